"""Rule semantics, with each of their quirks."""

import fnmatch
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows
from evidence_spark.functions.records import variant
from evidence_spark.operators import rules as D


def records(spark, *data, kind="Events"):
    made = [(str(i), "c", "M1", kind, json.dumps(x)) for i, x in enumerate(data)]
    return spark.createDataFrame(made, "record_id string, case_id string, machine string, data_type string, data string").withColumn("v", variant("data"))


def ids(df):
    return sorted(r["record_id"] for r in df.select("record_id").distinct().collect())


EVENT = {"@timestamp": "2024-01-01T00:00:00", "Event": {"System": {"EventID": {"#text": 4624}}, "EventData": {"User": "Admin", "Path": "C:\\Users\\Admin\\x.exe", "Empty": ""}}}


def hit(spark, rule, *data, ruleset=(), **kw):
    r = rule if isinstance(rule, D.Rule) else D.Rule("r", description="d", **rule)
    return ids(D.scan(records(spark, *data), [*ruleset, r], **kw))


def test_include(spark):
    assert hit(spark, {"include": {"Event.EventData.User": "adm*"}}, EVENT) == ["0"]
    assert hit(spark, {"include": {"Event.EventData.User": ["x", "ADMIN"]}}, EVENT) == ["0"]
    assert hit(spark, {"include": {"Event.EventData.User": "admin", "Event.None": "*"}}, EVENT) == []
    assert hit(spark, {"include": {"Event.EventData.Empty": "*"}}, EVENT) == []


def test_int_and_text_ids(spark):
    assert hit(spark, {"include": {"Event.System.EventID.#text": "4624"}}, EVENT) == ["0"]
    assert hit(spark, {"include": {"Event.System.EventID.#text": 4624}}, EVENT) == ["0"]
    assert hit(spark, {"include": {"Event.System.EventID.#text": [1, 2]}}, EVENT) == []


def test_exclude_scalar_keeps_and_list_rejects_missing(spark):
    base = {"Event.EventData.User": "admin"}
    assert hit(spark, {"include": base, "exclude": {"Event.None": "x"}}, EVENT) == ["0"]
    assert hit(spark, {"include": base, "exclude": {"Event.None": ["x"]}}, EVENT) == []
    assert hit(spark, {"include": base, "exclude": {"Event.EventData.Path": ["*.dll"]}}, EVENT) == ["0"]
    assert hit(spark, {"include": base, "exclude": {"Event.EventData.Path": "*.exe"}}, EVENT) == []


def test_exclude_only_never_fires(spark):
    assert hit(spark, {"exclude": {"Event.EventData.User": "x"}}, EVENT) == []


def test_modifiers(spark):
    base = {"Event.EventData.User": "admin"}
    assert hit(spark, {"include": base, "modifiers": ["Event.EventData.User == 5"]}, EVENT) == ["0"]
    assert hit(spark, {"include": base, "modifiers": ["Event.EventData.User $rex A.min"]}, EVENT) == ["0"]
    assert hit(spark, {"include": base, "modifiers": ["Event.EventData.User $rex dmi"]}, EVENT) == []
    assert hit(spark, {"include": base, "modifiers": ["Event.None > 0"]}, EVENT) == []
    assert hit(spark, {"include": base, "modifiers": ["search $rex x\\.exe"]}, EVENT) == ["0"]
    assert hit(spark, {"include": base, "modifiers": ["search $str *x.ex?*"]}, EVENT) == ["0"]
    dotted = {"include": base, "modifiers": ["Event.EventData.User == 5"]}
    assert hit(spark, dotted, EVENT, lookup="flat") == []


def test_variables(spark):
    path = "Event.EventData.Path"
    assert hit(spark, {"include": {path: "$Event.EventData.User"}}, EVENT) == ["0"]
    assert hit(spark, {"include": {"Event.EventData.User": "$WHO"}}, EVENT, variables={"WHO": ["root", "admin"]}) == ["0"]
    assert hit(spark, {"include": {"Event.EventData.User": "$WHO"}}, EVENT, variables={"WHO": "root"}) == []


def test_one_value_is_contained_and_a_list_has_the_whole(spark):
    user = "Event.EventData.User"
    assert hit(spark, {"include": {user: "$WHO"}}, EVENT, variables={"WHO": "DMI"}) == ["0"]
    assert hit(spark, {"include": {user: "$WHO"}}, EVENT, variables={"WHO": "a?min"}) == ["0"]
    assert hit(spark, {"include": {user: "$WHO"}}, EVENT, variables={"WHO": ["dmi", "a*"]}) == []
    assert hit(spark, {"exclude": {user: "$WHO"}, "include": {user: "*"}}, EVENT, variables={"WHO": "dm"}) == []


def test_search_is_anchored(spark):
    base = {"Event.EventData.User": "*"}
    assert hit(spark, {"include": base, "modifiers": ["search $str admin"]}, EVENT) == []
    assert hit(spark, {"include": base, "modifiers": ["search $str *admin"]}, EVENT) == []
    assert hit(spark, {"include": base, "modifiers": ["search $str *ADMIN*"]}, EVENT) == ["0"]
    assert hit(spark, {"include": base, "modifiers": ["search $str $WHO"]}, EVENT, variables={"WHO": "admin"}) == ["0"]
    assert hit(spark, {"include": base, "modifiers": ["search $str $WHO"]}, EVENT, variables={"WHO": ["root", "Admin"]}) == ["0"]


def test_globs_of_columns_equal_fnmatch(spark):
    values = ["abc", "a.c", "a[c", "a\\c", "x\ny", "a-c", "äbc", "a]c", "a[!b", "(a|c)$", "[[]", "a{1}"]
    patterns = ["*", "a*", "*b*", "a[bx]c", "a[!b]c", "a.c", "a[c", "*[*", "??", "a\\c", "*(a|c)*", "[[]", "[z-a]", "a{1}", "*]*", "[!", "$"]
    df = spark.createDataFrame([(v, p) for v in values for p in patterns], "v string, p string")
    for r in df.select("v", "p", D.glob_match_column(F.col("v"), F.col("p")).alias("hit")).collect():
        p = r["p"].replace("[z-a]", "[[]z-a]").replace("[[]", "[[]") if r["p"] != "[[]" else "[[][[]]"
        assert r["hit"] == fnmatch.fnmatchcase(r["v"].lower(), p.lower()), (r["v"], r["p"])


def test_bursts_are_dealt_to_parts(spark, monkeypatch):
    """Many records of one moment: all pairs, and no part of the bucket holds them all."""
    monkeypatch.setattr(D, "PAIRS", 100)
    private = {n: D.Rule(n, False, include={"t": n}) for n in "ab"}
    df = records(spark, *[{**at(5), "t": "ab"[i % 2]} for i in range(60)])
    got = D.correlate(df, D.Rule("R", calls=["a", "b"], within=1000), private)
    assert got.count() == 900
    assert "_x" in got._jdf.queryExecution().optimizedPlan().toString()


def test_even_records_are_hardly_copied(spark, monkeypatch):
    """Records far apart: a few near the border of a bucket are copied, and nothing is dealt."""
    private = {n: D.Rule(n, False, include={"t": n}) for n in "ab"}
    df = records(spark, *[{**at(i % 50), "@timestamp": f"2024-01-01T{i // 3600:02d}:{i // 60 % 60:02d}:{i % 60:02d}", "t": "ab"[i % 2]} for i in range(0, 4000)])
    got = D.correlate(df, D.Rule("R", calls=["a", "b"], within=2000), private)
    assert got.count() == 3999
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_x" not in plan and plan.count("explode") == 1


def test_windows_of_any_width_and_order(spark, monkeypatch):
    """Three rules, hot and even buckets: as plain loops find them, with what each rule returns."""
    import itertools
    import random

    rng = random.Random(6)
    times = [rng.choice([100, 100, rng.randint(0, 59_000)]) + rng.randint(0, 999) for _ in range(90)]
    data = [{"@timestamp": f"2024-01-01T00:00:{ms // 1000:02d}.{ms % 1000:03d}", "t": "abc"[i % 3], "n": i} for i, ms in enumerate(times)]
    private = {"a": D.Rule("a", False, include={"t": "a"}, returns=["n"]), "b": D.Rule("b", False, include={"t": "b"}), "c": D.Rule("c", False, include={"t": "c"}, returns=["t", "n"])}
    rule = D.Rule("R", calls=["a", "b", "c"], description="why", reference="where")
    for within, pairs in ((1, 4_000_000), (700, 4_000_000), (700, 20), (9000, 50)):
        monkeypatch.setattr(D, "PAIRS", pairs)
        got = D.correlate(records(spark, *data), rule, private, within)
        groups = [[i for i in range(90) if i % 3 == k] for k in range(3)]
        want = sorted([str(i) for i in x] for x in itertools.product(*groups) if max(times[i] for i in x) - min(times[i] for i in x) < within)
        out = got.collect()
        assert sorted(r["record_ids"] for r in out) == want
        for r in out[:50]:
            assert (r["description"], r["reference"]) == ("why", "where")
            assert json.loads(r["returned"]["a"])["n"] == r["record_ids"][0] and json.loads(r["returned"]["b"]) == data[int(r["record_ids"][1])]


def test_only_records_are_written(spark, monkeypatch):
    """All sets of a moment, of a bucket as it is and dealt, from tables that hold records, not pairs; each record is parsed once."""
    real, sizes, plans = D.cut, [], []

    def counted(df):
        out = real(df)
        sizes.append(out.count())
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return out

    monkeypatch.setattr(D, "cut", counted)
    private = {n: D.Rule(n, False, include={"t": n}) for n in "abc"}
    df = records(spark, *[{**at(5), "t": "abc"[i % 3]} for i in range(60)]).drop("v")
    for pairs in (4_000_000, 2):
        monkeypatch.setattr(D, "PAIRS", pairs)
        sizes.clear(), plans.clear()
        got = D.correlate(df, D.Rule("R", calls=["a", "b", "c"], within=1000), private)
        assert got.select("record_ids").distinct().count() == got.count() == 20**3
        assert sizes[0] == 60 and sum(sizes) <= 61
        assert plans[0].count("parseJson") == 1
        assert ("_x" in got._jdf.queryExecution().optimizedPlan().toString()) == (pairs == 2)


def test_time_texts_are_made_for_records(spark):
    """The text of the earliest time, whichever rule has it; no date is formatted after a join."""
    from conftest import DATA
    from evidence_spark.plans.catalog import QUERIES

    private = {n: D.Rule(n, False, include={"t": n}) for n in "abc"}
    df = records(spark, *[{**at(ms), "t": t} for ms, t in ((1999, "a"), (2000, "b"), (2001, "c"), (1500, "b"), (999, "c"), (1999, "c"))])
    got = D.correlate(df, D.Rule("R", calls=["a", "b", "c"], within=1500), private, time_format="yyyy-MM-dd HH:mm:ss")
    out = got.select("ts_text", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).collect()
    assert len(out) == 6 and len({r[0] for r in out}) == 2 and all(r[0] == r[1] for r in out)
    plan = QUERIES["d12_alert_content"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "date_format" in plan and "date_format" not in plan[: plan.rindex("Join Inner")]


def test_modifiers_in_any_shape():
    assert D.parse_modifier("Search   $str  a  b") == ("search", "$str", "a b")
    assert D.parse_modifier("a.b\t>=  7") == ("a.b", ">=", "7")
    assert D.parse_modifier("a.b $rex x  y$") == ("a.b", "$rex", "x  y$")
    with pytest.raises(ValueError, match="modifier"):
        D.parse_modifier("a >")


def test_channel(spark):
    assert hit(spark, {"channel": "EV*", "include": {"Event.EventData.User": "*"}}, EVENT) == ["0"]
    assert hit(spark, {"channel": "Other", "include": {"Event.EventData.User": "*"}}, EVENT) == []


def test_last_rule_wins_private_included(spark):
    a = D.Rule("A", include={"Event.EventData.User": "*"})
    b = D.Rule("B", False, include={"Event.EventData.User": "admin"})
    out = D.annotate(records(spark, EVENT, {"x": 1}), [a, b])
    assert rows(out, "record_id", "rule_match.rule_name") == [("0", "B"), ("1", None)]
    assert [r["rule_name"] for r in D.scan(records(spark, EVENT), [a, b]).collect()] == ["A"]


def at(ms):
    return {"@timestamp": f"2024-01-01T00:00:{ms // 1000:02d}.{ms % 1000:03d}", "k": ms}


def test_within_is_strict_and_unknown_time_is_out(spark):
    s, e = D.Rule("S", False, include={"k": "0"}), D.Rule("E", False, include={"k": ["1000", "999", "9"]})
    rule = D.Rule("R", calls=["S", "E"], within=1000)
    df = records(spark, at(0), at(1000), at(999), {"@timestamp": "1700-01-01T00:00:00", "k": 9}, {"@timestamp": "bad", "k": 9})
    got = D.correlate(df, rule, {"S": s, "E": e})
    assert [r["record_ids"] for r in got.collect()] == [["0", "2"]]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9000), st.sampled_from("abc")), min_size=3, max_size=14))
def test_correlation_equals_product(spark, events):
    import itertools

    private = {n: D.Rule(n, False, include={"t": n}) for n in "abc"}
    rule = D.Rule("R", calls=["a", "b", "c"], within=1500)
    df = records(spark, *[{**at(ms), "t": t} for ms, t in events])
    got = sorted(tuple(r["record_ids"]) for r in D.correlate(df, rule, private).collect())
    want = []
    groups = [[(ms, str(i)) for i, (ms, t) in enumerate(events) if t == n] for n in "abc"]
    for combo in itertools.product(*groups):
        times = [ms for ms, _ in combo]
        if max(times) - min(times) < 1500:
            want.append(tuple(i for _, i in combo))
    assert got == sorted(want)


def test_globs_equal_fnmatch(spark):
    values = ["abc", "ABC", "a.c", "a[c", "", "abcabc", "x\ny", "b", "a-c", "äbc", "a]c"]
    patterns = ["*", "a*", "*c", "*b*", "?b?", "a[bx]c", "a[!b]c", "a.c", "[", "a[c", "*[*", "??", "a[a-c]c", "[]]*", "a[]]c", "*a*c*"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for p in patterns:
        got = [r[0] for r in df.select(D.glob_match(F.col("v"), p)).collect()]
        assert got == [bool(v) and fnmatch.fnmatchcase(v.lower(), p.lower()) for v in values], p


TEXT = """
# a comment
public Burst
{
    metadata:
      author: "x"
      score: 70
      description: "d"
    Channel: "Events"
    include:
      Event.EventData.User:
        - "a*"
      Event.EventData.User: "b*"
    modifiers:
      - "Event.EventData.User > 1"
    returns:
      - Event.EventData.User
}
private Part
{
    metadata:
      description: "p"
    include:
      x: 1
}
public Both
{
    metadata:
      description: "c"
    include:
      rule:
        - Burst
        - Part
      if:
        within: 500
}
"""


def test_load_rules():
    pytest.importorskip("yaml")
    burst, part, both = D.load_rules(TEXT)
    assert (burst.score, burst.channel, burst.include, burst.returns) == (70, "Events", {"Event.EventData.User": "b*"}, ["Event.EventData.User"])
    assert (part.public, part.score) == (False, 10)
    assert (both.calls, both.within, both.include) == (["Burst", "Part"], 500, {})
    for bad in (TEXT + TEXT, "public A-b\n{\n  metadata:\n    description: d\n}\n", "public A\n{\n  include:\n    x: 1\n}\n"):
        with pytest.raises(ValueError):
            D.load_rules(bad)


def test_literals_of_globs():
    from evidence_spark.operators.rule_index import anchor, literal

    assert [literal(p) for p in ("*Abc*de?", "a[bc]defg*", "[!x]yz", "*", "a[b", "[]x]abc", "plain")] == ["abc", "defg", "yz", "", "a", "abc", "plain"]
    called = D.Rule("P", False, include={"id": 4624})
    assert anchor(D.Rule("r", include={"a": ["x*", "y"], "b": ["One", "two"]}), {}) == ("whole", "b", {"one", "two"})
    assert anchor(D.Rule("r", include={"a": "*"}, calls=["P"]), {"P": called}) == ("number", "id", {4624})
    assert anchor(D.Rule("r", channel="Sec", include={"a": "$WHO"}), {}) == ("channel", "", {"sec"})
    assert anchor(D.Rule("r", include={"a": ["abc", 7]}), {}) is None
    assert anchor(D.Rule("r", include={"a": ["*abcd*", "xyz"]}), {}) == ("part", "a", {"abcd", "xyz"})


def test_index_finds_what_all_rules_find(spark):
    """Hundreds of rules of every kind: the index gives what each rule gives by itself."""
    import random

    rng = random.Random(4)
    words = [f"{a}{b}{c}" for a in ("net", "Power", "cmd", "Äx") for b in ("shell", "user", "[x]", ".exe") for c in range(6)]
    shapes = [lambda w: w, lambda w: f"*{w}*", lambda w: f"{w[:4]}*", lambda w: f"*{w[3:]}", lambda w: f"{w[:2]}?{w[3:]}*", lambda w: "*", lambda w: f"*{w[:1]}*", lambda w: "$b", lambda w: "$WHO", lambda w: "", lambda w: True]
    rules = []
    for i in range(320):
        keys = rng.sample(["a", "b", "n.id"], rng.randint(0, 2)) or ["a"]
        include = {}
        for k in keys:
            some = [rng.choice(shapes)(rng.choice(words)) if k != "n.id" else rng.choice([rng.randint(0, 9), "7", "*"]) for _ in range(rng.randint(1, 3))]
            include[k] = some if len(some) > 1 or rng.random() < 0.5 else some[0]
        extra = {"exclude": {"b": f"*{rng.choice(words)}*"}} if rng.random() < 0.3 else {}
        rules.append(D.Rule(f"R{i}", rng.random() < 0.8, rng.choice(["*", "events", "Ev*", "none"]), include, **extra, modifiers=["a > 2"] if rng.random() < 0.2 else []))
    rules += [D.Rule(f"C{i}", calls=[f"R{i}"], include={"a": "*"}) for i in range(0, 40, 7)]
    data = [{"a": rng.choice(words) + rng.choice(["", "tail"]), "b": rng.choice([*words, "", None]), "n": {"id": rng.choice([7, "07", "7", 3, None])}, "flag": True} for _ in range(60)] + [{}, {"a": "true", "b": 5}]
    known = {"WHO": [words[0], words[5]]}
    df = records(spark, *data)
    got = {r["record_id"]: [m["rule_name"] for m in r["matches"]] for r in D.matches(df, rules, known, public_only=False).select("record_id", "matches").collect()}
    by_name = {r.name: r for r in rules}
    want = {str(i): [] for i in range(len(data))}
    for start in range(0, len(rules), 40):
        some = rules[start : start + 40]
        flags = df.select("record_id", *[D.rule_condition(r, by_name, known).alias(r.name) for r in some]).collect()
        for row in flags:
            want[row["record_id"]] += [r.name for r in some if row[r.name]]
    assert got == want and sum(map(len, want.values())) > 500


def test_records_of_other_channels_are_not_parsed(spark):
    df = spark.createDataFrame([("0", "c", "M", "Events", '{"a": "x"}'), ("1", "c", "M", "Other", "{not json")], "record_id string, case_id string, machine string, data_type string, data string")
    rules = [D.Rule("A", channel="ev*", include={"a": "x"}), D.Rule("B", channel="events", include={"a": "*"})]
    out = D.matches(df, rules)
    assert {r["record_id"]: (r["v"] is None, len(r["matches"])) for r in out.selectExpr("record_id", "to_json(v) as v", "matches").collect()} == {"0": (False, 2), "1": (True, 0)}
    assert rows(D.annotate(df, rules).select("record_id", "rule_match.rule_name")) == [("0", "B"), ("1", None)]
