"""Order-dependent operators, edge cases of search, JSON, timelines, status and sinks."""

import json
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows
from evidence_spark.functions import convert as C
from evidence_spark.functions import jsonfix, leaves
from evidence_spark.functions import records as R
from evidence_spark.operators import heuristics as H
from evidence_spark.operators import ioc as I
from evidence_spark.operators import reconstruct as J
from evidence_spark.operators import registry as U
from evidence_spark.operators import search as S
from evidence_spark.operators import status as P
from evidence_spark.operators import timeline as T


@settings(max_examples=10, deadline=None)
@given(st.lists(st.booleans(), max_size=24))
def test_pairing_equals_a_stack(spark, steps):
    df = spark.createDataFrame([("k", i, b) for i, b in enumerate(steps)], "k string, i int, is_request boolean")
    want, open_ = [], []
    for i, b in enumerate(steps):
        if b:
            open_.append(i)
        elif open_:
            want.append((i, open_.pop()))
    assert rows(J.pair_requests(df, ["k"], ["i"]), "i", "request_i") == sorted(want, key=repr)


def test_walk_stops_at_cycles(spark):
    df = spark.createDataFrame([("M", 1, None), ("M", 2, 1), ("M", 3, 2), ("M", 8, 9), ("M", 9, 8), ("N", 2, 7)], "machine string, pid int, ppid int")
    out = J.process_tree(df, max_depth=6)
    assert rows(out, "machine", "pid", "depth") == [("M", 1, 0), ("M", 2, 1), ("M", 3, 2), ("N", 2, 0)]


def test_missing_ids(spark):
    df = spark.createDataFrame([("a", 1), ("a", 4), ("a", 4), ("b", 5), ("a", 7)], "m string, i long")
    out = rows(H.missing_ids(df, ["m"], "i"), "m", "missing_id", "previous_id")
    assert out == [("a", 2, 1), ("a", 3, 1), ("a", 5, 4), ("a", 6, 4)]


def test_unused_processes_in_spite_of_null_keys(spark):
    usage = spark.createDataFrame([("M", 1, 5), ("M", None, 6)], "machine string, p int, bytes int")
    procs = spark.createDataFrame([("M", 1, "x"), ("M", 2, "y")], "machine string, p int, name string")
    assert rows(J.usage_with_process(usage, procs, "p"), "p", "bytes", "name") == [(1, 5, "x"), (2, None, "y"), (None, 6, None)]


def test_version_diff(spark):
    df = spark.createDataFrame([("M", "f", 1, "a\nb"), ("M", "f", 2, "a\nc\nb"), ("M", "f", 3, "c")], "machine string, path string, modified int, text string")
    assert rows(J.version_diff(df), "modified", "line", "change") == [(2, "c", "added"), (3, "a", "removed"), (3, "b", "removed")]


def test_version_diff_has_moved_lines(spark):
    data = [("f", 1, "a\nb\nb\r\nc"), ("f", 2, "b\nb\nb\na\n"), ("f", 3, None), ("f", 4, "x"), ("g", 1, "only"), (None, 1, "p\nq"), (None, 2, "q\np")]
    df = spark.createDataFrame(data, "path string, modified int, text string")
    got = [tuple(r) for r in J.version_diff(df, ["path"]).orderBy("path", "modified", "at").select("path", "modified", "line", "change").collect()]
    assert got == [
        (None, 2, "q", "added"), (None, 2, "q", "removed"),
        ("f", 2, "a", "removed"), ("f", 2, "c", "removed"), ("f", 2, "b", "added"), ("f", 2, "a", "added"),
        ("f", 3, "b", "removed"), ("f", 3, "b", "removed"), ("f", 3, "b", "removed"), ("f", 3, "a", "removed"), ("f", 4, "x", "added"),
    ]


def test_version_diffs_turn_one_version_into_the_next(spark):
    rng = random.Random(8)
    texts = ["\n".join(rng.choice(["a", "b", "c", "", "--", "++x"]) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "modified int, text string").withColumn("path", F.lit("f"))
    by = {}
    for r in J.version_diff(df, ["path"]).orderBy("modified", "at").collect():
        by.setdefault(r["modified"], []).append((r["line"], r["change"]))
    lines_of = lambda t: t[:-1].split("\n") if t.endswith("\n") else t.split("\n") if t else []
    for i in range(1, len(texts)):
        old, new = lines_of(texts[i - 1]), lines_of(texts[i])
        gone, came = Counter(x for x, c in by.get(i, []) if c == "removed"), Counter(x for x, c in by.get(i, []) if c == "added")
        assert Counter(old) - gone + came == Counter(new)
        kept = list((Counter(old) - gone).elements())
        assert not gone - Counter(old) and len(kept) + came.total() == len(new)


def test_requests_of_a_hot_key_in_blocks(spark):
    """One key with nearly all rows, in few and in many blocks: as a stack pairs them."""
    rng = random.Random(9)
    runs = [rng.random() < p for p in (0.5, 0.9, 0.1, 0.5, 1, 0, 0.3, 0.7) for _ in range(150)]
    data = [(None if i % 50 == 0 else "cold" if i % 11 == 0 else "hot", i, q) for i, q in enumerate(runs)]
    df = spark.createDataFrame(data, "k string, i int, is_request boolean").repartition(5)
    want, open_ = [], {}
    for k, i, q in data:
        if q:
            open_.setdefault(k, []).append(i)
        elif open_.get(k):
            want.append((k, i, open_[k].pop()))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "3", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            assert rows(J.pair_requests(df, ["k"], ["i"]), "k", "i", "request_i") == sorted(want, key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(want) > 300


def test_public_suffix_rules(spark):
    rules = C.load_suffixes("// comment\ncom\nck\n*.ck\n!www.ck\njp\n*.kobe.jp\n!city.kobe.jp\nco.uk\nuk // tail\n")
    cases = {
        "http://www.ck/": "www.ck", "http://a.www.ck/": "www.ck", "http://b.ck/": None, "http://a.b.ck/": "a.b.ck", "http://x.a.b.ck/": "a.b.ck", "http://com/": None, "http://X.COM.": "x.com",
        "http://c.kobe.jp/": None, "http://b.c.kobe.jp/": "b.c.kobe.jp", "http://city.kobe.jp/": "city.kobe.jp", "http://a.city.kobe.jp/": "city.kobe.jp", "http://a.jp": "a.jp", "http://a.co.uk": "a.co.uk",
        "http://co.uk/": None, "http://10.0.0.1/x": None, "http://a.b.unknown/": "b.unknown", "no url": None, None: None,
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    assert {r["u"]: r["d"] for r in df.select("u", C.registrable_domain("u", rules).alias("d")).collect()} == cases
    many = [f"s{i}.test" for i in range(9000)]
    assert df.limit(1).select(C.registrable_domain(F.lit("http://a.b.s8999.test"), many)).first()[0] == "b.s8999.test"


def test_deep_trees(spark):
    """A chain far deeper than any level-by-level walk, and a cycle."""
    n = 300
    df = spark.createDataFrame([(i, i - 1 if i else None) for i in range(n)] + [(1000, 1001), (1001, 1000), (1002, 1001), (7000, 7000)], "pid int, ppid int")
    got = {r["pid"]: r for r in J.process_tree(df, keys=()).collect()}
    assert set(got) == {*range(n), 7000} and all(got[i]["depth"] == i for i in range(n))
    assert got[n - 1]["path"] == "/".join(f"{i:012d}" for i in range(n))
    assert J.process_tree(df, keys=(), max_depth=5).count() == 7


def test_substrings_on_both_sides_of_the_pattern_limit(spark, monkeypatch):
    values = ["", "abc", "x.Example.com", "longer.example.com", "a", "é.test", "[.*", "no.such.thing.test"]
    texts = [None, "", "http:/X.EXAMPLE.com/abc", "see longer.example.com.", "É.test", "a[.*b", "zzz", "AbC"]
    iocs = spark.createDataFrame([("domain", v) for v in values] + [("process", "zzz")], "kind string, value string")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    want = sorted((i, v) for i, t in enumerate(texts) for v in values if t and v and v.lower() in t.lower())
    assert rows(I.match_path_mention(df, "t", iocs), "i", "ioc") == want
    for limit, chars in ((0, 1000), (3, 1000), (0, 20), (0, 1)):
        monkeypatch.setattr(I, "PATTERN_MAX", limit)
        monkeypatch.setattr(I, "AUTOMATON_CHARS", chars)
        assert rows(I.match_path_mention(df, "t", iocs), "i", "ioc") == want
    assert I.match_any_field(df.withColumnsRenamed({"i": "record_id", "t": "value"}), iocs).count() == len(want) + 1


def test_many_indicators_cost_one_pass(spark):
    """A hundred thousand indicators: rows grow with hits only, and are those of plain search."""
    values = [f"{i * 2654435761 % 2**32:x}.{'net' if i % 2 else 'Example.org'}" for i in range(100_000)] + ["net", "9.net"]
    texts = [f"/a/{values[i * 37 % 100_000].upper()}/b-{values[i]}" if i % 5 == 0 else f"/a/{i:x}x" for i in range(1000)]
    iocs = spark.createDataFrame([("domain", v) for v in values], "kind string, value string")
    got = I.match_path_mention(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t", iocs)
    lower = [(v, v.lower()) for v in values]
    want = sorted(((i, v) for i, t in enumerate(texts) if i % 5 == 0 for low in [t.lower()] for v, x in lower if x in low), key=repr)
    assert rows(got, "i", "ioc") == want and len(want) > 400
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Generate") == 1


def test_path_prefixes_of_many_lengths(spark, monkeypatch):
    paths = ["/" + "a" * i for i in range(1, 30)] + ["/b", "", None]
    iocs = spark.createDataFrame([("file_path", "/" + "a" * i + "/" * (i % 2)) for i in range(1, 25)] + [("file_path", ""), ("file_path", "/")], "kind string, value string")
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    want = sorted((p, "/" + "a" * i) for p in paths for i in range(1, 25) if p and p.startswith("/" + "a" * i))
    assert rows(I.match_path_prefix(df, "p", iocs), "p", "ioc") == want
    monkeypatch.setattr(I, "PREFIX_LENGTHS", 3)
    assert rows(I.match_path_prefix(df, "p", iocs), "p", "ioc") == want


def test_pages_reach_records_without_a_key(spark):
    data = [(f"{i:02d}", json.dumps({"@timestamp": f"t{i % 3}"} if i % 4 else {"@timestamp": "x" * 300} if i % 8 else {})) for i in range(20)]
    df = spark.createDataFrame([(i, d, "c") for i, d in data], "record_id string, data string, data_type string")
    seen, key, last = [], "", ""
    while True:
        got = [(R.get_path("v", "@timestamp"), r) for r in S.page_after(df, key, last, 6).select("record_id", R.get_path("v", "@timestamp").alias("t")).collect()]
        if not got:
            break
        seen += [r["record_id"] for _, r in got]
        r = got[-1][1]
        key, last = (r["t"] if r["t"] and len(r["t"]) <= 256 else None), r["record_id"]
    assert seen == [r["record_id"] for r in S.sort_records(df).collect()] and len(seen) == 20


def test_json_of_odd_shapes(spark):
    deep = "[" * 100_000 + "]" * 100_000
    df = spark.createDataFrame([(1, "[1]"), (2, "5"), (3, deep), (4, "{bad"), (5, None), (6, '{"a": 3}'), (7, '"text"')], "i int, data string")
    assert rows(df.select("i", jsonfix.set_path("data", "a.b", F.lit("x")).alias("o"))) == [(1, None), (2, None), (3, None), (4, None), (5, '{"a":{"b":"x"}}'), (6, '{"a":{"b":"x"}}'), (7, None)]
    some = df.where("i <> 3")
    assert rows(leaves.flatten_leaves(some), "i", "path", "value") == [(1, "0", "1"), (2, "", "5"), (6, "a", "3"), (7, "", "text")]
    assert leaves.with_catch_all(df).count() == 7 and leaves.field_catalog(some).count() == 4
    assert [r[0] for r in rows(leaves.unparsed(df), "i")] == [3, 4]


def plain_leaves(x, path=""):
    if isinstance(x, dict | list):
        for k, v in x.items() if isinstance(x, dict) else enumerate(x):
            yield from plain_leaves(v, f"{path}.{k}" if path else str(k))
    else:
        kind = "string" if isinstance(x, str) else "null" if x is None else "boolean" if isinstance(x, bool) else "number"
        yield path, x if isinstance(x, str) else None if x is None else json.dumps(x), kind


def test_leaves_equal_a_plain_walk(spark):
    rng = random.Random(3)
    words = ["", "a", "A b", 'q"uo\\te', "\\", '"', "é😀", "\n\t", "[x]", "{}:", '":', "null", "1.0", "\u0007"]
    numbers = [0, 1, -7, 10**17, 12345678901234567890, 1.0, 0.1, -2.5, 1e5, 1.5e-7, 0.00015, 1e7, 12345678.9, 1e16, 2.5e20, 1e-10, 100.0, -3e-5]

    def make(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice([None, True, False, rng.choice(words), rng.choice(numbers)])
        if rng.random() < 0.5:
            return [make(depth - 1) for _ in range(rng.randint(0, 3))]
        return {rng.choice(words): make(depth - 1) for _ in range(rng.randint(0, 4))}

    made = [make(rng.randint(0, 11)) for _ in range(300)] + words + numbers
    data = [(i, json.dumps(x, ensure_ascii=bool(i % 2), separators=(",", ":") if i % 3 else (", ", ": "))) for i, x in enumerate(made)]
    df = spark.createDataFrame(data, "i int, data string").withColumns({"path": F.lit("p0"), "pos": F.lit(1), "key": F.lit(2)})
    got = leaves.flatten_leaves(df.drop("path"))
    assert rows(got, "i", "path", "value", "kind") == sorted(((i, *leaf) for i, x in enumerate(made) for leaf in plain_leaves(x)), key=repr)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString() and "Arrow" not in got._jdf.queryExecution().executedPlan().toString()
    for r in leaves.with_catch_all(df).select("i", "catch_all").collect():
        assert sorted(r["catch_all"]) == sorted(v.lower() for _, v, _ in plain_leaves(made[r["i"]]) if v is not None)


def test_leaves_of_any_depth(spark):
    deep = json.loads("[" * 40 + "1" + "]" * 40)
    df = spark.createDataFrame([(1, json.dumps(deep)), (2, '{"a":{"b":[{"c":"x"}]}}'), (3, '"{[[["'), (4, "[[],{}]")], "i int, data string")
    assert [r[0] for r in rows(df.select("i", leaves.json_depth("data").alias("n")), "n")] == [0, 2, 4, 40]
    assert rows(leaves.flatten_leaves(df), "i", "path", "value") == [(1, ".".join("0" * 40), "1"), (2, "a.b.0.c", "x"), (3, "", "{[[[")]
    levels = "[" * 3000 + '{"a b":1}' + "]" * 3000
    one = spark.createDataFrame([(levels,)], "data string")
    assert one.select(jsonfix.sanitize_keys("data")).first()[0] == levels.replace("a b", "a_b")


def test_truncated_process_name(spark):
    iocs = spark.createDataFrame([("process", "abcdefghijklmnopqrs"), ("process", "short")], "kind string, value string")
    df = spark.createDataFrame([("/x/abcdefghijklmnop",), ("/x/abcdefghijklmno",), ("short",), (None,)], "p string")
    assert rows(I.match_process(df, "p", iocs), "p", "ioc") == [("/x/abcdefghijklmnop", "abcdefghijklmnopqrs"), ("short", "short")]


def test_indicators(spark, tmp_path):
    bundle = {"objects": [{"type": "indicator", "pattern": "[domain-name:value='Bad.Example.com']"}, {"type": "indicator", "pattern": "[email-addr:value='A@b.c']"}, {"type": "malware"}, {"type": "indicator", "pattern": "[domain-name:value='bad.example.com']"}, {"type": "indicator", "pattern": "[file:hashes.sha256='AB']"}]}
    (tmp_path / "a.stix2").write_text(json.dumps(bundle))
    assert rows(I.load_indicators(spark, str(tmp_path))) == [("domain", "bad.example.com"), ("email", "a@b.c"), ("sha256", "AB")]


def test_subdomain_indicator_needs_the_host(spark):
    iocs = spark.createDataFrame([("domain", "x.evil.com"), ("domain", "evil.org")], "kind string, value string")
    df = spark.createDataFrame([("http://evil.com/",), ("https://x.evil.com:8/a",), ("http://y.evil.org",), ("http://www.x.evil.com",), ("none",)], "u string")
    assert rows(I.match_domain(df, "u", iocs)) == [("http://www.x.evil.com", "x.evil.com"), ("http://y.evil.org", "evil.org"), ("https://x.evil.com:8/a", "x.evil.com")]


def test_query_strings(spark):
    data = [("1", "M1", "event", '{"a":{"b":"x \\"y\\""},"n":1}'), ("2", "M2", "event", '{"a":{"b":"Other"}}'), ("3", "M3", "tag", '{"a":{"b":"other"}}')]
    df = spark.createDataFrame(data, "record_id string, machine string, data_type string, data string")

    def found(q):
        return [r[0] for r in rows(S.search(df, S.compile_query(q)), "record_id")]

    assert found('Data.a.b:"OTHER"') == ["2"]
    assert found(r'Data.a.b:"x \"y\""') == ["1"]
    assert found("") == ["1", "2"]
    assert found('NOT Data.a.b:"other"') == ["1"]
    assert found('machine:"M1" OR machine:"M2" AND Data.a.b:"none"') == ["1"]
    assert found('(machine:"M1" OR machine:"M2") AND Data.a.b:"oth*"') == ["2"]
    for bad in ('(machine:"M1"', 'machine:"M1")', "AND"):
        with pytest.raises(ValueError):
            S.compile_query(bad)


def test_json_rewrites(spark):
    text = '{"a.b":1,"a b":2,"l":[true,{"x/y":null}],"s":"t"}'
    df = spark.createDataFrame([(text,), ("no json",), (None,)], "data string")
    got = [r[0] for r in df.select(jsonfix.normalize_json("data")).collect()]
    assert json.loads(got[0]) == {"a_b": "2", "l": {"0": "True", "1": {"x_y": "None"}}, "s": "t"} and got[1:] == [None, None]
    found = rows(leaves.flatten_leaves(df), "path", "value", "kind")
    assert ("l.0", "true", "boolean") in found and ("l.1.x/y", None, "null") in found
    one = df.limit(1).select(jsonfix.set_path(F.col("data"), "s.t.u", F.lit("v"))).first()[0]
    assert json.loads(one)["s"] == {"t": {"u": "v"}}


def test_event_normalisation(spark):
    raw = {"Event": {"#attributes": {"xmlns": "u"}, "System": {"EventID": 7, "Correlation": None, "TimeCreated": {"#attributes": {"SystemTime": "2024-01-01T00:00:00Z"}}}, "EventData": {"Data": "text", "Gone": None}, "UserData": {"Data": {"#text": ["a", "b"]}}}}
    x = jsonfix.normalize_event(raw)
    assert x["@timestamp"] == "2024-01-01T00:00:00Z"
    assert x["Event"]["System"] == {"EventID": {"#text": 7}, "TimeCreated": {"@SystemTime": "2024-01-01T00:00:00Z"}}
    assert x["Event"]["EventData"] == {"DataText": "text"} and x["Event"]["UserData"]["Data"]["#text"] == "a\nb"
    flat = jsonfix.flatten_event({"Event": {"System": {"Provider": {"#attributes": {"Name": "n"}}, "EventID": 5}, "EventData": {"Data": {"#text": ["p", "q"]}}}})
    assert flat == {"Provider.Name": "n", "EventID": "5", "Data.Data0": "p", "Data.Data1": "q"}
    df = spark.createDataFrame([(json.dumps(raw),)], "data string")
    assert df.select(jsonfix.flatten_event_map("data")).first()[0]["EventID"] == "7"
    assert json.loads(df.select(jsonfix.normalize_evtx_json("data")).first()[0])["Event"]["EventData"] == {"DataText": "text"}


def test_conflicts(spark):
    df = spark.createDataFrame([('{"o":"None","d":"2024-13","t":{"a":1,"b":"x"}}',), ('{"o":{"k":1},"d":"2024-01-01 00:00:00","t":["p","q"]}',), ("{}",)], "data string")
    got = rows(R.repair_conflicts(df, {"o": "object", "d": "date", "t": "text"}), "o", "d", "t")
    assert sorted(map(repr, got)) == sorted(map(repr, [(None, "1700-01-01T00:00:00", "a=1\nb=x"), ('{"k":1}', "2024-01-01T00:00:00", "p\nq"), (None, None, None)]))


def test_conversions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.cast("string")).first()[0]
    assert get(C.filetime_to_ts(F.lit(116444736000000010))) == "1970-01-01 00:00:00.000001"
    assert get(C.mac_to_ts(F.lit(0))) is None
    assert get(C.mac_to_ts(F.lit(1), from_2001=False)) == "1970-01-01 00:00:01"
    assert get(C.url_domain(F.lit("http://web.example.org/"))) == "web.example.org"
    assert get(C.registrable_domain(F.lit("http://a.b.example.co.uk"))) == "example.co.uk"
    assert get(C.ipv6_to_mac(F.lit("0" * 31 + "1"))) == "Local Host ::1"
    assert get(C.folder_to_url(F.lit("file__0"))) is None
    assert get(C.decode_flags(F.lit(0x80000101), C.USN_REASONS)) == "DATA_OVERWRITE FILE_CREATE CLOSE"


def test_views_and_labels(spark):
    pytest.importorskip("yaml")
    views = T.load_views("- name: v\n  condition:\n    query: 'data_type:\"x\"'\n  fields:\n    A: 'a ${Data.k}'\n")
    df = spark.createDataFrame([("1", "m", "x", '{"k":3}')], "record_id string, machine string, data_type string, data string")
    assert T.render_view(df, views[0]).first()["A"] == "a 3"
    with pytest.raises(ValueError):
        T.load_views("- name: v\n")


def test_first_run_ignores_unknown(spark):
    df = spark.createDataFrame([(["1700-01-01T00:00:00", "2024-01-02", "2024-01-01"],), (["1700-01-01T00:00:00"],)], "r array<string>")
    assert rows(T.first_last_run(df, "r"), "first_run", "last_run") == [("2024-01-01", "2024-01-02"), (None, None)]


def test_status(spark):
    s = "machine string, file_path string, parser_name string, status string, start_time string, disabled boolean"
    st_ = spark.createDataFrame([("M", "a", "p", "done", "1", False), ("M", "b", "p", "error", "1", None), ("M", "c", "p", "error", "1", True)], s)
    routed = spark.createDataFrame([("M", x, "p") for x in "abcd"], "machine string, file_path string, parser_name string")
    assert rows(P.pending_files(routed, st_), "file_path") == [("b",), ("d",)]
    new = spark.createDataFrame([("M", "a", "p", "error", "1", False)], s)
    assert rows(P.upsert_status(st_, new).where("file_path = 'a'"), "status") == [("error",)]


def test_user_parser_and_module(spark):
    def parser(path, content):
        if content == b"bad":
            return None, "unreadable"
        if content == b"boom":
            raise ValueError("x")
        return [{"n": i} for i in range(len(content))]

    U.register_parser("p", parser)
    files = spark.createDataFrame([("a", b"12"), ("b", b"bad"), ("c", b"boom")], "path string, content binary")
    assert rows(U.run_parser(files, "p")) == [("a", '{"n": 0}', None), ("a", '{"n": 1}', None), ("b", None, "unreadable"), ("c", None, "ValueError: x")]
    U.register_module("m", lambda t: t, lambda r, i: r.join(i, "path", "left_semi"), lambda r: r.select(F.col("path").alias("event")))
    out = U.run_module("m", files.where("path = 'a'").select("path"), files)
    assert out["detected"].count() == 1 and out["timeline"].count() == 3


def test_tags_keep_free_messages(spark):
    s = "record_id string, tag_type string, time string, message string"
    old = spark.createDataFrame([("1", "legit", "1", ""), (None, "suspicious", "1", "m")], s)
    new = spark.createDataFrame([("1", "malicious", "2", ""), (None, "suspicious", "1", "m"), (None, "suspicious", "2", "n")], s)
    assert rows(S.add_tags(old, new), "record_id", "tag_type", "message") == [("1", "malicious", ""), (None, "suspicious", "m"), (None, "suspicious", "n")]


def test_wide_gaps_are_given_whole(spark, monkeypatch):
    df = spark.createDataFrame([(None, 5), (None, 8), ("a", 1), ("a", 1_500_003), ("a", 1_500_005), ("b", -3), ("b", 2), ("b", None)], "m string, i long")
    got = H.missing_ids(df, ["m"], "i")
    assert got.where("m = 'a'").count() == 1_500_002 and got.where("m = 'a'").agg(F.count_distinct("missing_id")).first()[0] == 1_500_002
    assert rows(got.where("m <=> 'b' or m is null"), "m", "missing_id", "previous_id", "gap") == sorted([(None, 6, 5, 2), (None, 7, 5, 2), *[("b", i, -3, 4) for i in range(-2, 2)]], key=repr)
    monkeypatch.setattr(H, "ID_BLOCK", 7)
    monkeypatch.setattr(H, "ID_ARRAY", 3)
    small = df.where("i < 1000000")
    assert rows(H.missing_ids(small.union(spark.createDataFrame([("a", 40), ("a", 41)], "m string, i long")), ["m"], "i").where("m = 'a'"), "missing_id") == sorted([(i,) for i in range(2, 40)], key=repr)


def test_rows_without_a_key_are_counted(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "k string, i int")
    assert rows(H.with_occurrences(df, "k"), "i", "occurrences") == [(1, 1), (2, 2), (3, 2)]


def test_views_of_one_name_are_refused():
    view = "- {name: v, condition: {default: true}, fields: {A: x}}\n"
    with pytest.raises(ValueError, match="twice"):
        T.load_views(view, view)
    with pytest.raises(ValueError, match="no query"):
        T.load_views("- {name: v, condition: {}, fields: {A: x}}")


def _by_sql(spark, tmp_path, name, table, df):
    """Rows of a query and of its SQL over a table made here."""
    import duckdb

    import __spark_entry__

    df.coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    out = __spark_entry__.queries()[name](spark, str(tmp_path))
    cur = db.execute(__spark_entry__.oracle_sql()[name])
    return rows(out, *[x[0] for x in cur.description]), sorted(cur.fetchall(), key=repr)


def test_address_of_a_number_of_more_than_32_bits(spark, tmp_path):
    got, want = _by_sql(spark, tmp_path, "c15_ipv4", "events", spark.range(542_370, 542_390).withColumnRenamed("id", "event_id"))
    assert got == want and (542_378, "0.1.228.182") in got


def test_short_hosts_are_compared_whole(spark, tmp_path):
    urls = ["https://www.therin.example.net/a", "https://therin.example.net/a", "http://thther.example.org", "http://x.example.org", "none", None]
    got, want = _by_sql(spark, tmp_path, "c21_shortened", "pages", spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"))
    assert got == want == [(0, False), (1, True), (2, True), (3, False), (4, False), (5, None)]
    assert spark.createDataFrame([("http://www.bit.ly/x",)], "u string").select(C.is_shortened("u", ["bit.ly"])).first()[0] is True
