"""Detection rules compiled to Columns.

A rule matches a record when its channel fits, every include key has a matching value,
no exclude key has one, all modifiers hold, and at least one string was matched. An
exclude key with one value keeps a record that lacks the field; one with a list rejects it.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_spark.functions.records import get_path, json_path, variant
from evidence_spark.functions.storage import cut
from evidence_spark.operators.rule_index import found_rules, text

_META = re.compile(r"[*?\[]")
#: Channels of rules up to which a record's channel is tested before its text is parsed.
CHANNELS = 16
#: Windows of a time bucket in correlations, pairs of a bucket that one task may join, and how many times as many sets of more than two rules.
WIDE, PAIRS, SETS = 4, 4_000_000, 64


@dataclass
class Rule:
    name: str
    public: bool = True
    channel: str = "*"
    include: dict = field(default_factory=dict)
    exclude: dict = field(default_factory=dict)
    modifiers: list[str] = field(default_factory=list)
    returns: list[str] = field(default_factory=list)
    score: int = 10
    description: str = ""
    reference: str = ""
    within: int | None = None
    calls: list[str] = field(default_factory=list)


def glob_regex(pattern: str) -> str:
    """``*``, ``?``, ``[seq]`` and ``[!seq]`` -> an anchored expression, whatever the case."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            j = i + (pattern[i : i + 1] in ("!", "^"))
            j += pattern[j : j + 1] == "]"
            j = pattern.find("]", j)
            if j < 0:
                out.append(r"\[")
            else:
                body = pattern[i:j]
                no = body.startswith("!")
                body = re.sub(r"([\\\[\]&~|^])", r"\\\1", body[no:])
                out.append(f"[{'^' if no else ''}{body}]")
                i = j + 1
        else:
            out.append(re.escape(c))
    return r"(?is)\A" + "".join(out) + r"\z"


def glob_match(col: Column, pattern: str) -> Column:
    """Whole-value glob (D1). Empty text or pattern never match; simple globs need no regex."""
    if not pattern:
        return F.lit(False)
    low, p = F.lower(col), pattern.lower()
    inner = p.strip("*")
    if not _META.search(p):
        hit = low == p
    elif inner and not _META.search(inner) and p == f"*{inner}*":
        hit = low.contains(inner)
    elif inner and not _META.search(inner) and p == f"{inner}*":
        hit = low.startswith(inner)
    elif inner and not _META.search(inner) and p == f"*{inner}":
        hit = low.endswith(inner)
    else:
        hit = col.rlike(glob_regex(pattern))
    return F.coalesce(hit & (F.length(col) > 0), F.lit(False))


def _glob_of(value: Column) -> Column:
    """The expression that :func:`glob_regex` makes of a pattern, for one that is a column.

    A class in brackets may hold letters, digits, ``_`` and spaces; other brackets are
    themselves, so that no value makes an expression that is none.
    """
    x = F.regexp_replace(value, r"([\\.+^${}()|&])", r"\\$1")
    x = F.regexp_replace(x, r"\[!(?=[A-Za-z0-9_ ]+\])", "[^")
    x = F.regexp_replace(x, r"\[(?!\^?[A-Za-z0-9_ ]+\])", r"\\[")
    x = F.replace(F.replace(x, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit("."))
    return F.concat(F.lit(r"(?is)\A"), x, F.lit(r"\z"))


def glob_match_column(col: Column, pattern: Column) -> Column:
    """Whole-value glob with a pattern from the record itself; plain values need no regex."""
    inner = F.regexp_extract(pattern, r"(?s)^\*([^*?\[]+)\*$", 1)
    hit = F.when(F.length(inner) > 0, F.contains(F.lower(col), F.lower(inner))).otherwise(F.regexp(col, _glob_of(pattern)))
    return F.coalesce(hit & (F.length(col) > 0) & (F.length(pattern) > 0), F.lit(False))


def variable_match(col: Column, name: str, variables: Mapping[str, str | Sequence[str]], record: str = "v", inside: bool = False) -> Column:
    """``$name`` in a rule.

    One value matches where this field contains it (as the glob ``*value*``), and so does
    another field of the record. A list of values matches where the field equals one of
    them, whatever the case; ``inside`` (a search in the whole record) where it contains one.
    """
    known = variables.get(name)
    if isinstance(known, str):
        return glob_match(col, f"*{known}*")
    if known is not None and inside:
        return F.coalesce(_any([F.contains(col, F.lit(x)) for x in known]), F.lit(False))
    if known is not None:
        return F.coalesce(F.lower(col).isin(*[x.lower() for x in known]), F.lit(False))
    other = get_path(record, name)
    return F.coalesce((F.length(other) > 0) & glob_match_column(col, F.concat(F.lit("*"), other, F.lit("*"))), F.lit(False))


def _value(path: str, pattern, variables: Mapping, record: str = "v") -> Column:
    col = get_path(record, path)
    if isinstance(pattern, bool) or pattern is None:
        return F.coalesce(F.lower(col) == str(pattern).lower(), F.lit(False))
    if isinstance(pattern, int):
        return F.coalesce(col.try_cast("long") == pattern, F.lit(False))
    if pattern.startswith("$") and len(pattern) > 1:
        return variable_match(col, pattern[1:], variables, record)
    return glob_match(col, pattern)


def _all(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _any(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def include_clause(rule: Rule, variables: Mapping = {}) -> Column:
    """All keys, any value of each; a missing field fails."""
    return _all([_any([_value(p, v, variables) for v in (want if isinstance(want, list) else [want])]) for p, want in rule.include.items()])


def exclude_clause(rule: Rule, variables: Mapping = {}) -> Column:
    """True where nothing excludes the record (D3): see the module's text on lists."""
    parts = []
    for p, want in rule.exclude.items():
        if isinstance(want, list):
            parts.append(get_path("v", p).isNotNull() & ~_any([_value(p, v, variables) for v in want]))
        else:
            parts.append(~_value(p, want, variables))
    return _all(parts)


def length_check(col: Column, op: str, n: int) -> Column:
    """Length of a value against a number."""
    size = F.length(col)
    test = {"<": size < n, ">": size > n, "<=": size <= n, ">=": size >= n, "==": size == n}[op]
    return F.coalesce(test, F.lit(False))


def regex_check(col: Column, pattern: str) -> Column:
    """A regular expression from the first to the last character of a value.

    As in the rules' own engine the anchors are put around the pattern as it is: of ``a|b``
    the first alternative is anchored at the start only, the second at the end only.
    """
    return F.coalesce((F.length(col) > 0) & col.rlike(f"^{pattern}$"), F.lit(False))


def record_search(op: str, pattern: str, data: str = "data", variables: Mapping = {}, record: str = "v") -> Column:
    """A pattern over the whole record's text (D6): ``$rex`` anywhere, ``$str`` as a glob.

    The glob is anchored: without stars it must be the whole text. ``$name`` is a variable.
    """
    if op == "$rex":
        return F.coalesce(F.col(data).rlike(pattern), F.lit(False))
    if pattern.startswith("$") and len(pattern) > 1:
        return variable_match(F.col(data), pattern[1:], variables, record, inside=True)
    return glob_match(F.col(data), pattern)


def parse_modifier(text: str) -> tuple[str, str, str]:
    """(field, operation, value): ``search`` in any case, any white space between the parts.

    The value of a search has single spaces; that of ``field $rex value`` is as it is.
    """
    parts = text.split()
    if text.lower().startswith("search "):
        return "search", parts[1], " ".join(parts[2:])
    if " $rex " in text:
        left, right = text.split(" $rex ")[:2]
        return left, "$rex", right
    if len(parts) != 3:
        raise ValueError(f"modifier {text!r}")
    return parts[0], parts[1], parts[2]


def modifier_clause(rule: Rule, lookup: str = "path", variables: Mapping = {}) -> Column:
    """All modifiers. ``lookup='flat'`` takes a dotted path as one key of the record."""
    parts = []
    for text in rule.modifiers:
        left, op, right = parse_modifier(text)
        if left == "search":
            parts.append(record_search(op, right, variables=variables))
            continue
        col = get_path("v", left) if lookup == "path" else F.try_variant_get("v", f"$['{left}']", "string")
        parts.append(regex_check(col, right) if op == "$rex" else length_check(col, op, int(right)))
    return _all(parts)


def channel_clause(rule: Rule, channel: str = "data_type") -> Column:
    """The record's channel fits the rule's."""
    return F.lit(True) if rule.channel == "*" else glob_match(F.col(channel), rule.channel)


def calls_private(rule: Rule, ruleset: Mapping[str, Rule], variables: Mapping = {}) -> Column:
    """All private rules that a rule names match the record itself."""
    return _all([rule_condition(ruleset[n], ruleset, variables) for n in rule.calls])


def rule_condition(rule: Rule, ruleset: Mapping[str, Rule] = {}, variables: Mapping = {}, lookup: str = "path") -> Column:
    """Whether a record matches; a rule without include, call or modifier never does."""
    if not (rule.include or rule.calls or rule.modifiers):
        return F.lit(False)
    parts = [channel_clause(rule), include_clause(rule, variables), exclude_clause(rule, variables), modifier_clause(rule, lookup, variables)]
    if rule.calls:
        parts.append(calls_private(rule, ruleset, variables))
    return _all(parts)


def matched_strings(rule: Rule, variables: Mapping = {}) -> Column:
    """Values of the record that include patterns matched."""
    found = [F.when(_any([_value(p, v, variables) for v in (want if isinstance(want, list) else [want])]), get_path("v", p)) for p, want in rule.include.items()]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def with_returns(rule: Rule) -> Column:
    """Returned fields as JSON, else the record."""
    if not rule.returns:
        return F.col("data")
    return F.to_json(F.struct(*[get_path("v", p).alias(p.replace(".", "_")) for p in rule.returns]))


def _named(rules: Sequence[Rule]) -> dict[str, Rule]:
    return {r.name: r for r in rules}


def _parsed(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``df`` with ``v``; where no rule's channel fits a record, it is not parsed."""
    if "v" in df.columns:
        return df
    channels = {r.channel for r in rules}
    if "*" in channels or len(channels) > CHANNELS or "data_type" not in df.columns:
        return df.withColumn("v", variant("data"))
    return df.withColumn("v", F.when(_any([channel_clause(Rule("", channel=c)) for c in sorted(channels)]), variant("data")))


def _glob_sql(x: str, pattern: str) -> str:
    """The test of :func:`glob_match` as SQL text; null counts as no match."""
    p = pattern.lower()
    inner = p.strip("*")
    if not p:
        return "false"
    if not _META.search(p):
        return f"lower({x}) = {text(p)}"
    if inner and not _META.search(inner):
        for form, call in ((f"*{inner}*", "contains"), (f"{inner}*", "startswith"), (f"*{inner}", "endswith")):
            if p == form:
                return f"{call}(lower({x}), {text(inner)})"
    return f"(length({x}) > 0 AND {x} RLIKE {text(glob_regex(pattern))})"


def _value_sql(x: str, pattern, variables: Mapping) -> str | None:
    if isinstance(pattern, bool) or pattern is None:
        return f"lower({x}) = {text(str(pattern).lower())}"
    if isinstance(pattern, int):
        return f"try_cast({x} AS BIGINT) = {pattern}L"
    if pattern.startswith("$") and len(pattern) > 1:
        known = variables.get(pattern[1:])
        if isinstance(known, str):
            return _glob_sql(x, f"*{known}*")
        # another field of the record is compared by Columns
        return None if known is None else f"lower({x}) IN ({', '.join(text(v.lower()) for v in known)})" if known else "false"
    return _glob_sql(x, pattern)


def condition_sql(rule: Rule, ruleset: Mapping[str, Rule] = {}, variables: Mapping = {}, lookup: str = "path") -> str | None:
    """:func:`rule_condition` as SQL text over ``v``, ``data`` and ``data_type``; None where it needs Columns.

    True where the rule matches, and else false or null.
    """
    field = lambda p: f"try_variant_get(v, {text(json_path(p))}, 'string')"
    if not (rule.include or rule.calls or rule.modifiers):
        return "false"
    parts = [] if rule.channel == "*" else [_glob_sql("data_type", rule.channel)]
    for kind, clauses in (("include", rule.include), ("exclude", rule.exclude)):
        for path, want in clauses.items():
            tests = [_value_sql(field(path), w, variables) for w in (want if isinstance(want, list) else [want])]
            if None in tests:
                return None
            some = " OR ".join(tests) or "false"
            if kind == "include":
                parts.append(f"({some})")
            else:
                parts.append(f"NOT coalesce({some}, false)" + (f" AND {field(path)} IS NOT NULL" if isinstance(want, list) else ""))
    for modifier in rule.modifiers:
        left, op, right = parse_modifier(modifier)
        if left == "search":
            if op != "$rex" and right.startswith("$") and len(right) > 1:
                return None
            parts.append(f"data RLIKE {text(right)}" if op == "$rex" else _glob_sql("data", right))
            continue
        x = field(left) if lookup == "path" else f"try_variant_get(v, {text(f"$['{left}']")}, 'string')"
        size = {"<": "<", ">": ">", "<=": "<=", ">=": ">=", "==": "="}
        parts.append(f"(length({x}) > 0 AND {x} RLIKE {text(f'^{right}$')})" if op == "$rex" else f"length({x}) {size[op]} {int(right)}")
    for name in rule.calls:
        called = condition_sql(ruleset[name], ruleset, variables)
        if called is None:
            return None
        parts.append(f"({called})")
    return " AND ".join(parts) or "true"


def _found(df: DataFrame, chosen: Sequence[Rule], by_name: Mapping[str, Rule], variables: Mapping, lookup: str) -> DataFrame:
    """``df`` with ``v`` and ``_found``, the numbers of the matching rules in file order."""

    def condition(i: int) -> str | Column:
        own = condition_sql(chosen[i], by_name, variables, lookup)
        return rule_condition(chosen[i], by_name, variables, lookup) if own is None else own

    return found_rules(_parsed(df, chosen), chosen, by_name, condition)


def _detail_sql(chosen: Sequence[Rule], n: str) -> str:
    """The struct of details of rule number ``n`` as SQL text.

    As all include keys of a rule that matches have matched, the matched strings are their values.
    """
    field = lambda p: f"try_variant_get(v, {text(json_path(p))}, 'string')"
    of = lambda values: f"element_at(array({', '.join(values)}), {n} + 1)"

    def cases(of_rule, value, otherwise: str) -> str:
        groups: dict[tuple, list[int]] = {}
        for i, r in enumerate(chosen):
            groups.setdefault(tuple(of_rule(r)), []).append(i)
        whens = " ".join(f"WHEN {n} IN ({', '.join(map(str, own))}) THEN {value(key)}" for key, own in groups.items() if key)
        return f"CASE {whens} ELSE {otherwise} END" if whens else otherwise

    matched = cases(lambda r: r.include, lambda key: f"array_compact(array({', '.join(map(field, key))}))", "cast(array() AS array<string>)")
    returned = cases(lambda r: r.returns, lambda key: "to_json(named_struct(" + ", ".join(f"{text(p.replace('.', '_'))}, {field(p)}" for p in key) + "))", "data")
    return (
        f"named_struct('rule_name', {of([text(r.name) for r in chosen])}, 'score', {of([str(int(r.score)) for r in chosen])}, 'description', {of([text(r.description) for r in chosen])}, "
        f"'reference', {of([text(r.reference) for r in chosen])}, 'matched', {matched}, 'returned', {returned})"
    )


_NO_DETAIL = "struct<rule_name:string,score:int,description:string,reference:string,matched:array<string>,returned:string>"


def _chosen(rules: Sequence[Rule], public_only: bool) -> list[Rule]:
    return [r for r in rules if r.within is None and (r.public or not public_only)]


def matches(df: DataFrame, rules: Sequence[Rule], variables: Mapping = {}, lookup: str = "path", public_only: bool = True) -> DataFrame:
    """``df`` with ``matches``: an array of details of its matching rules, in file order.

    An index over the rules finds those that may fire; only these are evaluated.
    """
    chosen = _chosen(rules, public_only)
    if not chosen:
        return _parsed(df, rules).withColumn("matches", F.array().cast(f"array<{_NO_DETAIL}>"))
    return _found(df, chosen, _named(rules), variables, lookup).withColumn("matches", F.expr(f"transform(_found, n -> {_detail_sql(chosen, 'n')})")).drop("_found")


def scan(df: DataFrame, rules: Sequence[Rule], variables: Mapping = {}, lookup: str = "path") -> DataFrame:
    """A row per record and matching public rule."""
    chosen = _chosen(rules, True)
    first = ["record_id", "case_id", "machine", get_path("v", "@timestamp").alias("ts")]
    if not chosen:
        return matches(df, rules).select(*first, F.explode("matches").alias("m")).select("record_id", "case_id", "machine", "ts", "m.*")
    hits = _found(df, chosen, _named(rules), variables, lookup).withColumn("_n", F.explode("_found"))
    return hits.select(*first, F.expr(_detail_sql(chosen, "_n")).alias("m")).select("record_id", "case_id", "machine", "ts", "m.*")


def annotate(df: DataFrame, rules: Sequence[Rule], variables: Mapping = {}, lookup: str = "path") -> DataFrame:
    """One row per record with the details of its last matching rule, private ones included."""
    chosen = _chosen(rules, False)
    if not chosen:
        return _parsed(df, rules).withColumn("rule_match", F.lit(None).cast(_NO_DETAIL)).drop("v")
    out = _found(df, chosen, _named(rules), variables, lookup).withColumn("_n", F.try_element_at("_found", F.lit(-1)))
    return out.withColumn("rule_match", F.expr(f"CASE WHEN _n IS NOT NULL THEN {_detail_sql(chosen, '_n')} END")).drop("_found", "_n", "v")


def correlate(df: DataFrame, rule: Rule, ruleset: Mapping[str, Rule], within_ms: int | None = None, keys: Sequence[str] = (), variables: Mapping = {}, time_format: str | None = None) -> DataFrame:
    """Combinations of one record per private rule less than ``within_ms`` apart.

    Each private rule's records are found first, all in one pass over the records, and
    written; then time buckets of WIDE windows make the range join an equi-join. A set is
    made in the bucket of its first rule's record; those of the other rules have a copy for
    each bucket they may meet, which few near a border need. All joins have the same keys, so
    only records are shuffled, and combinations pass from join to join within a task. Columns:
    the keys, rule_name, score, description, reference, ts (earliest), record_ids and returned
    (what each private rule returns, by its name); with ``time_format`` also ts_text, the text
    of ts, which is made for each record, not for each of its combinations. Records with the
    unknown time, or without a key, take no part.
    """
    within = within_ms if within_ms is not None else rule.within
    names, on = rule.calls, [*keys, "_b"]
    private = [ruleset[n] for n in names]
    parsed = _parsed(df, private)
    ts = F.try_to_timestamp(get_path("v", "@timestamp"))
    known = ts >= F.lit("1701-01-01").cast("timestamp")
    hits = [F.when(rule_condition(r, ruleset, variables) & known, F.struct(F.lit(k).alias("_k"), F.unix_millis(ts).alias("_ms"), with_returns(r).alias("_returned"))) for k, r in enumerate(private)]
    # outer: a filter on what an inner explode takes, or on the hits, would parse the records again for each field it looks at
    base = cut(parsed.select(*keys, "record_id", F.explode_outer(F.array(*hits)).alias("_h")).where("_h IS NOT NULL").select(*keys, "record_id", "_h.*"))
    width = max(1, WIDE * within)

    def events(k: int) -> DataFrame:
        bucket = lambda ms: F.floor(ms / width)
        near = F.explode(F.sequence(bucket(F.col("_ms") - within + 1), bucket(F.col("_ms") + within - 1))) if k else bucket(F.col("_ms"))
        shown = [F.date_format(F.timestamp_millis("_ms"), time_format).alias(f"_text{k}")] if time_format else []
        return base.where(F.col("_k") == k).select(*keys, near.alias("_b"), F.col("_ms").alias(f"_ms{k}"), F.col("record_id").alias(f"_id{k}"), F.col("_returned").alias(f"_returned{k}"), *shown)

    sides = [events(k) for k in range(len(names))]
    if len(names) > 1:
        sides, on = _dealt(sides, on)
    out = sides[0]
    for k in range(1, len(names)):
        times = [f"_ms{i}" for i in range(k + 1)]
        out = out.join(sides[k], on).where(F.greatest(*times) - F.least(*times) < within)
    content = {"rule_name": rule.name, "score": rule.score, "description": rule.description, "reference": rule.reference}
    first = F.least(*[f"_ms{k}" for k in range(len(names))]) if len(names) > 1 else F.col("_ms0")
    ids = F.array(*[f"_id{k}" for k in range(len(names))])
    returned = F.create_map(*[x for k, n in enumerate(names) for x in (F.lit(n), F.col(f"_returned{k}"))])
    shown = [F.coalesce(*[F.when(F.col(f"_ms{k}") == first, F.col(f"_text{k}")) for k in range(len(names))]).alias("ts_text")] if time_format else []
    return out.select(*keys, *[F.lit(v).alias(c) for c, v in content.items()], F.timestamp_millis(first).alias("ts"), ids.alias("record_ids"), returned.alias("returned"), *shown)


def _dealt(sides: list[DataFrame], on: list[str]) -> tuple[list[DataFrame], list[str]]:
    """Each rule's records with the parts of their bucket, and what a join of them needs to be equal on.

    Buckets are counted, and those of more combinations than a task may join are dealt to a
    grid, with a side for each rule: a record is in one part of its own side and has copies
    along the others, so that each combination is in one part. Parts are of one size, so the
    copies stay a small share of the combinations, and no record's match is held whole.
    """
    n = len(sides)
    most = PAIRS if n == 2 else PAIRS * SETS
    side = max(1.0, most ** (1 / n))
    all_of = reduce(DataFrame.union, [s.select(*on, F.lit(k).alias("_k")) for k, s in enumerate(sides)])
    counts = all_of.groupBy(*on).agg(*[F.count_if(F.col("_k") == k).cast("double").alias(f"_n{k}") for k in range(n)])
    sets = reduce(lambda a, b: a * b, [F.col(f"_n{k}") for k in range(n)])
    crowded = (sets > most) | ((sets > 0) & (F.greatest(*[f"_n{k}" for k in range(n)]) > PAIRS))
    hot = cut(counts.where(crowded).select(*on, *[F.ceil(F.col(f"_n{k}") / side).alias(f"_p{k}") for k in range(n)]))
    if hot.isEmpty():
        return sides, on
    dealt = []
    for k, s in enumerate(sides):
        s = s.join(hot, on, "left")
        for i in range(n):
            parts = F.coalesce(f"_p{i}", F.lit(1))
            s = s.withColumn(f"_x{i}", F.pmod(F.xxhash64(f"_id{k}"), parts) if i == k else F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
        dealt.append(s.drop(*[f"_p{i}" for i in range(n)]))
    return dealt, [*on, *[f"_x{i}" for i in range(n)]]


def alert_summary(alerts: DataFrame) -> DataFrame:
    """Counts by rule and machine with all subtotals, and the highest score."""
    return alerts.cube("rule_name", "machine").agg(F.count("*").alias("n"), F.max("score").alias("score"), F.grouping_id().alias("level"))


# -- rule text (D14) ---------------------------------------------------------------------

_BLOCK = re.compile(r"^[ \t]*(public|private)[ \t]+([^\s{]+)[ \t]*\n[ \t]*\{[ \t]*\n(.*?)^[ \t]*\}[ \t]*$", re.M | re.S)


def load_rules(*texts: str) -> list[Rule]:
    """Rules of rule files' text; ValueError for what is not well formed.

    Lines that start with ``#`` are comments. Of a key given twice the last one holds.
    """
    import yaml

    rules: list[Rule] = []
    for text in texts:
        plain = "\n".join(x for x in text.replace("\r\n", "\n").split("\n") if not x.lstrip().startswith("#"))
        for kind, name, body in _BLOCK.findall(plain):
            if not re.fullmatch(r"[A-Za-z0-9_]+", name):
                raise ValueError(f"rule name {name!r}")
            if any(r.name == name for r in rules):
                raise ValueError(f"rule {name} is given twice")
            y = yaml.safe_load(body) or {}
            meta = y.get("metadata") or {}
            if not meta.get("description"):
                raise ValueError(f"rule {name} has no description")
            include = dict(y.get("include") or {})
            calls = include.pop("rule", None) or []
            within = (include.pop("if", None) or {}).get("within")
            modifiers = y.get("modifiers") or []
            returns = y.get("returns") or []
            if not isinstance(modifiers, list) or not isinstance(returns, list):
                raise ValueError(f"rule {name}: modifiers and returns are lists")
            rules.append(Rule(
                name, kind == "public", str(y.get("Channel") or "*"), include, dict(y.get("exclude") or {}), [str(m) for m in modifiers], [str(r) for r in returns],
                int(meta.get("score", 10)), str(meta["description"]), str(meta.get("reference") or ""), None if within is None else int(within), [calls] if isinstance(calls, str) else list(calls),
            ))
    return rules
