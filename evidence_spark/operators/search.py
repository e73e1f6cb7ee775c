"""Search, projection, sorting, paging, grouping and editing of case records."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_spark.functions.records import get_path, keyword, project_paths, variant

ENVELOPE = frozenset(("record_id", "case_id", "machine", "data_source", "data_type", "data_path"))


def field(path: str) -> Column:
    """A path of a record: an envelope column, or a path in the parsed data column ``v``."""
    return F.col(path) if path in ENVELOPE else get_path("v", path.removeprefix("Data."))


def parsed(df: DataFrame) -> DataFrame:
    """``df`` with its JSON parsed once, in ``v``."""
    return df if "v" in df.columns else df.withColumn("v", variant("data"))


def field_eq(path: str, value: str) -> Column:
    """Whole-value equality, whatever the case (Q1)."""
    return F.coalesce(F.lower(field(path)) == value.lower(), F.lit(False))


def field_like(path: str, pattern: str) -> Column:
    """Wildcards ``*`` and ``?`` over the whole value (Q2)."""
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return F.coalesce(field(path).rlike(f"(?is)^{body}$"), F.lit(False))


def field_regex(path: str, pattern: str) -> Column:
    """A regular expression over the whole value (Q2)."""
    return F.coalesce(field(path).rlike(f"(?is)^(?:{pattern})$"), F.lit(False))


def any_field(term: str, columns: Sequence[str] = (), paths: Sequence[str] = ()) -> Column:
    """Some field's whole value equals the term (Q3).

    Fields are the array column ``catch_all``, or the given columns and paths.
    """
    if not columns and not paths:
        return F.coalesce(F.array_contains("catch_all", term.lower()), F.lit(False))
    values = F.array(*[F.lower(field(p)) for p in (*columns, *paths)])
    return F.coalesce(F.exists(values, lambda x: F.coalesce(x == term.lower(), F.lit(False))), F.lit(False))


def search(df: DataFrame, expr: Column | None = None) -> DataFrame:
    """Records for which ``expr`` holds; tag rows never match; no expression is all (Q4)."""
    out = parsed(df).where(F.coalesce(F.lower("data_type") != "tag", F.lit(True)))
    return out if expr is None else out.where(F.coalesce(expr, F.lit(False)))


_WORD = re.compile(r'\s*(?:(\()|(\))|(AND|OR|NOT)\b|([^\s:()"]+):"((?:[^"\\]|\\.)*)"|([^\s:()"]+):([^\s()"]+)|"((?:[^"\\]|\\.)*)"|([^\s:()"]+))')


def compile_query(text: str, terms: Sequence[str] = ()) -> Column:
    """``path:"v" AND NOT (…)`` -> predicate (Q5).

    Values with ``*`` or ``?`` are wildcards unless escaped. A bare term is looked for in
    ``catch_all``, or in the given fields. Empty text matches all.
    """
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = _WORD.match(text, at)
        if not m:
            raise ValueError(f"cannot read the query at {text[at:at + 20]!r}")
        tokens.append(m)
        at = m.end()
    if not tokens:
        return F.lit(True)
    pos = 0

    def leaf(m: re.Match) -> Column:
        path, raw = (m[4], m[5]) if m[4] else (m[6], m[7]) if m[6] else (None, m[8] if m[8] is not None else m[9])
        plain = re.sub(r"\\(.)", r"\1", raw)
        if path is None:
            return any_field(plain, paths=terms)
        if re.search(r"(?<!\\)[*?]", raw):
            return field_like(path, plain)
        return field_eq(path, plain)

    def level(kind: str) -> Column:
        nonlocal pos
        if kind == "NOT":
            if pos < len(tokens) and tokens[pos][3] == "NOT":
                pos += 1
                return ~level("NOT")
            if pos >= len(tokens) or tokens[pos][2] or tokens[pos][3]:
                raise ValueError("a value is missing")
            m = tokens[pos]
            pos += 1
            if m[1]:
                out = level("OR")
                if pos >= len(tokens) or not tokens[pos][2]:
                    raise ValueError("a bracket is open")
                pos += 1
                return out
            return leaf(m)
        below = "AND" if kind == "OR" else "NOT"
        out = level(below)
        while pos < len(tokens) and not tokens[pos][2] and (tokens[pos][3] == kind or (kind == "AND" and tokens[pos][3] != "OR")):
            pos += tokens[pos][3] == kind
            right = level(below)
            out = out | right if kind == "OR" else out & right
        return out

    out = level("OR")
    if pos < len(tokens):
        raise ValueError("a bracket is closed that is not open")
    return out


def project(df: DataFrame, fields: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """Chosen field paths as columns (Q6)."""
    return project_paths(df, fields)


def sort_records(df: DataFrame, path: str = "Data.@timestamp", desc: bool = False) -> DataFrame:
    """Sorted by the keyword view of a field, ties by record id (Q7)."""
    key = keyword(field(path))
    return parsed(df).orderBy(key.desc_nulls_last() if desc else key.asc_nulls_last(), F.col("record_id").asc())


def page(df: DataFrame, seq: int, size: int, path: str = "Data.@timestamp", desc: bool = False) -> DataFrame:
    """Page ``seq`` (from 0) of a sorted result (Q8)."""
    return sort_records(df, path, desc).offset(seq * size).limit(size)


def page_after(df: DataFrame, last_key: str | None, last_id: str, size: int, path: str = "Data.@timestamp") -> DataFrame:
    """The page after a row, by its key: a deep page costs no more than the first.

    Records without a key (missing, or too long to be a keyword) follow all others by their
    ids; ``last_key`` is null after one of them.
    """
    key = keyword(field(path))
    after = F.col("record_id") > last_id
    rest = key.isNull() & after if last_key is None else (key > last_key) | ((key == last_key) & after) | key.isNull()
    return parsed(df).where(rest).orderBy(key.asc_nulls_last(), F.col("record_id").asc()).limit(size)


def top_k(df: DataFrame, path: str, k: int) -> DataFrame:
    """The k records with the largest values, ties by record id (Q9)."""
    return sort_records(df, path, desc=True).limit(k)


def page_with_total(df: DataFrame, seq: int, size: int, path: str = "Data.@timestamp") -> DataFrame:
    """A page with the number of all hits in ``total`` (Q10)."""
    return page(df, seq, size, path).crossJoin(F.broadcast(df.agg(F.count("*").alias("total"))))


def multi_search(df: DataFrame, queries: Mapping[str, Column]) -> DataFrame:
    """A row per query and matching record, from one scan (Q11)."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(p, F.lit(False)), F.lit(n)) for n, p in queries.items()]))
    return search(df).withColumn("query", F.explode(found))


def export_all(df: DataFrame, path: str) -> None:
    """Every row of a result as Parquet (Q12)."""
    df.drop("v").write.mode("overwrite").parquet(path)


def group_count(df: DataFrame, path: str, k: int | None = None) -> DataFrame:
    """Values of a field with counts, most frequent first (Q13)."""
    out = parsed(df).groupBy(field(path).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("value"))
    return out if k is None else out.limit(k)


def filter_machines(df: DataFrame, names: Sequence[str] | None = None, machines: DataFrame | None = None, group: str | None = None) -> DataFrame:
    """Records of listed machines, or of the machines of a group (Q14)."""
    out = df if names is None else df.where(F.col("machine").isin(*names))
    if group is not None:
        out = out.join(machines.where(F.array_contains("groups", group)).select("machine").distinct(), "machine", "left_semi")
    return out


def by_id(df: DataFrame, record_id: str) -> DataFrame:
    """One record (Q15)."""
    return df.where(F.col("record_id") == record_id)


def delete_where(df: DataFrame, pred: Column) -> DataFrame:
    """What stays after deletion; rows of unknown truth stay (Q16)."""
    return parsed(df).where(~F.coalesce(pred, F.lit(False)))


def update_field(df: DataFrame, updates: DataFrame, column: str) -> DataFrame:
    """``column`` replaced where ``updates(record_id, value)`` has a row (Q17).

    Of several updates of a record the largest value holds; a null value changes nothing.
    """
    new = updates.groupBy("record_id").agg(F.max("value").alias("_new"))
    return df.join(new, "record_id", "left").withColumn(column, F.coalesce("_new", column)).drop("_new").select(*df.columns)


def add_tags(tags: DataFrame, new: DataFrame) -> DataFrame:
    """Tags with new ones: a record has one tag, the latest; free messages all stay (Q18)."""
    both = tags.unionByName(new)
    last = both.where("record_id is not null").groupBy("record_id").agg(F.max(F.struct("time", "tag_type", "message")).alias("t"))
    typed = last.select("record_id", "t.tag_type", "t.time", "t.message")
    return typed.unionByName(both.where("record_id is null").select("record_id", "tag_type", "time", "message").distinct())


def case_stats(df: DataFrame) -> DataFrame:
    """Records per case and overall (null case) (Q19)."""
    return df.rollup("case_id").agg(F.count("*").alias("n"))


def rule_alerts(df: DataFrame, rules: Sequence[tuple[str, str, str]], terms: Sequence[str] = ()) -> DataFrame:
    """Hits of saved queries (name, severity, query) per rule, severity and machine (Q20)."""
    severity = F.create_map(*[F.lit(x) for name, sev, _ in rules for x in (name, sev)])
    hits = multi_search(df, {name: compile_query(q, terms) for name, _, q in rules})
    return hits.groupBy(F.col("query").alias("rule"), severity[F.col("query")].alias("severity"), "machine").agg(F.count("*").alias("n"))


def assign_group(machines: DataFrame, names: Sequence[str], group: str, remove: bool = False) -> DataFrame:
    """A group added to machines, once, or removed from them (Q21)."""
    g = F.coalesce("groups", F.array().cast("array<string>"))
    new = F.array_remove(g, group) if remove else F.array_union(g, F.array(F.lit(group)))
    return machines.withColumn("groups", F.when(F.col("machine").isin(*names), new).otherwise(g))


def list_machines(machines: DataFrame, case_id: str) -> DataFrame:
    """Machines of a case, newest first (Q22)."""
    return machines.where(F.col("case_id") == case_id).orderBy(F.desc("creation_time"), "machine")


def important_fields(df: DataFrame, spec: Sequence[Mapping[str, str]]) -> DataFrame:
    """The summary columns of a parser: its list of name and path (Q23)."""
    return project_paths(df, {s["name"]: s["path"] for s in spec})


def manifest_lookup(df: DataFrame, path: str | None = None, domain: str | None = None) -> DataFrame:
    """Backup files by relative path and domain, with where they lie (Q24)."""
    out = df
    if path is not None:
        out = out.where(F.col("relative_path") == path)
    if domain is not None:
        out = out.where(F.col("domain") == domain)
    return out.withColumn("physical_path", F.concat(F.substring("file_id", 1, 2), F.lit("/"), F.col("file_id")))
