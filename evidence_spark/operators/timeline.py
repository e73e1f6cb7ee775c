"""Timelines: module entries, several times per row, views, and tagged export."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_spark.functions.records import SENTINEL, get_path, variant
from evidence_spark.operators.search import compile_query

COLUMNS = ("timestamp", "module", "event", "data")


def entries(df: DataFrame, module: str, timestamp: Column, event: str | Column, data: Column) -> DataFrame:
    """Rows of an artifact table as timeline entries (T1); rows without a time are none."""
    return df.select(timestamp.alias("timestamp"), F.lit(module).alias("module"), (F.lit(event) if isinstance(event, str) else event).alias("event"), data.alias("data")).where("timestamp is not null")


def to_timeline(modules: Sequence[DataFrame]) -> DataFrame:
    """The entries of all modules."""
    out = modules[0]
    for m in modules[1:]:
        out = out.unionByName(m)
    return out


def dedup_timeline(tl: DataFrame) -> DataFrame:
    """Each entry once."""
    return tl.dropDuplicates(list(COLUMNS))


def multi_time(df: DataFrame, spec: Mapping[str, str], keep: Sequence[str]) -> DataFrame:
    """A row per time that is there (T3): ``spec`` is column -> event name."""
    times = F.array(*[F.struct(F.col(c).alias("ts"), F.lit(e).alias("event")) for c, e in spec.items()])
    return df.select(*keep, F.explode(F.filter(times, lambda x: x["ts"].isNotNull())).alias("_t")).select(*keep, "_t.*")


def macb(df: DataFrame, keep: Sequence[str], modified: str, accessed: str | None, changed: str, born: str) -> DataFrame:
    """A row per distinct time with the letters of what it is, as ``M-CB`` (T4)."""
    cols = {"M": modified, "A": accessed, "C": changed, "B": born}
    there = [F.col(c) for c in cols.values() if c]
    out = df.withColumn("ts", F.explode(F.array_distinct(F.array_compact(F.array(*there)))))
    letters = [F.when(F.coalesce(F.col(c) == F.col("ts"), F.lit(False)), F.lit(k)).otherwise(F.lit("-")) if c else F.lit("-") for k, c in cols.items()]
    return out.select(*keep, "ts", F.concat(*letters).alias("macb"))


def distinct_times(df: DataFrame, fields: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Each distinct time of a row once, named by the first field that has it (T5)."""
    out = df
    pairs = F.array(*[F.struct(F.col(f).alias("ts"), F.lit(f).alias("field")) for f in fields])
    times = F.array_distinct(F.array_compact(F.array(*[F.col(f) for f in fields])))
    first = F.transform(times, lambda t: F.element_at(F.filter(pairs, lambda p: p["ts"] == t), 1))
    return out.select(*keep, F.explode(first).alias("_t")).select(*keep, "_t.*")


KINDS = ("created", "modified", "accessed", "changed")


def wide_timeline(df: DataFrame) -> DataFrame:
    """One row per (plugin, item) with the last value of each kind of time.

    ``df`` has plugin, item, type, ts and seq (the order of values).
    """
    last = df.groupBy("plugin", "item").pivot("type", list(KINDS)).agg(F.max_by("ts", "seq"))
    return last.orderBy(*[F.col(k).asc_nulls_last() for k in KINDS], "plugin", "item")


def first_last_run(df: DataFrame, col: str, unknown: str = SENTINEL) -> DataFrame:
    """First and last of the known run times."""
    known = F.filter(col, lambda t: t.isNotNull() & (t != unknown))
    return df.withColumns({"first_run": F.array_min(known), "last_run": F.array_max(known), "n_runs": F.size(known)})


_SLOT = re.compile(r"\$\{([^}]*)\}")


def render_template(template: str, value) -> Column:
    """``${path}`` slots in text; a missing path is empty."""
    parts, at = [], 0
    for m in _SLOT.finditer(template):
        parts += [F.lit(template[at : m.start()]), F.coalesce(value(m[1].strip()), F.lit(""))]
        at = m.end()
    parts.append(F.lit(template[at:]))
    return F.concat(*parts)


def _value(path: str) -> Column:
    from evidence_spark.operators.search import field

    return field(path)


def load_views(*texts: str) -> list[dict]:
    """Views of view files' text (YAML), in order; ValueError for what is not well formed.

    A file has one view or a list of views: ``name``, ``condition`` (``query``, or
    ``default: true``), ``sheet`` and ``fields`` (column: template).
    """
    import yaml

    views: list[dict] = []
    for text in texts:
        got = yaml.safe_load(text) or []
        for v in got if isinstance(got, list) else [got]:
            if not isinstance(v, dict) or not v.get("name") or not isinstance(v.get("fields"), dict) or not isinstance(v.get("condition"), dict):
                raise ValueError("a view needs name, condition and fields")
            if any(v["name"] == w["name"] for w in views):
                raise ValueError(f"view {v['name']} is given twice")
            if not (v["condition"].get("query") or v["condition"].get("default") or v["condition"].get("Default")):
                raise ValueError(f"view {v['name']} has no query and is no default")
            views.append({**v, "name": str(v["name"]), "sheet": str(v.get("sheet") or ""), "fields": {str(k): str(x) for k, x in v["fields"].items()}})
    return views


def render_view(df: DataFrame, view: Mapping) -> DataFrame:
    """The columns of a view over records (T8), with its sheet and name."""
    rows = df if "v" in df.columns else df.withColumn("v", variant("data"))
    cols = [render_template(str(t), _value).alias(c) for c, t in view["fields"].items()]
    return rows.select("record_id", F.lit(view["name"]).alias("view"), F.lit(view.get("sheet", "")).alias("sheet"), *cols)


def select_views(df: DataFrame, views: Sequence[Mapping]) -> DataFrame:
    """A row per record and view whose query it fits; the default view where none does."""
    rows = df if "v" in df.columns else df.withColumn("v", variant("data"))
    fits = [F.when(F.coalesce(compile_query(v["condition"]["query"]), F.lit(False)), F.lit(v["name"])) for v in views if "query" in v["condition"]]
    default = [v["name"] for v in views if v["condition"].get("default") or v["condition"].get("Default")]
    found = F.array_compact(F.array(*fits)) if fits else F.array().cast("array<string>")
    otherwise = F.array(*[F.lit(d) for d in default]).cast("array<string>")
    return rows.withColumn("view", F.explode(F.when(F.size(found) > 0, found).otherwise(otherwise)))


def tagged_timeline(df: DataFrame, tags: DataFrame, views: Sequence[Mapping], removed: Sequence[str] = ()) -> DataFrame:
    """Tagged records through their views and free messages, by time.

    Columns: ts, record_id, tag_type, view, sheet, fields (JSON text), message.
    """
    typed = tags.where("record_id is not null").select("record_id", "tag_type")
    if removed:
        typed = typed.where(~F.col("record_id").isin(*removed))
    rows = select_views(df.join(typed, "record_id"), views)
    text = F.lit(None).cast("string")
    sheet = F.lit(None).cast("string")
    for v in views:
        cols = F.to_json(F.struct(*[render_template(str(t), _value).alias(c) for c, t in v["fields"].items()]))
        text = F.when(F.col("view") == v["name"], cols).otherwise(text)
        sheet = F.when(F.col("view") == v["name"], F.lit(v.get("sheet", ""))).otherwise(sheet)
    seen = rows.select(get_path("v", "@timestamp").alias("ts"), "record_id", "tag_type", "view", sheet.alias("sheet"), text.alias("fields"), F.lit(None).cast("string").alias("message"))
    none = F.lit(None).cast("string")
    free = tags.where("record_id is null").select(F.col("time").alias("ts"), none.alias("record_id"), "tag_type", none.alias("view"), none.alias("sheet"), none.alias("fields"), "message")
    return seen.unionByName(free).orderBy("ts", "record_id", "view")


def label_value(col: Column, rules: Sequence[Mapping[str, str]], auto: str | None = None) -> Column:
    """Category of a cell (T11): the first rule that fits, else the prefix that ``auto`` matches."""
    out = F.regexp_extract(col, f"^({auto})", 1) if auto else F.lit(None).cast("string")
    for r in reversed(list(rules)):
        hit = col == r["equal"] if "equal" in r else col.startswith(r["startswith"])
        out = F.when(F.coalesce(hit, F.lit(False)), F.lit(r["label"])).otherwise(out)
    return out
