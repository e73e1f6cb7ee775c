"""The record envelope, paths into its JSON, and built-in normalisation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENVELOPE = ("record_id", "case_id", "machine", "data_source", "data_type", "data_path", "data")
SENTINEL = "1700-01-01T00:00:00"
TIMESTAMP = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?Z?$"


def json_path(path: str) -> str:
    """Dotted path -> bracket path, so that keys may hold ``#``, ``@`` and spaces."""
    return "$" + "".join(f"['{k}']" if not k.isdigit() else f"[{k}]" for k in path.split("."))


def variant(data: Column | str) -> Column:
    """Parsed JSON; null for what is no JSON."""
    return F.try_parse_json(F.col(data) if isinstance(data, str) else data)


def get_path(v: Column | str, path: str, kind: str = "string") -> Column:
    """Value at a dotted path of a variant column; null where it is missing."""
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, json_path(path), kind)


def to_records(df: DataFrame, case_id: str, machine: Column, data_source: str, data_type: Column, data_path: Column) -> DataFrame:
    """Wrap rows in the envelope (N1). The id is a hash of the content, so replays agree."""
    out = df.select(
        F.lit(case_id).alias("case_id"), machine.alias("machine"), F.lit(data_source).alias("data_source"),
        data_type.alias("data_type"), data_path.alias("data_path"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("data"),
    )
    return out.withColumn("record_id", F.sha2(F.concat_ws("\u0001", "machine", "data_type", "data_path", "data"), 256)).select(*ENVELOPE)


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as records of one case with 20 machines."""
    return records_of_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def records_of_events(e: DataFrame) -> DataFrame:
    """Event rows, of a table or a stream, as records."""
    data = F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("@timestamp"), F.struct(F.get_json_object("props", "$.k").cast("long").alias("k")).alias("props"),
        "value", "user_id", "event_type",
    ))
    return e.select(
        F.col("event_id").cast("string").alias("record_id"), F.lit("case1").alias("case_id"), F.concat(F.lit("M"), (F.col("user_id") % 20).cast("string")).alias("machine"),
        F.lit("events").alias("data_source"), F.col("event_type").alias("data_type"), F.concat(F.lit("/logs/"), F.col("event_type"), F.lit(".log")).alias("data_path"), data.alias("data"),
    )


def fix_timestamp(ts: Column) -> Column:
    """A valid ISO time with ``T``, else the sentinel (N5); offsets are not valid."""
    return F.when(F.coalesce(ts.rlike(TIMESTAMP), F.lit(False)), F.replace(ts, F.lit(" "), F.lit("T"))).otherwise(F.lit(SENTINEL))


def split_rejects(df: DataFrame, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Rows with a valid time, and the others."""
    ok = F.coalesce(F.col(ts).rlike(TIMESTAMP), F.lit(False))
    return df.where(ok), df.where(~ok)


def keyword(col: Column | str, limit: int = 256) -> Column:
    """The value as a keyword: null beyond the limit."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.length(c) <= limit, c)


def sanitize_case(col: Column | str) -> Column:
    """Lower-cased name of ``[a-z0-9_]`` without leading ``_``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9_]", ""), "^_+", "")


def nulls_to_none(df: DataFrame) -> DataFrame:
    """Every column as text with ``None`` for null."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(c) for c in df.columns])


def split_path(col: Column | str) -> tuple[Column, Column]:
    """Folder and file name of a path with backslashes."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract(c, r"^(.*)\\[^\\]*$", 1), F.substring_index(c, "\\", -1)


def repair_conflicts(df: DataFrame, schema: Mapping[str, str], data: str = "data") -> DataFrame:
    """Columns promoted from ``data`` under a declared kind, with conflicts repaired.

    Kinds: ``object`` (JSON text; 'None' becomes null, another string ``{"value": s}``),
    ``date`` (an unparsable one becomes the sentinel) and ``text`` (an object becomes its
    ``k=v`` lines, a list its elements, one to a line).
    """
    v = variant(data)
    out = {}
    for path, kind in schema.items():
        raw = F.try_variant_get(v, json_path(path), "variant")
        text = F.try_variant_get(v, json_path(path), "string")
        what = F.schema_of_variant(raw)
        if kind == "object":
            col = F.when(what.startswith("OBJECT"), F.to_json(raw)).when(text == "None", F.lit(None)).when(text.isNotNull(), F.to_json(F.struct(text.alias("value"))))
        elif kind == "date":
            col = F.when(raw.isNotNull(), fix_timestamp(text))
        else:
            pairs = F.from_json(F.to_json(raw), "map<string,string>")
            lines = F.array_join(F.transform(F.map_entries(pairs), lambda e: F.concat_ws("=", e["key"], e["value"])), "\n")
            items = F.array_join(F.from_json(F.to_json(raw), "array<string>"), "\n")
            col = F.when(what.startswith("OBJECT"), lines).when(what.startswith("ARRAY"), items).otherwise(text)
        out[path.replace(".", "_")] = col
    return df.withColumns(out)


def project_paths(df: DataFrame, fields: Mapping[str, str] | Sequence[str], data: str = "data") -> DataFrame:
    """Chosen paths as columns: display name -> path."""
    names = fields if isinstance(fields, Mapping) else {f: f for f in fields}
    with_v = df.withColumn("_v", variant(data))
    return with_v.select(*[F.col(p) .alias(n) if p in df.columns else get_path("_v", p.removeprefix("Data.")).alias(n) for n, p in names.items()])
