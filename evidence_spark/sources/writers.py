"""Sinks for records, alerts and timelines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def write_records(df: DataFrame, path: str) -> dict[str, int]:
    """Append records to a case store by case and data type (K1); counts of stored and failed.

    Records without an id fail. Rows of a case and type come together in few files, but
    the rebalancing splits a large type over as many tasks as its bytes ask for.
    """
    seen = Observation()
    bad = F.col("record_id").isNull() | F.col("data").isNull()
    counted = df.observe(seen, F.count_if(~bad).alias("pushed"), F.count_if(bad).alias("failed"))
    counted.where(~bad).hint("rebalance", "case_id", "data_type").write.mode("append").partitionBy("case_id", "data_type").parquet(path)
    return seen.get


def write_jsonl(df: DataFrame, path: str) -> None:
    """Rows as JSON lines (K2)."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def write_alerts_csv(alerts: DataFrame, path: str) -> None:
    """Alerts as quoted CSV (K3)."""
    cols = [F.col("ts").alias("time"), F.col("record_id"), F.col("rule_name"), F.col("score"), F.col("description"), F.col("reference"), F.array_join("matched", "; ").alias("matched"), F.col("returned")]
    alerts.select(*cols).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def export_columns(df: DataFrame, cols: Sequence[str], path: str) -> None:
    """Only the displayed columns (K4)."""
    df.select(*cols).write.mode("overwrite").csv(path, header=True, escape='"')


def body_line(name: Column, atime: Column, mtime: Column, ctime: Column, crtime: Column) -> Column:
    """A body-file line (K5): eleven fields, bars in the name become ``_``, absent times 0."""
    secs = [F.coalesce(F.unix_timestamp(t).cast("string"), F.lit("0")) for t in (atime, mtime, ctime, crtime)]
    return F.concat_ws("|", F.lit(""), F.replace(name, F.lit("|"), F.lit("_")), *[F.lit("")] * 5, *secs)


def write_body_file(wide: DataFrame, path: str) -> None:
    """A wide timeline (plugin, item and four times) as body-file lines (K5)."""
    name = F.concat_ws(" ", "plugin", "item")
    wide.select(body_line(name, F.col("accessed"), F.col("modified"), F.col("changed"), F.col("created")).alias("value")).write.mode("overwrite").text(path)
