"""Edits of a partitioned store: only the partitions that change are written again.

An edit is staged whole inside the store's hidden ``_edits`` folder before anything is
replaced. If it breaks off later, the next edit, or :func:`recover_store`, puts the staged
partitions in place again, which may be repeated any number of times. One edit runs at a
time, and appends to the store wait for it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from evidence_spark.operators.search import delete_where, parsed, update_field
from evidence_spark.operators.status import KEY, upsert_status

CASE_KEYS = ("case_id", "data_type")
STATUS_KEYS = ("machine",)
#: Partitions that are named in a filter; more are met by a join.
NAMED = 200
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"  # fixed value: the folder of rows without a key


def _fs(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def read_store(spark: SparkSession, path: str, keys: Sequence[str] = CASE_KEYS) -> DataFrame:
    """The rows of a store; partition keys are text as they were written, ``01`` too."""
    found = spark.read.parquet(path).schema
    return spark.read.schema(StructType([StructField(f.name, StringType()) if f.name in keys else f for f in found])).parquet(path)


def _within(df: DataFrame, parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of some partitions; where they are few, the others are not listed or read."""
    some = parts.limit(NAMED + 1).collect()  # as large as the store's file listing at most
    if len(some) > NAMED:
        named = parts.select(*[F.col(k).alias(f"_{k}") for k in keys])
        return df.join(named, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "left_semi")
    each = [reduce(Column.__and__, [F.col(k).isNull() if r[k] is None else F.col(k) == r[k] for k in keys]) for r in some]
    return df.where(reduce(Column.__or__, each, F.lit(False)))


def edit_store(spark: SparkSession, path: str, keys: Sequence[str], touched: Callable[[DataFrame], DataFrame], edit: Callable[[DataFrame], DataFrame]) -> int:
    """Replace the partitions that ``touched`` finds by ``edit`` of their rows; their number.

    ``touched`` takes the store's rows and gives rows with the partition keys. What
    ``edit`` gives must lie in these partitions. An edit may be tried again at any time.
    """
    recover_store(spark, path, keys)
    rows = read_store(spark, path, keys)
    stage = f"{path}/_edits/{uuid.uuid4().hex}"
    touched(rows).select(*keys).distinct().write.parquet(f"{stage}/touched")
    parts = spark.read.schema(", ".join(f"`{k}` string" for k in keys)).parquet(f"{stage}/touched")
    n = parts.count()
    if n:
        edit(_within(rows, parts, keys)).select(*rows.columns).hint("rebalance", *keys).write.partitionBy(*keys).parquet(f"{stage}/rows")
        fs, ready = _fs(spark, f"{stage}/ready")
        fs.create(ready).close()
        _apply(spark, path, keys, stage)
    fs, place = _fs(spark, stage)
    fs.delete(place, True)
    return n


def _apply(spark: SparkSession, path: str, keys: Sequence[str], stage: str) -> None:
    """Put staged partitions in place of the store's, and take away those that are empty now."""
    parts = spark.read.schema(", ".join(f"`{k}` string" for k in keys)).parquet(f"{stage}/touched")
    fs, rows_place = _fs(spark, f"{stage}/rows")
    gone = parts
    if any("=" in x.getPath().getName() for x in fs.listStatus(rows_place)):
        rows = read_store(spark, f"{stage}/rows", keys)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
        left = rows.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
        gone = parts.join(left, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "left_anti")
    escape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for r in gone.toLocalIterator():
        fs, place = _fs(spark, "/".join([path, *[f"{escape(k)}={_NO_VALUE if r[k] is None else escape(r[k])}" for k in keys]]))
        fs.delete(place, True)


def recover_store(spark: SparkSession, path: str, keys: Sequence[str] = CASE_KEYS) -> int:
    """Finish edits that broke off after they were staged, and drop those that did before."""
    fs, place = _fs(spark, f"{path}/_edits")
    done = 0
    if fs.exists(place):
        for s in fs.listStatus(place):
            stage = s.getPath().toString()
            if fs.exists(_fs(spark, f"{stage}/ready")[1]):
                _apply(spark, path, keys, stage)
                done += 1
            fs.delete(s.getPath(), True)
    return done


def delete_in_store(spark: SparkSession, path: str, pred: Column, keys: Sequence[str] = CASE_KEYS) -> int:
    """Delete the records that ``pred`` holds for (Q16); the number of partitions written."""
    return edit_store(spark, path, keys, lambda df: parsed(df).where(pred), lambda df: delete_where(df, pred))


def update_in_store(spark: SparkSession, path: str, updates: DataFrame, column: str, keys: Sequence[str] = CASE_KEYS) -> int:
    """Set ``column`` of records by ``updates(record_id, value)`` (Q17); the number of partitions written."""
    return edit_store(spark, path, keys, lambda df: df.join(updates.where("value is not null").select("record_id").distinct(), "record_id", "left_semi"), lambda df: update_field(df, updates, column))


def upsert_in_store(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str] = STATUS_KEYS) -> int:
    """Latest rows of a status store by machine (F2): only the machines of ``new`` are written."""

    def edit(df: DataFrame) -> DataFrame:
        return upsert_status(df, new.select(*df.columns))

    return edit_store(spark, path, keys, lambda df: new, edit)


def disable_in_store(spark: SparkSession, path: str, machine: str, file_path: str, parser: str, flag: bool) -> int:
    """Disable or enable a file of a machine for a parser in a status store."""
    hit = (F.col("machine") == machine) & (F.col("file_path") == file_path) & (F.col("parser_name") == parser)
    return edit_store(spark, path, STATUS_KEYS, lambda df: df.where(hit), lambda df: df.withColumn("disabled", F.when(hit, F.lit(flag)).otherwise(F.col("disabled"))))


def create_status_store(status: DataFrame, path: str) -> None:
    """A status table as a store by machine, a row per machine, file and parser."""
    status.dropDuplicates(list(KEY)).hint("rebalance", *STATUS_KEYS).write.partitionBy(*STATUS_KEYS).parquet(path)
