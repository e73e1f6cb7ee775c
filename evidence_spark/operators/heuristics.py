"""Heuristics over artifact tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evidence_spark.functions.convert import extract_links, mode_bits, url_domain


def redirect_injection(visits: DataFrame, keys: Sequence[str] = ("machine",)) -> DataFrame:
    """``http://`` visits redirected to another domain in under a second (H1).

    ``visits`` has the keys, visit_id, url, ts and redirect_destination (a visit id).
    """
    later = visits.select(*keys, F.col("visit_id").alias("redirect_destination"), F.col("url").alias("to_url"), F.col("ts").alias("to_ts"))
    gap = F.unix_micros("to_ts") - F.unix_micros("ts")
    joined = visits.where(F.lower("url").startswith("http://")).join(later, [*keys, "redirect_destination"])
    out = joined.where((gap >= 0) & (gap < 1_000_000) & (url_domain("url") != url_domain("to_url")))
    return out.select(*keys, "visit_id", "url", "to_url", (gap / 1000).cast("long").alias("gap_ms"))


def manipulated_processes(usage: DataFrame, procs: DataFrame, key: str, keys: Sequence[str] = ("machine",)) -> DataFrame:
    """Usage of processes that have no process row: first usage of each, by time (H2)."""
    alone = usage.join(procs.select(*keys, key), [*keys, key], "left_anti")
    return alone.groupBy(*keys, key).agg(F.min("ts").alias("first_ts"), F.count("*").alias("n")).withColumn("label", F.concat(F.lit("deleted process "), F.col(key).cast("string")))


#: Ids of which one task finds the gaps, and of which one array is made.
ID_BLOCK, ID_ARRAY = 1_000_000, 10_000


def missing_ids(df: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """Ids absent between neighbours, with the id before the gap (H3); rows without an id are left out.

    Gaps are found in blocks of ids; what follows a block is carried over from a row per
    block. However wide a gap is, all its ids are given, from arrays of bounded size.
    """
    k = list(keys)
    ids = df.where(F.col(id_col).isNotNull()).select(*k, id_col).distinct().withColumn("_blk", F.floor(F.col(id_col) / ID_BLOCK))
    blocks = ids.groupBy(*k, "_blk").agg(F.min(id_col).alias("_low")).withColumn("_far", F.lead("_low").over(W.partitionBy(*k).orderBy("_blk")))
    near = ids.withColumn("_near", F.lead(id_col).over(W.partitionBy(*k, "_blk").orderBy(id_col)))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*k, "_blk"]]
    both = near.alias("a").join(blocks.alias("b"), reduce(Column.__and__, same)).select("a.*", F.coalesce("_near", "_far").alias("_next"))
    gaps = both.where(F.col("_next") > F.col(id_col) + 1)
    start = F.explode(F.sequence(F.col(id_col) + 1, F.col("_next") - 1, F.lit(ID_ARRAY).cast("long")))
    runs = gaps.select(*k, F.col(id_col).alias("previous_id"), (F.col("_next") - F.col(id_col) - 1).alias("gap"), "_next", start.alias("_s"))
    return runs.select(*k, F.explode(F.sequence("_s", F.least(F.col("_s") + ID_ARRAY - 1, F.col("_next") - 1))).alias("missing_id"), "previous_id", "gap")


def suid_files(files: DataFrame, mode: str = "mode") -> DataFrame:
    """Files with the setuid or setgid bit (H4)."""
    suid, sgid = mode_bits(mode)
    return files.withColumns({"is_suid": suid, "is_sgid": sgid}).where("is_suid or is_sgid")


def with_occurrences(df: DataFrame, key: str, text: str | None = None) -> DataFrame:
    """Each row with the number of rows of its key, and a flag for double nul characters (H5).

    Counted by aggregation and joined back, so that a frequent key needs no one task. Rows
    without a key count as one key.
    """
    counts = df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("occurrences"))
    out = df.join(counts, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    return out if text is None else out.withColumn("nul_pattern", F.contains(F.col(text), F.lit("\x00\x00")))


def root_packages(pkgs: DataFrame, names: Sequence[str], col: str = "package_name") -> DataFrame:
    """Packages of a known list (H6)."""
    return pkgs.where(F.col(col).isin(*names))


def suspicious_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], a: str, b: str) -> DataFrame:
    """Rows with one of the given pairs of values (H7)."""
    hit = F.lit(False)
    for x, y in pairs:
        hit = hit | ((F.col(a) == x) & (F.col(b) == y))
    return df.where(hit)


def processes_without_binary(procs: DataFrame, files: DataFrame, name: str, path: str, bundle: str = "bundle", keys: Sequence[str] = ("machine",)) -> DataFrame:
    """Processes without a bundle id whose name is no file's name (H8)."""
    known = files.select(*keys, F.substring_index(F.col(path), "/", -1).alias(name)).distinct()
    return procs.where(F.col(bundle).isNull() | (F.col(bundle) == "")).join(known, [*keys, name], "left_anti")


def messages_of_interest(df: DataFrame, col: str) -> DataFrame:
    """Messages with links, or without text (H9)."""
    links: Column = extract_links(F.coalesce(F.col(col), F.lit("")))
    return df.withColumn("links", links).where((F.size("links") > 0) | (F.trim(F.coalesce(F.col(col), F.lit(""))) == ""))
