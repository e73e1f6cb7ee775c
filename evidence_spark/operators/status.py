"""Status of files per parser: what is still to do, progress and failures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("machine", "file_path", "parser_name")
TAKEN = ("queued", "done", "parsing")


def pending_files(routed: DataFrame, status: DataFrame) -> DataFrame:
    """Routed files that are not taken or disabled; errors are tried again (F1)."""
    taken = status.where(F.col("status").isin(*TAKEN) | F.coalesce("disabled", F.lit(False))).select(*KEY)
    return routed.join(taken, list(KEY), "left_anti")


def upsert_status(old: DataFrame, new: DataFrame) -> DataFrame:
    """The latest row per machine, file and parser (F2); of equal times, a new row."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c not in KEY]
    last = both.groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.struct("start_time", "_new")).alias("_s"))
    return last.select(*KEY, *[F.col(f"_s.{c}").alias(c) for c in rest]).select(*old.columns)


def files_by_status(nested: DataFrame, status: Sequence[str] | None = None) -> DataFrame:
    """Nested files and parsers of machines as rows, of some status."""
    files = nested.select("machine", F.explode("files").alias("f")).select("machine", "f.file_path", "f.file_size", F.explode("f.parsers").alias("p"))
    out = files.select("machine", "file_path", "file_size", "p.*")
    return out if status is None else out.where(F.col("status").isin(*status))


def parsing_progress(status: DataFrame, kinds: Sequence[str] = ("queued", "parsing", "done", "error"), by: str = "parser_name") -> DataFrame:
    """Files per status, and the share that is over."""
    counts = status.groupBy(by).agg(*[F.count_if(F.col("status") == k).alias(k) for k in kinds], F.count("*").alias("total"))
    return counts.withColumn("progress", F.round((F.col("done") + F.col("error")) / F.col("total"), 4))


def fail_task(status: DataFrame, task_id: str, message: str) -> DataFrame:
    """Unfinished rows of a task become errors."""
    hit = (F.col("task_id") == task_id) & F.col("status").isin("queued", "parsing")
    hit = F.coalesce(hit, F.lit(False))
    return status.withColumns({"status": F.when(hit, "error").otherwise(F.col("status")), "message": F.when(hit, message).otherwise(F.col("message"))})


def push_counts(records: DataFrame, by: Sequence[str] = ("machine", "data_path"), ok: str = "pushed") -> DataFrame:
    """Records stored and failed per file."""
    return records.groupBy(*by).agg(F.count_if(F.col(ok)).alias("pushed"), F.count_if(~F.coalesce(F.col(ok), F.lit(False))).alias("failed"))


def set_disabled(status: DataFrame, file_path: str, parser: str, flag: bool) -> DataFrame:
    """A file is disabled or enabled for a parser."""
    hit = (F.col("file_path") == file_path) & (F.col("parser_name") == parser)
    return status.withColumn("disabled", F.when(hit, F.lit(flag)).otherwise(F.col("disabled")))
