"""Registry of queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Records of the events table, in SQL.
REC = (
    "(SELECT CAST(event_id AS VARCHAR) AS record_id, 'case1' AS case_id, 'M' || CAST(user_id % 20 AS VARCHAR) AS machine, event_type AS data_type, "
    "'/logs/' || event_type || '.log' AS data_path, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS t, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, "
    "value, user_id, event_id, ts FROM events)"
)


def query(name: str, sql: str | None = None):
    """Register a query ``f(spark, sf_dir)`` under a name, with its SQL where there is one."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql.replace("{REC}", REC)
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
