"""All registered queries of the library's own operators."""

from __future__ import annotations

from evidence_spark.plans import convert_queries, io_queries, ioc_queries, join_queries, rule_queries, search_queries, source_queries, timeline_queries
from evidence_spark.plans.registry import ORACLES, QUERIES
from evidence_spark.plans.rule_queries import flagship

__all__ = ["ORACLES", "QUERIES", "convert_queries", "flagship", "io_queries", "ioc_queries", "join_queries", "rule_queries", "search_queries", "source_queries", "timeline_queries"]
