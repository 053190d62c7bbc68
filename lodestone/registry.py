"""Names of all queries of the library outside the training-data package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import blocks, edited, files, folded, marked, more, ordered, package, payments, quality, relational, repairs, scans, state, text

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (relational, ordered, blocks, text, state, quality, package, folded, marked, payments, edited, files, more, repairs, scans):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
