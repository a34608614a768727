"""Queries of the core, with SQL for DuckDB where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.operators import timestamps
from millrace.plans import code as _code  # noqa: F401 - registers its queries
from millrace.plans import given as _given  # noqa: F401
from millrace.plans import reference
from millrace.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return timestamps.found_instants({t: table(spark, sf, t) for t in ("issues", "comments")}, table(spark, sf, "feeds"))


QUERIES: dict[str, Query] = {"p6_found": p6_found, **reference.QUERIES}
ORACLES: dict[str, str] = dict(reference.ORACLES)
