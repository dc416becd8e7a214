"""Named queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import briefs, code, corpus, graphs, logs

entry = graphs.entry


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return briefs.QUERIES | code.QUERIES | corpus.QUERIES | graphs.QUERIES | logs.QUERIES


def oracle_sql() -> dict[str, str]:
    return briefs.SQL | code.SQL | corpus.SQL | graphs.SQL | logs.SQL
