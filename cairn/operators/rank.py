"""Ranked, bounded lists that always say how much they left out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CAP = 12


def rank_bound_report(df: DataFrame, name: str, order: Sequence[Column], by: Sequence[str] = (), cap: int | None = CAP) -> DataFrame:
    """The first cap rows of each group, with rank, <name>_total and <name>_shown.

    order must end in a key that is unique in the group: Spark's sort isn't stable. The rank is a
    window group limit, so that no task sorts more than cap rows a group after the first pass; the
    totals are a hash aggregate.
    """
    window = Window.partitionBy(*by).orderBy(*order)
    ranked = df.withColumn("rank", F.row_number().over(window))
    shown = ranked if cap is None else ranked.filter(F.col("rank") <= cap)
    total = F.count("*").cast("long")
    if by:
        totals = df.groupBy(*by).agg(total.alias(f"{name}_total"))
        shown = shown.join(totals, list(by))
    else:
        shown = shown.crossJoin(F.broadcast(df.agg(total.alias(f"{name}_total"))))
    bound = F.col(f"{name}_total") if cap is None else F.least(F.col(f"{name}_total"), F.lit(cap).cast("long"))
    return shown.withColumn(f"{name}_shown", bound)


def closest(candidates: DataFrame, by: str, ratio: str, name: str, cap: int = 3) -> DataFrame:
    """The cap likeliest names for each key: by ratio, then by name, both descending."""
    window = Window.partitionBy(by).orderBy(F.col(ratio).desc(), F.col(name).desc())
    return candidates.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= cap)


def budgeted(df: DataFrame, order: Sequence[Column], cost: str, budget: int) -> DataFrame:
    """Rows in order until the next one would overflow the budget; costs are 1 at least."""
    window = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The best row of every cost level is enough to know where to stop: at most budget rows fit.
    top = df.orderBy(*order).limit(budget + 1)
    return top.withColumn("spent", F.sum(cost).over(window)).filter(F.col("spent") <= budget)
