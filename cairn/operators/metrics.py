"""Aggregates over entities, edges and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parent_rollup(df: DataFrame, parent: str, value: str) -> DataFrame:
    """Sum over the direct children of each parent, and how many they are."""
    return df.filter(F.col(parent).isNotNull()).groupBy(parent).agg(F.sum(value).alias("agg_value"), F.count("*").alias("n_children"))


def midrank_percentile(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df with percentile = (values below + values up to) / 2 / all.

    Counts of distinct values are ranked instead of rows: one value is one row of the window.
    """
    keys = list(by)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("here"))
    upto = F.sum("here").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("here").over(Window.partitionBy(*keys))
    share = (2 * F.col("upto") - F.col("here")).cast("double") / 2.0 / F.col("total")
    ranked = counts.withColumn("upto", upto).withColumn("total", total).select(*keys, value, share.alias("percentile"))
    return df.join(ranked, [*keys, value], "left")


def fan(edges: DataFrame, tests: DataFrame | None = None) -> DataFrame:
    """coord, fan_in (calls and imports whose source is no test), fan_out (all of them)."""
    used = edges.filter(F.col("kind").isin("calls", "imports"))
    outward = used.groupBy(F.col("src").alias("coord")).agg(F.count("*").alias("fan_out"))
    inner = used.filter(~F.startswith(F.col("dst").cast("string"), F.lit("EVT:")))
    if tests is not None:
        inner = inner.join(tests.select(F.col("coord").alias("src")), "src", "left_anti")
    inward = inner.groupBy(F.col("dst").alias("coord")).agg(F.count("*").alias("fan_in"))
    both = outward.join(inward, "coord", "full_outer")
    return both.select("coord", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def most_depended_on(edges: DataFrame, guess_below: float = 0.7) -> DataFrame:
    """coord, callers and guessed (callers of low confidence)."""
    calls = edges.filter(F.col("kind") == "calls")
    return calls.groupBy(F.col("dst").alias("coord")).agg(F.count("*").alias("callers"), F.count_if(F.col("confidence") < guess_below).alias("guessed"))


def grounding(edges: DataFrame, touched: DataFrame, low: float = 0.7) -> DataFrame:
    """Edges that touch the given coords, by resolution, and how many are of low confidence."""
    used = edges.filter(F.col("kind").isin("calls", "imports"))
    ends = touched.select("coord")
    hit = used.join(ends, used.src == ends.coord, "left_semi").unionByName(used.join(ends, used.dst == ends.coord, "left_semi")).distinct()
    return hit.groupBy("resolution").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") < low).alias("n_low"))


def memoised(current: DataFrame, previous: DataFrame, compute: Column, out: str) -> DataFrame:
    """current with `out`, taken from previous where body or (non-empty) logic digest is unchanged.

    `compute` is evaluated for the other rows only; coords that are gone drop out.
    """
    old = previous.select("coord", F.col("body_hash").alias("old_body"), F.col("logic_hash").alias("old_logic"), F.col(out).alias("old_value"))
    joined = current.join(old, "coord", "left")
    same = (F.col("body_hash") == F.col("old_body")) | ((F.col("logic_hash") == F.col("old_logic")) & (F.col("logic_hash") != ""))
    joined = joined.withColumn("memoised", F.coalesce(same, F.lit(False)))
    return joined.withColumn(out, F.when(F.col("memoised"), F.col("old_value")).otherwise(compute)).drop("old_body", "old_logic", "old_value")


def history_summary(commits: DataFrame, by: str, order: list[Column], line: Column, shown: int = 8) -> DataFrame:
    """Of each file: how many commits, the first `shown` as text, and "(+N earlier)" for the rest."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    # Cut before anything is collected: no task sorts or holds all commits of a file.
    rows = commits.select(by, line.alias("line"), place.alias("place")).filter(F.col("place") <= shown)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "; ")
    counted = commits.groupBy(by).agg(F.count("*").alias("n_commits"))
    return counted.join(rows.groupBy(by).agg(text.alias("text")), by).withColumn("text", F.when(F.col("n_commits") > shown, F.concat("text", F.lit(" (+"), (F.col("n_commits") - shown).cast("string"), F.lit(" earlier)"))).otherwise(F.col("text")))


def churn(spans: DataFrame, blame: DataFrame) -> DataFrame:
    """coord and the distinct commits that touch its lines. spans: coord, path, lo, hi; blame: path, line, commit."""
    hit = spans.join(blame, "path").filter(F.col("line").between(F.col("lo"), F.col("hi")))
    return hit.groupBy("coord").agg(F.count_distinct("commit").alias("churn"))


def triage(df: DataFrame, value: str, tie: str, k: int) -> DataFrame:
    """The k hardest rows; ties in the order of `tie`."""
    return df.orderBy(F.col(value).desc(), F.col(tie)).limit(k)
