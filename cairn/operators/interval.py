"""Innermost containing intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def innermost(points: DataFrame, spans: DataFrame, key: str, point: str, lo: str, hi: str, id_: str, bin_: int | None = None) -> DataFrame:
    """points with `inner`, the id of the shortest span of the same key that holds them, and n_around.

    Ties go to the later start, then the larger id. Without bin_ the join is an equi-join on key;
    with it, spans are filed under every bin they touch, so that a key with many spans (or a single
    key) still joins on equality. Points in no span keep a null.
    """
    p, s = points, spans.select(key, lo, hi, F.col(id_).alias("__id"))
    on = [key]
    if bin_:
        p = p.withColumn("__bin", F.floor(F.col(point) / bin_))
        s = s.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(lo) / bin_), F.floor(F.col(hi) / bin_))))
        on = [key, "__bin"]
    hit = p.select(*on, point).distinct().join(s, on).filter(F.col(point).between(F.col(lo), F.col(hi)))
    near = F.min(F.struct((F.col(hi) - F.col(lo)).alias("span"), (-F.col(lo)).alias("at"), F.col("__id").alias("id")))
    best = hit.groupBy(key, point).agg(near.alias("n"), F.count("*").alias("n_around")).select(key, point, F.col("n.id").alias("inner"), "n_around")
    return points.join(best, [key, point], "left").withColumn("n_around", F.coalesce("n_around", F.lit(0)).cast("long"))


def enclosing(points: DataFrame, spans: DataFrame, key: str, point: str, lo: str, hi: str, id_: str) -> DataFrame:
    """(key, point, chain): ids of all spans around each point, outermost first."""
    hit = points.select(key, point).distinct().join(spans.select(key, lo, hi, F.col(id_).alias("id")), key).filter(F.col(point).between(F.col(lo), F.col(hi)))
    rows = F.array_sort(F.collect_list(F.struct((F.col(lo) - F.col(hi)).alias("n"), F.col(lo).alias("at"), F.col("id"))))
    return hit.groupBy(key, point).agg(F.transform(rows, lambda x: x["id"]).alias("chain"))


def owned_markers(comments: DataFrame, tags: tuple[str, ...] = ("FIXME", "HACK", "XXX", "TODO"), most: int = 100) -> DataFrame:
    """Comment markers once each, with their innermost owner, in order of tags.

    comments: coord, path, lineno, end_lineno, rel (line within the entity) and text. The same marker
    is seen from every enclosing entity; the one of least span owns it.
    """
    pattern = rf"(?i)^\W*({'|'.join(tags)})\b[:\s-]*(.*)$"
    tag = F.upper(F.regexp_extract("text", pattern, 1))
    rows = comments.withColumn("tag", tag).filter("tag <> ''").withColumn("line", F.col("lineno") + F.col("rel") - 1).withColumn("note", F.substring(F.trim(F.regexp_extract("text", pattern, 2)), 1, most))
    owner = F.min(F.struct((F.col("end_lineno") - F.col("lineno")).alias("span"), F.col("coord"))).alias("o")
    best = rows.groupBy("path", "line", "tag", "note").agg(owner)
    order = F.array_position(F.array(*map(F.lit, tags)), F.col("tag"))
    return best.select("path", "line", "tag", "note", F.col("o.coord").alias("coord"), order.cast("int").alias("priority"))
