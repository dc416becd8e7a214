"""Commits, change requests and their summaries: merging, labelling, bounding by bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row a key: that of the greatest `order`; a hash aggregate, no sort."""
    rest = [c for c in rows.columns if c not in key and c not in order]
    return rows.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("x")).select(*key, "x.*")


def summarise(rows: DataFrame, by: str, order: list[Column], label: Column, shown: int = 5) -> DataFrame:
    """Rows of each source, and the labels of the first `shown`."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    ranked = rows.select(by, label.alias("label"), place.alias("place")).filter(F.col("place") <= shown)
    first = ranked.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "label"))), lambda x: x["label"]).alias("top"))
    return rows.groupBy(by).agg(F.count("*").alias("n")).join(first, by)


def provenance(rows: DataFrame, by: str, order: list[Column], boundary: str) -> DataFrame:
    """rows with `label`: newest first, what lies behind the oldest boundary is region-history."""
    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    last = F.max(F.when(F.col(boundary), F.col("k"))).over(Window.partitionBy(by))
    ranked = ranked.withColumn("b", last)
    return ranked.withColumn("label", F.when(F.col("k") > F.col("b"), "region-history").otherwise("entity-history")).drop("k", "b")


def byte_cap(rows: DataFrame, by: str, order: list[Column], size: Column, cap: int) -> DataFrame:
    """The first rows of each group within cap bytes, with n_kept and n_dropped."""
    run = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sized = rows.withColumn("__used", F.sum(size).over(run)).withColumn("__n", F.count("*").over(Window.partitionBy(by)))
    kept = sized.filter(F.col("__used") <= cap).withColumn("n_kept", F.count("*").over(Window.partitionBy(by)))
    return kept.withColumn("n_dropped", F.col("__n") - F.col("n_kept")).drop("__used", "__n")


def ref_index(evidence: DataFrame) -> DataFrame:
    """(ref, sha) of every way to name a record: its number with and without #, its sha and usual prefixes."""
    number = F.col("number").cast("string")
    refs = F.array(F.col("sha"), *[F.substring("sha", 1, n) for n in (7, 8, 9, 10, 12)], number, F.concat(F.lit("#"), number))
    return evidence.select(F.explode(F.array_compact(F.array_distinct(refs))).alias("ref"), "sha")


def decorate(verdicts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Verdicts (ref, verdict) with the record they name; `cached` is false where there is none."""
    return verdicts.join(ref_index(evidence), "ref", "left").withColumn("cached", F.col("sha").isNotNull())


def creation_boundary(touches: DataFrame, introductions: DataFrame, by: list[str], order: str) -> DataFrame:
    """(by, boundary, predates): the oldest commit that both touches the lines and introduces the name.

    Where none does both, and the name was introduced by an older commit than any that touches the
    lines, the entity predates its range's history.
    """
    both = touches.join(introductions.select(*by, "sha"), [*by, "sha"], "left_semi").groupBy(*by).agg(F.min_by("sha", order).alias("boundary"))
    oldest = touches.groupBy(*by).agg(F.min(order).alias("first_touch"))
    named = introductions.groupBy(*by).agg(F.min(order).alias("first_name"))
    joined = oldest.join(named, by, "left").join(both, by, "left")
    return joined.select(*by, "boundary", F.coalesce(F.col("boundary").isNull() & (F.col("first_name") < F.col("first_touch")), F.lit(False)).alias("predates"))


def released_in(rows: DataFrame, tags: DataFrame) -> DataFrame:
    """rows with `tags`, those that contain the commit (sha, tag), and `unreleased` where none does."""
    found = tags.groupBy("sha").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    joined = rows.join(found, "sha", "left")
    return joined.withColumn("unreleased", F.col("tags").isNull()).withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def bounded_bodies(rows: DataFrame, by: str, order: list[Column], cap: int, pr_most: int = 400, keep: int = 200) -> DataFrame:
    """Rows within cap bytes a group: long request bodies are cut first, then commits' bodies, then the oldest rows go.

    rows: source ("pr" or "commit") and body. Each step is taken only in groups that are still over the
    cap after the one before; `trimmed` marks cut bodies, n_dropped says how many rows went.
    """
    size = F.octet_length(F.coalesce("body", F.lit("")))
    whole = Window.partitionBy(by)
    over = rows.withColumn("__all", F.sum(size).over(whole))
    first = (F.col("__all") > cap) & (F.col("source") == "pr") & (F.length("body") > pr_most)
    cut = over.withColumn("trimmed", F.coalesce(first, F.lit(False))).withColumn("body", F.when(first, F.substring("body", 1, pr_most)).otherwise(F.col("body")))
    cut = cut.withColumn("__all", F.sum(size).over(whole))
    second = (F.col("__all") > cap) & (F.col("source") == "commit") & (F.length("body") > keep)
    cut = cut.withColumn("trimmed", F.col("trimmed") | F.coalesce(second, F.lit(False))).withColumn("body", F.when(second, F.substring("body", 1, keep)).otherwise(F.col("body")))
    return byte_cap(cut.drop("__all"), by, order, F.octet_length(F.coalesce("body", F.lit(""))), cap)


def dig(commits: DataFrame, introductions: DataFrame, tags: DataFrame, shallow: Column | bool = False) -> DataFrame:
    """History of each entity's lines: commits (coord, sha, pos, subject; pos 0 is the newest) with label, tags and notes.

    What lies behind the creation boundary is the region's history. In a shallow clone the history is
    only a lower bound, and every row says so.
    """
    old_first = commits.withColumn("__age", -F.col("pos"))
    edge = creation_boundary(old_first, introductions.withColumn("__age", -F.col("pos")), ["coord"], "__age")
    marked = commits.join(edge, "coord", "left").withColumn("is_boundary", F.coalesce(F.col("sha") == F.col("boundary"), F.lit(False)))
    labelled = provenance(marked, "coord", [F.col("pos").asc()], "is_boundary")
    return released_in(labelled, tags).withColumn("lower_bound", shallow if isinstance(shallow, Column) else F.lit(shallow)).drop("is_boundary")


def rebuild(commits: DataFrame, requests: DataFrame) -> DataFrame:
    """Evidence records from commits (coord, sha, numbers) and request bodies (number, body): one row a commit with its requests."""
    each = commits.select("coord", "sha", F.explode_outer("numbers").alias("number")).join(requests, "number", "left")
    refs = F.array_sort(F.collect_list(F.when(F.col("number").isNotNull(), F.struct("number", F.coalesce("body", F.lit("unavailable")).alias("body")))))
    return each.groupBy("coord", "sha").agg(refs.alias("requests"))


def map_lag(manifest: DataFrame, commits: DataFrame, map_folder: str = ".cairn/") -> DataFrame:
    """Of each map (repo, indexed_sha, indexed_tree, dirty): its state against commits (repo, sha, tree, pos, paths).

    "fresh" if the newest tree is the indexed one and nothing was dirty; "behind" with the number of later
    commits that touch anything but the map; "dirty"; "unknown" where the indexed commit isn't among them.
    """
    head = commits.groupBy("repo").agg(F.max_by("tree", "pos").alias("head_tree"))
    own = manifest.join(commits.select("repo", F.col("sha").alias("indexed_sha"), F.col("pos").alias("at")), ["repo", "indexed_sha"], "left").join(head, "repo", "left")
    real = commits.filter(F.exists("paths", lambda p: ~p.startswith(map_folder))).select("repo", "pos")
    later = own.select("repo", "at").join(real, "repo").filter(F.col("pos") > F.col("at")).groupBy("repo").agg(F.count("*").alias("behind"))
    joined = own.join(later, "repo", "left").withColumn("behind", F.coalesce("behind", F.lit(0)).cast("long"))
    state = F.when(F.col("dirty"), "dirty").when(F.col("head_tree") == F.col("indexed_tree"), "fresh").when(F.col("at").isNull(), "unknown").when(F.col("behind") > 0, "behind").otherwise("fresh")
    return joined.select("repo", state.alias("state"), F.when(state == "behind", F.col("behind")).otherwise(0).cast("long").alias("behind"))
