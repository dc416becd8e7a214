"""What became of entities between two snapshots.

A snapshot has coord, qualname, kind, path, pos (scan order), loc, signature, body_hash, logic_hash,
shape_hash, sketch (array of longs) and n_shingles.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import sketch_containment, sketch_jaccard, size_ratio
from .graph import components, stored

WEIGHTS = {"name": 0.22, "jac": 0.30, "shape": 0.22, "sig": 0.13, "loc": 0.13}
FLOOR, SURE, MARGIN, WEAK, CONTAINED = 0.33, 0.55, 0.05, 0.03, 0.5


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "coord", digest: str = "body_hash") -> DataFrame:
    """(key, change): added, removed, changed or same; one full outer join."""
    a = old.select(F.col(key), F.col(digest).alias("was"), F.lit(True).alias("in_old"))
    b = new.select(F.col(key), F.col(digest).alias("now"), F.lit(True).alias("in_new"))
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(F.col("was").eqNullSafe(F.col("now")), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def pair_by_rank(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(old, new): the k-th old and the k-th new row (by pos) of equal keys, as far as both go."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("pos", "coord"))
    a = old.select(*keys, F.col("coord").alias("old"), place.alias("k"))
    b = new.select(*keys, F.col("coord").alias("new"), place.alias("k"))
    return a.join(b, [*keys, "k"]).select("old", "new")


def exact_moves(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old, new, how) of removed and added entities of equal body, then of equal logic, within a kind."""
    gone = stored(old.join(new.select("coord"), "coord", "left_anti"))
    come = stored(new.join(old.select("coord"), "coord", "left_anti"))
    body = stored(pair_by_rank(gone, come, ["kind", "body_hash"]).withColumn("how", F.lit("identical body")))
    rest = gone.join(body.select(F.col("old").alias("coord")), "coord", "left_anti").filter("logic_hash <> ''")
    left = come.join(body.select(F.col("new").alias("coord")), "coord", "left_anti").filter("logic_hash <> ''")
    logic = pair_by_rank(rest, left, ["kind", "logic_hash"]).withColumn("how", F.lit("identical logic"))
    return body.unionByName(logic)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio; distinct pairs of a batch are compared once."""
    known: dict[tuple, float] = {}
    out = []
    for x, y in zip(a, b):
        key = (x or "", y or "")
        if key not in known:
            known[key] = difflib.SequenceMatcher(None, *key).ratio()
        out.append(known[key])
    return pd.Series(out, dtype="float64")


#: Places of a sketch that make a band: two entities meet if they share one.
BAND = 2


def candidate_pairs(old: DataFrame, new: DataFrame, use_sketch: bool = True) -> DataFrame:
    """(o_coord, n_coord) of one kind with the same last name, the same shape or a common band of sketches.

    Equi-joins on those keys; a shape meets only where sizes are within a factor of two or the signature is
    the same, so that the many small functions of one shape don't all meet. A pair outside can't reach SURE
    unless name and signature are almost the same under another last name.
    """
    short = lambda c: F.element_at(F.split(c, r"\."), -1)
    keys = [F.struct(F.lit("n").alias("t"), F.xxhash64(short("qualname")).alias("k"))]
    scale = F.floor(F.log2(F.greatest("loc", F.lit(1))))
    shape = F.coalesce("shape_hash", F.lit("")) != ""
    keys += [F.when(shape, F.struct(F.lit(f"s{i}").alias("t"), F.xxhash64("shape_hash", x).alias("k"))) for i, x in enumerate((scale, F.col("signature")))]
    if use_sketch:
        keys += [F.when(F.size("sketch") >= i + BAND, F.struct(F.lit(f"b{i}").alias("t"), F.xxhash64(F.slice("sketch", i + 1, BAND)).alias("k"))) for i in range(0, 48, BAND)]
    each = lambda df, name: df.select("kind", F.col("coord").alias(name), F.explode(F.array_compact(F.array(*keys))).alias("key"))
    return each(old, "o_coord").join(each(new, "n_coord"), ["kind", "key"]).select("o_coord", "n_coord").distinct()


def pair_scores(old: DataFrame, new: DataFrame, use_sketch: bool = True, exhaustive: bool = False) -> DataFrame:
    """Scores of candidate pairs of old and new functions, methods and classes of one kind.

    A signal that wasn't measured is left out and the weights of the others are scaled up. exhaustive
    compares all pairs of a kind, for small snapshots.
    """
    side = lambda df, p: df.select("kind", *[F.col(c).alias(f"{p}_{c}") for c in ("coord", "qualname", "path", "pos", "loc", "signature", "shape_hash", "sketch", "n_shingles", "body_hash")])
    new = new.filter(F.col("kind").isin("function", "method", "class"))
    if exhaustive:
        pairs = side(old, "o").join(side(new, "n"), "kind")
    else:
        found = candidate_pairs(old, new, use_sketch)
        pairs = found.join(side(old, "o"), "o_coord").join(side(new, "n").drop("kind"), "n_coord")
    short = lambda c: F.element_at(F.split(c, r"\."), -1)
    pairs = pairs.withColumn("name", sequence_ratio(short("o_qualname"), short("n_qualname"))).withColumn("sig", sequence_ratio("o_signature", "n_signature"))
    pairs = pairs.withColumn("jac", sketch_jaccard("o_sketch", "n_sketch") if use_sketch else F.lit(0.0))
    pairs = pairs.withColumn("shape", ((F.coalesce("o_shape_hash", F.lit("")) != "") & (F.col("o_shape_hash") == F.col("n_shape_hash"))).cast("double")).withColumn("shape", F.coalesce("shape", F.lit(0.0)))
    pairs = pairs.withColumn("loc", size_ratio("o_loc", "n_loc"))
    used = {k: w for k, w in WEIGHTS.items() if use_sketch or k != "jac"}
    total = sum(used.values())
    score = sum((F.col(k) * w for k, w in used.items()), F.lit(0.0)) / total
    measured = (F.size("o_sketch") > 0) & (F.size("n_sketch") > 0)
    contained = F.when(F.lit(use_sketch) & measured, sketch_containment(F.col("jac"), "n_n_shingles", "o_n_shingles")).otherwise(0.0)
    back = F.when(F.lit(use_sketch) & measured, sketch_containment(F.col("jac"), "o_n_shingles", "n_n_shingles")).otherwise(0.0)
    return pairs.withColumn("score", score).withColumn("contained", contained).withColumn("contained_back", back)


def _assign(pairs: pd.DataFrame, use_sketch: bool) -> list[tuple]:
    """Greedy matching of one kind: (kind of move, olds, news, author, score)."""
    out: list[tuple] = []
    used_o: set[str] = set()
    used_n: set[str] = set()
    rows: dict[str, list[tuple[float, str]]] = {}
    cols: dict[str, list[tuple[float, str]]] = {}
    parts: dict[str, list[tuple[int, str]]] = {}
    wholes: dict[str, list[tuple[int, str]]] = {}
    for r in pairs.itertuples():
        rows.setdefault(r.o_coord, []).append((r.score, r.n_coord))
        cols.setdefault(r.n_coord, []).append((r.score, r.o_coord))
        if r.contained >= CONTAINED:
            parts.setdefault(r.o_coord, []).append((r.n_pos, r.n_coord))
        if r.contained_back >= CONTAINED:
            wholes.setdefault(r.n_coord, []).append((r.o_pos, r.o_coord))
    for lists in (rows, cols):
        for x in lists.values():
            x.sort(reverse=True)
    suspects = {o for o, kids in parts.items() if len(kids) > 1}

    def rival(options: list[tuple[float, str]], mine: str, used: set[str]) -> float:
        return next((s for s, c in options if c != mine and c not in used), 0.0)

    later = []
    for r in pairs[pairs.score >= FLOOR].sort_values(["score", "o_pos", "n_pos"], ascending=[False, True, True], kind="stable").itertuples():
        o, n = r.o_coord, r.n_coord
        if o in used_o or n in used_n:
            continue
        margin = r.score - max(rival(rows[o], n, used_n), rival(cols[n], o, used_o))
        backed = r.shape > 0 or r.name >= 0.60 or (use_sketch and r.jac >= 0.45)
        same_name = r.name == 1.0 and r.sig >= 0.85
        move = "renamed" if r.o_path == r.n_path else "moved"
        if o in suspects and not same_name:
            later.append((move, o, n, r.score))
        elif (r.score >= SURE and backed and margin >= MARGIN) or same_name:
            out.append((move, [o], [n], "auto", r.score, r.n_body_hash if r.shape > 0 else None))
            used_o.add(o)
            used_n.add(n)
        elif margin >= WEAK:
            later.append((move, o, n, r.score))
    if use_sketch:
        for o, kids in sorted(parts.items(), key=lambda kv: kv[0]):
            free = [n for _, n in sorted(kids) if n not in used_n]
            if o not in used_o and free:
                out.append(("split", [o], free, "pending-review", 0.0, None))
                used_o.add(o)
                used_n.update(free)
        for n, olds in sorted(wholes.items(), key=lambda kv: kv[0]):
            free = [o for _, o in sorted(olds) if o not in used_o]
            if n not in used_n and free:
                out.append(("merged", free, [n], "pending-review", 0.0, None))
                used_o.update(free)
                used_n.add(n)
    for move, o, n, score in later:
        if o not in used_o and n not in used_n:
            out.append((move, [o], [n], "pending-review", score, None))
            used_o.add(o)
            used_n.add(n)
    return out


RECORD = "kind string, old array<string>, new array<string>, author string, score double, restamp string"


def scored_moves(pairs: DataFrame, use_sketch: bool = True) -> DataFrame:
    """Greedy one-to-one assignment with splits and merges, one connected component of pairs at a time.

    pairs: pair_scores(). Only pairs that can matter are sent to Python: at the score floor or
    contained by half. Matching depends on its own order among pairs that share an entity, so a
    component is matched in one task, and different components side by side.
    """
    useful = stored(pairs.filter((F.col("score") >= FLOOR) | (F.col("contained") >= CONTAINED) | (F.col("contained_back") >= CONTAINED)))
    roots = components(useful.select(F.concat(F.lit("o"), "o_coord").alias("a"), F.concat(F.lit("n"), "n_coord").alias("b")))
    useful = useful.join(roots.filter(F.startswith("id", F.lit("o"))).select(F.substr("id", F.lit(2)).alias("o_coord"), F.col("root").alias("__group")), "o_coord")
    columns = ["o_coord", "n_coord", "o_pos", "n_pos", "o_path", "n_path", "n_body_hash", "score", "name", "sig", "jac", "shape", "contained", "contained_back"]

    def match(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_assign(frame, use_sketch), columns=["kind", "old", "new", "author", "score", "restamp"])

    return useful.select("__group", *columns).groupBy("__group").applyInPandas(match, RECORD)


def detect(old: DataFrame, new: DataFrame, use_sketch: bool = True) -> DataFrame:
    """All lineage records between two snapshots: exact moves, scored moves, splits, merges, deletions."""
    exact = stored(exact_moves(old, new))
    gone = old.join(new.select("coord"), "coord", "left_anti").join(exact.select(F.col("old").alias("coord")), "coord", "left_anti")
    come = new.join(old.select("coord"), "coord", "left_anti").join(exact.select(F.col("new").alias("coord")), "coord", "left_anti")
    gone = stored(gone)
    scored = stored(scored_moves(pair_scores(gone, come, use_sketch), use_sketch))
    taken = scored.select(F.explode("old").alias("coord"))
    author = "auto" if use_sketch else "pending-review"
    deleted = gone.join(taken, "coord", "left_anti").select(F.lit("deleted").alias("kind"), F.array("coord").alias("old"), F.array().cast("array<string>").alias("new"), F.lit(author).alias("author"), F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("restamp"))
    moved = exact.select(F.lit("renamed").alias("kind"), F.array("old").alias("old"), F.array("new").alias("new"), F.lit("auto").alias("author"), F.lit(1.0).alias("score"), F.lit(None).cast("string").alias("restamp"))
    return moved.unionByName(scored).unionByName(deleted)


def ancestry(log: DataFrame, coords: DataFrame) -> DataFrame:
    """(coord, seq, kind, old, new) of the records that lead to each coord of coords, as the log has them.

    A record counts if it names an id that is known to lead there; its old ids lead there, too. The log
    is exploded once, and each round joins the new ids with it.
    """
    named = stored(log.select("seq", "old", F.explode(F.array_distinct(F.concat("old", "new"))).alias("id")))
    seen = stored(coords.select("coord", F.col("coord").alias("id")).distinct())
    front, hits = seen, None
    while not front.isEmpty():
        found = stored(front.join(named, "id").select("coord", "seq", "old").distinct())
        hits = found.select("coord", "seq") if hits is None else hits.unionByName(found.select("coord", "seq"))
        front = stored(found.select("coord", F.explode("old").alias("id")).distinct().join(seen, ["coord", "id"], "left_anti"))
        seen = seen.unionByName(front)
    every = hits.distinct() if hits is not None else coords.select("coord", F.lit(0).cast(log.schema["seq"].dataType).alias("seq")).limit(0)
    return every.join(log, "seq").select("coord", "seq", "kind", "old", "new")


def next_version(spark, folder: str) -> int:
    """One more than the largest v<N> below folder; 1 where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in store.listStatus(path)] if store.exists(path) else []
    return max([int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()], default=0) + 1


def snapshot(tables: dict[str, DataFrame], folder: str) -> int:
    """Writes the tables as the next version below folder; its number. A version is complete once its marker is there."""
    spark = next(iter(tables.values())).sparkSession
    n = next_version(spark, folder)
    for name, df in tables.items():
        df.write.parquet(f"{folder}/v{n}/{name}")
    spark.createDataFrame([(n,)], "version int").coalesce(1).write.parquet(f"{folder}/v{n}/complete")
    return n


def newest(spark, folder: str, name: str) -> DataFrame | None:
    """A table of the newest version that is complete and readable; None where there is none."""
    for n in range(next_version(spark, folder) - 1, 0, -1):
        try:
            spark.read.parquet(f"{folder}/v{n}/complete")
            return spark.read.parquet(f"{folder}/v{n}/{name}")
        except Exception:  # noqa: BLE001 - an unreadable version is passed over for the one before
            continue
    return None


def mined_renames(commits: DataFrame) -> DataFrame:
    """Lineage of rename lines (status, old_path, new_path, seq): one record a pair of paths, ids prefixed "git:"."""
    moved = commits.filter(F.startswith("status", F.lit("R")))
    first = moved.groupBy("old_path", "new_path").agg(F.min("seq").alias("seq"))
    ids = lambda c: F.array(F.concat(F.lit("git:"), F.col(c)))
    return first.select("seq", F.lit("renamed").alias("kind"), ids("old_path").alias("old"), ids("new_path").alias("new"), F.lit("mined-git").alias("author"))


def replay(entities: DataFrame, old: DataFrame, log: DataFrame, local: DataFrame, pairs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows to append to the local log, orphans): notes of another version follow their entity.

    By equal coord, else by the best pair score of SURE at least within the kind (pairs: o_coord, n_coord,
    score, pair_scores() if not given); else orphaned, with the best score seen. Rows whose text the local
    channel has are left out, so that a second replay appends nothing; stamps stay as they were.
    """
    same = old.join(entities.select("coord"), "coord", "left_semi").select("coord", F.col("coord").alias("target"), F.lit(1.0).alias("score"))
    gone = stored(old.join(entities.select("coord"), "coord", "left_anti").join(log.select("coord").distinct(), "coord", "left_semi"))
    scores = pair_scores(gone, entities) if pairs is None else pairs
    best = scores.groupBy(F.col("o_coord").alias("coord")).agg(F.max(F.struct("score", "n_coord")).alias("b")).select("coord", F.col("b.n_coord").alias("target"), F.col("b.score").alias("score"))
    best = stored(gone.select("coord").join(best, "coord", "left"))
    follow = same.unionByName(best.filter(F.col("score") >= SURE))
    rows = log.join(follow.select("coord", "target"), "coord").withColumn("coord", F.col("target")).drop("target")
    rows = rows.join(local.select("coord", "channel", "text").distinct(), ["coord", "channel", "text"], "left_anti").select(*log.columns)
    return rows, best.filter(F.coalesce("score", F.lit(0.0)) < SURE).select("coord", F.coalesce("score", F.lit(0.0)).alias("best_score"))
