"""What a change reaches: tests, stale notes, rotten comments, and a gate over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_runnable_test, is_test_path, short_of, test_node
from . import graph, knowledge, lineage

_RUNNERS = {".go": "go test", ".js": "node", ".jsx": "node", ".ts": "node", ".tsx": "node", ".java": "junit"}
#: Names of that many letters and fewer hit by chance.
SHORT = 3


def name_hits(files: DataFrame, names: DataFrame) -> DataFrame:
    """(path, name): test files (path, text) that hold a name as a whole word; words meet names on equality."""
    wanted = names.select("name").filter(F.length("name") > SHORT).distinct()
    words = files.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))).alias("name"))
    return words.join(wanted, "name", "left_semi").select("path", "name")


def verify_change(old: DataFrame, new: DataFrame, edges: DataFrame, files: DataFrame | None = None, unparsed: DataFrame | None = None, max_depth: int = 4) -> dict[str, DataFrame]:
    """Tables of one change: changed (coord), impacted (coord, depth), tests (coord, tier, test, runner), unparsed.

    Changed are entities of new that are added or have another body. Tests are reached over calls, imports
    and enclosing functions: "grounded" ones can be run, "other-language" ones are named with their runner;
    "name-hit" ones are files that no grounded test is in and that hold a changed name.
    """
    change = lineage.snapshot_diff(old, new).filter(F.col("change").isin("added", "changed")).select("coord")
    changed = graph.stored(new.join(change, "coord", "left_semi"))
    seeds = changed.select(F.lit("change").alias("seed"), "coord")
    reached = graph.stored(graph.change_impact(seeds, edges, graph.closure_parents(new), max_depth).select("coord", "depth"))
    around = reached.select("coord").unionByName(changed.select("coord")).distinct()
    tests = graph.stored(new.join(around, "coord", "left_semi").filter(F.col("kind").isin("function", "method") & is_test_path("path")))
    suffix = F.regexp_extract("path", r"(\.[^./]*)$", 1)
    runner = F.coalesce(*[F.when(suffix == k, v) for k, v in _RUNNERS.items()], F.lit("unknown"))
    grounded = tests.filter(is_runnable_test("path", "kind", "qualname")).select("coord", "path", F.lit("grounded").alias("tier"), test_node("path", "qualname").alias("test"), F.lit("pytest").alias("runner"))
    other = tests.filter(~F.endswith("path", F.lit(".py"))).select("coord", "path", F.lit("other-language").alias("tier"), F.col("qualname").alias("test"), runner.alias("runner"))
    found = grounded.unionByName(other)
    if files is not None:
        rest = files.filter(is_test_path("path") & F.endswith("path", F.lit(".py"))).join(grounded.select("path").distinct(), "path", "left_anti")
        hits = name_hits(rest, changed.select(short_of("qualname").alias("name"))).select("path").distinct()
        found = found.unionByName(hits.select(F.lit(None).cast("string").alias("coord"), "path", F.lit("name-hit").alias("tier"), F.col("path").alias("test"), F.lit("pytest").alias("runner")))
    return {"changed": changed, "impacted": reached, "tests": found.drop("path"), "unparsed": unparsed if unparsed is not None else new.select(F.col("coord").alias("path"), F.lit("").alias("error")).limit(0)}


def staled(display: DataFrame, changed: DataFrame) -> DataFrame:
    """Decisive stale notes on changed entities."""
    return knowledge.decisive_stale(display).join(changed.select("coord"), "coord", "left_semi")


def rotted(entities: DataFrame, log: DataFrame, shown: int = 3) -> DataFrame:
    """Entities whose comments may describe old behaviour and that no current confirmation answers: (coord, comments)."""
    answered = knowledge.rot_answered(log).filter("answered").select("coord")
    flagged = entities.filter((F.col("kind") != "module") & F.coalesce(F.col("comment_rot"), F.lit(False))).join(answered, "coord", "left_anti")
    return flagged.select("coord", F.transform(F.slice("comments", 1, shown), lambda c: c["text"]).alias("comments"))


def gate(unparsed: DataFrame, staled_: DataFrame) -> DataFrame:
    """One row: n_unparsed, n_staled (of notes and docs), passed. What nobody could parse fails as well."""
    a = unparsed.agg(F.count("*").alias("n_unparsed"))
    b = staled_.agg(F.count_if(F.col("channel").isin("notes", "docs")).alias("n_staled"))
    return a.crossJoin(F.broadcast(b)).withColumn("passed", (F.col("n_unparsed") == 0) & (F.col("n_staled") == 0))
