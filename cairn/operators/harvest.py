"""Notes that are mined from what is there: docstrings, test names, assertions, documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import backtick_refs, contract_words, digest16, is_test_path, short_of, write_stamp


def _new(found: DataFrame, log: DataFrame, channel: str, author: str) -> DataFrame:
    """found (coord, text), the first text a coord, where the channel holds nothing of that author yet."""
    had = log.filter((F.col("channel") == channel) & (F.col("author") == author)).select("coord").distinct()
    one = found.groupBy("coord").agg(F.min("text").alias("text"))
    return one.join(had, "coord", "left_anti").select("coord", F.lit(channel).alias("channel"), F.lit(author).alias("author"), "text")


def docstrings(docs: DataFrame, entities: DataFrame, log: DataFrame) -> DataFrame:
    """Notes for docs (path, lineno, text): those that begin where an entity of the file does."""
    found = docs.join(entities.select("coord", "path", "lineno"), ["path", "lineno"]).select("coord", F.trim("text").alias("text"))
    return _new(found.filter("text <> ''"), log, "docs", "mined-docstring")


def test_contracts(refs: DataFrame, entities: DataFrame, log: DataFrame) -> DataFrame:
    """Notes on what a test calls and is named after. refs: src_qualname and the coord that it resolved to."""
    tests = entities.filter(F.col("kind").isin("function", "method")).select(F.col("qualname").alias("src_qualname"), contract_words(short_of("qualname")).alias("words")).filter(F.size("words") > 0)
    target = entities.select("coord", F.lower(short_of("qualname")).alias("short"))
    hit = refs.join(tests, "src_qualname").join(target, "coord").filter(F.array_contains("words", F.col("short")))
    return _new(hit.select("coord", F.concat(F.lit("contract of "), "src_qualname", F.lit(": "), F.array_join("words", " ")).alias("text")), log, "notes", "mined-test")


def assertion_contracts(asserted: DataFrame, entities: DataFrame, log: DataFrame) -> DataFrame:
    """Notes on what assertions of tests call. asserted: test (its name) and the coord that the call resolved to."""
    target = entities.filter(F.col("kind").isin("function", "method") & ~is_test_path("path")).select("coord")
    named = asserted.filter(F.size(contract_words("test")) > 0).join(target, "coord", "left_semi")
    return _new(named.select("coord", F.concat(F.lit("asserted by "), "test", F.lit(": "), F.array_join(contract_words("test"), " ")).alias("text")), log, "notes", "mined-test-assert")


def doc_bindings(docs: DataFrame, entities: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(doc, file_hash, coord, logic_hash): entities that documents (doc, text) name in backticks.

    A document whose text is as it was keeps the bindings of `before`, with the digests of then; the
    others are bound to the digests of now. Names are full or end a full name at a dot, uniquely.
    """
    hashed = docs.filter(~F.array_contains(F.split("doc", "/"), F.lit("examples"))).select("doc", "text", digest16(F.col("text")).alias("file_hash"))
    now = entities.select("coord", "qualname", short_of("qualname").alias("short"), write_stamp("logic_hash", "body_hash").alias("logic_hash"))
    fresh = hashed if before is None else hashed.join(before.select("doc", "file_hash").distinct(), ["doc", "file_hash"], "left_anti")
    named = fresh.select("doc", "file_hash", F.explode(backtick_refs("text")).alias("ref")).withColumn("short", short_of("ref"))
    hit = named.join(now, "short").filter((F.col("qualname") == F.col("ref")) | F.endswith("qualname", F.concat(F.lit("."), F.col("ref"))))
    exact = F.col("qualname") == F.col("ref")
    one = hit.groupBy("doc", "file_hash", "ref").agg(F.count("*").alias("n"), F.min("coord").alias("only"), F.min(F.when(exact, F.col("coord"))).alias("exact"))
    found = one.select("doc", "file_hash", F.coalesce("exact", F.when(F.col("n") == 1, F.col("only"))).alias("coord")).filter("coord is not null").distinct().join(now.select("coord", "logic_hash"), "coord")
    found = found.select("doc", "file_hash", "coord", "logic_hash")
    if before is None:
        return found
    return before.join(hashed.select("doc", "file_hash"), ["doc", "file_hash"], "left_semi").select(*found.columns).unionByName(found)


def drifted(bindings: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc, coord, fresh) of bindings whose entity is still there: fresh if its behaviour is as the document knew it."""
    now = entities.select("coord", write_stamp("logic_hash", "body_hash").alias("now"))
    return bindings.join(now, "coord").select("doc", "coord", (F.col("now") == F.col("logic_hash")).alias("fresh"))


def apply_churn(metrics: DataFrame, churn: DataFrame) -> DataFrame:
    """metrics with churn taken from (coord, churn) where it is known there, and `dirty` where that changed it."""
    joined = metrics.withColumnRenamed("churn", "was").join(churn.select("coord", F.col("churn").alias("now")), "coord", "left")
    return joined.withColumn("churn", F.coalesce("now", "was")).withColumn("dirty", F.coalesce(F.col("now") != F.coalesce("was", F.lit(-1)), F.lit(False))).drop("was", "now")
