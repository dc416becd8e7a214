"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Every document's words and adjacent word pairs are hashed into 2**BITS buckets. Two multinomials
with add-one smoothing are estimated over those buckets: the target from all documents labelled of
quality 1, the raw one from all documents. A document's score is the mean over its n-grams of
log p_target - log p_raw; it is kept if that mean is at least the threshold. Weights are whole
micro-nats and scores are whole sums, so a decision never depends on the order of additions.

Defined cases. Null or blank text has no n-grams: score 0, mean null, rejected. A document equal
to another one gets the same decision; a repeated row counts as often as it occurs, in the corpus
and (if labelled) in the target; repeated labels count once. A label row with a null id or quality
is ignored. Without any trusted document the target is uniform. Ties with the threshold are kept. Empty
tables give empty results.
Other columns of documents, whatever their names, pass through the filter untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .runtime import packed, semi_join_ids, table, unpacked

BITS = 16
#: Micro-nats an n-gram, at least, of a document that is kept.
THRESHOLD = -150_000


def gram_buckets(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each row (words, then pairs, row by row), and each row's bounds."""
    words = K.Words(*K.buffers(column))
    h = words.hashes()
    pair = np.zeros(len(h), np.uint64)
    pair[1:] = h[:-1] * np.uint64(K.PAIR) + h[1:]
    inner = ~words.first()
    each = np.empty((len(h), 2), np.int64)
    each[:, 0] = K.bucket(h, bits)
    each[:, 1] = np.where(inner, K.bucket(pair, bits), -1)
    flat = each.ravel()
    counts = np.maximum(2 * words.counts - 1, 0)
    return flat[flat >= 0], np.concatenate(([0], np.cumsum(counts)))


def bucket_counts(docs: DataFrame, bits: int = BITS) -> np.ndarray:
    """How often each bucket occurs in `__text` of docs; one sparse row a bucket and task is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in K.pieces(batches, 0):
            total += np.bincount(gram_buckets(batch.column(0), bits)[0], minlength=1 << bits)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["b", "n"])

    rows = docs.select("__text").mapInArrow(count, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(1 << bits, np.int64)
    total[rows["b"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return total


def weights(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    p = np.log((target + 1.0) / float(target.sum() + len(target)))
    q = np.log((raw + 1.0) / float(raw.sum() + len(raw)))
    return np.floor((p - q) * 1e6).astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame, bits: int = BITS) -> np.ndarray:
    """Micro-nats of each bucket, from all documents and all labels."""
    text = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("__text"))
    trusted = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("__id")).distinct()
    return weights(bucket_counts(semi_join_ids(text, trusted, "__id"), bits), bucket_counts(text, bits))


def scorer(w: np.ndarray, bits: int = BITS):
    """An Arrow function of text that gives struct(score_micro, n_grams)."""
    table_ = w

    @F.arrow_udf("struct<score_micro: long, n_grams: long>")
    def score(column: pa.Array) -> pa.Array:
        sums, counts = [], []
        batch = pa.RecordBatch.from_arrays([column], ["t"])
        for piece in K.pieces(iter([batch]), 0):
            grams, bounds = gram_buckets(piece.column(0), bits)
            sums.append(K.row_sums(table_[grams], bounds))
            counts.append(np.diff(bounds))
        flat = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (sums, counts)]
        return pa.StructArray.from_arrays(flat, ["score_micro", "n_grams"])

    # Else a filter on the result would be moved below it and compute it twice.
    return score.asNondeterministic()


def scored(docs: DataFrame, labels: DataFrame, bits: int = BITS) -> DataFrame:
    """docs as struct `__row`, and `q`, struct(score_micro, n_grams)."""
    return packed(docs, q=scorer(fit(docs, labels, bits), bits)(docs["text"].cast("string")))


def passes(threshold: int = THRESHOLD):
    return (F.col("q.n_grams") > 0) & (F.col("q.score_micro") >= threshold * F.col("q.n_grams"))


def filter_quality(docs: DataFrame, labels: DataFrame, threshold: int = THRESHOLD, bits: int = BITS) -> DataFrame:
    """The documents that pass, with their own columns."""
    return unpacked(scored(docs, labels, bits).filter(passes(threshold)), docs.columns)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: int = THRESHOLD, bits: int = BITS) -> DataFrame:
    """doc_id, score_micro, n_grams and llr (nats an n-gram) of every document that passes."""
    q = scored(docs.select("doc_id", "text"), labels, bits).filter(passes(threshold))
    return q.select("__row.doc_id", "q.score_micro", "q.n_grams", (F.col("q.score_micro") / F.col("q.n_grams") / F.lit(1e6)).alias("llr"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def oracle(threshold: int = THRESHOLD, bits: int = BITS) -> str:
    """The same in DuckDB SQL, from bytes up."""
    size, two64 = 1 << bits, f"{1 << 64}::HUGEINT"
    spread = f"(({{}} * {K.SPREAD}::HUGEINT) % {two64}) >> {64 - bits}"
    return f"""
WITH toks AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(regexp_split_to_array(text, '[\\t\\n\\x0b\\f\\r ]+'), lambda x: x <> '') AS ws
  FROM documents WHERE text IS NOT NULL),
vocab AS (SELECT DISTINCT unnest(ws) AS w FROM toks),
hashed AS (
  SELECT w, list_reduce(list_prepend(0::HUGEINT, list_reverse(list_transform(range(1, octet_length(encode(w)) + 1),
           lambda i: ('0x' || substr(hex(encode(w)), (2 * i - 1)::BIGINT, 2))::INTEGER::HUGEINT))),
           lambda a, b: (a * {K.R}::HUGEINT + b) % {two64}) AS h FROM vocab),
flat AS (SELECT rid, doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM toks),
one AS (SELECT rid, doc_id, i, h, lag(h) OVER (PARTITION BY rid ORDER BY i) AS p FROM flat JOIN hashed USING (w)),
grams AS (
  SELECT rid, doc_id, {spread.format('h')} AS b FROM one
  UNION ALL
  SELECT rid, doc_id, {spread.format(f'((p * {K.PAIR}::HUGEINT + h) % {two64})')} FROM one WHERE p IS NOT NULL),
trusted AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL),
counts AS (
  SELECT b, count(*) AS r, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM trusted)) AS t FROM grams GROUP BY b),
sums AS (SELECT sum(r)::DOUBLE + {size} AS rs, sum(t)::DOUBLE + {size} AS ts FROM counts),
w AS (SELECT b, floor((ln((t + 1.0::DOUBLE) / ts) - ln((r + 1.0::DOUBLE) / rs)) * 1e6::DOUBLE)::BIGINT AS w FROM counts, sums),
scores AS (SELECT rid, any_value(doc_id) AS doc_id, sum(w)::BIGINT AS score_micro, count(*) AS n_grams FROM grams JOIN w USING (b) GROUP BY rid)
SELECT doc_id, score_micro, n_grams, score_micro::DOUBLE / n_grams::DOUBLE / 1e6::DOUBLE AS llr
FROM scores WHERE score_micro >= {threshold} * n_grams"""
