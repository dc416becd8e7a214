"""Toxic spans by a linear-chain conditional random field.

The labels say which documents are toxic, not which words, so tokens are labelled first. Over a
bounded sample of labelled documents, of which near copies are left out, a unit (a whole word, or a
beginning of STEMS bytes) is offensive if PRECISION of the class-balanced documents that hold it
are toxic and chance is ruled out: n * KL(share of toxic | sample's share) exceeds the logarithm of
the number of units by MARGIN. Tokens with an offensive unit in toxic documents are positive, all
others negative. The field is trained on FIT of those documents a class: two states, transition
weights, and hashed features of the word, its beginnings, its end, its case and its neighbours, by
gradient ascent on the regularised likelihood. So it also tags words that the sample doesn't hold.

Every document is one sequence, whole. Forward-backward marginals of at least CUT make offending
tokens; adjacent ones make a span, given in characters; a document's score is one minus the product
of one minus the offending tokens' marginals. It is toxic from the score on that tells the sample's
toxic documents apart best (F1), CUT at least.

Defined cases. Null and empty texts score 0. Repeated rows are scored row by row. A document whose
labels differ counts as toxic; labels with nulls are ignored. Without toxic labels nothing is toxic.
The sample is the first SAMPLE toxic and twice as many other labelled documents by a hash of doc_id:
a parameter, and the only bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crf
from . import kernel as K
from .op08_minhash import BANDS, ROWS, _salts, band_keys, folded_words, minima, shingled
from .runtime import table

SAMPLE, FIT, PRECISION, MARGIN, CUT, BITS, ROUNDS = 1500, 400, 0.95, 4.0, 0.5, 18, 30
STEMS = (4, 5, 6, 7, 8)


def units(words: K.Words) -> np.ndarray:
    """(1 + STEMS, tokens) hashes of the word and its beginnings; 0 where the word is no longer than that."""
    rows = [K.mix(words.hashes())]
    for k in STEMS:
        longer = words.ends - words.starts > k
        h = K.mix(K.span_hashes(words.data, words.starts, np.minimum(words.starts + k, words.ends)) + np.uint64(k))
        rows.append(np.where(longer, h, np.uint64(0)))
    return np.stack(rows)


def features(words: K.Words, raw: np.ndarray, bits: int = BITS) -> np.ndarray:
    """(features, tokens) bucket of each feature of each token; bucket 0 is no feature."""
    own = units(words)
    h, n, first = own[0], len(words), words.first()
    before, after = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    before[1:] = np.where(first[1:], np.uint64(0), h[:-1])
    after[:-1] = np.where(first[1:], np.uint64(0), h[1:])
    tail = K.span_hashes(words.data, np.maximum(words.ends - 3, words.starts), words.ends)
    second = np.minimum(words.starts + 1, max(len(raw) - 1, 0))
    shape = (raw[words.starts] != words.data[words.starts]).astype(np.uint64) + 2 * (raw[second] != words.data[second]).astype(np.uint64)
    shape = shape * np.uint64(16) + np.minimum(words.ends - words.starts, 15).astype(np.uint64)
    rows = []
    for k, x in enumerate((*own, before, after, tail, shape)):
        at = np.maximum(K.bucket(K.mix(x * np.uint64(16) + np.uint64(k)), bits), 1)
        rows.append(np.where(x == 0, 0, at) if 0 < k <= len(STEMS) else at)
    return np.stack(rows)


def sample(docs: DataFrame, labels: DataFrame, size: int) -> tuple[list[str], np.ndarray]:
    """Texts and labels of the first `size` toxic and twice as many other documents, by a hash of doc_id."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("y"))
    chosen = [known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(size * (2 - y)) for y in (0, 1)]
    ids = chosen[0].unionByName(chosen[1])
    text = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    rows = text.join(F.broadcast(ids), "id").groupBy("id", "y").agg(F.min("text").alias("text")).orderBy(F.xxhash64("id"), "id").toArrow()
    return rows.column("text").to_pylist(), rows.column("y").to_numpy().astype(np.int64)


def slices(texts: list[str], *more: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The sample in slices of half a megabyte: the driver holds little more than the texts."""
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *map(pa.array, more)], ["t", *map(str, range(len(more)))])
    return K.pieces(iter([batch]), 0, 1 << 19)


def without_copies(texts: list[str]) -> np.ndarray:
    """Indices of the texts that share no MinHash band with an earlier one."""
    xor, times = _salts(BANDS * ROWS)
    known: set[int] = set()
    out, at = [], 0
    for piece in slices(texts):
        _, shingles, bounds = shingled(piece.column(0))
        low = shingles.astype(np.uint32)
        for i in range(piece.num_rows):
            keys = band_keys(minima(low[bounds[i] : bounds[i + 1]], xor, times), BANDS, ROWS)[0].tolist()
            if known.isdisjoint(keys):
                out.append(at)
            known.update(keys)
            at += 1
    return np.array(out, np.int64)


def offensive_units(texts: list[str], toxic: np.ndarray, precision: float = PRECISION, margin: float = MARGIN) -> np.ndarray:
    """Hashes of offensive units, ascending."""
    n = np.bincount(toxic, minlength=2).astype(float)
    if not n.all():
        return np.zeros(0, np.uint64)
    seen: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]]
    for piece in slices(texts, toxic):
        words = folded_words(piece.column(0))
        own, r, y = units(words), words.range, piece.column(1).to_numpy()
        for i in range(piece.num_rows):
            seen[y[i]].append(np.unique(own[:, r[i] : r[i + 1]]))
    (clean, n_clean), (bad, n_bad) = (np.unique(np.concatenate(x), return_counts=True) for x in seen)
    at = np.minimum(np.searchsorted(clean, bad), max(len(clean) - 1, 0))
    there = np.where(clean[at] == bad, n_clean[at], 0) if len(clean) else np.zeros(len(bad))
    p_bad, p_clean, share = n_bad / n[1], there / n[0], n[1] / n.sum()
    q = n_bad / (n_bad + there)
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = q * np.log(q / share) + np.where(q < 1, (1 - q) * np.log((1 - q) / (1 - share)), 0)
    ok = (p_bad >= precision * (p_bad + p_clean)) & ((n_bad + there) * kl >= np.log(len(bad) + len(clean)) + margin)
    return bad[ok & (bad != 0)]


def train(texts: list[str], toxic: np.ndarray, words_: np.ndarray, rounds: int = ROUNDS, bits: int = BITS) -> dict:
    """Weights of state 1 (state 0 has none), transitions and start, by Adam on the mean log likelihood."""
    words = folded_words(pa.array(texts, pa.string()))
    raw, _ = K.buffers(pa.array(texts, pa.string()))
    n, first = len(words), words.first()
    w, trans, start = np.zeros(1 << bits), np.zeros((2, 2)), np.zeros(2)
    if not n or not len(words_):
        w[:] = -1.0
        return {"w": w.astype(np.float32), "trans": trans, "start": start, "cut": CUT}
    own = units(words)
    y = (words_[np.minimum(np.searchsorted(words_, own), len(words_) - 1)] == own).any(axis=0) & (toxic[words.rows()] > 0)
    y = y.astype(np.int64)
    f = features(words, raw, bits)
    pairs = np.zeros((2, 2))
    inner = np.flatnonzero(~first)
    np.add.at(pairs, (y[inner - 1], y[inner]), 1)
    begun = np.bincount(y[first], minlength=2)
    held = [np.zeros(w.shape), np.zeros((2, 2)), np.zeros(2)]
    second = [np.zeros(w.shape), np.zeros((2, 2)), np.zeros(2)]
    weight = np.where(y == 1, max(1.0, (n - y.sum()) / max(y.sum(), 1) / 50), 1.0)
    for step in range(1, rounds + 1):
        emit = np.stack([np.zeros(n), w[f].sum(axis=0)], axis=1)
        p, both = crf.pair_marginals(emit, trans, start, first)
        miss = (y - p[:, 1]) * weight
        grad_w = np.zeros_like(w)
        for row in f:
            grad_w += np.bincount(row, miss, minlength=len(w))
        grads = [grad_w - 0.01 * w, pairs - both - 0.01 * trans, begun - p[first].sum(axis=0) - 0.01 * start]
        for k, (x, g) in enumerate(zip((w, trans, start), grads)):
            held[k] = 0.9 * held[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            x += 0.3 * (held[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return {"w": w.astype(np.float32), "trans": trans, "start": start, "cut": CUT}


def tag(column: pa.Array, model: dict, cut: float = CUT) -> tuple[np.ndarray, list[list[dict]]]:
    """(score, offending spans) of each row."""
    raw, _ = K.buffers(column)
    words = folded_words(column)
    rows = len(words.counts)
    if not len(words):
        return np.zeros(rows), [[] for _ in range(rows)]
    score = model["w"][features(words, raw)].sum(axis=0).astype(np.float64)
    p = crf.marginals(np.stack([np.zeros(len(score)), score], axis=1), model["trans"], model["start"], words.first())[:, 1]
    bad = p >= cut
    out: list[list[dict]] = [[] for _ in range(rows)]
    at = np.flatnonzero(bad)
    left = np.zeros(rows)
    if len(at):
        row = np.searchsorted(words.range, at, "right") - 1
        np.add.at(left, row, np.log1p(-np.minimum(p[at], 1 - 1e-12)))
        begin = np.ones(len(at), bool)
        begin[1:] = (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])
        heads = np.flatnonzero(begin)
        ends = np.concatenate((heads[1:], [len(at)])) - 1
        chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        for a, b in zip(heads, ends):
            base = chars[words.offsets[row[a]]]
            out[row[a]].append({"start": int(chars[words.starts[at[a]]] - base), "end": int(chars[words.ends[at[b]]] - base)})
    return 1 - np.exp(left), out


def holds(texts: list[str], found: np.ndarray) -> np.ndarray:
    """Whether each text holds an offensive unit."""
    out = [np.zeros(0, bool)]
    for piece in slices(texts):
        words = folded_words(piece.column(0))
        own = units(words)
        hit = (found[np.minimum(np.searchsorted(found, own), len(found) - 1)] == own).any(axis=0) if len(found) else np.zeros(len(words), bool)
        out.append(K.row_sums(hit.astype(np.int64), words.range) > 0)
    return np.concatenate(out)


def best_cut(score: np.ndarray, toxic: np.ndarray) -> float:
    """The score, CUT at least, from which documents are best called toxic (F1; the middle of the gap below it)."""
    order = np.argsort(-score, kind="stable")
    s, y = score[order], toxic[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + max(y.sum(), 1))
    last = np.append(s[1:] < s[:-1], True)
    f1 = np.where(last & (s >= CUT), f1, -1.0)
    if not len(f1) or f1.max() <= 0:
        return CUT
    k = int(np.argmax(f1))
    return max(CUT, float((s[k] + (s[k + 1] if k + 1 < len(s) else 0.0)) / 2))


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, few: int = FIT) -> dict:
    """A trained field, with the document score from which the sample is best told apart."""
    texts, toxic = sample(docs, labels, size)
    keep = without_copies(texts)
    texts, toxic = [texts[i] for i in keep], toxic[keep]
    found = offensive_units(texts, toxic)
    # Clean documents that hold an offensive unit by chance teach most, and come first.
    hard = np.flatnonzero((toxic == 0) & holds(texts, found))[:few]
    use = np.concatenate([np.flatnonzero(toxic == 1)[:few], hard, np.setdiff1d(np.flatnonzero(toxic == 0), hard)[: few - len(hard)]])
    model = train([texts[i] for i in use], toxic[use], found)
    score = [tag(piece.column(0), model)[0] for piece in slices(texts)]
    model["cut"] = best_cut(np.concatenate([np.zeros(0), *score]), toxic)
    return model


def toxic_documents(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, score, n_spans and spans (start, end in characters) of every toxic document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **how))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.pieces(batches, 1):
            score, spans = tag(batch.column(1), model.value)
            some = np.flatnonzero((score >= model.value["cut"]) & np.array([bool(x) for x in spans]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(some)), pa.array(score[some]), pa.array([len(spans[i]) for i in some], pa.int32()), pa.array([spans[i] for i in some], kind)],
                ["doc_id", "score", "n_spans", "spans"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, n_spans int, spans array<struct<start: int, end: int>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
