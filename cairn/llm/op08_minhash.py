"""MinHash near-duplicates with sequential Bayesian verification.

Words are lower-cased runs of letters and digits; a document's shingles are its adjacent word
pairs (its one word, if it has just one). Two documents are near duplicates if the Jaccard
similarity of their shingle sets is at least THRESHOLD, and groups are the connected components.

1. One pass gives each document a 128-bit hash of its word sequence and a signature of
   BANDS * ROWS minima. Documents of equal sequence collapse into the one of least id.
2. Band keys group the collapsed documents. Inside each group signatures are compared in batches
   of STEP minima; a pair is dropped as soon as the posterior probability (uniform prior) that its
   similarity reaches the threshold falls below MISS. Survivors give candidate components.
3. The texts of each candidate component meet once; pairs that share a band and survive the same
   bounds are verified on their exact shingle sets, unless they are connected already.
   Components of verified pairs are the groups.
No task grows with the largest group. Band groups are told apart by map-side aggregates (those of
the same members in several bands are one), not by lists of their members. Groups of more than SPLIT
documents are cut into random blocks of about SPLIT; each of SHUFFLES rounds connects the documents
of every block, and groups that have become one component are done, as groups of true copies are
after a round or two. In the rest every pair of blocks is one task, so that no pair is lost.

Defined cases. Null, empty and wordless texts, and rows of null doc_id, are in no group and stay.
Rows that repeat a doc_id and text count as copies of one document: one stays. A doc_id with
several texts is similar to whatever one of them is similar to. Of a group the least id stays, with
one row for each of its texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .components import components
from .runtime import join_checked, packed, stable, table, unpacked

THRESHOLD, BANDS, ROWS, STEP, MISS, SPLIT, SHUFFLES = 0.6, 24, 4, 16, 0.005, 2048, 3

#: ASCII letters and digits and all bytes above ASCII make words; letters are lower-cased.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
NO_WORD = np.ones(256, bool)
NO_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the letters that UTF-8 writes as 0xC3 and a byte."""
    out = FOLD[data]
    if len(data) > 1:
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][upper] += 32
    return out


def folded_words(column: pa.Array) -> K.Words:
    data, offsets = K.buffers(column)
    return K.Words(fold(data), offsets, NO_WORD)


def _salts(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = K.mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (x[:n] >> np.uint64(32)).astype(np.uint32)[:, None], (x[n:] >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)


def minima(shingles: np.ndarray, xor: np.ndarray, times: np.ndarray) -> np.ndarray:
    """One minimum for each salt over a document's 32-bit shingles, in steps that bound memory."""
    best = np.full(len(xor), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), 4096):
        np.minimum(best, ((shingles[None, at : at + 4096] ^ xor) * times).min(axis=1), out=best)
    return best


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sig.reshape(-1, bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2])
    for r in range(rows):
        key = K.mix(key * np.uint64(K.PAIR) + parts[:, :, r])
    return key


def shingled(column: pa.Array) -> tuple[K.Words, np.ndarray, np.ndarray]:
    """Words, mixed shingle hashes, and each row's bounds among them."""
    words = folded_words(column)
    h = K.mix(words.hashes())
    pair = np.zeros(len(h), np.uint64)
    pair[1:] = K.mix(h[:-1] * np.uint64(K.PAIR) + h[1:])
    use = ~words.first()
    alone = words.range[:-1][words.counts == 1]
    pair[alone], use[alone] = h[alone], True
    counts = np.maximum(words.counts - 1, np.minimum(words.counts, 1))
    return words, pair[use], np.concatenate(([0], np.cumsum(counts)))


def sequence_hashes(words: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row's sequence of words."""
    h, n = words.hashes(), len(words)
    place = np.arange(n) - np.repeat(words.range[:-1], words.counts)
    up = K.powers(int(place.max()) + 1 if n else 1)[0][place]
    return tuple(K.row_sums(K.mix(h ^ np.uint64(salt)) * up, words.range) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F))


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, h1, h2, sig (16 bits a minimum) and band keys of each document that has words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xor, times = _salts(bands * rows)
        for batch in K.pieces(batches, 1):
            words, shingles, bounds = shingled(batch.column(1))
            h1, h2 = sequence_hashes(words)
            low = shingles.astype(np.uint32)
            at = np.flatnonzero(words.counts)
            if not len(at):
                continue
            sig = np.stack([minima(low[bounds[i] : bounds[i + 1]], xor, times) for i in at])
            keys = band_keys(sig, bands, rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * bands), pa.array(keys.ravel().view(np.int64)))
            packed = (sig >> np.uint32(16)).astype(np.uint16).tobytes()
            width = bands * rows * 2
            binary = pa.array([packed[i * width : (i + 1) * width] for i in range(len(at))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(h1[at].view(np.int64)), pa.array(h2[at].view(np.int64)), binary, lists], ["id", "h1", "h2", "sig", "keys"])

    rows_ = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("__text"))
    return rows_.mapInArrow(sign, "id long, h1 long, h2 long, sig binary, keys array<long>")


def least_matches(n: int, step: int, threshold: float, miss: float) -> list[tuple[int, int]]:
    """(minima compared, matches at least): with fewer, P(similarity >= threshold) < miss.

    With a uniform prior the posterior after m matches of k is Beta(m + 1, k - m + 1), whose upper
    tail is a binomial sum.
    """
    out = []
    for k in range(step, n + 1, step):
        tail = 0.0
        for m in range(k + 1):
            tail += comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
            if tail >= miss:
                out.append((k, m))
                break
    return out


def surviving(sigs: np.ndarray, one: np.ndarray, rules: list[tuple[int, int]]) -> np.ndarray:
    """Indices of rows of sigs whose comparison with one is never cut off."""
    left, done, matched = np.arange(len(sigs)), 0, np.zeros(len(sigs), np.int64)
    for upto, least in rules:
        matched = matched + (sigs[left, done:upto] == one[done:upto]).sum(axis=1)
        ok = matched >= least
        left, matched, done = left[ok], matched[ok], upto
        if not len(left):
            break
    return left


def blocks_of(members: DataFrame, split: int) -> DataFrame:
    """Members (grp, id, n) to (grp, b0, b1, id): every pair of blocks of a group meets in one task."""
    n_blocks = F.ceil(F.col("n") / F.lit(split))
    members = members.withColumn("own", F.pmod(F.xxhash64("id"), n_blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)))
    members = members.filter((F.col("own") != F.col("other")) | (n_blocks == 1))
    return members.select("grp", F.least("own", "other").alias("b0"), F.greatest("own", "other").alias("b1"), "id")


def linked(members: DataFrame, split: int, edges_of) -> DataFrame:
    """Edges that connect the members (grp, id, n) of each group as edges_of((grp, b0, b1, id)) finds them in tasks."""
    members = stable(members)
    found = stable(edges_of(blocks_of(members.filter(F.col("n") <= split), split)))
    big = members.filter(F.col("n") > split)
    for turn in range(SHUFFLES):
        if big.isEmpty():
            return found
        block = F.pmod(F.xxhash64("id", F.lit(turn)), F.ceil(F.col("n") / F.lit(split)))
        found = stable(found.unionByName(edges_of(big.select("grp", block.alias("b0"), F.lit(0).cast("long").alias("b1"), "id"))))
        # A document that nothing has reached is its own root.
        at = big.join(components(found), "id", "left").select("grp", F.coalesce("root", "id").alias("root"))
        several = at.groupBy("grp").agg((F.min("root") < F.max("root")).alias("open")).filter("open").select("grp")
        big = stable(big.join(several, "grp", "left_semi"))
    return found if big.isEmpty() else found.unionByName(edges_of(blocks_of(big, split)))


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches sorted by their first `keys` columns, cut into one list of slices a key."""
    held: list[pa.RecordBatch] = []
    now: tuple | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(n, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        at = [0, *np.flatnonzero(change).tolist(), n]
        for i, j in zip(at, at[1:]):
            key = tuple(c[i] for c in cols)
            if key != now and held:
                yield held
                held = []
            now = key
            held.append(batch.slice(i, j - i))
    if held:
        yield held


def _closest(x: int, rest: np.ndarray, sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which of rest are similar to x, by exact shingle sets."""
    mine, sizes = sets[x], np.array([len(sets[y]) for y in rest])
    flat = np.concatenate([sets[y] for y in rest])
    place = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
    both = np.add.reduceat(mine[place] == flat, np.concatenate(([0], np.cumsum(sizes)[:-1])), dtype=np.int64)
    return rest[both >= threshold * (len(mine) + sizes - both)]


def _connect(n: int, near) -> list[tuple[int, int]]:
    """Tree edges of the components of the graph whose neighbours near(x, unreached) gives."""
    edges, rest = [], np.arange(n)
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            found = near(x, rest)
            if len(found):
                edges += [(x, int(y)) for y in found]
                queue += found.tolist()
                rest = np.setdiff1d(rest, found, assume_unique=True)
    return edges


def _edge_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def band_groups(canon: DataFrame) -> DataFrame:
    """(grp, id, n) of the documents that share a band key; groups of equal members once."""
    keyed = canon.select("id", F.explode("keys").alias("grp"))
    sums = [F.sum(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1 << 40))).alias(f"s{k}") for k in (1, 2)]
    groups = keyed.groupBy("grp").agg(F.count("*").alias("n"), *sums).filter("n > 1")
    groups = stable(groups.groupBy("n", "s1", "s2").agg(F.min("grp").alias("grp")).select("grp", "n"))
    return join_checked(keyed, groups, "grp").select("grp", "id", "n")


def candidate_edges(canon: DataFrame, rules: list[tuple[int, int]], split: int) -> DataFrame:
    """Tree edges over documents whose signatures survive, from each group of one band key."""

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for run in _runs(batches, 3):
            ids = [i for b in run for i in b.column(3).to_pylist()]
            sigs = np.frombuffer(b"".join(s for b in run for s in b.column(4).to_pylist()), np.uint16).reshape(len(ids), -1)
            out += [(ids[x], ids[y]) for x, y in _connect(len(ids), lambda x, rest: rest[surviving(sigs[rest], sigs[x], rules)])]
            if len(out) > 20_000:
                yield _edge_batch(out)
                out = []
        yield _edge_batch(out)

    def edges_of(tasks: DataFrame) -> DataFrame:
        ready = tasks.join(canon.select("id", "sig"), "id").repartition("grp", "b0", "b1").sortWithinPartitions("grp", "b0", "b1", "id")
        return ready.select("grp", "b0", "b1", "id", "sig").mapInArrow(connect, "a long, b long")

    return linked(band_groups(canon), split, edges_of)


def verified_edges(texts: DataFrame, rules: list[tuple[int, int]], threshold: float, bands: int, rows: int) -> DataFrame:
    """Tree edges of verified pairs, from texts (grp, b0, b1, id, __text) sorted by task."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xor, times = _salts(bands * rows)
        out: list[tuple[int, int]] = []
        for run in _runs(batches, 3):
            ids: list[int] = []
            sets: list[np.ndarray] = []
            sigs: list[np.ndarray] = []
            for part in K.pieces(iter(run), 4):
                _, shingles, bounds = shingled(part.column(4))
                ids += part.column(3).to_pylist()
                for i in range(part.num_rows):
                    sets.append(np.unique(shingles[bounds[i] : bounds[i + 1]]))
                    sigs.append(minima(sets[-1].astype(np.uint32), xor, times))
            sig = np.stack(sigs)
            keys, short = band_keys(sig, bands, rows), (sig >> np.uint32(16)).astype(np.uint16)

            def near(x: int, rest: np.ndarray) -> np.ndarray:
                some = rest[(keys[rest] == keys[x]).any(axis=1)]
                some = some[surviving(short[some], short[x], rules)]
                return _closest(x, some, sets, threshold) if len(some) else some

            out += [(ids[x], ids[y]) for x, y in _connect(len(ids), near)]
            if len(out) > 20_000:
                yield _edge_batch(out)
                out = []
        yield _edge_batch(out)

    return texts.mapInArrow(verify, "a long, b long")


def members(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, split: int = SPLIT) -> tuple[DataFrame, DataFrame]:
    """((id, h1, h2, group_id) of every document that has words, and its stored signatures)."""
    rules = least_matches(bands * rows, STEP, threshold, MISS)
    signed = stable(signatures(docs, bands, rows))
    canon = signed.groupBy("h1", "h2").agg(F.min_by(F.struct("id", "sig", "keys"), "id").alias("x")).select("h1", "h2", "x.id", "x.sig", "x.keys")
    canon = stable(canon)
    found = components(candidate_edges(canon, rules, split))
    sizes = found.groupBy(F.col("root").alias("grp")).agg(F.count("*").alias("n"))
    numbered = found.select(F.col("root").alias("grp"), "id").join(sizes, "grp")
    # A doc_id with several texts brings them all; each is compared under the same id.
    text = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("__text"))

    def edges_of(tasks: DataFrame) -> DataFrame:
        ready = tasks.join(text, "id").repartition("grp", "b0", "b1").sortWithinPartitions("grp", "b0", "b1", "id")
        return verified_edges(ready.select("grp", "b0", "b1", "id", "__text"), rules, threshold, bands, rows)

    final = components(linked(numbered, split, edges_of))
    own = signed.select("id", "h1", "h2").join(canon.select("h1", "h2", F.col("id").alias("rep")), ["h1", "h2"])
    own = own.join(final.withColumnRenamed("id", "rep"), "rep", "left")
    return own.select("id", "h1", "h2", F.coalesce("root", "rep").alias("group_id")), signed


def near_duplicate_groups(docs: DataFrame, **how) -> DataFrame:
    """doc_id, group_id (the group's least doc_id, which stays) and n_docs of every document in a group of two and more.

    One row a document, however large a group is; a doc_id of several texts is one document.
    """
    own = stable(members(docs, **how)[0].groupBy("id").agg(F.min("group_id").alias("group_id")))
    sizes = own.groupBy("group_id").agg(F.count("*").alias("n_docs")).filter("n_docs > 1")
    return join_checked(own, sizes, "group_id").select(F.col("id").alias("doc_id"), "group_id", "n_docs")


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """docs without all but one document of each group."""
    own, signed = members(docs, **how)
    own = stable(own)
    if signed.groupBy("id").count().filter("count > 1").limit(1).count():
        return _drop_by_row(docs, own)
    gone = own.filter("id <> group_id").select(F.col("id").alias("gone"))
    rows = packed(docs, id=docs["doc_id"].cast("long"))
    return unpacked(rows.join(gone, rows["id"] == gone["gone"], "left_anti"), docs.columns)


def _drop_by_row(docs: DataFrame, own: DataFrame) -> DataFrame:
    """Where ids repeat: of the least id of a group one row a word sequence stays."""

    @F.arrow_udf("struct<h1: long, h2: long>")
    def sequence(column: pa.Array) -> pa.Array:
        h = sequence_hashes(folded_words(column))
        return pa.StructArray.from_arrays([pa.array(x.view(np.int64)) for x in h], ["h1", "h2"])

    marked = packed(docs, id=docs["doc_id"].cast("long"), s=sequence(F.coalesce(docs["text"].cast("string"), F.lit(""))))
    marked = marked.select("__row", "id", F.col("s.h1").alias("h1"), F.col("s.h2").alias("h2"))
    joined = marked.join(own.distinct(), ["id", "h1", "h2"], "left")
    kept = joined.filter("id = group_id").groupBy("id", "h1", "h2").agg(F.any_value("__row").alias("__row")).select("__row")
    return unpacked(kept.unionByName(joined.filter("group_id is null").select("__row")), docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "documents"))
