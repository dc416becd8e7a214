"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, edit verification.

Strings are sequences of folded words (lower case, letters and digits). An item of n words leaks
into a document if some span of its words lies within edit distance t = floor(n / TOLERANCE) of it,
counted in words; such a span has n - t to n + t words.

1. Windows that share too few word q-grams with the items are passed over. An edit spoils q of an
   item's q-grams at most, and an insertion q - 1, so the window of n words from the start of a span
   within t edits of an item with d different q-grams has d - q * t of them, or one, even if it cuts
   the span's inserted length off: none is lost. Windows that the document's end cuts are padded.
2. The CGK random walk writes each remaining window and each item as a string of 3 n symbols whose
   Hamming distance follows the edit distance: at step j the current symbol is written, and a random
   bit of (j, symbol) says whether the walk moves on. REPEATS walks are taken; from each, SAMPLES
   sets of positions give one key a set. Their number is chosen by simulation for the target recall
   at the largest distance allowed, for the worst of insertions, deletions, substitutions and a mix.
3. Where a window shares a key with an item of its length, the spans of n - t to n + t words from its
   start and from up to t words away are compared with the item by dynamic programming. The closest
   one, and of these the first and then the shortest, is reported.

Defined cases. Null and empty texts leak nothing; items without words are ignored; items of equal
id and text count once, of equal id and other text as items of their own; a null item_id is given
as -1. A document with a repeated row is reported a row each. Other columns pass through the filter,
whatever their names. Empty tables give empty results or leave all documents. Items are sent to the
executors in blocks of BLOCK words in all (one item at least), one block at a time: the documents
are read once a block, and what is broadcast doesn't grow with the benchmark. Long items are walked
and compared in steps of STEP symbols.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .op08_minhash import folded_words
from .runtime import packed, stable, table, unpacked

TOLERANCE, STRETCH, PICKS, SAMPLES, RECALL, BLOCK, STEP = 5, 3, 3, 8, 0.98, 400_000, 1 << 21
LEAK = "array<struct<item_id: long, word_start: int, n_words: int, distance: int>>"
END = np.uint64(0x9216D5D98979FB1B)


def gram_size(n: int) -> int:
    return 3 if n >= 8 else min(n, 2)


def grams(h: np.ndarray, q: int) -> np.ndarray:
    """Hashes of the q adjacent symbols from each position; the last q - 1 are meaningless."""
    out = h.copy()
    for k in range(1, q):
        out[: len(h) - k] = out[: len(h) - k] * np.uint64(K.PAIR) + h[k:]
    return K.mix(out)


def walk(rows: np.ndarray, repeat: int) -> np.ndarray:
    """CGK embedding of each row of symbols, with the random bits of one repeat."""
    m, n = rows.shape
    size = STRETCH * n
    padded = np.concatenate([rows, np.full((m, 1), END)], axis=1)
    bits = [K.mix(padded ^ K.mix(np.full(1, (repeat << 8) + w + 1, np.uint64))) for w in range((size + 63) // 64)]
    at, line, out = np.zeros(m, np.int64), np.arange(m), np.empty((m, size), np.uint64)
    for j in range(size):
        out[:, j] = padded[line, at]
        step = (bits[j // 64][line, at] >> np.uint64(j % 64)) & np.uint64(1)
        at = np.minimum(at + step.astype(np.int64), n)
    return out


def keys(rows: np.ndarray, repeats: int) -> np.ndarray:
    """LSH keys of rows of equal length: repeats * SAMPLES columns."""
    n = rows.shape[1]
    out = []
    for r in range(repeats):
        walked = walk(rows, r)
        place = np.random.default_rng([r, n]).integers(0, STRETCH * n, (SAMPLES, PICKS))
        for s in range(SAMPLES):
            key = np.full(len(rows), (r * SAMPLES + s) * 1009 + n, np.uint64)
            for p in place[s]:
                key = K.mix(key * np.uint64(K.PAIR) + walked[:, p])
            out.append(key)
    return np.stack(out, axis=1)


def repeats_for(n: int, recall: float) -> int:
    """Walks needed for the recall on strings of n symbols with n // TOLERANCE random edits of the worst kind (simulated).

    Trials go on until each kind has hit a walk 16 times, so that rare hits are estimated as well.
    """
    edits, rng = n // TOLERANCE, np.random.default_rng(n)
    if not edits:
        return 1
    worst, trials = 1.0, max(8, min(64, STEP // (STRETCH * n)))
    # Insertions, deletions, substitutions only; and all of them.
    for kinds in ((0,), (1,), (2,), (0, 1, 2, 2)):
        hits = tried = 0
        while hits < 16 and tried < 1 << 13:
            a = rng.integers(1, 1 << 62, (trials, n)).astype(np.uint64)
            b = []
            for row in a.tolist():
                row = list(row)
                for _ in range(edits):
                    p, kind = int(rng.integers(len(row))), kinds[int(rng.integers(len(kinds)))]
                    fresh = int(rng.integers(1, 1 << 62))
                    if kind == 0:
                        row.insert(p, fresh)
                    elif kind == 1 and len(row) > 1:
                        del row[p]
                    else:
                        row[p] = fresh
                row += [int(x) for x in rng.integers(1, 1 << 62, max(0, n - len(row)))]
                b.append(row[:n])
            hits += int((keys(a, 2) == keys(np.array(b, np.uint64), 2)).reshape(trials, 2, SAMPLES).any(axis=2).sum())
            tried += 2 * trials
        worst = min(worst, max(hits, 1) / tried)
    return max(1, ceil(log(1 - recall) / log(1 - min(worst, 1 - 1e-9))))


def prefix_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit distances of each row of a to the prefixes of 0, 1, ... symbols of the same row of b."""
    ramp = np.arange(b.shape[1] + 1)
    row = np.broadcast_to(ramp, (len(b), len(ramp))).copy()
    for i in range(a.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (a[:, i : i + 1] != b))
        row = np.minimum.accumulate(new - ramp, axis=1) + ramp
    return row


def edit_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit distance of each row of a to the same row of b."""
    return prefix_distances(a, b)[:, -1]


def spans(h: np.ndarray, start: np.ndarray, stop: np.ndarray, n: int) -> np.ndarray:
    """Rows of the n symbols from each start, padded from stop on."""
    at = start[:, None] + np.arange(n)
    return np.where(at < stop[:, None], h[np.minimum(at, len(h) - 1)], END)


class Index:
    """Items by length, with q-gram tables and LSH keys."""

    def __init__(self, ids: list[int], texts: list[str | None], recall: float = RECALL):
        words = folded_words(pa.array(texts, pa.string()))
        h, r = K.mix(words.hashes()), words.range
        by: dict[int, dict[tuple, int]] = {}
        for i in range(len(ids)):
            row = h[r[i] : r[i + 1]]
            if len(row):
                by.setdefault(len(row), {})[(ids[i], row.tobytes())] = ids[i]
        self.items = {n: (np.array(list(x.values()), np.int64), np.stack([np.frombuffer(k[1], np.uint64) for k in x])) for n, x in sorted(by.items())}
        total = sum(rows.size for _, rows in self.items.values())
        self.bits = max(16, int(total * 128).bit_length())
        self.tables = {q: np.zeros(1 << self.bits, bool) for q in {gram_size(n) for n in self.items}}
        self.repeats, self.keys, self.need, self.own = {}, {}, {}, {}
        for n, (_, rows) in self.items.items():
            q = gram_size(n)
            owns = [np.unique(grams(row, q)[: n - q + 1]) for row in rows]
            self.own[n] = np.unique(np.concatenate(owns))
            self.tables[q][K.bucket(self.own[n], self.bits)] = True
            self.need[n] = max(1, min(map(len, owns)) - q * (n // TOLERANCE))
            self.repeats[n] = repeats_for(n, recall)
            flat = keys(rows, self.repeats[n])
            order = np.argsort(flat.ravel(), kind="stable")
            self.keys[n] = flat.ravel()[order], order // flat.shape[1]

    def leaks(self, column: pa.Array) -> list[list[dict]]:
        words = folded_words(column)
        h, bounds = K.mix(words.hashes()), words.range
        out: list[list[dict]] = [[] for _ in range(len(bounds) - 1)]
        if not len(h) or not self.items:
            return out
        each = {q: grams(h, q) for q in self.tables}
        hits = {q: np.concatenate(([0], np.cumsum(t[K.bucket(each[q], self.bits)]))) for q, t in self.tables.items()}
        # Positions whose following words, as many as the longest item has, hold enough q-grams of any item.
        size, longest = len(h), max(self.items)
        row = np.repeat(np.arange(len(out)), words.counts)
        stop = bounds[1:][row]
        upto = np.minimum(np.arange(size) + longest, stop)
        maybe = np.zeros(size, bool)
        for q, total in hits.items():
            maybe |= total[upto] - total[:-1] >= min(k for n, k in self.need.items() if gram_size(n) == q)
        where = np.flatnonzero(maybe)
        if not len(where):
            return out
        to = stop[where]
        cover = np.zeros(size + 1, np.int64)
        np.add.at(cover, where, 1)
        np.add.at(cover, upto[where], -1)
        cover = np.cumsum(cover[:-1]) > 0
        shared = {q: np.flatnonzero(cover & (total[1:] > total[:-1])) for q, total in hits.items()}
        mine = {q: each[q][at] for q, at in shared.items()}
        # From here on only those, and for each length its own items' q-grams.
        for n, (ids, items) in self.items.items():
            q, own = gram_size(n), self.own[n]
            there = own[np.minimum(np.searchsorted(own, mine[q]), len(own) - 1)] == mine[q]
            if there.sum() < self.need[n]:
                continue
            inside = np.zeros(size, bool)
            inside[shared[q][there]] = True
            total = np.concatenate(([0], np.cumsum(inside)))
            at = where[where + n - n // TOLERANCE <= to]
            at = at[total[np.minimum(at + n, stop[at]) - q + 1] - total[at] >= self.need[n]]
            step = max(1, min(8192, STEP // n))
            for k in range(0, len(at), step):
                some = at[k : k + step]
                place = some[:, None] + np.arange(n - q + 1)
                within = place + q <= stop[some][:, None]
                place = np.minimum(place, size - 1)
                seen = np.where(within & inside[place], each[q][place], np.uint64(0))
                seen.sort(axis=1)
                different = (seen[:, 0] != 0).astype(np.int64) + ((seen[:, 1:] != seen[:, :-1]) & (seen[:, 1:] != 0)).sum(axis=1)
                some = some[different >= self.need[n]]
                if len(some):
                    self._windows(h, bounds, n, ids, items, some, row[some], out)
        for found in out:
            best: dict[int, dict] = {}
            for x in found:
                b = best.get(x["item_id"])
                if b is None or (x["distance"], x["word_start"], x["n_words"]) < (b["distance"], b["word_start"], b["n_words"]):
                    best[x["item_id"]] = x
            found[:] = [best[k] for k in sorted(best, key=lambda k: (k is None, k))]
        return out

    def _windows(self, h, bounds, n, ids, items, start, row, out) -> None:
        """Appends the leaks of items of n words in and around the windows from start."""
        step = max(1, STEP // (STRETCH * n))
        if len(start) > step:
            for k in range(0, len(start), step):
                self._windows(h, bounds, n, ids, items, start[k : k + step], row[k : k + step], out)
            return
        flat = keys(spans(h, start, bounds[row + 1], n), self.repeats[n])
        known, item = self.keys[n]
        lo, hi = np.searchsorted(known, flat.ravel(), "left"), np.searchsorted(known, flat.ravel(), "right")
        many = hi - lo
        window = np.repeat(np.arange(flat.size) // flat.shape[1], many)
        pairs = np.unique(np.stack([window, item[K.ragged(lo, many)]]), axis=1)
        if not pairs.shape[1]:
            return
        t = n // TOLERANCE
        near = (start[pairs[0]][:, None] + np.arange(-t, t + 1)).ravel()
        which, doc = np.repeat(pairs[1], 2 * t + 1), np.repeat(row[pairs[0]], 2 * t + 1)
        inside = (near >= bounds[doc]) & (near + n - t <= bounds[doc + 1])
        tries = np.unique(np.stack([doc[inside], which[inside], near[inside]]), axis=1)
        step = max(1, min(16384, STEP // n))
        for at in range(0, tries.shape[1], step):
            doc, which, near = tries[:, at : at + step]
            stop = bounds[doc + 1]
            far = prefix_distances(items[which], spans(h, near, stop, n + t))
            far[np.arange(n + t + 1) > (stop - near)[:, None]] = n + t
            far = far[:, n - t :]
            size = far.argmin(axis=1)
            far = far[np.arange(len(far)), size]
            for k in np.flatnonzero(far <= t):
                out[doc[k]].append({"item_id": int(ids[which[k]]), "word_start": int(near[k] - bounds[doc[k]]), "n_words": int(size[k]) + n - t, "distance": int(far[k])})


def _leak_udf(index: Broadcast):
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("word_start", pa.int32()), ("n_words", pa.int32()), ("distance", pa.int32())]))

    @F.arrow_udf(LEAK)
    def leak(column: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([column], ["t"])
        return pa.array([x for piece in K.pieces(iter([batch]), 0) for x in index.value.leaks(piece.column(0))], kind)

    # Else a filter on the result would be moved below it and compute it twice.
    return leak.asNondeterministic()


def blocks(benchmark: DataFrame, most: int) -> Iterator[list]:
    """The items, in lists of about `most` words in all."""
    held, size = [], 0
    for r in benchmark.filter("text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        held.append((-1 if r[0] is None else r[0], r[1]))
        size += r[1].count(" ") + 1
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def with_leaks(docs: DataFrame, part: list, recall: float = RECALL) -> DataFrame:
    """docs as struct `__row`, and `leaks`, what of one block of items leaks into each."""
    index = docs.sparkSession.sparkContext.broadcast(Index([i for i, _ in part], [t for _, t in part], recall))
    return packed(docs, leaks=_leak_udf(index)(docs["text"].cast("string")))


def contaminations(docs: DataFrame, benchmark: DataFrame, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, word_start, n_words, distance of every leak."""
    found, small = None, docs.select("doc_id", "text")
    for part in blocks(benchmark, block):
        rows = with_leaks(small, part, recall).filter(F.size("leaks") > 0).select("__row.doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.*")
        # What one block found is stored before the next one is indexed.
        found = rows if found is None else stable(found).unionByName(rows)
    if found is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id long, word_start int, n_words int, distance int")
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """The documents into which nothing leaks."""
    kept, names = docs, docs.columns
    for k, part in enumerate(blocks(benchmark, block)):
        kept = unpacked(with_leaks(stable(kept) if k else kept, part, recall).filter(F.size("leaks") == 0), names)
    return kept


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
