"""Packing by minimum bin slack over the multiset of remaining lengths.

Documents are cut into pieces of CAPACITY tokens, which are windows of their own, and a remainder.
The remainders' lengths are counted, which leaves at most CAPACITY - 1 numbers however large the
corpus is. For each window the longest remaining length is taken, and a bitset dynamic programme
over the others finds the multiset whose sum comes closest to the capacity; walking back through
the bitsets gives its counts. A multiset stays the best choice while it can be had, since taking
lengths away adds no sum, so it is used as often as the counts allow, and the number of programmes
depends on the number of lengths alone.

Documents look up their window by their rank among those of equal remainder. Ranks need no sort of a
whole length: rows are range-partitioned and sorted by (remainder, doc_id, length), which splits a
common remainder among tasks, and a row's rank is its place in its partition plus the rows of that
remainder in the partitions before. The driver gets one count a partition and remainder there: as
the order is global, CAPACITY of them and one more a partition.

Defined cases. Null and empty texts have no tokens and are in no window. Repeated rows are packed
once a row; equal remainders are ranked by doc_id (nulls first) and then total length, and rows that
tie in both can't be told apart. An empty table gives no windows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .runtime import stable, table
from .tokens import encoder, vocabulary

CAPACITY = 2048


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset out of counts (length to how many) whose sum is the largest up to room."""
    mask, bits = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted(counts, reverse=True):
        left, take = min(counts[length], room // length), 1
        while left:
            take = min(take, left)
            steps.append((length, take, bits))
            bits |= (bits << (length * take)) & mask
            left, take = left - take, take * 2
        if bits >> room & 1:
            break
    at, used = bits.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return used


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """((length, first rank, how many a window, first window, offset in the window) by window, windows)."""
    left, taken = dict(counts), dict.fromkeys(counts, 0)
    rows, window = [], 0
    while left:
        top = max(left)
        rest = dict(left)
        rest[top] -= 1
        if not rest[top]:
            del rest[top]
        use = best_fill(rest, capacity - top)
        use[top] = use.get(top, 0) + 1
        times = min(left[k] // n for k, n in use.items())
        offset = 0
        for length in sorted(use, reverse=True):
            n = use[length]
            rows.append((length, taken[length], n, window, offset))
            taken[length] += n * times
            left[length] -= n * times
            if not left[length]:
                del left[length]
            offset += length * n
        window += times
    return rows, window


def id_width(held) -> np.dtype:
    """Two bytes an id where the vocabulary's ids fit into them, else four: what is shuffled and stored."""
    ids = (int(line.split()[1]) for line in held.value[0].splitlines())
    return np.dtype("<u2") if max(ids) < 1 << 16 else np.dtype("<u4")


def token_counts(docs: DataFrame, path: str | None = None, tokens: bool = False) -> DataFrame:
    """doc_id and n, its tokens, of each row; their ids as well if asked for, as bytes of id_width()."""
    held = vocabulary(docs.sparkSession, path)
    kind = id_width(held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(held)
        for batch in K.pieces(batches, 1):
            each = [encode(t) for t in batch.column(1).to_pylist()]
            n = np.array([len(x) for x in each], np.int64)
            out = [batch.column(0), pa.array(n)]
            if tokens:
                out.append(pa.array([x.astype(kind).tobytes() for x in each], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n", "token_ids"][: len(out)])

    shape = "doc_id long, n long" + ", token_ids binary" * tokens
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, shape)


def ordered(sized: DataFrame, capacity: int) -> DataFrame:
    """Rows that have tokens, stored in the order of (rest, doc_id, n) over all partitions."""
    rows = sized.filter("n > 0").withColumn("rest", F.col("n") % capacity)
    return stable(rows.repartitionByRange("rest", "doc_id", "n").sortWithinPartitions("rest", "doc_id", "n"))


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, tokens: bool = False) -> DataFrame:
    """window_id, window_offset, doc_id, token_start and n_tokens of every piece, and its token_ids if asked for."""
    # Stored before it is ordered: the range partitioning samples its input, and texts are tokenised once.
    rows = ordered(stable(token_counts(docs, path, tokens)), capacity)
    counts = rows.groupBy(F.spark_partition_id().alias("pid"), "rest").agg(F.count("*").alias("k"), F.sum(F.expr(f"n div {capacity}")).alias("w")).collect()
    rests: dict[int, int] = {}
    ahead: dict[tuple[int, int], int] = {}
    whole: dict[int, int] = {}
    for r in sorted(counts):
        ahead[r["pid"], r["rest"]] = rests.get(r["rest"], 0)
        rests[r["rest"]] = rests.get(r["rest"], 0) + r["k"]
        whole[r["pid"]] = whole.get(r["pid"], 0) + r["w"]
    rests.pop(0, None)
    steps, base = plan(rests, capacity)
    for pid in sorted(whole):
        whole[pid], base = base, base + whole[pid]
    kind = id_width(vocabulary(docs.sparkSession, path)) if tokens else None
    known = docs.sparkSession.sparkContext.broadcast((np.array(sorted(steps), np.int64).reshape(-1, 5), ahead, whole))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, ahead, whole = known.value
        key = by[:, 0] * (1 << 44) + by[:, 1]
        pid = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        next_whole = whole.get(pid, 0)
        for batch in batches:
            n, rest = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, batch.num_columns - 1))
            first = np.flatnonzero(np.concatenate(([True], rest[1:] != rest[:-1]))) if len(rest) else np.zeros(0, np.int64)
            rank = np.arange(len(rest))
            for i, j in zip(first.tolist(), [*first[1:].tolist(), len(rest)]):
                r = int(rest[i])
                rank[i:j] += seen.get(r, ahead.get((pid, r), 0)) - i
                seen[r] = int(rank[j - 1]) + 1
            # A row's pieces: its whole windows, then the remainder, if there is one.
            full = n // capacity
            pieces = full + (rest > 0)
            row = np.repeat(np.arange(len(n)), pieces)
            turn = K.ragged(np.zeros(len(n), np.int64), pieces)
            tail = turn == full[row]
            before = next_whole + np.cumsum(full) - full
            next_whole += int(full.sum())
            window, offset, size = before[row] + turn, np.zeros(len(row), np.int64), np.full(len(row), capacity, np.int64)
            if tail.any():
                at = row[tail]
                _, from_, each, begin, shift = by[np.searchsorted(key, rest[at] * (1 << 44) + rank[at], "right") - 1].T
                again, slot = np.divmod(rank[at] - from_, each)
                window[tail], offset[tail], size[tail] = begin + again, shift + slot * rest[at], rest[at]
            out = [pa.array(window), pa.array(offset), batch.column(0).take(pa.array(row)), pa.array(turn * capacity), pa.array(size)]
            if tokens:
                out.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(np.frombuffer(b"".join(batch.column(2).to_pylist()), kind).astype(np.int32))))
            yield pa.RecordBatch.from_arrays(out, ["window_id", "window_offset", "doc_id", "token_start", "n_tokens", "token_ids"][: len(out)])

    shape = "window_id long, window_offset long, doc_id long, token_start long, n_tokens long" + ", token_ids array<int>" * tokens
    return rows.mapInArrow(place, shape)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
