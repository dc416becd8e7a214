"""Packing as a whole plan: every window against all sums, ranks over partitions, token ids."""

import random

import numpy as np
import pytest

from cairn.llm import op02_packing as P
from cairn.llm.tokens import vocabulary
from tests.llm.test_operators import table, words

rng = random.Random(23)


def check_plan(rows, counts, capacity):
    """Windows in order: each holds the longest length left, and the closest sum to capacity that the others allow."""
    by = {}
    for r in rows:
        by.setdefault(r["window_id"], []).append((r["window_offset"], r["n_tokens"]))
    assert sorted(by) == list(range(len(by)))
    left = dict(counts)
    for w in sorted(by):
        spans = sorted(by[w])
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
        sizes = [n for _, n in spans]
        if sizes == [capacity]:
            continue
        assert max(sizes) == max(left)
        sums, top = {0}, max(left)
        for k, n in left.items():
            sums = {s + k * i for s in sums for i in range(n - (k == top) + 1) if s + k * i <= capacity - top}
        assert sum(sizes) == top + max(sums)
        for k in sizes:
            left[k] -= 1
            if not left[k]:
                del left[k]
    assert not left


@pytest.mark.parametrize("partitions", [1, 5])
def test_whole_plan_against_brute_force(spark, partitions):
    capacity = 32
    docs = table(spark, [(i, words(rng.choice([1, 2, 3, 3, 3, 9, 20]))) for i in range(90)] + [(None, words(3)), (None, words(3)), (7, words(40)), (7, words(40)), (8, None), (9, "")])
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = P.pack(docs, capacity=capacity, tokens=True).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = P.token_counts(docs, tokens=True).collect()
    counts = {}
    for r in sizes:
        if r["n"] % capacity:
            counts[r["n"] % capacity] = counts.get(r["n"] % capacity, 0) + 1
    check_plan(rows, counts, capacity)
    # Every document's ids, in order, once a row.
    ids = {}
    for r in sorted(rows, key=lambda r: r["token_start"]):
        assert len(r["token_ids"]) == r["n_tokens"]
        ids.setdefault(r["doc_id"], []).append((r["token_start"], tuple(r["token_ids"])))
    for r in sizes:
        held = np.frombuffer(r["token_ids"], P.id_width(vocabulary(spark))).tolist()
        pieces = [(k, tuple(held[k : k + capacity])) for k in range(0, r["n"], capacity)]
        for piece in pieces:
            ids[r["doc_id"]].remove(piece)
    assert not any(ids.values())
    # Equal remainders are ranked by doc_id: lower ids come first.
    first = {}
    for r in rows:
        if r["n_tokens"] < capacity and r["doc_id"] is not None and r["doc_id"] != 7:
            first.setdefault(r["n_tokens"], []).append((r["window_id"], r["window_offset"], r["doc_id"]))
    assert all([d for *_, d in sorted(x)] == sorted(d for *_, d in x) for x in first.values())


def test_empty_table_and_only_empty_texts(spark):
    assert P.pack(table(spark, [])).count() == 0
    assert P.pack(table(spark, [(1, None), (2, "")])).count() == 0


def test_one_very_common_remainder_is_split(spark):
    docs = spark.createDataFrame([(i, "a b c") for i in range(4000)], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = P.ordered(P.token_counts(docs), 2048)
        sizes = [r["count"] for r in rows.groupBy(P.F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 2000
