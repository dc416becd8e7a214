"""Nulls, empty and long texts, ties, repeated rows, clashing names: what each operator gives."""

import numpy as np
import pyarrow as pa

from cairn.llm import crf, op03_decontaminate as D, op04_quality as Q, op09_tokens as B, op10_toxicity as X
from cairn.llm.tokens import encoder, vocabulary
from tests.llm.oracle import rows_of, rows_of_sql
from tests.llm.test_operators import none, odd, table, words  # noqa: F401 - fixtures


def test_quality(spark):
    good = [words(30) for _ in range(20)]
    rows = [*enumerate(good), (50, None), (51, "  \n"), (3, good[3]), (None, good[0])]
    known = spark.createDataFrame([*[(i, 1, 0) for i in range(20)], (3, 1, 0), (3, 0, 1), (None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    docs = table(spark, rows)
    assert rows_of(Q.quality_scores(docs, known)) == rows_of_sql(Q.oracle(), documents=docs.select("doc_id", "text"), labels=known)
    kept = sorted(((r["doc_id"], r["text"]) for r in Q.filter_quality(docs, known).collect()), key=str)
    assert set(kept) <= {r for r in rows if r[0] not in (50, 51)} and len(kept) > 15 and kept.count((3, good[3])) == 2
    assert ((None, good[0]) in kept) == ((0, good[0]) in kept)
    # A document at the threshold is kept, one micro-nat above it goes.
    row = Q.quality_scores(table(spark, [(1, "a b")]), known).first()
    mean = row["score_micro"] // row["n_grams"]
    exact = [Q.quality_scores(table(spark, [(1, "a b")]), known, threshold=t).count() for t in (mean, mean + 1)]
    assert row["score_micro"] % row["n_grams"] or exact == [1, 0]
    clash = spark.createDataFrame([(1, "a b", "mine", 7, 8)], "doc_id long, text string, __q string, q int, __row int")
    assert [tuple(r) for r in Q.filter_quality(clash, known).collect()] == [(1, "a b", "mine", 7, 8)]
    # Without a trusted document the target is uniform: frequent n-grams count against a text.
    assert Q.quality_scores(docs, known.limit(0)).count() >= 0 and Q.filter_quality(docs.limit(0), known).count() == 0


def test_decontamination(spark):
    item = words(14)
    rows = [(1, None), (2, ""), (None, f"{words(9)} {item} {words(9)}"), (3, f"{item} {words(20_000)}"), (4, words(40)), (5, item), (5, item)]
    bench = spark.createDataFrame([(1, item), (1, item), (None, item), (2, None), (3, ""), (7, "...")], "item_id long, text string")
    found = sorted((str(r["doc_id"]), r["item_id"], r["word_start"], r["n_words"], r["distance"]) for r in D.contaminations(table(spark, rows), bench).collect())
    assert found == sorted([(str(d), i, s, 14, 0) for d, s in ((None, 9), (3, 0), (5, 0), (5, 0)) for i in (-1, 1)])
    clash = spark.createDataFrame([(1, item, 3, "a"), (2, words(30), 4, "b")], "doc_id long, text string, leaks int, __leaks string")
    assert [tuple(r)[2:] for r in D.drop_contaminated(clash, bench).collect()] == [(4, "b")]
    assert D.drop_contaminated(table(spark, rows), bench.limit(0)).count() == len(rows) and D.contaminations(table(spark, rows), bench.limit(0)).count() == 0
    assert D.contaminations(table(spark, []), bench).count() == 0


def test_long_items_in_blocks(spark):
    """Items of thousands of words, one index at a time; no cap on walks."""
    items = [(i, words(n)) for i, n in enumerate((1500, 400, 12))]
    texts = []
    for i, t in items:
        w = t.split()
        for k in range(len(w) // 10):
            w[(k * 9973) % len(w)] = f"other{k}"
        texts.append((i, f"{words(20)} {' '.join(w)} {words(20)}"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 300):
        assert sorted((r["doc_id"], r["item_id"]) for r in D.contaminations(table(spark, texts), bench, block=block).collect()) == [(0, 0), (1, 1), (2, 2)]
    assert D.repeats_for(400, 0.98) >= 1


def test_token_blocks(spark, odd):  # noqa: F811
    out = B.token_blocks(odd).collect()
    inner = encoder(vocabulary(spark))
    want = sorted((str(r["doc_id"]), inner(r["text"]).tolist()) for r in odd.collect())
    assert sorted((str(r["doc_id"]), B.decode(bytes(r["payload"]), r["block_starts"], r["n_tokens"]).tolist()) for r in out) == want
    empty = [r for r in out if r["doc_id"] in (1, 2)]
    assert all((r["n_tokens"], r["block_starts"], bytes(r["payload"])) == (0, [], b"") for r in empty) and B.token_blocks(odd.limit(0)).count() == 0


def test_blocked_marginals_are_the_plain_ones():
    r = np.random.default_rng(8)
    n = 1000
    emit, trans, start, first = r.normal(size=(n, 2)), r.normal(size=(2, 2)), r.normal(size=2), r.random(n) < 0.01
    first[0] = True
    want = np.empty((n, 2))
    bounds = [*np.flatnonzero(first).tolist(), n]
    for a, b in zip(bounds, bounds[1:]):
        alpha, beta = np.zeros((b - a, 2)), np.zeros((b - a, 2))
        alpha[0] = start + emit[a]
        for i in range(1, b - a):
            alpha[i] = np.logaddexp.reduce(alpha[i - 1][:, None] + trans, axis=0) + emit[a + i]
        for i in range(b - a - 2, -1, -1):
            beta[i] = np.logaddexp.reduce(trans + (emit[a + i + 1] + beta[i + 1])[None], axis=1)
        x = alpha + beta
        want[a:b] = np.exp(x - np.logaddexp.reduce(x, axis=1, keepdims=True))
    assert np.abs(crf.marginals(emit, trans, start, first) - want).max() < 1e-9


def test_toxicity(spark):
    bad, rows = "vilegrub", []
    for i in range(240):
        rows.append((i, f"{words(20)} {bad} {words(20)}" if i % 3 == 0 else words(40)))
    long_ = f"{words(20_000)} {bad}"
    rows += [(500, None), (501, ""), (502, "  "), (None, f"x {bad} y"), (503, f"a {bad} b"), (503, f"a {bad} b"), (504, long_), (505, "plain words only")]
    labels = [(i, 1, int(i % 3 == 0)) for i in range(240)] + [(0, 1, 0), (None, 1, 1), (505, None, None)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = X.toxic_documents(table(spark, rows), known).collect()
    ids = sorted(str(r["doc_id"]) for r in out if r["doc_id"] is None or r["doc_id"] >= 240)
    assert ids == ["503", "503", "504", "None"] and 0 in {r["doc_id"] for r in out}
    spans = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in out}
    assert spans[503] == [(2, 10)] and spans[504] == [(len(long_) - 8, len(long_))] and spans[None] == [(2, 10)]
    assert all(0 < r["score"] <= 1 and r["n_spans"] == len(r["spans"]) for r in out)
    assert X.toxic_documents(table(spark, rows), known.limit(0)).count() == 0 and X.toxic_documents(table(spark, []), known).count() == 0
    # Of a document whose labels differ the toxic one counts.
    texts, toxic = X.sample(table(spark, rows), known, 10**6)
    assert toxic[texts.index(rows[0][1])] == 1
    assert pa.array(texts).null_count == 0
