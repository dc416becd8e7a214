"""The pipeline over a small corpus against plain Python versions of its stages."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from cairn.llm import op02_packing, op03_decontaminate, op04_quality, op08_minhash
from cairn.llm.op08_minhash import folded_words
from tests.llm.test_lines import brute
from tests.llm.test_operators import words
from tests.llm.test_packing import check_plan
from tests.llm.test_whole_job import closest

rng = random.Random(57)
SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    """Good and junk documents, repeated passages, exact and near copies, leaks, nulls, empty and repeated rows."""
    texts, shared = {}, [words(13) for _ in range(4)]
    items = [(i, words(14)) for i in range(6)]
    for i in range(60):
        texts[i] = "\n".join(words(rng.randint(10, 18)) for _ in range(rng.randint(2, 5)))
    for i in range(60, 66):
        texts[i] = words(20) + "\n" + "\n".join(shared) + "\n" + words(20)
    for i in range(66, 72):
        texts[i] = texts[i - 66]
    for i in range(72, 84):
        base = texts[i - 52].replace("\n", " ").split()
        base[rng.randrange(len(base))] = "changed"
        texts[i] = " ".join(base)
    for i in range(84, 90):
        w = items[i - 84][1].split()
        w[5] = "other"
        texts[i] = f"{words(30)} {' '.join(w)} {words(30)}"
    for i in range(90, 100):
        texts[i] = " ".join("".join(rng.choice("qwxyz#$%") for _ in range(8)) for _ in range(60))
    rows = list(texts.items()) + [(0, texts[0]), (200, None), (201, ""), (None, words(40))]
    return rows, items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, items = corpus()
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SHAPE).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i < 90), 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows, items


def quality_kept(rows, trusted):
    size = 1 << op04_quality.BITS
    grams = lambda t: op04_quality.gram_buckets(pa.array([t or ""]))[0]
    raw = sum(np.bincount(grams(t), minlength=size) for _, t in rows)
    good = sum(np.bincount(grams(t), minlength=size) for i, t in rows if i in trusted)
    w = op04_quality.weights(good, raw)
    return [(i, t) for i, t in rows if len(g := grams(t)) and w[g].sum() >= op04_quality.THRESHOLD * len(g)]


def near_groups(texts):
    """Components of exact shingle similarity, by union of all pairs."""
    sets = {i: set(op08_minhash.shingled(pa.array([t]))[1].tolist()) for i, t in texts.items()}
    root = {i: i for i in texts}
    find = lambda i: i if root[i] == i else find(root[i])
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= op08_minhash.THRESHOLD * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in texts if find(i) == i or not sets[i]}


@pytest.fixture(scope="module")
def results(spark, folder):
    """What each stage returns, stored as Parquet and read again for the next."""
    at, _, _ = folder
    docs, out = spark.read.parquet(f"{at}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, at).write.parquet(f"{at}/stage-{k}")
        docs = spark.read.parquet(f"{at}/stage-{k}")
        out.append(docs)
    return out


def now(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def folded(text):
    w = folded_words(pa.array([text]))
    return [w.data[a:b].tobytes().decode() for a, b in zip(w.starts, w.ends)]


def test_stages_against_plain_python(spark, folder, results):
    at, rows, items = folder
    one, two, three, four, five = results
    kept = quality_kept(rows, set(range(90)))
    assert now(one) == sorted(kept, key=str) and 60 < len(kept) < len(rows)
    left, found = brute({i: t for i, t in kept if i is not None}), now(two)
    assert {i: [x for x in t.split("\n") if x.split()] for i, t in found if i is not None} == {i: x for i, x in left.items() if x}
    assert {r[0] for r in now(three)} - {None} == near_groups({i: t for i, t in found if i is not None})
    assert sum(r[0] == 0 for r in now(three)) == 1
    clean = [(i, t) for i, t in now(three) if all(closest(folded(x), folded(t)) > len(folded(x)) // op03_decontaminate.TOLERANCE for _, x in items)]
    assert now(four) == clean and len(clean) < three.count()
    sizes = {}
    for r in op02_packing.token_counts(four).collect():
        if r["n"] % op02_packing.CAPACITY:
            sizes[r["n"] % op02_packing.CAPACITY] = sizes.get(r["n"] % op02_packing.CAPACITY, 0) + 1
    check_plan(five.collect(), sizes, op02_packing.CAPACITY)
    documents = spark.read.parquet(f"{at}/documents.parquet").columns
    assert all(df.columns == documents for df in results[:4])


def test_the_whole_run_is_the_stages_in_order(spark, folder, results):
    key = lambda r: (r["window_id"], r["window_offset"])
    assert sorted(corpus_pipeline.run(spark, folder[0]).collect(), key=key) == sorted(results[4].collect(), key=key)


def test_windows_can_be_made_into_text_again(spark, results):
    from cairn.llm.tokens import encoder, vocabulary

    inner, pieces = encoder(vocabulary(spark)).inner, {}
    for r in results[4].collect():
        pieces.setdefault(r["doc_id"], []).append((r["token_start"], r["token_ids"]))
    assert sorted(inner.decode([x for _, ids in sorted(p) for x in ids]) for p in pieces.values()) == sorted(r["text"] for r in results[3].collect())


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SHAPE).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
