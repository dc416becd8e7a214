"""Training-data operators against brute force, round trips and their defined cases."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from cairn.llm import crf, op01_pii, op02_packing, op03_decontaminate, op04_quality, op06_warc, op07_lines, op08_minhash, op09_tokens, op10_toxicity
from cairn.llm.components import components

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, `id` long, `__text` string"
rng = random.Random(7)
VOCAB = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(600)]


def words(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1, "x") for i, t in rows], SHAPE)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, clashing columns."""
    long_ = words(30_000)
    return table(spark, [(1, None), (2, ""), (None, words(20)), (3, long_), (3, long_), (4, "   \n\n "), (5, words(50)), (6, "ü ß é\n" * 3)])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SHAPE)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (3, 0, 1), (None, 1, 1), (6, None, None), (5, 1, 0)], "doc_id long, quality int, toxic int")


def test_defined_cases_of_all_stages(spark, odd, none, labels):
    items = spark.createDataFrame([(1, words(12)), (2, None), (3, "")], "item_id long, text string")
    for docs in (odd, none):
        for df in (op04_quality.filter_quality(docs, labels), op07_lines.dedup_lines(docs), op08_minhash.drop_near_duplicates(docs), op03_decontaminate.drop_contaminated(docs, items)):
            assert df.columns == docs.columns
            df.collect()
        for df in (op02_packing.pack(docs), op09_tokens.token_blocks(docs), op10_toxicity.toxic_documents(docs, labels), op01_pii.private_documents(docs)):
            df.collect()
    assert op08_minhash.drop_near_duplicates(odd).count() == 7
    assert op03_decontaminate.drop_contaminated(odd, items).count() == 8


def test_quality_sums_against_plain_python(spark):
    docs = table(spark, [(i, words(rng.randint(1, 60))) for i in range(40)])
    known = spark.createDataFrame([(i, int(i < 10), 0) for i in range(30)], "doc_id long, quality int, toxic int")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}

    def buckets(t):
        grams, _ = op04_quality.gram_buckets(pa.array([t]))
        return grams

    size = 1 << op04_quality.BITS
    raw = sum(np.bincount(buckets(t), minlength=size) for t in texts.values())
    good = sum(np.bincount(buckets(texts[i]), minlength=size) for i in range(10))
    w = op04_quality.weights(good, raw)
    found = {r["doc_id"]: r["score_micro"] for r in op04_quality.quality_scores(docs, known, threshold=-(10**9)).collect()}
    assert found == {i: int(w[buckets(t)].sum()) for i, t in texts.items()}


def test_line_dedup_keeps_the_first_place(spark):
    shared = "\n".join(words(14) for _ in range(5))
    docs = table(spark, [(1, words(9) + "\n" + shared + "\n" + words(8)), (2, shared + "\n" + words(9)), (3, words(9)), (4, words(60)), (5, "a b\n" + words(5))])
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    after = {r["doc_id"]: r for r in op07_lines.dedup_lines(docs).collect()}
    assert all(after[i]["text"] == before[i] for i in (1, 3, 4, 5))
    assert after[2]["text"] == before[2][len(shared) + 1 :] and after[2]["n_chars"] == len(after[2]["text"])


def _pairs(texts, threshold):
    sets = []
    for t in texts:
        _, sh, _ = op08_minhash.shingled(pa.array([t]))
        sets.append(set(sh.tolist()))
    return {(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])}


def test_near_duplicates_recall_against_brute_force(spark):
    texts = []
    for _ in range(40):
        base = words(80).split()
        texts.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            for _ in range(rng.randint(0, 14)):
                copy[rng.randrange(len(copy))] = rng.choice(VOCAB)
            texts.append(" ".join(copy))
    docs = table(spark, list(enumerate(texts)))
    for split in (2048, 2):
        group = {r["doc_id"]: r["group_id"] for r in op08_minhash.near_duplicate_groups(docs, split=split).collect()}
        true = _pairs(texts, op08_minhash.THRESHOLD)
        hit = sum(group.get(i, -1) == group.get(j, -2) for i, j in true)
        assert hit >= 0.9 * len(true)
        assert all(i // 4 == g // 4 for i, g in group.items())


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51), (60, 60)], "a long, b long")
    found = {r["id"]: r["root"] for r in components(edges).collect()}
    assert found == {**{i: 0 for i in range(31)}, 50: 50, 51: 50}


def test_bayesian_bounds_only_drop_the_improbable():
    for k, m in op08_minhash.least_matches(96, 16, 0.6, 0.005):
        assert 0 < m <= 0.6 * k


def test_decontamination_recall_and_exactness(spark):
    items = [(i, words(rng.randint(8, 30))) for i in range(25)]
    rows, planted = [], set()
    for i, (item, t) in enumerate(items * 4):
        w = t.split()
        for _ in range(rng.randint(0, len(w) // op03_decontaminate.TOLERANCE)):
            w[rng.randrange(len(w))] = "changed"
        rows.append((i, words(40) + " " + " ".join(w) + " " + words(30)))
        planted.add((i, item))
    rows += [(1000 + i, words(200)) for i in range(50)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in op03_decontaminate.contaminations(table(spark, rows), bench).collect()}
    assert len(found & planted) >= 0.9 * len(planted) and all(d < 1000 for d, _ in found)
    blocks = {(r["doc_id"], r["item_id"]) for r in op03_decontaminate.contaminations(table(spark, rows), bench, block=7).collect()}
    assert blocks == found


def test_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    a, b = np.random.default_rng(1).integers(0, 4, (2, 50, 9)).astype(np.uint64)
    assert op03_decontaminate.edit_distances(a, b).tolist() == [plain(x, y) for x, y in zip(a.tolist(), b.tolist())]


def test_best_fill_is_the_closest_sum():
    for _ in range(60):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(4)}
        room = rng.randint(1, 60)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * i for s in sums for i in range(n + 1) if s + k * i <= room}
        use = op02_packing.best_fill(counts, room)
        assert sum(k * n for k, n in use.items()) == max(sums) and all(n <= counts[k] for k, n in use.items())


def test_packing_places_every_token_once(spark):
    docs = table(spark, [(i, words(rng.randint(1, 90))) for i in range(60)] + [(7, words(5)), (8, None)])
    rows = op02_packing.pack(docs, capacity=64).collect()
    by = {}
    for r in rows:
        by.setdefault(r["window_id"], []).append((r["window_offset"], r["n_tokens"]))
    assert sorted(by) == list(range(len(by)))
    for spans in by.values():
        spans.sort()
        assert sum(n for _, n in spans) <= 64 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0
    assert sum(r["n_tokens"] for r in rows) == sum(r["n"] for r in op02_packing.token_counts(docs).collect())


def test_token_blocks_round_trip(spark, odd):
    counts = np.array([0, 1, 128, 129, 1000])
    ids = np.random.default_rng(3).integers(0, 1 << 31, int(counts.sum()))
    ids[::3] %= 50
    data, bounds, starts = op09_tokens.encode(ids, counts)
    at = block = 0
    for i, n in enumerate(counts.tolist()):
        k = -(-n // op09_tokens.SIZE)
        assert op09_tokens.decode(data[bounds[i] : bounds[i + 1]].tobytes(), starts[block : block + k].tolist(), n).tolist() == ids[at : at + n].tolist()
        at, block = at + n, block + k
    sizes = sorted(r["n"] for r in op02_packing.token_counts(odd).collect())
    assert sizes == sorted(len(op09_tokens.decode(bytes(r["payload"]), r["block_starts"], r["n_tokens"])) for r in op09_tokens.token_blocks(odd).collect())


def test_warc_statuses(spark, tmp_path):
    parts = [op06_warc.record(f"http://a/{i}", f"<p>{i}</p>".encode(), i, "t") for i in range(4)]
    raw = zlib.decompress(parts[1], 31).replace(b"<p>1", b"<p>9")
    parts[1] = (packer := zlib.compressobj(4, zlib.DEFLATED, 31)).compress(raw) + packer.flush()
    parts[2] = parts[2][:30] + b"\xff" * 8 + parts[2][38:]
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"".join(parts) + parts[0][:-20])
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    files = spark.createDataFrame([(f"file://{path}",), (f"file://{tmp_path}/empty.warc.gz",), (None,)], "uri string")
    rows = op06_warc.read_warc(files).orderBy("offset").collect()
    status = [r["status"] for r in rows]
    assert status[:2] == ["ok", "bad digest"] and "bad gzip" in status and status[-1] == "truncated"
    assert next(r for r in rows if r["page_id"] == 3)["status"] == "ok"


def test_crf_marginals_against_enumeration():
    from itertools import product

    r = np.random.default_rng(5)
    emit, trans, start = r.normal(size=(6, 2)), r.normal(size=(2, 2)), r.normal(size=2)
    first = np.array([True] + [False] * 5)
    paths = {y: np.exp(start[y[0]] + emit[range(6), y].sum() + sum(trans[a, b] for a, b in zip(y, y[1:]))) for y in product((0, 1), repeat=6)}
    total = sum(paths.values())
    want = [sum(p for y, p in paths.items() if y[i] == 1) / total for i in range(6)]
    assert crf.marginals(emit, trans, start, first)[:, 1] == pytest.approx(want)


def test_loopy_messages_are_exact_on_trees():
    r = np.random.default_rng(6)
    emit, pair = r.normal(size=(3, 2)), r.normal(size=(2, 2))
    found = op01_pii.loopy(emit, np.array([[0, 1]]), np.array([[1, 2]]), pair, 0.8, rounds=200)
    p = np.zeros((3, 2))
    for y in np.ndindex(2, 2, 2):
        s = np.exp(emit[range(3), y].sum() + pair[y[0], y[1]] + 0.8 * (y[1] == y[2]))
        for i in range(3):
            p[i, y[i]] += s
    assert found == pytest.approx(p / p.sum(axis=1, keepdims=True), abs=1e-3)


def test_private_data_on_held_out_documents(spark):
    rows = []
    for i in range(300):
        secret = [f"user{i}@mail{i % 9}.example.com", f"+1 (202) 555-{1000 + i}", f"10.0.{i % 250}.{i % 200 + 1}"][i % 3]
        rows.append((i, f"{words(15)} {secret} {words(10)}" if i % 2 else words(20)))
    found = {r["doc_id"] for r in op01_pii.private_documents(table(spark, rows), size=120).collect()}
    true = {i for i in range(300) if i % 2}
    assert len(found & true) >= 0.9 * len(true) and not found - true


def test_toxicity_on_held_out_documents(spark):
    bad = ["vilegrub", "stinkrot", "muckhead"]
    rows = [(i, " ".join([words(20), rng.choice(bad), words(20)]) if i % 3 == 0 else words(40)) for i in range(360)]
    known = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(240)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r["spans"] for r in op10_toxicity.toxic_documents(table(spark, rows), known).collect()}
    assert {i for i in out if i >= 240} == {i for i in range(240, 360) if i % 3 == 0}
    text = dict(rows)
    assert all(text[i][s["start"] : s["end"]] in bad for i, spans in out.items() for s in spans)


def test_pipeline_stages_and_rows(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "MinHash near-dedup", "benchmark decontamination", "packing"]
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["window_id", "window_offset", "doc_id", "token_start", "n_tokens", "token_ids"] and out.count() > 0
