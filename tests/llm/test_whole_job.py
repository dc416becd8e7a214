"""Parts of the job that an earlier state left out, with the production parameters."""

import random
import zlib

from cairn.llm import op03_decontaminate, op06_warc, op07_lines, op10_toxicity

SHAPE = "doc_id long, text string"
rng = random.Random(11)
VOCAB = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(600)]


def words(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def cleaned(spark, rows):
    return {r["doc_id"]: r["text"] for r in op07_lines.dedup_lines(spark.createDataFrame(rows, SHAPE)).collect()}


def test_every_second_copy_of_a_short_passage_goes(spark):
    rows, left = [], {}
    for i in range(60):
        lines = [words(k) for k in [(26, 26), (17, 18, 17), (30, 30, 3), (3, 4, 39, 5), (1,) * 52][i % 5]]
        for copy in (0, 1):
            before, after = words(12), words(13)
            rows.append((i + 1000 * copy, "\n".join([before, *lines, after])))
            left[i + 1000 * copy] = f"{before}\n{after}" if copy else rows[-1][1]
    assert cleaned(spark, rows) == left


def test_blank_lines_at_the_first_place_keep_no_other_copies(spark):
    parts, near = [words(20) for _ in range(3)], words(9)
    rows = [(1, "\n\n".join(parts))] + [(i, words(11) + "\n" + "\n".join(parts) + "\n" + words(11)) for i in range(2, 8)]
    # Here blank lines differ beside the passage only.
    more = [words(20) for _ in range(3)]
    rows += [(20, near + "\n\n" + "\n".join(more)), (21, near + "\n" + "\n".join(more) + "\n" + words(11))]
    after = cleaned(spark, rows)
    text = dict(rows)
    assert all(after[i] == text[i] for i in (1, 2, 20))
    assert all(after[i] == text[i].replace("\n".join(parts) + "\n", "") for i in range(3, 8))
    assert after[21] == text[21].replace("\n".join(more) + "\n", "")


def test_equal_lines_within_a_range_that_differs():
    a = "\n".join([words(6), words(6), "x " * 9, words(6), words(3)]).encode()
    b = a.replace(b"x", b"y")
    cut = a.index(b"x") - 1
    assert op07_lines.alike(a, a) == [(0, len(a))]
    assert op07_lines.alike(a, b) == [(0, cut), (cut + 20, len(a))]


def closest(item, text):
    """Least edit distance of the item to any span of the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item):
        new = [i + 1]
        for j, y in enumerate(text):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return min(row)


def test_leaks_with_insertions_and_deletions_against_brute_force(spark):
    items = [(i, words((8, 15, 20, 38, 59)[i % 5])) for i in range(15)]
    rows = []
    for i, t in items:
        n = len(t.split())
        for k in range(n // op03_decontaminate.TOLERANCE + 2):
            for insert in (True, False):
                w = t.split()
                for _ in range(k):
                    at = rng.randrange(1, len(w))
                    w[at : at + (not insert)] = [words(1)] if insert else []
                edges = [(words(30), words(30)), ("", words(30)), (words(30), ""), ("", "")][len(rows) % 4]
                rows.append((len(rows), f"{edges[0]} {' '.join(w)} {edges[1]}"))
    texts = {i: t.split() for i, t in rows}
    true = {(d, i): closest(t.split(), texts[d]) for d in texts for i, t in items}
    true = {k: x for k, x in true.items() if x <= len(dict(items)[k[1]].split()) // op03_decontaminate.TOLERANCE}
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = op03_decontaminate.contaminations(spark.createDataFrame(rows, SHAPE), bench).collect()
    for r in found:
        span = texts[r["doc_id"]][r["word_start"] : r["word_start"] + r["n_words"]]
        assert closest(span, dict(items)[r["item_id"]].split()) <= r["distance"] and closest(dict(items)[r["item_id"]].split(), span) == r["distance"]
    assert {(r["doc_id"], r["item_id"]) for r in found} <= set(true)
    print("found", len(found), "of", len(true))
    assert len(found) >= 0.97 * len(true)


def test_an_item_less_one_word_leaks_alone(spark):
    items = [(i, words(12)) for i in range(10)]
    rows = [(i, t.split(" ", 1)[1] if i % 2 else t.rsplit(" ", 1)[0]) for i, t in items]
    found = op03_decontaminate.contaminations(spark.createDataFrame(rows, SHAPE), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["n_words"], r["distance"]) for r in found) == [(i, i, 11, 1) for i in range(10)]


def test_a_warc_record_with_a_very_long_url():
    url = "data:text/html," + "a" * 200_000
    row = op06_warc.parse(zlib.decompress(op06_warc.record(url, b"<p>x", 5, "t"), 31), "")
    assert (row["status"], row["page_id"], row["target_uri"], row["payload"]) == ("ok", 5, url, b"<p>x")


def test_the_toxicity_sample_holds_1500_documents(spark):
    docs = spark.createDataFrame([(i, "x") for i in range(1600)], SHAPE)
    labels = spark.createDataFrame([(i, 1, 1) for i in range(1600)], "doc_id long, quality int, toxic int")
    texts, toxic = op10_toxicity.sample(docs, labels, op10_toxicity.SAMPLE)
    assert len(texts) == toxic.sum() == 1500
