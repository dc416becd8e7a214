"""Line dedup against brute force over all runs of lines, and its defined cases."""

import random

from cairn.llm import op07_lines as L
from tests.llm.test_operators import table, words

rng = random.Random(41)


def brute(texts):
    """Lines that stay, by doc: a line goes if some run of whole lines around it that makes a chunk stands earlier."""
    runs, first = [], {}
    for doc in sorted(texts):
        t, at, lines = texts[doc] or "", 0, []
        for line in t.split("\n"):
            lines.append((at, at + len(line), len(line.split())))
            at += len(line) + 1
        full = [k for k, x in enumerate(lines) if x[2]]
        for i in range(len(full)):
            n = 0
            for j in range(i, len(full)):
                n += lines[full[j]][2]
                if n >= L.LEAST and (j > i or lines[full[i]][2] >= L.LONG):
                    part = t[lines[full[i]][0] : lines[full[j]][1]]
                    place = (doc, lines[full[i]][0])
                    runs.append((part, place, doc, full[i], full[j]))
                    first[part] = min(first.get(part, place), place)
    gone = {(doc, k) for part, place, doc, i, j in runs if first[part] != place for k in range(i, j + 1)}
    return {doc: [x for k, x in enumerate((t or "").split("\n")) if x.split() and (doc, k) not in gone] for doc, t in texts.items()}


def test_against_all_runs_of_lines(spark):
    pool = [words(rng.choice([2, 3, 5, 9, 14, 45])) for _ in range(60)]
    for salt in range(4):
        texts = {}
        for doc in range(60):
            lines = []
            while len(lines) < rng.randint(1, 14):
                k = rng.randrange(len(pool))
                lines += pool[k : k + rng.randint(1, 4)] if rng.random() < 0.6 else [words(rng.choice([1, 4, 12]))]
                if rng.random() < 0.15:
                    lines.append(rng.choice(["", "  "]))
            texts[doc] = "\n".join(lines)
        out = {r["doc_id"]: r["text"] for r in L.dedup_lines(table(spark, list(texts.items()))).collect()}
        want = brute(texts)
        assert {d: [x for x in t.split("\n") if x.split()] for d, t in out.items()} == want


def test_short_blocks_in_two_documents_each(spark):
    for n_lines in (2, 3, 5, 8, 12):
        texts, blocks = {}, []
        for i in range(60):
            block = [words(rng.randint(4, 9)) for _ in range(n_lines)]
            blocks.append(block)
            for copy in (0, 1):
                texts[i + 1000 * copy] = "\n".join([*[words(11) for _ in range(rng.randint(0, 3))], *block, *[words(12) for _ in range(rng.randint(0, 3))]])
        out = {r["doc_id"]: r["text"] or "" for r in L.dedup_lines(table(spark, list(texts.items()))).collect()}
        gone = sum(line not in out[1000 + i].split("\n") for i, b in enumerate(blocks) for line in b)
        assert gone == 60 * n_lines and all(out[i] == texts[i] for i in range(60))


def test_defined_cases(spark):
    passage = "\n".join(words(12) for _ in range(3))
    biggest = (1 << 63) - 1
    rows = [(1, passage), (2, None), (3, ""), (None, passage), (None, passage), (4, f"{passage}\n{passage}"), (4, f"{passage}\n{passage}"), (biggest, f"x y\n{passage}"), (5, passage), (1, passage), (6, " \n\n ")]
    out = sorted(((r["doc_id"], r["text"]) for r in L.dedup_lines(table(spark, rows)).collect()), key=str)
    assert out == sorted([(1, passage), (1, passage), (2, None), (3, ""), (None, passage), (None, passage), (4, ""), (4, ""), (biggest, "x y"), (5, ""), (6, " \n\n ")], key=str)
    left = sorted(((r["doc_id"], r["text"]) for r in L.dedup_lines(table(spark, rows), drop_emptied=True).collect()), key=str)
    assert left == [x for x in out if not (x[0] in (4, 5) and x[1] == "")]
    # A chunk that repeats within one document stays at its first place.
    twice = table(spark, [(8, f"{passage}\nmiddle part\n{passage}")])
    assert L.dedup_lines(twice).first()["text"] == f"{passage}\nmiddle part"
    assert L.dedup_lines(table(spark, [])).count() == 0
    clash = spark.createDataFrame([(1, passage, 1, "r"), (2, passage, 2, "s")], "doc_id long, text string, __cut int, __row string")
    assert sorted((r["doc_id"], r["text"], r["__cut"], r["__row"]) for r in L.dedup_lines(clash).collect()) == [(1, passage, 1, "r"), (2, "", 2, "s")]


def test_a_chunk_of_a_third_of_all_documents(spark):
    hot = "\n".join(words(12) for _ in range(3))
    rows = [(i, (hot + "\n" if i % 3 == 0 else "") + words(9)) for i in range(1500)]
    out = {r["doc_id"]: r["text"] for r in L.dedup_lines(table(spark, rows)).collect()}
    assert sum(hot in t for t in out.values()) == 1 and hot in out[0]
