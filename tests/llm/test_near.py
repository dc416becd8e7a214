"""Near duplicates: groups larger than a task, exact links, defined cases."""

import random

from cairn.llm import op08_minhash as M
from tests.llm.test_operators import _pairs, table, words

rng = random.Random(61)


def components_of(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return {i: find(i) for i in range(n)}


def test_a_group_larger_than_its_tasks(spark):
    """A hot group of copies that differ in a word or two, and a chain whose ends aren't alike, over tasks of 8 documents."""
    base, chain = words(60).split(), words(60).split()
    texts = []
    for _ in range(70):
        copy = list(base)
        for _ in range(rng.randint(1, 3)):
            copy[rng.randrange(60)] = rng.choice(["one", "two", "three"])
        texts.append(" ".join(copy))
    for k in range(0, 60, 6):
        texts.append(" ".join(words(k).split() + chain[k:]))
    texts += [words(60) for _ in range(20)]
    want = components_of(len(texts), _pairs(texts, M.THRESHOLD))
    for split in (8, 2048):
        found = {r["doc_id"]: (r["group_id"], r["n_docs"]) for r in M.near_duplicate_groups(table(spark, list(enumerate(texts))), split=split).collect()}
        sizes = {g: sum(x == g for x in want.values()) for g in want.values()}
        assert found == {i: (g, sizes[g]) for i, g in want.items() if sizes[g] > 1}


def test_defined_cases(spark):
    same = words(30)
    rows = [(1, same), (1, same), (2, same.upper()), (3, None), (4, ""), (5, "!!! ..."), (None, same), (6, "word"), (7, "word."), (8, words(30)), (8, same), (9, "  ")]
    groups = sorted((r["doc_id"], r["group_id"], r["n_docs"]) for r in M.near_duplicate_groups(table(spark, rows)).collect())
    assert groups == [(1, 1, 3), (2, 1, 3), (6, 6, 2), (7, 6, 2), (8, 1, 3)]
    left = sorted(((r["doc_id"], r["text"]) for r in M.drop_near_duplicates(table(spark, rows)).collect()), key=str)
    other = next(t for i, t in rows if i == 8 and t != same)
    assert left == sorted([(1, same), (3, None), (4, ""), (5, "!!! ..."), (None, same), (6, "word"), (8, other), (9, "  ")], key=str)
    clash = spark.createDataFrame([(1, same, 1, 2, "r"), (2, same, 3, 4, "s"), (3, words(9), 5, 6, "t")], "doc_id long, text string, gone int, id int, __row string")
    assert sorted(tuple(r)[2:] for r in M.drop_near_duplicates(clash).collect()) == [(1, 2, "r"), (5, 6, "t")]
    assert M.near_duplicate_groups(table(spark, [])).count() == 0 and M.drop_near_duplicates(table(spark, [])).count() == 0
