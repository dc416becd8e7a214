"""The skip-chain field against enumeration and the full chain, on held-out documents and shapes, and its defined cases."""

import random
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from cairn.llm import op01_pii as P
from tests.llm.test_operators import VOCAB, table

rng = random.Random(31)
NAMES = ["Ortega", "Lindqvist", "Baumann", "Okafor", "Moreau", "Tanaka", "Silva", "Novak", "Haddad", "Kovacs", "Brandt", "Eriksen"]


def prose(n, local=rng):
    """Sentences of small words, each beginning with a capital."""
    out = []
    while len(out) < n:
        k = min(local.randint(4, 9), n - len(out))
        words = [local.choice(VOCAB) for _ in range(k)]
        out += [words[0].capitalize(), *words[1:-1], words[-1] + "."] if k > 1 else [words[0].capitalize() + "."]
    return " ".join(out)


def enumerate_marginals(emit, chain, skip, pair, agree):
    n, labels = emit.shape
    p = np.zeros((n, labels))
    for y in product(range(labels), repeat=n):
        s = np.exp(emit[range(n), y].sum() + sum(pair[y[a], y[b]] for a, b in chain) + sum(agree * (y[a] == y[b]) for a, b in skip))
        for i in range(n):
            p[i, y[i]] += s
    return p / p.sum(axis=1, keepdims=True)


def test_loopy_against_enumeration_on_short_loopy_documents():
    r = np.random.default_rng(9)
    agreed = 0
    for _ in range(40):
        emit, pair = r.normal(size=(6, 3)) * 2, r.normal(size=(3, 3)) * 0.5
        chain, skip = np.array([[i, i + 1] for i in range(5)]), np.array([[0, 3], [3, 5], [1, 4]])
        found, true = P.loopy(emit, chain, skip, pair, 0.7, rounds=300), enumerate_marginals(emit, chain, skip, pair, 0.7)
        assert np.abs(found - true).max() < 0.15
        agreed += (found.argmax(axis=1) == true.argmax(axis=1)).sum()
    assert agreed >= 0.97 * 240


def test_a_document_settles_by_itself():
    r = np.random.default_rng(10)
    parts = [(r.normal(size=(5, 3)) * k, np.array([[i, i + 1] for i in range(4)]), np.array([[0, 3]])) for k in (0.1, 3, 1)]
    pair = r.normal(size=(3, 3))
    alone = [P.loopy(e, c, s, pair, 1.0) for e, c, s in parts]
    shift = lambda k: np.concatenate([p[k] + 5 * i for i, p in enumerate(parts)])
    both = P.loopy(np.concatenate([p[0] for p in parts]), shift(1), shift(2), pair, 1.0, owner=np.repeat([0, 1, 2], 5))
    assert np.array_equal(both, np.concatenate(alone))


@pytest.fixture(scope="module")
def model():
    local, texts = random.Random(1), []
    for i in range(500):
        secret = [[f"user{i}@mail{i % 9}.example.com", f"{local.choice(VOCAB)}.{local.choice(VOCAB)}@{local.choice(VOCAB)}.net", f"{local.choice(VOCAB)}@{local.choice(VOCAB)}.example.org"][i % 3], f"+1 (202) 555-{1000 + i}", f"10.0.{i % 250}.{i % 200 + 1}", f"{local.choice(['Dr.', 'Mrs.', 'Prof.'])} {local.choice(NAMES)}", "ghp_" + "".join(local.choice("abcdefXYZ") for _ in range(24))][i % 5]
        after = local.choice([prose(20, local), f"{local.choice(VOCAB)} {local.choice(VOCAB)}. {prose(20, local)}"])
        texts.append(f"{prose(30, local)} {prose(5, local)[:-1]} {secret} {after}" if i % 2 else prose(50, local))
    return P.train(texts)


def spans_of(model, text, eps=P.EPS):
    return [(e["label"], text[e["start"] : e["end"]]) for e in P.entities(pa.array([text]), model, eps)[0]]


def test_active_tokens_give_what_the_full_chain_gives(model):
    texts = [prose(60) + f" mail a{i}@b{i}.example.org or call +1 (202) 555-{2000 + i}, ask Dr. Varga. " + prose(30) + " with Varga now" for i in range(8)]
    column = pa.array(texts)
    tokens = P.Tokens(column)
    ids, some = P.infer(tokens, model)
    every, full = P.infer(tokens, model, 0.0)
    assert len(every) == len(tokens) and len(ids) < len(tokens)
    held = np.zeros_like(full)
    held[:, 0] = 1
    held[ids] = some
    assert np.abs(held - full).max() < 5e-3
    assert P.entities(column, model) == P.entities(column, model, 0.0)


def test_shapes_that_no_pattern_knows(model):
    """Hosts beyond ASCII, keys of letters only with another beginning, and numbers in other groups of digits."""
    host = "write to jo.mueller@bücher.example today"
    assert not P.strict_spans(host) and spans_of(model, host) == [("EMAIL", "jo.mueller@bücher.example")]
    key = "the key ghp_" + "abcXYZdefabc" + "é" + " is out"
    assert not any(k == "SECRET" and e - s > 20 for s, e, k in P.strict_spans(key))


def test_a_name_is_tied_to_where_it_was_introduced(model):
    """A name that no training document holds: introduced once, then bare; the bare one is private by its tie alone."""
    filler = prose(12)
    bare = f"{filler} they met with Zelenko again and left"
    tied = f"{prose(10)} it was Dr. Zelenko who came. {bare}"
    without = spans_of(model, bare)
    with_ = spans_of(model, tied)
    assert ("NAME", "Zelenko") in with_
    assert with_.count(("NAME", "Zelenko")) >= without.count(("NAME", "Zelenko")) + 1
    tokens = P.Tokens(pa.array([tied]))
    names = [k for k in range(len(tokens)) if tokens.text(k).startswith("Zelenko")]
    assert [names[0], names[1]] in tokens.skip.tolist()
    untied = dict(model, agree=0.0)
    ids, p = P.infer(tokens, model, 0.0)
    _, q = P.infer(tokens, untied, 0.0)
    assert p[names[1], P.LABELS.index("NAME")] > q[names[1], P.LABELS.index("NAME")]


def test_plain_prose_is_left_alone(model):
    for _ in range(40):
        text = prose(200)
        assert spans_of(model, text) == []


def test_held_out_documents_with_names_and_keys(spark):
    local, rows, true = random.Random(4), [], set()
    for i in range(400):
        extra = [f"Mrs. {local.choice(NAMES)}", f"user{i}@mail.example.com", "sk_" + "".join(local.choice("abcdefghKLMNOP") for _ in range(20)), ""][i % 4]
        rows.append((i, f"{prose(14, local)} {extra} {prose(10, local)}"))
        if extra:
            true.add(i)
    found = {r["doc_id"]: r["entities"] for r in P.private_documents(table(spark, rows), size=200).collect()}
    assert len(set(found) & true) >= 0.97 * len(true) and not set(found) - true
    text = dict(rows)
    assert all(text[i][e["start"] : e["end"]] for i, es in found.items() for e in es)


def test_defined_cases(spark):
    long_ = prose(30_000) + " mail me@here.example.com"
    rows = [(1, None), (2, ""), (None, "write me@here.example.com"), (3, long_), (4, "   \n\n "), (5, "me@here.example.com"), (5, "me@here.example.com"), (6, "ü me@here.example.com é"), *[(10 + i, f"{prose(6)} mail m{i}@x.example.com") for i in range(30)]]
    out = [r for r in P.private_documents(table(spark, rows)).collect() if r["doc_id"] is None or r["doc_id"] < 10]
    assert sorted(str(r["doc_id"]) for r in out) == ["3", "5", "5", "6", "None"]
    at = {r["doc_id"]: [(e["label"], e["start"], e["end"]) for e in r["entities"]] for r in out}
    assert at[5] == [("EMAIL", 0, 19)] and at[6] == [("EMAIL", 2, 21)] and at[3] == [("EMAIL", len(long_) - 19, len(long_))]
    assert P.private_documents(table(spark, [])).count() == 0
    assert P.private_documents(table(spark, [(1, None), (2, "a b")])).count() == 0
