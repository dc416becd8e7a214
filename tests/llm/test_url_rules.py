"""URL rules with the production parameters: planted combinations, labels without signal, SQL, defined cases."""

import random

from cairn.llm import op05_url_rules as U
from tests.llm.oracle import rows_of, rows_of_sql

PAGES, LABELS = "page_id long, url string, tokens string", "doc_id long, quality int, toxic int"


def site(rng, i, bad):
    host = rng.choice(["m", "www", "blog"]) + "." + rng.choice(["casino", "news", "shop", "wiki"] if not bad else ["casino"])
    return f"https://{host}.example.com/{'promo' if bad else rng.choice(['promo', 'en', 'de'])}/{i}{rng.choice(['', '/', '.html', '?page=2&ref=x', '#top'])}"


def fixture(spark, signal, n=2400):
    """casino with promo is bad nine times in ten; one token alone is not. The second half of the documents is held out."""
    rng = random.Random(3)
    pages, truth = [], {}
    for i in range(n):
        url = site(rng, i, i % 8 == 0)
        planted = "casino" in url and "/promo/" in url
        truth[i] = int(not (rng.random() < 0.9)) if signal and planted else int(rng.random() > 0.1)
        pages.append((i + 7, url, "x"))
    pages += [(900, None, None), (901, "no url", "x"), pages[0], pages[0]]
    labels = [(i, q, 0) for i, q in truth.items() if i < n // 2] + [(None, 0, 0), (5, None, 1)]
    return spark.createDataFrame(pages, PAGES), spark.createDataFrame(labels, LABELS), truth


def test_planted_combination_is_found_and_holds_on_held_out_labels(spark):
    pages, labels, truth = fixture(spark, True)
    out = U.url_decisions(pages, labels).collect()
    assert len(out) == pages.count()
    held = [r for r in out if r["dropped"] and int(r["url"].split("/")[4].split("?")[0].split("#")[0].split(".")[0]) >= 1200]
    bad = [r for r in held if truth[int(r["url"].split("/")[4].split("?")[0].split("#")[0].split(".")[0])] == 0]
    print("held-out precision", len(bad), "of", len(held))
    assert len(held) > 100 and len(bad) > 0.8 * len(held)
    assert all("casino" in r["url"] and "/promo/" in r["url"] for r in out if r["dropped"])
    planted = [r for r in out if r["url"] and "casino" in r["url"] and "/promo/" in r["url"]]
    assert all(r["dropped"] for r in planted)


def test_labels_without_signal_drop_nothing(spark):
    pages, labels, _ = fixture(spark, False)
    assert U.url_decisions(pages, labels).filter("dropped").count() == 0
    assert U.url_decisions(pages, labels.limit(0)).filter("dropped").count() == 0
    assert U.url_decisions(pages.limit(0), labels).count() == 0


def test_against_sql(spark):
    for signal in (True, False):
        pages, labels, _ = fixture(spark, signal, 1200)
        found = rows_of(U.url_decisions(pages, labels))
        assert found == rows_of_sql(U.ORACLE_SQL, pages=pages, labels=labels)
        assert any("True" in r for r in found) == signal


def test_a_combination_of_five_tokens_and_ties(spark):
    """No four of a, b, c, d, e are bad; tokens that always go together (www, x, y) are one item."""
    rng = random.Random(5)
    pages, labels = [], []
    for i in range(3000):
        parts = [p for p in "abcde" if rng.random() < 0.7]
        pages.append((i, f"http://www.h.com/x/y/{'/'.join(parts)}/{i}", ""))
        labels.append((i, int(not (len(parts) == 5)), 0))
    pages, labels = spark.createDataFrame(pages, PAGES), spark.createDataFrame(labels, LABELS)
    found = rows_of(U.url_decisions(pages, labels))
    assert sum("'p:a p:b p:c p:d p:e'" in r for r in found) > 400
    assert found == rows_of_sql(U.ORACLE_SQL, pages=pages, labels=labels)
    rules = U.mine(U.transactions(pages, labels)).collect()
    assert [sorted(r["rule"]) for r in rules] == [[f"p:{x}" for x in "abcde"]]
