"""URL filter by association rules.

A URL becomes a set of tokens: scheme, host labels, path parts (digits masked), query keys and
fragment. A page shows the document whose id is the last number of its URL's path; pages of labelled
documents are transactions, and those of quality 0 carry BAD besides. Tokens that occur in exactly
the same transactions are one item, so that long URLs of one template don't multiply the sets.
FP-growth mines the item sets, of any size, of MIN_SHARE of the transactions and MIN_COUNT of them
at least, with and without BAD. A set is a rule if

- its confidence (share of BAD among the transactions that hold it) is MIN_CONFIDENCE at least;
- chance is ruled out: n * KL(confidence | share of BAD overall) is the logarithm of the number of
  sets tested plus MARGIN at least (Chernoff's bound over all tests: a set without any connection to
  BAD passes with a probability of exp(-MARGIN) in the whole run);
- no smaller set within it is as confident.

Rules are filed under their rarest token (ties: the first in byte order); a page looks up its tokens
there and is dropped if it holds all tokens of some rule. Labels that URLs say nothing about give no
rules, and nothing is dropped.

Defined cases. A null URL has no tokens and is kept, as is a URL without a scheme; repeated rows are
decided row by row, and each counts as a transaction if labelled; a document labelled twice counts
by its lowest quality; null labels are ignored. Without transactions or BAD ones there are no rules.
Of equally confident rules of a page the shortest, then the first in byte order, is named. Other
columns of pages and labels are ignored; empty tables give empty results.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import stable, table

MIN_SHARE, MIN_COUNT, MIN_CONFIDENCE, MARGIN = 0.002, 8, 0.8, 3.0
BAD = "\x01bad"
#: Between the tokens of one item.
AND = "\x02"
BROADCAST_RULES = 100_000

_SCHEME = "^([a-z][a-z0-9+.-]*)://"
_HOST = "^[a-z][a-z0-9+.-]*://([^/?#]*)"
_PATH = "^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)"
_QUERY = "^[a-z][a-z0-9+.-]*://[^?#]*[?]([^#]*)"
_DOCUMENT = "/([0-9]{1,18})[^0-9/]*/?$"
_FRAGMENT = "^[a-z][a-z0-9+.-]*://[^#]*#(.*)$"


def tokens(url):
    """Sorted distinct tokens of a URL column; empty for null and for what isn't a URL."""
    u = F.lower(F.coalesce(url.cast("string"), F.lit("")))
    part = lambda pattern: F.regexp_extract(u, pattern, 1)
    named = lambda prefix, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(prefix), x))
    path = F.transform(F.split(part(_PATH), "/"), lambda x: F.regexp_replace(x, "[0-9]+", "0"))
    keys = F.transform(F.split(part(_QUERY), "&"), lambda x: F.regexp_replace(x, "=.*$", ""))
    groups = [named("s:", F.array(part(_SCHEME))), named("h:", F.split(part(_HOST), "[.]")), named("p:", path), named("q:", keys), named("f:", F.array(part(_FRAGMENT)))]
    return F.array_sort(F.array_distinct(F.concat(*groups)))


def document_of(url):
    """The id of the document that a page shows: the last number of its URL's path."""
    path = F.regexp_extract(F.lower(F.coalesce(url.cast("string"), F.lit(""))), _PATH, 1)
    return F.nullif(F.regexp_extract(path, _DOCUMENT, 1), F.lit("")).try_cast("long")


def transactions(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """tokens and bad of each page of a labelled document."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("quality"))
    rows = pages.select(document_of(F.col("url")).alias("id"), tokens(F.col("url")).alias("tokens")).filter(F.size("tokens") > 0)
    return rows.join(known, "id").select("tokens", (F.col("quality") <= 0).alias("bad"))


def as_items(rows: DataFrame, least: int) -> DataFrame:
    """items of each transaction: its tokens of `least` transactions and more, those that always go together as one.

    A token's transactions are told by their number and two sums of hashes. At most (tokens of a URL)
    * (transactions) / least tokens are so frequent, however many transactions there are.
    """
    rows = rows.withColumn("t", F.monotonically_increasing_id())
    sums = [F.sum(F.pmod(F.xxhash64("t", F.lit(k)), F.lit(1 << 31)).cast("decimal(20,0)")).alias(f"k{k}") for k in (1, 2)]
    token = rows.select("t", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), *sums).filter(F.col("n") >= least)
    item = token.groupBy("n", "k1", "k2").agg(F.array_sort(F.collect_list("token")).alias("all"))
    item = stable(item.select(F.explode("all").alias("token"), F.array_join("all", AND).alias("item")))
    side = F.broadcast(item) if item.count() <= BROADCAST_RULES else item
    found = rows.select("t", "bad", F.explode("tokens").alias("token")).join(side, "token").groupBy("t").agg(F.collect_set("item").alias("items"), F.first("bad").alias("bad"))
    return found.select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items"))


def mine(rows: DataFrame, share: float = MIN_SHARE, count: int = MIN_COUNT, confidence: float = MIN_CONFIDENCE, margin: float = MARGIN) -> DataFrame:
    """(rule, n_tokens, n, n_bad, confidence, key) of the rules that pruning leaves, from transactions (tokens, bad)."""
    spark = rows.sparkSession
    # Stored: a transaction's number must stay its own.
    rows = stable(rows)
    total, bad = rows.agg(F.count("*"), F.count_if("bad")).first()
    shape = "rule array<string>, n_tokens int, n long, n_bad long, confidence double, key string"
    least = ceil(max(share * total, count))
    if not bad or least > total:
        return spark.createDataFrame([], shape)
    base = bad / total
    items = stable(as_items(rows, least))
    # Half a transaction less: the support is a share, and its product must not be rounded up past `least`.
    sets = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / max(items.count(), 1), minConfidence=1.0).fit(items).freqItemsets
    plain = F.array_sort(F.flatten(F.transform(F.array_remove("items", BAD), lambda x: F.split(x, AND))))
    sets = stable(sets.filter(F.size(F.array_remove("items", BAD)) > 0).select(plain.alias("rule"), F.array_contains("items", BAD).alias("with_bad"), F.col("freq").alias("n")))
    both = stable(sets.filter("not with_bad").select("rule", "n").join(sets.filter("with_bad").select("rule", F.col("n").alias("n_bad")), "rule"))
    tests = both.count()
    c = F.col("confidence")
    kl = F.when(c >= 1, F.lit(log(1 / base))).otherwise(c * F.log(c / base) + (1 - c) * F.log((1 - c) / (1 - base if base < 1 else 1e-300)))
    found = both.withColumn("confidence", F.col("n_bad") / F.col("n")).filter((c >= confidence) & (c > base) & (F.col("n") * kl >= log(max(tests, 1)) + margin))
    found = stable(found.withColumn("n_tokens", F.size("rule")))
    small = found.select(F.col("rule").alias("less"), F.col("n_tokens").alias("n_less"), c.alias("c_less"), F.col("rule")[0].alias("first"))
    wide = found.withColumn("first", F.explode("rule"))
    covered = wide.join(small, "first").filter((F.col("n_less") < F.col("n_tokens")) & (F.col("c_less") >= c) & (F.size(F.array_intersect("less", "rule")) == F.col("n_less")))
    kept = found.join(covered.select("rule").distinct(), "rule", "left_anti")
    # How often a token occurs is the most that a mined set with it does: that of its own item.
    single = sets.filter("not with_bad").select(F.explode("rule").alias("token"), "n").groupBy("token").agg(F.max("n").alias("f"))
    key = kept.select("rule", F.explode("rule").alias("token")).join(single, "token").groupBy("rule").agg(F.min(F.struct("f", "token")).alias("k"))
    return kept.join(key, "rule").select("rule", "n_tokens", "n", "n_bad", "confidence", F.col("k.token").alias("key"))


def decide(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, url, n_rules, confidence and rule (the best one, or null) and dropped of every page."""
    rules = stable(rules.select("key", "rule", "n_tokens", "confidence"))
    side = F.broadcast(rules) if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES else rules
    urls = pages.select(F.col("url").cast("string").alias("u")).filter("u is not null").distinct().withColumn("tokens", tokens(F.col("u")))
    hits = urls.withColumn("key", F.explode("tokens")).join(side, "key").filter(F.size(F.array_intersect("rule", "tokens")) == F.col("n_tokens"))
    best = hits.groupBy("u").agg(F.count("*").alias("n_rules"), F.min(F.struct((-F.col("confidence")).alias("c"), F.col("n_tokens").alias("t"), F.array_join("rule", " ").alias("rule"))).alias("b"))
    joined = pages.select("page_id", F.col("url").cast("string").alias("url")).join(best, F.col("url") == F.col("u"), "left")
    return joined.select("page_id", "url", F.coalesce("n_rules", F.lit(0)).cast("long").alias("n_rules"), (-F.col("b.c")).alias("confidence"), F.col("b.rule").alias("rule"), F.col("u").isNotNull().alias("dropped"))


def url_decisions(pages: DataFrame, labels: DataFrame, **how) -> DataFrame:
    return decide(pages, mine(transactions(pages, labels), **how))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_decisions(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def _sql_tokens() -> str:
    part = lambda p: f"regexp_extract(u, '{p}', 1)"
    named = lambda prefix, parts: f"list_transform(list_filter({parts}, lambda x: x <> ''), lambda x: '{prefix}' || x)"
    path = f"list_transform(string_split({part(_PATH)}, '/'), lambda x: regexp_replace(x, '[0-9]+', '0', 'g'))"
    keys = f"list_transform(string_split({part(_QUERY)}, '&'), lambda x: regexp_replace(x, '=.*$', ''))"
    groups = [named("s:", f"[{part(_SCHEME)}]"), named("h:", f"string_split({part(_HOST)}, '.')"), named("p:", path), named("q:", keys), named("f:", f"[{part(_FRAGMENT)}]")]
    return "list_sort(list_distinct(" + " || ".join(groups) + "))"


ORACLE_SQL = f"""
WITH base AS (SELECT row_number() OVER () AS r, page_id, url, lower(coalesce(url, '')) AS u FROM pages),
toks AS (SELECT r, page_id, url, {_sql_tokens()} AS t, try_cast(regexp_extract(regexp_extract(u, '{_PATH}', 1), '{_DOCUMENT}', 1) AS BIGINT) AS id FROM base),
known AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
trans AS (SELECT r, t, quality <= 0 AS bad FROM toks JOIN known ON id = doc_id WHERE len(t) > 0),
tot AS (SELECT count(*) AS n, count(*) FILTER (WHERE bad) AS b, count(*) FILTER (WHERE bad)::DOUBLE / count(*)::DOUBLE AS p, greatest(ceil({MIN_SHARE}::DOUBLE * count(*)::DOUBLE), {MIN_COUNT}) AS least FROM trans),
one AS (SELECT r, bad, unnest(t) AS a FROM trans),
tids AS (SELECT a, list(r ORDER BY r) AS rs FROM one GROUP BY a),
item AS (SELECT a, min(a) OVER (PARTITION BY rs) AS rep FROM tids, tot WHERE len(rs) >= least),
class AS (SELECT rep, list(a ORDER BY a) AS members FROM item GROUP BY rep),
its AS (SELECT r, any_value(bad) AS bad, list(DISTINCT rep ORDER BY rep) AS i FROM one JOIN item USING (a) GROUP BY r),
sets AS (SELECT bad, list_transform(list_filter(range(len(i)), lambda k: (m >> k) & 1 = 1), lambda k: i[k + 1]) AS s FROM (SELECT bad, i, unnest(range(1, (1::BIGINT << len(i))::BIGINT)) AS m FROM its)),
counts AS (SELECT s, count(*) AS n, count(*) FILTER (WHERE bad) AS n_bad FROM sets GROUP BY s),
both_ AS (SELECT row_number() OVER () AS k, s, counts.n AS n, n_bad, n_bad::DOUBLE / counts.n::DOUBLE AS c FROM counts, tot WHERE n_bad >= least),
sure AS (
  SELECT k, s, both_.n AS n, c FROM both_, tot
  WHERE c >= {MIN_CONFIDENCE}::DOUBLE AND c > p
    AND both_.n * (c * ln(c / p) + CASE WHEN c < 1 THEN (1 - c) * ln((1 - c) / (1 - p)) ELSE 0 END) >= ln((SELECT count(*) FROM both_)::DOUBLE) + {MARGIN}::DOUBLE),
found AS (SELECT k, any_value(c) AS c, list(m ORDER BY m) AS rule FROM (SELECT k, c, unnest(members) AS m FROM (SELECT k, c, unnest(s) AS rep FROM sure) JOIN class USING (rep)) GROUP BY k),
kept AS (
  SELECT * FROM found f WHERE NOT EXISTS (
    SELECT 1 FROM found g WHERE len(g.rule) < len(f.rule) AND g.c >= f.c AND list_has_all(f.rule, g.rule))),
hits AS (SELECT r, count(*) AS n_rules, min({{'c': -c, 't': len(rule), 'rule': array_to_string(rule, ' ')}}) AS b
         FROM toks JOIN kept ON list_has_all(t, rule) GROUP BY r)
SELECT page_id, url, coalesce(n_rules, 0)::BIGINT AS n_rules, -(b.c) AS confidence, b.rule AS rule, n_rules IS NOT NULL AS dropped
FROM toks LEFT JOIN hits USING (r)"""
