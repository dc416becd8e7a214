"""The knowledge log's operators over conversations (coord = conversation, channel = role, pos = turn) and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence as E
from ..operators import knowledge as K
from .corpus import table


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn of several lines reaffirms what was said before; each is stamped with its text's digest."""
    ask = F.contains("text", F.lit(".\n")).cast("int")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("coord"), F.col("role").alias("channel"), F.col("turn").alias("pos"), "text", F.substring(F.md5("text"), 1, 16).alias("stamp"), ask.alias("reaffirms"))


def _stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    accepted = log.groupBy("coord").agg(F.array(F.max_by("stamp", "pos"), F.min_by("stamp", "pos"), F.max("stamp")).alias("accepted"))
    return K.with_staleness(log, accepted)


def knowledge_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stale(spark, sf_dir).select("coord", "channel", "pos", "stale", "reaffirmed_pos")


def knowledge_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.for_display(_log(spark, sf_dir)).select("coord", "channel", "pos", F.col("place").cast("long").alias("place"), "superseded")


def knowledge_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.knowledge_lag(K.for_display(_stale(spark, sf_dir)))


def knowledge_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = K.search(K.for_display(_log(spark, sf_dir)), "Er")
    return found.select("coord", "matches", "live", F.array_join("excerpts", "|").alias("excerpts"))


def knowledge_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was said since the third turn; what the system said was written otherwise then."""
    log = _log(spark, sf_dir)
    was = log.filter("pos < 3").withColumn("text", F.when(F.col("channel") == "system", F.upper("text")).otherwise(F.col("text")))
    return K.review(log, was).select("coord", "channel", "pos", "text", "predecessor", "rewritten", "added")


def log_union_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' turns as the local log, all turns as the other one."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", "text")
    return K.union_merge(rows.filter("role = 'user'"), rows, ("conv_id", "role", "turn", "text"))


def trace_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    hops = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("trace_id"), F.col("turn").alias("seq"), F.col("role").alias("coord"), F.col("text").alias("note"))
    return K.trace_rows(hops).select("trace_id", "seq", "coord", "channel", "text", F.array_join("full_path", ">").alias("full_path"))


def evidence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each type, user and property stays."""
    rows = table(spark, sf_dir, "events").select("event_type", "user_id", "props", "ts", "event_id", "value")
    return E.last_wins(rows, ["event_type", "user_id", "props"], ["ts", "event_id"]).select("event_type", "user_id", "props", "event_id", "value")


def evidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), "ts", F.col("event_id").alias("id"))
    return E.summarise(rows, "source", [F.col("ts").desc(), F.col("id").desc()], F.col("id").cast("string")).select("source", "n", F.array_join("top", ",").alias("top"))


def provenance_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders, newest first; those before its first urgent one are history of the region only."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", (F.col("o_orderpriority") == "1-URGENT").alias("boundary"))
    return E.provenance(orders, "o_custkey", [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], "boundary").select("o_orderkey", "label")


def byte_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations within 4000 bytes: the oldest turns go."""
    rows = table(spark, sf_dir, "conversations")
    return E.byte_cap(rows, "conv_id", [F.col("turn").desc()], F.octet_length("text"), 4000).select("conv_id", "turn", "n_kept", "n_dropped")


QUERIES = {f.__name__: f for f in (knowledge_staleness, knowledge_display, knowledge_lag, knowledge_search, knowledge_review, log_union_merge, trace_rows, evidence_merge, evidence_summary, provenance_labels, byte_budget)}

_LOG = """l AS (SELECT conv_id AS coord, role AS channel, turn AS pos, text, substr(md5(text), 1, 16) AS stamp, contains(text, '.' || chr(10)) AS ask FROM conversations),
a AS (SELECT coord, [arg_max(stamp, pos), arg_min(stamp, pos), max(stamp)] AS ok FROM l GROUP BY coord),
m AS (SELECT l.*, NOT list_contains(ok, stamp) AS moved FROM l JOIN a USING (coord)),
v AS (SELECT *, max(CASE WHEN ask AND NOT moved THEN pos END) OVER (PARTITION BY coord, channel) AS v FROM m),
s AS (SELECT *, moved AND NOT coalesce(pos < v, false) AS stale FROM v),
d AS (SELECT *, row_number() OVER (PARTITION BY coord, channel ORDER BY pos DESC) AS place FROM s WHERE NOT ask)"""
_FLAT = r"trim(regexp_replace(text, '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))"

SQL = {
    "knowledge_staleness": f"WITH {_LOG} SELECT coord, channel, pos, stale, CASE WHEN pos < v AND NOT ask THEN v END AS reaffirmed_pos FROM s",
    "knowledge_display": f"WITH {_LOG} SELECT coord, channel, pos, place, place > 1 AS superseded FROM d",
    "knowledge_lag": f"WITH {_LOG} SELECT coord, count(*) AS n_stale FROM d WHERE stale AND place = 1 GROUP BY coord",
    "knowledge_search": f"""WITH {_LOG},
h AS (SELECT *, {_FLAT} AS f, row_number() OVER (PARTITION BY coord ORDER BY channel, place) AS hit FROM d WHERE contains(lower(text), 'er')),
x AS (SELECT *, greatest(1, position('er' IN lower(f)) - 80) AS b FROM h),
y AS (SELECT *, CASE WHEN b > 1 THEN '…' ELSE '' END || substr(f, b, 160) || CASE WHEN b + 159 < length(f) THEN '…' ELSE '' END AS e FROM x)
SELECT coord, count(*) AS matches, count(*) FILTER (WHERE place = 1) AS live, string_agg(e, '|' ORDER BY hit) FILTER (WHERE hit <= 3) AS excerpts FROM y GROUP BY coord""",
    "knowledge_review": """WITH r AS (SELECT conv_id AS coord, role AS channel, turn AS pos, text, lag(text) OVER (PARTITION BY conv_id, role ORDER BY turn) AS predecessor, turn < 3 AND role = 'system' AND upper(text) <> text AS broken FROM conversations)
SELECT coord, channel, pos, text, predecessor, rewritten, pos >= 3 AS added FROM (SELECT *, bool_or(broken) OVER (PARTITION BY coord, channel) AS rewritten FROM r) WHERE pos >= 3 OR broken""",
    "log_union_merge": "SELECT conv_id, role, turn, text, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS origin FROM (SELECT DISTINCT conv_id, role, turn, text FROM conversations)",
    "trace_rows": """WITH p AS (SELECT conv_id, string_agg(role, '>' ORDER BY turn, role) AS full_path FROM conversations GROUP BY conv_id)
SELECT conv_id AS trace_id, turn AS seq, role AS coord, 'traces' AS channel, text, full_path FROM conversations JOIN p USING (conv_id)""",
    "evidence_merge": "SELECT event_type, user_id, props, max({'t': ts, 'i': event_id, 'v': value}).i AS event_id, max({'t': ts, 'i': event_id, 'v': value}).v AS value FROM events GROUP BY event_type, user_id, props",
    "evidence_summary": """WITH r AS (SELECT event_type AS source, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT source, count(*) AS n, string_agg(event_id::VARCHAR, ',' ORDER BY k) FILTER (WHERE k <= 5) AS top FROM r GROUP BY source""",
    "provenance_labels": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders),
z AS (SELECT *, max(CASE WHEN o_orderpriority = '1-URGENT' THEN k END) OVER (PARTITION BY o_custkey) AS b FROM r)
SELECT o_orderkey, CASE WHEN b IS NULL OR k <= b THEN 'entity-history' ELSE 'region-history' END AS label FROM z""",
    "byte_budget": """WITH r AS (SELECT *, sum(octet_length(encode(text))) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
k AS (SELECT *, count(*) FILTER (WHERE used <= 4000) OVER (PARTITION BY conv_id) AS n_kept FROM r) SELECT conv_id, turn, n_kept, n - n_kept AS n_dropped FROM k WHERE used <= 4000""",
}
