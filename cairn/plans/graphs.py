"""Graph, metric and interval operators over the star schema: orders use parts, parts their suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph, interval, metrics, rank
from .corpus import near_pairs, table


def _name(prefix: str, key: str):
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders call parts, parts call suppliers, suppliers import nations, nations import regions."""
    line, supplier, nation = (table(spark, sf_dir, n) for n in ("lineitem", "supplier", "nation"))
    edge = lambda df, src, dst, kind, confidence: df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), confidence.cast("double").alias("confidence"))
    out = edge(line, _name("O", "l_orderkey"), _name("P", "l_partkey"), "calls", 1 - F.col("l_discount"))
    out = out.unionByName(edge(line, _name("P", "l_partkey"), _name("S", "l_suppkey"), "calls", 1 - F.col("l_tax")))
    out = out.unionByName(edge(supplier, _name("S", "s_suppkey"), _name("N", "s_nationkey"), "imports", F.lit(1.0)))
    return out.unionByName(edge(nation, _name("N", "n_nationkey"), _name("R", "n_regionkey"), "imports", F.lit(1.0)))


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    coord = _name("R", "r_regionkey")
    return table(spark, sf_dir, "region").select(coord.alias("seed"), coord.alias("coord"))


def blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, seeds = _edges(spark, sf_dir), _regions(spark, sf_dir)
    return graph.radius(graph.blast_radius(seeds, edges), edges, seeds)


def change_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each region's change reaches, with suppliers' nations as enclosing functions."""
    closures = table(spark, sf_dir, "supplier").select(_name("S", "s_suppkey").alias("child"), _name("N", "s_nationkey").alias("parent"))
    reached = graph.change_impact(_regions(spark, sf_dir), _edges(spark, sf_dir), closures)
    return reached.groupBy("seed", "depth").agg(F.count("*").alias("n"))


def confidence_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.confidence_reach(_regions(spark, sf_dir), _edges(spark, sf_dir))


def centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.centrality(_edges(spark, sf_dir).select("src", "dst"))


def event_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases emit and views consume the event of their property."""
    kind = F.when(F.col("event_type") == "purchase", "emits").when(F.col("event_type") == "view", "consumes")
    edges = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("src"), F.concat(F.lit("EVT:"), F.get_json_object("props", "$.k")).alias("dst"), kind.alias("kind"))
    return graph.event_sides(edges)


def fan_in_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers in debt count as tests."""
    edges = table(spark, sf_dir, "lineitem").select(_name("S", "l_suppkey").alias("src"), _name("P", "l_partkey").alias("dst"), F.lit("calls").alias("kind"))
    return metrics.fan(edges, table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(_name("S", "s_suppkey").alias("coord")))


def most_depended_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five parts that most orders use."""
    edges = _edges(spark, sf_dir).filter(F.startswith("src", F.lit("O")))
    found = metrics.most_depended_on(edges, 0.95)
    return rank.rank_bound_report(found, "parts", [F.col("callers").desc(), F.col("coord")], cap=5).select("coord", "callers", "guessed", "rank", "parts_total", "parts_shown")


def grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").select(_name("O", "l_orderkey").alias("src"), _name("P", "l_partkey").alias("dst"), F.lit("calls").alias("kind"), F.col("l_discount").alias("confidence"), F.col("l_returnflag").alias("resolution"))
    return metrics.grounding(edges, table(spark, sf_dir, "part").filter("p_size < 10").select(_name("P", "p_partkey").alias("coord")), 0.05)


def hierarchy_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [("orders", "O", "o_orderkey", "C", "o_custkey"), ("customer", "C", "c_custkey", "N", "c_nationkey"), ("nation", "N", "n_nationkey", "R", "n_regionkey")]
    out = None
    for name, a, key, b, parent in pairs:
        rows = table(spark, sf_dir, name).select(_name(a, key).alias("node"), _name(b, parent).alias("parent"))
        out = rows if out is None else out.unionByName(rows)
    return graph.ancestors(out)


def supersession_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as versions, each replaced by the next one."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    then = turns.select("conv_id", (F.col("turn") - 1).alias("turn"))
    pairs = turns.join(then, ["conv_id", "turn"])
    at = lambda n: F.concat_ws(":", F.col("conv_id").cast("string"), n.cast("string"))
    return graph.chase(pairs.select(at(F.col("turn")).alias("old"), at(F.col("turn") + 1).alias("new"), F.col("turn").alias("seq")))


def parent_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    return metrics.parent_rollup(orders, "o_custkey", "price").select("o_custkey", F.col("agg_value").cast("double").alias("agg_value"), "n_children")


def midrank_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return metrics.midrank_percentile(orders, "o_totalprice", ("o_orderpriority",)).select("o_orderkey", "o_orderpriority", "percentile")


def _spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return events, events.groupBy("user_id", "event_type").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))


def innermost_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest of a user's activity spans around each event."""
    events, spans = _spans(spark, sf_dir)
    return interval.innermost(events.select("event_id", "user_id", "at"), spans, "user_id", "at", "lo", "hi", "event_type").select("event_id", F.col("inner").alias("span"), "n_around")


def enclosing_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, spans = _spans(spark, sf_dir)
    return interval.enclosing(events, spans, "user_id", "at", "lo", "hi", "event_type").select("user_id", "at", F.array_join("chain", ">").alias("chain"))


def churn_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, spans = _spans(spark, sf_dir)
    spans = spans.select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("coord"), F.col("user_id").alias("path"), "lo", "hi")
    return metrics.churn(spans, events.select(F.col("user_id").alias("path"), F.col("at").alias("line"), F.col("props").alias("commit")))


def history_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    line = F.concat_ws(" ", F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderpriority")
    return metrics.history_summary(orders, "o_custkey", [F.col("o_orderdate").desc(), F.col("o_orderkey")], line)


def flow_vs_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of supplier and part that were returned (observed) against those that weren't (the map)."""
    line = table(spark, sf_dir, "lineitem").select(_name("S", "l_suppkey").alias("src"), _name("P", "l_partkey").alias("dst"), "l_returnflag")
    return graph.flow_vs_map(line.filter("l_returnflag = 'R'"), line.filter("l_returnflag <> 'R'"))


def tree_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws(" ", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(T.tree_hash(F.collect_list(line)).alias("tree_hash"))


def hardest_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three dearest parts of each brand."""
    part = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice")
    return rank.rank_bound_report(part, "parts", [F.col("p_retailprice").desc(), F.col("p_partkey")], ["p_brand"], 3)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents as a graph; what a change of the most connected one reaches, bounded."""
    pairs = graph.stored(near_pairs(spark, sf_dir))
    both = pairs.select(F.col("a").cast("string").alias("src"), F.col("b").cast("string").alias("dst")).unionByName(pairs.select(F.col("b").cast("string").alias("src"), F.col("a").cast("string").alias("dst")))
    edges = graph.stored(both.withColumn("kind", F.lit("calls")))
    top = edges.groupBy(F.col("dst").alias("coord")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("coord").cast("long")).limit(1)
    reached = graph.blast_radius(top.select(F.col("coord").alias("seed"), "coord"), edges)
    return rank.rank_bound_report(reached, "affected", [F.col("depth"), F.col("coord").cast("long")])


QUERIES = {f.__name__: f for f in (blast_radius, change_impact, confidence_reach, centrality, event_pairs, fan_in_out, most_depended_on, grounding, hierarchy_closure, supersession_chain, parent_rollup, midrank_percentile, innermost_spans, enclosing_spans, churn_span, history_summary, flow_vs_map, tree_hash, hardest_parts)}

_LEVELS = """
e1 AS (SELECT DISTINCT 'R' || n_regionkey AS seed, 'N' || n_nationkey AS coord, n_nationkey FROM nation),
e2 AS (SELECT DISTINCT seed, 'S' || s_suppkey AS coord, s_suppkey FROM e1 JOIN supplier ON s_nationkey = n_nationkey),
e3 AS (SELECT DISTINCT seed, 'P' || l_partkey AS coord, l_partkey FROM e2 JOIN lineitem ON l_suppkey = s_suppkey),
e4 AS (SELECT DISTINCT seed, 'O' || l.l_orderkey AS coord FROM e3 JOIN lineitem l ON l.l_partkey = e3.l_partkey),
d AS (SELECT seed, 1 AS depth, count(*) AS n FROM e1 GROUP BY seed UNION ALL SELECT seed, 2, count(*) FROM e2 GROUP BY seed
      UNION ALL SELECT seed, 3, count(*) FROM e3 GROUP BY seed UNION ALL SELECT seed, 4, count(*) FROM e4 GROUP BY seed)"""
_EV = 'ev AS (SELECT event_id, user_id, event_type, props, epoch_us(ts) AS "at" FROM events), sp AS (SELECT user_id, event_type, min("at") AS lo, max("at") AS hi FROM ev GROUP BY ALL)'

SQL = {
    "blast_radius": f"WITH {_LEVELS} SELECT 'R' || r_regionkey AS seed, coalesce(round(sum(n * power(0.5::DOUBLE, depth - 1)), 2), 0)::DOUBLE AS radius, coalesce(sum(n), 0)::BIGINT AS n_affected, false AS radius_is_lower_bound FROM region LEFT JOIN d ON seed = 'R' || r_regionkey GROUP BY r_regionkey",
    "change_impact": f"WITH {_LEVELS} SELECT seed, depth, n FROM d",
    "confidence_reach": """WITH l AS (SELECT l_orderkey, l_partkey, l_suppkey, 1 - l_tax AS t, 1 - l_discount AS u FROM lineitem),
e1 AS (SELECT 'R' || n_regionkey AS seed, n_nationkey FROM nation),
e2 AS (SELECT seed, s_suppkey FROM e1 JOIN supplier ON s_nationkey = n_nationkey),
e3 AS (SELECT seed, l_partkey, max(1.0::DOUBLE * t) AS c FROM e2 JOIN l ON l_suppkey = s_suppkey GROUP BY ALL),
e4 AS (SELECT seed, l_orderkey, max(c * u) AS c FROM e3 JOIN l USING (l_partkey) GROUP BY ALL)
SELECT seed, 'N' || n_nationkey AS coord, 1.0::DOUBLE AS confidence, 1 AS depth FROM e1 UNION ALL SELECT seed, 'S' || s_suppkey, 1.0, 2 FROM e2
UNION ALL SELECT seed, 'P' || l_partkey, c, 3 FROM e3 UNION ALL SELECT seed, 'O' || l_orderkey, c, 4 FROM e4""",
    "event_pairs": """SELECT DISTINCT 'EVT:' || json_extract_string(props, '$.k') AS event, CASE event_type WHEN 'purchase' THEN 'emits' ELSE 'consumes' END AS side, user_id::VARCHAR AS coord FROM events WHERE event_type IN ('purchase', 'view')""",
    "fan_in_out": """WITH o AS (SELECT 'S' || l_suppkey AS c, count(*) AS n FROM lineitem GROUP BY 1),
i AS (SELECT 'P' || l_partkey AS c, count(*) AS n FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY 1)
SELECT coalesce(o.c, i.c) AS coord, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out FROM o FULL JOIN i ON o.c = i.c""",
    "most_depended_on": """WITH c AS (SELECT 'P' || l_partkey AS coord, count(*) AS callers, count(*) FILTER (WHERE 1 - l_discount < 0.95::DOUBLE) AS guessed FROM lineitem GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY callers DESC, coord)::INTEGER AS rank, count(*) OVER () AS parts_total FROM c)
SELECT *, least(parts_total, 5)::BIGINT AS parts_shown FROM r WHERE rank <= 5""",
    "grounding": """SELECT r AS resolution, count(*) AS n, count(*) FILTER (WHERE c < 0.05::DOUBLE) AS n_low FROM (
SELECT DISTINCT l_orderkey, l_partkey, l_discount AS c, l_returnflag AS r FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10)) GROUP BY r""",
    "hierarchy_closure": """WITH RECURSIVE p AS (SELECT 'O' || o_orderkey AS node, 'C' || o_custkey AS parent FROM orders UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer
UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation),
a AS (SELECT node, parent AS ancestor, 1 AS hops FROM p UNION ALL SELECT a.node, p.parent, hops + 1 FROM a JOIN p ON a.ancestor = p.node) SELECT node, ancestor, hops FROM a""",
    "supersession_chain": """WITH m AS (SELECT conv_id, turn, max(turn) OVER (PARTITION BY conv_id) AS z FROM (SELECT DISTINCT conv_id, turn FROM conversations))
SELECT conv_id || ':' || turn AS start, conv_id || ':' || z AS final, (z - turn)::INTEGER AS hops FROM m WHERE turn < z""",
    "parent_rollup": "SELECT o_custkey, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS agg_value, count(*) AS n_children FROM orders GROUP BY o_custkey",
    "midrank_percentile": """SELECT o_orderkey, o_orderpriority, (2 * (rank() OVER w - 1) + count(*) OVER (PARTITION BY o_orderpriority, o_totalprice))::DOUBLE / 2 / count(*) OVER (PARTITION BY o_orderpriority) AS percentile
FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice)""",
    "innermost_spans": f"""WITH {_EV}, h AS (SELECT event_id, sp.event_type AS span, count(*) OVER (PARTITION BY event_id) AS n_around, row_number() OVER (PARTITION BY event_id ORDER BY hi - lo, -lo, sp.event_type) AS k
FROM ev JOIN sp ON ev.user_id = sp.user_id AND "at" BETWEEN lo AND hi) SELECT event_id, span, n_around FROM h WHERE k = 1""",
    "enclosing_spans": f"""WITH {_EV} SELECT user_id, "at", string_agg(t, '>' ORDER BY lo - hi, lo, t) AS chain FROM (
SELECT DISTINCT ev.user_id, "at", sp.event_type AS t, lo, hi FROM ev JOIN sp ON ev.user_id = sp.user_id AND "at" BETWEEN lo AND hi) GROUP BY ALL""",
    "churn_span": f'''WITH {_EV} SELECT sp.user_id || ':' || sp.event_type AS coord, count(DISTINCT props) AS churn FROM sp JOIN ev ON ev.user_id = sp.user_id AND "at" BETWEEN lo AND hi GROUP BY 1''',
    "history_summary": """WITH r AS (SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d') || ' ' || o_orderpriority AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders)
SELECT o_custkey, count(*) AS n_commits, string_agg(x, '; ' ORDER BY k) FILTER (WHERE k <= 8) || CASE WHEN count(*) > 8 THEN ' (+' || (count(*) - 8) || ' earlier)' ELSE '' END AS text FROM r GROUP BY o_custkey""",
    "flow_vs_map": """WITH x AS (SELECT 'S' || l_suppkey AS src, 'P' || l_partkey AS dst, bool_or(l_returnflag = 'R') AS o, bool_or(l_returnflag <> 'R') AS m FROM lineitem GROUP BY ALL)
SELECT src, dst, CASE WHEN o AND m THEN 'confirmed' WHEN o THEN 'discovered' ELSE 'unobserved' END AS status FROM x""",
    "tree_hash": "SELECT l_orderkey, substr(sha256(string_agg(x, chr(10) ORDER BY x)), 1, 16) AS tree_hash FROM (SELECT l_orderkey, l_linenumber || ' ' || l_partkey || ' ' || l_suppkey AS x FROM lineitem) GROUP BY l_orderkey",
    "hardest_parts": """SELECT *, least(parts_total, 3)::BIGINT AS parts_shown FROM (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)::INTEGER AS rank,
count(*) OVER (PARTITION BY p_brand) AS parts_total FROM part) WHERE rank <= 3""",
}
