"""Source code made from the parts table, scanned, parsed and identified; ids over many names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, resolve
from ..sources import code as C
from .corpus import table

#: One class a part, with a method that calls the next size's helper; every module ends in a line that emits.
_LINES = ("class Part{k}(Base{s}):", "    # made of {n}", "    def weigh(self, other: Part{k}):", '        """{t} weight."""', "        if other and self.near():", "            return help_{s}(other)", "        return {k}", "")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): one Python module a brand."""
    part = table(spark, sf_dir, "part")
    line = F.lit("\n".join(_LINES))
    for mark, column in (("{k}", F.col("p_partkey").cast("string")), ("{s}", F.col("p_size").cast("string")), ("{n}", F.col("p_name")), ("{t}", F.col("p_type"))):
        line = F.replace(line, F.lit(mark), column)
    brand = F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))
    rows = part.select(brand.alias("b"), F.struct("p_partkey", line.alias("x")).alias("r"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["x"]), "\n")
    return rows.groupBy("b").agg(F.concat(text, F.lit("\nemit('stock')\n")).alias("content")).select(F.concat(F.lit("shop/"), "b", F.lit(".py")).alias("path"), "content")


def code_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.parse(C.kept(sources(spark, sf_dir)), "md5_48", ("entity",), False, ("body_hash", "complexity", "loc", "comment_hash", "comments", "param_types")).filter("what = 'entity'")
    first = F.col("comments")[0]
    return found.select("path", "qualname", "kind", "lineno", "end_lineno", "signature", "parent_qualname", "body_hash", "complexity", "loc", "comment_hash", F.size("comments").alias("n_comments"), first["text"].alias("comment"), F.try_element_at("param_types", F.lit("other")).alias("other_type"))


def code_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.references(C.parse(C.kept(sources(spark, sf_dir)), whats=("edge",)))


def code_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the generated modules, counted by kind and how they were resolved."""
    parsed = graph.stored(C.parse(C.kept(sources(spark, sf_dir)), wanted=("param_types",)))
    ents = graph.stored(C.entities(parsed))
    edges, _ = resolve.build_edges(C.references(parsed).drop("path"), ents, resolve.class_bases(C.class_names(parsed)), C.builtins_table(spark))
    return edges.groupBy("kind", "resolution", "confidence").agg(F.count("*").alias("n"))


def unique_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the names of documents, orders, parts, customers and events; names whose digits clash are salted.

    Six digits up to 8.4 million names; more names than that can't all have six and get longer ids.
    """
    sides = [(n, k) for n, k in (("documents", "doc_id"), ("orders", "o_orderkey"), ("part", "p_partkey"), ("customer", "c_custkey"), ("events", "event_id"))]
    names = None
    for place, (name, key) in enumerate(sides):
        rows = table(spark, sf_dir, name).select(F.concat(F.lit(f"{name}."), F.col(key).cast("string")).alias("name"), (F.col(key) + F.lit(place * 10**12)).alias("pos"))
        names = rows if names is None else names.unionByName(rows)
    return C.assign_ids(names, "name", "pos").select("name", "coord", (~F.startswith(F.concat(F.lit("C-"), F.sha2("name", 256)), F.col("coord"))).alias("salted"))


QUERIES = {f.__name__: f for f in (code_entities, code_references, code_edges, unique_ids)}

_SRC = "p AS (SELECT p_partkey AS k, p_size AS s, p_name AS n, p_type AS t, lower(replace(p_brand, '#', '')) AS b, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) * 8 + 1 AS ln FROM part)"


def _quoted(lines: tuple[str, ...]) -> str:
    """SQL for the lines' text, with a part's own values."""
    out = "'" + "\n".join(lines).replace("'", "''") + "'"
    for mark, column in (("{k}", "k::VARCHAR"), ("{s}", "s::VARCHAR"), ("{n}", "n"), ("{t}", "t")):
        out = f"replace({out}, '{mark}', {column})"
    return out


_HASH = lambda x: f"substr(sha256(regexp_replace({x}, '\\s+', '', 'g')), 1, 16)"
_D = lambda x: f"substr(sha256({x}), 1, 16)"
_BARE = _D(f"{_D('m.note')}")
_CLASS, _METHOD = _quoted(_LINES[:7]), _quoted(_LINES[2:7])


def _round(k: int) -> str:
    return f"""r{k} AS (SELECT name, pos, CASE WHEN row_number() OVER (PARTITION BY coord ORDER BY pos, name) > 1 THEN 'C-' || substr(sha256(name || coord), 1, 6) ELSE coord END AS coord FROM r{k - 1})"""


SQL = {
    "code_entities": f"""WITH {_SRC}
SELECT 'shop/' || b || '.py' AS path, 'shop.' || b || '.Part' || k AS qualname, 'class' AS kind, ln::INTEGER AS lineno, (ln + 6)::INTEGER AS end_lineno, '' AS signature, 'shop.' || b AS parent_qualname, {_HASH(_CLASS)} AS body_hash, 3 AS complexity, 7 AS loc,
       {_D(_D("'made of ' || n"))} AS comment_hash, 1 AS n_comments, 'made of ' || n AS comment, NULL AS other_type FROM p
UNION ALL SELECT 'shop/' || b || '.py', 'shop.' || b || '.Part' || k || '.weigh', 'method', (ln + 2)::INTEGER, (ln + 6)::INTEGER, 'weigh(self, other)', 'shop.' || b || '.Part' || k, {_HASH(_METHOD)}, 3, 5,
       {_D(_D("t || ' weight.'"))}, 1, t || ' weight.', 'Part' || k FROM p""",
    "code_references": f"""WITH {_SRC}, m AS (SELECT DISTINCT b FROM p)
SELECT 'shop/' || b || '.py' AS path, 'shop.' || b || '.Part' || k || '.weigh' AS src_qualname, 'shop.' || b || '.Part' || k || '.near' AS dst_ref, 'calls' AS kind, false AS via_attr, false AS bare, false AS literal_recv FROM p
UNION ALL SELECT 'shop/' || b || '.py', 'shop.' || b || '.Part' || k || '.weigh', 'help_' || s, 'calls', false, true, false FROM p
UNION ALL SELECT 'shop/' || b || '.py', 'shop.' || b, 'EVT:stock', 'emits', false, false, false FROM m""",
    "code_edges": """SELECT 'contains' AS kind, 'structural' AS resolution, 1.0::DOUBLE AS confidence, 2 * count(*) AS n FROM part
UNION ALL SELECT 'emits', 'event', 0.5, count(DISTINCT p_brand) FROM part""",
    "unique_ids": f"""WITH r0 AS (SELECT name, pos, 'C-' || substr(sha256(name), 1, 6) AS coord FROM (
SELECT 'documents.' || doc_id AS name, doc_id AS pos FROM documents UNION ALL SELECT 'orders.' || o_orderkey, o_orderkey + 1000000000000 FROM orders
UNION ALL SELECT 'part.' || p_partkey, p_partkey + 2000000000000 FROM part UNION ALL SELECT 'customer.' || c_custkey, c_custkey + 3000000000000 FROM customer UNION ALL SELECT 'events.' || event_id, event_id + 4000000000000 FROM events)),
{', '.join(_round(k) for k in range(1, 7))}
SELECT name, coord, coord <> 'C-' || substr(sha256(name), 1, 6) AS salted FROM r6""",
}
