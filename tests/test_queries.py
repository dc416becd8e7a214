"""Every registered query of the engine against its SQL, and operators on toy inputs."""

import glob
import os

import duckdb
import pytest

from cairn.functions import text as T
from cairn.operators import graph, interval, knowledge, lineage, rank
from cairn.plans import registry
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    return v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    df = registry.queries()[name](spark, SF)
    found = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda row: str([norm(x) for x in row])
    assert sorted(key(r) for r in df.select(names).collect()) == sorted(key(r) for r in found.fetchall())


def test_blast_over_events_and_depth(spark):
    edges = spark.createDataFrame([("B", "A", "calls"), ("C", "B", "calls"), ("A", "EVT:x", "emits"), ("D", "EVT:x", "consumes")], "src string, dst string, kind string")
    seed = spark.createDataFrame([("A", "A")], "seed string, coord string")
    found = {r["coord"]: (r["depth"], r["impact"], r["via_event"]) for r in graph.blast_radius(seed, edges).collect()}
    assert found == {"B": (1, 1.0, False), "C": (2, 0.5, False), "D": (1, 1.0, True)}
    total = graph.radius(graph.blast_radius(seed, edges), edges, seed).first()
    assert (total["radius"], total["n_affected"], total["radius_is_lower_bound"]) == (2.5, 3, False)
    chain = spark.createDataFrame([(f"N{i + 1}", f"N{i}", "calls") for i in range(10)], "src string, dst string, kind string")
    start = spark.createDataFrame([("N0", "N0")], "seed string, coord string")
    assert graph.blast_radius(start, chain, 3).agg(F.max("depth")).first()[0] == 3


def test_centrality_against_brute_force(spark):
    pairs = [("a", "b"), ("a", "b"), ("b", "c"), ("d", "b"), ("c", "a")]
    nodes = sorted({x for p in pairs for x in p})
    r = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(20):
        r = {n: 0.15 / len(nodes) + 0.85 * sum(r[s] / sum(x == s for x, _ in pairs) for s, d in pairs if d == n) for n in nodes}
    found = {x["coord"]: x["centrality"] for x in graph.centrality(spark.createDataFrame(pairs, "src string, dst string")).collect()}
    assert found == pytest.approx({n: v / max(r.values()) for n, v in r.items()})


def test_chase_and_ancestors_end_on_cycles(spark):
    pairs = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("c", "a", 3), ("x", "y", 4)], "old string, new string, seq int")
    assert {(r["start"], r["final"]) for r in graph.chase(pairs).collect()} == {("a", "c"), ("b", "a"), ("c", "b"), ("x", "y")}
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "node string, parent string")
    assert {(r["node"], r["ancestor"], r["hops"]) for r in graph.ancestors(loop).collect()} == {("a", "b", 1), ("b", "a", 1)}


def test_sketch_codec_and_refs(spark):
    row = spark.createDataFrame([([1, (1 << 48) - 1, 7],)], "v array<bigint>").select(T.decode_sketch(T.encode_sketch("v")).alias("v"), T.base_of(F.lit("m.f/2#3")).alias("b"), T.arity_of(F.lit("m.f/2#3")).alias("a"), T.short_of(F.lit("m.f/2#3")).alias("s")).first()
    assert (row["v"], row["b"], row["a"], row["s"]) == ([1, (1 << 48) - 1, 7], "m.f", 2, "f")


def test_innermost_with_bins_is_the_same(spark):
    spans = spark.createDataFrame([("p", 0, 100, "mod"), ("p", 10, 20, "f"), ("p", 12, 14, "g"), ("q", 0, 5, "h")], "k string, lo int, hi int, id string")
    points = spark.createDataFrame([("p", 13), ("p", 15), ("p", 500), ("q", 5)], "k string, at int")
    one = interval.innermost(points, spans, "k", "at", "lo", "hi", "id").collect()
    assert {(r["k"], r["at"]): r["inner"] for r in one} == {("p", 13): "g", ("p", 15): "f", ("p", 500): None, ("q", 5): "h"}
    assert sorted(map(str, interval.innermost(points, spans, "k", "at", "lo", "hi", "id", 7).select("k", "at", "inner").collect())) == sorted(str(x) for x in spark.createDataFrame(one).select("k", "at", "inner").collect())


def test_stamp_vouches_backwards_only(spark):
    log = spark.createDataFrame([("c", "notes", 0, "old", "h0", 0), ("c", "notes", 1, "", "h1", 1), ("c", "notes", 2, "new", "h0", 0)], "coord string, channel string, pos int, text string, stamp string, reaffirms int")
    accepted = spark.createDataFrame([("c", ["h1"])], "coord string, accepted array<string>")
    assert [r["stale"] for r in knowledge.with_staleness(log, accepted).orderBy("pos").collect()] == [False, False, True]


def test_detect_follows_a_rename(spark):
    shape = "coord string, qualname string, kind string, path string, pos int, loc int, signature string, body_hash string, logic_hash string, shape_hash string, sketch array<bigint>, n_shingles int"
    old = [("C1", "m.load_rows", "function", "m.py", 0, 10, "(path)", "b1", "l1", "s1", [1, 2, 3, 4], 9), ("C2", "m.gone", "function", "m.py", 1, 3, "()", "b2", "l2", "s2", [9, 9, 9, 9], 3), ("C3", "m.same", "function", "m.py", 2, 3, "()", "b3", "l3", "s3", [5, 5, 5, 5], 3)]
    new = [("C4", "m.load_all_rows", "function", "m.py", 0, 11, "(path)", "b4", "l4", "s1", [1, 2, 3, 5], 9), ("C5", "n.same", "function", "n.py", 1, 3, "()", "b3", "l3", "s3", [5, 5, 5, 5], 3)]
    found = {(r["kind"], *r["old"], *r["new"]) for r in lineage.detect(spark.createDataFrame(old, shape), spark.createDataFrame(new, shape)).collect()}
    assert found == {("renamed", "C3", "C5"), ("renamed", "C1", "C4"), ("deleted", "C2")}


def test_rank_bound_report_says_what_it_left_out(spark):
    df = spark.range(30).withColumnRenamed("id", "x")
    rows = rank.rank_bound_report(df, "x", [F.col("x").desc()]).collect()
    assert len(rows) == 12 and {(r["x_total"], r["x_shown"]) for r in rows} == {(30, 12)}
    assert rank.budgeted(df.withColumn("cost", F.lit(4)), [F.col("x")], "cost", 10).count() == 2


def test_entry(spark):
    assert set(registry.entry(spark, SF).columns) >= {"coord", "depth", "impact", "rank", "affected_total", "affected_shown"}
