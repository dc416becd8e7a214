"""Operators on toy inputs: what the driver tables can't show, and that green rows exercise every branch."""

import json

import pytest
from pyspark.sql import functions as F

from cairn.functions import source
from cairn.functions import text as T
from cairn.operators import briefing, evidence, graph, harvest, knowledge, lineage, rank, resolve, verify
from cairn.plans import registry
from cairn.streaming import logs

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(
    ("name", "column", "values"),
    [
        ("resolve_every_tier", "tier", {"file", "id", "name", "unique", "arity", "source", None}),
        ("snapshot_diff", "change", {"added", "removed", "changed", "same"}),
        ("exact_moves", "how", {"identical body", "identical logic"}),
        ("map_lag", "state", {"fresh", "behind", "dirty", "unknown"}),
        ("verify_change", "tier", {"grounded", "other-language"}),
        ("dig_history", "label", {"entity-history", "region-history"}),
        ("knowledge_review", "rewritten", {True, False}),
        ("knowledge_staleness", "stale", {True, False}),
        ("flow_vs_map", "status", {"confirmed", "discovered", "unobserved"}),
        ("doc_bindings", "fresh", {True, False}),
        ("unique_ids", "salted", {True, False}),
    ],
)
def test_every_value_occurs(spark, name, column, values):
    assert {r[column] for r in registry.queries()[name](spark, SF).select(column).distinct().collect()} == values


def test_reaffirmed_rows_occur(spark):
    df = registry.queries()["knowledge_staleness"](spark, SF)
    assert df.filter("reaffirmed_pos is not null").count() > 0 and df.filter("reaffirmed_pos is null").count() > 0


SHAPE = "coord string, channel string, pos long, ts string, author string, text string, stamp string, reaffirms long"


def log(spark, rows):
    return spark.createDataFrame([(c, ch, p, "t", "human", t, s, r) for c, ch, p, t, s, r in rows], SHAPE)


def test_migrate_adds_its_history_row(spark):
    rows = log(spark, [("a", "notes", 0, "x", "h1", 0), ("a", "notes", 1, "y", None, 0), ("b", "notes", 0, "z", "h9", 0), ("b", "history", 0, "older", None, 0)])
    moves = spark.createDataFrame([("a", "b", "h2", "followed")], "old string, new string, restamp string, note string")
    out = [(r["coord"], r["channel"], r["pos"], r["text"], r["stamp"], r["author"]) for r in knowledge.migrate(rows, moves).orderBy("channel", "pos").collect()]
    assert out == [("b", "history", 1, "followed", None, "lineage"), ("b", "notes", 1, "x", "h2", "human"), ("b", "notes", 2, "y", None, "human")]


def test_a_second_replay_appends_nothing(spark):
    kinds = "coord string, qualname string, kind string, path string, pos int, loc int, signature string, body_hash string, logic_hash string, shape_hash string, sketch array<bigint>, n_shingles int"
    old = spark.createDataFrame([("A", "m.a", "function", "m.py", 0, 3, "()", "b", "l", "s", [1, 2], 2), ("B", "m.load_rows", "function", "m.py", 1, 9, "(x)", "b2", "l2", "s2", [3, 4], 2), ("Z", "m.zzz", "class", "m.py", 2, 1, "", "b3", "l3", "s3", [8, 8], 2)], kinds)
    new = spark.createDataFrame([("A", "m.a", "function", "m.py", 0, 3, "()", "b", "l", "s", [1, 2], 2), ("C", "m.load_rows", "function", "n.py", 1, 9, "(x)", "b9", "l9", "s2", [3, 4], 2)], kinds)
    notes = log(spark, [("A", "notes", 0, "one", "h", 0), ("B", "notes", 0, "two", "h", 0), ("Z", "docs", 0, "lost", None, 0)])
    local = log(spark, [("A", "notes", 0, "one", "h", 0)])
    rows, orphans = lineage.replay(new, old, notes, local)
    assert [(r["coord"], r["text"], r["stamp"]) for r in rows.collect()] == [("C", "two", "h")] and [r["coord"] for r in orphans.collect()] == ["Z"]
    again, _ = lineage.replay(new, old, notes, local.unionByName(rows))
    assert again.count() == 0


def test_ancestry_over_splits_and_cycles(spark):
    rows = spark.createDataFrame([(1, "renamed", ["a"], ["b"]), (2, "split", ["b"], ["c", "d"]), (3, "merged", ["d", "x"], ["e"]), (4, "renamed", ["q"], ["a"]), (5, "moved", ["e"], ["a2"]), (6, "renamed", ["a2"], ["e"])], "seq int, kind string, old array<string>, new array<string>")
    found = lineage.ancestry(rows, spark.createDataFrame([("c",), ("e",), ("none",)], "coord string"))
    by = {}
    for r in found.collect():
        by.setdefault(r["coord"], set()).add(r["seq"])
    assert by["c"] == {1, 2, 4} and by["e"] == {1, 2, 3, 4, 5, 6} and "none" not in by


def test_long_chains_are_followed_to_their_end(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}", i) for i in range(150)], "old string, new string, seq int")
    found = {r["start"]: (r["final"], r["hops"]) for r in graph.chase(chain).collect()}
    assert found == {f"n{i}": ("n150", 150 - i) for i in range(150)}
    tail = spark.createDataFrame([("t", "a", 1), ("a", "b", 2), ("b", "c", 3), ("c", "a", 4), ("z", "y", 5)], "old string, new string, seq int")
    assert {r["start"]: (r["final"], r["hops"]) for r in graph.chase(tail).collect()} == {"t": ("c", 3), "a": ("c", 2), "b": ("a", 2), "c": ("b", 2), "z": ("y", 1)}
    up = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(70)], "node string, parent string")
    assert graph.ancestors(up).filter("node = 'n0'").agg(F.max("hops")).first()[0] == 70


def test_versions_and_recovery(spark, tmp_path):
    folder = f"{tmp_path}/maps"
    one, two = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,)], "x int")
    assert lineage.newest(spark, folder, "t") is None
    assert lineage.snapshot({"t": one}, folder) == 1 and lineage.snapshot({"t": two}, folder) == 2
    one.write.parquet(f"{folder}/v3/t")
    assert lineage.newest(spark, folder, "t").first()["x"] == 2 and lineage.next_version(spark, folder) == 4


def test_mined_renames_once_a_pair(spark):
    rows = spark.createDataFrame([("R100", "a.py", "b.py", 1), ("R090", "a.py", "b.py", 2), ("M", "a.py", "a.py", 3)], "status string, old_path string, new_path string, seq int")
    assert [(r["seq"], r["old"], r["new"]) for r in lineage.mined_renames(rows).collect()] == [(1, ["git:a.py"], ["git:b.py"])]


def test_harvest(spark):
    ents = spark.createDataFrame([("A", "m.load", "function", "m.py", 3, "l1", "b1"), ("T", "tests.t.test_load_fails", "function", "tests/t.py", 1, "", "b2")], "coord string, qualname string, kind string, path string, lineno int, logic_hash string, body_hash string")
    had = log(spark, [])
    docs = spark.createDataFrame([("m.py", 3, " Loads. "), ("m.py", 9, "nothing here"), ("m.py", 3, "")], "path string, lineno int, text string")
    assert [(r["coord"], r["text"]) for r in harvest.docstrings(docs, ents, had).collect()] == [("A", "Loads.")]
    again = log(spark, []).unionByName(spark.createDataFrame([("A", "docs", 0, "t", "mined-docstring", "Loads.", None, 0)], SHAPE))
    assert harvest.docstrings(docs, ents, again).count() == 0
    refs = spark.createDataFrame([("tests.t.test_load_fails", "A"), ("m.load", "A")], "src_qualname string, coord string")
    assert [(r["coord"], r["author"]) for r in harvest.test_contracts(refs, ents, had).collect()] == [("A", "mined-test")]
    asserted = spark.createDataFrame([("test_load_fails", "A"), ("test_x", "T"), ("helper", "A")], "test string, coord string")
    assert [r["coord"] for r in harvest.assertion_contracts(asserted, ents, had).collect()] == ["A"]
    text = spark.createDataFrame([("docs/a.md", "see `m.load`"), ("docs/examples/b.md", "see `m.load`")], "doc string, text string")
    bound = harvest.doc_bindings(text, ents)
    assert [(r["doc"], r["coord"], r["logic_hash"]) for r in bound.collect()] == [("docs/a.md", "A", "l1")]
    moved = ents.withColumn("logic_hash", F.lit("l2"))
    kept = harvest.doc_bindings(text, moved, bound)
    assert [r["logic_hash"] for r in kept.collect()] == ["l1"] and [r["fresh"] for r in harvest.drifted(kept, moved).collect()] == [False]
    assert [r["logic_hash"] for r in harvest.doc_bindings(text.withColumn("text", F.concat("text", F.lit("!"))), moved, bound).collect()] == ["l2"]
    m = spark.createDataFrame([("A", 3), ("B", 1)], "coord string, churn int")
    assert sorted((r["coord"], r["churn"], r["dirty"]) for r in harvest.apply_churn(m, spark.createDataFrame([("A", 5)], "coord string, churn int")).collect()) == [("A", 5, True), ("B", 1, False)]


def test_rot_gate_and_stale(spark):
    ents = spark.createDataFrame([("A", "function", True, [("c1",), ("c2",), ("c3",), ("c4",)]), ("B", "module", True, []), ("C", "method", True, [("k",)])], "coord string, kind string, comment_rot boolean, comments array<struct<text: string>>")
    rows = log(spark, [("C", "confirm", 0, "read", "h", 0), ("A", "confirm", 0, "old", "gone", 0), ("A", "notes", 0, "n", "gone", 0)])
    judged = knowledge.with_staleness(rows, spark.createDataFrame([("C", ["h"]), ("A", ["x"])], "coord string, accepted array<string>"))
    assert [(r["coord"], r["comments"]) for r in verify.rotted(ents, judged).collect()] == [("A", ["c1", "c2", "c3"])]
    found = verify.staled(knowledge.for_display(judged), spark.createDataFrame([("A",)], "coord string"))
    none = spark.createDataFrame([], "path string, error string")
    assert [tuple(r) for r in verify.gate(none, found).collect()] == [(0, 1, False)]
    assert [tuple(r) for r in verify.gate(none, found.filter("channel = 'confirm'")).collect()] == [(0, 0, True)]
    assert verify.gate(spark.createDataFrame([("a.py", "SyntaxError")], "path string, error string"), found.limit(0)).first()["passed"] is False


def test_evidence(spark):
    touches = spark.createDataFrame([("A", "s3", 3), ("A", "s2", 2), ("B", "s5", 5)], "coord string, sha string, age int")
    named = spark.createDataFrame([("A", "s2", 2), ("A", "s1", 1), ("B", "s1", 1)], "coord string, sha string, age int")
    assert {tuple(r) for r in evidence.creation_boundary(touches, named, ["coord"], "age").collect()} == {("A", "s2", False), ("B", None, True)}
    commits = spark.createDataFrame([("A", "s1", [7, 8]), ("A", "s2", [])], "coord string, sha string, numbers array<int>")
    out = {r["sha"]: [(x["number"], x["body"]) for x in r["requests"]] for r in evidence.rebuild(commits, spark.createDataFrame([(7, "why")], "number int, body string")).collect()}
    assert out == {"s1": [(7, "why"), (8, "unavailable")], "s2": []}


def test_views_and_caps(spark):
    ents = spark.createDataFrame([(f"E{i}", f"m.{'a' if i < 3 else 'b'}.f{i}", "function", "m.py", i, i + 2, "", 1) for i in range(6)], "coord string, qualname string, kind string, path string, lineno int, end_lineno int, signature string, complexity int")
    edges = spark.createDataFrame([("E0", "E4"), ("E5", "E5")], "src string, dst string")
    assert {(r["coord"], r["boundary"]) for r in briefing.subtree(ents, edges, "m.a").collect()} == {("E0", False), ("E1", False), ("E2", False), ("E4", True)}
    with pytest.raises(ValueError):
        briefing.subtree(ents, edges, "", most=5)
    assert briefing.view_rows(ents).filter("id = 'E1'").first()["span"] == "1-3" and briefing.cards(ents).columns == ["coord", "qualname", "kind", "path", "line", "line_end", "signature"]
    assert spark.range(1).select(briefing.map_label(F.lit("/a/b/"), F.lit(" ")).alias("l")).first()["l"] == "b"
    rows = spark.createDataFrame([("x", ["e" * 50] * 3, ["n" * 50] * 3), ("y", ["e"], ["n"])], "id string, ev array<string>, kn array<string>")
    out = {r["id"]: (r["ev"], r["kn"], r["cuts"]) for r in briefing.byte_capped(rows, F.lit(10), "ev", "kn", 100).collect()}
    assert out["y"] == (["e"], ["n"], []) and out["x"][0] is None and len(out["x"][1]) == 1 and out["x"][2] == ["evidence items", "evidence", "authored notes"]
    near = rank.closest(spark.createDataFrame([("k", 0.5, "a"), ("k", 0.5, "b"), ("k", 0.9, "c"), ("k", 0.1, "d")], "k string, ratio double, name string"), "k", "ratio", "name")
    assert [r["name"] for r in near.orderBy("rank").collect()] == ["c", "b", "a"]


def test_the_log_as_a_stream(spark, tmp_path):
    source, stored, marks = (f"{tmp_path}/{n}" for n in ("in", "log", "ck"))
    (tmp_path / "in").mkdir()
    row = lambda pos, text, stamp="h1": {"coord": "A", "channel": "notes", "pos": pos, "text": text, "stamp": stamp, "reaffirms": 0, "unknown": 1}
    (tmp_path / "in/1.json").write_text("\n".join(json.dumps(x) for x in (row(0, "a"), row(2, "c"), row(2, "c"))))
    logs.ingest(spark, source, stored, marks).awaitTermination(120)
    (tmp_path / "in/2.json").write_text("\n".join(json.dumps(x) for x in (row(1, "late"), row(0, "again"), {"coord": None})))
    logs.ingest(spark, source, stored, marks).awaitTermination(120)
    assert [(r["pos"], r["text"]) for r in logs.stored_log(spark, stored).orderBy("pos").collect()] == [(0, "a"), (1, "late"), (2, "c")]
    seen = logs.judged(spark, stored, spark.createDataFrame([("A", ["h2"])], "coord string, accepted array<string>"))
    assert [(r["pos"], r["superseded"], r["stale"]) for r in seen.orderBy("pos").collect()] == [(0, True, True), (1, True, True), (2, False, True)]
    batch = spark.createDataFrame([("A", "notes", 5, None, None, "x", None, 0)], logs.LOG)
    for _ in range(2):
        logs.merge(batch, stored, 9)
    assert logs.stored_log(spark, stored).filter("pos = 5").count() == 1


def snapshots(spark, n=40):
    """Renames, moves, body changes, a split, a merge, deletions and additions of small functions."""
    import random

    rng = random.Random(3)
    shape = "coord string, qualname string, kind string, path string, pos int, loc int, signature string, body_hash string, logic_hash string, shape_hash string, sketch array<bigint>, n_shingles int"
    verbs, nouns = ["load", "save", "check", "merge", "split", "count"], ["row", "page", "item", "user", "part", "key", "blob"]
    old, new = [], []
    for i in range(n):
        name, sk = f"{rng.choice(verbs)}_{rng.choice(nouns)}{i}", [rng.randrange(1 << 20) for _ in range(48)]
        row = [f"A{i}", f"m.{name}", "function", "m.py", i, rng.randint(3, 30), f"({rng.choice(nouns)})", f"b{i}", f"l{i}", f"s{i % 7}", sk, 50]
        old.append(tuple(row))
        kind = i % 5
        near = [v if rng.random() < 0.8 else rng.randrange(1 << 20) for v in sk]
        if kind == 0:
            new.append((f"B{i}", f"m.{rng.choice(verbs)}_{rng.choice(nouns)}{i}", "function", "m.py", i, row[5] + 1, row[6], f"x{i}", f"y{i}", row[9], near, 50))
        elif kind == 1:
            new.append((f"B{i}", f"n.{name}", "function", "n.py", i, row[5], row[6], f"x{i}", f"y{i}", f"t{i}", near, 48))
        elif kind == 2:
            for k in (0, 1):
                new.append((f"B{i}_{k}", f"m.part{k}_{i}", "function", "m.py", i, max(1, row[5] // 2), "()", f"x{i}{k}", f"y{i}{k}", f"u{i}{k}", [v if j % 2 == k or rng.random() < 0.4 else rng.randrange(1 << 20) for j, v in enumerate(sk)], 25))
    return spark.createDataFrame(old, shape), spark.createDataFrame(new, shape)


def test_blocked_matching_gives_what_all_pairs_give(spark):
    old, new = snapshots(spark)
    key = lambda r: (r["kind"], tuple(r["old"]), tuple(r["new"]), r["author"])
    blocked = {key(r) for r in lineage.scored_moves(lineage.pair_scores(old, new)).collect()}
    every = {key(r) for r in lineage.scored_moves(lineage.pair_scores(old, new, exhaustive=True)).collect()}
    sure = lambda x: {r for r in x if r[3] == "auto"}
    assert sure(blocked) == sure(every) and len(sure(every)) >= 10
    assert {r[0] for r in every} >= {"renamed", "moved", "split"}
    split = {r[1] for r in blocked if r[0] == "split"}
    assert split and split <= {r[1] for r in every if r[0] == "split"}


def test_graph_components(spark):
    pairs = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(20)] + [("x", "y"), ("z", "z")], "a string, b string")
    assert {r["id"]: r["root"] for r in graph.components(pairs).collect()} == {**{f"n{i:02}": "n00" for i in range(21)}, "x": "x", "y": "x", "z": "z"}


def test_resolve_and_stored_never_trust_a_guessed_size(spark, tmp_path):
    """A small file that many references are made of: no side of it goes to the driver because of the file's size."""
    spark.range(40_000).select(F.concat(F.lit("m.w"), F.col("id").cast("string")).alias("q")).write.parquet(str(tmp_path / "q"))
    ents = spark.read.parquet(str(tmp_path / "q")).select(F.concat(F.lit("C"), "q").alias("coord"), F.col("q").alias("qualname"), F.lit("src/a.py").alias("path"))
    refs = ents.select(F.explode(F.array(*[F.concat(F.lit(f"{k}."), "qualname") for k in range(3)], F.col("qualname"))).alias("ref"))
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    out = resolve.resolve(refs, ents)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r["tier"], r["count"]) for r in out.groupBy("tier").count().collect()} == {("name", 40_000), (None, 120_000)}
    assert {k: spark.conf.get(k, None) for k in before} == before


def test_inherited_rows_are_counted_before_the_join(spark):
    log = spark.createDataFrame([("N", "notes", k, "t", 0, k % 3 == 0) for k in range(7)] + [("M", "notes", 0, "t", 0, True), ("M", "notes", 1, "", 1, False)], "coord string, channel string, pos int, text string, reaffirms int, stale boolean")
    up = spark.createDataFrame([("a", "N", 1), ("b", "N", 1), ("b", "N", 1), ("b", "M", 2), ("c", "X", 1)], "coord string, ancestor string, hops int")
    whole = knowledge.inherited(log, up).groupBy("coord", "ancestor", "hops").agg(F.count("*").alias("n"), F.count_if("stale").alias("n_stale"))
    out = knowledge.inherited_counts(log, up)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, whole.collect())) == [("a", "N", 1, 7, 3), ("b", "M", 2, 1, 1), ("b", "N", 1, 14, 6)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")


def test_text_sketch_is_the_expression_and_no_shingle_is_a_row(spark):
    texts = ["", " ", "a", "a b", "a b c", "x_1 é ñandú 42 \u2003漢字 ½ a\x85b", "word " * 9]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, text string").select("k", T.sketch_of("text").alias("s"), F.size(T.shingles(T.tokens("text"))).alias("n")).collect()
    for r in rows:
        n, found = source.text_sketch(texts[r["k"]])
        assert (n, found.tolist()) == (r["n"], r["s"])
    long = " ".join(f"w{k}" for k in range(5000))
    n, found = source.text_sketch(long)
    assert (found.tolist(), n) == source.sketch(long, "md5_48")
    assert "Generate" not in registry.queries()["minhash_sketch"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def _walks(edges, seeds, depth):
    """Plain Python: {(seed, coord): first depth} and {(seed, coord): best product}."""
    first, best = {}, {}
    for s in seeds:
        at, label = {s: 0}, {s: 1.0}
        front, wave = {s}, {s: 1.0}
        for d in range(1, depth + 1):
            front = {a for a, b, _ in edges if b in front and a != b} - set(at)
            at |= dict.fromkeys(front, d)
            step = {}
            for a, b, w in edges:
                if b in wave:
                    step[a] = max(step.get(a, 0), wave[b] * w)
            wave = {a: c for a, c in step.items() if c > label.get(a, 0)}
            label |= wave
        first |= {(s, c): d for c, d in at.items() if d}
        best |= {(s, c): x for c, x in label.items() if c != s}
    return first, best


def test_walks_of_more_seeds_than_a_row_has_bits(spark):
    edges = [(f"n{i}", f"n{j}", 0.5 + (i * j % 7) / 20) for i in range(90) for j in ((i * 7 + 3) % 90, (i + 11) % 90)]
    df = spark.createDataFrame([(a, b, "calls", w) for a, b, w in edges], "src string, dst string, kind string, confidence double")
    names = [f"n{i}" for i in range(80)]
    seeds = spark.createDataFrame([(s, s) for s in names], "seed string, coord string")
    first, best = _walks(edges, names, 3)
    assert {(r["seed"], r["coord"]): r["depth"] for r in graph.blast_radius(seeds, df, 3).collect()} == first
    found = {(r["seed"], r["coord"]): r["confidence"] for r in graph.confidence_reach(seeds, df, max_depth=3).collect()}
    assert found == pytest.approx(best)


def test_centrality_stops_where_nothing_moves(spark, monkeypatch):
    """Sources, a layered part and a cycle, against 20 plain rounds; without a cycle there are as few rounds as layers."""
    def plain(pairs):
        nodes = sorted({x for p in pairs for x in p})
        r = dict.fromkeys(nodes, 1 / len(nodes))
        for _ in range(20):
            r = {n: 0.15 / len(nodes) + 0.85 * sum(r[s] / sum(x == s for x, _ in pairs) for s, d in pairs if d == n) for n in nodes}
        return {n: v / max(r.values()) for n, v in r.items()}

    layered = [(f"o{i}", f"p{i % 5}") for i in range(20)] + [(f"p{i}", f"s{i % 2}") for i in range(5)] + [("s0", "z"), ("s1", "z")]
    rounds, real = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df: rounds.append(1) or real(df))
    for pairs, most in ((layered, 12), (layered + [("z", "c1"), ("c1", "c2"), ("c2", "c1"), ("c2", "s0")], 40)):
        rounds.clear()
        found = {x["coord"]: x["centrality"] for x in graph.centrality(spark.createDataFrame(pairs, "src string, dst string")).collect()}
        assert found == pytest.approx(plain(pairs)) and len(rounds) <= most
