"""Resolution where half the index shares a last name: joins whose keys hold the whole rule, against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cairn.operators import resolve
from cairn.sources import code as C

ENTITIES = "coord string, qualname string, kind string, path string, parent string, param_types map<string, string>"
REFS = "src_qualname string, dst_ref string, kind string, via_attr boolean, bare boolean, literal_recv boolean"


def _crowd() -> list[tuple]:
    """Modules and a test module whose classes and functions share few names, with functions inside functions and classes."""
    rows = []
    for m in ("m", "pm", "tests.t"):
        path = m.replace(".", "/") + ".py"
        rows.append((m, m, "module", path, None, None))
        for k in "AB":
            rows += [(f"{m}.{k}", f"{m}.{k}", "class", path, m, None), (f"{m}.{k}.run", f"{m}.{k}.run", "method", path, f"{m}.{k}", {"s": "A"}), (f"{m}.{k}.run.In", f"{m}.{k}.run.In", "class", path, f"{m}.{k}.run", None)]
            rows += [(f"{m}.{k}.run.In.len", f"{m}.{k}.run.In.len", "method", path, f"{m}.{k}.run.In", None), (f"{m}.{k}.run.In.len.aid", f"{m}.{k}.run.In.len.aid", "function", path, f"{m}.{k}.run.In.len", None)]
        rows += [(f"{m}.aid", f"{m}.aid", "function", path, m, None), (f"{m}.A.len", f"{m}.A.len", "method", path, f"{m}.A", None)]
    return rows + [("only", "pm.A.sole", "method", "pm.py", "pm.A", None)]


def test_no_join_compares_all_of_a_last_name(spark, monkeypatch):
    """Ends of names are keys of joins: as a residual they compare each reference with each entity of its last name."""
    plans = []
    keep = lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or stored(df)
    stored = resolve.stored
    monkeypatch.setattr(resolve, "stored", keep)
    ents = spark.createDataFrame(_crowd(), ENTITIES)
    refs = spark.createDataFrame([("m.A.run", "m.B.run", "calls", False, False, False), ("pm.A.run", "aid", "calls", False, True, False)], REFS)
    bases = resolve.class_bases(spark.createDataFrame([("m.A", ["B"]), ("m.B", [])], "qualname string, bases array<string>"))
    keep(bases)
    resolve.build_edges(refs, ents, bases, C.builtins_table(spark))
    joins = [line for plan in plans for line in plan.splitlines() if "Join " in line]
    assert joins and not [line for line in joins if re.search(r"(Ends|Starts)With\(\w+#\d+, \S*#\d+", line)]


@pytest.mark.parametrize("end", ["right", "left"])
def test_cut_finds_what_comparing_all_pairs_finds(spark, end):
    rng = random.Random(end)
    word = lambda n: "".join(rng.choice("ab.π") for _ in range(rng.randint(0, n)))
    whole = [(i, rng.choice("kl"), word(6) if i % 9 else None, word(4)) for i in range(60)]
    asked = [(i, rng.choice("klm"), word(3) if i % 7 else None, word(2)) for i in range(60)]
    fits = lambda short, full: short is not None and full is not None and (full.endswith(short) if end == "right" else full.startswith(short))
    want = sorted((a[0], w[0]) for a in asked for w in whole if a[1] == w[1] and fits(a[2], w[2]) and fits(a[3], w[3]))
    found = resolve.cut(spark.createDataFrame(whole, "w int, k string, full string, path string"), spark.createDataFrame(asked, "a int, k string, part string, file string"), "k", {"part": "full", "file": "path"}, end)
    assert want and sorted((r["a"], r["w"]) for r in found.collect()) == want


def test_sole_target_is_the_only_pair_without_a_veto(spark):
    ents = C.stored(spark.createDataFrame(_crowd(), ENTITIES))
    rows = [r[0] for r in _crowd()]
    calls, i = [], 0
    for src in rows:
        for name in ("run", "len", "aid", "sole", "In"):
            for flags in ((False, True, False), (True, False, False), (False, False, True), (False, False, False)):
                calls.append((i, src, name, *flags))
                i += 1
    calls = C.stored(spark.createDataFrame(calls, "i long, src string, name string, via_attr boolean, bare boolean, literal_recv boolean"))
    builtins, scoped = C.builtins_table(spark), resolve.scopes(ents)
    targets = resolve.prepared(ents).filter("kind in ('function', 'method', 'class')")
    pairs = calls.join(targets.select(F.col("last").alias("name"), F.col("coord").alias("dst")), "name")
    free = resolve.vetoes(pairs.select("i", "src", "dst", "via_attr", "bare", "literal_recv"), ents, builtins, scoped).filter("veto = ''")
    want = {r["i"]: r["dst"] for r in free.groupBy("i").agg(F.count_distinct("dst").alias("n"), F.min("dst").alias("dst")).filter("n = 1").collect()}
    assert len(set(want.values())) > 3 and {r["i"]: r["dst"] for r in resolve.sole(calls, targets, ents, builtins, scoped).collect()} == want


def test_scopes_are_the_functions_around(spark):
    enclosed, inside = resolve.scopes(spark.createDataFrame(_crowd(), ENTITIES))
    kinds, parents = {r[0]: r[2] for r in _crowd()}, {r[0]: r[4] for r in _crowd()}

    def around(x):
        up = []
        while x := parents[x]:
            up += [x] * (kinds[x] in ("function", "method"))
        return up

    assert {r["dst"]: r["encloser"] for r in enclosed.collect()} == {x: around(x)[0] for x in kinds if around(x)}
    used = {around(x)[0] for x in kinds if around(x)}
    assert sorted((r["src"], r["encloser"]) for r in inside.collect()) == sorted((x, f) for x in kinds for f in {x, *around(x)} & used)


def test_a_base_is_the_only_one_or_the_only_one_of_its_package(spark):
    classes = [("p.m.A", ["Base", "Gone"]), ("p.m.Base", []), ("q.m.Base", []), ("q.m.B", ["Base", "One"]), ("r.m.C", ["Base", "One"]), ("r.m.One", ["One"])]
    found = resolve.class_bases(spark.createDataFrame(classes, "qualname string, bases array<string>")).collect()
    assert {(r["cls"], r["base"]) for r in found} == {("p.m.A", "p.m.Base"), ("q.m.B", "q.m.Base"), ("q.m.B", "r.m.One"), ("r.m.C", "r.m.One")}
