"""Scanning and parsing a small tree of four languages; digests; identity."""

import hashlib

import pytest
from pyspark.sql import functions as F

from cairn.functions import source as S
from cairn.operators import resolve
from cairn.sources import code as C
from cairn.sources import parsers as P

TREE = {
    "app/core.py": '''import json
from app import helper
LIMIT = 3

class Store:
    """Keeps rows."""
    size = 0

    def put(self, row: dict) -> bool:
        # TODO: check the row
        if row and self.ready():
            helper.audit(row)
            emit("stored", row)
            return True
        return json.dumps(row)

    def ready(self):
        return self.size < LIMIT

class Fast(Store):
    def ready(self):
        return True

def load(store: Store):
    def inner():
        return store.put({})
    for i in range(3):
        inner()
    emit(f"done{store}")
    return [x for x in range(2) if x]

def load(store):
    return fresh_name(store)
''',
    "app/helper.py": "def audit(row):\n    subscribe('stored', audit)\n    return 'x'.join(row)\n",
    "app/broken.py": "def f(:\n  pass\n",
    "tests/test_core.py": "from app.core import Store\n\nclass TestStore:\n    def test_put(self, s: Store):\n        assert s.put(1)\n",
    "web/report.ts": "import { sum } from './sums';\ninterface Row extends Base { n: number }\ntype Name = string;\nexport class Report {\n  render(rows: Row[]): string {\n    if (rows && true) { return this.line(rows); } // FIXME later\n    return sum(rows);\n  }\n  line(rows) { return 'for (x)'; }\n}\nconst total = (a, b) => sum(a);\n",
    "srv/score.go": 'package srv\n\nimport "fmt"\n\ntype Scorer struct { n int }\n\nfunc (s *Scorer) Clamp(x int) int {\n\tif x > s.n { return s.n }\n\treturn clampLow(x)\n}\n\nfunc clampLow(x int) int {\n\tfmt.Println(x)\n\treturn x\n}\n',
    "srv/Box.java": "import java.util.List;\npublic class Box extends Crate {\n  /* one */\n  public int add(int a, int b) { return add(a); }\n  int add(int a) { publish(\"added\"); return a; }\n}\n",
    "web/app.min.js": "function a(){}",
    "web/long.js": "var x = '" + "y" * 600 + "';\n",
    "node_modules/dep.js": "function dep(){}",
    ".hidden/x.py": "x = 1\n",
    "notes.txt": "no source\n",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, content in TREE.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(content)
    return root


@pytest.fixture(scope="module")
def parsed(spark, tree):
    return C.stored(C.parse(C.scan(spark, str(tree))))


def test_scan_and_containment(spark, tree, parsed):
    assert {r["path"] for r in C.scan(spark, str(tree)).collect()} == {p for p in TREE if p.startswith(("app/", "tests/", "web/report", "srv/"))}
    bad = C.errors(parsed).collect()
    assert [r["path"] for r in bad] == ["app/broken.py"] and "SyntaxError" in bad[0]["error"]


def test_entities_of_each_language(parsed):
    found = {(r["qualname"], r["kind"]) for r in parsed.filter("what = 'entity'").collect()}
    assert {("app.core", "module"), ("app.core.Store", "class"), ("app.core.Store.size", "attribute"), ("app.core.Store.put", "method"), ("app.core.load", "function"), ("app.core.load#2", "function"), ("app.core.load.inner", "function")} <= found
    assert {("web.report.Row", "class"), ("web.report.Name", "class"), ("web.report.Report.render", "method"), ("web.report.Report.line", "method"), ("web.report.total", "function")} <= found
    assert {("srv.score.Scorer", "class"), ("srv.score.Scorer.Clamp", "method"), ("srv.score.clampLow", "function")} <= found
    assert {("srv.Box.Box", "class"), ("srv.Box.Box.add/2", "method"), ("srv.Box.Box.add/1", "method")} <= found
    rows = {r["qualname"]: r for r in parsed.filter("what = 'entity'").collect()}
    put = rows["app.core.Store.put"]
    assert (put["lineno"], put["end_lineno"], put["complexity"], put["signature"], put["return_type"], put["param_types"]) == (9, 15, 3, "put(self, row)", "bool", {"row": "dict"})
    assert [(c["line"], c["text"]) for c in put["comments"]] == [(2, "TODO: check the row")]
    assert [c["kind"] for c in rows["app.core.Store"]["comments"]] == ["docstring", "comment"]
    assert rows["srv.score.Scorer.Clamp"]["lineno"] == 7 and rows["srv.score.Scorer.Clamp"]["end_lineno"] == 10
    assert len(put["sketch"]) == 48


def test_references(parsed):
    refs = {(r["src_qualname"], r["dst_ref"], r["kind"]) for r in C.references(parsed).collect()}
    assert {("app.core.Store.put", "app.core.Store.ready", "calls"), ("app.core.Store.put", "helper.audit", "calls"), ("app.core.Store.put", "EVT:stored", "emits"), ("app.core.load", "EVT:<dynamic>", "emits"), ("app.helper.audit", "EVT:stored", "consumes"), ("app.core", "app.helper", "imports"), ("tests.test_core.TestStore.test_put", "Store.put", "calls")} <= refs
    assert {("web.report.Report.render", "web.report.Report.line", "calls"), ("web.report.Report.render", "sum", "calls"), ("srv.score.Scorer.Clamp", "clampLow", "calls"), ("srv.Box.Box.add/1", "EVT:added", "emits"), ("web.report", "sums", "imports")} <= refs
    literal = [r for r in C.references(parsed).collect() if r["dst_ref"] == "join"]
    assert [(r["literal_recv"], r["via_attr"]) for r in literal] == [(True, True)]
    assert not any(d in ("for", "if", "return") for _, d, _ in refs)


def test_edges_with_vetoes_and_tiers(spark, parsed):
    ents = C.stored(C.entities(parsed))
    edges, dropped = resolve.build_edges(C.references(parsed).drop("path"), ents, resolve.class_bases(C.class_names(parsed)), C.builtins_table(spark))
    name = {r["coord"]: r["qualname"] for r in ents.collect()}
    found = {(name[r["src"]], name.get(r["dst"], r["dst"]), r["kind"]): (r["resolution"], r["confidence"]) for r in edges.collect()}
    assert found["app.core.Store.put", "app.core.Store.ready", "calls"] == ("exact", 0.95)
    assert found["app.core.Store.put", "app.helper.audit", "calls"][0] in ("exact", "suffix")
    assert found["tests.test_core.TestStore.test_put", "app.core.Store.put", "calls"][0] in ("exact", "annotated", "suffix")
    assert found["app.core.load", "app.core.load.inner", "calls"] == ("exact", 0.95)
    assert found["app.core.Fast", "app.core.Store", "inherits"] == ("structural", 1.0)
    assert found["app.core.Store", "app.core.Store.put", "contains"] == ("structural", 1.0)
    assert found["app.core.Store.put", "EVT:stored", "emits"] == ("event", 0.5)
    assert ("app.helper.audit", "app.core.Fast", "calls") not in found
    assert all(r["n"] > 0 for r in dropped.collect())


def test_one_test_a_veto(spark):
    shape = "coord string, qualname string, kind string, path string, parent string, param_types map<string, string>"
    ents = spark.createDataFrame([("m", "m", "module", "m.py", None, None), ("f", "m.f", "function", "m.py", "m", None), ("in", "m.f.inner", "function", "m.py", "f", None), ("g", "m.g", "function", "m.py", "m", None), ("c", "m.C", "class", "m.py", "m", None), ("len", "m.C.len", "method", "m.py", "c", None), ("t", "tests.t.check", "function", "tests/t.py", None, None)], shape)
    pairs = spark.createDataFrame([("g", "in", False, True, False), ("f", "in", False, True, False), ("g", "f", True, False, False), ("g", "len", False, True, False), ("g", "len", False, False, True), ("g", "t", False, True, False), ("t", "g", False, True, False)], "src string, dst string, via_attr boolean, bare boolean, literal_recv boolean")
    found = sorted((r["src"], r["dst"], r["veto"]) for r in resolve.vetoes(pairs, ents, C.builtins_table(spark)).collect())
    assert found == sorted([("g", "in", "function-local"), ("f", "in", ""), ("g", "f", "attr-call-to-function"), ("g", "len", "builtin-call"), ("g", "len", "literal-receiver"), ("g", "t", "test-only"), ("t", "g", "")])


def test_reuse_of_parsed_files(spark, parsed, tree):
    files = C.scan(spark, str(tree))
    changed = files.withColumn("content", F.when(F.col("path") == "app/helper.py", "def audit(row):\n    return 1\n").otherwise(F.col("content")))
    marked = parsed.withColumn("signature", F.lit("from before"))
    out = C.parse_changed(changed, marked).filter("what = 'entity'")
    assert {r["path"] for r in out.filter("signature <> 'from before'").select("path").distinct().collect()} == {"app/helper.py"}
    assert out.filter("path = 'app/helper.py'").count() == 2 and C.parse_changed(files, None).count() == parsed.count()


def test_ids_stay_and_rot(spark, parsed):
    first = C.stored(C.entities(parsed))
    moved = parsed.withColumn("logic_hash", F.when(F.col("qualname") == "app.core.Store.put", "other").otherwise(F.col("logic_hash"))).withColumn("logic_hash", F.when(F.col("kind") == "module", "x").otherwise(F.col("logic_hash")))
    then = C.stored(C.entities(moved, first))
    a, b = ({r["qualname"]: (r["coord"], r["comment_rot"]) for r in df.collect()} for df in (first, then))
    assert {q: c for q, (c, _) in a.items()} == {q: c for q, (c, _) in b.items()} and len({c for c, _ in a.values()}) == len(a)
    assert {q for q, (_, rot) in b.items() if rot} == {"app.core.Store.put"}
    again = C.entities(moved, then)
    assert {r["qualname"] for r in again.filter("comment_rot").collect()} == {"app.core.Store.put"}
    touched = moved.withColumn("comment_hash", F.when(F.col("qualname") == "app.core.Store.put", "new").otherwise(F.col("comment_hash")))
    assert C.entities(touched, then).filter("comment_rot").count() == 0


def test_clashing_ids_as_if_names_came_one_by_one(spark):
    import hashlib

    names = [f"n{i}" for i in range(120)]
    taken: dict[str, str] = {}
    for n in names:
        c = "C-" + hashlib.sha256(n.encode()).hexdigest()[:2]
        while c in taken:
            c = "C-" + hashlib.sha256((n + c).encode()).hexdigest()[:2]
        taken[c] = n
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, pos int")
    assert {r["coord"]: r["name"] for r in C.assign_ids(df, "name", "pos", 2).collect()} == taken
    with pytest.raises(ValueError):
        C.assign_ids(df, "name", "pos", 1)


def test_digests_move_with_what_they_are_of():
    base = 'def f(a):\n    """Doc."""\n    return a + 1\n'
    cosmetic = 'def f(a):\n    """Other doc."""\n    # note\n    return a + 1\n'
    assert S.logic_hash(base) == S.logic_hash(cosmetic) == S.logic_hash(base.replace("def f", "def g")) and S.logic_hash(base) != S.logic_hash(base.replace("+ 1", "+ 2"))
    assert S.shape_hash(base, "f") == S.shape_hash(base.replace("a", "b"), "f") and S.body_hash(base) != S.body_hash(cosmetic)
    assert S.complexity("def f(x):\n    if x and y:\n        for i in x:\n            pass\n", ".py") == 4 and S.complexity("if (a) { b() } else { c() }", ".js") == 2
    assert S.complexity("def (:", ".py") == 1 and S.annotations("x = 1") == ({}, "")
    assert [c["text"] for c in S.brace_comments('x = "// no"; // yes\n/* two\n * lines */')] == ["yes", "two lines"]
    assert S.sketch("")[1] == 1 and len(S.sketch("a b c d", "md5_48")[0]) == 48


def test_registry_takes_other_languages(spark):
    P.register(".toy", "toy", lambda text, module: ([P.entity("module", module, 1, 1, text, module)], [P.reference(module, "x", "calls")], []))
    try:
        rows = C.parse(spark.createDataFrame([("a.toy", "hi"), ("b.zig", "hi")], "path string, content string")).collect()
    finally:
        del P.REGISTRY[".toy"]
    assert sorted(r["what"] for r in rows if r["path"] == "a.toy") in (["edge", "entity"], ["error"])
    assert [r["error"] for r in rows if r["path"] == "b.zig"] == ["parser unavailable: .zig"]


def test_more_names_than_ids_of_the_usual_length(spark, monkeypatch):
    monkeypatch.setattr(C, "DIGITS", 2)
    df = spark.range(200).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), F.col("id").alias("pos"))
    found = {r["coord"]: r["name"] for r in C.assign_ids(df, "name", "pos").collect()}
    assert len(found) == 200 and {len(c) for c in found} == {len("C-") + 3}
    taken = {}
    for k in range(200):
        c = "C-" + hashlib.sha256(f"n{k}".encode()).hexdigest()[:3]
        while c in taken:
            c = "C-" + hashlib.sha256(f"n{k}{c}".encode()).hexdigest()[:3]
        taken[c] = f"n{k}"
    assert found == taken


_LONG = '''"""About it."""
import os
from x import y as z
# first
def f(a: int) -> str:
    """Says."""
    return z.run(a) if a else os.getcwd()   # inner

TEXT = """
class NotOne:
def neither(): (
"""
@deco
class A(B):
    x = 1

    class I:
        def g(self): self.h(); "a".join([])
    def h(self):
        s = """one

   two"""
        for i in s: pass

@deco(
    1)
async def f(b: A = None): emit("e")
if f:
    def f(): pass
else:
    class A: pass
def last(): y(); b.h()
'''


@pytest.mark.parametrize("text", [_LONG, _LONG.split("\n", 1)[1], "\n# only\n" + _LONG[_LONG.index("@deco") :], _LONG * 3, "def f(a: int):\r\n    'd'\r\nclass B: pass\r\nx = 1", "'d'\nclass C: pass", "x\ndef g(): pass"])
def test_pieces_give_what_the_whole_file_gives(monkeypatch, text):
    how = ("blake2b6", ("entity", "edge", "base"), True, S.MEASURES)
    whole = [r for rows in C._blocks("m/a.py", text, *how) for r in rows]
    monkeypatch.setattr(P, "PIECE", 1)
    cut = list(P.pieces(text))
    assert len(cut) > 1 and "".join(t for _, t, _ in cut) == text
    found = [r for rows in C._blocks("m/a.py", text, *how) for r in rows]
    key = lambda r: (r["what"], r.get("pos", 0), str(sorted((k, str(v)) for k, v in r.items())))
    assert sorted(found, key=key) == sorted(whole, key=key)


def test_a_long_file_that_breaks_late_is_one_error(spark, monkeypatch):
    monkeypatch.setattr(P, "PIECE", 10)
    text = "def f():\n    g()\n" * 5 + "class A:\n    x = (\n"
    schema = C.pa.schema(C._FIELDS)
    rows = [r for b in C._batches("a.py", text, schema, "blake2b6", ("edge",), True, ()) for r in b.to_pylist()]
    assert [r["what"] for r in rows] == ["error"] and "line 12" in rows[0]["error"]
    assert len([r for b in C._batches("a.py", text[:85], schema, "blake2b6", ("edge",), True, ()) for r in b.to_pylist()]) == 5
