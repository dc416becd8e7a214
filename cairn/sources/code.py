"""Source trees as tables: scan, parse, identity.

Files are read as binary rows and parsed in Arrow batches, one file a call; a file that can't be read
gives a row in `errors` and the rest go on. Parsed rows are reused by the digest of a file's content.
"""

from __future__ import annotations

import tempfile
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import source
from ..functions import text as T
from ..operators.graph import near, stored
from . import parsers

SKIPPED = ("node_modules", "dist", "build", "vendor", ".git", "__pycache__", ".next", "coverage")
#: Raised when parsers or digests change: stored rows of another schema aren't reused.
SCHEMA = 1
#: Hex digits of an id, as long as they do.
DIGITS = 6
_COMMENT = pa.struct([("line", pa.int32()), ("text", pa.string()), ("kind", pa.string()), ("h", pa.string())])
_FIELDS = [
    ("what", pa.string()), ("path", pa.string()), ("sha", pa.string()), ("pos", pa.int32()), ("kind", pa.string()), ("qualname", pa.string()), ("lineno", pa.int32()), ("end_lineno", pa.int32()), ("signature", pa.string()),
    ("parent_qualname", pa.string()), ("body_hash", pa.string()), ("shape_hash", pa.string()), ("logic_hash", pa.string()), ("comment_hash", pa.string()), ("return_type", pa.string()), ("param_types", pa.map_(pa.string(), pa.string())),
    ("comments", pa.list_(_COMMENT)), ("loc", pa.int32()), ("complexity", pa.int32()), ("n_shingles", pa.int32()), ("sketch", pa.list_(pa.int64())), ("src_qualname", pa.string()), ("dst_ref", pa.string()), ("via_attr", pa.bool_()),
    ("bare", pa.bool_()), ("literal_recv", pa.bool_()), ("cls", pa.string()), ("base", pa.string()), ("error", pa.string()),
]
PARSED = (
    "what string, path string, sha string, pos int, kind string, qualname string, lineno int, end_lineno int, signature string, parent_qualname string, body_hash string, shape_hash string, logic_hash string, comment_hash string, return_type string, "
    "param_types map<string, string>, comments array<struct<line: int, text: string, kind: string, h: string>>, loc int, complexity int, n_shingles int, sketch array<bigint>, src_qualname string, dst_ref string, via_attr boolean, bare boolean, literal_recv boolean, cls string, base string, error string"
)
ENTITY = ("path", "pos", "kind", "qualname", "lineno", "end_lineno", "signature", "parent_qualname", "body_hash", "shape_hash", "logic_hash", "comment_hash", "return_type", "param_types", "comments", "loc", "complexity", "n_shingles", "sketch")
REFERENCE = ("path", "src_qualname", "dst_ref", "kind", "via_attr", "bare", "literal_recv")


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the source files under root; names are judged before any content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*{" + ",".join(sorted(parsers.REGISTRY)) + "}").load(root)
    base = root.rstrip("/")
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*(?=/)", ""), "^" + base.replace("file:", "").replace(".", r"\.") + "/?", "")
    return kept(files.select(relative.alias("path"), F.col("content").cast("string").alias("content")))


def kept(files: DataFrame) -> DataFrame:
    """Files (path, content) that a scan takes: no vendored, hidden or minified ones."""
    parts = F.split("path", "/")
    plain = ~F.exists(parts, lambda p: p.isin(*SKIPPED) | (p.startswith(".") & (p != "."))) & ~F.contains("path", F.lit(".min."))
    suffix = F.regexp_extract("path", r"(\.[^./]+)$", 1)
    packed = suffix.isin(".js", ".jsx", ".ts", ".tsx") & F.exists(F.split(F.substring("content", 1, 2048), "\n"), lambda x: F.length(x) > 500)
    return files.filter(plain & suffix.isin(*parsers.REGISTRY) & ~packed)


def _blocks(path: str, content: str, family: str, whats: Collection[str], modules: bool, wanted: Collection[str]) -> Iterator[list[dict]]:
    """Rows of one file, piece by piece; what can't be read raises."""
    suffix = "." + path.rsplit(".", 1)[-1]
    module = path.rsplit(".", 1)[0].replace("/", ".")
    if suffix == ".py" and module.endswith(".__init__"):
        module = module[: -len(".__init__")]
    parser = parsers.REGISTRY[suffix][1]
    long, pos = parser is parsers.python and len(content) > parsers.PIECE, 0
    for found, refs, bases in parsers.python_pieces(content, module) if parser is parsers.python else [parser(content, module)]:
        out = []
        for e in found:
            body, short = e.pop("body"), e.pop("short")
            if "entity" in whats and (modules or e["kind"] != "module"):
                if long and e["kind"] == "module":
                    measured = source.measures_of_pieces(((line, text) for line, text, _ in parsers.pieces(body)), family, wanted) if wanted else {}
                else:
                    measured = source.measures(body, short, suffix, family, wanted)
                out.append(e | measured | {"what": "entity", "pos": pos})
            pos += 1
        if "edge" in whats:
            out += [r | {"what": "edge"} for r in refs]
        if "base" in whats:
            out += [b | {"what": "base"} for b in bases]
        yield out


def _batches(path: str, content: str, schema: pa.Schema, *how) -> Iterator[pa.RecordBatch]:
    """Rows of one file in batches, or its error alone: those of a long file wait on disk until it's through."""
    sha, names = source.digest(content), schema.names

    def made(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(rows), 1000):
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} | {"path": path, "sha": sha} for r in rows[i : i + 1000]], schema)

    suffix = "." + path.rsplit(".", 1)[-1]
    if suffix not in parsers.REGISTRY:
        yield from made([{"what": "error", "error": f"parser unavailable: {suffix}"}])
        return
    with tempfile.TemporaryFile() as kept:
        try:
            with pa.ipc.new_stream(kept, schema) as sink:
                for rows in _blocks(path, content, *how):
                    for batch in made(rows):
                        sink.write_batch(batch)
        except Exception as e:  # noqa: BLE001 - one file's failure is a row, whatever it is
            yield from made([{"what": "error", "error": f"{type(e).__name__}: {e}"}])
            return
        kept.seek(0)
        yield from pa.ipc.open_stream(kept)


def parse(files: DataFrame, family: str = "blake2b6", whats: Collection[str] = ("entity", "edge", "base"), modules: bool = True, wanted: Collection[str] = source.MEASURES) -> DataFrame:
    """Rows of what files (path, content) hold: entities, edges, bases and errors in one table.

    Only rows of `whats` are made (of entities the modules only with `modules`), and only measures that
    are `wanted` are taken; other columns are null. A file is one task's, whatever others there are.
    """
    schema = pa.schema(_FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from _batches(batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or "", schema, family, whats, modules, wanted)

    spread = files.select("path", "content").repartition(8 * files.sparkSession.sparkContext.defaultParallelism, "path")
    return spread.mapInArrow(run, PARSED)


def parse_changed(files: DataFrame, before: DataFrame | None, family: str = "blake2b6") -> DataFrame:
    """As parse(), with the rows of `before` for each file whose content it has seen: only the others are parsed."""
    if before is None:
        return parse(files, family)
    content = files.withColumn("sha", F.substring(F.sha2("content", 256), 1, 16))
    seen = before.select("path", "sha").distinct()
    return before.join(content.select("path", "sha"), ["path", "sha"], "left_semi").select(*[n for n, _ in _FIELDS]).unionByName(parse(content.join(seen, ["path", "sha"], "left_anti"), family))


def errors(parsed: DataFrame) -> DataFrame:
    return parsed.filter("what = 'error'").select("path", "error")


def references(parsed: DataFrame) -> DataFrame:
    return parsed.filter("what = 'edge'").select(*REFERENCE)


def assign_ids(names: DataFrame, name: str, order: str, digits: int | None = None) -> DataFrame:
    """names with `coord`, unique: of names whose ids clash the first in `order` keeps it, the others are salted with it.

    As if names came one by one: a name takes the first free id of its own sequence of salts. Each
    round moves the losers of a clash on, and those whose id an earlier name now claims; after the first
    only ids that moved names claim are looked at. Ids have six digits unless the caller says how many;
    where the names would fill more than half of that space, as many as leave fifteen sixteenths free, so
    that rounds stay few. A number of digits that the caller gave and that is too small is refused.
    """
    n = names.count()
    if digits and n * 2 > 16**digits:
        raise ValueError(f"{n} names don't fit ids of {digits} hex digits")
    if not digits:
        digits = DIGITS if n * 2 <= 16**DIGITS else next(d for d in range(DIGITS + 1, 65) if n * 16 <= 16**d)
    cols, key = names.columns, [name, order]
    late = F.rank().over(Window.partitionBy("coord").orderBy(order, name)) > 1
    again = lambda df: df.filter("late").select(*cols, T.coord_id(F.col(name), F.col("coord"), digits).alias("coord"))
    rows = stored(names.withColumn("coord", T.coord_id(F.col(name), None, digits)).withColumn("late", late))
    first, moved = rows.filter("not late").drop("late"), stored(again(rows))
    fresh = moved
    while not fresh.isEmpty():
        claimed = near(stored(fresh.select("coord").distinct()))
        rivals = first.join(claimed, "coord", "left_semi").join(near(moved.select(*key)), key, "left_anti").select(*cols, "coord").unionByName(moved.join(claimed, "coord", "left_semi").select(*cols, "coord"))
        fresh = stored(again(rivals.withColumn("late", late)))
        moved = stored(moved.join(near(fresh.select(*key)), key, "left_anti").select(*cols, "coord").unionByName(fresh))
    return first.join(near(moved.select(*key)), key, "left_anti").select(*cols, "coord").unionByName(moved)


def entities(parsed: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Entities with coord (kept from `before` where the name is known), parent and comment_rot."""
    found = stored(parsed.filter("what = 'entity'").select(*ENTITY))
    named = found.select("qualname", F.concat_ws("\0", "path", F.lpad(F.col("pos").cast("string"), 9, "0")).alias("place"))
    if before is not None:
        old = before.select("qualname", F.col("coord").alias("was"), F.col("logic_hash").alias("old_logic"), F.col("comment_hash").alias("old_comments"), F.col("comment_rot").alias("old_rot"))
        fresh = named.join(old.select("qualname"), "qualname", "left_anti")
        ids = assign_ids(fresh, "qualname", "place").select("qualname", "coord").unionByName(old.join(named.select("qualname"), "qualname", "left_semi").select("qualname", F.col("was").alias("coord")))
    else:
        old, ids = None, assign_ids(named, "qualname", "place").select("qualname", "coord")
    out = found.join(ids, "qualname").join(ids.select(F.col("qualname").alias("parent_qualname"), F.col("coord").alias("parent")), "parent_qualname", "left")
    if old is None:
        return out.withColumn("comment_rot", F.lit(False))
    out = out.join(old.drop("was"), "qualname", "left")
    return out.withColumn("comment_rot", comment_rot(F.col("kind"), F.col("comment_hash"), F.col("logic_hash"), F.col("old_comments"), F.col("old_logic"), F.col("old_rot"))).drop("old_logic", "old_comments", "old_rot")


def comment_rot(kind, comments, logic, old_comments, old_logic, old_rot):
    """Comments that stayed while the logic moved; touched comments clear it, else it stays. Modules never rot."""
    known = old_comments.isNotNull() & (F.coalesce(comments, F.lit("")) != "")
    moved = (F.coalesce(old_logic, F.lit("")) != "") & (F.coalesce(logic, F.lit("")) != "") & (old_logic != logic)
    return F.coalesce(F.when(kind == "module", False).when(~known, False).when(old_comments != comments, False).when(moved, True).otherwise(old_rot), F.lit(False))


def builtins_table(spark: SparkSession) -> DataFrame:
    """(suffix, name) of what languages define themselves; a fixed list."""
    return spark.createDataFrame([(s, n) for s, names in parsers.BUILTINS.items() for n in names], "suffix string, name string")


def class_names(parsed: DataFrame) -> DataFrame:
    """(qualname, bases) of classes, for resolve.class_bases()."""
    own = parsed.filter("what = 'entity' and kind = 'class'").select("qualname")
    bases = parsed.filter("what = 'base'").groupBy(F.col("cls").alias("qualname")).agg(F.collect_set("base").alias("bases"))
    return own.join(bases, "qualname", "left").select("qualname", F.coalesce("bases", F.array().cast("array<string>")).alias("bases"))
