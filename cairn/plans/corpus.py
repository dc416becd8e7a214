"""Identity, sketches, snapshots and lineage over documents, parts and events."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import source
from ..functions import text as T
from ..operators import graph, interval, lineage, metrics, resolve

SPACES = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
TOKENS = r"[A-Za-z_][\p{L}\p{N}_]*|[^\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}A-Za-z_]"
BODY = f"substr(sha256(regexp_replace(text, '{SPACES}', '', 'g')), 1, 16)"
BANDS = 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def coordinate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws(".", "source", F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", T.coord_id(name).alias("coord"), T.short_of(name).alias("short"))


def body_hash_clones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are equal but for white space."""
    rows = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", T.body_hash("text").alias("body_hash"))
    return rows.groupBy("body_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("n > 1")


def token_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = T.tokens(F.coalesce("text", F.lit("")))
    rows = table(spark, sf_dir, "documents").select("doc_id", tokens.alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(T.shingles("t")).cast("long").alias("n_shingles"))


def _sketched(spark: SparkSession, sf_dir: str, name: str, id_: str) -> DataFrame:
    """id, n (distinct shingles) and sketch of each row's text, a text at a time; no shingle leaves its task."""
    rows = table(spark, sf_dir, name).select(F.col(id_).alias("id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [source.text_sketch(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([k for _, k in found], pa.list_(pa.int64()))], ["id", "n", "sketch"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n bigint, sketch array<bigint>")


def minhash_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sketched(spark, sf_dir, "documents", "doc_id")
    return rows.select(F.col("id").alias("doc_id"), F.array_join(F.transform("sketch", lambda v: v.cast("string")), ",").alias("sketch"))


def near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, jaccard): b shares a band of its sketch with a, the first document that has that band.

    Every two documents that share a band are connected through its first one, so no link is lost and a
    band of n documents gives n - 1 rows, not all pairs. Equal sketches are one: their first document
    stands for them. The first of a band comes from a map-side aggregate.
    """
    full = graph.stored(_sketched(spark, sf_dir, "documents", "doc_id").groupBy("sketch").agg(F.min("id").alias("id")))
    width = T.SKETCH_SIZE // BANDS
    bands = full.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(F.slice("sketch", b * width + 1, width)))).alias("band", "key"))
    first = bands.groupBy("band", "key").agg(F.min("id").alias("a"), F.count("*").alias("k")).filter("k > 1").drop("k")
    pairs = bands.join(first, ["band", "key"]).filter("a < id").select("a", F.col("id").alias("b")).distinct()
    sides = [full.select(F.col("id").alias(s), F.col("sketch").alias(f"s{s}")) for s in ("a", "b")]
    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", T.sketch_jaccard("sa", "sb").alias("jaccard"))


def benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each item its sketch finds in a document; sketches meet value by value.

    The items' values are broadcast up to a million of them (some 50 MB), else both sides are shuffled.
    """
    sides = []
    for name, id_ in (("benchmark", "item_id"), ("documents", "doc_id")):
        rows = _sketched(spark, sf_dir, name, id_)
        sides.append(rows.select(F.col("id").alias(id_), F.col("n").alias(f"n_{id_}"), F.posexplode("sketch").alias("place", "value")))
    items = graph.stored(sides[0])
    equal = sides[1].join(F.broadcast(items) if items.count() <= 1_000_000 else items, ["place", "value"]).groupBy("item_id", "doc_id", "n_item_id", "n_doc_id").agg(F.count("*").alias("n_equal"))
    j = F.col("n_equal").cast("double") / F.lit(float(T.SKETCH_SIZE))
    return equal.select("item_id", "doc_id", "n_equal", T.sketch_containment(j, "n_item_id", "n_doc_id").alias("containment"))


def _halves(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Which types of events each user had with each property, in the first two days and later: two snapshots."""
    events = table(spark, sf_dir, "events")
    kinds = F.array_join(F.array_sort(F.collect_set("event_type")), "|")
    key = F.concat_ws(":", F.col("user_id").cast("string"), F.get_json_object("props", "$.k"))
    late = F.dayofmonth("ts") > 2
    return [events.filter(half).groupBy(key.alias("coord")).agg(kinds.alias("body_hash")) for half in (~late, late)]


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _halves(spark, sf_dir)
    return lineage.snapshot_diff(old, new)


def exact_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as the old snapshot, the others as the new one: copies are moves.

    Texts of one source with as many characters, but for the last two digits, count as of equal logic.
    Digests are taken in the scan and stored; no text is shuffled.
    """
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    alike = F.concat_ws("|", "source", F.floor(F.col("n_chars") / 100).cast("string"))
    shape = [F.col("doc_id").alias("coord"), F.col("lang").alias("kind"), F.col("doc_id").alias("pos"), T.body_hash("text").alias("body_hash"), T.body_hash(alike).alias("logic_hash")]
    rows = graph.stored(docs.select(*shape))
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("coord")).distinct()
    return lineage.exact_moves(rows.join(known, "coord", "left_semi"), rows.join(known, "coord", "left_anti"))


def resolve_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names, and their last words, as references to the parts."""
    part = table(spark, sf_dir, "part")
    dotted = F.regexp_replace("p_name", " ", ".")
    entities = part.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("coord"), F.concat_ws(".", F.col("p_brand"), dotted).alias("qualname"), F.when(F.col("p_size") < 5, "tests/a.py").otherwise("src/a.py").alias("path"))
    refs = part.select(F.concat_ws(".", F.col("p_brand"), dotted).alias("ref")).unionByName(part.select(dotted.alias("ref"))).unionByName(part.select(F.col("p_name").alias("ref")))
    return resolve.resolve(refs, entities)


def memoised_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complexity of all documents; that of labelled ones is taken from the previous run."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("coord"), "text", T.body_hash("text").alias("body_hash"), T.body_hash(F.lower("text")).alias("logic_hash"))
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("coord")).distinct()
    old = docs.join(known, "coord", "left_semi").withColumn("complexity", T.regex_complexity("text"))
    return metrics.memoised(docs, old, T.regex_complexity("text"), "complexity").select(F.col("coord").alias("doc_id"), "memoised", F.col("complexity").cast("long").alias("complexity"))


def marker_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence lines of documents as comment markers."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    lines = docs.select(F.col("doc_id").alias("coord"), F.col("source").alias("path"), F.split("text", "\n").alias("l"))
    rows = lines.select("coord", "path", F.lit(1).alias("lineno"), F.size("l").alias("end_lineno"), F.posexplode("l").alias("rel", "text"))
    out = interval.owned_markers(rows.withColumn("rel", F.col("rel") + 1), TAGS)
    return out.select("path", "line", "tag", "note", "coord", "priority")


TAGS = ("RELEASED", "LICENSED", "COPYRIGHT")


def census_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"), F.count_distinct(T.body_hash("text")).alias("n_bodies"))


QUERIES = {f.__name__: f for f in (coordinate_ids, body_hash_clones, token_shingles, minhash_sketch, near_pairs, benchmark_containment, snapshot_diff, exact_moves, resolve_tiers, memoised_metrics, marker_queue, census_summary)}

_SALTS = "[" + ", ".join(f"{k}::BIGINT" for k in T.SKETCH_SALTS) + "]"


def _sketch_sql(name: str, id_: str) -> str:
    return f"""
t_{name} AS (SELECT {id_}, regexp_extract_all(coalesce(text, ''), '{TOKENS}') AS t FROM {name}),
g_{name} AS (SELECT {id_}, CASE WHEN len(t) < 3 THEN [array_to_string(t, chr(0))] ELSE list_distinct(list_transform(list_zip(t[:len(t) - 2], t[2:len(t) - 1], t[3:]), lambda z: z[1] || chr(0) || z[2] || chr(0) || z[3])) END AS sh FROM t_{name}),
h_{name} AS (SELECT {id_}, len(sh) AS n, list_transform(sh, lambda s: ('0x' || substr(md5(s), 1, 12))::BIGINT) AS h FROM g_{name}),
s_{name} AS (SELECT {id_}, n, list_transform({_SALTS}, lambda k: list_min(list_transform(h, lambda s: xor(s, k)))) AS sketch FROM h_{name})"""


_MARK = rf"(?i)^\W*({'|'.join(TAGS)})\b[:\s-]*(.*)$"

SQL = {
    "coordinate_ids": "SELECT doc_id, 'C-' || substr(sha256(source || '.' || doc_id::VARCHAR), 1, 6) AS coord, doc_id::VARCHAR AS short FROM documents",
    "body_hash_clones": f"SELECT {BODY} AS body_hash, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "token_shingles": f"WITH {_sketch_sql('documents', 'doc_id')} SELECT doc_id, len(t)::BIGINT AS n_tokens, len(sh)::BIGINT AS n_shingles FROM t_documents JOIN g_documents USING (doc_id)",
    "minhash_sketch": f"WITH {_sketch_sql('documents', 'doc_id')} SELECT doc_id, array_to_string(sketch, ',') AS sketch FROM s_documents",
    "near_pairs": f"""WITH {_sketch_sql('documents', 'doc_id')},
f AS (SELECT sketch, min(doc_id) AS id FROM s_documents GROUP BY sketch),
b AS (SELECT id, i, sketch[i * 4 + 1:i * 4 + 4] AS k FROM f, range({BANDS}) r(i)),
p AS (SELECT DISTINCT a, id AS b FROM (SELECT id, min(id) OVER (PARTITION BY i, k) AS a FROM b) WHERE a < id),
j AS (SELECT a, b, len(list_filter(list_zip(x.sketch, y.sketch), lambda z: z[1] = z[2]))::DOUBLE / 48 AS jaccard FROM p JOIN f x ON x.id = a JOIN f y ON y.id = b)
SELECT a, b, jaccard FROM j""",
    "benchmark_containment": f"""WITH {_sketch_sql('documents', 'doc_id')}, {_sketch_sql('benchmark', 'item_id')},
d AS (SELECT doc_id, n, generate_subscripts(sketch, 1) AS p, unnest(sketch) AS v FROM s_documents),
i AS (SELECT item_id, n, generate_subscripts(sketch, 1) AS p, unnest(sketch) AS v FROM s_benchmark),
e AS (SELECT item_id, doc_id, i.n AS ni, d.n AS nd, count(*) AS n_equal FROM i JOIN d USING (p, v) GROUP BY ALL)
SELECT item_id, doc_id, n_equal, least(1.0::DOUBLE, ((n_equal::DOUBLE / 48) / (1 + n_equal::DOUBLE / 48) * (ni + nd)) / ni) AS containment FROM e""",
    "snapshot_diff": """WITH h AS (SELECT user_id || ':' || json_extract_string(props, '$.k') AS c, day(ts) > 2 AS late, array_to_string(list_sort(list(DISTINCT event_type)), '|') AS b FROM events GROUP BY ALL)
SELECT coalesce(o.c, n.c) AS coord, CASE WHEN o.c IS NULL THEN 'added' WHEN n.c IS NULL THEN 'removed' WHEN o.b = n.b THEN 'same' ELSE 'changed' END AS change
FROM (SELECT * FROM h WHERE NOT late) o FULL JOIN (SELECT * FROM h WHERE late) n ON o.c = n.c""",
    "exact_moves": f"""WITH d AS (SELECT doc_id, lang, {BODY} AS b, substr(sha256(source || '|' || n_chars // 100), 1, 16) AS l, doc_id IN (SELECT doc_id FROM labels) AS old FROM documents WHERE text IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY old, lang, b ORDER BY doc_id) AS k FROM d),
one AS (SELECT o.doc_id AS old, n.doc_id AS new, 'identical body' AS how FROM r o JOIN r n USING (lang, b, k) WHERE o.old AND NOT n.old),
r2 AS (SELECT *, row_number() OVER (PARTITION BY old, lang, l ORDER BY doc_id) AS k FROM d WHERE doc_id NOT IN (SELECT old FROM one UNION ALL SELECT new FROM one))
SELECT * FROM one UNION ALL SELECT o.doc_id, n.doc_id, 'identical logic' FROM r2 o JOIN r2 n USING (lang, l, k) WHERE o.old AND NOT n.old""",
    "resolve_tiers": """WITH e AS (SELECT 'P' || p_partkey AS coord, p_brand || '.' || replace(p_name, ' ', '.') AS q, p_size < 5 AS test FROM part),
r AS (SELECT DISTINCT unnest([p_brand || '.' || replace(p_name, ' ', '.'), replace(p_name, ' ', '.'), p_name]) AS ref FROM part),
x AS (SELECT ref, min(coord) AS coord FROM r JOIN e ON q = ref GROUP BY ref),
c AS (SELECT ref, count(*) AS n, min(coord) AS one, count(*) FILTER (WHERE NOT test) AS m, min(coord) FILTER (WHERE NOT test) AS src
      FROM r JOIN e ON split_part(q, '.', -1) = split_part(ref, '.', -1) AND suffix(q, ref) GROUP BY ref)
SELECT ref, CASE WHEN x.coord IS NOT NULL THEN x.coord WHEN n = 1 THEN one WHEN m = 1 THEN src END AS coord,
       CASE WHEN x.coord IS NOT NULL THEN 'name' WHEN n = 1 THEN 'unique' WHEN m = 1 THEN 'source' END AS tier, coalesce(n, 0)::BIGINT AS n_candidates
FROM r LEFT JOIN x USING (ref) LEFT JOIN c USING (ref)""",
    "memoised_metrics": r"""SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS memoised, 1 + len(regexp_extract_all(text, '\b(?:if|else if|for|while|case|catch|\?\?|&&|\|\|)\b|\?'))::BIGINT AS complexity FROM documents""",
    "marker_queue": f"""WITH l AS (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, source, len(l) AS n, generate_subscripts(l, 1) AS line, unnest(l) AS t FROM l),
m AS (SELECT source AS path, line::INTEGER AS line, upper(regexp_extract(t, '{_MARK}', 1)) AS tag, substr(trim(regexp_extract(t, '{_MARK}', 2)), 1, 100) AS note, doc_id, n FROM x WHERE regexp_matches(t, '{_MARK}'))
SELECT path, line, tag, note, min({{'s': n, 'c': doc_id}}).c AS coord, list_position({list(TAGS)}, tag)::INTEGER AS priority FROM m GROUP BY path, line, tag, note""",
    "census_summary": f"SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS n_chars, count(DISTINCT {BODY}) AS n_bodies FROM documents GROUP BY lang, source",
}
