"""Briefings: what there is to know about entities before they are changed, for many entities at once.

Every part is a table keyed by coord; the briefing joins them, so a thousand entities cost one pass
over edges and log, not a thousand. Lists are ranked, bounded and counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_test_path
from . import graph, knowledge, lineage, metrics, rank

LOW, HARD, WIDE, SHOWN_NOTES = 0.7, 15, 5, 6


def cards(entities: DataFrame) -> DataFrame:
    """coord, qualname, kind, path, line, line_end, signature."""
    return entities.select("coord", "qualname", "kind", "path", F.col("lineno").alias("line"), F.col("end_lineno").alias("line_end"), "signature")


def _tests(entities: DataFrame) -> DataFrame:
    return entities.select("coord", "qualname", is_test_path("path").alias("is_test"))


def ranked_edges(seeds: DataFrame, edges: DataFrame, entities: DataFrame, cap: int | None = rank.CAP) -> DataFrame:
    """(coord, direction, kind, other, confidence, rank, edges_total, edges_shown): out first, production first, sure first, then by name."""
    out = edges.join(seeds.select(F.col("coord").alias("src")), "src", "left_semi").select(F.col("src").alias("coord"), F.lit("out").alias("direction"), "kind", F.col("dst").alias("other"), "confidence")
    into = edges.filter("src <> dst").join(seeds.select(F.col("coord").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("coord"), F.lit("in").alias("direction"), "kind", F.col("src").alias("other"), "confidence")
    named = out.unionByName(into).join(_tests(entities).withColumnRenamed("coord", "other").withColumnRenamed("qualname", "q"), "other", "left")
    named = named.withColumn("target", F.coalesce("q", "other"))
    order = [(F.col("direction") == "in").cast("int"), F.coalesce(F.col("is_test"), F.lit(False)).cast("int"), F.col("confidence").desc(), F.col("target"), F.col("kind")]
    return rank.rank_bound_report(named.select("coord", "direction", "kind", "target", "confidence", "is_test"), "edges", order, ["coord"], cap).drop("is_test")


def ranked_callers(seeds: DataFrame, edges: DataFrame, entities: DataFrame, cap: int | None = rank.CAP) -> DataFrame:
    """(coord, caller, rank, callers_total, callers_shown): production first, then the most called, then by name."""
    calls = edges.filter("kind = 'calls'")
    fan = calls.groupBy(F.col("dst").alias("src")).agg(F.count("*").alias("fan"))
    into = calls.join(seeds.select(F.col("coord").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("coord"), "src")
    named = into.join(_tests(entities).withColumnRenamed("coord", "src"), "src").join(fan, "src", "left")
    rows = named.select("coord", F.col("qualname").alias("caller"), F.col("is_test").cast("int").alias("t"), F.coalesce("fan", F.lit(0)).alias("fan"))
    return rank.rank_bound_report(rows, "callers", [F.col("t"), F.col("fan").desc(), F.col("caller")], ["coord"], cap).drop("t", "fan")


def ranked_notes(display: DataFrame, cap: int = SHOWN_NOTES) -> DataFrame:
    """Rows of display with rank, notes_total and notes_shown: those that decide first, then by channel, newest first."""
    order = [F.col("superseded").cast("int"), F.col("channel"), F.col("pos").desc()]
    return rank.rank_bound_report(display, "notes", order, ["coord"], cap)


def joined_list(rows: DataFrame, by: str, order: str, value: str, name: str, sep: str = ",") -> DataFrame:
    """(by, name): a group's values as one string, in order. Rows are bounded before."""
    return rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value].cast("string")), sep).alias(name))


def warnings(texts: list[tuple[Column, Column | str]]) -> Column:
    """The texts whose conditions hold, as an array."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), t if isinstance(t, Column) else F.lit(t)) for c, t in texts]))


def before_edit(seeds: DataFrame, entities: DataFrame, edges: DataFrame, log: DataFrame, accepted: DataFrame, moves: DataFrame, bindings: DataFrame, unresolved: DataFrame, depth: int = 4) -> DataFrame:
    """One row a seed (coord): who depends on it, what changes of it reach, what was written about it, and warnings.

    log: knowledge rows; accepted: (coord, accepted); moves: lineage records; bindings: (doc, coord, fresh);
    unresolved: (coord, n_unresolved) of references to its name that nothing resolved.
    """
    keys = graph.stored(seeds.select("coord").distinct())
    calls = edges.filter("kind = 'calls'").join(keys.select(F.col("coord").alias("dst")), "dst", "left_semi")
    callers = calls.join(_tests(entities).withColumnRenamed("coord", "src"), "src").groupBy(F.col("dst").alias("coord")).agg(F.count("*").alias("callers"), F.count_if("is_test").alias("callers_tests"), F.count_if(F.col("confidence") < LOW).alias("callers_guessed"))
    listed = joined_list(ranked_callers(keys, edges, entities), "coord", "rank", "caller", "callers_shown")
    targets = keys.select(F.col("coord").alias("seed"), "coord")
    reached = graph.stored(graph.blast_radius(targets, edges, depth))
    radius = graph.radius(reached, edges, targets).select(F.col("seed").alias("coord"), "radius_is_lower_bound")
    shape = reached.groupBy(F.col("seed").alias("coord")).agg(F.count("*").alias("downstream"), F.count_if(F.col("depth") == 1).alias("direct"), F.count_if("via_event").alias("via_event"))
    touched = reached.select("seed", "coord").unionByName(targets)
    used = edges.filter(F.col("kind").isin("calls", "imports")).withColumn("__e", F.xxhash64("src", "dst", "kind", "resolution"))
    ends = [touched.join(used.select(F.col(side).alias("coord"), "__e", "src", "dst", "kind", "resolution", "confidence"), "coord").drop("coord") for side in ("src", "dst")]
    ground = ends[0].unionByName(ends[1]).distinct().groupBy("seed", "resolution").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") < LOW).alias("low"))
    ground = ground.groupBy(F.col("seed").alias("coord")).agg(F.sum("low").alias("low_confidence"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "resolution", "n"))), ",").alias("grounding"))
    judged = knowledge.with_staleness(log.join(keys, "coord", "left_semi"), accepted)
    display = knowledge.for_display(judged)
    notes = display.groupBy("coord").agg(F.count("*").alias("notes_total"), F.bool_or(F.col("stale") & ~F.col("superseded")).alias("has_stale"))
    answered = knowledge.rot_answered(judged)
    docs = bindings.groupBy("coord").agg(F.count_if("fresh").alias("docs_fresh"), F.count_if(~F.col("fresh")).alias("docs_changed"))
    history = lineage.ancestry(moves, keys)
    recent = rank.rank_bound_report(history, "history", [F.col("seq").desc()], ["coord"], 3)
    kinds = recent.groupBy("coord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "kind"))), lambda x: x["kind"]), ",").alias("recent"))
    fan = metrics.fan(edges, entities.filter(is_test_path("path")).select("coord")).select("coord", "fan_in")
    own = entities.select("coord", "qualname", "kind", "path", "complexity", F.coalesce("comment_rot", F.lit(False)).alias("rot"))
    out = own.join(keys, "coord", "left_semi")
    for part in (callers, listed, radius, shape, ground, notes, answered, docs, kinds, fan, unresolved):
        out = out.join(part, "coord", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    rot = F.col("rot") & ~no("answered")
    bound = no("radius_is_lower_bound") | (F.coalesce("n_unresolved", F.lit(0)) > 0)
    said = warnings([
        (F.col("complexity") >= HARD, "hard"), ((F.col("callers") >= WIDE) & (F.col("callers_guessed") == F.col("callers")), "wide-guessed"), ((F.col("callers") >= WIDE) & (F.col("callers_guessed") < F.col("callers")), "wide"),
        (bound, "lower-bound"), (no("has_stale"), "stale-notes"), (rot, "comment-rot"), (F.col("docs_changed") > 0, "document-behind"), (F.col("recent").rlike("renamed|moved"), "recently-moved"),
    ])
    return out.select(
        "coord", "qualname", "kind", "path", "complexity", zero("fan_in"), zero("callers"), zero("callers_tests"), zero("callers_guessed"), F.coalesce("callers_shown", F.lit("")).alias("callers_shown"), zero("downstream"), zero("direct"), zero("via_event"),
        bound.alias("is_lower_bound"), zero("n_unresolved"), zero("low_confidence"), F.coalesce("grounding", F.lit("")).alias("grounding"), zero("notes_total"), no("has_stale").alias("has_stale"), rot.alias("comment_rot"), zero("docs_fresh"), zero("docs_changed"), F.coalesce("recent", F.lit("")).alias("recent"), F.array_join(said, ",").alias("warnings"),
    )


def byte_capped(payload: DataFrame, size: Column, evidence: str, notes: str, cap: int) -> DataFrame:
    """Payload rows within cap bytes, with `cuts`: evidence goes to one item, then whole, then authored notes, last one kept.

    evidence and notes are array columns; size is the row's other bytes. What was cut is always said.
    """
    weight = lambda c: F.octet_length(F.to_json(F.col(c)))
    one = payload.withColumn("__size", size + weight(evidence) + weight(notes)).withColumn("__over", F.col("__size") > cap)
    one = one.withColumn(evidence, F.when(F.col("__over"), F.slice(evidence, 1, 1)).otherwise(F.col(evidence)))
    two = one.withColumn("__drop", F.col("__over") & (size + weight(evidence) + weight(notes) > cap)).withColumn(evidence, F.when(F.col("__drop"), F.lit(None)).otherwise(F.col(evidence)))
    three = two.withColumn("__last", F.col("__drop") & (size + weight(notes) > cap)).withColumn(notes, F.when(F.col("__last"), F.slice(notes, 1, 1)).otherwise(F.col(notes)))
    cuts = F.array_compact(F.array(F.when(F.col("__over"), F.lit("evidence items")), F.when(F.col("__drop"), F.lit("evidence")), F.when(F.col("__last"), F.lit("authored notes"))))
    return three.withColumn("cuts", cuts).drop("__size", "__over", "__drop", "__last")


def subtree(entities: DataFrame, edges: DataFrame, prefix: str, most: int = 1500) -> DataFrame:
    """Entities at or below a prefix, and their direct neighbours as boundary; refused, never sampled, above `most` without a prefix."""
    if not prefix:
        if entities.limit(most + 1).count() > most:
            raise ValueError(f"more than {most} entities: name a prefix")
        return entities.withColumn("boundary", F.lit(False))
    inside = entities.filter((F.col("qualname") == prefix) | F.startswith("qualname", F.lit(prefix + ".")))
    ids = inside.select("coord")
    near = edges.join(ids.withColumnRenamed("coord", "src"), "src", "left_semi").select(F.col("dst").alias("coord")).unionByName(edges.join(ids.withColumnRenamed("coord", "dst"), "dst", "left_semi").select(F.col("src").alias("coord"))).distinct()
    around = entities.join(near, "coord", "left_semi").join(ids, "coord", "left_anti")
    return inside.withColumn("boundary", F.lit(False)).unionByName(around.withColumn("boundary", F.lit(True)))


def view_rows(entities: DataFrame) -> DataFrame:
    """id, file, span, complexity and is_test, as a picture of the map needs them."""
    return entities.select(F.col("coord").alias("id"), F.col("path").alias("file"), F.concat_ws("-", "lineno", "end_lineno").alias("span"), "complexity", is_test_path("path").alias("is_test"))


def map_label(path: Column | str, project: Column | str | None = None) -> Column:
    """A map's label: the project's name if it has one, else its folder's."""
    folder = F.element_at(F.split(F.regexp_replace(F.col(path) if isinstance(path, str) else path, "/+$", ""), "/"), -1)
    return folder if project is None else F.coalesce(F.nullif(F.trim(F.col(project) if isinstance(project, str) else project), F.lit("")), folder)


def summary(entities: DataFrame) -> DataFrame:
    """Entities by kind, suffix and whether they are of a test: how many, the hardest, and all complexity."""
    suffix = F.regexp_extract("path", r"(\.[^./]*)$", 1)
    return entities.groupBy("kind", suffix.alias("suffix"), is_test_path("path").alias("is_test")).agg(F.count("*").alias("n"), F.max("complexity").alias("hardest"), F.sum("complexity").alias("complexity"))


def attention(entities: DataFrame, judged: DataFrame, bindings: DataFrame) -> DataFrame:
    """(item, coord, detail): what may be wrong, entity by entity: comments that no one has confirmed, stale notes, documents behind."""
    answered = knowledge.rot_answered(judged).filter("answered").select("coord")
    rot = entities.filter((F.col("kind") != "module") & F.coalesce(F.col("comment_rot"), F.lit(False))).join(answered, "coord", "left_anti").select(F.lit("comment rot").alias("item"), "coord", F.lit("").alias("detail"))
    stale = knowledge.decisive_stale(knowledge.for_display(judged)).select(F.lit("stale note").alias("item"), "coord", F.col("channel").alias("detail"))
    behind = bindings.filter(~F.col("fresh")).select(F.lit("document behind").alias("item"), "coord", F.col("doc").alias("detail"))
    return rot.unionByName(stale).unionByName(behind)
