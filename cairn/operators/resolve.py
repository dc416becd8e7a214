"""References to entities: ordered tiers of joins, each of which wins only where it is unique.

entities: coord, qualname, kind, path, parent, param_types (map), and the flags is_test; bases come
as (cls, base) pairs of names. refs: src_qualname, dst_ref, kind, via_attr, bare, literal_recv.
Every tier is an equi-join whose key holds the whole rule: where an end of a name is asked for, the
names are cut to the lengths that references of the same last name (`short`) have. A last name that
half the index shares is met once a length, not once a reference.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import arity_of, base_of, is_test_path, short_of
from .graph import ancestors, near, stored

EXACT, MRO, ANNOTATED, SUFFIX, INHERITED, BARE, EVENT = 0.95, 0.90, 0.90, 0.75, 0.70, 0.60, 0.50


def occurrences(defs: DataFrame, scope: str, name: str, position: str) -> DataFrame:
    """defs with `occurrence`: which definition of that name in its scope it is."""
    return defs.withColumn("occurrence", F.row_number().over(Window.partitionBy(scope, name).orderBy(position)))


def prepared(entities: DataFrame) -> DataFrame:
    out = entities.withColumn("short", short_of("qualname")).withColumn("base_q", base_of("qualname")).withColumn("last", F.element_at(F.split("qualname", r"\."), -1))
    return out if "is_test" in entities.columns else out.withColumn("is_test", is_test_path("path"))


def cut(whole: DataFrame, asked: DataFrame, on: str, sides: dict[str, str], end: str = "right") -> DataFrame:
    """Rows of asked and whole of the same `on` where each column of sides (of asked: of whole) is an end of the other's.

    A row of whole meets at most one value a length, so that what is found grows with whole, not with the product.
    """
    lengths = F.struct(*[F.length(a).alias(a) for a in sides])
    of = asked.groupBy(on).agg(F.collect_set(lengths).alias("_n"))
    fits = lambda n: reduce(and_, [n[a] <= F.length(w) for a, w in sides.items()])
    each = whole.join(near(of, 20_000), on).withColumn("_n", F.explode(F.filter("_n", fits)))
    return each.select(*whole.columns, *[F.call_function(end, F.col(w), F.col("_n")[a]).alias(a) for a, w in sides.items()]).join(asked, [on, *sides])


def resolve(refs: DataFrame, entities: DataFrame) -> DataFrame:
    """(ref, coord or null, tier, n_candidates) of each distinct ref.

    Tiers: "file" (file.py:name, the shortest name of that file), "id", "name" (exact), "unique",
    "arity" and "source" (the only candidate that is no test). n_candidates tells absence (0) from
    ambiguity (2 and more).
    """
    names = stored(refs.select("ref").filter("ref is not null").distinct())
    ents = prepared(entities).select("coord", "qualname", "path", "short", "base_q", "is_test", arity_of("qualname").alias("arity"))
    parts = names.withColumn("file", F.regexp_extract("ref", r"^(.*\.[A-Za-z]+):(?!\d+$)(.+)$", 1)).withColumn("name", F.regexp_extract("ref", r"^(.*\.[A-Za-z]+):(?!\d+$)(.+)$", 2))
    filed = cut(ents, parts.filter("file <> ''").select("ref", "file", short_of("name").alias("short"), base_of("name").alias("base")), "short", {"file": "path", "base": "base_q"})
    by_id = names.join(ents.select(F.col("coord").alias("ref")).distinct(), "ref")
    exact = names.join(ents.select(F.col("qualname").alias("ref"), "coord"), "ref")
    found = cut(ents, names.select("ref", short_of("ref").alias("short"), base_of("ref").alias("base"), arity_of("ref").alias("want")), "short", {"base": "base_q"})
    nothing, no = F.lit(None).cast("string"), F.lit(False)
    hit = lambda df, kind, coord, qualname=nothing, fits=no, test=no: df.select("ref", F.lit(kind).alias("kind"), coord.alias("coord"), qualname.alias("qualname"), fits.alias("fits"), test.alias("is_test"))
    coord = F.col("coord")
    hits = hit(names, "ref", nothing).unionByName(hit(filed, "file", coord, F.col("qualname"))).unionByName(hit(by_id, "id", F.col("ref"))).unionByName(hit(exact, "name", coord))
    # Candidates meet in one aggregate a reference: no tier is joined back, so none has to fit in a broadcast.
    hits = stored(hits.unionByName(hit(found, "found", coord, nothing, F.coalesce(F.col("want") == F.col("arity"), no), F.coalesce("is_test", F.lit(True)))))
    of = lambda kind, more=F.lit(True): F.when((F.col("kind") == kind) & more, coord)
    first = F.min(F.when(F.col("kind") == "file", F.struct(F.length("qualname").alias("n"), "qualname", "coord"))).alias("file")
    sides = {"unique": of("found"), "arity": of("found", F.col("fits")), "source": of("found", ~F.col("is_test"))}
    ends = [f(c).alias(f"{f.__name__}_{k}") for k, c in sides.items() for f in (F.min, F.max)]
    won = hits.groupBy("ref").agg(first, F.min(of("id")).alias("id"), F.min(of("name")).alias("name"), *ends, F.count_distinct(of("found")).alias("n_candidates"))
    tiers = {"file": F.col("file.coord"), "id": F.col("id"), "name": F.col("name")} | {k: F.when(F.col(f"min_{k}") == F.col(f"max_{k}"), F.col(f"min_{k}")) for k in sides}
    label = F.coalesce(*[F.when(c.isNotNull(), F.lit(k)) for k, c in tiers.items()])
    return won.select("ref", F.coalesce(*tiers.values()).alias("coord"), label.alias("tier"), F.col("n_candidates").cast("long").alias("n_candidates"))


def scopes(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dst, encloser), the innermost function around each entity that has one; (src, encloser, in_scope), what lies in or is such a function."""
    local = F.coalesce(F.col("kind").isin("function", "method"), F.lit(False))
    links = stored(entities.filter("parent is not null").select(F.col("coord").alias("dst"), "parent", (~local).alias("open")))
    found = frontier = stored(links.join(entities.filter(local).select(F.col("coord").alias("parent")), "parent", "left_semi").select("dst", F.col("parent").alias("encloser"), "open"))
    # Only what lies in functions is walked: down from them, through classes, to the next function.
    while not frontier.filter("open").isEmpty():
        step = links.join(near(frontier.filter("open").select(F.col("dst").alias("parent"), "encloser")), "parent").select("dst", "encloser", "open")
        frontier = stored(step.join(near(found.select("dst")), "dst", "left_anti"))
        found = found.unionByName(frontier)
    enclosed = found.select("dst", "encloser")
    up = ancestors(enclosed.select(F.col("dst").alias("node"), F.col("encloser").alias("parent"))).select(F.col("node").alias("src"), F.col("ancestor").alias("encloser"))
    own = enclosed.select(F.col("encloser").alias("src"), "encloser").distinct()
    return enclosed, up.unionByName(own).withColumn("in_scope", F.lit(True))


def vetoes(pairs: DataFrame, entities: DataFrame, builtins: DataFrame, scoped: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """pairs (src, dst, via_attr, bare, literal_recv) with `veto`: why a match by name alone can't be it.

    builtins: suffix and name of what each language defines itself. scoped: scopes(entities), where they are known.
    """
    ents = prepared(entities)
    enclosed, inside = scoped or scopes(entities)
    dst = ents.select(F.col("coord").alias("dst"), F.col("kind").alias("dst_kind"), F.col("is_test").alias("dst_test"), F.col("short").alias("dst_short"))
    out = pairs.join(dst, "dst").join(_sources(ents), "src").join(enclosed, "dst", "left").join(inside, ["src", "encloser"], "left").join(_builtin_names(builtins), ["suffix", "dst_short"], "left")
    return out.withColumn("veto", _why()).select(*pairs.columns, "veto")


def _sources(ents: DataFrame) -> DataFrame:
    return ents.select(F.col("coord").alias("src"), F.col("is_test").alias("src_test"), F.regexp_extract("path", r"(\.[^./]*)$", 1).alias("suffix"))


def _builtin_names(builtins: DataFrame) -> DataFrame:
    # Language builtins are a fixed list of some hundred names; a longer one isn't forced to be broadcast.
    names = builtins.select("suffix", F.col("name").alias("dst_short"), F.lit(True).alias("is_builtin"))
    return F.broadcast(names) if builtins.limit(10_001).count() <= 10_000 else names


def _why() -> Column:
    # A function-local target is decided by scope alone.
    return (
        F.when(F.col("encloser").isNotNull(), F.when(F.coalesce("in_scope", F.lit(False)), "").otherwise("function-local"))
        .when(F.col("via_attr") & (F.col("dst_kind") == "function"), "attr-call-to-function")
        .when((F.col("dst_kind") == "method") & F.col("bare") & F.coalesce("is_builtin", F.lit(False)), "builtin-call")
        .when(F.col("literal_recv"), "literal-receiver")
        .when(F.col("dst_test") & ~F.col("src_test"), "test-only")
        .otherwise("")
    )


def sole(calls: DataFrame, targets: DataFrame, entities: DataFrame, builtins: DataFrame, scoped: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(i, dst) of calls (i, src, name and flags) where just one entity of targets (prepared entities) whose `last` is the name isn't vetoed.

    Vetoes depend on a target's kind, place and scope only: targets that have those in common are one
    row, and function-local ones are looked for in a caller's own scopes, so that no call meets all
    entities of its name.
    """
    enclosed, inside = scoped
    one = targets.select(F.col("coord").alias("dst"), F.col("last").alias("name"), F.col("kind").alias("dst_kind"), F.col("is_test").alias("dst_test"), F.col("short").alias("dst_short")).join(enclosed, "dst", "left")
    alike = stored(one.groupBy("name", "encloser", "dst_kind", "dst_test", "dst_short").agg(F.min("dst").alias("low"), F.max("dst").alias("high")))
    wide = calls.join(alike.filter("encloser is null"), "name").join(_sources(prepared(entities)), "src").join(_builtin_names(builtins), ["suffix", "dst_short"], "left").withColumn("in_scope", F.lit(None).cast("boolean"))
    local = calls.join(inside, "src").join(alike.filter("encloser is not null"), ["name", "encloser"])
    allowed = wide.filter(_why() == "").select("i", "low", "high").unionByName(local.select("i", "low", "high"))
    return allowed.groupBy("i").agg(F.min("low").alias("dst"), F.max("high").alias("high")).filter("dst = high").select("i", "dst")


def class_bases(classes: DataFrame) -> DataFrame:
    """(cls, base) names: classes has qualname and bases (short names). Unique short name, else unique in the package."""
    named = classes.select(F.col("qualname").alias("cls"), F.explode("bases").alias("b")).groupBy("cls", "b").agg(F.count("*").alias("times"))
    named = stored(named.withColumn("pkg", F.regexp_replace("cls", r"\.[^.]*(\.[^.]*)?$", "")))
    all_ = classes.select(short_of("qualname").alias("b"), F.col("qualname").alias("base"))
    every = all_.groupBy("b").agg(F.count("*").alias("n"), F.min("base").alias("one"))
    close = cut(all_, named.select("b", "pkg").distinct(), "b", {"pkg": "base"}, "left").groupBy("b", "pkg").agg(F.count("*").alias("n_near"), F.min("base").alias("near"))
    counts = named.join(every, "b").join(close, ["b", "pkg"], "left")
    only = lambda n: F.col("times") * F.col(n) == 1
    return counts.select("cls", F.when(only("n"), F.col("one")).when(only("n_near"), F.col("near")).alias("base")).filter("base is not null and base <> cls")


def build_edges(refs: DataFrame, entities: DataFrame, bases: DataFrame, builtins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges (src, dst, kind, confidence, resolution), counts of dropped matches by veto)."""
    ents = stored(prepared(entities))
    raw = stored(refs.withColumn("i", F.xxhash64(*refs.columns)).dropDuplicates(refs.columns))
    wanted = raw.select(F.col("src_qualname").alias("ref")).unionByName(raw.select(F.col("dst_ref").alias("ref")))
    known = stored(resolve(wanted, entities).select("ref", "coord"))
    src = known.filter("coord is not null").select(F.col("ref").alias("src_qualname"), F.col("coord").alias("src"))
    raw = stored(raw.join(src, "src_qualname"))
    events = raw.filter(F.startswith("dst_ref", F.lit("EVT:"))).select("src", F.col("dst_ref").alias("dst"), "kind", F.lit(EVENT).alias("confidence"), F.lit("event").alias("resolution"))
    calls = stored(raw.filter(~F.startswith("dst_ref", F.lit("EVT:"))).join(known.select(F.col("ref").alias("dst_ref"), F.col("coord").alias("dst")), "dst_ref", "left"))
    flags = ("via_attr", "bare", "literal_recv")
    dotted = F.contains("dst_ref", F.lit("."))
    scoped = scopes(entities)
    checked = stored(vetoes(calls.filter(F.col("dst").isNotNull() & ~dotted).select("i", "src", "dst", *flags), entities, builtins, scoped))
    bad = checked.filter("veto <> ''")
    first = calls.filter("dst is not null").join(bad.select("i"), "i", "left_anti").select("i", "dst", F.lit(EXACT).alias("confidence"), F.lit("exact").alias("resolution"))
    done, rest = first, calls.join(first.select("i"), "i", "left_anti").drop("dst")
    up = ancestors(bases.select(F.col("cls").alias("node"), F.col("base").alias("parent")))
    by_name = ents.select("qualname", "coord")

    def through(pairs: DataFrame) -> DataFrame:
        """(i, dst): pairs (i, cls, meth), the method on the nearest ancestor that has it."""
        near = pairs.join(up.withColumnRenamed("node", "cls"), "cls").withColumn("qualname", F.concat_ws(".", "ancestor", "meth")).join(by_name, "qualname")
        return near.groupBy("i").agg(F.min(F.struct("hops", "qualname", "coord")).alias("b")).select("i", F.col("b.coord").alias("dst"))

    def settle(found: DataFrame, confidence: float, how: str) -> None:
        nonlocal done, rest
        found = stored(found.select("i", "dst", F.lit(confidence).alias("confidence"), F.lit(how).alias("resolution")))
        done, rest = done.unionByName(found), stored(rest.join(found.select("i"), "i", "left_anti"))

    rest = stored(rest)
    split = lambda df: df.withColumn("cls", F.regexp_replace("dst_ref", r"\.[^.]*$", "")).withColumn("meth", F.element_at(F.split("dst_ref", r"\."), -1))
    # The class may be written short: resolve it to its full name first.
    classes = known.join(ents.filter("kind = 'class'").select("coord", F.col("qualname").alias("full")), "coord").select(F.col("ref").alias("cls"), "full")
    direct = split(rest.filter(dotted)).select("i", "cls", "meth")
    short_cls = ents.filter("kind = 'class'").groupBy("short").agg(F.count("*").alias("n"), F.min("qualname").alias("full")).filter("n = 1").select(F.col("short").alias("cls"), "full")
    full = direct.join(classes.unionByName(short_cls).groupBy("cls").agg(F.min("full").alias("full")), "cls", "left").select("i", F.coalesce("full", "cls").alias("cls"), "meth")
    settle(through(full), MRO, "mro")
    typed = rest.filter(dotted).withColumn("recv", F.split("dst_ref", r"\.")[0]).withColumn("meth", F.split("dst_ref", r"\.")[1])
    typed = typed.join(ents.select(F.col("coord").alias("src"), "param_types"), "src").withColumn("ann", F.try_element_at("param_types", F.col("recv"))).filter("ann is not null")
    inner = F.when(F.startswith("ann", F.lit("Optional[")), F.regexp_extract("ann", r"^Optional\[([^,\]]*)", 1)).otherwise(F.split("ann", r"\[")[0])
    typed = typed.withColumn("short", short_of(F.trim(F.regexp_replace(F.trim(inner), "^['\"]|['\"]$", ""))))
    one_class = ents.filter("kind = 'class'").groupBy("short").agg(F.count("*").alias("n"), F.min("qualname").alias("cls")).filter("n = 1")
    typed = stored(typed.join(one_class.select("short", "cls"), "short").select("i", "cls", "meth"))
    own = typed.withColumn("qualname", F.concat_ws(".", "cls", "meth")).join(by_name, "qualname").select("i", F.col("coord").alias("dst"))
    settle(own.unionByName(through(typed.join(own.select("i"), "i", "left_anti"))), ANNOTATED, "annotated")
    last = rest.filter(dotted).withColumn("last", F.element_at(F.split("dst_ref", r"\."), -1))
    after_dot = lambda x: F.concat(F.lit("."), F.col(x))
    hits = stored(cut(ents.select("last", "coord", after_dot("qualname").alias("dotted")), last.select("i", "last", after_dot("dst_ref").alias("tail")), "last", {"tail": "dotted"}))
    suffix = hits.groupBy("i").agg(F.count_distinct("coord").alias("n"), F.min("coord").alias("dst"))
    settle(suffix.filter("n = 1"), SUFFIX, "suffix")
    guess = last.join(suffix.select("i"), "i", "left_anti").join(rest.select("i"), "i", "left_semi").withColumn("ref", F.regexp_replace("dst_ref", r"\.[^.]*$", ""))
    prefix = resolve(guess.select("ref"), entities).filter("coord is not null").select("ref")
    guess = guess.join(prefix, "ref", "left_semi").select("i", "src", F.col("last").alias("name"), *flags)
    settle(sole(guess, ents.filter(F.col("kind").isin("function", "method")), entities, builtins, scoped), INHERITED, "inherited-guess")
    bare = rest.filter(~dotted).select("i", "src", F.col("dst_ref").alias("name"), *flags)
    settle(sole(bare, ents.filter(F.col("kind").isin("function", "method", "class")), entities, builtins, scoped), BARE, "bare-name")
    resolved = done.join(calls.select("i", "src", "kind"), "i").select("src", "dst", "kind", "confidence", "resolution")
    fixed = lambda df, kind: df.select("src", "dst", F.lit(kind).alias("kind"), F.lit(1.0).alias("confidence"), F.lit("structural").alias("resolution"))
    contains = fixed(entities.filter("parent is not null").select(F.col("parent").alias("src"), F.col("coord").alias("dst")), "contains")
    one = ents.select("qualname", "coord")
    inherits = bases.join(one.select(F.col("qualname").alias("cls"), F.col("coord").alias("src")), "cls").join(one.select(F.col("qualname").alias("base"), F.col("coord").alias("dst")), "base")
    edges = resolved.unionByName(events).unionByName(contains).unionByName(fixed(inherits, "inherits"))
    return stored(edges.filter("src <> dst").distinct()), bad.groupBy("veto").agg(F.count("*").alias("n"))


def unresolved_calls(refs: DataFrame, entities: DataFrame) -> DataFrame:
    """(short, n): call references whose last name nothing in the index has."""
    calls = refs.filter((F.col("kind") == "calls") & ~F.startswith("dst_ref", F.lit("EVT:"))).withColumn("short", short_of("dst_ref"))
    known = prepared(entities).select("short").distinct()
    return calls.join(known, "short", "left_anti").groupBy("short").agg(F.count("*").alias("n"))
