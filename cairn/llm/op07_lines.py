"""Line dedup by content-defined chunks of lines.

A text is its lines, split at line feeds. For each of SALTS chunkings, a boundary follows a line
if the rolling hash of the last WINDOW (1 for even salts, 2 for odd ones) line hashes, mixed with
the salt, is 0 modulo DIVISOR; a line of LONG words and more always stands alone. Boundaries depend
on nothing but the lines around them, so text that is inserted elsewhere doesn't shift them.
A chunk takes part if it has two lines and more that aren't blank, or is a single line of LONG
words and more (a paragraph of that length repeats as passages of lines do); and at least LEAST
words in all. Two places must cut a passage alike for such a chunk to be found, so the
shortest chunk from each line on and the shortest one up to each line take part too: whatever lines
two places share that would make a chunk, all of them lie in such runs, wherever boundaries fall.

A chunk that occurs in several places stays at the first of them, in order of (doc_id, start), and
goes everywhere else. Places are the same if their bytes are, blank lines between included. Before
anything goes, the bytes at both places are compared; where a range of several chunks differs, the
runs of equal lines in it that would make a chunk still go.

A repeated chunk can be that of a third of all documents: hashes are counted with map-side
aggregates, only chunks of repeated hashes are looked at again, and the first place of each comes
from another such aggregate, so that no task holds all places of a chunk.

Defined cases. Null and empty texts stay as they are, and so do rows of null doc_id, which have no
place in the order and are no model either. Rows that repeat a doc_id and text are the same place: each keeps what that place keeps.
A chunk that repeats within a document stays at its first place. Every line that goes stands also at
an earlier (doc_id, position), so the first place of a line is never lost, whatever chunkings say.
A text all of whose lines go becomes "", and its row stays, unless emptied rows are to be dropped.
Other columns pass, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernel as K
from .runtime import join_checked, packed, stable, table

SALTS, DIVISOR, LONG, LEAST = 6, 2, 40, 8

LINE = np.zeros(256, bool)
LINE[10] = True


class Lines:
    """Lines of a slice: byte bounds (without the line feed), row, hash, words; blank lines are left out."""

    def __init__(self, column: pa.Array):
        data, offsets = K.buffers(column)
        lines = K.Words(data, offsets, LINE)
        words = K.Words(data, offsets)
        inside = np.searchsorted(words.starts, lines.starts), np.searchsorted(words.starts, lines.ends)
        n_words = inside[1] - inside[0]
        keep = n_words > 0
        self.data, self.offsets = data, offsets
        self.starts, self.ends, self.words = lines.starts[keep], lines.ends[keep], n_words[keep]
        self.row = lines.rows()[keep]
        self.hash = K.mix(K.span_hashes(data, self.starts, self.ends))
        first = np.ones(len(self.row), bool)
        first[1:] = self.row[1:] != self.row[:-1]
        self.first = first


def cuts(lines: Lines, salt: int) -> np.ndarray:
    """True at each line after which chunking `salt` has a boundary."""
    h = lines.hash
    if salt % 2:
        before = np.zeros(len(h), np.uint64)
        before[1:] = h[:-1]
        before[lines.first] = 0
        h = h * np.uint64(K.R) + before
    x = K.mix(h ^ np.uint64((salt + 1) * 0x9E3779B97F4A7C15 & K.MASK))
    cut = (x >> np.uint64(32)) % np.uint64(DIVISOR) == 0
    alone = lines.words >= LONG
    cut |= alone
    ends = np.ones(len(h), bool)
    if len(h):
        ends[:-1] = lines.first[1:] | alone[1:]
    return cut | ends


def runs(lines: Lines, row_first: np.ndarray, row_last: np.ndarray, total: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(first, last) lines of the shortest chunk from each line on, and of the shortest one up to each line."""
    at, long = np.arange(len(lines.words)), lines.words >= LONG
    last = np.where(long, at, np.maximum(np.searchsorted(total, total[:-1] + LEAST, "left") - 1, at + 1))
    first = np.where(long, at, np.minimum(np.searchsorted(total, total[1:] - LEAST, "right") - 1, at - 1))
    on, up = last <= row_last, first >= row_first
    return [(at[on], last[on]), (first[up], at[up])]


def chunk_table(column: pa.Array, ids: pa.Array) -> pa.RecordBatch | None:
    """One row a chunk that takes part: id, start and end bytes, hash."""
    lines = Lines(column)
    n = len(lines.starts)
    if not n:
        return None
    last_of_row = np.empty(n, bool)
    last_of_row[:-1], last_of_row[-1] = lines.first[1:], True
    row_first = np.maximum.accumulate(np.where(lines.first, np.arange(n), 0))
    row_last = np.minimum.accumulate(np.where(last_of_row, np.arange(n), n)[::-1])[::-1]
    total = np.concatenate(([0], np.cumsum(lines.words)))
    parts = runs(lines, row_first, row_last, total)
    for salt in range(SALTS):
        end = np.flatnonzero(cuts(lines, salt))
        begin = np.concatenate(([0], end[:-1] + 1))
        words = total[end + 1] - total[begin]
        ok = ((end > begin) | (words >= LONG)) & (words >= LEAST)
        parts.append((begin[ok], end[ok]))
    begin, end = (np.concatenate(x) for x in zip(*parts))
    # The same lines can be a chunk several times: once is enough.
    begin, end = np.divmod(np.unique(begin * n + end), n)
    # Of the bytes, blank lines between included: what differs there has a first place of its own.
    s, e = lines.starts[begin], lines.ends[end]
    h = K.mix(K.span_hashes(lines.data, s, e) + (e - s).astype(np.uint64) * np.uint64(K.PAIR))
    base = lines.offsets[lines.row[begin]]
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(lines.row[begin])), pa.array(s - base, pa.int32()), pa.array(e - base, pa.int32()), pa.array(h.view(np.int64))],
        ["id", "s", "e", "h"],
    )


def chunks(docs: DataFrame) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.pieces(batches, 1):
            out = chunk_table(batch.column(1), batch.column(0))
            if out is not None:
                yield out

    return _narrow(docs).mapInArrow(cut, "id long, s int, e int, h long")


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))


def removals(docs: DataFrame) -> DataFrame:
    """(id, s, e, m_id, m_s, m_e): byte ranges that may go, each with the place of the same lines that stays."""
    found = chunks(docs)
    often = stable(found.groupBy("h").agg(F.count("*").alias("k")).filter("k > 1").select("h"))
    some = stable(join_checked(found, often, "h", "left_semi"))
    pairs = join_checked(some, some.groupBy("h").agg(F.min(F.struct("id", "s", "e")).alias("m")), "h").filter((F.col("id") != F.col("m.id")) | (F.col("s") != F.col("m.s")))
    # One document and one model a window: what it sorts is no longer than a document.
    ranges = pairs.select("id", F.col("m.id").alias("m_id"), (F.col("s") - F.col("m.s")).alias("shift"), "s", "e").distinct()
    # Ranges that touch and lie at the same distance from their models are one.
    run = Window.partitionBy("id", "m_id", "shift").orderBy("s", "e")
    before = F.max("e").over(run.rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.withColumn("new", F.when(F.col("s") <= before + 1, 0).otherwise(1)).withColumn("part", F.sum("new").over(run))
    ranges = ranges.groupBy("id", "m_id", "shift", "part").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return ranges.select("id", "s", "e", "m_id", (F.col("s") - F.col("shift")).alias("m_s"), (F.col("e") - F.col("shift")).alias("m_e"))


def _slices(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(m_id, m_s, m_e, model) with the bytes of the wanted places (m_id, m_s, m_e)."""
    ranges = wanted.groupBy("m_id").agg(F.collect_set(F.struct("m_s", "m_e")).alias("r"))
    found = rows.join(ranges, F.col("__id") == F.col("m_id")).select("__id", "r", "__row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, ends, out = [], [], [], []
            for i, ranges_, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).field("text").to_pylist()):
                raw = "" if t is None else t if isinstance(t, str) else str(t)
                raw = raw.encode()
                for r in ranges_:
                    ids.append(i)
                    starts.append(r["m_s"])
                    ends.append(r["m_e"])
                    out.append(raw[r["m_s"] : r["m_e"]])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(out, pa.binary())], ["m_id", "m_s", "m_e", "model"])

    return found.mapInArrow(cut, "m_id long, m_s int, m_e int, model binary").dropDuplicates(["m_id", "m_s", "m_e"])


def alike(a: bytes, b: bytes) -> list[tuple[int, int]]:
    """Byte ranges of the runs of lines equal and at the same place in a and b that would make a chunk."""
    out, at, begin, n_lines, n_words, longest = [], 0, 0, 0, 0, 0
    for line in [*a.split(b"\n"), None]:
        end = len(a) if line is None else at + len(line)
        same = line is not None and b[at:end] == line and (not at or b[at - 1 : at] == b"\n") and b[end : end + 1] in (b"", b"\n")
        if same:
            k = len(line.split())
            n_lines, n_words, longest = n_lines + (k > 0), n_words + k, max(longest, k)
        else:
            if n_words >= LEAST and (n_lines > 1 or longest >= LONG):
                out.append((begin, at - 1))
            begin, n_lines, n_words, longest = end + 1, 0, 0, 0
        at = end + 1
    return out


def cutter():
    """(text, ranges with the bytes that stay elsewhere) to (text without them, ranges cut, bytes cut)."""

    @F.arrow_udf("struct<text: string, n_ranges: int, n_bytes: long>")
    def cut(text: pa.Array, ranges: pa.Array) -> pa.Array:
        out: list[dict] = []
        for t, found in zip(text.to_pylist(), ranges.to_pylist()):
            if t is None or not found:
                out.append({"text": t, "n_ranges": 0, "n_bytes": 0})
                continue
            raw, keep, at, n, spans = t.encode(), [], 0, 0, []
            for r in found:
                s, e = r["s"], r["e"]
                spans += [(s, e)] if raw[s:e] == r["model"] else [(s + x, s + y) for x, y in alike(raw[s:e], r["model"])]
            for s, e in sorted(spans):
                n += 1
                if e <= at:
                    continue
                keep.append(raw[at : max(s, at)])
                at = e + 1 if raw[e : e + 1] == b"\n" else e
            keep.append(raw[at:])
            left = b"".join(keep)
            if n and left.endswith(b"\n") and not raw.endswith(b"\n"):
                left = left[:-1]
            out.append({"text": left.decode("utf-8", "replace"), "n_ranges": n, "n_bytes": len(raw) - len(left)})
        return pa.array(out, pa.struct([("text", pa.string()), ("n_ranges", pa.int32()), ("n_bytes", pa.int64())]))

    # Else a filter on the result would be moved below it and compute it twice.
    return cut.asNondeterministic()


def with_cuts(docs: DataFrame) -> DataFrame:
    """docs (its columns as struct `__row`) with `__cut`, struct(text, n_ranges, n_bytes); null where nothing repeats."""
    pairs = stable(removals(docs))
    # Both joins read one and the same exchange: the texts are shuffled once.
    some, kept = docs.filter("doc_id is not null"), docs.filter("doc_id is null")
    rows = packed(some, __id=some["doc_id"].cast("long")).repartition("__id")
    models = _slices(rows, pairs.select("m_id", "m_s", "m_e"))
    lists = pairs.join(models, ["m_id", "m_s", "m_e"]).groupBy("id").agg(F.collect_list(F.struct("s", "e", "model")).alias("__ranges"))
    joined = rows.join(lists, F.col("__id") == F.col("id"), "left")
    repeats = F.col("__ranges").isNotNull()
    found = joined.select("__row", F.when(repeats, cutter()(F.when(repeats, F.col("__row.text").cast("string")), F.col("__ranges"))).alias("__cut"))
    return found.unionByName(packed(kept, __cut=F.lit(None).cast("struct<text: string, n_ranges: int, n_bytes: long>")))


def dedup_lines(docs: DataFrame, drop_emptied: bool = False) -> DataFrame:
    """docs with repeated chunks cut from text (and n_chars, if there, counted again where cut).

    drop_emptied: rows that lost all their text go; every line of theirs stands elsewhere.
    """
    names, rows = docs.columns, with_cuts(docs)
    if drop_emptied:
        rows = rows.filter(~((F.coalesce("__cut.n_bytes", F.lit(0)) > 0) & (F.trim("__cut.text", F.lit(" \t\r\n")) == "")))
    new = {"text": F.when(F.col("__cut").isNotNull(), F.col("__cut.text")).otherwise(F.col("__row.text"))}
    if "n_chars" in names:
        new["n_chars"] = F.when(F.col("__cut.n_bytes") > 0, F.char_length("__cut.text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("__row.n_chars"))
    return rows.select(*[new[c].alias(c) if c in new else F.col(f"__row.`{c}`").alias(c) for c in names])


def line_dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, text (cleaned), n_ranges and n_bytes of every document that lost lines."""
    out = with_cuts(docs.select("doc_id", "text")).filter("__cut.n_bytes > 0")
    return out.select("__row.doc_id", "__cut.text", "__cut.n_ranges", "__cut.n_bytes")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup_report(table(spark, sf_dir, "documents"))
