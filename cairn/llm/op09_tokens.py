"""Token ids in patched frame-of-reference blocks.

A document's ids are cut into blocks of SIZE. A block stores its minimum, and the differences to it
packed at the width that PERCENTILE of them fit into; a difference that doesn't fit keeps its low
bits there and stands in full in the block's exception list. An index gives each block's first byte.

Bytes of a block, little-endian: minimum (4), width (1), exceptions (1), SIZE differences of width
bits, lowest first, then the exceptions' places (1 each) and differences (4 each). The last block
is filled up with the document's last id; n_tokens tells where it ends.

Defined cases. A null or empty text has no tokens: n_tokens 0, an empty index and payload. Repeated
rows are encoded row by row. Other columns are ignored; rows of a null doc_id are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .runtime import table
from .tokens import encoder, vocabulary

SIZE, PERCENTILE = 128, 0.9


def bit_lengths(x: np.ndarray) -> np.ndarray:
    """Bits that each value under 2**32 takes."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def pack_width(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, SIZE) low `width` bits to (blocks, SIZE * width // 8) bytes."""
    columns = np.ascontiguousarray((values & np.uint32((1 << width) - 1)).T).astype(np.uint64)
    out = np.zeros((SIZE * width // 64, values.shape[0]), np.uint64)
    for i in range(SIZE):
        word, shift = divmod(i * width, 64)
        out[word] |= columns[i] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= columns[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).view(np.uint8)


def encode(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents' ids one after another: (bytes, each document's bounds in them, each block's first byte there)."""
    blocks = -(-counts // SIZE)
    ends = np.cumsum(counts)
    first = np.concatenate(([0], np.cumsum(blocks)))
    n = int(first[-1])
    if not n:
        return np.zeros(0, np.uint8), np.zeros(len(counts) + 1, np.int64), np.zeros(0, np.int64)
    at = K.ragged(ends - counts, blocks * SIZE)
    values = ids[np.minimum(at, np.repeat(ends - 1, blocks * SIZE))].astype(np.uint32).reshape(n, SIZE)
    low = values.min(axis=1)
    values = values - low[:, None]
    place = min(SIZE - 1, int(np.ceil(PERCENTILE * SIZE)) - 1)
    width = bit_lengths(np.partition(values, place, axis=1)[:, place])
    over = (values.astype(np.uint64) >> width.astype(np.uint64)[:, None]) != 0
    n_over = over.sum(axis=1)
    sizes = 6 + SIZE // 8 * width + 5 * n_over
    starts = np.concatenate(([0], np.cumsum(sizes)))
    out = np.zeros(int(starts[-1]), np.uint8)
    begin = starts[:-1]
    out[begin[:, None] + np.arange(4)] = np.ascontiguousarray(low).view(np.uint8).reshape(n, 4)
    out[begin + 4], out[begin + 5] = width, n_over
    for w in np.unique(width[width > 0]).tolist():
        some = np.flatnonzero(width == w)
        out[begin[some][:, None] + (6 + np.arange(SIZE // 8 * w))] = pack_width(values[some], w)
    block, slot = np.nonzero(over)
    rank = np.arange(len(block)) - (np.cumsum(n_over) - n_over)[block]
    tail = begin[block] + 6 + SIZE // 8 * width[block]
    out[tail + rank] = slot
    out[(tail + n_over[block] + 4 * rank)[:, None] + np.arange(4)] = np.ascontiguousarray(values[block, slot]).view(np.uint8).reshape(-1, 4)
    bounds = starts[first]
    return out, bounds, begin - np.repeat(bounds[:-1], blocks)


def decode_block(payload: bytes, start: int) -> np.ndarray:
    """The SIZE ids of the block that starts there."""
    low, width, n_over = int.from_bytes(payload[start : start + 4], "little"), payload[start + 4], payload[start + 5]
    at = start + 6 + SIZE // 8 * width
    bits = np.unpackbits(np.frombuffer(payload, np.uint8, SIZE // 8 * width, start + 6), bitorder="little")
    values = (bits.reshape(SIZE, width).astype(np.int64) << np.arange(width)).sum(axis=1) if width else np.zeros(SIZE, np.int64)
    places = np.frombuffer(payload, np.uint8, n_over, at)
    values[places] = np.frombuffer(payload, np.dtype("<u4"), n_over, at + n_over)
    return values + low


def decode(payload: bytes, starts: list[int], n_tokens: int) -> np.ndarray:
    """A document's ids."""
    blocks = [decode_block(payload, s) for s in starts]
    return np.concatenate(blocks)[:n_tokens] if blocks else np.zeros(0, np.int64)


def token_blocks(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, block_starts and payload of each row."""
    held = vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(held)
        for batch in K.pieces(batches, 1):
            each = [tokens(t) for t in batch.column(1).to_pylist()]
            counts = np.array([len(x) for x in each], np.int64)
            data, bounds, starts = encode(np.concatenate(each), counts)
            blocks = np.concatenate(([0], np.cumsum(-(-counts // SIZE))))
            payload = pa.Array.from_buffers(pa.binary(), len(each), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])
            index = pa.ListArray.from_arrays(pa.array(blocks.astype(np.int32)), pa.array(starts.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), index, payload], ["doc_id", "n_tokens", "block_starts", "payload"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, block_starts array<int>, payload binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks(table(spark, sf_dir, "documents"))
