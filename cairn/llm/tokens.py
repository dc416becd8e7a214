"""Byte-level BPE token ids with a public vocabulary file, whose path is a parameter."""

from __future__ import annotations

import base64

import numpy as np
from pyspark import Broadcast
from pyspark.sql import SparkSession

_made: dict[tuple[int, str], object] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def vocabulary(spark: SparkSession, path: str | None = None) -> Broadcast:
    """(file contents, split pattern), read on the driver; about 1 MB, whatever the corpus."""
    import public_tokenizers

    with open(path or default_vocabulary(), "rb") as f:
        return spark.sparkContext.broadcast((f.read(), public_tokenizers.PATTERN))


class Encoder:
    """Token ids of a text as ordinary text, without special tokens."""

    def __init__(self, contents: bytes, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, contents.splitlines())}
        self.inner = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        return self.inner.encode_to_numpy(text, disallowed_special=())

    def count(self, text: str | None) -> int:
        return len(self(text))


def encoder(held: Broadcast) -> Encoder:
    """One encoder a Python worker."""
    contents, pattern = held.value
    key = (hash(contents), pattern)
    if key not in _made:
        _made[key] = Encoder(contents, pattern)
    return _made[key]
