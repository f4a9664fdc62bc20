"""Byte-level BPE as a monoid: encode halves, join neighbours at a re-encoded boundary; decode by concatenation.

A token sequence is the encoding of its bytes exactly if every two neighbouring tokens are the encoding of their own
bytes: a first merge across a boundary would also happen in the pair alone.  So two encoded halves may be joined by
re-encoding a window of k tokens on each side, and the result is final as soon as the window's first and last tokens are
stable next to the untouched tokens outside; otherwise k doubles.  The product is associative, the empty sequence is its
unit.  Matches of the pretokenizer pattern never merge, so there the product is plain concatenation.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, functions as F

from . import common

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Bytes up to which a segment is a leaf of the tree, and up to which a boundary window's merges are remembered.
LEAF, SHORT = 5, 16
#: Tokens that one leaf of the decoding tree concatenates.
DECODE_LEAF = 4096


class TreeEncoder:
    """Encoder and decoder of one rank file; its caches are bounded and hold no state that changes a result."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = common.CACHE_ENTRIES):
        self.ranks, self.pattern, self.limit = ranks, regex.compile(pattern), cache
        self.tokens = {v: k for k, v in ranks.items()}
        self._short: dict[bytes, tuple[int, ...]] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._after: dict[str, bytes] = {}

    def merge(self, data: bytes) -> tuple[int, ...]:
        """The merges in order of rank, leftmost first."""
        ranks, parts = self.ranks, [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = at = None
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return tuple([ranks[p] for p in parts])

    def direct(self, data: bytes) -> tuple[int, ...]:
        """The merges of a short byte string, remembered."""
        got = self._short.get(data)
        if got is None:
            if len(self._short) >= self.limit:
                self._short.clear()
            got = self._short[data] = self.merge(data)
        return got

    def stable(self, left: int, right: int) -> bool:
        """Whether the two tokens side by side are the encoding of their bytes."""
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) >= self.limit:
                self._pairs.clear()
            known = self._pairs[left, right] = self.merge(self.tokens[left] + self.tokens[right]) == (left, right)
        return known

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The monoid's product: the encoding of the bytes of both."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        k, tokens, stable = 1, self.tokens, self.stable
        while True:
            lo, hi = max(0, len(left) - k), min(k, len(right))
            window = b"".join([tokens[t] for t in left[lo:] + right[:hi]])
            mid = self.direct(window) if len(window) <= SHORT else self.merge(window)
            if (lo == 0 or stable(left[lo - 1], mid[0])) and (hi == len(right) or stable(mid[-1], right[hi])):
                return left[:lo] + mid + right[hi:]
            k *= 2

    def segment(self, data: bytes) -> tuple[int, ...]:
        """Tokens of a byte string by halves."""
        if len(data) <= LEAF:
            return self._short.get(data) or self.direct(data)
        half = len(data) // 2
        return self.join(self.segment(data[:half]), self.segment(data[half:]))

    def match(self, piece: str) -> tuple[int, ...]:
        """Tokens of one match of the pattern; a match that is itself a vocabulary entry is that entry."""
        data = piece.encode()
        whole = self.ranks.get(data)
        return (whole,) if whole is not None else self.segment(data)

    def encode(self, text: str) -> np.ndarray:
        """Token ids of a whole text as 32-bit integers."""
        first, *rest = common.chunks(text)
        out = [self._tokens(first), *map(self._after.get, rest)]  # known chunks behind a space
        if None in out:
            for k, ids in enumerate(out):
                if ids is None:
                    c = rest[k - 1]
                    out[k] = self._after.get(c) or self._learn(c)
        return np.frombuffer(b"".join(out), np.int32)

    def _tokens(self, text: str) -> bytes:
        return np.array([t for m in self.pattern.findall(text) for t in self.match(m)], np.int32).tobytes()

    def _learn(self, chunk: str) -> bytes:
        ids = self._tokens(" " + chunk)
        if len(chunk) <= 64:
            if len(self._after) >= self.limit:
                self._after.clear()
            self._after[chunk] = ids
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a token sequence, concatenated up the tree."""
        if len(ids) <= DECODE_LEAF:
            return b"".join(map(self.tokens.__getitem__, ids.tolist()))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> TreeEncoder:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return TreeEncoder(ranks, pattern)


def encode_decode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Per row: the key, ``ids`` array<int> of the whole text and ``decoded`` binary of those ids.

    A null text is an empty one: no ids, no bytes.  Null and repeated keys are kept row by row, other columns are not
    looked at, an empty table gives an empty result.  A map without a shuffle: rows are independent.
    """
    path = path or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in common.steps(batches, "text"):
            got = [enc.encode(t or "") for t in b.column("text").to_pylist()]
            ids = common.lists(np.concatenate(got), np.array([len(g) for g in got]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("key"), ids, pa.array([enc.decode(g) for g in got], pa.binary())], ["key", "ids", "decoded"])

    kind = docs.select(key).dtypes[0][1]
    out = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, ids array<int>, decoded binary")
    return out.withColumnRenamed("key", key)


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Token count and the sha256 of the comma-joined decimal ids and of the decoded bytes."""
    return encoded.select(
        key, F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
