"""Benchmark contamination by a positional inverted index of the training words.

The index is cut by documents: a shard is a run of whole documents with consecutive word positions and a gap between two
documents.  For each term a shard stores the sorted positions as compressed differences, so any test set can be looked up
later.  A phrase is found by taking its terms from the rarest in the shard, shifting each position list by the term's offset
and intersecting; what is left are exact occurrences.  Proximity asks for all terms within a span.  No shard depends on
another, so a term that is in every document is only as long as a shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path
from . import common

#: Consecutive words of a window; words hit per word from which a document is contaminated (1 / 20).
WINDOW, SHARE = 13, 20
#: Bytes of text in a shard; positions left free between two documents.
SHARD_BYTES, GAP = 8 << 20, 64

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Maximal runs of digits, letters and anything beyond ASCII, with A-Z in lower case."""
    return (text or "").encode().translate(_TABLE).split(b" ")


def split(text: str | None) -> list[bytes]:
    return [w for w in words(text) if w]


# --- index --------------------------------------------------------------------------------------------------------

_SHARD = "shard bigint, keys array<{key}>, starts array<bigint>, n_words array<bigint>, terms binary, term_sizes binary, counts binary, postings binary"


def build(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text") -> None:
    """Write the shards of the index.  A null text has no words; null and repeated keys are kept row by row."""
    kind = docs.select(key).dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        press = zstandard.ZstdCompressor(level=1)
        keys, lengths, flat, size = [], [], [], 0

        def emit(key_type):
            nonlocal keys, lengths, flat, size, number
            vocabulary: dict[bytes, int] = {}
            ids, n_words = [], []
            for doc in flat:
                own = [vocabulary.setdefault(w, len(vocabulary)) for w in doc if w]
                ids.append(np.array(own, np.int32))
                n_words.append(len(own))
            count = np.array(n_words, np.int64)
            starts = np.cumsum(count + GAP) - count - GAP
            term = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            place = np.arange(len(term)) + np.repeat(starts - (np.cumsum(count) - count), count)
            order = np.argsort(term, kind="stable")
            post = place[order]
            per = np.bincount(term, minlength=len(vocabulary))
            gaps = np.diff(post, prepend=0)
            first = np.cumsum(per) - per
            gaps[first[per > 0]] = post[first[per > 0]]  # each list starts anew
            names = list(vocabulary)
            sizes = np.fromiter(map(len, names), np.int32, len(names))
            row = [[(part << 33) + number], [keys], [starts], [count], [press.compress(b"".join(names))], [press.compress(sizes.tobytes())], [press.compress(per.astype(np.int32).tobytes())],
                   [press.compress(np.ascontiguousarray(gaps.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())]]
            types = [pa.int64(), pa.list_(key_type), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.binary()] * 4]
            keys, lengths, flat, size = [], [], [], 0
            number += 1
            return pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(row, types)], ["shard", "keys", "starts", "n_words", "terms", "term_sizes", "counts", "postings"])

        key_type = None
        for b in common.steps(batches, "text"):
            key_type = b.schema.field("key").type
            for k, t in zip(b.column("key").to_pylist(), b.column("text").to_pylist()):
                keys.append(k)
                flat.append(words(t))
                size += len(t or "")
                if size >= SHARD_BYTES:
                    yield emit(key_type)
        if keys:
            yield emit(key_type)

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    rows.mapInArrow(run, _SHARD.replace("{key}", kind)).write.option("compression", "none").parquet(folder)


class Shard:
    """One shard read back: position lists by term, documents by position."""

    def __init__(self, row: dict):
        press = zstandard.ZstdDecompressor()
        load = lambda name, kind: np.frombuffer(press.decompress(row[name]), kind)
        self.keys, self.starts, self.n_words = row["keys"], np.array(row["starts"], np.int64), np.array(row["n_words"], np.int64)
        names, sizes = press.decompress(row["terms"]), load("term_sizes", np.int32)
        ends = np.cumsum(sizes)
        self.id = {names[b - n:b]: k for k, (b, n) in enumerate(zip(ends.tolist(), sizes.tolist()))}
        self.count = load("counts", np.int32)
        self.first = np.cumsum(self.count, dtype=np.int64) - self.count
        self.gaps = np.ascontiguousarray(load("postings", np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)
        self._lists: dict[int, np.ndarray] = {}

    def positions(self, term: int) -> np.ndarray:
        got = self._lists.get(term)
        if got is None:
            a = self.first[term]
            got = self._lists[term] = np.cumsum(self.gaps[a:a + self.count[term]], dtype=np.int64)
        return got

    def phrase(self, terms: list[bytes]) -> np.ndarray:
        """Positions at which the words stand one after another."""
        ids = [self.id.get(t, -1) for t in terms]
        if not ids or min(ids) < 0:
            return np.zeros(0, np.int64)
        order = sorted(range(len(ids)), key=lambda k: self.count[ids[k]])
        at = self.positions(ids[order[0]]) - order[0]
        for k in order[1:]:
            own = self.positions(ids[k])
            found = np.searchsorted(own, at + k)
            at = at[(found < len(own)) & (own[np.minimum(found, len(own) - 1)] == at + k)]
            if not len(at):
                break
        return at

    def near(self, terms: list[bytes], span: int) -> np.ndarray:
        """Positions of the rarest term around which every other term stands within ``span`` words, in one document."""
        ids = [self.id.get(t, -1) for t in terms]
        if not ids or min(ids) < 0:
            return np.zeros(0, np.int64)
        ids.sort(key=lambda k: self.count[k])
        at = self.positions(ids[0])
        doc = np.searchsorted(self.starts, at, "right") - 1
        lo, hi = np.maximum(at - span, self.starts[doc]), np.minimum(at + span, self.starts[doc] + self.n_words[doc] - 1)
        ok = np.ones(len(at), bool)
        for k in ids[1:]:
            own = self.positions(k)
            ok &= np.searchsorted(own, lo) < np.searchsorted(own, hi, "right")
        return at[ok]

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1


# --- contamination ------------------------------------------------------------------------------------------------

def windows(item: list[bytes], width: int = WINDOW) -> list[tuple[bytes, ...]]:
    return [tuple(item[k:k + width]) for k in range(max(1, len(item) - width + 1))] if item else []


def find_windows(shard: Shard, wanted: dict[tuple[bytes, ...], list[int]]) -> Iterator[tuple[tuple[bytes, ...], np.ndarray]]:
    """Windows of the shard with their positions.  A window whose terms are not all in the shard costs a few lookups."""
    for window in wanted:
        at = shard.phrase(window)
        if len(at):
            yield window, at


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", share: int = SHARE) -> DataFrame:
    """Per document: key, n_words, n_hit, n_items, items_sha256, contaminated.

    The test windows go to every task in blocks of items of bounded text; the index is read once per block.  Null texts and
    items without words have no windows; repeated rows are rows of their own; repeated item ids count once.  A document is
    contaminated if words of it are hit and they are one in ``share`` at least.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "positional-index")
    build(docs, folder, key, text)
    hits = None
    for block in item_blocks(benchmark, item, item_text):
        got = look_up(spark, folder, block)
        hits = got if hits is None else hits.unionByName(got)
    if hits is None:
        hits = look_up(spark, folder, [])
    return summary(hits, key, share)


#: Bytes of item texts that go to the tasks at once.
BLOCK_BYTES = 8 << 20


def item_blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[str, str]]]:
    """Item ids as strings and texts, in blocks of bounded bytes."""
    held, size = [], 0
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    for r in rows.toLocalIterator():
        held.append((r["item"], r["text"]))
        size += len(r["text"])
        if size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def look_up(spark: SparkSession, folder: str, items: list[tuple[str, str]]) -> DataFrame:
    """(shard, doc, key, n_words, items, runs) of every document: the ids of its items and its hit runs of words."""
    shards = spark.read.parquet(folder)
    kind = shards.dtypes[1][1][6:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, wanted = [i for i, _ in items], {}
        for n, (_, t) in enumerate(items):
            for w in windows(split(t)):
                wanted.setdefault(w, []).append(n)
        for b in batches:
            key_type = b.schema.field("keys").type.value_type
            for row in b.to_pylist():
                shard = Shard(row)
                found: list[set[str]] = [set() for _ in shard.keys]
                edge = np.zeros(int(shard.starts[-1] + shard.n_words[-1]) + 2 if len(shard.keys) else 1, np.int32)
                for window, at in find_windows(shard, wanted):
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + len(window), -1)
                    ids = {names[n] for n in wanted[window] if names[n] is not None}
                    for d in np.unique(shard.document(at)).tolist():
                        found[d] |= ids
                hit = np.cumsum(edge) > 0
                change = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0))
                first, last = change[::2], change[1::2]
                owner = shard.document(first)
                bounds = np.searchsorted(owner, np.arange(len(shard.keys) + 1))
                runs = [[{"at": int(first[k] - shard.starts[d]), "n": int(last[k] - first[k])} for k in range(bounds[d], bounds[d + 1])] for d in range(len(shard.keys))]
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["shard"]] * len(shard.keys), pa.int64()), pa.array(range(len(shard.keys)), pa.int64()), pa.array(shard.keys, key_type), pa.array(shard.n_words, pa.int64()),
                    pa.array([sorted(f) for f in found], pa.list_(pa.string())), pa.array(runs, pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())])))], ["shard", "doc", "key", "n_words", "items", "runs"])

    return shards.mapInArrow(run, f"shard bigint, doc bigint, key {kind}, n_words bigint, items array<string>, runs array<struct<at:bigint,n:bigint>>")


def _merged_length(runs: F.Column) -> F.Column:
    """Words covered by runs that may overlap, in order of their start."""
    step = lambda acc, r: F.struct(
        (acc["total"] + F.greatest(F.lit(0).cast("bigint"), r["at"] + r["n"] - F.greatest(acc["end"], r["at"]))).alias("total"), F.greatest(acc["end"], r["at"] + r["n"]).alias("end"))
    zero = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("end"))
    return F.aggregate(F.array_sort(runs), zero, step)["total"]


def summary(hits: DataFrame, key: str, share: int = SHARE) -> DataFrame:
    """Merge the blocks of items: one row per document."""
    per = hits.groupBy("shard", "doc").agg(
        F.first("key").alias("key"), F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("runs")).alias("runs"))
    per = per.withColumn("n_hit", _merged_length(F.col("runs")))
    return per.select(F.col("key").alias(key), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                      ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def matches(docs_folder: str, spark: SparkSession, phrases: list[str], span: int | None = None) -> DataFrame:
    """(key, phrase, at): exact phrase matches in a stored index, or with ``span`` places of the rarest term with all terms near."""
    shards = spark.read.parquet(docs_folder)
    kind = shards.dtypes[1][1][6:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key_type = b.schema.field("keys").type.value_type
            for row in b.to_pylist():
                shard = Shard(row)
                for p in phrases:
                    at = shard.phrase(split(p)) if span is None else shard.near(split(p), span)
                    doc = shard.document(at)
                    yield pa.RecordBatch.from_arrays([pa.array([shard.keys[d] for d in doc.tolist()], key_type), pa.array([p] * len(at), pa.string()), pa.array(at - shard.starts[doc], pa.int64())], ["key", "phrase", "at"])

    return shards.mapInArrow(run, f"key {kind}, phrase string, at bigint")
