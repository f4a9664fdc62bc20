"""SimHash near duplicates by a binary trie self-join with a Hamming error budget.

Distinct fingerprints are keyed by each of their four 16-bit blocks: two fingerprints that differ in at most three bits
agree in one block, so every link meets under one key, with an error budget of 0 in the key's levels of the trie.  Below
the key a task traverses node pairs together: a pair of nodes splits into pairs of children, differing bits are added up,
and a pair over the budget is dropped.  A key with very many fingerprints is split once more by the four 12-bit blocks of
the remaining 48 bits, by the same argument.  A task returns a spanning forest of the links it found, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import common
from .components import components, unite

SEED, SHINGLE, BUDGET = 42, 3, 3
#: Fingerprints under one key above which the key is split.
SPLIT = 2048
#: Node pairs handled in one vectorised step.
FRONT = 1 << 18


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 majority bits over the XXH64 of all word shingles; zero without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return digest(b" ".join(words), seed)
    grams = map(b" ".join, zip(*[words[k:] for k in range(shingle)]))
    h = np.fromiter((digest(g, seed) for g in grams), np.uint64, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        part = h[at:at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): one 64-bit fingerprint per row; a null text is an empty one and has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.steps(batches, "text"):
            fp = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(fp.view(np.int64))], ["key", "fp"])

    kind = docs.select(key).dtypes[0][1]
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, fp bigint").withColumnRenamed("key", key)


def trie_pairs(values: np.ndarray, groups: np.ndarray, budget: int = BUDGET, bits: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of one group whose values differ in at most ``budget`` bits, by node pair traversal.

    ``values`` is sorted within each group; ``groups`` holds the groups' borders.  A node is a run of values with a common
    prefix; a node pair carries the bits in which the two prefixes differ.
    """
    below = np.zeros(len(values) + 1, np.int64)
    todo = [(groups[:-1], groups[1:], groups[:-1], groups[1:], np.zeros(len(groups) - 1, np.int64), bits - 1)]
    while todo:
        ul, uh, vl, vh, err, bit = todo.pop()
        if len(ul) > FRONT:
            for at in range(0, len(ul), FRONT):
                todo.append((*[x[at:at + FRONT] for x in (ul, uh, vl, vh, err)], bit))
            continue
        same = ul == vl
        small = ((uh - ul) * (vh - vl) <= 64) | (bit < 0)
        if small.any():
            yield from _leaf_pairs(values, *[x[small] for x in (ul, uh, vl, vh)], budget)
        ul, uh, vl, vh, err, same = (x[~small] for x in (ul, uh, vl, vh, err, same))
        if not len(ul):
            continue
        np.cumsum((values >> np.uint64(bit)) & np.uint64(1), out=below[1:])
        um, vm = uh - (below[uh] - below[ul]), vh - (below[vh] - below[vl])
        parts = [(ul, um, vl, vm, err), (um, uh, vm, vh, err), (ul, um, vm, vh, err + 1), (um[~same], uh[~same], vl[~same], vm[~same], err[~same] + 1)]
        kids = [np.concatenate(x) for x in zip(*parts)]
        keep = (kids[0] < kids[1]) & (kids[2] < kids[3]) & (kids[4] <= budget)
        todo.append((*[x[keep] for x in kids], bit - 1))


def _leaf_pairs(values, ul, uh, vl, vh, budget) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Compare every value of u with every value of v, in bounded steps."""
    size = (uh - ul) * (vh - vl)
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (FRONT << 2), "right")))
        n, first = size[at:to], np.repeat(np.arange(at, to), size[at:to])
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide = (vh - vl)[first]
        i, j = ul[first] + k // wide, vl[first] + k % wide
        ok = i < j
        i, j = i[ok], j[ok]
        ok = np.bitwise_count(values[i] ^ values[j]) <= budget
        if ok.any():
            yield i[ok], j[ok]
        at = to


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect exactly those within the error budget.

    ``fps`` holds distinct values in column fp.
    """
    block = [F.expr(f"shiftrightunsigned(fp, {16 * k}) & 65535L") for k in range(4)]
    keyed = fps.select("fp", F.posexplode(F.array(*block)).alias("j", "v"))
    crowded = keyed.groupBy("j", "v").count().where(F.col("count") > SPLIT).select("j", "v", F.lit(True).alias("hot"))
    rest = F.expr("CASE j WHEN 0 THEN shiftrightunsigned(fp, 16) WHEN 1 THEN (shiftrightunsigned(fp, 32) << 16) | (fp & 65535L) "
                  "WHEN 2 THEN (shiftrightunsigned(fp, 48) << 32) | (fp & 4294967295L) ELSE fp & 281474976710655L END")
    marked = keyed.join(crowded, ["j", "v"], "left").withColumn("rest", rest)
    inner = F.when(F.col("hot"), F.array(*[F.expr(f"{k}L * 4096 + (shiftrightunsigned(rest, {12 * k}) & 4095L)") for k in range(4)])).otherwise(F.array(F.lit(-1).cast("bigint")))
    split = marked.select("fp", "j", "v", F.explode(inner).alias("w")).select("fp", ((F.col("w") + 1) * 262144 + F.col("j") * 65536 + F.col("v")).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        fp = np.concatenate([b.column("fp").to_numpy() for b in held]).view(np.uint64)
        key = np.concatenate([b.column("key").to_numpy() for b in held])
        order = np.lexsort((fp, key))
        fp, key = fp[order], key[order]
        borders = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        # the rows of one value under several keys are one node of the forest
        names, node = np.unique(fp, return_inverse=True)
        root = np.arange(len(names))
        for i, j in trie_pairs(fp, borders):
            unite(root, node[i], node[j])
        linked = np.flatnonzero(root != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([pa.array(names[linked].view(np.int64)), pa.array(names[root[linked]].view(np.int64))], ["a", "b"])

    return split.repartition("key").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, fingerprint (16 lowercase hex digits), component_id (smallest key reachable by links).

    A null text is an empty one; documents without words share fingerprint zero, which links like any other.  Rows of one
    key are one document.  A null key is kept as a row and never names a component; a component of null keys only has a
    null id.  An empty table gives an empty result; other columns are not looked at.
    """
    each = common.stored(fingerprints(docs, key, text).withColumnRenamed(key, "key"), "fingerprints")
    heads = common.stored(each.groupBy("fp").agg(F.min("key").alias("head")), "fingerprint-heads")
    roots = components(links(heads.select("fp")))
    tied = heads.join(roots, heads.fp == roots.node, "left").select("fp", "head", F.coalesce("root", "fp").alias("root"))
    least = tied.groupBy("root").agg(F.min("head").alias("component_id"))
    named = tied.join(least, "root").select("fp", "component_id")
    return each.join(named, "fp").select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
