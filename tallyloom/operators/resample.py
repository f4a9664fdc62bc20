"""Bootstrap draws by splitting counts: how many draws fall into each block of a class is drawn first, the rest next to the rows.

A replicate makes as many draws from a class as it has rows.  A binary tree over the class's blocks splits this number: at a
node, the draws that go left are binomial with the left side's share of positions, and are drawn exactly.  Then the draws of
a block pick positions inside it, so no row and no draw moves; the counts per (replicate, block) do, which are
``BLOCK_ROWS`` times fewer.

Random words are 32-bit hashes of (replicate, class, place in the tree, number), in arithmetic that SQL repeats.  A binomial
with share p compares the bits of all its trials with those of p at once: at a one, trials with bit zero are below p and
succeed, at a zero, trials with bit one are above and fail; the others go on to the next bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import importable

#: Rows of a block; bits of the share that a binomial looks at.
BLOCK_ROWS, BITS = 512, 64
WORD = 0xFFFFFFFF
# Odd factors of the word hash, of numbers in a row, and of places in the tree.
FACTORS, ROW, PLACE, INSIDE = (2146121005, 73244475), 2654435769, (2246822519, 3266489917), 668265263
CLASS = 1013904223


def mix(x: np.ndarray) -> np.ndarray:
    x = x & np.uint64(WORD)
    x = x ^ (x >> np.uint64(16))
    x = (x * np.uint64(FACTORS[0])) & np.uint64(WORD)
    x = x ^ (x >> np.uint64(15))
    x = (x * np.uint64(FACTORS[1])) & np.uint64(WORD)
    return x ^ (x >> np.uint64(16))


def stream(replicates: np.ndarray, label: int) -> np.ndarray:
    """The word that names a replicate's draws from a class."""
    return mix(((replicates * ROW) % (1 << 32) + (label * CLASS) % (1 << 32)).astype(np.uint64))


def words(seed: np.ndarray, number: np.ndarray) -> np.ndarray:
    return mix(seed ^ ((number * ROW) & WORD).astype(np.uint64))


def binomial(n: np.ndarray, part: int, whole: int, seed: np.ndarray) -> np.ndarray:
    """Successes among ``n`` trials with probability ``part / whole``, one number per seed."""
    left, done, used, rest = n.astype(np.int64), np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), part
    for _ in range(BITS):
        if not left.any():
            break
        rest *= 2
        one = rest >= whole
        rest -= whole * one
        count = (left + 31) // 32
        i = np.arange(int(count.max()))
        kept = np.clip(left[:, None] - 32 * i, 0, 32)
        zeros = np.bitwise_count(words(seed[:, None], used[:, None] + i) & ((np.uint64(1) << kept.astype(np.uint64)) - np.uint64(1))).sum(1).astype(np.int64)
        used += count
        done, left = (done + zeros, left - zeros) if one else (done, zeros)
    return done


def block_counts(replicates: np.ndarray, label: int, size: int, rows: int = BLOCK_ROWS) -> np.ndarray:
    """Draws per (replicate, block) from a class of ``size`` rows."""
    blocks = -(-size // rows)
    out, base = np.zeros((len(replicates), blocks), np.int64), stream(replicates, label)
    todo = [(0, blocks, np.full(len(replicates), size, np.int64))]
    while todo:
        lo, hi, n = todo.pop()
        if hi - lo == 1:
            out[:, lo] = n
            continue
        mid = (lo + hi) // 2
        seed = mix(base ^ np.uint64((lo * PLACE[0] + hi * PLACE[1]) & WORD))
        first = binomial(n, (mid - lo) * rows, min(hi * rows, size) - lo * rows, seed)
        todo += [(lo, mid, first), (mid, hi, n - first)]
    return out


def inside(replicates: np.ndarray, label: int, block: int, draws: np.ndarray, rows: int) -> np.ndarray:
    """How often each row of a block is drawn, per replicate."""
    seed = mix(stream(replicates, label) ^ np.uint64((block * PLACE[0] + INSIDE) & WORD))
    owner = np.repeat(np.arange(len(draws)), draws)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(draws) - draws, draws)
    place = ((words(seed[owner], number) * np.uint64(rows)) >> np.uint64(32)).astype(np.int64)
    return np.bincount(owner * rows + place, minlength=len(draws) * rows).reshape(len(draws), rows)


def drawn_blocks(spark: SparkSession, sizes: dict[int, int], replicates: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """(replicate_id, label, block, draws): replicates are shared out, each walks its tree."""
    importable(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for label, size in sizes.items():
                step = max(1, (1 << 20) // -(-size // rows))
                for at in range(0, len(ids), step):
                    part = ids[at:at + step]
                    n = block_counts(part, label, size, rows)
                    cells = n.size
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(part, n.shape[1])), pa.array(np.full(cells, label, np.int64)), pa.array(np.tile(np.arange(n.shape[1]), len(part))), pa.array(n.ravel())],
                        ["replicate_id", "label", "block", "draws"])

    return spark.range(replicates).mapInArrow(run, "replicate_id bigint, label bigint, block bigint, draws bigint")


_SHARE = 64  # replicates whose draws inside a block are held at once


def resample(placed: DataFrame, label: str, sizes: dict[int, int], replicates: int, values: list[str], counts: bool = False, rows: int = BLOCK_ROWS) -> DataFrame:
    """Sums of ``values`` over each replicate's draws, per block; with ``counts`` the drawn positions and how often instead.

    ``placed`` holds the label, the position inside its class and the values of every row.
    """
    spark = placed.sparkSession
    mine = placed.select(F.col(label).cast("bigint").alias("label"), "position", F.floor(F.col("position") / rows).alias("block"), *[F.col(v).cast("double").alias(v) for v in values])
    drawn = drawn_blocks(spark, sizes, replicates, rows)

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        name, block = int(key[0].as_py()), int(key[1].as_py())
        order = np.argsort(left.column("position").to_numpy())
        x = np.stack([left.column(v).to_numpy()[order] for v in values], 1) if values else None
        ids, n, found = right.column("replicate_id").to_numpy(), right.column("draws").to_numpy(), []
        for at in range(0, len(ids), _SHARE):
            hits = inside(ids[at:at + _SHARE], name, block, n[at:at + _SHARE], len(order))
            if counts:
                r, p = np.nonzero(hits)
                found.append((ids[at + r], p + block * rows, hits[r, p]))
            else:
                found.append(hits @ x)
        if counts:
            r, p, c = (np.concatenate(f) for f in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
            return pa.table({"replicate_id": r, "label": np.full(len(r), name, np.int64), "position": p, "draws": c})
        sums = np.concatenate(found) if found else np.zeros((0, len(values)))
        return pa.table({"replicate_id": ids, **{v: sums[:, k] for k, v in enumerate(values)}})

    schema = "replicate_id bigint, label bigint, position bigint, draws bigint" if counts else "replicate_id bigint, " + ", ".join(f"{v} double" for v in values)
    return mine.groupBy("label", "block").cogroup(drawn.groupBy("label", "block")).applyInArrow(run, schema)


# --- the same in SQL --------------------------------------------------------------------------------------------------

def mix_sql(x: str) -> str:
    a = f"xor({x}, ({x}) >> 16)"
    b = f"(({a} * {FACTORS[0]}) & {WORD})"
    c = f"xor({b}, ({b}) >> 15)"
    d = f"(({c} * {FACTORS[1]}) & {WORD})"
    return f"xor({d}, ({d}) >> 16)"


def draws_sql(rows_sql: str, label: str, key: str, replicates: int, rows: int = BLOCK_ROWS) -> str:
    """DuckDB statement of (r, label, position, c): the drawn positions of every replicate."""
    word = mix_sql(f"xor(q.seed, ((a.used + i) * {ROW}) & {WORD})")
    zeros = f"coalesce(list_sum(list_transform(range(0, (a.n + 31) // 32), lambda i: bit_count({word} & ((1::BIGINT << least(32, a.n - 32 * i)) - 1))))::BIGINT, 0)"
    # one step: the next bit of the share, then the trials that it decides
    step = (f"lambda a, z: {{'n': CASE WHEN 2 * a.rest >= q.whole THEN a.n - {zeros} ELSE {zeros} END, 'done': a.done + CASE WHEN 2 * a.rest >= q.whole THEN {zeros} ELSE 0 END, "
            f"'used': a.used + (a.n + 31) // 32, 'rest': 2 * a.rest - CASE WHEN 2 * a.rest >= q.whole THEN q.whole ELSE 0 END}}")
    start = "{'n': q.n, 'done': 0::BIGINT, 'used': 0::BIGINT, 'rest': q.part}"
    binomial = f"list_reduce(list_concat([{start}], list_transform(range({BITS}), lambda z: {start})), {step}).done"
    return f"""
WITH RECURSIVE cls AS (SELECT {label} AS label, count(*) AS m FROM ({rows_sql}) c GROUP BY 1),
node AS (SELECT r, label, m, {mix_sql("base")} AS base, 0::BIGINT AS lo, (m + {rows - 1}) // {rows} AS hi, m AS n
         FROM (SELECT r, label, m, (r * {ROW} % 4294967296 + label * {CLASS} % 4294967296) & {WORD} AS base FROM cls, range(0, {replicates}) t(r)) b
         UNION ALL
         SELECT r, label, m, base, CASE WHEN side = 0 THEN lo ELSE mid END, CASE WHEN side = 0 THEN mid ELSE hi END, CASE WHEN side = 0 THEN first ELSE n - first END
         FROM (SELECT q.*, {binomial} AS first FROM (SELECT *, (lo + hi) // 2 AS mid, ((lo + hi) // 2 - lo) * {rows} AS part, least(hi * {rows}, m) - lo * {rows} AS whole,
                      {mix_sql(f"xor(base, (lo * {PLACE[0]} + hi * {PLACE[1]}) & {WORD})")} AS seed FROM node WHERE hi - lo > 1) q) s, range(0, 2) u(side)),
leaf AS (SELECT r, label, lo, n, least({rows}, m - lo * {rows}) AS size, {mix_sql(f"xor(base, (lo * {PLACE[0]} + {INSIDE}) & {WORD})")} AS seed FROM node WHERE hi - lo = 1)
SELECT r, label, lo * {rows} + (({mix_sql(f"xor(seed, (i * {ROW}) & {WORD})")} * size) >> 32) AS position, count(*) AS c
FROM (SELECT r, label, lo, size, seed, unnest(range(0, n)) AS i FROM leaf) d GROUP BY ALL"""
