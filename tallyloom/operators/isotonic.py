"""Isotonic fits for all groups at once, by pooling that merges.

Points lie in ranges of (group, score).  Each range pools its own adjacent violators; pooling the blocks of neighbouring ranges
again, in order, gives the fit of their union, so only blocks meet per group and none on the driver.  A fitted
block reaches the ranges between its first score and the next block's, so prediction is an equi-join on (group, range) with a
search inside it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import importable
from .ranking import RANGE, range_partition


def pool(n: np.ndarray, pos: np.ndarray) -> list[tuple[int, int, float, float]]:
    """Adjacent violators of rates ``pos / n`` pooled: (first, last, rows, positives) of each block, rates not falling."""
    out: list[tuple[int, int, float, float]] = []
    for k, (rows, hits) in enumerate(zip(n.tolist(), pos.tolist())):
        first = k
        while out and out[-1][3] * rows > hits * out[-1][2]:  # whole numbers, so equal rates are seen as equal
            first, _, more, others = out.pop()
            rows, hits = rows + more, hits + others
        out.append((first, k, rows, hits))
    return out


def _schema(df: DataFrame, by: list[str], rest: str) -> str:
    return "".join(f"`{n}` {t}, " for n, t in df.select(*by).dtypes) + rest


_BLOCK = "lo double, hi double, n double, pos double, first_range int, last_range int"


def _pooled(df: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """Pool blocks or points (lo, hi, n, pos, first_range, last_range) of each group of ``keys``."""

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column("lo").to_numpy(), kind="stable")))
        found = pool(table.column("n").to_numpy(), table.column("pos").to_numpy())
        first, last = [f for f, *_ in found], [k for _, k, *_ in found]
        cols = {k: table.column(k).take(pa.array(first)) for k in by}
        cols |= {"lo": table.column("lo").take(pa.array(first)), "hi": table.column("hi").take(pa.array(last)), "n": pa.array([f[2] for f in found]), "pos": pa.array([f[3] for f in found]),
                 "first_range": table.column("first_range").take(pa.array(first)), "last_range": table.column("last_range").take(pa.array(last))}
        return pa.table(cols)

    return df.groupBy(*keys).applyInArrow(run, _schema(df, by, _BLOCK))


def fit(points: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """The points with their ranges, and the blocks of each group: first and last score, rows, positives, value and the next block's.

    ``points`` holds one row per group and score ``pd`` with rows ``n`` and positives ``pos``; a point with n = 0 is only predicted.
    """
    importable(points.sparkSession)
    ranged = range_partition(points.select(*by, "pd", F.col("n").cast("double").alias("n"), F.col("pos").cast("double").alias("pos")), [*by, "pd"])
    rows = ranged.where("n > 0").select(*by, F.col("pd").alias("lo"), F.col("pd").alias("hi"), "n", "pos", F.col(RANGE).alias("first_range"), F.col(RANGE).alias("last_range"))
    local = _pooled(rows, [*by], [*by, "first_range"])
    merged = _pooled(local, by, by)
    after = Window.partitionBy(*by).orderBy("lo")  # one row a block
    value = F.col("pos") / F.col("n")
    blocks = merged.select(*by, "lo", "hi", "n", "pos", value.alias("value"), "first_range", F.lead("lo").over(after).alias("next_lo"),
                           F.lead(value).over(after).alias("next_value"), F.lead("first_range").over(after).alias("next_range"), F.row_number().over(after).alias("number"))
    return ranged, blocks


def predict(ranged: DataFrame, blocks: DataFrame, by: list[str]) -> DataFrame:
    """(group, pd, iso) of every point: a block's value inside it, a straight line to the next block, the end values outside."""
    ends = ranged.groupBy(*by).agg(F.min(RANGE).alias("least"), F.max(RANGE).alias("most"))
    first = F.when(F.col("number") == 1, F.col("least")).otherwise(F.col("first_range"))
    reach = blocks.join(ends, by).withColumn(RANGE, F.explode(F.sequence(first, F.coalesce("next_range", "most"))))
    reach = reach.select(*by, RANGE, "lo", "hi", "value", "next_lo", "next_value")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        x = left.column("pd").to_numpy()
        order = np.argsort(right.column("lo").to_numpy())
        lo, hi, v, nx, nv = (right.column(c).to_numpy()[order] for c in ("lo", "hi", "value", "next_lo", "next_value"))
        if not len(lo):
            return pa.table({**{k: left.column(k) for k in by}, "pd": left.column("pd"), "iso": pa.array(np.full(len(x), np.nan))})
        k = np.maximum(np.searchsorted(lo, x, "right") - 1, 0)
        with np.errstate(invalid="ignore"):
            between = v[k] + (nv[k] - v[k]) * (x - hi[k]) / (nx[k] - hi[k])
        iso = np.where((x > hi[k]) & ~np.isnan(nx[k]), between, v[k])
        return pa.table({**{c: left.column(c) for c in by}, "pd": left.column("pd"), "iso": pa.array(iso)})

    keys = [*by, RANGE]
    points = ranged.select(*keys, "pd")
    return points.groupBy(*keys).cogroup(reach.groupBy(*keys)).applyInArrow(run, _schema(points, by, "pd double, iso double"))


def valid(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Per group: scores strictly grow, values do not fall and lie in [0, 1]; first and last score and value."""
    sound = (F.col("lo") <= F.col("hi")) & F.col("value").between(0.0, 1.0) & (F.col("next_lo").isNull() | ((F.col("hi") < F.col("next_lo")) & (F.col("value") <= F.col("next_value"))))
    return blocks.groupBy(*by).agg(F.bool_and(sound).alias("valid"), F.min("lo").alias("x_min"), F.max("hi").alias("x_max"), F.min("value").alias("value_min"), F.max("value").alias("value_max"))
