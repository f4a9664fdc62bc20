"""Global order, prefix sums and exact quantiles without a single-task window.

A window without a partition moves every row to one task.  Here the rows are range
partitioned on the full order (score *and* key, so a block of equal scores can be cut),
the range id is frozen in a checkpoint, and a second table of one row per range carries
the offsets.  Row numbers and running sums inside a range are ordinary windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import freeze, stored

RANGE = "__range"
#: Rows of a range, so that what a task sorts does not grow with the table.
RANGE_ROWS = 500_000
#: Offsets beyond this number of (group, range) rows are not broadcast.
BROADCAST_OFFSETS = 100_000


def more_parts(spark: SparkSession, rows: int | None) -> int | None:
    """Partitions of at most ``RANGE_ROWS`` rows, where the session's own number would hold more."""
    parts = -(-(rows or 0) // RANGE_ROWS)
    return parts if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def range_partition(df: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """Tag each row with the id of its slice of the total order."""
    ranged = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    return stored(ranged.withColumn(RANGE, F.spark_partition_id()), "ranges")


def _offsets(ranged: DataFrame, by: list[str], sums: dict[str, Column]) -> DataFrame:
    """One row per (group, range): totals before the range and of the whole group."""
    per = ranged.groupBy(*by, RANGE).agg(
        F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(f"__s_{k}") for k, c in sums.items()]
    )
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = w.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    cols = [F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(w).alias("__total")]
    cols += [F.col(f"__s_{k}").alias(f"__here_{k}") for k in sums]
    for k in sums:
        cols.append(F.coalesce(F.sum(f"__s_{k}").over(before), F.lit(0)).alias(f"__b_{k}"))
        cols.append(F.sum(f"__s_{k}").over(w).alias(f"__t_{k}"))
    return per.select(*by, RANGE, *cols)


def running(
    df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column] | None = None, totals: bool = False, rows: int | None = None
) -> DataFrame:
    """Add ``rn``, ``n_rows`` and the running sums ``<name>`` of ``sums`` along ``order``.

    ``order`` must end in a key that makes it total.  With ``totals`` the group sum of
    every running column is added as ``<name>_total``.  Where ``rows`` tells the number of
    rows, a large table is cut into more and smaller ranges.
    """
    sums = sums or {}
    parts = more_parts(df.sparkSession, rows)
    ranged = range_partition(df, by + order, parts)
    offsets = _offsets(ranged, by, sums)
    if parts:
        ranged, offsets = ranged.repartition(parts, *by, RANGE), freeze(offsets)
        offsets = F.broadcast(offsets) if offsets.count() <= BROADCAST_OFFSETS else offsets
    w = Window.partitionBy(*by, RANGE).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.withColumns(
        {"__rn": F.row_number().over(w), **{f"__l_{k}": F.sum(c).over(upto) for k, c in sums.items()}}
    )
    joined = local.join(offsets, by + [RANGE])
    out = [F.col(c) for c in df.columns]
    out += [(F.col("__before") + F.col("__rn")).alias("rn"), F.col("__total").alias("n_rows")]
    for k in sums:
        out.append((F.col(f"__b_{k}") + F.col(f"__l_{k}")).alias(k))
        if totals:
            out.append(F.col(f"__t_{k}").alias(f"{k}_total"))
    return joined.select(*out)


def risk_percentile(rn: Column, n: Column) -> Column:
    return F.when(n <= 1, F.lit(0.0)).otherwise((rn - 1) / (n - 1))


def equal_count_bin(rn: Column, n: Column, bins: int) -> Column:
    """Bins by position; the remainder rule differs from ``ntile``."""
    return F.least(F.lit(bins), F.floor((rn - 1) * bins / n) + 1).cast("bigint")


def exact_quantiles(
    df: DataFrame, by: list[str], value: str, probs: dict[str, float], weight: str | None = None
) -> DataFrame:
    """Exact linear-interpolation quantiles per group, one row per group.

    ``weight`` names the frequency of rows that are already counted per value.
    """
    row = _neighbours(df, by, value, probs, weight)
    n = F.col("__n")
    return row.select(*by, *[interpolate(F.col(f"__lo_{k}"), F.col(f"__hi_{k}"), n, p).alias(k) for k, p in probs.items()])


def order_statistics(df: DataFrame, by: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Neighbouring order statistics ``<name>_lo`` and ``<name>_hi`` of each quantile, and ``n``.

    A monotone map of the values can be applied to them afterwards, so quantiles of several
    monotone transforms need one pass only.
    """
    row = _neighbours(df, by, value, probs, None)
    cols = [F.col(f"__{tag}_{k}").alias(f"{k}_{tag}") for k in probs for tag in ("lo", "hi")]
    return row.select(*by, F.col("__n").alias("n"), *cols)


def interpolate(lo: Column | float, hi: Column | float, n: Column | float, p: float):
    """Linear interpolation between neighbouring order statistics (columns only)."""
    pos = F.lit(p) * (n - 1)
    return lo + (hi - lo) * (pos - F.floor(pos))


SKETCH = 10_000  # a sketch of this accuracy misses a rank by at most one part in SKETCH
MARGIN = 3.0 / SKETCH
SKETCH_GROUPS = 100_000  # more groups than this are not broadcast and take the plain way


def _frequencies(df: DataFrame, by: list[str], value: str, weight: str | None) -> DataFrame:
    """(group, smallest and largest value, rows): here one row per value."""
    f = F.sum(weight) if weight else F.count(F.lit(1))
    return df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(f.alias("__f")).withColumn("__top", F.col("__v"))


def _compressed(df: DataFrame, by: list[str], value: str, probs: dict[str, float]) -> DataFrame | None:
    """Frequencies in which the values no wanted rank can be near are merged.

    A mergeable sketch brackets every wanted quantile per group.  Values inside a bracket
    keep their own row, the values between two brackets become a single row, so one
    aggregate with map-side combine replaces a shuffle of the column.  None when there are
    too many groups to send their brackets to every task.
    """
    ps = sorted(probs.values())
    edges = [max(0.0, p - MARGIN) for p in ps] + [min(1.0, p + MARGIN) for p in ps]
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"))
    sketch = freeze(rows.groupBy(*by).agg(F.percentile_approx("__v", edges, SKETCH).alias("__edges")))
    if sketch.count() > SKETCH_GROUPS:
        return None
    v = F.col("__v")
    inside, passed = F.lit(False), F.lit(0)
    for i in range(len(ps)):
        low, high = F.col("__edges")[i], F.col("__edges")[len(ps) + i]
        inside = inside | v.between(low, high)
        passed = passed + F.when(v > high, 1).otherwise(0)
    tagged = rows.join(F.broadcast(sketch), by).select(
        *by, "__v", F.when(inside, v).alias("__own"), F.when(~inside, passed).alias("__gap"))
    return tagged.groupBy(*by, "__own", "__gap").agg(F.min("__v").alias("__v"), F.max("__v").alias("__top"), F.count(F.lit(1)).alias("__f")).drop("__own", "__gap")


def _neighbours(df: DataFrame, by: list[str], value: str, probs: dict[str, float], weight: str | None) -> DataFrame:
    if not by:
        return _neighbours(df.withColumn("__all", F.lit(1)), ["__all"], value, probs, weight).drop("__all")
    merged = _compressed(df, by, value, probs) if weight is None else None
    if merged is not None:
        row = freeze(_pick(merged, by, probs))  # one row per group, read by the check and by the caller
        if row.where("__inexact").limit(1).count() == 0:
            return row.drop("__inexact")
    return _pick(_frequencies(df, by, value, weight), by, probs).drop("__inexact")


def _pick(freq: DataFrame, by: list[str], probs: dict[str, float]) -> DataFrame:
    """The values at the wanted ranks of a frequency table, found in ranges of its order.

    Only the ranges that hold a wanted rank are ranked, so neither a task nor the driver
    ever sees the whole table.  ``__inexact`` marks a rank that fell on a merged row.
    """
    ranged = range_partition(freq, by + ["__v"])
    n = F.col("__t_f")
    lows = {k: F.floor(F.lit(p) * (n - 1)) for k, p in probs.items()}
    highs = {k: F.ceil(F.lit(p) * (n - 1)) for k, p in probs.items()}
    wanted = F.array(*lows.values(), *highs.values())
    hit = F.exists(wanted, lambda r: (r >= F.col("__b_f")) & (r < F.col("__b_f") + F.col("__here_f")))
    spans = _offsets(ranged, by, {"f": F.col("__f")}).where(hit).select(*by, RANGE, "__b_f", "__t_f")
    w = Window.partitionBy(*by, RANGE).orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        ranged.join(spans, by + [RANGE])
        .withColumn("__end", F.col("__b_f") + F.sum("__f").over(w))
        .withColumn("__start", F.col("__end") - F.col("__f"))
    )
    holds = lambda rank: (rank >= F.col("__start")) & (rank < F.col("__end"))
    picks = [F.max("__t_f").alias("__n")]
    for k in probs:
        for tag, rank in (("lo", lows[k]), ("hi", highs[k])):
            picks.append(F.max(F.when(holds(rank), F.col("__v"))).alias(f"__{tag}_{k}"))
    merged = F.exists(wanted, holds) & (F.col("__v") < F.col("__top"))
    return placed.groupBy(*by).agg(*picks, F.bool_or(merged).alias("__inexact"))


# Names and levels of the quantile vectors in reports.
SEVEN = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def value_summary(df: DataFrame, by: list[str], value: str, probs: dict[str, float] | None = None, distinct: bool = True) -> DataFrame:
    """Count, distinct count, min, quantiles, max and mean of the non-NULL values per group.

    ``by`` must name at least one column.  Without ``distinct`` no shuffle of values is needed.
    """
    v = F.col(value)
    rows = df.where(v.isNotNull())
    aggs = [F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean")]
    out = rows.groupBy(*by).agg(*aggs, *([F.count_distinct(v).alias("distinct")] if distinct else []))
    return out.join(exact_quantiles(df, by, value, probs or SEVEN), by)


def summary_of_counts(
    counts: DataFrame, by: list[str], value: str, freq: str, probs: dict[str, float] | None = None
) -> DataFrame:
    """``value_summary`` of a table that already holds one row per (group, value)."""
    v, f = F.col(value), F.col(freq)
    moments = counts.groupBy(*by).agg(
        F.sum(f).alias("n"), F.count(F.lit(1)).alias("distinct"), F.min(v).alias("min"), F.max(v).alias("max"),
        (F.sum(v * f) / F.sum(f)).alias("mean"),
    )
    return moments.join(exact_quantiles(counts, by, value, probs or SEVEN, freq), by)


def bounded_quantiles(value: Column, probs: list[float], frequency: Column) -> Column:
    """Quantile array of a pre-counted column whose domain is bounded (days, row counts)."""
    return F.percentile(value, F.array(*[F.lit(p) for p in probs]), frequency)


def top_frequencies(df: DataFrame, field: str, n: int) -> DataFrame:
    """The ``n`` most frequent values with rank; ties go to the smaller value."""
    freq = df.where(F.col(field).isNotNull()).groupBy(field).agg(F.count(F.lit(1)).alias("row_count"))
    head = freq.orderBy(F.desc("row_count"), F.asc(field)).limit(n)
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("row_count"), F.asc(field))  # at most n rows
    return head.withColumn("rank", F.row_number().over(w).cast("bigint"))


def top_values(df: DataFrame, field: str, n: int) -> DataFrame:
    """Most frequent values with their share of all rows and of the non-missing rows."""
    totals = df.agg(F.count(F.lit(1)).alias("all"), F.count(field).alias("present")).first()  # two numbers
    pct = lambda d: F.round(F.try_divide(F.col("row_count") * 100.0, F.lit(d)), 6)
    return top_frequencies(df, field, n).select(
        F.lit(field).alias("candidate"), F.col(field).alias("value"), "row_count",
        pct(totals["all"]).alias("percentage_all"), pct(totals["present"]).alias("percentage_non_missing"), "rank")


def top_per_group(freq: DataFrame, by: list[str], field: str, count: str, n: int) -> DataFrame:
    """Top ``n`` of a frequency table per group; Spark prunes each map task to ``n`` rows."""
    w = Window.partitionBy(*by).orderBy(F.desc(count), F.asc(field))
    return freq.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).withColumn(
        "rank", F.col("rank").cast("bigint")
    )


def even_sample(df: DataFrame, order: str, points: int) -> DataFrame:
    """Rows at ``points`` evenly spaced positions of the order (first and last included)."""
    r = running(df, [], [order])
    last = F.col("n_rows") - 1
    step = last / F.lit(float(points - 1))
    pos = F.col("rn") - 1
    near = F.floor(pos / step)  # candidate index; its neighbours cover rounding of the division
    hit = F.lit(False)
    for shift in (-1, 0, 1):
        i = near + shift
        hit = hit | ((i >= 0) & (i < points) & (F.floor(i * step) == pos))
    return r.where(F.when(last <= points - 1, F.lit(True)).otherwise(hit)).withColumn("position", pos).drop("rn", "n_rows")
