"""Audits of a materialised feature table."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .audit import blocks, union_all
from .longform import count_where, ratio
from .history import LEVELS
from .ranking import exact_quantiles, top_per_group, value_summary


def stack_columns(df: DataFrame, keep: list[str], columns: list[str], name: str = "feature_name") -> DataFrame:
    return df.select(*keep, F.inline(F.array(*[
        F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias("v")) for c in columns])))


def numeric_feature_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing, zero, signs and exact quantiles per numeric feature."""
    parts = []
    for cols in blocks(columns):
        long = stack_columns(df, [], cols)
        v = F.col("v")
        base = long.groupBy("feature_name").agg(
            F.count(F.lit(1)).alias("row_count"), count_where(v.isNull()).alias("missing_count"), F.count(v).alias("finite_count"),
            count_where(v == 0).alias("zero_count"), count_where(v > 0).alias("positive_count"), count_where(v < 0).alias("negative_count"))
        s = value_summary(long, ["feature_name"], "v", {"p01": 0.01, "median": 0.5, "p99": 0.99}, distinct=False)
        parts.append(base.join(s.drop("n", "mean"), "feature_name", "left"))
    out = union_all(parts)
    return out.select(
        "feature_name", "row_count", "missing_count", F.round(ratio(F.col("missing_count"), F.col("row_count")), 9).alias("missing_rate"),
        "finite_count", "zero_count", "positive_count", "negative_count",
        *[F.round(c, 6).alias(c) for c in ("min", "p01", "median", "p99", "max")],
        F.when(F.col("finite_count") == 0, "UNDEFINED_NO_FINITE_VALUES").otherwise("MEASURED").alias("status"))


def category_feature_audit(df: DataFrame, columns: list[str], top: int = 20) -> DataFrame:
    """Populated and distinct counts, and the most frequent values as JSON."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature_name"), F.col(c).alias("v")) for c in columns])))
    freq = long.groupBy("feature_name", "v").agg(F.count(F.lit(1)).alias("n"))
    base = freq.groupBy("feature_name").agg(
        F.sum("n").alias("row_count"), F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("populated_count"),
        F.count("v").alias("distinct_count"))
    head = top_per_group(freq.where(F.col("v").isNotNull()), ["feature_name"], "v", "n", top)
    item = F.struct("rank", F.col("v").alias("value"), F.col("n").alias("count"))
    js = head.groupBy("feature_name").agg(F.sort_array(F.collect_list(item)).alias("x")).select(
        "feature_name", F.to_json(F.transform("x", lambda e: F.struct(e["value"].alias("value"), e["count"].alias("count")))).alias("top_values"))
    return base.join(js, "feature_name", "left")


def duplicate_columns(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Pairs of columns equal in every row, missing rows included.

    An order-free signature per column (xor of row hashes and a count) nominates pairs in
    one pass; only nominated pairs are compared exactly.
    """
    types = dict(df.dtypes)
    sig = df.agg(*[x for c in columns for x in (F.bit_xor(F.xxhash64(key, c)).alias(f"h_{c}"), F.count(c).alias(f"n_{c}"))]).first()
    pairs = [(a, b) for a, b in combinations(columns, 2)
             if types[a] == types[b] and sig[f"h_{a}"] == sig[f"h_{b}"] and sig[f"n_{a}"] == sig[f"n_{b}"]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "left_column string, right_column string, row_count bigint")
    wide = df.agg(F.count(F.lit(1)).alias("n"), *[F.bool_and(F.col(a).eqNullSafe(F.col(b))).alias(f"e{i}") for i, (a, b) in enumerate(pairs)])
    rows = wide.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("left_column"), F.lit(b).alias("right_column"), F.col("n").alias("row_count"), F.col(f"e{i}").alias("same"))
        for i, (a, b) in enumerate(pairs)])))
    return rows.where(F.col("same")).drop("same")


def recompute_check(aggregated: DataFrame, source: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Recompute mean and max from value frequencies and compare with ``<field>__mean`` / ``__max``."""
    out = []
    for f in fields:
        v, n = F.col(f), F.col("n")
        freq = source.where(F.col(key).isNotNull() & v.isNotNull()).groupBy(key, f).agg(F.count(F.lit(1)).alias("n"))
        again = freq.groupBy(key).agg((F.sum(v * n) / F.sum(n)).alias("m2"), F.max(v).alias("x2"))
        j = aggregated.select(key, F.col(f"{f}__mean").alias("m1"), F.col(f"{f}__max").alias("x1")).join(again, key, "left")
        dm = F.abs(F.col("m1") - F.col("m2"))
        tol = F.lit(1e-9) * F.greatest(F.abs("m1"), F.lit(1.0))
        out.append(j.agg(
            F.lit(f).alias("field"), F.count(F.lit(1)).alias("entities"), F.count("m1").alias("with_value"),
            count_where(~F.col("x1").eqNullSafe(F.col("x2"))).alias("max_mismatches"),
            count_where((F.col("m1").isNull() != F.col("m2").isNull()) | (dm > tol)).alias("mean_mismatches")))
    return union_all(out)


def pick_examples(df: DataFrame, key: str, order: str, reasons: dict[str, Column]) -> DataFrame:
    """First entity in base order for every reason."""
    hits = df.select(key, order, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in reasons.items()]))).alias("reason"))
    return hits.groupBy("reason").agg(F.min_by(key, order).alias(key), F.min(order).alias(order), F.count(F.lit(1)).alias("candidates"))


def distribution_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, mean, sample deviation, exact deciles and shares by sign per group."""
    v = F.col(value)
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 9)
    base = df.where(v.isNotNull()).groupBy(*by).agg(
        F.count(v).alias("n_cases"), F.round(F.avg(v), 9).alias("mean"), F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)), 9).alias("standard_deviation"),
        F.round(F.min(v), 9).alias("minimum"), F.round(F.max(v), 9).alias("maximum"),
        share(v < 0).alias("share_below_zero"), share(v == 0).alias("share_exactly_zero"), share(v > 0).alias("share_above_zero"))
    probs = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}
    q = exact_quantiles(df, by, value, probs)
    return base.join(q.select(*by, *[F.round(k, 9).alias(k) for k in probs]), by)


def subgroup_integrity(df: DataFrame, dimensions: dict[str, str]) -> DataFrame:
    """Group sizes, shares, outcome rates and exclusions of every dimension."""
    long = df.select("target", F.inline(F.array(*[
        F.struct(F.lit(d).alias("dim"), F.col(c).alias("label")) for d, c in dimensions.items()])))
    g = long.groupBy("dim", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("y"))
    w = Window.partitionBy("dim")  # one row per group
    n, y = F.col("n"), F.col("y")
    g = g.withColumn("total", F.sum(n).over(w)).where(F.col("label").isNotNull()).withColumn("eligible", F.sum(n).over(w))
    return g.select(
        "dim", "label", n.alias("group_case_count"), F.round(ratio(n, F.col("eligible")), 9).alias("share_of_eligible"),
        F.round(ratio(n, F.col("total")), 9).alias("share_of_population"), y.alias("positive_count"), F.round(ratio(y, n), 9).alias("observed_rate"),
        F.col("eligible").alias("eligible_count"), (F.col("total") - F.col("eligible")).alias("excluded_count"))


def score_audit(df: DataFrame, by: list[str], key: str, score: str, label: str) -> DataFrame:
    """Validity counts, key uniqueness and exact quantiles of a score per group."""
    p = F.col(score)
    # unique keys: count per (group, key) first, then per group
    per = df.groupBy(*by, key).agg(
        F.count(F.lit(1)).alias("n"), count_where(p.isNull()).alias("miss"), count_where(p < 0).alias("lo"), count_where(p > 1).alias("hi"),
        F.sum(label).alias("y"))
    base = per.groupBy(*by).agg(
        F.sum("n").alias("row_count"), F.count(key).alias("unique_keys"), F.sum("miss").alias("missing_count"), F.sum("lo").alias("below_zero"),
        F.sum("hi").alias("above_one"), F.sum("y").alias("positive_count"))
    s = value_summary(df, by, score, LEVELS, distinct=False)
    return base.join(s, by).select(
        *base.columns, F.round("min", 9).alias("minimum"), F.round("max", 9).alias("maximum"), *[F.round(k, 9).alias(k) for k in LEVELS])
