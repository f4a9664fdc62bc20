"""Subgroup design tables: distributions, indicator inventories, field audits on split members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import groups as G
from .features import stack_columns
from .history import LEVELS
from .longform import count_where, ratio
from .ranking import value_summary


def _pct(a: str, b: Column) -> Column:
    return F.round(ratio(F.col(a) * 100, b), 6)


def group_distribution(df: DataFrame, label: Column, value: Column, order: tuple[str, ...]) -> DataFrame:
    """Counts, shares and observed range per group, with a TOTAL row over the assigned groups."""
    g = df.groupBy(label.alias("group_label")).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    everything = Window.partitionBy(F.lit(0))  # one row per group
    g = g.withColumn("all_rows", F.sum("n").over(everything)).where(F.col("group_label").isNotNull())
    total = g.agg(F.lit("TOTAL").alias("group_label"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
                  F.max("all_rows").alias("all_rows"))
    eligible = F.max("n").over(everything)  # the TOTAL row
    position = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("group_label")), F.lit(0)), F.lit(99))
    return g.unionByName(total).withColumn("eligible", eligible).select(
        position.cast("bigint").alias("group_order"), "group_label", F.col("n").alias("group_count"),
        _pct("n", F.col("eligible")).alias("percentage_eligible"), _pct("n", F.col("all_rows")).alias("percentage_all"),
        F.round("lo", 6).alias("observed_minimum"), F.round("hi", 6).alias("observed_maximum"))


def indicator_inventory(df: DataFrame, flags: list[str]) -> DataFrame:
    """0 / 1 / invalid counts of binary indicators."""
    v = F.col("v")
    a = stack_columns(df, [], flags).groupBy("feature_name").agg(
        F.count(F.lit(1)).alias("n"), count_where(v == 0).alias("value_0_count"), count_where(v == 1).alias("value_1_count"),
        count_where(v.isNull() | ~v.isin(0.0, 1.0)).alias("invalid_count"))
    return a.select("feature_name", "value_0_count", _pct("value_0_count", F.col("n")).alias("value_0_percentage"),
                    "value_1_count", _pct("value_1_count", F.col("n")).alias("value_1_percentage"), "invalid_count")


def richness_distribution(df: DataFrame, flags: list[str]) -> DataFrame:
    """Counts per number of set flags and per exact pattern."""
    cols = [F.col(f) for f in flags]
    cells = df.groupBy(G.richness(*cols).alias("level"), G.pattern_code(*cols).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    total = Window.partitionBy("candidate_id")  # at most 2^k rows
    a = cells.groupBy(F.col("level").alias("level_or_value")).agg(F.sum("n").alias("n")).withColumn("candidate_id", F.lit("module_count"))
    b = cells.groupBy(F.col("pattern").alias("level_or_value")).agg(F.sum("n").alias("n")).withColumn("candidate_id", F.lit("module_pattern"))
    u = a.unionByName(b).withColumns({"all": F.sum("n").over(total), "smallest_group_count": F.min("n").over(total)})
    return u.select("candidate_id", "level_or_value", F.col("n").alias("group_count"), _pct("n", F.col("all")).alias("percentage"), "smallest_group_count")


def field_audit(df: DataFrame, fields: list[str]) -> DataFrame:
    """Missing, sign and exact quantile audit of numeric fields."""
    long = stack_columns(df, [], fields, "field_name")
    v = F.col("v")
    base = long.groupBy("field_name").agg(
        F.count(F.lit(1)).alias("total"), F.count(v).alias("non_missing_count"), count_where(v == 0).alias("zero_count"),
        count_where(v > 0).alias("positive_count"), count_where(v < 0).alias("negative_count"))
    s = value_summary(long, ["field_name"], "v", LEVELS).drop("n", "mean")
    return base.join(s, "field_name", "left").select(
        "field_name", "total", "non_missing_count", _pct("non_missing_count", F.col("total")).alias("non_missing_percentage"),
        "zero_count", "positive_count", "negative_count", F.coalesce("distinct", F.lit(0)).alias("unique_values"),
        F.col("min").alias("minimum"), F.col("max").alias("maximum"), *[F.round(k, 6).alias(k) for k in LEVELS])
