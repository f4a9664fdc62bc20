"""Long metric layout: many measures of one wide aggregate as (metric, value, denominator) rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

ZERO_DENOMINATOR = "UNDEFINED_ZERO_DENOMINATOR"
NO_FINITE = "UNDEFINED_NO_FINITE_VALUES"


@dataclass(frozen=True)
class Metric:
    name: str
    value: Column
    denominator_name: str
    denominator: Column
    undefined: str = ZERO_DENOMINATOR


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def ratio(num: Column, den: Column) -> Column:
    """Quotient as double, NULL on a zero denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def with_rate(name: str, count: Column, den_name: str, den: Column, undefined: str = ZERO_DENOMINATOR) -> list[Metric]:
    return [Metric(f"{name}_count", count, den_name, den), Metric(f"{name}_rate", ratio(count, den), den_name, den, undefined)]


def to_long(wide: DataFrame, by: list[str], metrics: list[Metric], digits: int = 6) -> DataFrame:
    """One output row per metric; an undefined value keeps its reason in ``status``."""
    items = F.array(
        *[
            F.struct(
                F.lit(m.name).alias("metric_name"),
                F.round(m.value.cast("double"), digits).alias("value"),
                F.lit(m.denominator_name).alias("denominator_name"),
                m.denominator.cast("bigint").alias("denominator_value"),
                F.when(m.value.isNull(), m.undefined).otherwise("MEASURED").alias("status"),
            )
            for m in metrics
        ]
    )
    return wide.select(*by, F.inline(items))


def melt(wide: DataFrame, by: list[str], columns: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    """Unpivot numeric columns of a small result into (name, value) rows."""
    return wide.unpivot(by, [F.col(c).cast("double").alias(c) for c in columns], name, value)
