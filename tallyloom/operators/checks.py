"""Check tables: (check_id, status, observed, expected) rows, roll-up and result contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .longform import count_where


def check_row(name: str, ok: Column, observed: Column, expected: Column) -> Column:
    return F.struct(
        F.lit(name).alias("check_id"), F.when(ok.isNull(), "NOT_CHECKED").when(ok, "PASS").otherwise("FAIL").alias("status"),
        observed.cast("string").alias("observed"), expected.cast("string").alias("expected"))


def check_rows(wide: DataFrame, rows: list[Column]) -> DataFrame:
    return wide.select(F.inline(F.array(*rows)))


def roll_up(checks: DataFrame, by: list[str], informational: list[str] = ()) -> DataFrame:
    """FAIL beats PASS beats NOT_CHECKED; informational checks do not decide."""
    used = checks.where(~F.col("check_id").isin(list(informational))) if informational else checks
    s = F.col("status")
    return used.groupBy(*by).agg(
        count_where(s == "FAIL").alias("fail_count"), count_where(s == "PASS").alias("pass_count"),
        count_where(s == "NOT_CHECKED").alias("not_checked_count"),
        F.when(F.bool_or(s == "FAIL"), "FAIL").when(F.bool_or(s == "PASS"), "PASS").otherwise("NOT_CHECKABLE").alias("overall_status"))


def require_pass(checks: DataFrame) -> None:
    """Raise when any check failed; reads only the failing rows, at most one per check."""
    bad = [r["check_id"] for r in checks.where(F.col("status") == "FAIL").select("check_id").limit(100).collect()]
    if bad:
        raise ValueError(f"failed checks: {bad}")


def unique_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    n = F.col("n")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("row_count"), count_where(n > 1).alias("duplicate_keys"))


def required_columns(df: DataFrame, columns: list[str], forbidden: list[str] = ()) -> dict[str, list[str]]:
    """Missing and forbidden column names of a result."""
    return {"missing": [c for c in columns if c not in df.columns], "forbidden": [c for c in forbidden if c in df.columns]}


def monotone_violations(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Steps of a result curve on which ``value`` falls (curves hold one row per grid point)."""
    w = Window.partitionBy(*by).orderBy(order)
    step = F.col(value) - F.lag(value).over(w)
    return df.withColumn("step", step).groupBy(*by).agg(
        F.count(F.lit(1)).alias("points"), count_where(F.col("step") < 0).alias("decreasing_steps"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, multiplicity included."""
    cols = a.columns
    left = a.select(cols).exceptAll(b.select(cols)).withColumn("only_in", F.lit("left"))
    right = b.select(cols).exceptAll(a.select(cols)).withColumn("only_in", F.lit("right"))
    return left.unionByName(right)
