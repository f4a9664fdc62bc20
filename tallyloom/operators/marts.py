"""Small result tables behind displays, and the contracts of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import groups as G
from .checks import check_row, check_rows, monotone_violations, unique_keys
from .longform import count_where

# Row-level columns a published table must not hold.
ROW_LEVEL = ("case_id", "base_order", "target")
HIGHER_IS_BETTER = ("roc_auc", "average_precision")


def performance(metrics: DataFrame) -> DataFrame:
    """Metric values of both information sets side by side, improvement oriented by metric."""
    m = F.col("model_id")
    names = ("roc_auc", "average_precision", "log_loss", "brier_score")
    long = metrics.select(m, *names).unpivot(["model_id"], list(names), "metric", "value")
    wide = (
        long.withColumn("info", G.information_set(m)).groupBy(G.algorithm_family(m).alias("algorithm_family"), "metric")
        .pivot("info", ["T", "T_plus_AD"]).agg(F.max("value"))
    )
    up = F.col("metric").isin(*HIGHER_IS_BETTER)
    change = F.col("T_plus_AD") - F.col("T")
    return wide.withColumn("improvement", F.round(F.when(up, change).otherwise(-change), 9))


def heterogeneity(gains: DataFrame, dimension: str, family: str, gain: str = "roc_auc_gain") -> DataFrame:
    """Gain by group of one dimension, in group order."""
    order = {"account_count": G.ACCOUNT_LABELS, "bureau_history": G.HISTORY_LABELS, "ad_richness": G.RICHNESS_LABELS}[dimension]
    position = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("label"))
    rows = gains.where((F.col("dim") == dimension) & (F.col("algorithm_family") == family))
    return rows.select(position.alias("group_order"), "label", "sample_count", F.col(gain).alias("gain")).orderBy("group_order")


def heat_map(migration: DataFrame, family: str, bins: int, value: str = "share_within_t_bin") -> DataFrame:
    """Origin bins as rows, destination bins as columns."""
    rows = migration.where((F.col("algorithm_family") == family) & (F.col("n_bins") == bins) & (F.col("dim") == "overall"))
    wide = rows.groupBy("t_bin").pivot("ad_bin", list(range(1, bins + 1))).agg(F.max(value))
    return wide.select("t_bin", *[F.col(str(i)).alias(f"ad_bin_{i}") for i in range(1, bins + 1)]).orderBy("t_bin")


def allocation(curve: DataFrame, family: str, level: str, values: list[str]) -> DataFrame:
    """A rate or budget curve of one model pair, both models in one row per point."""
    a, b = G.FAMILIES[family]
    side = lambda m, tag: curve.where(F.col("model_id") == m).select(level, *[F.col(v).alias(f"{tag}_{v}") for v in values])
    return side(a, "t").join(side(b, "ad"), level).orderBy(level)


def value_mart(comparison: DataFrame, value: str) -> DataFrame:
    rows = comparison.where("comparison_type = 'within_family'")
    return rows.select(F.col("comparison_id").alias("algorithm_family"), "loss_ratio", "display_role", value).orderBy("algorithm_family", "loss_ratio")


def migration_checks(migration: DataFrame, formal: DataFrame, bin_counts: tuple[int, ...], population: int, families: int) -> DataFrame:
    """Cell counts, totals, origin shares, bounds, and agreement with the formal quintiles."""
    expected = families * sum(k * k for k in bin_counts)
    n, y = F.col("case_count"), F.col("default_count")
    per = migration.groupBy("algorithm_family", "n_bins").agg(F.count(F.lit(1)).alias("cells"), F.sum(n).alias("total"))
    share = migration.groupBy("algorithm_family", "n_bins", "t_bin").agg(F.sum("share_within_t_bin").alias("s"))
    a = migration.agg(F.count(F.lit(1)).alias("rows"), count_where((n < 0) | (y < 0) | (y > n)).alias("bad"), F.lit(1).alias("k"))
    b = per.agg(count_where((F.col("cells") != F.col("n_bins") * F.col("n_bins")) | (F.col("total") != population)).alias("off"), F.lit(1).alias("k"))
    c = share.agg(count_where(F.abs(F.col("s") - 1) > 1e-7).alias("uneven"), F.lit(1).alias("k"))
    keys = ["algorithm_family", "t_bin", "ad_bin"]
    j = formal.where("dim = 'overall'").select(*keys, F.col("case_count").alias("formal")).join(
        migration.where("n_bins = 5").select(*keys, F.col("case_count").alias("made")), keys, "full_outer")
    d = j.agg(count_where(~F.col("formal").eqNullSafe(F.col("made"))).alias("differ"), F.lit(1).alias("k"))
    w = a.join(b, "k").join(c, "k").join(d, "k")
    zero = F.lit(0)
    return check_rows(w, [
        check_row("migration_row_count", F.col("rows") == expected, F.col("rows"), F.lit(expected)),
        check_row("migration_counts_valid", F.col("bad") == 0, F.col("bad"), zero),
        check_row("migration_totals_reconcile", F.col("off") == 0, F.col("off"), zero),
        check_row("migration_origin_shares_sum_to_one", F.col("uneven") == 0, F.col("uneven"), zero),
        check_row("migration_equals_formal_quintiles", F.col("differ") == 0, F.col("differ"), zero)])


def curve_contract(name: str, curve: DataFrame, keys: list[str], by: list[str], order: str, expected_rows: int) -> DataFrame:
    """Row count, unique keys and non-decreasing accepted counts of a curve."""
    u = unique_keys(curve, keys).withColumn("k", F.lit(1))
    m = monotone_violations(curve, by, order, "approved_count").agg(F.sum("decreasing_steps").alias("down"), F.lit(1).alias("k"))
    zero = F.lit(0)
    return check_rows(u.join(m, "k"), [
        check_row(f"{name}_row_count", F.col("row_count") == expected_rows, F.col("row_count"), F.lit(expected_rows)),
        check_row(f"{name}_unique_keys", F.col("duplicate_keys") == 0, F.col("duplicate_keys"), zero),
        check_row(f"{name}_monotone", F.col("down") == 0, F.col("down"), zero)])


def budget_contract(curve: DataFrame) -> DataFrame:
    a = curve.agg(count_where(F.col("approved_mean_pd") > F.col("risk_budget") + 1e-9).alias("over"),
                  count_where(F.col("feasible") != (F.col("approved_count") > 0)).alias("flag"))
    zero = F.lit(0)
    return check_rows(a, [check_row("budget_not_exceeded", F.col("over") == 0, F.col("over"), zero),
                          check_row("feasibility_flag_consistent", F.col("flag") == 0, F.col("flag"), zero)])


def prediction_checks(predictions: DataFrame, key: str, models: list[str], expected: DataFrame) -> DataFrame:
    """Schema, key uniqueness, membership and bounds of a wide prediction table."""
    missing = [m for m in models if m not in predictions.columns]
    bad = F.lit(False)
    for m in models:
        p = F.col(m)
        bad = bad | p.isNull() | F.isnan(p) | ~p.between(0.0, 1.0)
    per = predictions.groupBy(key).agg(F.count(F.lit(1)).alias("n"), count_where(bad).alias("bad"))
    j = expected.select(key, F.lit(1).alias("m")).join(per, key, "full_outer")
    a = j.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), count_where(F.col("m").isNotNull()).alias("members"), count_where(F.col("n") > 1).alias("repeated"),
              count_where(F.col("n").isNull()).alias("absent"), count_where(F.col("m").isNull()).alias("strangers"), F.sum("bad").alias("bad"))
    zero, c = F.lit(0), F.col
    return check_rows(a, [
        check_row("required_columns", F.lit(not missing), F.lit(len(missing)), zero),
        check_row("row_count", c("rows") == c("members"), c("rows"), c("members")),
        check_row("unique_keys", c("repeated") == 0, c("repeated"), zero), check_row("no_absent_members", c("absent") == 0, c("absent"), zero),
        check_row("no_strangers", c("strangers") == 0, c("strangers"), zero), check_row("bounded_probabilities", c("bad") == 0, c("bad"), zero)])


def membership_checks(split: DataFrame, key: str) -> DataFrame:
    """Every key in one outer split; roles exactly on validation rows."""
    per = split.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("outer_split").alias("splits"))
    a = per.agg(F.count(F.lit(1)).alias("keys"), count_where(F.col("splits") != 1).alias("overlap"), count_where(F.col("n") != 1).alias("repeated"), F.lit(1).alias("k"))
    role = F.col("validation_role").isNotNull()
    b = split.agg(F.count(F.lit(1)).alias("rows"), count_where(role != (F.col("outer_split") == "validation")).alias("roles"), F.lit(1).alias("k"))
    zero, c = F.lit(0), F.col
    return check_rows(a.join(b, "k"), [
        check_row("population", c("keys") == c("rows"), c("keys"), c("rows")), check_row("disjoint_splits", c("overlap") == 0, c("overlap"), zero),
        check_row("unique_keys", c("repeated") == 0, c("repeated"), zero), check_row("roles_partition_validation", c("roles") == 0, c("roles"), zero)])


def package_inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and row-level columns of every published table."""
    out = None
    for name, df in tables.items():
        exposed = [c for c in ROW_LEVEL if c in df.columns]
        x = df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count")).withColumn("row_level_columns", F.lit(",".join(exposed)))
        out = x if out is None else out.unionByName(x)
    return out
