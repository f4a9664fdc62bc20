"""Model metrics, subgroup evaluation, re-ranking, policy curves and scenario value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import groups as G
from ..operators import features as X, metrics as M, policy as L
from ..session import freeze, scratch_path
from ..sources import io
from ..operators.scoring import DIMENSIONS, add_subgroups, expand_strata, unpivot_models
from .group_e import ranked_scores
from .registry import query
from .sqlviews import gain_sql, metric_sql, quantiles_sql

LABELS = list(DIMENSIONS.values())


def long_scores(t):
    return unpivot_models(t.scores, G.MODELS)


def strata_long(t):
    wide = add_subgroups(t.scores).select("case_id", "base_order", "target", *G.MODELS, *LABELS)
    return unpivot_models(expand_strata(wide), G.MODELS, ["dim", "label"])


def strata_metrics(t):
    return M.binary_metrics(strata_long(t), ["dim", "label", "model_id"])


def pair_rows(t, ranks=None):
    wide = add_subgroups(t.scores).select("case_id", "base_order", "target", *G.MODELS, *LABELS)
    return L.pair_ranks(wide, G.FAMILIES, LABELS, ranks)


def rank_table(t):
    return ranked_scores(t)


# ---------------------------------------------------------------- metrics and gains


@query("m06_model_metrics", "SELECT * FROM metric_overall")
def _(t):
    return M.binary_metrics(long_scores(t), ["model_id"])


@query("c10_overall_gains", gain_sql("metric_overall"))
def _(t):
    return M.gains(M.binary_metrics(long_scores(t), ["model_id"]), [], G.FAMILIES)


@query(
    "m08_comparison_with_prevalence",
    """SELECT model_id, sample_count, positive_count, roc_auc, average_precision, log_loss, brier_score, mean_pd FROM metric_overall
       UNION ALL SELECT 'constant_prevalence', count(*), CAST(sum(target) AS BIGINT), 0.5::DOUBLE, round(avg(target), 9),
              round(-(avg(target) * ln(avg(target)) + (1 - avg(target)) * ln(1 - avg(target))), 9), round(avg(target) * (1 - avg(target)), 9),
              round(avg(target), 9) FROM scores""",
)
def _(t):
    ref = M.prevalence_reference(t.scores)
    return M.binary_metrics(long_scores(t), ["model_id"]).select(ref.columns).unionByName(ref)


@query(
    "m05_candidate_selection",
    """WITH c AS (SELECT split_part(model_id, '_', 2) AS track, model_id AS candidate_id, average_precision, log_loss,
                         CAST(length(model_id) AS INTEGER) AS complexity, model_id <> 'trees_ad' AS eligible FROM metric_overall),
            b AS (SELECT *, coalesce(eligible AND average_precision >= max(CASE WHEN eligible THEN average_precision END) OVER (PARTITION BY track) - 1e-4, false) AS in_band FROM c),
            r AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY in_band DESC, log_loss, complexity, candidate_id) AS rn FROM b)
       SELECT track, candidate_id, average_precision, log_loss, complexity, eligible, in_band, in_band AND rn = 1 AS selected,
              CASE WHEN in_band AND rn = 1 THEN 'SELECTED' WHEN in_band THEN 'ELIGIBLE_NOT_SELECTED' ELSE 'OUTSIDE_BAND_OR_INELIGIBLE' END AS selection_reason FROM r""",
)
def _(t):
    m = M.binary_metrics(long_scores(t), ["model_id"])
    cand = m.select(F.regexp_extract("model_id", "_(.*)$", 1).alias("track"), F.col("model_id").alias("candidate_id"), "average_precision", "log_loss",
                    F.length("model_id").alias("complexity"), (F.col("model_id") != "trees_ad").alias("eligible"))
    return M.select_candidate(cand, ["track"], "complexity")


def prediction_parts(t):
    s = t.scores
    return [s.select("case_id", "target", F.col(n).alias("pd")) for n in G.MODELS]


@query("m07_prediction_merge", "SELECT s.case_id, s.target, " + ", ".join(G.MODELS) + " FROM scores s")
def _(t):
    return M.join_predictions(prediction_parts(t), "case_id", "target", list(G.MODELS))[0]


@query(
    "m07_merge_checks",
    """SELECT count(*) AS row_count, count(*) FILTER (WHERE case_id % 50 = 3 OR case_id % 70 = 4) AS incomplete_rows, count(*) FILTER (WHERE case_id % 90 = 5) AS label_conflicts,
              count(*) FILTER (WHERE case_id % 110 = 6) AS out_of_bounds_rows FROM scores""",
)
def _(t):
    """Parts with planted faults: absent rows of one model, repeated rows of a second, turned labels of a third and scores above one of a fourth."""
    a, b, c, d, *rest = prediction_parts(t)
    k = F.col("case_id")
    a = a.where(k % 50 != 3)
    b = b.unionByName(b.where(k % 70 == 4))
    c = c.withColumn("target", F.when(k % 90 == 5, 1 - F.col("target")).otherwise(F.col("target")))
    d = d.withColumn("pd", F.when(k % 110 == 6, F.col("pd") + 1).otherwise(F.col("pd")))
    return M.join_predictions([a, b, c, d, *rest], "case_id", "target", list(G.MODELS))[1]


# ---------------------------------------------------------------- joins of predictions


@query("c11_prediction_subgroup_label", " UNION ALL ".join(
    f"SELECT '{m}' AS model_id, g.case_id, g.target, account_group, history_group, richness_group, {m} AS pd FROM groups g" for m in G.MODELS))
def _(t):
    groups = add_subgroups(t.scores).select("case_id", *LABELS)
    labels = t.features.select("case_id", "target")
    return unpivot_models(t.scores, G.MODELS).select("model_id", "case_id", "pd").join(groups, "case_id", "left").join(labels, "case_id", "left")


@query(
    "c12_curve_anchor_reconciliation",
    """SELECT model_id, count(*) AS anchor_points, count(*) FILTER (WHERE approval_rate_percent = 60) AS mismatches FROM approval_points WHERE is_display_point GROUP BY model_id""",
)
def _(t):
    """Anchors are a saved table, read back; the one at 60 % is altered, so it must be found."""
    curve = L.approval_curve(rank_table(t), L.approval_grid(t.spark))
    saved = curve.where("is_display_point").select("model_id", "approval_rate_percent", "approved_count", "approved_mean_pd")
    path = scratch_path(t.spark, "anchors")
    io.write_parquet(saved.withColumn("approved_mean_pd", F.col("approved_mean_pd") * F.when(F.col("approval_rate_percent") == 60, 1.001).otherwise(1.0)), path)
    return L.reconcile_anchors(curve, t.spark.read.parquet(path))


@query(
    "c13_grid_evaluation",
    """SELECT r.model_id, r.n_rows * g.pct // 100 AS approved_count, r.pd AS cutoff, r.cum_y AS realised_defaults, CAST(g.pct AS DOUBLE) AS approval_rate_percent
       FROM ranked r JOIN (SELECT CAST(unnest(generate_series(1, 100)) AS BIGINT) AS pct) g ON r.rn = r.n_rows * g.pct // 100""",
)
def _(t):
    c = L.approval_curve(rank_table(t), L.approval_grid(t.spark, (100, 10000, 100)))
    return c.select("model_id", "approved_count", "cutoff", "realised_defaults", "approval_rate_percent")


# ---------------------------------------------------------------- subgroups


@query("l01_subgroup_table", "SELECT case_id, account_group, history_group, richness_group FROM groups")
def _(t):
    return add_subgroups(t.scores).select("case_id", *LABELS)


@query("l02_strata", "SELECT dim, label, count(*) AS row_count, CAST(sum(target) AS BIGINT) AS positive_count FROM strata GROUP BY 1, 2")
def _(t):
    return expand_strata(add_subgroups(t.scores)).groupBy("dim", "label").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("target").alias("positive_count"))


@query("l03_subgroup_metrics", "SELECT * FROM metric_strata")
def _(t):
    return strata_metrics(t)


@query(
    "l03_single_class_groups",
    metric_sql("(SELECT CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'other' END AS grp, model_id, target, pd FROM scores_long s JOIN orders o ON o.o_orderkey = s.case_id) x", "grp, model_id"),
)
def _(t):
    status = t.orders.select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderstatus") == "F", "F").otherwise("other").alias("grp"))
    return M.binary_metrics(long_scores(t).join(status, "case_id"), ["grp", "model_id"])


@query(
    "l04_subgroup_integrity",
    """WITH g AS (SELECT dim, label, count(*) AS n, sum(target) AS y FROM strata WHERE dim <> 'overall' GROUP BY 1, 2), a AS (SELECT count(*) AS total FROM scores)
       SELECT dim, label, n AS group_case_count, round(n / sum(n) OVER (PARTITION BY dim), 9) AS share_of_eligible, round(n / total, 9) AS share_of_population,
              CAST(y AS BIGINT) AS positive_count, round(y / n, 9) AS observed_rate, CAST(sum(n) OVER (PARTITION BY dim) AS BIGINT) AS eligible_count,
              CAST(total - sum(n) OVER (PARTITION BY dim) AS BIGINT) AS excluded_count FROM g CROSS JOIN a""",
)
def _(t):
    return X.subgroup_integrity(add_subgroups(t.scores), DIMENSIONS)


@query("l05_subgroup_gains", gain_sql("metric_strata", "dim, label"))
def _(t):
    return M.gains(strata_metrics(t), ["dim", "label"], G.FAMILIES)


# ---------------------------------------------------------------- re-ranking


@query(
    "l06_reassessment",
    """WITH v AS (SELECT algorithm_family, dim, label, 'delta_pd' AS measure, pd_ad - pd_t AS v FROM pair_strata
                  UNION ALL SELECT algorithm_family, dim, label, 'delta_risk_percentile', (rn_ad - 1) / (n - 1) - (rn_t - 1) / (n - 1) FROM pair_strata)
       SELECT algorithm_family, dim, label, measure, count(*) AS n_cases, round(avg(v), 9) AS mean, round(stddev_samp(v), 9) AS standard_deviation,
              round(min(v), 9) AS minimum, round(max(v), 9) AS maximum, round(avg(CASE WHEN v < 0 THEN 1e0 ELSE 0e0 END), 9) AS share_below_zero,
              round(avg(CASE WHEN v = 0 THEN 1e0 ELSE 0e0 END), 9) AS share_exactly_zero, round(avg(CASE WHEN v > 0 THEN 1e0 ELSE 0e0 END), 9) AS share_above_zero, """
    + quantiles_sql("v", {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}, 9) + " FROM v GROUP BY ALL",
)
def _(t):
    return X.distribution_summary(L.reassessment(freeze(pair_rows(t)), DIMENSIONS), ["algorithm_family", "dim", "label", "measure"], "v")


def _migration_sql(source, dims, k):
    return f"""SELECT g.algorithm_family, g.dim, g.label, {k}::BIGINT AS n_bins, a.i AS t_bin, b.i AS ad_bin, coalesce(c, 0) AS case_count,
        round(coalesce(c, 0) / sum(coalesce(c, 0)) OVER (PARTITION BY g.algorithm_family, g.dim, g.label), 9) AS share_of_stratum,
        round(coalesce(c, 0) / nullif(sum(coalesce(c, 0)) OVER (PARTITION BY g.algorithm_family, g.dim, g.label, a.i), 0), 9) AS share_within_t_bin,
        CAST(coalesce(y, 0) AS BIGINT) AS default_count, round(y / c, 9) AS observed_default_rate
        FROM (SELECT DISTINCT algorithm_family, dim, label FROM {source}) g CROSS JOIN (SELECT unnest(generate_series(1, {k})) AS i) a
        CROSS JOIN (SELECT unnest(generate_series(1, {k})) AS i) b
        LEFT JOIN (SELECT algorithm_family, dim, label, (rn_t - 1) * {k} // n + 1 AS bt, (rn_ad - 1) * {k} // n + 1 AS ba, count(*) AS c, sum(target) AS y
                   FROM {source} GROUP BY ALL) x
          ON x.algorithm_family = g.algorithm_family AND x.dim = g.dim AND x.label = g.label AND x.bt = a.i AND x.ba = b.i"""


@query("l07_migration", _migration_sql("pair_strata", None, 5))
def _(t):
    return L.migration(pair_rows(t), DIMENSIONS, (5,))


_OVERALL = "(SELECT *, 'overall' AS dim, 'ALL' AS label FROM pair_rank)"


@query("l07_migration_bin_counts", " UNION ALL ".join(_migration_sql(_OVERALL, None, k) for k in (5, 10, 20)))
def _(t):
    return L.migration(pair_rows(t), {}, (5, 10, 20))


# ---------------------------------------------------------------- policy curves


@query("l08_approval_curve", "SELECT * FROM approval_points")
def _(t):
    return L.approval_curve(rank_table(t), L.approval_grid(t.spark))


@query(
    "l09_approval_switches",
    """WITH g AS (SELECT DISTINCT algorithm_family, dim, label, n FROM pair_strata),
            a AS (SELECT CAST(unnest([4000, 5000, 6000, 7000, 8000]) AS BIGINT) AS bp),
            k AS (SELECT unnest(['both_approved', 'T_only_approved', 'T_plus_AD_only_approved', 'both_rejected']) AS switch_category),
            x AS (SELECT algorithm_family, dim, label, bp, CASE WHEN rn_t <= n * bp // 10000 AND rn_ad <= n * bp // 10000 THEN 'both_approved'
                         WHEN rn_t <= n * bp // 10000 THEN 'T_only_approved' WHEN rn_ad <= n * bp // 10000 THEN 'T_plus_AD_only_approved' ELSE 'both_rejected' END AS switch_category,
                         count(*) AS c, sum(target) AS y, avg(pd_t) AS mt, avg(pd_ad) AS ma FROM pair_strata CROSS JOIN a GROUP BY ALL)
       SELECT g.algorithm_family, g.dim, g.label, a.bp / 100e0 AS approval_rate_percent, g.n * a.bp // 10000 AS approved_count_each_model, k.switch_category,
              coalesce(c, 0) AS case_count, round(coalesce(c, 0) / sum(coalesce(c, 0)) OVER (PARTITION BY g.algorithm_family, g.dim, g.label, a.bp), 9) AS share_of_stratum,
              CAST(coalesce(y, 0) AS BIGINT) AS default_count, round(y / c, 9) AS observed_default_rate, round(mt, 9) AS mean_pd_t, round(ma, 9) AS mean_pd_ad,
              round(ma - mt, 9) AS mean_delta_pd
       FROM g CROSS JOIN a CROSS JOIN k LEFT JOIN x ON x.algorithm_family = g.algorithm_family AND x.dim = g.dim AND x.label = g.label AND x.bp = a.bp
            AND x.switch_category = k.switch_category""",
)
def _(t):
    return L.approval_switches(pair_rows(t), DIMENSIONS)


@query(
    "l10_risk_budget_curve",
    """SELECT model_id, u / 1e4 AS risk_budget, u IN (75, 100, 125, 150, 175, 200) AS is_display_point, round(100 * coalesce(k, 0) / n, 9) AS maximum_approval_rate_percent,
              coalesce(k, 0) AS approved_count, n - coalesce(k, 0) AS rejected_count, pd AS cutoff, round(cum_pd / k, 9) AS approved_mean_pd,
              round(coalesce(cum_pd, 0), 6) AS expected_defaults, coalesce(cum_y, 0) AS realised_defaults, coalesce(k, 0) - coalesce(cum_y, 0) AS realised_non_defaults,
              round(cum_y / k, 9) AS realised_default_rate, round(u / 1e4 - cum_pd / k, 9) AS budget_slack, coalesce(k, 0) > 0 AS feasible,
              CASE WHEN coalesce(k, 0) > 0 THEN 'FEASIBLE' ELSE 'NO_POSITIVE_PREFIX_FEASIBLE' END AS status FROM budget_points""",
)
def _(t):
    return L.risk_budget_curve(rank_table(t), L.budget_grid(t.spark))


@query(
    "l11_budget_inversion",
    """WITH c AS (SELECT r.model_id, CAST(g.pct AS DOUBLE) AS rate, r.rn AS k, round(cum_pd / rn, 9) AS m FROM ranked r
                  JOIN (SELECT CAST(unnest(generate_series(1, 100)) AS BIGINT) AS pct) g ON r.rn = r.n_rows * g.pct // 100),
            b AS (SELECT DISTINCT round(m, 12) AS common_budget FROM c), m AS (SELECT DISTINCT model_id FROM c)
       SELECT m.model_id, b.common_budget, coalesce(max(c.rate), 0) AS maximum_approval_rate_percent, coalesce(max(c.k), 0) AS approved_count, max(c.k) IS NOT NULL AS feasible
       FROM m CROSS JOIN b LEFT JOIN c ON c.model_id = m.model_id AND c.m <= b.common_budget + 1e-12 GROUP BY 1, 2""",
)
def _(t):
    curve = L.approval_curve(rank_table(t), L.approval_grid(t.spark, (100, 10000, 100)))
    return L.invert_budgets(curve, L.common_budgets(curve))


@query("l12_scenario_values", "SELECT * FROM scenario_rows")
def _(t):
    return L.scenario_values(long_scores(t))


COMPARISONS = [("within_family", f, a, b) for f, (a, b) in G.FAMILIES.items()] + [
    ("extended_complexity", "trees_minus_logit", "logit_ad", "trees_ad"), ("extended_complexity", "mlp_minus_logit", "logit_ad", "mlp_ad"),
    ("extended_complexity", "mlp_minus_trees", "trees_ad", "mlp_ad")]


@query(
    "l13_scenario_comparison",
    "WITH p AS (SELECT * FROM (VALUES " + ", ".join(str(c) for c in COMPARISONS) + """) v(comparison_type, comparison_id, reference_model, candidate_model))
       SELECT p.*, r.loss_ratio, r.display_role, c.approved_count - r.approved_count AS approved_count_change,
              round(c.approval_rate_percent - r.approval_rate_percent, 9) AS approval_rate_change, c.approved_defaults - r.approved_defaults AS default_count_change,
              round(c.approved_default_rate - r.approved_default_rate, 9) AS default_rate_change, round(c.expected_value - r.expected_value, 4) AS expected_value_change,
              c.realised_value - r.realised_value AS realised_value_change, round(c.realised_value_per_case - r.realised_value_per_case, 7) AS realised_value_per_case_change,
              CASE WHEN comparison_type = 'within_family' THEN round((c.realised_value - r.realised_value) / r.n_cases, 9) END AS break_even_cost_per_case
       FROM p JOIN scenario_rows r ON r.model_id = reference_model JOIN scenario_rows c ON c.model_id = candidate_model AND c.loss_ratio = r.loss_ratio""",
)
def _(t):
    return L.value_comparison(L.scenario_values(long_scores(t)), COMPARISONS)


@query("l14_grids", " UNION ALL ".join(
    f"""SELECT '{m}' AS model_id, g.* FROM (WITH n AS (SELECT count(*) AS n FROM scores)
       SELECT 'approval' AS grid, (bp - 4000) // 25 + 1 AS grid_order, bp / 1e4 AS level, bp IN (4000, 5000, 6000, 7000, 8000) AS is_display_point, n * bp // 10000 AS case_count
       FROM (SELECT CAST(unnest(generate_series(4000, 8000, 25)) AS BIGINT) AS bp) a CROSS JOIN n
       UNION ALL SELECT 'budget', u - 74, u / 1e4, u IN (75, 100, 125, 150, 175, 200), (SELECT count(*) FROM scores WHERE {m} <= u / 1e4)
       FROM (SELECT CAST(unnest(generate_series(75, 200)) AS BIGINT) AS u) b
       UNION ALL SELECT 'loss_ratio', row_number() OVER (ORDER BY k), 1e0 / (1 + k), k >= 20, (SELECT count(*) FROM scores WHERE {m} < 1e0 / (1 + k))
       FROM (SELECT unnest([2, 5, 10, 20, 30, 50]) AS k) c) g""" for m in G.MODELS))
def _(t):
    parts = [L.grids_on(t.scores, m).select(F.lit(m).alias("model_id"), "*") for m in G.MODELS]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(
    "l15_score_audit",
    "SELECT model_id, count(*) AS row_count, count(DISTINCT case_id) AS unique_keys, count(*) - count(pd) AS missing_count, count(*) FILTER (WHERE pd < 0) AS below_zero, "
    "count(*) FILTER (WHERE pd > 1) AS above_one, CAST(sum(target) AS BIGINT) AS positive_count, round(min(pd), 9) AS minimum, round(max(pd), 9) AS maximum, "
    + quantiles_sql("pd", {"p01": 0.01, "p05": 0.05, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}, 9)
    + " FROM scores_long GROUP BY model_id",
)
def _(t):
    return X.score_audit(long_scores(t), ["model_id"], "case_id", "pd", "target")


@query("l16_anchor_points", "SELECT model_id, approval_rate_percent, approved_count, cutoff, approved_mean_pd FROM approval_points WHERE is_display_point")
def _(t):
    c = L.approval_curve(rank_table(t), L.approval_grid(t.spark)).where("is_display_point")
    return c.select("model_id", "approval_rate_percent", "approved_count", "cutoff", "approved_mean_pd")
