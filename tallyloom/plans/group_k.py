"""Probability calibration."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import groups as G, probability as P
from ..operators import calibration as C, checks as K, isotonic as I, metrics as M, split as SP
from ..operators.scoring import unpivot_models
from ..session import freeze
from .group_d2 import split_of
from .registry import query
from .sqlviews import isotonic_sql, metric_sql, newton_sql

#: Fixed value: bootstrap replicates.
REPLICATES = 2000


def cal_scores(t):
    members = split_of(t).where("validation_role = 'validation_calibration'").select("case_id")
    return t.scores.join(members, "case_id", "left_semi")


def cal_long(t):
    return unpivot_models(cal_scores(t), G.MODELS)


def cal_folds(t):
    wide = SP.common_folds(cal_scores(t), "case_id", "target", 5, "folds")
    return unpivot_models(wide, G.MODELS, ["fold_id"]).drop("base_order")


METHODS = ("identity", "logistic", "isotonic")


def calibrated(t):
    """Calibration rows with the raw probability and both out-of-fold maps, all models."""
    folds = freeze(cal_folds(t))
    keys = ["case_id", "model_id"]
    logistic = C.cross_fit_logistic(folds, 5).select(*keys, F.col("oof").alias("logistic"))
    isotonic = C.cross_fit_isotonic(folds, 5).select(*keys, F.col("oof").alias("isotonic"))
    return freeze(folds.withColumnRenamed("pd", "identity").join(logistic, keys).join(isotonic, keys))


def methods_long(rows):
    return rows.select("case_id", "target", "model_id", "fold_id", F.inline(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("pd")) for m in METHODS])))


def bootstrap(rows):
    """Replicate losses of every model and method: one column each, so all share the draws."""
    wide = rows.groupBy("case_id", "target").pivot("model_id", list(G.MODELS)).agg(*[F.max(m).alias(m) for m in METHODS])
    variants = {f"{m}_{name}": (m, name) for m in G.MODELS for name in METHODS}
    return freeze(C.paired_bootstrap(wide, "case_id", "target", variants, REPLICATES))


def fitted_slopes(rows):
    """Slope of each model's logistic map, fitted on all calibration rows."""
    fits = C.fit_logistic(M.score_counts(rows.withColumnRenamed("identity", "pd"), ["model_id"]), ["model_id"])
    return fits.select("model_id", F.lit("logistic").alias("method"), F.col("beta").alias("slope"))


def guarded(rows, boot):
    metrics = M.binary_metrics(methods_long(rows), ["model_id", "method"], digits=15)
    return freeze(C.guardrails(metrics, fitted_slopes(rows), C.paired_errors(C.differences_to_identity(boot), "brier_vs_identity")))


def selection(t):
    rows = calibrated(t)
    boot = bootstrap(rows)
    g = guarded(rows, boot)
    ref = freeze(C.reference_methods(g))
    return C.select_method(g, ref, C.paired_errors(C.annotate_reference(boot, ref), "log_loss_difference"))


@query("k01_protected_logit", "SELECT model_id, case_id, round(ln(pd) - ln(1 - pd), 9) AS z FROM scores_long")
def _(t):
    return unpivot_models(t.scores, G.MODELS).select("model_id", "case_id", F.round(P.logit(F.col("pd")), 9).alias("z"))


@query(
    "k01_endpoint_counts",
    """SELECT l_returnflag, count(*) AS row_count, count(*) FILTER (WHERE l_discount * 10 = 0) AS exact_zero,
              count(*) FILTER (WHERE round(l_discount * 10, 6) = 1) AS exact_one,
              round(avg(CASE WHEN l_discount = 0 THEN ln(2.220446049250313e-16) ELSE 0e0 END), 6) AS mean_protected_log FROM lineitem GROUP BY 1""",
)
def _(t):
    rows = t.lineitem.select("l_returnflag", F.round(F.col("l_discount") * 10, 6).alias("pd"))
    low = F.when(F.col("pd") == 0, F.ln(P.protected(F.col("pd")))).otherwise(0.0)
    extra = rows.groupBy("l_returnflag").agg(F.round(F.avg(low), 6).alias("mean_protected_log"))
    return C.endpoint_counts(rows, ["l_returnflag"]).join(extra, "l_returnflag")


@query("k02_identity_map", "SELECT model_id, case_id, pd FROM scores_long")
def _(t):
    return unpivot_models(t.scores, G.MODELS).select("model_id", "case_id", C.identity_map("pd").alias("pd"))


_COUNTS = "SELECT model_id, pd, count(*)::DOUBLE AS n, sum(target)::DOUBLE AS pos FROM cal_long GROUP BY 1, 2"


@query("k03_logistic_fit", f"WITH {newton_sql(_COUNTS, 'model_id')} SELECT model_id, round(a, 6) AS alpha, round(b, 6) AS beta, b > 0 AS valid FROM p9")
def _(t):
    fits = C.fit_logistic(M.score_counts(cal_long(t), ["model_id"]), ["model_id"])
    return fits.select("model_id", F.round("alpha", 6).alias("alpha"), F.round("beta", 6).alias("beta"), "valid")


@query(
    "k03_logistic_predictions",
    f"""WITH {newton_sql(_COUNTS, 'model_id')} SELECT c.model_id, c.case_id, round(1 / (1 + exp(-(a + b * (ln(pd) - ln(1 - pd))))), 7) AS calibrated_pd
        FROM cal_long c JOIN p9 ON p9.model_id = c.model_id""",
)
def _(t):
    rows = cal_long(t)
    fits = C.fit_logistic(M.score_counts(rows, ["model_id"]), ["model_id"])
    return rows.join(F.broadcast(fits), "model_id").select("model_id", "case_id", F.round(C.logistic_map(), 7).alias("calibrated_pd"))


_ISO = "WITH " + isotonic_sql("SELECT model_id AS grp, pd AS x, n, pos FROM (" + _COUNTS + ") k")


@query("k04_isotonic_predictions", _ISO + " SELECT c.model_id, c.case_id, round(iso.y, 9) AS calibrated_pd FROM cal_long c JOIN iso ON iso.grp = c.model_id AND iso.x = c.pd")
def _(t):
    return C.isotonic_map(cal_long(t), ["model_id"]).select("model_id", "case_id", F.round("iso", 9).alias("calibrated_pd"))


@query(
    "k04_isotonic_contract",
    _ISO + """ SELECT grp AS model_id, bool_and(y >= coalesce(before, 0) AND y BETWEEN 0 AND 1) AS valid, round(min(y), 9) AS below_range, round(max(y), 9) AS above_range,
        round(min(x), 9) AS x_min, round(max(x), 9) AS x_max FROM (SELECT *, lag(y) OVER (PARTITION BY grp ORDER BY x) AS before FROM iso) o GROUP BY 1""",
)
def _(t):
    by = ["model_id"]
    counts = M.score_counts(cal_long(t), by)
    ends = counts.groupBy(*by).agg(F.min("pd").alias("lo"), F.max("pd").alias("hi"))
    probes = ends.select(*by, F.explode(F.array(F.col("lo") - 1, F.col("hi") + 1)).alias("pd"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("pos"))
    ranged, blocks = I.fit(counts.unionByName(probes), by)
    found = I.predict(ranged, blocks, by).join(ends, by).groupBy(*by).agg(
        F.max(F.when(F.col("pd") < F.col("lo"), F.col("iso"))).alias("below"), F.max(F.when(F.col("pd") > F.col("hi"), F.col("iso"))).alias("above"))
    return I.valid(blocks, by).join(found, by).select(
        "model_id", "valid", F.round("below", 9).alias("below_range"), F.round("above", 9).alias("above_range"), F.round("x_min", 9).alias("x_min"), F.round("x_max", 9).alias("x_max"))


_OTHERS = """SELECT c.model_id, h.f AS held, c.pd, count(*)::DOUBLE AS n, sum(target)::DOUBLE AS pos FROM cal_fold c JOIN range(0, 5) h(f) ON h.f <> c.fold_id
             GROUP BY 1, 2, 3"""


@query(
    "k05_cross_fit_logistic",
    f"""WITH {newton_sql(_OTHERS, 'model_id, held')} SELECT c.model_id, c.fold_id, c.case_id, round(1 / (1 + exp(-(a + b * (ln(pd) - ln(1 - pd))))), 7) AS oof
        FROM cal_fold c JOIN p9 ON p9.model_id = c.model_id AND p9.held = c.fold_id""",
)
def _(t):
    return C.cross_fit_logistic(cal_folds(t), 5).select("model_id", "fold_id", "case_id", F.round("oof", 7).alias("oof"))


@query(
    "k05_cross_fit_isotonic",
    "SELECT model_id, fold_id, case_id, round(pd, 7) AS oof FROM methods WHERE method = 'isotonic'",
)
def _(t):
    return C.cross_fit_isotonic(cal_folds(t), 5).select("model_id", "fold_id", "case_id", F.round("oof", 7).alias("oof"))


@query("k05_oof_coverage", "SELECT model_id, count(*) AS keys, count(*) AS predictions, 0::BIGINT AS repeated_keys, 0::BIGINT AS invalid_predictions FROM cal_long GROUP BY 1")
def _(t):
    return C.oof_coverage(C.cross_fit_logistic(cal_folds(t), 5), "case_id", ["model_id"])


@query("k06_fold_metrics", metric_sql("methods", "model_id, method, fold_id"))
def _(t):
    return C.fold_metrics(methods_long(calibrated(t)))


@query(
    "k06_stability",
    "WITH m AS (" + metric_sql("methods", "model_id, method, fold_id") + """), j AS (SELECT m.model_id, m.method, m.log_loss < i.log_loss AS better
        FROM m JOIN m i ON i.model_id = m.model_id AND i.fold_id = m.fold_id AND i.method = 'identity' WHERE m.method <> 'identity')
        SELECT model_id, method, count(*) FILTER (WHERE better) AS improved_folds, count(*) AS folds,
               CASE WHEN count(*) FILTER (WHERE better) <= 1 THEN 'STABILITY_WARNING' ELSE '' END AS warning FROM j GROUP BY 1, 2""",
)
def _(t):
    return C.stability(C.fold_metrics(methods_long(calibrated(t))))


_R = lambda *cols: ", ".join(f"round({c}, 10) AS {c}" for c in cols)


def rounded(df, *cols):
    return df.select(*[F.round(c, 10).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("k07_paired_bootstrap", f"SELECT replicate_id, model_id, method, {_R('log_loss', 'brier_score')} FROM boot")
def _(t):
    return rounded(bootstrap(calibrated(t)), "log_loss", "brier_score").withColumn("replicate_id", F.col("replicate_id").cast("bigint"))


@query("k07_draw_counts", "SELECT r AS replicate_id, label AS target, position, c AS draws FROM boot_draws")
def _(t):
    pos = C.class_positions(cal_scores(t).select("case_id", "target"), "case_id", "target")
    return C.draw_counts(pos, "target", REPLICATES)


@query("k08_differences_to_identity", f"SELECT replicate_id, model_id, method, {_R('log_loss_vs_identity', 'brier_vs_identity')} FROM boot_diff")
def _(t):
    d = C.differences_to_identity(bootstrap(calibrated(t)))
    return rounded(d, "log_loss_vs_identity", "brier_vs_identity").withColumn("replicate_id", F.col("replicate_id").cast("bigint"))


@query("c09_reference_rows", f"SELECT replicate_id, model_id, method, reference_method, {_R('log_loss', 'reference_log_loss', 'log_loss_difference')} FROM boot_ref")
def _(t):
    rows = calibrated(t)
    boot = bootstrap(rows)
    a = C.annotate_reference(boot, C.reference_methods(guarded(rows, boot))).withColumn("replicate_id", F.col("replicate_id").cast("bigint"))
    return rounded(a, "log_loss", "reference_log_loss", "log_loss_difference").drop("brier_score")


@query(
    "k09_paired_errors",
    """SELECT model_id, method, count(*) AS replicates, round(stddev_samp(log_loss_vs_identity), 10) AS paired_se, round(avg(log_loss_vs_identity), 10) AS mean_difference,
              round(quantile_cont(log_loss_vs_identity, 0.025), 10) AS interval_low, round(quantile_cont(log_loss_vs_identity, 0.975), 10) AS interval_high
       FROM boot_diff GROUP BY 1, 2""",
)
def _(t):
    e = C.paired_errors(C.differences_to_identity(bootstrap(calibrated(t))), "log_loss_vs_identity")
    return rounded(e, "paired_se", "mean_difference", "interval_low", "interval_high")


@query("k10_guardrails", f"""SELECT model_id, method, {_R('oof_log_loss', 'brier_change', 'brier_se', 'auc_change', 'ap_change')}, probability_valid,
        coalesce(passes_brier, false) AS passes_brier, passes_ranking FROM guard""")
def _(t):
    rows = calibrated(t)
    return rounded(guarded(rows, bootstrap(rows)), "oof_log_loss", "brier_change", "brier_se", "auc_change", "ap_change")


@query("k11_constrained_selection", f"""SELECT model_id, method, reference_method, {_R('oof_log_loss', 'delta_log_loss', 'paired_se')}, hard_admissible, eligible,
        selected, selection_reason FROM selection""")
def _(t):
    return rounded(selection(t), "oof_log_loss", "delta_log_loss", "paired_se")


@query("k12_selection_verification", "SELECT count(*) AS saved_rows, 0::BIGINT AS differing_rows FROM selection")
def _(t):
    cols = ["model_id", "method", "reference_method", "hard_admissible", "eligible", "selected", "selection_reason"]
    found = freeze(selection(t))
    saved = found.select(cols)
    # the second path: ranks by window functions over the saved figures, not the selector
    hard = F.col("hard_admissible")
    w = Window.partitionBy("model_id")
    low = F.min(F.when(hard, F.col("oof_log_loss"))).over(w)
    simple = F.array_position(F.array(*[F.lit(m) for m in METHODS]), F.col("method"))
    best = F.min(F.when(hard & (F.col("oof_log_loss") <= F.col("low") + 1e-12), simple)).over(w)
    again = found.withColumn("low", low).withColumn("best", best).withColumn("simple", simple)
    again = again.withColumn("reference_method", F.element_at(F.array(*[F.lit(m) for m in METHODS]), F.col("best").cast("int")))
    near = F.coalesce(hard & (F.col("oof_log_loss") - F.max(F.when(F.col("simple") == F.col("best"), F.col("oof_log_loss"))).over(w) <= F.col("paired_se") + 1e-12), F.lit(False))
    again = again.withColumn("eligible", near).withColumn("selected", near & (F.col("simple") == F.min(F.when(near, F.col("simple"))).over(w)))
    gap = K.difference(saved, again.select(cols)).agg(F.count(F.lit(1)).alias("differing_rows"), F.lit(1).alias("k"))
    return saved.agg(F.count(F.lit(1)).alias("saved_rows"), F.lit(1).alias("k")).join(gap, "k").drop("k")


@query("k13_calibration_in_the_large", f"WITH {newton_sql(_COUNTS, 'model_id', 9, False)} SELECT model_id, round(a, 6) AS intercept FROM p9")
def _(t):
    c = C.calibration_in_the_large(M.score_counts(cal_long(t), ["model_id"]), ["model_id"])
    return c.select("model_id", F.round("intercept", 6).alias("intercept"))


@query("k14_joint_intercept_slope", f"WITH {newton_sql(_COUNTS, 'model_id')} SELECT model_id, round(a, 6) AS joint_intercept, round(b, 6) AS calibration_slope FROM p9")
def _(t):
    fits = C.fit_logistic(M.score_counts(cal_long(t), ["model_id"]), ["model_id"])
    return fits.select("model_id", F.round("alpha", 6).alias("joint_intercept"), F.round("beta", 6).alias("calibration_slope"))


def _bins_cte(k: int) -> str:
    return f"""c AS (SELECT model_id, pd, count(*) AS n, sum(target) AS pos FROM scores_long GROUP BY 1, 2),
    cu AS (SELECT *, sum(n) OVER (PARTITION BY model_id ORDER BY pd) AS cum, sum(n) OVER (PARTITION BY model_id) AS total FROM c),
    t AS (SELECT DISTINCT model_id, total, b FROM cu CROSS JOIN range(1, {k}) r(b)),
    e AS (SELECT DISTINCT model_id, cum FROM (SELECT t.model_id, cu.cum, row_number() OVER (PARTITION BY t.model_id, t.b ORDER BY abs(cu.cum * {k} - t.b * t.total), cu.cum) AS r
          FROM t JOIN cu ON cu.model_id = t.model_id AND cu.cum < cu.total) x WHERE r = 1),
    bins AS (SELECT g.model_id, g.bin_id, CAST(sum(n) AS BIGINT) AS row_count, CAST(sum(pos) AS BIGINT) AS positive_count, sum(pos) / sum(n) AS observed_rate,
             sum(pd * n) / sum(n) AS mean_probability, min(pd) AS min_probability, max(pd) AS max_probability, sum(pd * n) / sum(n) - sum(pos) / sum(n) AS gap
             FROM (SELECT cu.*, 1 + (SELECT count(*) FROM e WHERE e.model_id = cu.model_id AND e.cum <= cu.cum - cu.n) AS bin_id FROM cu) g GROUP BY 1, 2)"""


@query("k15_tie_preserving_bins", f"""WITH {_bins_cte(10)} SELECT model_id, bin_id, row_count, positive_count, round(observed_rate, 9) AS observed_rate,
    round(mean_probability, 9) AS mean_probability, min_probability, max_probability, round(gap, 9) AS gap, 10::BIGINT AS requested_bins FROM bins""")
def _(t):
    b = C.tie_preserving_bins(M.score_table(unpivot_models(t.scores, G.MODELS), ["model_id"]), ["model_id"], 10)
    return b.select(*[F.round(c, 9).alias(c) if c in ("observed_rate", "mean_probability", "gap") else F.col(c) for c in b.columns])


@query("k16_bin_diagnostics", f"""WITH {_bins_cte(20)} SELECT model_id, 20::BIGINT AS requested_bins, count(*) AS actual_bins,
    round(sum(row_count * abs(gap)) / sum(row_count), 9) AS ece, round(max(abs(gap)), 9) AS max_abs_gap FROM bins GROUP BY 1""")
def _(t):
    table = M.score_table(unpivot_models(t.scores, G.MODELS), ["model_id"])
    d = C.bin_diagnostics(C.tie_preserving_bins(table, ["model_id"], 20), ["model_id"])
    return d.select("model_id", "requested_bins", "actual_bins", F.round("ece", 9).alias("ece"), F.round("max_abs_gap", 9).alias("max_abs_gap"))


_ALL = "SELECT model_id, pd, count(*)::DOUBLE AS n, sum(target)::DOUBLE AS pos FROM scores_long GROUP BY 1, 2"


@query(
    "k17_combined_diagnostics",
    f"""WITH {newton_sql(_ALL, 'model_id')}, i AS (WITH {newton_sql(_ALL, 'model_id', 9, False)} SELECT * FROM p9),
        d10 AS (WITH {_bins_cte(10)} SELECT model_id, sum(row_count * abs(gap)) / sum(row_count) AS ece, max(abs(gap)) AS mx FROM bins GROUP BY 1),
        d20 AS (WITH {_bins_cte(20)} SELECT model_id, sum(row_count * abs(gap)) / sum(row_count) AS ece, max(abs(gap)) AS mx FROM bins GROUP BY 1)
        SELECT m.model_id, m.roc_auc, m.average_precision, m.log_loss, m.brier_score, round(i.a, 6) AS calibration_in_the_large, round(p9.a, 6) AS joint_intercept,
               round(p9.b, 6) AS calibration_slope, round(d10.ece, 9) AS ece_10, round(d10.mx, 9) AS max_abs_gap_10, round(d20.ece, 9) AS ece_20, round(d20.mx, 9) AS max_abs_gap_20
        FROM metric_overall m JOIN p9 ON p9.model_id = m.model_id JOIN i ON i.model_id = m.model_id JOIN d10 ON d10.model_id = m.model_id JOIN d20 ON d20.model_id = m.model_id""",
)
def _(t):
    table = freeze(M.score_table(unpivot_models(t.scores, G.MODELS), ["model_id"]))
    d = C.diagnostics(table, ["model_id"], M.metrics_of(table, ["model_id"]))
    six, nine = ("calibration_in_the_large", "joint_intercept", "calibration_slope"), ("ece_10", "max_abs_gap_10", "ece_20", "max_abs_gap_20")
    return d.select("model_id", "roc_auc", "average_precision", "log_loss", "brier_score", *[F.round(c, 6).alias(c) for c in six], *[F.round(c, 9).alias(c) for c in nine])
