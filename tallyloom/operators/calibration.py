"""Probability calibration: maps, cross-fitting, paired bootstrap, constrained selection, diagnostics.

All fits work on counts per distinct score, which loses nothing and keeps the repeated
passes small.  Every fit handles all groups (models, folds) in the same Spark job.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import probability as P
from ..session import freeze
from . import isotonic, resample
from .longform import count_where
from .metrics import binary_metrics, score_counts
from .ranking import running

# Calibration methods from simple to complex.
METHODS = ("identity", "logistic", "isotonic")
MAX_ITERATIONS = 50
TOLERANCE = 1e-10


def endpoint_counts(df: DataFrame, by: list[str], score: str = "pd") -> DataFrame:
    p = F.col(score)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("row_count"), count_where(p == 0).alias("exact_zero"), count_where(p == 1).alias("exact_one"))


def identity_map(score: str = "pd") -> Column:
    return F.col(score)


def logistic_map(score: str = "pd", alpha: str = "alpha", beta: str = "beta") -> Column:
    return P.sigmoid(F.col(alpha) + F.col(beta) * P.logit(F.col(score)))


# ---------------------------------------------------------------- logistic fits


def _params(spark: SparkSession, by: list[str], rows: list[dict], fields: dict[str, str]) -> DataFrame:
    schema = ", ".join(f"{b} {t}" for b, t in {**{b: rows[0]["types"][b] for b in by}, **fields}.items())
    return spark.createDataFrame([tuple(r[c] for c in [*by, *fields]) for r in rows], schema)


def _groups(base: DataFrame, by: list[str], types: dict[str, str]) -> list[dict]:
    """One dictionary per group (models x folds) with its row and positive counts."""
    sums = base.groupBy(*by).agg(F.sum("n").cast("double").alias("rows"), F.sum("pos").cast("double").alias("positives"),
                                 (F.sum(F.col("n") * F.col("z")) / F.sum("n")).alias("centre"))
    return [{**r.asDict(), "types": types} for r in sums.collect()]


def fit_logistic(counts: DataFrame, by: list[str]) -> DataFrame:
    """Maximum-likelihood intercept and slope on the logit of the score, one row per group.

    Newton steps from the constant model, halved when the likelihood falls.  Each step is
    one aggregate over the counts for all groups, and only six sums per group (models x
    folds) come back.  A group is valid when its steps converge and the slope is positive.
    """
    spark, types = counts.sparkSession, dict(counts.dtypes)
    base = freeze(counts.select(*by, "n", "pos", P.logit(F.col("pd")).alias("z")))
    groups = _groups(base, by, types)
    for g in groups:
        mixed = 0 < g["positives"] < g["rows"]
        g |= {"alpha": math.log(g["positives"] / (g["rows"] - g["positives"])) if mixed else 0.0, "beta": 0.0, "iterations": 0,
              "done": not mixed, "converged": False, "last": None, "fit": -math.inf}
    fields = {"alpha": "double", "beta": "double"}
    n, z, pos = F.col("n"), F.col("z"), F.col("pos")
    eta = F.col("alpha") + F.col("beta") * z
    mu = P.sigmoid(eta)
    w, r = n * mu * (F.lit(1.0) - mu), pos - n * mu
    softplus = F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta)))
    for _ in range(MAX_ITERATIONS):
        active = [g for g in groups if not g["done"]]
        if not active:
            break
        sums = base.join(F.broadcast(_params(spark, by, active, fields)), by).groupBy(*by).agg(
            F.sum(w).alias("s0"), F.sum(w * z).alias("s1"), F.sum(w * z * z).alias("s2"), F.sum(r).alias("r0"), F.sum(r * z).alias("r1"),
            F.sum(pos * eta - n * softplus).alias("fit"))
        found = {tuple(x[b] for b in by): x for x in sums.collect()}
        for g in active:
            x = found[tuple(g[b] for b in by)]
            g["iterations"] += 1
            if g["last"] and x["fit"] < g["fit"] - 1e-9 * abs(g["fit"]):
                g["alpha"], g["beta"] = (g["alpha"] + g["last"][0]) / 2, (g["beta"] + g["last"][1]) / 2
                continue
            det = x["s0"] * x["s2"] - x["s1"] ** 2
            if not det > 0:
                g["done"] = True
                continue
            da = (x["s2"] * x["r0"] - x["s1"] * x["r1"]) / det
            db = (x["s0"] * x["r1"] - x["s1"] * x["r0"]) / det
            g["last"], g["fit"] = (g["alpha"], g["beta"]), x["fit"]
            g["alpha"], g["beta"] = g["alpha"] + da, g["beta"] + db
            g["done"] = g["converged"] = max(abs(da), abs(db)) <= TOLERANCE
    for g in groups:
        g["valid"] = g["converged"] and g["beta"] > 0
    return _params(spark, by, groups, {**fields, "iterations": "bigint", "converged": "boolean", "valid": "boolean"})


def calibration_in_the_large(counts: DataFrame, by: list[str]) -> DataFrame:
    """Intercept a with sum(sigmoid(a + z) - y) = 0 per group, slope fixed at one.

    The residual grows with a, so a Newton step is taken where it stays inside the known
    bracket and a bisection step elsewhere; every step is one aggregate for all groups.
    """
    spark, types = counts.sparkSession, dict(counts.dtypes)
    base = freeze(counts.select(*by, "n", "pos", P.logit(F.col("pd")).alias("z")))
    groups = _groups(base, by, types)
    for g in groups:
        if not 0 < g["positives"] < g["rows"]:
            raise ValueError("a calibration intercept needs both outcome classes")
        g |= {"lo": -128.0, "hi": 128.0, "a": math.log(g["positives"] / (g["rows"] - g["positives"])) - g["centre"], "done": False}
    mu = P.sigmoid(F.col("a") + F.col("z"))
    for _ in range(500):
        active = [g for g in groups if not g["done"]]
        if not active:
            break
        sums = base.join(F.broadcast(_params(spark, by, active, {"a": "double"})), by).groupBy(*by).agg(
            F.sum(F.col("n") * mu - F.col("pos")).alias("f"), F.sum(F.col("n") * mu * (F.lit(1.0) - mu)).alias("d"))
        found = {tuple(x[b] for b in by): x for x in sums.collect()}
        for g in active:
            x = found[tuple(g[b] for b in by)]
            g["lo"], g["hi"] = (g["a"], g["hi"]) if x["f"] < 0 else (g["lo"], g["a"])
            step = g["a"] - x["f"] / x["d"] if x["d"] > 0 else math.inf
            new = step if g["lo"] < step < g["hi"] else (g["lo"] + g["hi"]) / 2
            g["done"] = abs(x["f"]) <= 1e-10 or g["hi"] - g["lo"] <= 1e-12 or abs(new - g["a"]) <= 1e-13
            g["a"] = g["a"] if abs(x["f"]) <= 1e-10 else new
    else:
        raise ValueError("calibration intercept did not converge")
    return _params(spark, by, [{**g, "intercept": g["a"]} for g in groups], {"intercept": "double"})


# ---------------------------------------------------------------- isotonic fits


def isotonic_map(rows: DataFrame, by: list[str]) -> DataFrame:
    """Fit each group's monotone map on its own rows (pd, target) and add it as ``iso``."""
    ranged, blocks = isotonic.fit(score_counts(rows, by), by)
    return rows.join(isotonic.predict(ranged, blocks, by), [*by, "pd"])


# ---------------------------------------------------------------- cross-fitting


def cross_fit_logistic(rows: DataFrame, k: int) -> DataFrame:
    """Out-of-fold logistic maps: rows need model_id, fold_id, pd and target."""
    counts = score_counts(rows, ["model_id", "fold_id"])
    others = counts.withColumn("held_out", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint")))).where("held_out <> fold_id")
    train = others.groupBy("model_id", "held_out", "pd").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    fits = fit_logistic(train, ["model_id", "held_out"]).withColumnRenamed("held_out", "fold_id")
    return rows.join(F.broadcast(fits), ["model_id", "fold_id"]).withColumn("oof", logistic_map()).select(*rows.columns, "oof")


def cross_fit_isotonic(rows: DataFrame, k: int) -> DataFrame:
    """Out-of-fold isotonic maps: every (model, fold) is fitted on the other folds' counts, all in the same passes.

    A score of the held-out fold that no other fold has is a point without rows, which is only predicted.
    """
    counts = score_counts(rows, ["model_id", "fold_id"])
    folds = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint")))
    other = F.col("held_out") != F.col("fold_id")
    points = counts.withColumn("held_out", folds).groupBy("model_id", "held_out", "pd").agg(
        F.sum(F.when(other, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(other, F.col("pos")).otherwise(0)).alias("pos"))
    by = ["model_id", "held_out"]
    ranged, blocks = isotonic.fit(points, by)
    maps = isotonic.predict(ranged, blocks, by).select("model_id", F.col("held_out").alias("fold_id"), "pd", F.col("iso").alias("oof"))
    return rows.join(maps, ["model_id", "fold_id", "pd"]).select(*rows.columns, "oof")


def oof_coverage(oof: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Each key must be predicted exactly once per group, inside [0, 1]."""
    p = F.col("oof")
    per = oof.groupBy(*by, key).agg(F.count(F.lit(1)).alias("n"), count_where(p.isNull() | F.isnan(p) | ~p.between(0.0, 1.0)).alias("bad"))
    return per.groupBy(*by).agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("predictions"),
                                count_where(F.col("n") != 1).alias("repeated_keys"), F.sum("bad").alias("invalid_predictions"))


def fold_metrics(rows: DataFrame) -> DataFrame:
    return binary_metrics(rows, ["model_id", "method", "fold_id"])


def stability(folds: DataFrame) -> DataFrame:
    """Methods that beat identity on at most one fold."""
    base = folds.where("method = 'identity'").select("model_id", "fold_id", F.col("log_loss").alias("base"))
    j = folds.where("method <> 'identity'").join(base, ["model_id", "fold_id"])
    a = j.groupBy("model_id", "method").agg(count_where(F.col("log_loss") < F.col("base")).alias("improved_folds"), F.count(F.lit(1)).alias("folds"))
    return a.withColumn("warning", F.when(F.col("improved_folds") <= 1, "STABILITY_WARNING").otherwise(""))


# ---------------------------------------------------------------- paired bootstrap


def class_positions(rows: DataFrame, key: str, label: str) -> DataFrame:
    """Position of every row inside its class, by key order."""
    r = running(rows, [label], [key])
    return r.withColumn("position", F.col("rn") - 1).withColumnRenamed("n_rows", "class_size").drop("rn")


def class_sizes(positions: DataFrame, label: str) -> dict[int, int]:
    """Rows per class: two rows."""
    return {int(r[label]): int(r["n"]) for r in positions.groupBy(label).agg(F.max("class_size").alias("n")).collect()}


def draw_counts(positions: DataFrame, label: str, replicates: int) -> DataFrame:
    """How often each class position is drawn per replicate; class sizes are kept."""
    found = resample.resample(positions, label, class_sizes(positions, label), replicates, [], counts=True)
    return found.withColumnRenamed("label", label)


def paired_bootstrap(rows: DataFrame, key: str, label: str, variants: dict[str, tuple[str, str]], replicates: int) -> DataFrame:
    """Replicate means of log loss and Brier score for every (model, method) column of ``rows``.

    ``variants`` maps a probability column to its (model_id, method).  All variants share the draws.  Losses stay in
    blocks of rows, which draw inside themselves as often as the replicate's tree of counts says.
    """
    y = F.col(label).cast("double")
    cols = list(variants)
    loss = rows.select(key, label, *[P.log_loss(y, F.col(c)).alias(f"l_{c}") for c in cols], *[P.squared_error(y, F.col(c)).alias(f"b_{c}") for c in cols])
    placed = freeze(class_positions(loss, key, label))
    sizes = class_sizes(placed, label)
    total = sum(sizes.values())
    values = [f"{k}_{c}" for k in ("l", "b") for c in cols]
    sums = resample.resample(placed, label, sizes, replicates, values).groupBy("replicate_id").agg(*[(F.sum(v) / F.lit(total)).alias(v) for v in values])
    return sums.select("replicate_id", F.inline(F.array(*[
        F.struct(F.lit(m).alias("model_id"), F.lit(meth).alias("method"), F.col(f"l_{c}").alias("log_loss"), F.col(f"b_{c}").alias("brier_score"))
        for c, (m, meth) in variants.items()])))


def annotate_reference(boot: DataFrame, references: DataFrame) -> DataFrame:
    """Attach to each replicate row the loss of its model's reference method in the same replicate."""
    named = boot.join(F.broadcast(references), "model_id", "left").withColumn(
        "reference_method", F.coalesce("reference_method", F.raise_error(F.lit("model without reference method"))))
    ref = boot.select("replicate_id", "model_id", F.col("method").alias("reference_method"), F.col("log_loss").alias("reference_log_loss"))
    return named.join(ref, ["replicate_id", "model_id", "reference_method"], "left").withColumn(
        "log_loss_difference", F.col("log_loss") - F.col("reference_log_loss"))


def differences_to_identity(boot: DataFrame) -> DataFrame:
    base = boot.where("method = 'identity'").select(
        "replicate_id", "model_id", F.col("log_loss").alias("l0"), F.col("brier_score").alias("b0"))
    return boot.join(base, ["replicate_id", "model_id"]).select(
        "replicate_id", "model_id", "method", (F.col("log_loss") - F.col("l0")).alias("log_loss_vs_identity"),
        (F.col("brier_score") - F.col("b0")).alias("brier_vs_identity"))


def paired_errors(diff: DataFrame, value: str) -> DataFrame:
    """Sample deviation and 95 % interval of paired replicate differences (replicates per group: a few thousand)."""
    v = F.col(value)
    q = F.percentile(v, F.array(F.lit(0.025), F.lit(0.975)))
    return diff.groupBy("model_id", "method").agg(
        F.count(v).alias("replicates"), F.stddev_samp(v).alias("paired_se"), F.avg(v).alias("mean_difference"), q.alias("__q")).select(
        "model_id", "method", "replicates", "paired_se", "mean_difference", F.col("__q")[0].alias("interval_low"), F.col("__q")[1].alias("interval_high"))


# ---------------------------------------------------------------- guardrails and selection


def guardrails(metrics: DataFrame, slopes: DataFrame, brier_errors: DataFrame) -> DataFrame:
    """Admissibility of each method: Brier change within its error, ranking kept."""
    base = metrics.where("method = 'identity'").select(
        "model_id", F.col("roc_auc").alias("auc0"), F.col("average_precision").alias("ap0"), F.col("brier_score").alias("brier0"))
    j = metrics.join(base, "model_id").join(slopes, ["model_id", "method"], "left").join(
        brier_errors.select("model_id", "method", F.col("paired_se").alias("brier_se")), ["model_id", "method"], "left")
    c = F.col
    d_auc, d_ap, d_brier = c("roc_auc") - c("auc0"), c("average_precision") - c("ap0"), c("brier_score") - c("brier0")
    brier_ok = F.when(c("method") == "identity", True).otherwise(d_brier <= c("brier_se"))
    kept = (F.abs(d_auc) <= 1e-10) & (F.abs(d_ap) <= 1e-10) & (c("slope") > 0)
    # the drop limit is a decimal and inclusive
    floor = lambda v: F.round(v, 12) >= F.lit(-0.0005)
    rank_ok = F.when(c("method") == "identity", True).when(c("method") == "logistic", kept).otherwise(floor(d_auc) & floor(d_ap))
    valid = (c("min_pd") >= 0) & (c("max_pd") <= 1)
    return j.select(
        "model_id", "method", F.col("log_loss").alias("oof_log_loss"), d_brier.alias("brier_change"), "brier_se", d_auc.alias("auc_change"),
        d_ap.alias("ap_change"), F.coalesce(valid, F.lit(False)).alias("probability_valid"), F.coalesce(brier_ok, F.lit(False)).alias("passes_brier"),
        F.coalesce(rank_ok, F.lit(False)).alias("passes_ranking"))


def _complexity() -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in METHODS]), F.col("method"))


def reference_methods(guarded: DataFrame, tie: float = 1e-12) -> DataFrame:
    """Numerically best admissible method per model; near ties go to the simpler one."""
    ok = guarded.where("probability_valid AND passes_brier AND passes_ranking")
    w = Window.partitionBy("model_id")  # one row per method
    best = ok.withColumn("low", F.min("oof_log_loss").over(w)).where(F.col("oof_log_loss") <= F.col("low") + F.lit(tie))
    return best.groupBy("model_id").agg(F.min_by("method", _complexity()).alias("reference_method"))


def select_method(guarded: DataFrame, references: DataFrame, errors: DataFrame) -> DataFrame:
    """Constrained choice: admissible, within one paired error of the best, simplest."""
    c = F.col
    ref_loss = guarded.select("model_id", c("method").alias("reference_method"), c("oof_log_loss").alias("ref_loss"))
    j = guarded.join(F.broadcast(references), "model_id", "left").join(ref_loss, ["model_id", "reference_method"], "left").join(
        errors.select("model_id", "method", "paired_se"), ["model_id", "method"], "left")
    hard = c("probability_valid") & c("passes_brier") & c("passes_ranking")
    se = F.when(c("method") == c("reference_method"), 0.0).otherwise(c("paired_se"))
    delta = c("oof_log_loss") - c("ref_loss")
    j = j.withColumns({
        "hard_admissible": hard, "delta_log_loss": F.when(hard, delta), "paired_se": F.when(hard, se),
        "eligible": F.coalesce(hard & (delta <= se + F.lit(1e-12)), F.lit(False)), "complexity": _complexity()})
    w = Window.partitionBy("model_id").orderBy(F.desc("eligible"), "complexity")
    j = j.withColumn("selected", F.col("eligible") & (F.row_number().over(w) == 1))
    reason = (F.when(~c("probability_valid"), "INVALID_FIT_OR_PROBABILITY").when(~c("hard_admissible"), "INELIGIBLE_HARD_CONSTRAINT")
              .when(c("selected"), "SELECTED_SIMPLEST_ELIGIBLE").when(c("eligible"), "ELIGIBLE_NOT_SIMPLEST").otherwise("OUTSIDE_ONE_SE_BAND"))
    return j.withColumn("selection_reason", reason).select(
        "model_id", "method", "reference_method", "oof_log_loss", "delta_log_loss", "paired_se", "hard_admissible", "eligible", "selected", "selection_reason")


# ---------------------------------------------------------------- bins and diagnostics


def bin_edges(table: DataFrame, by: list[str], bins: int) -> DataFrame:
    """Cumulative counts at which equal-count bins end, never inside equal scores.

    For each target b * N / K the nearest cumulative count wins, the lower one on a tie.
    Scores are first grouped by the number of targets they have reached (at most K + 1
    groups), so the targets meet K + 1 rows and not the score table.
    """
    n, k = F.col("cum_n_total"), F.lit(bins)
    inner = table.where(F.col("cum_n") < n)
    step = F.floor(F.col("cum_n") * k / n).cast("bigint")
    exact = F.when(step * n > F.col("cum_n") * k, step - 1).when((step + 1) * n <= F.col("cum_n") * k, step + 1).otherwise(step)
    reach = inner.groupBy(*by, exact.alias("reached")).agg(F.min("cum_n").alias("lo"), F.max("cum_n").alias("hi"), F.max("cum_n_total").alias("total"))
    per = reach.groupBy(*by).agg(F.max("total").alias("total"), F.collect_list(F.struct("reached", "lo", "hi")).alias("g"))
    targets = per.select(*by, "total", "g", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("b"))
    b, total = F.col("b"), F.col("total")
    below = F.array_max(F.transform(F.filter("g", lambda e: e["reached"] < b), lambda e: e["hi"]))
    above = F.array_min(F.transform(F.filter("g", lambda e: e["reached"] >= b), lambda e: e["lo"]))
    far_up, far_down = above * k - b * total, b * total - below * k  # distances times K, whole numbers
    edge = F.when(below.isNull(), above).when(above.isNull(), below).when(far_up < far_down, above).otherwise(below)
    return targets.select(*by, edge.alias("edge")).groupBy(*by).agg(F.sort_array(F.collect_set("edge")).alias("edges"))


def tie_preserving_bins(table: DataFrame, by: list[str], bins: int) -> DataFrame:
    """Calibration bins of a score table: counts, observed and mean predicted rate, gap."""
    if not by:
        raise ValueError("give at least one group column")
    edges = bin_edges(table, by, bins)
    start = F.col("cum_n") - F.col("n")
    # a group whose scores are all equal has no inner edge and forms one bin
    index = F.coalesce(F.size(F.filter("edges", lambda e: e <= start)), F.lit(0))
    b = table.join(F.broadcast(edges), by, "left").withColumn("bin_id", F.when(F.col("edges").isNull(), 1).otherwise(index + 1).cast("bigint"))
    n, pos, p = F.sum("n"), F.sum("pos"), F.sum(F.col("pd") * F.col("n"))
    a = b.groupBy(*by, "bin_id").agg(
        n.alias("row_count"), pos.alias("positive_count"), (pos / n).alias("observed_rate"), (p / n).alias("mean_probability"),
        F.min("pd").alias("min_probability"), F.max("pd").alias("max_probability"))
    return a.withColumns({"gap": F.col("mean_probability") - F.col("observed_rate"), "requested_bins": F.lit(bins).cast("bigint")})


def bin_diagnostics(bins: DataFrame, by: list[str]) -> DataFrame:
    """Expected calibration error and the largest absolute gap."""
    n, gap = F.col("row_count"), F.abs(F.col("gap"))
    return bins.groupBy(*by, "requested_bins").agg(
        F.count(F.lit(1)).alias("actual_bins"), (F.sum(n * gap) / F.sum(n)).alias("ece"), F.max(gap).alias("max_abs_gap"))


def diagnostics(table: DataFrame, by: list[str], metrics: DataFrame, bin_counts: tuple[int, ...] = (10, 20)) -> DataFrame:
    """Metrics, calibration intercepts and slope, and bin diagnostics in one row per group."""
    counts = table.select(*by, "pd", "n", "pos")
    citl = calibration_in_the_large(counts, by).withColumnRenamed("intercept", "calibration_in_the_large")
    joint = fit_logistic(counts, by).select(*by, F.col("alpha").alias("joint_intercept"), F.col("beta").alias("calibration_slope"))
    out = metrics.join(citl, by).join(joint, by)
    for k in bin_counts:
        d = bin_diagnostics(tie_preserving_bins(table, by, k), by)
        out = out.join(d.select(*by, F.col("ece").alias(f"ece_{k}"), F.col("max_abs_gap").alias(f"max_abs_gap_{k}")), by)
    return out
