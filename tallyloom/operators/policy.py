"""Ranks of several models, migration, approval and budget curves, scenario values."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import freeze
from .longform import count_where, ratio
from .ranking import equal_count_bin, more_parts, risk_percentile, running
from .scoring import expand_strata

# Approval rates in percent (40 to 80 by 0.25) and displayed points.
APPROVAL_RANGE = (4000, 8000, 25)
APPROVAL_ANCHORS = (4000, 5000, 6000, 7000, 8000)
# Mean score budgets (0.75 % to 2.00 % by 0.01 %) in units of 1e-4, and displayed points.
BUDGET_RANGE = (75, 200)
BUDGET_SCALE = 10_000
BUDGET_ANCHORS = (75, 100, 125, 150, 175, 200)
# Loss to gain ratios and the role each has in displays.
LOSS_RATIOS = {2: "detailed_only", 5: "detailed_only", 10: "detailed_only", 20: "lower_loss_sensitivity", 30: "primary",
               50: "higher_loss_sensitivity"}


def threshold(loss: int) -> float:
    """1 / (1 + L), written with 18 decimals and read back as a double."""
    return float(format(Decimal(1) / (Decimal(1) + Decimal(loss)), ".18f"))


def approval_grid(spark: SparkSession, span: tuple[int, int, int] = APPROVAL_RANGE, anchors: tuple[int, ...] = APPROVAL_ANCHORS) -> DataFrame:
    lo, hi, step = span
    g = spark.range(lo, hi + 1, step, 1).select(F.col("id").alias("rate_bp"))
    return g.select(
        "rate_bp", ((F.col("rate_bp") - lo) / step + 1).cast("bigint").alias("grid_order"),
        (F.col("rate_bp").cast("decimal(10,0)") / 100).cast("decimal(6,2)").alias("approval_rate_percent"),
        F.col("rate_bp").isin(*anchors).alias("is_display_point"))


def budget_grid(spark: SparkSession, span: tuple[int, int] = BUDGET_RANGE, anchors: tuple[int, ...] = BUDGET_ANCHORS) -> DataFrame:
    lo, hi = span
    g = spark.range(lo, hi + 1, 1, 1).select(F.col("id").alias("budget_unit"))
    return g.select(
        "budget_unit", (F.col("budget_unit") - lo + 1).alias("grid_order"), (F.col("budget_unit") / BUDGET_SCALE).alias("risk_budget"),
        F.col("budget_unit").isin(*anchors).alias("is_display_point"))


def scenario_grid(spark: SparkSession, ratios: dict[int, str] | None = None) -> DataFrame:
    rows = [(f"gain_loss_{k}", k, threshold(k), role) for k, role in (ratios or LOSS_RATIOS).items()]
    return spark.createDataFrame(rows, "scenario_id string, loss_to_gain_ratio bigint, pd_threshold double, display_role string")


def ranked(long: DataFrame) -> DataFrame:
    """Stable total order per model (score, base order) with running score and outcome sums."""
    return running(long, ["model_id"], ["pd", "base_order"], {"cum_pd": F.col("pd"), "cum_y": F.col("target")}, rows=long.count())


def approved_count(n: Column, rate_bp: Column) -> Column:
    """floor(n * rate / 100) in whole numbers."""
    return F.floor(F.try_divide((n * rate_bp).cast("decimal(38,0)"), F.lit(10000).cast("decimal(38,0)"))).cast("bigint")


def approval_curve(r: DataFrame, grid: DataFrame) -> DataFrame:
    """Accept the floor(n * rate) lowest scores: one ranked row answers each grid point.

    The grid is attached to the per-model totals (models x grid points rows), so the ranked
    table is only filtered by an equi-join on (model, position).
    """
    totals = r.groupBy("model_id").agg(F.max("n_rows").alias("n"), F.min("pd").alias("lowest"))
    points = _attach(totals, grid).withColumn("rn", approved_count(F.col("n"), F.col("rate_bp")))
    hit = r.select("model_id", "rn", "pd", "cum_pd", "cum_y").join(F.broadcast(points), ["model_id", "rn"])
    k = F.col("rn")
    return hit.select(
        "model_id", F.col("approval_rate_percent").cast("double").alias("approval_rate_percent"), "is_display_point", k.alias("approved_count"),
        (F.col("n") - k).alias("rejected_count"), F.round(k * 100 / F.col("n"), 9).alias("actual_approval_rate_percent"),
        F.col("pd").alias("cutoff"), F.col("lowest").alias("approved_minimum"), F.round(F.col("cum_pd") / k, 9).alias("approved_mean_pd"),
        F.round("cum_pd", 6).alias("expected_defaults"), F.col("cum_y").alias("realised_defaults"),
        (k - F.col("cum_y")).alias("realised_non_defaults"), F.round(F.col("cum_y") / k, 9).alias("realised_default_rate"))


def _attach(totals: DataFrame, grid: DataFrame) -> DataFrame:
    """Every grid point for every row of a small totals table."""
    points = grid.agg(F.collect_list(F.struct(*grid.columns)).alias("g")).withColumn("__one", F.lit(1))
    return totals.withColumn("__one", F.lit(1)).join(F.broadcast(points), "__one").drop("__one").select("*", F.inline("g")).drop("g")


def budget_unit(mean: Column, scale: int = BUDGET_SCALE) -> Column:
    """Smallest whole unit u with mean <= u / scale, exact at the borders."""
    u = F.ceil(mean * scale)
    return F.when((u - 1) / scale >= mean, u - 1).when(u / scale < mean, u + 1).otherwise(u).cast("bigint")


def risk_budget_curve(r: DataFrame, grid: DataFrame, span: tuple[int, int] = BUDGET_RANGE) -> DataFrame:
    """Largest prefix whose mean score stays within each budget.

    Every row falls into the first budget unit that admits its running mean; one aggregate
    per (model, unit) keeps the longest prefix, and a running maximum over the grid fills in.
    """
    lo, hi = span
    k = F.col("rn")
    unit = F.greatest(budget_unit(F.col("cum_pd") / k), F.lit(lo))
    best = r.withColumn("budget_unit", unit).where(F.col("budget_unit") <= hi).groupBy("model_id", "budget_unit").agg(
        F.max(F.struct(k.alias("k"), "cum_pd", "cum_y", "pd")).alias("b"))
    totals = r.groupBy("model_id").agg(F.max("n_rows").alias("n"))
    w = Window.partitionBy("model_id").orderBy("budget_unit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    g = _attach(totals, grid).join(best, ["model_id", "budget_unit"], "left").withColumn("b", F.max("b").over(w))
    kk, n = F.coalesce(F.col("b.k"), F.lit(0)), F.col("n")
    mean = F.col("b.cum_pd") / F.col("b.k")
    y = F.coalesce(F.col("b.cum_y"), F.lit(0))
    return g.select(
        "model_id", "risk_budget", "is_display_point", F.round(kk * 100 / n, 9).alias("maximum_approval_rate_percent"), kk.alias("approved_count"),
        (n - kk).alias("rejected_count"), F.col("b.pd").alias("cutoff"), F.round(mean, 9).alias("approved_mean_pd"),
        F.round(F.coalesce(F.col("b.cum_pd"), F.lit(0.0)), 6).alias("expected_defaults"), y.alias("realised_defaults"),
        (kk - y).alias("realised_non_defaults"), F.round(y / F.col("b.k"), 9).alias("realised_default_rate"),
        F.round(F.col("risk_budget") - mean, 9).alias("budget_slack"), (kk > 0).alias("feasible"),
        F.when(kk > 0, "FEASIBLE").otherwise("NO_POSITIVE_PREFIX_FEASIBLE").alias("status"))


def invert_budgets(curve: DataFrame, budgets: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Highest rate of a coarse curve whose mean score is within each common budget.

    ``curve`` holds one row per (model, rate) and ``budgets`` its distinct means, so both
    have at most models x grid rows; they meet in one sorted sequence per model.
    """
    marks = curve.select("model_id").distinct()
    b = _attach(marks, budgets).select("model_id", F.col("common_budget").alias("level"), F.lit(1).alias("is_budget"),
                                       F.lit(None).cast("double").alias("rate"), F.lit(None).cast("bigint").alias("k"))
    c = curve.select("model_id", (F.col("approved_mean_pd") - F.lit(tolerance)).alias("level"), F.lit(0).alias("is_budget"),
                     F.col("approval_rate_percent").alias("rate"), F.col("approved_count").alias("k"))
    w = Window.partitionBy("model_id").orderBy("level", "is_budget").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    u = b.unionByName(c).withColumn("best", F.max(F.when(F.col("is_budget") == 0, F.struct("rate", "k"))).over(w))
    return u.where("is_budget = 1").select(
        "model_id", F.col("level").alias("common_budget"), F.coalesce("best.rate", F.lit(0.0)).alias("maximum_approval_rate_percent"),
        F.coalesce("best.k", F.lit(0)).alias("approved_count"), F.col("best").isNotNull().alias("feasible"))


def common_budgets(curve: DataFrame, decimals: int = 12) -> DataFrame:
    return curve.select(F.round("approved_mean_pd", decimals).alias("common_budget")).distinct()


# ---------------------------------------------------------------- model pairs


def pair_ranks(predictions: DataFrame, pairs: dict[str, tuple[str, str]], keep: list[str], r: DataFrame | None = None) -> DataFrame:
    """One row per (family, case): scores and ranks of both models of the pair.

    All models are ranked in one long table of keys and scores, unless ``r`` holds the ranks
    already; they come back to one row per case by a keyed aggregate, and only then meet the labels.
    """
    models = tuple(m for p in pairs.values() for m in p)
    rows = predictions.count() * len(models)
    if r is None:
        narrow = predictions.unpivot(["case_id", "base_order"], list(models), "model_id", "pd")
        r = running(narrow, ["model_id"], ["pd", "base_order"], rows=rows)
    if parts := more_parts(predictions.sparkSession, rows):
        r = r.select("case_id", "model_id", "rn", "n_rows").repartition(parts, "case_id")  # a row per model and case: nothing to combine before the shuffle
    m = F.col("model_id")
    ranks = r.groupBy("case_id").agg(
        F.max("n_rows").alias("n"), *[F.max(F.when(m == name, F.col("rn"))).alias(f"rn_{name}") for name in models])
    wide = predictions.select("case_id", "target", *keep, *models).join(ranks, "case_id")
    items = [F.struct(F.lit(f).alias("algorithm_family"), F.col(a).alias("pd_t"), F.col(b).alias("pd_ad"), F.col(f"rn_{a}").alias("rn_t"),
                      F.col(f"rn_{b}").alias("rn_ad")) for f, (a, b) in pairs.items()]
    return wide.select("case_id", "target", *keep, "n", F.inline(F.array(*items)))


def reassessment(pairs: DataFrame, dimensions: dict[str, str]) -> DataFrame:
    """Score and percentile changes per stratum, as long rows for ``distribution_summary``."""
    dp = F.col("pd_ad") - F.col("pd_t")
    dr = risk_percentile(F.col("rn_ad"), F.col("n")) - risk_percentile(F.col("rn_t"), F.col("n"))
    rows = expand_strata(pairs, dimensions)
    return rows.select("algorithm_family", "dim", "label", F.inline(F.array(
        F.struct(F.lit("delta_pd").alias("measure"), dp.alias("v")), F.struct(F.lit("delta_risk_percentile").alias("measure"), dr.alias("v")))))


def migration(pairs: DataFrame, dimensions: dict[str, str], bins: tuple[int, ...]) -> DataFrame:
    """Bin-to-bin counts per stratum with zero cells.

    Cells are counted once at the finest bin count; coarser bins divide it and are folded
    from those at most finest^2 cells per stratum.
    """
    top = max(bins)
    if any(top % k for k in bins):
        raise ValueError("every bin count must divide the largest one")
    fine = expand_strata(pairs.select("*", equal_count_bin(F.col("rn_t"), F.col("n"), top).alias("bt"),
                                      equal_count_bin(F.col("rn_ad"), F.col("n"), top).alias("ba")), dimensions)
    by = ["algorithm_family", "dim", "label"]
    cells = freeze(fine.groupBy(*by, "bt", "ba").agg(F.count(F.lit(1)).alias("c"), F.sum("target").alias("y")))  # read twice
    fold = cells.select(*by, "c", "y", F.inline(F.array(*[
        F.struct(F.lit(k).cast("bigint").alias("n_bins"), (F.floor((F.col("bt") - 1) * k / top) + 1).alias("t_bin"),
                 (F.floor((F.col("ba") - 1) * k / top) + 1).alias("ad_bin")) for k in bins])))
    counted = fold.groupBy(*by, "n_bins", "t_bin", "ad_bin").agg(F.sum("c").alias("case_count"), F.sum("y").alias("default_count"))
    groups = cells.select(*by).distinct()
    grid = groups.select(*by, F.inline(F.array(*[F.struct(F.lit(k).cast("bigint").alias("n_bins")) for k in bins])))
    axis = F.sequence(F.lit(1).cast("bigint"), F.col("n_bins"))
    grid = grid.select("*", F.explode(axis).alias("t_bin")).select("*", F.explode(axis).alias("ad_bin"))
    full = grid.join(counted, [*by, "n_bins", "t_bin", "ad_bin"], "left").fillna(0, ["case_count", "default_count"])
    whole, origin = Window.partitionBy(*by, "n_bins"), Window.partitionBy(*by, "n_bins", "t_bin")
    n, y = F.col("case_count"), F.col("default_count")
    return full.select(
        *by, "n_bins", "t_bin", "ad_bin", n, F.round(ratio(n, F.sum(n).over(whole)), 9).alias("share_of_stratum"),
        F.round(ratio(n, F.sum(n).over(origin)), 9).alias("share_within_t_bin"), y, F.round(ratio(y, n), 9).alias("observed_default_rate"))


def approval_switches(pairs: DataFrame, dimensions: dict[str, str], anchors: tuple[int, ...] = APPROVAL_ANCHORS) -> DataFrame:
    """Both / one / neither accepted at each anchor rate, per stratum, with zero cells.

    A row's fate at all anchors is fixed by the first anchor that accepts it under each
    model, so rows are counted per pair of first anchors and only those cells are expanded.
    """
    n = F.col("n")
    first = lambda rn: sum((F.when(F.col(rn) > approved_count(n, F.lit(a)), 1).otherwise(0) for a in anchors), F.lit(0))
    by = ["algorithm_family", "dim", "label"]
    rows = expand_strata(pairs.select("*", first("rn_t").alias("it"), first("rn_ad").alias("ia")), dimensions)
    cells = freeze(rows.groupBy(*by, "it", "ia").agg(
        F.max("n").alias("n"), F.count(F.lit(1)).alias("c"), F.sum("target").alias("y"), F.sum("pd_t").alias("st"), F.sum("pd_ad").alias("sa")))
    spread = cells.select("*", F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("rate_bp")) for i, a in enumerate(anchors)])))
    t, d = F.col("it") <= F.col("i"), F.col("ia") <= F.col("i")
    named = F.when(t & d, "both_approved").when(t, "T_only_approved").when(d, "T_plus_AD_only_approved").otherwise("both_rejected")
    counted = spread.groupBy(*by, "rate_bp", named.alias("switch_category")).agg(*[F.sum(c).alias(c) for c in ("c", "y", "st", "sa")])
    names = ("both_approved", "T_only_approved", "T_plus_AD_only_approved", "both_rejected")
    grid = cells.groupBy(*by).agg(F.max("n").alias("n")).select(
        *by, "n", F.explode(F.array(*map(F.lit, anchors))).alias("rate_bp")).select("*", F.explode(F.array(*map(F.lit, names))).alias("switch_category"))
    full = grid.join(counted, [*by, "rate_bp", "switch_category"], "left").fillna(0, ["c", "y"])
    c, y = F.col("c"), F.col("y")
    whole = Window.partitionBy(*by, "rate_bp")
    mean = lambda x: F.round(F.try_divide(x, c), 9)
    return full.select(
        *by, (F.col("rate_bp") / 100).alias("approval_rate_percent"), approved_count(F.col("n"), F.col("rate_bp")).alias("approved_count_each_model"),
        "switch_category", c.alias("case_count"), F.round(ratio(c, F.sum(c).over(whole)), 9).alias("share_of_stratum"),
        y.alias("default_count"), F.round(ratio(y, c), 9).alias("observed_default_rate"), mean(F.col("st")).alias("mean_pd_t"),
        mean(F.col("sa")).alias("mean_pd_ad"), mean(F.col("sa") - F.col("st")).alias("mean_delta_pd"))


# ---------------------------------------------------------------- scenario value


def scenario_values(long: DataFrame, ratios: dict[int, str] | None = None) -> DataFrame:
    """Expected and realised value of accepting scores below 1 / (1 + L), all ratios in one aggregate."""
    ratios = ratios or LOSS_RATIOS
    p, y = F.col("pd"), F.col("target")
    aggs = [F.count(F.lit(1)).alias("n")]
    for k in ratios:
        ok = p < F.lit(threshold(k))
        aggs += [count_where(ok).alias(f"k{k}"), F.coalesce(F.sum(F.when(ok, y)), F.lit(0)).alias(f"y{k}"),
                 F.coalesce(F.sum(F.when(ok, p)), F.lit(0.0)).alias(f"p{k}"),
                 F.coalesce(F.sum(F.when(ok, (F.lit(1.0) - p) - p * k)), F.lit(0.0)).alias(f"v{k}")]
    wide = long.groupBy("model_id").agg(*aggs)
    rows = wide.select("model_id", "n", F.inline(F.array(*[F.struct(
        F.lit(k).cast("bigint").alias("loss_ratio"), F.lit(threshold(k)).alias("pd_threshold"), F.lit(role).alias("display_role"),
        F.col(f"k{k}").alias("k"), F.col(f"y{k}").alias("y"), F.col(f"p{k}").alias("p"), F.col(f"v{k}").alias("v")) for k, role in ratios.items()])))
    n, k, y, v = (F.col(c) for c in ("n", "k", "y", "v"))
    good = k - y
    realised = (good - y * F.col("loss_ratio")).cast("double")
    return rows.select(
        "model_id", "loss_ratio", "pd_threshold", "display_role", k.alias("approved_count"), (n - k).alias("rejected_count"),
        F.round(k * 100 / n, 9).alias("approval_rate_percent"), good.alias("approved_non_defaults"), y.alias("approved_defaults"),
        F.round(ratio(y, k), 9).alias("approved_default_rate"), F.round(F.try_divide(F.col("p"), k), 9).alias("approved_mean_pd"),
        F.round(v, 5).alias("expected_value"), F.round(v / n, 9).alias("expected_value_per_case"),
        F.round(F.try_divide(v, k), 9).alias("expected_value_per_approved"), realised.alias("realised_value"),
        F.round(realised / n, 9).alias("realised_value_per_case"), F.round(F.try_divide(realised, k), 9).alias("realised_value_per_approved"), n.alias("n_cases"))


def value_comparison(values: DataFrame, comparisons: list[tuple[str, str, str, str]]) -> DataFrame:
    """Candidate minus reference per scenario; break-even cost per case within a family."""
    spark = values.sparkSession
    pairs = spark.createDataFrame(comparisons, "comparison_type string, comparison_id string, reference_model string, candidate_model string")
    cols = ["approved_count", "approval_rate_percent", "approved_defaults", "approved_default_rate", "expected_value", "realised_value",
            "expected_value_per_case", "realised_value_per_case"]
    ref = values.select(F.col("model_id").alias("reference_model"), "loss_ratio", "display_role", "n_cases", *[F.col(c).alias(f"r_{c}") for c in cols])
    cand = values.select(F.col("model_id").alias("candidate_model"), "loss_ratio", *[F.col(c).alias(f"c_{c}") for c in cols])
    j = F.broadcast(pairs).join(ref, "reference_model").join(cand, ["candidate_model", "loss_ratio"])
    change = lambda c, digits=9: F.round(F.col(f"c_{c}") - F.col(f"r_{c}"), digits)
    within = F.col("comparison_type") == "within_family"
    realised = F.col("c_realised_value") - F.col("r_realised_value")
    return j.select(
        "comparison_type", "comparison_id", "reference_model", "candidate_model", "loss_ratio", "display_role",
        (F.col("c_approved_count") - F.col("r_approved_count")).alias("approved_count_change"), change("approval_rate_percent").alias("approval_rate_change"),
        (F.col("c_approved_defaults") - F.col("r_approved_defaults")).alias("default_count_change"), change("approved_default_rate").alias("default_rate_change"),
        change("expected_value", 4).alias("expected_value_change"), realised.alias("realised_value_change"),
        change("realised_value_per_case", 7).alias("realised_value_per_case_change"),
        F.round(F.when(within, realised / F.col("n_cases")), 9).alias("break_even_cost_per_case"))


def grids_on(predictions: DataFrame, score: str) -> DataFrame:
    """The three policy grids with the number of cases each point admits under one score.

    Scores are counted per budget unit and per first admitting ratio; the grids then only
    take running sums over those few counts.
    """
    spark, p = predictions.sparkSession, F.col(score)
    unit = F.least(F.greatest(budget_unit(p), F.lit(BUDGET_RANGE[0])), F.lit(BUDGET_RANGE[1] + 1))
    ratios = sorted(LOSS_RATIOS)
    a = predictions.agg(F.count(F.lit(1)).alias("n"), *[count_where(p < F.lit(threshold(k))).alias(f"r{k}") for k in ratios])
    rates = _attach(a.select("n"), approval_grid(spark)).select(
        F.lit("approval").alias("grid"), "grid_order", (F.col("rate_bp") / 10000).alias("level"), "is_display_point",
        approved_count(F.col("n"), F.col("rate_bp")).alias("case_count"))
    units = predictions.groupBy(unit.alias("budget_unit")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(F.lit(0)).orderBy("budget_unit").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row per unit
    budgets = budget_grid(spark).join(units, "budget_unit", "left").select(
        F.lit("budget").alias("grid"), "grid_order", F.col("risk_budget").alias("level"), "is_display_point",
        F.coalesce(F.sum("c").over(w), F.lit(0)).alias("case_count"))
    losses = a.select(F.inline(F.array(*[
        F.struct(F.lit("loss_ratio").alias("grid"), F.lit(i).cast("bigint").alias("grid_order"), F.lit(threshold(k)).alias("level"),
                 F.lit(LOSS_RATIOS[k] != "detailed_only").alias("is_display_point"), F.col(f"r{k}").alias("case_count"))
        for i, k in enumerate(ratios, 1)])))
    return rates.unionByName(budgets).unionByName(losses)


def reconcile_anchors(curve: DataFrame, saved: DataFrame) -> DataFrame:
    """Saved anchor points against the curve, per model: an absent point or one that differs beyond rounding is a mismatch."""
    a = saved.select("model_id", "approval_rate_percent", F.col("approved_count").alias("__count"), F.col("approved_mean_pd").alias("__mean"))
    j = a.join(curve.select("model_id", "approval_rate_percent", "approved_count", "approved_mean_pd"), ["model_id", "approval_rate_percent"], "left")
    same = F.coalesce((F.col("__count") == F.col("approved_count")) & (F.abs(F.col("__mean") - F.col("approved_mean_pd")) <= 1e-12), F.lit(False))
    return j.groupBy("model_id").agg(F.count(F.lit(1)).alias("anchor_points"), count_where(~same).alias("mismatches"))
