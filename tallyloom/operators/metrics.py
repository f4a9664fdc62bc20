"""Exact ranking and probability metrics from counts per distinct score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import probability as P
from .longform import count_where, ratio
from .ranking import running


def score_counts(df: DataFrame, by: list[str], score: str = "pd", label: str = "target") -> DataFrame:
    """Rows and positives per distinct score; everything below works on this reduction."""
    return df.groupBy(*by, F.col(score).alias("pd")).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("pos"))


def score_table(df: DataFrame, by: list[str], score: str = "pd", label: str = "target") -> DataFrame:
    """Distinct scores with running rows, positives and score sums from the lowest score up."""
    n, pos = F.col("n"), F.col("pos")
    sums = {"cum_n": n, "cum_pos": pos, "cum_pd": F.col("pd") * n}
    return running(score_counts(df, by, score, label), by, ["pd"], sums, totals=True).drop("rn", "n_rows")


def metrics_of(table: DataFrame, by: list[str], digits: int = 9) -> DataFrame:
    """One row per group: counts, ROC AUC, average precision, log loss, Brier score, score range.

    Undefined ranking metrics of a one-class group are NULL with a PARTIAL status.
    """
    p, n, pos = F.col("pd"), F.col("n").cast("double"), F.col("pos").cast("double")
    neg = n - pos
    big_n, big_p = F.col("cum_n_total").cast("double"), F.col("cum_pos_total").cast("double")
    neg_below = (F.col("cum_n") - F.col("cum_pos")).cast("double") - neg
    tp_from_top, n_from_top = big_p - (F.col("cum_pos") - pos), big_n - (F.col("cum_n") - n)
    a = table.groupBy(*by).agg(
        F.sum("n").alias("sample_count"), F.sum("pos").alias("positive_count"),
        F.sum(pos * (neg_below + neg / 2)).alias("__wins"), F.sum(pos * tp_from_top / n_from_top).alias("__ap"),
        (F.sum(pos * P.log_loss(F.lit(1.0), p) + neg * P.log_loss(F.lit(0.0), p)) / F.sum(n)).alias("log_loss"),
        (F.sum(pos * P.squared_error(F.lit(1.0), p) + neg * P.squared_error(F.lit(0.0), p)) / F.sum(n)).alias("brier_score"),
        (F.sum(p * n) / F.sum(n)).alias("mean_pd"), F.min(p).alias("min_pd"), F.max(p).alias("max_pd"),
    )
    count, positives = F.col("sample_count"), F.col("positive_count")
    negatives = count - positives
    both = (positives > 0) & (negatives > 0)
    rounded = lambda c, name: F.round(c, digits).alias(name)
    return a.select(
        *by, "sample_count", "positive_count", negatives.alias("negative_count"),
        rounded(ratio(positives, count), "observed_rate"), rounded(F.col("mean_pd"), "mean_pd"),
        rounded(F.when(both, F.col("__wins") / (positives.cast("double") * negatives)), "roc_auc"),
        rounded(F.when(both, F.col("__ap") / positives), "average_precision"),
        rounded(F.col("log_loss"), "log_loss"), rounded(F.col("brier_score"), "brier_score"), rounded(F.col("min_pd"), "min_pd"),
        rounded(F.col("max_pd"), "max_pd"),
        F.when(both, "PASS").otherwise("PARTIAL_SINGLE_CLASS").alias("metric_status"),
    )


def binary_metrics(df: DataFrame, by: list[str], score: str = "pd", label: str = "target", digits: int = 9) -> DataFrame:
    return metrics_of(score_table(df, by, score, label), by, digits)


def gains(metrics: DataFrame, by: list[str], pairs: dict[str, tuple[str, str]], model: str = "model_id") -> DataFrame:
    """Extended model against reference model per family, oriented so that positive is better."""
    m = F.col(model)
    family = reduce(lambda acc, kv: acc.when(m.isin(*kv[1]), kv[0]), pairs.items(), F.when(F.lit(False), None))
    is_ref = m.isin(*[a for a, _ in pairs.values()])
    names = ("roc_auc", "average_precision", "log_loss", "brier_score", "mean_pd", "metric_status", "sample_count")
    tagged = metrics.select("*", family.alias("algorithm_family"), is_ref.alias("__ref")).where(F.col("algorithm_family").isNotNull())
    wide = tagged.groupBy(*by, "algorithm_family").agg(*[x for c in names for x in (
        F.max(F.when(F.col("__ref"), F.col(c))).alias(f"r_{c}"), F.max(F.when(~F.col("__ref"), F.col(c))).alias(f"c_{c}"))])
    c = F.col
    up = lambda k: F.round(c(f"c_{k}") - c(f"r_{k}"), 9)
    down = lambda k: F.round(c(f"r_{k}") - c(f"c_{k}"), 9)
    ok = (c("r_metric_status") == "PASS") & (c("c_metric_status") == "PASS")
    return wide.select(
        *by, "algorithm_family", c("r_sample_count").alias("sample_count"), up("roc_auc").alias("roc_auc_gain"),
        up("average_precision").alias("average_precision_gain"), down("log_loss").alias("log_loss_gain"),
        down("brier_score").alias("brier_gain"), up("mean_pd").alias("mean_pd_change"), F.when(ok, "PASS").otherwise("PARTIAL").alias("gain_status"))


def prevalence_reference(df: DataFrame, label: str = "target") -> DataFrame:
    """Metrics of the constant prevalence score, from two counts.

    All rows tie, so the AUC is one half and the average precision is the prevalence.
    """
    a = df.agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("pos"))
    q = ratio(F.col("pos"), F.col("n"))
    ll = q * P.log_loss(F.lit(1.0), q) + (F.lit(1.0) - q) * P.log_loss(F.lit(0.0), q)
    return a.select(
        F.lit("constant_prevalence").alias("model_id"), F.col("n").alias("sample_count"), F.col("pos").alias("positive_count"),
        F.lit(0.5).alias("roc_auc"), F.round(q, 9).alias("average_precision"), F.round(ll, 9).alias("log_loss"),
        F.round(q * (F.lit(1.0) - q), 9).alias("brier_score"), F.round(q, 9).alias("mean_pd"))


def top_risk(table: DataFrame, by: list[str], shares: list[float]) -> DataFrame:
    """Rows at or above the k-th highest score, k = ceil(share * n); ties at the cutoff are kept."""
    n, below = F.col("cum_n_total"), F.col("cum_n") - F.col("n")
    items = []
    for s in shares:
        rank_from_bottom = n - F.ceil(F.lit(float(s)) * n) + 1
        here = (below < rank_from_bottom) & (rank_from_bottom <= F.col("cum_n"))
        items.append(F.when(here, F.lit(float(s))))
    rows = table.select("*", F.explode(F.array_compact(F.array(*items))).alias("target_share"))
    kept = n - below
    pos = F.col("cum_pos_total") - (F.col("cum_pos") - F.col("pos"))
    total = F.col("cum_pd_total") - (F.col("cum_pd") - F.col("pd") * F.col("n"))
    return rows.select(
        *by, "target_share", kept.alias("actual_rows"), F.round(ratio(kept, n), 9).alias("actual_share"), F.col("pd").alias("cutoff"),
        F.round(total / kept, 9).alias("mean_probability"), F.round(ratio(pos, kept), 9).alias("observed_rate"), pos.alias("positive_count"))


def select_candidate(candidates: DataFrame, by: list[str], complexity: str, band: float = 1e-4) -> DataFrame:
    """Annotate candidates: eligible, within the band below the best average precision, selected.

    Candidate tables hold one row per fitted model, so the windows are small.
    """
    ok = F.col("eligible")
    top = F.max(F.when(ok, F.col("average_precision"))).over(Window.partitionBy(*by))
    inside = ok & (F.col("average_precision") >= top - F.lit(band))
    order = Window.partitionBy(*by).orderBy(F.desc("in_band"), "log_loss", complexity, "candidate_id")
    a = candidates.withColumn("in_band", F.coalesce(inside, F.lit(False))).withColumn("__rn", F.row_number().over(order))
    chosen = F.col("in_band") & (F.col("__rn") == 1)
    reason = (F.when(chosen, "SELECTED").when(F.col("in_band"), "ELIGIBLE_NOT_SELECTED").otherwise("OUTSIDE_BAND_OR_INELIGIBLE"))
    return a.withColumns({"selected": chosen, "selection_reason": reason}).drop("__rn")


def join_predictions(parts: list[DataFrame], key: str, label: str, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Merge one prediction column per model into a wide table, and check keys, labels and bounds.

    The parts are stacked and regrouped by key, which is one shuffle for any number of models.
    """
    long = reduce(lambda a, b: a.unionByName(b), [p.select(key, label, F.lit(n).alias("__m"), "pd") for p, n in zip(parts, names)])
    m = F.col("__m")
    wide = long.groupBy(key).agg(
        F.min(label).alias(label), (F.min(label) != F.max(label)).alias("__conflict"),
        *[F.max(F.when(m == n, F.col("pd"))).alias(n) for n in names], *[count_where(m == n).alias(f"__c_{n}") for n in names])
    complete = reduce(lambda a, b: a & b, [F.col(n).isNotNull() & (F.col(f"__c_{n}") == 1) for n in names])
    bounded = reduce(lambda a, b: a & b, [F.coalesce(F.col(n).between(0.0, 1.0), F.lit(True)) for n in names])
    checks = wide.agg(
        F.count(F.lit(1)).alias("row_count"), count_where(~complete).alias("incomplete_rows"), count_where(F.col("__conflict")).alias("label_conflicts"),
        count_where(~bounded).alias("out_of_bounds_rows"))
    return wide.select(key, label, *names), checks
