"""Point-in-time history: child dates against the decision date of their entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import states as S
from . import joins as J
from .longform import Metric, count_where, ratio, to_long
from .ranking import bounded_quantiles, value_summary

# Fixed value: days per year of history lengths.
DAYS_PER_YEAR = 365.25
# Quantile levels of the history and score audits.
LEVELS = {"p01": 0.01, "p05": 0.05, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def earliest_dates(spine: DataFrame, source: DataFrame, key: str, field: str, decision: str) -> DataFrame:
    """As-of filter: earliest date on or before the decision, with the excluded rows counted.

    Rows are counted per (key, day) first, so the join carries no raw rows.
    """
    off = J.day_offsets(source, spine, key, field, decision)
    n, d, dec, st = F.col("row_count"), F.col("day"), F.col("decision_day"), F.col("state")
    after = F.coalesce(d > dec, F.lit(False))
    total = lambda cond: F.sum(F.when(cond, n).otherwise(0))
    e = off.groupBy(key).agg(
        F.sum(n).alias("source_rows"), F.min(d).alias("earliest_day"), F.min(F.when(d <= dec, d)).alias("earliest_valid_day"),
        total(after).alias("after_rows"), total(st == "native_missing").alias("missing_rows"),
        total(st.isin("empty", "parse_failure")).alias("invalid_rows"),
    )
    counts = ["source_rows", "after_rows", "missing_rows", "invalid_rows"]
    return spine.select(key, F.col(decision).cast("date").alias("decision_day")).join(e, key, "left").fillna(0, counts)


def combined_history(
    spine: DataFrame, active: DataFrame, active_field: str, closed: DataFrame, closed_field: str, key: str, decision: str
) -> DataFrame:
    """History length from the earlier of two sources; a missing side is skipped."""
    a = earliest_dates(spine, active, key, active_field, decision)
    b = earliest_dates(spine, closed, key, closed_field, decision).drop("decision_day")
    names = [c for c in b.columns if c != key]
    j = a.withColumnsRenamed({c: f"active_{c}" for c in names}).join(
        b.withColumnsRenamed({c: f"closed_{c}" for c in names}), key)
    days = lambda c: F.datediff("decision_day", c).cast("bigint")
    return (
        j.withColumn("earliest_valid_day", F.least("active_earliest_valid_day", "closed_earliest_valid_day"))
        .withColumn("earliest_any_day", F.least("active_earliest_day", "closed_earliest_day"))
        .withColumn("history_days", days("earliest_valid_day"))
        .withColumn("history_years", F.col("history_days") / F.lit(DAYS_PER_YEAR))
        .withColumn("unrestricted_days", days("earliest_any_day"))
        .withColumn("negative_before_exclusion", F.coalesce(F.col("unrestricted_days") < 0, F.lit(False)))
    )


def amount_state(rows: Column, finite: Column, total: Column) -> Column:
    return (
        F.when(rows == 0, "NO_DETAIL_SOURCE").when(finite == 0, "DETAIL_ALL_AMOUNTS_MISSING_OR_INVALID")
        .when(total == 0, "DETAIL_FINITE_ZERO_SUM").otherwise("DETAIL_FINITE_NONZERO_SUM")
    )


def correspondence_counts(j: DataFrame, count_field: str, sum_field: str) -> DataFrame:
    """Exact and tolerant agreement of stated counts and sums with the detail rows."""
    sc, ss = F.col(count_field), F.col(sum_field)
    n, f, ds = F.col("detail_rows"), F.col("detail_finite"), F.col("detail_sum")
    whole = S.integer_like(sc)
    return j.agg(
        count_where(whole).alias("joint_integer_count"), count_where(whole & (F.rint(sc) == n)).alias("exact_record_count"),
        count_where(whole & (F.rint(sc) != n)).alias("record_mismatch_count"),
        count_where(whole & (F.rint(sc) == f)).alias("exact_finite_count"),
        count_where(whole & (F.rint(sc) != f)).alias("finite_mismatch_count"),
        count_where(sc.isNotNull() & ~whole).alias("noninteger_count"),
        count_where(whole & (F.rint(sc) != n) & (n > f)).alias("mismatches_with_missing_detail"),
        F.count(ss + ds).alias("joint_sum_count"), count_where(ss == ds).alias("exact_sum_count"),
        count_where(S.close(ss, ds)).alias("close_sum_count"), count_where(ss.isNotNull() & (ds == 0)).alias("zero_reference_count"),
        count_where((F.coalesce(sc, F.lit(0.0)) != 0) == (n > 0)).alias("presence_correspondence_count"),
    )


def difference_distribution(j: DataFrame, left: str, right: str) -> DataFrame:
    d = F.col(left) - F.col(right)
    measures = {"signed_difference": d, "absolute_difference": F.abs(d),
                "absolute_relative_difference": F.abs(F.try_divide(d, F.col(right)))}
    long = j.select(F.inline(F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("v")) for k, v in measures.items()])))
    probs = {"p01": 0.01, "p05": 0.05, "median": 0.5, "p95": 0.95, "p99": 0.99}
    s = value_summary(long, ["measure"], "v", probs, distinct=False)
    return s.select("measure", "n", *[F.round(c, 6).alias(c) for c in ("min", *probs, "max", "mean")])


def account_audit(df: DataFrame, fields: list[str]) -> DataFrame:
    """Share of missing, zero, positive and negative values and exact quantiles per field."""
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("candidate"), S.finite_value(F.col(f), S.is_text(df, f)).alias("v")) for f in fields])))
    v = F.col("v")
    counts = long.groupBy("candidate").agg(
        F.count(F.lit(1)).alias("total"), F.count(v).alias("non_missing_count"), count_where(v == 0).alias("zero_count"),
        count_where(v > 0).alias("positive_count"), count_where(v < 0).alias("negative_count"))
    s = value_summary(long, ["candidate"], "v", LEVELS).drop("n", "mean")
    pct = lambda a, b: F.round(ratio(F.col(a) * 100, F.col(b)), 6)
    return counts.join(s, "candidate", "left").select(
        "candidate", "total", "non_missing_count", (F.col("total") - F.col("non_missing_count")).alias("missing_count"),
        pct("non_missing_count", "total").alias("non_missing_percentage"), "zero_count", pct("zero_count", "total").alias("zero_percentage"),
        pct("zero_count", "non_missing_count").alias("zero_percentage_non_missing"), "positive_count",
        pct("positive_count", "total").alias("positive_percentage"), "negative_count",
        F.coalesce("distinct", F.lit(0)).alias("unique_values"), F.col("min").alias("minimum"), F.col("max").alias("maximum"),
        *[F.round(k, 6).alias(k) for k in LEVELS],
    )


def history_audit(h: DataFrame) -> DataFrame:
    """Availability, exclusion and length of the combined history, as long rows."""
    c = F.col
    has = lambda side: c(f"{side}_earliest_day").isNotNull()
    days = c("history_days")
    flags = {
        "active_date_available": has("active"), "closed_date_available": has("closed"),
        "both_sources_available": has("active") & has("closed"), "at_least_one_source_available": has("active") | has("closed"),
        "neither_source_available": ~has("active") & ~has("closed"), "valid_history": days.isNotNull(),
        "entities_with_date_after_decision": c("active_after_rows") + c("closed_after_rows") > 0,
        "entities_with_invalid_date": c("active_invalid_rows") + c("closed_invalid_rows") > 0,
        "zero_day_history": days == 0, "negative_history_before_exclusion": c("negative_before_exclusion"),
    }
    rows = {"after_decision": "after_rows", "invalid": "invalid_rows", "native_missing": "missing_rows"}
    sides = ("active", "closed")
    a = h.agg(
        F.count(F.lit(1)).alias("total"), *[count_where(v).alias(k) for k, v in flags.items()],
        *[F.sum(c(f"active_{r}") + c(f"closed_{r}")).alias(f"rows_{k}") for k, r in rows.items()],
        *[F.sum(f"{s}_source_rows").alias(f"{s}_rows") for s in sides],
        *[count_where(c(f"{s}_source_rows") > 0).alias(f"{s}_entities") for s in sides],
        *[count_where(c(f"{s}_source_rows") > 1).alias(f"{s}_repeated") for s in sides],
        F.min(days).alias("lo"), F.max(days).alias("hi"),
        # day counts have a calendar-bounded domain
        bounded_quantiles(days, list(LEVELS.values()), F.when(days.isNotNull(), 1).otherwise(0)).alias("q"),
    )
    source_rows = c("active_rows") + c("closed_rows")
    m = [Metric(k, c(k), "population", c("total")) for k in flags]
    m += [Metric(f"source_rows_{k}", c(f"rows_{k}"), "matched_source_rows", source_rows) for k in rows]
    for s in sides:
        m += [Metric(f"{s}_matched_source_rows", c(f"{s}_rows"), f"{s}_matched_source_rows", c(f"{s}_rows")),
              Metric(f"{s}_source_entities", c(f"{s}_entities"), "population", c("total")),
              Metric(f"{s}_repeated_entities", c(f"{s}_repeated"), f"{s}_source_entities", c(f"{s}_entities")),
              Metric(f"{s}_repeated_excess_rows", c(f"{s}_rows") - c(f"{s}_entities"), f"{s}_matched_source_rows", c(f"{s}_rows"))]
    stats = {"minimum": c("lo"), **{k: c("q")[i] for i, k in enumerate(LEVELS)}, "maximum": c("hi")}
    for k, v in stats.items():
        m.append(Metric(f"history_days_{k}", v, "valid_history", c("valid_history"), "UNDEFINED_NO_VALID_HISTORY"))
        m.append(Metric(f"history_years_{k}", v / F.lit(DAYS_PER_YEAR), "valid_history", c("valid_history"), "UNDEFINED_NO_VALID_HISTORY"))
    return to_long(a, [], m)


def joint_coverage(df: DataFrame, count_field: str, history_field: str) -> DataFrame:
    n, h = F.col(count_field), F.col(history_field).isNotNull()
    ok = n.isNotNull()
    cells = {
        "both_valid": ok & h, "count_valid_history_missing": ok & ~h, "count_missing_history_valid": ~ok & h, "both_missing": ~ok & ~h,
        "count_zero_history_valid": (n == 0) & h, "count_zero_history_missing": (n == 0) & ~h,
        "count_positive_history_valid": (n > 0) & h, "count_positive_history_missing": (n > 0) & ~h,
    }
    a = df.agg(F.count(F.lit(1)).alias("total"), *[count_where(v).alias(k) for k, v in cells.items()])
    return a.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("coverage_category"), F.col(k).alias("entity_count"),
                 F.round(ratio(F.col(k) * 100, F.col("total")), 6).alias("percentage")) for k in cells])))


def integrity_rows(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """Row, key and duplicate counts of every source, one row per (source, metric)."""
    out = None
    for name, df in sources.items():
        per = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        n = F.col("n")
        a = per.agg(F.sum(n).alias("source_row_count"), F.count(n).alias("unique_key_count"),
                    count_where(n > 1).alias("duplicated_key_count"), F.sum(n - 1).alias("duplicate_row_count"))
        rows = a.unpivot([], a.columns, "metric", "value").select(F.lit(name).alias("source"), "metric", "value")
        out = rows if out is None else out.unionByName(rows)
    return out
