"""Audits of keys, labels, dates, values and categories.

Every 1:n source is reduced to one row per entity (or per entity and value) by a hash
aggregate with map-side combine before it meets another table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import states as S
from ..session import freeze
from . import joins as J
from .longform import NO_FINITE, Metric, count_where, ratio, to_long, with_rate
from .ranking import SEVEN, bounded_quantiles, running, summary_of_counts

BLOCK = 40  # columns per aggregate; hundreds in one aggregate exceed the code generation limit


def blocks(columns: list[str]) -> list[list[str]]:
    return [columns[i : i + BLOCK] for i in range(0, len(columns), BLOCK)]


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def label_counts(c: Column) -> list[Column]:
    return [
        count_where(c == 0).alias("target_0_count"), count_where(c == 1).alias("target_1_count"),
        count_where(c.isNull()).alias("target_missing_count"),
        count_where(c.isNotNull() & ~c.isin(0, 1)).alias("target_other_count"),
        count_where(c.isin(0, 1)).alias("valid_binary_label_count"),
    ]


def numeric_character(df: DataFrame, fields: list[str]) -> DataFrame:
    """Per column: non-NULL rows, whether all are finite numbers, whether all are whole."""
    wide = []
    for f in fields:
        v = S.finite_value(F.col(f), S.is_text(df, f))
        present = F.col(f).isNotNull()
        wide += [
            F.count(f).alias(f"n__{f}"),
            F.bool_and(F.when(present, v.isNotNull())).alias(f"s__{f}"),
            F.bool_and(F.when(present, F.coalesce(v == F.floor(v), F.lit(False)))).alias(f"i__{f}"),
        ]
    return df.agg(*wide).select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f"n__{f}").alias("non_null"),
                 F.coalesce(f"s__{f}", F.lit(False)).alias("numerically_sortable"),
                 F.coalesce(f"i__{f}", F.lit(False)).alias("integer_valued"))
        for f in fields
    ])))


def ordered_values(df: DataFrame, field: str) -> DataFrame:
    """Distinct values with their position: numeric order where all are numbers, else text order."""
    text = S.is_text(df, field)
    sortable = numeric_character(df, [field]).first()["numerically_sortable"]
    number = S.finite_value(F.col(field), text) if sortable else F.lit(0.0)
    distinct = df.where(F.col(field).isNotNull()).select(F.col(field).alias("v"), number.alias("num")).distinct()
    ranked = running(distinct, [], ["num", "v"])
    return ranked.select(F.lit(field).alias("field"), F.col("rn").alias("position"), F.col("v").cast("string").alias("value"))


def exclusive_rename(df: DataFrame, old: str, new: str) -> DataFrame:
    if (old in df.columns) == (new in df.columns):
        raise ValueError(f"exactly one of {old} and {new} must exist")
    return df.withColumnRenamed(old, new)


def ratio_review(df: DataFrame, candidates: dict[str, tuple[str, str]]) -> DataFrame:
    """Eligibility of ratios; the ratios themselves are not computed."""
    cols, items = [], []
    for name, (num, den) in candidates.items():
        n, d = S.finite_value(F.col(num), S.is_text(df, num)), S.finite_value(F.col(den), S.is_text(df, den))
        ok = F.coalesce(n.isNotNull() & (d > 0), F.lit(False))
        parts = {"eligible_count": ok, "undefined_count": ~ok, "denominator_missing_count": d.isNull(),
                 "denominator_zero_count": d == 0, "denominator_negative_count": d < 0}
        cols += [count_where(c).alias(f"{name}__{k}") for k, c in parts.items()]
        items.append(F.struct(F.lit(name).alias("candidate"), *[F.col(f"{name}__{k}").alias(k) for k in parts]))
    return df.agg(*cols).select(F.inline(F.array(*items)))


def probability_validity(df: DataFrame, by: list[str], p: str) -> DataFrame:
    v = F.col(p)
    present = v.isNotNull() & ~F.isnan(v)
    odd = F.isnan(v) | v.isin(float("inf"), float("-inf"))
    a = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"), count_where(v.isNull()).alias("missing"), count_where(odd).alias("nonfinite"),
        count_where(present & (v < 0)).alias("below_zero"), count_where(present & (v > 1)).alias("above_one"),
        count_where(v == 0).alias("exact_zero"), count_where(v == 1).alias("exact_one"),
        F.min(F.when(~odd, v)).alias("minimum"), F.max(F.when(~odd, v)).alias("maximum"),
        F.round(F.avg(F.when(~odd, v)), 9).alias("mean"),
    )
    bad = F.col("missing") + F.col("nonfinite") + F.col("below_zero") + F.col("above_one")
    return a.withColumn("status", F.when(bad == 0, "PASS").otherwise("FAIL"))


# ---------------------------------------------------------------- entity reduction


def per_entity(source: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row per key: row count, and per field the state counts and finite min/max/mean."""
    df = S.classify(source.where(F.col(key).isNotNull()), fields)
    aggs = [F.count(F.lit(1)).alias("source_rows")]
    for f in fields:
        st, v = F.col(f"{f}__state"), F.col(f"{f}__value")
        aggs += [count_where(st == s).alias(f"{f}__{s}") for s in S.ROW_STATES]
        aggs += [F.count(v).alias(f"{f}__finite"), count_where(v != 0).alias(f"{f}__nonzero"),
                 F.avg(v).alias(f"{f}__mean"), F.min(v).alias(f"{f}__min"), F.max(v).alias(f"{f}__max"),
                 F.sum(v).alias(f"{f}__sum")]
    return df.groupBy(key).agg(*aggs)


def on_spine(spine: DataFrame, reduced: DataFrame, key: str, keep: list[str] | None = None) -> DataFrame:
    """Left join on the population; counts become 0 where there is no source, values stay NULL."""
    counts = [c for c, t in reduced.dtypes if t == "bigint" and c != key]
    return spine.select(key, *(keep or [])).join(reduced, key, "left").fillna(0, counts)


def aggregate_history(spine: DataFrame, source: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Finite mean and max with finite, nonzero, missing and invalid counts per entity."""
    e = on_spine(spine, per_entity(source, key, fields), key)
    out = [key, "source_rows"]
    for f in fields:
        out += [F.col(f"{f}__mean"), F.col(f"{f}__max"), F.col(f"{f}__finite"), F.col(f"{f}__nonzero"),
                F.col(f"{f}__missing"), (F.col(f"{f}__unparseable") + F.col(f"{f}__nonfinite")).alias(f"{f}__invalid")]
    return e.select(*out)


def source_structure(spine: DataFrame, source: DataFrame, key: str, index: str) -> DataFrame:
    """Row, key and composite-key structure of a 1:n source, and its join readiness."""
    pair = source.groupBy(key, index).agg(F.count(F.lit(1)).alias("n"))
    idx, n = F.col(index), F.col("n")
    one = F.lit(1)
    per = pair.groupBy(key).agg(
        F.sum(n).alias("rows"), F.sum(F.when(idx.isNull(), n).otherwise(0)).alias("null_index"),
        F.sum(F.when(idx.isNotNull() & ~S.valid_index(idx), n).otherwise(0)).alias("bad_index"),
        count_where(idx.isNotNull() & (n > 1)).alias("dup_pairs"),
        F.sum(F.when(idx.isNotNull(), n - 1).otherwise(0)).alias("dup_pair_excess"),
    )
    keys = spine.select(F.col(key).alias("base_key"))
    j = per.join(keys, per[key] == keys["base_key"], "full_outer")
    k, base, rows = F.col(key), F.col("base_key"), F.coalesce("rows", F.lit(0))
    sourced = rows > 0
    matched, orphan = sourced & base.isNotNull(), sourced & k.isNotNull() & base.isNull()
    total = lambda cond, c=rows: F.sum(F.when(cond, c).otherwise(0))
    keyed = sourced & k.isNotNull()
    a = j.agg(
        F.sum(rows).alias("physical_rows"), total(sourced & k.isNull()).alias("null_key_rows"),
        count_where(keyed).alias("distinct_keys"), count_where(keyed & (rows > 1)).alias("duplicate_key_distinct"),
        total(keyed, rows - one).alias("duplicate_key_excess"), total(matched).alias("matched_rows"),
        total(orphan).alias("orphan_rows"), count_where(matched).alias("matched_keys"),
        count_where(orphan).alias("orphan_keys"), count_where(base.isNotNull() & ~sourced).alias("missing_base_keys"),
        F.sum(F.coalesce("null_index", F.lit(0))).alias("null_index_rows"),
        F.sum(F.coalesce("bad_index", F.lit(0))).alias("invalid_index_rows"),
        total(keyed, F.col("dup_pairs")).alias("duplicate_composite_distinct"),
        total(keyed, F.col("dup_pair_excess")).alias("duplicate_composite_excess"),
    )
    return a.withColumn(
        "join_readiness",
        F.when((F.col("null_key_rows") > 0) | (F.col("null_index_rows") > 0), "KEY_DEFECTS_REQUIRE_REVIEW")
        .when(F.col("duplicate_key_excess") > 0, "ONE_TO_MANY_REQUIRES_AGGREGATION")
        .otherwise("OBSERVED_ONE_ROW_PER_MATCHED_ENTITY"),
    )


def record_distribution(counts: DataFrame, n: str) -> DataFrame:
    """Distribution of positive per-entity row counts.

    The counts are reduced to (count, entities).  N rows can hold at most sqrt(2 N) different
    counts, so the exact percentile state is small at any size.
    """
    freq = counts.where(F.col(n) > 0).groupBy(n).agg(F.count(F.lit(1)).alias("f"))
    c, f = F.col(n), F.col("f")
    q = freq.agg(
        F.min(c).alias("min"), F.max(c).alias("max"), bounded_quantiles(c, [0.5, 0.9, 0.95, 0.99], f).alias("q"),
        *[F.coalesce(F.sum(F.when(cond, f)), F.lit(0)).alias(name) for name, cond in (
            ("entities_1_row", c == 1), ("entities_2_rows", c == 2), ("entities_3_5_rows", (c >= 3) & (c <= 5)),
            ("entities_6_10_rows", (c >= 6) & (c <= 10)), ("entities_gt10_rows", c > 10))],
    )
    names = ("median", "p90", "p95", "p99")
    return q.select("min", "max", *[F.round(F.col("q")[i], 6).alias(k) for i, k in enumerate(names)],
                    *[x for x in q.columns if x.startswith("entities_")])


def matched_frequencies(spine: DataFrame, source: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, state, value, freq) of the rows whose key is in the population: one scan, counted before it meets the population."""
    rows = S.classify(source.where(F.col(key).isNotNull()), fields)
    long = rows.select(key, F.inline(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f"{f}__state").alias("state"), F.col(f"{f}__value").alias("value")) for f in fields])))
    per = long.groupBy(key, "field", "state", "value").agg(F.count(F.lit(1)).alias("freq"))
    return freeze(J.skew_join(per, spine.select(key), key, "left_semi"))


def audit_numeric(spine: DataFrame, source: DataFrame, key: str, fields: list[str], count_fields: list[str] = ()) -> DataFrame:
    """Long audit of numeric fields: row states, value statistics, entity states, overlap diagnostics.

    All of it is read from one frequency table; entities without a source record are the population less those that have one.
    """
    found = matched_frequencies(spine, source, key, fields)
    parts = [*S.ROW_STATES, "finite", "nonzero"]
    c = F.col
    f, v = c("freq"), c("value")
    total = lambda cond: F.sum(F.when(cond, f).otherwise(0))
    per = found.groupBy(key, "field").agg(
        F.sum(f).alias("source_rows"), *[total(c("state") == s).alias(s) for s in S.ROW_STATES], total(v.isNotNull()).alias("finite"),
        total(v != 0).alias("nonzero"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    state = S.entity_state(c("source_rows"), c("finite"), c("nonzero"))
    present = [s for s in S.ENTITY_STATES if s != "NO_SOURCE_RECORD"]
    seen = per.groupBy("field").agg(
        F.sum("source_rows").alias("matched_rows"), F.count(F.lit(1)).alias("sources"),
        *[F.sum(p).alias(f"r_{p}") for p in parts],
        *[count_where(state == s).alias(f"e_{s}") for s in present],
        count_where((c("finite") > 0) & (c("missing") > 0)).alias("d_finite_and_missing"),
        count_where((c("zero") > 0) & (c("nonzero") > 0)).alias("d_zero_and_nonzero"),
        count_where(c("unparseable") + c("nonfinite") > 0).alias("d_any_invalid"),
        count_where(c("lo") < c("hi")).alias("d_finite_variation_across_rows"),
    )
    everyone = spine.agg(F.count(F.lit(1)).alias("population")).withColumn("field", F.explode(F.array(*map(F.lit, fields))))
    wide = everyone.join(seen, "field", "left").fillna(0, [x for x in seen.columns if x != "field"])
    wide = wide.withColumn("e_NO_SOURCE_RECORD", c("population") - c("sources"))
    counts = found.where(v.isNotNull()).groupBy("field", "value").agg(F.sum(f).alias("freq"))
    stats = summary_of_counts(counts, ["field"], "value", "freq")
    whole = S.integer_like(v)
    checks = counts.groupBy("field").agg(*[
        F.coalesce(F.sum(F.when(cond, f)), F.lit(0)).alias(name)
        for name, cond in (("c_nonnegative", v >= 0), ("c_integer_like", whole), ("c_positive_integer_like", (v > 0) & whole))
    ])
    row = wide.join(stats, "field", "left").join(checks, "field", "left")
    n = F.coalesce("n", F.lit(0))
    m: list[Metric] = []
    for s in S.ROW_STATES:
        m += with_rate(f"row_state_{s}", c(f"r_{s}"), "matched_source_rows", c("matched_rows"))
    m.append(Metric("finite_observation_count", n, "matched_source_rows", c("matched_rows")))
    m.append(Metric("distinct_finite_value_count", F.coalesce("distinct", F.lit(0)), "finite_observations", n))
    m += [Metric(f"finite_{q}", c(q), "finite_observations", n, NO_FINITE) for q in ("min", *SEVEN, "max", "mean")]
    for s in S.ENTITY_STATES:
        m.append(Metric(f"entity_state_{s}_count", c(f"e_{s}"), "population", c("population")))
        m.append(Metric(f"entity_state_{s}_population_rate", ratio(c(f"e_{s}"), c("population")), "population", c("population")))
        cond = F.lit(None).cast("double") if s == "NO_SOURCE_RECORD" else ratio(c(f"e_{s}"), c("sources"))
        m.append(Metric(f"entity_state_{s}_source_rate", cond, "entities_with_source", c("sources"), "NOT_APPLICABLE"))
    for d in ("finite_and_missing", "zero_and_nonzero", "any_invalid", "finite_variation_across_rows"):
        m.append(Metric(f"entities_{d}", c(f"d_{d}"), "population", c("population")))
    out = to_long(row, ["field"], m)
    if count_fields:
        extra = [x for k in ("nonnegative", "integer_like", "positive_integer_like")
                 for x in with_rate(f"finite_{k}", F.coalesce(f"c_{k}", F.lit(0)), "finite_observations", n)]
        out = out.unionByName(to_long(row.where(c("field").isin(list(count_fields))), ["field"], extra))
    return out


def entity_partition(spine: DataFrame, source: DataFrame, key: str, field: str) -> DataFrame:
    e = on_spine(spine, per_entity(source, key, [field]), key)
    return e.select(key, S.entity_state(F.col("source_rows"), F.col(f"{field}__finite"), F.col(f"{field}__nonzero")).alias("state"))


# ---------------------------------------------------------------- dates


def date_offsets_by_entity(offsets: DataFrame, key: str) -> DataFrame:
    o, n = F.col("offset_days"), F.col("row_count")
    flag = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    return offsets.groupBy(key).agg(
        F.sum(n).alias("source_rows"), F.sum(F.when(F.col("state") == "parseable", n).otherwise(0)).alias("parseable_rows"),
        flag(o < 0).alias("any_before"), flag(o == 0).alias("any_on"), flag(o > 0).alias("any_after"),
    )


def audit_date(spine: DataFrame, source: DataFrame, key: str, field: str, decision: str) -> DataFrame:
    """Long audit of a date field: states, offset signs and quantiles."""
    off = J.day_offsets(source, spine, key, field, decision)
    n, o, st = F.col("row_count"), F.col("offset_days"), F.col("state")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
    a = off.agg(
        F.sum(n).alias("rows"), *[total(st == s).alias(f"s_{s}") for s in S.DATE_STATES],
        total(o.isNotNull()).alias("pairs"), total((st == "parseable") & o.isNull()).alias("no_base"),
        total(o < 0).alias("below_zero"), total(o == 0).alias("equal_zero"), total(o > 0).alias("above_zero"),
        F.min(o).alias("lo"), F.max(o).alias("hi"),
        bounded_quantiles(o, [0.05, 0.5, 0.95], F.when(o.isNotNull(), n).otherwise(F.lit(0))).alias("q"),  # calendar days
    )
    c = F.col
    m = []
    for s in S.DATE_STATES:
        m += with_rate(f"row_date_{s}", c(f"s_{s}"), "matched_source_rows", c("rows"))
    m.append(Metric("date_offset_valid_pair_count", c("pairs"), "parseable_rows", c("s_parseable")))
    m.append(Metric("date_source_without_usable_base_date_count", c("no_base"), "parseable_rows", c("s_parseable")))
    for s in ("below_zero", "equal_zero", "above_zero"):
        m += with_rate(f"date_offset_{s}", c(s), "valid_date_pairs", c("pairs"))
    for name, v in (("min", c("lo")), ("p05", c("q")[0]), ("median", c("q")[1]), ("p95", c("q")[2]), ("max", c("hi"))):
        m.append(Metric(f"date_offset_days_{name}", v, "valid_date_pairs", c("pairs"), "UNDEFINED_NO_VALID_PAIRS"))
    return to_long(a, [], m)


def entity_timing(spine: DataFrame, source: DataFrame, key: str, field: str, decision: str) -> DataFrame:
    e = date_offsets_by_entity(J.day_offsets(source, spine, key, field, decision), key)
    before, on, after = F.col("any_before"), F.col("any_on"), F.col("any_after")
    return e.select(key, "any_before", "any_on", "any_after", (before & after).alias("mixed_before_and_after"),
                    (F.col("parseable_rows") == 0).alias("no_usable_date"))


def latest_date_ties(spine: DataFrame, source: DataFrame, key: str, field: str, payload: list[str], track: bool = True) -> DataFrame:
    """Entities with several rows on their latest date and with different payloads there.

    Rows are reduced per (key, day) to a count and the smallest and largest payload, then
    per key to the latest day.  ``track=False`` reports NOT_CHECKED, never 0.
    """
    v = F.struct(*payload)
    day = source.select(key, S.as_day(source, field).alias("day"), *payload).where(F.col(key).isNotNull()).groupBy(key, "day").agg(
        F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")
    )
    latest = day.groupBy(key).agg(
        F.max("day").alias("latest"), F.max_by(F.struct("n", (~F.col("lo").eqNullSafe(F.col("hi"))).alias("differs")), "day").alias("x")
    ).join(spine.select(key), key, "left_semi")
    dated = F.col("latest").isNotNull()
    tied = dated & (F.col("x.n") > 1)
    skip = F.lit(None).cast("bigint")
    a = latest.agg(
        F.count(F.lit(1)).alias("source_entities"), count_where(~dated).alias("entities_no_usable_date"),
        (count_where(tied) if track else skip).alias("entities_latest_date_tied"),
        (count_where(tied & F.col("x.differs")) if track else skip).alias("entities_latest_tie_payload_conflict"),
    )
    return a.withColumn("tie_status", F.lit("MEASURED" if track else "NOT_CHECKED"))


# ---------------------------------------------------------------- categories, text, pairs


def audit_category(spine: DataFrame, source: DataFrame, key: str, field: str) -> DataFrame:
    """States, distinct codes and entities with more than one code, as long rows."""
    freq = category_counts(spine, source, key, field)
    c, st, n = F.col, F.col("state"), F.col("n")
    code = F.when(st == "populated", c("code"))
    e = freq.groupBy(key).agg(
        *[F.sum(F.when(st == s, n).otherwise(0)).alias(s) for s in S.TEXT_STATES], (F.min(code) != F.max(code)).alias("varies")
    )
    a = on_spine(spine, e, key).agg(
        *[F.sum(s).alias(s) for s in S.TEXT_STATES], count_where(c("varies")).alias("varying"), F.count(F.lit(1)).alias("population")
    )
    rows = c("native_missing") + c("empty_or_whitespace") + c("populated")
    m = [x for s in S.TEXT_STATES for x in with_rate(f"row_category_{s}", c(s), "matched_source_rows", rows)]
    m.append(Metric("entities_with_category_variation", c("varying"), "population", c("population")))
    codes = freq.where(st == "populated").groupBy("code").agg(F.sum(n).alias("n")).agg(
        F.count("code").alias("codes"), F.coalesce(F.sum("n"), F.lit(0)).alias("populated"))
    distinct = Metric("distinct_populated_code_count", c("codes"), "populated_matched_rows", c("populated"))
    return to_long(a, [], m).unionByName(to_long(codes, [], [distinct]))


def category_counts(spine: DataFrame, source: DataFrame, key: str, field: str) -> DataFrame:
    """(key, state, code, n) of matched rows; blank texts carry no code."""
    state = S.text_state(F.col(field))
    per = source.where(F.col(key).isNotNull()).groupBy(
        key, state.alias("state"), F.when(state == "populated", F.col(field)).alias("code")
    ).agg(F.count(F.lit(1)).alias("n"))
    return J.skew_join(per, spine.select(key), key, "left_semi")


def audit_text(spine: DataFrame, source: DataFrame, key: str, field: str) -> DataFrame:
    freq = category_counts(spine, source, key, field)
    tokens = freq.groupBy("state", "code").agg(F.sum("n").alias("n"))
    c, st = F.col, F.col("state")
    a = tokens.agg(
        *[F.coalesce(F.sum(F.when(st == s, c("n"))), F.lit(0)).alias(s) for s in S.TEXT_STATES], F.count("code").alias("tokens")
    )
    rows = c("native_missing") + c("empty_or_whitespace") + c("populated")
    m = [x for s in S.TEXT_STATES for x in with_rate(f"row_text_{s}", c(s), "matched_source_rows", rows)]
    m.append(Metric("distinct_populated_token_count", c("tokens"), "populated_matched_rows", c("populated")))
    return to_long(a, [], m)


def pair_diagnostics(df: DataFrame, fields: list[str], rtol: float = 1e-9, atol: float = 1e-12) -> DataFrame:
    """Joint states, equality and Pearson correlation of every pair of fields, in one pass."""
    d = S.classify(df, fields)
    cols, items = [], []
    for i, left in enumerate(fields):
        for right in fields[i + 1 :]:
            k = f"{left}|{right}"
            x, y = F.col(f"{left}__value"), F.col(f"{right}__value")
            both = x.isNotNull() & y.isNotNull()
            px, py = F.when(both, x), F.when(both, y)
            gone = (F.col(f"{left}__state") == "missing") & (F.col(f"{right}__state") == "missing")
            # central moments; the built-in corr raises on a constant column
            r = F.try_divide(F.covar_pop(px, py), F.stddev_pop(px) * F.stddev_pop(py))
            cols += [F.count(F.lit(1)).alias(f"{k}#rows"), count_where(both).alias(f"{k}#joint"), count_where(gone).alias(f"{k}#gone"),
                     count_where(S.close(x, y, rtol, atol)).alias(f"{k}#equal"), r.alias(f"{k}#r")]
            c = lambda s, k=k: F.col(f"`{k}#{s}`")
            items.append(F.struct(
                F.lit(k).alias("pair"), c("rows").alias("matched_rows"), c("joint").alias("joint_finite_rows"),
                c("gone").alias("joint_missing_rows"), c("equal").alias("equal_count"),
                (c("joint") - c("equal")).alias("disagreement_count"),
                F.round(ratio(c("equal"), c("joint")), 6).alias("equality_rate"), F.round(c("r"), 6).alias("pearson_correlation"),
            ))
    return d.agg(*cols).select(F.inline(F.array(*items)))


# ---------------------------------------------------------------- base table


def schema_profile(df: DataFrame) -> DataFrame:
    parts = []
    for cols in blocks(df.columns):
        wide = df.agg(F.count(F.lit(1)).alias("__rows"), *[count_where(F.col(c).isNull()).alias(c) for c in cols])
        parts.append(wide.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.lit(dict(df.dtypes)[c]).alias("dtype"),
                     F.col("__rows").alias("row_count"), F.col(c).alias("null_count")) for c in cols]))))
    return union_all(parts)


def key_profile(df: DataFrame, key: str) -> DataFrame:
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    k, n = F.col(key), F.col("n")
    present = k.isNotNull()
    a = per.agg(
        F.coalesce(F.sum(F.when(present, n)), F.lit(0)).alias("non_null_rows"),
        F.coalesce(F.sum(F.when(~present, n)), F.lit(0)).alias("missing_rows"), F.count(k).alias("distinct_keys"),
        count_where(present & (n > 1)).alias("repeated_distinct_keys"),
        F.coalesce(F.sum(F.when(present, n - 1)), F.lit(0)).alias("excess_rows"),
    )
    return a.withColumn("uniqueness_check", F.when(F.col("distinct_keys") == 0, "NOT_CHECKABLE")
                        .when(F.col("repeated_distinct_keys") == 0, "PASS").otherwise("FAIL"))


def duplicate_profile(df: DataFrame) -> DataFrame:
    n = F.col("__n")
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n")).where(n > 1).agg(
        F.coalesce(F.sum(n - 1), F.lit(0)).alias("excess_duplicate_rows"),
        F.coalesce(F.sum(n), F.lit(0)).alias("participating_rows"), F.count(n).alias("duplicate_patterns"),
    )


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(F.col(label).cast("string").alias("value"), S.label_class(F.col(label)).alias("label_class")).agg(
        F.count(F.lit(1)).alias("row_count")
    )


def range_profile(df: DataFrame, fields: list[str]) -> DataFrame:
    """Missing, distinct, min and max as text; distinct counts come from one grouping of (field, value)."""
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("txt"), F.col(f).cast("double").alias("num")) for f in fields
    ])))
    freq = long.groupBy("field", "txt", "num").agg(F.count(F.lit(1)).alias("n"))
    return freq.groupBy("field").agg(
        F.coalesce(F.sum(F.when(F.col("txt").isNull(), F.col("n"))), F.lit(0)).alias("missing_count"),
        F.count("txt").alias("distinct_non_null"), F.min("num").alias("observed_min"), F.max("num").alias("observed_max"),
    )


def weekly_summary(df: DataFrame, week: str, day: str, label: str) -> DataFrame:
    d, y = F.col(day), F.col(label)
    w = df.groupBy(F.col(week).alias("week_num")).agg(
        F.count(F.lit(1)).alias("row_count"), F.min(d).cast("string").alias("min_day"), F.max(d).cast("string").alias("max_day"),
        count_where(d.isNull()).alias("missing_day_count"), *label_counts(y),
    )
    return w.withColumns({
        "event_rate": F.round(ratio(F.col("target_1_count"), F.col("valid_binary_label_count")), 9),
        "week_is_missing": F.col("week_num").isNull(),
    }).orderBy(F.col("week_num").asc_nulls_last())


#: Numbers of a gap that one row is unfolded to.
GAP_BLOCK = 100_000


def missing_integers(df: DataFrame, field: str) -> DataFrame:
    """Whole numbers that are absent between consecutive observed values.

    Neighbours meet by their global row number; a wide gap is cut into blocks first, so no row holds a whole gap.
    """
    seen = df.where(F.col(field).isNotNull()).select(F.col(field).cast("bigint").alias("v")).distinct()
    placed = running(seen, [], ["v"]).select("v", "rn")
    gaps = placed.join(placed.select((F.col("rn") - 1).alias("rn"), F.col("v").alias("next")), "rn").where("next - v > 1")
    blocks = gaps.select("next", F.explode(F.sequence(F.col("v") + 1, F.col("next") - 1, F.lit(GAP_BLOCK).cast("bigint"))).alias("lo"))
    missing = blocks.select(F.explode(F.sequence("lo", F.least(F.col("lo") + GAP_BLOCK, F.col("next")) - 1)).alias("v"))
    return missing.select(F.lit(field).alias("field"), F.col("v").alias("missing_value"))


def week_ranges(df: DataFrame, week: str, day: str) -> DataFrame:
    """Date range per week next to that of the preceding week (one row per calendar week)."""
    r = df.where(F.col(week).isNotNull()).groupBy(F.col(week).alias("week_num")).agg(
        F.min(day).alias("lo"), F.max(day).alias("hi")).where(F.col("lo").isNotNull())
    w = Window.partitionBy(F.lit(0)).orderBy("week_num")
    return r.withColumns({"prev_week": F.lag("week_num").over(w), "prev_lo": F.lag("lo").over(w), "prev_hi": F.lag("hi").over(w)})


def temporal_checks(df: DataFrame, week: str, day: str) -> DataFrame:
    per_day = df.where(F.col(day).isNotNull()).groupBy(day).agg(
        (F.count_distinct(week) + F.max(F.when(F.col(week).isNull(), 1).otherwise(0))).alias("weeks"))
    a = per_day.agg(F.count(F.lit(1)).alias("compared"), count_where(F.col("weeks") > 1).alias("findings"))
    r = week_ranges(df, week, day).where(F.col("prev_week").isNotNull())
    back_lo, back_hi = F.col("lo") < F.col("prev_lo"), F.col("hi") < F.col("prev_hi")
    b = r.agg(F.count(F.lit(1)).alias("compared"), count_where(back_lo).alias("a"), count_where(back_hi).alias("b"),
              count_where(F.col("lo") <= F.col("prev_hi")).alias("c"))
    rows = b.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("check_id"), F.col("compared"), F.col(x).alias("findings"))
        for k, x in (("backward_min_date", "a"), ("backward_max_date", "b"), ("overlapping_ranges", "c"))])))
    out = a.select(F.lit("date_maps_to_one_week").alias("check_id"), "compared", "findings").unionByName(rows)
    return out.withColumn("status", F.when(F.col("findings") == 0, "PASS").otherwise("FAIL"))


def month_mapping(df: DataFrame, month: str, day: str) -> DataFrame:
    """Month code against calendar months, from counts per (code, calendar month)."""
    d = F.col(day)
    pre = df.groupBy(F.col(month).alias("month_code"), F.date_format(d, "yyyy-MM").alias("ym")).agg(
        F.count(F.lit(1)).alias("n"), F.min(d).alias("lo"), F.max(d).alias("hi"))
    return pre.groupBy("month_code").agg(
        F.sum("n").alias("row_count"), F.min("lo").cast("string").alias("min_day"), F.max("hi").cast("string").alias("max_day"),
        F.coalesce(F.sum(F.when(F.col("ym").isNull(), F.col("n"))), F.lit(0)).alias("missing_day_count"),
        F.count("ym").alias("calendar_months"), F.array_join(F.array_sort(F.collect_list("ym")), ",").alias("calendar_month_values"),
    )


def calendar_to_month(df: DataFrame, month: str, day: str) -> DataFrame:
    pre = df.where(F.col(day).isNotNull()).select(F.date_format(day, "yyyy-MM").alias("calendar_month"), month).distinct()
    return pre.groupBy("calendar_month").agg(F.count(F.lit(1)).alias("month_codes"))
