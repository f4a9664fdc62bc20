"""Follow-up audits of detail sources: applicant rows, evidence sides, count candidates, end dates."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import states as S
from . import joins as J
from .audit import category_counts, date_offsets_by_entity, on_spine, per_entity
from .longform import count_where, ratio
from .ranking import summary_of_counts, top_per_group

# States of a count candidate.
CANDIDATE_STATES = ("NO_SOURCE_RECORD", "SOURCE_PRESENT_NO_FINITE", "INVALID", "CONFLICTING_FINITE_VALUES",
                    "OBSERVED_ZERO", "OBSERVED_POSITIVE", "OBSERVED_NEGATIVE")


def select_index_zero(spine: DataFrame, source: DataFrame, key: str, index: str, fields: list[str]) -> DataFrame:
    """Per entity: rows, rows with index 0, and the payload of the index-0 row when there is exactly one."""
    zero = F.col(index) == 0
    reduced = source.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("source_rows"), count_where(zero).alias("selected_rows"),
        *[F.max(F.when(zero, F.col(f))).alias(f) for f in fields])
    e = on_spine(spine, reduced, key)
    return e.withColumns({f: F.when(F.col("selected_rows") == 1, F.col(f)) for f in fields})


def selection_state(rows: Column, selected: Column) -> Column:
    return (F.when(rows == 0, "NO_PERSON_SOURCE").when(selected == 0, "SOURCE_PRESENT_ZERO_INDEX_ZERO_ROWS")
            .when(selected == 1, "EXACTLY_ONE_INDEX_ZERO_ROW").otherwise("MULTIPLE_INDEX_ZERO_ROWS"))


def index_cross_check(source: DataFrame, index: str, other: str) -> DataFrame:
    o = F.col(other)
    kind = F.when(o.isNull(), "other_index_missing").when(o == 0, "other_index_zero").otherwise("other_index_nonzero")
    return source.where(F.col(index) == 0).groupBy(kind.alias("state")).agg(F.count(F.lit(1)).alias("row_count"))


def token(c: Column) -> Column:
    """Category as text with explicit tokens for missing and blank."""
    return F.when(c.isNull(), "<NULL>").when(S.blank(c), "<EMPTY>").otherwise(c)


def combination_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    g = df.groupBy(*[token(F.col(f)).alias(f) for f in fields]).agg(F.count(F.lit(1)).alias("row_count"))
    return g.select(F.to_json(F.struct(*fields)).alias("combination"), "row_count")


def role_audit(spine: DataFrame, source: DataFrame, key: str, index: str, other: str, controls: list[str], payload: list[str]) -> DataFrame:
    """Selection multiplicity, cross-check, code and combination frequencies, payload coverage."""
    row = lambda df, kind, name, code, rows, entities: df.select(
        F.lit(kind).alias("record_type"), F.lit(name).alias("field_name"), code.alias("code_or_state"),
        rows.cast("bigint").alias("row_count"), entities.cast("bigint").alias("entity_count"))
    none = F.lit(None)
    sel = select_index_zero(spine, source, key, index, payload)
    states = sel.groupBy(selection_state(F.col("source_rows"), F.col("selected_rows")).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    parts = [row(states, "SELECTION_MULTIPLICITY", index, F.col("s"), none, F.col("n")),
             row(index_cross_check(source, index, other), "SELECTION_CROSS_CHECK", other, F.col("state"), F.col("row_count"), none)]
    for c in controls:
        f = category_counts(spine, source, key, c).where(F.col("state") == "populated").groupBy("code").agg(F.sum("n").alias("n"))
        parts.append(row(f, "CODE_FREQUENCY", c, F.col("code"), F.col("n"), none))
    combos = combination_counts(source, controls)
    parts.append(row(combos, "COMBINATION_FREQUENCY", "|".join(controls), F.col("combination"), F.col("row_count"), none))
    for p in payload:
        parts.append(row(sel.agg(F.count(p).alias("n")), "PAYLOAD_COVERAGE", p, F.lit("POPULATED"), none, F.col("n")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def evidence_states(spine: DataFrame, source: DataFrame, key: str, active: Column, closed: Column) -> DataFrame:
    """Five-way partition of entities by the sides on which any row holds evidence."""
    reduced = source.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("source_rows"), F.bool_or(F.coalesce(active, F.lit(False))).alias("a"),
        F.bool_or(F.coalesce(closed, F.lit(False))).alias("c"))
    e = on_spine(spine, reduced, key)
    a, c = F.col("a"), F.col("c")
    state = (F.when(F.col("source_rows") == 0, "no_source_record").when(a & c, "both_active_and_closed")
             .when(a, "active_only").when(c, "closed_only").otherwise("neither"))
    return e.select(key, state.alias("state"))


def candidate_states(spine: DataFrame, source: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Per entity and field: state of a count candidate and its consistent value."""
    e = on_spine(spine, per_entity(source, key, fields), key)
    cols = [F.col(key)]
    for f in fields:
        c = lambda s, f=f: F.col(f"{f}__{s}")
        finite, lo, hi = c("finite") > 0, c("min"), c("max")
        same = finite & (lo == hi)
        st = (F.when(F.col("source_rows") == 0, CANDIDATE_STATES[0]).when(finite & (lo != hi), CANDIDATE_STATES[3])
              .when(same & (lo == 0), CANDIDATE_STATES[4]).when(same & (lo > 0), CANDIDATE_STATES[5])
              .when(same & (lo < 0), CANDIDATE_STATES[6]).when(c("unparseable") + c("nonfinite") > 0, CANDIDATE_STATES[2])
              .otherwise(CANDIDATE_STATES[1]))
        cols += [st.alias(f"{f}__state"), F.when(same, lo).alias(f"{f}__value")]
    return e.select(*cols)


def candidate_review(states: DataFrame, fields: list[str]) -> DataFrame:
    """State counts, unresolved shares, state cross-tabs (cells that occur) and pair agreement."""
    empty = F.lit("")
    row = lambda kind, l, r, metric, sl, sr, v: F.struct(
        F.lit(kind).alias("record_type"), F.lit(l).alias("candidate_left"), F.lit(r).alias("candidate_right"),
        F.lit(metric).alias("metric"), sl.alias("state_left"), sr.alias("state_right"), v.cast("double").alias("value"))
    cells = states.groupBy(*[f"{f}__state" for f in fields]).agg(F.count(F.lit(1)).alias("n"))  # at most 7^k rows
    out = None
    for f in fields:
        x = cells.groupBy(F.col(f"{f}__state").alias("s")).agg(F.sum("n").alias("n")).select(
            F.inline(F.array(row("CANDIDATE_STATE", f, "", "entity_state_count", F.col("s"), empty, F.col("n")))))
        out = x if out is None else out.unionByName(x)
    agg, items = [F.count(F.lit(1)).alias("n")], []
    for f in fields:
        agg.append(count_where(F.col(f"{f}__value").isNull()).alias(f"u_{f}"))
        items.append(row("CANDIDATE_SUMMARY", f, "", "unresolved_share", empty, empty, F.round(ratio(F.col(f"u_{f}"), F.col("n")), 9)))
    for l, r in combinations(fields, 2):
        a, b = F.col(f"{l}__value"), F.col(f"{r}__value")
        joint = a.isNotNull() & b.isNotNull()
        equal = S.close(a, b, rtol=0.0)
        for k, m in (("joint_consistent_count", joint), ("joint_agreement_count", joint & equal), ("joint_disagreement_count", joint & ~equal)):
            agg.append(count_where(m).alias(f"{k}_{l}_{r}"))
            items.append(row("PAIR_AGREEMENT", l, r, k, empty, empty, F.col(f"{k}_{l}_{r}")))
        x = cells.groupBy(F.col(f"{l}__state").alias("a"), F.col(f"{r}__state").alias("b")).agg(F.sum("n").alias("n")).select(
            F.inline(F.array(row("STATE_CROSSTAB", l, r, "joint_state_count", F.col("a"), F.col("b"), F.col("n")))))
        out = out.unionByName(x)
    return out.unionByName(states.agg(*agg).select(F.inline(F.array(*items))))


def consistent_value(spine: DataFrame, source: DataFrame, key: str, field: str) -> DataFrame:
    """Value of an entity when all its finite rows agree, else NULL."""
    e = on_spine(spine, per_entity(source, key, [field]), key)
    lo, hi = F.col(f"{field}__min"), F.col(f"{field}__max")
    return e.select(key, "source_rows", F.col(f"{field}__finite").alias("finite_rows"), F.when(lo == hi, lo).alias("value"),
                    F.coalesce(lo != hi, F.lit(False)).alias("conflict"))


def consistent_summary(values: DataFrame) -> DataFrame:
    n = F.col("source_rows")
    return values.agg(
        F.sum(n).alias("source_rows"), count_where(n > 0).alias("source_entities"), count_where(n > 1).alias("repeated_entities"),
        F.sum(F.greatest(n - 1, F.lit(0))).alias("excess_rows"),
        count_where((n > 0) & (F.col("finite_rows") == 0)).alias("source_present_no_finite"),
        count_where(F.col("conflict")).alias("conflicting_finite_values"))


def detail_timing(spine: DataFrame, source: DataFrame, key: str, field: str, decision: str) -> DataFrame:
    e = date_offsets_by_entity(J.day_offsets(source, spine, key, field, decision), key)
    past, after = F.col("any_before") | F.col("any_on"), F.col("any_after")
    full = F.col("parseable_rows") == F.col("source_rows")
    masks = {
        "any_future_observation": after, "all_source_rows_future": after & ~past & full, "both_past_and_future": past & after,
        "no_past_observation": ~past, "no_usable_date": F.col("parseable_rows") == 0,
    }
    return e.agg(F.count(F.lit(1)).alias("source_entities"), *[count_where(m).alias(k) for k, m in masks.items()])


def offsets_by_month(spine: DataFrame, source: DataFrame, key: str, field: str, decision: str) -> DataFrame:
    off = J.day_offsets(source, spine, key, field, decision).where(F.col("offset_days").isNotNull())
    return off.groupBy(F.date_format("decision_day", "yyyy-MM").alias("calendar_month"), "offset_days").agg(
        F.sum("row_count").alias("row_count"))


def top_offsets(spine: DataFrame, source: DataFrame, key: str, field: str, decision: str, n: int = 10) -> DataFrame:
    freq = offsets_by_month(spine, source, key, field, decision).groupBy("offset_days").agg(F.sum("row_count").alias("row_count"))
    return top_per_group(freq.withColumn("field", F.lit(field)), ["field"], "offset_days", "row_count", n)


def repeated_signatures(df: DataFrame, columns: list[str], dates: list[str], amounts: list[str]) -> DataFrame:
    """Rows equal in all chosen columns; the local index takes no part and NULLs group together."""
    g = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    no_date = F.lit(False)
    for d in dates:
        no_date = no_date | F.col(d).isNull()
    no_amount = F.lit(bool(amounts))
    for a in amounts:
        no_amount = no_amount & F.col(a).isNull()
    return g.agg(
        F.count(n).alias("signature_groups"), count_where(n > 1).alias("repeated_groups"),
        F.coalesce(F.sum(F.when(n > 1, n - 1)), F.lit(0)).alias("repeated_excess_rows"), F.max(n).alias("max_multiplicity"),
        F.coalesce(F.sum(F.when(no_date, n)), F.lit(0)).alias("rows_any_date_missing"),
        F.coalesce(F.sum(F.when(no_amount, n)), F.lit(0)).alias("rows_all_amounts_missing"))


# Names of the end-date states.
END_ROW_STATES = ("BEFORE_DECISION", "ON_DECISION", "AFTER_DECISION", "UNKNOWN")


def end_rows(spine: DataFrame, source: DataFrame, key: str, field: str, amount: str, decision: str) -> DataFrame:
    """(key, end state, amount, n): detail rows counted before they meet the decision date."""
    pre = source.where(F.col(key).isNotNull()).select(key, S.as_day(source, field).alias("day"), F.col(amount).alias("amount")).groupBy(
        key, "day", "amount").agg(F.count(F.lit(1)).alias("n"))
    days = spine.select(key, F.col(decision).cast("date").alias("decision_day"))
    j = J.skew_join(pre, days, key, "inner")
    d = F.datediff("day", "decision_day")
    state = F.when(d < 0, END_ROW_STATES[0]).when(d == 0, END_ROW_STATES[1]).when(d > 0, END_ROW_STATES[2]).when(
        F.col("day").isNull(), END_ROW_STATES[3])
    return j.select(key, state.alias("state"), "amount", "n")


def end_entity_states(spine: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    st = F.col("state")
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    e = on_spine(spine, rows.groupBy(key).agg(
        F.sum("n").alias("source_rows"), flag(st == END_ROW_STATES[0]).alias("b"),
        flag(st.isin(END_ROW_STATES[1], END_ROW_STATES[2])).alias("o"), flag(st == END_ROW_STATES[3]).alias("u")), key)
    b, o, u = F.col("b"), F.col("o"), F.col("u")
    state = (F.when(F.col("source_rows") == 0, "NO_SOURCE").when(o, "ANY_END_DATE_ON_OR_AFTER_DECISION")
             .when(b & u, "NO_END_DATE_ON_OR_AFTER_BUT_MIXED_BEFORE_AND_UNKNOWN").when(b, "ALL_ROWS_END_BEFORE_DECISION")
             .when(u, "ALL_END_DATES_UNKNOWN").otherwise("NO_USABLE_DECISION_DATE"))
    return e.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("entity_count"))


def end_amounts(rows: DataFrame) -> DataFrame:
    """Amount statistics per end-date row state."""
    r = rows.where(F.col("state").isNotNull())
    a, n = F.col("amount"), F.col("n")
    base = r.groupBy("state").agg(
        F.sum(n).alias("row_count"), F.coalesce(F.sum(F.when(a.isNotNull(), n)), F.lit(0)).alias("finite_count"),
        F.coalesce(F.sum(F.when(a == 0, n)), F.lit(0)).alias("zero_count"))
    counts = r.where(a.isNotNull()).groupBy("state", "amount").agg(F.sum(n).alias("f"))
    s = summary_of_counts(counts, ["state"], "amount", "f")
    keep = [c for c in s.columns if c not in ("state", "n", "distinct")]
    return base.join(s, "state", "left").select("state", "row_count", "finite_count", "zero_count", *[F.round(c, 6).alias(c) for c in keep])
