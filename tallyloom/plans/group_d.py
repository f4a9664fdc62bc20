"""Audits of keys, values, dates, categories and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import states as S
from ..operators import audit as A, coverage as V, detail as T, ranking as R
from ..operators.history import amount_state
from ..operators.ranking import SEVEN
from .registry import query
from .sqlviews import coverage_mask_sql, coverage_sql, long_sql, quantiles_sql, rated, unique_sql

COMPONENTS = {
    "debit_child": V.Component("debit", "child", ("amount_text",), ("code",)),
    "debit_summary": V.Component("debit", "summary", ("stated_sum",)),
    "deposit_detail": V.Component("deposit", "detail", ("amount",), ("flag",)),
    "tax_child": V.Component("tax", "child", ("pay_count",), ("date_text",)),
    "tax_summary": V.Component("tax", "summary", ("stated_count",), ("nation_code",)),
}
SOURCES = ["child", "detail", "summary"]


def flag_table(t):
    flags = V.component_flags(t.spine, {s: getattr(t, s) for s in SOURCES}, COMPONENTS, "case_id", ["decision_date"])
    return V.module_flags(flags, COMPONENTS)


@query(
    "d01_entity_mean_max",
    """SELECT case_id, src AS source_rows, round(v_mean, 6) AS amount_text__mean, v_max AS amount_text__max, n_finite AS amount_text__finite,
              n_nonzero AS amount_text__nonzero, n_missing AS amount_text__missing, n_unparseable + n_nonfinite AS amount_text__invalid
       FROM entity""",
)
def _(t):
    return A.aggregate_history(t.spine, t.child, "case_id", ["amount_text"]).withColumn(
        "amount_text__mean", F.round("amount_text__mean", 6))


@query(
    "d02_source_structure",
    """WITH k AS (SELECT case_id, count(*) AS n FROM child GROUP BY 1),
            p AS (SELECT case_id, num_group1, count(*) AS n FROM child WHERE case_id IS NOT NULL AND num_group1 IS NOT NULL GROUP BY 1, 2),
            j AS (SELECT k.*, s.case_id AS base FROM k LEFT JOIN spine s ON s.case_id = k.case_id)
       SELECT (SELECT count(*) FROM child) AS physical_rows, (SELECT count(*) FROM child WHERE case_id IS NULL) AS null_key_rows,
              count(case_id) AS distinct_keys, count(*) FILTER (WHERE case_id IS NOT NULL AND n > 1) AS duplicate_key_distinct,
              CAST(sum(n - 1) FILTER (WHERE case_id IS NOT NULL) AS BIGINT) AS duplicate_key_excess,
              CAST(sum(n) FILTER (WHERE base IS NOT NULL) AS BIGINT) AS matched_rows,
              CAST(coalesce(sum(n) FILTER (WHERE base IS NULL AND case_id IS NOT NULL), 0) AS BIGINT) AS orphan_rows,
              count(base) AS matched_keys, count(*) FILTER (WHERE base IS NULL AND case_id IS NOT NULL) AS orphan_keys,
              (SELECT count(*) FROM spine s WHERE s.case_id NOT IN (SELECT case_id FROM k WHERE case_id IS NOT NULL)) AS missing_base_keys,
              (SELECT count(*) FROM child WHERE num_group1 IS NULL) AS null_index_rows,
              (SELECT count(*) FROM child WHERE num_group1 < 0 OR num_group1 > 4294967295) AS invalid_index_rows,
              (SELECT count(*) FROM p WHERE n > 1) AS duplicate_composite_distinct,
              (SELECT CAST(sum(n - 1) AS BIGINT) FROM p) AS duplicate_composite_excess,
              'KEY_DEFECTS_REQUIRE_REVIEW' AS join_readiness
       FROM j""",
)
def _(t):
    return A.source_structure(t.spine, t.child, "case_id", "num_group1")


@query(
    "d03_record_distribution",
    """WITH c AS (SELECT src AS n FROM entity WHERE src > 0)
       SELECT min(n) AS min, max(n) AS max, quantile_cont(n::DOUBLE, 0.5) AS median, round(quantile_cont(n::DOUBLE, 0.9), 6) AS p90,
              round(quantile_cont(n::DOUBLE, 0.95), 6) AS p95, round(quantile_cont(n::DOUBLE, 0.99), 6) AS p99,
              count(*) FILTER (WHERE n = 1) AS entities_1_row, count(*) FILTER (WHERE n = 2) AS entities_2_rows,
              count(*) FILTER (WHERE n BETWEEN 3 AND 5) AS entities_3_5_rows,
              count(*) FILTER (WHERE n BETWEEN 6 AND 10) AS entities_6_10_rows, count(*) FILTER (WHERE n > 10) AS entities_gt10_rows FROM c""",
)
def _(t):
    counts = A.on_spine(t.spine, t.child.where("case_id IS NOT NULL").groupBy("case_id").agg(F.count(F.lit(1)).alias("n")), "case_id")
    return A.record_distribution(counts, "n")


def _numeric_long() -> str:
    states = ("missing", "unparseable", "nonfinite", "zero", "positive", "negative")
    m = [x for s in states for x in rated(f"row_state_{s}", f"r_{s}", "matched_source_rows", "matched_rows")]
    m += [("finite_observation_count", "n", "matched_source_rows", "matched_rows"),
          ("distinct_finite_value_count", "d", "finite_observations", "n")]
    m += [(f"finite_{q}", f"q_{q}", "finite_observations", "n", "UNDEFINED_NO_FINITE_VALUES") for q in ("min", *SEVEN, "max", "mean")]
    for s in S.ENTITY_STATES:
        m += [(f"entity_state_{s}_count", f"e_{s}", "population", "population"),
              (f"entity_state_{s}_population_rate", f"e_{s} / population", "population", "population"),
              (f"entity_state_{s}_source_rate", "CAST(NULL AS DOUBLE)" if s == "NO_SOURCE_RECORD" else f"e_{s} / sources",
               "entities_with_source", "sources", "NOT_APPLICABLE")]
    m += [(f"entities_{d}", f"d_{d}", "population", "population")
          for d in ("finite_and_missing", "zero_and_nonzero", "any_invalid", "finite_variation_across_rows")]
    extra = [x for k in ("nonnegative", "integer_like", "positive_integer_like")
             for x in rated(f"finite_{k}", f"c_{k}", "finite_observations", "n")]
    return long_sql("w", m, ["field"]) + "\nUNION ALL " + long_sql("(SELECT * FROM w WHERE field = 'pay_count') w", extra, ["field"])


@query(
    "d04_numeric_audit",
    """WITH u AS (SELECT case_id, 'amount_text' AS field, st, val FROM child_num
                  UNION ALL SELECT case_id, 'pay_count', CASE WHEN pay_count IS NULL THEN 'missing' WHEN pay_count = 0 THEN 'zero'
                                   WHEN pay_count > 0 THEN 'positive' ELSE 'negative' END, pay_count FROM child),
            m AS (SELECT u.* FROM u JOIN spine s ON s.case_id = u.case_id),
            e AS (SELECT s.case_id, f.field, count(m.st) AS src, count(m.val) AS fin, count(*) FILTER (WHERE m.val <> 0) AS nz,
                         count(*) FILTER (WHERE st = 'missing') AS mis, count(*) FILTER (WHERE st = 'zero') AS zer,
                         count(*) FILTER (WHERE st IN ('unparseable', 'nonfinite')) AS inv, count(DISTINCT val) AS dv
                  FROM spine s CROSS JOIN (SELECT DISTINCT field FROM u) f LEFT JOIN m ON m.case_id = s.case_id AND m.field = f.field
                  GROUP BY ALL),
            a AS (SELECT field, count(*) AS matched_rows, """
    + ", ".join(f"count(*) FILTER (WHERE st = '{s}') AS r_{s}" for s in S.ROW_STATES)
    + ", count(val) AS n, count(DISTINCT val) AS d, min(val) AS q_min, max(val) AS q_max, avg(val) AS q_mean, "
    + ", ".join(f"quantile_cont(val, {p}) AS q_{k}" for k, p in SEVEN.items())
    + """, count(*) FILTER (WHERE val >= 0) AS c_nonnegative, count(*) FILTER (WHERE val = floor(val)) AS c_integer_like,
           count(*) FILTER (WHERE val > 0 AND val = floor(val)) AS c_positive_integer_like FROM m GROUP BY field),
            b AS (SELECT field, count(*) AS population, count(*) FILTER (WHERE src > 0) AS sources,
                         count(*) FILTER (WHERE src = 0) AS e_NO_SOURCE_RECORD,
                         count(*) FILTER (WHERE src > 0 AND fin = 0) AS e_SOURCE_PRESENT_NO_FINITE_OBSERVATION,
                         count(*) FILTER (WHERE fin > 0 AND nz = 0) AS e_FINITE_OBSERVATIONS_ZERO_ONLY,
                         count(*) FILTER (WHERE nz > 0) AS e_AT_LEAST_ONE_FINITE_NONZERO_OBSERVATION,
                         count(*) FILTER (WHERE fin > 0 AND mis > 0) AS d_finite_and_missing,
                         count(*) FILTER (WHERE zer > 0 AND nz > 0) AS d_zero_and_nonzero, count(*) FILTER (WHERE inv > 0) AS d_any_invalid,
                         count(*) FILTER (WHERE dv > 1) AS d_finite_variation_across_rows FROM e GROUP BY field),
            w AS (SELECT a.*, b.* EXCLUDE (field) FROM a JOIN b ON a.field = b.field) """
    + _numeric_long(),
)
def _(t):
    return A.audit_numeric(t.spine, t.child, "case_id", ["amount_text", "pay_count"], ["pay_count"])


@query(
    "d05_entity_partition",
    """SELECT case_id, CASE WHEN src = 0 THEN 'NO_SOURCE_RECORD' WHEN n_finite = 0 THEN 'SOURCE_PRESENT_NO_FINITE_OBSERVATION'
              WHEN n_nonzero = 0 THEN 'FINITE_OBSERVATIONS_ZERO_ONLY' ELSE 'AT_LEAST_ONE_FINITE_NONZERO_OBSERVATION' END AS state FROM entity""",
)
def _(t):
    return A.entity_partition(t.spine, t.child, "case_id", "amount_text")


def _q10(field, table):
    return (f"SELECT '{field}' AS field, count({field}) AS n, count(DISTINCT {field}) AS distinct_values, round(min({field}), 6) AS min, "
            f"{quantiles_sql(field, SEVEN)}, round(max({field}), 6) AS max, round(avg({field}), 9) AS mean FROM {table}")


@query("d06_exact_quantiles", " UNION ALL ".join(_q10(f, "lineitem") for f in ("l_extendedprice", "l_quantity", "l_discount")))
def _(t):
    fields = ["l_extendedprice", "l_quantity", "l_discount"]
    long = t.lineitem.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in fields])))
    s = R.value_summary(long, ["field"], "v")
    return s.select("field", "n", F.col("distinct").alias("distinct_values"), *[F.round(c, 6).alias(c) for c in ("min", *SEVEN, "max")],
                    F.round("mean", 9).alias("mean"))


_OFFS = "o AS (SELECT dst, datediff('day', decision_date, dday) AS off FROM matched)"


@query(
    "d07_date_audit",
    f"""WITH {_OFFS}, w AS (SELECT count(*) AS matched_rows, """
    + ", ".join(f"count(*) FILTER (WHERE dst = '{s}') AS s_{s}" for s in S.DATE_STATES)
    + """, count(off) AS pairs, count(*) FILTER (WHERE dst = 'parseable' AND off IS NULL) AS no_base,
           count(*) FILTER (WHERE off < 0) AS below_zero, count(*) FILTER (WHERE off = 0) AS equal_zero,
           count(*) FILTER (WHERE off > 0) AS above_zero, min(off) AS q_min, quantile_cont(off::DOUBLE, 0.05) AS q_p05,
           quantile_cont(off::DOUBLE, 0.5) AS q_median, quantile_cont(off::DOUBLE, 0.95) AS q_p95, max(off) AS q_max FROM o) """
    + long_sql("w", [x for s in S.DATE_STATES for x in rated(f"row_date_{s}", f"s_{s}", "matched_source_rows", "matched_rows")]
               + [("date_offset_valid_pair_count", "pairs", "parseable_rows", "s_parseable"),
                  ("date_source_without_usable_base_date_count", "no_base", "parseable_rows", "s_parseable")]
               + [x for s in ("below_zero", "equal_zero", "above_zero") for x in rated(f"date_offset_{s}", s, "valid_date_pairs", "pairs")]
               + [(f"date_offset_days_{q}", f"q_{q}", "valid_date_pairs", "pairs", "UNDEFINED_NO_VALID_PAIRS")
                  for q in ("min", "p05", "median", "p95", "max")]),
)
def _(t):
    return A.audit_date(t.spine, t.child, "case_id", "date_text", "decision_date")


@query(
    "d08_entity_timing",
    """SELECT case_id, coalesce(bool_or(dday < decision_date), false) AS any_before, coalesce(bool_or(dday = decision_date), false) AS any_on,
              coalesce(bool_or(dday > decision_date), false) AS any_after,
              coalesce(bool_or(dday < decision_date), false) AND coalesce(bool_or(dday > decision_date), false) AS mixed_before_and_after,
              count(dday) = 0 AS no_usable_date FROM matched GROUP BY case_id""",
)
def _(t):
    return A.entity_timing(t.spine, t.child, "case_id", "date_text", "decision_date")


@query(
    "d09_latest_date_ties",
    """WITH m AS (SELECT *, max(dday) OVER (PARTITION BY case_id) AS latest FROM matched),
            g AS (SELECT case_id, count(*) AS n, count(DISTINCT (amount_text, code)) AS v FROM m WHERE dday = latest GROUP BY case_id)
       SELECT (SELECT count(DISTINCT case_id) FROM matched) AS source_entities,
              (SELECT count(DISTINCT case_id) FROM m WHERE latest IS NULL) AS entities_no_usable_date,
              count(*) FILTER (WHERE n > 1) AS entities_latest_date_tied,
              count(*) FILTER (WHERE n > 1 AND v > 1) AS entities_latest_tie_payload_conflict, 'MEASURED' AS tie_status FROM g
       UNION ALL SELECT (SELECT count(DISTINCT case_id) FROM matched), (SELECT count(DISTINCT case_id) FROM m WHERE latest IS NULL),
              NULL, NULL, 'NOT_CHECKED'""",
)
def _(t):
    args = (t.spine, t.child, "case_id", "date_text", ["amount_text", "code"])
    return A.latest_date_ties(*args).unionByName(A.latest_date_ties(*args, track=False))


_TXT = """w AS (SELECT count(*) AS matched_rows, count(*) FILTER (WHERE code IS NULL) AS native_missing,
           count(*) FILTER (WHERE trim(code) = '') AS empty_or_whitespace, count(*) FILTER (WHERE trim(code) <> '') AS populated,
           count(DISTINCT CASE WHEN trim(code) <> '' THEN code END) AS codes,
           (SELECT count(*) FROM spine) AS population,
           (SELECT count(*) FROM (SELECT case_id FROM matched WHERE trim(code) <> '' GROUP BY 1 HAVING count(DISTINCT code) > 1) v) AS varying
    FROM matched)"""


@query(
    "d10_category_audit",
    f"WITH {_TXT} " + long_sql("w", [x for s in S.TEXT_STATES for x in rated(f"row_category_{s}", s, "matched_source_rows", "matched_rows")]
                               + [("entities_with_category_variation", "varying", "population", "population"),
                                  ("distinct_populated_code_count", "codes", "populated_matched_rows", "populated")]),
)
def _(t):
    return A.audit_category(t.spine, t.child, "case_id", "code")


@query("d10_category_frequencies", "SELECT code, count(*) AS row_count FROM matched WHERE trim(code) <> '' GROUP BY code")
def _(t):
    f = A.category_counts(t.spine, t.child, "case_id", "code").where("state = 'populated'")
    return f.groupBy("code").agg(F.sum("n").alias("row_count"))


@query(
    "d11_text_audit",
    f"WITH {_TXT} " + long_sql("w", [x for s in S.TEXT_STATES for x in rated(f"row_text_{s}", s, "matched_source_rows", "matched_rows")]
                               + [("distinct_populated_token_count", "codes", "populated_matched_rows", "populated")]),
)
def _(t):
    return A.audit_text(t.spine, t.child, "case_id", "code")


_PAIRS = [("ad_debit_mean", "ad_debit_max"), ("ad_debit_mean", "ad_deposit_mean"), ("ad_debit_mean", "t_income"),
          ("ad_debit_max", "ad_deposit_mean"), ("ad_debit_max", "t_income"), ("ad_deposit_mean", "t_income")]


@query(
    "d12_pair_diagnostics",
    " UNION ALL ".join(
        f"""SELECT '{a}|{b}' AS pair, count(*) AS matched_rows, count({a} + {b}) AS joint_finite_rows,
            count(*) FILTER (WHERE {a} IS NULL AND {b} IS NULL) AS joint_missing_rows,
            count(*) FILTER (WHERE abs({a} - {b}) <= 1e-12 + 1e-9 * abs({b})) AS equal_count,
            count({a} + {b}) - count(*) FILTER (WHERE abs({a} - {b}) <= 1e-12 + 1e-9 * abs({b})) AS disagreement_count,
            round(count(*) FILTER (WHERE abs({a} - {b}) <= 1e-12 + 1e-9 * abs({b})) / count({a} + {b}), 6) AS equality_rate,
            round(corr({a}, {b}), 6) AS pearson_correlation FROM features""" for a, b in _PAIRS),
)
def _(t):
    return A.pair_diagnostics(t.features, ["ad_debit_mean", "ad_debit_max", "ad_deposit_mean", "t_income"])


_DTYPES = {"row_id": "bigint", "case_id": "bigint", "num_group1": "bigint", "shard": "string", "amount_text": "string", "amount": "double",
           "pay_count": "double", "date_text": "string", "event_day": "date", "code": "string", "side": "string"}


@query("d13_schema_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{d}' AS dtype, count(*) AS row_count, count(*) - count({c}) AS null_count FROM child" for c, d in _DTYPES.items()))
def _(t):
    return A.schema_profile(t.child)


@query(
    "d14_key_profile",
    """WITH k AS (SELECT case_id, count(*) AS n FROM child WHERE case_id IS NOT NULL GROUP BY 1)
       SELECT (SELECT count(case_id) FROM child) AS non_null_rows, (SELECT count(*) - count(case_id) FROM child) AS missing_rows,
              count(*) AS distinct_keys, count(*) FILTER (WHERE n > 1) AS repeated_distinct_keys, CAST(sum(n - 1) AS BIGINT) AS excess_rows,
              'FAIL' AS uniqueness_check FROM k""",
)
def _(t):
    return A.key_profile(t.child.select("case_id"), "case_id")


@query(
    "d15_duplicate_rows",
    """WITH g AS (SELECT case_id, num_group1, amount, flag, status, count(*) AS n FROM detail GROUP BY ALL HAVING count(*) > 1)
       SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS excess_duplicate_rows, CAST(coalesce(sum(n), 0) AS BIGINT) AS participating_rows,
              count(*) AS duplicate_patterns FROM g""",
)
def _(t):
    return A.duplicate_profile(t.detail.select("case_id", "num_group1", "amount", "flag", "status"))


@query(
    "d16_label_distribution",
    """SELECT CAST(target AS VARCHAR) AS value, CASE WHEN target IS NULL THEN 'missing' WHEN target = 0 THEN 'target_0'
              WHEN target = 1 THEN 'target_1' ELSE 'other' END AS label_class, count(*) AS row_count FROM spine GROUP BY 1, 2""",
)
def _(t):
    return A.label_distribution(t.spine, "target")


@query("d17_range_profile", " UNION ALL ".join(
    f"""SELECT '{c}' AS field, count(*) - count({c}) AS missing_count, count(DISTINCT {c}) AS distinct_non_null,
        CAST(min({c}) AS DOUBLE) AS observed_min, CAST(max({c}) AS DOUBLE) AS observed_max FROM spine"""
    for c in ("week_num", "month_code", "target", "balance")))
def _(t):
    return A.range_profile(t.spine, ["week_num", "month_code", "target", "balance"])


@query(
    "d18_weekly_summary",
    """SELECT week_num, count(*) AS row_count, CAST(min(decision_date) AS VARCHAR) AS min_day, CAST(max(decision_date) AS VARCHAR) AS max_day,
              count(*) - count(decision_date) AS missing_day_count, count(*) FILTER (WHERE target = 0) AS target_0_count,
              count(*) FILTER (WHERE target = 1) AS target_1_count, count(*) - count(target) AS target_missing_count,
              count(*) FILTER (WHERE target NOT IN (0, 1)) AS target_other_count,
              count(*) FILTER (WHERE target IN (0, 1)) AS valid_binary_label_count,
              round(count(*) FILTER (WHERE target = 1) / nullif(count(*) FILTER (WHERE target IN (0, 1)), 0), 9) AS event_rate,
              week_num IS NULL AS week_is_missing FROM spine GROUP BY week_num""",
)
def _(t):
    return A.weekly_summary(t.spine, "week_num", "decision_date", "target")


@query(
    "d19_missing_weeks",
    """SELECT 'week_num' AS field, v AS missing_value FROM (SELECT unnest(generate_series(min(week_num), max(week_num))) AS v FROM spine) g
       WHERE v NOT IN (SELECT week_num FROM spine WHERE week_num IS NOT NULL)""",
)
def _(t):
    return A.missing_integers(t.spine, "week_num")


@query(
    "d20_temporal_checks",
    """WITH d AS (SELECT decision_date, count(DISTINCT coalesce(week_num, -1)) AS k FROM spine WHERE decision_date IS NOT NULL GROUP BY 1),
            r AS (SELECT week_num, min(decision_date) AS lo, max(decision_date) AS hi FROM spine WHERE week_num IS NOT NULL
                  GROUP BY 1 HAVING min(decision_date) IS NOT NULL),
            p AS (SELECT *, lag(lo) OVER (ORDER BY week_num) AS plo, lag(hi) OVER (ORDER BY week_num) AS phi FROM r),
            u AS (SELECT 'date_maps_to_one_week' AS check_id, count(*) AS compared, count(*) FILTER (WHERE k > 1) AS findings FROM d
                  UNION ALL SELECT 'backward_min_date', count(plo), count(*) FILTER (WHERE lo < plo) FROM p
                  UNION ALL SELECT 'backward_max_date', count(plo), count(*) FILTER (WHERE hi < phi) FROM p
                  UNION ALL SELECT 'overlapping_ranges', count(plo), count(*) FILTER (WHERE lo <= phi) FROM p)
       SELECT *, CASE WHEN findings = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM u""",
)
def _(t):
    return A.temporal_checks(t.spine, "week_num", "decision_date")


@query(
    "d21_month_mapping",
    """SELECT month_code, count(*) AS row_count, CAST(min(decision_date) AS VARCHAR) AS min_day, CAST(max(decision_date) AS VARCHAR) AS max_day,
              count(*) - count(decision_date) AS missing_day_count, count(DISTINCT strftime(decision_date, '%Y-%m')) AS calendar_months,
              coalesce(string_agg(DISTINCT strftime(decision_date, '%Y-%m'), ',' ORDER BY strftime(decision_date, '%Y-%m')), '') AS calendar_month_values
       FROM spine GROUP BY month_code""",
)
def _(t):
    return A.month_mapping(t.spine, "month_code", "decision_date")


@query(
    "d21_calendar_to_month",
    """SELECT strftime(decision_date, '%Y-%m') AS calendar_month, count(DISTINCT coalesce(month_code, -1)) AS month_codes
       FROM spine WHERE decision_date IS NOT NULL GROUP BY 1""",
)
def _(t):
    return A.calendar_to_month(t.spine, "month_code", "decision_date")


_C = [f"{n}__{k}" for n in COMPONENTS for k in V.MEASURES]
_M = [f"module_{m}__{k}" for m in ("debit", "deposit", "tax") for k in V.MODULE_MEASURES]


@query("d22_component_flags", f"SELECT case_id, {', '.join(_C)} FROM flag_table")
def _(t):
    return flag_table(t).select("case_id", *_C)


@query("d23_module_flags", f"SELECT case_id, {', '.join(_M)} FROM flag_table")
def _(t):
    return flag_table(t).select("case_id", *_M)


@query("d24_coverage_rows", coverage_sql(coverage_mask_sql()))
def _(t):
    return V.coverage_rows(flag_table(t), V.coverage_masks(COMPONENTS, SOURCES))


@query("d25_unique_contribution", coverage_sql(unique_sql()))
def _(t):
    return V.coverage_rows(flag_table(t), V.unique_contribution(COMPONENTS))


def _pattern_sql(kind, bits):
    code = "concat(" + ", ".join(f"CAST({b} AS INT)" for b in bits) + ")"
    k = len(bits)
    grid = "SELECT " + " || ".join(f"CAST(i // {2 ** (k - 1 - j)} % 2 AS VARCHAR)" for j in range(k)) + f" AS pattern FROM range({2 ** k}) t(i)"
    return (f"SELECT '{kind}' AS pattern_type, g.pattern, coalesce(c, 0) AS pattern_count, (SELECT count(*) FROM flag_table) AS denominator_value, "
            f"round(coalesce(c, 0) / (SELECT count(*) FROM flag_table), 9) AS rate FROM ({grid}) g "
            f"LEFT JOIN (SELECT {code} AS pattern, count(*) AS c FROM flag_table GROUP BY 1) x ON x.pattern = g.pattern")


_MOD = [f"module_{m}__content" for m in ("debit", "deposit", "tax")]
_TAX = ["tax_child__content", "tax_summary__content", "debit_child__content", "deposit_detail__nonzero"]


@query("d26_overlap_patterns", _pattern_sql("MODULE_CONTENT", _MOD) + " UNION ALL " + _pattern_sql("COMPONENT_CONTENT", _TAX))
def _(t):
    f = flag_table(t)
    return V.pattern_counts(f, "MODULE_CONTENT", [F.col(c) for c in _MOD]).unionByName(
        V.pattern_counts(f, "COMPONENT_CONTENT", [F.col(c) for c in _TAX]))


@query(
    "d27_monthly_coverage",
    "SELECT coalesce(strftime(decision_date, '%Y-%m'), 'UNKNOWN_DATE') AS calendar_month, count(*) AS entity_count, "
    + ", ".join(f"count(*) FILTER (WHERE {e}) AS {n}_count, round(count(*) FILTER (WHERE {e}) / count(*), 9) AS {n}_rate" for n, e in (
        [(f"{m}_content", f"module_{m}__content") for m in ("debit", "deposit", "tax")]
        + [("any_module", " OR ".join(_MOD)), ("all_modules", " AND ".join(_MOD))]))
    + " FROM flag_table GROUP BY 1",
)
def _(t):
    return V.monthly_coverage(flag_table(t), "decision_date", ["debit", "deposit", "tax"])


@query("d28_flag_table", "SELECT * EXCLUDE (decision_date), CAST(decision_date AS VARCHAR) AS decision_day FROM flag_table")
def _(t):
    return flag_table(t).withColumn("decision_day", F.col("decision_date").cast("string")).drop("decision_date")


_SEL = """sel AS (SELECT s.case_id, count(c.row_id) AS n, count(*) FILTER (WHERE c.num_group1 = 0) AS z,
           max(CASE WHEN c.num_group1 = 0 THEN c.amount_text END) AS amount_text, max(CASE WHEN c.num_group1 = 0 THEN c.code END) AS code
    FROM spine s LEFT JOIN child c ON c.case_id = s.case_id GROUP BY s.case_id)"""
_SEL_STATE = """CASE WHEN n = 0 THEN 'NO_PERSON_SOURCE' WHEN z = 0 THEN 'SOURCE_PRESENT_ZERO_INDEX_ZERO_ROWS'
    WHEN z = 1 THEN 'EXACTLY_ONE_INDEX_ZERO_ROW' ELSE 'MULTIPLE_INDEX_ZERO_ROWS' END"""


@query(
    "d29_index_zero_rows",
    f"""WITH {_SEL} SELECT case_id, n AS source_rows, z AS selected_rows, CASE WHEN z = 1 THEN amount_text END AS amount_text,
        CASE WHEN z = 1 THEN code END AS code, {_SEL_STATE} AS state FROM sel""",
)
def _(t):
    s = T.select_index_zero(t.spine, t.child, "case_id", "num_group1", ["amount_text", "code"])
    return s.withColumn("state", T.selection_state(F.col("source_rows"), F.col("selected_rows")))


_TOK = "CASE WHEN {0} IS NULL THEN '<NULL>' WHEN trim({0}) = '' THEN '<EMPTY>' ELSE {0} END"
_COMBO = f"""SELECT concat('{{"code":"', {_TOK.format('code')}, '","side":"', {_TOK.format('side')}, '"}}') AS combination,
             count(*) AS row_count FROM child GROUP BY 1"""


@query("d30_category_combinations", _COMBO)
def _(t):
    return T.combination_counts(t.child, ["code", "side"])


@query(
    "d31_role_audit",
    f"""WITH {_SEL}
    SELECT 'SELECTION_MULTIPLICITY' AS record_type, 'num_group1' AS field_name, {_SEL_STATE} AS code_or_state, CAST(NULL AS BIGINT) AS row_count,
           count(*) AS entity_count FROM sel GROUP BY 3
    UNION ALL SELECT 'SELECTION_CROSS_CHECK', 'pay_count', CASE WHEN pay_count IS NULL THEN 'other_index_missing' WHEN pay_count = 0
           THEN 'other_index_zero' ELSE 'other_index_nonzero' END, count(*), NULL FROM child WHERE num_group1 = 0 GROUP BY 3
    UNION ALL SELECT 'CODE_FREQUENCY', 'code', code, count(*), NULL FROM matched WHERE trim(code) <> '' GROUP BY 3
    UNION ALL SELECT 'CODE_FREQUENCY', 'side', side, count(*), NULL FROM matched WHERE trim(side) <> '' GROUP BY 3
    UNION ALL SELECT 'COMBINATION_FREQUENCY', 'code|side', combination, row_count, NULL FROM ({_COMBO}) x
    UNION ALL SELECT 'PAYLOAD_COVERAGE', 'amount_text', 'POPULATED', NULL, count(amount_text) FROM sel WHERE z = 1""",
)
def _(t):
    return T.role_audit(t.spine, t.child, "case_id", "num_group1", "pay_count", ["code", "side"], ["amount_text"])


@query(
    "d32_evidence_states",
    """SELECT s.case_id, CASE WHEN count(c.row_id) = 0 THEN 'no_source_record'
              WHEN bool_or(c.amount IS NOT NULL AND c.side = 'O') AND bool_or(c.event_day IS NOT NULL AND c.side = 'F') THEN 'both_active_and_closed'
              WHEN bool_or(c.amount IS NOT NULL AND c.side = 'O') THEN 'active_only'
              WHEN bool_or(c.event_day IS NOT NULL AND c.side = 'F') THEN 'closed_only' ELSE 'neither' END AS state
       FROM spine s LEFT JOIN child c ON c.case_id = s.case_id GROUP BY s.case_id""",
)
def _(t):
    active = F.col("amount").isNotNull() & (F.col("side") == "O")
    closed = F.col("event_day").isNotNull() & (F.col("side") == "F")
    return T.evidence_states(t.spine, t.child, "case_id", active, closed)


def _cand(f, lo, hi, fin, inv):
    return (f"CASE WHEN src = 0 THEN 'NO_SOURCE_RECORD' WHEN {lo} <> {hi} THEN 'CONFLICTING_FINITE_VALUES' WHEN {lo} = 0 THEN 'OBSERVED_ZERO' "
            f"WHEN {lo} > 0 THEN 'OBSERVED_POSITIVE' WHEN {lo} < 0 THEN 'OBSERVED_NEGATIVE' WHEN {inv} > 0 THEN 'INVALID' "
            f"ELSE 'SOURCE_PRESENT_NO_FINITE' END AS {f}__state, CASE WHEN {lo} = {hi} THEN {lo} END AS {f}__value")


_CAND = f"""cs AS (SELECT case_id, {_cand('pay_count', 'plo', 'phi', 'pf', '0')}, {_cand('amount', 'alo', 'ahi', 'af', '0')},
           {_cand('amount_text', 'xlo', 'xhi', 'xf', 'xi')}
    FROM (SELECT s.case_id, count(c.row_id) AS src, min(pay_count) AS plo, max(pay_count) AS phi, min(amount) AS alo, max(amount) AS ahi,
                 min(val) AS xlo, max(val) AS xhi, count(*) FILTER (WHERE st IN ('unparseable', 'nonfinite')) AS xi
          FROM spine s LEFT JOIN child_num c ON c.case_id = s.case_id GROUP BY s.case_id) e)"""
_CF = ["pay_count", "amount", "amount_text"]


@query("d33_candidate_states", f"WITH {_CAND} SELECT * FROM cs")
def _(t):
    return T.candidate_states(t.spine, t.child, "case_id", _CF)


def _review_sql():
    cols = "AS record_type, '{l}' AS candidate_left, '{r}' AS candidate_right, '{m}' AS metric, {sl} AS state_left, {sr} AS state_right, "
    out = []
    for f in _CF:
        out.append("SELECT 'CANDIDATE_STATE' " + cols.format(l=f, r="", m="entity_state_count", sl=f"{f}__state", sr="''")
                   + f"CAST(count(*) AS DOUBLE) AS value FROM cs GROUP BY {f}__state")
        out.append("SELECT 'CANDIDATE_SUMMARY' " + cols.format(l=f, r="", m="unresolved_share", sl="''", sr="''")
                   + f"round(count(*) FILTER (WHERE {f}__value IS NULL) / count(*), 9) AS value FROM cs")
    for i, a in enumerate(_CF):
        for b in _CF[i + 1:]:
            out.append("SELECT 'STATE_CROSSTAB' " + cols.format(l=a, r=b, m="joint_state_count", sl=f"{a}__state", sr=f"{b}__state")
                       + f"CAST(count(*) AS DOUBLE) AS value FROM cs GROUP BY {a}__state, {b}__state")
            eq = f"abs({a}__value - {b}__value) <= 1e-12"
            for m, e in (("joint_consistent_count", f"{a}__value + {b}__value IS NOT NULL"), ("joint_agreement_count", eq),
                         ("joint_disagreement_count", f"NOT ({eq})")):
                out.append("SELECT 'PAIR_AGREEMENT' " + cols.format(l=a, r=b, m=m, sl="''", sr="''")
                           + f"CAST(count(*) FILTER (WHERE {e}) AS DOUBLE) AS value FROM cs")
    return f"WITH {_CAND} " + " UNION ALL ".join(out)


@query("d34_candidate_review", _review_sql())
def _(t):
    return T.candidate_review(T.candidate_states(t.spine, t.child, "case_id", _CF), _CF)


@query(
    "d35_consistent_value",
    """SELECT s.case_id, count(c.row_id) AS source_rows, count(c.pay_count) AS finite_rows,
              CASE WHEN min(pay_count) = max(pay_count) THEN min(pay_count) END AS value,
              coalesce(min(pay_count) <> max(pay_count), false) AS conflict
       FROM spine s LEFT JOIN child c ON c.case_id = s.case_id GROUP BY s.case_id""",
)
def _(t):
    return T.consistent_value(t.spine, t.child, "case_id", "pay_count")


@query(
    "d35_consistent_summary",
    """WITH e AS (SELECT s.case_id, count(c.row_id) AS n, count(c.pay_count) AS f, min(pay_count) <> max(pay_count) AS x
                  FROM spine s LEFT JOIN child c ON c.case_id = s.case_id GROUP BY s.case_id)
       SELECT CAST(sum(n) AS BIGINT) AS source_rows, count(*) FILTER (WHERE n > 0) AS source_entities,
              count(*) FILTER (WHERE n > 1) AS repeated_entities, CAST(sum(greatest(n - 1, 0)) AS BIGINT) AS excess_rows,
              count(*) FILTER (WHERE n > 0 AND f = 0) AS source_present_no_finite, count(*) FILTER (WHERE x) AS conflicting_finite_values FROM e""",
)
def _(t):
    return T.consistent_summary(T.consistent_value(t.spine, t.child, "case_id", "pay_count"))


@query(
    "d36_detail_timing",
    """WITH e AS (SELECT case_id, count(*) AS n, count(dday) AS p, coalesce(bool_or(dday <= decision_date), false) AS past,
                         coalesce(bool_or(dday > decision_date), false) AS fut FROM matched GROUP BY case_id)
       SELECT count(*) AS source_entities, count(*) FILTER (WHERE fut) AS any_future_observation,
              count(*) FILTER (WHERE fut AND NOT past AND n = p) AS all_source_rows_future, count(*) FILTER (WHERE fut AND past) AS both_past_and_future,
              count(*) FILTER (WHERE NOT past) AS no_past_observation, count(*) FILTER (WHERE p = 0) AS no_usable_date FROM e""",
)
def _(t):
    return T.detail_timing(t.spine, t.child, "case_id", "date_text", "decision_date")


@query(
    "d37_offsets_by_month",
    """SELECT strftime(decision_date, '%Y-%m') AS calendar_month, datediff('day', decision_date, dday) AS offset_days, count(*) AS row_count
       FROM matched WHERE dday IS NOT NULL AND decision_date IS NOT NULL GROUP BY 1, 2""",
)
def _(t):
    return T.offsets_by_month(t.spine, t.child, "case_id", "date_text", "decision_date")


@query(
    "d37_top_offsets",
    """WITH f AS (SELECT datediff('day', decision_date, dday) AS offset_days, count(*) AS row_count FROM matched
                  WHERE dday IS NOT NULL AND decision_date IS NOT NULL GROUP BY 1)
       SELECT 'date_text' AS field, offset_days, row_count, row_number() OVER (ORDER BY row_count DESC, offset_days) AS rank FROM f
       QUALIFY rank <= 10""",
)
def _(t):
    return T.top_offsets(t.spine, t.child, "case_id", "date_text", "decision_date")


@query(
    "d38_amount_states",
    """SELECT s.case_id, CASE WHEN count(c.row_id) = 0 THEN 'NO_DETAIL_SOURCE' WHEN count(val) = 0 THEN 'DETAIL_ALL_AMOUNTS_MISSING_OR_INVALID'
              WHEN sum(val) = 0 THEN 'DETAIL_FINITE_ZERO_SUM' ELSE 'DETAIL_FINITE_NONZERO_SUM' END AS state
       FROM spine s LEFT JOIN child_num c ON c.case_id = s.case_id GROUP BY s.case_id""",
)
def _(t):
    e = A.on_spine(t.spine, A.per_entity(t.child, "case_id", ["amount_text"]), "case_id")
    return e.select("case_id", amount_state(F.col("source_rows"), F.col("amount_text__finite"), F.col("amount_text__sum")).alias("state"))


@query(
    "d39_repeated_signatures",
    """WITH g AS (SELECT case_id, amount, event_day, flag, count(*) AS n FROM detail GROUP BY ALL)
       SELECT count(*) AS signature_groups, count(*) FILTER (WHERE n > 1) AS repeated_groups,
              CAST(coalesce(sum(n - 1) FILTER (WHERE n > 1), 0) AS BIGINT) AS repeated_excess_rows, max(n) AS max_multiplicity,
              CAST(sum(n) FILTER (WHERE event_day IS NULL) AS BIGINT) AS rows_any_date_missing,
              CAST(sum(n) FILTER (WHERE amount IS NULL) AS BIGINT) AS rows_all_amounts_missing FROM g""",
)
def _(t):
    return T.repeated_signatures(t.detail, ["case_id", "amount", "event_day", "flag"], ["event_day"], ["amount"])


_END = """er AS (SELECT d.case_id, d.amount, CASE WHEN close_day < decision_date THEN 'BEFORE_DECISION' WHEN close_day = decision_date THEN 'ON_DECISION'
           WHEN close_day > decision_date THEN 'AFTER_DECISION' WHEN close_day IS NULL THEN 'UNKNOWN' END AS state
    FROM detail d JOIN spine s ON s.case_id = d.case_id)"""


@query(
    "d40_end_entity_states",
    f"""WITH {_END}, e AS (SELECT s.case_id, count(er.case_id) AS n, bool_or(state = 'BEFORE_DECISION') AS b,
                                  bool_or(state IN ('ON_DECISION', 'AFTER_DECISION')) AS o, bool_or(state = 'UNKNOWN') AS u
                           FROM spine s LEFT JOIN er ON er.case_id = s.case_id GROUP BY s.case_id)
    SELECT CASE WHEN n = 0 THEN 'NO_SOURCE' WHEN o THEN 'ANY_END_DATE_ON_OR_AFTER_DECISION'
                WHEN b AND u THEN 'NO_END_DATE_ON_OR_AFTER_BUT_MIXED_BEFORE_AND_UNKNOWN' WHEN b THEN 'ALL_ROWS_END_BEFORE_DECISION'
                WHEN u THEN 'ALL_END_DATES_UNKNOWN' ELSE 'NO_USABLE_DECISION_DATE' END AS state, count(*) AS entity_count FROM e GROUP BY 1""",
)
def _(t):
    return T.end_entity_states(t.spine, T.end_rows(t.spine, t.detail, "case_id", "close_day", "amount", "decision_date"), "case_id")


@query(
    "d40_end_amounts",
    f"""WITH {_END} SELECT state, count(*) AS row_count, count(amount) AS finite_count, count(*) FILTER (WHERE amount = 0) AS zero_count,
        min(amount) AS min, max(amount) AS max, round(avg(amount), 6) AS mean, {quantiles_sql('amount', SEVEN)}
        FROM er WHERE state IS NOT NULL GROUP BY state""",
)
def _(t):
    return T.end_amounts(T.end_rows(t.spine, t.detail, "case_id", "close_day", "amount", "decision_date"))
