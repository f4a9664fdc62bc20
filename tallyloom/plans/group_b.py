"""Row-level classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import groups as G, states as S
from ..operators import audit as A, joins as J
from ..operators.longform import count_where
from ..operators.scoring import unpivot_models
from .registry import query


@query("b01_numeric_states", "SELECT row_id, amount_text, st AS state, val AS value FROM child_num")
def _(t):
    df = S.classify(t.child, ["amount_text"])
    return df.select("row_id", "amount_text", F.col("amount_text__state").alias("state"), F.col("amount_text__value").alias("value"))


@query(
    "b02_clean_numeric",
    """SELECT st AS state, count(*) AS row_count, count(val) AS kept, sum(val) AS kept_sum FROM child_num GROUP BY st""",
)
def _(t):
    df = S.classify(t.child.select("amount_text"), ["amount_text"])
    v = F.col("amount_text__value")
    return df.groupBy(F.col("amount_text__state").alias("state")).agg(
        F.count(F.lit(1)).alias("row_count"), F.count(v).alias("kept"), F.sum(v).alias("kept_sum")
    )


@query("b03_date_states", "SELECT row_id, date_text, dst AS state, CAST(dday AS VARCHAR) AS day_text FROM child_num")
def _(t):
    df = t.child
    return df.select(
        "row_id", "date_text", S.date_state(df, "date_text").alias("state"),
        S.as_day(df, "date_text").cast("string").alias("day_text"),
    )


@query(
    "b04_text_states",
    """SELECT CASE WHEN code IS NULL THEN 'native_missing' WHEN trim(code) = '' THEN 'empty_or_whitespace'
              ELSE 'populated' END AS state, count(*) AS row_count, count(DISTINCT code) AS codes
       FROM child GROUP BY 1""",
)
def _(t):
    return t.child.groupBy(S.text_state(F.col("code")).alias("state")).agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct("code").alias("codes")
    )


@query(
    "b05_day_offsets",
    """SELECT case_id, datediff('day', decision_date, dday) AS offset_days, count(*) AS row_count,
              CASE WHEN dday < decision_date THEN 'before' WHEN dday = decision_date THEN 'on' ELSE 'after' END AS side
       FROM matched WHERE dday IS NOT NULL AND decision_date IS NOT NULL GROUP BY ALL""",
)
def _(t):
    return J.day_offsets(t.child, t.spine, "case_id", "date_text", "decision_date").where("offset_days IS NOT NULL").select(
        "case_id", "offset_days", "row_count", J.side("offset_days").alias("side")
    )


@query(
    "b06_label_classes",
    """SELECT count(*) FILTER (WHERE target = 0) AS target_0_count, count(*) FILTER (WHERE target = 1) AS target_1_count,
              count(*) FILTER (WHERE target IS NULL) AS target_missing_count,
              count(*) FILTER (WHERE target NOT IN (0, 1)) AS target_other_count,
              count(*) FILTER (WHERE target IN (0, 1)) AS valid_binary_label_count FROM spine""",
)
def _(t):
    return t.spine.agg(*A.label_counts(F.col("target")))


@query(
    "b07_count_field",
    """SELECT count(pay_count) AS finite_count, count(*) FILTER (WHERE pay_count >= 0) AS nonnegative_count,
              count(*) FILTER (WHERE abs(pay_count - round_even(pay_count, 0)) <= 1e-12) AS integer_like_count,
              count(*) FILTER (WHERE pay_count > 0 AND abs(pay_count - round_even(pay_count, 0)) <= 1e-12)
                  AS positive_integer_like_count FROM child""",
)
def _(t):
    v = F.col("pay_count")
    return t.child.agg(
        F.count(v).alias("finite_count"), count_where(v >= 0).alias("nonnegative_count"),
        count_where(S.integer_like(v)).alias("integer_like_count"),
        count_where((v > 0) & S.integer_like(v)).alias("positive_integer_like_count"),
    )


@query(
    "b08_index_validity",
    """SELECT shard, count(*) AS row_count, count(*) FILTER (WHERE num_group1 IS NULL) AS null_index_rows,
              count(*) FILTER (WHERE num_group1 < 0 OR num_group1 > 4294967295) AS invalid_index_rows,
              count(*) FILTER (WHERE num_group1 BETWEEN 0 AND 4294967295) AS valid_index_rows
       FROM child GROUP BY shard""",
)
def _(t):
    idx = F.col("num_group1")
    return t.child.groupBy("shard").agg(
        F.count(F.lit(1)).alias("row_count"), count_where(idx.isNull()).alias("null_index_rows"),
        count_where(idx.isNotNull() & ~S.valid_index(idx)).alias("invalid_index_rows"),
        count_where(S.valid_index(idx)).alias("valid_index_rows"),
    )


@query(
    "b09_numeric_character",
    """WITH u AS (SELECT 'pay_count' AS field, CAST(pay_count AS VARCHAR) AS x FROM child
                  UNION ALL SELECT 'amount_text', amount_text FROM child
                  UNION ALL SELECT 'amount', CAST(amount AS VARCHAR) FROM child
                  UNION ALL SELECT 'code', code FROM child),
            v AS (SELECT field, try_cast(x AS DOUBLE) AS d FROM u WHERE x IS NOT NULL)
       SELECT field, count(*) AS non_null, bool_and(coalesce(isfinite(d), false)) AS numerically_sortable,
              bool_and(coalesce(isfinite(d) AND d = floor(d), false)) AS integer_valued FROM v GROUP BY field""",
)
def _(t):
    return A.numeric_character(t.child, ["pay_count", "amount_text", "amount", "code"])


@query(
    "b09_ordered_values",
    """WITH d AS (SELECT DISTINCT pay_count AS v FROM child WHERE pay_count IS NOT NULL),
            c AS (SELECT DISTINCT code AS v FROM child WHERE code IS NOT NULL)
       SELECT 'pay_count' AS field, row_number() OVER (ORDER BY v) AS position, CAST(v AS VARCHAR) AS value FROM d
       UNION ALL SELECT 'code', row_number() OVER (ORDER BY v), v FROM c""",
)
def _(t):
    return A.ordered_values(t.child, "pay_count").unionByName(A.ordered_values(t.child, "code"))


@query(
    "b10_exclusive_rename",
    "SELECT 'case_id' AS field, count(c_custkey) AS populated FROM customer UNION ALL SELECT 'balance', count(c_acctbal) FROM customer",
)
def _(t):
    df = A.exclusive_rename(A.exclusive_rename(t.customer, "c_custkey", "case_id"), "c_acctbal", "balance")
    return df.agg(F.count("case_id").alias("case_id"), F.count("balance").alias("balance")).unpivot(
        [], ["case_id", "balance"], "field", "populated"
    )


@query("b11_account_groups", "SELECT case_id, account_group FROM groups")
def _(t):
    return t.scores.select("case_id", G.account_group(F.col("account_count")).alias("account_group"))


@query("b12_history_groups", "SELECT case_id, history_group FROM groups")
def _(t):
    return t.scores.select("case_id", G.history_group(F.col("history_years")).alias("history_group"))


@query("b13_richness", "SELECT case_id, richness_group FROM groups")
def _(t):
    return t.scores.select(
        "case_id", G.richness(F.col("has_debit"), F.col("has_deposit"), F.col("has_tax")).alias("richness_group")
    )


# Names of the eight module patterns (debit, deposit, tax).
PATTERN_LABELS = {
    "000": "none", "001": "tax_only", "010": "deposit_only", "011": "deposit_and_tax",
    "100": "debit_only", "101": "debit_and_tax", "110": "debit_and_deposit", "111": "all_three",
}


@query(
    "b14_pattern_codes",
    "SELECT case_id, concat(has_debit, has_deposit, has_tax) AS pattern, CASE concat(has_debit, has_deposit, has_tax) "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PATTERN_LABELS.items())
    + " END AS pattern_label FROM scores",
)
def _(t):
    code = G.pattern_code(F.col("has_debit"), F.col("has_deposit"), F.col("has_tax"))
    names = F.create_map(*[F.lit(x) for kv in PATTERN_LABELS.items() for x in kv])
    return t.scores.select("case_id", code.alias("pattern"), names[code].alias("pattern_label"))


@query(
    "b15_ratio_review",
    """SELECT 'income_over_deposit' AS candidate,
              count(*) FILTER (WHERE t_income IS NOT NULL AND ad_deposit_mean > 0) AS eligible_count,
              count(*) - count(*) FILTER (WHERE t_income IS NOT NULL AND ad_deposit_mean > 0) AS undefined_count,
              count(*) FILTER (WHERE ad_deposit_mean IS NULL) AS denominator_missing_count,
              count(*) FILTER (WHERE ad_deposit_mean = 0) AS denominator_zero_count,
              count(*) FILTER (WHERE ad_deposit_mean < 0) AS denominator_negative_count FROM features
       UNION ALL
       SELECT 'dpd_over_debit', count(*) FILTER (WHERE t_dpd IS NOT NULL AND ad_debit_mean > 0),
              count(*) - count(*) FILTER (WHERE t_dpd IS NOT NULL AND ad_debit_mean > 0),
              count(*) FILTER (WHERE ad_debit_mean IS NULL), count(*) FILTER (WHERE ad_debit_mean = 0),
              count(*) FILTER (WHERE ad_debit_mean < 0) FROM features""",
)
def _(t):
    return A.ratio_review(
        t.features, {"income_over_deposit": ("t_income", "ad_deposit_mean"), "dpd_over_debit": ("t_dpd", "ad_debit_mean")}
    )


@query(
    "b16_probability_validity",
    """SELECT model_id, count(*) AS row_count, count(*) - count(pd) AS missing, count(*) FILTER (WHERE NOT isfinite(pd)) AS nonfinite,
              count(*) FILTER (WHERE pd < 0) AS below_zero, count(*) FILTER (WHERE pd > 1) AS above_one,
              count(*) FILTER (WHERE pd = 0) AS exact_zero, count(*) FILTER (WHERE pd = 1) AS exact_one,
              min(pd) AS minimum, max(pd) AS maximum, round(avg(pd), 9) AS mean, 'PASS' AS status
       FROM scores_long GROUP BY model_id""",
)
def _(t):
    return A.probability_validity(unpivot_models(t.scores, G.MODELS), ["model_id"], "pd")


@query(
    "b17_value_equality",
    """SELECT count(*) FILTER (WHERE ad_debit_mean IS NOT DISTINCT FROM ad_debit_copy) AS null_safe_equal,
              count(*) FILTER (WHERE ad_debit_mean IS NOT DISTINCT FROM ad_debit_max) AS null_safe_equal_max,
              count(*) FILTER (WHERE abs(ad_debit_mean - ad_debit_max) <= 1e-12 + 1e-2 * abs(ad_debit_max)) AS close_max,
              count(*) FILTER (WHERE abs(ad_debit_mean - ad_debit_copy) <= 1e-12 + 1e-9 * abs(ad_debit_copy)) AS close_copy
       FROM features""",
)
def _(t):
    m, x, c = F.col("ad_debit_mean"), F.col("ad_debit_max"), F.col("ad_debit_copy")
    return t.features.agg(
        count_where(m.eqNullSafe(c)).alias("null_safe_equal"), count_where(m.eqNullSafe(x)).alias("null_safe_equal_max"),
        count_where(S.close(m, x, rtol=1e-2)).alias("close_max"), count_where(S.close(m, c)).alias("close_copy"),
    )


@query(
    "b18_model_catalogue",
    """SELECT model_id, CASE WHEN model_id LIKE '%\\_ad' ESCAPE '\\' THEN 'T_plus_AD' ELSE 'T' END AS information_set,
              split_part(model_id, '_', 1) AS algorithm_family, count(*) AS scored_rows, round(avg(pd), 9) AS mean_pd
       FROM scores_long GROUP BY model_id""",
)
def _(t):
    m = F.col("model_id")
    return (
        unpivot_models(t.scores, G.MODELS)
        .groupBy(m, G.information_set(m).alias("information_set"), G.algorithm_family(m).alias("algorithm_family"))
        .agg(F.count(F.lit(1)).alias("scored_rows"), F.round(F.avg("pd"), 9).alias("mean_pd"))
    )
