"""Audits of the feature table, history, subgroup design, splits and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import groups as G
from ..operators import audit as A, checks as K, coverage as V, design as D, detail as T, features as X, history as H, ranking as R, split as P
from .registry import query
from .sqlviews import long_sql, quantiles_sql

NUMERIC = ["t_age", "t_income", "t_dpd", "ad_debit_mean", "ad_debit_max", "ad_debit_copy", "ad_deposit_mean", "ad_tax_count"]
CATEGORIES = ["t_priority", "t_kind"]
FAMILIES = {"debit": ["ad_debit_mean", "ad_debit_max"], "deposit": ["ad_deposit_mean"], "tax": ["ad_tax_count"]}


@query("d41_feature_audit", " UNION ALL ".join(
    f"""SELECT '{c}' AS feature_name, count(*) AS row_count, count(*) - count({c}) AS missing_count,
        round((count(*) - count({c})) / count(*), 9) AS missing_rate, count({c}) AS finite_count,
        count(*) FILTER (WHERE {c} = 0) AS zero_count, count(*) FILTER (WHERE {c} > 0) AS positive_count,
        count(*) FILTER (WHERE {c} < 0) AS negative_count, min({c}) AS min,
        {quantiles_sql(c, {"p01": 0.01, "median": 0.5, "p99": 0.99})}, max({c}) AS max, 'MEASURED' AS status FROM features""" for c in NUMERIC))
def _(t):
    return X.numeric_feature_audit(t.features, NUMERIC)


@query("d41_category_audit", " UNION ALL ".join(
    f"""SELECT '{c}' AS feature_name, (SELECT count(*) FROM features) AS row_count, (SELECT count({c}) FROM features) AS populated_count,
        (SELECT count(DISTINCT {c}) FROM features) AS distinct_count,
        (SELECT concat('[', string_agg(concat('{{"value":"', v, '","count":', n, '}}'), ',' ORDER BY n DESC, v), ']')
         FROM (SELECT {c} AS v, count(*) AS n FROM features WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 20) x) AS top_values"""
    for c in CATEGORIES))
def _(t):
    return X.category_feature_audit(t.features, CATEGORIES)


def _family_sql():
    out = []
    fams = {**FAMILIES, "union": [c for cols in FAMILIES.values() for c in cols]}
    for f, cols in fams.items():
        c = " OR ".join(f"{x} IS NOT NULL" for x in cols)
        z = " OR ".join(f"coalesce({x} <> 0, false)" for x in cols)
        out.append(f"""SELECT '{f}' AS family, count(*) AS population, count(*) FILTER (WHERE {c}) AS content_count,
            round(count(*) FILTER (WHERE {c}) / count(*), 9) AS content_rate, count(*) FILTER (WHERE {z}) AS nonzero_count,
            round(count(*) FILTER (WHERE {z}) / count(*) FILTER (WHERE {c}), 9) AS nonzero_given_content FROM features""")
    return " UNION ALL ".join(out)


@query("d42_family_coverage", _family_sql())
def _(t):
    return V.family_coverage(t.features, FAMILIES)


@query("d43_duplicate_columns", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS left_column, '{b}' AS right_column, count(*) AS row_count FROM features HAVING bool_and({a} IS NOT DISTINCT FROM {b})"
    for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1:]) + ") x")
def _(t):
    return X.duplicate_columns(t.features, "case_id", NUMERIC)


@query(
    "d44_recompute_check",
    """WITH a AS (SELECT s.case_id, avg(d.amount) AS m, max(d.amount) AS x FROM spine s LEFT JOIN detail d ON d.case_id = s.case_id GROUP BY 1)
       SELECT 'amount' AS field, count(*) AS entities, count(m) AS with_value, 0::BIGINT AS max_mismatches, 0::BIGINT AS mean_mismatches FROM a""",
)
def _(t):
    agg = A.aggregate_history(t.spine, t.detail, "case_id", ["amount"])
    return X.recompute_check(agg, t.detail, "case_id", ["amount"])


_REASONS = {
    "debit_negative": "ad_debit_mean < 0", "income_zero": "t_income = 0", "deposit_missing": "ad_deposit_mean IS NULL",
    "all_three_present": "ad_debit_mean IS NOT NULL AND ad_deposit_mean IS NOT NULL AND ad_tax_count IS NOT NULL",
    "rare_category": "t_kind LIKE 'R%'",
}


@query("d45_example_picks", " UNION ALL ".join(
    f"SELECT '{k}' AS reason, min_by(case_id, base_order) AS case_id, min(base_order) AS base_order, count(*) AS candidates FROM features WHERE {e} HAVING count(*) > 0"
    for k, e in _REASONS.items()))
def _(t):
    return X.pick_examples(t.features, "case_id", "base_order", {k: F.expr(e) for k, e in _REASONS.items()})


def _account_sql(c):
    return f"""SELECT '{c}' AS candidate, count(*) AS total, count({c}) AS non_missing_count, count(*) - count({c}) AS missing_count,
        round(100 * count({c}) / count(*), 6) AS non_missing_percentage, count(*) FILTER (WHERE {c} = 0) AS zero_count,
        round(100 * count(*) FILTER (WHERE {c} = 0) / count(*), 6) AS zero_percentage,
        round(100 * count(*) FILTER (WHERE {c} = 0) / count({c}), 6) AS zero_percentage_non_missing,
        count(*) FILTER (WHERE {c} > 0) AS positive_count, round(100 * count(*) FILTER (WHERE {c} > 0) / count(*), 6) AS positive_percentage,
        count(*) FILTER (WHERE {c} < 0) AS negative_count, count(DISTINCT {c}) AS unique_values, min({c}) AS minimum, max({c}) AS maximum,
        {quantiles_sql(c, H.LEVELS)} FROM features"""


@query("d46_account_audit", _account_sql("ad_tax_count") + " UNION ALL " + _account_sql("t_dpd"))
def _(t):
    return H.account_audit(t.features, ["ad_tax_count", "t_dpd"])


@query(
    "d47_top_values",
    """WITH f AS (SELECT t_dpd AS value, count(*) AS row_count FROM features WHERE t_dpd IS NOT NULL GROUP BY 1)
       SELECT 't_dpd' AS candidate, value, row_count, round(100 * row_count / (SELECT count(*) FROM features), 6) AS percentage_all,
              round(100 * row_count / (SELECT count(t_dpd) FROM features), 6) AS percentage_non_missing,
              row_number() OVER (ORDER BY row_count DESC, value) AS rank FROM f QUALIFY rank <= 10""",
)
def _(t):
    return R.top_values(t.features, "t_dpd", 10)


_AB = """ab AS (SELECT s.case_id, s.decision_date, a.*  EXCLUDE (case_id), b.* EXCLUDE (case_id)
    FROM spine s JOIN (SELECT s.case_id, count(row_id) AS ar, min(dday) AS ae, min(CASE WHEN dday <= s.decision_date THEN dday END) AS av,
              count(*) FILTER (WHERE dday > s.decision_date) AS aa, count(*) FILTER (WHERE dst IN ('empty', 'parse_failure')) AS ai,
              count(*) FILTER (WHERE dst = 'native_missing') AS am
       FROM spine s LEFT JOIN child_num c ON c.case_id = s.case_id GROUP BY 1) a ON a.case_id = s.case_id
    JOIN (SELECT s.case_id, count(row_id) AS br, min(event_day) AS be, min(CASE WHEN event_day <= s.decision_date THEN event_day END) AS bv,
              count(*) FILTER (WHERE event_day > s.decision_date) AS ba, count(*) FILTER (WHERE row_id IS NOT NULL AND event_day IS NULL) AS bm
       FROM spine s LEFT JOIN detail d ON d.case_id = s.case_id GROUP BY 1) b ON b.case_id = s.case_id),
    h AS (SELECT *, date_diff('day', least(av, bv), decision_date) AS days, date_diff('day', least(ae, be), decision_date) AS ud FROM ab)"""


def _history_sql():
    c = lambda e: f"count(*) FILTER (WHERE {e})"
    cols = {
        "total": "count(*)", "active_date_available": "count(ae)", "closed_date_available": "count(be)",
        "both_sources_available": c("ae IS NOT NULL AND be IS NOT NULL"), "at_least_one_source_available": c("ae IS NOT NULL OR be IS NOT NULL"),
        "neither_source_available": c("ae IS NULL AND be IS NULL"), "valid_history": "count(days)",
        "entities_with_date_after_decision": c("aa + ba > 0"), "entities_with_invalid_date": c("ai > 0"),
        "zero_day_history": c("days = 0"), "negative_history_before_exclusion": c("ud < 0"),
        "rows_after_decision": "sum(aa + ba)", "rows_invalid": "sum(ai)", "rows_native_missing": "sum(am + bm)",
        "active_rows": "sum(ar)", "closed_rows": "sum(br)", "active_entities": c("ar > 0"), "closed_entities": c("br > 0"),
        "active_repeated": c("ar > 1"), "closed_repeated": c("br > 1"), "q_minimum": "min(days)", "q_maximum": "max(days)",
        **{f"q_{k}": f"quantile_cont(days::DOUBLE, {p})" for k, p in H.LEVELS.items()},
    }
    flags = list(cols)[1:11]
    m = [(k, k, "population", "total") for k in flags]
    m += [(f"source_rows_{k}", f"rows_{k}", "matched_source_rows", "active_rows + closed_rows") for k in ("after_decision", "invalid", "native_missing")]
    for s in ("active", "closed"):
        m += [(f"{s}_matched_source_rows", f"{s}_rows", f"{s}_matched_source_rows", f"{s}_rows"),
              (f"{s}_source_entities", f"{s}_entities", "population", "total"),
              (f"{s}_repeated_entities", f"{s}_repeated", f"{s}_source_entities", f"{s}_entities"),
              (f"{s}_repeated_excess_rows", f"{s}_rows - {s}_entities", f"{s}_matched_source_rows", f"{s}_rows")]
    for k in ("minimum", *H.LEVELS, "maximum"):
        m += [(f"history_days_{k}", f"q_{k}", "valid_history", "valid_history", "UNDEFINED_NO_VALID_HISTORY"),
              (f"history_years_{k}", f"q_{k} / 365.25::DOUBLE", "valid_history", "valid_history", "UNDEFINED_NO_VALID_HISTORY")]
    return f"WITH {_AB}, w AS (SELECT {', '.join(f'{e} AS {k}' for k, e in cols.items())} FROM h) " + long_sql("w", m)


def _history(t):
    return H.combined_history(t.spine, t.child, "date_text", t.detail, "event_day", "case_id", "decision_date")


@query("d48_history_audit", _history_sql())
def _(t):
    return H.history_audit(_history(t))


_JOINT = {
    "both_valid": "n IS NOT NULL AND days IS NOT NULL", "count_valid_history_missing": "n IS NOT NULL AND days IS NULL",
    "count_missing_history_valid": "n IS NULL AND days IS NOT NULL", "both_missing": "n IS NULL AND days IS NULL",
    "count_zero_history_valid": "n = 0 AND days IS NOT NULL", "count_zero_history_missing": "n = 0 AND days IS NULL",
    "count_positive_history_valid": "n > 0 AND days IS NOT NULL", "count_positive_history_missing": "n > 0 AND days IS NULL",
}


@query("d49_joint_coverage", f"WITH {_AB}, j AS (SELECT h.days, p.n FROM h JOIN (SELECT s.case_id, CASE WHEN min(pay_count) = max(pay_count) THEN min(pay_count) END AS n "
       "FROM spine s LEFT JOIN child c ON c.case_id = s.case_id GROUP BY 1) p ON p.case_id = h.case_id) " + " UNION ALL ".join(
    f"SELECT '{k}' AS coverage_category, count(*) FILTER (WHERE {e}) AS entity_count, round(100 * count(*) FILTER (WHERE {e}) / count(*), 6) AS percentage FROM j"
    for k, e in _JOINT.items()))
def _(t):
    counts = T.consistent_value(t.spine, t.child, "case_id", "pay_count").select("case_id", F.col("value").alias("n"))
    return H.joint_coverage(_history(t).join(counts, "case_id"), "n", "history_days")


@query(
    "d50_integrity_rows",
    " UNION ALL ".join(
        f"""SELECT '{s}' AS source, metric, CAST(value AS BIGINT) AS value FROM (
            SELECT sum(n) AS source_row_count, count(*) AS unique_key_count, count(*) FILTER (WHERE n > 1) AS duplicated_key_count,
                   sum(n - 1) AS duplicate_row_count FROM (SELECT case_id, count(*) AS n FROM {s} WHERE case_id IS NOT NULL GROUP BY 1) k) w
            UNPIVOT (value FOR metric IN (source_row_count, unique_key_count, duplicated_key_count, duplicate_row_count))"""
        for s in ("spine", "child", "detail", "summary")),
)
def _(t):
    return H.integrity_rows({s: getattr(t, s) for s in ("spine", "child", "detail", "summary")}, "case_id")


def _dist_sql(label, value, order):
    pos = " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(order, 1))
    return f"""WITH g AS (SELECT g.{label} AS l, {value} AS v FROM groups g JOIN scores s ON s.case_id = g.case_id),
        x AS (SELECT l, count(*) AS n, min(v) AS lo, max(v) AS hi FROM g WHERE l IS NOT NULL GROUP BY l
              UNION ALL SELECT 'TOTAL', count(*), min(v), max(v) FROM g WHERE l IS NOT NULL)
        SELECT CAST(CASE l {pos} ELSE 99 END AS BIGINT) AS group_order, l AS group_label, n AS group_count,
               round(100 * n / (SELECT count(l) FROM g), 6) AS percentage_eligible, round(100 * n / (SELECT count(*) FROM g), 6) AS percentage_all,
               lo AS observed_minimum, hi AS observed_maximum FROM x"""


@query("d51_account_distribution", _dist_sql("account_group", "account_count", G.ACCOUNT_LABELS))
def _(t):
    return D.group_distribution(t.scores, G.account_group(F.col("account_count")), F.col("account_count"), G.ACCOUNT_LABELS)


@query("d51_history_distribution", _dist_sql("history_group", "coalesce(history_years, 0)", G.HISTORY_LABELS))
def _(t):
    v = F.coalesce("history_years", F.lit(0.0))
    return D.group_distribution(t.scores, G.history_group(F.col("history_years")), v, G.HISTORY_LABELS)


@query("d52_indicator_inventory", " UNION ALL ".join(
    f"""SELECT '{f}' AS feature_name, count(*) FILTER (WHERE {f} = 0) AS value_0_count, round(100 * count(*) FILTER (WHERE {f} = 0) / count(*), 6) AS value_0_percentage,
        count(*) FILTER (WHERE {f} = 1) AS value_1_count, round(100 * count(*) FILTER (WHERE {f} = 1) / count(*), 6) AS value_1_percentage,
        count(*) FILTER (WHERE {f} IS NULL OR {f} NOT IN (0, 1)) AS invalid_count FROM features""" for f in ("has_debit", "has_deposit", "has_tax")))
def _(t):
    return D.indicator_inventory(t.features, ["has_debit", "has_deposit", "has_tax"])


@query(
    "d53_richness_distribution",
    """WITH c AS (SELECT 'module_count' AS candidate_id, CAST(has_debit + has_deposit + has_tax AS VARCHAR) AS v FROM features
                  UNION ALL SELECT 'module_pattern', concat(has_debit, has_deposit, has_tax) FROM features),
            g AS (SELECT candidate_id, v, count(*) AS n FROM c GROUP BY 1, 2)
       SELECT candidate_id, v AS level_or_value, n AS group_count, round(100 * n / sum(n) OVER (PARTITION BY candidate_id), 6) AS percentage,
              min(n) OVER (PARTITION BY candidate_id) AS smallest_group_count FROM g""",
)
def _(t):
    return D.richness_distribution(t.features, ["has_debit", "has_deposit", "has_tax"])


def _field_sql(c):
    return f"""SELECT '{c}' AS field_name, count(*) AS total, count({c}) AS non_missing_count, round(100 * count({c}) / count(*), 6) AS non_missing_percentage,
        count(*) FILTER (WHERE {c} = 0) AS zero_count, count(*) FILTER (WHERE {c} > 0) AS positive_count, count(*) FILTER (WHERE {c} < 0) AS negative_count,
        count(DISTINCT {c}) AS unique_values, min({c}) AS minimum, max({c}) AS maximum, {quantiles_sql(c, H.LEVELS)}
        FROM split_rows WHERE outer_split = 'train'"""


@query("d54_field_audit_on_train", " UNION ALL ".join(_field_sql(c) for c in ("t_income", "ad_debit_mean", "ad_tax_count")))
def _(t):
    members = split_of(t).where("outer_split = 'train'").select("case_id")
    return D.field_audit(t.features.join(members, "case_id", "left_semi"), ["t_income", "ad_debit_mean", "ad_tax_count"])


def split_of(t):
    return P.make_splits(t.features.select("case_id", "target"), "case_id", "target", "split")


_COV = {
    "debit_finite": "ad_debit_mean IS NOT NULL OR ad_debit_max IS NOT NULL",
    "deposit_finite": "ad_deposit_mean IS NOT NULL", "tax_finite": "ad_tax_count IS NOT NULL",
}


@query(
    "d55_split_summary",
    """WITH u AS (SELECT outer_split AS split, * FROM split_rows UNION ALL SELECT validation_role, * FROM split_rows WHERE validation_role IS NOT NULL)
       SELECT split, count(*) AS row_count, CAST(sum(target) AS BIGINT) AS positive_count, round(avg(target), 9) AS positive_rate,
              CAST(min(decision_date) AS VARCHAR) AS date_min, CAST(max(decision_date) AS VARCHAR) AS date_max, """
    + ", ".join(f"count(*) FILTER (WHERE {e}) AS {k}_count" for k, e in _COV.items()) + " FROM u GROUP BY split",
)
def _(t):
    rows = t.features.join(split_of(t).drop("target"), "case_id")
    y = F.col("target")
    return rows.select("*", P.split_names().alias("split")).groupBy("split").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum(y).alias("positive_count"), F.round(F.avg(y), 9).alias("positive_rate"),
        F.min("decision_date").cast("string").alias("date_min"), F.max("decision_date").cast("string").alias("date_max"),
        *[F.count(F.when(F.expr(e), 1)).alias(f"{k}_count") for k, e in _COV.items()])


@query(
    "d55_split_by_month",
    """SELECT outer_split, strftime(decision_date, '%Y-%m') AS calendar_month, count(*) AS row_count, CAST(sum(target) AS BIGINT) AS positive_count
       FROM split_rows GROUP BY 1, 2""",
)
def _(t):
    rows = t.features.select("case_id", "target", "decision_date").join(split_of(t).drop("target"), "case_id")
    return rows.groupBy("outer_split", F.date_format("decision_date", "yyyy-MM").alias("calendar_month")).agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("target").alias("positive_count"))


@query(
    "d56_fingerprint",
    """SELECT outer_split, count(*) AS row_count,
              bit_xor(CAST('0x' || substr(sha256(concat_ws('|', case_id, outer_split)), 1, 15) AS BIGINT)) AS fingerprint
       FROM split GROUP BY outer_split""",
)
def _(t):
    return P.fingerprint(split_of(t), ["outer_split"], ["case_id", "outer_split"])


@query(
    "d57_check_roll_up",
    "WITH w AS (SELECT shard, min(num_group1) AS lo, count(*) FILTER (WHERE case_id IS NULL) AS nulls, count(*) AS n, "
    "CASE WHEN shard = 'shard_1' THEN NULL ELSE min(amount) END AS amt FROM child GROUP BY shard), "
    "c AS (SELECT shard, 'no_null_keys' AS id, nulls = 0 AS ok FROM w UNION ALL SELECT shard, 'index_not_negative', lo >= 0 FROM w "
    "UNION ALL SELECT shard, 'has_rows', n > 0 FROM w UNION ALL SELECT shard, 'amounts_positive', amt > 0 FROM w) "
    "SELECT shard, count(*) FILTER (WHERE NOT ok) AS fail_count, count(*) FILTER (WHERE ok) AS pass_count, count(*) - count(ok) AS not_checked_count, "
    "CASE WHEN bool_or(NOT ok) THEN 'FAIL' WHEN bool_or(ok) THEN 'PASS' ELSE 'NOT_CHECKABLE' END AS overall_status "
    "FROM c WHERE id <> 'index_not_negative' GROUP BY shard",
)
def _(t):
    w = t.child.groupBy("shard").agg(
        F.min("num_group1").alias("lo"), F.count(F.when(F.col("case_id").isNull(), 1)).alias("nulls"),
        F.count(F.lit(1)).alias("n"), F.min("amount").alias("amt"))
    amt = F.when(F.col("shard") != "shard_1", F.col("amt"))
    zero = F.lit(0)
    checks = w.select("shard", F.inline(F.array(
        K.check_row("no_null_keys", F.col("nulls") == 0, F.col("nulls"), zero),
        K.check_row("index_not_negative", F.col("lo") >= 0, F.col("lo"), zero),
        K.check_row("has_rows", F.col("n") > 0, F.col("n"), F.lit(1)),
        K.check_row("amounts_positive", amt > 0, amt, zero))))
    return K.roll_up(checks, ["shard"], informational=["index_not_negative"])


@query(
    "d58_distribution_summary",
    """WITH v AS (SELECT l_returnflag AS grp, l_extendedprice * l_discount - 2000 AS x FROM lineitem)
       SELECT grp, count(*) AS n_cases, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS standard_deviation, round(min(x), 6) AS minimum,
              round(max(x), 6) AS maximum, round(avg(CASE WHEN x < 0 THEN 1e0 ELSE 0e0 END), 9) AS share_below_zero,
              round(avg(CASE WHEN x = 0 THEN 1e0 ELSE 0e0 END), 9) AS share_exactly_zero,
              round(avg(CASE WHEN x > 0 THEN 1e0 ELSE 0e0 END), 9) AS share_above_zero, """
    + quantiles_sql("x", {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}) + " FROM v GROUP BY grp",
)
def _(t):
    df = t.lineitem.select(F.col("l_returnflag").alias("grp"), (F.col("l_extendedprice") * F.col("l_discount") - 2000).alias("x"))
    s = X.distribution_summary(df, ["grp"], "x")
    keep = [c for c in s.columns if c.startswith("share") or c in ("grp", "n_cases")]
    return s.select(*keep, *[F.round(c, 6).alias(c) for c in s.columns if c not in keep])
