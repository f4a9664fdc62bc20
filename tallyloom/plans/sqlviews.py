"""Views used only by the SQL statements the queries are checked against."""

from ..operators.resample import draws_sql

MODELS = ["logit_t", "logit_ad", "trees_t", "trees_ad", "mlp_t", "mlp_ad"]

SQL_VIEWS: dict[str, str] = {}

SQL_VIEWS["child_num"] = """
SELECT c.*,
       CASE WHEN amount_text IS NULL THEN 'missing' WHEN v IS NULL OR isnan(v) THEN 'unparseable'
            WHEN isinf(v) THEN 'nonfinite' WHEN v = 0 THEN 'zero' WHEN v > 0 THEN 'positive' ELSE 'negative' END AS st,
       CASE WHEN isfinite(v) THEN v END AS val,
       CASE WHEN date_text IS NULL THEN 'native_missing' WHEN trim(date_text) = '' THEN 'empty'
            WHEN try_cast(date_text AS DATE) IS NULL THEN 'parse_failure' ELSE 'parseable' END AS dst,
       try_cast(date_text AS DATE) AS dday
FROM (SELECT *, try_cast(trim(amount_text) AS DOUBLE) AS v FROM {child}) c
"""

# rows matched to an entity, and one row per entity with its counts
SQL_VIEWS["matched"] = """
SELECT c.*, s.decision_date FROM {child_num} c JOIN {spine} s ON s.case_id = c.case_id
"""
SQL_VIEWS["entity"] = """
SELECT s.case_id, count(c.row_id) AS src, count(*) FILTER (WHERE st = 'missing') AS n_missing,
       count(*) FILTER (WHERE st = 'unparseable') AS n_unparseable, count(*) FILTER (WHERE st = 'nonfinite') AS n_nonfinite,
       count(*) FILTER (WHERE st = 'zero') AS n_zero, count(*) FILTER (WHERE st = 'positive') AS n_positive,
       count(*) FILTER (WHERE st = 'negative') AS n_negative, count(val) AS n_finite,
       count(*) FILTER (WHERE val <> 0) AS n_nonzero, avg(val) AS v_mean, min(val) AS v_min, max(val) AS v_max
FROM {spine} s LEFT JOIN {child_num} c ON c.case_id = s.case_id GROUP BY s.case_id
"""

SQL_VIEWS["scores_long"] = " UNION ALL ".join(
    f"SELECT case_id, base_order, target, '{m}' AS model_id, {m} AS pd, account_count, history_years, "
    "has_debit, has_deposit, has_tax FROM {scores}"
    for m in MODELS
)

SQL_VIEWS["ranked"] = """
SELECT model_id, case_id, base_order, target, pd,
       row_number() OVER w AS rn, count(*) OVER (PARTITION BY model_id) AS n_rows,
       sum(pd) OVER w AS cum_pd, CAST(sum(target) OVER w AS BIGINT) AS cum_y
FROM {scores_long}
WINDOW w AS (PARTITION BY model_id ORDER BY pd, base_order ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""

SQL_VIEWS["groups"] = """
SELECT case_id, base_order, target, logit_t, logit_ad, trees_t, trees_ad, mlp_t, mlp_ad,
       CASE WHEN account_count IS NULL OR account_count < 0 OR account_count <> floor(account_count) THEN NULL
            WHEN account_count >= 3 THEN '3_plus' ELSE CAST(CAST(account_count AS BIGINT) AS VARCHAR) END AS account_group,
       CASE WHEN coalesce(history_years, 0) < 0 THEN NULL WHEN coalesce(history_years, 0) <= 0.5 THEN '0_to_0_5'
            WHEN history_years <= 1 THEN '0_5_to_1' WHEN history_years <= 2 THEN '1_to_2'
            WHEN history_years <= 3 THEN '2_to_3' WHEN history_years <= 4 THEN '3_to_4'
            WHEN history_years <= 5 THEN '4_to_5' ELSE 'gt_5' END AS history_group,
       CAST(has_debit + has_deposit + has_tax AS VARCHAR) AS richness_group
FROM {scores}
"""

SQL_VIEWS["strata"] = """
SELECT 'overall' AS dim, 'ALL' AS label, g.* FROM {groups} g
UNION ALL SELECT 'account_count', account_group, g.* FROM {groups} g WHERE account_group IS NOT NULL
UNION ALL SELECT 'bureau_history', history_group, g.* FROM {groups} g WHERE history_group IS NOT NULL
UNION ALL SELECT 'ad_richness', richness_group, g.* FROM {groups} g WHERE richness_group IS NOT NULL
"""


def long_sql(source: str, metrics: list[tuple], by: list[str] = ()) -> str:
    """UNION ALL of (metric_name, value, denominator) rows over a one-row-per-group query."""
    parts = []
    for m in metrics:
        name, expr, den_name, den = m[:4]
        undefined = m[4] if len(m) > 4 else "UNDEFINED_ZERO_DENOMINATOR"
        parts.append(
            f"SELECT {''.join(b + ', ' for b in by)}'{name}' AS metric_name, round(CAST({expr} AS DOUBLE), 6) AS value, "
            f"'{den_name}' AS denominator_name, CAST({den} AS BIGINT) AS denominator_value, "
            f"CASE WHEN ({expr}) IS NULL THEN '{undefined}' ELSE 'MEASURED' END AS status FROM {source}"
        )
    return "\nUNION ALL ".join(parts)


def rated(name: str, num: str, den_name: str, den: str, undefined: str = "UNDEFINED_ZERO_DENOMINATOR") -> list[tuple]:
    return [(f"{name}_count", num, den_name, den), (f"{name}_rate", f"{num} / nullif({den}, 0)", den_name, den, undefined)]


_RANK = """SELECT {key} AS case_id, {label} AS target, row_number() OVER (PARTITION BY {label} ORDER BY md5(concat('{seed}|', {key})), {key}) AS rn,
       count(*) OVER (PARTITION BY {label}) AS n FROM {src}"""

SQL_VIEWS["split"] = """
SELECT case_id, target,
       CASE WHEN rn <= e THEN 'evaluation' WHEN rn <= e + v THEN 'validation' ELSE 'train' END AS outer_split,
       CASE WHEN rn > e AND rn <= e + v THEN CASE WHEN rn <= e + c THEN 'validation_calibration' ELSE 'validation_tuning' END END
           AS validation_role
FROM (SELECT *, CAST(round_even(v * 0.5::DOUBLE, 0) AS BIGINT) AS c
      FROM (SELECT *, CAST(round_even((n - e) * (15e0 / 85e0), 0) AS BIGINT) AS v
            FROM (SELECT *, CAST(round_even(n * 0.15::DOUBLE, 0) AS BIGINT) AS e FROM (""" + _RANK.format(
    key="case_id", label="target", seed="split", src="{features}") + """) a) b) d) f
"""
SQL_VIEWS["split_rows"] = """
SELECT f.*, s.outer_split, s.validation_role FROM {features} f JOIN {split} s ON s.case_id = f.case_id
"""

# component name -> (module, source, content, nonzero, invalid, economic, auxiliary) as SQL over the source's rows
_COMPONENTS = {
    "debit_child": ("debit", "child", "val IS NOT NULL", "coalesce(val <> 0, false)", "st IN ('unparseable', 'nonfinite')",
                    "st <> 'missing'", "code IS NOT NULL AND trim(code) <> ''"),
    "debit_summary": ("debit", "summary", "stated_sum IS NOT NULL", "coalesce(stated_sum <> 0, false)", "false",
                      "stated_sum IS NOT NULL", "false"),
    "deposit_detail": ("deposit", "detail", "amount IS NOT NULL", "coalesce(amount <> 0, false)", "false",
                       "amount IS NOT NULL", "flag IS NOT NULL AND trim(flag) <> ''"),
    "tax_child": ("tax", "child", "pay_count IS NOT NULL", "coalesce(pay_count <> 0, false)", "false",
                  "pay_count IS NOT NULL", "date_text IS NOT NULL AND trim(date_text) <> ''"),
    "tax_summary": ("tax", "summary", "stated_count IS NOT NULL", "coalesce(stated_count <> 0, false)", "false",
                    "stated_count IS NOT NULL", "nation_code IS NOT NULL"),
}
MEASURES = ("content", "nonzero", "zero_only", "invalid", "auxiliary_evidence", "field_evidence")


def _flags_sql() -> str:
    subs, out = [], ["s.case_id", "s.decision_date"]
    for src, table in (("child", "{child_num}"), ("detail", "{detail}"), ("summary", "{summary}")):
        cols = []
        for name, (_, s, *exprs) in _COMPONENTS.items():
            if s == src:
                cols += [f"bool_or({e}) AS {name}_{k}" for e, k in zip(exprs, ("c", "z", "i", "e", "a"))]
        subs.append(f"LEFT JOIN (SELECT case_id, count(*) AS n, {', '.join(cols)} FROM {table} GROUP BY case_id) x_{src} "
                    f"ON x_{src}.case_id = s.case_id")
        out.append(f"coalesce(x_{src}.n, 0) AS source__{src}")
    for n in _COMPONENTS:
        c, z, i, e, a = (f"coalesce({n}_{k}, false)" for k in "cziea")
        out += [f"{c} AS {n}__content", f"({c} AND {z}) AS {n}__nonzero", f"({c} AND NOT {z}) AS {n}__zero_only",
                f"{i} AS {n}__invalid", f"{a} AS {n}__auxiliary_evidence", f"({e} OR {a}) AS {n}__field_evidence"]
    return f"SELECT {', '.join(out)} FROM {{spine}} s " + " ".join(subs)


def _module_sql() -> str:
    out = []
    for m in ("debit", "deposit", "tax"):
        u = {k: "(" + " OR ".join(f"{n}__{k}" for n, c in _COMPONENTS.items() if c[0] == m) + ")" for k in MEASURES}
        out += [f"{u['content']} AS module_{m}__content", f"({u['content']} AND {u['nonzero']}) AS module_{m}__nonzero",
                f"({u['content']} AND NOT {u['nonzero']}) AS module_{m}__zero_only",
                f"({u['auxiliary_evidence']} AND NOT {u['content']}) AS module_{m}__auxiliary_only",
                f"{u['field_evidence']} AS module_{m}__field_evidence", f"(NOT {u['content']}) AS module_{m}__no_content",
                f"{u['invalid']} AS module_{m}__invalid"]
    return "SELECT *, " + ", ".join(out) + " FROM {component_flags}"


SQL_VIEWS["component_flags"] = _flags_sql()
SQL_VIEWS["flag_table"] = _module_sql()


def coverage_sql(masks: list[tuple[str, str, str, str]]) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{s}' AS scope_type, '{n}' AS scope_name, '{m}' AS measure, count(*) FILTER (WHERE {e}) AS population_count, "
        f"count(*) AS denominator_value, round(count(*) FILTER (WHERE {e}) / count(*), 9) AS rate FROM flag_table"
        for s, n, m, e in masks)


def coverage_mask_sql() -> list[tuple[str, str, str, str]]:
    masks = [("SOURCE_CONTAINER", s, "matched_source_footprint", f"source__{s} > 0") for s in ("child", "detail", "summary")]
    for n in _COMPONENTS:
        masks += [("MODULE_COMPONENT", n, k, f"{n}__{k}") for k in MEASURES]
        masks.append(("MODULE_COMPONENT", n, "auxiliary_only", f"{n}__auxiliary_evidence AND NOT {n}__content"))
    for m in ("debit", "deposit", "tax"):
        masks += [("MODULE", m, k, f"module_{m}__{k}") for k in
                  ("content", "nonzero", "zero_only", "auxiliary_only", "field_evidence", "no_content", "invalid")]
    k = " + ".join(f"CAST(module_{m}__content AS INT)" for m in ("debit", "deposit", "tax"))
    return masks + [("CROSS_MODULE", "all", n, f"({k}) {op}") for n, op in (
        ("at_least_one_module", ">= 1"), ("exactly_one_module", "= 1"), ("exactly_two_modules", "= 2"), ("all_modules", "= 3"))]


def unique_sql() -> list[tuple[str, str, str, str]]:
    out = []
    for n, c in _COMPONENTS.items():
        others = [f"{o}__content" for o, x in _COMPONENTS.items() if o != n and x[0] == c[0]]
        out.append(("MODULE_COMPONENT", n, "unique_content", f"{n}__content" + (f" AND NOT ({' OR '.join(others)})" if others else "")))
    return out


def quantiles_sql(value: str, probs: dict[str, float], digits: int = 6) -> str:
    return ", ".join(f"round(quantile_cont({value}, {p}), {digits}) AS {k}" for k, p in probs.items())

# fitted preparation, stated over the training rows of the split
NUM = ["t_age", "t_income", "t_dpd", "ad_debit_mean", "ad_debit_max", "ad_deposit_mean", "ad_tax_count"]
MONEY = ["t_income", "ad_debit_mean", "ad_debit_max", "ad_deposit_mean"]
LOGS = MONEY + ["t_dpd"]
CLIP = ["ad_debit_mean", "ad_debit_max", "ad_deposit_mean"]


def _clip(c: str) -> str:
    return f"CASE WHEN {c} < 0 THEN 0e0 ELSE {c} END" if c in CLIP else c


SQL_VIEWS["prep_cap"] = ("SELECT " + ", ".join(f"quantile_cont({_clip(c)}, 0.999) AS cap_{c}" for c in MONEY)
                         + " FROM {split_rows} WHERE outer_split = 'train'")
SQL_VIEWS["prep_capped"] = ("SELECT r.*, " + ", ".join(
    (f"CASE WHEN {_clip(c)} > cap_{c} THEN cap_{c} ELSE {_clip(c)} END" if c in MONEY else c) + f" AS {c}__cap" for c in NUM)
    + " FROM {split_rows} r CROSS JOIN {prep_cap} p")
SQL_VIEWS["prep_logged"] = "SELECT *, " + ", ".join(
    (f"ln(1 + {c}__cap)" if c in LOGS else f"{c}__cap") + f" AS {c}__log" for c in NUM) + " FROM {prep_capped}"
SQL_VIEWS["prep_median"] = ("SELECT " + ", ".join(f"quantile_cont({c}__log, 0.5) AS med_{c}" for c in NUM)
                            + " FROM {prep_logged} WHERE outer_split = 'train'")
SQL_VIEWS["prep_filled"] = ("SELECT r.*, " + ", ".join(f"coalesce({c}__log, med_{c}) AS {c}__fill" for c in NUM)
                            + " FROM {prep_logged} r CROSS JOIN {prep_median} p")
SQL_VIEWS["prep_moment"] = ("SELECT " + ", ".join(f"avg({c}__fill) AS mean_{c}, stddev_pop({c}__fill) AS sd_{c}" for c in NUM)
                            + " FROM {prep_filled} WHERE outer_split = 'train'")
SQL_VIEWS["prep_scaled"] = ("SELECT r.*, " + ", ".join(f"({c}__fill - mean_{c}) / sd_{c} AS {c}__z" for c in NUM)
                            + " FROM {prep_filled} r CROSS JOIN {prep_moment} p")


def _level(c: str) -> str:
    return (f"CASE WHEN {c} IS NULL THEN '__MISSING__' WHEN {c} IN (SELECT {c} FROM {{split_rows}} WHERE outer_split = 'train') "
            f"THEN {c} ELSE '__UNSEEN__' END AS {c}__level")


SQL_VIEWS["prep_levels"] = ("SELECT case_id, outer_split, validation_role, t_priority, t_kind, " + _level("t_priority") + ", "
                            + _level("t_kind") + " FROM {split_rows}")

# counts and metrics per distinct score; by = comma separated group columns
def metric_sql(source: str, by: str, score: str = "pd", digits: int = 9) -> str:
    r = lambda e, k: f"round({e}, {digits}) AS {k}"
    lim = "least(greatest(s, 2.220446049250313e-16), 1 - 2.220446049250313e-16)"
    return f"""
SELECT {by}, CAST(sum(n) AS BIGINT) AS sample_count, CAST(sum(pos) AS BIGINT) AS positive_count, CAST(sum(n - pos) AS BIGINT) AS negative_count,
       {r('sum(pos) / sum(n)', 'observed_rate')}, {r('sum(s * n) / sum(n)', 'mean_pd')},
       {r('sum(pos * (below + (n - pos) / 2.0::DOUBLE)) / nullif(sum(pos)::DOUBLE * sum(n - pos), 0)', 'roc_auc')},
       {r('CASE WHEN sum(n - pos) > 0 THEN sum(pos * tp / fn::DOUBLE) / nullif(sum(pos), 0) END', 'average_precision')},
       {r(f'sum(-(pos * ln({lim}) + (n - pos) * ln(1 - {lim}))) / sum(n)', 'log_loss')},
       {r('sum(pos * (1 - s) * (1 - s) + (n - pos) * s * s) / sum(n)', 'brier_score')}, {r('min(s)', 'min_pd')}, {r('max(s)', 'max_pd')},
       CASE WHEN sum(pos) > 0 AND sum(n - pos) > 0 THEN 'PASS' ELSE 'PARTIAL_SINGLE_CLASS' END AS metric_status
FROM (SELECT *, coalesce(sum(n - pos) OVER (PARTITION BY {by} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS below,
             sum(pos) OVER (PARTITION BY {by} ORDER BY s DESC)::DOUBLE AS tp, sum(n) OVER (PARTITION BY {by} ORDER BY s DESC)::DOUBLE AS fn
      FROM (SELECT {by}, {score} AS s, count(*)::DOUBLE AS n, sum(target)::DOUBLE AS pos FROM {source} GROUP BY ALL) c) d
GROUP BY {by}"""


SQL_VIEWS["strata_long"] = " UNION ALL ".join(
    f"SELECT dim, label, case_id, target, '{m}' AS model_id, {m} AS pd FROM {{strata}}" for m in MODELS)
SQL_VIEWS["metric_overall"] = metric_sql("{scores_long}", "model_id")
SQL_VIEWS["metric_strata"] = metric_sql("{strata_long}", "dim, label, model_id")


def gain_sql(source: str, by: str = "") -> str:
    on = " AND ".join(f"c.{b.strip()} = r.{b.strip()}" for b in by.split(",") if b.strip()) or "true"
    sel = "".join(f"r.{b.strip()}, " for b in by.split(",") if b.strip())
    return f"""SELECT {sel}split_part(r.model_id, '_', 1) AS algorithm_family, r.sample_count, round(c.roc_auc - r.roc_auc, 9) AS roc_auc_gain,
        round(c.average_precision - r.average_precision, 9) AS average_precision_gain, round(r.log_loss - c.log_loss, 9) AS log_loss_gain,
        round(r.brier_score - c.brier_score, 9) AS brier_gain, round(c.mean_pd - r.mean_pd, 9) AS mean_pd_change,
        CASE WHEN r.metric_status = 'PASS' AND c.metric_status = 'PASS' THEN 'PASS' ELSE 'PARTIAL' END AS gain_status
        FROM {source} r JOIN {source} c ON {on} AND r.model_id LIKE '%\\_t' ESCAPE '\\' AND c.model_id = replace(r.model_id, '_t', '_ad')
            AND split_part(c.model_id, '_', 1) = split_part(r.model_id, '_', 1)"""


SQL_VIEWS["pair_rank"] = """
SELECT split_part(t.model_id, '_', 1) AS algorithm_family, t.case_id, t.target, t.n_rows AS n, t.pd AS pd_t, a.pd AS pd_ad, t.rn AS rn_t, a.rn AS rn_ad
FROM {ranked} t JOIN {ranked} a ON a.case_id = t.case_id AND t.model_id LIKE '%\\_t' ESCAPE '\\' AND a.model_id LIKE '%\\_ad' ESCAPE '\\'
     AND split_part(t.model_id, '_', 1) = split_part(a.model_id, '_', 1)
"""
SQL_VIEWS["pair_strata"] = """
SELECT p.*, s.dim, s.label FROM {pair_rank} p JOIN (SELECT dim, label, case_id FROM {strata}) s ON s.case_id = p.case_id
"""
SQL_VIEWS["approval_points"] = """
SELECT r.model_id, g.bp / 100e0 AS approval_rate_percent, g.bp IN (4000, 5000, 6000, 7000, 8000) AS is_display_point, r.rn AS approved_count,
       r.n_rows - r.rn AS rejected_count, round(100 * r.rn / r.n_rows, 9) AS actual_approval_rate_percent, r.pd AS cutoff,
       (SELECT min(pd) FROM {ranked} x WHERE x.model_id = r.model_id) AS approved_minimum, round(cum_pd / rn, 9) AS approved_mean_pd,
       round(cum_pd, 6) AS expected_defaults, cum_y AS realised_defaults, rn - cum_y AS realised_non_defaults, round(cum_y / rn, 9) AS realised_default_rate
FROM {ranked} r JOIN (SELECT CAST(unnest(generate_series(4000, 8000, 25)) AS BIGINT) AS bp) g ON r.rn = (r.n_rows * g.bp) // 10000
"""
SQL_VIEWS["budget_points"] = """
SELECT b.*, r.pd, r.cum_pd, r.cum_y FROM (
    SELECT m.model_id, g.u, m.n, (SELECT max(rn) FROM {ranked} x WHERE x.model_id = m.model_id AND x.cum_pd / x.rn <= g.u / 1e4) AS k
    FROM (SELECT model_id, max(n_rows) AS n FROM {ranked} GROUP BY 1) m CROSS JOIN (SELECT CAST(unnest(generate_series(75, 200)) AS BIGINT) AS u) g) b
LEFT JOIN {ranked} r ON r.model_id = b.model_id AND r.rn = b.k
"""

LOSSES = {2: "detailed_only", 5: "detailed_only", 10: "detailed_only", 20: "lower_loss_sensitivity", 30: "primary", 50: "higher_loss_sensitivity"}
SQL_VIEWS["scenario_rows"] = " UNION ALL ".join(f"""
SELECT model_id, {k}::BIGINT AS loss_ratio, 1e0 / {1 + k}e0 AS pd_threshold, '{role}' AS display_role, count(*) FILTER (WHERE ok) AS approved_count,
       count(*) - count(*) FILTER (WHERE ok) AS rejected_count, round(100 * count(*) FILTER (WHERE ok) / count(*), 9) AS approval_rate_percent,
       count(*) FILTER (WHERE ok AND target = 0) AS approved_non_defaults, count(*) FILTER (WHERE ok AND target = 1) AS approved_defaults,
       round(count(*) FILTER (WHERE ok AND target = 1) / nullif(count(*) FILTER (WHERE ok), 0), 9) AS approved_default_rate,
       round(avg(pd) FILTER (WHERE ok), 9) AS approved_mean_pd, round(coalesce(sum(1 - pd - pd * {k}) FILTER (WHERE ok), 0), 5) AS expected_value,
       round(coalesce(sum(1 - pd - pd * {k}) FILTER (WHERE ok), 0) / count(*), 9) AS expected_value_per_case,
       round(avg(1 - pd - pd * {k}) FILTER (WHERE ok), 9) AS expected_value_per_approved,
       CAST(count(*) FILTER (WHERE ok AND target = 0) - {k} * count(*) FILTER (WHERE ok AND target = 1) AS DOUBLE) AS realised_value,
       round((count(*) FILTER (WHERE ok AND target = 0) - {k} * count(*) FILTER (WHERE ok AND target = 1)) / count(*), 9) AS realised_value_per_case,
       round((count(*) FILTER (WHERE ok AND target = 0) - {k} * count(*) FILTER (WHERE ok AND target = 1)) / nullif(count(*) FILTER (WHERE ok), 0), 9)
           AS realised_value_per_approved, count(*) AS n_cases
FROM (SELECT *, pd < 1e0 / {1 + k}e0 AS ok FROM {{scores_long}}) s GROUP BY model_id""" for k, role in LOSSES.items())

# ---------------------------------------------------------------- calibration

SQL_VIEWS["cal"] = """
SELECT s.* FROM {scores} s JOIN {split} p ON p.case_id = s.case_id WHERE p.validation_role = 'validation_calibration'
"""
SQL_VIEWS["cal_long"] = " UNION ALL ".join(f"SELECT case_id, target, '{m}' AS model_id, {m} AS pd FROM {{cal}}" for m in MODELS)
SQL_VIEWS["cal_fold"] = """
SELECT c.*, f.fold_id FROM {cal_long} c JOIN (
    SELECT case_id, (row_number() OVER (PARTITION BY target ORDER BY md5(concat('folds|', case_id)), case_id) - 1) % 5 AS fold_id FROM {cal}) f
ON f.case_id = c.case_id
"""
SQL_VIEWS["boot_draws"] = draws_sql("SELECT * FROM {cal}", "target", "case_id", 2000)
SQL_VIEWS["boot"] = """
SELECT d.r AS replicate_id, m.model_id, m.method, sum(c * -(m.target * ln(greatest(least(pd, 1 - 2.220446049250313e-16), 2.220446049250313e-16)) + (1 - m.target) * ln(1 - greatest(least(pd, 1 - 2.220446049250313e-16), 2.220446049250313e-16)))) / (SELECT count(*) FROM {cal}) AS log_loss,
       sum(c * (pd - m.target) * (pd - m.target)) / (SELECT count(*) FROM {cal}) AS brier_score
FROM {boot_draws} d
JOIN (SELECT case_id, target, row_number() OVER (PARTITION BY target ORDER BY case_id) - 1 AS position FROM {cal}) q ON q.target = d.label AND q.position = d.position
JOIN {methods} m ON m.case_id = q.case_id GROUP BY ALL
"""
SQL_VIEWS["boot_diff"] = """
SELECT b.*, b.log_loss - i.log_loss AS log_loss_vs_identity, b.brier_score - i.brier_score AS brier_vs_identity
FROM {boot} b JOIN {boot} i ON i.replicate_id = b.replicate_id AND i.model_id = b.model_id AND i.method = 'identity'
"""
SQL_VIEWS["metric_method"] = metric_sql("{methods}", "model_id, method", digits=15)
SQL_VIEWS["guard"] = """
SELECT m.model_id, m.method, m.log_loss AS oof_log_loss, m.brier_score - i.brier_score AS brier_change, s.se AS brier_se, m.roc_auc - i.roc_auc AS auc_change,
       m.average_precision - i.average_precision AS ap_change, m.min_pd >= 0 AND m.max_pd <= 1 AS probability_valid,
       m.method = 'identity' OR m.brier_score - i.brier_score <= s.se AS passes_brier,
       CASE m.method WHEN 'identity' THEN true
            WHEN 'logistic' THEN abs(m.roc_auc - i.roc_auc) <= 1e-10 AND abs(m.average_precision - i.average_precision) <= 1e-10 AND coalesce(f.slope > 0, false)
            ELSE round(m.roc_auc - i.roc_auc, 12) >= -0.0005::DOUBLE AND round(m.average_precision - i.average_precision, 12) >= -0.0005::DOUBLE END AS passes_ranking
FROM {metric_method} m JOIN {metric_method} i ON i.model_id = m.model_id AND i.method = 'identity'
LEFT JOIN (SELECT model_id, method, stddev_samp(brier_vs_identity) AS se FROM {boot_diff} GROUP BY 1, 2) s ON s.model_id = m.model_id AND s.method = m.method
LEFT JOIN {slopes} f ON f.model_id = m.model_id
"""
SQL_VIEWS["best"] = """
SELECT model_id, min_by(method, list_position(['identity', 'logistic', 'isotonic'], method)) AS reference_method
FROM (SELECT *, min(oof_log_loss) OVER (PARTITION BY model_id) AS low FROM {guard} WHERE probability_valid AND passes_brier AND passes_ranking) g
WHERE oof_log_loss <= low + 1e-12 GROUP BY model_id
"""
SQL_VIEWS["boot_ref"] = """
SELECT b.*, x.reference_method, r.log_loss AS reference_log_loss, b.log_loss - r.log_loss AS log_loss_difference
FROM {boot} b JOIN {best} x ON x.model_id = b.model_id JOIN {boot} r ON r.replicate_id = b.replicate_id AND r.model_id = b.model_id AND r.method = x.reference_method
"""
SQL_VIEWS["selection"] = """
SELECT model_id, method, reference_method, oof_log_loss, CASE WHEN hard THEN delta END AS delta_log_loss, CASE WHEN hard THEN se END AS paired_se,
       hard AS hard_admissible, eligible, eligible AND rn = 1 AS selected,
       CASE WHEN NOT probability_valid THEN 'INVALID_FIT_OR_PROBABILITY' WHEN NOT hard THEN 'INELIGIBLE_HARD_CONSTRAINT' WHEN eligible AND rn = 1
            THEN 'SELECTED_SIMPLEST_ELIGIBLE' WHEN eligible THEN 'ELIGIBLE_NOT_SIMPLEST' ELSE 'OUTSIDE_ONE_SE_BAND' END AS selection_reason
FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY eligible DESC, list_position(['identity', 'logistic', 'isotonic'], method)) AS rn
      FROM (SELECT *, coalesce(hard AND delta <= se + 1e-12, false) AS eligible
            FROM (SELECT g.*, x.reference_method, g.probability_valid AND g.passes_brier AND g.passes_ranking AS hard, g.oof_log_loss - r.oof_log_loss AS delta,
                         CASE WHEN g.method = x.reference_method THEN 0e0 ELSE e.se END AS se
                  FROM {guard} g JOIN {best} x ON x.model_id = g.model_id JOIN {guard} r ON r.model_id = g.model_id AND r.method = x.reference_method
                  LEFT JOIN (SELECT model_id, method, stddev_samp(log_loss_difference) AS se FROM {boot_ref} GROUP BY 1, 2) e
                    ON e.model_id = g.model_id AND e.method = g.method) a) b) c
"""


def newton_sql(counts: str, by: str, steps: int = 9, slope: bool = True) -> str:
    """Chain of CTEs p0 .. p<steps> with the Newton iterates of a logistic fit on the logit of pd."""
    keys = [k.strip() for k in by.split(",")]
    out = [f"z AS MATERIALIZED (SELECT {by}, n, pos, ln(pd) - ln(1 - pd) AS z FROM ({counts}) c)", f"p0 AS (SELECT {by}, ln(sum(pos) / sum(n - pos)){'' if slope else ' - sum(n * z) / sum(n)'} AS a, {'0e0' if slope else '1e0'} AS b FROM z GROUP BY {by})"]
    on = " AND ".join(f"z.{k} = q.{k}" for k in keys)
    sel = ", ".join(f"q.{k}" for k in keys)
    for i in range(steps):
        sums = (f"SELECT {sel}, q.a, q.b, sum(n * mu * (1 - mu)) AS s0, sum(n * mu * (1 - mu) * z) AS s1, sum(n * mu * (1 - mu) * z * z) AS s2, "
                f"sum(pos - n * mu) AS r0, sum((pos - n * mu) * z) AS r1 FROM (SELECT z.*, q.a, q.b, 1 / (1 + exp(-(q.a + q.b * z.z))) AS mu "
                f"FROM z JOIN p{i} q ON {on}) q GROUP BY {sel}, q.a, q.b")
        new = ("a + (s2 * r0 - s1 * r1) / (s0 * s2 - s1 * s1) AS a, b + (s0 * r1 - s1 * r0) / (s0 * s2 - s1 * s1) AS b" if slope
               else "a + r0 / s0 AS a, b")
        out.append(f"p{i + 1} AS (SELECT {by}, {new} FROM ({sums}) s)")
    return ", ".join(out)


def isotonic_sql(counts: str) -> str:
    """CTE iso(grp, x, y): monotone fit by the max-min formula over all score intervals."""
    return f"""ii AS MATERIALIZED (SELECT grp, x, n, pos, row_number() OVER w AS i, sum(n) OVER w AS cn, sum(pos) OVER w AS cp FROM ({counts}) c
            WINDOW w AS (PARTITION BY grp ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        iw AS (SELECT a.grp, a.i AS j, b.i AS k, min((b.cp - a.cp + a.pos) / (b.cn - a.cn + a.n)::DOUBLE) OVER
               (PARTITION BY a.grp, a.i ORDER BY b.i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS low
               FROM ii a JOIN ii b ON b.grp = a.grp AND b.i >= a.i),
        iso AS (SELECT ii.grp, ii.x, t.y FROM ii JOIN (SELECT grp, k, max(low) AS y FROM iw GROUP BY 1, 2) t ON t.grp = ii.grp AND t.k = ii.i)"""

# words of each text as fields of the file "<source>_<lang>" in the group "<source>"
SQL_VIEWS["field_rows"] = """
SELECT DISTINCT concat(source, '_', lang) AS file_name, source AS table_group, lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS field_name FROM documents
"""
SQL_VIEWS["dict_unique"] = """
SELECT variable AS field_name, min_by(coalesce(description, ''), item_id) AS description FROM {dictionary} WHERE trim(coalesce(variable, '')) <> '' GROUP BY variable
"""
SQL_VIEWS["mention_rows"] = """
SELECT d.doc_id, d.source, d.lang, d.text, t.name FROM documents d
JOIN (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS name FROM documents) t ON t.doc_id = d.doc_id
WHERE t.name IN (SELECT field_name FROM {dict_unique}) OR regexp_full_match(t.name, '[A-Za-z][A-Za-z0-9_]*_[0-9]+[A-Z]?')
   OR t.name IN ('case_id', 'target', 'date_decision', 'MONTH', 'WEEK_NUM', 'num_group1', 'num_group2')
"""
SQL_VIEWS["mention_excerpts"] = """
SELECT doc_id, source, name, substr(concat(CASE WHEN s > 0 THEN '…' ELSE '' END,
           trim(regexp_replace(substr(text, s + 1, e - s), '[ \\t\\n\\f\\r]+', ' ', 'g'), ' '), CASE WHEN e < n THEN '…' ELSE '' END), 1, 240) AS excerpt
FROM (SELECT *, greatest(p0 - 120, 0) AS s, least(p0 + length(name) + 120, n) AS e
      FROM (SELECT *, length(text) AS n, instr(text, m) - 1 + CASE WHEN m[1] = name[1] AND starts_with(m, name) THEN 0 ELSE 1 END AS p0
            FROM (SELECT *, regexp_extract(text, concat('(?:^|[^A-Za-z0-9_])', name, '(?:[^A-Za-z0-9_]|$)')) AS m FROM {mention_rows}) a) b) c
"""


_OTHER_FOLDS = """SELECT c.model_id, h.f AS held, c.pd, count(*)::DOUBLE AS n, sum(target)::DOUBLE AS pos FROM {cal_fold} c JOIN range(0, 5) h(f) ON h.f <> c.fold_id GROUP BY 1, 2, 3"""
SQL_VIEWS["methods"] = f"""
SELECT case_id, target, model_id, 'identity' AS method, fold_id, pd FROM {{cal_fold}}
UNION ALL SELECT * FROM (WITH {newton_sql(_OTHER_FOLDS, 'model_id, held')}
    SELECT c.case_id, c.target, c.model_id, 'logistic', c.fold_id, 1 / (1 + exp(-(a + b * (ln(pd) - ln(1 - pd))))) FROM {{cal_fold}} c JOIN p9 ON p9.model_id = c.model_id AND p9.held = c.fold_id) lo
UNION ALL SELECT * FROM (WITH {isotonic_sql("SELECT concat(model_id, '|', held) AS grp, pd AS x, n, pos FROM (" + _OTHER_FOLDS + ") o")},
    q AS (SELECT *, concat(model_id, '|', fold_id) AS grp FROM {{cal_fold}}),
    lo AS (SELECT q.*, i.x AS x0, i.y AS y0 FROM q ASOF LEFT JOIN iso i ON i.grp = q.grp AND q.pd >= i.x),
    hi AS (SELECT lo.*, i.x AS x1, i.y AS y1 FROM lo ASOF LEFT JOIN iso i ON i.grp = lo.grp AND lo.pd <= i.x)
    SELECT case_id, target, model_id, 'isotonic', fold_id, CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL OR x1 = x0 THEN y0 ELSE y0 + (y1 - y0) * (pd - x0) / (x1 - x0) END FROM hi) iso_rows
"""
SQL_VIEWS["slopes"] = f"""
SELECT * FROM (WITH {newton_sql("SELECT model_id, pd, count(*)::DOUBLE AS n, sum(target)::DOUBLE AS pos FROM {cal_fold} GROUP BY 1, 2", 'model_id')} SELECT model_id, b AS slope FROM p9) s
"""
# views are defined in the order of their use: the two above before what reads them
for _late in ("boot_draws", "boot", "boot_diff", "metric_method", "guard", "best", "boot_ref", "selection"):
    SQL_VIEWS[_late] = SQL_VIEWS.pop(_late)
