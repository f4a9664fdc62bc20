"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H, joins as J
from .registry import query


@query(
    "c01_align_to_spine",
    """SELECT s.case_id, stated_count, stated_sum, CAST(CASE WHEN m.case_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS source_rows
       FROM spine s LEFT JOIN summary m ON m.case_id = s.case_id""",
)
def _(t):
    return J.align(t.spine.select("case_id"), t.summary.select("case_id", "stated_count", "stated_sum"), "case_id")


@query(
    "c02_key_partition",
    """SELECT CASE WHEN c.case_id IS NULL THEN 'null_key' WHEN s.case_id IS NULL THEN 'orphan' ELSE 'matched' END AS key_class,
              count(*) AS row_count, count(DISTINCT c.case_id) AS distinct_keys
       FROM child c LEFT JOIN spine s ON s.case_id = c.case_id GROUP BY 1""",
)
def _(t):
    return J.key_partition(t.child.select("case_id"), t.spine, "case_id")


@query(
    "c03_label_join_audit",
    """WITH f AS (SELECT doc_id, count(*) AS n FROM documents GROUP BY 1), l AS (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1)
       SELECT (SELECT count(*) FROM documents) AS feature_rows, (SELECT count(*) FROM labels) AS label_rows,
              (SELECT count(*) FROM documents WHERE doc_id IS NULL) AS feature_null_keys,
              (SELECT count(*) FROM labels WHERE doc_id IS NULL) AS label_null_keys,
              (SELECT CAST(sum(n - 1) AS BIGINT) FROM f WHERE doc_id IS NOT NULL) AS feature_duplicate_excess,
              (SELECT CAST(sum(n - 1) AS BIGINT) FROM l WHERE doc_id IS NOT NULL) AS label_duplicate_excess,
              (SELECT count(*) FROM f JOIN l USING (doc_id)) AS matched_keys,
              (SELECT count(*) FROM f ANTI JOIN l USING (doc_id)) AS feature_keys_without_label,
              (SELECT count(*) FROM l ANTI JOIN f USING (doc_id)) AS label_keys_without_feature,
              (SELECT count(*) FROM labels WHERE toxic = 1) AS positives,
              (SELECT count(*) FROM labels WHERE toxic IS NULL) AS null_labels,
              (SELECT count(*) FROM labels WHERE toxic NOT IN (0, 1)) AS nonbinary_labels""",
)
def _(t):
    return J.label_join_audit(t.documents.select("doc_id"), t.labels, "doc_id", "toxic")


@query(
    "c04_grouped_dates",
    """WITH l AS (SELECT case_id, event_day, count(*) AS n FROM child WHERE case_id IS NOT NULL AND event_day IS NOT NULL GROUP BY ALL),
            r AS (SELECT case_id, event_day, count(*) AS n FROM detail WHERE case_id IS NOT NULL AND event_day IS NOT NULL GROUP BY ALL)
       SELECT count(l.n) AS left_group_count, count(r.n) AS right_group_count, count(l.n + r.n) AS matched_group_count,
              count(*) FILTER (WHERE r.n IS NULL) AS left_only_group_count,
              count(*) FILTER (WHERE l.n IS NULL) AS right_only_group_count,
              count(*) FILTER (WHERE l.n = r.n) AS matched_equal_multiplicity_count,
              count(*) FILTER (WHERE l.n <> r.n) AS matched_different_multiplicity_count,
              count(*) FILTER (WHERE l.n IS NOT NULL AND r.n IS NOT NULL AND (l.n > 1 OR r.n > 1)) AS matched_ambiguous_multirow_group_count
       FROM l FULL JOIN r ON l.case_id = r.case_id AND l.event_day = r.event_day""",
)
def _(t):
    return J.grouped_date_comparison(t.child, t.detail, "case_id", "event_day")


@query(
    "c05_shard_overlap",
    """WITH src AS (SELECT doc_id AS k, 'documents' AS shard, doc_id % 5 AS v FROM documents
                    UNION ALL SELECT doc_id, 'labels', quality FROM labels
                    UNION ALL SELECT conv_id, 'conversations', turn FROM conversations
                    UNION ALL SELECT page_id, 'pages', page_id % 5 FROM pages),
            st AS (SELECT shard, count(*) AS row_n, count(DISTINCT k) AS key_n FROM src GROUP BY shard),
            per AS (SELECT k, shard, count(*) AS n, min(v) AS v FROM src WHERE k IS NOT NULL GROUP BY ALL),
            hit AS (SELECT a.shard AS l, b.shard AS r, count(*) AS o, bool_or(a.n > 1 OR b.n > 1) AS rep,
                           count(*) FILTER (WHERE a.v IS DISTINCT FROM b.v) AS x
                    FROM per a JOIN per b ON a.k = b.k AND a.shard < b.shard GROUP BY ALL)
       SELECT a.shard AS left_file, b.shard AS right_file, a.row_n AS left_rows, b.row_n AS right_rows,
              a.key_n AS left_distinct_keys, b.key_n AS right_distinct_keys, coalesce(o, 0) AS overlapping_keys,
              CASE WHEN coalesce(rep, false) THEN NULL ELSE coalesce(x, 0) END AS conflicting_keys,
              CASE WHEN coalesce(o, 0) = 0 THEN 'PASS_NO_OVERLAP'
                   WHEN rep THEN 'NOT_CHECKED_DUPLICATE_KEYS_AVOIDS_CARTESIAN_JOIN' ELSE 'CHECKED' END AS check_status
       FROM st a JOIN st b ON a.shard < b.shard LEFT JOIN hit ON hit.l = a.shard AND hit.r = b.shard""",
)
def _(t):
    part = lambda df, k, name, v: df.select(F.col(k).alias("k"), F.lit(name).alias("shard"), v.cast("bigint").alias("v"))
    src = (
        part(t.documents, "doc_id", "documents", F.col("doc_id") % 5)
        .unionByName(part(t.labels, "doc_id", "labels", F.col("quality")))
        .unionByName(part(t.conversations, "conv_id", "conversations", F.col("turn")))
        .unionByName(part(t.pages, "page_id", "pages", F.col("page_id") % 5))
    )
    return J.shard_overlap(src, "k", "shard", ["v"])


@query(
    "c06_shard_composite_overlap",
    """WITH src AS (SELECT case_id, num_group1, shard, amount_text, event_day FROM child
                    WHERE case_id IS NOT NULL AND num_group1 BETWEEN 0 AND 4294967295),
            cs AS (SELECT DISTINCT case_id, shard FROM src),
            ca AS (SELECT a.shard AS l, b.shard AS r, count(*) AS n FROM cs a JOIN cs b ON a.case_id = b.case_id AND a.shard < b.shard GROUP BY ALL),
            ps AS (SELECT DISTINCT case_id, num_group1, shard FROM src),
            pa AS (SELECT a.case_id, a.num_group1, a.shard AS l, b.shard AS r FROM ps a JOIN ps b
                   ON a.case_id = b.case_id AND a.num_group1 = b.num_group1 AND a.shard < b.shard),
            pc AS (SELECT pa.*, count(DISTINCT (s.amount_text, s.event_day)) AS payloads FROM pa JOIN src s
                   ON s.case_id = pa.case_id AND s.num_group1 = pa.num_group1 AND s.shard IN (pa.l, pa.r) GROUP BY ALL),
            pg AS (SELECT l, r, count(*) AS n, count(*) FILTER (WHERE payloads > 1) AS x FROM pc GROUP BY ALL)
       SELECT ca.l AS left_file, ca.r AS right_file, ca.n AS case_overlap_count,
              coalesce(pg.n, 0) AS composite_key_overlap_count, coalesce(pg.x, 0) AS conflicting_composite_keys
       FROM ca LEFT JOIN pg ON pg.l = ca.l AND pg.r = ca.r""",
)
def _(t):
    return J.shard_composite_overlap(t.child, "case_id", "num_group1", "shard", ["amount_text", "event_day"])


_ASOF = """SELECT s.case_id, count({r}) AS source_rows, min({d}) AS earliest_day,
       min(CASE WHEN {d} <= s.decision_date THEN {d} END) AS earliest_valid_day,
       count(*) FILTER (WHERE {d} > s.decision_date) AS after_rows
FROM spine s LEFT JOIN {t} x ON x.case_id = s.case_id GROUP BY s.case_id"""


@query(
    "c07_asof_earliest",
    "WITH a AS (" + _ASOF.format(r="row_id", d="dday", t="child_num") + """)
    SELECT a.case_id, source_rows, CAST(earliest_day AS VARCHAR) AS earliest_day, CAST(earliest_valid_day AS VARCHAR) AS earliest_valid_day,
           after_rows, b.missing_rows, b.invalid_rows
    FROM a JOIN (SELECT s.case_id, count(*) FILTER (WHERE dst = 'native_missing') AS missing_rows,
                        count(*) FILTER (WHERE dst IN ('empty', 'parse_failure')) AS invalid_rows
                 FROM spine s LEFT JOIN child_num c ON c.case_id = s.case_id GROUP BY 1) b ON b.case_id = a.case_id""",
)
def _(t):
    a = H.earliest_dates(t.spine, t.child, "case_id", "date_text", "decision_date")
    return a.select(
        "case_id", "source_rows", F.col("earliest_day").cast("string").alias("earliest_day"),
        F.col("earliest_valid_day").cast("string").alias("earliest_valid_day"), "after_rows", "missing_rows", "invalid_rows",
    )


@query(
    "c08_combined_history",
    "WITH a AS (" + _ASOF.format(r="row_id", d="dday", t="child_num") + "), b AS ("
    + _ASOF.format(r="row_id", d="event_day", t="detail") + """),
    j AS (SELECT s.case_id, s.decision_date, least(a.earliest_valid_day, b.earliest_valid_day) AS v,
                 least(a.earliest_day, b.earliest_day) AS u
          FROM spine s JOIN a ON a.case_id = s.case_id JOIN b ON b.case_id = s.case_id)
    SELECT case_id, CAST(v AS VARCHAR) AS earliest_valid_day, CAST(date_diff('day', v, decision_date) AS BIGINT) AS history_days,
           round(date_diff('day', v, decision_date) / 365.25::DOUBLE, 9) AS history_years,
           CAST(date_diff('day', u, decision_date) AS BIGINT) AS unrestricted_days,
           coalesce(date_diff('day', u, decision_date) < 0, false) AS negative_before_exclusion FROM j""",
)
def _(t):
    h = H.combined_history(t.spine, t.child, "date_text", t.detail, "event_day", "case_id", "decision_date")
    return h.select(
        "case_id", F.col("earliest_valid_day").cast("string").alias("earliest_valid_day"), "history_days",
        F.round("history_years", 9).alias("history_years"), "unrestricted_days", "negative_before_exclusion",
    )


@query(
    "c14_count_correspondence",
    """WITH a AS (SELECT case_id, count(*) AS n FROM child WHERE case_id IS NOT NULL GROUP BY 1),
            b AS (SELECT case_id, count(*) AS n, count(amount) AS f FROM detail WHERE case_id IS NOT NULL GROUP BY 1),
            e AS (SELECT coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y, coalesce(b.f, 0) AS z FROM spine s
                  LEFT JOIN a ON a.case_id = s.case_id LEFT JOIN b ON b.case_id = s.case_id),
            v AS (SELECT 'every_b_entity_also_in_a' AS check_id, count(*) FILTER (WHERE y > 0 AND x = 0) AS violations FROM e
                  UNION ALL SELECT 'a_count_equals_b_count', count(*) FILTER (WHERE x <> y) FROM e
                  UNION ALL SELECT 'a_count_equals_b_plus_finite', count(*) FILTER (WHERE x <> y + z) FROM e
                  UNION ALL SELECT 'b_missing_equals_a_count', count(*) FILTER (WHERE y - z <> x) FROM e)
       SELECT check_id, violations, CASE WHEN violations = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM v""",
)
def _(t):
    return J.count_correspondence(t.spine, "case_id", t.child, t.detail, F.col("amount").isNotNull())


_SVD = """
d AS (SELECT case_id, count(*) AS n, count(amount) AS f, sum(amount) AS s FROM detail WHERE case_id IS NOT NULL GROUP BY 1),
j AS (SELECT sp.case_id, m.stated_count AS sc, m.stated_sum AS ss, coalesce(d.n, 0) AS n, coalesce(d.f, 0) AS f, d.s AS ds
      FROM spine sp LEFT JOIN summary m ON m.case_id = sp.case_id LEFT JOIN d ON d.case_id = sp.case_id)"""


@query(
    "c15_summary_vs_detail",
    f"""WITH {_SVD.strip()},
    x AS (SELECT *, sc IS NOT NULL AND abs(sc - round_even(sc, 0)) <= 1e-12 AS whole FROM j)
    SELECT count(*) FILTER (WHERE whole) AS joint_integer_count, count(*) FILTER (WHERE whole AND sc = n) AS exact_record_count,
           count(*) FILTER (WHERE whole AND sc <> n) AS record_mismatch_count,
           count(*) FILTER (WHERE whole AND sc = f) AS exact_finite_count,
           count(*) FILTER (WHERE whole AND sc <> f) AS finite_mismatch_count,
           count(*) FILTER (WHERE sc IS NOT NULL AND NOT whole) AS noninteger_count,
           count(*) FILTER (WHERE whole AND sc <> n AND n > f) AS mismatches_with_missing_detail,
           count(ss + ds) AS joint_sum_count, count(*) FILTER (WHERE ss = ds) AS exact_sum_count,
           count(*) FILTER (WHERE abs(ss - ds) <= 1e-12 + 1e-9 * abs(ds)) AS close_sum_count,
           count(*) FILTER (WHERE ss IS NOT NULL AND ds = 0) AS zero_reference_count,
           count(*) FILTER (WHERE (coalesce(sc, 0) <> 0) = (n > 0)) AS presence_correspondence_count FROM x""",
)
def _(t):
    j = J.summary_vs_detail(t.spine, t.summary, t.detail, "case_id", "stated_count", "stated_sum", "amount")
    return H.correspondence_counts(j, "stated_count", "stated_sum")


def _diffs(name, expr):
    q = ", ".join(f"round(quantile_cont(v, {p}), 6) AS {k}" for k, p in
                  (("p01", 0.01), ("p05", 0.05), ("median", 0.5), ("p95", 0.95), ("p99", 0.99)))
    return f"""SELECT '{name}' AS measure, count(v) AS n, round(min(v), 6) AS min, {q}, round(max(v), 6) AS max, round(avg(v), 6) AS mean
               FROM (SELECT {expr} AS v FROM j)"""


@query(
    "c15_difference_distribution",
    f"WITH {_SVD.strip()} " + " UNION ALL ".join([
        _diffs("signed_difference", "ss - ds"), _diffs("absolute_difference", "abs(ss - ds)"),
        _diffs("absolute_relative_difference", "abs((ss - ds) / nullif(ds, 0))")]),
)
def _(t):
    j = J.summary_vs_detail(t.spine, t.summary, t.detail, "case_id", "stated_count", "stated_sum", "amount")
    return H.difference_distribution(j, "stated_sum", "detail_sum")


@query(
    "c15_amount_states",
    f"""WITH {_SVD.strip()}
    SELECT CASE WHEN n = 0 THEN 'NO_DETAIL_SOURCE' WHEN f = 0 THEN 'DETAIL_ALL_AMOUNTS_MISSING_OR_INVALID'
                WHEN ds = 0 THEN 'DETAIL_FINITE_ZERO_SUM' ELSE 'DETAIL_FINITE_NONZERO_SUM' END AS state, count(*) AS entity_count
    FROM j GROUP BY 1""",
)
def _(t):
    j = J.summary_vs_detail(t.spine, t.summary, t.detail, "case_id", "stated_count", "stated_sum", "amount")
    return j.groupBy(H.amount_state(F.col("detail_rows"), F.col("detail_finite"), F.col("detail_sum")).alias("state")).agg(
        F.count(F.lit(1)).alias("entity_count"))
