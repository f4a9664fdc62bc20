"""Windows, ranks, top-k, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import groups as G, probability as P, states as S
from ..operators import audit as A, checks as K, joins as J, metrics as M, policy as L, ranking as R
from ..operators.longform import ratio
from ..operators.scoring import unpivot_models
from ..session import stored
from .registry import kept, query


def ranked_scores(t):
    """Total order of all models' scores with running sums: one range shuffle a session, read by every query on ranks."""
    return kept(t, "ranks", lambda: stored(L.ranked(unpivot_models(t.scores, G.MODELS)), "ranks"))


@query("e01_stable_order", "SELECT model_id, case_id, rn FROM ranked")
def _(t):
    return ranked_scores(t).select("model_id", "case_id", "rn")


@query("e02_risk_percentile", "SELECT model_id, case_id, round((rn - 1) / (n_rows - 1), 9) AS risk_percentile FROM ranked")
def _(t):
    r = ranked_scores(t)
    return r.select("model_id", "case_id", F.round(R.risk_percentile(F.col("rn"), F.col("n_rows")), 9).alias("risk_percentile"))


@query("e03_equal_count_bins", "SELECT model_id, case_id, " + ", ".join(f"least({k}, (rn - 1) * {k} // n_rows + 1) AS bin_{k}" for k in (5, 10, 20)) + " FROM ranked")
def _(t):
    r = ranked_scores(t)
    return r.select("model_id", "case_id", *[R.equal_count_bin(F.col("rn"), F.col("n_rows"), k).alias(f"bin_{k}") for k in (5, 10, 20)])


@query("e04_running_sums", "SELECT model_id, rn, pd, round(cum_pd, 6) AS cum_pd, cum_y, round(cum_pd / rn, 9) AS running_mean FROM ranked")
def _(t):
    r = ranked_scores(t)
    return r.select("model_id", "rn", "pd", F.round("cum_pd", 6).alias("cum_pd"), "cum_y", F.round(F.col("cum_pd") / F.col("rn"), 9).alias("running_mean"))


@query(
    "e05_previous_group",
    """SELECT week_num, lag(week_num) OVER w AS prev_week, CAST(lo AS VARCHAR) AS lo, CAST(lag(lo) OVER w AS VARCHAR) AS prev_lo, lo < lag(lo) OVER w AS backward
       FROM (SELECT week_num, min(decision_date) AS lo FROM spine WHERE week_num IS NOT NULL GROUP BY 1 HAVING min(decision_date) IS NOT NULL) r
       WINDOW w AS (ORDER BY week_num)""",
)
def _(t):
    r = A.week_ranges(t.spine, "week_num", "decision_date")
    return r.select("week_num", "prev_week", F.col("lo").cast("string").alias("lo"), F.col("prev_lo").cast("string").alias("prev_lo"),
                    (F.col("lo") < F.col("prev_lo")).alias("backward"))


@query(
    "e06_group_maximum",
    """SELECT row_id, case_id, CAST(max(event_day) OVER (PARTITION BY case_id) AS VARCHAR) AS latest_day,
              coalesce(event_day = max(event_day) OVER (PARTITION BY case_id), false) AS is_latest FROM child WHERE case_id IS NOT NULL""",
)
def _(t):
    rows = t.child.where("case_id IS NOT NULL").select("row_id", "case_id", "event_day")
    top = rows.groupBy("case_id").agg(F.max("event_day").alias("latest_day"))
    return J.skew_join(rows, top, "case_id", "left").select(
        "row_id", "case_id", F.col("latest_day").cast("string").alias("latest_day"),
        F.coalesce(F.col("event_day") == F.col("latest_day"), F.lit(False)).alias("is_latest"))


@query(
    "e07_share_within_origin",
    """WITH g AS (SELECT l_returnflag AS origin, l_linestatus AS destination, count(*) AS n FROM lineitem GROUP BY ALL)
       SELECT origin, destination, n AS row_count, round(n / sum(n) OVER (PARTITION BY origin), 9) AS share_within_origin,
              round(n / sum(n) OVER (), 9) AS share_of_total FROM g""",
)
def _(t):
    g = t.lineitem.groupBy(F.col("l_returnflag").alias("origin"), F.col("l_linestatus").alias("destination")).agg(F.count(F.lit(1)).alias("row_count"))
    n = F.col("row_count")
    everything = Window.partitionBy(F.lit(0))  # one row per cell
    return g.select("origin", "destination", "row_count", F.round(ratio(n, F.sum(n).over(Window.partitionBy("origin"))), 9).alias("share_within_origin"),
                    F.round(ratio(n, F.sum(n).over(everything)), 9).alias("share_of_total"))


@query(
    "f01_global_prefix",
    """SELECT event_id, row_number() OVER w AS rn, count(*) OVER () AS n_rows, round(sum(value) OVER w, 4) AS cum_value, sum(user_id) OVER w::BIGINT AS cum_user
       FROM events WINDOW w AS (ORDER BY value, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""".replace(
        "sum(user_id) OVER w::BIGINT", "CAST(sum(user_id) OVER w AS BIGINT)"),
)
def _(t):
    r = R.running(t.events.select("event_id", "value", "user_id"), [], ["value", "event_id"], {"cum_value": F.col("value"), "cum_user": F.col("user_id")})
    return r.select("event_id", "rn", "n_rows", F.round("cum_value", 4).alias("cum_value"), "cum_user")


@query(
    "f02_top_risk_share",
    """WITH s AS (SELECT unnest([0.01, 0.05, 0.1])::DOUBLE AS target_share),
            k AS (SELECT r.model_id, s.target_share, r.pd AS cutoff FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY pd DESC) AS d FROM scores_long) r
                  JOIN s ON r.d = CAST(ceil(s.target_share * (SELECT count(*) FROM scores)) AS BIGINT))
       SELECT k.model_id, k.target_share, count(*) AS actual_rows, round(count(*) / (SELECT count(*) FROM scores), 9) AS actual_share, k.cutoff,
              round(avg(pd), 9) AS mean_probability, round(avg(target), 9) AS observed_rate, CAST(sum(target) AS BIGINT) AS positive_count
       FROM k JOIN scores_long l ON l.model_id = k.model_id AND l.pd >= k.cutoff GROUP BY k.model_id, k.target_share, k.cutoff""",
)
def _(t):
    table = M.score_table(unpivot_models(t.scores, G.MODELS), ["model_id"])
    return M.top_risk(table, ["model_id"], [0.01, 0.05, 0.10])


@query(
    "f03_frequency_top_n",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY row_count DESC, code) AS rank
       FROM (SELECT shard, code, count(*) AS row_count FROM child WHERE code IS NOT NULL GROUP BY 1, 2) g) x WHERE rank <= 3""",
)
def _(t):
    freq = t.child.where("code IS NOT NULL").groupBy("shard", "code").agg(F.count(F.lit(1)).alias("row_count"))
    return R.top_per_group(freq, ["shard"], "code", "row_count", 3)


@query(
    "f04_stable_sort",
    """WITH g AS (SELECT o_orderstatus, o_orderpriority, count(*) AS row_count FROM orders GROUP BY ALL)
       SELECT *, row_number() OVER (ORDER BY row_count DESC, o_orderstatus, o_orderpriority) AS position FROM g""",
)
def _(t):
    g = t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("row_count"))
    r = R.running(g.withColumn("neg", -F.col("row_count")), [], ["neg", "o_orderstatus", "o_orderpriority"])
    return r.select("o_orderstatus", "o_orderpriority", "row_count", F.col("rn").alias("position")).orderBy("position")


@query(
    "f05_even_sample",
    """WITH n AS (SELECT count(*) AS n FROM features),
            p AS (SELECT DISTINCT CAST(floor(i * ((n - 1) / 100e0)) AS BIGINT) AS pos FROM n, range(0, 101) t(i))
       SELECT case_id, rn - 1 AS position FROM (SELECT case_id, row_number() OVER (ORDER BY base_order) AS rn FROM features) f JOIN p ON p.pos = f.rn - 1""",
)
def _(t):
    return R.even_sample(t.features.select("case_id", "base_order"), "base_order", 101).select("case_id", "position")


@query(
    "g01_union_blocks",
    """SELECT 'customer' AS block, c_nationkey AS nation, count(*) AS row_count, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY ALL
       UNION ALL SELECT 'supplier', s_nationkey, count(*), round(sum(s_acctbal), 2) FROM supplier GROUP BY ALL""",
)
def _(t):
    part = lambda df, name, k, b: df.select(F.lit(name).alias("block"), F.col(k).alias("nation"), F.col(b).alias("balance"))
    u = A.union_all([part(t.customer, "customer", "c_nationkey", "c_acctbal"), part(t.supplier, "supplier", "s_nationkey", "s_acctbal")])
    return u.groupBy("block", "nation").agg(F.count(F.lit(1)).alias("row_count"), F.round(F.sum("balance"), 2).alias("balance"))


@query("g02_key_intersection", "SELECT count(*) AS overlapping_keys FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) x")
def _(t):
    return t.documents.select("doc_id").intersect(t.labels.select("doc_id")).agg(F.count(F.lit(1)).alias("overlapping_keys"))


@query(
    "g03_key_difference",
    """SELECT 'left' AS only_in, count(*) AS key_count FROM (SELECT case_id FROM spine EXCEPT SELECT case_id FROM child) a
       UNION ALL SELECT 'right', count(*) FROM (SELECT case_id FROM child WHERE case_id IS NOT NULL EXCEPT SELECT case_id FROM spine) b""",
)
def _(t):
    a, b = t.spine.select("case_id"), t.child.select("case_id").where("case_id IS NOT NULL").distinct()
    left = a.join(b, "case_id", "left_anti").agg(F.lit("left").alias("only_in"), F.count(F.lit(1)).alias("key_count"))
    return left.unionByName(b.join(a, "case_id", "left_anti").agg(F.lit("right").alias("only_in"), F.count(F.lit(1)).alias("key_count")))


@query("g04_distinct", "SELECT DISTINCT amount_text, code, side FROM child")
def _(t):
    return t.child.select("amount_text", "code", "side").distinct()


@query(
    "g05_split_and_recombine",
    "SELECT (SELECT count(*) FROM child) AS row_count, count(*) FILTER (WHERE amount >= 0 OR amount IS NULL) AS left_rows, "
    "count(*) FILTER (WHERE amount < 0) AS right_rows, 0::BIGINT AS unmatched_rows FROM child",
)
def _(t):
    df = t.child
    neg = F.coalesce(F.col("amount") < 0, F.lit(False))
    a, b = df.where(~neg), df.where(neg)
    gap = K.difference(df, a.unionByName(b)).agg(F.count(F.lit(1)).alias("unmatched_rows"))
    sizes = df.agg(F.count(F.lit(1)).alias("row_count"), F.count(F.when(~neg, 1)).alias("left_rows"), F.count(F.when(neg, 1)).alias("right_rows"))
    return sizes.withColumn("k", F.lit(1)).join(gap.withColumn("k", F.lit(1)), "k").drop("k")


# ---------------------------------------------------------------- scalar families


@query(
    "h01_logs_and_sigmoid",
    """SELECT case_id, round(ln(1 + t_income), 9) AS log1p_income, round(ln(c / (1 - c)), 9) AS logit_p, round(exp(-c), 9) AS exp_p,
              round(1 / (1 + exp(-(c - 0.5::DOUBLE))), 9) AS sigmoid_p
       FROM (SELECT f.case_id, f.t_income, s.logit_t AS c FROM features f JOIN scores s ON s.case_id = f.case_id) x""",
)
def _(t):
    j = t.features.select("case_id", "t_income").join(t.scores.select("case_id", "logit_t"), "case_id")
    p = F.col("logit_t")
    r = lambda c, n: F.round(c, 9).alias(n)
    return j.select("case_id", r(F.log1p("t_income"), "log1p_income"), r(P.logit(p), "logit_p"), r(F.exp(-p), "exp_p"), r(P.sigmoid(p - 0.5), "sigmoid_p"))


@query(
    "h02_rounding_family",
    """SELECT row_id, CASE WHEN amount < 0 THEN 0e0 WHEN amount > 2e5 THEN 2e5 ELSE amount END AS clipped, CAST(floor(pay_count / 2) AS BIGINT) AS floor_half,
              CAST(ceil(pay_count / 2) AS BIGINT) AS ceil_half, round_even(pay_count / 2, 0) AS rint_half, round_even(pay_count * 2.5::DOUBLE, 0) AS half_even FROM child""",
)
def _(t):
    a, v = F.col("amount"), F.col("pay_count")
    return t.child.select(
        "row_id", F.when(a < 0, 0.0).when(a > 2e5, 2e5).otherwise(a).alias("clipped"), F.floor(v / 2).alias("floor_half"), F.ceil(v / 2).alias("ceil_half"),
        F.rint(v / 2).alias("rint_half"), F.bround(v * 2.5, 0).alias("half_even"))


@query("h03_tolerance_equality", """SELECT case_id, coalesce(abs(ad_debit_mean - ad_debit_max) <= 1e-12 + 5e-3 * abs(ad_debit_max), false) AS is_close FROM features""")
def _(t):
    return t.features.select("case_id", F.coalesce(S.close(F.col("ad_debit_mean"), F.col("ad_debit_max"), rtol=5e-3), F.lit(False)).alias("is_close"))


@query(
    "h04_text_functions",
    """SELECT doc_id, length(regexp_replace(trim(text, ' '), '\\s+', ' ', 'g')) AS collapsed_length,
              CAST(len(regexp_extract_all(text, '[A-Za-z]+')) AS INTEGER) AS word_count,
              regexp_extract(text, '([A-Za-z]+)', 1) AS first_word, concat(lang, '|', source) AS tag, substr(sha1(text), 1, 10) AS text_hash,
              regexp_full_match(source, '[a-z_]+') AS plain_source FROM documents""",
)
def _(t):
    x = F.col("text")
    return t.documents.select(
        "doc_id", F.length(F.regexp_replace(F.trim(x), r"[ \t\n\f\r]+", " ")).cast("bigint").alias("collapsed_length"),
        F.size(F.regexp_extract_all(x, F.lit("[A-Za-z]+"), F.lit(0))).alias("word_count"),
        F.regexp_extract(x, "([A-Za-z]+)", 1).alias("first_word"), F.concat_ws("|", "lang", "source").alias("tag"),
        F.substring(F.sha1(x), 1, 10).alias("text_hash"), F.col("source").rlike("^[a-z_]+$").alias("plain_source"))


@query(
    "h05_date_functions",
    """SELECT case_id, strftime(decision_date, '%Y-%m') AS year_month, CAST(date_diff('day', DATE '1997-06-15', decision_date) AS BIGINT) AS day_count,
              round(date_diff('day', DATE '1997-06-15', decision_date) / 365.25::DOUBLE, 9) AS years FROM spine""",
)
def _(t):
    d = F.datediff("decision_date", F.lit("1997-06-15").cast("date")).cast("bigint")
    return t.spine.select("case_id", F.date_format("decision_date", "yyyy-MM").alias("year_month"), d.alias("day_count"), F.round(d / 365.25, 9).alias("years"))


@query(
    "h06_decimal_family",
    """WITH n AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT CAST(unnest(generate_series(4000, 8000, 25)) AS BIGINT) AS bp)
       SELECT o_orderpriority, CAST(bp AS DOUBLE) / 100 AS rate_percent, n * bp // 10000 AS approved_count FROM n CROSS JOIN r""",
)
def _(t):
    totals = t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    g = L._attach(totals, L.approval_grid(t.spark))
    return g.select("o_orderpriority", F.col("approval_rate_percent").cast("double").alias("rate_percent"),
                    L.approved_count(F.col("n"), F.col("rate_bp")).alias("approved_count"))


@query(
    "h07_json_encode",
    """SELECT row_id, concat('{"state":"', st, '"', CASE WHEN val IS NULL THEN ',"value":null' ELSE concat(',"value":', CAST(CAST(val AS BIGINT) AS VARCHAR)) END, '}') AS js
       FROM child_num""",
)
def _(t):
    df = S.classify(t.child, ["amount_text"])
    body = F.struct(F.col("amount_text__state").alias("state"), F.col("amount_text__value").cast("bigint").alias("value"))
    return df.select("row_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("js"))


@query(
    "h08_row_hashes",
    """SELECT count(*) AS distinct_payloads, count(*) FILTER (WHERE n > 1) AS repeated_payloads, max(n) AS max_multiplicity FROM
       (SELECT case_id, num_group1, amount, flag, count(*) AS n FROM detail GROUP BY ALL) x""",
)
def _(t):
    g = t.detail.groupBy("case_id", "num_group1", "amount", "flag").agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.count(F.lit(1)).alias("distinct_payloads"), F.count(F.when(F.col("n") > 1, 1)).alias("repeated_payloads"), F.max("n").alias("max_multiplicity"))


@query(
    "h09_array_and_map",
    """SELECT pattern, count(*) AS row_count, CASE pattern WHEN '000' THEN 'none' WHEN '111' THEN 'all_three' ELSE 'some' END AS pattern_name
       FROM (SELECT concat(has_debit, has_deposit, has_tax) AS pattern FROM scores) s GROUP BY 1""",
)
def _(t):
    bits = F.array("has_debit", "has_deposit", "has_tax")
    code = F.array_join(F.transform(bits, lambda b: b.cast("string")), "")
    names = F.create_map(F.lit("000"), F.lit("none"), F.lit("111"), F.lit("all_three"))
    g = t.scores.groupBy(code.alias("pattern")).agg(F.count(F.lit(1)).alias("row_count"))
    return g.withColumn("pattern_name", F.coalesce(F.try_element_at(names, F.col("pattern")), F.lit("some")))
