import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import audit as A, checks as K, coverage as V, detail as T, features as X, history as H, joins as J

D = dt.date


def test_structure(spark):
    rng = random.Random(12)
    keys = [rng.choice([None, *range(30)]) for _ in range(400)]
    data = [(k, rng.randrange(6)) for k in keys]
    spine = set(range(5, 40))
    r = A.source_structure(spark.createDataFrame([(k,) for k in sorted(spine)], "case_id long"), spark.createDataFrame(data, "case_id long, num_group1 long").repartition(3), "case_id", "num_group1").first()
    known = [d for d in data if d[0] is not None]
    assert r.null_key_rows == keys.count(None) and r.orphan_rows == sum(k not in spine for k, _ in known)
    assert r.matched_rows == sum(k in spine for k, _ in known) and r.missing_base_keys == len(spine - {k for k, _ in known})
    assert r.duplicate_key_excess == len(known) - len({k for k, _ in known}) and r.duplicate_composite_excess == len(known) - len(set(known))
    assert r.join_readiness == "KEY_DEFECTS_REQUIRE_REVIEW"


def test_shard_overlap(spark):
    left, right = {k: k * k for k in range(0, 70)}, {k: k * k + (k % 5 == 0) for k in range(55, 90)}
    data = [(k, v, "left") for k, v in left.items()] + [(k, v, "right") for k, v in right.items()]
    r = J.shard_overlap(spark.createDataFrame(data, "k long, v long, f string"), "k", "f", ["v"]).first()
    assert (r.overlapping_keys, r.conflicting_keys, r.check_status) == (15, 3, "CHECKED")


def test_shard_overlap_repeated_keys_not_compared(spark):
    df = spark.createDataFrame([(1, 10, "a"), (1, 10, "a"), (1, 10, "b"), (5, 1, "c")], "k long, v long, f string")
    got = {(r.left_file, r.right_file): r for r in J.shard_overlap(df, "k", "f", ["v"]).collect()}
    assert got[("a", "b")].conflicting_keys is None and got[("a", "b")].check_status.startswith("NOT_CHECKED")
    assert got[("a", "c")].check_status == "PASS_NO_OVERLAP" and len(got) == 3


def test_composite_overlap(spark):
    data = [(k, i, "x", 1000 * k + i) for k in range(12) for i in range(3)] + [(k, i, "y", 1000 * k + i + (k == 10 and i > 1)) for k in range(8, 20) for i in range(1, 5)]
    r = J.shard_composite_overlap(spark.createDataFrame(data, "k long, i long, f string, h long"), "k", "i", "f", ["h"]).first()
    assert (r.case_overlap_count, r.composite_key_overlap_count, r.conflicting_composite_keys) == (4, 8, 1)


def test_latest_ties(spark):
    rng = random.Random(8)
    data = [(rng.randrange(25), rng.choice([None, D(2017, 3, 1), D(2017, 3, 2), D(2018, 11, 30)]), rng.randrange(3)) for _ in range(70)]
    spine = spark.createDataFrame([(k,) for k in range(25)], "case_id long")
    src = spark.createDataFrame(data, "case_id long, d date, v long")
    tied = conflict = undated = 0
    for k in range(25):
        own = [(d, v) for c, d, v in data if c == k]
        dated = [x for x in own if x[0] is not None]
        undated += bool(own) and not dated
        last = [v for d, v in dated if d == max(x[0] for x in dated)]
        tied += len(last) > 1
        conflict += len(set(last)) > 1
    r = A.latest_date_ties(spine, src, "case_id", "d", ["v"]).first()
    assert (r.entities_latest_date_tied, r.entities_latest_tie_payload_conflict, r.entities_no_usable_date) == (tied, conflict, undated) and conflict < tied
    off = A.latest_date_ties(spine, src, "case_id", "d", ["v"], track=False).first()
    assert off.entities_latest_date_tied is None and off.tie_status == "NOT_CHECKED"


def test_date_audit(spark):
    spine = spark.createDataFrame([(k, D(2015, 6, 15)) for k in range(4)], "case_id long, decision date")
    texts = [(0, "2015-06-15"), (0, "2015-06-25"), (1, "2015-07-05"), (1, "15.06.2015"), (2, "2015-13-01"), (2, None), (3, "2014-06-15"), (3, "soon")]
    m = {r.metric_name: r for r in A.audit_date(spine, spark.createDataFrame(texts, "case_id long, d string"), "case_id", "d", "decision").collect()}
    assert m["row_date_parse_failure_count"].value == 3 and m["date_offset_above_zero_count"].value == 2
    assert m["date_offset_days_median"].value == 5


def test_undefined_status(spark):
    spine = spark.createDataFrame([(1,)], "case_id long")
    src = spark.createDataFrame([(1, "bad")], "case_id long, v string")
    m = {r.metric_name: r for r in A.audit_numeric(spine, src, "case_id", ["v"]).collect()}
    assert m["finite_median"].value is None and m["finite_median"].status == "UNDEFINED_NO_FINITE_VALUES"
    assert m["entity_state_NO_SOURCE_RECORD_source_rate"].status == "NOT_APPLICABLE"
    assert m["row_state_unparseable_count"].value == 1


def test_index_zero_rows(spark, rows):
    data = [(k, i, 10 * k + i) for k in range(1, 20) for i in range(k % 4)] + [(30, 0, 7), (30, 0, 8), (31, 5, 9)]
    spine = spark.createDataFrame([(k,) for k in [*range(1, 20), 30, 31, 32]], "case_id long")
    got = rows(T.select_index_zero(spine, spark.createDataFrame(data, "case_id long, num_group1 long, v long"), "case_id", "num_group1", ["v"]), "case_id")
    assert {k: r["v"] for k, r in got.items()} == {**{k: 10 * k if k % 4 else None for k in range(1, 20)}, 30: None, 31: None, 32: None}


def test_ratio_review(spark):
    data = [(n, d) for n in (None, -4.0, 0.0, 9.5) for d in (None, -2.0, -0.0, 0.0, 0.5, 1e-300)]
    r = A.ratio_review(spark.createDataFrame(data, "n double, d double"), {"x": ("n", "d")}).first()
    assert (r.eligible_count, r.undefined_count, r.denominator_zero_count, r.denominator_negative_count) == (6, 18, 8, 4)


def test_duplicate_columns(spark):
    rng = random.Random(5)
    base = [rng.choice([None, 0.0, -1.5, 1e9]) for _ in range(80)]
    last = [v if k < 79 else 123.0 for k, v in enumerate(base)]
    data = [(k, b, l, b, None if b == 0 else b) for k, (b, l) in enumerate(zip(base, last))]
    df = spark.createDataFrame(data, "k long, p double, q double, r double, s double")
    assert [(x.left_column, x.right_column) for x in X.duplicate_columns(df, "k", ["p", "q", "r", "s"]).collect()] == [("p", "r")]


def test_consistent_value(spark, rows):
    rng = random.Random(21)
    data = [(rng.randrange(40), rng.choice([None, None, 2.5, 2.5, 2.5, -8.0])) for _ in range(90)]
    want, conflicts, empty = {}, 0, 0
    for k in range(45):
        own = [v for c, v in data if c == k]
        seen = {v for v in own if v is not None}
        want[k] = seen.pop() if len(seen) == 1 else None
        conflicts += len({v for v in own if v is not None}) > 1
        empty += bool(own) and all(v is None for v in own)
    vals = T.consistent_value(spark.createDataFrame([(k,) for k in range(45)], "case_id long"), spark.createDataFrame(data, "case_id long, v double"), "case_id", "v")
    assert {k: r["value"] for k, r in rows(vals, "case_id").items()} == want
    s = T.consistent_summary(vals).first()
    assert (s.source_present_no_finite, s.conflicting_finite_values) == (empty, conflicts) and conflicts and empty


def test_asof_history(spark, rows):
    rng = random.Random(33)
    day = lambda n: D(2012, 1, 1) + dt.timedelta(days=n)
    decision = {k: day(rng.randrange(200, 260)) for k in range(30)}
    active = [(rng.randrange(30), day(rng.randrange(0, 400))) for _ in range(50)]
    closed = [(rng.randrange(30), day(rng.randrange(0, 400))) for _ in range(50)]
    frame = lambda x: spark.createDataFrame(x, "case_id long, d date")
    got = rows(H.combined_history(spark.createDataFrame(list(decision.items()), "case_id long, decision date"), frame(active), "d", frame(closed), "d", "case_id", "decision"), "case_id")
    for k, when in decision.items():
        known = [d for c, d in active + closed if c == k and d <= when]
        assert got[k]["history_days"] == (max((when - d).days for d in known) if known else None)
        assert got[k]["active_after_rows"] == sum(c == k and d > when for c, d in active)


def test_weekly_and_missing_weeks(spark, rows):
    df = spark.createDataFrame([(0, 0), (0, 1), (0, 1), (2, 0), (2, 0), (5, None)], "w long, y long").withColumn("d", F.lit(D(2020, 1, 1)))
    got = rows(A.weekly_summary(df, "w", "d", "y"), "week_num")
    assert got[0]["event_rate"] == round(2 / 3, 9) and got[2]["event_rate"] == 0 and got[5]["event_rate"] is None
    assert sorted(r.missing_value for r in A.missing_integers(df, "w").collect()) == [1, 3, 4]


def test_grouped_dates(spark):
    rng = random.Random(6)
    draw = lambda: [(rng.randrange(12), D(2019, 5, rng.randint(1, 3))) for _ in range(40)]
    left, right = draw(), draw()
    a, b = Counter(left), Counter(right)
    x = J.grouped_date_comparison(spark.createDataFrame(left, "k long, d date"), spark.createDataFrame(right, "k long, d date"), "k", "d").first()
    both = set(a) & set(b)
    assert x.matched_group_count == len(both) and x.left_only_group_count == len(set(a) - both) and x.right_only_group_count == len(set(b) - both)
    assert x.matched_equal_multiplicity_count == sum(a[g] == b[g] for g in both)
    assert x.matched_ambiguous_multirow_group_count == sum(a[g] > 1 or b[g] > 1 for g in both)


def test_summary_against_detail(spark):
    spine = spark.createDataFrame([(k,) for k in range(1, 7)], "case_id long")
    s = spark.createDataFrame([(1, 3.0, 0.6), (2, 1.0, 40.0), (3, 2.0, 17.5), (4, 5.0, 9.0), (6, 1.0, 2.25)], "case_id long, c double, s double")
    d = spark.createDataFrame([(1, 0.2), (1, 0.2), (1, 0.2), (2, 40.0), (3, 10.0), (3, 7.0), (4, 9.0), (6, 2.25)], "case_id long, a double")
    r = H.correspondence_counts(J.summary_vs_detail(spine, s, d, "case_id", "c", "s", "a"), "c", "s").first()
    assert (r.exact_record_count, r.exact_sum_count, r.close_sum_count) == (4, 3, 4)


@pytest.mark.parametrize("records, finite, total, state", [
    (0, 0, None, "NO_DETAIL_SOURCE"), (6, 0, None, "DETAIL_ALL_AMOUNTS_MISSING_OR_INVALID"), (6, 6, -0.0, "DETAIL_FINITE_ZERO_SUM"),
    (7, 3, 1e-9, "DETAIL_FINITE_NONZERO_SUM"), (1, 1, -480.5, "DETAIL_FINITE_NONZERO_SUM"),
])
def test_amount_states(spark, records, finite, total, state):
    df = spark.createDataFrame([(records, finite, total)], "r long, f long, s double")
    assert df.select(H.amount_state(F.col("r"), F.col("f"), F.col("s"))).first()[0] == state


def test_signatures(spark):
    df = spark.createDataFrame([(1, 0, 5.0), (1, 1, 5.0), (2, 0, None)], "k long, i long, v double")
    r = T.repeated_signatures(df, ["k", "v"], [], ["v"]).first()
    assert (r.repeated_groups, r.repeated_excess_rows, r.rows_all_amounts_missing) == (1, 1, 1)


def test_patterns_include_zero_counts(spark, rows):
    df = spark.createDataFrame([(True, True), (True, False), (True, False)], "a boolean, b boolean")
    got = rows(V.pattern_counts(df, "x", [F.col("a"), F.col("b")]), "pattern")
    assert {k: v["pattern_count"] for k, v in got.items()} == {"00": 0, "01": 0, "10": 2, "11": 1}
    assert got["10"]["denominator_value"] == 3


def test_module_masks(spark, rows):
    spine = spark.createDataFrame([(0,), (1,)], "case_id long")
    src = spark.createDataFrame([(0, None, "x"), (1, None, None)], "case_id long, v double, aux string")
    comp = {"c": V.Component("m", "s", ("v",), ("aux",))}
    got = rows(V.module_flags(V.component_flags(spine, {"s": src}, comp, "case_id"), comp), "case_id")
    assert [got[i]["module_m__content"] for i in (0, 1)] == [False, False]
    assert [got[i]["module_m__auxiliary_only"] for i in (0, 1)] == [True, False]


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, None)], "a double, b double")
    r = A.pair_diagnostics(df, ["a", "b"]).first()
    assert r.joint_finite_rows == 2 and r.pearson_correlation is None


def test_align_refuses_repeated_keys(spark):
    spine = spark.createDataFrame([(1,)], "case_id long")
    with pytest.raises(Exception, match="not unique"):
        J.align(spine, spark.createDataFrame([(1, 2), (1, 3)], "case_id long, v long"), "case_id").collect()


def test_skew_join_equals_plain_join(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    for how in ("inner", "left", "left_semi"):
        a, b = J.skew_join(left, right, "k", how), left.join(right, "k", how)
        assert K.difference(a.select(b.columns), b).count() == 0


def test_check_roll_up(spark, rows):
    df = spark.createDataFrame([("g", "a", "PASS"), ("g", "b", "NOT_CHECKED"), ("h", "a", "NOT_CHECKED"), ("i", "a", "FAIL"), ("i", "info", "FAIL"),
                                ("j", "info", "FAIL"), ("j", "a", "PASS")], "g string, check_id string, status string")
    got = rows(K.roll_up(df, ["g"], ["info"]), "g")
    assert {k: v["overall_status"] for k, v in got.items()} == {"g": "PASS", "h": "NOT_CHECKABLE", "i": "FAIL", "j": "PASS"}


def test_sparse_integers(spark, monkeypatch):
    monkeypatch.setattr(A, "GAP_BLOCK", 1000)
    seen = [-(2**40), -(2**40) + 2500, -(2**40) + 2501, -(2**40) + 2503]
    got = [r.missing_value for r in A.missing_integers(spark.createDataFrame([(v,) for v in [*seen, seen[0], None]], "w long"), "w").collect()]
    assert sorted(got) == sorted(set(range(seen[0], seen[-1])) - set(seen))


def test_many_shards(spark):
    data = [(k, k, f"f{s:03d}") for s in range(60) for k in (s, s + 1)]
    got = {(r.left_file, r.right_file): (r.overlapping_keys, r.check_status) for r in J.shard_overlap(spark.createDataFrame(data, "k long, v long, f string"), "k", "f", ["v"]).collect()}
    assert len(got) == 60 * 59 // 2
    assert all(v == ((1, "CHECKED") if int(b[1:]) - int(a[1:]) == 1 else (0, "PASS_NO_OVERLAP")) for (a, b), v in got.items())
