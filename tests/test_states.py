"""Row classifiers and group rules: a table of single values with the label written beside each, and random histories."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import groups as G, states as S
from tallyloom.operators import audit as A

TEXT_VALUES = {
    "0.0": "zero", "-0": "zero", "+0e9": "zero", ".5": "positive", "17.": "positive", "+8": "positive", "9e300": "positive", "4E-2": "positive",
    " 12\t": "positive", "-.25": "negative", "-6e-3": "negative", "-1e308": "negative", "Infinity": "nonfinite", "+INF": "nonfinite", "-infinity": "nonfinite",
    "1e999": "nonfinite", "": "unparseable", "  ": "unparseable", "nan": "unparseable", "12f": "unparseable", "0x1F": "unparseable", "1,5": "unparseable",
    "--4": "unparseable", "e5": "unparseable", "seven": "unparseable",
}


def label(spark, value, kind, rule):
    return spark.createDataFrame([(value,)], f"v {kind}").select(rule(F.col("v"))).first()[0]


def test_text_states(spark):
    df = spark.createDataFrame([(v,) for v in [*TEXT_VALUES, None]], "v string")
    got = {r.v: r["v__state"] for r in S.classify(df, ["v"]).collect()}
    assert got == {**TEXT_VALUES, None: "missing"}


def test_numeric_states(spark):
    want = {1: (-0.0, "zero"), 2: (5e-324, "positive"), 3: (-1.7e308, "negative"), 4: (math.inf, "nonfinite"), 5: (-math.inf, "nonfinite"), 6: (math.nan, "missing"), 7: (None, "missing")}
    df = spark.createDataFrame([(k, v) for k, (v, _) in want.items()], "k int, v double")
    got = {r.k: (r["v__state"], r["v__value"]) for r in S.classify(df, ["v"]).collect()}
    assert {k: s for k, (s, _) in got.items()} == {k: s for k, (_, s) in want.items()}
    assert got[2][1] == 5e-324 and got[4][1] is None and got[6][1] is None


@pytest.mark.parametrize("source, finite, nonzero, state", [
    (0, 0, 0, "NO_SOURCE_RECORD"),
    (9, 0, 0, "SOURCE_PRESENT_NO_FINITE_OBSERVATION"),
    (40, 39, 0, "FINITE_OBSERVATIONS_ZERO_ONLY"),
    (40, 40, 0, "FINITE_OBSERVATIONS_ZERO_ONLY"),
    (40, 1, 1, "AT_LEAST_ONE_FINITE_NONZERO_OBSERVATION"),
    (3_000_000, 2_999_999, 2_999_998, "AT_LEAST_ONE_FINITE_NONZERO_OBSERVATION"),
])
def test_entity_states(spark, source, finite, nonzero, state):
    df = spark.createDataFrame([(source, finite, nonzero)], "s int, f int, n int")
    assert df.select(S.entity_state(F.col("s"), F.col("f"), F.col("n"))).first()[0] == state


def test_date_states(spark):
    want = {"1999-12-31": "parseable", "2024-02-29": "parseable", "2023-02-29": "parse_failure", "2024-06-01 23:59:59": "parseable", "31/12/1999": "parse_failure", "": "empty", None: "native_missing"}
    df = spark.createDataFrame([(v,) for v in want], "d string")
    assert {r.d: r.s for r in df.select("d", S.date_state(df, "d").alias("s")).collect()} == want


@pytest.mark.parametrize("years, bin_", [
    (0.25, "0_to_0_5"), (math.nextafter(0.5, 1), "0_5_to_1"), (0.75, "0_5_to_1"), (math.nextafter(1, 2), "1_to_2"), (math.nextafter(2, 1), "1_to_2"), (2.75, "2_to_3"),
    (math.nextafter(3, 4), "3_to_4"), (3.999, "3_to_4"), (4.4, "4_to_5"), (math.nextafter(5, 9), "gt_5"), (73.0, "gt_5"), (math.inf, "gt_5"), (-0.0, "0_to_0_5"), (-0.001, None), (None, "0_to_0_5"),
])
def test_history_bins(spark, years, bin_):
    assert label(spark, years, "double", G.history_group) == bin_


@pytest.mark.parametrize("edge, closed", [(0.5, "0_to_0_5"), (2.0, "1_to_2"), (4.0, "3_to_4"), (5.0, "4_to_5")])
def test_history_bins_are_closed_on_the_right(spark, edge, closed):
    assert label(spark, edge, "double", G.history_group) == closed


@pytest.mark.parametrize("accounts, group", [(-0.0, "0"), (2.0, "2"), (math.nextafter(3, 0), None), (4.0, "3_plus"), (1e12, "3_plus"), (0.999, None), (-7.0, None), (None, None)])
def test_account_groups(spark, accounts, group):
    assert label(spark, accounts, "double", G.account_group) == group


def test_richness_rejects_non_binary(spark):
    df = spark.createDataFrame([(0, -1, 1)], "a int, b int, c int")
    with pytest.raises(Exception, match="module indicators"):
        df.select(G.richness(F.col("a"), F.col("b"), F.col("c"))).collect()


def test_histories_equal_brute_force(spark, rows):
    rng = random.Random(41)
    texts = ["12.5", "-3.25", "0", "-0.0", "junk", "inf", None, "8e2", " 4 ", "nan"]
    numbers = {"12.5": 12.5, "-3.25": -3.25, "0": 0.0, "-0.0": 0.0, "8e2": 800.0, " 4 ": 4.0}
    data = [(rng.choice([None, *range(60)]), rng.choice(texts)) for _ in range(700)]
    spine = spark.createDataFrame([(k,) for k in range(10, 50)], "case_id long")
    got = rows(A.aggregate_history(spine, spark.createDataFrame(data, "case_id long, v string").repartition(5), "case_id", ["v"]), "case_id")
    assert set(got) == set(range(10, 50))
    for k, r in got.items():
        own = [v for key, v in data if key == k]
        finite = [numbers[v] for v in own if v in numbers]
        assert r["source_rows"] == len(own) and r["v__finite"] == len(finite)
        assert r["v__invalid"] == sum(v in ("junk", "nan", "inf") for v in own)
        assert r["v__mean"] == (pytest.approx(sum(finite) / len(finite)) if finite else None)
        assert r["v__max"] == (max(finite) if finite else None)


def test_integer_like(spark):
    df = spark.createDataFrame([(-8.0,), (0.25,), (1e15,)], "v double")
    assert [r[0] for r in df.select(S.integer_like(F.col("v"))).collect()] == [True, False, True]
