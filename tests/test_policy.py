from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import groups as G
from tallyloom.operators import policy as L
from tallyloom.operators.scoring import unpivot_models


@pytest.fixture(scope="module")
def ten(spark):
    base = np.linspace(0.01, 0.10, 10)
    rows = [(i, i, i % 2, *[float(base[(i * (j + 1)) % 10] + 0.001 * j) for j in range(6)]) for i in range(10)]
    cols = ", ".join(f"{m} double" for m in G.MODELS)
    return spark.createDataFrame(rows, f"case_id long, base_order long, target long, {cols}")


def test_grids(spark):
    a, b = L.approval_grid(spark).collect(), L.budget_grid(spark).collect()
    assert len(a) == 161 and len(b) == 126 and sum(r.is_display_point for r in a) == 5 and sum(r.is_display_point for r in b) == 6
    assert a[1].approval_rate_percent == Decimal("40.25") and b[-1].risk_budget == 0.02
    assert [r.pd_threshold for r in L.scenario_grid(spark).collect()] == [float(format(Decimal(1) / (1 + k), ".18f")) for k in (2, 5, 10, 20, 30, 50)]


def test_curves(spark, ten):
    r = L.ranked(unpivot_models(ten, G.MODELS)).cache()
    a = L.approval_curve(r, L.approval_grid(spark)).collect()
    b = L.risk_budget_curve(r, L.budget_grid(spark)).collect()
    assert len(a) == 161 * 6 and len(b) == 126 * 6
    wide = {m: sorted((x[m], x.base_order, x.target) for x in ten.collect()) for m in G.MODELS}
    for x in a:
        k = int(10 * Decimal(str(x.approval_rate_percent)) / 100)
        head = wide[x.model_id][:k]
        assert x.approved_count == k and x.cutoff == head[-1][0] and x.realised_defaults == sum(h[2] for h in head)
    for x in b:
        p = np.array([h[0] for h in wide[x.model_id]])
        k = int(np.searchsorted(np.cumsum(p) / np.arange(1, 11), x.risk_budget, side="right"))
        assert x.approved_count == k and x.feasible == (k > 0)
        if k:
            assert x.approved_mean_pd <= x.risk_budget + 1e-9


def test_budget_unit_borders(spark):
    values = [0.0075, 0.00750000000000001, 0.0074999999999, 0.02, 0.0123, 0.01230000001]
    df = spark.createDataFrame([(v,) for v in values], "m double")
    got = [r[0] for r in df.select(L.budget_unit(F.col("m"))).collect()]
    assert got == [next(u for u in range(1, 500) if v <= u / 10000) for v in values]


def test_switches_swap_equally(spark, ten):
    pairs = L.pair_ranks(ten, G.FAMILIES, []).cache()
    rows = L.approval_switches(pairs, {}).collect()
    assert len(rows) == 3 * 5 * 4
    for fam in G.FAMILIES:
        for rate in (40.0, 50.0, 60.0, 70.0, 80.0):
            c = {r.switch_category: r.case_count for r in rows if r.algorithm_family == fam and r.approval_rate_percent == rate}
            assert c["T_only_approved"] == c["T_plus_AD_only_approved"] and sum(c.values()) == 10


def test_migration_folds_to_coarser_bins(spark):
    rng = np.random.default_rng(8)
    rows = [(i, i, int(rng.integers(0, 2)), *[float(x) for x in rng.integers(1, 40, 6) / 50]) for i in range(357)]
    df = spark.createDataFrame(rows, "case_id long, base_order long, target long, " + ", ".join(f"{m} double" for m in G.MODELS))
    got = L.migration(L.pair_ranks(df, G.FAMILIES, []), {}, (5, 10, 20)).collect()
    assert len(got) == 3 * 525
    order = {m: {r[0]: k for k, r in enumerate(sorted(rows, key=lambda r: (r[3 + j], r[1])))} for j, m in enumerate(G.MODELS)}
    for fam, (a, b) in G.FAMILIES.items():
        for k in (5, 10, 20):
            cells = np.zeros((k, k), int)
            for i in range(357):
                cells[order[a][i] * k // 357, order[b][i] * k // 357] += 1
            mine = {(r.t_bin, r.ad_bin): r.case_count for r in got if r.algorithm_family == fam and r.n_bins == k}
            assert all(mine[(i + 1, j + 1)] == cells[i, j] for i in range(k) for j in range(k))


def test_scenario_value_is_strict(spark):
    df = spark.createDataFrame([("m", 0.1, 0), ("m", 0.2, 1), ("m", 1 / 3, 0)], "model_id string, pd double, target long")
    r = L.scenario_values(df, {2: "x"}).first()
    assert r.approved_count == 2 and r.expected_value == pytest.approx(0.7 + 0.4) and r.realised_value == 1 - 2


def test_budget_inversion(spark):
    curve = spark.createDataFrame([("a", float(r), r, 0.001 * r) for r in range(1, 11)] + [("b", float(r), r, 0.0005 + 0.001 * r) for r in range(1, 11)],
                                  "model_id string, approval_rate_percent double, approved_count long, approved_mean_pd double")
    got = {(r.model_id, r.common_budget): r for r in L.invert_budgets(curve, L.common_budgets(curve)).collect()}
    assert len(got) == 40 and got[("a", 0.0015)].approved_count == 1 and got[("a", 0.002)].approved_count == 2
    assert got[("b", 0.001)].feasible is False and got[("b", 0.0105)].approved_count == 10
