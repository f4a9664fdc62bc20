import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import features as X, metrics as M, ranking as R


def test_ties_follow_base_order(spark):
    rng = np.random.default_rng(19)
    p, base = rng.integers(0, 4, 41) / 8, rng.permutation(41)
    df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(p, base))], "i int, p double, b int")
    r = {x.i: x for x in R.running(df.repartition(3), [], ["p", "b"]).select(
        "i", "rn", R.risk_percentile(F.col("rn"), F.col("n_rows")).alias("pct"), R.equal_count_bin(F.col("rn"), F.col("n_rows"), 4).alias("bin")).collect()}
    order = np.lexsort((base, p)).tolist()
    assert sorted(r, key=lambda i: r[i].rn) == order
    assert np.allclose([r[i].pct for i in order], np.arange(41) / 40)
    sizes = np.bincount([r[i].bin for i in order])[1:]
    assert len(sizes) == 4 and sizes.sum() == 41 and sizes.max() - sizes.min() == 1 and [r[i].bin for i in order] == sorted(r[i].bin for i in order)


def test_running_matches_brute_force_with_a_heavy_tie(spark):
    rng = np.random.default_rng(3)
    n = 4000
    score = np.where(rng.random(n) < 0.4, 0.5, rng.integers(0, 50, n) / 50.0)
    y = rng.integers(0, 2, n)
    df = spark.createDataFrame([(int(i), "a" if i % 3 else "b", float(s), int(v)) for i, (s, v) in enumerate(zip(score, y))], "k long, g string, s double, y long")
    got = R.running(df.repartition(7), ["g"], ["s", "k"], {"cy": F.col("y"), "cs": F.col("s")}, totals=True).collect()
    for g in ("a", "b"):
        idx = [i for i in range(n) if ("a" if i % 3 else "b") == g]
        idx.sort(key=lambda i: (score[i], i))
        cy, cs = np.cumsum(y[idx]), np.cumsum(score[idx])
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.rn)
        assert [r.k for r in mine] == idx and [r.rn for r in mine] == list(range(1, len(idx) + 1))
        assert [r.cy for r in mine] == cy.tolist() and np.allclose([r.cs for r in mine], cs)
        assert {r.cy_total for r in mine} == {int(cy[-1])} and {r.n_rows for r in mine} == {len(idx)}


@pytest.mark.parametrize("kind", ["normal", "ties", "tiny", "constant"])
def test_quantiles_equal_numpy(spark, kind):
    rng = np.random.default_rng(11)
    v = {"normal": rng.normal(size=20011), "ties": np.where(rng.random(9000) < 0.35, 0.0, rng.integers(-5, 900, 9000)).astype(float),
         "tiny": np.array([3.0, 1.0]), "constant": np.full(100, 4.5)}[kind]
    probs = {"a": 0.0, "p01": 0.01, "q": 0.25, "m": 0.5, "p999": 0.999, "z": 1.0}
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)] * 5, "v double").repartition(5)
    got = R.exact_quantiles(df.withColumn("g", F.lit(1)), ["g"], "v", probs).first()
    assert np.allclose([got[k] for k in probs], [np.quantile(v, p) for p in probs.values()], rtol=1e-12, atol=1e-12)
    alone = R.exact_quantiles(df, [], "v", probs).first()
    assert np.allclose([alone[k] for k in probs], [got[k] for k in probs])


def test_quantiles_stay_exact_when_the_sketch_misses(spark, monkeypatch):
    monkeypatch.setattr(R, "SKETCH", 5)
    monkeypatch.setattr(R, "MARGIN", 0.0)
    v = np.random.default_rng(2).normal(size=5000)
    df = spark.createDataFrame([(float(x),) for x in v], "v double").repartition(6)
    got = R.exact_quantiles(df, [], "v", {"p37": 0.37, "p81": 0.81}).first()
    assert np.allclose([got.p37, got.p81], np.quantile(v, [0.37, 0.81]))


def test_weighted_quantiles(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 1), (10.0, 6)], "v double, f long")
    full = [1.0] * 3 + [2.0] + [10.0] * 6
    got = R.exact_quantiles(df, [], "v", {"q": 0.25, "m": 0.5}, "f").first()
    assert [got.q, got.m] == [np.quantile(full, 0.25), np.quantile(full, 0.5)]


def test_distribution_summary(spark):
    v = np.concatenate([np.random.default_rng(4).normal(0.3, 2, 57), np.zeros(9)])
    r = X.distribution_summary(spark.createDataFrame([("g", float(x)) for x in v], "g string, v double"), ["g"], "v").first()
    assert r.n_cases == 66
    assert [r.share_below_zero, r.share_exactly_zero, r.share_above_zero] == pytest.approx([(v < 0).mean(), 9 / 66, (v > 0).mean()], abs=1e-9)
    assert r.standard_deviation == pytest.approx(v.std(ddof=1), abs=1e-9)


@pytest.mark.parametrize("share", [0.05, 0.3, 0.62])
def test_top_risk_keeps_ties(spark, share):
    rng = np.random.default_rng(7)
    p, y = rng.integers(1, 9, 90) / 10, rng.integers(0, 2, 90)
    df = spark.createDataFrame([(float(a), int(b), "x") for a, b in zip(p, y)], "pd double, target long, m string")
    r = M.top_risk(M.score_table(df, ["m"]), ["m"], [share]).first()
    cut = np.sort(p)[::-1][int(np.ceil(share * 90 - 1e-9)) - 1]
    assert (r.actual_rows, r.cutoff, r.positive_count) == ((p >= cut).sum(), cut, y[p >= cut].sum())


def auc_ap(y, p):
    pos, neg = p[y == 1], p[y == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    ap, last = 0.0, 0.0
    for s in sorted(set(p), reverse=True):
        tp, n = (y[p >= s] == 1).sum(), (p >= s).sum()
        ap += (tp / len(pos) - last) * tp / n
        last = tp / len(pos)
    return auc, ap


def test_metrics_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    p = rng.integers(1, 60, 400) / 61.0
    y = (rng.random(400) < p).astype(int)
    df = spark.createDataFrame([("m", float(a), int(b)) for a, b in zip(p, y)] + [("one", 0.3, 1), ("one", 0.4, 1)], "m string, pd double, target long")
    got = {r.m: r for r in M.binary_metrics(df, ["m"]).collect()}
    auc, ap = auc_ap(y, p)
    assert got["m"].roc_auc == pytest.approx(auc, abs=1e-9) and got["m"].average_precision == pytest.approx(ap, abs=1e-9)
    assert got["m"].log_loss == pytest.approx(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)), abs=1e-9)
    assert got["m"].brier_score == pytest.approx(np.mean((p - y) ** 2), abs=1e-9)
    assert got["one"].roc_auc is None and got["one"].metric_status == "PARTIAL_SINGLE_CLASS"


def test_gains_are_positive_when_better(spark):
    y, better, worse = [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9], [0.4, 0.6, 0.4, 0.6]
    df = spark.createDataFrame([("f_t", p, t) for p, t in zip(worse, y)] + [("f_ad", p, t) for p, t in zip(better, y)], "model_id string, pd double, target long")
    g = M.gains(M.binary_metrics(df, ["model_id"]), [], {"f": ("f_t", "f_ad")}).first()
    assert min(g.roc_auc_gain, g.average_precision_gain, g.log_loss_gain, g.brier_gain) > 0


def test_even_sample(spark):
    got = sorted(r.position for r in R.even_sample(spark.range(1003).withColumnRenamed("id", "b"), "b", 101).collect())
    assert got == sorted(set(np.linspace(0, 1002, 101, dtype=int).tolist()))


def test_ranges_follow_the_number_of_rows(spark, monkeypatch):
    """A task sorts a bounded number of rows: more rows than the session's partitions may hold make more ranges."""
    rows = [(k % 3, k * 7919 % 101, k, float(k % 5)) for k in range(900)]
    df = spark.createDataFrame(rows, "g long, s long, k long, y double")
    plain = {tuple(r) for r in R.running(df, ["g"], ["s", "k"], {"cy": F.col("y")}, totals=True, rows=900).collect()}
    monkeypatch.setattr(R, "RANGE_ROWS", 50)
    made = []
    kept = R.range_partition
    monkeypatch.setattr(R, "range_partition", lambda *a: made.append(kept(*a)) or made[-1])
    got = {tuple(r) for r in R.running(df, ["g"], ["s", "k"], {"cy": F.col("y")}, totals=True, rows=900).collect()}
    assert got == plain and len(got) == 900
    sizes = [r["count"] for r in made[0].groupBy(R.RANGE).count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 150
    assert R.more_parts(spark, 200) is None and R.more_parts(spark, 201) == 5 and R.more_parts(spark, None) is None
