import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import calibration as C, isotonic as I, metrics as M, resample as R


def table(spark, p, y, name="m"):
    return spark.createDataFrame([(name, float(a), int(b)) for a, b in zip(p, y)], "model_id string, pd double, target long")


def bins(spark, p, k):
    df = table(spark, p, [0] * len(p))
    return sorted((r.bin_id, r.row_count) for r in C.tie_preserving_bins(M.score_table(df, ["model_id"]), ["model_id"], k).collect())


def test_bins_keep_ties(spark):
    assert bins(spark, [0.05] * 2 + [0.4] * 11 + [0.75] * 3, 4) == [(1, 2), (2, 11), (3, 3)]
    assert bins(spark, [0.11, 0.22, 0.33, 0.44, 0.55, 0.66], 4)[0] == (1, 1)  # equal distance goes to the lower count
    assert bins(spark, [0.3] * 7, 4) == [(1, 7)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bins_equal_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    p = np.sort(rng.choice(rng.random(23), 301))
    u, counts = np.unique(p, return_counts=True)
    cum = np.cumsum(counts)
    cand = cum[:-1]
    edges = sorted({int(cand[np.argmin(np.abs(cand * 10 - b * 301))]) for b in range(1, 10)})
    expected = np.diff([0, *edges, 301]).tolist()
    assert [n for _, n in bins(spark, p, 10)] == expected


def test_bin_diagnostics(spark):
    rng = np.random.default_rng(9)
    n, gap = rng.integers(1, 50, 12), rng.normal(0, 0.1, 12)
    df = spark.createDataFrame([("m", int(a), float(g), 12) for a, g in zip(n, gap)], "model_id string, row_count long, gap double, requested_bins long")
    r = C.bin_diagnostics(df, ["model_id"]).first()
    assert r.ece == pytest.approx((n * np.abs(gap)).sum() / n.sum()) and r.max_abs_gap == pytest.approx(np.abs(gap).max())


def sample(seed=0, n=3000):
    rng = np.random.default_rng(seed)
    p = rng.integers(1, 400, n) / 401
    z = np.log(p / (1 - p))
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.4 + 0.7 * z)))).astype(int)
    return p, z, y


def test_logistic_fit_solves_the_score_equations(spark):
    p, z, y = sample()
    fit = C.fit_logistic(M.score_counts(table(spark, p, y), ["model_id"]), ["model_id"]).first()
    mu = 1 / (1 + np.exp(-(fit.alpha + fit.beta * z)))
    assert fit.valid and abs((mu - y).sum()) < 1e-6 and abs(((mu - y) * z).sum()) < 1e-6


def test_logistic_fit_far_from_start(spark):
    rng = np.random.default_rng(6)
    z = rng.normal(-6, 0.01, 2000)
    p = 1 / (1 + np.exp(-z))
    y = (rng.random(2000) < 0.5).astype(int)
    fit = C.fit_logistic(M.score_counts(table(spark, p, y), ["model_id"]), ["model_id"]).first()
    mu = 1 / (1 + np.exp(-(fit.alpha + fit.beta * np.log(p / (1 - p)))))
    assert fit.converged and abs((mu - y).sum()) < 1e-4


def test_one_class_is_invalid(spark):
    fit = C.fit_logistic(M.score_counts(table(spark, [0.1, 0.2], [1, 1]), ["model_id"]), ["model_id"]).first()
    assert not fit.valid


def test_calibration_in_the_large(spark):
    p, z, y = sample(4)
    far = 1 / (1 + np.exp(-(z - 5)))
    both = table(spark, p, y, "a").unionByName(table(spark, far, y, "b"))
    got = {r.model_id: r.intercept for r in C.calibration_in_the_large(M.score_counts(both, ["model_id"]), ["model_id"]).collect()}
    for name, zz in (("a", z), ("b", np.log(far / (1 - far)))):
        assert abs((1 / (1 + np.exp(-(got[name] + zz))) - y).sum()) < 1e-5


def pav(p, y):
    x = np.unique(p)
    blocks = [[y[p == v].sum(), (p == v).sum(), 1] for v in x]
    out = []
    for b in blocks:
        out.append(b)
        while len(out) > 1 and out[-2][0] / out[-2][1] > out[-1][0] / out[-1][1]:
            a = out.pop()
            out[-1] = [out[-1][0] + a[0], out[-1][1] + a[1], out[-1][2] + a[2]]
    fit = np.concatenate([np.full(k, s / n) for s, n, k in out])
    return dict(zip(x, fit))


def line(fit, x):
    """Value of a fit at a score: straight between training scores, the end values outside."""
    known = sorted(fit)
    return float(np.interp(x, known, [fit[k] for k in known]))


@pytest.fixture
def many_ranges(spark):
    """Small ranges stay apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("seed", [9, 10])
def test_isotonic_equals_pool_adjacent_violators(spark, many_ranges, seed):
    samples = {"a": sample(seed, 1500), "b": sample(seed + 20, 700), "c": (np.array([0.2, 0.4, 0.6]), None, np.array([1, 0, 0])), "d": (np.array([0.3]), None, np.array([1]))}
    df = None
    for name, (p, _, y) in samples.items():
        part = table(spark, p, y, name)
        df = part if df is None else df.unionByName(part)
    counts = M.score_counts(df, ["model_id"])
    probes = [(m, x, 0, 0) for m in samples for x in (-1.0, 0.0123, 0.3333, 0.50001, 2.0)]
    points = counts.unionByName(spark.createDataFrame(probes, "model_id string, pd double, n long, pos long"))
    ranged, blocks = I.fit(points.repartition(5), ["model_id"])
    assert ranged.select("__range").distinct().count() > 1
    got = {(r.model_id, r.pd): r.iso for r in I.predict(ranged, blocks, ["model_id"]).collect()}
    assert len(got) == points.count()
    for m, (p, _, y) in samples.items():
        want = pav(p, y)
        for (name, x), v in got.items():
            if name == m:
                assert v == pytest.approx(line(want, x), abs=1e-12), (m, x)
    assert all(r.valid and r.x_min == samples[r.model_id][0].min() for r in I.valid(blocks, ["model_id"]).collect())


def test_pooling_merges_like_a_monoid():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n, cut = int(rng.integers(2, 30)), int(rng.integers(1, 29))
        rows = rng.integers(1, 5, n)
        pos = rng.binomial(rows, 0.5)
        whole = [(r, h) for *_, r, h in I.pool(rows, pos)]
        parts = [(r, h) for a, b in ((0, cut), (cut, n)) for *_, r, h in I.pool(rows[a:b], pos[a:b])]
        assert [(r, h) for *_, r, h in I.pool(np.array([r for r, _ in parts]), np.array([h for _, h in parts]))] == whole


def test_cross_fitted_isotonic_equals_plain(spark):
    p, _, y = sample(14, 500)
    rows = spark.createDataFrame([(i, m, i % 3, float(a if m == "m" else a / 2), int(b)) for i, (a, b) in enumerate(zip(p, y)) for m in "mk"], "case_id long, model_id string, fold_id long, pd double, target long")
    got = {(r.model_id, r.case_id): r.oof for r in C.cross_fit_isotonic(rows, 3).collect()}
    assert len(got) == 1000
    fold = np.arange(500) % 3
    for f in range(3):
        for m, x in (("m", p), ("k", p / 2)):
            fit = pav(x[fold != f], y[fold != f])
            assert all(got[m, i] == pytest.approx(line(fit, x[i]), abs=1e-12) for i in np.flatnonzero(fold == f))


def test_cross_fit_leaves_the_held_out_fold_out(spark):
    p, z, y = sample(12, 600)
    rows = spark.createDataFrame([(i, "m", i % 3, float(a), int(b)) for i, (a, b) in enumerate(zip(p, y))], "case_id long, model_id string, fold_id long, pd double, target long")
    oof = C.cross_fit_logistic(rows, 3)
    got = {r.case_id: r.oof for r in oof.collect()}
    train = [i for i in range(600) if i % 3 != 0]
    fit = C.fit_logistic(M.score_counts(table(spark, p[train], y[train]), ["model_id"]), ["model_id"]).first()
    for i in range(0, 600, 3):
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(fit.alpha + fit.beta * z[i]))), abs=1e-9)
    cov = C.oof_coverage(oof, "case_id", ["model_id"]).first()
    assert (cov.keys, cov.predictions, cov.repeated_keys, cov.invalid_predictions) == (600, 600, 0, 0)


def test_bootstrap_keeps_class_sizes_and_pairs(spark, monkeypatch):
    p, _, y = sample(3, 120)
    rows = spark.createDataFrame([(i, int(b), float(a), float(a)) for i, (a, b) in enumerate(zip(p, y))], "case_id long, target long, p1 double, p2 double")
    placed = C.class_positions(rows.select("case_id", "target"), "case_id", "target")
    d = C.draw_counts(placed, "target", 4).groupBy("replicate_id", "target").agg(F.sum("draws").alias("n"))
    assert {(r.target, r.n) for r in d.collect()} == {(0, int((y == 0).sum())), (1, int((y == 1).sum()))} and d.count() == 8
    variants = {"p1": ("m", "identity"), "p2": ("m", "logistic")}
    boot = C.paired_bootstrap(rows, "case_id", "target", variants, 6)
    assert boot.count() == 12
    assert boot.groupBy("replicate_id").agg((F.max("log_loss") - F.min("log_loss")).alias("x")).where("x <> 0").count() == 0
    assert boot.where("method = 'identity'").select("log_loss").distinct().count() > 1
    counts = {(r.replicate_id, r.target, r.position): r.draws for r in C.draw_counts(placed, "target", 6).collect()}
    by_class = {c: np.flatnonzero(y == c) for c in (0, 1)}
    loss = -(y * np.log(p) + (1 - y) * np.log(1 - p))
    for r in boot.where("method = 'identity'").collect():
        want = sum(n * loss[by_class[c][k]] for (rep, c, k), n in counts.items() if rep == r.replicate_id) / 120
        assert r.log_loss == pytest.approx(want)


@pytest.mark.parametrize("rows", [7, 64, 512])
def test_draws_equal_their_sql(spark, rows):
    """Several blocks, a shorter last one, and classes of one row and of one block."""
    labels = [0] * 300 + [1] * 63 + [2]
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT unnest($x) AS y", {"x": labels})
    want = {(r, c, k): n for r, c, k, n in con.sql(R.draws_sql("SELECT y FROM t", "y", "y", 25, rows)).fetchall()}
    placed = spark.createDataFrame([(c, k) for c in set(labels) for k in range(labels.count(c))], "y long, position long")
    sizes = {c: labels.count(c) for c in set(labels)}
    got = {(r.replicate_id, r.label, r.position): r.draws for r in R.resample(placed, "y", sizes, 25, [], counts=True, rows=rows).collect()}
    assert got == want
    for r in range(25):
        for c, m in sizes.items():
            assert sum(n for (rep, label, _), n in got.items() if rep == r and label == c) == m


def test_draws_are_multinomial():
    """Counts of blocks and of rows have the moments of independent draws."""
    n = R.block_counts(np.arange(4000), 1, 1000, 64)
    size = np.array([64] * 15 + [40])
    assert (n.sum(1) == 1000).all() and np.abs(n.mean(0) - size).max() < 1
    assert np.abs(n.var(0) / (size * (1 - size / 1000)) - 1).max() < 0.12
    assert abs(np.corrcoef(n[:, 0], n[:, 9])[0, 1] + size[0] / (1000 - size[0])) < 0.06
    hits = R.inside(np.arange(3000), 0, 2, np.full(3000, 50), 50)
    assert (hits.sum(1) == 50).all() and abs(hits.var() - 0.98) < 0.03
    x = R.binomial(np.full(20_000, 41), 5, 17, R.mix(np.arange(20_000).astype(np.uint64)))
    assert abs(x.mean() - 41 * 5 / 17) < 0.1 and abs(x.var() - 41 * 5 / 17 * 12 / 17) < 0.3 and x.max() <= 41


def guard_rows(spark, rows):
    return spark.createDataFrame(rows, "model_id string, method string, oof_log_loss double, probability_valid boolean, passes_brier boolean, passes_ranking boolean")


def choose(spark, rows, errors):
    g = guard_rows(spark, rows)
    e = spark.createDataFrame(errors, "model_id string, method string, paired_se double")
    return {r.method: r for r in C.select_method(g, C.reference_methods(g), e).collect()}


def test_simplest_within_one_error_wins(spark):
    got = choose(spark, [("m", "identity", 0.5004, True, True, True), ("m", "logistic", 0.5001, True, True, True), ("m", "isotonic", 0.5, True, True, True)],
                 [("m", "identity", 0.0005), ("m", "logistic", 0.0005)])
    assert got["identity"].selected and got["isotonic"].reference_method == "isotonic" and got["logistic"].selection_reason == "ELIGIBLE_NOT_SIMPLEST"


def test_outside_the_band_and_hard_constraints(spark):
    got = choose(spark, [("m", "identity", 0.6, True, True, True), ("m", "logistic", 0.5, True, True, True), ("m", "isotonic", 0.4, True, False, True)],
                 [("m", "identity", 0.01)])
    assert got["logistic"].selected and got["identity"].selection_reason == "OUTSIDE_ONE_SE_BAND"
    assert got["isotonic"].selection_reason == "INELIGIBLE_HARD_CONSTRAINT" and got["isotonic"].delta_log_loss is None


def test_stability_warning(spark):
    rows = [("m", meth, f, ll) for f, (a, b) in enumerate([(0.5, 0.4), (0.5, 0.6), (0.5, 0.6)]) for meth, ll in (("identity", a), ("logistic", b))]
    r = C.stability(spark.createDataFrame(rows, "model_id string, method string, fold_id long, log_loss double")).first()
    assert r.improved_folds == 1 and r.warning == "STABILITY_WARNING"
