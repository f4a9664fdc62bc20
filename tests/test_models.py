import pathlib
import pickle

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import blocks as K, boosting as X, metrics as M, models as Y, perceptron as N


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3))
    y = (rng.random(600) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - x[:, 1])))).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), *map(float, x[i])) for i in range(600)], "case_id long, target long, a double, b double, c double")
    return df.cache(), x, y


def test_logit_matches_the_penalised_optimum(data):
    df, x, y = data
    fit = Y.fit_logit(df.where("case_id < 400"), df.where("case_id >= 400"), ["a", "b", "c"], strengths=(0.05,))
    p = {r.case_id: r.pd for r in fit.score(df).collect()}
    X, t, w = np.c_[x[:400], np.ones(400)], y[:400], np.zeros(4)
    ridge = np.diag([1.0, 1.0, 1.0, 0.0])  # C * sum(loss) + |w|^2 / 2 with C = 0.05
    for _ in range(50):
        mu = 1 / (1 + np.exp(-X @ w))
        w = w - np.linalg.solve(0.05 * (X.T * (mu * (1 - mu))) @ X + ridge, 0.05 * X.T @ (mu - t) + ridge @ w)
    want = 1 / (1 + np.exp(-np.c_[x, np.ones(600)] @ w))
    assert max(abs(p[i] - want[i]) for i in range(600)) < 1e-3
    r = fit.candidates.first()
    assert r.selected and r.eligible and r.sample_count == 200


def test_logits_of_all_feature_sets_read_rows_prepared_once(data, monkeypatch):
    df, *_ = data
    train, tuning, sets = df.where("case_id < 400"), df.where("case_id >= 400"), {"T": ["a", "b"], "T_plus_AD": ["a", "b", "c"]}
    alone = {s: [r.asDict() for r in Y.fit_logit(train, tuning, cols).candidates.drop("feature_set").orderBy("candidate_id").collect()] for s, cols in sets.items()}
    made, widths = [], []
    plain, at_once = Y.assemble, Y.at_once
    monkeypatch.setattr(Y, "assemble", lambda m, f, keep: made.append(list(f)) or plain(m, f, keep))
    monkeypatch.setattr(Y, "at_once", lambda spark, fn, items, width: widths.append(width) or at_once(spark, fn, items, width))
    for most in (Y.SIDE_BY_SIDE, 399):
        monkeypatch.setattr(Y, "SIDE_BY_SIDE", most)
        fits = Y.fit_logits(train, tuning, sets)
        assert list(fits) == ["T", "T_plus_AD"]
        for s, f in fits.items():
            rows = f.candidates.orderBy("candidate_id").collect()
            assert {r.feature_set for r in rows} == {s} and sum(r.selected for r in rows) == 1
            for r, a in zip(rows, alone[s], strict=True):
                assert (r.candidate_id, r.iterations, r.selected, r.average_precision) == (a["candidate_id"], a["iterations"], a["selected"], a["average_precision"])
            assert Y.score_checks(f.score(df)).first().scored_rows == 600
    assert made[:2] == [["T", "T_plus_AD"]] * 2 and made.count(["T", "T_plus_AD"]) == 4 and widths == [4, 1]


def test_candidate_choice(spark):
    rows = [("f", "a", 0.50000, 0.30, 3, True), ("f", "b", 0.49995, 0.20, 2, True), ("f", "c", 0.49995, 0.20, 1, True), ("f", "d", 0.40, 0.01, 1, True),
            ("f", "e", 0.9, 0.01, 1, False)]
    df = spark.createDataFrame(rows, "family string, candidate_id string, average_precision double, log_loss double, complexity int, eligible boolean")
    got = {r.candidate_id: r for r in M.select_candidate(df, ["family"], "complexity").collect()}
    assert [k for k, r in got.items() if r.selected] == ["c"]
    assert got["a"].selection_reason == "ELIGIBLE_NOT_SELECTED" and got["d"].selection_reason == got["e"].selection_reason == "OUTSIDE_BAND_OR_INELIGIBLE"


# --- boosted trees ----------------------------------------------------------------------------------------------------

def plain_boost(x, y, tx, ty, keys, lay, used_of, setting, budget):
    """Boosting of one fit in plain numpy, node by node; returns margins of ``x`` and the tuning scores per round."""
    bins, tbins = lay.binned(x), lay.binned(tx)
    start = np.log(y.sum() / (len(y) - y.sum()))
    margin, tuned, scores, kept = np.full(len(y), start), np.full(len(ty), start), [], []
    best = (0, -1.0)
    for r in range(budget.rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h, bag = p - y, p * (1 - p), X.in_bag(keys, r, budget.seed, budget.subsample)
        used = used_of(r)

        def offer(rows):
            found = None
            for c in used:
                for cut in range(len(lay.cuts[c]) + 1):
                    for side in (False, True):
                        gone = bins[c, rows] == lay.missing[c]
                        go = np.where(gone, side, bins[c, rows] <= cut)
                        parts = [rows[go], rows[~go]]
                        if min(map(len, parts)) < setting.min_rows or min(h[q].sum() for q in parts) < budget.min_curvature:
                            continue
                        gain = round(sum(g[q].sum() ** 2 / (h[q].sum() + budget.ridge) for q in parts) - g[rows].sum() ** 2 / (h[rows].sum() + budget.ridge), 7)
                        if gain > 0 and (found is None or (gain, -side) > (found[0], -found[3])):
                            found = (gain, c, cut, side, *parts)
            return found

        value = lambda q: -budget.step * g[q].sum() / (h[q].sum() + budget.ridge)
        rules, open_nodes, leaves, made = {}, {0: offer(np.flatnonzero(bag))}, 1, 1
        values = {0: 0.0}
        while leaves < setting.leaves:
            level = sorted((n for n, o in open_nodes.items() if o), key=lambda n: (-open_nodes[n][0], n))[: setting.leaves - leaves]
            if not level:
                break
            for n in level:
                _, c, cut, side, lo, hi = open_nodes.pop(n)
                rules[n] = (c, cut, side, made, made + 1)
                values |= {made: value(lo), made + 1: value(hi)}
                open_nodes |= {made: lo, made + 1: hi}
                made, leaves = made + 2, leaves + 1
            if leaves < setting.leaves:
                open_nodes = {n: offer(o) if isinstance(o, np.ndarray) else o for n, o in open_nodes.items()}
        if not rules:
            break

        def leaf(b, k):
            n = 0
            while n in rules:
                c, cut, side, left, right = rules[n]
                n = left if (side if b[c, k] == lay.missing[c] else b[c, k] <= cut) else right
            return values[n]

        margin = margin + np.array([leaf(bins, k) for k in range(len(y))])
        tuned = tuned + np.array([leaf(tbins, k) for k in range(len(ty))])
        kept.append(margin)
        scores.append(K.ranked(K.counted(tuned, ty))[0])
        if scores[-1] > best[1]:
            best = (len(scores), scores[-1])
        if len(scores) - best[0] >= budget.patience:
            break
    return kept[best[0] - 1], best[0], scores


@pytest.mark.parametrize("rebase", [1000, 2])
def test_boosting_equals_plain_numpy(spark, data, rebase):
    rng = np.random.default_rng(3)
    df, x, y = data
    shown = x.round(1)
    shown[rng.random(x.shape) < 0.15] = np.nan
    kind = rng.integers(0, 3, 600)
    wide = np.c_[shown, kind == 0, kind == 1].astype(float)
    cols = ["a", "b", "c", "d", "e"]
    rows = [(i, int(y[i]), *[None if np.isnan(v) else float(v) for v in wide[i]]) for i in range(600)]
    frame = spark.createDataFrame(rows, "case_id long, target long, " + ", ".join(f"{c} double" for c in cols)).repartition(3)
    train, tuning = frame.where("case_id < 500"), frame.where("case_id >= 500")
    budget = X.Budget(rounds=9, patience=3, step=0.3, ridge=1.0, bins=12, every=2, rebase=rebase)
    settings, sets = (X.Setting("small", 4, 20), X.Setting("large", 7, 5)), {"T": cols[:2] + cols[3:], "T_plus_AD": cols}
    lay = X.layout(train, cols, budget.bins)
    found = X.boost(train, tuning, sets, settings, budget, lay=lay)
    assert [(f.feature_set, f.setting.name) for f, _ in found] == [(s, k.name) for s in sets for k in settings]
    for f, ensemble in found:
        allowed = np.isin(cols, sets[f.feature_set])

        def used_of(r):
            pick = np.random.default_rng([budget.seed, r]).permutation(np.flatnonzero(allowed))
            return sorted(pick[:max(1, round(budget.colsample * len(pick)))])

        want, best, scores = plain_boost(wide[:500].T, y[:500], wide[500:].T, y[500:], np.arange(500), lay, used_of, f.setting, budget)
        assert f.best == best and f.scores[:len(scores)] == pytest.approx(scores)
        assert np.allclose(ensemble.margin(wide[:500].T), want, atol=1e-9)


def test_trees_take_missing_values_and_are_saved(spark, data):
    df = data[0].withColumn("a", F.when(F.col("case_id") % 4 != 0, F.col("a")))
    budget = X.Budget(rounds=6, patience=2, every=2, step=0.3)
    fits = Y.fit_trees(df.where("case_id < 400"), df.where("case_id >= 400"), {"T": ["a", "b"], "T_plus_AD": ["a", "b", "c"]}, (X.Setting("small", 4, 20),), budget)
    assert list(fits) == ["T", "T_plus_AD"]
    for fit in fits.values():
        c = Y.score_checks(fit.score(df)).first()
        assert (c.scored_rows, c.scored_keys, c.invalid_scores) == (600, 600, 0)
        r = fit.candidates.first()
        assert fit.candidates.count() == 1 and r.selected and 0 < r.iterations <= r.rounds_executed <= 6 and r.sample_count == 200
    tree = (np.array([0, -1, -1]), np.zeros(3, int), np.array([True, False, False]), np.array([1, 0, 0]), np.array([2, 0, 0]), np.array([0.0, -1.0, 2.0]))
    e = X.Ensemble(["a"], 0.5, [tree], [np.array([0.0, 0.0, 0.0])])
    again = X.Ensemble.from_frame(e.to_frame(spark))
    x = np.array([[-1.0, 0.0, 1.0, np.nan]])
    assert e.margin(x).tolist() == again.margin(x).tolist() == [-0.5, -0.5, 2.5, -0.5]


def test_blocks_carry_margins_that_are_up_to_date(spark, data, monkeypatch):
    """No tree is applied again and again: with nothing remembered, a pass finds margins at most ``refresh`` rounds old."""
    monkeypatch.setattr(X, "REMEMBERED", -1)
    rng = np.random.default_rng(2)
    rows = spark.sparkContext.parallelize([(0, np.arange(50), (rng.random(50) < 0.5).astype(float), rng.integers(0, 4, (2, 50)).astype(np.uint8).tobytes())], 1)
    lay = X.Layout(["a", "b"], [np.array([0.0, 1.0])] * 2)
    fit = X.Fit(0, "T", X.SETTINGS[0], np.ones(2, bool), 0.1, X.Budget())
    fit.trees = [(np.array([0, -1, -1]), np.array([1, 0, 0]), np.zeros(3, bool), np.array([1, 0, 0]), np.array([2, 0, 0]), np.array([0.0, 0.5, -0.25]))] * 3
    blocks = rows.map(lambda r: X._Block(r, lay)).persist()
    block, = X._refreshed(blocks, "run", lay, [fit], None).collect()
    done, margin = block.margins[0]
    assert done == 3 and np.allclose(margin, 0.1 + 3 * np.where(block.bins[0] <= 1, 0.5, -0.25))
    monkeypatch.setattr(X, "route", None)
    assert X._margin(block, "other", lay, 0, fit.trees, (0, np.zeros(50))) is margin


def test_dense_and_sparse_counts_agree(data, monkeypatch):
    df = data[0].withColumn("d", F.when(F.col("case_id") % 3 != 0, (F.col("case_id") % 19 == 0).cast("double")))
    cols, budget = ["a", "b", "c", "d"], X.Budget(rounds=6, patience=6, every=3, refresh=2, step=0.3)
    lay, found = X.layout(df, cols, 20), []
    for share in (0.0, X.SPARSE, 2.0):
        monkeypatch.setattr(X, "SPARSE", share)
        (fit, e), = X.boost(df.where("case_id < 400"), df.where("case_id >= 400"), {"T": cols}, (X.Setting("small", 6, 20),), budget, lay=lay)
        found.append((fit.scores, [t[0].tolist() for t in e.trees], [t[1].tolist() for t in e.trees]))
    assert len(found[0][0]) == 6 and found[0] == found[1] == found[2]


def test_boosting_goes_on_from_earlier_trees(data):
    df, x, _ = data
    train, tuning, cols = df.where("case_id < 400"), df.where("case_id >= 400"), ["a", "b", "c"]
    lay, settings = X.layout(train, cols, 20), (X.Setting("small", 4, 20),)
    budget = X.Budget(rounds=6, patience=6, every=3)
    (whole, all_trees), = X.boost(train, tuning, {"T": cols}, settings, budget, lay=lay)
    (_, half), = X.boost(train, tuning, {"T": cols}, settings, X.Budget(rounds=3, patience=6, every=3), lay=lay)
    half.trees = whole.trees[:3]
    (more, joined), = X.boost(train, tuning, {"T": cols}, settings, budget, lay=lay, begin={("T", "small"): half})
    assert more.best == whole.best and np.allclose(joined.margin(x.T), all_trees.margin(x.T))


def test_many_trees_are_scored_in_one_map(spark):
    rng = np.random.default_rng(0)
    trees, limits = [], []
    for _ in range(1500):
        trees.append((np.array([0, 1, -1, -1, -1]), np.zeros(5, int), np.zeros(5, bool), np.array([1, 3, 0, 0, 0]), np.array([2, 4, 0, 0, 0]), rng.normal(0, 0.01, 5)))
        limits.append(rng.normal(size=5))
    e = X.Ensemble(["a", "b"], -1.0, trees, limits)
    df = spark.range(2000).selectExpr("id AS case_id", "id % 2 AS target", "sin(id) AS a", "cos(id) AS b")
    got = {r.case_id: r.pd for r in e.score(df, ["case_id"]).collect()}
    k = np.arange(2000)
    assert np.allclose([got[i] for i in k], 1 / (1 + np.exp(-e.margin(np.stack([np.sin(k), np.cos(k)])))), atol=1e-9)


def test_one_class_cannot_be_fitted(data):
    with pytest.raises(ValueError, match="both classes"):
        X.boost(data[0].withColumn("target", F.lit(0)), data[0], {"T": ["a"]}, budget=X.Budget(rounds=1))


def test_sums_are_added_by_executors_beyond_a_bound(spark, monkeypatch):
    from tallyloom.operators import blocks

    rdd = spark.sparkContext.parallelize(range(100), 8)
    plain = blocks.total(rdd, lambda v: sum(v), lambda a, b: a + b)
    monkeypatch.setattr(blocks, "COLLECTED", 2)
    assert blocks.total(rdd, lambda v: sum(v), lambda a, b: a + b) == plain == 4950


# --- perceptron -------------------------------------------------------------------------------------------------------

def test_stored_blocks_are_written_and_read_few_at_a_time(spark, monkeypatch):
    """A row is a whole block: a row group closes by its bytes, not after a hundred rows."""
    paths, plain = [], K.scratch_path
    monkeypatch.setattr(K, "scratch_path", lambda *a: paths.append(plain(*a)) or paths[-1])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        rows = K.store(spark.range(0, 8000, 1, 4).selectExpr("id AS case_id", "1 AS target", "id AS a"), ["a"], "wide", "case_id", "target",
                       lambda x: np.random.default_rng(int(x[0, 0])).bytes(1 << 20))
        assert rows.map(lambda r: (len(r[1]), len(r[3]))).distinct().collect() == [(50, 1 << 20)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    groups = [pq.ParquetFile(f).metadata.row_group(k) for f in pathlib.Path(paths[0].removeprefix("file:")).glob("part-*.parquet") for k in range(pq.ParquetFile(f).num_row_groups)]
    assert sum(g.num_rows for g in groups) == 160 and max(g.num_rows for g in groups) <= 18


def test_blocks_travel_compressed():
    rng = np.random.default_rng(3)
    bins = np.stack([rng.integers(0, 100, 5000), *(rng.random((40, 5000)) < 0.01)]).astype(np.uint8)
    for values in (bins, bins[:, :0], rng.random((2, 3))):
        assert bytes(K.opened(K.pressed(values), values.nbytes)) == values.tobytes()
    lay = X.Layout([f"c{k}" for k in range(41)], [np.arange(99.0), *[np.zeros(1)] * 40])
    block = X._Block((0, np.arange(5000), np.zeros(5000), K.pressed(bins)), lay)
    plain = X._Block((0, np.arange(5000), np.zeros(5000), bins.tobytes()), lay)
    packed = pickle.dumps(block)
    assert len(packed) < 0.6 * (len(pickle.dumps(plain)))
    assert np.array_equal(pickle.loads(packed).bins, bins) and np.array_equal(pickle.loads(pickle.dumps(plain)).bins, bins)


def test_gradient_equals_differences():
    rng = np.random.default_rng(5)
    net = N.Network(3, (4, 2))
    flat, x, y = net.begin(-1.0, 1), rng.normal(size=(20, 3)), (rng.random(20) < 0.4).astype(float)
    masks = [np.ones((20, 4)) * 1.25, np.ones((20, 2))]
    loss, g = net.gradient(flat, x, y, masks)
    for k in range(len(flat)):
        step = np.zeros_like(flat)
        step[k] = 1e-6
        assert abs((net.gradient(flat + step, x, y, masks)[0] - net.gradient(flat - step, x, y, masks)[0]) / 2e-6 - g[k]) < 1e-6
    plain = [np.ones((20, 4)), np.ones((20, 2))]
    z = net.logits(flat, x)
    assert abs(net.gradient(flat, x, y, plain)[0] - np.mean(np.log1p(np.exp(z)) - y * z)) < 1e-12 and loss > 0


def test_perceptron_equals_rounds_in_numpy(spark, data):
    df, x, y = data
    budget = N.Budget(hidden=(5, 3), epochs=4, patience=9, rate=0.01, batch=256)
    train = df.where("case_id < 400").repartition(4, "case_id")
    course, = N.fit(train, df.where("case_id >= 400"), {"T": ["a", "b", "c"]}, budget)
    rows = K.store(train, ["a", "b", "c"], "again", "case_id", "target", lambda v: v.astype(np.float32).tobytes())
    parts = rows.glom().collect()
    net = N.Network(3, (5, 3))
    state = N.State(net.begin(float(np.log(y[:400].sum() / (400 - y[:400].sum()))), budget.seed), *np.zeros((2, net.cuts[-1])))
    history = []
    for epoch in range(1, 5):
        ends = []
        for part in parts:
            s = N.State(state.weights.copy(), state.first.copy(), state.second.copy(), state.steps)
            for block, _, labels, packed in part:
                N.steps(net, s, np.frombuffer(packed, np.float32).reshape(3, -1).astype(float).T, labels, budget, max(64, 256 // len(parts)), [budget.seed, epoch, block])
            ends += [s] if s.rows else []
        share = np.array([s.rows for s in ends]) / 400
        state = N.State(*(sum(w * getattr(s, k) for w, s in zip(share, ends)) for k in ("weights", "first", "second", "steps")))
        z = net.logits(state.weights, x[400:].astype(np.float32).astype(float))
        history.append(K.ranked(K.counted(z, y[400:].astype(float)))[0])
    assert [h[2] for h in course.history] == pytest.approx(history) and course.best == 1 + int(np.argmax(history)) and course.executed == 4


def test_rounds_have_no_more_tasks_than_cores(spark, data, monkeypatch):
    """More stored partitions bring longer tasks, not smaller steps."""
    df, cores, seen = data[0], spark.sparkContext.defaultParallelism, []
    plain = N._round
    monkeypatch.setattr(N, "_round", lambda rows, work, width, budget, batch, epoch: seen.append((rows.getNumPartitions(), batch)) or plain(rows, work, width, budget, batch, epoch))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        course, = N.fit(df.where("case_id < 400").repartition(3 * cores, "case_id"), df.where("case_id >= 400"), {"T": ["a", "b", "c"]}, N.Budget(epochs=1))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert seen == [(cores, max(64, 4096 // cores))] and course.executed == 1


def test_perceptron_learns_and_scores(data):
    df = data[0]
    fits = Y.fit_mlp(df.where("case_id < 400"), df.where("case_id >= 400"), {"T": ["a", "b"], "T_plus_AD": ["a", "b", "c"]}, N.Budget(epochs=12, rate=0.01, batch=256))
    for fit in fits.values():
        assert Y.score_checks(fit.score(df)).first().invalid_scores == 0
        r = fit.candidates.first()
        assert r.roc_auc > 0.7 and r.selected and 0 < r.iterations <= r.rounds_executed


def test_a_fit_that_diverges_is_not_eligible(data):
    df = data[0].withColumn("c", F.lit(1e300) * F.col("c"))
    train, tuning = df.where("case_id < 400"), df.where("case_id >= 400")
    fits = Y.fit_mlp(train, tuning, {"T": ["a", "b"], "T_plus_AD": ["a", "b", "c"]}, N.Budget(epochs=2, batch=256))
    good, bad = fits["T"].candidates.first(), fits["T_plus_AD"].candidates.first()
    assert good.eligible and good.selected and not bad.eligible and not bad.selected and bad.log_loss is None and fits["T_plus_AD"].score is None
    lost = Y.fit_mlp(train, tuning, {"T_plus_AD": ["a", "b", "c"]}, N.Budget(epochs=2, batch=256))["T_plus_AD"]
    assert not lost.candidates.first().eligible


def test_patience_counts_small_gains_as_none():
    p = N.Patience(2, 0.01)
    assert p.goes_on(1, 0.5, 1.0) and p.goes_on(2, 0.505, 1.0) and not p.goes_on(3, 0.505, 0.9) and p.epoch == 3


def test_prediction_merge_reports_defects(spark):
    a = spark.createDataFrame([(1, 0, 0.1), (2, 1, 0.2)], "case_id long, target long, pd double")
    b = spark.createDataFrame([(1, 1, 0.1), (3, 1, 1.2)], "case_id long, target long, pd double")
    _, checks = M.join_predictions([a, b], "case_id", "target", ["x", "y"])
    r = checks.first()
    assert (r.row_count, r.incomplete_rows, r.label_conflicts, r.out_of_bounds_rows) == (3, 2, 1, 1)
