import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import levels as V, prep as X, split as P


def labelled(spark, zeros, ones):
    return spark.range(zeros + ones).select(F.col("id").alias("k"), (F.col("id") >= zeros).cast("long").alias("y"))


def test_split_counts_are_exact(spark):
    s = P.make_splits(labelled(spark, 970, 30), "k", "y", 1).cache()
    n = {(r.outer_split, r.validation_role, r.y): r.n for r in s.groupBy("outer_split", "validation_role", "y").agg(F.count("*").alias("n")).collect()}
    for y, size in ((0, 970), (1, 30)):
        ev = round(size * 0.15)
        val = round((size - ev) * (15 / 85))
        cal = round(val * 0.5)
        assert n[("evaluation", None, y)] == ev and n[("validation", "validation_calibration", y)] == cal
        assert n[("validation", "validation_tuning", y)] == val - cal and n[("train", None, y)] == size - ev - val
    again = P.make_splits(labelled(spark, 970, 30).repartition(9), "k", "y", 1)
    assert s.exceptAll(again.select(s.columns)).count() == 0
    assert P.make_splits(labelled(spark, 970, 30), "k", "y", 2).join(s.select("k", F.col("outer_split").alias("o")), "k").where("o <> outer_split").count() > 0


def test_split_equals_the_ranked_order_without_ranking_all_rows(spark, monkeypatch):
    """The same members as row numbers give, found without a range shuffle of the rows; few, equal and missing labels included."""
    monkeypatch.setattr(P, "running", None)
    df = spark.range(3000).select(F.col("id").alias("k"), F.expr("CASE WHEN id < 2900 THEN 0 WHEN id < 2980 THEN 1 WHEN id < 2982 THEN 2 END").alias("y"))
    df.createOrReplaceTempView("split_source")
    want = {(r.k, r.outer_split, r.validation_role) for r in spark.sql("""
        SELECT k, CASE WHEN rn <= e THEN 'evaluation' WHEN rn <= e + v THEN 'validation' ELSE 'train' END AS outer_split,
               CASE WHEN rn > e AND rn <= e + v THEN CASE WHEN rn <= e + bround(v * 0.5D, 0) THEN 'validation_calibration' ELSE 'validation_tuning' END END AS validation_role
        FROM (SELECT *, bround((n - e) * (15D / 85D), 0) AS v FROM (SELECT *, bround(n * 0.15D, 0) AS e FROM (
            SELECT k, row_number() OVER (PARTITION BY y ORDER BY md5(concat('s|', k)), k) AS rn, count(*) OVER (PARTITION BY y) AS n FROM split_source)))""").collect()}
    got = P.make_splits(df, "k", "y", "s")
    assert got.columns == ["k", "y", "outer_split", "validation_role"]
    assert {(r.k, r.outer_split, r.validation_role) for r in got.collect()} == want and len(want) == 3000
    for digits in (0, 1, 32):
        monkeypatch.setattr(P, "COUNTED_DIGITS", digits)
        assert {(r.k, r.outer_split, r.validation_role) for r in P.make_splits(df, "k", "y", "s").collect()} == want
    monkeypatch.setattr(P, "BROADCAST_OFFSETS", 0)
    assert {(r.k, r.outer_split, r.validation_role) for r in P.make_splits(df, "k", "y", "s").collect()} == want


def test_folds_are_balanced(spark):
    f = P.fold_summary(P.common_folds(labelled(spark, 52, 13), "k", "y", 5, "s"), "y").collect()
    assert sorted(r.positive_count for r in f) == [2, 2, 3, 3, 3] and sum(r.row_count for r in f) == 65


def spec(**kw):
    base = dict(numeric=("t_a", "ad_m", "ad_x"), monetary=("ad_m", "ad_x"), log_only=(), clip_negative=("ad_m", "ad_x"), categories=("c",), flags=("f",),
                first=("t_a",), siblings=(("ad", ("ad_m", "ad_x")),))
    return X.PrepSpec(**{**base, **kw})


@pytest.fixture
def frame(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(100):
        miss = i % 5 == 0
        rows.append((i, "train" if i < 70 else "evaluation", float(rng.uniform(0, 100)), None if miss else float(rng.normal(20, 30)),
                     None if miss else float(rng.normal(30, 30)), [None, "x", "y"][i % 3] if i < 90 else "new", i % 2))
    return spark.createDataFrame(rows, "k long, s string, t_a double, ad_m double, ad_x double, c string, f long")


def test_fit_equals_numpy(frame):
    p = X.fit(frame, spec(), F.expr("s = 'train'"))
    train = frame.where("s = 'train'").toPandas()
    for c in ("ad_m", "ad_x"):
        v = train[c].dropna().clip(lower=0).to_numpy()
        cap = np.quantile(v, 0.999)
        logged = np.log1p(np.minimum(v, cap))
        filled = np.concatenate([logged, np.full(train[c].isna().sum(), np.median(logged))])
        assert p.caps[c]["cap"] == pytest.approx(cap) and p.medians[c] == pytest.approx(np.median(logged))
        assert p.means[c] == pytest.approx(filled.mean()) and p.scales[c] == pytest.approx(filled.std())
    assert p.medians["t_a"] == pytest.approx(np.median(train.t_a))
    assert [m["name"] for m in p.missing_flags] == ["missing_ad"]
    assert p.vocabularies["c"] == ["x", "y", X.MISSING, X.UNSEEN]


def test_transform_layout_and_reload(spark, frame, tmp_path):
    p = X.fit(frame, spec(), F.expr("s = 'train'"))
    cols = p.output_columns()
    assert cols[: p.base_width()] == ["t_a", *[n for _, n in p.level_columns("c")]]
    lin = p.transform(frame, "linear_nn", ["k"])
    tree = p.transform(frame, "gbdt", ["k"])
    assert lin.where(" OR ".join(f"{c} IS NULL" for c in cols)).count() == 0
    assert tree.where("ad_m IS NULL").count() == 20 and dict(tree.dtypes)["ad_m"] == "float"
    hot = [n for _, n in p.level_columns("c")]
    assert {r[0] for r in lin.select(sum((F.col(h).cast("int") for h in hot), F.lit(0))).collect()} == {1}
    assert lin.where(f"{X.level_name('c', X.UNSEEN)} = 1").count() == 10
    path = str(tmp_path / "prep")
    p.save(spark, path)
    assert X.Preprocessor.load(spark, path) == p


def test_sparse_cap_uses_finite_values_only(spark):
    df = spark.createDataFrame([(i, float(i) if 1 <= i <= 10 else None) for i in range(100)], "k long, v double")
    df = df.withColumn("c", F.lit("a"))
    p = X.fit(df, X.PrepSpec(numeric=("v",), monetary=("v",), log_only=(), clip_negative=(), categories=("c",), flags=(), first=("v",)), F.lit(True))
    assert p.caps["v"]["n"] == 10 and p.caps["v"]["cap"] == pytest.approx(np.quantile(np.arange(1, 11), 0.999))


def test_contract_violations(spark, frame):
    with pytest.raises(ValueError, match="negative"):
        X.fit(frame, spec(clip_negative=("ad_m",)), F.expr("s = 'train'"))
    uneven = frame.withColumn("ad_x", F.when(F.col("k") == 3, None).otherwise(F.col("ad_x")))
    with pytest.raises(ValueError, match="sibling"):
        X.fit(uneven, spec(), F.expr("s = 'train'"))
    with pytest.raises(ValueError, match="reserved"):
        X.fit(frame.withColumn("c", F.lit(X.MISSING)), spec(), F.expr("s = 'train'"))


def test_all_missing_and_degenerate_columns(spark):
    df = spark.createDataFrame([(i, None, 0.0 if i < 5000 else 1.0, 7.0, "a") for i in range(5001)], "k long, a double, b double, d double, c string")
    s = X.PrepSpec(numeric=("a", "b", "d"), monetary=("a", "b"), log_only=(), clip_negative=(), categories=("c",), flags=(), first=("a",))
    p = X.fit(df, s, F.lit(True))
    assert p.caps["a"]["status"] == "TRAIN_ALL_MISSING" and p.all_missing == ["a"]
    assert p.caps["b"]["status"] == "CAP_SKIPPED_DEGENERATE_ZERO" and p.caps["b"]["cap"] is None
    assert "d" in p.constant and p.scales["d"] == 1.0


# --- categories as sparse vectors ---------------------------------------------------------------------------------

def test_sparse_vectors_equal_the_wide_columns(spark, frame, monkeypatch):
    p = X.fit(frame, spec(), F.expr("s = 'train'"))
    odd = frame.unionByName(frame.limit(2).withColumn("k", F.col("k") + 1000).withColumn("c", F.when(F.col("k") % 2 == 0, X.MISSING).otherwise(X.UNSEEN)))
    index = V.level_index(frame.where("s = 'train'"), ["c"])
    assert [(r.level, r.position) for r in index.orderBy("position").collect()] == [("x", 0), ("y", 1), (X.MISSING, 2), (X.UNSEEN, 3)]
    names = {r.level: r.output_name for r in V.names_of(index).collect()}
    assert names == {level: name for level, name in p.level_columns("c")}
    wide = {r.k: [float(r[c]) for c in p.output_columns()] for r in p.transform(odd, "linear_nn", ["k"]).collect()}
    base, whole = V.vector_inputs(p)
    for limit in (100_000, 1):  # with the table broadcast, and by a shuffled join
        monkeypatch.setattr(V, "BROADCAST_LEVELS", limit)
        rows = V.encoded(odd, p, index, "linear_nn", ["k"])
        got = {r.k: r.features.toArray().tolist() for r in V.assemble(rows, whole, ["k"]).collect()}
        assert got.keys() == wide.keys() and all(np.allclose(got[k], wide[k]) for k in got)
        first = {r.k: r.features.toArray().tolist() for r in V.assemble(rows, base, ["k"]).collect()}
        assert all(np.allclose(first[k], wide[k][:p.base_width()]) for k in first)


def test_a_million_levels(spark):
    rows = spark.range(1_000_000).selectExpr("id AS k", "cast(id % 7 AS double) AS t_a", "cast(1 AS double) AS ad_m", "cast(1 AS double) AS ad_x", "concat('v', id) AS c", "id % 2 AS f")
    p = X.fit(rows.where("k < 20000"), spec(), F.lit(True))
    assert p.vocabularies == {}
    with pytest.raises(ValueError, match="levels.encoded"):
        p.output_columns()
    index = V.level_index(rows, ["c"])
    assert V.widths(index) == {"c": 1_000_002}
    some = rows.where("k % 50000 = 0").unionByName(rows.limit(1).withColumn("c", F.lit("never")))
    got = V.assemble(V.encoded(some, p, index, "linear_nn", ["k"]), V.vector_inputs(p)[1], ["k"]).collect()
    order = sorted(f"v{k}" for k in range(1_000_000))
    for r in got:
        size, set_at = r.features.size, [int(i) for i in r.features.indices if 1 <= i < 1_000_003]
        assert size == 1_000_002 + 4 and len(set_at) == 1
    places = {r.k: [int(i) - 1 for i in r.features.indices if 1 <= i < 1_000_003][0] for r in got if r.k != 0}
    assert all(order[at] == f"v{k}" for k, at in places.items())
    assert 1_000_001 in [int(i) - 1 for r in got if r.k == 0 for i in r.features.indices]


def test_reserved_levels_and_empty_categories(spark):
    with pytest.raises(ValueError, match="reserved"):
        V.level_index(spark.createDataFrame([(X.UNSEEN,)], "c string"), ["c"])
    nothing = V.level_index(spark.createDataFrame([(None, "a")], "c string, d string"), ["c", "d"])
    assert V.widths(nothing) == {"c": 2, "d": 3}


def test_trace_finds_first_rows_before_it_spells_them_out(spark, monkeypatch):
    """The first row of a reason is found by one aggregate; only such rows are exploded."""
    spec = X.PrepSpec(numeric=("v",), monetary=("v",), log_only=(), clip_negative=("v",), categories=(), flags=(), first=("v",))
    rows = [(k, 100 - k, None if k % 5 == 0 else float(k % 7 - 1)) for k in range(100)]
    df = spark.createDataFrame(rows, "k long, o long, v double")
    p = X.Preprocessor(spec, caps={"v": {"cap": 4.0}}, medians={"v": 1.0}, means={"v": 0.0}, scales={"v": 1.0})
    seen = []
    join = type(df).join
    monkeypatch.setattr(type(df), "join", lambda *a: seen.append(join(*a)) or seen[-1])
    got = {(r.input_column, r.reason): (r.k, r.original_value) for r in X.transform_trace(df, p, "k", "o").collect()}
    last = lambda ok: max((k, v) for k, _, v in rows if ok(v))  # the smallest order is the largest key
    want = {("v", "negative_clipped"): last(lambda v: v is not None and v < 0), ("v", "upper_clipped"): last(lambda v: v is not None and v > 4),
            ("v", "observed_zero_kept"): last(lambda v: v == 0), ("v", "missing_filled_for_linear"): (95, None)}
    assert got == want
    assert len(seen) == 1 and seen[0].count() <= 4


def test_missing_flags_need_no_fit(spark):
    spec = X.PrepSpec(numeric=("a", "b", "c", "d"), monetary=(), log_only=(), clip_negative=(), categories=(), flags=(), first=("a",), siblings=(("bc", ("b", "c")),))
    df = spark.createDataFrame([(1.0, None, None, 1.0), (None, 2.0, 2.0, 1.0)], "a double, b double, c double, d double")
    flags = X.missing_flags(X.column_counts(df, spec), spec)
    assert [(m["name"], m["columns"], m["first"]) for m in flags] == [("missing_a", ["a"], True), ("missing_bc", ["b", "c"], False)]
    with pytest.raises(ValueError, match="differ in their missing rows"):
        X.column_counts(df.withColumn("c", F.lit(1.0)), spec)
