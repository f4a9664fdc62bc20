import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallyloom.sources import catalog as C, io
from tallyloom.session import freeze, shared_dir


def test_csv_sink_drops_non_finite(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), "x"), (2, float("inf"), None), (3, 1.5, "z")], "k long, v double, s string")
    io.write_csv(df, str(tmp_path / "c"), ["s", "v", "k"])
    text = sorted(x for f in (tmp_path / "c").glob("part-*") for x in f.read_text().splitlines())
    assert "s,v,k" in text and "x,,1" in text and "z,1.5,3" in text
    with pytest.raises(Exception):
        io.write_csv(df, str(tmp_path / "c"), ["s"])


def test_role_filter_reaches_the_scan(spark, tmp_path, capsys):
    path = str(tmp_path / "p")
    io.write_parquet(spark.range(10).select("id", F.when(F.col("id") < 5, "a").otherwise("b").alias("role"), F.lit(1).alias("wide")), path)
    df = io.read_role(spark, path, ["id"], "role", "a")
    assert df.count() == 5
    df.explain()
    plan = capsys.readouterr().out
    assert "EqualTo(role,a)" in plan and "wide" not in plan.split("ReadSchema")[1]


def test_file_names(spark):
    names = ["train_base.parquet", "train_applprev_1_0.parquet", "train_static_cb_0.parquet", "odd.parquet"]
    got = {r.file_name: r for r in C.parse_file_names(spark.createDataFrame([(n,) for n in names], "f string"), "f").collect()}
    assert got[names[0]].naming_status == "BASE" and got[names[3]].naming_status == "UNEXPECTED_PATTERN"
    assert (got[names[1]].table_group, got[names[1]].depth, got[names[1]].shard) == ("train_applprev_1", 1, 0)
    assert (got[names[2]].table_group, got[names[2]].depth, got[names[2]].shard) == ("train_static_cb_0", 0, None)


def test_mentions_need_exact_tokens(spark):
    blocks = spark.createDataFrame([(1, "a", "use amount_416A, not amount_416AB"), (2, "b", "case_id  x annuity."), (3, "b", "annuityx")], "doc_id long, loc string, text string")
    names = spark.createDataFrame([("annuity",)], "field_name string")
    found = C.mentions(blocks, "text", names, ["doc_id", "loc"])
    got = {(r.doc_id, r["name"]): r.excerpt for r in found.collect()}
    assert set(got) == {(1, "amount_416A"), (2, "case_id"), (2, "annuity")}
    assert got[(2, "annuity")] == "case_id x annuity."


def test_excerpt_window(spark):
    text = "w " * 300 + "debt " + "v " * 300
    blocks = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = C.mentions(blocks, "text", spark.createDataFrame([("debt",)], "field_name string"), ["doc_id"]).first()
    at = text.index("debt")
    want = "…" + " ".join(text[at - 120: at + 124].split()) + "…"
    assert r.excerpt == want[:240]


def test_three_first_different_excerpts(spark):
    found = spark.createDataFrame([("n", i, "s", e) for i, e in enumerate(["b", "a", "b", "c", "d"])], "name string, doc_id long, loc string, excerpt string")
    r = C.mine_identifiers(found, "loc", "doc_id").first()
    assert r.contexts == "b || a || c" and r.text_count == 5 and r.location_count == 1


def test_direct_load_rejects_orphans(spark, tmp_path):
    spine = spark.createDataFrame([(1,), (2,)], "case_id long")
    path = str(tmp_path / "train_x_0.parquet")
    io.write_parquet(spark.createDataFrame([(9, 1.0)], "case_id long, v double"), path)
    with pytest.raises(Exception, match="unknown key"):
        io.load_direct(spark, spine, [path], "case_id", ["v"]).collect()


def test_checkpoints_use_the_shared_folder(spark):
    folder = shared_dir(spark)
    assert freeze(spark.range(5)).count() == 5
    assert spark.sparkContext.getCheckpointDir() and folder


def test_footers_of_many_files_in_one_job(spark, tmp_path):
    for k in range(40):
        cols = ["id", "a"] if k % 2 else ["a", "id", "b"]
        spark.range(k).selectExpr("id", "cast(id as double) a", "string(id) b").select(cols).coalesce(1).write.parquet(f"{tmp_path}/t_{k:02d}.parquet")
    paths = [f"{tmp_path}/t_{k:02d}.parquet" for k in range(40)]
    inv = {r.file_name: r for r in C.file_inventory(spark, paths).collect()}
    assert len(inv) == 40 and all(inv[f"t_{k:02d}.parquet"].physical_rows == k for k in range(40))
    assert inv["t_03.parquet"].column_names == "id,a" and inv["t_04.parquet"].column_names == "a,id,b" and inv["t_04.parquet"].file_bytes > 0
    kinds = {(r.position, r.name): r.dtype for r in C.schema_rows(spark, paths).where("file_name = 't_04.parquet'").collect()}
    assert kinds == {(0, "a"): "double", (1, "id"): "bigint", (2, "b"): "string"}
    both = io.read_small_group(spark, paths, ["id", "b"])
    assert both.count() == sum(range(40)) and both.where("b IS NULL").count() == sum(range(1, 40, 2))
    with pytest.raises(ValueError):
        io.footers(spark, [])


def test_footer_types_are_those_of_the_reader(spark, tmp_path):
    df = spark.sql("SELECT 1Y a, 2S b, 3 c, 4L d, 1.5F e, 2.5D f, 1.25BD g, true h, 'x' i, date'2020-01-01' j, timestamp'2020-01-01 00:00:00' k, array(1) l, named_struct('m', 1) n, X'01' o")
    df.write.parquet(f"{tmp_path}/kinds.parquet")
    got = {r.name: r.dtype for r in C.schema_rows(spark, [f"{tmp_path}/kinds.parquet"]).collect()}
    assert got == {f.name: f.dataType.simpleString() for f in spark.read.parquet(f"{tmp_path}/kinds.parquet").schema}
    table = pa.table({"a": pa.array([1], pa.int16()), "t": pa.array([0], pa.timestamp("us")), "z": pa.array([0], pa.timestamp("us", "UTC")), "s": ["x"]})
    (tmp_path / "plain.parquet").mkdir()
    pq.write_table(table, f"{tmp_path}/plain.parquet/part-0.parquet")
    got = {r.name: r.dtype for r in C.schema_rows(spark, [f"{tmp_path}/plain.parquet"]).collect()}
    assert got == {f.name: f.dataType.simpleString() for f in spark.read.parquet(f"{tmp_path}/plain.parquet").schema}
