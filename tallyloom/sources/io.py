"""Readers and writers."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pa_fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import DoubleType, FloatType, StructType
from pyspark.sql.utils import AnalysisException

from ..operators.joins import align
from ..session import importable

FILE = "__file"
# the table a part file belongs to: the folder Spark wrote, or the file itself
_TABLE_NAME = r"([^/]+\.parquet)(/part-[^/]+)?$"


def table_name(path: Column) -> Column:
    return F.regexp_extract(path, _TABLE_NAME, 1)


def table_file(path: str) -> str:
    return path.rstrip("/").split("/")[-1]


def read_group(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """Column-projected scan of several shards, each row tagged with its file."""
    if not paths:
        raise ValueError("no shards given")
    return spark.read.parquet(*paths).select(*columns, table_name(F.col("_metadata.file_path")).alias(FILE))


def _uri(path: str) -> str:
    return path if "://" in path else "file://" + path.removeprefix("file:")


def _fields(meta: pq.FileMetaData) -> list[tuple[str, str]]:
    """Names and Spark types of a file's columns: as its writer noted them, else as Spark reads the file's own types."""
    noted = (meta.metadata or {}).get(b"org.apache.spark.sql.parquet.row.metadata")
    if noted:
        return [(f.name, f.dataType.simpleString()) for f in StructType.fromJson(json.loads(noted))]
    old = {meta.schema.column(k).path for k in range(meta.num_columns) if meta.schema.column(k).physical_type == "INT96"}
    return [(f.name, from_arrow_type(f.type, prefer_timestamp_ntz=f.name not in old).simpleString()) for f in meta.schema.to_arrow_schema()]


def footers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per file below ``paths``: path, table file, bytes, rows, row groups and columns (name, Spark type).

    Spark lists the files; executors open each file's footer alone, whatever the number of files.
    """
    if not paths:
        raise ValueError("no files given")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(list(paths)).select("path", F.col("length").alias("bytes"))
    importable(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("name", pa.string()), ("dtype", pa.string())]))
        for b in batches:
            rows, groups, columns = [], [], []
            for path in b.column("path").to_pylist():
                fs, inner = pa_fs.FileSystem.from_uri(_uri(path))
                with fs.open_input_file(inner) as f:
                    meta = pq.read_metadata(f)
                rows.append(meta.num_rows)
                groups.append(meta.num_row_groups)
                columns.append([{"name": n, "dtype": t} for n, t in _fields(meta)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, pa.int64()), pa.array(groups, pa.int64()), pa.array(columns, kind)], ["path", "bytes", "rows", "row_groups", "columns"])

    # many small reads: files are dealt out, not read where they happen to be listed
    dealt = files.repartition("path")
    found = dealt.mapInArrow(run, "path string, bytes bigint, rows bigint, row_groups bigint, columns array<struct<name: string, dtype: string>>")
    return found.withColumn("file_name", table_name(F.col("path")))


def read_small_group(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """Union by name of shards whose schemas may differ; absent columns become NULL.

    Shards with equal columns are one scan, so the plan grows with the number of different schemas only.
    """
    alike: dict[str, list[str]] = {}
    names = {table_file(p): p for p in paths}
    kinds = footers(spark, paths).groupBy("file_name").agg(F.min(F.to_json("columns")).alias("kind")).collect()  # one row a shard, as in ``paths``
    for r in sorted(kinds, key=lambda r: r["file_name"]):
        alike.setdefault(r["kind"], []).append(names[r["file_name"]])
    out = None
    for group in alike.values():
        df = spark.read.parquet(*group)
        df = df.select(*[c for c in columns if c in df.columns])
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out.select(*columns)


def load_direct(spark: SparkSession, spine: DataFrame, paths: list[str], key: str, fields: list[str]) -> DataFrame:
    """One-to-one source aligned to the spine; null, repeated or unknown keys fail the job."""
    src = read_group(spark, paths, [key, *fields]).drop(FILE)
    known = spine.select(key, F.lit(1).alias("__known"))
    checked = src.join(known, key, "left").withColumn(
        key, F.when(F.col(key).isNull(), F.raise_error(F.lit("null key in one-to-one source")))
        .when(F.col("__known").isNull(), F.raise_error(F.lit("unknown key in one-to-one source"))).otherwise(F.col(key)))
    return align(spine, checked.drop("__known"), key)


def read_role(spark: SparkSession, path: str, columns: list[str], role_column: str, role: str) -> DataFrame:
    """Role-filtered read; the filter reaches the scan (or prunes partitions)."""
    return spark.read.parquet(path).where(F.col(role_column) == role).select(*columns)


def read_members(spark: SparkSession, path: str, members: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Ordered columns of the rows whose key is a member."""
    return spark.read.parquet(path).join(members.select(key), key, "left_semi").select(key, *columns)


def member_checks(rows: DataFrame, members: DataFrame, key: str, columns: list[str], nulls_allowed: bool = False) -> DataFrame:
    """Every member once, no stranger, and finite values."""
    bad = F.lit(False)
    for c in columns:
        v = F.col(c).cast("double")
        odd = F.isnan(v) | v.isin(float("inf"), float("-inf"))
        bad = bad | F.coalesce(odd, F.lit(False)) | (F.lit(not nulls_allowed) & v.isNull())
    per = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(bad.cast("bigint")).alias("bad"))
    j = members.select(key, F.lit(1).alias("m")).join(per, key, "full_outer")
    c = lambda cond: F.count(F.when(cond, 1))
    return j.agg(
        c(F.col("m").isNotNull()).alias("members"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows_read"), c(F.col("n").isNull()).alias("missing_members"),
        c(F.col("m").isNull()).alias("unknown_rows"), c(F.col("n") > 1).alias("repeated_members"), F.coalesce(F.sum("bad"), F.lit(0)).alias("invalid_rows"))


def read_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """CSV with a header and an explicit schema (decimals stay exact; a byte-order mark is skipped)."""
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=True, mode="FAILFAST")


def finite_or_null(df: DataFrame) -> DataFrame:
    floats = {f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))}
    odd = lambda c: F.isnan(c) | F.col(c).isin(float("inf"), float("-inf"))
    return df.select(*[F.when(~odd(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def write_csv(df: DataFrame, path: str, headers: list[str]) -> None:
    """Fixed column order; NaN and infinities become empty cells.  Refuses to overwrite."""
    finite_or_null(df).select(*headers).write.mode("errorifexists").csv(path, header=True, nullValue="", emptyValue="")


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """zstd Parquet; refuses to overwrite."""
    w = df.write.mode("errorifexists").option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def refuses_overwrite(df: DataFrame, path: str) -> bool:
    try:
        write_parquet(df, path)
    except AnalysisException:
        return True
    return False
