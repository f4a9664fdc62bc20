"""Scans, sources, sinks and catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import states as S
from ..operators import audit as A, prep as X
from ..session import scratch_path
from ..sources import catalog as C, io
from .group_d2 import split_of
from .group_i import SPEC, TRAIN, split_rows
from .registry import TABLES, query
from .sqlviews import NUM


def child_shards(t) -> list[str]:
    """The 1:n source written as three shard files."""
    root, paths, child = scratch_path(t.spark, "shards"), [], t.child
    for i in range(3):
        paths.append(f"{root}/train_child_1_{i}.parquet")
        io.write_parquet(child.where(F.col("shard") == f"shard_{i}"), paths[-1])
    return paths


@query(
    "a01_scan_projected",
    """SELECT concat('train_child_1_', right(shard, 1), '.parquet') AS file_name, count(*) AS row_count, count(case_id) AS keyed_rows,
              round(sum(amount), 2) AS amount_sum FROM child GROUP BY shard""",
)
def _(t):
    df = io.read_group(t.spark, child_shards(t), ["case_id", "amount"])
    return df.groupBy(F.col(io.FILE).alias("file_name")).agg(
        F.count(F.lit(1)).alias("row_count"), F.count("case_id").alias("keyed_rows"), F.round(F.sum("amount"), 2).alias("amount_sum"))


@query(
    "a02_load_direct",
    """SELECT s.case_id, stated_count, stated_sum, CAST(CASE WHEN m.case_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS source_rows
       FROM spine s LEFT JOIN summary m ON m.case_id = s.case_id""",
)
def _(t):
    root = scratch_path(t.spark, "direct")
    paths = [f"{root}/train_static_0_{i}.parquet" for i in range(2)]
    for i, p in enumerate(paths):
        io.write_parquet(t.summary.where(F.col("case_id") % 2 == i), p)
    return io.load_direct(t.spark, t.spine.select("case_id"), paths, "case_id", ["stated_count", "stated_sum"])


@query(
    "a03_small_group_union",
    """SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS row_count,
              (SELECT count(*) FROM customer) AS with_segment, (SELECT round(sum(c_acctbal), 2) FROM customer) + (SELECT round(sum(s_acctbal), 2) FROM supplier) AS balance""",
)
def _(t):
    root = scratch_path(t.spark, "small")
    a, b = f"{root}/train_party_1_0.parquet", f"{root}/train_party_1_1.parquet"
    io.write_parquet(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")), a)
    io.write_parquet(t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")), b)
    df = io.read_small_group(t.spark, [a, b], ["id", "balance", "segment"])
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.count("segment").alias("with_segment"), F.round(F.sum("balance"), 2).alias("balance"))


@query(
    "a04_mergeable_scan",
    """SELECT count(*) AS row_count, count(amount) AS finite_count, count(*) FILTER (WHERE amount <> 0) AS nonzero_count, round(sum(amount), 2) AS amount_sum,
              max(amount) AS amount_max, count(DISTINCT case_id) AS entities FROM detail""",
)
def _(t):
    per = A.per_entity(t.detail, "case_id", ["amount"])
    return per.agg(
        F.sum("source_rows").alias("row_count"), F.sum("amount__finite").alias("finite_count"), F.sum("amount__nonzero").alias("nonzero_count"),
        F.round(F.sum("amount__sum"), 2).alias("amount_sum"), F.max("amount__max").alias("amount_max"), F.count(F.lit(1)).alias("entities"))


@query("a05_role_filtered_labels", "SELECT case_id, target FROM split WHERE validation_role = 'validation_tuning'")
def _(t):
    path = scratch_path(t.spark, "manifest")
    io.write_parquet(split_of(t), path, ["outer_split"])
    rows = t.spark.read.parquet(path).where("outer_split = 'validation'")
    return rows.where("validation_role = 'validation_tuning'").select("case_id", "target")


@query("a06_member_matrix", "SELECT case_id, " + ", ".join(f"round(CAST(CAST({c}__z AS FLOAT) AS DOUBLE), 4) AS {c}" for c in NUM)
       + " FROM prep_scaled WHERE validation_role = 'validation_tuning'")
def _(t):
    rows = split_rows(t)
    p = X.fit(rows, SPEC, F.expr(TRAIN))
    path = scratch_path(t.spark, "matrix")
    io.write_parquet(p.transform(rows, "linear_nn", ["case_id"]), path)
    members = split_of(t).where("validation_role = 'validation_tuning'")
    m = io.read_members(t.spark, path, members, "case_id", p.output_columns())
    return m.select("case_id", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in NUM])


@query(
    "a06_member_checks",
    """SELECT count(*) AS members, count(*) AS rows_read, 0::BIGINT AS missing_members, 0::BIGINT AS unknown_rows, 0::BIGINT AS repeated_members,
              (SELECT count(*) FROM split_rows WHERE validation_role = 'validation_tuning' AND (t_income IS NULL OR t_dpd IS NULL)) AS invalid_rows
       FROM split WHERE validation_role = 'validation_tuning'""",
)
def _(t):
    members = split_of(t).where("validation_role = 'validation_tuning'")
    path = scratch_path(t.spark, "features")
    io.write_parquet(t.features, path)
    cols = ["t_age", "t_income", "t_dpd"]
    return io.member_checks(io.read_members(t.spark, path, members, "case_id", cols), members, "case_id", cols)


@query("a07_raw_member_rows", "SELECT case_id, t_income, t_dpd, t_priority FROM split_rows WHERE outer_split = 'evaluation'")
def _(t):
    path = scratch_path(t.spark, "raw")
    io.write_parquet(t.features, path)
    members = split_of(t).where("outer_split = 'evaluation'")
    return io.read_members(t.spark, path, members, "case_id", ["t_income", "t_dpd", "t_priority"])


@query(
    "a08_csv_decimals",
    "SELECT CAST(o_orderkey AS BIGINT) AS k, CAST(CAST(o_orderkey % 8001 AS DECIMAL(12, 2)) / 100 AS DECIMAL(12, 2))::DOUBLE * 100 AS rate_bp FROM orders",
)
def _(t):
    path = scratch_path(t.spark, "grid_csv")
    rate = (F.col("o_orderkey") % 8001).cast("decimal(12,2)") / 100
    # a leading byte-order mark, as spreadsheet exports write it
    df = t.orders.select(F.col("o_orderkey").alias("\ufeffk"), rate.cast("decimal(12,2)").alias("rate"))
    df.write.mode("errorifexists").csv(path, header=True)
    back = io.read_csv(t.spark, path, "k bigint, rate decimal(12,2)")
    return back.select("k", (F.col("rate").cast("double") * 100).alias("rate_bp"))


@query("a09_parquet_sink", "SELECT count(*) AS row_count, round(sum(o_totalprice), 2) AS total, true AS zstd FROM orders")
def _(t):
    path = scratch_path(t.spark, "sink")
    io.write_parquet(t.orders, path)
    back = t.spark.read.parquet(path)
    named = back.select("o_totalprice", F.col("_metadata.file_name").contains(".zstd.").alias("z"))
    return named.agg(F.count(F.lit(1)).alias("row_count"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.bool_and("z").alias("zstd"))


@query(
    "a10_csv_sink",
    """SELECT row_id, CASE WHEN st = 'nonfinite' THEN NULL ELSE val END AS amount, shard FROM child_num""",
)
def _(t):
    path = scratch_path(t.spark, "csv")
    df = t.child.select("shard", "row_id", S.as_number(F.col("amount_text"), True).alias("amount"))
    io.write_csv(df, path, ["row_id", "amount", "shard"])
    return io.read_csv(t.spark, path, "row_id bigint, amount double, shard string")


@query("a11_refuse_overwrite", "SELECT count(*) AS row_count, true AS second_write_refused FROM customer")
def _(t):
    path = scratch_path(t.spark, "guard")
    io.write_parquet(t.customer, path)
    refused = io.refuses_overwrite(t.customer.where("c_custkey < 0"), path)
    return t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("row_count"), F.lit(refused).alias("second_write_refused"))


@query("a12_file_inventory", " UNION ALL ".join(
    f"""SELECT '{f}.parquet' AS file_name, (SELECT count(*) FROM {f}) AS physical_rows, count(*) AS column_count, string_agg(column_name, ',' ORDER BY column_index) AS column_names,
        count(*) FILTER (WHERE column_name = 'case_id') > 0 AS has_case_id, count(*) FILTER (WHERE column_name = 'num_group1') > 0 AS has_num_group1, true AS has_bytes,
        true AS has_row_groups FROM duckdb_columns() WHERE table_name = '{f}'""" for f in TABLES))
def _(t):
    inv = C.file_inventory(t.spark, [t.path(f) for f in TABLES])
    return inv.select("file_name", "physical_rows", "column_count", "column_names", "has_case_id", "has_num_group1", (F.col("file_bytes") > 0).alias("has_bytes"),
                      ((F.col("row_group_count") > 0) | (F.col("physical_rows") == 0)).alias("has_row_groups"))


_NAMES = """n AS (SELECT DISTINCT CASE WHEN doc_id % 11 = 0 THEN 'train_base.parquet' WHEN doc_id % 7 = 0 THEN concat(source, '.parquet')
    WHEN doc_id % 2 = 0 THEN concat('train_', source, '_', CAST(doc_id % 3 AS STRING), '.parquet')
    ELSE concat('train_', source, '_', CAST(doc_id % 3 AS STRING), '_', CAST(doc_id % 5 AS STRING), '.parquet') END AS f FROM documents)"""


@query(
    "a13_file_name_groups",
    f"""WITH {_NAMES}, m AS (SELECT f, regexp_extract(f, '^train_(.+?)_([012])(?:_([0-9]+))?\\.parquet$', 1) AS s,
            regexp_extract(f, '^train_(.+?)_([012])(?:_([0-9]+))?\\.parquet$', 2) AS d, regexp_extract(f, '^train_(.+?)_([012])(?:_([0-9]+))?\\.parquet$', 3) AS h FROM n)
        SELECT f AS file_name, CASE WHEN f = 'train_base.parquet' THEN 'train_base' WHEN s <> '' THEN concat('train_', s, '_', d) ELSE replace(f, '.parquet', '') END AS table_group,
               try_cast(d AS INTEGER) AS depth, try_cast(h AS INTEGER) AS shard,
               CASE WHEN f = 'train_base.parquet' THEN 'BASE' WHEN s <> '' THEN 'EXPECTED_PATTERN' ELSE 'UNEXPECTED_PATTERN' END AS naming_status FROM m""",
)
def _(t):
    sql = _NAMES.replace("FROM documents", "FROM {documents}")
    names = t.spark.sql(f"WITH {sql} SELECT f FROM n", documents=t.documents)
    return C.parse_file_names(names, "f")


def _drift_paths(t):
    """Three shards: the reference, one with moved columns, one with a lost, a new and a retyped column."""
    root = scratch_path(t.spark, "drift")
    base = t.child.select("case_id", "num_group1", "amount", "code", "shard")
    paths = [f"{root}/train_child_1_{i}.parquet" for i in range(3)]
    io.write_parquet(base.where("shard = 'shard_0'").drop("shard"), paths[0])
    io.write_parquet(base.where("shard = 'shard_1'").select("num_group1", "case_id", "amount", "code"), paths[1])
    io.write_parquet(base.where("shard = 'shard_2'").select(
        "case_id", "num_group1", F.col("amount").cast("string").alias("amount"), F.col("code").alias("code_new")), paths[2])
    return paths


@query(
    "a14_schema_drift",
    """SELECT 'train_child_1' AS table_group, concat('train_child_1_', i, '.parquet') AS file_name, CASE i WHEN 2 THEN 'code' ELSE '' END AS missing_columns,
              CASE i WHEN 2 THEN 'code_new' ELSE '' END AS extra_columns, CASE i WHEN 2 THEN 'amount' ELSE '' END AS type_differences,
              CASE i WHEN 1 THEN 2::BIGINT ELSE 0 END AS moved_columns, 4::BIGINT AS column_count, i < 2 AS names_match, i = 0 AS ordered_schema_match,
              (SELECT count(*) FROM child WHERE shard = concat('shard_', i)) AS physical_rows FROM range(0, 3) t(i)""",
)
def _(t):
    paths = _drift_paths(t)
    schema = C.schema_rows(t.spark, paths)
    drift = C.schema_drift(schema, F.regexp_extract("file_name", r"^(.*)_[0-9]+\.parquet$", 1))
    return drift.join(C.file_inventory(t.spark, paths).select("file_name", "physical_rows"), "file_name")


@query(
    "a14_group_summary",
    """SELECT 'train_child_1' AS table_group, 3::BIGINT AS physical_file_count, count(*) AS physical_row_total, 4::BIGINT AS column_count_min,
              4::BIGINT AS column_count_max, false AS ordered_schema_match FROM child""",
)
def _(t):
    paths = _drift_paths(t)
    drift = C.schema_drift(C.schema_rows(t.spark, paths), F.regexp_extract("file_name", r"^(.*)_[0-9]+\.parquet$", 1))
    return C.group_summary(drift, C.file_inventory(t.spark, paths).select("file_name", "physical_rows"))


@query(
    "a15_required_fields",
    """SELECT v.*, (SELECT count(*) FROM orders) AS physical_rows FROM (VALUES ('orders.parquet', 'o_orderkey', 'key', 'VERIFIED_PRESENT'),
        ('orders.parquet', 'o_totalprice', 'numeric', 'VERIFIED_PRESENT'), ('orders.parquet', 'o_orderdate', 'numeric', 'UNEXPECTED_NUMERIC_TYPE'),
        ('orders.parquet', 'o_custkey', 'date', 'UNEXPECTED_DATE_TYPE'), ('orders.parquet', 'o_orderdate', 'date', 'VERIFIED_PRESENT'),
        ('orders.parquet', 'o_clerk', 'text', 'MISSING')) v(file_name, name, kind, status)""",
)
def _(t):
    need = [("o_orderkey", "key"), ("o_totalprice", "numeric"), ("o_orderdate", "numeric"), ("o_custkey", "date"), ("o_orderdate", "date"), ("o_clerk", "text")]
    required = t.spark.createDataFrame([("orders.parquet", n, k) for n, k in need], "file_name string, name string, kind string")
    checked = C.verify_required(C.schema_rows(t.spark, [t.path("orders")]), required)
    rows = C.file_inventory(t.spark, [t.path("orders")]).select("file_name", "physical_rows")
    return checked.join(rows, "file_name").select("file_name", "name", "kind", "status", "physical_rows")


def field_rows(t):
    words = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)))
    return t.documents.select(F.concat("source", F.lit("_"), "lang").alias("file_name"), F.col("source").alias("table_group"), words.alias("w")).select(
        "file_name", "table_group", F.lower("w").alias("field_name")).distinct()


def dictionary(t):
    return C.unique_dictionary(t.dictionary, "variable", "description", "item_id")


@query(
    "a16_field_inventory",
    """SELECT f.file_name, f.table_group, f.field_name, coalesce(d.description, '') AS description,
              CASE WHEN d.description = '' THEN 'MATCHED_EMPTY_DESCRIPTION' WHEN d.description IS NOT NULL THEN 'MATCHED'
                   WHEN f.field_name IN ('case_id', 'target', 'date_decision', 'MONTH', 'WEEK_NUM', 'num_group1', 'num_group2') THEN 'STRUCTURAL_NOT_IN_DICTIONARY'
                   ELSE 'UNDOCUMENTED' END AS dictionary_status, CASE f.field_name WHEN 'target' THEN 'LABEL' ELSE 'OTHER' END AS technical_role
       FROM field_rows f LEFT JOIN dict_unique d ON d.field_name = f.field_name""",
)
def _(t):
    return C.field_inventory(field_rows(t), dictionary(t))


@query(
    "a17_dictionary_validation",
    """WITH b AS (SELECT coalesce(variable, '') AS v, coalesce(description, '') AS d FROM dictionary)
       SELECT 'BLANK_NAME' AS finding, '' AS variable, count(*) AS row_count FROM b WHERE trim(v) = '' HAVING count(*) > 0
       UNION ALL SELECT 'DUPLICATE_NAME', v, count(*) FROM b WHERE trim(v) <> '' GROUP BY v HAVING count(*) > 1
       UNION ALL SELECT 'EMPTY_DESCRIPTION', v, count(*) FROM b WHERE trim(v) <> '' AND d = '' GROUP BY v""",
)
def _(t):
    return C.validate_dictionary(t.dictionary, "variable", "description", "item_id")


def found(t):
    return C.mentions(t.documents.select("doc_id", "source", "text"), "text", dictionary(t), ["doc_id", "source"])


@query("a18_identifier_mentions", "SELECT doc_id, source, name, excerpt FROM mention_excerpts")
def _(t):
    return found(t)


@query(
    "a18_identifier_mining",
    """WITH b AS (SELECT name, count(*) AS text_count, count(DISTINCT source) AS location_count FROM mention_excerpts GROUP BY name),
            f AS (SELECT name, excerpt, min(doc_id) AS first FROM mention_excerpts WHERE excerpt <> '' GROUP BY 1, 2),
            r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY first, excerpt) AS k FROM f),
            c AS (SELECT name, string_agg(excerpt, ' || ' ORDER BY k) AS contexts FROM r WHERE k <= 3 GROUP BY name)
       SELECT b.*, c.contexts FROM b LEFT JOIN c ON c.name = b.name""",
)
def _(t):
    return C.mine_identifiers(found(t), "source", "doc_id")


_LOCATIONS = """WITH l AS (SELECT field_name, count(*) AS files, count(DISTINCT table_group) AS groups, string_agg(DISTINCT table_group, ',' ORDER BY table_group) AS gs
                          FROM field_rows GROUP BY 1),
            n AS (SELECT DISTINCT name FROM mention_rows)"""


@query(
    "a19_candidate_locations",
    _LOCATIONS + """ SELECT n.name AS field_name, n.name IN (SELECT field_name FROM dict_unique) AS in_dictionary,
              CASE WHEN coalesce(groups, 0) = 0 THEN 'NOT_OBSERVED' WHEN groups = 1 THEN 'OBSERVED_IN_ONE_GROUP' ELSE 'OBSERVED_IN_MULTIPLE_GROUPS' END AS location_status,
              coalesce(files, 0) AS physical_file_count, coalesce(groups, 0) AS group_count, coalesce(gs, '') AS table_groups,
              n.name IN ('case_id', 'target', 'date_decision', 'MONTH', 'WEEK_NUM', 'num_group1', 'num_group2') AS is_structural
       FROM n LEFT JOIN l ON l.field_name = n.name""",
)
def _(t):
    return C.candidate_locations(found(t), field_rows(t), dictionary(t))


@query(
    "a20_inventory_checks",
    """WITH f AS (SELECT count(*) AS n FROM field_rows), m AS (SELECT count(DISTINCT name) AS n FROM mention_rows)
       SELECT 'field_occurrences_reconcile' AS check_id, 'PASS' AS status, CAST(n AS VARCHAR) AS observed, CAST(n AS VARCHAR) AS expected FROM f
       UNION ALL SELECT 'candidate_names_unique', 'PASS', CAST(n AS VARCHAR), CAST(n AS VARCHAR) FROM m
       UNION ALL SELECT 'candidate_statuses_reconcile', 'PASS', CAST(n AS VARCHAR), CAST(n AS VARCHAR) FROM m
       UNION ALL SELECT 'observed_candidates_have_locations', 'PASS', '0', '0'""",
)
def _(t):
    rows = field_rows(t)
    per_file = rows.groupBy("file_name").agg(F.count(F.lit(1)).alias("column_count"))
    return C.internal_checks(per_file, C.field_inventory(rows, dictionary(t)), C.candidate_locations(found(t), rows, dictionary(t)))
