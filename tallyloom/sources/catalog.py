"""Inventory of files, schemas, the data dictionary and identifiers in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.checks import check_row, check_rows
from ..operators.joins import skew_join
from ..operators.longform import count_where
from ..operators.ranking import top_per_group
from ..session import freeze, spread
from . import io

# Technical roles of the structural columns and the file name grammar of the sources.
TECHNICAL_ROLES = {
    "case_id": "JOIN_KEY", "target": "LABEL", "date_decision": "TIME_METADATA", "MONTH": "TIME_METADATA", "WEEK_NUM": "TIME_METADATA",
    "num_group1": "GROUP_INDEX", "num_group2": "GROUP_INDEX",
}
STRUCTURAL = tuple(TECHNICAL_ROLES)
FILE_NAME = r"^train_(.+?)_([012])(?:_([0-9]+))?\.parquet$"
BASE_FILE = "train_base.parquet"
RAW_TOKEN = r"^[A-Za-z][A-Za-z0-9_]*_[0-9]+[A-Z]?$"
CONTEXT_CHARS = 240
BROADCAST_NAMES = 100_000
CONTEXTS = 3


def file_inventory(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows, size, row groups and columns per table file, from footers that executors read side by side."""
    f = io.footers(spark, paths)
    first = F.min_by(F.struct("columns"), "path")["columns"]  # a table's columns are those of its first part
    per = f.groupBy("file_name").agg(F.sum("rows").alias("physical_rows"), F.sum("bytes").alias("file_bytes"), F.sum("row_groups").alias("row_group_count"), first.alias("columns"))
    names = F.transform("columns", lambda c: c["name"])
    return per.select("file_name", "physical_rows", "file_bytes", "row_group_count", F.size("columns").cast("bigint").alias("column_count"), F.array_join(names, ",").alias("column_names"),
                      *[F.array_contains(names, c).alias(f"has_{c}") for c in ("case_id", "num_group1", "num_group2")])


def parse_file_names(df: DataFrame, name: str) -> DataFrame:
    """Table group, depth, shard and naming status of distinct file names."""
    n = F.col(name)
    match = n.rlike(FILE_NAME)
    part = lambda i: F.regexp_extract(n, FILE_NAME, i)
    is_base = n == BASE_FILE
    return df.select(name).distinct().select(
        n.alias("file_name"),
        F.when(is_base, "train_base").when(match, F.concat(F.lit("train_"), part(1), F.lit("_"), part(2)))
        .otherwise(F.regexp_replace(n, r"\.[^.]*$", "")).alias("table_group"),
        F.when(match & ~is_base, part(2).try_cast("int")).alias("depth"),
        F.when(match & ~is_base, part(3).try_cast("int")).alias("shard"),
        F.when(is_base, "BASE").when(match, "EXPECTED_PATTERN").otherwise("UNEXPECTED_PATTERN").alias("naming_status"))


def schema_rows(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file_name, position, name, dtype) from footers only; a table of several parts has its first part's columns."""
    first = io.footers(spark, paths).groupBy("file_name").agg(F.min_by(F.struct("columns"), "path")["columns"].alias("columns"))
    return first.select("file_name", F.posexplode("columns").alias("position", "c")).select("file_name", "position", "c.name", "c.dtype")


def schema_drift(schema: DataFrame, group: Column) -> DataFrame:
    """Each shard's columns against the first shard of its group."""
    s = schema.withColumn("table_group", group)
    first = s.groupBy("table_group").agg(F.min("file_name").alias("reference_file"))
    files = s.select("table_group", "file_name").distinct().join(first, "table_group")
    ref = s.join(first, "table_group").where("file_name = reference_file").select(
        "table_group", "name", F.col("dtype").alias("rt"), F.col("position").alias("rp"))
    wanted = files.join(ref, "table_group")
    j = wanted.join(s.select("table_group", "file_name", "name", "dtype", "position"), ["table_group", "file_name", "name"], "full_outer")
    r, x = F.col("rt"), F.col("dtype")
    names = lambda cond: F.array_join(F.sort_array(F.collect_list(F.when(cond, F.col("name")))), ",")
    a = j.groupBy("table_group", "file_name").agg(
        names(r.isNotNull() & x.isNull()).alias("missing_columns"), names(r.isNull() & x.isNotNull()).alias("extra_columns"),
        names(r != x).alias("type_differences"), count_where(F.col("rp") != F.col("position")).alias("moved_columns"),
        F.count(x).alias("column_count"))
    same = (F.col("missing_columns") == "") & (F.col("extra_columns") == "")
    return a.withColumns({
        "names_match": same, "ordered_schema_match": same & (F.col("type_differences") == "") & (F.col("moved_columns") == 0)})


def group_summary(drift: DataFrame, rows: DataFrame) -> DataFrame:
    """Files, row total and schema agreement per table group."""
    return drift.join(rows, "file_name").groupBy("table_group").agg(
        F.count(F.lit(1)).alias("physical_file_count"), F.sum("physical_rows").alias("physical_row_total"),
        F.min("column_count").alias("column_count_min"), F.max("column_count").alias("column_count_max"),
        F.bool_and("ordered_schema_match").alias("ordered_schema_match"))


def verify_required(schema: DataFrame, required: DataFrame) -> DataFrame:
    """Status of required fields (name, kind in key / numeric / date / text)."""
    t = F.col("dtype")
    numeric = t.rlike("^(tinyint|smallint|int|bigint|float|double|decimal)")
    dated = t.rlike("^(string|date|timestamp)")
    status = (F.when(t.isNull(), "MISSING").when((F.col("kind") == "numeric") & ~numeric & (t != "string"), "UNEXPECTED_NUMERIC_TYPE")
              .when((F.col("kind") == "date") & ~dated, "UNEXPECTED_DATE_TYPE").otherwise("VERIFIED_PRESENT"))
    return required.join(schema.select("file_name", "name", "dtype"), ["file_name", "name"], "left").withColumn("status", status)


def validate_dictionary(df: DataFrame, variable: str, description: str, order: str) -> DataFrame:
    """Blank, duplicate and undescribed variables as (finding, variable, rows) records."""
    v = F.coalesce(F.col(variable), F.lit(""))
    d = F.coalesce(F.col(description), F.lit(""))
    base = df.select(v.alias("variable"), d.alias("d"), F.col(order).alias("o"))
    named = F.trim("variable") != ""
    blank = base.where(~named).groupBy(F.lit("").alias("variable")).agg(F.count(F.lit(1)).alias("row_count"))
    dup = base.where(named).groupBy("variable").agg(F.count(F.lit(1)).alias("row_count")).where("row_count > 1")
    bare = base.where(named & (F.col("d") == "")).groupBy("variable").agg(F.count(F.lit(1)).alias("row_count"))
    tag = lambda x, name: x.select(F.lit(name).alias("finding"), "variable", "row_count")
    return tag(blank, "BLANK_NAME").unionByName(tag(dup, "DUPLICATE_NAME")).unionByName(tag(bare, "EMPTY_DESCRIPTION"))


def unique_dictionary(df: DataFrame, variable: str, description: str, order: str) -> DataFrame:
    """One row per non-blank variable: the description of its first entry."""
    named = df.where(F.trim(F.coalesce(F.col(variable), F.lit(""))) != "")
    return named.groupBy(F.col(variable).alias("field_name")).agg(
        F.min_by(F.coalesce(F.col(description), F.lit("")), F.col(order)).alias("description"))


def field_inventory(fields: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Dictionary status and technical role of every field."""
    f, d = F.col("field_name"), F.col("description")
    status = (F.when(d == "", "MATCHED_EMPTY_DESCRIPTION").when(d.isNotNull(), "MATCHED")
              .when(f.isin(*STRUCTURAL), "STRUCTURAL_NOT_IN_DICTIONARY").otherwise("UNDOCUMENTED"))
    roles = F.create_map(*[F.lit(x) for kv in TECHNICAL_ROLES.items() for x in kv])
    role = F.coalesce(F.try_element_at(roles, f), F.lit("OTHER"))
    return fields.join(dictionary, "field_name", "left").withColumns({
        "dictionary_status": status, "technical_role": role, "description": F.coalesce(d, F.lit(""))})


def mentions(blocks: DataFrame, text: str, names: DataFrame, keys: list[str]) -> DataFrame:
    """(name, keys..., excerpt) for every identifier that occurs in a text as an exact token.

    A token is a maximal run of letters, digits and underscores; it counts when it is a
    dictionary or structural name or has the form of a raw field name.  Tokens are matched
    without their text; the names found are gathered per text (at most its distinct
    tokens) and only then meet the text again, so each text moves at most once.
    """
    t = F.col(text)
    blocks = spread(blocks)
    tokens = blocks.select(*keys, F.explode(F.array_distinct(F.regexp_extract_all(t, F.lit("[A-Za-z0-9_]+"), F.lit(0)))).alias("name"))
    known = names.select(F.col("field_name").alias("name"), F.lit(True).alias("__known")).where(F.col("name").rlike("^[A-Za-z0-9_]+$")).distinct()
    small = known.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES
    # common words make hot join keys, so a dictionary too large to broadcast is joined with salt
    joined = tokens.join(F.broadcast(known), "name", "left") if small else skew_join(tokens, known, "name", "left")
    hits = joined.where(F.coalesce("__known", F.lit(False)) | F.col("name").rlike(RAW_TOKEN) | F.col("name").isin(*STRUCTURAL))
    per_text = hits.groupBy(*keys).agg(F.collect_list("name").alias("__names"))
    rows = blocks.join(per_text, keys).select(*keys, t, F.explode("__names").alias("name"))
    # position of the first exact occurrence, kept as a column so that it is computed once
    pattern = F.concat(F.lit("(?<![A-Za-z0-9_])"), F.col("name"), F.lit("(?![A-Za-z0-9_])"))
    placed = rows.withColumn("__at", F.regexp_instr(t, pattern) - 1)
    return placed.select("name", *keys, excerpt(t, F.col("__at"), F.length("name")).alias("excerpt"))


def excerpt(text: Column, at: Column, width: Column, size: int = CONTEXT_CHARS) -> Column:
    """Text around position ``at``, white space collapsed, at most ``size`` characters."""
    pad = size // 2
    start = F.greatest(at - pad, F.lit(0))
    end = F.least(at + width + pad, F.length(text))
    body = F.trim(F.regexp_replace(F.substring(text, start + 1, end - start), r"[ \t\n\f\r]+", " "))
    framed = F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(end < F.length(text), "…").otherwise(""))
    return F.substring(framed, 1, size)


def mine_identifiers(found: DataFrame, location: str, order: str) -> DataFrame:
    """Per identifier: texts, distinct locations and the first three different excerpts."""
    found = freeze(found)  # names and excerpts only; the texts are read once
    base = found.groupBy("name", location).agg(F.count(F.lit(1)).alias("n")).groupBy("name").agg(
        F.sum("n").alias("text_count"), F.count(F.lit(1)).alias("location_count"))
    firsts = found.where(F.col("excerpt") != "").groupBy("name", "excerpt").agg((-F.min(order)).alias("first"))
    top = top_per_group(firsts, ["name"], "excerpt", "first", CONTEXTS)
    ctx = top.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("rank", "excerpt"))).alias("x")).select(
        "name", F.array_join(F.transform("x", lambda e: e["excerpt"]), " || ").alias("contexts"))
    return base.join(ctx, "name", "left")


def candidate_locations(names: DataFrame, fields: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Where mined identifiers are observed: nowhere, in one group, in several groups."""
    loc = fields.groupBy("field_name", "table_group").agg(F.count_distinct("file_name").alias("files")).groupBy("field_name").agg(
        F.sum("files").alias("physical_file_count"), F.count(F.lit(1)).alias("group_count"),
        F.array_join(F.sort_array(F.collect_list("table_group")), ",").alias("table_groups"))
    j = names.select(F.col("name").alias("field_name")).distinct().join(loc, "field_name", "left").join(
        dictionary.select("field_name", F.lit(True).alias("in_dictionary")), "field_name", "left")
    g = F.coalesce("group_count", F.lit(0))
    status = F.when(g == 0, "NOT_OBSERVED").when(g == 1, "OBSERVED_IN_ONE_GROUP").otherwise("OBSERVED_IN_MULTIPLE_GROUPS")
    return j.select(
        "field_name", F.coalesce("in_dictionary", F.lit(False)).alias("in_dictionary"), status.alias("location_status"),
        F.coalesce("physical_file_count", F.lit(0)).alias("physical_file_count"), g.alias("group_count"),
        F.coalesce("table_groups", F.lit("")).alias("table_groups"), F.col("field_name").isin(*STRUCTURAL).alias("is_structural"))


def internal_checks(inventory: DataFrame, fields: DataFrame, candidates: DataFrame) -> DataFrame:
    """Reconciliation of the inventory: field occurrences, unique names, statuses, locations."""
    one = lambda df, *aggs: df.agg(*aggs, F.lit(1).alias("k"))
    c = F.col
    wide = one(inventory, F.sum("column_count").alias("expected")).join(one(fields, F.count(F.lit(1)).alias("actual")), "k").join(
        one(candidates, F.count(F.lit(1)).alias("rows"), F.count_distinct("field_name").alias("names"),
            count_where(c("location_status").isin("NOT_OBSERVED", "OBSERVED_IN_ONE_GROUP", "OBSERVED_IN_MULTIPLE_GROUPS")).alias("known"),
            count_where((c("location_status") != "NOT_OBSERVED") & (c("physical_file_count") == 0)).alias("unplaced")), "k")
    zero = F.lit(0)
    return check_rows(wide, [
        check_row("field_occurrences_reconcile", c("actual") == c("expected"), c("actual"), c("expected")),
        check_row("candidate_names_unique", c("rows") == c("names"), c("names"), c("rows")),
        check_row("candidate_statuses_reconcile", c("known") == c("rows"), c("known"), c("rows")),
        check_row("observed_candidates_have_locations", c("unplaced") == 0, c("unplaced"), zero)])
