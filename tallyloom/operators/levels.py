"""Category levels as a table and as sparse vectors, for vocabularies of any size.

Training levels are numbered in their order by a distributed rank; the table meets the rows by a join on the value, with the table
broadcast only if its row count allows.  The encoded row is one sparse vector in the order of the wide columns, so a million
levels cost what is set in them.
"""

from __future__ import annotations


from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from ..session import freeze
from . import prep
from .joins import skew_join
from .ranking import running

#: More levels of a category than this are not broadcast.
BROADCAST_LEVELS = 100_000


def level_index(rows: DataFrame, categories: list[str]) -> DataFrame:
    """(input_column, level, position) of all training levels in their order, then the two reserved levels."""
    long = rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("input_column"), F.col(c).cast("string").alias("level")) for c in categories])))
    found = freeze(long.where(F.col("level").isNotNull()).distinct())
    clash = found.where(F.col("level").isin(prep.MISSING, prep.UNSEEN)).first()
    if clash:
        raise ValueError(f"reserved category token occurs in {clash['input_column']}")
    numbered = running(found, ["input_column"], ["level"]).select("input_column", "level", (F.col("rn") - 1).alias("position"))
    names = rows.sparkSession.createDataFrame([(c,) for c in categories], "input_column string")
    sizes = names.join(found.groupBy("input_column").agg(F.count(F.lit(1)).alias("n")), "input_column", "left").fillna(0, ["n"])
    reserved = sizes.select("input_column", F.inline(F.array(
        F.struct(F.lit(prep.MISSING).alias("level"), F.col("n").alias("position")), F.struct(F.lit(prep.UNSEEN).alias("level"), (F.col("n") + 1).alias("position")))))
    return freeze(numbered.unionByName(reserved))


def widths(index: DataFrame) -> dict[str, int]:
    """Outputs per category: one row each."""
    return {r["input_column"]: int(r["w"]) for r in index.groupBy("input_column").agg((F.max("position") + 1).alias("w")).collect()}


def output_name(column: str | Column, level: Column) -> Column:
    """Name of a level's indicator, as the wide columns have it."""
    c = F.lit(column) if isinstance(column, str) else column
    plain = F.concat(F.lit("ohe_"), c, F.lit("__"), F.substring(F.sha1(level.cast("binary")), 1, 10))
    return F.when(level == prep.MISSING, F.concat(F.lit("ohe_"), c, F.lit("__missing"))).when(level == prep.UNSEEN, F.concat(F.lit("ohe_"), c, F.lit("__unseen"))).otherwise(plain)


def with_positions(df: DataFrame, index: DataFrame, size: dict[str, int], categories: list[str]) -> DataFrame:
    """Add ``slot_<category>``: the position of each row's level; nulls and unknown values have the reserved ones."""
    out = df
    for c in categories:
        name = f"__level_{c}"
        mine = index.where(F.col("input_column") == c).select(F.col("level").alias(name), F.col("position").alias(f"__at_{c}"))
        keyed = out.withColumn(name, F.coalesce(F.col(c).cast("string"), F.lit(prep.MISSING)))
        joined = keyed.join(F.broadcast(mine), name, "left") if size[c] <= BROADCAST_LEVELS else skew_join(keyed, mine, name, "left")
        # a value that spells a reserved token was not seen in training
        known = F.when(F.col(c).isNotNull() & F.col(name).isin(prep.MISSING, prep.UNSEEN), None).otherwise(F.col(f"__at_{c}"))
        out = joined.withColumn(f"slot_{c}", F.coalesce(known, F.lit(size[c] - 1)).cast("int")).drop(name, f"__at_{c}")
    return out


def encoded(df: DataFrame, p: prep.Preprocessor, index: DataFrame, representation: str, keep: list[str]) -> DataFrame:
    """``keep``, the prepared numbers and flags, and each category as a sparse ``hot_<category>`` vector.

    ``linear_nn`` holds no nulls; ``gbdt`` keeps missing numbers.
    """
    cats, size = list(p.spec.categories), widths(index)
    rows = with_positions(p.numbers(df, representation, [*keep, *cats]), index, size, cats).drop(*[c for c in cats if c not in keep])
    last = rows.sparkSession.createDataFrame([tuple(size[c] - 1 for c in cats)], ", ".join(f"`slot_{c}` int" for c in cats))  # the encoder takes the width from it
    model = OneHotEncoder(inputCols=[f"slot_{c}" for c in cats], outputCols=[f"hot_{c}" for c in cats], dropLast=False).fit(last)
    return model.transform(rows).drop(*[f"slot_{c}" for c in cats])


def vector_inputs(p: prep.Preprocessor) -> tuple[list[str], list[str]]:
    """Inputs of the base feature set's vector and of the whole one's, in the order of the wide columns."""
    s = p.spec
    base = [c for c in s.numeric if c in s.first] + [f["name"] for f in p.missing_flags if f["first"]] + [f"hot_{c}" for c in s.categories]
    more = [c for c in s.numeric if c not in s.first] + list(s.flags) + [f["name"] for f in p.missing_flags if not f["first"]]
    return base, base + more


def assemble(df: DataFrame, inputs: list[str], keep: list[str]) -> DataFrame:
    """``keep`` and ``features``, sparse where that is smaller."""
    return VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="error").transform(df).select(*keep, "features")


def names_of(index: DataFrame) -> DataFrame:
    return index.withColumn("output_name", output_name(F.col("input_column"), F.col("level")))
