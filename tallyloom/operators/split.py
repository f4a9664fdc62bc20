"""Deterministic stratified splits with exact class counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import freeze
from .longform import count_where
from .ranking import BROADCAST_OFFSETS, running

# Split fractions.
EVALUATION_FRACTION = 0.15
VALIDATION_FRACTION = 15 / 85
CALIBRATION_FRACTION = 0.5
#: Leading hex digits of a draw that are counted to find a place in the random order: 65,536 counts a class.
COUNTED_DIGITS = 4


def draw(seed: int | str, key: str) -> Column:
    """Pseudo-random order of keys that any engine with md5 can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def class_rank(df: DataFrame, key: str, label: str, seed: int | str) -> DataFrame:
    """``df`` with ``rn`` and ``n_rows`` of a random order within each class."""
    return running(df.withColumn("__draw", draw(seed, key)), [label], ["__draw", key], rows=df.count()).drop("__draw")


def holdout_size(n: Column, fraction: float) -> Column:
    return F.bround(n * F.lit(fraction), 0).cast("bigint")


def _ends(df: DataFrame, key: str, label: str, seed: int | str, sizes: dict[str, Column]) -> DataFrame:
    """Per class the draw and key of the row at each wanted place of its random order; NULL for place 0.

    ``sizes`` state the places by the class's rows ``n``.  Counts per leading digits of the draw say which digits hold a place, and
    only rows with those digits, a few in 65,536, are ordered.
    """
    rows = df.select(F.col(label).alias("__class"), F.col(key).alias("__key"), draw(seed, key).alias("__draw"))
    rows = rows.withColumn("__digits", F.substring("__draw", 1, COUNTED_DIGITS))
    whole = Window.partitionBy("__class")  # over counts
    before = whole.orderBy("__digits").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("__class", "__digits").agg(F.count(F.lit(1)).alias("__rows")).select(
        "__class", "__digits", "__rows", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"), F.sum("__rows").over(whole).alias("n"))
    placed = counts.select("*", *[c.alias(f"__at_{k}") for k, c in sizes.items()])
    here = lambda at: (at > F.col("__before")) & (at <= F.col("__before") + F.col("__rows"))
    at = {k: F.col(f"__at_{k}") for k in sizes}
    # place 0 is before every row: the first digits stand in for it, so that every class has its row here
    first = F.col("__before") == 0
    hit = freeze(placed.where(reduce(lambda a, b: a | b, [here(a) for a in at.values()], first)).withColumnsRenamed({"__class": "__c", "__digits": "__d"}))
    few = F.broadcast(hit) if hit.count() <= BROADCAST_OFFSETS else hit
    near = rows.join(few, F.col("__class").eqNullSafe(F.col("__c")) & F.col("__digits").eqNullSafe(F.col("__d")))
    rn = F.col("__before") + F.row_number().over(Window.partitionBy("__class", "__digits").orderBy("__draw", "__key"))
    return freeze(near.withColumn("__rn", rn).groupBy("__class").agg(
        *[F.max(F.when(F.col("__rn") == a, F.struct("__draw", "__key"))).alias(f"__end_{k}") for k, a in at.items()]))


def within(df: DataFrame, key: str, label: str, seed: int | str, sizes: dict[str, Column]) -> DataFrame:
    """Add a flag per name of ``sizes``: whether a row is among the first so many of its class's random order.

    A row is compared with the last of them, so rows are neither moved nor ordered.
    """
    ends = _ends(df, key, label, seed, sizes)
    ends = F.broadcast(ends) if ends.count() <= BROADCAST_OFFSETS else ends
    mine = F.struct(draw(seed, key).alias("__draw"), F.col(key).alias("__key"))
    joined = df.withColumn("__mine", mine).join(ends, F.col(label).eqNullSafe(F.col("__class")))
    return joined.select(*df.columns, *[F.coalesce(F.col("__mine") <= F.col(f"__end_{k}"), F.lit(False)).alias(k) for k in sizes])


def stratified_holdout(df: DataFrame, key: str, label: str, fraction: float, seed: int | str) -> DataFrame:
    """Flag exactly round-half-even(n * fraction) rows of every class as held out."""
    return within(df, key, label, seed, {"held_out": holdout_size(F.col("n"), fraction)})


def make_splits(df: DataFrame, key: str, label: str, seed: int | str) -> DataFrame:
    """Add ``outer_split`` (train / validation / evaluation) and ``validation_role``.

    One random order per class is cut at the nested sizes, which gives the class counts of
    three chained hold-outs for the price of finding three places of it.
    """
    n = F.col("n")
    n_eval = holdout_size(n, EVALUATION_FRACTION)
    n_val = holdout_size(n - n_eval, VALIDATION_FRACTION)
    n_cal = holdout_size(n_val, CALIBRATION_FRACTION)
    r = within(df, key, label, seed, {"__evaluation": n_eval, "__calibration": n_eval + n_cal, "__validation": n_eval + n_val})
    outer = F.when(F.col("__evaluation"), "evaluation").when(F.col("__validation"), "validation").otherwise("train")
    role = F.when(outer == "validation", F.when(F.col("__calibration"), "validation_calibration").otherwise("validation_tuning"))
    return r.select(*df.columns, outer.alias("outer_split"), role.alias("validation_role"))


def common_folds(df: DataFrame, key: str, label: str, k: int, seed: int | str) -> DataFrame:
    r = class_rank(df, key, label, seed)
    return r.withColumn("fold_id", ((F.col("rn") - 1) % k).cast("bigint")).drop("rn", "n_rows")


def fold_summary(folds: DataFrame, label: str) -> DataFrame:
    return folds.groupBy("fold_id").agg(
        F.count(F.lit(1)).alias("row_count"), count_where(F.col(label) == 1).alias("positive_count"),
        count_where(F.col(label) == 0).alias("negative_count"))


def split_names() -> Column:
    """A row's outer split and, for validation rows, also its nested role."""
    return F.explode(F.array_compact(F.array("outer_split", "validation_role")))


def fingerprint(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Order-free membership fingerprint: row count and xor of 60 digest bits per row."""
    digest = F.substring(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), 256), 1, 15)
    bits = F.conv(digest, 16, 10).cast("bigint")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("row_count"), F.bit_xor(bits).alias("fingerprint"))
