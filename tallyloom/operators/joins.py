"""Joins of sources to the population, always on reduced rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import states as S
from .longform import count_where

HOT_KEYS = 1000
SALTS = 64


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str) -> DataFrame:
    """Join rows to a table that is unique on ``key`` when some keys hold many rows.

    The most frequent keys (at most ``HOT_KEYS``, so every key with more than 0.1 % of the
    rows is among them, and small enough to broadcast) are salted: their rows spread over
    ``SALTS`` join partitions, and the one matching row is repeated that often.  The salt
    is a hash of the row, so a retried task sends it to the same place.
    """
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    hot = counts.orderBy(F.desc("__n"), F.asc(key)).limit(HOT_KEYS).select(key, F.lit(True).alias("__hot"))
    spread = F.when(F.col("__hot"), F.pmod(F.xxhash64(*left.columns), F.lit(SALTS))).otherwise(F.lit(0))
    copies = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted = left.join(F.broadcast(hot), key, "left").withColumn("__salt", spread.cast("int")).drop("__hot")
    copied = right.join(F.broadcast(hot), key, "left").withColumn("__salt", F.explode(copies)).drop("__hot")
    return salted.join(copied, [key, "__salt"], how).drop("__salt")


def align(spine: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Left alignment of a source with unique keys; keeps exactly the spine rows.

    A second source row for a key fails the job, so the row count cannot grow.
    """
    one = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit(f"source is not unique on {key}"))).otherwise(F.lit(1))
    values = [c for c in source.columns if c != key]
    unique = source.where(F.col(key).isNotNull()).groupBy(key).agg(
        *[F.any_value(c).alias(c) for c in values], one.alias("source_rows")
    )
    return spine.join(unique, key, "left").withColumn("source_rows", F.coalesce("source_rows", F.lit(0)).cast("bigint"))


def key_partition(source: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows and distinct keys that are matched, orphan or NULL; rows are counted per key first."""
    per_key = source.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    tagged = per_key.join(keys.select(key, F.lit(1).alias("known")), key, "left")
    kind = F.when(F.col(key).isNull(), "null_key").when(F.col("known").isNull(), "orphan").otherwise("matched")
    return tagged.groupBy(kind.alias("key_class")).agg(
        F.sum("n").alias("row_count"), F.count(key).alias("distinct_keys")
    )


def label_join_audit(features: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Integrity of a one-to-one label join: nulls, duplicates, unmatched keys, binary labels."""
    side = lambda df, name, extra: df.groupBy(key).agg(F.count(F.lit(1)).alias(name), *extra)
    a = side(features, "n_f", [])
    b = side(labels, "n_l", [
        count_where(F.col(label) == 1).alias("pos"), count_where(F.col(label).isNull()).alias("label_null"),
        count_where(F.col(label).isNotNull() & ~F.col(label).isin(0, 1)).alias("label_other"),
    ])
    j = a.join(b, a[key].eqNullSafe(b[key]), "full_outer").select(
        F.coalesce(a[key], b[key]).alias(key), "n_f", "n_l", "pos", "label_null", "label_other"
    )
    keyed = F.col(key).isNotNull()
    f_rows, l_rows = F.coalesce("n_f", F.lit(0)), F.coalesce("n_l", F.lit(0))
    return j.agg(
        F.sum(f_rows).alias("feature_rows"), F.sum(l_rows).alias("label_rows"),
        F.sum(F.when(keyed, 0).otherwise(f_rows)).alias("feature_null_keys"),
        F.sum(F.when(keyed, 0).otherwise(l_rows)).alias("label_null_keys"),
        F.sum(F.when(keyed, F.greatest(f_rows - 1, F.lit(0))).otherwise(0)).alias("feature_duplicate_excess"),
        F.sum(F.when(keyed, F.greatest(l_rows - 1, F.lit(0))).otherwise(0)).alias("label_duplicate_excess"),
        count_where(keyed & (f_rows > 0) & (l_rows > 0)).alias("matched_keys"),
        count_where(keyed & (l_rows == 0)).alias("feature_keys_without_label"),
        count_where(keyed & (f_rows == 0)).alias("label_keys_without_feature"),
        F.sum(F.coalesce("pos", F.lit(0))).alias("positives"),
        F.sum(F.coalesce("label_null", F.lit(0))).alias("null_labels"),
        F.sum(F.coalesce("label_other", F.lit(0))).alias("nonbinary_labels"),
    )


def day_offsets(source: DataFrame, spine: DataFrame, key: str, field: str, decision: str) -> DataFrame:
    """Signed day offset of a source date to the decision date, per (key, state, day).

    Rows are counted per (key, day) before the join, so a key with very many rows brings
    at most one row per calendar day.
    """
    pre = (
        source.where(F.col(key).isNotNull()).select(key, field, S.as_day(source, field).alias("day"))
        .select(key, S.date_state(source, field, F.col("day")).alias("state"), "day")
        .groupBy(key, "state", "day")
        .agg(F.count(F.lit(1)).alias("row_count"))
    )
    days = spine.select(key, F.col(decision).cast("date").alias("decision_day"))
    return pre.join(days, key).withColumn("offset_days", F.datediff("day", "decision_day").cast("bigint"))


def side(offset: str) -> Column:
    o = F.col(offset)
    return F.when(o < 0, "before").when(o == 0, "on").when(o > 0, "after")


def grouped_date_comparison(left: DataFrame, right: DataFrame, key: str, day: str) -> DataFrame:
    """Compare (key, day) groups counted independently on both sides; raw rows never meet."""
    count = lambda df, name: (
        df.where(F.col(key).isNotNull() & F.col(day).isNotNull()).groupBy(key, day).agg(F.count(F.lit(1)).alias(name))
    )
    j = count(left, "l").join(count(right, "r"), [key, day], "full_outer")
    l, r = F.col("l"), F.col("r")
    both = l.isNotNull() & r.isNotNull()
    return j.agg(
        F.count(l).alias("left_group_count"), F.count(r).alias("right_group_count"),
        count_where(both).alias("matched_group_count"),
        count_where(r.isNull()).alias("left_only_group_count"),
        count_where(l.isNull()).alias("right_only_group_count"),
        count_where(both & (l == r)).alias("matched_equal_multiplicity_count"),
        count_where(both & (l != r)).alias("matched_different_multiplicity_count"),
        count_where(both & ((l > 1) | (r > 1))).alias("matched_ambiguous_multirow_group_count"),
    )


def _pairs(signature: str) -> Column:
    """All (left, right) entries of a shard-sorted signature array, left before right."""
    s = F.col(signature)
    return F.flatten(
        F.transform(s, lambda a, i: F.transform(F.slice(s, i + 2, F.size(s)), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    )


def shard_overlap(df: DataFrame, key: str, shard: str, payload: list[str]) -> DataFrame:
    """Shared keys of every pair of shards and conflicting payloads among them.

    Each key becomes a signature (shard, payload class, repeated or not).  Keys are counted
    per signature, and pairs are formed on the few distinct signatures only.  A pair with a
    repeated key in its overlap is not compared, as that would need a cartesian join.
    """
    keyed = df.where(F.col(key).isNotNull())
    per = keyed.groupBy(key, shard).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*payload)).alias("v"))
    sig = per.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(shard).alias("s"), "n", "v"))).alias("x"))
    values = F.transform("x", lambda e: e["v"])
    entry = lambda e: F.struct(
        e["s"].alias("s"), F.array_position(values, e["v"]).alias("c"), (e["n"] > 1).alias("rep")
    )
    patterns = sig.select(F.transform("x", entry).alias("sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("keys"))
    pairs = patterns.where(F.size("sig") > 1).select("keys", F.explode(_pairs("sig")).alias("p"))
    hits = pairs.groupBy(F.col("p.a.s").alias("left_file"), F.col("p.b.s").alias("right_file")).agg(
        F.sum("keys").alias("overlap"),
        F.sum(F.when(F.col("p.a.c") != F.col("p.b.c"), F.col("keys")).otherwise(0)).alias("conflicts"),
        F.max(F.col("p.a.rep") | F.col("p.b.rep")).alias("repeated"),
    )
    stats = df.groupBy(shard).agg(F.count(F.lit(1)).alias("rows")).join(
        per.groupBy(shard).agg(F.count(F.lit(1)).alias("keys")), shard
    )
    grid = _shard_pairs(stats, shard, ["rows", "keys"])
    j = grid.join(hits, ["left_file", "right_file"], "left")
    overlap = F.coalesce("overlap", F.lit(0))
    repeated = F.coalesce("repeated", F.lit(False))
    return j.select(
        "left_file", "right_file", F.col("left_rows"), F.col("right_rows"),
        F.col("left_keys").alias("left_distinct_keys"), F.col("right_keys").alias("right_distinct_keys"),
        overlap.alias("overlapping_keys"),
        F.when(~repeated, F.coalesce("conflicts", F.lit(0))).alias("conflicting_keys"),
        F.when(overlap == 0, "PASS_NO_OVERLAP").when(repeated, "NOT_CHECKED_DUPLICATE_KEYS_AVOIDS_CARTESIAN_JOIN")
        .otherwise("CHECKED").alias("check_status"),
    )


def _shard_pairs(stats: DataFrame, shard: str, cols: list[str]) -> DataFrame:
    """Ordered pairs of the shard statistics: one row per file on each side, met by the partner's number."""
    order = Window.partitionBy(F.lit(0))  # one row per file
    numbered = stats.select(F.col(shard).alias("s"), *cols, F.row_number().over(order.orderBy(shard)).alias("i"), F.count(F.lit(1)).over(order).alias("files"))
    left = numbered.where("i < files").select(
        F.col("s").alias("left_file"), *[F.col(c).alias(f"left_{c}") for c in cols], F.explode(F.sequence(F.col("i") + 1, F.col("files").cast("int"))).alias("i"))
    right = numbered.select(F.col("s").alias("right_file"), *[F.col(c).alias(f"right_{c}") for c in cols], "i")
    return left.join(right, "i").drop("i")


def shard_composite_overlap(df: DataFrame, key: str, index: str, shard: str, payload: list[str]) -> DataFrame:
    """Shared keys, shared (key, index) pairs and payload conflicts of every pair of shards."""
    rows = df.where(F.col(key).isNotNull() & S.valid_index(F.col(index)))
    v = F.struct(*payload)
    per = rows.groupBy(key, index, shard).agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    item = F.struct(F.col(shard).alias("s"), "lo", "hi")
    comp = per.groupBy(key, index).agg(F.sort_array(F.collect_list(item)).alias("x"))
    lows = F.transform("x", lambda e: e["lo"])
    entry = lambda e: F.struct(
        e["s"].alias("s"), F.array_position(lows, e["lo"]).alias("c"), (~e["lo"].eqNullSafe(e["hi"])).alias("mixed")
    )
    sigs = comp.where(F.size("x") > 1).select(F.transform("x", entry).alias("sig")).groupBy("sig").agg(
        F.count(F.lit(1)).alias("keys")
    )
    differ = F.col("p.a.mixed") | F.col("p.b.mixed") | (F.col("p.a.c") != F.col("p.b.c"))
    pair_cols = [F.col("p.a.s").alias("left_file"), F.col("p.b.s").alias("right_file")]
    composite = sigs.select("keys", F.explode(_pairs("sig")).alias("p")).groupBy(*pair_cols).agg(
        F.sum("keys").alias("composite_key_overlap_count"),
        F.sum(F.when(differ, F.col("keys")).otherwise(0)).alias("conflicting_composite_keys"),
    )
    sets = rows.groupBy(key).agg(F.sort_array(F.collect_set(F.struct(F.col(shard).alias("s")))).alias("sig"))
    cases = (
        sets.groupBy("sig").agg(F.count(F.lit(1)).alias("keys")).where(F.size("sig") > 1)
        .select("keys", F.explode(_pairs("sig")).alias("p")).groupBy(*pair_cols).agg(F.sum("keys").alias("case_overlap_count"))
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return cases.join(composite, ["left_file", "right_file"], "left").select(
        "left_file", "right_file", "case_overlap_count", zero("composite_key_overlap_count"), zero("conflicting_composite_keys")
    )


def count_correspondence(spine: DataFrame, key: str, a: DataFrame, b: DataFrame, finite_b: Column) -> DataFrame:
    """Per-entity count relations of two sources, compared over the whole population."""
    ca = a.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("a_rows"))
    cb = b.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("b_rows"), count_where(finite_b).alias("b_finite")
    )
    e = spine.select(key).join(ca, key, "left").join(cb, key, "left").fillna(0)
    x, y, z = F.col("a_rows"), F.col("b_rows"), F.col("b_finite")
    checks = {
        "every_b_entity_also_in_a": ~((y > 0) & (x == 0)),
        "a_count_equals_b_count": x == y,
        "a_count_equals_b_plus_finite": x == y + z,
        "b_missing_equals_a_count": (y - z) == x,
    }
    wide = e.agg(*[F.bool_and(c).alias(f"ok_{k}") for k, c in checks.items()],
                 *[count_where(~c).alias(f"n_{k}") for k, c in checks.items()])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("check_id"), F.col(f"n_{k}").alias("violations"),
                 F.when(F.col(f"ok_{k}"), "PASS").otherwise("FAIL").alias("status"))
        for k in checks
    ])))


def summary_vs_detail(
    spine: DataFrame, summary: DataFrame, detail: DataFrame, key: str, count_field: str, sum_field: str, amount: str
) -> DataFrame:
    """One row per entity: stated count and sum next to the counted and summed detail rows."""
    d = detail.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("detail_rows"), F.count(amount).alias("detail_finite"), F.sum(amount).alias("detail_sum")
    )
    return (
        spine.select(key).join(summary.select(key, count_field, sum_field), key, "left").join(d, key, "left")
        .fillna(0, ["detail_rows", "detail_finite"])
    )
