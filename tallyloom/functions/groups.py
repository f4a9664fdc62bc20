"""Group assignment rules and model catalogue."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Labels of the subgroup dimensions.
ACCOUNT_LABELS = ("0", "1", "2", "3_plus")
HISTORY_LABELS = ("0_to_0_5", "0_5_to_1", "1_to_2", "2_to_3", "3_to_4", "4_to_5", "gt_5")
HISTORY_UPPER = (0.5, 1.0, 2.0, 3.0, 4.0, 5.0)
RICHNESS_LABELS = ("0", "1", "2", "3")

# Model catalogue (reference model, extended model) per family.
FAMILIES = {
    "logit": ("logit_t", "logit_ad"),
    "trees": ("trees_t", "trees_ad"),
    "mlp": ("mlp_t", "mlp_ad"),
}
MODELS = tuple(m for pair in FAMILIES.values() for m in pair)


def account_group(v: Column) -> Column:
    whole = v.isNotNull() & (v >= 0) & (v == F.floor(v))
    return F.when(whole & (v >= 3), ACCOUNT_LABELS[3]).when(whole, v.cast("bigint").cast("string"))


def history_group(years: Column) -> Column:
    """Bins open on the left and closed on the right; no history counts as zero years."""
    v = F.coalesce(years, F.lit(0.0))
    out = F.when(v < 0, None)
    for upper, label in zip(HISTORY_UPPER, HISTORY_LABELS):
        out = out.when(v <= upper, label)
    return out.otherwise(HISTORY_LABELS[-1])


def richness(*flags: Column) -> Column:
    """Number of set flags as text; fails the job on a flag that is not 0 or 1."""
    total = sum((F.coalesce(f, F.lit(-1)).cast("int") for f in flags[1:]), F.coalesce(flags[0], F.lit(-1)).cast("int"))
    binary = flags[0].isin(0, 1)
    for f in flags[1:]:
        binary = binary & f.isin(0, 1)
    bad = F.coalesce(~binary, F.lit(True))
    return F.when(bad, F.raise_error(F.lit("module indicators must be 0 or 1"))).otherwise(total.cast("string"))


def pattern_code(*flags: Column) -> Column:
    return F.concat(*[f.cast("int").cast("string") for f in flags])


def information_set(model: Column) -> Column:
    return F.when(model.endswith("_ad"), "T_plus_AD").otherwise("T")


def algorithm_family(model: Column) -> Column:
    return F.regexp_extract(model, r"^(.*)_(t|ad)$", 1)
