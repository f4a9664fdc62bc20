"""Long form of wide prediction tables, subgroup labels and strata."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import groups as G

KEYS = ["case_id", "base_order", "target"]


def unpivot_models(predictions: DataFrame, models: tuple[str, ...], keep: list[str] | None = None) -> DataFrame:
    """(keys, model_id, pd): a narrow projection, no shuffle."""
    return predictions.unpivot(KEYS + (keep or []), list(models), "model_id", "pd")


def add_subgroups(df: DataFrame) -> DataFrame:
    """Account, history and richness labels from pre-model values."""
    return df.withColumns(
        {
            "account_group": G.account_group(F.col("account_count")),
            "history_group": G.history_group(F.col("history_years")),
            "richness_group": G.richness(F.col("has_debit"), F.col("has_deposit"), F.col("has_tax")),
        }
    )


# Stratum dimensions and the label column of each.
DIMENSIONS = {"account_count": "account_group", "bureau_history": "history_group", "ad_richness": "richness_group"}


def expand_strata(df: DataFrame, dimensions: dict[str, str] | None = None) -> DataFrame:
    """Repeat each row for the overall stratum and for its group in every dimension."""
    dimensions = DIMENSIONS if dimensions is None else dimensions
    items = [F.struct(F.lit("overall").alias("dim"), F.lit("ALL").alias("label"))]
    items += [F.struct(F.lit(d).alias("dim"), F.col(c).alias("label")) for d, c in dimensions.items()]
    return df.select("*", F.inline(F.array(*items))).where(F.col("label").isNotNull())
