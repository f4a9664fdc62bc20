"""Content coverage of components and modules over the population."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import states as S
from .longform import count_where, ratio

MEASURES = ("content", "nonzero", "zero_only", "invalid", "auxiliary_evidence", "field_evidence")
MODULE_MEASURES = ("content", "nonzero", "zero_only", "auxiliary_only", "field_evidence", "no_content", "invalid")


@dataclass(frozen=True)
class Component:
    """One source's contribution to a module: amount fields and auxiliary fields."""

    module: str
    source: str
    economic: tuple[str, ...]
    auxiliary: tuple[str, ...] = field(default_factory=tuple)


def any_of(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols) if cols else F.lit(False)


def _populated(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    return c.isNotNull() & ~S.blank(c) if S.is_text(df, name) else c.isNotNull()


def component_flags(spine: DataFrame, sources: dict[str, DataFrame], components: dict[str, Component], key: str,
                    keep: list[str] | None = None) -> DataFrame:
    """Per entity: ``source__<s>`` row counts and ``<component>__<measure>`` flags.

    Each source is read once and reduced to one row per key with boolean aggregates.
    """
    out = spine.select(key, *(keep or []))
    for name, df in sources.items():
        aggs = [F.count(F.lit(1)).alias(f"source__{name}")]
        used = list(dict.fromkeys(f for c in components.values() if c.source == name for f in c.economic))
        for cname, c in components.items():
            if c.source != name:
                continue
            val = {f: F.col(f"{f}__value") for f in c.economic}
            st = {f: F.col(f"{f}__state") for f in c.economic}
            aggs += [
                F.bool_or(any_of([v.isNotNull() for v in val.values()])).alias(f"{cname}__content"),
                F.bool_or(any_of([F.coalesce(v != 0, F.lit(False)) for v in val.values()])).alias(f"{cname}__any_nonzero"),
                F.bool_or(any_of([s.isin("unparseable", "nonfinite") for s in st.values()])).alias(f"{cname}__invalid"),
                F.bool_or(any_of([s != "missing" for s in st.values()])).alias(f"{cname}__economic"),
                F.bool_or(any_of([_populated(df, a) for a in c.auxiliary])).alias(f"{cname}__auxiliary_evidence"),
            ]
        reduced = S.classify(df.where(F.col(key).isNotNull()), used).groupBy(key).agg(*aggs)
        out = out.join(reduced, key, "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    cols: dict[str, Column] = {}
    for cname in components:
        content, nz = flag(F.col(f"{cname}__content")), flag(F.col(f"{cname}__any_nonzero"))
        aux = flag(F.col(f"{cname}__auxiliary_evidence"))
        cols[f"{cname}__content"] = content
        cols[f"{cname}__nonzero"] = content & nz
        cols[f"{cname}__zero_only"] = content & ~nz
        cols[f"{cname}__invalid"] = flag(F.col(f"{cname}__invalid"))
        cols[f"{cname}__auxiliary_evidence"] = aux
        cols[f"{cname}__field_evidence"] = flag(F.col(f"{cname}__economic")) | aux
    return out.select(key, *(keep or []), *[F.coalesce(f"source__{s}", F.lit(0)).alias(f"source__{s}") for s in sources], *[v.alias(k) for k, v in cols.items()])


def module_flags(flags: DataFrame, components: dict[str, Component]) -> DataFrame:
    """Add ``module_<m>__<measure>``: the union of the module's components."""
    cols: dict[str, Column] = {}
    for m in dict.fromkeys(c.module for c in components.values()):
        members = [n for n, c in components.items() if c.module == m]
        union = {k: any_of([F.col(f"{n}__{k}") for n in members]) for k in MEASURES}
        cols |= {
            f"module_{m}__content": union["content"], f"module_{m}__nonzero": union["content"] & union["nonzero"],
            f"module_{m}__zero_only": union["content"] & ~union["nonzero"],
            f"module_{m}__auxiliary_only": union["auxiliary_evidence"] & ~union["content"],
            f"module_{m}__field_evidence": union["field_evidence"], f"module_{m}__no_content": ~union["content"],
            f"module_{m}__invalid": union["invalid"],
        }
    return flags.withColumns(cols)


def coverage_rows(flags: DataFrame, masks: list[tuple[str, str, str, Column]]) -> DataFrame:
    """(scope, name, measure, count, rate) of boolean masks, in one aggregate pass."""
    wide = flags.agg(F.count(F.lit(1)).alias("n"), *[count_where(m).alias(f"m{i}") for i, (*_, m) in enumerate(masks)])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(s).alias("scope_type"), F.lit(name).alias("scope_name"), F.lit(measure).alias("measure"),
                 F.col(f"m{i}").alias("population_count"), F.col("n").alias("denominator_value"),
                 F.round(ratio(F.col(f"m{i}"), F.col("n")), 9).alias("rate"))
        for i, (s, name, measure, _) in enumerate(masks)])))


def coverage_masks(components: dict[str, Component], sources: list[str]) -> list[tuple[str, str, str, Column]]:
    c = F.col
    masks = [("SOURCE_CONTAINER", s, "matched_source_footprint", c(f"source__{s}") > 0) for s in sources]
    for n in components:
        masks += [("MODULE_COMPONENT", n, k, c(f"{n}__{k}")) for k in MEASURES]
        masks.append(("MODULE_COMPONENT", n, "auxiliary_only", c(f"{n}__auxiliary_evidence") & ~c(f"{n}__content")))
    modules = list(dict.fromkeys(x.module for x in components.values()))
    for m in modules:
        masks += [("MODULE", m, k, c(f"module_{m}__{k}")) for k in MODULE_MEASURES]
    k = sum((c(f"module_{m}__content").cast("int") for m in modules[1:]), c(f"module_{modules[0]}__content").cast("int"))
    masks += [("CROSS_MODULE", "all", "at_least_one_module", k >= 1), ("CROSS_MODULE", "all", "exactly_one_module", k == 1),
              ("CROSS_MODULE", "all", "exactly_two_modules", k == 2), ("CROSS_MODULE", "all", "all_modules", k == len(modules))]
    return masks


def unique_contribution(components: dict[str, Component]) -> list[tuple[str, str, str, Column]]:
    """Content of a component that no other component of its module has."""
    out = []
    for n, c in components.items():
        others = [F.col(f"{o}__content") for o, x in components.items() if o != n and x.module == c.module]
        out.append(("MODULE_COMPONENT", n, "unique_content", F.col(f"{n}__content") & ~any_of(others)))
    return out


def pattern_counts(flags: DataFrame, kind: str, bits: list[Column]) -> DataFrame:
    """All 2^k patterns of k flags, patterns that do not occur included with count 0."""
    code = F.concat(*[b.cast("int").cast("string") for b in bits])
    seen = flags.groupBy(code.alias("pattern")).agg(F.count(F.lit(1)).alias("c"))
    spark = flags.sparkSession
    grid = spark.range(2 ** len(bits)).select(F.lpad(F.bin("id"), len(bits), "0").alias("pattern"))
    n = Window.partitionBy("pattern_type")  # 2^k rows
    return (
        grid.join(seen, "pattern", "left")
        .select(F.lit(kind).alias("pattern_type"), "pattern", F.coalesce("c", F.lit(0)).alias("pattern_count"))
        .withColumn("denominator_value", F.sum("pattern_count").over(n))
        .withColumn("rate", F.round(ratio(F.col("pattern_count"), F.col("denominator_value")), 9))
    )


def monthly_coverage(flags: DataFrame, day: str, modules: list[str]) -> DataFrame:
    c = [F.col(f"module_{m}__content") for m in modules]
    masks = {**{f"{m}_content": x for m, x in zip(modules, c)}, "any_module": any_of(c), "all_modules": reduce(lambda a, b: a & b, c)}
    month = F.coalesce(F.date_format(day, "yyyy-MM"), F.lit("UNKNOWN_DATE"))
    a = flags.groupBy(month.alias("calendar_month")).agg(
        F.count(F.lit(1)).alias("entity_count"), *[count_where(m).alias(f"{k}_count") for k, m in masks.items()])
    out = a.withColumns({f"{k}_rate": F.round(ratio(F.col(f"{k}_count"), F.col("entity_count")), 9) for k in masks})
    return out.orderBy(F.col("calendar_month") == "UNKNOWN_DATE", "calendar_month")


def family_coverage(df: DataFrame, families: dict[str, list[str]]) -> DataFrame:
    """Finite and nonzero content per feature family and of their union, with conditional rates."""
    fin = {f: any_of([F.col(x).isNotNull() for x in cols]) for f, cols in families.items()}
    nz = {f: any_of([F.coalesce(F.col(x) != 0, F.lit(False)) for x in cols]) for f, cols in families.items()}
    fin["union"], nz["union"] = any_of(list(fin.values())), any_of(list(nz.values()))
    a = df.agg(F.count(F.lit(1)).alias("n"), *[count_where(m).alias(f"f_{k}") for k, m in fin.items()],
               *[count_where(m).alias(f"z_{k}") for k, m in nz.items()])
    return a.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("family"), F.col("n").alias("population"), F.col(f"f_{k}").alias("content_count"),
                 F.round(ratio(F.col(f"f_{k}"), F.col("n")), 9).alias("content_rate"), F.col(f"z_{k}").alias("nonzero_count"),
                 F.round(ratio(F.col(f"z_{k}"), F.col(f"f_{k}")), 9).alias("nonzero_given_content"))
        for k in fin])))
