"""Fitted feature preparation in two representations.

Fitting reads training rows only and keeps a few numbers per column; ``transform`` is one
projection with those numbers as literals, so it needs no shuffle and no Python worker.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from .audit import blocks
from .features import stack_columns
from .longform import count_where
from .ranking import exact_quantiles, order_statistics, value_summary

# Cap level and reserved category tokens.
CAP_QUANTILE = 0.999
MISSING = "__MISSING__"
UNSEEN = "__UNSEEN__"
MAX_VOCABULARY = 10_000  # one output column per level


@dataclass(frozen=True)
class PrepSpec:
    """Column roles; ``first`` lists the base feature set, the rest extends it."""

    numeric: tuple[str, ...]
    monetary: tuple[str, ...]
    log_only: tuple[str, ...]
    clip_negative: tuple[str, ...]
    categories: tuple[str, ...]
    flags: tuple[str, ...]
    first: tuple[str, ...]
    siblings: tuple[tuple[str, tuple[str, ...]], ...] = ()


@dataclass
class Preprocessor:
    spec: PrepSpec
    caps: dict[str, dict] = field(default_factory=dict)
    medians: dict[str, float] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    scales: dict[str, float] = field(default_factory=dict)
    constant: list[str] = field(default_factory=list)
    all_missing: list[str] = field(default_factory=list)
    missing_flags: list[dict] = field(default_factory=list)
    vocabularies: dict[str, list[str]] = field(default_factory=dict)

    # stages of one numeric column

    def clipped(self, c: str) -> Column:
        v = F.col(c).cast("double")
        return F.when(v < 0, F.lit(0.0)).otherwise(v) if c in self.spec.clip_negative else v

    def capped(self, c: str) -> Column:
        v = self.clipped(c)
        cap = self.caps.get(c, {}).get("cap")  # least() would turn a NULL into the cap
        return v if cap is None else F.when(v > F.lit(float(cap)), F.lit(float(cap))).otherwise(v)

    def logged(self, c: str) -> Column:
        v = self.capped(c)
        return F.log1p(v) if c in self.spec.monetary + self.spec.log_only else v

    def filled(self, c: str) -> Column:
        return F.coalesce(self.logged(c), F.lit(float(self.medians[c])))

    def scaled(self, c: str) -> Column:
        return (self.filled(c) - F.lit(float(self.means[c]))) / F.lit(float(self.scales[c]))

    def mapped(self, c: str) -> Column:
        known = [v for v in self.vocabularies[c] if v not in (MISSING, UNSEEN)]
        v = F.col(c).cast("string")
        return F.when(v.isNull(), MISSING).when(v.isin(known), v).otherwise(UNSEEN)

    def one_hot(self, c: str, level: str) -> Column:
        """Indicator of one level; stated per level so that no output carries the whole mapping."""
        v = F.col(c).cast("string")
        if level == MISSING:
            return v.isNull()
        if level == UNSEEN:
            known = [x for x in self.vocabularies[c] if x not in (MISSING, UNSEEN)]
            return F.coalesce(~v.isin(known), F.lit(False)) if known else v.isNotNull()
        return F.coalesce(v == level, F.lit(False))

    # output layout

    def level_columns(self, c: str) -> list[tuple[str, str]]:
        if not self.vocabularies:
            raise ValueError("too many category levels for one column each; encode them with levels.encoded")
        return [(level, level_name(c, level)) for level in self.vocabularies[c]]

    def output_columns(self) -> list[str]:
        """Ordered outputs; the base feature set is an exact prefix."""
        s = self.spec
        base = [c for c in s.numeric if c in s.first]
        base += [f["name"] for f in self.missing_flags if f["first"]]
        base += [name for c in s.categories for _, name in self.level_columns(c)]
        more = [c for c in s.numeric if c not in s.first] + list(s.flags)
        return base + more + [f["name"] for f in self.missing_flags if not f["first"]]

    def base_width(self) -> int:
        s = self.spec
        return (len([c for c in s.numeric if c in s.first]) + len([f for f in self.missing_flags if f["first"]])
                + sum(len(v) for v in self.vocabularies.values()))

    def _numbers(self, representation: str) -> dict[str, Column]:
        stage = {"linear_nn": self.scaled, "gbdt": self.capped}[representation]
        out = {c: stage(c).cast("float") for c in self.spec.numeric}
        out |= {f: F.col(f).cast("byte") for f in self.spec.flags}
        return out | {m["name"]: F.col(m["columns"][0]).isNull().cast("byte") for m in self.missing_flags}

    def numbers(self, df: DataFrame, representation: str, keep: list[str]) -> DataFrame:
        """All outputs but the categories, which ``levels`` encodes for vocabularies of any size."""
        return df.select(*keep, *[v.alias(n) for n, v in self._numbers(representation).items()])

    def transform(self, df: DataFrame, representation: str, keep: list[str]) -> DataFrame:
        """``linear_nn``: cap, log, fill, scale.  ``gbdt``: cap only, missing values kept."""
        out = self._numbers(representation)
        for c in self.spec.categories:
            out |= {name: self.one_hot(c, level).cast("byte") for level, name in self.level_columns(c)}
        return df.select(*keep, *[out[n].alias(n) for n in self.output_columns()])

    # storage

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> "Preprocessor":
        d = json.loads(text)
        s = d.pop("spec")
        spec = PrepSpec(**{k: tuple(tuple(x) if isinstance(x, list) else x for x in v) for k, v in s.items() if k != "siblings"},
                        siblings=tuple((name, tuple(cols)) for name, cols in s["siblings"]))
        return Preprocessor(spec=spec, **d)

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.mode("errorifexists").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Preprocessor":
        return Preprocessor.from_json(spark.read.text(path, wholetext=True).first()["value"].strip())


def level_name(column: str, level: str) -> str:
    """Deterministic one-hot name: reserved levels by word, others by a hash prefix."""
    if level in (MISSING, UNSEEN):
        return f"ohe_{column}__{level.strip('_').lower()}"
    return f"ohe_{column}__{hashlib.sha1(level.encode()).hexdigest()[:10]}"


def negative_counts(train: DataFrame, spec: PrepSpec) -> DataFrame:
    """Negative training values per column and whether clipping is authorised."""
    a = train.agg(*[count_where(F.col(c) < 0).alias(c) for c in spec.numeric])
    return a.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("input_column"), F.col(c).alias("negative_count"), F.lit(c in spec.clip_negative).alias("clipping_allowed"))
        for c in spec.numeric])))


def fit(df: DataFrame, spec: PrepSpec, train: Column) -> Preprocessor:
    """Fit caps, medians, scaling, missing flags and vocabularies on the training rows.

    Clip, cap and log are monotone, so one pass of order statistics of the clipped values
    gives both the cap and, mapped through cap and log, the median.
    """
    p, rows = Preprocessor(spec), df.where(train)
    stats = column_counts(rows, spec)
    clip = rows.select(*[p.clipped(c).alias(c) for c in spec.numeric])
    order = order_statistics(stack_columns(clip, [], list(spec.numeric), "c"), ["c"], "v", {"cap": CAP_QUANTILE, "mid": 0.5})
    order = {r["c"]: r for r in order.collect()}  # one row per column
    for c in spec.monetary:
        r = order.get(c)
        if r is None:
            p.caps[c] = {"status": "TRAIN_ALL_MISSING", "cap": None, "computed": None, "n": 0}
            continue
        pos = CAP_QUANTILE * (r["n"] - 1)
        q = r["cap_lo"] + (r["cap_hi"] - r["cap_lo"]) * (pos - int(pos))
        skip = q == 0 and stats[f"pos_{c}"] > 0
        p.caps[c] = {"status": "CAP_SKIPPED_DEGENERATE_ZERO" if skip else "CAP_APPLIED", "cap": None if skip else q,
                     "computed": q, "n": r["n"]}
    mids = [c for c in spec.numeric if c in order]
    p.all_missing = [c for c in spec.numeric if c not in order]
    p.medians = {c: 0.0 for c in p.all_missing}
    if mids:
        one = rows.sparkSession.createDataFrame(
            [tuple(float(order[c][k]) for c in mids) for k in ("mid_lo", "mid_hi")], ", ".join(f"`{c}` double" for c in mids))
        low, high = one.select(*[p.logged(c).alias(c) for c in mids]).orderBy(*mids).collect()
        p.medians |= {c: (low[c] + high[c]) / 2 for c in mids}
    moments: dict[str, float] = {}
    for cols in blocks(list(spec.numeric)):
        moments |= rows.agg(*[x for c in cols for x in (
            F.avg(p.filled(c)).alias(f"m_{c}"), F.stddev_pop(p.filled(c)).alias(f"s_{c}"),
            F.min(p.filled(c)).alias(f"lo_{c}"), F.max(p.filled(c)).alias(f"hi_{c}"))]).first().asDict()
    for c in spec.numeric:
        p.means[c] = moments[f"m_{c}"]
        if moments[f"lo_{c}"] == moments[f"hi_{c}"]:
            p.constant.append(c)
            p.scales[c] = 1.0
        else:
            p.scales[c] = moments[f"s_{c}"]

    p.missing_flags = missing_flags(stats, spec)
    p.vocabularies = vocabularies(rows, spec)
    return p


def column_counts(rows: DataFrame, spec: PrepSpec) -> Row:
    """Present, negative and positive values per column of the training rows; refuses what the contract of the columns forbids."""
    stats = rows.agg(*[x for c in spec.numeric for x in (
        count_where(F.col(c) < 0).alias(f"neg_{c}"), F.count(c).alias(f"n_{c}"), count_where(F.col(c) > 0).alias(f"pos_{c}"))],
        *[F.bool_and(F.col(cols[0]).isNull() == F.col(o).isNull()).alias(f"same_{name}_{o}") for name, cols in spec.siblings for o in cols[1:]],
        F.count(F.lit(1)).alias("n")).first()
    bad = [c for c in spec.numeric if stats[f"neg_{c}"] and c not in spec.clip_negative]
    if bad:
        raise ValueError(f"negative training values in {bad}")
    uneven = [name for name, cols in spec.siblings for o in cols[1:] if not stats[f"same_{name}_{o}"]]
    if uneven:
        raise ValueError(f"sibling columns differ in their missing rows: {uneven}")
    return stats


def missing_flags(stats: Row, spec: PrepSpec) -> list[dict]:
    """One flag per column with missing training values; sibling columns share theirs."""
    shared, out = {c: (name, cols) for name, cols in spec.siblings for c in cols}, []
    done: set[str] = set()
    for c in spec.numeric:
        if c in done or stats[f"n_{c}"] == stats["n"]:
            continue
        name, cols = shared.get(c, (c, (c,)))
        out.append({"name": f"missing_{name}", "columns": list(cols), "first": c in spec.first})
        done |= set(cols)
    return out


def vocabularies(rows: DataFrame, spec: PrepSpec) -> dict[str, list[str]]:
    """Sorted training levels per category plus the two reserved levels; none at all beyond ``MAX_VOCABULARY`` levels.

    They are only needed for one column per level; ``levels.level_index`` holds any number.
    """
    long = rows.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in spec.categories])))
    levels = long.where(F.col("v").isNotNull()).distinct()
    found = levels.limit(MAX_VOCABULARY + 1).collect()  # each level becomes a column
    if len(found) > MAX_VOCABULARY:
        return {}
    out = {c: sorted(r["v"] for r in found if r["c"] == c) for c in spec.categories}
    for c, v in out.items():
        if MISSING in v or UNSEEN in v:
            raise ValueError(f"reserved category token occurs in {c}")
    return {c: [*v, MISSING, UNSEEN] for c, v in out.items()}


def parameter_table(spark: SparkSession, p: Preprocessor) -> DataFrame:
    rows = [(c, p.caps.get(c, {}).get("status"), p.caps.get(c, {}).get("cap"), p.medians[c], p.means[c], p.scales[c], c in p.constant, None)
            for c in p.spec.numeric]
    rows += [(c, None, None, None, None, None, None, json.dumps(p.vocabularies[c], separators=(",", ":"))) for c in p.spec.categories]
    return spark.createDataFrame(rows, "input_column string, cap_status string, cap_value double, median double, scaler_mean double, "
                                       "scaler_scale double, constant_on_train boolean, vocabulary string")


def effects(df: DataFrame, p: Preprocessor, split: str) -> DataFrame:
    """Counts and exact quantiles of the original, capped and transformed stage per column and split."""
    s = p.spec
    items = []
    for c in s.numeric:
        cap = p.caps.get(c, {}).get("cap")
        over = p.clipped(c) > F.lit(cap) if cap is not None else F.lit(False)
        items.append(F.struct(
            F.lit(c).alias("input_column"), F.col(c).cast("double").alias("raw"), p.capped(c).alias("capped"), p.logged(c).alias("transformed"),
            F.coalesce(over, F.lit(False)).alias("over"), F.lit(c in s.clip_negative).alias("clip")))
    long = df.select(F.col(split).alias("split"), F.inline(F.array(*items)))
    raw = F.col("raw")
    base = long.groupBy("input_column", "split").agg(
        F.count(F.lit(1)).alias("row_count"), F.count(raw).alias("original_finite"), count_where(raw.isNull()).alias("original_missing"),
        count_where(raw == 0).alias("original_zero"), count_where(raw < 0).alias("original_negative"),
        count_where(F.col("clip") & (raw < 0)).alias("negative_clipped"), count_where(F.col("over")).alias("upper_clipped"),
        F.max(raw).alias("original_max"), F.max("capped").alias("capped_max"), F.max("transformed").alias("transformed_max"))
    stages = long.select("input_column", "split", F.inline(F.array(*[
        F.struct(F.lit(k).alias("stage"), F.col(x).alias("v")) for k, x in (("original", "raw"), ("capped", "capped"), ("transformed", "transformed"))])))
    q = exact_quantiles(stages, ["input_column", "split", "stage"], "v", {"median": 0.5, "p99": 0.99})
    wide = q.groupBy("input_column", "split").pivot("stage", ["original", "capped", "transformed"]).agg(
        F.max("median").alias("median"), F.max("p99").alias("p99"))
    out = base.join(wide, ["input_column", "split"], "left")
    doubles = [c for c, t in out.dtypes if t == "double"]
    return out.select(*[F.round(c, 6).alias(c) if c in doubles else F.col(c) for c in out.columns])


def category_audit(df: DataFrame, p: Preprocessor, split: str) -> DataFrame:
    """Missing and unseen levels per category and split, and the one-hot row sums."""
    items = []
    for c in p.spec.categories:
        total = sum((p.one_hot(c, level).cast("int") for level, _ in p.level_columns(c)), F.lit(0))
        items.append(F.struct(F.lit(c).alias("input_column"), p.mapped(c).alias("m"), total.alias("ones"),
                              F.lit(len(p.vocabularies[c])).cast("bigint").alias("output_count")))
    long = df.select(F.col(split).alias("split"), F.inline(F.array(*items)))
    return long.groupBy("input_column", "split", "output_count").agg(
        F.count(F.lit(1)).alias("row_count"), count_where(F.col("m") == MISSING).alias("missing_count"),
        count_where(F.col("m") == UNSEEN).alias("unseen_count"), count_where(F.col("ones") != 1).alias("row_sum_violations"))


def _kind(p: Preprocessor, name: str) -> str:
    if name in p.spec.numeric:
        return "substantive_numeric"
    if name in p.spec.flags:
        return "original_indicator"
    return "missing_indicator" if name.startswith("missing_") else "one_hot"


def constant_columns(df: DataFrame, p: Preprocessor, train: Column, representations: tuple[str, ...] = ("linear_nn", "gbdt")) -> DataFrame:
    """Prepared columns that hold a single value on the training rows."""
    out = None
    for rep in representations:
        m = p.transform(df.where(train), rep, [])
        cols = p.output_columns()
        a = m.agg(F.count(F.lit(1)).alias("n"), *[x for i, c in enumerate(cols) for x in (
            F.count(c).alias(f"c{i}"), F.min(c).cast("double").alias(f"lo{i}"), F.max(c).cast("double").alias(f"hi{i}"))])
        rows = a.select(F.inline(F.array(*[
            F.struct(F.lit(rep).alias("representation"), F.lit(c).alias("prepared_column"), F.lit(_kind(p, c)).alias("prepared_type"),
                     F.col("n").alias("train_rows"), F.col(f"c{i}").alias("finite_count"), F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi"))
            for i, c in enumerate(cols)])))
        keep = (F.col("finite_count") == 0) | ((F.col("finite_count") == F.col("train_rows")) & (F.col("lo") == F.col("hi")))
        rows = rows.where(keep).select("representation", "prepared_column", "prepared_type", "train_rows", "finite_count", F.col("lo").alias("constant_value"))
        out = rows if out is None else out.unionByName(rows)
    return out


def standardized_audit(df: DataFrame, p: Preprocessor, role: str) -> DataFrame:
    """Quantiles and extreme counts of scaled values, over all rows and over observed rows."""
    items = []
    for c in p.spec.numeric:
        v = p.scaled(c)
        items.append(F.struct(F.lit(c).alias("input_column"), F.lit("all_rows_after_imputation").alias("slice"), v.alias("v")))
        items.append(F.struct(F.lit(c).alias("input_column"), F.lit("originally_observed_content").alias("slice"),
                              F.when(F.col(c).isNotNull(), v).alias("v")))
    long = df.select(F.col(role).alias("role"), F.inline(F.array(*items))).where(F.col("v").isNotNull())
    by = ["role", "input_column", "slice"]
    probs = {"q0001": 0.001, "q001": 0.01, "median": 0.5, "q099": 0.99, "q0999": 0.999}
    extreme = long.groupBy(*by).agg(count_where(F.abs("v") > 10).alias("abs_gt_10_count"), count_where(F.abs("v") > 20).alias("abs_gt_20_count"))
    s = value_summary(long, by, "v", probs, distinct=False).join(extreme, by)
    return s.select(*by, F.col("n").alias("denominator"), *[F.round(c, 6).alias(c) for c in ("min", *probs, "max")], "abs_gt_10_count", "abs_gt_20_count")


def integrity(df: DataFrame, p: Preprocessor, role: str) -> DataFrame:
    """Binary columns hold 0/1 only, one-hot groups sum to one, reserved levels and their activations."""
    m = p.transform(df, "linear_nn", [role])
    binary = [c for c in p.output_columns() if c not in p.spec.numeric]
    groups = {c: [n for _, n in p.level_columns(c)] for c in p.spec.categories}
    aggs = [F.count(F.lit(1)).alias("n")]
    items = []
    for i, c in enumerate(binary):
        aggs += [count_where(F.col(c).isNull() | ~F.col(c).isin(0, 1)).alias(f"b{i}"), F.coalesce(F.sum(F.col(c).cast("bigint")), F.lit(0)).alias(f"a{i}")]
        items.append(F.struct(F.lit("binary_values").alias("check_id"), F.lit(c).alias("column_or_group"),
                              F.col(f"b{i}").alias("violation_count"), F.col(f"a{i}").alias("active_count")))
    for i, (g, cols) in enumerate(groups.items()):
        total = sum((F.col(c).cast("int") for c in cols), F.lit(0))
        aggs.append(count_where(total != 1).alias(f"g{i}"))
        items.append(F.struct(F.lit("one_hot_group_sum").alias("check_id"), F.lit(g).alias("column_or_group"),
                              F.col(f"g{i}").alias("violation_count"), F.col("n").alias("active_count")))
    wide = m.groupBy(F.col(role).alias("role")).agg(*aggs)
    return wide.select("role", F.col("n").alias("row_count"), F.inline(F.array(*items))).withColumn(
        "status", F.when(F.col("violation_count") == 0, "PASS").otherwise("FAIL"))


def transform_trace(df: DataFrame, p: Preprocessor, key: str, order: str) -> DataFrame:
    """First entity per reason and column, with every stage of its value.

    One aggregate finds the smallest order of each, so only those rows are spelt out and compared.
    """
    s, reasons = p.spec, []
    for c in s.numeric:
        v = F.col(c).cast("double")
        cap = p.caps.get(c, {}).get("cap")
        if c in s.clip_negative:
            reasons.append((c, "negative_clipped", v < 0))
        if cap is not None:
            reasons.append((c, "upper_clipped", v > F.lit(cap)))
        reasons += [(c, "missing_filled_for_linear", v.isNull()), (c, "observed_zero_kept", v == 0)]
    stage = lambda c: [F.col(c).cast("double").alias("original_value"), p.clipped(c).alias("after_clipping"),
                       p.capped(c).alias("after_cap"), p.logged(c).alias("after_log"), p.filled(c).alias("after_fill"), p.scaled(c).alias("scaled_value")]
    items = F.array_compact(F.array(*[
        F.when(cond, F.struct(F.lit(c).alias("input_column"), F.lit(why).alias("reason"), *stage(c))) for c, why, cond in reasons]))
    least = df.agg(*[F.min(F.when(cond, F.col(order))).alias(f"r{i}") for i, (_, _, cond) in enumerate(reasons)])
    wanted = least.select(F.explode(F.array_compact(F.array(*least.columns))).alias(order)).distinct()  # at most one a reason
    hits = df.join(F.broadcast(wanted), order, "left_semi").select(key, order, F.inline(items))
    cols = [c for c in hits.columns if c not in (order, "input_column", "reason")]
    first = hits.groupBy("input_column", "reason").agg(F.min_by(F.struct(*cols), order).alias("x"))
    return first.select("input_column", "reason", *[F.col(f"x.{c}") if c == key else F.round(f"x.{c}", 6).alias(c) for c in cols])
