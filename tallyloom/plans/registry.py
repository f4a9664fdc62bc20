"""Query registry: a Spark callable and, where SQL can state it, an equivalent query."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .inputs import VIEWS
from .sqlviews import SQL_VIEWS

ALL_VIEWS = {**VIEWS, **SQL_VIEWS}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

#: Views that a statement may read several times and that are dear to expand each time.
SHARED_VIEWS = ("scores_long", "scenario_rows", "cal", "cal_fold", "methods", "boot_draws", "boot", "boot_diff", "metric_method", "guard", "best", "boot_ref")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy access to the parquet tables and to the derived input views."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.dir}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(self.path(name))
        if name in VIEWS:
            used = set(re.findall(r"\{(\w+)\}", VIEWS[name]))
            return self.spark.sql(VIEWS[name], **{u: getattr(self, u) for u in used})
        raise AttributeError(name)


_KEPT: dict[tuple[str, str, str], object] = {}


def kept(t: Tables, name: str, build: Callable[[], object]):
    """What ``build`` made of these tables, stored once a session: a frozen table, fitted parameters or a path."""
    key = (t.spark.sparkContext.applicationId, t.dir, name)
    if key not in _KEPT:
        _KEPT[key] = build()
    return _KEPT[key]


def _view_closure(text: str) -> list[str]:
    need: set[str] = set()
    stack = [v for v in ALL_VIEWS if re.search(rf"\b{v}\b", text)]
    while stack:
        v = stack.pop()
        if v not in need:
            need.add(v)
            stack += [u for u in re.findall(r"\{(\w+)\}", ALL_VIEWS[v]) if u in ALL_VIEWS]
    return [v for v in ALL_VIEWS if v in need]


def expand(sql: str) -> str:
    """Prefix the definitions of the input views a statement uses."""
    sql = sql.strip()
    views = [f"{v} AS {'MATERIALIZED ' if v in SHARED_VIEWS else ''}({re.sub(r'{(\w+)}', r'\1', ALL_VIEWS[v]).strip()})" for v in _view_closure(sql)]
    if not views:
        return sql
    head = ",\n".join(views)
    if re.match(r"(?i)with\s", sql):
        return f"WITH {head},\n{sql[4:].strip()}"
    return f"WITH {head}\n{sql}"


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = expand(sql)
        return fn

    return add
