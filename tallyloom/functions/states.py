"""Row-level classifiers: missing, unparseable, zero and absent are never mixed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DateType, StringType, TimestampNTZType, TimestampType

# Names of the states in reports.
ROW_STATES = ("missing", "unparseable", "nonfinite", "zero", "positive", "negative")
FINITE_STATES = ("zero", "positive", "negative")
DATE_STATES = ("native_missing", "empty", "parseable", "parse_failure")
TEXT_STATES = ("native_missing", "empty_or_whitespace", "populated")
ENTITY_STATES = (
    "NO_SOURCE_RECORD",
    "SOURCE_PRESENT_NO_FINITE_OBSERVATION",
    "FINITE_OBSERVATIONS_ZERO_ONLY",
    "AT_LEAST_ONE_FINITE_NONZERO_OBSERVATION",
)
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss")

# try_cast accepts Java suffixes such as "2.5d" and the word NaN; this pattern does not.
_NUMBER = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"
_INF = float("inf")


def blank(c: Column) -> Column:
    """Nothing but white space."""
    return c.rlike(r"\A\s*\z")


def is_text(df: DataFrame, field: str) -> bool:
    return isinstance(df.schema[field].dataType, StringType)


def as_number(c: Column, text: bool) -> Column:
    """Parsed double; NULL when missing or unparseable, infinities kept."""
    if text:
        return F.when(c.rlike(_NUMBER), F.trim(c).try_cast("double"))
    v = c.cast("double")
    return F.when(~F.isnan(v), v)


def numeric_state(c: Column, text: bool, parsed: Column | None = None) -> Column:
    """State of a value; ``parsed`` is its ``as_number`` when that is already a column."""
    v = as_number(c, text) if parsed is None else parsed
    absent = F.when(c.isNull(), "missing").when(v.isNull(), "unparseable") if text else F.when(v.isNull(), "missing")
    return (
        absent.when(v.isin(_INF, -_INF), "nonfinite")
        .when(v == 0, "zero")
        .when(v > 0, "positive")
        .otherwise("negative")
    )


def finite_value(c: Column, text: bool) -> Column:
    v = as_number(c, text)
    return F.when(~v.isin(_INF, -_INF), v)


def classify(df: DataFrame, fields: list[str]) -> DataFrame:
    """Add ``<field>__state`` and ``<field>__value`` (finite or NULL) for every field.

    Texts are parsed in a projection of their own, so each value is parsed once.
    """
    parsed = df.withColumns({f"{f}__parsed": as_number(F.col(f), is_text(df, f)) for f in fields})
    out = {}
    for f in fields:
        v = F.col(f"{f}__parsed")
        out[f"{f}__state"] = numeric_state(F.col(f), is_text(df, f), v)
        out[f"{f}__value"] = F.when(~v.isin(_INF, -_INF), v)
    return parsed.withColumns(out).drop(*[f"{f}__parsed" for f in fields])


def as_day(df: DataFrame, field: str) -> Column:
    """Calendar date of a text, date or timestamp column; NULL when it cannot be read."""
    c, kind = F.col(field), df.schema[field].dataType
    if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        return c.cast("date")
    return F.coalesce(*[F.try_to_timestamp(F.btrim(c, F.lit(" \t\n\r\x0b\x0c")), F.lit(fmt)) for fmt in DATE_FORMATS]).cast("date")


def date_state(df: DataFrame, field: str, day: Column | None = None) -> Column:
    """State of a date; ``day`` is its ``as_day`` when that is already a column."""
    c = F.col(field)
    state = F.when(c.isNull(), "native_missing")
    if is_text(df, field):
        state = state.when(blank(c), "empty")
    return state.when((as_day(df, field) if day is None else day).isNotNull(), "parseable").otherwise("parse_failure")


def text_state(c: Column) -> Column:
    return F.when(c.isNull(), "native_missing").when(blank(c), "empty_or_whitespace").otherwise("populated")


def entity_state(source: Column, finite: Column, nonzero: Column) -> Column:
    """Four-way partition of an entity by its source, finite and nonzero row counts."""
    no_source, no_finite, zero_only, content = ENTITY_STATES
    return (
        F.when(F.coalesce(source, F.lit(0)) == 0, no_source)
        .when(F.coalesce(finite, F.lit(0)) == 0, no_finite)
        .when(F.coalesce(nonzero, F.lit(0)) == 0, zero_only)
        .otherwise(content)
    )


def label_class(c: Column) -> Column:
    return (
        F.when(c.isNull(), "missing").when(c == 0, "target_0").when(c == 1, "target_1").otherwise("other")
    )


def integer_like(v: Column, atol: float = 1e-12) -> Column:
    return F.abs(v - F.rint(v)) <= atol


def valid_index(c: Column) -> Column:
    """Non-negative integer local row index that fits 32 bits."""
    v = c.cast("double")
    return F.coalesce((v == F.floor(v)) & (v >= 0) & (v <= 4294967295), F.lit(False))


def close(a: Column, b: Column, rtol: float = 1e-9, atol: float = 1e-12) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)
