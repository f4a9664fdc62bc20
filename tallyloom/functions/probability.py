"""Probability arithmetic shared by metrics and calibration."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: double machine epsilon, the endpoint protection of logit and log loss.
EPS = 2.220446049250313e-16


def protected(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(EPS)), F.lit(1.0 - EPS))


def logit(p: Column) -> Column:
    c = protected(p)
    return F.ln(c) - F.log1p(-c)


def sigmoid(x: Column) -> Column:
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, F.lit(1.0) / (F.lit(1.0) + e)).otherwise(e / (F.lit(1.0) + e))


def log_loss(y: Column, p: Column) -> Column:
    c = protected(p)
    return -(y * F.ln(c) + (F.lit(1) - y) * F.log1p(-c))


def squared_error(y: Column, p: Column) -> Column:
    return (p - y) * (p - y)
