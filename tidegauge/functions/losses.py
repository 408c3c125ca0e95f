"""Forecast losses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def qlike(true: str, predicted: str) -> Column:
    """exp(u) - u - 1 with u = ln(true / predicted); an error for values that are not positive."""
    t, p = F.col(true), F.col(predicted)
    u = F.ln(t) - F.ln(p)
    bad = (t <= 0) | (p <= 0) | F.isnan(t) | F.isnan(p)
    return F.when(bad, F.raise_error(F.lit("a loss needs positive values")).cast("double")).otherwise(F.exp(u) - u - 1)


def half_gamma_deviance(true: str, predicted: str) -> Column:
    """The same loss written as half the deviance of a Gamma model."""
    ratio = F.col(true) / F.col(predicted)
    return ratio - 1 - F.ln(ratio)


def usable(*columns: str) -> Column:
    """Every column is a finite positive number."""
    test = F.lit(True)
    for c in columns:
        test = test & F.coalesce((F.col(c) > 0) & ~F.isnan(c) & (F.col(c) < F.lit(float("inf"))), F.lit(False))
    return test


def finite(*columns: str) -> Column:
    """Every column is a finite number; null counts as not finite."""
    test = F.lit(True)
    for c in columns:
        x = F.col(c).cast("double")
        test = test & F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))
    return test
