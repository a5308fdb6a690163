"""Scoring expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(prediction: Column) -> Column:
    """Nonnegative forecast rounded half to even."""
    return F.rint(F.greatest(prediction, F.lit(0.0)))


def wape(error: Column, actual: Column) -> Column:
    """Pooled error over demand; NULL without demand."""
    return F.try_divide(error, actual)


def winkler(lower: Column, upper: Column, level: Column, actual: Column) -> Column:
    """Width plus ``2/alpha`` times the distance missed."""
    missed = F.greatest(lower - actual, F.lit(0.0)) + F.greatest(actual - upper, F.lit(0.0))
    return (upper - lower) + F.lit(2.0) / (F.lit(1.0) - level) * missed


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def half_life(age: Column, days: float) -> Column:
    return F.pow(F.lit(2.0), -age / days)


def bounded(anchor: Column, correction: Column, cap: float) -> Column:
    """An anchor changed by at most ``cap``."""
    return anchor * (F.lit(1.0) + clip(correction, -cap, cap))


def bounded_hybrid(anchor: Column, uniform: Column, recency: Column, cap: float = 0.05) -> Column:
    """Half the anchor and a quarter of each bounded correction."""
    return anchor * 0.5 + bounded(anchor, uniform, cap) * 0.25 + bounded(anchor, recency, cap) * 0.25
