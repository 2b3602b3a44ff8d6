"""Risk level, action and expected loss of a scored row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from duesight.settings import ACTIONS, THRESHOLD_HIGH, THRESHOLD_LOW, UNKNOWN_ACTION


def checked(low: float, high: float) -> tuple[float, float]:
    """The thresholds, if they are in order."""
    if not 0 <= low < high <= 1:
        raise ValueError("thresholds must satisfy 0 <= low < high <= 1")
    return low, high


def risk_level(p: Column, low: float = THRESHOLD_LOW, high: float = THRESHOLD_HIGH) -> Column:
    """A missing or NaN probability compares false, hence LOW."""
    low, high = checked(low, high)
    known = ~F.isnan(p)
    return F.when(known & (p >= high), "HIGH").when(known & (p >= low), "MEDIUM").otherwise("LOW")


def action(level: Column) -> Column:
    out = F.lit(UNKNOWN_ACTION)
    for name, text in ACTIONS.items():
        out = F.when(level == name, text).otherwise(out)
    return out


def expected_loss(amount: Column, p: Column) -> Column:
    return F.abs(F.coalesce(amount, F.lit(0.0))) * p
