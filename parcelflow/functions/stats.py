"""Gated statistics: values only where enough rows stand behind them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent_change(current: Column, previous: Column) -> Column:
    """Change in percent; null where either side is missing or zero."""
    return F.when((current != 0) & (previous > 0), (current - previous) / previous * 100)


def round_half_up(value: Column, digits: int = 0) -> Column:
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale


def median_where(value: Column, condition: Column) -> Column:
    return F.median(F.when(condition, value))


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def gated(value: Column, rows: Column, least: int) -> Column:
    """`value` where at least `least` rows stand behind it."""
    return F.when(rows >= least, value)


def mean_money(value: Column) -> Column:
    """Mean to the cent; a tiny nudge makes exact halves go up whatever the engine's binary rounding."""
    return F.round(F.avg(value) + 1e-7, 2)
