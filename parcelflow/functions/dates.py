"""Dates: parsing without surprises, windows that end at a given day, months."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_month_year(value: Column) -> Column:
    """A strict dd/MM/yyyy date; null for what is no calendar day."""
    text = F.btrim(value)
    return F.when(text.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.try_to_date(text, "dd/MM/yyyy"))


def iso_day(value: Column) -> Column:
    """The calendar day that an ISO text begins with, whatever its zone."""
    head = F.substring(value, 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd"))


def epoch_day(millis: Column) -> Column:
    """The UTC day of milliseconds since the epoch."""
    return F.to_date(F.timestamp_millis(millis))


def rolling(as_of: date, months: int, back: int = 0) -> tuple[Column, Column]:
    """First and last day of the `months` months that end `back` months before `as_of`."""
    end = F.add_months(F.lit(as_of), -back)
    return F.date_add(F.add_months(end, -months), 1), end


def month_index(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day) - 1


def due_text(due: Column, as_of: date) -> Column:
    days = F.datediff(due, F.lit(as_of))
    unit = F.when(F.abs(days) == 1, " day").otherwise(" days")
    return F.when(days == 0, "due today").when(days > 0, F.concat(F.lit("due in "), days.cast("string"), unit)).when(days < 0, F.concat(F.lit("due "), F.abs(days).cast("string"), unit, F.lit(" ago")))


def backoff_minutes(attempt: Column) -> Column:
    return F.least(F.lit(60), (5 * F.pow(F.lit(2), attempt - 1)).cast("int"))
