"""The public history of applications: corrected dates, a decision's wording, and what is not shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.functions import text as T
from parcelflow.operators.planning import HIDDEN, MILESTONES

#: Places of events within a day, those of construction after all milestones.
ORDINALS = {event: k for k, event in enumerate(MILESTONES)} | {"works_commenced": 20, "completion_certificate_validated": 21}


def _strict_date(value: Column) -> Column:
    """The date of a YYYY-MM-DD text that the calendar has; null otherwise."""
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), value.try_cast("date"))


def _said(value: Column) -> Column:
    """The text, null for blanks and placeholders."""
    text = T.squeeze(value)
    return F.when(~F.lower(text).isin(*(p for p in T.PLACEHOLDERS if p != "not recorded in source")), text)


def _order(day: str = "event_date") -> list[Column]:
    place = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in ORDINALS.items() for x in pair]), F.col("event_type")), F.lit(99))
    return [F.col(day), place, F.col("detected_at"), F.col("event_key")]


def resolved(events: DataFrame) -> DataFrame:
    """All events with their dates after corrections.

    The corrections of an application's field fold in order of detection, then key: each moves a date that is
    its old value to its new one, so that chains are followed and corrections of another value do nothing. Corrections
    themselves stay as they are. events: application_id, event_type, event_date, detected_at, source_field,
    old_value, new_value, event_key and any others.
    """
    old, new = _strict_date(F.col("old_value")), _strict_date(F.col("new_value"))
    corrections = events.where("event_type = 'source_date_corrected' and source_field is not null").where(old.isNotNull() & new.isNotNull())
    steps = corrections.groupBy("application_id", "source_field").agg(F.sort_array(F.collect_list(F.struct("detected_at", "event_key", old.alias("old"), new.alias("new")))).alias("steps"))
    both = events.join(steps, ["application_id", "source_field"], "left")
    moved = F.aggregate("steps", F.col("event_date"), lambda day, c: F.when(day == c["old"], c["new"]).otherwise(day))
    day = F.when((F.col("event_type") == "source_date_corrected") | F.col("steps").isNull(), F.col("event_date")).otherwise(moved)
    return both.select(*(day.alias(c) if c == "event_date" else F.col(c) for c in events.columns))


def public_timeline(events: DataFrame) -> DataFrame:
    """application_id, place, event_type, event_date, label, event_key of the shown events, in order.

    Dates are corrected first. The first decision that a source dates takes the wording of the first change of
    decision text from nothing to something. Technical events are left out.
    """
    now = resolved(events)
    by = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(_order())))
    dated = now.where("event_type = 'decision_made' and source_field is not null").groupBy("application_id").agg(F.min_by("event_key", by).alias("decision_key"))
    worded = now.where("event_type = 'decision_changed'").where(_said(F.col("old_value")).isNull() & _said(F.col("new_value")).isNotNull())
    worded = worded.groupBy("application_id").agg(F.min_by(_said(F.col("new_value")), by).alias("wording"))
    told = dated.join(worded, "application_id")
    shown = now.where(~F.col("event_type").isin(*HIDDEN)).join(told, "application_id", "left")
    label = F.when(F.coalesce(F.col("event_key") == F.col("decision_key"), F.lit(False)), F.concat(F.lit("Decision: "), "wording")).otherwise(F.col("label"))
    place = F.row_number().over(Window.partitionBy("application_id").orderBy(*_order()))
    return shown.select("application_id", place.alias("place"), "event_type", "event_date", label.alias("label"), "event_key")
