"""Bulk backfill of lifecycle dates: stored rows, new events and counters from one comparison."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelflow.sources.shared import materialised

#: The dates that a source may bring, with the event and the label of those that are milestones.
FIELDS: dict[str, tuple[str, str] | None] = {
    "further_information_requested_date": ("further_information_requested", "Further information requested"),
    "further_information_received_date": ("further_information_received", "Further information received"),
    "withdrawal_date": ("withdrawn", "Application withdrawn"),
    "decision_due_date": None,
    "expiry_date": None,
    "appeal_lodged_date": ("appeal_lodged", "Appeal lodged"),
    "appeal_decision_date": ("appeal_decided", "Appeal decided"),
}


@dataclass
class Backfilled:
    """applications as they stand afterwards, the events to add, and counters (name, n)."""

    applications: DataFrame
    events: DataFrame
    report: DataFrame


def latest_incoming(incoming: DataFrame) -> DataFrame:
    """One row for each authority code, whatever its case, and reference: of the greatest source id, then of the later dates; blank keys go."""
    code, reference = F.upper(F.btrim("local_authority_code")), F.btrim("reference")
    keyed = incoming.select(code.alias("local_authority_code"), reference.alias("reference"), F.struct("source_application_id", *FIELDS).alias("v"))
    best = keyed.where("local_authority_code <> '' and reference <> ''").groupBy("local_authority_code", "reference").agg(F.max("v").alias("v"))
    return best.select("local_authority_code", "reference", F.struct(*(F.col(f"v.{f}").alias(f) for f in FIELDS)).alias("new_dates"))


def backfill(applications: DataFrame, incoming: DataFrame, events: DataFrame, now: datetime) -> Backfilled:
    """Lifecycle dates of `incoming` put into `applications`, nulls too, and an event for each milestone that was unknown.

    applications: id, local_authority_code, reference, updated_at, the dates, and any others. events:
    application_id, event_key; an event whose key is there is not added again. Rows that do not change keep their
    updated_at. Stored rows, events and counters come from one comparison, which is written once.
    """
    new = latest_incoming(incoming)
    old = F.struct(*FIELDS)
    both = applications.select("id", "local_authority_code", "reference", old.alias("old_dates")).join(new, ["local_authority_code", "reference"])
    met = materialised(both.select("id", "old_dates", "new_dates", (~F.col("old_dates").eqNullSafe(F.col("new_dates"))).alias("changed")))

    def was(f: str) -> Column:
        return F.col("old_dates")[f]

    def will(f: str) -> Column:
        return F.col("new_dates")[f]

    held = [c for c in applications.columns if c not in (*FIELDS, "updated_at")]
    joined = applications.join(met.where("changed").select("id", "new_dates"), "id", "left")
    hit = F.col("new_dates").isNotNull()
    stored = joined.select(*held, *(F.when(hit, will(f)).otherwise(F.col(f)).alias(f) for f in FIELDS), F.when(hit, F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at")).select(*applications.columns)

    found = [
        F.when(was(f).isNull() & will(f).isNotNull(), F.struct(F.lit(told[0]).alias("event_type"), will(f).alias("event_date"), F.lit(f).alias("source_field"), F.lit(told[1]).alias("label"), F.concat_ws(":", F.lit("source"), F.lit(f), will(f).cast("string")).alias("event_key")))
        for f, told in FIELDS.items()
        if told
    ]
    fresh = met.select(F.col("id").alias("application_id"), F.inline(F.array_compact(F.array(*found))))
    added = materialised(fresh.join(events.select("application_id", "event_key"), ["application_id", "event_key"], "left_anti").select("application_id", "event_type", "event_date", "source_field", "label", "event_key"))

    moved = [F.count_if(~was(f).eqNullSafe(will(f))).alias(f"field {f}") for f in FIELDS]
    of_rows = met.agg(F.count("*").alias("matched"), F.count_if("changed").alias("updated"), *moved)
    kinds = [F.count_if(F.col("event_type") == told[0]).alias(f"event {told[0]}") for told in FIELDS.values() if told]
    of_events = added.agg(F.count("*").alias("events inserted"), F.count_distinct("application_id").alias("applications enriched"), *kinds)
    counts = incoming.agg(F.count("*").alias("submitted")).crossJoin(of_rows).crossJoin(of_events)  # three single rows
    report = counts.select(F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").alias("n")) for c in counts.columns))))
    return Backfilled(stored, added, report.where("n > 0 or name not like 'field %' and name not like 'event %'"))
