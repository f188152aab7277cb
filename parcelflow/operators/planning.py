"""Planning applications: dashboards, event history by change detection, refresh cohorts, ranges.

Applications have id, reference, authority, location, status, application_type, registration_date and
further lifecycle dates. Clocks are parameters.
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.functions import dates
from parcelflow.functions import text as T

#: Event types by the date column that they come from, in public order.
MILESTONES = {
    "application_received": "registration_date",
    "application_validated": "valid_date",
    "further_information_requested": "further_information_requested_date",
    "further_information_received": "further_information_received_date",
    "decision_made": "decision_date",
    "decision_notice_issued": "dispatch_date",
    "final_grant": "final_grant_date",
    "appeal_lodged": "appeal_lodged_date",
    "appeal_notification": "appeal_notify_date",
    "appeal_decided": "appeal_decision_date",
    "withdrawn": "withdrawal_date",
}
#: Events that the public history leaves out.
HIDDEN = ("application_validated", "decision_notice_issued", "appeal_notification", "status_changed", "decision_changed", "decision_due_changed", "source_date_corrected")
#: States whose own milestone says more than a change of status.
STATE_EVENTS = {"registered": "application_received", "further_information_requested": "further_information_requested", "further_information_received": "further_information_received", "decision_made": "decision_made", "final_grant": "final_grant", "appealed": "appeal_lodged", "appeal_decided": "appeal_decided", "withdrawn": "withdrawn"}


def _present(df: DataFrame) -> dict[str, str]:
    return {event: column for event, column in MILESTONES.items() if column in df.columns}


def filtered(applications: DataFrame, term: str | None = None, authority: str | None = None, status: str | None = None, kind: str | None = None, since: date | None = None, until: date | None = None) -> DataFrame:
    """The rows that match every filter that is given; a term is sought in several columns."""
    rows = applications
    if term and term.strip():
        pattern = T.match_pattern(term)
        rows = rows.where(F.col("reference").ilike(pattern) | F.col("location").ilike(pattern) | F.col("authority").ilike(pattern))
    for column, value in (("authority", authority), ("status", status), ("application_type", kind)):
        if value and value.strip():
            rows = rows.where(F.lower(column) == value.strip().lower())
    if since:
        rows = rows.where(F.col("registration_date") >= F.lit(since))
    if until:
        rows = rows.where(F.col("registration_date") <= F.lit(until))
    return rows


#: Entries of each facet that a dashboard shows, and of the options it offers (0: all).
FACETS = {"area": 12, "status": 8, "type": 8, "month": 12, "latest-area": 8, "latest-status": 6, "latest-type": 6}
OPTIONS = {"area": 80, "status": 0, "type": 0}


def dashboard_cube(applications: DataFrame, area: Column | None = None) -> DataFrame:
    """month, area, status, type with their rows and latest registration: all that a dashboard's counts are made of.

    The applications are read and grouped once; the cube has as many rows as there are combinations. area: authority, or
    for one authority's dashboard its locality.
    """
    area = F.col("authority") if area is None else area
    by = [F.trunc("registration_date", "month").alias("month"), area.alias("area"), F.col("status").alias("status"), F.col("application_type").alias("type")]
    return applications.groupBy(*by).agg(F.count("*").alias("n"), F.max("registration_date").alias("latest"))


def dashboard_facets(cube: DataFrame) -> DataFrame:
    """facet, label, count: areas, statuses, types and months, the first three for the latest month, and the options of a filter.

    Blank labels are left out. Largest first, ties by label; months latest first. Options are named `area-option` and so on.
    """
    latest = cube.agg(F.max("month").alias("latest_month"))  # one row
    rows = cube.crossJoin(F.broadcast(latest))
    recent = F.col("month") == F.col("latest_month")
    pairs = [("area", F.col("area")), ("status", F.col("status")), ("type", F.col("type")), ("month", F.date_format("month", "yyyy-MM"))]
    pairs += [(f"latest-{name}", F.when(recent, F.col(name))) for name in ("area", "status", "type")]
    long = rows.select("n", F.inline(F.array(*(F.struct(F.lit(name).alias("facet"), value.alias("label")) for name, value in pairs)))).where(F.btrim("label") != "")
    counts = long.groupBy("facet", "label").agg(F.sum("n").alias("count"))
    by = Window.partitionBy("facet").orderBy(F.when(F.col("facet") == "month", F.col("label")).desc_nulls_last(), F.desc("count"), "label")
    placed = counts.withColumn("place", F.row_number().over(by))  # a row for each label
    shown = [F.when((F.col("facet") == name) & (F.col("place") <= most), F.lit(name)) for name, most in FACETS.items()]
    offered = [F.when((F.col("facet") == name) & ((F.col("place") <= most) | (most == 0)), F.lit(f"{name}-option")) for name, most in OPTIONS.items()]
    return placed.select(F.explode(F.array_compact(F.array(*shown, *offered))).alias("facet"), "label", "count")


def dashboard_totals(cube: DataFrame) -> DataFrame:
    """One row: total, latest date and month, its count, the month before's, and the change."""
    months = cube.groupBy("month").agg(F.sum("n").alias("n"), F.max("latest").alias("latest"))
    anchor = months.agg(F.max("month").alias("start"), F.max("latest").alias("latest_date"))  # one row
    rows = months.crossJoin(F.broadcast(anchor))
    of = lambda month: F.coalesce(F.sum(F.when(F.col("month") == month, F.col("n"))), F.lit(0))
    one = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_count"), F.max("latest_date").alias("latest_date"), of(F.col("start")).alias("latest_month_count"), of(F.add_months("start", -1)).alias("previous_month_count"))
    return one.withColumns({"latest_month": F.date_format("latest_date", "yyyy-MM"), "month_change": F.col("latest_month_count") - F.col("previous_month_count")})


def map_points(applications: DataFrame, most: int = 28) -> DataFrame:
    """Mean position of the largest areas, scaled to 0-100 with north up."""
    located = applications.where(F.col("grid_easting").isNotNull() & F.col("grid_northing").isNotNull())
    means = located.groupBy(F.col("authority").alias("area")).agg(F.count("*").alias("count"), F.avg("grid_easting").alias("e"), F.avg("grid_northing").alias("n"))
    top = means.orderBy(F.desc("count"), "area").limit(most)
    box = top.agg(F.min("e").alias("e0"), F.max("e").alias("e1"), F.min("n").alias("n0"), F.max("n").alias("n1"))
    scaled = top.crossJoin(F.broadcast(box))
    x = (F.col("e") - F.col("e0")) / F.greatest(F.col("e1") - F.col("e0"), F.lit(1.0)) * 100
    y = 100 - (F.col("n") - F.col("n0")) / F.greatest(F.col("n1") - F.col("n0"), F.lit(1.0)) * 100
    return scaled.select("area", "count", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


def council_activity(applications: DataFrame) -> DataFrame:
    """Applications by authority in the 12 months that end with the latest registration."""
    latest = applications.agg(F.max("registration_date").alias("end"))
    rows = applications.crossJoin(F.broadcast(latest)).where(F.col("registration_date").between(F.date_add(F.add_months("end", -12), 1), F.col("end")))
    return rows.groupBy("authority").agg(F.count("*").alias("applications"), F.min("registration_date").alias("first"), F.max("registration_date").alias("last"))


def reconstruct_events(applications: DataFrame) -> DataFrame:
    """A milestone for each known date; keys repeat for the same date of the same column, whoever finds it."""
    parts = [F.struct(F.lit(event).alias("event_type"), F.col(column).alias("event_date"), F.lit(column).alias("source_field")) for event, column in _present(applications).items()]
    long = applications.select("id", F.inline(F.array(*parts))).where("event_date is not null")
    return long.select(F.col("id").alias("application_id"), "event_type", "event_date", "source_field", _key(F.col("source_field"), F.col("event_date")), F.lit("reconstructed").alias("provenance"))


def _key(column: Column, day: Column) -> Column:
    return F.concat_ws(":", F.lit("source"), column, day.cast("string")).alias("event_key")


def observed_changes(old: DataFrame, new: DataFrame, detected: date) -> DataFrame:
    """Events between two snapshots: new milestones, corrected dates, and changes of state that no milestone explains.

    One wide row for each application that is in both is compared and unpivoted.
    """
    columns = _present(new)
    before = old.select("id", F.struct(*columns.values(), "state").alias("o"))
    both = new.select("id", F.struct(*columns.values(), "state").alias("n")).join(before, "id")
    changes, fired = [], {}
    for event, column in columns.items():
        was, now = F.col(f"o.{column}"), F.col(f"n.{column}")
        fired[event] = was.isNull() & now.isNotNull()
        changes.append(F.when(fired[event], _event(event, now, column, was.cast("string"), now.cast("string"))))
        changes.append(F.when(was.isNotNull() & now.isNotNull() & (was != now), _event("source_date_corrected", now, column, was.cast("string"), now.cast("string"))))
    explained = reduce(lambda a, b: a | b, [(F.col("n.state") == state) & fired[event] for state, event in STATE_EVENTS.items() if event in fired], F.lit(False))
    changed = ~F.col("o.state").eqNullSafe(F.col("n.state")) & ~explained
    changes.append(F.when(changed, _event("status_changed", F.lit(detected), "state", F.col("o.state"), F.col("n.state"))))
    long = both.select(F.col("id").alias("application_id"), F.explode(F.array_compact(F.array(*changes))).alias("e")).select("application_id", "e.*")
    key = F.when(F.col("event_type") == "source_date_corrected", F.concat_ws(":", F.lit("correction"), "source_field", "old_value", "new_value")).when(F.col("event_type") == "status_changed", F.concat_ws(":", F.lit("status"), F.coalesce("old_value", F.lit("")), "new_value", F.lit(str(detected)))).otherwise(_key(F.col("source_field"), F.col("event_date")))
    return long.select("*", key.alias("event_key"), F.lit("observed").alias("provenance"))


def _event(kind: str, day: Column, column: str, was: Column, now: Column) -> Column:
    return F.struct(F.lit(kind).alias("event_type"), day.alias("event_date"), F.lit(column).alias("source_field"), was.alias("old_value"), now.alias("new_value"))


def append_events(known: DataFrame, found: DataFrame) -> DataFrame:
    """Found events whose key is not known yet; of equal keys one."""
    return found.dropDuplicates(["application_id", "event_key"]).join(known.select("application_id", "event_key"), ["application_id", "event_key"], "left_anti")


def active_ranges(applications: DataFrame, as_of: date) -> DataFrame:
    """Runs of months with registrations by authority, from the first day to the last or to `as_of`."""
    months = applications.where(F.col("registration_date") <= F.lit(as_of)).groupBy("authority", F.trunc("registration_date", "month").alias("month")).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("authority").orderBy("month"))
    island = months.withColumn("island", dates.month_index(F.col("month")) - place)
    ranges = island.groupBy("authority", "island").agg(F.min("month").alias("start_date"), F.last_day(F.max("month")).alias("end_date"), F.sum("n").alias("rows"), F.count("*").alias("months"))
    return ranges.select("authority", "start_date", F.least("end_date", F.lit(as_of)).alias("end_date"), "rows", "months")


def refresh_cohort(applications: DataFrame, as_of: date, decided_days: int = 90, unknown_days: int = 365) -> DataFrame:
    """Applications to look at again: open ones, ones decided lately, and ones of unknown state that are recent."""
    decided = F.col("decision_date").isNotNull()
    final = F.col("final_grant_date").isNotNull()
    reason = (
        F.when((F.col("state") == "registered") & (F.col("registration_date") >= F.date_sub(F.lit(as_of), unknown_days)), "recent")
        .when(decided & ~final & (F.col("decision_date") >= F.date_sub(F.lit(as_of), decided_days)), "decided")
        .when((F.col("state") == "appealed") & ~final, "appealed")
    )
    return applications.select("id", "authority", "state", reason.alias("reason")).where("reason is not null")


def recheck_buckets(applications: DataFrame, as_of: date, grace: int = 180, most: int = 50, stream: int = 6000) -> DataFrame:
    """Authority months to check again, by priority: overdue decisions first, then old open ones; each stream and the result have a cap by design."""
    open_ = applications.where("decision_date is null")
    overdue = open_.where(F.col("registration_date") < F.date_sub(F.lit(as_of), grace)).orderBy("registration_date", "id").limit(stream).withColumn("priority", F.lit(1))
    waiting = open_.where(F.col("registration_date") >= F.date_sub(F.lit(as_of), grace)).orderBy("registration_date", "id").limit(stream).withColumn("priority", F.lit(2))
    rows = overdue.unionByName(waiting)
    grouped = rows.groupBy("authority", F.trunc("registration_date", "month").alias("month")).agg(F.min("priority").alias("priority"), F.count("*").alias("applications"))
    return grouped.orderBy("priority", F.desc("applications"), "authority", "month").limit(most)


def latest_by_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def changed_fields(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """For each incoming row: whether it is new, changed or unchanged, and which fields differ; arrays compare without order."""
    kinds = dict(new.dtypes)

    def norm(c: Column, field: str) -> Column:
        return F.array_sort(c) if kinds[field].startswith("array") else c

    before = old.select(key, F.struct(*fields).alias("o"), F.lit(True).alias("known"))
    both = new.select(key, F.struct(*fields).alias("n")).join(before, key, "left")
    differs = F.array_compact(F.array(*(F.when(~norm(F.col(f"n.{f}"), f).eqNullSafe(norm(F.col(f"o.{f}"), f)), F.lit(f)) for f in fields)))
    state = F.when(F.col("known").isNull(), "new").when(F.size(differs) > 0, "changed").otherwise("unchanged")
    return both.select(key, state.alias("change"), F.when(F.col("known").isNotNull(), differs).otherwise(F.array().cast("array<string>")).alias("fields"))


def lifecycle_coverage(applications: DataFrame) -> DataFrame:
    """Known and missing lifecycle dates by authority, and applications with two and three of them."""
    columns = list(_present(applications).values())
    known = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in columns])
    aggs = [F.count(c).alias(f"{c}_known") for c in columns]
    return applications.groupBy("authority").agg(F.count("*").alias("applications"), *aggs, F.count_if(known >= 2).alias("two_or_more"), F.count_if(known >= 3).alias("three_or_more"))
