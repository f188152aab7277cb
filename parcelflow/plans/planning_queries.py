"""Queries over planning applications."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.operators import planning as P
from parcelflow.operators import timeline as L
from parcelflow.plans.mapping import APPLICATIONS, SALES_AS_OF, applications, registrations, snapshot, snapshot_sql
from parcelflow.plans.registry import query

OLD, NEW = date(2000, 6, 28), date(2001, 6, 28)
DAY = f"date '{SALES_AS_OF}'"
MONTH = "strftime(registration_date, '%Y-%m')"


@query(
    "a21_dashboard_facets",
    f"""with {APPLICATIONS}, l as (select max({MONTH}) as latest from applications),
    long as (select 'area' as facet, authority as label from applications union all select 'status', status from applications union all select 'type', application_type from applications
      union all select 'month', {MONTH} from applications union all select 'latest-area', authority from applications, l where {MONTH} = latest
      union all select 'latest-status', status from applications, l where {MONTH} = latest union all select 'latest-type', application_type from applications, l where {MONTH} = latest),
    c as (select facet, label, count(*) as count from long where trim(label) <> '' group by all),
    r as (select *, row_number() over (partition by facet order by case when facet = 'month' then label end desc nulls last, count desc, label) as place from c)
    select facet, label, count from r where place <= case facet when 'area' then 12 when 'status' then 8 when 'type' then 8 when 'month' then 12 when 'latest-area' then 8 else 6 end
    union all select facet || '-option', label, count from r where facet = 'area' and place <= 80 or facet in ('status', 'type')""",
)
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.dashboard_facets(P.dashboard_cube(registrations(spark, sf_dir)))


@query(
    "a21_dashboard_totals",
    f"""with {APPLICATIONS}, l as (select max(registration_date) as latest_date from applications), m as (select *, cast(date_trunc('month', latest_date) as date) as start from l),
    t as (select count(*) as total_count, max(latest_date) as latest_date, count(*) filter (registration_date >= start and registration_date < start + interval 1 month) as latest_month_count,
      count(*) filter (registration_date >= start - interval 1 month and registration_date < start) as previous_month_count from applications, m)
    select *, strftime(latest_date, '%Y-%m') as latest_month, latest_month_count - previous_month_count as month_change from t""",
)
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.dashboard_totals(P.dashboard_cube(registrations(spark, sf_dir)))


@query(
    "a42_map_points",
    f"""with {APPLICATIONS}, m as (select authority as area, count(*) as count, avg(grid_easting) as e, avg(grid_northing) as n from applications group by 1),
    t as (select * from m order by count desc, area limit 28), b as (select min(e) as e0, max(e) as e1, min(n) as n0, max(n) as n1 from t)
    select area, count, round((e - e0) / greatest(e1 - e0, 1.0) * 100, 4) as x, round(100 - (n - n0) / greatest(n1 - n0, 1.0) * 100, 4) as y from t, b""",
)
def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.map_points(registrations(spark, sf_dir))


@query(
    "a29_council_activity",
    f"""with {APPLICATIONS}, l as (select max(registration_date) as e from applications)
    select authority, count(*) as applications, min(registration_date) as first, max(registration_date) as last from applications, l
    where registration_date between cast(e - interval 12 month as date) + 1 and e group by 1""",
)
def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.council_activity(registrations(spark, sf_dir))


COLUMNS = {"application_received": "registration_date", "decision_made": "decision_date", "final_grant": "final_grant_date", "appeal_lodged": "appeal_lodged_date"}
EVENTS = "events_of as (" + " union all ".join(f"select id as application_id, '{e}' as event_type, {c} as event_date, '{c}' as source_field, 'source:{c}:' || cast({c} as varchar) as event_key, 'reconstructed' as provenance from applications where {c} is not null" for e, c in COLUMNS.items()) + ")"


@query("c1_reconstructed_events", f"with {APPLICATIONS}, {EVENTS} select * from events_of")
def reconstructed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.reconstruct_events(applications(spark, sf_dir))


def _changes_sql() -> str:
    parts = [
        f"select n.id as application_id, '{e}' as event_type, n.{c} as event_date, '{c}' as source_field, cast(o.{c} as varchar) as old_value, cast(n.{c} as varchar) as new_value, 'source:{c}:' || cast(n.{c} as varchar) as event_key, 'observed' as provenance from n join o using (id) where o.{c} is null and n.{c} is not null"
        for e, c in COLUMNS.items()
    ]
    fired = {"decision_made": "decision_date", "final_grant": "final_grant_date", "appealed": "appeal_lodged_date"}
    explained = " or ".join(f"(n.state = '{s}' and o.{c} is null and n.{c} is not null)" for s, c in fired.items())
    parts.append(f"select n.id, 'status_changed', date '{NEW}', 'state', o.state, n.state, 'status:' || o.state || ':' || n.state || ':{NEW}', 'observed' from n join o using (id) where o.state <> n.state and not ({explained})")
    return " union all ".join(parts)


CHANGES = f"{APPLICATIONS}, {snapshot_sql('o', OLD)}, {snapshot_sql('n', NEW)}, changes as ({_changes_sql()})"


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = applications(spark, sf_dir)
    return snapshot(rows, OLD), snapshot(rows, NEW)


@query("c2_observed_changes", f"with {CHANGES} select * from changes")
def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Milestones, corrections and changes of state between two snapshots."""
    return P.observed_changes(*_both(spark, sf_dir), NEW)


#: Corrections of a registration date: one that follows from the date, one that follows from that, one of another value; and wordings of decisions.
CORRECTED = f"""{EVENTS}, full_events as (select application_id, event_type, event_date, timestamp '2001-09-01' as detected_at, source_field, event_type as label, cast(null as varchar) as old_value, cast(null as varchar) as new_value, event_key from events_of
  union all select id, 'source_date_corrected', date '2001-09-02', timestamp '2001-09-02', 'registration_date', 'x', cast(registration_date as varchar), cast(registration_date + 2 as varchar), 'c1' from applications where id % 3 = 0
  union all select id, 'source_date_corrected', date '2001-09-03', timestamp '2001-09-03', 'registration_date', 'x', cast(registration_date + 2 as varchar), cast(registration_date + 400 as varchar), 'c2' from applications where id % 2 = 0
  union all select id, 'source_date_corrected', date '2001-09-04', timestamp '2001-09-04', 'registration_date', 'x', cast(registration_date as varchar), '2001-02-30', 'c3' from applications where id % 5 = 0
  union all select id, 'decision_changed', date '2001-09-05', timestamp '2001-09-05', 'decision_text', 'x', case id % 8 when 0 then 'Granted' end, case id % 12 when 0 then 'N/A' else ' Refused  by ' || status end, 'd1' from applications where id % 4 = 0)"""


@query(
    "c9_public_timeline",
    f"""with {APPLICATIONS}, {CORRECTED}, a as (select id, status, case when id % 6 = 0 then registration_date + 400 when id % 3 = 0 then registration_date + 2 else registration_date end as day from applications),
    o as (select e.application_id, event_type, case when source_field = 'registration_date' then day else event_date end as event_date, case event_type when 'application_received' then 0 when 'decision_made' then 4 when 'final_grant' then 6 else 7 end as k, event_key,
      case when event_type = 'decision_made' and a.id % 4 = 0 and a.id % 8 > 0 and a.id % 12 > 0 then 'Decision: Refused by ' || status else event_type end as label from events_of e join a on a.id = e.application_id)
    select application_id, row_number() over (partition by application_id order by event_date, k, event_key) as place, event_type, event_date, label, event_key from o""",
)
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public timelines of all applications, with chains of corrections and wordings of decisions."""
    rows = applications(spark, sf_dir)
    text, none = F.col("registration_date").cast("string"), F.lit(None).cast("string")
    events = P.reconstruct_events(rows).select("application_id", "event_type", "event_date", F.lit("2001-09-01").cast("timestamp").alias("detected_at"), "source_field", F.col("event_type").alias("label"), none.alias("old_value"), none.alias("new_value"), "event_key")

    def told(day: str, kind: str, field: str, old: Column, new: Column, key: str, some: Column) -> DataFrame:
        return rows.where(some).select("id", F.lit(kind), F.lit(day).cast("date"), F.lit(day).cast("timestamp"), F.lit(field), F.lit("x"), old, new, F.lit(key))

    i, later = F.col("id"), lambda n: F.date_add("registration_date", n).cast("string")
    events = events.union(told("2001-09-02", "source_date_corrected", "registration_date", text, later(2), "c1", i % 3 == 0))
    events = events.union(told("2001-09-03", "source_date_corrected", "registration_date", later(2), later(400), "c2", i % 2 == 0))
    events = events.union(told("2001-09-04", "source_date_corrected", "registration_date", text, F.lit("2001-02-30"), "c3", i % 5 == 0))
    wording = F.when(i % 12 == 0, "N/A").otherwise(F.concat(F.lit(" Refused  by "), "status"))
    events = events.union(told("2001-09-05", "decision_changed", "decision_text", F.when(i % 8 == 0, "Granted"), wording, "d1", i % 4 == 0))
    return L.public_timeline(events)


@query(
    "u_appended_events",
    f"""with {CHANGES}, {EVENTS.replace("from applications", "from o")} select c.* from changes c where not exists (select 1 from events_of e where e.application_id = c.application_id and e.event_key = c.event_key)""",
)
def appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed events that the history reconstructed from the old snapshot does not have."""
    old, new = _both(spark, sf_dir)
    return P.append_events(P.reconstruct_events(old), P.observed_changes(old, new, NEW))


@query(
    "w6_active_ranges_all",
    f"""with {APPLICATIONS}, m as (select authority, cast(date_trunc('month', registration_date) as date) as month, count(*) as n from applications where registration_date <= {DAY} group by all),
    i as (select *, year(month) * 12 + month(month) - 1 - row_number() over (partition by authority order by month) as island from m)
    select authority, min(month) as start_date, least(last_day(max(month)), {DAY}) as end_date, sum(n)::bigint as rows, count(*) as months from i group by authority, island""",
)
def all_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Islands of active months of all applications."""
    return P.active_ranges(applications(spark, sf_dir), SALES_AS_OF)


@query(
    "c12_refresh_cohort",
    f"""with {APPLICATIONS}, {snapshot_sql('n', SALES_AS_OF)}, r as (select id, authority, state, case when state = 'registered' and registration_date >= {DAY} - 365 then 'recent'
      when decision_date is not null and final_grant_date is null and decision_date >= {DAY} - 90 then 'decided' when state = 'appealed' and final_grant_date is null then 'appealed' end as reason from n)
    select * from r where reason is not null""",
)
def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.refresh_cohort(snapshot(applications(spark, sf_dir), SALES_AS_OF), SALES_AS_OF)


@query(
    "c13_recheck_buckets",
    f"""with {APPLICATIONS}, open_ as (select * from applications where decision_date is null),
    a as (select *, 1 as priority from open_ where registration_date < {DAY} - 180 order by registration_date, id limit 6000), b as (select *, 2 as priority from open_ where registration_date >= {DAY} - 180 order by registration_date, id limit 6000)
    select authority, cast(date_trunc('month', registration_date) as date) as month, min(priority) as priority, count(*) as applications from (select * from a union all select * from b) group by 1, 2 order by 3, 4 desc, 1, 2 limit 50""",
)
def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.recheck_buckets(applications(spark, sf_dir), SALES_AS_OF)


@query(
    "a44_lifecycle_coverage",
    f"""with {APPLICATIONS}, k as (select *, (registration_date is not null)::int + (decision_date is not null)::int + (final_grant_date is not null)::int + (appeal_lodged_date is not null)::int as known from applications)
    select authority, count(*) as applications, count(registration_date) as registration_date_known, count(decision_date) as decision_date_known, count(final_grant_date) as final_grant_date_known,
    count(appeal_lodged_date) as appeal_lodged_date_known, count(*) filter (known >= 2) as two_or_more, count(*) filter (known >= 3) as three_or_more from k group by authority""",
)
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.lifecycle_coverage(applications(spark, sf_dir))


@query(
    "w2_latest_by_customer",
    f"with {APPLICATIONS} select location, id, registration_date from (select *, row_number() over (partition by location order by registration_date desc, id desc) as rn from applications) where rn = 1",
)
def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.latest_by_key(applications(spark, sf_dir), ["location"], [F.desc("registration_date"), F.desc("id")]).select("location", "id", "registration_date")


@query(
    "c10_change_filter",
    f"""with {APPLICATIONS}, {snapshot_sql('o', OLD)}, {snapshot_sql('n', NEW)}, j as (select n.id, o.id is not null as known,
      list_filter([case when n.state is distinct from o.state then 'state' end, case when n.decision_date is distinct from o.decision_date then 'decision_date' end,
        case when n.final_grant_date is distinct from o.final_grant_date then 'final_grant_date' end, case when n.authority is distinct from o.authority then 'authority' end], lambda x: x is not null) as f from n left join o using (id))
    select case when not known then 'new' when len(f) > 0 then 'changed' else 'unchanged' end as change, array_to_string(case when known then f else [] end, ',') as fields, count(*) as n from j group by all""",
)
def change_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New, changed and unchanged rows between snapshots, counted by the fields that differ."""
    old, new = _both(spark, sf_dir)
    found = P.changed_fields(old, new, "id", ["state", "decision_date", "final_grant_date", "authority"])
    return found.groupBy("change", F.array_join("fields", ",").alias("fields")).agg(F.count("*").alias("n"))


@query(
    "x16_planning_search",
    f"""with {APPLICATIONS} select id, authority, location, status, registration_date from applications where (reference ilike '%12%' or location ilike '%12%' or authority ilike '%12%') and lower(status) = 'f'
    order by registration_date desc nulls last, reference limit 25""",
)
def planning_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of a search over several columns."""
    found = P.filtered(applications(spark, sf_dir), term="12", status="F")
    return found.orderBy(F.desc_nulls_last("registration_date"), "reference").limit(25).select("id", "authority", "location", "status", "registration_date")


@query(
    "a30_authority_months",
    f"""with {APPLICATIONS} select authority, cast(date_trunc('month', registration_date) as date) as month, count(*) as n, case when count(*) = count(decision_date) then min(decision_date) end as first_decision from applications group by 1, 2""",
)
def authority_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by authority and month; the least decision date is null where any is missing."""
    first = F.when(F.count("*") == F.count("decision_date"), F.min("decision_date"))
    return applications(spark, sf_dir).groupBy("authority", F.trunc("registration_date", "month").alias("month")).agg(F.count("*").alias("n"), first.alias("first_decision"))


@query(
    "a27_duplicate_lines",
    "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1",
)
def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query(
    "w12_latest_milestone",
    f"""with {APPLICATIONS}, {EVENTS}, o as (select *, case event_type when 'application_received' then 0 when 'decision_made' then 4 when 'final_grant' then 6 else 7 end as k from events_of)
    select event_type, count(*) as n from (select *, row_number() over (partition by application_id order by event_date desc, k) as rn from o) where rn = 1 group by 1""",
)
def latest_milestone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many applications stand at each milestone; of equal dates the earlier listed one counts."""
    rows = applications(spark, sf_dir)
    parts = [F.struct(F.col(c).alias("day"), F.lit(-k).alias("k"), F.lit(e).alias("event_type")) for k, (e, c) in enumerate(COLUMNS.items())]
    known = F.filter(F.array(*parts), lambda p: p["day"].isNotNull())
    return rows.select(F.array_max(known)["event_type"].alias("event_type")).where("event_type is not null").groupBy("event_type").agg(F.count("*").alias("n"))
