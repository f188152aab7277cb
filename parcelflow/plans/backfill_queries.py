"""Queries of the lifecycle backfill: stored rows, events and counters. Orders are applications, with dates that follow from their own."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.operators import backfill as B
from parcelflow.plans.mapping import APPLICATIONS, SALES_AS_OF, applications
from parcelflow.plans.registry import query

THEN, STAMP, NOW = date(2000, 6, 28), datetime(2000, 6, 28), datetime(2001, 8, 28, 6)
#: Each date: days after which other date it lies, and whose ids have it.
DATES = {
    "further_information_requested_date": ("registration_date", 20, 3),
    "further_information_received_date": ("registration_date", 45, 6),
    "withdrawal_date": ("registration_date", 60, 10),
    "decision_due_date": ("registration_date", 56, 1),
    "expiry_date": ("final_grant_date", 90, 1),
    "appeal_lodged_date": ("appeal_lodged_date", 0, 1),
    "appeal_decision_date": ("appeal_lodged_date", 40, 2),
}


def _dates_sql(until: date, shift: int = 0) -> str:
    return ", ".join(f"case when id % {k} = 0 and {base} + {n + shift} <= date '{until}' then {base} + {n + shift} end as {name}" for name, (base, n, k) in DATES.items())


BACKFILL = f"""{APPLICATIONS}, stored as (select id, authority as local_authority_code, reference, {_dates_sql(THEN)}, timestamp '{STAMP}' as updated_at from applications),
  incoming as (select '  ' || lower(authority) as local_authority_code, reference || ' ' as reference, id as source_application_id, {_dates_sql(SALES_AS_OF)} from applications where id % 7 > 0
    union all select authority, reference, case when id % 8 = 0 then null else id - 1 end, {_dates_sql(SALES_AS_OF, 3)} from applications where id % 4 = 0 union all select ' ', reference, id, {_dates_sql(SALES_AS_OF)} from applications where id % 50 = 1),
  known as (select id as application_id, 'source:further_information_requested_date:' || cast(registration_date + 20 as varchar) as event_key from applications where id % 5 = 0),
  latest as (select * exclude (rn) from (select upper(trim(local_authority_code)) as local_authority_code, trim(reference) as reference, * exclude (local_authority_code, reference), row_number() over (partition by upper(trim(local_authority_code)), trim(reference) order by source_application_id desc nulls last) as rn
    from incoming where trim(local_authority_code) <> '') where rn = 1),
  met as (select s.id, {", ".join(f"s.{f} as old_{f}, l.{f} as new_{f}" for f in DATES)} from stored s join latest l using (local_authority_code, reference)),
  fresh as ({" union all ".join(f"select id as application_id, '{told[0]}' as event_type, new_{f} as event_date, '{f}' as source_field, '{told[1]}' as label, 'source:{f}:' || cast(new_{f} as varchar) as event_key from met where old_{f} is null and new_{f} is not null" for f, told in B.FIELDS.items() if told)}),
  added as (select * from fresh f where not exists (select 1 from known k where k.application_id = f.application_id and k.event_key = f.event_key)),
  differs as (select *, {" or ".join(f"old_{f} is distinct from new_{f}" for f in DATES)} as changed from met)"""


def _dates(until: date, shift: int = 0) -> list[Column]:
    out = []
    for name, (base, n, k) in DATES.items():
        day = F.date_add(base, n + shift)
        out.append(F.when((F.col("id") % k == 0) & (day <= F.lit(until)), day).alias(name))
    return out


def _backfilled(spark: SparkSession, sf_dir: str) -> B.Backfilled:
    rows = applications(spark, sf_dir)
    stored = rows.select("id", F.col("authority").alias("local_authority_code"), "reference", *_dates(THEN), F.lit(STAMP).alias("updated_at"))
    blank = F.lit(" ").alias("local_authority_code")
    first = rows.where("id % 7 > 0").select(F.concat(F.lit("  "), F.lower("authority")).alias("local_authority_code"), F.concat("reference", F.lit(" ")).alias("reference"), F.col("id").alias("source_application_id"), *_dates(SALES_AS_OF))
    second = rows.where("id % 4 = 0").select("authority", "reference", F.when(F.col("id") % 8 != 0, F.col("id") - 1), *_dates(SALES_AS_OF, 3))
    third = rows.where("id % 50 = 1").select(blank, "reference", "id", *_dates(SALES_AS_OF))
    known = rows.where("id % 5 = 0").select(F.col("id").alias("application_id"), F.concat(F.lit("source:further_information_requested_date:"), F.date_add("registration_date", 20).cast("string")).alias("event_key"))
    return B.backfill(stored, first.union(second).union(third), known, NOW)


@query("c15_backfill_report", f"""with {BACKFILL}, r as (select 'submitted' as name, count(*) as n from incoming union all select 'matched', count(*) from met union all select 'updated', count(*) from differs where changed
  union all select 'events inserted', count(*) from added union all select 'applications enriched', count(distinct application_id) from added union all select 'event ' || event_type, count(*) from added group by event_type
  {" ".join(f"union all select 'field {f}', count(*) from met where old_{f} is distinct from new_{f} having count(*) > 0" for f in DATES)}) select * from r""")  # fmt: skip
def backfill_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a backfill with repeated, blank and differently written keys."""
    return _backfilled(spark, sf_dir).report


@query("c15_backfill_events", f"with {BACKFILL} select * from added")
def backfill_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _backfilled(spark, sf_dir).events


@query("c15_backfilled", f"with {BACKFILL} select s.id, s.local_authority_code, s.reference, {', '.join(f'case when d.changed then d.new_{f} else s.{f} end as {f}' for f in DATES)}, case when d.changed then timestamp '{NOW}' else s.updated_at end as updated_at from stored s left join differs d using (id)")
def backfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All applications after the backfill."""
    return _backfilled(spark, sf_dir).applications
