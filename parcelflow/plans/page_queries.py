"""Queries of pages and reports."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelflow.functions import places
from parcelflow.functions import text as T
from parcelflow.operators import pages as G
from parcelflow.plans.mapping import APPLICATIONS, SALES, applications, sales, snapshot, snapshot_sql
from parcelflow.plans.registry import query
from parcelflow.sources.tables import table

NOW = datetime(2024, 1, 15, 12)
OLD_DAY = date(2000, 6, 28)


@query(
    "o13_table_order",
    f"with {SALES}, a as (select county || '/' || area_slug as label, median(price_eur) filter (is_new_dwelling and price_eur > 100000) as v from sales group by 1) select label, v is null as missing, row_number() over (order by v desc nulls first, label desc) as place from a",
)
def table_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas by the median of new dwellings above 100,000, going down: missing ones come first. One row an area is numbered."""
    label = F.concat("county", F.lit("/"), "area_slug").alias("label")
    areas = sales(spark, sf_dir).groupBy(label).agg(F.expr("median(price_eur) filter (where is_new_dwelling and price_eur > 100000)").alias("v"))
    return areas.select("label", F.col("v").isNull().alias("missing"), F.row_number().over(Window.orderBy(*G.table_order("v", True))).alias("place"))


TRAFFIC_SQL = "t as (select user_id as id, count(distinct cast(ts as date)) filter (event_type = 'purchase') as visitors, count(*) filter (event_type = 'click') as clicks, count(*) as pageviews, count(*) filter (event_type = 'view') as impressions from events group by 1)"


@query(
    "o14_traffic_cohort",
    f"with {APPLICATIONS}, {TRAFFIC_SQL} select id, authority, reference, visitors, clicks, pageviews, impressions from t join applications using (id) order by greatest((visitors > 0)::int, (clicks > 0)::int) desc, visitors desc, clicks desc, pageviews desc, impressions desc, authority, reference limit 40",
)
def traffic_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forty applications of most traffic, by seven keys."""
    kind = F.col("event_type")
    seen = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(
        F.count_distinct(F.when(kind == "purchase", F.to_date("ts"))).alias("visitors"), F.count_if(kind == "click").alias("clicks"), F.count("*").alias("pageviews"), F.count_if(kind == "view").alias("impressions")
    )
    rows = seen.join(applications(spark, sf_dir).select("id", "authority", "reference"), "id")
    return rows.orderBy(*G.traffic_order()).limit(40).select("id", "authority", "reference", "visitors", "clicks", "pageviews", "impressions")


@query(
    "p24_due_soon",
    "select event_id as id, ts as starts_at from events where event_type = 'view' and ts >= timestamp '2024-01-16 00:00:00' and ts < timestamp '2024-01-17 04:00:00' and event_id % 2 = 0 order by ts, event_id limit 50",
)
def due_soon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits within 12 to 40 hours; the limit is the size of a run."""
    k = F.col("event_id") % 2
    visits = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("starts_at"), F.when(F.col("event_type") == "view", "scheduled").otherwise("cancelled").alias("status"), F.when(k == 1, F.lit(NOW)).alias("reminded_at"))
    return G.due_soon(visits, NOW).select("id", "starts_at")


@query("a45_growth", "select count(*) as total, count(*) filter (ts >= timestamp '2024-01-08 12:00:00') as week, count(*) filter (ts >= timestamp '2024-01-14 12:00:00') as day from events")
def growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.growth(table(spark, sf_dir, "events"), "ts", {"week": datetime(2024, 1, 8, 12), "day": datetime(2024, 1, 14, 12)})


@query("a43_batch_summary", "select list_sort(list(distinct cast(year(l_shipdate) as int))) as years, cast(max(l_shipdate) as date) as latest, count(*) as n from lineitem")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.batch_summary(table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("day")), "day")


@query(
    "u3_last_rows",
    f"with {APPLICATIONS}, {snapshot_sql('o', OLD_DAY)} select id, case when id % 3 = 0 then a.decision_date else o.decision_date end as decision_date from applications a left join o using (id) where id % 3 = 0 or o.id is not null",
)
def last_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An old snapshot and a third of today's applications; the latter win."""
    rows = applications(spark, sf_dir)
    return G.last_rows(snapshot(rows, OLD_DAY).select("id", "decision_date"), rows.where("id % 3 = 0").select("id", "decision_date"), "id")


@query("r2_same_records", "select o_orderkey % 2 = 0 or o_orderstatus = 'F' as same, count(*) as n from orders group by 1")
def same_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON of every order in two key orders, some with another status."""
    orders = table(spark, sf_dir, "orders")
    left = F.to_json(F.struct("o_orderkey", "o_orderstatus"))
    right = F.to_json(F.struct(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).otherwise("F").alias("o_orderstatus"), "o_orderkey"))
    return orders.groupBy(G.same_record(left, right).alias("same")).agg(F.count("*").alias("n"))


@query("p23_without_known", f"with {APPLICATIONS} select id, registration_date from applications where status <> 'F' order by registration_date desc, id limit 12")
def without_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = applications(spark, sf_dir)
    return G.without_known(rows.select("id", "registration_date"), rows.where("status = 'F'"), "id", [F.desc("registration_date"), F.asc("id")], 12)
