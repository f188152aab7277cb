"""The driver tables seen as sales, planning applications and search performance.

The SQL constants say the same for DuckDB; queries prepend them as common table expressions.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.functions import text
from parcelflow.sources.tables import table

#: Clocks of the queries: days up to the 28th, so month arithmetic has no overflow.
SALES_AS_OF = date(2001, 8, 28)
EVENTS_AS_OF = date(2024, 1, 28)


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each line item: date_of_sale, price_eur, county, area_slug, eircode_prefix, is_new_dwelling, locality, address."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate", "l_extendedprice", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    placed = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    joined = lines.join(placed, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        F.to_date("l_shipdate").alias("date_of_sale"),
        F.col("l_extendedprice").alias("price_eur"),
        F.col("n_name").alias("county"),
        text.slug(F.col("p_type")).alias("area_slug"),
        F.col("p_brand").alias("eircode_prefix"),
        F.when(F.col("l_returnflag") == "N", True).when(F.col("l_returnflag") == "A", False).alias("is_new_dwelling"),
        F.col("p_name").alias("locality"),
        F.col("c_name").alias("address"),
    )


SALES = """sales as (
  select cast(l_shipdate as date) as date_of_sale, l_extendedprice as price_eur, n_name as county,
    trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-') as area_slug, p_brand as eircode_prefix,
    case l_returnflag when 'N' then true when 'A' then false end as is_new_dwelling, p_name as locality, c_name as address
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
    join nation on c_nationkey = n_nationkey join part on l_partkey = p_partkey)"""


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The applications without the dates that come after registration, so without a look at line items."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderkey").cast("string").alias("reference"),
        F.col("n_name").alias("authority"),
        F.col("c_name").alias("location"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("application_type"),
        F.to_date("o_orderdate").alias("registration_date"),
        (400000 + (F.col("o_orderkey") * 7919) % 400000).alias("grid_easting"),
        (450000 + (F.col("o_orderkey") * 104729) % 550000).alias("grid_northing"),
    )


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order as a planning application."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    ships = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_date(F.min("l_shipdate")).alias("first_ship"), F.to_date(F.max("l_shipdate")).alias("last_ship"))
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(ships, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return joined.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderkey").cast("string").alias("reference"),
        F.col("n_name").alias("authority"),
        F.col("c_name").alias("location"),
        status.alias("status"),
        priority.alias("application_type"),
        F.to_date("o_orderdate").alias("registration_date"),
        F.when(status.isin("F", "P"), F.col("first_ship")).alias("decision_date"),
        F.when(status == "F", F.col("last_ship")).alias("final_grant_date"),
        F.when((priority == "1-URGENT") & (status == "P"), F.col("last_ship")).alias("appeal_lodged_date"),
        (400000 + (F.col("o_orderkey") * 7919) % 400000).alias("grid_easting"),
        (450000 + (F.col("o_orderkey") * 104729) % 550000).alias("grid_northing"),
    )


APPLICATIONS = """applications as (
  select o_orderkey as id, cast(o_orderkey as varchar) as reference, n_name as authority, c_name as location, o_orderstatus as status,
    o_orderpriority as application_type, cast(o_orderdate as date) as registration_date,
    case when o_orderstatus in ('F', 'P') then first_ship end as decision_date,
    case when o_orderstatus = 'F' then last_ship end as final_grant_date,
    case when o_orderpriority = '1-URGENT' and o_orderstatus = 'P' then last_ship end as appeal_lodged_date,
    400000 + (o_orderkey * 7919) % 400000 as grid_easting, 450000 + (o_orderkey * 104729) % 550000 as grid_northing
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
    left join (select l_orderkey, cast(min(l_shipdate) as date) as first_ship, cast(max(l_shipdate) as date) as last_ship from lineitem group by 1) on o_orderkey = l_orderkey)"""


def search_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and impressions by page and day, from the event log."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.col("user_id").alias("page"), F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") == "view").alias("impressions"), F.avg("value").alias("position"))


SEARCH_DAYS = """search_days as (
  select user_id as page, cast(ts as date) as day, count(*) filter (event_type = 'click') as clicks,
    count(*) filter (event_type = 'view') as impressions, avg(value) as position from events group by 1, 2)"""


def snapshot(applications: DataFrame, as_of: date) -> DataFrame:
    """The applications as they stood on a day: later dates are not known yet."""
    known = {c: F.when(F.col(c) <= F.lit(as_of), F.col(c)) for c in ("decision_date", "final_grant_date", "appeal_lodged_date")}
    seen = applications.where(F.col("registration_date") <= F.lit(as_of)).withColumns(known)
    state = F.when(F.col("appeal_lodged_date").isNotNull(), "appealed").when(F.col("final_grant_date").isNotNull(), "final_grant").when(F.col("decision_date").isNotNull(), "decision_made").otherwise("registered")
    return seen.withColumn("state", state)


def snapshot_sql(name: str, as_of: date) -> str:
    known = ", ".join(f"case when {c} <= date '{as_of}' then {c} end as {c}" for c in ("decision_date", "final_grant_date", "appeal_lodged_date"))
    return f"""{name} as (select *, case when appeal_lodged_date is not null then 'appealed' when final_grant_date is not null then 'final_grant'
    when decision_date is not null then 'decision_made' else 'registered' end as state
  from (select id, reference, authority, location, status, application_type, registration_date, grid_easting, grid_northing, {known}
    from applications where registration_date <= date '{as_of}'))"""
