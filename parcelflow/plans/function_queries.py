"""Queries of column functions over whole tables: dates in three writings, tags, money, casing, grid texts, boxes and protected texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.functions import dates, geo
from parcelflow.functions import text as T
from parcelflow.plans.mapping import APPLICATIONS, registrations
from parcelflow.plans.registry import query
from parcelflow.sources.tables import table


@query("d1_d3_dates", "select o_orderkey as id, cast(o_orderdate as date) as written, cast(o_orderdate as date) as iso, cast(o_orderdate as date) as epoch, case when day(o_orderdate) <= 12 then make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) end as swapped from orders")
def parsed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's day, read back from dd/mm/yyyy, from an ISO text with a zone and from milliseconds; with day and month swapped it is a day only up to the twelfth."""
    day = F.col("o_orderdate")
    written, swapped, iso = F.date_format(day, "dd/MM/yyyy"), F.date_format(day, "MM/dd/yyyy"), F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T23:59:59-11:00"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), dates.day_month_year(written).alias("written"), dates.iso_day(iso).alias("iso"), dates.epoch_day(F.unix_millis(day.cast("timestamp"))).alias("epoch"), dates.day_month_year(swapped).alias("swapped"))


@query("f8_property_tags", """with p as (select p_partkey, case p_size % 5 when 0 then 'New Dwelling House /Apartment' when 1 then 'Second-Hand House' when 2 then 'NEW apartment' when 3 then p_type end as d, case p_size % 3 when 0 then true when 1 then false end as v from part)
  select p_partkey, concat_ws('|', case when contains(lower(d), 'house') then 'House' when contains(lower(d), 'apartment') then 'Apartment' else 'Property' end, case when contains(lower(d), 'new') then 'New build' else 'Second-hand' end, case when contains(lower(d), 'new') then case v when true then 'VAT exclusive' when false then 'VAT included' end end) as tags from p""")  # fmt: skip
def property_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("p_size") % 5, F.col("p_size") % 3
    said = F.when(k == 0, "New Dwelling House /Apartment").when(k == 1, "Second-Hand House").when(k == 2, "NEW apartment").when(k == 3, F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.property_tags(said, F.when(n == 0, True).when(n == 1, False)), "|").alias("tags"))


@query("f38_money", "select c_custkey, '€' || replace(format('{:,}', cast(floor(abs(c_acctbal) * 100 + 0.5) as bigint)), ',', ',') as money, case when c_acctbal > 0 then '+' else '' end || format('{:.1f}', floor(c_acctbal / 100 * 10 + 0.5) / 10) || '%' as share from customer")
def money(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances in cents as whole euros, and as signed percents."""
    return table(spark, sf_dir, "customer").select("c_custkey", T.currency(F.abs("c_acctbal") * 100).alias("money"), T.signed_percent(F.col("c_acctbal") / 100).alias("share"))


@query("f40_initials", "select c_custkey, list_aggregate(list_transform(string_split(lower(c_mktsegment || ' ' || c_name), ' '), lambda w: list_aggregate(list_transform(string_split(w, '#'), lambda x: upper(x[1]) || x[2:]), 'string_agg', '#')), 'string_agg', ' ') as named from customer")
def initials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", T.title_initials(F.concat("c_mktsegment", F.lit(" "), "c_name")).alias("named"))


@query("g4_g5_grid_boxes", f"with {APPLICATIONS} select id, cast(grid_easting as double) as easting, cast(grid_northing as double) as northing, round(grid_northing / 20000.0 - 2 / 110.574, 9) as south, round(2 / (111.32 * cos(radians(grid_northing / 20000.0))), 9) as half_width from applications")
def grid_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid texts of all applications split into numbers, and boxes of two kilometres around latitudes made of their northings."""
    pair = geo.grid_pair(F.concat(F.lit(" "), F.col("grid_easting").cast("string"), F.lit(" , "), F.col("grid_northing").cast("string")))
    lat = F.col("grid_northing") / 20_000.0
    tall, wide = geo.box_degrees(lat, 2.0)
    return registrations(spark, sf_dir).select("id", pair["easting"].alias("easting"), pair["northing"].alias("northing"), F.round(lat - tall, 9).alias("south"), F.round(wide, 9).alias("half_width"))


@query("f34_protected_texts", "select p_partkey, case when p_size % 3 = 0 then p_name || '.' when p_size % 3 = 1 then p_type else p_name end as kept from part")
def protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming texts that are a beginning of the stored one do not replace it; others do, null ones never."""
    k = F.col("p_size") % 3
    stored = F.when(k == 0, F.concat("p_name", F.lit("."))).otherwise(F.col("p_name"))
    incoming = F.when(k == 0, F.col("p_name")).when(k == 1, F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", T.keep_longer(stored, incoming).alias("kept"))
