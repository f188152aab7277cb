"""Queries of the unified search over the households of the postal queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.operators.unified import unified_search
from parcelflow.plans import postal_queries as H
from parcelflow.plans.registry import query
from parcelflow.sources.tables import table

ASKED = """asked as (select 'c' || k as query_id, eircode as q, 'postcode' as intent from homes union all select 'r' || o_orderkey, cast(o_orderkey as varchar), case when o_orderkey >= 10000 then 'reference' else case when length(cast(o_orderkey as varchar)) > 1 then 'area' else 'none' end end from orders where o_orderstatus = 'P'
  union all select 't' || n_nationkey, 'Town ' || n_nationkey, case when n_nationkey > 9 or true then 'address' end from nation union all select 'm' || k, '7 Main Road, ' || label, 'address' from homes
  union all select * from (values ('u', 'upper  town', 'area'), ('o', ' Old Quarter', 'area'), ('s', 'x', 'none'), ('i', 'A10 123', 'none')) v(query_id, q, intent))"""
TOKENS = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
SOLD_AT = "sold_at as (select o_orderkey as id, case when k % 9 <> 4 then eircode end as eircode, county, area_slug, (o_orderkey % 12) || ' Main Road, ' || label as address, cast(o_orderdate as date) as date_of_sale from orders join homes on o_custkey = k)"


@query(
    "x6_unified_search",
    f"""with {H.HOMES}, {H.FILED}, {SOLD_AT}, {ASKED}, a as (select query_id, q, intent, {TOKENS("q")} as t, lower(trim(q)) as low from asked where intent <> 'none'),
    ar as (select county, label, area_slug, count(*) as n from sold_at join (select distinct county, area_slug, label from homes) using (county, area_slug) group by all),
    pl as (select query_id, county, label, area_slug, n, {TOKENS("label")} = t as exact, (case when {TOKENS("label")} = t then 1000 else 0 end) + (case when starts_with({TOKENS("label")}, t) or starts_with(t, {TOKENS("label")}) then 300 else 0 end) + log10(n + 1) * 35 as score
      from a join ar on intent in ('address', 'area') and (contains(' ' || {TOKENS("label")}, ' ' || t) or starts_with(t, {TOKENS("label")}))),
    p8 as (select * from (select *, row_number() over (partition by query_id order by exact desc, round(score, 6) desc, n desc, label, county) as place from pl) where place <= 8),
    es as (select query_id, 'sale' as section, row_number() over (partition by query_id order by date_of_sale desc, id desc) as place, id, address as label from a join sold_at s on intent = 'postcode' and s.eircode = a.q),
    ep as (select query_id, 'planning' as section, row_number() over (partition by query_id order by registration_date desc, reference desc) as place, id, reference as label from a join filed f on intent = 'postcode' and f.eircode = a.q),
    ad as (select query_id, 'sale' as section, row_number() over (partition by query_id order by (case when {TOKENS("address")} = t then 1000 else 0 end) + (case when starts_with({TOKENS("address")}, t) then 500 else 0 end) + (case when contains({TOKENS("address")}, t) then 300 else 0 end) desc, date_of_sale desc, id desc) as place, id, address as label
      from a join (select *, string_split({TOKENS("address")}, ' ') as w from sold_at) s on intent = 'address' and list_has_all(s.w, string_split(t, ' '))),
    fp as (select distinct query_id, low, f.id, f.reference, f.registration_date from a join filed f on intent in ('reference', 'area') and contains(lower(f.reference), low) or intent in ('address', 'area') and contains(' ' || {TOKENS("f.location")} || ' ', ' ' || t || ' ')),
    f8 as (select * from (select *, row_number() over (partition by query_id order by registration_date desc, reference desc) as rn from fp) where rn <= 8),
    f9 as (select query_id, 'planning' as section, row_number() over (partition by query_id order by lower(reference) = low desc, registration_date desc, reference desc) as place, id, reference as label from f8)
    select query_id, 'place' as section, place, county || '/' || area_slug as ref, label from p8 union all select query_id, section, place, cast(id as varchar), label from (select * from es where place <= 25 union all select * from ep where place <= 25 union all select * from ad where place <= 6 union all select * from f9)""",
)
def unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every household's postcode and address, every town, the references of pending orders and some odd ones, all at once."""
    homes = H.homes(spark, sf_dir)
    orders = table(spark, sf_dir, "orders")
    turn = (F.col("o_orderkey") % 12).cast("string")
    sold = orders.join(homes, F.col("o_custkey") == F.col("k")).select(F.col("o_orderkey").alias("id"), F.when(F.col("k") % 9 != 4, F.col("eircode")).alias("eircode"), "county", "area_slug", F.concat(turn, F.lit(" Main Road, "), "label").alias("address"), F.to_date("o_orderdate").alias("date_of_sale"))
    areas = sold.groupBy("county", "area_slug").agg(F.count("*").alias("sales_count")).join(H.areas(spark, sf_dir), ["county", "area_slug"])
    key = F.col("o_orderkey").cast("string")
    asked = homes.select(F.concat(F.lit("c"), F.col("k").cast("string")).alias("query_id"), F.col("eircode").alias("query"))
    asked = asked.union(orders.where("o_orderstatus = 'P'").select(F.concat(F.lit("r"), key), key))
    town = F.col("n_nationkey").cast("string")
    asked = asked.union(table(spark, sf_dir, "nation").select(F.concat(F.lit("t"), town), F.concat(F.lit("Town "), town)))
    asked = asked.union(homes.select(F.concat(F.lit("m"), F.col("k").cast("string")), F.concat(F.lit("7 Main Road, "), "label")))
    asked = asked.union(spark.createDataFrame([("u", "upper  town"), ("o", " Old Quarter"), ("s", "x"), ("i", "A10 123")], "query_id string, query string"))
    return unified_search(asked, sold, H.filed(spark, sf_dir), areas)
