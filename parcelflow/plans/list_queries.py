"""Queries of area lists, status filters and JSON record sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.operators import lists as L
from parcelflow.plans import postal_queries as H
from parcelflow.plans.mapping import APPLICATIONS, SALES_AS_OF, applications, snapshot, snapshot_sql
from parcelflow.plans.registry import query

STATS = f"{H.HOMES}, {H.SOLD}, stats as (select county, area_slug, count(*) as sales_count, max(date_of_sale) as last_sale_date from sold group by 1, 2)"


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.sold(spark, sf_dir).groupBy("county", "area_slug").agg(F.count("*").alias("sales_count"), F.max("date_of_sale").alias("last_sale_date"))


@query("x14_search_areas", f"with {STATS} select county, area_slug, list_aggregate(list_transform(string_split(area_slug, '-'), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') as area_label, sales_count, last_sale_date from stats where trim(county) <> ''")
def search_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.search_areas(_stats(spark, sf_dir))


@query("x14_quick_areas", f"with {STATS} select county, area_slug, sales_count, last_sale_date from stats where trim(county) <> '' order by sales_count desc, county, area_slug limit 8")
def quick_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.quick_areas(_stats(spark, sf_dir))


@query("x14_county_areas", f"with {STATS}, r as (select *, row_number() over (partition by county order by sales_count desc, area_slug) as place from stats where trim(county) <> '') select county, area_slug, sales_count, last_sale_date, place from r where place <= 8")
def county_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.county_areas(_stats(spark, sf_dir))


@query("p11_status_filter", f"with {APPLICATIONS}, {snapshot_sql('n', SALES_AS_OF)} select 'decision_made' as asked, authority, count(*) as n from n where state = 'decision_made' group by 2 union all select 'P', authority, count(*) from n where status = 'P' group by 2")
def status_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applications of a state and of a source's own status."""
    rows = snapshot(applications(spark, sf_dir), SALES_AS_OF)
    parts = [rows.where(L.status_is(v)).groupBy(F.lit(v).alias("asked"), "authority").agg(F.count("*").alias("n")) for v in ("decision_made", "P")]
    return parts[0].unionByName(parts[1])


@query("s11_recordset", f"with {APPLICATIONS} select id, authority, registration_date, decision_date is null as undecided from applications where id % 3 > 0 union all select id, authority, registration_date, null from applications where id % 3 = 0")
def recordset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record sets, one JSON text for each authority and month, as rows joined by authority and reference to the applications (S11, J11); some records lack a field."""
    rows = applications(spark, sf_dir)
    record = F.struct(F.col("authority").alias("code"), F.concat(F.lit(" "), "reference").alias("ref"), F.when(F.col("id") % 3 > 0, F.col("decision_date").isNull()).alias("undecided"), F.col("status").alias("other"))
    texts = rows.groupBy("authority", F.trunc("registration_date", "month").alias("month")).agg(F.to_json(F.collect_list(record)).alias("records"))
    broken = spark.createDataFrame([("{}",), ("[",), (None,)], "records string")
    found = L.recordset(texts.select("records").union(broken), "records", "code string, ref string, undecided boolean")
    found = found.select(F.col("code").alias("authority"), F.btrim("ref").alias("reference"), "undecided")
    return found.join(rows.select("id", "authority", "reference", "registration_date"), ["authority", "reference"]).select("id", "authority", "registration_date", "undecided")
