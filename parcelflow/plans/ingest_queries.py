"""Queries over raw texts: names, addresses, pages, JSON fields and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.functions import dates, text
from parcelflow.plans.mapping import APPLICATIONS, SALES_AS_OF, applications
from parcelflow.plans.registry import query
from parcelflow.sources import files
from parcelflow.sources.tables import table

DAY = f"date '{SALES_AS_OF}'"


@query(
    "f1_f7_names",
    """with s as (select p_partkey as id, p_name || ', ' || p_type || ' ,, ' || p_brand as address, p_brand as county, p_name from part)
    select id, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') as slug,
    array_to_string(list_transform(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), '-'), lambda w: upper(w[1:1]) || w[2:]), ' ') as title,
    array_to_string(list_filter(list_transform(string_split(address, ','), lambda x: trim(x)), lambda x: x <> ''), ', ') as compact,
    upper(trim(regexp_replace(address, '\\s+', ' ', 'g'))) as normal,
    list_filter(list_transform(string_split(address, ','), lambda x: trim(x)), lambda x: x <> '')[-2] as locality from s""",
)
def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs, titles, compact and normal addresses and localities."""
    address = F.concat("p_name", F.lit(", "), "p_type", F.lit(" ,, "), "p_brand")
    slug = text.slug(F.col("p_name"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), slug.alias("slug"), text.slug_title(slug).alias("title"), text.compact_address(address).alias("compact"), text.normalised_address(address).alias("normal"), text.locality_of(address, F.col("p_brand")).alias("locality"))


@query(
    "f9_f12_record_fields",
    """with s as (select o_orderkey as id, case o_orderkey % 4 when 0 then '€1,' || (o_orderkey % 900 + 100) || '.50' when 1 then '1.2.3' when 2 then '' else cast(o_orderkey as varchar) end as price,
      case o_orderkey % 5 when 0 then 'Yes' when 1 then ' n ' when 2 then 'TRUE' when 3 then '0' else 'maybe' end as flag, case o_orderkey % 3 when 0 then 'New Dwelling house' when 1 then 'Second-Hand house' else ' ' end as what from orders)
    select id, try_cast(regexp_replace(price, '[^0-9.]', '', 'g') as double) as price, case when lower(trim(flag)) in ('yes', 'y', 'true', '1') then true when lower(trim(flag)) in ('no', 'n', 'false', '0') then false end as flag,
    case when trim(what) <> '' then contains(lower(what), 'new dwelling') end as is_new, sha256('{"price":"' || price || '","flag":"' || flag || '"}') as hash from s""",
)
def record_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices, flags, new dwellings and record hashes."""
    k = F.col("o_orderkey")
    price = F.when(k % 4 == 0, F.concat(F.lit("€1,"), (k % 900 + 100).cast("string"), F.lit(".50"))).when(k % 4 == 1, "1.2.3").when(k % 4 == 2, "").otherwise(k.cast("string"))
    flag = F.when(k % 5 == 0, "Yes").when(k % 5 == 1, " n ").when(k % 5 == 2, "TRUE").when(k % 5 == 3, "0").otherwise("maybe")
    what = F.when(k % 3 == 0, "New Dwelling house").when(k % 3 == 1, "Second-Hand house").otherwise(" ")
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), price.alias("price"), flag.alias("flag"), what.alias("what"))
    return rows.select("id", text.price(F.col("price")).alias("price"), text.flag(F.col("flag")).alias("flag"), text.new_dwelling(F.col("what")).alias("is_new"), text.record_hash(F.col("price"), F.col("flag")).alias("hash"))


@query(
    "f24_reference_slugs",
    "select o_orderkey as id, 'ref-' || rtrim(replace(replace(base64(encode(o_orderpriority || '/' || o_orderkey)), '+', '-'), '/', '_'), '=') as slug, o_orderpriority || '/' || o_orderkey as back from orders",
)
def reference_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    slug = text.reference_slug(F.concat("o_orderpriority", F.lit("/"), F.col("o_orderkey").cast("string")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), slug.alias("slug"), text.reference_of(slug).alias("back"))


@query(
    "f25_page_urls",
    r"""select page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) as host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) as path from pages""",
)
def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(url, "^[a-z]+://([^/?#:]+)", 1).alias("host"), F.regexp_extract(url, "^[a-z]+://[^/?#]+([^?#]*)", 1).alias("path"))


@query(
    "f36_page_text",
    r"""with t as (select page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') as t from pages)
    select page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[ \t\n\x0b\f\r]+', ' ', 'g'))) as text_md5 from t""",
)
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.html_text(F.col("html"))).alias("text_md5"))


@query(
    "f41_json_fields",
    "select event_type, count(*) as n, sum(try_cast(props->>'k' as int))::bigint as total, max(try_cast(props->>'k' as int)) as top from events group by 1",
)
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"), F.max(k).alias("top"))


@query(
    "d12_due_texts",
    f"""with {APPLICATIONS}, d as (select id, date_diff('day', {DAY}, registration_date) as n from applications)
    select id, case when n = 0 then 'due today' when n > 0 then 'due in ' || n || case when n = 1 then ' day' else ' days' end else 'due ' || -n || case when n = -1 then ' day' else ' days' end || ' ago' end as due from d""",
)
def due_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return applications(spark, sf_dir).select("id", dates.due_text(F.col("registration_date"), SALES_AS_OF).alias("due"))


@query(
    "s14_insert_new",
    "select l_orderkey, count(*) as n from (select distinct l_orderkey, l_partkey from lineitem) where not exists (select 1 from orders where o_orderkey = l_orderkey and o_orderstatus = 'O') group by 1",
)
def insert_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that a target does not have, one of each."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    known = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    return lines.join(known, "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query(
    "s15_upsert",
    """with t as (select c_custkey as k, c_name as name, 1 as version from customer where c_custkey % 2 = 0), i as (select c_custkey as k, 'new ' || c_name as name, 1 + c_custkey % 3 as version from customer where c_custkey % 3 = 0),
    u as (select *, 0 as n from t union all select *, 1 from i) select k, name, version::bigint as version from (select *, row_number() over (partition by k order by version desc, n desc) as rn from u) where rn = 1""",
)
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    target = rows.where("k % 2 = 0").withColumn("version", F.lit(1).cast("long"))
    incoming = rows.where("k % 3 = 0").select("k", F.concat(F.lit("new "), "name").alias("name"), (1 + F.col("k") % 3).alias("version"))
    return files.upsert(target, incoming, ["k"], "version")


@query(
    "s18_fill_nulls",
    f"with {APPLICATIONS} select id, coalesce(decision_date, case when id % 2 = 0 then registration_date + 30 end) as decision_date from applications",
)
def fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = applications(spark, sf_dir).select("id", "decision_date", "registration_date")
    extra = rows.where("id % 2 = 0").select("id", F.date_add("registration_date", 30).alias("decision_date"))
    return files.fill_nulls(rows.select("id", "decision_date"), extra, "id", ["decision_date"])


@query(
    "s20_sitemap",
    r"""select url, '<url><loc>' || replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') || '</loc><lastmod>2024-01-28</lastmod></url>' as entry from pages""",
)
def sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.sitemap(table(spark, sf_dir, "pages").withColumn("day", F.lit("2024-01-28").cast("date")), "url", "day")
