"""Queries of the smaller set operations."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.operators import planning as P
from parcelflow.operators import records as R
from parcelflow.plans.mapping import APPLICATIONS, EVENTS_AS_OF, SALES, SALES_AS_OF, applications, sales, snapshot, snapshot_sql
from parcelflow.plans.registry import query
from parcelflow.sources.tables import table

DAY, EDAY = f"date '{SALES_AS_OF}'", f"date '{EVENTS_AS_OF}'"


@query("j5_semi_flag", "select c_custkey, c_custkey in (select o_custkey from orders where o_orderstatus = 'F') as has_final from customer")
def semi_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    final = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return R.flagged(table(spark, sf_dir, "customer").select("c_custkey"), final, "c_custkey", "has_final")


EVENT_ROWS = "ev as (select event_id, user_id as entity, cast(ts as date) as at, case when event_type in ('view', 'click') then 'status' else event_type end as type, case event_type when 'view' then 'seen' when 'click' then 'bought' else '' end as value from events)"


@query(
    "j6_suppressed_status",
    f"with {EVENT_ROWS} select type, value, count(*) as n from ev a where not (type = 'status' and exists (select 1 from ev b where b.entity = a.entity and b.at = a.at and b.type = case a.value when 'bought' then 'purchase' when 'seen' then 'signup' end)) group by all",
)
def suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generic events that a specific one of the same day explains are left out."""
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("entity"), F.to_date("ts").alias("at"), F.when(kind.isin("view", "click"), "status").otherwise(kind).alias("type"), F.when(kind == "view", "seen").when(kind == "click", "bought").otherwise("").alias("value"))
    return R.without_generic(rows, {"bought": "purchase", "seen": "signup"}).groupBy("type", "value").agg(F.count("*").alias("n"))


@query(
    "j7_latest_order",
    "select c_custkey, o_orderdate as last_o_orderdate, o_orderkey, o_orderstatus from customer left join (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders) o on o_custkey = c_custkey and rn = 1",
)
def latest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return R.with_latest(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey", "o_orderdate", ["o_orderkey", "o_orderstatus"])


@query("a48_route_index", "select lower(p_name) as slug, case when count(distinct p_brand) = 1 then min(p_brand) end as redirect, count(distinct p_brand) > 1 as ambiguous from part group by 1")
def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.route_index(table(spark, sf_dir, "part").select(F.lower("p_name").alias("slug"), F.col("p_brand").alias("destination")))


OLD = date(2000, 6, 28)


@query(
    "a49_mismatch_histogram",
    f"""with {APPLICATIONS}, {snapshot_sql('o', OLD)}, l as (select 'decision_date' as field, a.decision_date as a, o.decision_date + cast(id % 3 as int) as b from applications a join o using (id)
      union all select 'final_grant_date', a.final_grant_date, o.final_grant_date + cast(id % 3 as int) from applications a join o using (id)),
    k as (select field, case when a is not null and b is null then 'missing' when a is null and b is not null then 'absent' when b - a > 0 then '+' || (b - a) || ' days' when b - a < 0 then (b - a) || ' days' end as kind from l)
    select field, kind, count(*) as n from k where kind is not null group by all""",
)
def mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored dates, some shifted and some unknown, against the source's."""
    rows = applications(spark, sf_dir)
    shifted = snapshot(rows, OLD).select("id", *(F.date_add(c, (F.col("id") % 3).cast("int")).alias(c) for c in ("decision_date", "final_grant_date")))
    return R.mismatches(rows, shifted, "id", ["decision_date", "final_grant_date"])


@query(
    "a47_trend_series",
    f"""with {APPLICATIONS}, c as (select cast(date_trunc('month', registration_date) as date) as month, count(*) as n from applications where registration_date < date_trunc('month', {DAY}) group by 1), t as (select * from c order by month desc limit 12)
    select month, n, n - lag(n) over (order by month) as delta from t""",
)
def trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.trend_series(applications(spark, sf_dir), "registration_date", SALES_AS_OF)


@query(
    "a51_chart_heights",
    f"with {SALES}, m as (select strftime(date_of_sale, '%Y-%m') as month, count(*) as n from sales group by 1) select month, n, greatest(8.0::double, round(n / (select max(n) from m) * 100, 4)) as height from m",
)
def heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.scaled(sales(spark, sf_dir).groupBy(F.date_format("date_of_sale", "yyyy-MM").alias("month")).agg(F.count("*").alias("n")), "n")


@query("u6_head_and_tail", "select o_orderkey from (select o_orderkey from orders order by o_orderkey limit 10) union select o_orderkey from (select o_orderkey from orders order by o_orderkey desc limit 10)")
def head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of both ends, which is the feature."""
    return R.head_and_tail(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 10)


@query(
    "c22_qa_classes",
    f"""with {APPLICATIONS}, p as (select id, coalesce(decision_date < registration_date, false)::int + coalesce(final_grant_date < decision_date, false)::int + coalesce(greatest(registration_date, decision_date, final_grant_date) > {DAY}, false)::int as problems,
      (decision_date is null and {DAY} - registration_date > 365) as late from applications)
    select case when problems > 0 then case when id % 10 = 0 then 'REPAIRED' else 'FAIL' end when late then 'WARN' else 'PASS' end as class, count(*) as n from p group by 1""",
)
def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applications by quality class; those whose id is divisible by ten count as repaired."""
    found = R.timeline_problems(applications(spark, sf_dir), SALES_AS_OF)
    return found.groupBy(R.qa_class(F.col("problems"), F.col("warnings"), F.col("id") % 10 == 0).alias("class")).agg(F.count("*").alias("n"))


@query(
    "c17_membership_sync",
    f"""with m as (select user_id as page, min(cast(ts as date)) as entered, case when user_id % 5 = 0 then max(cast(ts as date)) end as left_ from events group by 1 having count(*) filter (event_type = 'purchase') > 0), s as (select user_id as page from events group by 1 having count(*) filter (event_type = 'click') > (select count(*) filter (event_type = 'click') / count(distinct user_id) from events))
    select page, case when s.page is not null and not (entered is not null and left_ is null) then {EDAY} else entered end as entered,
    case when s.page is not null then null when entered is not null and left_ is null then {EDAY} else left_ end as "left" from m full outer join s using (page)""",
)
def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a purchase are members; those of more clicks than the mean page are selected."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("page"), F.to_date("ts").alias("day"), (F.col("event_type") == "click").alias("click"), (F.col("event_type") == "purchase").alias("purchase"))
    pages = events.groupBy("page").agg(F.min("day").alias("entered"), F.max("day").alias("last"), F.count_if("click").alias("clicks"), F.count_if("purchase").alias("purchases"))
    members = pages.where("purchases > 0").select("page", "entered", F.when(F.col("page") % 5 == 0, F.col("last")).alias("left"))
    mean = pages.agg(F.avg("clicks").alias("mean"))  # one row
    return R.membership_sync(members, pages.crossJoin(F.broadcast(mean)).where("clicks > mean").select("page"), EVENTS_AS_OF)


@query("a41_conflicts", "select c_nationkey, count(distinct lower(trim(c_mktsegment))) as n from customer group by 1 having count(distinct lower(trim(c_mktsegment))) > 1")
def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.contradictions(table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment")


@query(
    "a36_changed_field_counts",
    f"""with {APPLICATIONS}, {snapshot_sql('o', OLD)}, {snapshot_sql('n', SALES_AS_OF)}, f as (select unnest(['state', 'decision_date', 'final_grant_date']) as field, unnest([n.state is distinct from o.state, n.decision_date is distinct from o.decision_date, n.final_grant_date is distinct from o.final_grant_date]) as differs from n join o using (id))
    select field, count(*) as n from f where differs group by 1""",
)
def changed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = applications(spark, sf_dir)
    found = P.changed_fields(snapshot(rows, OLD), snapshot(rows, SALES_AS_OF), "id", ["state", "decision_date", "final_grant_date"])
    return found.where("change = 'changed'").select(F.explode("fields").alias("field")).groupBy("field").agg(F.count("*").alias("n"))


@query(
    "a26_facet_document",
    f"""with {APPLICATIONS}, c as (select authority, status, count(*) as n from applications group by all) select authority, '[' || string_agg('"' || status || ':' || n || '"', ',' order by n desc, status) || ']' as facets from c group by 1""",
)
def facet_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered facets of each authority as a JSON array."""
    counts = applications(spark, sf_dir).groupBy("authority", "status").agg(F.count("*").alias("n"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "status", "n"))), lambda x: F.concat(x["status"], F.lit(":"), x["n"].cast("string")))
    return counts.groupBy("authority").agg(F.to_json(listed).alias("facets"))


@query(
    "x13_nearby_areas",
    f"""with {SALES}, a as (select county, area_slug, count(*) as n from sales group by all) select * from (select a.county, a.area_slug, b.area_slug as near, b.n, row_number() over (partition by a.county, a.area_slug order by b.n desc, b.area_slug) as place from a join a b on a.county = b.county and a.area_slug <> b.area_slug) where place <= 3""",
)
def nearby(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three busiest other areas of each area's county; a county's areas are a small dimension."""
    from pyspark.sql import Window

    areas = sales(spark, sf_dir).groupBy("county", "area_slug").agg(F.count("*").alias("n"))
    other = areas.withColumnRenamed("area_slug", "near")
    pairs = areas.drop("n").join(other, "county").where("near <> area_slug")
    place = F.row_number().over(Window.partitionBy("county", "area_slug").orderBy(F.desc("n"), "near"))
    return pairs.withColumn("place", place).where("place <= 3")
