"""Queries of record upkeep, places, display texts and postcode context."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.functions import display, places, status
from parcelflow.operators import context as X
from parcelflow.operators import upkeep as U
from parcelflow.plans.mapping import APPLICATIONS, EVENTS_AS_OF, SALES, SALES_AS_OF, SEARCH_DAYS, applications, sales, search_days, snapshot, snapshot_sql
from parcelflow.plans.registry import query
from parcelflow.sources.tables import table

DAY, EDAY, NOW = f"date '{SALES_AS_OF}'", f"date '{EVENTS_AS_OF}'", datetime(2024, 1, 28, 12)
OLD = date(2000, 6, 28)

#: Authority and written location of an application, by its id, in every form that locality rules tell apart.
PLACED_SQL = """placed as (select id, registration_date, ['CORKCOCO', 'KILDARE', 'GALWAYCITY', 'DLR', 'MEATH'][id % 5 + 1] as authority,
    case id % 7 when 0 then '1 Main Street, Naas, Co. Kildare' when 1 then 'Site at  blarney, County Cork' when 2 then 'Salthill, Galway' when 3 then '12'
      when 4 then 'Old Road, Trim, Co Meath, C15 X2Y3' when 5 then 'Dun Laoghaire' end as location,
    case id % 2 when 0 then 'Municipal District of: Ashbourne' end as ward from applications)"""


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id") % 7
    texts = ["1 Main Street, Naas, Co. Kildare", "Site at  blarney, County Cork", "Salthill, Galway", "12", "Old Road, Trim, Co Meath, C15 X2Y3", "Dun Laoghaire"]
    location = F.try_element_at(F.array(*map(F.lit, texts)), (k + 1).cast("int"))
    codes = F.array(*map(F.lit, ("CORKCOCO", "KILDARE", "GALWAYCITY", "DLR", "MEATH")))
    ward = F.when(F.col("id") % 2 == 0, "Municipal District of: Ashbourne")
    return applications(spark, sf_dir).select("id", "registration_date", F.get(codes, (F.col("id") % 5).cast("int")).alias("authority"), location.alias("location"), ward.alias("ward"))


LOCALITIES_SQL = PLACED_SQL + """, bare as (select *, case id % 7 when 0 then case authority when 'KILDARE' then 'Naas' else 'Co. Kildare' end
      when 1 then case authority when 'CORKCOCO' then 'Blarney' else 'County Cork' end when 2 then case authority when 'GALWAYCITY' then 'Salthill' else 'Galway' end
      when 4 then case authority when 'MEATH' then 'Trim' else 'Co Meath' end when 5 then 'Dun Laoghaire' else case id % 2 when 0 then 'Ashbourne' end end as locality from placed)"""


@query("f15_localities", f"with {APPLICATIONS}, {LOCALITIES_SQL} select authority, locality, count(*) as n from bare group by all")
def localities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locality of every application; the twin states the expected one for each written form."""
    found = places.locality(F.col("location"), F.col("ward"), F.col("authority"))
    return _placed(spark, sf_dir).groupBy("authority", found.alias("locality")).agg(F.count("*").alias("n"))


@query("p10_area_filter", f"with {APPLICATIONS}, {LOCALITIES_SQL} select authority, count(*) as n from bare where (location ilike '%Naas%' or locality = 'Naas') or authority = 'Naas' group by 1")
def area_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applications of an area by text, derived locality or authority."""
    rows = _placed(spark, sf_dir)
    inside = F.col("location").ilike("%Naas%") | (places.locality(F.col("location"), F.col("ward"), F.col("authority")) == "Naas") | (F.col("authority") == "Naas")
    return rows.where(inside).groupBy("authority").agg(F.count("*").alias("n"))


@query(
    "f42_sale_labels",
    f"""with {SALES}, c as (select *, array_to_string(list_transform(string_split(lower(county), ' '), lambda w: upper(w[1]) || w[2:]), ' ') as shown from sales),
    l as (select case when is_new_dwelling then address when is_new_dwelling is null then locality || ', ' || shown else shown end as label, county from c) select county, count(distinct label) as labels, min(label) as first_label from l group by 1""",
)
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses for some sales, localities or only counties for others."""
    new = F.col("is_new_dwelling")
    told = sales(spark, sf_dir).select("county", F.when(new, F.col("address")).alias("address"), F.when(new.isNull(), F.col("locality")).alias("locality"), F.lit(None).cast("string").alias("area_slug"))
    return display.sale_labels(told)


@query(
    "f35_market_matches",
    "select p_brand, count(*) filter (regexp_matches(p_name, '(^| )' || split_part(p_name, ' ', 2) || '( |$)') and not regexp_matches(p_name, '(^| )red( |$)')) as n from part group by 1",
)
def market_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with a token and without a rival's."""
    hit = places.in_market(F.col("p_name"), F.split_part("p_name", F.lit(" "), F.lit(2)), F.array(F.lit("red")))
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count_if(hit).alias("n"))


@query("f26_page_surfaces", "select case p_size % 4 when 0 then 'sold' when 1 then 'planning' end as surface, count(*) as n from part group by 1")
def surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 4
    url = F.concat(F.lit("https://example.org"), F.when(k == 0, "/sold-prices/mayo/").when(k == 1, "/planning/mayo/areas/").when(k == 2, "/planning/mayo/").otherwise("/sold-prices/"), F.col("p_partkey").cast("string"), F.lit("/"))
    return table(spark, sf_dir, "part").groupBy(places.page_surface(url).alias("surface")).agg(F.count("*").alias("n"))


def _decisions(rows: DataFrame, later: bool) -> DataFrame:
    k = F.col("id") % 4
    new = F.when(k == 0, "GRANTED  with conditions").when(k == 1, "refused").when(k == 2, "granted")
    words = new if later else F.when(k == 0, "Granted with conditions").when(k == 1, "granted")
    due = F.date_add("registration_date", F.lit(56) + (F.lit(7) if later else F.lit(0)) * (F.col("id") % 3).cast("int"))
    return rows.select("id", "decision_date", words.alias("decision_text"), (F.when(F.col("id") % 5 != 0, due) if later else F.when(F.col("id") % 7 != 0, due)).alias("decision_due_date"))


@query(
    "c5_c6_decision_changes",
    f"""with {APPLICATIONS}, {snapshot_sql('o', OLD)}, {snapshot_sql('n', SALES_AS_OF)}, b as (select id, o.decision_date is null and n.decision_date is not null as fired,
      case id % 4 when 0 then 'Granted with conditions' when 1 then 'granted' end as ot, case id % 4 when 0 then 'GRANTED  with conditions' when 1 then 'refused' when 2 then 'granted' end as nt,
      case when id % 7 <> 0 then registration_date + 56 end as od, case when id % 5 <> 0 then registration_date + 56 + cast(7 * (id % 3) as int) end as nd from (select id, registration_date, decision_date from n) n join (select id, decision_date from o) o using (id))
    select id as application_id, {DAY} as event_date, 'decision_changed' as event_type, 'Decision updated: ' || nt as label, ot as old_value, nt as new_value from b where id % 4 in (1, 2) and not fired
    union all select id, {DAY}, 'decision_due_changed', case when nd is null then 'Decision due date removed from source' else 'Decision due date updated' end, cast(od as varchar), cast(nd as varchar) from b where od is not null and od is distinct from nd""",
)
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = applications(spark, sf_dir)
    return U.decision_changes(_decisions(snapshot(rows, OLD), False), _decisions(snapshot(rows, SALES_AS_OF), True), SALES_AS_OF)


FIELDS = ["decision_date", "final_grant_date"]


@query(
    "c11_known_kept",
    f"with {APPLICATIONS}, {snapshot_sql('o', OLD)} select a.id, coalesce(o.decision_date, a.decision_date) as decision_date, coalesce(o.final_grant_date, a.final_grant_date) as final_grant_date from o join applications a using (id)",
)
def known_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = applications(spark, sf_dir)
    return U.known_kept(rows, snapshot(rows, OLD), "id", FIELDS)


@query(
    "s17_conditional_update",
    f"with {APPLICATIONS}, {snapshot_sql('o', OLD)} select o.id, a.decision_date, a.final_grant_date, a.decision_date is distinct from o.decision_date or a.final_grant_date is distinct from o.final_grant_date as changed from o join applications a using (id)",
)
def conditional_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows take incoming values where they differ."""
    rows = applications(spark, sf_dir)
    return U.updated(snapshot(rows, OLD).select("id", *FIELDS), rows, "id", FIELDS)


@query(
    "c16_revisions",
    f"with {APPLICATIONS}, {snapshot_sql('o', OLD)} select a.id, a.decision_date, a.final_grant_date, case when o.id is not null and a.decision_date is not distinct from o.decision_date and a.final_grant_date is not distinct from o.final_grant_date then timestamp '2000-06-28 00:00:00' else timestamp '2024-01-28 12:00:00' end as updated_at from applications a left join o using (id)",
)
def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = applications(spark, sf_dir)
    return U.revised(snapshot(rows, OLD).select("id", *FIELDS, F.lit(datetime(2000, 6, 28)).alias("updated_at")), rows, "id", FIELDS, NOW)


@query(
    "c14_marked_checked",
    f"""with {APPLICATIONS}, {snapshot_sql('n', SALES_AS_OF)} select authority, count(*) as n, count(*) filter (authority = 'NATION_1' and registration_date >= date '1996-01-01' and registration_date < date '1999-01-01' and final_grant_date is null
      and (id % 3 > 0 or appeal_lodged_date is null) and state <> 'final_grant' and (appeal_lodged_date is not null or state = 'appealed' or decision_date is null or decision_date >= {DAY} - 180)) as checked from n group by 1""",
)
def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = snapshot(applications(spark, sf_dir), SALES_AS_OF).withColumns({"last_checked": F.lit(None).cast("date"), "appeal_decision_date": F.when(F.col("id") % 3 == 0, F.date_add("appeal_lodged_date", 30))})
    found = U.marked_checked(rows, "NATION_1", date(1996, 1, 1), date(1999, 1, 1), SALES_AS_OF)
    return found.groupBy("authority").agg(F.count("*").alias("n"), F.count("last_checked").alias("checked"))


@query(
    "a39_quality_candidates",
    f"with {APPLICATIONS}, {SEARCH_DAYS} select id, authority, reference, sum(clicks) as clicks, sum(impressions) as impressions from search_days join applications on page = id where day >= {EDAY} - 28 group by all order by 4 desc, 5 desc, 2, 3 limit 20",
)
def quality_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.quality_candidates(applications(spark, sf_dir), search_days(spark, sf_dir), EVENTS_AS_OF)


@query(
    "c21_proposal_backfill",
    f"""with {APPLICATIONS}, {SEARCH_DAYS}, {snapshot_sql('n', SALES_AS_OF)}, t as (select page, sum(clicks) as clicks, sum(impressions) as impressions from search_days group by 1), r as (select n.id, reference, registration_date, coalesce(clicks, 0) as clicks, coalesce(impressions, 0) as impressions, status = 'P' as is_notable,
      case when coalesce(clicks, 0) > 0 or coalesce(impressions, 0) > 0 or status = 'P' then 0 when registration_date >= {DAY} - interval 24 month and state not in ('decision_made', 'final_grant') and decision_date is null and id % 4 > 0 then 1 else 2 end as priority from n left join t on page = n.id where length(location) = 18 and registration_date between date '1996-01-01' and date '2001-06-30')
    select * from r order by priority, clicks desc, impressions desc, registration_date desc, reference desc, id limit 100""",
)
def proposal_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applications of a span of days whose text has just the length at which its source cuts."""
    rows = snapshot(applications(spark, sf_dir), SALES_AS_OF).withColumn("withdrawal_date", F.when(F.col("id") % 4 == 0, F.date_add("registration_date", 10)))
    cut = F.length("location") == 18
    return U.proposal_backfill(rows, search_days(spark, sf_dir), rows.where("status = 'P'"), cut, SALES_AS_OF, 100, date(1996, 1, 1), date(2001, 6, 30))


@query(
    "q5_cancelled",
    """with q as (select o_orderkey as id, o_custkey % 50 as subscription_id, case o_orderstatus when 'F' then 'sent' when 'P' then 'sending' else 'queued' end as status, o_custkey % 50 % 3 = 0 and o_custkey % 50 % 2 = 0 and o_orderstatus <> 'F' as hit from orders)
    select case when hit then 'failed' else status end as status, case when hit then 'Subscription disabled before delivery.' end as last_error, count(*) as n, count(*) filter (not hit) as due from q group by all""",
)
def cancelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "sent").when(F.col("o_orderstatus") == "P", "sending").otherwise("queued")
    queue = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("subscription_id"), state.alias("status"), F.lit(NOW).alias("next_attempt_at"), F.lit(None).cast("timestamp").alias("claimed_at"), F.lit(None).cast("string").alias("claim_token"), F.lit(None).cast("string").alias("last_error"))
    keys = queue.select("subscription_id").distinct()
    was, now = keys.withColumn("enabled", F.col("subscription_id") % 3 == 0), keys.withColumn("enabled", F.col("subscription_id") % 2 != 0)
    return U.cancelled(queue, was, now).groupBy("status", "last_error").agg(F.count("*").alias("n"), F.count("next_attempt_at").alias("due"))


@query(
    "q9_watched",
    """with e as (select distinct user_id as application_id from events), s as (select application_id, case when application_id % 4 = 0 then timestamp '2024-01-01' end as initialized_at, case when application_id % 6 = 0 then timestamp '2024-01-02' end as requested_at from e where application_id % 2 = 0), w as (select application_id from e where application_id % 3 <> 1)
    select application_id, initialized_at, case when initialized_at is null and w.application_id is not null then coalesce(requested_at, timestamp '2024-01-28 12:00:00') else requested_at end as requested_at from s full outer join w using (application_id)""",
)
def watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the applications have a watch; two thirds have an enabled subscription."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("application_id")).distinct()
    k = F.col("application_id")
    state = rows.where(k % 2 == 0).select("application_id", F.when(k % 4 == 0, F.lit(datetime(2024, 1, 1))).alias("initialized_at"), F.when(k % 6 == 0, F.lit(datetime(2024, 1, 2))).alias("requested_at"))
    return U.watched(state, rows.withColumn("enabled", k % 3 != 1), NOW)


@query(
    "w3_first_rows",
    "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts, event_id) as rn from events) where rn = 1",
)
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.first_rows(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], [F.asc("ts"), F.asc("event_id")]).drop("ts")


@query("w9_path_cohort", "select lower(p_type) as path, max(p_retailprice) as score from part group by 1 order by 2 desc, 1 limit 100")
def path_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.path_cohort(table(spark, sf_dir, "part").select(F.lower("p_type").alias("path"), F.col("p_retailprice").alias("score")))


@query(
    "d13_due_shown",
    f"with {APPLICATIONS}, {snapshot_sql('n', SALES_AS_OF)} select state, case when state not in ('decision_made', 'final_grant') and decision_date is null and final_grant_date is null and id % 3 <> 0 then registration_date + 56 end as due, count(*) as n from n group by all",
)
def due_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Due dates of open applications; a third are no dates."""
    rows = snapshot(applications(spark, sf_dir), SALES_AS_OF)
    written = F.when(F.col("id") % 3 == 0, "2001-02-30").otherwise(F.date_add("registration_date", 56).cast("string"))
    shown = display.due_shown(written, F.col("state"), F.col("decision_date"), F.col("final_grant_date"))
    return rows.groupBy("state", shown.alias("due")).agg(F.count("*").alias("n"))


@query(
    "a37_state_stats",
    f"with {APPLICATIONS} select case when id % 4 in (0, 1) then 'Withdrawn' else 'Status not classified' end as label, count(*) as n from applications group by 1",
)
def state_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of raw wordings, summed by state."""
    k = F.col("id") % 4
    raw = F.when(k == 0, "WITHDRAWN").when(k == 1, "withdrawn").when(k == 2, "no such wording")
    counts = applications(spark, sf_dir).groupBy(raw.alias("raw")).agg(F.count("*").alias("n"))
    return counts.groupBy(status.label(status.canonical(F.col("raw"))).alias("label")).agg(F.sum("n").alias("n"))


@query(
    "o4_recent_nulls_first",
    f"with {APPLICATIONS} select id, decision_date, row_number() over (order by decision_date desc nulls first, id) as place from applications order by decision_date desc nulls first, id limit 8",
)
def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight latest, unknown dates first (O4); the limit is the feature."""
    from pyspark.sql import Window

    top = applications(spark, sf_dir).select("id", "decision_date").orderBy(F.desc_nulls_first("decision_date"), "id").limit(8)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_first("decision_date"), "id")))


def _code(number: Column) -> Column:
    return F.concat(F.lit("A"), F.lpad((number % 90 + 10).cast("string"), 2, "0"), F.lit(" "), F.lpad((number % 10000).cast("string"), 4, "0"))


def _number(name: str) -> Column:
    return F.regexp_extract(name, r"(\d+)$", 1).cast("long")


def _coded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    numbers = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array(F.lit(0), F.lit(4), F.lit(3000))).alias("step"))
    codes = numbers.select(_code(F.col("c_custkey") + F.col("step")).alias("eircode"))
    sold = sales(spark, sf_dir).select(_code(_number("address")).alias("eircode"), "date_of_sale", "county", "locality", F.when(F.col("is_new_dwelling"), F.col("area_slug")).alias("area_slug"), "price_eur")
    planned = applications(spark, sf_dir).select("id", _code(_number("location") + 7).alias("eircode"), "registration_date", F.col("authority").alias("county"), F.lit(" ").alias("locality"), F.when(F.col("id") % 2 == 0, F.lower("authority")).alias("area_slug"))
    return codes, sold, planned


def _code_sql(number: str) -> str:
    return f"'A' || ({number}) % 90 + 10 || ' ' || lpad(cast(({number}) % 10000 as varchar), 4, '0')".replace(f"({number}) % 90 + 10", f"cast(({number}) % 90 + 10 as varchar)")


CODED_SQL = f"""{SALES}, {APPLICATIONS}, codes as (select distinct {_code_sql('k')} as eircode from (select c_custkey + unnest([0, 4, 3000]) as k from customer)),
    sold as (select {_code_sql("cast(regexp_extract(address, '(\\d+)$', 1) as bigint)")} as eircode, date_of_sale, county, locality, case when is_new_dwelling then area_slug end as area_slug from sales),
    planned as (select id, {_code_sql("cast(regexp_extract(location, '(\\d+)$', 1) as bigint) + 7")} as eircode, registration_date, authority as county, cast(null as varchar) as locality, case when id % 2 = 0 then lower(authority) end as area_slug from applications)"""


@query(
    "x7_exact_records",
    f"with {CODED_SQL}, r as (select eircode, 'sale' as surface, date_of_sale as day from sold union all select eircode, 'planning', registration_date from planned) select eircode, surface, count(*) as n, max(day) as latest from r where eircode in (select eircode from codes) group by all",
)
def exact_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, sold, planned = _coded(spark, sf_dir)
    found = X.exact_records(codes, sold.withColumn("id", F.lit(0).cast("long")), planned)
    return found.groupBy("eircode", "surface").agg(F.count("*").alias("n"), F.max("day").alias("latest"))


@query(
    "x4_unique_places",
    "with a as (select distinct c_nationkey as county, c_custkey % 1000 as k from customer) select 'area ' || k as query, min(county) as county, 'area-' || k as area_slug from a group by k having count(*) = 1",
)
def unique_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area names that only one nation has, asked in another case."""
    k = (F.col("c_custkey") % 1000).cast("string")
    customers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("county"), F.concat(F.lit("area-"), k).alias("area_slug"), F.concat(F.lit("Area "), k).alias("area_label"))
    return X.unique_place(customers.select(F.lower("area_label").alias("query")), customers.distinct())
