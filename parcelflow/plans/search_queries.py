"""Queries over search performance, alert queues, places and positions; the event log stands for the days of pages."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.functions import geo, postcode, status, text
from parcelflow.operators import fulltext
from parcelflow.operators import measure as M
from parcelflow.operators import search as X
from parcelflow.plans.mapping import APPLICATIONS, EVENTS_AS_OF, SALES, SEARCH_DAYS, applications, sales, search_days
from parcelflow.plans.registry import query
from parcelflow.sources.tables import table

DAY = f"date '{EVENTS_AS_OF}'"
NOW = datetime(2024, 1, 28, 12)
TOTALS = f"""totals as (select page, sum(clicks)::bigint as clicks, sum(impressions)::bigint as impressions, count(distinct day) as days,
  round(sum(clicks) / nullif(sum(impressions), 0), 6) as ctr, round(sum(position * impressions) / nullif(sum(impressions), 0) + 1e-7, 4) as position
  from search_days where day between {DAY} - 27 and {DAY} group by page)"""


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.page_totals(search_days(spark, sf_dir), EVENTS_AS_OF - timedelta(days=27), EVENTS_AS_OF)


@query("a33_page_totals", f"with {SEARCH_DAYS}, {TOTALS} select * from totals")
def page_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals(spark, sf_dir)


@query("a34_top_pages", f"with {SEARCH_DAYS}, {TOTALS} select page, clicks, impressions from totals order by clicks desc, impressions desc, page limit 10")
def top_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.top_pages(_totals(spark, sf_dir)).select("page", "clicks", "impressions")


@query(
    "a35_trends",
    f"with {SEARCH_DAYS} "
    + " union all ".join(
        f"""select {n} as span, coalesce(sum(clicks) filter (day between {DAY} - {n - 1} and {DAY}), 0)::bigint as clicks, coalesce(sum(clicks) filter (day between {DAY} - {2 * n - 1} and {DAY} - {n}), 0)::bigint as previous_clicks,
    coalesce(sum(impressions) filter (day between {DAY} - {n - 1} and {DAY}), 0)::bigint as impressions, coalesce(sum(impressions) filter (day between {DAY} - {2 * n - 1} and {DAY} - {n}), 0)::bigint as previous_impressions from search_days"""
        for n in (7, 28)
    ),
)
def trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.trends(search_days(spark, sf_dir), EVENTS_AS_OF)


@query(
    "a38_promotions",
    f"""with {SEARCH_DAYS} select page, count(distinct day) as days, sum(clicks)::bigint as clicks, sum(impressions)::bigint as impressions from search_days
    where day >= {DAY} - 90 and page % 5 <> 0 group by page having count(distinct day) >= 3 and (sum(clicks) >= 2 or sum(impressions) >= 100)""",
)
def promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to promote; those whose number is divisible by five are notable already."""
    days = search_days(spark, sf_dir)
    return M.promotions(days, days.where("page % 5 = 0").select("page").distinct(), EVENTS_AS_OF)


@query(
    "w7_stratified_sample",
    f"""with {SEARCH_DAYS}, c as (select page, case page % 3 when 0 then 'notable' when 1 then 'left' else 'recent' end as cohort, sum(clicks)::bigint as clicks from search_days group by page),
    r as (select *, row_number() over (partition by cohort order by clicks desc, page) as rank from c)
    select page, cohort, clicks from r where rank <= 40 order by case when rank <= case cohort when 'notable' then 8 when 'left' then 12 else 20 end then case cohort when 'notable' then 0 when 'left' then 1 else 2 end else 3 end, clicks desc, page limit 40""",
)
def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 40 pages with quotas of cohorts; sampling is the feature."""
    pages = search_days(spark, sf_dir).groupBy("page").agg(F.sum("clicks").alias("clicks"))
    cohort = F.when(F.col("page") % 3 == 0, "notable").when(F.col("page") % 3 == 1, "left").otherwise("recent")
    return M.stratified(pages.withColumn("cohort", cohort), 40, {"notable": 0.2, "left": 0.3, "recent": 0.5}, [F.desc("clicks"), F.asc("page")]).select("page", "cohort", "clicks")


@query(
    "c18_inspection_priority",
    f"""with {SEARCH_DAYS}, p as (select distinct page from search_days), l as (select page, max(day) as inspected, sum(clicks) > 10 as indexed from search_days where page % 4 <> 0 group by page)
    select * from (select page, case when inspected is null then 0 when not indexed and {DAY} - inspected >= 7 then 1 when indexed and {DAY} - inspected >= 30 then 2 end as priority, md5(cast(page as varchar) || '{EVENTS_AS_OF}') as shuffle from p left join l using (page)) where priority is not null""",
)
def inspections(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = search_days(spark, sf_dir)
    last = days.where("page % 4 <> 0").groupBy("page").agg(F.max("day").alias("inspected"), (F.sum("clicks") > 10).alias("indexed"))
    return M.inspection_priority(days.select("page").distinct(), last, EVENTS_AS_OF)


@query(
    "a32_days_to_first_purchase",
    """with v as (select user_id, min(ts) as t from events where event_type = 'view' group by 1), p as (select user_id, min(ts) as t from events where event_type = 'purchase' group by 1)
    select round(median((epoch_us(p.t) - epoch_us(v.t)) / 86400000000.0), 4) as median_days, count(*) as n from v join p using (user_id) where p.t >= v.t""",
)
def time_to_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median days between the first of one kind and the first of another."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    first = {k: events.where(F.col("event_type") == k).groupBy("user_id").agg(F.min(F.col("ts").cast("timestamp")).alias(k)) for k in ("view", "purchase")}
    both = first["view"].join(first["purchase"], "user_id").where("purchase >= view")
    days = (F.unix_micros("purchase") - F.unix_micros("view")) / 86_400_000_000.0
    return both.agg(F.round(F.median(days), 4).alias("median_days"), F.count("*").alias("n"))


QUEUE = """subs as (select user_id as subscription, user_id as entity, min(ts) as created_at from events where event_type = 'signup' group by 1),
  seen as (select event_id as change, user_id as entity, ts as observed_at from events where event_type in ('purchase', 'error'))"""


def _alerts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    subs = events.where("event_type = 'signup'").groupBy(F.col("user_id").alias("subscription")).agg(F.min("ts").alias("created_at")).withColumn("entity", F.col("subscription"))
    seen = events.where(F.col("event_type").isin("purchase", "error")).select(F.col("event_id").alias("change"), F.col("user_id").alias("entity"), F.col("ts").alias("observed_at"))
    sent = seen.where("change % 10 = 0").select(F.col("entity").alias("subscription"), "change")
    return seen, subs, sent


@query("q1_enqueue_alerts", f"with {QUEUE} select subscription, change from seen join subs using (entity) where observed_at >= created_at and change % 10 <> 0")
def enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries due (J2, J3, J4, Q1, Q10); changes whose number is divisible by ten were sent before."""
    seen, subs, sent = _alerts(spark, sf_dir)
    return M.enqueue(seen, subs, sent)


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'purchase'")
    return events.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 0, "processing").otherwise("queued").alias("status"), (F.col("event_id") % 7).cast("int").alias("attempts"), F.col("ts").alias("due_at"), F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("claimed_at"), F.when(F.col("event_id") % 3 == 0, F.sha2(F.col("event_id").cast("string"), 256)).alias("token"), F.col("user_id").alias("subscription"), F.date_trunc("day", "ts").alias("created_at"))


QUEUED = "queue as (select event_id as id, case when event_id % 3 = 0 then 'processing' else 'queued' end as status, (event_id % 7)::int as attempts, ts as due_at, case when event_id % 3 = 0 then ts end as claimed_at, case when event_id % 3 = 0 then sha256(cast(event_id as varchar)) end as token, user_id as subscription, date_trunc('day', ts) as created_at from events where event_type = 'purchase')"


@query(
    "q2_claim_batch",
    f"""with {QUEUED}, c as (select id from queue where status = 'queued' and attempts < 5 and due_at <= timestamp '{NOW}' and subscription % 4 <> 0 order by due_at, created_at, id limit 25)
    select id, case when id in (select id from c) then 'processing' else status end as status, attempts + (id in (select id from c))::int as attempts, case when id not in (select id from c) then due_at end as due_at,
    case when id in (select id from c) then sha256(cast(id as varchar) || ':{NOW}') end as token, case when id in (select id from c) then timestamp '{NOW}' end as claimed_at from queue""",
)
def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscriptions whose number is divisible by four are disabled."""
    queue = _queue(spark, sf_dir)
    return M.claim(queue, queue.where("subscription % 4 <> 0").select("subscription").distinct(), NOW)


@query(
    "q3_expire_leases",
    f"""with {QUEUED}, q as (select *, coalesce(status = 'processing' and claimed_at <= timestamp '{NOW}' - interval 30 minute, false) as stale from queue)
    select id, case when stale and attempts >= 5 then 'failed' when stale then 'queued' else status end as status,
      case when stale and attempts < 5 then timestamp '{NOW}' when not stale then due_at end as due_at, case when not stale then claimed_at end as claimed_at, case when not stale then token end as token from q""",
)
def expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.expire_leases(_queue(spark, sf_dir), NOW).select("id", "status", "due_at", "claimed_at", "token")


@query(
    "q4_complete",
    f"""with {QUEUED}, r as (select id, case when id % 2 = 0 then token else 'stale' end as given, id % 4 <> 0 as ok from queue where status = 'processing'),
    j as (select queue.*, r.ok, coalesce(status = 'processing' and token = given, false) as holds from queue left join r using (id))
    select id, case when holds and ok then 'sent' when holds and attempts >= 5 then 'failed' when holds then 'queued' else status end as status, attempts,
    case when holds and not ok then timestamp '{NOW}' + to_minutes(least(60, cast(floor(5 * pow(2, attempts - 1)) as int))) else due_at end as due_at, case when not holds then token end as token from j""",
)
def completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = _queue(spark, sf_dir)
    results = queue.where("status = 'processing'").select("id", F.when(F.col("id") % 2 == 0, F.col("token")).otherwise("stale").alias("token"), (F.col("id") % 4 != 0).alias("ok"))
    return M.complete(queue, results, NOW)


@query(
    "q8_revalidation_queue",
    """with q as (select user_id as entity, max(ts) as requested_at from events where event_type = 'error' group by 1)
    select * from q where entity % 3 <> 0""",
)
def revalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest request of each entity, less those worked off as of that request."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'error'").select(F.col("user_id").alias("entity"), F.col("ts").alias("requested_at"))
    queue = M.coalesced(events)
    return M.cleared(queue, queue.where("entity % 3 = 0"))


@query(
    "q6_watch_changes",
    f"""with {SEARCH_DAYS}, o as (select page as entity, sum(clicks)::bigint as clicks, max(day) as last_day from search_days where day <= date '2024-01-14' group by 1), n as (select page as entity, sum(clicks)::bigint as clicks, max(day) as last_day from search_days group by 1)
    select entity, array_to_string(list_filter([case when n.clicks is distinct from o.clicks then 'clicks' end, case when n.last_day is distinct from o.last_day then 'last_day' end], lambda x: x is not null), ',') as fields
    from n join o using (entity) where n.clicks is distinct from o.clicks or n.last_day is distinct from o.last_day""",
)
def watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = search_days(spark, sf_dir)
    state = lambda d: d.groupBy(F.col("page").alias("entity")).agg(F.sum("clicks").alias("clicks"), F.max("day").alias("last_day"))
    _, changes = M.watch_changes(state(days.where("day <= '2024-01-14'")), state(days), ["clicks", "last_day"])
    return changes.select("entity", F.array_join("fields", ",").alias("fields"))


@query(
    "x3_suggested_places",
    f"""with {SALES}, a as (select county, replace(area_slug, '-', ' ') as label, count(*) as n from sales group by all)
    select county, label, n as sales_count, round(case when label = 'promo' then 1300 when starts_with(label, 'promo') then 300 else 0 end + log10(n + 1) * 35, 6) as score from a order by 4 desc, 3 desc, 2, 1 limit 8""",
)
def suggested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best places for a term; no area of the tables is street-like, the tests have such ones."""
    slug = F.col("area_slug")
    areas = sales(spark, sf_dir).groupBy("county", "area_slug").agg(F.count("*").alias("sales_count"))
    return X.suggested_places(areas.withColumn("label", F.replace(slug, F.lit("-"), F.lit(" "))), "Promo")


@query(
    "x5_address_ranking",
    f"""with {SALES}, s as (select address, date_of_sale, price_eur, case when address = 'Customer#000000012' then 1800 when starts_with(address, 'Customer#000000012') then 800 else 0 end as score from sales)
    select address, date_of_sale, price_eur, score from s order by score desc, date_of_sale desc, address, price_eur limit 6""",
)
def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.rank_addresses(sales(spark, sf_dir), "Customer#000000012").select("address", "date_of_sale", "price_eur", "score")


def _round_trip_sql() -> str:
    """The series of both ways for DuckDB, over rows of `applications`; `p` holds positions, `b` the way back of those inside the box."""
    add = lambda first, terms: " ".join([first, *terms])
    x = add("xi", [f"- ({c!r}) * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate(geo._BACK, 1)])
    y = add("eta", [f"- ({c!r}) * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate(geo._BACK, 1)])
    lat = add("chi", [f"+ ({c!r}) * sin({2 * j} * chi)" for j, c in enumerate(geo._LATITUDE, 1)])
    east = add("eta", [f"+ ({c!r}) * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate(geo._FORWARD, 1)])
    north = add("xi", [f"+ ({c!r}) * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate(geo._FORWARD, 1)])
    return f"""r as (select grid_easting::double as e, grid_northing::double as n, (grid_northing - {geo.FALSE_N!r} + {geo._NORTH0!r}) / {geo._RADIUS!r} as xi, (grid_easting - {geo.FALSE_E!r}) / {geo._RADIUS!r} as eta from applications),
    c as (select e, n, {x} as x, {y} as y from r), d as (select *, asin(sin(x) / cosh(y)) as chi from c), p as (select e, n, {lat} as phi, {geo.LNG0!r} + atan2(sinh(y), cos(x)) as lam from d),
    q as (select e, n, phi, lam - {geo.LNG0!r} as lam, sinh(atanh(sin(phi)) - {geo._K!r} * atanh({geo._K!r} * sin(phi))) as t from p where e between 400000 and 800000 and n between 450000 and 1000000 and degrees(phi) between 51 and 56 and degrees(lam) between -11 and -5),
    s as (select e, n, atan2(t, cos(lam)) as xi, atanh(sin(lam) / sqrt(1 + t * t)) as eta from q),
    b as (select e, n, {geo.FALSE_E!r} + {geo._RADIUS!r} * ({east}) as e2, {geo.FALSE_N!r} - {geo._NORTH0!r} + {geo._RADIUS!r} * ({north}) as n2 from s)"""


@query(
    "g2_g3_grid_round_trip_all",
    f"""with {APPLICATIONS}, {_round_trip_sql()}, k as (select count(*) as n, max(sqrt((e2 - e) ** 2 + (n2 - n) ** 2)) as worst from b)
    select k.n as n, (select count(*) from applications) - k.n as outside, round(worst, 2) as worst_metre from k""",
)
def whole_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trips of every grid position that both ways accept; the others are counted as outside."""
    rows = applications(spark, sf_dir).select(F.col("grid_easting").cast("double").alias("e"), F.col("grid_northing").cast("double").alias("n"))
    there = rows.select("e", "n", geo.from_grid(F.col("e"), F.col("n")).alias("p"))
    back = there.select("e", "n", geo.to_grid(F.col("p.lat"), F.col("p.lng")).alias("g"))
    away = F.hypot(F.col("g.easting") - F.col("e"), F.col("g.northing") - F.col("n"))
    return back.agg(F.count("g").alias("n"), F.count_if(F.col("g").isNull()).alias("outside"), F.round(F.max(away), 2).alias("worst_metre"))


@query(
    "j16_within_radius",
    f"""with {APPLICATIONS}, p as (select id, 51.5 + (id * 7919 % 40000) / 10000.0 as lat, -10.0 + (id * 104729 % 45000) / 10000.0 as lng from applications),
    j as (select a.id as origin, b.id as point, sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lng - a.lng) / 2) ** 2 as h
      from p a, p b where a.id % 50 = 0 and a.id <> b.id and abs(a.lat - b.lat) < 0.1)
    select origin, point, round(2 * 6371.0088 * atan2(sqrt(h), sqrt(1 - h)), 6) as distance_km from j where 2 * 6371.0088 * atan2(sqrt(h), sqrt(1 - h)) <= 5""",
)
def radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All positions within 5 km of the query positions, those whose id is divisible by 50."""
    rows = applications(spark, sf_dir).select("id", (F.lit(51.5) + (F.col("id") * 7919 % 40000) / 10000.0).alias("lat"), (F.lit(-10.0) + (F.col("id") * 104729 % 45000) / 10000.0).alias("lng"))
    return X.within_km(rows, rows.where("id % 50 = 0"), 5.0)


@query(
    "j15_longest_label",
    """with l as (select distinct p_name as label from part), p as (select p_partkey as id, p_name || ' in the yard' as location from part)
    select id, label from (select id, label, row_number() over (partition by id order by length(label) desc, label desc) as rn from p join l on contains(' ' || lower(location) || ' ', ' ' || lower(label) || ' ')) where rn = 1""",
)
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return X.longest_label(parts.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" in the yard")).alias("location")), parts.select(F.col("p_name").alias("label")))


@query(
    "f17_status_states",
    """with s as (select o_orderkey, case o_orderkey % 6 when 0 then 'Application_Closed' when 1 then ' AI  Received ' when 2 then 'PRE-VALIDATION' when 3 then 'n/a' when 4 then 'Appeal Lodged' else 'No such wording' end as raw from orders)
    select case trim(regexp_replace(lower(raw), '[\\s_-]+', ' ', 'g')) when 'application closed' then 'finalised' when 'ai received' then 'further_information_received' when 'pre validation' then 'pre_validation' when 'appeal lodged' then 'appealed' else 'unknown' end as state,
    case trim(regexp_replace(lower(raw), '[\\s_-]+', ' ', 'g')) when 'application closed' then 'Application finalised' when 'ai received' then 'Further information received' when 'pre validation' then 'Pre-validation' when 'appeal lodged' then 'Under appeal' else 'Status not classified' end as label,
    trim(regexp_replace(lower(raw), '[\\s_-]+', ' ', 'g')) = 'application closed' as terminal, count(*) as n from s group by all""",
)
def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw wordings to canonical states, labels and terminality."""
    k = F.col("o_orderkey") % 6
    raw = F.when(k == 0, "Application_Closed").when(k == 1, " AI  Received ").when(k == 2, "PRE-VALIDATION").when(k == 3, "n/a").when(k == 4, "Appeal Lodged").otherwise("No such wording")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(status.canonical(raw).alias("state"))
    return rows.groupBy("state", status.label(F.col("state")).alias("label"), status.is_terminal(F.col("state")).alias("terminal")).agg(F.count("*").alias("n"))


@query(
    "f19_f22_postcodes",
    r"""with s as (select o_orderkey as id, chr(65 + cast(o_orderkey % 26 as int)) || lpad(cast(o_orderkey % 100 as varchar), 2, '0') as k, 'x' || cast(1000 + o_orderkey % 9000 as varchar) as u from orders),
    t as (select id, 'Near ' || k || ' ' || substr(u, 2) || ', Town' as t, k || ' ' || substr(u, 2) as code, regexp_matches(k, '^[AC-FHKNPRTV-Y]') as ok from s)
    select id, case when ok then code end as found, case when ok then substr(code, 1, 3) end as routing from t""",
)
def postcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes in free text, made from order numbers."""
    key = F.concat(F.char(65 + F.col("o_orderkey") % 26), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"))
    place = F.concat(F.lit("Near "), F.lower(key), F.lit(" "), (1000 + F.col("o_orderkey") % 9000).cast("string"), F.lit(", Town"))
    found = postcode.first_valid(F.lit(None).cast("string"), place)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), found.alias("found"), postcode.routing_key(found).alias("routing"))


@query(
    "x1_intents",
    """with q as (select o_orderkey % 7 as k, o_orderkey as id from orders)
    select case k when 0 then 'reference' when 1 then 'invalid_postcode' when 2 then 'invalid_postcode' when 3 then 'address' when 4 then 'reference' when 5 then case when id >= 10000 then 'reference' else 'area' end else 'area' end as intent, count(*) as n from q group by 1""",
)
def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of seven forms made of every order's number; numbers alone are references from five digits on."""
    k, i = F.col("o_orderkey") % 7, F.col("o_orderkey").cast("string")
    asked = F.when(k == 0, F.concat(F.lit("24/"), i)).when(k == 1, "d6w ab12").when(k == 2, "B12 3456").when(k == 3, F.concat(i, F.lit(" Main Street"))).when(k == 4, F.concat(F.lit("24-A"), i)).when(k == 5, i).otherwise("Midleton")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(X.intent(asked).alias("intent")).groupBy("intent").agg(F.count("*").alias("n"))


@query("f37_text_search")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold all words of a benchmark item, stop words and endings aside; no twin, as it takes a stemmer."""
    return fulltext.text_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")
