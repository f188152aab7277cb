"""Queries over sales."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.functions import stats, text
from parcelflow.operators import sales as S
from parcelflow.plans.mapping import SALES, SALES_AS_OF, sales
from parcelflow.plans.registry import query

DAY = f"date '{SALES_AS_OF}'"


def _window(months: int, back: int = 0) -> str:
    end = f"({DAY} - interval {back} month)"
    return f"date_of_sale between cast({end} - interval {months} month as date) + 1 and cast({end} as date)"


NOW, BEFORE, THIRD = _window(12), _window(12, 12), _window(12, 36)


def _change(now: str, before: str) -> str:
    return f"case when {now} <> 0 and {before} > 0 then ({now} - {before}) / cast({before} as double) * 100 end"


@query(
    "a1_area_lifetime_stats",
    f"""with {SALES} select county, area_slug, min(date_of_sale) as first_sale_date, max(date_of_sale) as last_sale_date, count(*) as sales_count,
    median(price_eur) as median_price, round(avg(price_eur) + 1e-7, 2) as avg_price, min(price_eur) as min_price, max(price_eur) as max_price
    from sales where county is not null and area_slug is not null group by 1, 2""",
)
def area_lifetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.area_lifetime_stats(sales(spark, sf_dir))


@query(
    "a2_area_monthly_stats",
    f"""with {SALES} select county, area_slug, strftime(date_of_sale, '%Y-%m') as year_month, count(*) as sales_count,
    median(price_eur) as median_price, round(avg(price_eur) + 1e-7, 2) as avg_price from sales group by all""",
)
def area_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.area_monthly_stats(sales(spark, sf_dir))


@query(
    "a3_price_percentiles",
    f"""with {SALES} select county, round(quantile_cont(price_eur, 0.25), 4) as p25, round(median(price_eur), 4) as p50, round(quantile_cont(price_eur, 0.75), 4) as p75,
    round(quantile_cont(price_eur, 0.9), 4) as p90 from sales group by county""",
)
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = {f"p{round(100 * p)}": ("n", p) for p in (0.25, 0.5, 0.75, 0.9)}
    counts = sales(spark, sf_dir).groupBy("county", "price_eur").agg(F.count("*").alias("n"))
    found = S.exact_percentiles(counts, ["county"], "price_eur", shares)
    return found.select("county", *(F.round(c, 4).alias(c) for c in shares))


def _insights_sql(keys: str, source: str = "sales", extra: str = "") -> str:
    both, split = "sales_12m >= 24 and previous_12m >= 24", "new_count >= 8 and old_count >= 8"
    gap = "date_diff('day', first_now, last_now) / nullif(sales_12m - 1, 0)"
    return f"""raw as (select {keys}, count(*) filter ({NOW}) as sales_12m, count(*) filter ({BEFORE}) as previous_12m, count(*) filter ({THIRD}) as third_12m,
      median(price_eur) filter ({NOW}) as median_now, median(price_eur) filter ({BEFORE}) as median_before, median(price_eur) filter ({THIRD}) as median_third,
      avg(price_eur) filter ({NOW}) as mean_now, min(date_of_sale) filter ({NOW}) as first_now, max(date_of_sale) filter ({NOW}) as last_now,
      quantile_cont(price_eur, 0.25) filter ({NOW}) as q1, quantile_cont(price_eur, 0.75) filter ({NOW}) as q3,
      count(*) filter ({NOW} and is_new_dwelling) as new_count, count(*) filter ({NOW} and not is_new_dwelling) as old_count,
      median(price_eur) filter ({NOW} and is_new_dwelling) as new_raw, median(price_eur) filter ({NOW} and not is_new_dwelling) as old_raw
      from {source} where date_of_sale <= {DAY} group by {keys}),
    insights as (select {keys}, sales_12m, previous_12m, median_now as median_price, round(mean_now + 1e-7, 2) as avg_price,
      case when {both} then round({_change('median_now', 'median_before')}, 4) end as yoy_percent,
      case when {both} and third_12m >= 24 then round({_change('median_now', 'median_third')}, 4) end as three_year_percent,
      case when {both} then round({_change('sales_12m', 'previous_12m')}, 4) end as activity_percent, ({both}) as activity_reliable,
      case when sales_12m >= 6 and {gap} > 0 then greatest(floor({gap} + 0.5), 1.0) end as days_between_sales,
      case when sales_12m >= 12 then q1 end as price_p25, case when sales_12m >= 12 then q3 end as price_p75,
      case when {split} then new_raw end as new_median, case when {split} then old_raw end as second_hand_median,
      case when {split} then new_raw - old_raw end as new_premium, case when {split} then round({_change('new_raw', 'old_raw')}, 4) end as new_premium_percent
      from raw){extra}"""


@query("a15_county_insights", f"with {SALES}, {_insights_sql('county')} select * from insights")
def county_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Momentum, activity, gaps, spread and build split by county."""
    return S.insights(sales(spark, sf_dir), ["county"], SALES_AS_OF)


@query("a15_area_insights", f"with {SALES}, {_insights_sql('county, area_slug')} select * from insights")
def area_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.insights(sales(spark, sf_dir), ["county", "area_slug"], SALES_AS_OF)


@query("a8_momentum", f"with {SALES}, {_insights_sql('eircode_prefix')} select eircode_prefix, sales_12m, previous_12m, median_price, yoy_percent, three_year_percent from insights")
def momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.insights(sales(spark, sf_dir), ["eircode_prefix"], SALES_AS_OF).select("eircode_prefix", "sales_12m", "previous_12m", "median_price", "yoy_percent", "three_year_percent")


@query(
    "a11_peak_month",
    f"""with {SALES}, m as (select county, area_slug, year(date_of_sale) as year, month(date_of_sale) as month, count(*) as n from sales group by all),
    r as (select *, rank() over (partition by county, area_slug, year order by n desc) as place from m),
    v as (select county, area_slug, month, count(*) filter (place = 1) as votes from r group by all),
    e as (select county, area_slug, count(distinct year) as years, sum(n)::bigint as sales_count from m group by all),
    b as (select *, row_number() over (partition by county, area_slug order by votes desc, month) as rn from v)
    select county, area_slug, month::int as peak_month, votes, years, sales_count from b join e using (county, area_slug) where rn = 1 and years >= 4 and sales_count >= 24""",
)
def peak_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.peak_month(sales(spark, sf_dir), ["county", "area_slug"])


@query(
    "a13_threshold_shares",
    f"""with {SALES}, w as (select county, count(*) as sales_count, avg((price_eur > 40000)::int) * 100 as a, avg((price_eur > 50000)::int) * 100 as b, avg((price_eur > 60000)::int) * 100 as c
      from sales where {NOW} group by county having count(*) >= 18),
    l as (select county, 40000::bigint as threshold, sales_count, floor(a + 0.5) as share from w union all select county, 50000, sales_count, floor(b + 0.5) from w union all select county, 60000, sales_count, floor(c + 0.5) from w)
    select * from l where share between 10 and 90""",
)
def thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds that suit the test prices."""
    return S.threshold_shares(sales(spark, sf_dir), ["county"], SALES_AS_OF, thresholds=(40_000, 50_000, 60_000))


def _range_sql(key: str, months: int | None) -> str:
    now, before = (_window(months), _window(months, months)) if months else (f"date_of_sale <= {DAY}", "false")
    gate = "sales_count >= 24 and previous_count >= 24"
    return f"""select '{key}' as range_key, sales_count, previous_count, median_price, round(mean + 1e-7, 2) as avg_price,
      case when {gate} then round({_change('median_price', 'previous_median')}, 4) end as median_change, case when {gate} then round({_change('sales_count', 'previous_count')}, 4) end as count_change
      from (select count(*) filter ({now}) as sales_count, count(*) filter ({before}) as previous_count, median(price_eur) filter ({now}) as median_price,
        median(price_eur) filter ({before}) as previous_median, avg(price_eur) filter ({now}) as mean from sales)"""


@query("a18_national_snapshots", f"with {SALES} " + " union all ".join(_range_sql(k, m) for k, m in (("last-year", 12), ("3-years", 36), ("5-years", 60), ("all-time", None))))
def national(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.national_snapshots(sales(spark, sf_dir), SALES_AS_OF)


@query(
    "a19_a20_leaders",
    f"""with {SALES}, {_insights_sql('county')}, s as (select county, yoy_percent from insights where yoy_percent is not null order by yoy_percent desc, county limit 1),
    l as (select county, sales_12m from insights order by sales_12m desc, county limit 1)
    select s.county as strongest_county, s.yoy_percent as strongest_yoy, l.county as leader_county, l.sales_12m as leader_sales from s, l""",
)
def leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.strongest_county(sales(spark, sf_dir), SALES_AS_OF)


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The market dimension: a row for each county, prefix, and area of a county; its size follows the dimensions."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("county"))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    none = F.lit(None).cast("string")
    county = nations.select(text.slug(F.col("county")).alias("slug"), F.col("county").alias("label"), F.lit("county").alias("kind"), "county", none.alias("prefix"), none.alias("area_slug"))
    brands = parts.select(F.col("p_brand").alias("prefix")).distinct()
    district = brands.select(text.slug(F.col("prefix")).alias("slug"), F.col("prefix").alias("label"), F.lit("district").alias("kind"), none.alias("county"), "prefix", none.alias("area_slug"))
    areas = parts.select(text.slug(F.col("p_type")).alias("area_slug")).distinct().crossJoin(nations)  # two dimensions
    name = F.concat_ws(" ", "county", "area_slug")
    area = areas.select(text.slug(name).alias("slug"), name.alias("label"), F.lit("area").alias("kind"), "county", none.alias("prefix"), "area_slug")
    return county.unionByName(district).unionByName(area)


def _slug(expression: str) -> str:
    return f"trim(regexp_replace(lower({expression}), '[^a-z0-9]+', '-', 'g'), '-')"


MATCHED = f"""matched as (
  select {_slug('county')} as slug, county as label, 'county' as kind, date_of_sale, price_eur, is_new_dwelling from sales
  union all select {_slug('eircode_prefix')}, eircode_prefix, 'district', date_of_sale, price_eur, is_new_dwelling from sales
  union all select {_slug("county || ' ' || area_slug")}, county || ' ' || area_slug, 'area', date_of_sale, price_eur, is_new_dwelling from sales)"""
COMPARISON = f"""{SALES}, {MATCHED}, {_insights_sql('slug, label, kind', 'matched')}, nat as (select median(price_eur) as national_median from sales where {NOW}),
  comparison as (select slug, label, kind, sales_12m, previous_12m, median_price, yoy_percent, activity_percent, round({_change('median_price', 'national_median')}, 4) as national_percent,
    abs(median_price - national_median) as national_distance from insights, nat where sales_12m >= 24)"""


@query("a16_comparison_rows", f"with {COMPARISON} select * from comparison")
def comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales under every market they match (J1), gated and compared."""
    return S.comparison_rows(sales(spark, sf_dir), markets(spark, sf_dir), SALES_AS_OF)


@query(
    "j1_market_match_counts",
    f"with {SALES}, {MATCHED} select kind, slug, count(*) as sales_count, round(avg(price_eur) + 1e-7, 2) as avg_price from matched group by all",
)
def match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = S.match_markets(sales(spark, sf_dir), markets(spark, sf_dir))
    return matched.groupBy("kind", "slug").agg(F.count("*").alias("sales_count"), stats.mean_money(F.col("price_eur")).alias("avg_price"))


def _group_sql(key: str) -> str:
    member, order, cap = S.GROUPS[key]
    by = ", ".join(f"{c} {'asc' if up else 'desc'} nulls last" for c, up in order)
    return f"select * from (select '{key}' as group_key, row_number() over (order by {by}, slug) as rank, slug, median_price, sales_12m from comparison where {member})" + (f" where rank <= {cap}" if cap else "")


@query("o8_ranked_groups", f"with {COMPARISON} " + " union all ".join(map(_group_sql, S.GROUPS)))
def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked market groups."""
    return S.ranked_groups(S.comparison_rows(sales(spark, sf_dir), markets(spark, sf_dir), SALES_AS_OF))


@query(
    "a17_county_of_area",
    f"""with {SALES}, c as (select area_slug, county, count(*) as n from sales where county is not null group by all), r as (select *, rank() over (partition by area_slug order by n desc) as place from c)
    select area_slug, case when count(*) = 1 then min(county) end as mode, max(n) as n from r where place = 1 group by area_slug""",
)
def inferred_county(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.mode_or_none(sales(spark, sf_dir), ["area_slug"], "county")


@query(
    "a40_dominant_area",
    f"""with {SALES}, c as (select eircode_prefix, lower(trim(area_slug)) as norm, count(*) as n, min(area_slug) as spelling from sales group by all),
    r as (select *, sum(n) over (partition by eircode_prefix) as total, row_number() over (partition by eircode_prefix order by n desc, norm) as place from c)
    select eircode_prefix, spelling as dominant, n, total::bigint as total from r where place = 1 and n >= total * 0.2""",
)
def dominant_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.dominant_share(sales(spark, sf_dir), ["eircode_prefix"], "area_slug", 0.2)


@query(
    "o1_o2_search_page",
    f"""with {SALES} select * from sales where price_eur >= 20000 and price_eur <= 90000 and date_of_sale >= date '1999-08-28' and (contains(lower(locality), 'red') or contains(lower(address), 'red'))
    order by price_eur desc, date_of_sale, price_eur, county, area_slug, eircode_prefix, locality, address limit 25 offset 25""",
)
def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a filtered search."""
    from datetime import date

    return S.page(sales(spark, sf_dir), "price-high", 2, low=20_000, high=90_000, since=date(1999, 8, 28), terms=("red",))


@query(
    "o9_extremes",
    f"""with {COMPARISON}, m as (select * from comparison where kind = 'area')
    select 'highest' as pick, slug from (select * from m order by median_price desc, sales_12m desc, label limit 1) union all select 'lowest', slug from (select * from m order by median_price, sales_12m desc, label limit 1)
    union all select 'busiest', slug from (select * from m order by sales_12m desc, median_price desc, label limit 1) union all select 'closest', slug from (select * from m order by national_distance, label limit 1)""",
)
def extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.extremes(S.comparison_rows(sales(spark, sf_dir), markets(spark, sf_dir), SALES_AS_OF).where("kind = 'area'"))


@query(
    "x2_area_suggestions",
    f"""with {SALES}, a as (select county, area_slug, count(*) as n, max(date_of_sale) as last_sale from sales group by all)
    select county, area_slug, n, last_sale, starts_with(area_slug, 's') as starts from a where contains(area_slug, 's') order by starts desc, n desc, area_slug, county limit 25""",
)
def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas that begin with or hold a text, by volume; a top 25 by design."""
    areas = sales(spark, sf_dir).groupBy("county", "area_slug").agg(F.count("*").alias("n"), F.max("date_of_sale").alias("last_sale"))
    found = areas.where(F.col("area_slug").contains("s")).withColumn("starts", F.col("area_slug").startswith("s"))
    return found.orderBy(F.desc("starts"), F.desc("n"), "area_slug", "county").limit(25)


@query(
    "x15_dataset_summary",
    f"""with {SALES} select count(*) as sales_count, min(date_of_sale) as first_sale, max(date_of_sale) as last_sale, count(distinct county) as counties,
    max(price_eur) filter (date_of_sale = (select max(date_of_sale) from sales)) as last_day_top_price from sales""",
)
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales(spark, sf_dir).agg(F.count("*").alias("sales_count"), F.min("date_of_sale").alias("first_sale"), F.max("date_of_sale").alias("last_sale"), F.count_distinct("county").alias("counties"), F.max(F.struct("date_of_sale", "price_eur")).getField("price_eur").alias("last_day_top_price"))


@query(
    "a46_treemap_shares",
    f"""with {SALES}, c as (select county, count(*) as n from sales where {NOW} group by 1), t as (select * from c order by n desc, county limit 8)
    select county, n, round(n / sum(n) over () * 100, 4) as share, round(sum(n) over (order by n desc, county) / sum(n) over () * 100, 4) as up_to from t""",
)
def treemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the eight largest counties, and their running sum that the tiles are laid out by."""
    from pyspark.sql import Window

    top = sales(spark, sf_dir).where(S._within(S.dates.rolling(SALES_AS_OF, 12))).groupBy("county").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "county").limit(8)
    everything = Window.partitionBy()  # eight rows
    running = everything.orderBy(F.desc("n"), "county").rowsBetween(Window.unboundedPreceding, 0)
    return top.select("county", "n", F.round(F.col("n") / F.sum("n").over(everything) * 100, 4).alias("share"), F.round(F.sum("n").over(running) / F.sum("n").over(everything) * 100, 4).alias("up_to"))
