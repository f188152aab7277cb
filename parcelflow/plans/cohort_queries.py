"""Queries of locality cohorts and pages: authorities stand for nations, customers' market segments for localities."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.functions import places, stats
from parcelflow.functions import text as T
from parcelflow.operators import cohorts as C
from parcelflow.operators import pages as G
from parcelflow.plans.mapping import SALES, sales
from parcelflow.plans.registry import query
from parcelflow.sources.shared import materialised
from parcelflow.sources.tables import table

AS_OF = date(2001, 8, 28)
CODES = sorted(places.PATHS)
COUNTY = places.COUNTIES | places.CAPITAL


def _values(name: str, columns: str, rows: list[tuple[str, ...]]) -> str:
    return f"{name}({columns}) as (values " + ", ".join("(" + ", ".join(f"'{v}'" for v in r) + ")" for r in rows) + ")"


AUTHORITIES = _values("authorities", "code, county, path", [(c, COUNTY[c], places.PATHS[c]) for c in CODES])
#: An order is an application of its nation's authority; urgent ones name no locality, low ones have a ward only.
LOCATED = f"""{AUTHORITIES}, code as (select code, county, path, row_number() over (order by code) - 1 as n from authorities), located as (
  select o_orderkey as id, cast(o_orderkey as varchar) as reference, code as authority, county, path, cast(o_orderdate as date) as registration_date, case when o_orderstatus = 'F' then cast(o_orderdate as date) + 60 end as decision_date,
    upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) as town, o_orderpriority as p from orders join customer on o_custkey = c_custkey join code on c_nationkey = n),
  towns as (select *, case when p like '1%' then 'Ireland' when p like '5%' then town || ' West' when code.capital then 'Co. Dublin' else town end as locality from located join (select code as authority, code in ({", ".join(f"'{c}'" for c in places.CAPITAL)}) as capital from authorities) code using (authority))"""


def _code(n: Column) -> Column:
    return F.get(F.array(*map(F.lit, CODES)), n.cast("int"))


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    code, town, p = _code(F.col("c_nationkey")), F.initcap("c_mktsegment"), F.col("o_orderpriority")
    county = places.authority_county(code)
    where = F.when(p.startswith("1"), F.concat(town, F.lit(", Ireland"))).when(p.startswith("5"), F.lit("12")).otherwise(F.concat(F.lit("4 Main Road, "), town, F.lit(", Co. "), county))
    ward = F.when(p.startswith("5"), F.concat(F.lit("The Municipal District of: "), town, F.lit(" West")))
    rows = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("reference"), code.alias("authority"), where.alias("location"), ward.alias("ward"), F.to_date("o_orderdate").alias("registration_date"), F.when(F.col("o_orderstatus") == "F", F.date_add(F.to_date("o_orderdate"), 60)).alias("decision_date"))
    return rows.withColumn("locality", places.locality(F.col("location"), F.col("ward"), F.col("authority")))


SLUG = lambda x: f"trim(regexp_replace(lower(trim({x})), '[^a-z0-9]+', '-', 'g'), '-')"
CANDIDATES = f"""{SALES}, {LOCATED}, s as (select county, area_slug, count(*) as n from sales group by all having count(*) >= 12 and max(date_of_sale) >= date '1998-08-28'),
  t as (select authority, path, locality, count(*) as n, max(registration_date) as last from towns group by all having count(*) >= 8 and max(registration_date) >= date '1998-08-28'),
  c as (select 'sold_prices' as surface, '/sold-prices/' || {SLUG("county")} || '/' || area_slug as path, list_aggregate(list_transform(string_split(area_slug, '-'), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') as label, ln(n) * 20 + 30 as score from s
    where length(area_slug) >= 3 and area_slug <> {SLUG("county")} union all
    select 'planning', '/planning/' || path || '/areas/' || {SLUG("locality")}, locality, ln(n) * 20 + case when last >= date '1999-08-28' then 30 else 0 end from t),
  candidates as (select surface, path, label, round(score, 6) as score from c where not regexp_matches(label, '[0-9]') and not regexp_matches(lower(label), '^co\\.?\\s+') and lower(label) not in (select lower(county) from authorities union all select unnest(['county cork', 'county dublin', 'ireland'])))"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.locality_candidates(sales(spark, sf_dir), located(spark, sf_dir), AS_OF).withColumn("score", F.round("score", 6))


@query("c19_locality_candidates", f"with {CANDIDATES} select * from candidates")
def locality_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of both surfaces (C19, P16, U2, D16); counties and what is broader are excluded."""
    return _candidates(spark, sf_dir)


#: Of the candidates, and of pages that are none any more, every second is a member; how long follows from the path.
MEMBERS = """members as (select surface, path, date '2001-08-28' - cast(length(path) * 7 % 90 as int) as entered, case when length(path) % 5 = 0 then date '2001-08-01' end as left_at, round(score / 2, 6) as score from candidates where length(path) % 2 = 0
  union all select 'planning', '/planning/gone/areas/' || lower(c_mktsegment), date '2001-01-01', null, null from (select distinct c_mktsegment from customer))"""
REFRESHED = f"""{CANDIDATES}, {MEMBERS}, m as (select *, left_at is null as active, left_at is null and entered <= date '2001-08-28' - 42 as old from members),
  f as (select surface from m where active group by 1 having count(*) >= 40 and not bool_or(old)),
  l as (select surface, path from (select *, row_number() over (partition by surface order by score nulls last, path) as rn from m where active and old and surface not in (select surface from f)) where rn <= 6),
  x as (select c.surface, c.path, c.score, a.path is null as fresh from candidates c left join (select * from m where active) a using (surface, path) where c.surface not in (select surface from f) and not coalesce(a.old, false)),
  e as (select * from (select *, row_number() over (partition by surface order by score desc, path) as rn from x) where rn <= 40 and fresh)
  select m.surface, m.path, entered, case when active and l.path is not null then date '2001-08-28' else left_at end as left, case when active and l.path is null and m.surface not in (select surface from f) then coalesce(c.score, m.score) else m.score end as score
    from m left join l using (surface, path) left join candidates c using (surface, path) union all select surface, path, date '2001-08-28', null, score from e"""


@query("w8_residence_cohort", f"with {REFRESHED}")
def refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both surfaces' memberships after a refresh of 40 places and six that may leave."""
    found = materialised(_candidates(spark, sf_dir))  # members and every step of the refresh are made of them
    size = F.length("path")
    members = found.where(size % 2 == 0).select("surface", "path", F.date_sub(F.lit(AS_OF), (size * 7 % 90).cast("int")).alias("entered"), F.when(size % 5 == 0, F.lit(date(2001, 8, 1))).alias("left"), stats.round_half_up(F.col("score") / 2, 6).alias("score"))
    gone = table(spark, sf_dir, "customer").select(F.lit("planning").alias("surface"), F.concat(F.lit("/planning/gone/areas/"), F.lower("c_mktsegment")).alias("path")).distinct()
    members = members.unionByName(gone.withColumns({"entered": F.lit(date(2001, 1, 1)), "left": F.lit(None).cast("date"), "score": F.lit(None).cast("double")}))
    return C.refreshed(members, found, AS_OF, size=40, rotation=6)


@query("j17_authority_counties", f"with {LOCATED} select authority, county, path, count(*) as n from located group by all")
def authority_counties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """County and path of every application's authority, the capital's among them."""
    code = F.col("authority")
    return located(spark, sf_dir).groupBy("authority", places.authority_county(code).alias("county"), places.authority_slug(code).alias("path")).agg(F.count("*").alias("n"))


@query("j17_county_authorities", f"with {LOCATED} select id, (select string_agg(code, ',' order by code) from authorities a where a.county = located.county) as codes from located")
def county_authorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All authorities of the county that each application is in."""
    county = F.upper(places.authority_county(F.col("authority")))
    return located(spark, sf_dir).select("id", F.array_join(places.county_authorities(county), ",").alias("codes"))


@query(
    "j20_resolved_paths",
    f"""with {LOCATED}, e as (select user_id, count(*) as views from events group by 1), u as (select e.*, c.path, c.code from e join code c on c.n = user_id % 25),
    v as (select *, case user_id % 4 when 0 then null when 1 then cast(user_id as varchar) when 2 then cast(user_id as varchar) else cast(-user_id as varchar) end as ref, case user_id % 4 when 2 then (select x.authority from located x where x.id = user_id) else code end as own from u)
    select case when l.id is null then 'FAIL' else 'FOUND' end as class, v.user_id, views, l.id from v left join located l on v.user_id % 4 > 0 and l.authority = own and l.reference = ref""",
)
def resolved_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path for every user: plain references, encoded ones of any and of the right authority, and unknown ones."""
    user, rows = F.col("user_id"), located(spark, sf_dir)
    seen = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("views"))
    seen = seen.join(rows.select(F.col("id").alias("user_id"), F.col("authority").alias("right")), "user_id", "left")
    code = F.when(user % 4 == 2, F.col("right")).otherwise(_code(user % 25))
    told = F.when(user % 4 == 0, user.cast("string")).otherwise(T.reference_slug(F.when(user % 4 == 3, -user).otherwise(user).cast("string")))
    paths = seen.select("user_id", F.concat(F.lit("https://example.org/planning/"), F.coalesce(places.authority_slug(code), F.lit("none")), F.lit("/"), told, F.lit("/?from=%2Fsearch#top")).alias("path"), "views")
    found = G.resolved_paths(paths, rows)
    return found.join(paths.select("path", "user_id"), "path").select("class", "user_id", "views", "id")


@query(
    "x17_locality_pages",
    f"""with {LOCATED}, c as (select authority, locality, count(*) as n from towns group by all having count(*) >= 8),
    d as (select authority, locality, id, decision_date, row_number() over (partition by authority, locality order by decision_date desc, reference desc) as place from towns where decision_date is not null)
    select authority, locality, n, place, id, decision_date from c left join d using (authority, locality) where place is null or place <= 5""",
)
def locality_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of every authority and derived locality, one row for each decision shown."""
    found = G.locality_pages(located(spark, sf_dir))
    return found.select("authority", "locality", "n", F.explode_outer("recent").alias("r")).select("authority", "locality", "n", "r.place", "r.id", "r.decision_date")
