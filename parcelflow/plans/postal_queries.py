"""Queries of postcodes: routing areas, what is known of a code, and the market around it.

Customers are households: a nation is a county, with its own routing key, a town and an upper town. Some
households have the key of the next nation, most of every sixth nation's do. Orders are sales and, with
other fields, applications.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.functions import geo
from parcelflow.operators import markets as M
from parcelflow.plans.registry import query
from parcelflow.sources.shared import materialised, written
from parcelflow.sources.tables import table

HOMES = """homes as (select *, 'A' || key || ' ' || lpad(cast(k % 10000 as varchar), 4, '0') as eircode, 'A' || key as eircode_prefix, replace(lower(label), ' ', '-') as area_slug from (
  select c_custkey as k, n_nationkey as n, n_name as county, 10 + case when c_custkey % 10 < case when n_nationkey % 6 = 5 then 8 else 1 end then (n_nationkey + 1) % 25 else n_nationkey end as key,
    case when c_custkey % 10 >= case when n_nationkey % 4 = 3 then 6 else 8 end then 'Upper Town ' else 'Town ' end || n_nationkey as label
  from customer join nation on c_nationkey = n_nationkey))"""
SOLD = """sold as (select o_orderkey as id, case when k % 9 <> 4 then eircode end as eircode, eircode_prefix, case o_orderkey % 7 when 5 then ' ' else county end as county,
    case o_orderkey % 7 when 6 then 'Old Quarter' when 4 then null else label end as locality, area_slug, cast(o_orderdate as date) as date_of_sale, o_totalprice as price_eur,
    case when o_orderkey % 3 > 0 then 50.5 + (k % 600) / 100.0::double end as lat, -11.5 + (k % 700) / 100.0::double as lng from orders join homes on o_custkey = k)"""
FILED = """filed as (select o.o_orderkey as id, cast(o.o_orderkey as varchar) as reference, case o.o_orderkey % 4 when 1 then h.eircode end as eircode, case when o.o_orderkey % 4 in (1, 2) and h.n % 7 > 0 then h.eircode_prefix end as eircode_prefix,
    case o.o_orderkey % 11 when 0 then x.n_name else h.county end as county, (o.o_orderkey % 100) || ' Main Road, ' || h.label || case o.o_orderkey % 13 when 0 then ', Old Quarter' else '' end || ', Co. ' || h.county as location,
    cast(o.o_orderdate as date) as registration_date, 400000 + (o.o_orderkey * 7919) % 450000 as grid_easting, 450000 + (o.o_orderkey * 104729) % 550000 as grid_northing
  from orders o join homes h on o.o_custkey = h.k join nation x on x.n_nationkey = (h.n + 1) % 25)"""
CODES = "codes as (select distinct eircode from homes union select 'A' || (10 + n_nationkey) || ' ZZZZ' from nation union select 'B00 ZZZZ')"
CURATED = """curated as (select distinct 'A' || (10 + n_nationkey) as eircode_prefix, x.county, x.label as locality, x.label, replace(lower(x.label), ' ', '-') as area_slug from nation join
  (select n_nationkey as n, n_name as county, unnest(['Town ' || n_nationkey, 'Upper Town ' || n_nationkey]) as label, unnest([1, 2]) as which from nation) x
  on case n_nationkey % 5 when 0 then x.n = n_nationkey and which = 1 when 1 then x.n = n_nationkey when 2 then x.n in (n_nationkey, (n_nationkey + 1) % 25) and which = 1 else false end)"""
DATA = f"{HOMES}, {SOLD}, {FILED}, {CODES}, {CURATED}"


def homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("n_nationkey")
    moved = k % 10 < F.when(n % 6 == 5, 8).otherwise(1)
    prefix = F.concat(F.lit("A"), (F.when(moved, (n + 1) % 25).otherwise(n) + 10).cast("int").cast("string"))
    label = F.concat(F.when(k % 10 >= F.when(n % 4 == 3, 6).otherwise(8), "Upper Town ").otherwise("Town "), n.cast("string"))
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == n)
    rows = rows.select(k.alias("k"), n.alias("n"), F.col("n_name").alias("county"), prefix.alias("eircode_prefix"), label.alias("label"))
    return rows.withColumns({"eircode": F.concat("eircode_prefix", F.lit(" "), F.lpad((F.col("k") % 10000).cast("string"), 4, "0")), "area_slug": F.replace(F.lower("label"), F.lit(" "), F.lit("-"))})


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with its household: what sales and applications are made of."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("price_eur"))
    return rows.join(homes(spark, sf_dir), F.col("o_custkey") == F.col("k")).drop("o_custkey")


def _sold(rows: DataFrame) -> DataFrame:
    turn, k = F.col("id") % 7, F.col("k")
    return rows.select(
        "id", F.when(k % 9 != 4, F.col("eircode")).alias("eircode"), "eircode_prefix", F.when(turn == 5, " ").otherwise(F.col("county")).alias("county"),
        F.when(turn == 6, "Old Quarter").when(turn != 4, F.col("label")).alias("locality"), "area_slug", F.col("day").alias("date_of_sale"), "price_eur",
        F.when(F.col("id") % 3 > 0, F.lit(50.5) + (k % 600) / 100).alias("lat"), (F.lit(-11.5) + (k % 700) / 100).alias("lng"),
    )


def _filed(rows: DataFrame, nations: DataFrame) -> DataFrame:
    i, n = F.col("id"), F.col("n")
    nxt = nations.select(F.col("n_nationkey").alias("m"), F.col("n_name").alias("next_county"))
    rows = rows.join(nxt, (n + 1) % 25 == F.col("m"))
    where = F.concat((i % 100).cast("string"), F.lit(" Main Road, "), "label", F.when(i % 13 == 0, ", Old Quarter").otherwise(""), F.lit(", Co. "), "county")
    return rows.select(
        "id", i.cast("string").alias("reference"), F.when(i % 4 == 1, F.col("eircode")).alias("eircode"), F.when((i % 4).isin(1, 2) & (n % 7 > 0), F.col("eircode_prefix")).alias("eircode_prefix"),
        F.when(i % 11 == 0, F.col("next_county")).otherwise(F.col("county")).alias("county"), where.alias("location"), F.col("day").alias("registration_date"),
        (400_000 + (i * 7919) % 450_000).alias("grid_easting"), (450_000 + (i * 104_729) % 550_000).alias("grid_northing"),
    )


def sold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sold(_orders(spark, sf_dir))


def filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filed(_orders(spark, sf_dir), table(spark, sf_dir, "nation"))


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "nation").select(F.concat(F.lit("A"), (F.col("n_nationkey") + 10).cast("string"), F.lit(" ZZZZ")).alias("eircode"))
    return homes(spark, sf_dir).select("eircode").union(keys).union(spark.createDataFrame([("b00 zzzz",)], "eircode string"))


def curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated markets: one town, two towns of one county, towns of two counties, or none, by nation."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    n = F.col("n_nationkey")
    towns = nations.select(n.alias("n"), F.col("n_name").alias("county"), F.posexplode(F.array(F.lit("Town "), F.lit("Upper Town "))).alias("which", "kind"))
    near = F.when(n % 5 == 0, (F.col("n") == n) & (F.col("which") == 0)).when(n % 5 == 1, F.col("n") == n).when(n % 5 == 2, ((F.col("n") == n) | (F.col("n") == (n + 1) % 25)) & (F.col("which") == 0)).otherwise(False)
    label = F.concat("kind", F.col("n").cast("string"))
    rows = nations.select("n_nationkey").join(F.broadcast(towns), near)  # 25 nations
    return rows.select(F.concat(F.lit("a"), (n + 10).cast("string"), F.lit(" ")).alias("eircode_prefix"), "county", label.alias("label"), F.replace(F.lower(label), F.lit(" "), F.lit("-")).alias("area_slug"), F.lit(None).cast("string").alias("locality"))


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return homes(spark, sf_dir).select("county", "label", "area_slug").distinct()


def _routing(spark: SparkSession, sf_dir: str, sales: DataFrame) -> DataFrame:
    return M.routing_areas(sales, M.routing_markets(curated(spark, sf_dir)))


def _records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sales, applications and areas; many steps read them, so orders meet their households once for all."""
    rows = written(_orders(spark, sf_dir))
    return _sold(rows), _filed(rows, table(spark, sf_dir, "nation")), materialised(areas(spark, sf_dir))


def _context(spark: SparkSession, sf_dir: str, sales: DataFrame, applications: DataFrame, named: DataFrame) -> DataFrame:
    return M.postcode_context(codes(spark, sf_dir), sales, applications, _routing(spark, sf_dir, sales), named)


def _dominant_sql(name: str, rows: str, value: str, share: float) -> str:
    return f"""{name} as (select eircode_prefix, v as top_{value} from (select eircode_prefix, min({value}) as v, sum(n) as c, sum(sum(n)) over (partition by eircode_prefix) as total,
      row_number() over (partition by eircode_prefix order by sum(n) desc, lower(trim({value}))) as rn from {rows} where {value} is not null group by eircode_prefix, lower(trim({value}))) where rn = 1 and c >= total * {share})"""


ROUTING = f"""cnt as (select eircode_prefix, nullif(trim(county), '') as county, nullif(trim(locality), '') as locality, nullif(trim(area_slug), '') as area_slug, count(*) as n from sold where eircode_prefix is not null group by all),
  tot as (select eircode_prefix, sum(n) as total, coalesce(sum(n) filter (county is not null), 0) as placed from cnt group by 1 having sum(n) >= 5 and coalesce(sum(n) filter (county is not null), 0) > 0),
  cur as (select eircode_prefix, count(*) as m, count(distinct county) as counties, min(county) as county, min(locality) as locality, min(area_slug) as area_slug, string_agg(label, '|' order by label) as markets, list(county) as named from curated group by 1),
  agr as (select c.eircode_prefix, sum(c.n) as agreed from cnt c join cur u on c.eircode_prefix = u.eircode_prefix and list_contains(u.named, c.county) group by 1),
  {_dominant_sql("dc", "cnt", "county", 0.6)}, wi as (select cnt.* from cnt join dc using (eircode_prefix) where county = top_county),
  {_dominant_sql("da", "wi", "area_slug", 0.7)}, wa as (select wi.* from wi join da using (eircode_prefix) where area_slug = top_area_slug),
  {_dominant_sql("dl", "wa", "locality", 0.5)},
  rj as (select *, coalesce(agreed >= 5 and 1 - agreed / placed <= 0.2, false) as holds from tot left join agr using (eircode_prefix) left join cur using (eircode_prefix) left join dc using (eircode_prefix) left join da using (eircode_prefix) left join dl using (eircode_prefix)),
  routing as (select eircode_prefix, case when holds then case when counties = 1 then county end else top_county end as county, case when holds then case when m = 1 then locality end else top_locality end as locality,
    case when holds then case when m = 1 then area_slug end else top_area_slug end as area_slug, case when holds then markets else coalesce(case when top_area_slug is not null then coalesce(top_locality, top_area_slug) end, '') end as markets
    from rj where holds or top_county is not null)"""


@query("j18_routing_markets", f"with {CURATED} select eircode_prefix, string_agg(county || '/' || area_slug || '/' || locality || '/' || label, '|' order by label) as markets from curated group by 1")
def routing_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.routing_markets(curated(spark, sf_dir))
    return found.select("eircode_prefix", F.array_join(F.transform("markets", lambda m: F.concat_ws("/", m["county"], m["area_slug"], m["locality"], m["label"])), "|").alias("markets"))


@query("x9_routing_areas", f"with {HOMES}, {SOLD}, {CURATED}, {ROUTING} select * from routing")
def routing_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every routing key at the production gates, with the labels of its markets."""
    return _routing(spark, sf_dir, sold(spark, sf_dir)).withColumn("markets", F.array_join(F.transform("markets", lambda m: m["label"]), "|"))


#: Positions of applications by the inverse series, as the library states it.
_ADD = lambda first, terms: " ".join([first, *terms])
POSITIONS = f"""gr as (select *, (grid_northing - {geo.FALSE_N!r} + {geo._NORTH0!r}) / {geo._RADIUS!r} as xi, (grid_easting - {geo.FALSE_E!r}) / {geo._RADIUS!r} as eta from filed),
  gx as (select *, {_ADD("xi", [f"- ({c!r}) * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate(geo._BACK, 1)])} as gx, {_ADD("eta", [f"- ({c!r}) * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate(geo._BACK, 1)])} as gy from gr),
  gc as (select *, asin(sin(gx) / cosh(gy)) as chi from gx),
  placed as (select id, reference, eircode, eircode_prefix, county, location, registration_date, case when grid_easting between 400000 and 800000 and grid_northing between 450000 and 1000000 then degrees({_ADD("chi", [f"+ ({c!r}) * sin({2 * j} * chi)" for j, c in enumerate(geo._LATITUDE, 1)])}) end as plat,
    case when grid_easting between 400000 and 800000 and grid_northing between 450000 and 1000000 then degrees({geo.LNG0!r} + atan2(sinh(gy), cos(gx))) end as plng from gc)"""
#: Areas whose label an application's location holds as whole words, the longest first.
MATCHES = """areas as (select distinct county, label, area_slug from homes),
  named as (select f.id, a.label, a.area_slug, row_number() over (partition by f.id order by length(a.label) desc, a.area_slug) as rn from filed f join areas a on a.county = f.county and regexp_matches(lower(f.location), '(^|[^a-z0-9])' || lower(a.label) || '([^a-z0-9]|$)'))"""
CONTEXT = f"""{ROUTING}, {POSITIONS}, {MATCHES},
  ss as (select eircode, nullif(trim(county), '') as county, locality, area_slug, lat, lng, date_of_sale, id from sold where eircode is not null),
  s1 as (select * from (select *, row_number() over (partition by eircode order by date_of_sale desc, id desc) as rn from ss) where rn = 1),
  s2 as (select eircode, lat, lng from (select *, row_number() over (partition by eircode order by date_of_sale desc, id desc) as rn from ss where lat between 51 and 56 and lng between -11 and -5) where rn = 1),
  s3 as (select eircode, count(distinct county) > 1 or count(distinct locality) > 1 or count(distinct area_slug) > 1 as mixed from ss group by 1),
  p1 as (select p.*, n.label, n.area_slug from (select *, row_number() over (partition by eircode order by registration_date desc, id desc) as rn from placed where eircode is not null) p left join named n on n.id = p.id and n.rn = 1 where p.rn = 1),
  p2 as (select eircode, plat, plng from (select *, row_number() over (partition by eircode order by registration_date desc, id desc) as rn from placed where eircode is not null and plat is not null) where rn = 1),
  cj as (select c.eircode, s1.eircode is not null as s, p1.eircode is not null as p, r.eircode_prefix is not null as r, s1.county as sc, s1.locality as sl, s1.area_slug as sa, p1.county as pc, p1.label as pl, p1.area_slug as pa, r.county as rc, r.locality as rl, r.area_slug as ra, r.markets,
      s2.lat, s2.lng, p2.plat, p2.plng, coalesce(s1.county <> p1.county, false) as clash, s3.mixed
    from codes c left join s1 using (eircode) left join s2 using (eircode) left join s3 using (eircode) left join p1 using (eircode) left join p2 using (eircode) left join routing r on r.eircode_prefix = left(c.eircode, 3)),
  context as (select eircode, case when s then sc when p then pc else rc end as county, case when s then sl when p then pl else rl end as locality, case when s then sa when p then pa else ra end as area_slug,
      coalesce(lat, case when not (s and clash) then plat end) as lat, coalesce(lng, case when not (s and clash) then plng end) as lng,
      case when s then 'ppr-exact' when p then 'planning-exact' when r then 'routing-key' else 'none' end as source,
      case when lat is not null then 'ppr-exact' when not (s and clash) and plat is not null then 'planning-exact' end as coordinate_source,
      case when s then case when clash or mixed then 'medium' else 'high' end when p then case when pa is not null or plat is not null then 'high' else 'medium' end when r then 'low' else 'none' end as confidence,
      case when s or p then 'exact-record' when r then 'routing-area' else 'unresolved' end as context_level, case when s then case when clash then 'county' when mixed then 'values' end end as conflict,
      case when not s and not p and r then markets else '' end as routing_markets from cj)"""


def _labels(context: DataFrame) -> DataFrame:
    return context.withColumn("routing_markets", F.array_join(F.transform("routing_markets", lambda m: m["label"]), "|"))


@query("x8_postcode_context", f"with {DATA}, {CONTEXT} select * replace (round(lat, 6) as lat, round(lng, 6) as lng) from context")
def postcode_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context of every household's code, of a code without a household in every routing key, and of an unknown key."""
    return _labels(_context(spark, sf_dir, *_records(spark, sf_dir))).withColumns({c: F.round(c, 6) for c in ("lat", "lng")})


SLUG = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '-')"
PLANS = f"""plans as (select eircode, source, county, locality, area_slug, left(eircode, 3) as routing_key,
      coalesce(case when source = 'routing-key' then nullif(split_part(routing_markets, '|', 1), '') end, locality, list_aggregate(list_transform(string_split(area_slug, '-'), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' '), left(eircode, 3) || ' routing area') as label,
      case when area_slug is not null and {SLUG("county")} <> area_slug then 'area' else 'routing-key' end as sales_basis, case when {SLUG("county")} <> area_slug then area_slug end as stats_slug,
      case when length({SLUG("locality")}) >= 3 and {SLUG("locality")} <> {SLUG("county")} then locality end as planning_locality
    from context where source <> 'none' and county is not null and not (source = 'routing-key' and contains(routing_markets, '|')))"""


@query("x10_fallback_plans", f"with {DATA}, {CONTEXT}, {PLANS} select * from plans")
def fallback_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of every code that has one; keys of several markets have none."""
    return M.fallback_plans(_context(spark, sf_dir, *_records(spark, sf_dir)))


HOLDS = "regexp_matches(lower({0}), '(^|[^a-z0-9])' || lower({1}) || '([^a-z0-9]|$)')"
FALLBACK = f"""own as (select eircode, list(id) as excluded from (select *, row_number() over (partition by eircode order by registration_date desc, reference desc) as rn from filed where eircode is not null) where rn <= 25 group by 1),
  ask as (select p.eircode, routing_key, county, planning_locality as locality, stats_slug as area_slug, coalesce(excluded, []) as excluded, stats_slug is not null and planning_locality is not null as narrow from plans p left join own using (eircode)),
  scope as (select distinct routing_key, county, locality, area_slug from ask where narrow),
  rival as (select distinct eircode_prefix, locality, area_slug from sold where trim(locality) <> '' and trim(area_slug) <> ''),
  hit as (select s.*, f.id, f.registration_date, f.reference from scope s join filed f on f.county = s.county and {HOLDS.format("f.location", "s.locality")} join named n on n.id = f.id and n.rn = 1 and n.area_slug = s.area_slug
    where not exists (select 1 from rival r where r.eircode_prefix = s.routing_key and r.area_slug <> s.area_slug and {HOLDS.format("f.location", "r.locality")})),
  t1 as (select a.eircode, h.id, row_number() over (partition by a.eircode order by h.registration_date desc, h.reference desc) as rn from ask a join hit h on a.narrow and h.routing_key = a.routing_key and h.county = a.county and h.locality = a.locality and h.area_slug = a.area_slug where not list_contains(a.excluded, h.id)),
  t2 as (select a.eircode, f.id, row_number() over (partition by a.eircode order by f.registration_date desc, f.reference desc) as rn from ask a join filed f on not a.narrow and f.eircode_prefix = a.routing_key where not list_contains(a.excluded, f.id)),
  t3 as (select a.eircode, f.id, row_number() over (partition by a.eircode order by f.registration_date desc, f.reference desc) as rn from ask a join filed f on not a.narrow and f.county = a.county and {HOLDS.format("f.location", "a.locality")} where not list_contains(a.excluded, f.id) and a.eircode not in (select eircode from t2)),
  tier as (select eircode, 'area' as basis, id, rn from t1 where rn <= 6 union all select eircode, 'routing-key', id, rn from t2 where rn <= 6 union all select eircode, 'locality', id, rn from t3 where rn <= 6),
  fallback as (select a.eircode, coalesce(min(basis), 'none') as basis, coalesce(string_agg(cast(id as varchar), ',' order by rn), '') as ids from ask a left join tier using (eircode) group by 1)"""


@query("x11_planning_fallback", f"with {DATA}, {CONTEXT}, {PLANS}, {FALLBACK} select * from fallback")
def planning_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applications of the first tier that has any, for every code with a plan; its own applications left out."""
    sales, applications, named = _records(spark, sf_dir)
    plans = materialised(M.fallback_plans(_context(spark, sf_dir, sales, applications, named)))
    found = M.planned_around(plans, sales, applications, named)
    return found.withColumn("ids", F.array_join("ids", ","))


def _bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales, applications, named = _records(spark, sf_dir)
    return M.market_bundles(_context(spark, sf_dir, sales, applications, named), sales, applications, named)


@query(
    "x12_market_bundles",
    f"""with {DATA}, {CONTEXT}, {PLANS}, {FALLBACK},
    sx as (select eircode, list(id) as gone from (select *, row_number() over (partition by eircode order by date_of_sale desc, id desc) as rn from sold where eircode is not null) where rn <= 25 group by 1),
    near as (select p.eircode, s.id, row_number() over (partition by p.eircode order by s.date_of_sale desc, s.id desc) as rn from plans p left join sx using (eircode)
      join sold s on case when p.sales_basis = 'area' then s.county = p.county and s.area_slug = p.stats_slug else s.eircode_prefix = p.routing_key end where not list_contains(coalesce(gone, []), s.id)),
    rec as (select eircode, string_agg(cast(id as varchar), ',' order by rn) as recent_sales from near where rn <= 8 group by 1),
    st as (select county, area_slug as stats_slug, count(*) as n_sales, quantile_cont(price_eur, 0.5) as median_price from sold group by 1, 2)
    select p.eircode, case when source = 'routing-key' then 'routing-area' when area_slug is not null then 'area' else 'county' end as level, p.county, case when area_slug is not null then p.locality end as locality, area_slug, label, routing_key, sales_basis,
      n_sales, round(median_price, 3) as median_price, coalesce(recent_sales, '') as recent_sales, basis as planning_basis, ids as planning_ids
    from plans p left join rec using (eircode) left join st using (county, stats_slug) join fallback using (eircode)""",
)
def market_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The local market of every code with a plan."""
    return _bundles(spark, sf_dir).withColumns({"median_price": F.round("median_price", 3), "recent_sales": F.array_join("recent_sales", ","), "planning_ids": F.array_join("planning_ids", ",")})
