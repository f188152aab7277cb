"""Postal routing areas, what they tell about a postcode, and the local market around it.

Everything is asked for all postcodes at once. What hangs on a routing key, an area or a locality is
ranked and cut to the few rows that any answer can use before it meets the postcodes, so a key that
holds a third of all rows sends as little as any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.functions import geo, places
from parcelflow.functions import text as T
from parcelflow.operators.sales import exact_percentiles
from parcelflow.sources.shared import materialised

PLACE = ("county", "locality", "area_slug")
MARKETS = "array<struct<county: string, locality: string, area_slug: string, label: string>>"
#: Rows of an answer at most, rows that exclusions may cost at most, and their sum, which is ranked.
MOST, MOST_EXCLUDED = 12, 25
RANKED = MOST + MOST_EXCLUDED
#: Fixed value: scopes at most whose first periods are sent to all tasks; with more of them nothing is sent.
FEW_SCOPES = 100_000
#: Sales that a routing area needs, share of sales that may contradict its curated markets, shares that make a county, an area and a locality its own.
LEAST_SALES, MOST_CONFLICT = 5, 0.2
SHARES = (0.6, 0.7, 0.5)


def _clean(c: str | Column) -> Column:
    return F.nullif(F.btrim(c), F.lit(""))


def _name(c: str | Column) -> Column:
    return F.lower(F.btrim(c))


def routing_markets(rows: DataFrame) -> DataFrame:
    """eircode_prefix, markets: the curated markets of every routing key, in order of label.

    rows: eircode_prefix, county, label, area_slug and locality, which is the label where it is null. Keys of
    any case; repeated markets count once.
    """
    market = F.struct("county", F.coalesce(_clean("locality"), F.col("label")).alias("locality"), "area_slug", "label")
    sets = rows.groupBy(F.upper(F.btrim("eircode_prefix")).alias("eircode_prefix")).agg(F.collect_set(market).alias("m"))
    return sets.select("eircode_prefix", F.array_sort("m", lambda a, b: F.when(a["label"] < b["label"], -1).when(a["label"] > b["label"], 1).otherwise(0)).cast(MARKETS).alias("markets"))


def dominant(counts: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """by..., value: the value, whatever its case, that has at least `share` of the rows that have one; ties go to the least.

    counts: by..., value and n, the number of rows.
    """
    known = counts.where(F.col(value).isNotNull()).groupBy(*by, _name(value).alias("key")).agg(F.sum("n").alias("n"), F.min(value).alias(value))
    top = known.groupBy(*by).agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("less"), "key", value)).alias("top"))
    return top.where(-F.col("top.less") >= F.col("total") * share).select(*by, F.col(f"top.{value}").alias(value))


def routing_areas(sales: DataFrame, curated: DataFrame) -> DataFrame:
    """eircode_prefix, county, locality, area_slug, markets of every routing key whose sales say where it is.

    A key needs LEAST_SALES sales. Its curated markets hold if that many sales name one of their counties and
    at most MOST_CONFLICT of those with a county name another; one market alone gives its place, several only the
    county they share. Otherwise the dominant county, then the dominant area of that county's sales, then the
    dominant locality of that area's. sales: eircode_prefix and a place; curated: as of `routing_markets`.
    """
    tidy = sales.where(F.col("eircode_prefix").isNotNull()).select("eircode_prefix", *(_clean(c).alias(c) for c in PLACE))
    counts = materialised(tidy.groupBy("eircode_prefix", *PLACE).agg(F.count("*").alias("n")))  # every step below reads it
    enough = counts.groupBy("eircode_prefix").agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("county").isNotNull(), F.col("n"))), F.lit(0)).alias("placed"))
    enough = enough.where((F.col("total") >= LEAST_SALES) & (F.col("placed") > 0))

    met = counts.join(curated, "eircode_prefix").where(F.exists("markets", lambda m: _name(m["county"]) == _name("county")))
    agreed = met.groupBy("eircode_prefix").agg(F.sum("n").alias("agreed"), F.first("markets").alias("curated"))
    county = dominant(counts, ["eircode_prefix"], "county", SHARES[0]).withColumnRenamed("county", "top_county")
    within = counts.join(county, "eircode_prefix").where(_name("county") == _name("top_county"))
    area = dominant(within, ["eircode_prefix"], "area_slug", SHARES[1]).withColumnRenamed("area_slug", "top_area")
    inside = within.join(area, "eircode_prefix").where(F.col("area_slug") == F.col("top_area"))
    town = dominant(inside, ["eircode_prefix"], "locality", SHARES[2]).withColumnRenamed("locality", "top_locality")
    rows = enough
    for part in (agreed, county, area, town):
        rows = rows.join(part, "eircode_prefix", "left")

    holds = F.coalesce((F.col("agreed") >= LEAST_SALES) & (1 - F.col("agreed") / F.col("placed") <= MOST_CONFLICT), F.lit(False))
    one = F.when(F.size("curated") == 1, F.get("curated", F.lit(0)))
    counties = F.array_distinct(F.transform("curated", lambda m: m["county"]))
    shared = F.coalesce(one["county"], F.when(F.size(counties) == 1, F.get(counties, F.lit(0))))
    label = F.coalesce("top_locality", "top_area")
    own = F.when(F.col("top_area").isNotNull(), F.array(F.struct(F.col("top_county").alias("county"), label.alias("locality"), F.col("top_area").alias("area_slug"), label.alias("label")))).otherwise(F.array())
    found = rows.where(holds | F.col("top_county").isNotNull())
    return found.select(
        "eircode_prefix",
        F.when(holds, shared).otherwise(F.col("top_county")).alias("county"),
        F.when(holds, one["locality"]).otherwise(F.col("top_locality")).alias("locality"),
        F.when(holds, one["area_slug"]).otherwise(F.col("top_area")).alias("area_slug"),
        F.when(holds, F.col("curated")).otherwise(own).cast(MARKETS).alias("markets"),
    )


def held_names(rows: DataFrame, names: DataFrame) -> DataFrame:
    """id, name and what comes with it, for every name of its county that a row's location holds as whole words.

    rows: id, county, location; names: county, name and others. Names of n words meet the runs of n words of
    the locations by equi-join, for every n that a name has.
    """
    others = [c for c in names.columns if c != "county"]
    known = names.select(T.slug(F.col("county")).alias("of"), T.tokens(F.col("name")).alias("gram"), *others).where("gram <> ''")
    lengths = known.agg(F.collect_set(F.size(F.split("gram", " "))).alias("lengths"))  # one row
    words = F.split(T.tokens(F.col("location")), " ")

    def runs(n: Column) -> Column:
        return F.when(n <= F.size("w"), F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))).otherwise(F.array().cast("array<string>"))

    grams = rows.select("id", T.slug(F.col("county")).alias("of"), words.alias("w")).crossJoin(F.broadcast(lengths))
    grams = grams.select("id", "of", F.explode(F.array_distinct(F.flatten(F.transform("lengths", runs)))).alias("gram"))
    return grams.join(known, ["of", "gram"]).select("id", *others)


def area_matches(rows: DataFrame, areas: DataFrame) -> DataFrame:
    """id, label, area_slug: the longest area label of its county that a row's location holds; ties go to the least slug.

    rows: id, county, location; areas: county, label, area_slug.
    """
    found = held_names(rows, areas.select("county", F.col("label").alias("name"), "area_slug"))
    best = found.groupBy("id").agg(F.min(F.struct((-F.length("name")).alias("less"), "area_slug", "name")).alias("b"))
    return best.select("id", F.col("b.name").alias("label"), F.col("b.area_slug").alias("area_slug"))


def postcode_context(codes: DataFrame, sales: DataFrame, applications: DataFrame, routing: DataFrame, areas: DataFrame) -> DataFrame:
    """What is known of every code asked: place, position, where both come from, how sure, and what disagrees.

    codes: eircode. sales: eircode, id, date_of_sale, lat, lng and a place. applications: eircode, id, county,
    location, registration_date, grid_easting, grid_northing. routing: as of `routing_areas`. areas: county,
    label, area_slug. The latest sale that names any part of a place counts first, then the latest application with
    the area its location names, then the routing key; ties go to the greater id. A position comes from the
    latest sale or application that has one within the box; the applications' only where the counties agree.
    conflict: `county` where sale and application name different counties, `values` where sales differ among themselves.
    """
    asked = codes.select(F.upper(F.btrim("eircode")).alias("eircode")).distinct().where("eircode <> ''").withColumn("eircode_prefix", F.substring("eircode", 1, 3))
    asked = materialised(asked)
    tidy = sales.withColumns({c: _clean(c) for c in PLACE})
    says = F.coalesce(*PLACE).isNotNull()
    spot = F.when(geo.in_box(F.col("lat"), F.col("lng")), F.struct("lat", "lng"))
    mixed = [F.coalesce(F.min(_name(c)) != F.max(_name(c)), F.lit(False)) for c in PLACE]
    of_sales = tidy.groupBy("eircode").agg(
        F.max_by(F.struct(*PLACE), F.struct(says, "date_of_sale", "id")).alias("s"),
        F.max_by(spot, F.when(spot.isNotNull(), F.struct("date_of_sale", "id"))).alias("spot"),
        (mixed[0] | mixed[1] | mixed[2]).alias("mixed"),
    )
    grid = geo.from_grid(F.col("grid_easting").cast("double"), F.col("grid_northing").cast("double"))
    of_plans = applications.join(asked, "eircode", "left_semi").groupBy("eircode").agg(
        F.max_by(F.struct("id", "county", "location"), F.struct("registration_date", "id")).alias("p"),
        F.max_by(grid, F.when(grid.isNotNull(), F.struct("registration_date", "id"))).alias("grid"),
    )
    latest = of_plans.select("eircode", "grid", "p.*")
    named = area_matches(latest.select(F.col("eircode").alias("id"), "county", "location"), areas)
    of_plans = latest.join(named, latest["eircode"] == named["id"], "left").select("eircode", "grid", F.struct(_clean("county").alias("county"), F.col("label").alias("locality"), "area_slug").alias("p"))
    of_key = routing.select("eircode_prefix", F.struct(*PLACE, "markets").alias("r"))
    rows = asked.join(of_sales, "eircode", "left").join(of_plans, "eircode", "left").join(of_key, "eircode_prefix", "left")

    sold, planned, keyed = (F.col(c).isNotNull() for c in "spr")
    clash = F.coalesce(_name("s.county") != _name("p.county"), F.lit(False))
    conflict = F.when(sold, F.when(clash, "county").when(F.col("mixed"), "values"))
    grid_counts = F.when(~(sold & clash), F.col("grid"))
    source = F.when(sold, "ppr-exact").when(planned, "planning-exact").when(keyed, "routing-key").otherwise("none")
    sure = F.when(sold, F.when(conflict.isNotNull(), "medium").otherwise("high")).when(planned, F.when(F.col("p.area_slug").isNotNull() | F.col("grid").isNotNull(), "high").otherwise("medium")).when(keyed, "low").otherwise("none")
    exact = sold | planned
    place = [F.when(sold, F.col(f"s.{c}")).when(planned, F.col(f"p.{c}")).otherwise(F.col(f"r.{c}")).alias(c) for c in PLACE]
    position = [F.coalesce(F.col(f"spot.{c}"), grid_counts[c]).alias(c) for c in ("lat", "lng")]
    of_position = F.when(F.col("spot").isNotNull(), "ppr-exact").when(grid_counts.isNotNull(), "planning-exact")
    return rows.select(
        "eircode", *place, *position, source.alias("source"), of_position.alias("coordinate_source"), sure.alias("confidence"),
        F.when(exact, "exact-record").when(keyed, "routing-area").otherwise("unresolved").alias("context_level"), conflict.alias("conflict"),
        F.when(~exact & keyed, F.col("r.markets")).otherwise(F.array()).cast(MARKETS).alias("routing_markets"),
    )


def fallback_plans(context: DataFrame) -> DataFrame:
    """How to fill the page of each code that has a county and at most one routing market.

    routing_key, label, sales_basis (`area` or `routing-key`), stats_slug (the area whose statistics hold, or
    null), planning_locality (a locality that says more than its county, or null), beside the context's place.
    """
    several = (F.col("source") == "routing-key") & (F.size("routing_markets") > 1)
    broad = F.coalesce(T.slug(F.col("county")) == T.slug(F.col("area_slug")), F.lit(False))
    key = F.substring("eircode", 1, 3)
    market = F.when(F.col("source") == "routing-key", F.get("routing_markets", F.lit(0))["label"])
    label = F.coalesce(market, "locality", T.slug_title(F.col("area_slug")), F.concat(key, F.lit(" routing area")))
    own = F.col("area_slug").isNotNull() & ~broad
    found = context.where((F.col("source") != "none") & F.col("county").isNotNull() & ~several)
    return found.select(
        "eircode", "source", *PLACE, key.alias("routing_key"), label.alias("label"), F.when(own, "area").otherwise("routing-key").alias("sales_basis"),
        F.when(own, F.col("area_slug")).alias("stats_slug"), F.when(places.is_specific(F.col("locality"), F.col("county")), F.col("locality")).alias("planning_locality"),
    )


def _first(rows: DataFrame, scope: list[str], order: list[Column]) -> DataFrame:
    """The first RANKED rows of every scope in order, with their place; Spark cuts each task's rows before the shuffle.

    A hash of the scope leads it, as a sort tells numbers apart at once but texts with a common start slowly.
    """
    by = Window.partitionBy("scope_hash", *scope).orderBy(*order)
    return rows.withColumn("scope_hash", F.xxhash64(*scope)).withColumn("place", F.row_number().over(by)).where(F.col("place") <= RANKED)


def _late(rows: DataFrame, scope: list[str], period: Column) -> DataFrame:
    """`rows` without those of periods that RANKED later rows of their scope come before, so that `_first` need not sort them.

    period: a number that the first key of the order falls with, null for rows that come last. Rows are counted by scope and period
    first; of more than FEW_SCOPES scopes all rows stay, as a scope then has few to spare.
    """
    when = F.coalesce(period, F.lit(-(2**31)))
    counts = rows.groupBy(*(F.col(c).alias(f"of_{c}") for c in scope), when.alias("period")).agg(F.count("*").alias("n"))
    later = Window.partitionBy(*(f"of_{c}" for c in scope)).orderBy(F.desc("period")).rowsBetween(Window.unboundedPreceding, -1)
    needed = counts.withColumn("later", F.coalesce(F.sum("n").over(later), F.lit(0))).where(F.col("later") < RANKED)
    floors = materialised(needed.groupBy(*(f"of_{c}" for c in scope)).agg(F.min("period").alias("floor")))
    if floors.count() > FEW_SCOPES:
        return rows
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in scope))
    return rows.join(F.broadcast(floors), same & (when >= F.col("floor"))).select(*rows.columns)


def _ranked(rows: DataFrame, scope: list[str], order: list[Column], value: str) -> DataFrame:
    """scope..., ranked: the first RANKED values of every scope in order."""
    first = _first(rows, scope, order).groupBy("scope_hash", *scope).agg(F.sort_array(F.collect_list(F.struct("place", F.col(value).alias("value")))).alias("ranked"))
    return first.select(*scope, F.transform("ranked", lambda r: r["value"]).alias("ranked"))


def _without(ranked: Column, excluded: Column, limit: int) -> Column:
    """The first `limit` of a ranked array that are not excluded; as many exclusions count as MOST_EXCLUDED allows."""
    room = F.least(F.size(excluded), F.lit(MOST_EXCLUDED)) + limit
    kept = F.filter(F.slice(ranked, F.lit(1), room), lambda x: ~F.array_contains(excluded, x))
    return F.coalesce(F.slice(kept, 1, limit), F.array())


def planning_fallback(asked: DataFrame, applications: DataFrame, areas: DataFrame, rivals: DataFrame, limit: int = 6) -> DataFrame:
    """eircode, basis, ids: for every code the applications of the first tier that has any.

    asked: eircode, routing_key, county, locality, area_slug, excluded (ids). applications: id,
    eircode_prefix, county, location, registration_date, reference. areas: county, label, area_slug. rivals: eircode_prefix,
    locality, area_slug, the places that sales of a routing key name.

    With area and locality the tier is `area`: applications whose location holds the locality, names no place of the
    routing key in another area, and whose longest area label is the asked one's. Nothing else is tried then.
    Otherwise `routing-key`, and where that is empty `locality`: those of the county that hold the
    locality. Latest first, then by reference; `none` where no tier has rows. Whole words count, accents don't.

    Whether a row is of a locality or an area hangs on its county and location alone, so only the RANKED latest rows of
    one county and location can be in an answer. Each different text is looked into once, under the least id of its rows.
    """
    limit = max(1, min(limit, MOST))
    asked = asked.withColumn("excluded", F.coalesce("excluded", F.array().cast("array<bigint>"))).withColumn("county_key", T.slug(F.col("county")))
    narrow = F.col("area_slug").isNotNull() & F.col("locality").isNotNull()
    latest = [F.desc_nulls_last("registration_date"), F.desc("reference"), F.desc("id")]
    told = applications.where("county is not null and location is not null").select("county", "location", "registration_date", "reference", "id")
    kept = _first(_late(told, ["county", "location"], F.year("registration_date")), ["county", "location"], latest)
    texts = kept.groupBy("scope_hash", "county", "location").agg(F.min("id").alias("id"), F.collect_list(F.struct("registration_date", "reference", "id")).alias("rows")).drop("scope_hash")
    texts = materialised(texts.withColumns({"county_key": T.slug(F.col("county")), "words": T.tokens(F.col("location"))}))

    keyed = applications.where("eircode_prefix is not null").select("eircode_prefix", "registration_date", "reference", "id")
    by_key = _ranked(_late(keyed, ["eircode_prefix"], F.unix_date("registration_date")), ["eircode_prefix"], latest, "id")

    towns = asked.where("locality is not null").select(F.col("county_key").alias("county"), F.col("locality").alias("name")).distinct()
    holds = held_names(texts, towns).join(texts, "id").select("id", F.col("name").alias("locality"), "county_key", "words", "rows")
    by_town = _ranked(holds.select("county_key", "locality", F.inline("rows")), ["county_key", "locality"], latest, "id")

    wanted = asked.where(narrow).select("routing_key", "county_key", "locality", "area_slug").distinct()
    other = materialised(rivals.select("eircode_prefix", "locality", "area_slug").distinct())  # so that slugs are made of different places, not of every sale
    other = other.select(F.col("eircode_prefix").alias("routing_key"), _clean("locality").alias("rival"), T.slug(_clean("area_slug")).alias("rival_slug")).where("rival is not null and rival_slug <> ''").distinct()
    against = wanted.join(other, "routing_key").where(F.col("rival_slug") != T.slug(F.col("area_slug"))).groupBy("routing_key", "county_key", "locality", "area_slug").agg(F.collect_set(T.tokens(F.col("rival"))).alias("rivals"))
    slugs = area_matches(texts, areas).select("id", "area_slug")
    met = holds.join(slugs, "id").join(wanted, ["county_key", "locality", "area_slug"])
    free = met.join(against, wanted.columns, "left").where(~F.exists(F.coalesce("rivals", F.array().cast("array<string>")), lambda r: T.has_tokens(F.col("words"), r)))
    by_area = _ranked(free.select(*wanted.columns, F.inline("rows")), wanted.columns, latest, "id")

    rows = asked.join(by_key.select(F.col("eircode_prefix").alias("routing_key"), F.col("ranked").alias("of_key")), "routing_key", "left")
    rows = rows.join(by_town.withColumnRenamed("ranked", "of_town"), ["county_key", "locality"], "left")
    rows = rows.join(by_area.withColumnRenamed("ranked", "of_area"), wanted.columns, "left")
    first, second, third = (_without(F.col(c), F.col("excluded"), limit) for c in ("of_area", "of_key", "of_town"))
    rows = rows.select("eircode", narrow.alias("narrow"), first.alias("a"), second.alias("k"), third.alias("t"))
    basis = F.when(F.col("narrow"), F.when(F.size("a") > 0, "area").otherwise("none")).when(F.size("k") > 0, "routing-key").when(F.size("t") > 0, "locality").otherwise("none")
    ids = F.when(basis == "area", F.col("a")).when(basis == "routing-key", F.col("k")).when(basis == "locality", F.col("t")).otherwise(F.array())
    return rows.select("eircode", basis.alias("basis"), ids.alias("ids"))


def planned_around(plans: DataFrame, sales: DataFrame, applications: DataFrame, areas: DataFrame, planned: int = 6) -> DataFrame:
    """eircode, basis, ids: the `planning_fallback` of every plan, without the code's own latest MOST_EXCLUDED applications."""
    latest = [F.desc_nulls_last("registration_date"), F.desc("reference"), F.desc("id")]
    own = _ranked(applications.join(plans, "eircode", "left_semi"), ["eircode"], latest, "id").select("eircode", F.slice("ranked", 1, MOST_EXCLUDED).alias("excluded"))
    asked = plans.select("eircode", "routing_key", "county", F.col("planning_locality").alias("locality"), F.col("stats_slug").alias("area_slug"))
    asked = materialised(asked.join(own, "eircode", "left"))
    return planning_fallback(asked, applications, areas, sales.select("eircode_prefix", "locality", "area_slug"), planned)


def market_bundles(context: DataFrame, sales: DataFrame, applications: DataFrame, areas: DataFrame, recent: int = 8, planned: int = 6) -> DataFrame:
    """The local market of every code that has a plan: statistics of its area, latest sales and applications around it.

    level is `area`, `county` (no area known) or `routing-area` (only the routing key is); recent_sales and planning_ids leave out
    the code's own latest MOST_EXCLUDED records. The statistics are sales and median of the area, where the plan names one.
    """
    plans = materialised(fallback_plans(context))
    planning = planned_around(plans, sales, applications, areas, planned).select("eircode", F.col("basis").alias("planning_basis"), F.col("ids").alias("planning_ids"))
    latest = [F.desc_nulls_last("date_of_sale"), F.desc("id")]
    own = _ranked(sales.join(plans, "eircode", "left_semi"), ["eircode"], latest, "id").select("eircode", F.slice("ranked", 1, MOST_EXCLUDED).alias("own_sales"))
    plans = plans.join(own, "eircode", "left").withColumn("own_sales", F.coalesce("own_sales", F.array().cast("array<bigint>")))
    parts = ["eircode_prefix", "county", "area_slug"]  # the first rows of a key or an area are among the first of their parts
    dated = _late(sales.select(*parts, "date_of_sale", "id"), parts, F.unix_date("date_of_sale"))
    heads = materialised(_first(dated, parts, latest).select(*parts, "date_of_sale", "id"))
    by_key = _ranked(heads.where("eircode_prefix is not null"), ["eircode_prefix"], latest, "id").select(F.col("eircode_prefix").alias("routing_key"), F.col("ranked").alias("of_key"))
    by_area = _ranked(heads.where("area_slug is not null"), ["county", "area_slug"], latest, "id").select("county", F.col("area_slug").alias("stats_slug"), F.col("ranked").alias("of_area"))
    known = sales.where("county is not null and area_slug is not null").select("county", F.col("area_slug").alias("stats_slug"), "price_eur")
    medians = exact_percentiles(known.groupBy("county", "stats_slug", "price_eur").agg(F.count("*").alias("n")), ["county", "stats_slug"], "price_eur", {"median_price": ("n", 0.5)})
    stats = known.groupBy("county", "stats_slug").agg(F.count("*").alias("n_sales")).join(medians, ["county", "stats_slug"])
    rows = plans.join(by_key, "routing_key", "left").join(by_area, ["county", "stats_slug"], "left").join(stats, ["county", "stats_slug"], "left").join(planning, "eircode")
    sold = F.when(F.col("sales_basis") == "area", _without(F.col("of_area"), F.col("own_sales"), recent)).otherwise(_without(F.col("of_key"), F.col("own_sales"), recent))
    level = F.when(F.col("source") == "routing-key", "routing-area").when(F.col("area_slug").isNotNull(), "area").otherwise("county")
    return rows.select("eircode", level.alias("level"), "county", F.when(F.col("area_slug").isNotNull(), F.col("locality")).alias("locality"), "area_slug", "label", "routing_key", "sales_basis", "n_sales", "median_price", sold.alias("recent_sales"), "planning_basis", "planning_ids")
