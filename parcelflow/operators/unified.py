"""One search for anything: each query's intent decides which branches it takes, and all queries run through them together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.functions import postcode
from parcelflow.functions import text as T
from parcelflow.operators.fulltext import text_search
from parcelflow.operators.search import intent, place_candidates, ranked_places
from parcelflow.sources.shared import materialised

#: Rows of each section, records of one postcode, characters of a query.
PLACES, SALES, PLANNING, EXACT, LONGEST = 8, 6, 8, 25, 120


def _first(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("place") <= most)


def _section(rows: DataFrame, name: str, ref: Column | str, label: Column | str) -> DataFrame:
    return rows.select("query_id", F.lit(name).alias("section"), "place", F.col(ref).cast("string").alias("ref") if isinstance(ref, str) else ref.alias("ref"), F.col(label).alias("label") if isinstance(label, str) else label.alias("label"))


def _holding(asked: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """query_id, id: rows whose text holds a query's tokens in a row, by equality of the runs of as many tokens as queries have."""
    lengths = asked.agg(F.collect_set(F.size(F.split("asked", " "))).alias("lengths"))  # one row
    words = F.split(T.tokens(F.col(column)), " ")

    def runs(n: Column) -> Column:
        return F.when(n <= F.size("w"), F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))).otherwise(F.array().cast("array<string>"))

    held = rows.select("id", words.alias("w")).crossJoin(F.broadcast(lengths)).select("id", F.explode(F.array_distinct(F.flatten(F.transform("lengths", runs)))).alias("asked"))
    return held.join(asked.where("asked <> ''"), "asked").select("query_id", "id")


def _containing(asked: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """query_id, id: rows whose short text contains a query's letters, whatever the case, by equality of its parts of as many letters."""
    lengths = asked.agg(F.collect_set(F.length("low")).alias("lengths"))  # one row
    text = F.lower(F.btrim(column))

    def parts(n: Column) -> Column:
        return F.when(n <= F.length("t"), F.transform(F.sequence(F.lit(1), F.length("t") - n + 1), lambda i: F.substr("t", i, n))).otherwise(F.array().cast("array<string>"))

    held = rows.select("id", text.alias("t")).where("t <> ''").crossJoin(F.broadcast(lengths)).select("id", F.explode(F.array_distinct(F.flatten(F.transform("lengths", parts)))).alias("low"))
    return held.join(asked.where("low <> ''"), "low").select("query_id", "id")


def unified_search(queries: DataFrame, sales: DataFrame, applications: DataFrame, areas: DataFrame) -> DataFrame:
    """query_id, section, place, ref, label: ranked places, sales and applications of every query.

    queries: query_id, query; of less than two characters or postcode-like without being one they find nothing. sales: id, eircode, county,
    area_slug, address, date_of_sale. applications: id, reference, location, eircode, registration_date. areas:
    county, label, area_slug, sales_count.

    A postcode finds its records. A reference finds applications that contain it. An address finds sales that hold all its words,
    exact ones first, then those it begins, then those it is part of; other queries the latest sales of the one place
    of exactly that name. Both find applications whose location holds them, others also by reference; all but references find
    places. Of applications the latest count, the exact reference first.

    Each different text is searched once, under itself as its id; the queries that say it get its few rows in the end.
    """
    cleaned = F.substring(T.squeeze(F.col("query")), 1, LONGEST)
    told = materialised(queries.select("query_id", cleaned.alias("q")).where(F.length("q") >= 2))
    known = {"intent": intent(F.col("q")), "asked": T.tokens(F.col("q")), "low": F.lower("q"), "code": postcode.canonical(F.col("q"))}
    asked = materialised(told.select("q").distinct().withColumns({"query_id": F.col("q"), **known}))
    latest_sale = [F.desc_nulls_last("date_of_sale"), F.desc("id")]
    latest_plan = [F.desc_nulls_last("registration_date"), F.desc("reference"), F.desc("id")]

    codes = asked.where("intent = 'postcode'").select("query_id", F.col("code").alias("eircode"))
    exact_sales = _first(codes.join(sales, "eircode"), latest_sale, EXACT)
    exact_plans = _first(codes.join(applications, "eircode"), latest_plan, EXACT)

    named = asked.where("intent in ('address', 'area')")
    places = materialised(ranked_places(place_candidates(named.select("query_id", "asked"), areas), PLACES))
    single = places.where("exact").groupBy("query_id").agg(F.count("*").alias("n"), F.first("county").alias("county"), F.first("area_slug").alias("area_slug")).where("n = 1")
    single = single.join(asked.where("intent = 'area'").select("query_id"), "query_id", "left_semi")
    latest = sales.withColumn("rank", F.row_number().over(Window.partitionBy("county", "area_slug").orderBy(*latest_sale))).where(F.col("rank") <= SALES)
    area_sales = _first(single.join(latest, ["county", "area_slug"]), latest_sale, SALES)

    addresses = named.where("intent = 'address'")
    found = text_search(sales, addresses, "id", "address", "query_id", "q").join(sales, "id").join(addresses.select("query_id", "asked"), "query_id")
    name = T.tokens(F.col("address"))
    score = sum((F.when(hit, gain).otherwise(0) for hit, gain in ((name == F.col("asked"), 1000), (name.startswith(F.col("asked")), 500), (name.contains(F.col("asked")), 300))), F.lit(0))
    address_sales = _first(found, [F.desc(score), *latest_sale], SALES)

    by_reference = _containing(asked.where("intent in ('reference', 'area')"), applications, "reference")
    by_location = _holding(named, applications, "location")
    plans = by_reference.union(by_location).distinct().join(applications, "id").join(asked.select("query_id", "low"), "query_id")
    top = _first(plans, latest_plan, PLANNING)
    top = _first(top.drop("place").withColumn("own", F.lower("reference") == F.col("low")), [F.desc("own"), *latest_plan], PLANNING)

    parts = [
        _section(places, "place", F.concat_ws("/", "county", "area_slug"), "label"),
        *(_section(rows, "sale", "id", "address") for rows in (exact_sales, area_sales, address_sales)),
        *(_section(rows, "planning", "id", "reference") for rows in (exact_plans, top)),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumnRenamed("query_id", "q").join(told, "q").select("query_id", "section", "place", "ref", "label")
