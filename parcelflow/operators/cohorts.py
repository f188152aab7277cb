"""Locality pages that a sitemap carries: candidates of two surfaces, and the cohort that they make over time."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.functions import places
from parcelflow.functions import text as T

#: Labels that name more than a locality, beside the counties.
BROAD = ("county cork", "county dublin", "ireland")
#: An area that is none.
NO_AREA = "janeville"


def bounded(value: int | None, default: int, most: int, least: int = 1) -> int:
    """A limit that was asked for, or the default, within its bounds."""
    return max(least, min(default if value is None else value, most))


def is_locality(label: Column) -> Column:
    """Whether a label may head a page: short, without digits, no post office, no county and nothing broader."""
    low = F.lower(label)
    county = low.rlike(r"^co\.?\s+") | low.isin(*(c.lower() for c in places.COUNTY_NAMES), *BROAD)
    return F.coalesce((F.length(label) <= 80) & ~label.rlike("[0-9]") & ~low.rlike(r"(^|\s)(p\.?o\.?|post office)(\s|$)") & ~county, F.lit(False))


def locality_candidates(sales: DataFrame, applications: DataFrame, as_of: date) -> DataFrame:
    """surface, path, label, score: areas of 12 sales and localities of 8 applications, the last within three years.

    sales: county, area_slug, date_of_sale. applications: authority (a code), locality, registration_date; codes
    without a path are left out, as are areas named like their county or without the shape of a slug.
    """

    def since(years: int) -> Column:
        return F.add_months(F.lit(as_of), -12 * years)

    areas = sales.groupBy("county", "area_slug").agg(F.count("*").alias("n"), F.max("date_of_sale").alias("last"))
    sound = F.col("area_slug").rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$") & (F.length("area_slug") >= 3) & (F.col("area_slug") != T.ascii_slug(F.col("county"))) & (F.col("area_slug") != NO_AREA)
    areas = areas.where((F.col("n") >= 12) & (F.col("last") >= since(3)) & sound)
    sold = areas.select(F.lit("sold_prices").alias("surface"), F.concat(F.lit("/sold-prices/"), T.ascii_slug(F.col("county")), F.lit("/"), "area_slug").alias("path"), F.initcap(F.replace("area_slug", F.lit("-"), F.lit(" "))).alias("label"), "area_slug", places.place_score(F.col("n"), F.lit(True)).alias("score"))
    towns = applications.where("registration_date is not null and locality is not null").groupBy("authority", "locality").agg(F.count("*").alias("n"), F.max("registration_date").alias("last"))
    towns = towns.where((F.col("n") >= 8) & (F.col("last") >= since(3))).withColumns({"authority_slug": places.authority_slug(F.col("authority")), "area_slug": T.ascii_slug(F.col("locality"))})
    planned = towns.where("authority_slug is not null").select(F.lit("planning").alias("surface"), F.concat(F.lit("/planning/"), "authority_slug", F.lit("/areas/"), "area_slug").alias("path"), F.col("locality").alias("label"), "area_slug", places.place_score(F.col("n"), F.col("last") >= since(2)).alias("score"))
    return sold.unionByName(planned).where(is_locality(F.col("label")) & (F.col("area_slug") != "")).drop("area_slug")


def refreshed(members: DataFrame, candidates: DataFrame, as_of: date, size: int | None = None, residence: int | None = None, rotation: int | None = None) -> DataFrame:
    """The memberships after a refresh of all surfaces: surface, path, entered, left, score.

    members: surface, path, entered, left (null while in), score. candidates: surface, path, score, one row for each
    path. A surface that is full and has no member of `residence` days stays as it is. Otherwise candidates that are young members
    and candidates that are no members compete for `size` places, best score first, then path; those that are no members enter. Of
    the old members the `rotation` of the lowest stored scores leave. Active members take the candidates' scores,
    and a page that left may enter again, with a row of its own.
    """
    size, residence = bounded(size, 100, 500), max(1, 42 if residence is None else residence)
    rotation = bounded(rotation, 20, size, least=0)
    active = members.where("left is null").withColumn("old", F.col("entered") <= F.date_sub(F.lit(as_of), residence))
    full = active.groupBy("surface").agg(F.count("*").alias("n"), F.count_if("old").alias("n_old")).where((F.col("n") >= size) & (F.col("n_old") == 0)).select("surface")

    def first(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
        return rows.withColumn("place", F.row_number().over(Window.partitionBy("surface").orderBy(*order))).where(F.col("place") <= most).drop("place")

    open_members = active.join(full, "surface", "left_anti")
    leaving = first(open_members.where("old"), [F.col("score").asc_nulls_last(), F.col("path")], rotation).select("surface", "path", F.lit(True).alias("leaving"))
    state = active.select("surface", "path", F.col("old").alias("is_old"))
    competing = candidates.select("surface", "path", "score").join(full, "surface", "left_anti").join(state, ["surface", "path"], "left").where("is_old is null or not is_old")
    chosen = first(competing, [F.desc_nulls_first("score"), F.col("path")], size)
    entering = chosen.where("is_old is null").select("surface", "path", F.lit(as_of).alias("entered"), F.lit(None).cast("date").alias("left"), "score")
    fresh = candidates.select("surface", "path", F.col("score").alias("new_score"))
    kept = members.join(leaving, ["surface", "path"], "left").join(fresh, ["surface", "path"], "left").join(full.withColumn("is_full", F.lit(True)), "surface", "left")
    goes = F.col("left").isNull() & F.col("leaving").isNotNull()
    scored = F.col("left").isNull() & ~goes & F.col("is_full").isNull()
    after = kept.select("surface", "path", "entered", F.when(goes, F.lit(as_of)).otherwise(F.col("left")).alias("left"), F.when(scored, F.coalesce("new_score", "score")).otherwise(F.col("score")).alias("score"))
    return after.unionByName(entering)
