"""Exact lookups: the records of a postcode, and places that one name alone means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow.functions import text as T


def exact_records(codes: DataFrame, sales: DataFrame, applications: DataFrame) -> DataFrame:
    """Every sale and application of the codes asked: eircode, surface, id, day. Latest first is up to the reader's order."""
    asked = codes.select("eircode").distinct()
    sold = sales.select("eircode", F.lit("sale").alias("surface"), "id", F.col("date_of_sale").alias("day"))
    planned = applications.select("eircode", F.lit("planning").alias("surface"), "id", F.col("registration_date").alias("day"))
    return sold.unionByName(planned).join(asked, "eircode", "left_semi")


def unique_place(queries: DataFrame, areas: DataFrame) -> DataFrame:
    """query and area of the queries that name exactly one area by label or slug, whatever the case, accents and punctuation."""
    asked = queries.select("query").distinct().withColumn("name", T.tokens(F.col("query"))).where("name <> ''")
    names = F.array_distinct(F.array(T.tokens(F.col("area_label")), T.tokens(F.col("area_slug"))))
    named = areas.select("county", "area_slug", F.explode(names).alias("name"))
    return asked.join(named, "name").groupBy("query").agg(F.count("*").alias("n"), F.min("county").alias("county"), F.min("area_slug").alias("area_slug")).where("n = 1").drop("n")
