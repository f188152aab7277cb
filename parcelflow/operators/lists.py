"""Lists that search pages offer, the status filter behind them, and record sets that come as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.functions import status
from parcelflow.functions import text as T
from parcelflow.operators.cohorts import NO_AREA

_AREA = ["county", "area_slug", "sales_count", "last_sale_date"]


def _areas(stats: DataFrame) -> DataFrame:
    """Trimmed areas that have a county and a slug, without the one that is none."""
    tidy = stats.withColumns({"county": F.btrim("county"), "area_slug": F.lower(F.btrim("area_slug"))})
    return tidy.where((F.col("county") != "") & (F.col("area_slug") != "") & (F.col("area_slug") != NO_AREA))


def search_areas(stats: DataFrame) -> DataFrame:
    """county, area_slug, area_label, sales_count, last_sale_date of every area once; of spellings that differ in case or blanks the one of most sales.

    In order of county, then most sales, then label, as the caller sorts or pages them.
    """
    best = _areas(stats).groupBy("county", "area_slug").agg(F.max(F.struct(F.coalesce("sales_count", F.lit(0)).alias("sales_count"), "last_sale_date")).alias("b"))
    return best.select("county", "area_slug", T.slug_title(F.col("area_slug")).alias("area_label"), "b.sales_count", "b.last_sale_date").orderBy("county", F.desc("sales_count"), "area_label", "area_slug")


def quick_areas(stats: DataFrame, limit: int = 8) -> DataFrame:
    """The areas of most sales; ties by county and slug."""
    return _areas(stats).select(*_AREA).orderBy(F.desc("sales_count"), "county", "area_slug").limit(limit)


def county_areas(stats: DataFrame, limit: int = 8) -> DataFrame:
    """The areas of most sales of every county, with their place in it."""
    by = Window.partitionBy("county").orderBy(F.desc("sales_count"), "area_slug")
    return _areas(stats).select(*_AREA).withColumn("place", F.row_number().over(by)).where(F.col("place") <= limit)


def status_is(value: str, state: str = "state", raw: str = "status") -> Column:
    """Rows of a status: by state if the value is one of the states that statuses are brought to, else by the source's own wording."""
    return F.col(state if value in status.LABELS else raw) == value


def recordset(rows: DataFrame, json: str, schema: str) -> DataFrame:
    """The records of JSON arrays as rows: `schema` names the fields that are read; missing ones are null, texts that are no array give nothing."""
    return rows.select(F.inline(F.from_json(json, f"array<struct<{schema}>>")))
