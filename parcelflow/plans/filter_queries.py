"""Queries of search filters, date windows and replaced tables."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.operators import filters as S
from parcelflow.plans import postal_queries as H
from parcelflow.plans.mapping import APPLICATIONS, registrations
from parcelflow.plans.registry import query
from parcelflow.sources.shared import shared_folder
from parcelflow.sources.versions import ReplacedTable

NAME, COUNTIES, AS_OF = "Town 3, a12, County NATION_5", [f"NATION_{k}" for k in range(25)], date(2001, 8, 28)
ROWS = "a as (select *, '5 Main Road, ' || coalesce(locality, 'Town 3') as address from sold)"
TEXTS = ("Town 3 a12 County NATION_5", "Town 3", "a12", "County NATION_5")


def _match(column: str) -> str:
    return " or ".join(f"contains(lower({column}), lower('{t}'))" for t in TEXTS)


def _sql(narrow: bool) -> str:
    named = f"area_slug in ('town-3-a12-county-nation-5', 'town-3', 'a12', 'county-nation-5') or eircode_prefix = 'A12' or county = 'NATION_5' or {_match('locality')}"
    return f"with {H.HOMES}, {H.SOLD}, {ROWS} select county, area_slug, count(*) as n from a where ({named}{'' if narrow else ' or ' + _match('address')}) and date_of_sale between date '1999-08-28' and date '2001-08-28' group by all"


def _found(spark: SparkSession, sf_dir: str, broad: bool) -> DataFrame:
    since, until = S.date_range(AS_OF)
    rows = H.sold(spark, sf_dir).withColumn("address", F.concat(F.lit("5 Main Road, "), F.coalesce("locality", F.lit("Town 3"))))
    held = rows.where(S.area_filter(NAME, broad, COUNTIES) & F.col("date_of_sale").between(F.lit(since), F.lit(until)))
    return held.groupBy("county", "area_slug").agg(F.count("*").alias("n"))


@query("p18_area_filter", _sql(False))
def area_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales of the default span that an area's name, its key or its county asks for, address texts too."""
    return _found(spark, sf_dir, True)


@query("p18_narrow_area_filter", _sql(True))
def narrow_area_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, False)


#: As sizes halve, 32 days to one, a window of a size is a run of days from the start of the window that it is part of.
_STEPS = [32, 16, 8, 4, 2, 1]
_WINDOWS = ", ".join(
    f"""w{k} as (select status, f{k - 1} + cast((day - f{k - 1}) // {size} * {size} as int) as f{k}, least(l{k - 1}, f{k - 1} + cast((day - f{k - 1}) // {size} * {size} as int) + {size - 1}) as l{k}, day, n from o{k - 1}),
    t{k} as (select status, f{k}, l{k}, sum(n) as total from w{k} group by all), o{k} as (select w{k}.* from w{k} join t{k} using (status, f{k}, l{k}) where total > {{most}} and l{k} > f{k} and {size} > 1)"""
    for k, size in enumerate(_STEPS, 1)
)


def _bisected_sql(most: int) -> str:
    ends = " union all ".join(f"select status as kind, f{k} as first, l{k} as last, cast(total as bigint) as n from t{k} where not (total > {most} and l{k} > f{k} and {size} > 1)" for k, size in enumerate(_STEPS, 1))
    return f"with {APPLICATIONS}, o0 as (select status, date '1995-01-01' as f0, date '2001-12-31' as l0, registration_date as day, count(*) as n from applications where registration_date between date '1995-01-01' and date '2001-12-31' group by all), {_WINDOWS.format(most=most)} {ends}"


@query("s9_bisected_windows", _bisected_sql(20))
def bisected_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 32 days over all registrations by status, halved where they hold more than 20."""
    return S.bisected_windows(registrations(spark, sf_dir), "registration_date", "status", date(1995, 1, 1), date(2001, 12, 31), 32, 20)


@query("s16_replaced_table", f"with {APPLICATIONS} select authority, count(*) + 1 as n, max(registration_date) as latest from applications group by 1")
def replaced_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of counts that is replaced by one made of itself, as it stands afterwards."""
    held = ReplacedTable(spark, f"{shared_folder(spark)}/replaced-{uuid.uuid4().hex}")
    held.replace(registrations(spark, sf_dir).groupBy("authority").agg(F.count("*").alias("n"), F.max("registration_date").alias("latest")))
    held.replace(held.read().withColumn("n", F.col("n") + 1))
    return held.read()
