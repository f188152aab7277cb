"""What pages and reports are made of: locality pages, table orders, traffic cohorts, growth and batch summaries."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.functions import places
from parcelflow.functions import text as T


def locality_pages(applications: DataFrame, least: int = 8, decisions: int = 5) -> DataFrame:
    """authority, locality, n and the latest decisions (id, decision_date) of localities with enough applications; null localities have no page.

    Only ranked rows are kept before anything is gathered, so a page is small however busy its locality.
    """
    key = ["authority", "locality"]
    counts = applications.where("locality is not null").groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    latest = Window.partitionBy(*key).orderBy(F.desc("decision_date"), F.desc("reference"))
    top = applications.where("decision_date is not null").withColumn("place", F.row_number().over(latest)).where(F.col("place") <= decisions)
    listed = top.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", "id", "decision_date"))).alias("recent"))
    return counts.join(listed, key, "left").select(*key, "n", "recent")


def table_order(key: str, descending: bool) -> list[Column]:
    """Sort columns of a table: missing values last going up and, as going down is the exact reverse, first going down."""
    return [F.desc_nulls_first(key), F.desc("label")] if descending else [F.asc_nulls_last(key), F.asc("label")]


def traffic_order() -> list[Column]:
    """Sort columns of a traffic cohort: pages that anybody came to, then visitors, clicks, views, impressions, authority and reference."""
    came = F.greatest((F.col("visitors") > 0).cast("int"), (F.col("clicks") > 0).cast("int"))
    return [F.desc(came), *map(F.desc, ("visitors", "clicks", "pageviews", "impressions")), F.asc("authority"), F.asc("reference")]


def resolved_paths(paths: DataFrame, applications: DataFrame) -> DataFrame:
    """path, views, id and class of each visited path or url: its application by authority code and decoded reference, or `FAIL`.

    applications: id, authority (a code), reference. Paths of any other shape than an application's page are left out.
    """
    bare = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+://[^/?#]*", ""), r"[?#].*$", "")
    shape = "^/planning/([^/]+)/([^/]+)/?$"
    part = [F.try_url_decode(F.regexp_extract(bare, shape, k)) for k in (1, 2)]
    wanted = paths.where(bare.rlike(shape)).withColumns({"authority": places.authority_of_slug(part[0]), "reference": F.btrim(T.reference_of(part[1]))})
    known = applications.select("id", "authority", "reference")
    found = wanted.join(known, ["authority", "reference"], "left")
    return found.select("path", "views", "id", F.when(F.col("id").isNull(), "FAIL").otherwise("FOUND").alias("class"))


def due_soon(visits: DataFrame, now: datetime, start: int = 12, end: int = 40, most: int = 50) -> DataFrame:
    """The next visits due in a span of hours that nobody was reminded of; at most `most` a run."""
    due = F.col("starts_at").between(F.lit(now + timedelta(hours=start)), F.lit(now + timedelta(hours=end))) & (F.col("starts_at") < F.lit(now + timedelta(hours=end)))
    return visits.where(due & (F.col("status") == "scheduled") & F.col("reminded_at").isNull()).orderBy("starts_at", "id").limit(most)


def growth(rows: DataFrame, created: str, spans: dict[str, datetime]) -> DataFrame:
    """One row: all rows, and those created since each moment."""
    return rows.agg(F.count("*").alias("total"), *(F.count_if(F.col(created) >= F.lit(t)).alias(name) for name, t in spans.items()))


def batch_summary(rows: DataFrame, day: str) -> DataFrame:
    """One row: the years in order, the latest day and the number of rows of a batch; a list of years is short."""
    return rows.agg(F.array_sort(F.collect_set(F.year(day))).alias("years"), F.max(day).alias("latest"), F.count("*").alias("n"))


def last_rows(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Both tables, and of rows with one key that of the second; of equal keys in one table the greatest row."""
    columns = [c for c in first.columns if c != key]
    both = first.withColumn("table_no", F.lit(1)).unionByName(second.withColumn("table_no", F.lit(2)))
    last = both.groupBy(key).agg(F.max(F.struct("table_no", *columns)).alias("last_row"))
    return last.select(key, *(F.col("last_row")[c].alias(c) for c in columns))


def same_record(left: Column, right: Column) -> Column:
    """Whether two flat JSON objects say the same, whatever the order of their keys; nulls equal each other."""

    def entries(c: Column) -> Column:
        return F.array_sort(F.map_entries(F.from_json(c, "map<string,string>")))

    return entries(left).eqNullSafe(entries(right))


def without_known(rows: DataFrame, known: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """The first `most` rows whose key is not known."""
    return rows.join(known.select(key), key, "left_anti").orderBy(*order).limit(most)
