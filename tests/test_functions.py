"""Column functions on hand-made values: edges, nulls, ties."""

import datetime

import pytest
from pyspark.sql import functions as F

from parcelflow.functions import dates, geo, postcode, stats, status, text


def values(spark, expression, rows):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(rows)], "k int, v string")
    return [r[0] for r in df.orderBy("k").select(expression(F.col("v"))).collect()]


@pytest.mark.parametrize(
    ("function", "pairs"),
    [
        (text.slug, [("Café d'Or  12", "cafe-dor-12"), ("--A--", "a"), (None, None), ("", "")]),
        (text.ascii_slug, [(" Dún Áth ", "d-n-th"), ("A/B", "a-b")]),
        (text.slug_title, [("new-town", "New Town")]),
        (text.price, [("€1,234.50", 1234.5), ("1.2.3", None), ("", None), (None, None)]),
        (text.flag, [("Yes", True), (" n ", False), ("maybe", None), (None, None)]),
        (text.squeeze, [(" a \n b ", "a b"), ("  ", None)]),
        (text.html_text, [("<p>a&nbsp;&amp; b</p><br>c", "a & b c"), ("<p> </p>", None)]),
        (text.meaningful, [("n/a", None), ("hello  there", "Hello there"), ("Unknown", None)]),
        (text.xml_escape, [("a<b>&'\"", "a&lt;b&gt;&amp;&apos;&quot;")]),
        (text.reference_slug, [("25/1", "ref-MjUvMQ")]),
        (text.reference_of, [("ref-MjUvMQ", "25/1"), ("ref-***", None), ("x", None)]),
        (text.encoded_url, [("a b/ç", "a%20b%2F%C3%A7")]),
        (text.title_initials, [("little-island o'neill", "Little-Island O'Neill")]),
        (postcode.canonical, [("p25hx40", "P25 HX40"), ("D6W AC12", "D6W AC12"), ("B25 HX40", None), ("P25 HX4", None)]),
        (postcode.extract, [("Midleton, Co. Cork, P25 HX40", "P25 HX40"), ("XP25HX40", None), ("none", None)]),
        (postcode.looks_like, [("B12 3456", True), ("abc def", False), (None, False)]),
        (status.canonical, [("Application Closed", "finalised"), ("PRE_VALIDATION", "pre_validation"), ("AI Received", "further_information_received"), ("n/a", "unknown"), (None, "unknown"), ("new wording", "unknown")]),
        (dates.day_month_year, [("31/12/2020", datetime.date(2020, 12, 31)), ("30/02/2020", None), ("1/1/2020", None)]),
        (dates.iso_day, [("2024-02-29T23:00:00+05:00", datetime.date(2024, 2, 29)), ("2023-02-29", None), (None, None)]),
    ],
)
def test_function(spark, function, pairs):
    assert values(spark, function, [p[0] for p in pairs]) == [p[1] for p in pairs]


def test_locality_and_fields(spark):
    df = spark.createDataFrame([("1 Main St, Midleton, Cork", "Cork"), ("1 Main St, Cork, Ireland", "Cork"), ("alone", "Cork")], "a string, c string")
    assert [r[0] for r in df.select(text.locality_of(F.col("a"), F.col("c"))).collect()] == ["Midleton", None, None]
    html = "<table><tr><th>Status</th><td>Open</td></tr><tr><th>Agent</th><td>&nbsp;</td></tr><tr><th>Status</th> <td>Later</td></tr></table>"
    row = spark.createDataFrame([(html,)], "h string").select(text.table_fields(F.col("h")).alias("m")).first()
    assert row.m == {"Status": "Open", "Agent": None}


def test_stats_gates(spark):
    df = spark.createDataFrame([(110.0, 100.0), (0.0, 100.0), (5.0, 0.0), (None, 1.0)], "now double, before double")
    assert [r[0] for r in df.select(stats.percent_change(F.col("now"), F.col("before"))).collect()] == [10.0, None, None, None]
    df = spark.createDataFrame([(-2.5,), (2.5,)], "x double")
    assert [r[0] for r in df.select(stats.round_half_up(F.col("x"))).collect()] == [-2.0, 3.0]


def test_grid_and_distance(spark):
    df = spark.createDataFrame([(53.5, -8.0), (51.9, -8.2), (40.0, 0.0)], "lat double, lng double")
    rows = df.select(geo.to_grid(F.col("lat"), F.col("lng")).alias("g")).collect()
    assert (rows[0].g.easting, rows[0].g.northing) == pytest.approx((600_000, 750_000), abs=0.01)
    assert rows[2].g is None
    back = df.limit(2).withColumn("g", geo.to_grid(F.col("lat"), F.col("lng"))).select("lat", "lng", geo.from_grid(F.col("g.easting"), F.col("g.northing")).alias("p")).collect()
    assert all((r.p.lat, r.p.lng) == pytest.approx((r.lat, r.lng), abs=1e-7) for r in back)
    km = df.limit(1).select(geo.haversine_km(F.lit(53.0), F.lit(-8.0), F.lit(54.0), F.lit(-8.0))).first()[0]
    assert km == pytest.approx(111.195, abs=0.01)


def test_due_and_backoff(spark):
    day = datetime.date(2024, 1, 10)
    df = spark.createDataFrame([(day,), (datetime.date(2024, 1, 11),), (datetime.date(2024, 1, 1),), (None,)], "d date")
    assert [r[0] for r in df.select(dates.due_text(F.col("d"), day)).collect()] == ["due today", "due in 1 day", "due 9 days ago", None]
    assert [r[0] for r in spark.range(1, 7).select(dates.backoff_minutes(F.col("id"))).collect()] == [5, 10, 20, 40, 60, 60]
