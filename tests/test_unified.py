"""Hand-made rows for the unified search."""

from datetime import date

from parcelflow.operators import unified
from parcelflow.operators.fulltext import text_search
from parcelflow.operators.unified import unified_search

D = date(2024, 1, 1)


def test_branches(spark):
    sales = spark.createDataFrame(
        [(1, "P25 HX40", "Cork", "midleton", "1 Main St, Midleton", D), (2, None, "Cork", "midleton", "Main Street 1", date(2024, 2, 2)), (3, None, "Dublin", "dun-laoghaire", "12 Dún Extensions Rd", D), (4, "P25 HX40", "Cork", "x", "z", None)],
        "id int, eircode string, county string, area_slug string, address string, date_of_sale date",
    )
    plans = spark.createDataFrame(
        [(1, "25/1234", "Midleton", "P25 HX40", D), (2, "25/12345", "1 Main St, Midleton", None, date(2024, 3, 3)), (3, "x", "Dun Laoghaire", None, None)],
        "id int, reference string, location string, eircode string, registration_date date",
    )
    areas = spark.createDataFrame([("Cork", "Midleton", "midleton", 90), ("Dublin", "Dún Laoghaire", "dun-laoghaire", 50), ("Dublin", "Upper Dún Laoghaire", "upper", 5)], "county string, label string, area_slug string, sales_count long")
    asked = [("code", "p25hx40"), ("ref", "25/1234"), ("addr", " 1 main  st"), ("stem", "12 dun extension"), ("area", "DUN laoghaire"), ("short", "x"), ("wrong", "P25 HX4"), ("none", None), ("long", "midleton in the county of cork")]
    got: dict = {}
    for r in unified_search(spark.createDataFrame(asked, "query_id string, query string"), sales, plans, areas).orderBy("query_id", "section", "place").collect():
        got.setdefault((r["query_id"], r["section"]), []).append(r["ref"])
    assert got == {
        ("code", "sale"): ["1", "4"],
        ("code", "planning"): ["1"],
        ("ref", "planning"): ["1", "2"],
        ("addr", "sale"): ["1"],
        ("addr", "planning"): ["2"],
        ("area", "place"): ["Dublin/dun-laoghaire", "Dublin/upper"],
        ("area", "sale"): ["3"],
        ("area", "planning"): ["3"],
        ("long", "place"): ["Cork/midleton"],
    }


def test_empty(spark):
    none = spark.createDataFrame([], "id int, eircode string, county string, area_slug string, address string, date_of_sale date, reference string, location string, registration_date date, label string, sales_count long")
    assert unified_search(spark.createDataFrame([("a", "12 main st")], "query_id string, query string"), none, none, none).count() == 0


def test_each_text_is_searched_once(spark, monkeypatch):
    """Before, every query met all rows of its rarest stem, so queries of one text cost as much as different ones."""
    searched = []

    def counted(rows, queries, *columns):
        searched.append(queries.count())
        return text_search(rows, queries, *columns)

    monkeypatch.setattr(unified, "text_search", counted)
    sales = spark.createDataFrame([(1, None, "Cork", "midleton", "1 Main St, Midleton", D)], "id int, eircode string, county string, area_slug string, address string, date_of_sale date")
    plans = spark.createDataFrame([(7, "x", "1 Main St, Midleton", None, D)], "id int, reference string, location string, eircode string, registration_date date")
    areas = spark.createDataFrame([("Cork", "Midleton", "midleton", 90)], "county string, label string, area_slug string, sales_count long")
    asked = spark.createDataFrame([(f"q{k}", "1 main  st" if k % 2 else " 1 main st") for k in range(6)], "query_id string, query string")
    got = {tuple(r) for r in unified_search(asked, sales, plans, areas).collect()}
    assert got == {row for k in range(6) for row in ((f"q{k}", "sale", 1, "1", "1 Main St, Midleton"), (f"q{k}", "planning", 1, "7", "x"))}
    assert searched == [1]
