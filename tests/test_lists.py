"""Hand-made rows for area lists, status filters and JSON record sets."""

from datetime import date

from parcelflow.operators import lists as L

D, E = date(2024, 1, 1), date(2023, 1, 1)


def test_area_lists(spark):
    rows = [("Cork", "midleton", 5, D), (" Cork ", "MIDLETON ", 9, E), ("Cork", "cobh", 9, D), ("Cork", "janeville", 99, D), (None, "x", 1, D), ("Mayo", " ", 1, D), ("Mayo", "west-port", None, None), ("Mayo", "a", 2, D)]
    stats = spark.createDataFrame(rows, "county string, area_slug string, sales_count long, last_sale_date date")
    assert [tuple(r) for r in L.search_areas(stats).collect()] == [("Cork", "cobh", "Cobh", 9, D), ("Cork", "midleton", "Midleton", 9, E), ("Mayo", "a", "A", 2, D), ("Mayo", "west-port", "West Port", 0, None)]
    assert [r["area_slug"] for r in L.quick_areas(stats, 3).collect()] == ["cobh", "midleton", "midleton"]
    assert sorted((r["county"], r["place"], r["area_slug"]) for r in L.county_areas(stats, 1).collect()) == [("Cork", 1, "cobh"), ("Mayo", 1, "a")]


def test_status_filter(spark):
    rows = spark.createDataFrame([(1, "withdrawn", "W"), (2, "unknown", "withdrawn"), (3, None, "N/A")], "id int, state string, status string")
    assert [r["id"] for r in rows.where(L.status_is("withdrawn")).collect()] == [1] and [r["id"] for r in rows.where(L.status_is("N/A")).collect()] == [3]


def test_record_sets(spark):
    texts = ['[{"a": 1, "b": "2024-01-01", "z": 0}, {"a": null}]', "[]", "nonsense", None]
    got = L.recordset(spark.createDataFrame([(t,) for t in texts], "j string"), "j", "a int, b date").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, D), (None, None)], key=repr)
