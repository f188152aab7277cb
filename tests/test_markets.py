"""Hand-made rows for routing areas, postcode context, fallback plans, planning fallback and market bundles."""

import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from parcelflow.functions import places
from parcelflow.functions import text as T
from parcelflow.operators import context as X
from parcelflow.operators import markets as M
from parcelflow.plans import registry

SALE = "id long, eircode string, eircode_prefix string, county string, locality string, area_slug string, date_of_sale date, price_eur double, lat double, lng double"
PLAN = "id long, reference string, eircode string, eircode_prefix string, county string, location string, registration_date date, grid_easting double, grid_northing double"
DAY = date(2025, 1, 1)
CURATED = [("P43", "Cork", "Carrigaline", "carrigaline", None), ("p25 ", "Cork", "Midleton", "midleton", None), ("T12", "Cork", "Cork (centre and southside)", "cork", "Cork"), *(("A63", "Wicklow", x, x.lower(), None) for x in ("Greystones", "Delgany")), ("A82", "Meath", "Kells", "kells", None), ("A82", "Cavan", "Virginia", "virginia", None)]


def sales(spark, rows):
    """rows: eircode, county, locality, area_slug, then a day and a position if need be."""
    full = [(i, e if len(e) > 3 else None, e[:3], c, loc, s, *(r or (DAY,))[:1], 100.0 * i, *((r[1], r[2]) if len(r) > 1 else (None, None))) for i, (e, c, loc, s, *r) in enumerate(rows)]
    return spark.createDataFrame(full, SALE)


@pytest.fixture(scope="module")
def curated(spark):
    return M.routing_markets(spark.createDataFrame(CURATED, "eircode_prefix string, county string, label string, area_slug string, locality string"))


@pytest.fixture(scope="module")
def areas(spark):
    names = [("Cork", "Midleton", "midleton"), ("Cork", "Carrigaline", "carrigaline"), ("Cork", "Carrigaline Middle", "carrigaline-middle"), ("Cork", "Ringaskiddy", "ringaskiddy"), ("Dublin", "Dublin 6", "dublin-6")]
    return spark.createDataFrame(names, "county string, label string, area_slug string")


def routing(spark, curated, rows):
    found = M.routing_areas(sales(spark, rows), curated).collect()
    return {r["eircode_prefix"]: (r["county"], r["locality"], r["area_slug"], [m["label"] for m in r["markets"]]) for r in found}


def test_curated_markets_hold_where_sales_agree(spark, curated):
    rows = [("P43", "Cork", t, t.lower()) for t in ("Carrigaline", "Herons Wood", "Crosshaven", "Church Rd", "Ringaskiddy") for _ in range(4)]
    rows += [("A63", " wicklow", None, None)] * 10 + [("A82", "Meath", None, None)] * 5 + [("A82", "Cavan", None, None)] * 5
    assert routing(spark, curated, rows) == {
        "P43": ("Cork", "Carrigaline", "carrigaline", ["Carrigaline"]),
        "A63": ("Wicklow", None, None, ["Delgany", "Greystones"]),
        "A82": (None, None, None, ["Kells", "Virginia"]),
    }


def test_gates_of_curated_markets(spark, curated):
    four, conflict, fifth = [("P43", "Cork", "X", "x")] * 4, [("P25", "Cork", "X", "x")] * 7 + [("P25", "Kerry", None, None)] * 3, [("T12", "Cork", "X", "x")] * 8 + [("T12", "Kerry", None, None)] * 2
    got = routing(spark, curated, [*four, ("P43", None, None, None), *conflict, *fifth])
    assert got["P43"] == ("Cork", "X", "x", ["X"])  # four sales agree, five are needed
    assert got["P25"] == ("Cork", "X", "x", ["X"])  # three tenths contradict
    assert got["T12"] == ("Cork", "Cork", "cork", ["Cork (centre and southside)"])  # two tenths may


def test_dominant_shares(spark, curated):
    def key(county, area, locality, n=10):
        return [("X01", "Mayo" if i < county else "Sligo", "L" if i < locality else f"l{i}", "a" if i < area else f"b{i}") for i in range(n)]

    of = lambda *a: routing(spark, curated, key(*a)).get("X01")
    assert of(6, 5, 3) == ("Mayo", "L", "a", ["L"])  # 6 of 10, 5 of 6, 3 of 5
    assert of(5, 5, 5) is None
    assert of(10, 6, 6) == ("Mayo", None, None, []) and of(10, 7, 3) == ("Mayo", None, "a", ["a"])
    assert of(4, 4, 4, 4) is None  # four sales
    assert routing(spark, curated, [("X01", " ", None, None)] * 9) == {}


def contexts(spark, curated, areas, codes, sold, filed=()):
    asked = spark.createDataFrame([(c,) for c in codes], "eircode string")
    rows = sales(spark, sold)
    return M.postcode_context(asked, rows, spark.createDataFrame(list(filed), PLAN), M.routing_areas(rows, curated), areas)


def filed(i, code, county="Cork", location="Midleton, Co. Cork", day=date(2025, 2, 1), east=587_769.0, north=573_825.0):
    return (i, f"25/{i}", code if code and len(code) > 3 else None, code and code[:3], county, location, day, east, north)


def test_context_of_exact_records(spark, curated, areas):
    sold = [
        ("P25 HX40", "Cork", "Midleton", "midleton", DAY, 51.9, -8.17),
        ("P25 HX41", "Cork", "Midleton", "midleton", DAY),
        ("P25 HX42", "Cork", "Midleton", "midleton", DAY),
        ("P25 HX43", "Cork", "Old Area", "old-area", date(2020, 1, 1), 51.9, -8.1),
        ("P25 HX43", "Cork", "Midleton", "midleton", DAY, 60.0, -8.1),
        ("P25 HX43", " ", None, "", date(2025, 6, 1)),
    ]
    plans = [filed(1, "P25 HX40"), filed(2, "P25 HX41"), filed(3, "P25 HX42", "Dublin"), filed(4, "P25 HX44", location="Main St, MIDLETON"), filed(5, "P25 HX45", location="x", east=1.0)]
    got = {r["eircode"]: r for r in contexts(spark, curated, areas, ["p25 hx40 ", *(f"P25 HX4{i}" for i in range(6)), "Z99 0000"], sold, plans).collect()}
    brief = {k[-1]: (r["area_slug"], r["source"], r["coordinate_source"], r["confidence"], r["conflict"]) for k, r in got.items() if k != "Z99 0000"}
    assert brief == {
        "0": ("midleton", "ppr-exact", "ppr-exact", "high", None),
        "1": ("midleton", "ppr-exact", "planning-exact", "high", None),
        "2": ("midleton", "ppr-exact", None, "medium", "county"),
        "3": ("midleton", "ppr-exact", "ppr-exact", "medium", "values"),
        "4": ("midleton", "planning-exact", "planning-exact", "high", None),
        "5": (None, "planning-exact", None, "medium", None),
    }
    assert (got["P25 HX40"]["lat"], got["P25 HX43"]["lat"], got["P25 HX42"]["lat"]) == (51.9, 51.9, None)
    assert 51 < got["P25 HX41"]["lat"] < 53
    assert got["Z99 0000"]["context_level"] == "unresolved" and got["Z99 0000"]["county"] is None


def test_context_and_plan_of_routing_keys(spark, curated, areas):
    sold = [("P25", "Cork", "Midleton", "midleton")] * 10 + [("T12", "Cork", "Cork", "cork")] * 10 + [("A63", "Wicklow", None, None)] * 10 + [("F23", "Mayo", "Castlebar", "castlebar")] * 10
    context = contexts(spark, curated, areas, ["P25 VVVV", "T12 VVVV", "A63 VVVV", "F23 VVVV", "B00 VVVV"], sold)
    levels = {r["eircode"][:3]: (r["context_level"], r["confidence"], r["lat"], len(r["routing_markets"])) for r in context.collect()}
    assert levels == {"P25": ("routing-area", "low", None, 1), "T12": ("routing-area", "low", None, 1), "A63": ("routing-area", "low", None, 2), "F23": ("routing-area", "low", None, 1), "B00": ("unresolved", "none", None, 0)}
    plans = {r["routing_key"]: (r["label"], r["sales_basis"], r["stats_slug"], r["planning_locality"]) for r in M.fallback_plans(context).collect()}
    assert plans == {
        "P25": ("Midleton", "area", "midleton", "Midleton"),
        "T12": ("Cork (centre and southside)", "routing-key", None, None),
        "F23": ("Castlebar", "area", "castlebar", "Castlebar"),
    }


def test_planning_fallback_tiers(spark, areas):
    asked = spark.createDataFrame(
        [("1", "P43", "Cork", "Carrigaline", "carrigaline", [4]), ("2", "P25", "Cork", "Midleton", None, None), ("3", "D99", "Dublin", "Dublin 6", None, None), ("4", "D99", "Dublin", "Nowhere", None, None), ("5", "P43", "cork", "Ringaskiddy", "carrigaline", None), ("6", "X99", "Cork", None, None, None)],
        "eircode string, routing_key string, county string, locality string, area_slug string, excluded array<long>",
    )
    plans = [
        filed(1, "P43", location="Main Street, Carrigaline, Cork"),
        filed(2, "P43", location="Ringaskiddy, Carrigaline, Cork"),
        filed(3, "P43", location="Carrigaline Middle, Cork"),
        filed(4, "P43", location="Carrigaline"),
        filed(5, "P25", location="Naas"),
        filed(6, "P25", location="Midleton", day=date(2026, 1, 1)),
        filed(7, None, "Dublin", "Rathmines, Dublin 6, D06 VVVV"),
        filed(8, None, "Dublin", "Example Road, Dublin 60"),
        filed(9, None, "Dublin", "Example Road, Dublin 6W"),
        filed(10, None, "Cork", "CARRIGALINE; Cork", day=None),
    ]
    rivals = spark.createDataFrame([("P43", "Carrigaline", "carrigaline"), ("P43", "Ringaskiddy", "ringaskiddy"), ("P43", " ", "x"), ("P43", "Main Street", None)], "eircode_prefix string, locality string, area_slug string")
    got = {r["eircode"]: (r["basis"], r["ids"]) for r in M.planning_fallback(asked, spark.createDataFrame(plans, PLAN), areas, rivals).collect()}
    assert got == {"1": ("area", [1, 10]), "2": ("routing-key", [6, 5]), "3": ("locality", [7]), "4": ("none", []), "5": ("none", []), "6": ("none", [])}


def test_exclusions_beyond_their_room(spark, areas):
    plans = spark.createDataFrame([filed(i, "P25", location="x", day=date(2025, 1, 1 + i % 28)) for i in range(80)], PLAN)
    gone = [r["id"] for r in plans.orderBy(F.desc("registration_date"), F.desc("reference")).limit(28).collect()]
    asked = spark.createDataFrame([("1", "P25", "Cork", None, None, gone)], "eircode string, routing_key string, county string, locality string, area_slug string, excluded array<long>")
    none = spark.createDataFrame([], "eircode_prefix string, locality string, area_slug string")
    row = M.planning_fallback(asked, plans, areas, none).first()
    assert row["basis"] == "routing-key" and len(row["ids"]) == 3  # 31 rows are looked at, 28 of them excluded


def test_market_bundle(spark, curated, areas):
    sold = [("P43 W000", "Cork", "Carrigaline", "carrigaline", DAY)] + [("P43", "Cork", "Carrigaline", "carrigaline", date(2024, 1, 1 + i)) for i in range(10)]
    plans = [filed(i, "P43", location="Carrigaline") for i in range(3)] + [filed(9, "P43 W000", location="Carrigaline", day=date(2026, 1, 1))]
    rows, apps = sales(spark, sold), spark.createDataFrame(plans, PLAN)
    context = M.postcode_context(spark.createDataFrame([("P43 W000",), ("P43 VVVV",)], "eircode string"), rows, apps, M.routing_areas(rows, curated), areas)
    got = {r["eircode"]: r for r in M.market_bundles(context, rows, apps, areas).collect()}
    own, other = got["P43 W000"], got["P43 VVVV"]
    assert (own["level"], own["n_sales"], own["median_price"], own["recent_sales"], own["planning_ids"]) == ("area", 11, 500.0, [10, 9, 8, 7, 6, 5, 4, 3], [2, 1, 0])
    assert (other["level"], other["recent_sales"], other["planning_basis"], other["planning_ids"]) == ("routing-area", [0, 10, 9, 8, 7, 6, 5, 4], "area", [9, 2, 1, 0])


def test_empty_tables(spark, curated, areas):
    rows, plans = sales(spark, []), spark.createDataFrame([], PLAN)
    context = M.postcode_context(spark.createDataFrame([("P43 W000",), (None,)], "eircode string"), rows, plans, M.routing_areas(rows, curated), areas)
    assert [r["source"] for r in context.collect()] == ["none"] and M.market_bundles(context, rows, plans, areas).count() == 0


def test_authorities_and_counties(spark):
    rows = spark.createDataFrame([("FINGAL", "dublin"), ("DLR", "CORK"), ("MAYO", "Atlantis"), (None, None)], "a string, c string")
    got = [tuple(r) for r in rows.select(places.authority_county(F.col("a")), places.county_authorities(F.col("c"))).collect()]
    assert got == [("Dublin", ["DLR", "DUBLINCITY", "FINGAL", "SOUTHDUBLIN"]), ("Dublin", ["CORKCITY", "CORKCO" "CO"]), ("Mayo", []), (None, [])]


def test_tokens_and_unique_places(spark):
    def of(text):
        return spark.createDataFrame([(text,)], "t string").select(T.tokens(F.col("t")).alias("x")).first()["x"]

    assert of("Dún  Laoghaire-Rathdown") == "dun laoghaire rathdown" and of("Dún") == "dun" and of("Ō ş ǎ ß") == "o s a" and of(None) == ""
    names = spark.createDataFrame([("Dublin", "dun-laoghaire", "Dún Laoghaire"), ("Mayo", "newport", "Newport"), ("Tipperary", "newport", "Newport")], "county string, area_slug string, area_label string")
    asked = spark.createDataFrame([("dun laoghaire!",), ("NEWPORT",), ("",)], "query string")
    assert [tuple(r) for r in X.unique_place(asked, names).collect()] == [("dun laoghaire!", "Dublin", "dun-laoghaire")]


def test_latest_of_many_with_one_location(spark, areas):
    """Of a location's many rows only the latest are kept and its text is looked into once; before, names met every row."""
    plans = [filed(i, None, location=t, day=date(2025, 1 + i // 28, 1 + i % 28)) for i, t in enumerate(["1 Main Road, Midleton", "Ringaskiddy, Midleton", "Cork"] * 40)]
    plans += [filed(200, None, None, "Midleton"), filed(201, None, location=None)]
    asked = spark.createDataFrame([("1", "P25", "Cork", "Midleton", "midleton", [117, 114]), ("2", "P26", "Cork", "Midleton", None, None)], "eircode string, routing_key string, county string, locality string, area_slug string, excluded array<long>")
    rivals = spark.createDataFrame([("P25", "Ringaskiddy", "ringaskiddy")], "eircode_prefix string, locality string, area_slug string")
    found = M.planning_fallback(asked, spark.createDataFrame(plans, PLAN), areas, rivals)
    assert {r["eircode"]: (r["basis"], r["ids"]) for r in found.collect()} == {"1": ("area", [111, 108, 105, 102, 99, 96]), "2": ("locality", [118, 117, 115, 114, 112, 111])}
    assert "inline(rows" in found._jdf.queryExecution().optimizedPlan().toString()


def test_bundle_of_a_location_with_many_rows(spark, curated, areas):
    """Applications of one location come to the bundle as one text with its latest rows; before, names met every row."""
    sold = [("P43 W000", "Cork", "Carrigaline", "carrigaline", DAY)] + [("P43", "Cork", "Carrigaline", "carrigaline", date(2024, 1, 1 + i)) for i in range(10)]
    plans = [filed(i, "P43", location="Carrigaline", day=date(2025, 1 + i // 28, 1 + i % 28)) for i in range(90)] + [filed(90 + i, "P43 W000", location="Carrigaline", day=date(2026, 1, 1 + i)) for i in range(27)]
    rows, apps = sales(spark, sold), spark.createDataFrame(plans, PLAN)
    context = M.postcode_context(spark.createDataFrame([("P43 W000",)], "eircode string"), rows, apps, M.routing_areas(rows, curated), areas)
    found = M.market_bundles(context, rows, apps, areas)
    row = found.first()
    assert (row["n_sales"], row["median_price"], row["planning_basis"], row["planning_ids"]) == (11, 500.0, "area", [91, 90, 89, 88, 87, 86])
    assert "inline(rows" in found._jdf.queryExecution().optimizedPlan().toString()


def test_late_rows_are_all_that_an_answer_needs(spark, monkeypatch):
    """Before, every row was sorted; now days that enough later rows of the scope precede fall first."""
    rows = [(s, None if i % 50 == 49 else date(2024, 1 + i // 28 % 12, 1 + i % 28), i) for s in ("A", None) for i in range(300)] + [("B", None, i) for i in range(40)]
    frame = spark.createDataFrame(rows, "s string, day date, id long")
    order = [F.desc_nulls_last("day"), F.desc("id")]
    late = M._late(frame, ["s"], F.unix_date("day"))
    left = {r["s"]: r["n"] for r in late.groupBy("s").agg(F.count("*").alias("n")).collect()}
    assert left["A"] == left[None] and M.RANKED <= left["A"] < M.RANKED + 5 and left["B"] == 40

    def first(found):
        return sorted((r["s"] or "", r["place"], r["id"]) for r in M._first(found, ["s"], order).collect())

    assert first(late) == first(frame) and len(first(frame)) == 3 * M.RANKED
    assert first(M._late(frame, ["s"], F.year("day"))) == first(frame)
    monkeypatch.setattr(M, "FEW_SCOPES", 2)
    assert M._late(frame, ["s"], F.unix_date("day")).count() == len(rows)


def test_statistics_of_a_bundle_are_counted_by_price(spark, curated, areas):
    """Sales without a price count but have no part in the median; no task holds all prices of an area, as it did before."""
    sold = [("P43", "Cork", "Carrigaline", "carrigaline", date(2024, 1, 1 + i % 28)) for i in range(60)] + [("P43", " ", "Carrigaline", "carrigaline", DAY)]
    rows = sales(spark, sold).withColumn("price_eur", F.when(F.col("id") % 3 > 0, (F.col("id") % 4) * 10.0))
    context = M.postcode_context(spark.createDataFrame([("P43 VVVV",)], "eircode string"), rows, spark.createDataFrame([], PLAN), M.routing_areas(rows, curated), areas)
    found = M.market_bundles(context, rows, spark.createDataFrame([], PLAN), areas)
    row = found.first()
    assert (row["n_sales"], row["median_price"], row["recent_sales"][:2], row["planning_basis"]) == (60, 15.0, [55, 27], "none")
    assert "percentile" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_orders_meet_their_households_once(spark):
    """Steps of the bundles read what one join wrote; before, each joined orders and customers anew."""
    plan = registry.QUERIES["x12_market_bundles"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderkey" not in plan and "c_custkey" not in plan
