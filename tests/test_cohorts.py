"""Hand-made rows for locality candidates, cohort refreshes, page paths, accents and radius search."""

import math
import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from parcelflow.functions import places
from parcelflow.functions import text as T
from parcelflow.operators import cohorts as C
from parcelflow.operators import pages, search

TODAY = date(2024, 6, 1)
MEMBER = "surface string, path string, entered date, left date, score double"
CANDIDATE = "surface string, path string, label string, score double"


def test_candidates(spark):
    day = date(2024, 1, 1)
    sold = [("Cork", s, day) for s in ("midleton", "cork", "janeville", "x1", "ab", "st-john-s", "P.O.", "dublin") for _ in range(12)] + [("Cork", "few", day)] * 11 + [("Cork", "old", date(2021, 5, 31))] * 12
    apps = [(a, t, d) for a, t, d, n in [("DLR", "Foxrock", day, 8), ("MAYO", "Ballina", date(2022, 5, 1), 8), ("MAYO", "Ireland", day, 9), ("MAYO", "Cork", day, 9), ("MAYO", "Co. Cork", day, 9), ("MAYO", "The Post Office", day, 9), ("MAYO", "Dublin 4", day, 9), ("MAYO", "—", day, 9), ("ATLANTIS", "Naas", day, 9), ("MAYO", None, day, 9), ("MAYO", "Few", day, 7)] for _ in range(n)]
    got = C.locality_candidates(spark.createDataFrame(sold, "county string, area_slug string, date_of_sale date"), spark.createDataFrame(apps, "authority string, locality string, registration_date date"), TODAY)
    assert {r["path"]: (r["label"], round(r["score"], 4)) for r in got.collect()} == {
        "/sold-prices/cork/midleton": ("Midleton", round(math.log(12) * 20 + 30, 4)),
        "/sold-prices/cork/st-john-s": ("St John S", round(math.log(12) * 20 + 30, 4)),
        "/planning/dun-laoghaire-rathdown/areas/foxrock": ("Foxrock", round(math.log(8) * 20 + 30, 4)),
        "/planning/mayo/areas/ballina": ("Ballina", round(math.log(8) * 20, 4)),
    }


def refresh(spark, members, candidates, **limits):
    rows = [(s, p, TODAY - timedelta(days=d), left, score) for s, p, d, left, score in members]
    out = C.refreshed(spark.createDataFrame(rows, MEMBER), spark.createDataFrame([(s, p, "x", v) for s, p, v in candidates], CANDIDATE), TODAY, **limits)
    return {(r["surface"], r["path"], r["entered"]): (r["left"], r["score"]) for r in out.collect()}


def test_full_cohorts_without_old_members_rest(spark):
    members = [("a", "m1", 10, None, 1.0), ("a", "m2", 41, None, 1.0), ("b", "m1", 42, None, 1.0), ("b", "m2", 1, None, 1.0)]
    got = refresh(spark, members, [("a", "new", 99.0), ("b", "new", 99.0), ("b", "m2", 5.0)], size=2, rotation=1)
    assert got == {
        ("a", "m1", TODAY - timedelta(days=10)): (None, 1.0),
        ("a", "m2", TODAY - timedelta(days=41)): (None, 1.0),
        ("b", "m1", TODAY - timedelta(days=42)): (TODAY, 1.0),
        ("b", "m2", TODAY - timedelta(days=1)): (None, 5.0),
        ("b", "new", TODAY): (None, 99.0),
    }


def test_young_members_and_newcomers_compete_and_rotation_is_bounded(spark):
    members = [("a", "young", 5, None, 9.0), *(("a", f"old{i}", 60, None, float(i)) for i in range(4)), ("a", "gone", 90, TODAY - timedelta(days=30), 3.0)]
    candidates = [("a", "young", 50.0), ("a", "n1", 60.0), ("a", "n2", 40.0), ("a", "gone", 55.0), ("a", "old3", 7.0), ("a", "old0", 100.0)]
    got = refresh(spark, members, candidates, size=3, rotation=2)
    old = TODAY - timedelta(days=60)
    assert got == {
        ("a", "young", TODAY - timedelta(days=5)): (None, 50.0),
        ("a", "old0", old): (TODAY, 0.0),
        ("a", "old1", old): (TODAY, 1.0),
        ("a", "old2", old): (None, 2.0),
        ("a", "old3", old): (None, 7.0),
        ("a", "gone", TODAY - timedelta(days=90)): (TODAY - timedelta(days=30), 3.0),
        ("a", "n1", TODAY): (None, 60.0),
        ("a", "gone", TODAY): (None, 55.0),
    }
    assert refresh(spark, [], [], size=3) == {}


def test_limits():
    assert [C.bounded(*a) for a in ((None, 100, 500), (0, 100, 500), (999, 100, 500), (7, 100, 500))] == [100, 1, 500, 7] and C.bounded(0, 20, 40, least=0) == 0


def test_paths(spark):
    apps = spark.createDataFrame([(1, "DLR", "25/1 A"), (2, "MAYO", "P24é")], "id int, authority string, reference string")
    slug = spark.range(1).select(T.reference_slug(F.lit("25/1 A")).alias("a"), T.reference_slug(F.lit("P24é")).alias("b")).first()
    good = f"https://x.org/planning/dun-laoghaire-rathdown/{slug['a']}/?q=1#t"
    paths = [good, f"/planning/mayo/{slug['b'].replace('-', '%2D')}", f"/planning/dlr/{slug['a']}", "/planning/mayo/P24é", f"/planning/mayo/{slug['b']}/map", "/sold-prices/mayo/ballina", "/planning/mayo/%zz", None]
    got = {r["path"]: (r["id"], r["class"]) for r in pages.resolved_paths(spark.createDataFrame([(p, 1) for p in paths], "path string, views int"), apps).collect()}
    assert got == {paths[0]: (1, "FOUND"), paths[1]: (2, "FOUND"), paths[2]: (None, "FAIL"), paths[3]: (None, "FAIL"), paths[6]: (None, "FAIL")}


def test_accents(spark):
    areas = spark.createDataFrame([("Dublin", "Dún Laoghaire", "dun-laoghaire", 100), ("Dublin", "Dalkey", "dalkey", 50)], "county string, label string, area_slug string, sales_count long")
    first = search.suggested_places(areas, "dun laoghaire").first()
    assert first["label"] == "Dún Laoghaire" and first["score"] == round(1300 + math.log10(101) * 35, 6)
    sold = spark.createDataFrame([("12 Dún St", date(2020, 1, 1), 1.0), ("12 Dun Street", date(2021, 1, 1), 1.0)], "address string, date_of_sale date, price_eur double")
    assert [r["score"] for r in search.rank_addresses(sold, "12 dún st").collect()] == [1800, 800]


def test_authority_paths(spark):
    rows = spark.createDataFrame([("CORKCITY",), ("FINGAL",), ("X",)], "a string").select(places.authority_slug(F.col("a")).alias("s"))
    assert [tuple(r) for r in rows.select("s", places.authority_of_slug(F.col("s"))).collect()] == [("cork-city", "CORKCITY"), ("fingal", "FINGAL"), (None, None)]


def test_radius_anywhere(spark):
    rnd = random.Random(4)
    spots = []
    for i in range(60):
        lat, lng = rnd.choice([0.0, 53.3, 70.0, -80.0, 89.9]), rnd.choice([0.0, -6.2, 179.99, -179.99])
        spots += [(10 * i + k, lat + rnd.uniform(-0.09, 0.09), (lng + rnd.uniform(-0.4, 0.4) + 180) % 360 - 180) for k in range(4)]
    spots = [(i, max(-90.0, min(90.0, a)), b) for i, a, b in spots]

    def km(p, q):
        f, g, d = math.radians(p[1]), math.radians(q[1]), math.radians(q[2] - p[2])
        h = math.sin((g - f) / 2) ** 2 + math.cos(f) * math.cos(g) * math.sin(d / 2) ** 2
        return 2 * 6371.0088 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    points = spark.createDataFrame(spots, "id int, lat double, lng double")
    want = {(p[0], q[0]) for p in spots for q in spots if p[0] != q[0] and km(p, q) <= 10}
    found = [(r["origin"], r["point"]) for r in search.within_km(points, points, 10.0).collect()]
    assert len(found) == len(set(found)) and set(found) == want
    top = search.within_km(points, points.where("id < 50"), 10.0, most=2).collect()
    for origin in {o for o, _ in want if o < 50}:
        near = sorted((round(km(spots_by[origin], spots_by[q]), 6), q) for o, q in want if o == origin) if (spots_by := {s[0]: s for s in spots}) else []
        assert [q for _, q in near[:2]] == [q for _, q in sorted((r["distance_km"], r["point"]) for r in top if r["origin"] == origin)]


def test_points_of_one_position(spark):
    """Copies of a position beyond one set all come, and meet an origin as sets; before, each was measured on its own."""
    spots = [(i, 53.3, -6.2) for i in range(2 * search.TOGETHER + 3)] + [(9000, 53.3, -6.21), (9001, None, -6.2), (9002, 54.3, -6.2)]
    points = spark.createDataFrame(spots, "id int, lat double, lng double")
    near = search.within_km(points, points.where("id in (5, 9000, 9001)"), 5.0)
    found = {(r["origin"], r["point"]) for r in near.collect()}
    here = set(range(2 * search.TOGETHER + 3))
    assert near.count() == len(found) and found == {(5, i) for i in here - {5} | {9000}} | {(9000, i) for i in here}
    assert [r["point"] for r in search.within_km(points, points.where("id = 9000"), 5.0, most=2).orderBy("point").collect()] == [0, 1]
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(points") < plan.index("Join Inner") < plan.index("collect_list(point")


def test_candidates_are_made_once(spark):
    """The refresh reads its candidates from the shared folder; before, its plan held the sales and applications behind them many times over."""
    from parcelflow.plans import registry

    plan = registry.QUERIES["w8_residence_cohort"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "o_orderkey" not in plan
