"""Hand-made rows for places, display texts, upkeep and postcode context."""

from datetime import date, datetime

from pyspark.sql import functions as F

from parcelflow.functions import display, places
from parcelflow.operators import upkeep


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_locality(spark):
    def of(location, ward, authority):
        return one(spark, places.locality(F.col("l"), F.col("w"), F.col("a")), l=location, w=ward, a=authority)

    assert of("Site at MALLOW road, Cork", None, "CORKCOCO") == "Mallow"
    assert of("1 Main St, Naas, County Kildare", None, "KILDARE") == "Naas"
    assert of("1 Main St, Naas, Kildare.", None, "KILDARE") == "Naas"
    assert of("Ballina, F26 AB12", None, "MAYO") == "Ballina"
    assert of("Foxrock, Dublin 18", None, "DLR") == "Dublin 18"
    assert of("12", "The Municipal District of: Trim", "MEATH") == "Trim"
    assert of("12", "Municipal Districts: Trim", "MEATH") == "Trim"
    assert of("", " ", "MEATH") is None and of(None, None, None) is None


def test_names_are_whole_tokens(spark):
    def has(location, name):
        return one(spark, places.contains_name(F.col("l"), F.col("n")), l=location, n=name)

    assert has("Old  Town, Naas", "old town") and has("Naas", "NAAS") and has("a (b) c", "(b)")
    assert not has("Naastown", "Naas") and not has("x", "") and not has(None, "x")
    assert not one(spark, places.in_market(F.col("l"), F.col("n"), F.col("r")), l="Naas Sallins", n="Naas", r=["Sallins"])


def test_pages(spark):
    def of(url):
        return one(spark, places.page_surface(F.col("u")), u=url)

    assert of("https://x.org/sold-prices/mayo/ballina/?a=1") == "sold" and of("/planning/mayo/areas/ballina") == "planning"
    assert of("https://x.org/planning/mayo/ballina") is None and of(None) is None


def test_display(spark):
    def case(text):
        return one(spark, display.display_case(F.col("t")), t=text)

    assert case("THE  HILL OF TARA-SKREEN RD") == "the Hill of Tara-Skreen Rd" and case("Mixed  CASE") == "Mixed CASE" and case(None) == "" and case("12") == "12"

    def label(a, place, c, s):
        return one(spark, display.sale_label(F.col("a"), F.col("l"), F.col("c"), F.col("s")), a=a, l=place, c=c, s=s)

    assert label("1 MAIN ST, , NAAS", None, None, None) == "1 Main St, Naas"
    assert label(None, "NAAS", "KILDARE", None) == "Naas, Kildare" and label(None, "Mayo", "MAYO", None) == "Mayo"
    assert label(None, None, "Mayo", "west-port") == "West Port, Mayo" and label(None, None, None, None) == "Nearby sale"


def test_gates(spark):
    def due(value, state, done):
        return one(spark, display.due_shown(F.col("d"), F.col("s"), F.col("x")), d=value, s=state, x=done)

    assert due("2024-02-29", "registered", None) == date(2024, 2, 29) and due("2024-02-29", None, None) == date(2024, 2, 29)
    assert due("2023-02-29", "registered", None) is None and due("2024-02-29", "decision_made", None) is None
    assert due("2024-02-29", "registered", "2024-01-01") is None and due("2024-2-9", "registered", None) is None
    council = lambda raw, state: one(spark, display.council_status(F.col("r"), F.col("s")), r=raw, s=state)
    assert council("withdrawn", "withdrawn") is None and council("held over", "unknown") == "Held over" and council("n/a", "unknown") is None
    assert one(spark, display.search_terms(F.col("t")), t=" a, b,a ,") == ["a, b,a ,", "a", "b"]
    found = lambda v, c, s: one(spark, display.is_discovered(F.col("v"), F.col("c"), F.lit(None).cast("string"), F.col("s"), F.array().cast("array<string>")), v=v, c=c, s=s)
    assert found("PASS", None, []) and found(None, None, ["m"]) and found(None, "Crawled", []) and not found(None, "URL is unknown to Google", []) and not found(None, None, [])


def test_decision_changes(spark):
    schema = "id long, decision_text string, decision_date date, decision_due_date date"
    d = date(2024, 1, 1)
    old = spark.createDataFrame([(1, "Grant", d, None), (2, None, None, d), (3, "a", d, d), (4, "b", d, None)], schema)
    new = spark.createDataFrame([(1, " GRANT ", d, d), (2, "refused", d, None), (3, " ", d, d), (5, "x", d, d)], schema)
    rows = {(r["application_id"], r["event_type"]): r for r in upkeep.decision_changes(old, new, d).collect()}
    assert set(rows) == {(2, "decision_due_changed"), (3, "decision_changed")}
    assert rows[2, "decision_due_changed"]["label"] == "Decision due date removed from source" and rows[3, "decision_changed"]["label"] == "Decision updated"


def test_updates_and_revisions(spark):
    stored = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, None, None)], "id long, p string, q string")
    incoming = spark.createDataFrame([(1, "a", None), (2, None, "x"), (9, "z", "z")], "id long, p string, q string")
    assert {tuple(r) for r in upkeep.updated(stored, incoming, "id", ["p", "q"]).collect()} == {(1, "a", None, False), (2, None, "x", True), (3, None, None, False)}
    assert {tuple(r) for r in upkeep.known_kept(stored, incoming, "id", ["p", "q"]).collect()} == {(1, "a", None), (2, "b", "x"), (9, "z", "z")}
    then, now = datetime(2020, 1, 1), datetime(2024, 1, 1)
    out = upkeep.revised(stored.withColumn("updated_at", F.lit(then)), incoming, "id", ["p", "q"], now)
    assert {(r["id"], r["updated_at"]) for r in out.collect()} == {(1, then), (2, now), (9, now)}


def test_search_rules(spark):
    from parcelflow.operators import search

    for text, kind in {"25-123": "reference", "1234567": "reference", "24/A12": "reference", "D6W XY12": "postcode", "Apt 12": "address", "a1": "area", "Naas": "area"}.items():
        assert one(spark, search.intent(F.col("t")), t=text) == kind, text
    areas = spark.createDataFrame(
        [("Cork", "Carrigaline", "carrigaline", 900), ("Cork", "Carrigaline Rd", "carrigaline-rd", 3), ("Cork", "Carrigaline Road", "carrigaline-road", 9), ("Cork", "Carrig Hill", "carrig-hill", 200), ("Cork", "Tower", "tower", 100)],
        "county string, label string, area_slug string, sales_count long",
    )
    assert [r["label"] for r in search.suggested_places(areas, "carrigaline").collect()] == ["Carrigaline", "Tower", "Carrig Hill"]
    exact = search.suggested_places(areas, "Carrigaline road").collect()
    assert exact[0]["label"] == "Carrigaline Road" and exact[0]["score"] == round(1080 + 35.0, 6)
    streets = areas.where("label like '% R%'")
    assert [r["label"] for r in search.suggested_places(streets, "x").collect()] == ["Carrigaline Road"]
    sold = spark.createDataFrame([("1 Main St", date(2020, 1, 1), 1.0), ("1 Main St.", date(2021, 1, 1), 1.0), ("1 Main Street", date(2022, 1, 1), 1.0), (None, date(2023, 1, 1), 1.0)], "address string, date_of_sale date, price_eur double")
    assert [(r["address"], r["score"]) for r in search.rank_addresses(sold, "1 main st", 4).collect()] == [("1 Main St.", 1800), ("1 Main St", 1800), ("1 Main Street", 800), (None, 0)]


def test_a_label_names_each_text_once_in_its_plan(spark):
    """Before, every mention of a cased text was an expression of its own: hundreds of them, each evaluated for each row."""
    rows = spark.createDataFrame([("MAYO", "1 MAIN ST", None, None), ("MAYO", None, "NAAS", None), ("MAYO", None, "NAAS", None), ("MAYO", None, None, None)], "county string, address string, locality string, area_slug string")
    found = display.sale_labels(rows)
    assert [tuple(r) for r in found.collect()] == [("MAYO", 3, "1 Main St")]
    plan = rows.select(display.sale_label(F.col("address"), F.col("locality"), F.col("county"), F.col("area_slug")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 12
