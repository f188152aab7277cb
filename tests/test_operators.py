"""Operators on hand-made frames: gates at n - 1 and n, ties, nulls, corrections, queues."""

import datetime

from pyspark.sql import functions as F

from parcelflow.operators import measure, planning, sales, search
from parcelflow.sources import files

D = datetime.date


def sale(day, price, county="Cork", area="midleton", new=None):
    return (day, float(price), county, area, "P25", new, "x", "y")


SALES = "date_of_sale date, price_eur double, county string, area_slug string, eircode_prefix string, is_new_dwelling boolean, locality string, address string"


def test_gates_and_splits(spark):
    as_of = D(2024, 6, 28)
    rows = [sale(D(2024, 1, 1 + k), 100 + k, new=[True, False, None][k % 3]) for k in range(24)] + [sale(D(2023, 1, 1 + k), 100) for k in range(24)]
    rows += [sale(D(2024, 1, 1 + k), 100, county="Kerry") for k in range(23)] + [sale(D(2023, 1, 1 + k), 100, county="Kerry") for k in range(24)]
    got = {r.county: r for r in sales.insights(spark.createDataFrame(rows, SALES), ["county"], as_of).collect()}
    cork, kerry = got["Cork"], got["Kerry"]
    assert (cork.sales_12m, cork.previous_12m, cork.median_price) == (24, 24, 111.5)
    assert cork.yoy_percent == 11.5 and kerry.yoy_percent is None
    assert cork.days_between_sales == 1.0
    assert cork.new_median == 110.5 and cork.new_premium == -1.0
    assert kerry.new_median is None and kerry.price_p25 == 100.0


def test_peak_month_ties(spark):
    rows = [sale(D(y, m, d), 1) for y in range(2018, 2022) for m in (3, 9) for d in range(1, 5)]
    out = sales.peak_month(spark.createDataFrame(rows, SALES), ["county"]).collect()
    assert [(r.peak_month, r.votes, r.years) for r in out] == [(3, 4, 4)]
    assert sales.peak_month(spark.createDataFrame(rows[:-9], SALES), ["county"], least_years=5).count() == 0


def test_mode_tie_is_null(spark):
    rows = [("a", "x"), ("a", "y"), ("b", "x"), ("b", "x"), ("b", None), ("c", None)]
    got = {r.k: r.mode for r in sales.mode_or_none(spark.createDataFrame(rows, "k string, v string"), ["k"], "v").collect()}
    assert got == {"a": None, "b": "x"}


APPS = "id long, registration_date date, decision_date date, final_grant_date date, state string"


def test_changes_and_corrections(spark):
    old = spark.createDataFrame([(1, D(2024, 1, 1), None, None, "registered"), (2, D(2024, 1, 1), D(2024, 2, 1), None, "decision_made"), (3, D(2024, 1, 1), None, None, "registered")], APPS)
    new = spark.createDataFrame([(1, D(2024, 1, 1), D(2024, 3, 1), None, "decision_made"), (2, D(2024, 1, 1), D(2024, 2, 5), None, "decision_made"), (3, D(2024, 1, 1), None, None, "withdrawn"), (4, D(2024, 3, 1), None, None, "registered")], APPS)
    found = planning.observed_changes(old, new, D(2024, 3, 2))
    got = {(r.application_id, r.event_type): r for r in found.collect()}
    assert set(got) == {(1, "decision_made"), (2, "source_date_corrected"), (3, "status_changed")}
    assert got[(2, "source_date_corrected")].old_value == "2024-02-01"
    history = planning.reconstruct_events(old)
    assert planning.append_events(history, planning.reconstruct_events(old)).count() == 0


def test_active_ranges(spark):
    rows = [("CORKCOCO", D(2026, 1, 15)), ("CORKCOCO", D(2026, 1, 20)), ("CORKCOCO", D(2026, 2, 4)), ("CORKCOCO", D(2026, 4, 9)), ("GALWAYCOCO", D(2026, 8, 11))]
    got = planning.active_ranges(spark.createDataFrame(rows, "authority string, registration_date date"), D(2026, 8, 20)).collect()
    assert sorted(map(tuple, got)) == [("CORKCOCO", D(2026, 1, 1), D(2026, 2, 28), 3, 2), ("CORKCOCO", D(2026, 4, 1), D(2026, 4, 30), 1, 1), ("GALWAYCOCO", D(2026, 8, 1), D(2026, 8, 20), 1, 1)]


def test_changed_fields_ignore_array_order(spark):
    schema = "id int, proposal string, area_ids array<int>"
    old = spark.createDataFrame([(1, "a", [2, 1]), (2, "a", None)], schema)
    new = spark.createDataFrame([(1, "a", [1, 2]), (2, "b", None), (3, "c", [])], schema)
    got = {r.id: (r.change, r.fields) for r in planning.changed_fields(old, new, "id", ["proposal", "area_ids"]).collect()}
    assert got == {1: ("unchanged", []), 2: ("changed", ["proposal"]), 3: ("new", [])}


QUEUE = "id int, status string, attempts int, due_at timestamp, claimed_at timestamp, token string, subscription int, created_at timestamp"


def test_claims_follow_subscription_and_age(spark):
    now = datetime.datetime(2024, 1, 1, 12)
    earlier = now - datetime.timedelta(hours=1)
    rows = [(1, "queued", 0, now, None, None, 1, now), (2, "queued", 0, now, None, None, 1, earlier), (3, "queued", 0, earlier, None, None, 2, earlier), (4, "queued", 0, now, None, None, 1, now)]
    got = {r.id: r for r in measure.claim(spark.createDataFrame(rows, QUEUE), spark.createDataFrame([(1,)], "subscription int"), now, batch=2).collect()}
    assert {k for k, r in got.items() if r.status == "processing"} == {1, 2}  # 3 is disabled, 4 comes after 1
    assert got[1].due_at is None and got[3].due_at == earlier


def test_expired_leases_lose_their_claim(spark):
    now = datetime.datetime(2024, 1, 1, 12)
    old, due = now - datetime.timedelta(minutes=30), now - datetime.timedelta(days=1)
    rows = [(1, "processing", 1, due, old, "t", 1, due), (2, "processing", 5, due, old, "t", 1, due), (3, "processing", 1, due, now, "t", 1, due), (4, "queued", 1, due, None, None, 1, due)]
    got = {r.id: (r.status, r.due_at, r.claimed_at, r.token) for r in measure.expire_leases(spark.createDataFrame(rows, QUEUE), now).collect()}
    assert got == {1: ("queued", now, None, None), 2: ("failed", None, None, None), 3: ("processing", due, now, "t"), 4: ("queued", due, None, None)}


def test_busy_county_sells_every_day(spark):
    as_of = D(2024, 6, 28)
    rows = [sale(D(2024, 1, 1 + k % 3), 100) for k in range(24)] + [sale(D(2024, 1, 1), 100, county="Kerry")] * 24
    rows += [sale(D(2021, 1, 1 + k), 50) for k in range(24)]
    got = {r.county: r for r in sales.insights(spark.createDataFrame(rows, SALES), ["county"], as_of).collect()}
    assert got["Cork"].days_between_sales == 1.0 and got["Kerry"].days_between_sales is None
    assert got["Cork"].three_year_percent is None  # no sales in the year before


def test_shares_are_whole_percents(spark):
    rows = [sale(D(2024, 1, 1), 400_000 if k < 2 else 1) for k in range(21)]  # 9.52 %
    rows += [sale(D(2024, 1, 1), 400_000 if k < 19 else 1, county="Kerry") for k in range(21)]  # 90.48 %
    got = sales.threshold_shares(spark.createDataFrame(rows, SALES), ["county"], D(2024, 6, 28), thresholds=(300_000,)).collect()
    assert {(r.county, r.share) for r in got} == {("Cork", 10.0), ("Kerry", 90.0)}


def test_idle_days_and_the_first_day_count_for_promotion(spark):
    as_of = D(2024, 6, 28)
    first = as_of - datetime.timedelta(days=90)
    rows = [("a", first, 2, 0), ("a", as_of, 0, 0), ("a", D(2024, 6, 1), 0, 0), ("b", first - datetime.timedelta(days=1), 2, 0), ("b", as_of, 2, 0), ("b", D(2024, 6, 1), 0, 0)]
    days = spark.createDataFrame(rows, "page string, day date, clicks long, impressions long")
    got = measure.promotions(days, days.where("false").select("page"), as_of).collect()
    assert [(r.page, r.days, r.clicks) for r in got] == [("a", 3, 2)]


def test_spill_follows_the_candidates_order(spark):
    rows = [(k, ["notable", "recent", "left"][k % 3], k) for k in range(12)]
    got = measure.stratified(spark.createDataFrame(rows, "id int, cohort string, n int"), 5, {"notable": 0.2, "left": 0.2, "recent": 0.0}, [F.asc("n")]).collect()
    assert [r.id for r in got] == [0, 2, 1, 4, 7]  # quotas 1, 1 and the remaining 3
    got = measure.stratified(spark.createDataFrame([(k, "left" if k % 2 else "notable", k) for k in range(6)], "id int, cohort string, n int"), 4, {"notable": 0.25, "left": 0.25, "recent": 0.5}, [F.asc("n")]).collect()
    assert [r.id for r in got] == [0, 1, 2, 3]


def test_names_that_agree_for_long(spark):
    names = ["a" * 70, "a" * 70 + "b", "a" * 64, "b", "", "ab"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r.name for r in df.orderBy(sales._descending("name").desc()).collect()] == sorted(names)


def test_queue_turns(spark):
    now = datetime.datetime(2024, 1, 1, 12)
    rows = [(1, "queued", 0, now, None, None), (2, "queued", 5, now, None, None), (3, "processing", 5, now, now - datetime.timedelta(minutes=30), "t"), (4, "processing", 1, now, now - datetime.timedelta(minutes=29), "u")]
    queue = spark.createDataFrame([(*r, 1, now) for r in rows], QUEUE)
    claimed = {r.id: r for r in measure.claim(queue, spark.createDataFrame([(1,)], "subscription int"), now).collect()}
    assert claimed[1].status == "processing" and claimed[1].attempts == 1 and claimed[1].token and claimed[2].status == "queued"
    assert {r.id: r.status for r in measure.expire_leases(queue, now).collect()} == {1: "queued", 2: "queued", 3: "failed", 4: "processing"}
    results = spark.createDataFrame([(3, "t", True), (4, "stale", True)], "id int, token string, ok boolean")
    assert {r.id: r.status for r in measure.complete(queue, results, now).collect()} == {1: "queued", 2: "queued", 3: "sent", 4: "processing"}


def test_watch_baseline_is_silent(spark):
    state = spark.createDataFrame([(1, "a")], "entity int, status string")
    seen = spark.createDataFrame([(1, "b"), (2, "c")], "entity int, status string")
    after, changes = measure.watch_changes(state, seen, ["status"])
    assert sorted(map(tuple, after.collect())) == [(1, "b"), (2, "c")]
    assert [(r.entity, r.fields) for r in changes.collect()] == [(1, ["status"])]


def test_csv_records(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text('Date of Sale (dd/mm/yyyy),Address,County,Eircode,Price (€),Not Full Market Price?,VAT Exclusive,Description of Property\r\n'
                    '31/12/2020,"1 ""The"" Quay, Midleton, Cork",Cork,p25hx40,"€1,234.50",No,Yes,New Dwelling house\r\n,,,,,,,\r\n01/02/2020,,Cork,,"€5",No,No,x\r\n01/02/2020,"2 Quay, Cork",Cork,bad,"€0",No,No,x\r\n')
    rows = files.sale_records(files.read_csv(spark, str(path))).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.date_of_sale, r.price_eur, r.locality, r.area_slug, r.eircode, r.vat_exclusive, r.is_new_dwelling) == (D(2020, 12, 31), 1234.5, "Midleton", "midleton", "P25 HX40", True, True)
    records = files.sale_records(files.read_csv(spark, str(path)))
    assert files.insert_new(records, records).count() == 0


def test_feature_records(spark):
    row = [(" 25/1 ", "CORK", " a  house ", "Midleton", "Ann", " ", "NEW APPLICATION", 1781481600000, None, None, None)]
    raw = spark.createDataFrame(row, "ApplicationNumber string, PlanningAuthority string, DevelopmentDescription string, DevelopmentAddress string, ApplicantForename string, ApplicantSurname string, ApplicationStatus string, ReceivedDate long, DecisionDate long, GrantDate long, WithdrawnDate long")
    r = files.feature_records(raw).first()
    assert (r.reference, r.proposal, r.applicant_name, r.registration_date, r.decision_date) == ("25/1", "a house", "Ann", D(2026, 6, 15), None)


def test_stratified_quotas(spark):
    rows = [(k, "notable" if k < 2 else "recent", k) for k in range(12)]
    got = measure.stratified(spark.createDataFrame(rows, "id int, cohort string, n int"), 10, {"notable": 0.3, "left": 0.3, "recent": 0.4}, [F.asc("n")]).collect()
    assert len(got) == 10 and {0, 1} <= {r.id for r in got}


def test_exact_percentiles_of_counts(spark):
    """Ranks between values, several counts of a value, null values and a group without any; all of it spread over ranges (before, one task held all values of a group)."""
    from parcelflow.operators import sales as S

    values = [(None if k % 11 == 0 else float(k * k % 97), ("x" if k % 3 else None), k % 4) for k in range(1, 200)]
    rows = spark.createDataFrame([*values, (None, "empty", 1)], "v double, g string, n long")
    counts = rows.groupBy("g", "v").agg(F.sum("n").alias("n"), F.count("*").alias("m"))
    got = {r["g"]: (r["a"], r["b"]) for r in S.exact_percentiles(counts, ["g"], "v", {"a": ("n", 0.9), "b": ("m", 0.5)}).collect()}
    want = {r["g"]: (r["a"], r["b"]) for r in rows.groupBy("g").agg(F.percentile("v", F.lit(0.9), F.col("n")).alias("a"), F.percentile("v", F.lit(0.5)).alias("b")).collect()}
    assert got == want and want["empty"] == (None, None) and None in want
