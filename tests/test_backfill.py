"""Hand-made rows for the lifecycle backfill."""

from datetime import date, datetime

from parcelflow.operators import backfill as B

FIELDS = ", ".join(f"{f} date" for f in B.FIELDS)
STORED = f"id long, local_authority_code string, reference string, note string, {FIELDS}, updated_at timestamp"
INCOMING = f"local_authority_code string, reference string, source_application_id long, {FIELDS}"
OLD, NOW, D, E = datetime(2020, 1, 1), datetime(2024, 1, 1), date(2023, 1, 1), date(2023, 2, 2)


def dates(**given):
    return tuple(given.get(f) for f in ("requested", "received", "withdrawal", "due", "expiry", "lodged", "decided"))


def test_backfill(spark):
    stored = spark.createDataFrame([(1, "MAYO", "a", "n", *dates(due=D), OLD), (2, "MAYO", "b", None, *dates(lodged=D), OLD), (3, "CORK", "a", None, *dates(expiry=D), OLD), (4, "CORK", "c", None, *dates(), OLD)], STORED)
    incoming = spark.createDataFrame(
        [(" mayo ", "a ", 5, *dates(due=E, requested=D)), ("MAYO", "a", None, *dates(withdrawal=D)), ("MAYO", "a", 4, *dates(withdrawal=D)), ("mayo", "b", 1, *dates(lodged=E, decided=E)), ("CORK", "a", 1, *dates(expiry=D)), ("", "a", 9, *dates(requested=D)), ("CORK", None, 9, *dates(requested=D)), ("CORK", "zz", 9, *dates(requested=D))],
        INCOMING,
    )
    known = spark.createDataFrame([(2, f"source:appeal_decision_date:{E}")], "application_id long, event_key string")
    out = B.backfill(stored, incoming, known, NOW)
    rows = {r["id"]: r for r in out.applications.collect()}
    assert out.applications.columns == stored.columns
    assert (rows[1]["decision_due_date"], rows[1]["further_information_requested_date"], rows[1]["withdrawal_date"], rows[1]["note"], rows[1]["updated_at"]) == (E, D, None, "n", NOW)
    assert (rows[2]["appeal_lodged_date"], rows[2]["appeal_decision_date"], rows[2]["updated_at"]) == (E, E, NOW)
    assert rows[3]["updated_at"] == rows[4]["updated_at"] == OLD
    assert [(r["application_id"], r["event_type"], r["event_date"], r["event_key"]) for r in out.events.collect()] == [(1, "further_information_requested", D, f"source:further_information_requested_date:{D}")]
    assert {r["name"]: r["n"] for r in out.report.collect()} == {
        "submitted": 8, "matched": 3, "updated": 2, "events inserted": 1, "applications enriched": 1, "event further_information_requested": 1,
        "field further_information_requested_date": 1, "field decision_due_date": 1, "field appeal_lodged_date": 1, "field appeal_decision_date": 1,
    }


def test_empty(spark):
    out = B.backfill(spark.createDataFrame([], STORED), spark.createDataFrame([], INCOMING), spark.createDataFrame([], "application_id long, event_key string"), NOW)
    assert {r["name"]: r["n"] for r in out.report.collect()} == {"submitted": 0, "matched": 0, "updated": 0, "events inserted": 0, "applications enriched": 0}
    assert out.applications.count() == out.events.count() == 0
