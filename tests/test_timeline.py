"""Golden rows for corrections, decision wordings and the order of public timelines."""

from datetime import date, datetime

from parcelflow.operators import timeline as L

SCHEMA = "application_id int, event_type string, event_date date, detected_at timestamp, source_field string, label string, old_value string, new_value string, event_key string"
T0 = datetime(2026, 8, 18)


def event(kind, day, field, key, label="x", old=None, new=None, at=T0, app=1):
    return (app, kind, date.fromisoformat(day), at, field, label, old, new, key)


def shown(spark, *events):
    return [(r["label"], str(r["event_date"]), r["place"]) for r in L.public_timeline(spark.createDataFrame(list(events), SCHEMA)).orderBy("application_id", "place").collect()]


def corrected(key, old, new, at=T0, field="registration_date"):
    return event("source_date_corrected", "2026-08-18", field, key, old=old, new=new, at=at)


RECEIVED = event("application_received", "2026-06-14", "registration_date", "a", "Application received")
DECISION = event("decision_made", "2026-08-13", "decision_date", "d", "Decision made")


def test_corrections_are_followed_in_order_of_detection(spark):
    assert shown(spark, RECEIVED, corrected("c", "2026-06-14", "2026-06-15")) == [("Application received", "2026-06-15", 1)]
    chain = [corrected("z", "2026-06-15", "2026-06-20", datetime(2026, 9, 1)), corrected("y", "2026-06-14", "2026-06-15"), corrected("x", "2026-01-01", "2026-02-02"), corrected("w", "2026-06-14", "2026-13-40"), corrected("v", "2026-06-14", "2026-06-01", field="valid_date")]
    assert shown(spark, RECEIVED, *chain) == [("Application received", "2026-06-20", 1)]
    late = [corrected("b", "2026-06-15", "2026-06-20"), corrected("c", "2026-06-14", "2026-06-15")]
    assert shown(spark, RECEIVED, *late) == [("Application received", "2026-06-15", 1)]  # the second comes too late for the first


def test_decisions_take_their_wording(spark):
    change = event("decision_changed", "2026-08-19", "decision_text", "e", old=None, new=" Refused ")
    status = event("status_changed", "2026-08-19", "status", "s", old="registered", new="decision_made")
    assert shown(spark, RECEIVED, DECISION, change, status) == [("Application received", "2026-06-14", 1), ("Decision: Refused", "2026-08-13", 2)]
    assert shown(spark, DECISION, event("decision_changed", "2026-08-19", "decision_text", "g", old="Grant permission", new="Refused")) == [("Decision made", "2026-08-13", 1)]
    assert shown(spark, DECISION, event("decision_changed", "2026-08-19", "decision_text", "g", old="n/a", new="Unknown")) == [("Decision made", "2026-08-13", 1)]
    assert shown(spark, change) == [] and shown(spark, event("decision_due_changed", "2026-08-19", "decision_due_date", "q")) == []
    second = event("decision_made", "2026-08-20", "decision_date", "d2", "Decision made")
    assert shown(spark, second, DECISION, change) == [("Decision: Refused", "2026-08-13", 1), ("Decision made", "2026-08-20", 2)]


def test_order_and_other_applications(spark):
    rows = [event("final_grant", "2026-08-13", "final_grant_date", "f", "Final grant"), DECISION, event("works_commenced", "2026-08-13", None, "w", "Works"), event("decision_made", "2026-01-01", None, "n", "No source", app=2), event("decision_changed", "2026-01-01", "decision_text", "m", new="Granted", app=2)]
    assert shown(spark, *rows) == [("Decision made", "2026-08-13", 1), ("Final grant", "2026-08-13", 2), ("Works", "2026-08-13", 3), ("No source", "2026-01-01", 1)]
    assert shown(spark, corrected("c", "2026-06-14", "2026-06-15")) == []
