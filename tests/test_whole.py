"""Operators do the whole job: every row, every order of arrival, every length."""

import datetime
import os
import random

import pytest

from parcelflow.operators import measure, search
from parcelflow.plans import registry
from parcelflow.plans.mapping import SALES_AS_OF, applications
from parcelflow.streaming import windows

D = datetime.date
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@tables
def test_ranges_count_every_application(spark):
    got = registry.QUERIES["w6_active_ranges_all"](spark, SF).agg({"rows": "sum"}).first()[0]
    assert got == applications(spark, SF).where(f"registration_date <= date '{SALES_AS_OF}'").count()


@tables
def test_round_trip_takes_every_position(spark):
    r = registry.QUERIES["g2_g3_grid_round_trip_all"](spark, SF).first()
    assert r.n + r.outside == applications(spark, SF).count() and r.n > r.outside and r.worst_metre <= 0.01


def changes_of(rows):
    """By brute force: rows are (event_id, user_id, event_type, minute)."""
    last, out = {}, []
    for event, user, kind, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        if user in last and last[user] != kind:
            out.append((user, event, last[user], kind))
        last[user] = kind
    return sorted(out)


def event_files(spark, folder, parts):
    schema = "event_id long, user_id long, event_type string, minute long"
    for k, part in enumerate(parts):
        rows = spark.createDataFrame(part, schema).coalesce(1)
        rows.selectExpr("event_id", "user_id", "event_type", "timestamp_seconds(1700000000 + minute * 60) as ts").write.mode("append").parquet(f"{folder}/{k:02}")
    return "event_id long, user_id long, event_type string, ts timestamp"


def test_changes_of_a_hot_user_in_shuffled_files(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, 1 if k < 25_000 else k % 7, rng.choice("abc"), rng.randrange(30_000)) for k in range(26_000)]
    rng.shuffle(rows)
    schema = event_files(spark, tmp_path, [rows[k::3] for k in range(3)])
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/*")
    got = windows.type_changes(spark, stream).collect()
    assert sorted(map(tuple, got)) == changes_of(rows)


def test_changes_over_micro_batches_that_overlap(spark, tmp_path):
    rng = random.Random(6)
    rows = [(k, k % 3, rng.choice("ab"), k * 10) for k in range(900)]
    parts = [[], [], []]
    for r in rows:
        parts[min(2, max(0, (r[0] + rng.randrange(-50, 50)) // 300))].append(r)
    schema = event_files(spark, tmp_path, parts)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*")
    assert sorted(map(tuple, windows.type_changes(spark, stream, "1 day").collect())) == changes_of(rows)
    with pytest.raises(Exception, match="LateRows"):
        windows.type_changes(spark, stream, "1 minute")


def test_labels_of_any_length(spark):
    names = ["bay", "one two three four five", "one two three four five six", "a b c d e f g h"]
    places = [(1, "By One-Two, three four five six"), (2, "x one two three four five y"), (3, "A b c d e f g h, Bay"), (4, "bay"), (5, "a b c d e f g"), (6, None)]
    found = search.longest_label(spark.createDataFrame(places, "id int, location string"), spark.createDataFrame([(n,) for n in names], "label string"))
    assert {r.id: r.label for r in found.collect()} == {1: names[2], 2: names[1], 3: names[3], 4: "bay"}
