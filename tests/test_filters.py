"""Hand-made rows for search filters, date windows and replaced tables."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from parcelflow.operators import filters as S
from parcelflow.sources.versions import ReplacedTable

ROWS = [
    (1, "midleton", "P25", "Cork", "Midleton", "1 Main St"),
    (2, "x", "P25", "Cork", None, "2 Main St, MIDLETON"),
    (3, "x", "T12", "Cork", "Ballincollig", "z"),
    (4, None, None, None, None, None),
    (5, "dun-laoghaire", "A96", "Dublin", "100% Town", "a_b"),
    (6, "y", "D6W", "Dublin", "100x Town", "axb"),
]


def test_area_terms():
    got = S.area_terms(" Dún Laoghaire, A96, Co. Dublin , ab")
    assert got == S.AreaTerms(("dun-laoghaire-a96-co-dublin-ab", "dun-laoghaire", "a96", "co-dublin", "ab"), ("A96",), ("Dublin",), ("Dún Laoghaire A96 Co. Dublin ab", "Dún Laoghaire", "A96", "Co. Dublin"))
    assert S.area_terms("Co Dublin, d6w").prefixes == ("D6W",) and S.area_terms("").slugs == ()


def test_area_filters(spark):
    rows = spark.createDataFrame(ROWS, "id int, area_slug string, eircode_prefix string, county string, locality string, address string")
    ids = lambda c: [r["id"] for r in rows.where(c).orderBy("id").collect()]
    assert ids(S.area_filter("Midleton")) == [1, 2] and ids(S.area_filter("midleton", broad=False)) == [1]
    assert ids(S.area_filter("County Cork")) == [1, 2, 3] and ids(S.area_filter("County Cork", counties=None)) == []
    assert ids(S.area_filter("t12, Dún Laoghaire")) == [3, 5] and ids(S.area_filter("")) == []
    assert ids(S.area_filter("a_b")) == [5] and ids(S.broad_area_filter("y", "Main St, Cork")) == [1, 2, 6]


def test_predicates_reach_the_scan(spark, tmp_path):
    spark.createDataFrame(ROWS, "id int, area_slug string, eircode_prefix string, county string, locality string, address string").write.parquet(f"{tmp_path}/t")
    read = spark.read.parquet(f"{tmp_path}/t").where(S.area_terms("P25").prefixes and F.col("eircode_prefix").isin("P25"))
    assert "PushedFilters: [IsNotNull(eircode_prefix), EqualTo(eircode_prefix,P25)]" in read._jdf.queryExecution().toString()


def test_ranges():
    day = date(2024, 2, 29)
    assert S.date_range(day) == (date(2022, 3, 1), day) == S.date_range(day, "nonsense") and S.date_range(day, "last-5-years") == (date(2019, 3, 1), day)
    assert S.date_range(day, "all") == (None, None) and S.date_range(day, "all", until=day) == (None, day)
    assert S.date_windows(date(2024, 1, 1), date(2024, 1, 8), 3) == [(date(2024, 1, 1), date(2024, 1, 3)), (date(2024, 1, 4), date(2024, 1, 6)), (date(2024, 1, 7), date(2024, 1, 8))]


def brute(counts, start, end, days, most):
    out = []

    def look(kind, windows, size):
        for a, b in windows:
            n = sum(c for k, d, c in counts if k == kind and a <= d <= b)
            if n > most and size > 1 and b > a:
                look(kind, S.date_windows(a, b, size // 2), size // 2)
            elif n:
                out.append((kind, a, b, n))

    for kind in {k for k, _, _ in counts}:
        look(kind, S.date_windows(start, end, days), days)
    return sorted(out)


@pytest.mark.parametrize("days,most", [(7, 10), (5, 3), (1, 1), (30, 25)])
def test_windows_are_halved_until_they_fit(spark, days, most):
    start, end = date(2024, 1, 1), date(2024, 2, 9)
    counts = [(k, start + timedelta(days=i), (i * 7 + len(k)) % 6 + (30 if i == 17 else 0)) for k in ("a", "bb") for i in range(40)]
    rows = spark.createDataFrame([(k, d) for k, d, n in counts for _ in range(n)] + [("a", None), ("a", date(2025, 1, 1))], "kind string, d date")
    got = sorted(map(tuple, S.bisected_windows(rows, "d", "kind", start, end, days, most).collect()))
    assert got == brute(counts, start, end, days, most)


def test_replaced_tables(spark, tmp_path):
    table = ReplacedTable(spark, f"{tmp_path}/t", keep=1)
    with pytest.raises(FileNotFoundError):
        table.read()
    table.replace(spark.range(3))
    old = table.read()
    table.replace(old.union(spark.range(10, 12)))
    assert sorted(r["id"] for r in table.read().collect()) == [0, 1, 2, 10, 11]
    with pytest.raises(Exception, match="lost"):
        table.replace(spark.range(5).select(F.raise_error(F.lit("lost")).cast("bigint").alias("id")))
    assert table.read().count() == 5  # a failed write changes nothing
    table.replace(spark.range(0))
    assert table.read().count() == 0 and len([p for p in (tmp_path / "t").iterdir() if p.is_dir()]) == 1
