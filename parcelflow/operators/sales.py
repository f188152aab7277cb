"""Derived datasets over property sales: summaries, gated insights, market comparison and ranking.

Sales have date_of_sale, price_eur, county, area_slug, eircode_prefix and is_new_dwelling (null: unknown).
Every clock is a parameter; every gate is an argument with the usual value.
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.functions import dates, stats
from parcelflow.sources.shared import materialised

#: Ranges of values that percentiles of large groups are counted in; each is one task.
RANGES = 64


def _price() -> Column:
    return F.col("price_eur")


def _within(window: tuple[Column, Column]) -> Column:
    return F.col("date_of_sale").between(*window)


def area_lifetime_stats(sales: DataFrame) -> DataFrame:
    """First and last sale, count, median, mean and range by (county, area) where both are known."""
    known = sales.where("county is not null and area_slug is not null")
    return known.groupBy("county", "area_slug").agg(
        F.min("date_of_sale").alias("first_sale_date"),
        F.max("date_of_sale").alias("last_sale_date"),
        F.count("*").alias("sales_count"),
        F.median("price_eur").alias("median_price"),
        stats.mean_money(F.col("price_eur")).alias("avg_price"),
        F.min("price_eur").alias("min_price"),
        F.max("price_eur").alias("max_price"),
    )


def area_monthly_stats(sales: DataFrame) -> DataFrame:
    known = sales.where("county is not null and area_slug is not null")
    return known.groupBy("county", "area_slug", F.date_format("date_of_sale", "yyyy-MM").alias("year_month")).agg(F.count("*").alias("sales_count"), F.median("price_eur").alias("median_price"), stats.mean_money(F.col("price_eur")).alias("avg_price"))


def exact_percentiles(counts: DataFrame, keys: list[str], value: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """keys... and a column for each name wanted, (count column, share): exact percentiles between ranks, null values left out.

    counts: keys..., value, and how many rows have it. Ranges of the value are counted first, so that no task sees
    more than a range, however large a group is; ranks then follow from the counts of the ranges before.
    """
    columns = sorted({column for column, _ in wanted.values()})
    known = counts.select(*keys, value, *(F.when(F.col(value).isNotNull(), F.col(c)).otherwise(0).alias(c) for c in columns))
    spread = materialised(materialised(known).repartitionByRange(RANGES, value).withColumn("part", F.spark_partition_id()))
    sums = spread.groupBy(*keys, "part").agg(*(F.sum(c).alias(c) for c in columns))
    group = Window.partitionBy(*keys)
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    named = [F.col(k).alias(f"own_{k}") for k in keys]
    sums = sums.select(*named, F.col("part").alias("own_part"), *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in columns), *(F.sum(c).over(group).alias(f"{c}_all") for c in columns))
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"own_{k}")) for k in [*keys, "part"]))
    within = Window.partitionBy(*keys, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = spread.withColumns({f"{c}_upto": F.sum(c).over(within) for c in columns}).join(F.broadcast(sums), same)  # a row for each group and range

    def at(column: str, share: float) -> Column:
        place = (F.col(f"{column}_all") - 1) * share
        upto = F.col(f"{column}_before") + F.col(f"{column}_upto")
        low, high = (F.max(F.when((rank >= upto - F.col(column)) & (rank < upto), F.col(value))) for rank in (F.floor(place), F.ceil(place)))
        part = F.max(place - F.floor(place))
        return F.when(part == 0, low).otherwise((1 - part) * low + part * high)

    return ranked.groupBy(*keys).agg(*(at(*w).alias(name) for name, w in wanted.items()))


def insights(sales: DataFrame, keys: list[str], as_of: date, price_gate: int = 24, activity_gate: int = 24, gap_gate: int = 6, spread_gate: int = 12, split_gate: int = 8) -> DataFrame:
    """One row for each key: medians, momentum, activity, gap between sales, spread and build split.

    All of it comes from one grouping with conditional aggregates.
    """
    now, before, third = (_within(dates.rolling(as_of, 12, back)) for back in (0, 12, 36))
    price = _price()
    new, old = now & (F.col("is_new_dwelling") == F.lit(True)), now & (F.col("is_new_dwelling") == F.lit(False))
    raw = sales.where(F.col("date_of_sale") <= F.lit(as_of)).groupBy(*keys).agg(
        F.count_if(now).alias("sales_12m"),
        F.count_if(before).alias("previous_12m"),
        F.count_if(third).alias("third_12m"),
        stats.median_where(price, now).alias("median_now"),
        stats.median_where(price, before).alias("median_before"),
        stats.median_where(price, third).alias("median_third"),
        F.avg(F.when(now, price)).alias("mean_now"),
        F.min(F.when(now, F.col("date_of_sale"))).alias("first_now"),
        F.max(F.when(now, F.col("date_of_sale"))).alias("last_now"),
        F.percentile(F.when(now, price), F.lit(0.25)).alias("q1"),
        F.percentile(F.when(now, price), F.lit(0.75)).alias("q3"),
        F.count_if(new).alias("new_count"),
        F.count_if(old).alias("old_count"),
        stats.median_where(price, new).alias("new_raw"),
        stats.median_where(price, old).alias("old_raw"),
    )
    both_prices = (F.col("sales_12m") >= price_gate) & (F.col("previous_12m") >= price_gate)
    both_counts = (F.col("sales_12m") >= activity_gate) & (F.col("previous_12m") >= activity_gate)
    split = (F.col("new_count") >= split_gate) & (F.col("old_count") >= split_gate)
    gap = F.datediff("last_now", "first_now") / (F.col("sales_12m") - 1)
    return raw.select(
        *keys,
        "sales_12m",
        "previous_12m",
        F.col("median_now").alias("median_price"),
        F.round(F.col("mean_now") + 1e-7, 2).alias("avg_price"),
        F.when(both_prices, F.round(stats.percent_change(F.col("median_now"), F.col("median_before")), 4)).alias("yoy_percent"),
        F.when(both_prices & (F.col("third_12m") >= price_gate), F.round(stats.percent_change(F.col("median_now"), F.col("median_third")), 4)).alias("three_year_percent"),
        F.when(both_counts, F.round(stats.percent_change(F.col("sales_12m"), F.col("previous_12m")), 4)).alias("activity_percent"),
        both_counts.alias("activity_reliable"),
        F.when((F.col("sales_12m") >= gap_gate) & (gap > 0), F.greatest(stats.round_half_up(gap), F.lit(1.0))).alias("days_between_sales"),
        stats.gated(F.col("q1"), F.col("sales_12m"), spread_gate).alias("price_p25"),
        stats.gated(F.col("q3"), F.col("sales_12m"), spread_gate).alias("price_p75"),
        F.when(split, F.col("new_raw")).alias("new_median"),
        F.when(split, F.col("old_raw")).alias("second_hand_median"),
        F.when(split, F.col("new_raw") - F.col("old_raw")).alias("new_premium"),
        F.when(split, F.round(stats.percent_change(F.col("new_raw"), F.col("old_raw")), 4)).alias("new_premium_percent"),
    )


def peak_month(sales: DataFrame, keys: list[str], least_years: int = 4, least_sales: int = 24) -> DataFrame:
    """The month that most years name as their busiest; tied months of a year all get its vote, then the earlier month wins."""
    monthly = sales.groupBy(*keys, F.year("date_of_sale").alias("year"), F.month("date_of_sale").alias("month")).agg(F.count("*").alias("n"))
    year = Window.partitionBy(*keys, "year").orderBy(F.desc("n"))
    votes = monthly.withColumn("place", F.rank().over(year)).groupBy(*keys, "month").agg(F.count_if(F.col("place") == 1).alias("votes"))
    extent = monthly.groupBy(*keys).agg(F.count_distinct("year").alias("years"), F.sum("n").alias("sales_count"))
    best = votes.groupBy(*keys).agg(F.max(F.struct("votes", (-F.col("month")).alias("m"))).alias("best"))
    out = best.join(extent, keys).where((F.col("years") >= least_years) & (F.col("sales_count") >= least_sales))
    return out.select(*keys, (-F.col("best.m")).cast("int").alias("peak_month"), F.col("best.votes").alias("votes"), "years", "sales_count")


def threshold_shares(sales: DataFrame, keys: list[str], as_of: date, thresholds: tuple[int, ...] = (300_000, 400_000, 500_000), least: int = 18, low: float = 10, high: float = 90) -> DataFrame:
    """Share in whole percent of the last 12 months' sales above each price; those under `low` or over `high` are left out."""
    recent = sales.where(_within(dates.rolling(as_of, 12)))
    above = [stats.round_half_up(F.avg((_price() > t).cast("double")) * 100).alias(str(t)) for t in thresholds]
    wide = recent.groupBy(*keys).agg(F.count("*").alias("sales_count"), *above).where(F.col("sales_count") >= least)
    long = wide.unpivot([*keys, "sales_count"], [str(t) for t in thresholds], "threshold", "share")
    return long.where(F.col("share").between(low, high)).select(*keys, F.col("threshold").cast("long").alias("threshold"), "sales_count", "share")


def national_snapshots(sales: DataFrame, as_of: date, ranges: dict[str, int | None] | None = None, gate: int = 24) -> DataFrame:
    """For each range: counts, median and mean of the range and of the one before it, and the changes."""
    ranges = ranges or {"last-year": 12, "3-years": 36, "5-years": 60, "all-time": None}
    rows = []
    for key, months in ranges.items():
        now = _within(dates.rolling(as_of, months)) if months else F.col("date_of_sale") <= F.lit(as_of)
        before = _within(dates.rolling(as_of, months, months)) if months else F.lit(False)
        rows.append((key, now, before))
    members = {f"{side}{k}": hit for k, (_, now, before) in enumerate(rows) for side, hit in (("n", now), ("b", before))}
    counts = materialised(sales.groupBy("price_eur").agg(*(F.count_if(hit).alias(name) for name, hit in members.items())))
    medians = {f"{'m' if name[0] == 'n' else 'p'}{name[1:]}": (name, 0.5) for name in members}
    priced = lambda k: F.when(F.col("price_eur").isNotNull(), F.col(f"n{k}"))
    means = [(F.sum(_price() * F.col(f"n{k}")) / F.nullif(F.sum(priced(k)), F.lit(0))).alias(f"a{k}") for k in range(len(rows))]
    sums = counts.agg(*(F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in members), *means)
    one = sums.crossJoin(exact_percentiles(counts, [], "price_eur", medians))  # one row each
    parts = [
        F.struct(
            F.lit(key).alias("range_key"),
            F.col(f"n{k}").alias("sales_count"),
            F.col(f"b{k}").alias("previous_count"),
            F.col(f"m{k}").alias("median_price"),
            F.round(F.col(f"a{k}") + 1e-7, 2).alias("avg_price"),
            F.when((F.col(f"n{k}") >= gate) & (F.col(f"b{k}") >= gate), F.round(stats.percent_change(F.col(f"m{k}"), F.col(f"p{k}")), 4)).alias("median_change"),
            F.when((F.col(f"n{k}") >= gate) & (F.col(f"b{k}") >= gate), F.round(stats.percent_change(F.col(f"n{k}"), F.col(f"b{k}")), 4)).alias("count_change"),
        )
        for k, (key, _, _) in enumerate(rows)
    ]
    return one.select(F.inline(F.array(*parts)))


def strongest_county(sales: DataFrame, as_of: date, gate: int = 24) -> DataFrame:
    """The county with the greatest yearly change of the median among those with enough sales, and the one with the most sales."""
    rows = insights(sales, ["county"], as_of, price_gate=gate, activity_gate=gate)
    best = rows.where("yoy_percent is not null").agg(F.max_by(F.struct("county", "yoy_percent"), F.struct("yoy_percent", _descending("county"))).alias("s"))
    most = rows.agg(F.max_by(F.struct("county", "sales_12m"), F.struct("sales_12m", _descending("county"))).alias("l"))
    return best.crossJoin(most).select(F.col("s.county").alias("strongest_county"), F.col("s.yoy_percent").alias("strongest_yoy"), F.col("l.county").alias("leader_county"), F.col("l.sales_12m").alias("leader_sales"))


def _descending(column: str) -> Column:
    """A key that is greater for names earlier in order; the end of a name is greater than any byte."""
    return F.concat(F.translate(F.hex(F.col(column).cast("binary")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))


def match_markets(sales: DataFrame, markets: DataFrame) -> DataFrame:
    """Each sale under every market it belongs to, by county, by routing prefix or by area within a county.

    `markets` (slug, label, kind, county, prefix, area_slug) is a dimension of some hundred rows; three equi-joins, never one with OR.
    """
    m = markets.withColumnsRenamed({"county": "m_county", "area_slug": "m_area"})
    by_county = sales.join(m.where("kind = 'county'"), F.col("county") == F.col("m_county"))
    by_prefix = sales.join(m.where("kind = 'district'"), F.col("eircode_prefix") == F.col("prefix"))
    by_area = sales.join(m.where("kind = 'area'"), (F.col("area_slug") == F.col("m_area")) & (F.col("county") == F.col("m_county")))
    columns = ["slug", "label", "kind", "date_of_sale", "price_eur", "county", "is_new_dwelling"]
    return reduce(DataFrame.unionByName, (d.select(*columns) for d in (by_county, by_prefix, by_area)))


def comparison_rows(sales: DataFrame, markets: DataFrame, as_of: date, gate: int = 24) -> DataFrame:
    """A row for each market with enough sales in the last year: counts, medians, changes, and the distance to the national median."""
    matched = match_markets(sales, markets)
    rows = insights(matched, ["slug", "label", "kind"], as_of, price_gate=gate, activity_gate=gate)
    national = sales.where(_within(dates.rolling(as_of, 12))).agg(F.median("price_eur").alias("national_median"))
    return rows.where(F.col("sales_12m") >= gate).crossJoin(F.broadcast(national)).select(
        "slug", "label", "kind", "sales_12m", "previous_12m", "median_price", "yoy_percent", "activity_percent",
        F.round(stats.percent_change(F.col("median_price"), F.col("national_median")), 4).alias("national_percent"),
        F.abs(F.col("median_price") - F.col("national_median")).alias("national_distance"),
    )


#: Membership, order and cap of the ranked groups that need no curated list.
GROUPS: dict[str, tuple[str, list[tuple[str, bool]], int | None]] = {
    "all-tracked": ("kind <> 'county'", [("label", True)], None),
    "counties-compared": ("kind = 'county'", [("median_price", False), ("label", True)], None),
    "districts-compared": ("kind = 'district'", [("median_price", False), ("label", True)], None),
    "affordable-markets": ("kind <> 'county' and sales_12m >= 24 and median_price <= 300000", [("median_price", True), ("sales_12m", False), ("label", True)], 30),
    "high-value-markets": ("kind <> 'county' and sales_12m >= 24 and median_price >= 500000", [("median_price", False), ("sales_12m", False), ("label", True)], 30),
    "most-active": ("kind <> 'county' and sales_12m > 0", [("sales_12m", False), ("median_price", False), ("label", True)], 30),
    "least-active": ("kind <> 'county' and sales_12m > 0", [("sales_12m", True), ("median_price", False), ("label", True)], 30),
    "hottest-markets": ("kind <> 'county' and sales_12m >= 12 and previous_12m >= 12 and activity_percent > 0 and yoy_percent > 0", [("activity_percent", False), ("yoy_percent", False), ("sales_12m", False), ("label", True)], 30),
    "coolest-markets": ("kind <> 'county' and sales_12m >= 12 and previous_12m >= 12 and activity_percent < 0 and yoy_percent <= 0", [("activity_percent", True), ("yoy_percent", True), ("sales_12m", True), ("label", True)], 30),
    "rising-markets": ("kind <> 'county' and sales_12m >= 50 and yoy_percent is not null", [("yoy_percent", False), ("label", True)], 30),
    "falling-markets": ("kind <> 'county' and sales_12m >= 50 and yoy_percent < 0", [("yoy_percent", True), ("label", True)], 30),
    "nearest-national": ("kind <> 'county'", [("national_distance", True), ("label", True)], 30),
}


def _sort_keys(order: list[tuple[str, bool]]) -> list[Column]:
    """Three numbers that rise in the order of the numeric columns, which come before the label; null values last."""
    keys = [F.col(c).cast("double") if up else -F.col(c).cast("double") for c, up in order if c != "label"]
    return [*keys, *[F.lit(None).cast("double")] * (3 - len(keys))]


def ranked_groups(comparison: DataFrame) -> DataFrame:
    """group_key, rank, slug of every group; the rows are sorted first and capped then. One pass: a row becomes one for each group that it is in."""
    entries = []
    for key, (member, order, cap) in GROUPS.items():
        fields = [F.lit(key).alias("group_key"), F.lit(cap).cast("int").alias("cap"), *(k.alias(f"key_{i}") for i, k in enumerate(_sort_keys(order)))]
        entries.append(F.when(F.expr(member), F.struct(*fields)))
    member_of = comparison.select("slug", "label", "median_price", "sales_12m", F.explode(F.array_compact(F.array(*entries))).alias("g")).select("slug", "label", "median_price", "sales_12m", "g.*")
    by = Window.partitionBy("group_key").orderBy(*(F.col(f"key_{i}").asc_nulls_last() for i in range(3)), "label", "slug")
    ranked = member_of.withColumn("rank", F.row_number().over(by))
    return ranked.where(F.col("cap").isNull() | (F.col("rank") <= F.col("cap"))).select("group_key", "rank", "slug", "median_price", "sales_12m")


def extremes(comparison: DataFrame) -> DataFrame:
    """pick and slug of the highest, lowest, busiest and nearest to the national median, in one aggregation; ties go to more sales or the higher price, then to the label."""
    price, many = F.col("median_price"), F.col("sales_12m")
    picks = {"highest": [-price, -many], "lowest": [price, -many], "busiest": [-many, -price], "closest": [F.col("national_distance")]}
    one = comparison.agg(*(F.min_by("slug", F.struct(*keys, "label")).alias(pick) for pick, keys in picks.items()))
    return one.unpivot([], list(picks), "pick", "slug").where("slug is not null")


def mode_or_none(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each key, null when two share the first place."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    top = counts.withColumn("place", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc("n")))).where("place = 1")
    return top.groupBy(*keys).agg(F.count("*").alias("firsts"), F.min(value).alias("v"), F.max("n").alias("n")).select(*keys, F.when(F.col("firsts") == 1, F.col("v")).alias("mode"), "n")


def dominant_share(rows: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """The most frequent value, regardless of case and outer blanks, of keys where it reaches a share of the rows."""
    norm = F.lower(F.btrim(F.col(value)))
    counts = rows.where(norm != "").groupBy(*keys, norm.alias("norm")).agg(F.count("*").alias("n"), F.min(value).alias("spelling"))
    by = Window.partitionBy(*keys)
    ranked = counts.withColumn("total", F.sum("n").over(by)).withColumn("place", F.row_number().over(by.orderBy(F.desc("n"), "norm")))
    return ranked.where((F.col("place") == 1) & (F.col("n") >= F.col("total") * share)).select(*keys, F.col("spelling").alias("dominant"), "n", "total")


def page(sales: DataFrame, sort: str = "newest", number: int = 1, size: int = 25, low: float | None = None, high: float | None = None, since: date | None = None, terms: tuple[str, ...] = ()) -> DataFrame:
    """One page of a filtered, sorted search."""
    orders = {"newest": [F.desc("date_of_sale")], "oldest": [F.asc("date_of_sale")], "price-high": [F.desc_nulls_last("price_eur")], "price-low": [F.asc_nulls_last("price_eur")]}
    rows = sales
    if low is not None:
        rows = rows.where(_price() >= low)
    if high is not None:
        rows = rows.where(_price() <= high)
    if since is not None:
        rows = rows.where(F.col("date_of_sale") >= F.lit(since))
    for term in (t for t in terms if len(t) >= 3):
        rows = rows.where(F.lower("locality").contains(term.lower()) | F.lower("address").contains(term.lower()))
    tie = ["date_of_sale", "price_eur", "county", "area_slug", "eircode_prefix", "locality", "address"]
    return rows.orderBy(*orders[sort], *tie).offset((max(1, number) - 1) * size).limit(size)
