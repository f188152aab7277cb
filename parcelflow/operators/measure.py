"""Search measurement, cohorts, alert queues: set operations and state transitions over keyed tables."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page_totals(days: DataFrame, start: date, end: date) -> DataFrame:
    """Clicks, impressions, rate, impression-weighted position and active days by page over a range of days."""
    rows = days.where(F.col("day").between(F.lit(start), F.lit(end)))
    totals = rows.groupBy("page").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.sum(F.col("position") * F.col("impressions")).alias("w"), F.count_distinct("day").alias("days"))
    return totals.select("page", "clicks", "impressions", "days", F.round(F.try_divide("clicks", "impressions"), 6).alias("ctr"), F.round(F.try_divide("w", "impressions") + 1e-7, 4).alias("position"))


def top_pages(totals: DataFrame, n: int = 10) -> DataFrame:
    return totals.orderBy(F.desc("clicks"), F.desc("impressions"), "page").limit(n)


def trends(days: DataFrame, as_of: date, spans: tuple[int, ...] = (7, 28)) -> DataFrame:
    """Clicks and impressions of the last days and of as many before, for each span."""
    aggs, parts = [], []
    for n in spans:
        now = F.col("day").between(F.date_sub(F.lit(as_of), n - 1), F.lit(as_of))
        before = F.col("day").between(F.date_sub(F.lit(as_of), 2 * n - 1), F.date_sub(F.lit(as_of), n))
        for name, column in (("clicks", "clicks"), ("impressions", "impressions")):
            aggs += [F.sum(F.when(now, F.col(column)).otherwise(0)).alias(f"{name}{n}"), F.sum(F.when(before, F.col(column)).otherwise(0)).alias(f"{name}{n}b")]
        parts.append(F.struct(F.lit(n).alias("span"), F.col(f"clicks{n}").alias("clicks"), F.col(f"clicks{n}b").alias("previous_clicks"), F.col(f"impressions{n}").alias("impressions"), F.col(f"impressions{n}b").alias("previous_impressions")))
    return days.agg(*aggs).select(F.inline(F.array(*parts)))


def promotions(days: DataFrame, known: DataFrame, as_of: date, window: int = 90, least_days: int = 3, clicks: int = 2, impressions: int = 100) -> DataFrame:
    """Pages not yet notable with rows on enough days of the window, clicked or shown or not, and clicked or shown enough."""
    rows = days.where(F.col("day") >= F.date_sub(F.lit(as_of), window))
    totals = rows.groupBy("page").agg(F.count_distinct("day").alias("days"), F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))
    enough = (F.col("days") >= least_days) & ((F.col("clicks") >= clicks) | (F.col("impressions") >= impressions))
    return totals.where(enough).join(known.select("page"), "page", "left_anti")


def stratified(candidates: DataFrame, total: int, shares: dict[str, float], order: list[Column]) -> DataFrame:
    """`total` rows, each cohort's quota first, then what is left over from any cohort in the candidates' own order."""
    quota, rest = {}, total
    names = list(shares)
    for name in names[:-1]:
        quota[name] = min(rest, -int(-total * shares[name] // 1))
        rest -= quota[name]
    quota[names[-1]] = rest
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in quota.items() for x in pair]), F.col("cohort"))
    place = F.element_at(F.create_map(*[F.lit(x) for k, n in enumerate(names) for x in (n, k)]), F.col("cohort"))
    ranked = candidates.withColumn("rank", F.row_number().over(Window.partitionBy("cohort").orderBy(*order)))
    first = F.when(F.col("rank") <= limit, 0).otherwise(1)
    return ranked.where(F.col("rank") <= total).orderBy(first, F.when(first == 0, place), *order).limit(total).drop("rank")


def enqueue(observed: DataFrame, subscriptions: DataFrame, deliveries: DataFrame) -> DataFrame:
    """A delivery for each change seen at or after a subscription began and not queued before."""
    due = observed.join(subscriptions, "entity").where("observed_at >= created_at").select("subscription", "change")
    return due.join(deliveries.select("subscription", "change"), ["subscription", "change"], "left_anti")


def claim(queue: DataFrame, enabled: DataFrame, now: datetime, batch: int = 25, attempts: int = 5) -> DataFrame:
    """The queue with the oldest due rows of enabled subscriptions leased by this single writer; tokens follow from the row and the clock, and leased rows are due at no time."""
    due = (F.col("status") == "queued") & (F.col("attempts") < attempts) & (F.col("due_at") <= F.lit(now))
    chosen = queue.where(due).join(enabled.select("subscription"), "subscription", "left_semi").orderBy("due_at", "created_at", "id").limit(batch).select("id", F.lit(True).alias("chosen"))
    rows = queue.join(chosen, "id", "left")
    took = F.coalesce("chosen", F.lit(False))
    return rows.select("id", F.when(took, "processing").otherwise(F.col("status")).alias("status"), (F.col("attempts") + took.cast("int")).alias("attempts"), F.when(~took, F.col("due_at")).alias("due_at"), F.when(took, F.sha2(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(now))), 256)).alias("token"), F.when(took, F.lit(now)).alias("claimed_at"))


def expire_leases(queue: DataFrame, now: datetime, minutes: int = 30, attempts: int = 5) -> DataFrame:
    """Leases older than `minutes` go back to the queue, due now, or fail after the last attempt; either way claim and token go."""
    stale = (F.col("status") == "processing") & (F.col("claimed_at") <= F.lit(now) - F.make_dt_interval(mins=F.lit(minutes)))
    stale = F.coalesce(stale, F.lit(False))
    last = stale & (F.col("attempts") >= attempts)
    return queue.withColumns(
        {
            "status": F.when(last, "failed").when(stale, "queued").otherwise(F.col("status")),
            "due_at": F.when(stale & ~last, F.lit(now)).when(~stale, F.col("due_at")),
            "claimed_at": F.when(~stale, F.col("claimed_at")),
            "token": F.when(~stale, F.col("token")),
        }
    )


def complete(queue: DataFrame, results: DataFrame, now: datetime, attempts: int = 5) -> DataFrame:
    """Results (id, token, ok) applied where the token still holds; failures wait longer each time."""
    rows = queue.join(results.withColumnRenamed("token", "given"), "id", "left")
    holds = (F.col("status") == "processing") & (F.col("token") == F.col("given"))
    wait = F.least(F.lit(60), (5 * F.pow(F.lit(2), F.col("attempts") - 1)).cast("int"))
    state = F.when(holds & F.col("ok"), "sent").when(holds & (F.col("attempts") >= attempts), "failed").when(holds, "queued").otherwise(F.col("status"))
    return rows.select("id", state.alias("status"), "attempts", F.when(holds & ~F.col("ok"), F.lit(now) + F.make_dt_interval(mins=wait)).otherwise(F.col("due_at")).alias("due_at"), F.when(~F.coalesce(holds, F.lit(False)), F.col("token")).alias("token"))


def coalesced(requests: DataFrame) -> DataFrame:
    """The latest request of each entity."""
    return requests.groupBy("entity").agg(F.max("requested_at").alias("requested_at"))


def cleared(queue: DataFrame, done: DataFrame) -> DataFrame:
    """The queue without entries that were worked off and not asked for again since."""
    return queue.join(done, ["entity", "requested_at"], "left_anti")


def watch_changes(state: DataFrame, seen: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(next state, changes): a first sight sets a baseline and reports nothing; later ones report the fields that differ."""
    before = state.select("entity", F.struct(*fields).alias("o"), F.lit(True).alias("known"))
    both = seen.select("entity", F.struct(*fields).alias("n")).join(before, "entity", "full_outer")
    differs = F.array_compact(F.array(*(F.when(~F.col(f"n.{f}").eqNullSafe(F.col(f"o.{f}")), F.lit(f)) for f in fields)))
    changes = both.where("known and n is not null").select("entity", differs.alias("fields")).where(F.size("fields") > 0)
    return both.select("entity", F.coalesce("n", "o").alias("s")).select("entity", "s.*"), changes


def inspection_priority(pages: DataFrame, last: DataFrame, as_of: date) -> DataFrame:
    """Pages by how urgently to inspect them: never seen, not indexed for 7 days, indexed for 30 days."""
    rows = pages.join(last, "page", "left")
    age = F.datediff(F.lit(as_of), F.col("inspected"))
    priority = F.when(F.col("inspected").isNull(), 0).when(~F.col("indexed") & (age >= 7), 1).when(F.col("indexed") & (age >= 30), 2)
    return rows.select("page", priority.alias("priority"), F.md5(F.concat(F.col("page").cast("string"), F.lit(str(as_of)))).alias("shuffle")).where("priority is not null")
