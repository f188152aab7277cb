"""Smaller set operations over keyed records: flags, suppression, routes, audits, bundles."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flagged(rows: DataFrame, other: DataFrame, key: str, name: str) -> DataFrame:
    """`rows` with whether `other` has the key."""
    return rows.join(other.select(key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def without_generic(events: DataFrame, specific: dict[str, str]) -> DataFrame:
    """Events less the generic ones (type `status`, value a state) that a specific event of the same entity and moment explains."""
    means = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in specific.items() for x in pair]), F.col("value")), F.lit(""))
    generic = events.where("type = 'status'").withColumn("means", means)
    told = events.where("type <> 'status'").select("entity", "at", F.col("type").alias("means"))
    return generic.join(told, ["entity", "at", "means"], "left_anti").drop("means").unionByName(events.where("type <> 'status'"))


def with_latest(rows: DataFrame, log: DataFrame, key: str, at: str, fields: list[str]) -> DataFrame:
    """`rows` with the fields of the latest log entry of each key; one aggregation instead of a lateral lookup."""
    last = log.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(at, *fields)).alias("last"), F.max(at).alias(f"last_{at}"))
    return rows.join(last, key, "left").select(*rows.columns, f"last_{at}", *(F.col(f"last.{f}").alias(f) for f in fields))


def route_index(routes: DataFrame) -> DataFrame:
    """For each slug its only destination, or that there are several."""
    sets = routes.groupBy("slug").agg(F.count_distinct("destination").alias("n"), F.min("destination").alias("d"))
    return sets.select("slug", F.when(F.col("n") == 1, F.col("d")).alias("redirect"), (F.col("n") > 1).alias("ambiguous"))


def mismatches(source: DataFrame, stored: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """field, kind, count: how stored dates differ from the source's: missing, absent from the source, or by days."""
    both = source.select(key, F.struct(*fields).alias("s")).join(stored.select(key, F.struct(*fields).alias("t")), key)
    parts = [F.struct(F.lit(f).alias("field"), F.col(f"s.{f}").alias("a"), F.col(f"t.{f}").alias("b")) for f in fields]
    long = both.select(F.inline(F.array(*parts)))
    days = F.datediff("b", "a")
    kind = F.when(F.col("a").isNotNull() & F.col("b").isNull(), "missing").when(F.col("a").isNull() & F.col("b").isNotNull(), "absent").when(days != 0, F.concat(F.when(days > 0, "+").otherwise(""), days.cast("string"), F.lit(" days")))
    return long.withColumn("kind", kind).where("kind is not null").groupBy("field", "kind").agg(F.count("*").alias("n"))


def trend_series(rows: DataFrame, day: str, as_of: date, months: int = 12) -> DataFrame:
    """Counts of the last complete months, each with the change to the month before."""
    counts = rows.where(F.col(day) < F.trunc(F.lit(as_of), "month")).groupBy(F.trunc(day, "month").alias("month")).agg(F.count("*").alias("n"))
    last = counts.orderBy(F.desc("month")).limit(months)  # a row for each month
    return last.select("month", "n", (F.col("n") - F.lag("n").over(Window.orderBy("month"))).alias("delta"))


def scaled(rows: DataFrame, value: str, floor: float = 8.0) -> DataFrame:
    """Bar heights in percent of the largest value of the whole series, with a floor."""
    top = rows.agg(F.max(value).alias("top"))
    return rows.crossJoin(F.broadcast(top)).select(*rows.columns, F.greatest(F.lit(floor), F.round(F.col(value) / F.col("top") * 100, 4)).alias("height"))


def head_and_tail(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The first and last `n` rows by key, each once."""
    return rows.orderBy(F.asc(key)).limit(n).union(rows.orderBy(F.desc(key)).limit(n)).dropDuplicates([key])


def qa_class(problems: Column, warnings: Column, repaired: Column) -> Column:
    return F.when(F.size(problems) > 0, F.when(repaired, "REPAIRED").otherwise("FAIL")).when(F.size(warnings) > 0, "WARN").otherwise("PASS")


def timeline_problems(applications: DataFrame, as_of: date) -> DataFrame:
    """id, problems, warnings of each application: dates out of order or in the future, decisions long overdue."""
    before = F.col("decision_date") < F.col("registration_date")
    future = F.greatest("registration_date", "decision_date", "final_grant_date") > F.lit(as_of)
    early = F.col("final_grant_date") < F.col("decision_date")
    overdue = F.col("decision_date").isNull() & (F.datediff(F.lit(as_of), "registration_date") > 365)
    problems = F.array_compact(F.array(F.when(before, "decision before registration"), F.when(early, "grant before decision"), F.when(future, "date in the future")))
    return applications.select("id", problems.alias("problems"), F.array_compact(F.array(F.when(overdue, "no decision in a year"))).alias("warnings"))


def membership_sync(members: DataFrame, selected: DataFrame, as_of: date) -> DataFrame:
    """The next membership: selected pages enter or stay, others leave on `as_of`; left ones can enter again.

    members: page, entered, left (null while in); selected: page.
    """
    both = members.join(selected.select("page", F.lit(True).alias("chosen")), "page", "full_outer")
    inside = F.col("entered").isNotNull() & F.col("left").isNull()
    entered = F.when(F.col("chosen") & ~inside, F.lit(as_of)).when(F.col("chosen") & F.col("entered").isNull(), F.lit(as_of)).otherwise(F.col("entered"))
    left = F.when(F.col("chosen"), F.lit(None).cast("date")).when(inside, F.lit(as_of)).otherwise(F.col("left"))
    return both.select("page", entered.alias("entered"), left.alias("left"))


def contradictions(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value, regardless of case and outer blanks."""
    return rows.groupBy(key).agg(F.count_distinct(F.lower(F.btrim(value))).alias("n")).where("n > 1")
