"""Structured Streaming over the event log: windows, sessions, and changes by keyed state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelflow.sources.shared import shared_folder


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts and sums by window and type."""
    grouped = _watermarked(events, late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "7 days", step: str = "1 day", late: str = "1 day") -> DataFrame:
    grouped = _watermarked(events, late).groupBy(F.window("ts", width, step).alias("w"))
    return grouped.agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users")).select(F.col("w.start").alias("start"), "n", "users")


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    """Runs of a user's events with no pause of `gap`."""
    grouped = _watermarked(events, late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def _watermarked(events: DataFrame, late: str) -> DataFrame:
    return events.withWatermark("ts", late) if events.isStreaming else events


class LateRows(ValueError):
    """Rows that came after later ones of their user were released."""


def _judged(rows: DataFrame, late: str) -> DataFrame:
    """`rows` in order of each user with the type before, and what becomes of them.

    release: comes out now; kept: needed by the next micro-batch (open rows, and the last closed one
    of each user); overtaken: open, but before a closed row.
    """
    order = Window.partitionBy("user_id").orderBy(F.asc_nulls_last("ts"), F.asc_nulls_last("event_id"))
    horizon = rows.agg((F.max("ts") - F.expr(f"interval {late}")).alias("horizon"))
    due = F.col("closed") | F.coalesce(F.col("ts") <= F.col("horizon"), F.lit(False))
    judged = rows.crossJoin(F.broadcast(horizon)).withColumn("due", due)
    judged = judged.withColumns({"was": F.lag("event_type").over(order), "next_due": F.lead("due").over(order), "overtaken": ~F.col("closed") & F.coalesce(F.max("closed").over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(False))})
    return judged.select("user_id", "event_id", "event_type", "ts", "closed", "was", "overtaken", (F.col("due") & ~F.col("closed")).alias("release"), (~F.col("due") | ~F.coalesce("next_due", F.lit(False))).alias("kept"))


def _differing(judged: DataFrame) -> DataFrame:
    return judged.where("was <> event_type").select("user_id", "event_id", "was", F.col("event_type").alias("now"))


def type_changes(spark: SparkSession, events: DataFrame, late: str = "1 day") -> DataFrame:
    """A row whenever a user's event is of another type than the one before; the first sets the baseline.

    The stream is run over all that is there. Events are ordered by time and number over the whole
    user, however the source splits them: a micro-batch releases rows older than the latest event by
    `late`, and keeps the others, with each user's last released row, as state in the shared folder. At the
    end all that is open comes out. Rows that come too late for their user's order stop the run
    with `LateRows`; none is dropped.
    """
    folder = f"{shared_folder(spark)}/changes-{uuid.uuid4().hex}"
    slim = events.select("user_id", "event_id", "event_type", "ts")
    judged_schema = f"{_ddl(slim)}, closed boolean, was string, overtaken boolean, release boolean, kept boolean"
    numbers: list[int] = []
    read = lambda session, number: session.read.schema(judged_schema).parquet(f"{folder}/judged/{number}")
    state = lambda session, number: read(session, number).where("kept").select(*slim.columns, (F.col("closed") | F.col("release")).alias("closed"))

    def advance(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("closed", F.lit(False))
        before = [n for n in numbers if n < number]
        if before:
            rows = rows.unionByName(state(batch.sparkSession, before[-1]))
        _judged(rows, late).write.mode("overwrite").parquet(f"{folder}/judged/{number}")
        overtaken = read(batch.sparkSession, number).where("overtaken").count()
        if overtaken:
            raise LateRows(f"{overtaken} events came after later ones of their user had been released; a longer `late` than {late} is needed")
        if number not in numbers:
            numbers.append(number)

    query = slim.writeStream.foreachBatch(advance).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if not numbers:
        return spark.createDataFrame([], "user_id long, event_id long, was string, now string")
    out = _differing(_judged(state(spark, numbers[-1]), late).where("not closed"))
    for number in numbers:
        out = out.unionByName(_differing(read(spark, number).where("release")))
    return out


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)


def drained(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """The stream run over all that is there, its result read back from the shared folder."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out" if mode == "complete" else f"{folder}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").select(*stream.columns)
