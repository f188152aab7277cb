"""Streams over the event log, each held against the same result in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parcelflow.plans.registry import query
from parcelflow.streaming import windows as S


@query(
    "stream_tumbling_days",
    "select date_trunc('day', ts)::timestamp as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2",
)
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drained(spark, S.tumbling(S.event_stream(spark, sf_dir)), "complete")


@query(
    "stream_sliding_weeks",
    """select start, count(*) as n from (select ts, unnest(generate_series(date_trunc('day', ts)::timestamp - interval 6 day, date_trunc('day', ts)::timestamp, interval 1 day)) as start from events) group by 1""",
)
def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drained(spark, S.sliding(S.event_stream(spark, sf_dir)), "complete").drop("users")


@query(
    "stream_sessions",
    """with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 12 hour then 0 else 1 end as fresh from events),
    s as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as k from g)
    select user_id, min(ts) as start, max(ts) + interval 12 hour as stop, count(*) as n from s group by user_id, k""",
)
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drained(spark, S.sessions(S.event_stream(spark, sf_dir)), "complete")


@query(
    "stream_type_changes",
    """select user_id, event_id, was, event_type as now from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as was from events) where was is not null and was <> event_type""",
)
def type_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.type_changes(spark, S.event_stream(spark, sf_dir))
