"""Keeping stored records up to date: conditional updates, checks, revisions, backfills, and who is told.

Clocks are parameters. Every function returns the table as it stands afterwards, or the rows to add.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.functions import status
from parcelflow.functions import text as T


def updated(stored: DataFrame, incoming: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """`stored` with the incoming values where a row differs in any field, and whether it changed; nulls are values."""
    new = incoming.select(key, F.struct(*fields).alias("incoming_values"))
    both = stored.join(new, key, "left")
    now, was = F.col("incoming_values"), F.struct(*fields)
    changed = now.isNotNull() & ~was.eqNullSafe(now)
    kept = [c for c in stored.columns if c not in fields]
    return both.select(*kept, *(F.when(changed, now[f]).otherwise(F.col(f)).alias(f) for f in fields), changed.alias("changed"))


def known_kept(stored: DataFrame, incoming: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Incoming rows whose null fields keep what is stored."""
    old = stored.select(key, F.struct(*fields).alias("stored_values"))
    return incoming.join(old, key, "left").select(key, *(F.coalesce(F.col(f), F.col("stored_values")[f]).alias(f) for f in fields))


def revised(stored: DataFrame, incoming: DataFrame, key: str, content: list[str], now: datetime) -> DataFrame:
    """Incoming rows with updated_at: `now` where the content is new or differs, else as stored."""
    old = stored.select(key, F.struct(*content).alias("stored_content"), F.col("updated_at").alias("stored_at"))
    both = incoming.join(old, key, "left")
    same = F.col("stored_content").eqNullSafe(F.struct(*content))
    return both.select(key, *content, F.when(same, F.col("stored_at")).otherwise(F.lit(now)).alias("updated_at"))


def marked_checked(applications: DataFrame, authority: str, start: date, end: date, as_of: date) -> DataFrame:
    """`applications` with last_checked: `as_of` for the open ones of an authority registered from `start` to before `end`.

    Open: no final grant, appeal decision or final state, and under appeal, undecided or decided within 180 days.
    """
    pending = F.col("appeal_lodged_date").isNotNull() | (F.col("state") == "appealed") | F.col("decision_date").isNull() | (F.col("decision_date") >= F.date_sub(F.lit(as_of), 180))
    unsettled = F.col("final_grant_date").isNull() & F.col("appeal_decision_date").isNull() & ~status.is_terminal(F.col("state")) & pending
    due = (F.col("authority") == authority) & (F.col("registration_date") >= F.lit(start)) & (F.col("registration_date") < F.lit(end)) & unsettled
    return applications.withColumn("last_checked", F.when(due, F.lit(as_of)).otherwise(F.col("last_checked")))


def decision_changes(old: DataFrame, new: DataFrame, detected: date) -> DataFrame:
    """Events for new wordings of a decision and for moved or removed due dates between two snapshots.

    Case and blanks of the wording do not count, and a decision date that came with it says it already. A
    due date that was unknown before gives no event.
    """

    def plain(c: Column) -> Column:
        return F.lower(F.coalesce(T.squeeze(c), F.lit("")))

    before = old.select("id", F.struct("decision_text", "decision_date", "decision_due_date").alias("o"))
    both = new.select("id", F.struct("decision_text", "decision_date", "decision_due_date").alias("n")).join(before, "id")
    fired = F.col("o.decision_date").isNull() & F.col("n.decision_date").isNotNull()
    told = F.nullif(F.btrim("n.decision_text"), F.lit(""))
    worded = F.struct(F.lit("decision_changed").alias("event_type"), F.coalesce(F.concat(F.lit("Decision updated: "), told), F.lit("Decision updated")).alias("label"), F.nullif(F.btrim("o.decision_text"), F.lit("")).alias("old_value"), told.alias("new_value"))
    was, now = F.col("o.decision_due_date"), F.col("n.decision_due_date")
    moved = F.struct(F.lit("decision_due_changed").alias("event_type"), F.when(now.isNull(), "Decision due date removed from source").otherwise("Decision due date updated").alias("label"), was.cast("string").alias("old_value"), now.cast("string").alias("new_value"))
    found = F.array(F.when((plain(F.col("o.decision_text")) != plain(F.col("n.decision_text"))) & ~fired, worded), F.when(was.isNotNull() & ~was.eqNullSafe(now), moved))
    return both.select(F.col("id").alias("application_id"), F.lit(detected).alias("event_date"), F.inline(F.array_compact(found)))


def traffic(days: DataFrame) -> DataFrame:
    """page, clicks, impressions over all days."""
    return days.groupBy("page").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))


def quality_candidates(applications: DataFrame, days: DataFrame, as_of: date, window: int = 28, most: int = 20) -> DataFrame:
    """The applications with most clicks, then impressions, in the last days; window 7 to 90 days, at most 20 rows."""
    since = F.date_sub(F.lit(as_of), max(7, min(window, 90)))
    seen = traffic(days.where(F.col("day") >= since))
    rows = applications.select("id", "authority", "reference").join(seen, F.col("id") == F.col("page")).drop("page")
    return rows.orderBy(F.desc("clicks"), F.desc("impressions"), "authority", "reference").limit(max(1, min(most, 20)))


def proposal_backfill(applications: DataFrame, days: DataFrame, notable: DataFrame, cut_short: Column, as_of: date, most: int = 50, since: date | None = None, until: date | None = None) -> DataFrame:
    """Applications with cut-off proposals, those that people look for first, then recent open ones, then the rest.

    Open: no decision, final state or withdrawal. since, until: first and last day of registration that count, if given.
    """
    seen = traffic(days)
    rows = applications.where(cut_short)
    if since:
        rows = rows.where(F.col("registration_date") >= F.lit(since))
    if until:
        rows = rows.where(F.col("registration_date") <= F.lit(until))
    rows = rows.join(seen, F.col("id") == F.col("page"), "left").drop("page").fillna(0, ["clicks", "impressions"])
    rows = rows.join(notable.select("id", F.lit(True).alias("is_notable")).distinct(), "id", "left").fillna(False, ["is_notable"])
    wanted = (F.col("clicks") > 0) | (F.col("impressions") > 0) | F.col("is_notable")
    pending = (F.col("registration_date") >= F.add_months(F.lit(as_of), -24)) & (F.col("state") != "decision_made") & ~status.is_terminal(F.col("state")) & F.col("decision_date").isNull() & F.col("withdrawal_date").isNull()
    rows = rows.withColumn("priority", F.when(wanted, 0).when(pending, 1).otherwise(2))
    order = ["priority", F.desc("clicks"), F.desc("impressions"), F.desc_nulls_last("registration_date"), F.desc("reference"), "id"]
    return rows.select("id", "reference", "registration_date", "priority", "clicks", "impressions", "is_notable").orderBy(*order).limit(max(1, min(most, 100)))


def cancelled(queue: DataFrame, was: DataFrame, now: DataFrame) -> DataFrame:
    """`queue` where waiting deliveries of subscriptions that were switched off have failed; was, now: subscription_id, enabled."""
    off = was.where("enabled").join(now.where("not enabled"), "subscription_id", "left_semi").select("subscription_id", F.lit(True).alias("is_off"))
    both = queue.join(off, "subscription_id", "left")
    hit = F.coalesce(F.col("is_off") & F.col("status").isin("queued", "sending"), F.lit(False))
    changes = {"status": F.lit("failed"), "next_attempt_at": F.lit(None), "claimed_at": F.lit(None), "claim_token": F.lit(None), "last_error": F.lit("Subscription disabled before delivery.")}
    return both.select(*(F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in queue.columns))


def watched(state: DataFrame, subscriptions: DataFrame, now: datetime) -> DataFrame:
    """Watch rows (application_id, initialized_at, requested_at) of which every enabled subscription has one; a request stays as it was first made."""
    wanted = subscriptions.where("enabled").select("application_id", F.lit(True).alias("is_wanted")).distinct()
    both = state.join(wanted, "application_id", "full_outer")
    asked = F.when(F.col("initialized_at").isNull() & F.col("is_wanted"), F.coalesce("requested_at", F.lit(now))).otherwise(F.col("requested_at"))
    return both.select("application_id", "initialized_at", asked.alias("requested_at"))


def first_rows(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("place_of_row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("place_of_row = 1").drop("place_of_row")


def path_cohort(candidates: DataFrame, size: int = 100) -> DataFrame:
    """The best candidate of each path, best first, as many as fit; ties by path. Extra columns go."""
    best = candidates.groupBy("path").agg(F.max("score").alias("score"))
    return best.orderBy(F.desc("score"), "path").limit(size)
