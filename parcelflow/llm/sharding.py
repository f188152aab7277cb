"""Sharding by balanced label propagation, in built-in functions only.

Documents with equal texts are linked through their text's hub. Linked documents start on a
shard of their hash; in each round every hub names the shard that holds most of its members,
and members elsewhere ask to move there. For each pair of shards as many moves are let through
as the opposite moves and the free room under the quota allow. At the end documents above a
shard's quota, unlinked ones first, fill the gaps of the others, so that row counts differ
by one at most. A hub larger than a quarter of a shard is salted into several.

Null texts have no bytes (size 1) and no links; blank texts link with equal ones. Repeated rows
are separate documents with equal texts. Null ids are kept. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.llm.shared import checkpointed

#: Rows that one window partition of the ranking holds, about.
RANK_ROWS = 4000
SCALE = 1_000_000


def _ranked(rows: DataFrame, key: list[str], buckets: int, spread: Column, order: list[Column], name: str) -> DataFrame:
    """`rows` with the 0-based rank `name` within `key`, ordered by bucket and then `order`.

    Buckets of bounded size are ranked on their own; their offsets come from a window over
    one aggregated row for each bucket.
    """
    cut = rows.withColumn("bucket", F.pmod(spread, F.lit(buckets)).cast("long"))
    sums = cut.groupBy(*key, "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*key, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy(*key, "bucket").orderBy(*order))
    return cut.withColumn("within", within).join(offsets, [*key, "bucket"]).withColumn(name, F.col("offset") + F.col("within") - 1).drop("bucket", "offset", "within")


def _propagate(linked: DataFrame, n_shards: int, room: list[int], rounds: int) -> DataFrame:
    """doc row, hub, label after at most `rounds` rounds of moves under the quotas."""
    spark = linked.sparkSession
    now = checkpointed(linked.withColumn("label", F.pmod(F.xxhash64("row"), F.lit(n_shards)).cast("int")))
    for turn in range(rounds):
        held = now.groupBy("hub", "label").agg(F.count("*").alias("n"))
        best = held.groupBy("hub").agg(F.max(F.struct("n", F.xxhash64("hub", "label").alias("tie"), "label")).alias("best")).select("hub", F.col("best.label").alias("to"))
        wants = held.join(best, "hub").where("label <> to").groupBy("label", "to").agg(F.sum("n").alias("n"))
        asked = {(r["label"], r["to"]): r["n"] for r in wants.collect()}  # a cell for each pair of shards
        if not asked:
            break
        load = {r["label"]: r["n"] for r in held.groupBy("label").agg(F.sum("n").alias("n")).collect()}
        let = []
        for s in range(n_shards):
            for t in range(n_shards):
                if n := asked.get((s, t), 0):
                    free = max(0, room[t] - load.get(t, 0)) // max(1, sum((k, t) in asked for k in range(n_shards)))
                    let.append((s, t, int(SCALE * min(1.0, (asked.get((t, s), 0) + free) / n))))
        quota = F.broadcast(spark.createDataFrame(let, "label int, to int, let int"))
        moving = now.join(best, "hub").join(quota, ["label", "to"], "left")
        goes = F.pmod(F.xxhash64("hub", F.lit(turn)), F.lit(SCALE)) < F.col("let")
        now = checkpointed(moving.select("row", "hub", F.when(goes, F.col("to")).otherwise(F.col("label")).alias("label")))
    return now


def shard(docs: DataFrame, n_shards: int = 8, rounds: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document, under the law `rows`."""
    text = F.col(text_col)
    whole = F.coalesce(text, F.lit(""))
    base = checkpointed(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(whole) + 1).cast("long").alias("size"),
            F.crc32(whole.cast("binary")).alias("text_crc32"),
            F.when(text.isNotNull(), F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))).alias("key"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    total = base.count()
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    groups = checkpointed(base.where("key is not null").groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    salts = F.ceil(F.col("n") / F.lit(float(max(1, total // (4 * n_shards)))))
    linked = base.join(groups, "key").select("row", F.xxhash64("key", F.pmod(F.xxhash64("row"), salts)).alias("hub"))
    labels = _propagate(linked, n_shards, room, rounds)

    placed = base.drop("key").join(labels, "row", "left").withColumn("first", F.col("label").isNotNull()).withColumn("label", F.coalesce("label", F.pmod(F.xxhash64("row"), F.lit(n_shards)).cast("int")))
    buckets = max(1, total // (n_shards * RANK_ROWS))
    # linked documents take the lower ranks, so that unlinked ones are the first to move
    spread = F.pmod(F.xxhash64(F.lit(3), "row"), F.lit(buckets)) + F.when(F.col("first"), F.lit(0)).otherwise(F.lit(buckets))
    ranked = checkpointed(_ranked(placed, ["label"], 2 * buckets, spread, [F.col("row")], "rank"))

    load = {r["label"]: r["n"] for r in ranked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    gaps = [max(0, room[s] - load.get(s, 0)) for s in range(n_shards)]
    quota = F.element_at(F.array(*map(F.lit, room)), F.col("label") + 1)
    stay = ranked.where(F.col("rank") < quota).select("doc_id", "size", "text_crc32", F.col("label").alias("shard"), F.col("rank").alias("slot"))
    surplus = ranked.where(F.col("rank") >= quota).withColumn("all", F.lit(0))
    moved = _ranked(surplus, ["all"], max(1, total // RANK_ROWS), F.xxhash64(F.lit(5), "row"), [F.col("row")], "place")
    to, slot, start = F.lit(None).cast("int"), F.lit(None).cast("long"), sum(gaps)
    for s in reversed(range(n_shards)):
        start -= gaps[s]
        here = (F.col("place") >= start) & (F.col("place") < start + gaps[s])
        to, slot = F.when(here, F.lit(s)).otherwise(to), F.when(here, F.col("place") - start + load.get(s, 0)).otherwise(slot)
    out = stay.unionByName(moved.select("doc_id", "size", "text_crc32", to.alias("shard"), slot.alias("slot")))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
