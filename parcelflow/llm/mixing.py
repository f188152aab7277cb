"""Mixing sources to target weights by balanced (cube) sampling.

Every source gets a target number of words from its weight. A document is taken a whole
number of times plus, with its source's fractional inclusion probability, once more. Those
extra picks come from the cube method: the vector of probabilities moves, three open
documents at a time, along the null space of the two balancing constraints (documents and
words), so both totals stay what they were while coordinates reach 0 or 1. Documents move in
blocks of bounded size; what stays open in the blocks meets in later rounds, and the last few
of a source are landed by trying all their combinations.

Null texts and texts without words have size 0. Null is a source of its own, last in order.
Equal rows are separate documents. Extra columns are ignored. Runs with one seed agree.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.llm import words as W
from parcelflow.llm.shared import checkpointed

#: Rows of one block of the flight phase.
BLOCK_ROWS = 2000
#: Open documents that a block hands on; they are of all sizes, and land finely together.
HANDED_ON = 8
#: Documents that the landing phase tries in all combinations.
LANDING = 14
EPS = 1e-9


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """One row for each source: source, source_id, source_size, n_docs, target.

    The window without a key runs over one aggregated row for each source.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = totals.withColumn("source_id", rank.cast("long"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_id") % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    row = ranked.withColumns({"weight": weight, "cap": cap}).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", "source_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy("ratio", "source_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # sources fill up in order of cap by weight; from the first that doesn't, all share by weight
    level = row.withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    open_level = F.when(F.col("level") <= F.col("ratio"), F.col("level"))
    levelled = level.withColumn("open_level", F.first(open_level, ignorenulls=True).over(everything))
    return levelled.select("source", "source_id", "source_size", "n_docs", F.least("cap", F.coalesce(F.col("open_level") * F.col("weight"), F.col("cap"))).alias("target"))


def _flight(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator, leave: int) -> np.ndarray:
    """Moves `pi` until at most `leave` (2 at least) of its coordinates are open; sums of pi and of pi * size stay."""
    pi = pi.copy()
    waiting = [k for k in np.argsort(-size, kind="stable").tolist() if EPS < pi[k] < 1 - EPS]
    # some of every size come last: sums of these are dense enough to land near the total
    late = {waiting[round(q)] for q in np.linspace(0, len(waiting) - 1, min(leave, len(waiting)))} if waiting else set()
    waiting = [k for k in waiting if k not in late] + sorted(late, key=lambda k: -size[k])
    active: list[int] = []
    left = len(waiting)
    draws = rng.random(len(waiting) + 1).tolist()
    position = 0
    while left > max(leave, 2):
        while len(active) < 3:
            active.append(waiting[position])
            position += 1
        a, b, c = active
        u = (float(size[c] - size[b]), float(size[a] - size[c]), float(size[b] - size[a]))
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = min((1 - pi[k]) / x if x > 0 else pi[k] / -x for k, x in zip(active, u, strict=True) if x)
        down = min(pi[k] / x if x > 0 else (1 - pi[k]) / -x for k, x in zip(active, u, strict=True) if x)
        step = up if draws[left - 1] * (up + down) < down else -down
        still = []
        for k, x in zip(active, u, strict=True):
            pi[k] += step * x
            if pi[k] < EPS or pi[k] > 1 - EPS:
                pi[k] = round(pi[k])
                left -= 1
            else:
                still.append(k)
        active = still
    return pi


def _land(pi: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Closes the open coordinates together with some closed ones of all sizes: the combination with the nearest word total, then document total, then the fewest changes."""
    pi = pi.copy()
    open_ = np.flatnonzero((pi > EPS) & (pi < 1 - EPS))
    if len(open_):
        closed = np.setdiff1d(np.argsort(-size, kind="stable"), open_, assume_unique=True)
        closed = closed[np.argsort(-size[closed], kind="stable")]
        extra = closed[np.unique(np.linspace(0, len(closed) - 1, max(0, LANDING - len(open_))).round().astype(int))] if len(closed) else closed
        units = np.concatenate([open_, extra])
        picks = (np.arange(1 << len(units))[:, None] >> np.arange(len(units))) & 1
        words = np.abs(picks @ size[units].astype(float) - float(pi[units] @ size[units])).round(6)
        count = np.abs(picks.sum(1) - pi[units].sum()).round(6)
        changed = np.abs(picks - pi[units]).sum(1)
        pi[units] = picks[np.lexsort((changed, count, words))[0]]
    return pi


def _block(seed: int, level: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id", "salt"], kind="stable", ignore_index=True)
        last = bool(rows["last"].iloc[0])
        size, pi = rows["size"].to_numpy(np.int64), rows["pi"].to_numpy(float)
        pi = _flight(pi, size, np.random.default_rng([seed, level, int(key[0]), int(key[1])]), HANDED_ON)
        return rows.assign(pi=_land(pi, size) if last else pi)

    return run


def _spread(numbered: DataFrame, block_rows: int) -> DataFrame:
    """`salt` becomes 0 but in rows that share source, id and size with many.

    These get the hash of their carried columns, and the ones that are many even so, which are
    interchangeable, keep a number of their own: no block holds them all.
    """
    same, most = ["source", "doc_id", "size"], F.lit(max(1, block_rows // 8))
    alike = numbered.groupBy(*same, "alike").agg(F.count("*").alias("equal"))
    shared = alike.groupBy(*same).agg(F.sum("equal").alias("equal")).where(F.col("equal") > most)
    out = numbered
    for name, keys, columns in (("shared", shared, same), ("equal", alike.where(F.col("equal") > most), [*same, "alike"])):
        hot = keys.select(*(F.col(c).alias(f"hot_{c}") for c in columns), F.lit(True).alias(f"is_{name}"))
        out = out.join(hot, [F.col(c).eqNullSafe(F.col(f"hot_{c}")) for c in columns], "left").drop(*(f"hot_{c}" for c in columns))
    salt = F.when(F.col("is_equal"), F.xxhash64("alike", "salt")).when(F.col("is_shared"), F.col("alike")).otherwise(F.lit(0).cast("long"))
    return out.withColumn("salt", salt).drop("is_shared", "is_equal", "alike")


def _salted(*parts: Column | str) -> Column:
    return F.when(F.col("salt") == 0, F.xxhash64(*parts)).otherwise(F.xxhash64(*parts, "salt"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), share: float = 1.0, most: float = 3.0, seed: int = 11, block_rows: int = BLOCK_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and the columns `carry` for every document.

    `weights` repeat over the sources in code point order; all targets add up to `share` of
    all words; no target exceeds `most` times its source.
    """
    numbered = docs.select("doc_id", "source", *carry, W.word_count(F.col("text")).alias("size")).withColumns({"salt": F.monotonically_increasing_id(), "alike": F.xxhash64(*carry) if carry else F.lit(0).cast("long")})
    sized = checkpointed(_spread(checkpointed(numbered), block_rows))
    targets = checkpointed(source_targets(sized, weights, share, most))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    rated = sized.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of", "source").withColumn("rate", rate)
    base = F.floor(F.col("rate") + F.lit(EPS))
    blocks = F.ceil(F.col("n_docs") / F.lit(float(block_rows)))
    state = rated.select("doc_id", *carry, "salt", "size", "source_size", "target", "source_id", base.alias("base"), F.greatest(F.col("rate") - base, F.lit(0.0)).alias("pi"), F.pmod(_salted("doc_id", "size"), blocks).cast("long").alias("block"), (blocks <= 1).alias("last"))
    schema = state.schema
    done: list[DataFrame] = []
    level = 0
    while True:
        moved = checkpointed(state.groupBy("source_id", "block").applyInPandas(_block(seed, level), schema))
        is_open = (F.col("pi") > EPS) & (F.col("pi") < 1 - EPS)
        done.append(moved.where(~is_open))
        rest = moved.where(is_open)
        if rest.isEmpty():
            break
        level += 1
        sums = rest.groupBy("source_id").agg(F.count("*").alias("open_docs"))
        again = F.ceil(F.col("open_docs") / F.lit(float(block_rows)))
        state = rest.join(sums, "source_id").withColumns({"block": F.pmod(_salted("doc_id", "size", F.lit(level)), again).cast("long"), "last": again <= 1}).select(*schema.names)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    copies = F.col("base") + F.round("pi").cast("long")
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), *carry)
