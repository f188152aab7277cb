"""Periodic runs of words: maximal stretches that repeat a period at least twice, found by suffix automata.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at
least `max(least, 2 * q)` words long, that no neighbouring word extends keeping period q.

The stretches of a text where a run can stand are isolated first, in numpy: every word of a run is
part of a sequence of `ceil(least / 2)` words that occurs again at most half a stretch away. For
each such stretch a suffix automaton is built. Its states hold the ordered sets of their end
positions, merged from the leaves of the suffix links, the smaller set into the larger. Where two
positions become neighbours in a state whose length reaches their distance, a square ends there;
each square is extended both ways to its run. The word twice in a square is primitive for at least
one square of each run, so runs that squares of a multiple of the period give are dropped. Words
are compared by their bytes.

Null and empty texts, and texts without words, have no run. Repeated rows have equal results, ties
do not arise, ids may be null. Extra columns are ignored. Tasks work on a text at a time: nothing
is shuffled, and a stretch of n repeating words takes about n * 700 bytes while it is searched.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelflow.llm import textarrays as T
from parcelflow.llm import words as W
from parcelflow.llm.shared import trimmed

#: Words that a run has at least.
LEAST = 12
#: Positions that one part of an ordered set holds.
PART = 1024
RUNS = "array<struct<start: long, length: long, period: long>>"


def automaton(symbols: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Length, suffix link and end position (-1 for clones) of every state of the suffix automaton; state 0 is the root."""
    length, link, end = [0], [-1], [-1]
    step: list[dict[int, int]] = [{}]
    last = 0
    for at, symbol in enumerate(symbols):
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        end.append(at)
        step.append({})
        state = last
        while state >= 0 and symbol not in step[state]:
            step[state][symbol] = new
            state = link[state]
        if state >= 0:
            goal = step[state][symbol]
            if length[goal] == length[state] + 1:
                link[new] = goal
            else:
                clone = len(length)
                length.append(length[state] + 1)
                link.append(link[goal])
                end.append(-1)
                step.append(step[goal].copy())
                link[goal] = link[new] = clone
                while state >= 0 and step[state].get(symbol) == goal:
                    step[state][symbol] = clone
                    state = link[state]
        last = new
    return length, link, end


class Ends:
    """An ordered set of end positions, in parts of bounded size."""

    __slots__ = ("heads", "parts", "size")

    def __init__(self, position: int):
        self.parts, self.heads, self.size = [[position]], [position], 1

    def add(self, x: int) -> tuple[int, int]:
        """Puts x in; its neighbours before and after, -1 for none."""
        parts, heads = self.parts, self.heads
        k = max(0, bisect_left(heads, x) - 1)
        part = parts[k]
        i = bisect_left(part, x)
        before = part[i - 1] if i else -1
        after = part[i] if i < len(part) else heads[k + 1] if k + 1 < len(heads) else -1
        part.insert(i, x)
        if not i:
            heads[k] = x
        self.size += 1
        if len(part) > PART:
            parts[k : k + 1] = [part[: PART // 2], part[PART // 2 :]]
            heads.insert(k + 1, part[PART // 2])
        return before, after


def squares(symbols: list[int]) -> set[tuple[int, int]]:
    """(period, last position) of squares: at least one in every run, each of a period no longer than its state."""
    length, link, end = automaton(symbols)
    held: list[Ends | None] = [Ends(x) if x >= 0 else None for x in end]
    found: set[tuple[int, int]] = set()
    for state in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        above, mine = link[state], held[state]
        held[state] = None
        if above <= 0:
            continue  # the root's length is 0: no square is seen there
        other = held[above]
        if other is None:
            held[above] = mine
            continue
        if mine.size > other.size:
            mine, other = other, mine
        most = length[above]
        for part in mine.parts:
            for x in part:
                before, after = other.add(x)
                if before >= 0 and x - before <= most:
                    found.add((x - before, x))
                if after >= 0 and after - x <= most:
                    found.add((after - x, after))
        held[above] = other
    return found


def _equal_run(values: np.ndarray, i: int, j: int, step: int) -> int:
    """How many positions from i and j on, towards `step`, are equal; looks at doubling stretches."""
    done, size = 0, 32
    while True:
        room = len(values) - max(i, j) if step > 0 else min(i, j) + 1
        n = min(size, room)
        if n <= 0:
            return done
        a = values[i : i + n] if step > 0 else values[i - n + 1 : i + 1][::-1]
        b = values[j : j + n] if step > 0 else values[j - n + 1 : j + 1][::-1]
        wrong = np.flatnonzero(a != b)
        if len(wrong):
            return done + int(wrong[0])
        done, size = done + n, size * 2
        i, j = i + step * n, j + step * n


def runs_of(symbols: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    values = np.array(symbols, np.int64)
    found: dict[tuple[int, int], int] = {}
    seen_period, seen_end = 0, 0
    for period, last in sorted(squares(symbols)):
        if period == seen_period and last < seen_end:
            continue  # in the run found before: two runs of one period share fewer words than it
        first = last - 2 * period + 1
        start = first - _equal_run(values, first - 1, first - 1 + period, -1)
        stop = last + 1 + _equal_run(values, last + 1 - period, last + 1, 1)
        seen_period, seen_end = period, stop
        if stop - start >= max(least, 2 * period):
            found.setdefault((start, stop), period)  # periods ascend: the smallest comes first
    return sorted((start, stop - start, period) for (start, stop), period in found.items())


def stretches(words: T.Words, least: int = LEAST) -> list[tuple[int, int]]:
    """Ranges of words of a chunk, each within a text, outside of which no run has a word."""
    gram = (least + 1) // 2
    hashes, bounds = words.sequences(gram)
    if not len(hashes):
        return []
    counts = np.diff(bounds)
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(hashes)) - bounds[text] + words.bounds[text]  # the word that each sequence starts with
    key = hashes ^ T.mix(text.astype(np.uint64), 5)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    left, right = at[order[:-1][same]], at[order[1:][same]]
    near = 2 * (right - left) <= words.counts()[text[order[:-1][same]]]
    left, right = left[near], right[near]
    n = int(words.bounds[-1])
    while len(left):
        edge = np.zeros(n + 1, np.int64)
        for side in (left, right):
            np.add.at(edge, side, 1)
            np.add.at(edge, side + gram, -1)
        inside = np.cumsum(edge[:-1]) > 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        cut = words.bounds[:-1][words.bounds[:-1] < n]
        begins[cut] = inside[cut]  # a text starts a stretch of its own
        starts = np.flatnonzero(begins)
        closes = inside & np.append(begins[1:] | ~inside[1:], True)
        ends = np.flatnonzero(closes) + 1
        part = np.searchsorted(starts, left, side="right") - 1
        size = ends[part] - starts[part]
        stay = (size >= least) & (2 * (right - left) <= size) & (right < ends[part])
        if stay.all():
            return list(zip(starts.tolist(), ends.tolist(), strict=True))
        left, right = left[stay], right[stay]
    return []


def _runs_of_chunk(chunk: T.Chunk, words: T.Words, least: int) -> dict[int, list[tuple[int, int, int]]]:
    """Runs of the texts that have one; starts count from the text's first word."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    for start, stop in stretches(words, least):
        names: dict[bytes, int] = {}
        symbols = [names.setdefault(chunk.data[a:b].tobytes(), len(names)) for a, b in zip(words.starts[start:stop].tolist(), words.ends[start:stop].tolist(), strict=True)]
        if runs := runs_of(symbols, least):
            k = int(np.searchsorted(words.bounds, start, side="right")) - 1
            found.setdefault(k, []).extend((start + s - int(words.bounds[k]), n, q) for s, n, q in runs)
    return found


def _collapsed(chunk: T.Chunk, words: T.Words, runs: dict[int, list[tuple[int, int, int]]]) -> pa.Array:
    """The words of each text outside of every run's repeats, joined by one space."""
    kept = np.ones(len(words.starts), bool)
    for k, found in runs.items():
        for start, size, period in found:
            first = int(words.bounds[k]) + start
            kept[first + period : first + size] = False
    starts, ends = words.starts[kept], words.ends[kept]
    bounds = np.append(0, np.cumsum(kept))[words.bounds]
    joint = np.ones(len(starts), bool)
    joint[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = False  # the last word of a text has no space after it
    edge = np.zeros(len(chunk.data) + 2, np.int8)
    edge[starts] = 1
    np.add.at(edge, ends + joint, -1)  # a kept word that another follows has white space behind it
    inside = np.cumsum(edge[: len(chunk.data)], dtype=np.int8) > 0
    data = chunk.data.copy()
    data[ends[joint]] = 0x20
    offsets = np.append(0, np.cumsum(inside))[chunk.offsets]
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[inside]))


def collapse(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed: the words but the repeats of runs, joined by one space."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in T.chunks(batch.column("text")):
                words = T.words_of(chunk)
                runs = _runs_of_chunk(chunk, words, least)
                rows = [sorted(runs.get(k, ()), key=lambda r: (r[0], r[2])) for k in range(chunk.last - chunk.first)]
                listed = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in row] for row in rows], kind)
                ids = batch.column("doc_id").slice(chunk.first, chunk.last - chunk.first)
                yield pa.RecordBatch.from_arrays([ids, pa.array(words.counts(), pa.int64()), listed, _collapsed(chunk, words, runs)], names=["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(trimmed(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed string")


def with_repeats(doc_id: Column, text: Column) -> Column:
    """`text`, which for a tenth of the ids ends in three to eleven repeats of a passage of its own words.

    With h the crc32 of the id in decimals and g = floor(h / 10): if h % 10 = 0, of n words each word
    i >= a becomes word a + (i - a) % p, where a = g % n and p = 1 + floor((n - a) / (3 + g % 8)).
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(x: Column) -> Column:
        words, g = x["words"], x["g"]
        n = F.size(words).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        taken = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.element_at(words, (F.when(i < a, i).otherwise(a + (i - a) % p) + 1).cast("int")))
        return F.array_join(taken, " ")

    once = F.transform(F.array(F.struct(W.words(text).alias("words"), g.alias("g"))), lambda x: F.when(F.size(x["words"]) > 0, repeated(x)))
    return F.when(h % 10 == 0, F.element_at(once, 1)).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """The longest run (ties: least start, then period) and digests of all runs and of the collapsed text."""
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    one = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("one"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length, period = -F.col("one")["less"], F.col("one")["period"]
    return one.select("doc_id", "n_runs", F.col("one")["start"].alias("start"), length.alias("length"), period.alias("period"), F.floor(length * 1000 / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
