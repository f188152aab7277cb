"""Removal of word passages that an earlier document has, by suffix automata of reference shards.

A window is `window` consecutive words of one document. Every word goes that a window covers
whose words also start somewhere in a document with a smaller id; windows are judged on the input.

Documents meet a shard's automaton only where they can match it:

1. Each window names a seed, the least hash of its 8-word sequences; equal windows name equal
   seeds. Windows of one seed in a row form a run. Seeds of one document only are dropped.
2. Equal runs meet by a 128-bit hash: all but those of the least document go whole.
3. The different runs of a seed are a reference shard. Its runs stream by rising id through a
   suffix automaton of the runs before; where the matching statistic reaches the window, the
   window goes, and the stretches that were not matched are added to the automaton.
4. A seed with more than `SHARD_RUNS` different runs, such as one in a line that very many documents
   hold, is split: windows with most words before the seed go by the words just before it, the others by
   the words just after. A part that is still crowded, the edge of a passage that very many documents share,
   would make a shard without bound; its windows meet by a 128-bit hash in an aggregation.

Automata of all shards are not broadcast to all documents: that work would grow with the square of
the corpus. Null texts have no words. Rows without id are kept whole and are no reference. Rows with
one id never remove words of each other. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow.llm import textarrays as T
from parcelflow.llm import words as W
from parcelflow.llm.shared import checkpointed, divided, trimmed, unused

WINDOW = 50
SEED_WORDS = 8
#: Different runs that one automaton takes.
SHARD_RUNS = 256


class SuffixAutomaton:
    """All substrings of the sequences added so far, over any hashable tokens."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, tokens: list) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for token in tokens:
            there = nxt[last].get(token)
            if there is not None and length[there] == length[last] + 1:
                last = there
                continue
            if there is not None:
                last = self._split(last, token, there)
                continue
            made = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            at = last
            while at >= 0 and token not in nxt[at]:
                nxt[at][token] = made
                at = link[at]
            if at >= 0:
                to = nxt[at][token]
                link[made] = to if length[to] == length[at] + 1 else self._split(at, token, to)
            last = made

    def _split(self, at: int, token: object, to: int) -> int:
        """A copy of state `to` for the strings no longer than those that reach it from `at`."""
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[to]))
        length.append(length[at] + 1)
        link.append(link[to])
        link[to] = copy
        while at >= 0 and nxt[at].get(token) == to:
            nxt[at][token] = copy
            at = link[at]
        return copy

    def statistics(self, tokens: list) -> list[int]:
        """For each position, the length of the longest substring that ends there and is known."""
        nxt, link, length = self.next, self.link, self.length
        state = matched = 0
        out = []
        for token in tokens:
            while state and token not in nxt[state]:
                state = link[state]
                matched = length[state]
            to = nxt[state].get(token)
            if to is not None:
                state = to
                matched += 1
            out.append(matched)
        return out


def _stretches(flags: list[bool]) -> list[tuple[int, int]]:
    """Start and length of the stretches of true flags."""
    padded = np.diff(np.concatenate([[0], np.asarray(flags, np.int8), [0]]))
    starts = np.flatnonzero(padded == 1)
    return list(zip(starts.tolist(), (np.flatnonzero(padded == -1) - starts).tolist(), strict=True))


def repeated_in_shard(runs: list[tuple[int, list]], window: int) -> list[list[tuple[int, int]]]:
    """For each run (id, words), by rising id: stretches of windows that runs of smaller ids have."""
    automaton = SuffixAutomaton()
    out: list[list[tuple[int, int]]] = []
    start = 0
    while start < len(runs):
        stop = start
        while stop < len(runs) and runs[stop][0] == runs[start][0]:
            stop += 1
        fresh = []
        for _, words in runs[start:stop]:
            known = [n >= window for n in automaton.statistics(words)[window - 1 :]]
            out.append(_stretches(known))
            fresh += [words[a : a + n + window - 1] for a, n in _stretches([not k for k in known])]
        for words in fresh:  # only now, as rows of one id are no reference for each other
            automaton.add(words)
        start = stop
    return out


def _least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of values[i : i + width] for each i."""
    out, span = values, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(values) - width + 1], out[width - span :]) if span < width else out


def _runs_of(chunk: T.Chunk, window: int) -> tuple[np.ndarray, ...]:
    """text, start, count, seed, h1, h2 of every run of a chunk; start is a word of the text."""
    words = T.words_of(chunk)
    k = min(SEED_WORDS, window)
    grams, gram_bounds = words.sequences(k)
    width = window - k + 1
    counts = np.maximum(words.counts() - window + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    if not bounds[-1]:
        return tuple(np.empty(0, d) for d in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64))
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(bounds[-1]) - bounds[:-1][text]
    seed = _least_in_windows(grams, width)[gram_bounds[:-1][text] + at]
    new = np.ones(len(seed), bool)
    new[1:] = (seed[1:] != seed[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(seed)))
    begin = words.bounds[:-1][text[first]] + at[first]
    end = begin + count + window - 1
    other = T.Words(words.starts, words.ends, words.bounds, T.mix(words.hashes, 31))
    return text[first], at[first], count, seed[first], words.ranges(begin, end), other.ranges(begin, end)


def _signed(docs: DataFrame) -> DataFrame:
    """Id, text and a hash of the text, which tells rows of one id apart."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("th"))


def _runs(docs: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in T.chunks(batch.column("text")):
                text, start, count, *hashes = _runs_of(chunk, window)
                rows = pa.array(text + chunk.first)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("th").take(rows), pa.array(start, pa.int32()), pa.array(count, pa.int32()), *(pa.array(h.view(np.int64)) for h in hashes)], names=["doc_id", "th", "start", "count", "seed", "h1", "h2"])

    return _signed(docs).where("doc_id is not null").mapInArrow(trimmed(run), "doc_id long, th long, start int, count int, seed long, h1 long, h2 long")


def _split_by_context(words: T.Words, begin: int, count: int, seed: int, window: int) -> list[tuple[int, int, int]]:
    """(first window, number of windows, new seed) of the parts of a run: by the words next to the seed, on the side of it that has more.

    Where words repeat the seed has many places in a run, and windows of one context stay together.
    """
    k = min(SEED_WORDS, window)
    half = (window - k) // 2
    starts = np.arange(begin, begin + count + window - k)
    places = starts[words.ranges(starts, starts + k).view(np.int64) == seed]
    at = np.arange(begin, begin + count)
    place = places[np.searchsorted(places, at)]
    before = place - at >= half
    low = np.where(before, place - half, place + k)
    high = np.where(before, place, place + window - half)
    context = T.mix(words.ranges(low, high) ^ T.mix(np.full(count, seed, np.int64).view(np.uint64), 41), 42) + before.astype(np.uint64)
    new = np.ones(count, bool)
    new[1:] = context[1:] != context[:-1]
    first = np.flatnonzero(new)
    return list(zip(first.tolist(), np.diff(np.append(first, count)).tolist(), context[first].view(np.int64).tolist(), strict=True))


def _contested(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The words of the wanted runs, as text; `at` is the run's window that the row begins with, crowded seeds come in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column("runs").to_pylist()
            ids = batch.column("doc_id").to_pylist()
            for chunk in T.chunks(batch.column("text")):
                words = T.words_of(chunk)
                out: list[tuple] = []
                for k in range(chunk.last - chunk.first):
                    for r in runs[chunk.first + k]:
                        begin = words.bounds[k] + r["start"]
                        parts = _split_by_context(words, begin, r["count"], r["seed"], window) if r["crowded"] else [(0, r["count"], r["seed"])]
                        for at, n, shard in parts:
                            low, high = begin + at, begin + at + n + window - 1
                            text = b" ".join(bytes(chunk.data[a:b]) for a, b in zip(words.starts[low:high], words.ends[low:high], strict=True)).decode()
                            out.append((shard, r["seed"], r["h1"], r["h2"], ids[chunk.first + k], at, text))
                columns = list(zip(*out, strict=True)) or [()] * 7
                kinds = [pa.int64()] * 5 + [pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["shard", "seed", "h1", "h2", "doc_id", "at", "words"])

    by_row = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "count", "seed", "h1", "h2", "crowded")).alias("runs"))
    near, _ = divided(_signed(docs), wanted)
    return near.join(by_row, ["doc_id", "th"]).select("doc_id", "text", "runs").mapInArrow(trimmed(run), "shard long, seed long, h1 long, h2 long, doc_id long, at int, words string")


def _windows(crowded: DataFrame, window: int) -> DataFrame:
    """A row with a 128-bit hash for each different window of each row, and its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in T.chunks(batch.column("words")):
                words = T.words_of(chunk)
                w1, bounds = words.sequences(window)
                w2, _ = T.Words(words.starts, words.ends, words.bounds, T.mix(words.hashes, 31)).sequences(window)
                row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                at = part_at(batch, chunk)[row] + np.arange(len(row)) - bounds[:-1][row]
                order = np.lexsort((at, w2, w1, row))
                row, w1, w2, at = row[order], w1[order], w2[order], at[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])
                first = np.flatnonzero(new)
                part = batch.slice(chunk.first, chunk.last - chunk.first).take(pa.array(row[first]))
                places = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), pa.array(at, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("seed", "h1", "h2", "doc_id")), places, pa.array(w1[first].view(np.int64)), pa.array(w2[first].view(np.int64))], names=["seed", "h1", "h2", "doc_id", "places", "w1", "w2"])

    def part_at(batch: pa.RecordBatch, chunk: T.Chunk) -> np.ndarray:
        return batch.column("at").to_numpy()[chunk.first : chunk.last]

    return crowded.select("seed", "h1", "h2", "doc_id", "at", "words").mapInArrow(trimmed(run), "seed long, h1 long, h2 long, doc_id long, places array<int>, w1 long, w2 long")


def _by_automata(runs: DataFrame, window: int) -> DataFrame:
    """seed, h1, h2 and the repeated stretches of windows (at, n) of the runs whose shard has them earlier."""
    dealt = runs.select("shard", "seed", "h1", "h2", "doc_id", "at", "words").repartition("shard").sortWithinPartitions("shard", "doc_id", "h1", "h2", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        shard: list[tuple[int, tuple[int, int, int], int, list]] = []
        out: list[tuple[int, int, int, int, int]] = []

        def close() -> None:
            if len(shard) > 1:
                for (_, key, start, _), found in zip(shard, repeated_in_shard([(r[0], r[3]) for r in shard], window), strict=True):
                    out.extend((*key, start + at, n) for at, n in found)

        for batch in batches:
            for s, seed, h1, h2, doc_id, at, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != now:
                    close()
                    now, shard = s, []
                shard.append((doc_id, (seed, h1, h2), at, words.split(" ")))
            yield _stretch_batch(out)
            out = []
        close()
        yield _stretch_batch(out)

    return dealt.mapInArrow(trimmed(run), "seed long, h1 long, h2 long, at int, n int")


def _stretch_batch(rows: list[tuple[int, int, int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 3 else pa.int32()) for k, c in enumerate(columns)], names=["seed", "h1", "h2", "at", "n"])


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, th and the spans (first window, number of windows) whose words an earlier document has."""
    runs = checkpointed(_runs(docs, window))
    met = runs.groupBy("seed").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("seed")
    shared = checkpointed(runs.join(met, "seed"))
    key = ["seed", "h1", "h2"]
    distinct = checkpointed(shared.groupBy(*key).agg(F.min(F.struct("doc_id", "th", "start", "count")).alias("f")))
    crowd = distinct.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1")
    wanted = checkpointed(distinct.join(crowd, "seed").select(*key, "f.*", (F.col("n") > SHARD_RUNS).alias("crowded")))
    contested = checkpointed(_contested(docs, wanted, window))

    sizes = checkpointed(contested.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1"))
    sized = contested.join(sizes, "shard")
    windows = _windows(sized.where(F.col("n") > SHARD_RUNS), window)
    least = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("w1", "w2", "low")
    by_hash = windows.join(least, ["w1", "w2"]).where("doc_id > low").select(*key, F.explode("places").alias("at"), F.lit(1).alias("n"))
    inner = _by_automata(sized.where(F.col("n") <= SHARD_RUNS), window).unionByName(by_hash)
    inner = inner.groupBy(*key).agg(F.collect_list(F.struct("at", "n")).alias("parts"))

    judged = shared.join(distinct.select(*key, F.col("f.doc_id").alias("low")), key).join(inner, key, "left")
    whole = F.array(F.struct(F.lit(0).alias("at"), F.col("count").alias("n")))
    parts = F.when(F.col("doc_id") > F.col("low"), whole).otherwise(F.col("parts"))
    spans = judged.where((F.col("doc_id") > F.col("low")) | F.col("parts").isNotNull()).select("doc_id", "th", F.transform(parts, lambda p: F.struct((p["at"] + F.col("start")).alias("at"), p["n"].alias("n"))).alias("spans"))
    return checkpointed(spans.groupBy("doc_id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans")))


def _kept(n_words: int, spans: list[dict], window: int) -> np.ndarray:
    """Whether each word stays."""
    steps = np.zeros(n_words + 1, np.int64)
    for s in spans:
        steps[s["at"]] += 1
        steps[min(n_words, s["at"] + s["n"] + window - 1)] -= 1
    return np.cumsum(steps[:-1]) == 0


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by one space) for every row.

    Only texts that lose words, and few besides, are shuffled to their spans.
    """
    spans = repeated_spans(docs, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = (text or "").encode().split()
                n_words.append(len(words))
                words = list(compress(words, _kept(len(words), found, window)))
                n_removed.append(n_words[-1] - len(words))
                kept.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    near, _ = divided(_signed(docs), spans)
    cut = near.join(spans, ["doc_id", "th"]).select("doc_id", "text", "spans").mapInArrow(trimmed(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")
    text = F.coalesce("text", F.lit(""))
    joined = F.regexp_replace(F.btrim(text, F.lit(W.SPACES)), W.SPACE_RUN, " ")
    whole = _signed(docs).select("doc_id", "th", W.word_count(text).alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.sha2(joined.cast("binary"), 256).alias("kept_sha256"))
    return whole.join(spans, ["doc_id", "th"], "left_anti").drop("th").unionByName(cut)


def strip(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` with repeated passages cut out: other texts stay as they are, cut ones keep their white space
    between kept words that were neighbours and get a space at a cut; texts with no word left go, n_chars follows."""
    th = F.xxhash64("text")
    own_id, own_th, cuts = (unused(name, docs) for name in ("id_of_spans", "hash_of_spans", "spans_of_text"))
    spans = repeated_spans(docs, window)
    near, rest = divided(docs, spans)
    named = spans.select(F.col("doc_id").alias(own_id), F.col("th").alias(own_th), F.col("spans").alias(cuts))
    held = near.join(named, (near["doc_id"] == F.col(own_id)) & (th == F.col(own_th)), "left").drop(own_id, own_th)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, spans = batch.column("text"), batch.column(cuts).to_pylist()
            texts, stays = column.to_pylist(), [True] * batch.num_rows
            for chunk in T.chunks(column):
                words = T.words_of(chunk)
                for k in range(chunk.last - chunk.first):
                    if not spans[chunk.first + k]:
                        continue
                    a, b = words.bounds[k], words.bounds[k + 1]
                    parts = _stretches(_kept(b - a, spans[chunk.first + k], window).tolist())
                    texts[chunk.first + k] = " ".join(bytes(chunk.data[words.starts[a + i] : words.ends[a + i + n - 1]]).decode() for i, n in parts)
                    stays[chunk.first + k] = bool(parts)
            out = {name: batch.column(name) for name in batch.schema.names if name != cuts} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in out:
                out["n_chars"] = pa.array([len(t) if s and t is not None else n for t, s, n in zip(texts, spans, batch.column("n_chars").to_pylist(), strict=True)], batch.column("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out)).filter(pa.array(stays))

    return held.mapInArrow(trimmed(run), docs.schema).unionByName(rest)


ORACLE = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, i, array_to_string(w[i:i + 49], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from w where len(w) >= 50)),
m as (select g, min(doc_id) as low from s group by g having count(*) > 1),
r as (select distinct s.doc_id, s.i + k as p from s join m on s.g = m.g and s.doc_id > m.low, (select unnest(range(50)) as k)),
p as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from w),
k as (select p.doc_id, count(*) as n, string_agg(word, ' ' order by p.p) as t from p anti join r on p.doc_id = r.doc_id and p.p = r.p group by p.doc_id)
select w.doc_id, len(w.w)::bigint as n_words, (len(w.w) - coalesce(k.n, 0))::bigint as n_removed, sha256(coalesce(k.t, '')) as kept_sha256
from w left join k using (doc_id)
"""
