"""Join of documents whose word shingles have a Jaccard similarity of a threshold or more.

Prefix filtering under several global orders. In any one order of all shingles, two sets that
are similar enough share several shingles among their first ones. Candidates must do so under three
orders, and every order sees only what the one before left:

1. Of each document's short prefix under the first order, the shingles are counted that any other prefix
   holds. A document with too few of them links with none and goes; most do.
2. The others, each set once, do the same with a longer prefix under the second order. Of what stays, a
   shingle that few sets have in their prefix gives pairs, which stay if they share enough. One that many
   have would give too many: its sets are tied to the least of them, but only sets whose prefix has
   enough such shingles to link by them. Pairs and ties make groups.
3. Within a group the three filters are intersected for each pair, with the sizes; what is left is
   verified exactly on the full sets.

All orders put shingles that are frequent in many documents last (from counts in a table of fixed
size over all documents) and hash the rest, each order with another salt. Frequent ones count as held by
others without a look, so that no shingle of very many documents is gathered in one place.

A group of at most `CELL_SETS` sets is one task. A larger one is dealt into cells by size level. First each
cell is verified within itself and with leaders, some sets of each level that go to all its cells. Sets
of the component that is then the largest need no look at each other again; only the rest meets
everything of its level and the neighbouring ones, cell by cell. What comes out are links that span
the components of a task, never all pairs.

Words are those of [^\\x20\\x09-\\x0D]+ with A-Z folded. Shingles are 64-bit hashes. Fewer words
than a shingle are one shingle; without words the set is empty and links with nothing, like null
texts. Rows without id are returned with a null component. Rows with equal ids are one node. Extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.llm import textarrays as T
from parcelflow.llm.shared import Scratch, checkpointed, connected_components, divided, trimmed

#: Cells of the table that counts frequent shingles; its size does not follow the data.
FREQUENCY_CELLS = 1 << 18
#: Sets and shingles that one cell of a large group holds, about.
CELL_SETS, CELL_SHINGLES = 1024, 1_500_000
COLUMNS = 1024
#: Lists of one task that share a value from which it counts by matrix products.
COMMON = 48
#: Sets of a prefix shingle up to which it gives pairs.
RARE = 12
#: Leaders of one size level of a group that several cells hold.
LEADERS = 8
#: Share of a set's shingles, in hundredths, that prefixes have in common at least, by order.
SHARES = {1: 5, 2: 35, 3: 40}


@dataclass(frozen=True)
class Terms:
    """Shingles of `words` words; a link from `part` hundredths of similarity."""

    words: int = 4
    part: int = 85

    def least_overlap(self, n: int) -> int:
        """Common shingles that a set of n has with any linked one, at least."""
        return -(-self.part * n // 100)

    def common(self, n: int, order: int) -> int:
        """Shingles that the prefix of a set of n shares with those of larger linked sets, at least; never falls with n.

        The first order sees all documents and keeps prefixes short; the others see few and ask for more.
        """
        return SHARES[order] * n // 100 + 1

    def need(self, n: int, order: int) -> int:
        """Those that it shares with the prefix of any linked set, at least: a linked set has `least_overlap` shingles or more."""
        return self.common(self.least_overlap(n), order)

    def prefix(self, n: int, order: int) -> int:
        """At most n - least_overlap shingles of the set are not in a linked one, so its first `common` ones that are lie within this prefix."""
        return min(n, n - self.least_overlap(n) + self.common(n, order))


def sets_of(chunk: T.Chunk, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = T.words_of(chunk, lower=True)
    grams, bounds = words.sequences(size)
    out = [np.unique(grams[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    few = np.flatnonzero((words.counts() > 0) & (words.counts() < size))
    for k, h in zip(few, words.ranges(words.bounds[few], words.bounds[few + 1]), strict=True):
        out[k] = np.array([h], np.uint64)
    return out


def ranks(shingles: np.ndarray, order: int, frequency: np.ndarray) -> np.ndarray:
    """Place of each shingle in a global order: by frequency class, then by a hash of the order's own."""
    grade = frequency[(shingles & np.uint64(FREQUENCY_CELLS - 1)).astype(np.int64)].astype(np.uint64)
    return (grade << np.uint64(58)) | (T.mix(shingles, order) >> np.uint64(6))


def prefix_of(shingles: np.ndarray, order: int, frequency: np.ndarray, terms: Terms) -> np.ndarray:
    if not len(shingles):
        return shingles
    p = terms.prefix(len(shingles), order)
    return shingles[np.argpartition(ranks(shingles, order, frequency), p - 1)[:p]]


def frequencies(docs: DataFrame, terms: Terms) -> np.ndarray:
    """A grade for each cell of the frequency table: 0 for ordinary ones, more the more frequent.

    Each task counts its shingles and reports the cells far above its mean; at most
    FREQUENCY_CELLS sums come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, n_docs = np.zeros(FREQUENCY_CELLS, np.int64), 0
        for batch in batches:
            for chunk in T.chunks(batch.column("text")):
                found, _ = T.words_of(chunk, lower=True).sequences(terms.words)
                cells += np.bincount((found & np.uint64(FREQUENCY_CELLS - 1)).astype(np.int64), minlength=FREQUENCY_CELLS)
                n_docs += chunk.last - chunk.first
        top = np.flatnonzero(cells > max(8, n_docs / 200 + 3 * cells.mean()))
        yield pa.RecordBatch.from_arrays([pa.array(top, pa.int64()), pa.array(cells[top], pa.int64())], names=["cell", "n"])

    grade = np.zeros(FREQUENCY_CELLS, np.uint8)
    for row in docs.select("text").mapInArrow(trimmed(run), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        grade[row["cell"]] = min(31, int(row["n"]).bit_length())
    return grade


def signatures(docs: DataFrame, frequency: np.ndarray, terms: Terms, order: int) -> DataFrame:
    """doc_id, n, h1, h2 (a 128-bit hash of the set), common, need, and the prefix under an order: frequent shingles of it apart."""
    shared = docs.sparkSession.sparkContext.broadcast(frequency)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in T.chunks(batch.column("text")):
                sets = sets_of(chunk, terms.words)
                part = batch.column("doc_id").slice(chunk.first, chunk.last - chunk.first)
                hashes = [pa.array(np.array([T.mix(s, salt).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64).view(np.int64)) for salt in (21, 22)]
                found = [prefix_of(s, order, shared.value, terms) for s in sets]
                often = [shared.value[(p & np.uint64(FREQUENCY_CELLS - 1)).astype(np.int64)] > 0 for p in found]
                bounds = [pa.array([f(len(s), order) for s in sets], pa.int32()) for f in (terms.common, terms.need)]
                lists = [_lists([p[~o] for p, o in zip(found, often, strict=True)]), _lists([p[o] for p, o in zip(found, often, strict=True)])]
                yield pa.RecordBatch.from_arrays([part, pa.array([len(s) for s in sets], pa.int64()), *hashes, *bounds, *lists], names=["doc_id", "n", "h1", "h2", "common", "need", "prefix", "frequent"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id long, n long, h1 long, h2 long, common int, need int, prefix array<long>, frequent array<long>")


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.uint64).view(np.int64)))


def _met(signed: DataFrame) -> DataFrame:
    """doc_id, token and m, the number of prefixes that hold the token, for every token that several hold; frequent ones are left out."""
    tokens = signed.select("doc_id", F.explode("prefix").alias("token"))
    return tokens.withColumn("m", F.count("*").over(Window.partitionBy("token"))).where("m > 1")


def _enough(signed: DataFrame, met: DataFrame) -> DataFrame:
    """doc_id, common, need and warm of the documents whose prefix holds enough tokens that others hold; warm: those of more than RARE prefixes."""
    bounds = signed.groupBy("doc_id").agg(F.min("common").alias("common"), F.min("need").alias("need"), F.sum(F.size("frequent")).alias("often"))
    have = met.groupBy("doc_id").agg(F.count("*").alias("have"), F.count_if(F.col("m") > RARE).alias("warm"))
    held = bounds.join(have, "doc_id", "left").withColumns({"have": F.coalesce("have", F.lit(0)) + F.col("often"), "warm": F.coalesce("warm", F.lit(0)) + F.col("often")})
    return held.where("have >= need").select("doc_id", "common", "need", "warm")


def _groups(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """id and component of the sets that the filters of the second order leave together."""
    met = scratch.write(_met(sets), "met")
    alive = checkpointed(_enough(sets, met))
    lists = met.where(F.col("m") <= RARE).groupBy("token").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))  # RARE ids at most
    both = F.flatten(F.transform("ids", lambda a, k: F.transform(F.slice("ids", F.lit(1), k), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    shared = lists.select(F.explode(both).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n")).where("a <> b")
    of_a, of_b = (alive.select(F.col("doc_id").alias(x), F.col("warm").alias(f"warm_{x}"), F.col("common").alias(f"common_{x}")) for x in "ab")
    pairs = shared.join(of_a, "a").join(of_b, "b").where(F.col("n") + F.least("warm_a", "warm_b") >= F.least("common_a", "common_b")).select("a", "b")

    warm = alive.where("warm >= need").select("doc_id")
    often = sets.select("doc_id", F.explode("frequent").alias("token")).join(warm, "doc_id", "left_semi")
    tied = scratch.write(met.where(F.col("m") > RARE).join(warm, "doc_id", "left_semi").select("doc_id", "token").unionByName(often), "tied")
    least = tied.groupBy("token").agg(F.min("doc_id").alias("b"))
    ties = tied.join(least, "token").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct()
    found = connected_components(pairs.unionByName(ties))
    scratch.drop("met", "tied")
    return found


def _level(n: Column, terms: Terms) -> Column:
    """Sizes of linked sets are on equal or neighbouring levels."""
    return F.floor(F.log(n.cast("double")) / F.lit(1.0001 * math.log(100 / terms.part))).cast("int")


def _dealt(rows: DataFrame, terms: Terms) -> DataFrame:
    """`rows` (doc_id, group, n, rest) with own, the set's cell, and the cells of the rest and of others that hold linked sets.

    A cell is a size level, whether it holds the rest, and a number.
    """
    levelled = rows.withColumn("level", _level(F.col("n"), terms) * 2 + F.col("rest").cast("int"))
    sums = levelled.groupBy("group", "level").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    parts = F.greatest(F.ceil(F.col("m") / F.lit(float(CELL_SETS))), F.ceil(F.col("n") / F.lit(float(CELL_SHINGLES)))).cast("int")
    plan = sums.groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("level", parts.alias("parts")))).alias("parts"))  # a level for each power of 1 / similarity

    def cells(level: Column) -> Column:
        many = F.try_element_at(F.col("parts"), level)
        return F.when(many.isNull(), F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), many - 1), lambda s: F.shiftleft(level.cast("long"), 32) + s))

    level = F.col("level")
    even = level - F.col("rest").cast("int")
    own = F.shiftleft(level.cast("long"), 32) + F.pmod(F.xxhash64("doc_id"), F.element_at(F.col("parts"), level))
    placed = levelled.join(plan, "group").withColumn("own", own)
    return placed.withColumn("of_rest", F.concat(cells(even - 1), cells(even + 1), cells(even + 3))).withColumn("of_others", F.concat(cells(even - 2), cells(even), cells(even + 2)))


def _tasks(cells: Column) -> Column:
    """A task, which is a group and two cells, for the set's own cell and each other one."""
    return F.transform(cells, lambda c: F.struct(F.col("group").alias("group"), F.least(F.col("own"), c).alias("low"), F.greatest(F.col("own"), c).alias("high")))


def _first_look(sets: DataFrame, large: DataFrame, terms: Terms) -> DataFrame:
    """doc_id, own and tasks: small groups whole, large ones by cells, which leaders visit."""
    small = sets.join(large, "group", "left_anti").withColumn("own", F.lit(0).cast("long"))
    rows = _dealt(sets.join(large, "group", "left_semi").withColumn("rest", F.lit(False)), terms)
    slot = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(LEADERS))
    leaders = rows.groupBy("group", "level", slot.alias("slot")).agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(True).alias("leads")).distinct()
    visits = F.transform("of_others", lambda c: F.struct(F.col("group").alias("group"), c.alias("low"), c.alias("high")))
    at_home = F.array(F.struct(F.col("group").alias("group"), F.col("own").alias("low"), F.col("own").alias("high")))
    led = rows.join(leaders, "doc_id", "left").select("doc_id", "own", F.when(F.col("leads"), F.array_union(visits, at_home)).otherwise(at_home).alias("tasks"))
    return small.select("doc_id", "own", _tasks(F.array("own")).alias("tasks")).unionByName(led)


def _second_look(sets: DataFrame, large: DataFrame, found: DataFrame, terms: Terms) -> DataFrame:
    """doc_id, own and tasks for the large groups that are not one component: the rest meets itself and the largest component."""
    named = sets.join(large, "group", "left_semi").join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    sizes = named.groupBy("group", "component").agg(F.count("*").alias("m"))
    main = sizes.groupBy("group").agg(F.max(F.struct("m", "component")).alias("largest"), F.count("*").alias("k")).where("k > 1")
    rows = _dealt(named.join(main, "group").withColumn("rest", F.col("component") != F.col("largest.component")), terms)
    return rows.select("doc_id", "own", _tasks(F.when(F.col("rest"), F.concat("of_rest", "of_others")).otherwise(F.col("of_rest"))).alias("tasks")).where(F.size("tasks") > 0)


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def _shared_counts(lists: list[np.ndarray]) -> np.ndarray:
    """Number of values that each two of the lists share: of common values by products of incidence matrices in column blocks, of others by counting pairs."""
    m = len(lists)
    owner = np.repeat(np.arange(m), [len(x) for x in lists])
    order = np.argsort(np.concatenate(lists), kind="stable")
    values, owner = np.concatenate(lists)[order], owner[order]
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, np.int64)
    many = np.diff(np.append(starts, len(values)))
    out = np.zeros((m, m), np.float32)

    common = np.flatnonzero(many > COMMON)
    rows = owner[np.repeat(starts[common], many[common]) + _counted(many[common])]
    column = np.repeat(np.arange(len(common)), many[common])
    for start in range(0, len(common), COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        block = np.zeros((m, min(COLUMNS, len(common) - start)), np.float32)
        block[rows[a:b], column[a:b] - start] = 1
        out += block @ block.T

    light = np.flatnonzero((many > 1) & (many <= COMMON))
    first, size = starts[light], many[light]
    pairs = np.zeros(m * m, np.float32)
    held: list[np.ndarray] = []
    for gap in range(1, COMMON):
        first, size = first[size > gap], size[size > gap]
        at = np.repeat(first, size - gap) + _counted(size - gap)
        held.append(owner[at] * m + owner[at + gap])
        if sum(map(len, held)) > 500_000 or gap == COMMON - 1 or not len(first):
            pairs += np.bincount(np.concatenate(held), minlength=m * m).astype(np.float32)
            held = []
        if not len(first):
            break
    pairs = pairs.reshape(m, m)
    return out + pairs + pairs.T


def _counted(sizes: np.ndarray) -> np.ndarray:
    """0 to size - 1 for each size, in a row."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def links_within(ids: list[int], own: list[int], sets: list[np.ndarray], same: bool, frequency: np.ndarray, terms: Terms) -> list[tuple[int, int]]:
    """Edges that span the components of the links in one task; across its two cells unless they are the same."""
    m = len(ids)
    if m < 2:
        return []
    n = np.array([len(s) for s in sets])
    small, large = np.minimum(n[:, None], n[None, :]), np.maximum(n[:, None], n[None, :])
    open_ = np.triu(100 * small >= terms.part * large, 1)
    if not same:
        side = np.array(own)
        open_ &= side[:, None] != side[None, :]
    for order in (1, 2, 3):
        own_common = np.array([terms.common(k, order) for k in n])
        common = np.minimum(own_common[:, None], own_common[None, :])
        if open_.any():
            open_ &= _shared_counts([prefix_of(s, order, frequency, terms) for s in sets]) >= common
    forest = _Forest(m)
    pairs = np.argwhere(open_)
    if len(pairs) > 4 * m:
        both = _shared_counts(sets)[pairs[:, 0], pairs[:, 1]].astype(np.int64)
        good = 100 * both >= terms.part * (n[pairs[:, 0]] + n[pairs[:, 1]] - both)
        for a, b in pairs[good].tolist():
            forest.join(a, b)
    else:
        for a, b in pairs.tolist():
            if forest.root(a) != forest.root(b):
                both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if 100 * both >= terms.part * (len(sets[a]) + len(sets[b]) - both):
                    forest.join(a, b)
    return [(ids[k], ids[forest.root(k)]) for k in range(m) if forest.root(k) != k]


def _verified(docs: DataFrame, placed: DataFrame, frequency: np.ndarray, terms: Terms) -> DataFrame:
    """Edges (a, b) of all tasks of `placed`, on the sets of whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(frequency)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in T.chunks(batch.column("text")):
                part = batch.slice(chunk.first, chunk.last - chunk.first)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("own"), part.column("tasks"), _lists(sets_of(chunk, terms.words))], names=["doc_id", "own", "tasks", "shingles"])

    task = "struct<group: long, low: long, high: long>"
    near, _ = divided(docs.select("doc_id", "text"), placed)
    held = near.join(placed, "doc_id").mapInArrow(trimmed(read), f"doc_id long, own long, tasks array<{task}>, shingles array<long>")
    dealt = held.select("doc_id", "own", F.explode("tasks").alias("t"), "shingles").select("t.group", "t.low", "t.high", "doc_id", "own", "shingles")
    dealt = dealt.repartition("group", "low", "high").sortWithinPartitions("group", "low", "high", "doc_id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple[int, int, int] | None = None
        ids: list[int] = []
        own: list[int] = []
        sets: list[np.ndarray] = []
        edges: list[tuple[int, int]] = []

        def close() -> None:
            if now is not None:
                edges.extend(links_within(ids, own, sets, now[1] == now[2], shared.value, terms))

        for batch in batches:
            column = batch.column("shingles")
            flat, offsets = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
            keys = zip(*(batch.column(c).to_pylist() for c in ("group", "low", "high", "doc_id", "own")), strict=True)
            for k, (group, low, high, doc_id, cell) in enumerate(keys):
                if (group, low, high) != now:
                    close()
                    now, ids, own, sets = (group, low, high), [], [], []
                found = flat[offsets[k] : offsets[k + 1]]
                if ids and ids[-1] == doc_id and np.array_equal(sets[-1], found):
                    continue  # a repeated row
                ids.append(doc_id)
                own.append(cell)
                sets.append(found.copy())
            if edges:
                yield _edge_batch(edges)
                edges = []
        close()
        yield _edge_batch(edges)

    return dealt.mapInArrow(trimmed(verify), "a long, b long")


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in edges], pa.int64()), pa.array([b for _, b in edges], pa.int64())], names=["a", "b"])


def join(docs: DataFrame, words: int = 4, part: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id (the least id reachable by links) for every row."""
    terms = Terms(words, part)
    frequency = frequencies(docs, terms)
    scratch = Scratch(docs.sparkSession)
    first = scratch.write(signatures(docs, frequency, terms, 1).drop("h1", "h2"), "first")
    usable = first.where("doc_id is not null and n > 0")
    alive = checkpointed(_enough(usable, _met(usable)).select("doc_id"))
    near, _ = divided(docs.select("doc_id", "text"), alive)
    second = scratch.write(signatures(near.join(alive, "doc_id", "left_semi"), frequency, terms, 2), "second").where("n > 0")
    sets = checkpointed(second.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n")))
    copies = second.join(sets.select("h1", "h2", F.col("doc_id").alias("b")), ["h1", "h2"]).where("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct()
    copies = checkpointed(copies)
    single = second.join(sets.select("h1", "h2", "doc_id"), ["h1", "h2", "doc_id"], "left_semi").dropDuplicates(["h1", "h2", "doc_id"])
    fine = _groups(single.select("doc_id", "common", "need", "prefix", "frequent"), scratch)
    scratch.drop("second")

    grouped = checkpointed(sets.join(fine.select(F.col("id").alias("doc_id"), F.col("component").alias("group")), "doc_id").select("doc_id", "group", "n"))
    sizes = grouped.groupBy("group").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    large = checkpointed(sizes.where((F.col("m") > CELL_SETS) | (F.col("n") > CELL_SHINGLES)).select("group"))
    links = _verified(docs, checkpointed(_first_look(grouped, large, terms)), frequency, terms)
    found = connected_components(copies.unionByName(links))
    if not large.isEmpty():
        again = checkpointed(_second_look(grouped, large, found, terms))
        stars = found.select(F.col("id").alias("a"), F.col("component").alias("b"))
        found = connected_components(stars.unionByName(_verified(docs, again, frequency, terms)))
    out = first.select("doc_id", F.col("n").alias("n_shingles")).join(found, first["doc_id"] == found["id"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


ORACLE = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, g from (
  select doc_id, array_to_string(w[i:i + 3], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 2)) as i from w where len(w) >= 4)
  union all select doc_id, array_to_string(w, ' ') from w where len(w) between 1 and 3)),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where 100 * c >= 85 * (x.n + y.n - c)),
r(doc_id, reach) as (select doc_id, doc_id from w union select r.doc_id, l.b from r join l on r.reach = l.a)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, min(reach) as component_id from w left join n using (doc_id) join r on r.doc_id = w.doc_id group by 1, 2
"""
