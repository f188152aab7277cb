"""Near-duplicate vectors by product quantisation: coarse inverted lists, residual codes, exact rerank.

Equal vectors are compared once, with their number as weight. Every distinct vector is indexed in
the inverted list of its nearest coarse centre, as codes of its residual in some subspaces, with
the length of what the codes leave out. It is a query in its nearest lists. There a table of the
query's distances to all codes gives each member's approximate distance; since the true distance is
at least that less the member's left-out length, no member within the radius is passed over. What
passes is compared exactly, in double precision. A pair is found if either asks the other's list.

Centres, codes and the number of lists to ask are fitted on a bounded, hash-chosen sample; every vector is
indexed and is a query. Of sample vectors that the centres were not fitted on, neighbours are made that
lie at the least cosine, towards other vectors of the sample; so many lists are asked as find
`RECALL` of them, and of nearer ones more. Lists grow with the vectors: beyond four times `MOST_LISTS` of them each
centre's list is split by a second table of centres for what the first leave. Lists that follow each other make a group, which holds similar
centres, so that a query is sent once to many lists. A long group is held in blocks, each a task through
which the group's queries stream. Tasks return sums of links for each vector and edges that span
components, never pairs.

Vectors that are null, zero, or hold null or non-finite components link with nothing, nor do rows
without id. Vectors of each length are indexed on their own. Rows of one id with equal vectors are one vector;
with different vectors they are several, which may link. Labels and extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow.llm.shared import checkpointed, connected_components

#: Vectors of one list on average, and the bound of each of the two tables of centres, which are broadcast.
LIST_ROWS, MOST_LISTS = 64, 4096
#: Sample rows for each centre, at least, and the numbers that a sample holds at most (32 MB).
SAMPLE_BY_LIST, LEAST_SAMPLE, SAMPLE_NUMBERS = 8, 4096, 1 << 22
#: Share of made neighbours at the least cosine that the lists asked find.
RECALL = 0.97
SUBSPACES, CODES = 8, 64
#: Members of one block are at most about GROUP_BLOCKS * BLOCK, as are those of a group of short lists.
BLOCK, GROUP_BLOCKS, MOST_GROUPS = 1024, 4, 1 << 16


@dataclass
class Quantiser:
    """centres, second: rows of `width`; books: subspace x code x part; probes: lists to ask. List k has centre k // len(second) plus second k % len(second)."""

    centres: np.ndarray
    second: np.ndarray
    books: np.ndarray
    probes: int = 1

    @property
    def lists(self) -> int:
        return len(self.centres) * len(self.second)

    def centres_of(self, lists: np.ndarray) -> np.ndarray:
        return self.centres[lists // len(self.second)] + self.second[lists % len(self.second)]

    def nearest(self, x: np.ndarray, k: int) -> np.ndarray:
        """The k nearest lists of each row among those of its k nearest centres, the nearest first."""
        k = min(k, len(self.centres))
        near = x @ self.centres.T - 0.5 * (self.centres**2).sum(1)
        first = _largest(near, k)
        if len(self.second) == 1:
            return first
        rest = x[:, None, :] - self.centres[first]
        away = (rest**2).sum(2)[:, :, None] - 2 * rest @ self.second.T + (self.second**2).sum(1)
        best = _largest(-away.reshape(len(x), -1), k)
        return np.take_along_axis(first, best // len(self.second), 1) * len(self.second) + best % len(self.second)

    def residual_codes(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code of each subspace, and the length of the part that the codes leave out."""
        parts = residual.reshape(len(residual), *self.books.shape[::2])
        codes = np.empty((len(residual), len(self.books)), np.uint8)
        rest = np.zeros(len(residual))
        for s, book in enumerate(self.books):
            away = ((parts[:, s, None, :] - book[None]) ** 2).sum(2)
            codes[:, s] = away.argmin(1)
            rest += away[np.arange(len(residual)), codes[:, s]]
        return codes, np.sqrt(rest)

    def tables(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of each query to all codes: query x subspace x code."""
        parts = x.reshape(len(x), *self.books.shape[::2])
        return np.stack([((parts[:, s, None, :] - book[None]) ** 2).sum(2) for s, book in enumerate(self.books)], 1)


def _largest(values: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest of each row, the largest first."""
    top = np.argpartition(-values, k - 1, axis=1)[:, :k]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(values, top, 1), axis=1, kind="stable"), 1)


def unit(rows: np.ndarray, width: int) -> np.ndarray:
    """Rows of length 1, padded with zeros to `width`; scaled first, so that squares stay finite."""
    out = np.zeros((len(rows), width))
    scaled = rows / np.abs(rows).max(1, keepdims=True, initial=np.finfo(np.float64).tiny)
    out[:, : rows.shape[1]] = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
    return out


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """k-means centres; ones that lose all rows stay where they were."""
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = (x @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
        many = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[many > 0] = sums[many > 0] / many[many > 0, None]
    return centres


def _made_neighbours(x: np.ndarray, towards: np.ndarray, least: float) -> np.ndarray:
    """Vectors of cosine `least` with the rows of x, on the side of `towards`."""
    aside = towards - (towards * x).sum(1, keepdims=True) * x
    length = np.linalg.norm(aside, axis=1, keepdims=True)
    return np.where(length > 1e-9, least * x + np.sqrt(1 - least**2) * aside / np.maximum(length, 1e-9), x)


def probes_for(quantiser: Quantiser, x: np.ndarray, least: float, rng: np.random.Generator) -> int:
    """Lists to ask so that RECALL of the made neighbours of the rows of x are found, whichever end asks."""
    home = quantiser.nearest(x, 1)[:, 0]
    same = np.argsort(home, kind="stable")
    beside = np.empty_like(same)
    beside[same] = np.roll(same, 1)  # one of the same list or of the next
    most = len(quantiser.centres)
    probes = 1
    for towards in (x[rng.permutation(len(x))], x[beside]):
        made = _made_neighbours(x, towards, least)
        target = quantiser.nearest(made, 1)[:, 0]
        while probes < most:
            found = 0
            for a in range(0, len(x), 64):
                b = slice(a, a + 64)
                found += ((quantiser.nearest(x[b], probes) == target[b, None]).any(1) | (quantiser.nearest(made[b], probes) == home[b, None]).any(1)).sum()
            if found >= RECALL * len(x):
                break
            probes = min(probes + probes // 2 + 1, most)
    return probes


def fit(sample: np.ndarray, lists: int, groups: int = 1, least: float = 0.9, seed: int = 9) -> Quantiser:
    """Quantiser of at least `lists` lists, as far as the sample has rows for two tables of centres."""
    rng = np.random.default_rng(seed)
    width = -(-sample.shape[1] // SUBSPACES) * SUBSPACES
    x = unit(sample, width)
    held = np.arange(len(x)) % 8 == 0 if len(x) > 64 else np.zeros(len(x), bool)
    train = x[~held]
    k = max(1, min(lists, MOST_LISTS, len(train)))
    centres = _means(train, k, rng)
    side = _means(centres, min(groups, k), rng, 4)
    centres = centres[np.argsort((centres @ side.T - 0.5 * (side**2).sum(1)).argmax(1), kind="stable")]
    near = (train @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
    rest = train - centres[near]
    second = _means(rest, min(MOST_LISTS, -(-lists // k)), rng) if lists > 4 * MOST_LISTS else np.zeros((1, width))
    rest = rest - second[(rest @ second.T - 0.5 * (second**2).sum(1)).argmax(1)]
    parts = rest.reshape(len(rest), SUBSPACES, -1)
    made = Quantiser(centres, second, np.stack([_means(np.ascontiguousarray(parts[:, s]), CODES, rng) for s in range(SUBSPACES)]))
    made.probes = probes_for(made, x[held][:2048] if held.any() else x, least, rng)
    return made


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def reach_of(least: float) -> float:
    """Distance of unit vectors at the cosine `least`, with room for rounding."""
    return float(np.sqrt(2 - 2 * least)) + 1e-6


def index(distinct: DataFrame, quantiser: Quantiser, groups: int) -> DataFrame:
    """The columns id, weight and vector, and home (its list), codes, error, asks (lists to ask, its own first) and sent (their groups) of every distinct vector."""
    shared = distinct.sparkSession.sparkContext.broadcast(quantiser)  # two tables of MOST_LISTS centres at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        rows = 512 if len(q.second) == 1 else 32
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                x = unit(_matrix(part.column("vector")), q.centres.shape[1])
                asks = q.nearest(x, q.probes)
                codes, error = q.residual_codes(x - q.centres_of(asks[:, 0]))
                sent = pa.array([np.unique(row * groups // q.lists).tolist() for row in asks], pa.list_(pa.int32()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(asks) + 1, dtype=np.int32) * asks.shape[1]), pa.array(asks.ravel(), pa.int32()))
                home = asks[:, 0]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("weight"), part.column("vector"), pa.array(home, pa.int32()), pa.array(home * groups // q.lists, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), lists, sent], names=["id", "weight", "vector", "home", "group", "codes", "error", "asks", "sent"])

    number = distinct.schema["vector"].dataType.elementType.simpleString()
    return distinct.select("id", "weight", "vector").mapInArrow(run, f"id long, weight long, vector array<{number}>, home int, group int, codes binary, error double, asks array<int>, sent array<int>")


class _Task:
    """One block of a group: its members by list, their sums of links, and the components they make."""

    def __init__(self) -> None:
        self.parts: list[tuple] = []
        self.ready = False

    def add(self, ids: np.ndarray, weight: np.ndarray, vectors: np.ndarray, part: pa.RecordBatch) -> None:
        codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
        self.parts.append((ids.copy(), weight.copy(), vectors.copy(), codes, part.column("error").to_numpy().copy(), part.column("home").to_numpy(zero_copy_only=False).copy(), _asked(part.column("asks"))))

    def prepare(self, q: Quantiser) -> None:
        self.ready = True
        ids, weight, raw, codes, error, home, asks = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        self.parts = []
        order = np.argsort(home, kind="stable")
        self.ids, self.weight, self.codes, self.error, self.home, self.asks = ids[order], weight[order], codes[order].astype(np.int64), error[order], home[order], asks[order]
        self.x = unit(raw[order], q.centres.shape[1])
        self.lists, self.starts = np.unique(self.home, return_index=True)
        self.stops = np.append(self.starts[1:], len(ids))
        self.centres = q.centres_of(self.lists)
        coded = np.concatenate([book[self.codes[:, s]] for s, book in enumerate(q.books)], 1)
        home_centres = q.centres_of(self.home)
        self.shift = (home_centres**2).sum(1) + 2 * (home_centres * coded).sum(1)
        self.sums = np.zeros(len(ids), np.int64)
        self.up = np.arange(len(ids))

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def meet(self, ids: np.ndarray, weight: np.ndarray, raw: np.ndarray, asks: np.ndarray, q: Quantiser, least: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Sums of links of the queries, and one edge for each that links."""
        x = unit(raw, q.centres.shape[1])
        tables = q.tables(x)
        query, column = np.nonzero(np.isin(asks, self.lists))
        place = np.searchsorted(self.lists, asks[query, column])
        order = np.argsort(place, kind="stable")
        query, place = query[order], place[order]
        cuts = np.flatnonzero(np.diff(place)) + 1
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for here, at in zip(np.split(query, cuts), place[np.r_[0, cuts]] if len(place) else [], strict=False):
            members = slice(self.starts[at], self.stops[at])
            # |x - c - code|^2 = |x - code|^2 - 2 x.c + (2 c.code + |c|^2)
            near = self.shift[members] - 2 * (x[here] @ self.centres[at])[:, None]
            for s in range(tables.shape[1]):
                near += tables[here, s][:, self.codes[members, s]]
            a, b = np.nonzero(near <= (self.error[members] + reach_of(least)) ** 2)
            found.append((here[a], b + members.start))
        if not found:
            return np.zeros(len(ids), np.int64), []
        a, b = (np.concatenate(c) for c in zip(*found, strict=True))
        home = asks[:, 0]
        # rows of one list meet once, by id; where both ask the other's list, the lower list counts
        both = (self.asks[b] == home[a][:, None]).any(1)
        take = np.where(home[a] == self.home[b], ids[a] < self.ids[b], ~both | (self.home[b] < home[a]))
        a, b = a[take], b[take]
        linked = np.einsum("ij,ij->i", x[a], self.x[b]) >= least
        a, b = a[linked], b[linked]
        np.add.at(self.sums, b, weight[a])
        sums = np.zeros(len(ids), np.int64)
        np.add.at(sums, a, self.weight[b])
        edges = []
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        for k, start in zip(*np.unique(a, return_index=True), strict=True):
            stop = np.searchsorted(a, k, side="right")
            first = self.root(b[start])
            for other in b[start + 1 : stop]:
                other = self.root(other)
                self.up[max(first, other)] = first = min(first, other)
            edges.append((int(ids[k]), int(self.ids[b[start]])))
        return sums, edges

    def close(self) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        if not self.ready:
            return [], []
        sums = [(int(i), int(n)) for i, n in zip(self.ids, self.sums, strict=True) if n]
        return sums, [(int(self.ids[k]), int(self.ids[self.root(k)])) for k in range(len(self.ids)) if self.root(k) != k]


def _asked(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _compared(indexed: DataFrame, quantiser: Quantiser, least: float) -> DataFrame:
    """id, links (to sum) and other (an edge, null in rows of sums)."""
    sizes = indexed.groupBy("group").agg(F.count("*").alias("n"))
    blocks = F.broadcast(sizes.select(F.col("group").alias("list"), F.ceil(F.col("n") / F.lit(float(GROUP_BLOCKS * BLOCK))).cast("int").alias("blocks")))  # MOST_GROUPS rows at most
    members = indexed.join(blocks, indexed["group"] == blocks["list"]).select("list", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("query"), "id", "weight", "vector", "asks", "home", "codes", "error")
    asked = indexed.withColumn("asked", F.explode("sent")).join(blocks, F.col("asked") == blocks["list"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    queries = asked.select("list", "block", F.lit(1).alias("query"), "id", "weight", "vector", "asks", F.lit(None).cast("int").alias("home"), F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("error"))
    dealt = members.unionByName(queries).repartition("list", "block").sortWithinPartitions("list", "block", "query", "id")
    shared = indexed.sparkSession.sparkContext.broadcast(quantiser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, key, task = shared.value, None, _Task()
        sums: list[tuple[int, int]] = []
        edges: list[tuple[int, int]] = []

        def batch_of() -> pa.RecordBatch:
            ids = [i for i, _ in sums] + [a for a, _ in edges]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([n for _, n in sums] + [0] * len(edges), pa.int64()), pa.array([None] * len(sums) + [b for _, b in edges], pa.int64())], names=["id", "links", "other"])

        for batch in batches:
            if not batch.num_rows:
                continue
            lists, parts, query = (batch.column(c).to_numpy() for c in ("list", "block", "query"))
            vectors, asks = _matrix(batch.column("vector")), _asked(batch.column("asks"))
            ids, weight = (batch.column(c).to_numpy() for c in ("id", "weight"))
            cuts = np.flatnonzero((np.diff(lists) != 0) | (np.diff(parts) != 0) | (np.diff(query) != 0)) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(ids)], strict=True):
                if (lists[a], parts[a]) != key:
                    for into, found in zip((sums, edges), task.close(), strict=True):
                        into.extend(found)
                    key, task = (lists[a], parts[a]), _Task()
                if not query[a]:
                    task.add(ids[a:b], weight[a:b], vectors[a:b], batch.slice(a, b - a))
                    continue
                if not task.ready:
                    if not task.parts:
                        continue  # a block without members
                    task.prepare(q)
                for start in range(a, b, 512):
                    stop = min(b, start + 512)
                    found, joined = task.meet(ids[start:stop], weight[start:stop], vectors[start:stop], asks[start:stop], q, least)
                    sums.extend((int(i), int(n)) for i, n in zip(ids[start:stop], found, strict=True) if n)
                    edges.extend(joined)
            yield batch_of()
            sums, edges = [], []
        for into, found in zip((sums, edges), task.close(), strict=True):
            into.extend(found)
        yield batch_of()

    return dealt.mapInArrow(run, "id long, links long, other long")


def _links(distinct: DataFrame, length: int, n: int, least: float, probes: int) -> DataFrame:
    """Links and edges of the `n` vectors of one length."""
    lists = max(1, n // LIST_ROWS)
    wanted = min(max(LEAST_SAMPLE, SAMPLE_BY_LIST * min(lists, MOST_LISTS)), max(1, SAMPLE_NUMBERS // length))
    sample = distinct.where(F.pmod(F.xxhash64("id", F.lit(29)), F.lit(max(1, n // wanted))) == 0).orderBy("id").limit(2 * wanted).select("vector").toArrow()
    rows = _matrix(sample.column("vector").combine_chunks()) if sample.num_rows else np.eye(1, length)
    groups = max(1, min(lists, MOST_GROUPS, -(-n // (GROUP_BLOCKS * BLOCK))))
    quantiser = fit(rows, min(lists, MOST_LISTS**2), groups, least)
    quantiser.probes = max(quantiser.probes, min(probes, len(quantiser.centres)))
    return checkpointed(_compared(checkpointed(index(distinct, quantiser, groups)), quantiser, least))


def near_duplicates(vectors: DataFrame, least: float = 0.9, probes: int = 0) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row; `probes` lists are asked at least."""
    e = F.col("embedding")
    sound = e.isNotNull() & F.col("vec_id").isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    keyed = vectors.select("vec_id", "embedding").withColumn("key", F.when(F.coalesce(sound, F.lit(False)), F.struct(F.xxhash64("embedding").alias("a"), F.xxhash64(F.lit(1), "embedding").alias("b"))))
    usable = keyed.where("key is not null")
    named = usable.groupBy("key", "vec_id").agg(F.first("embedding").alias("vector"))
    # every different vector has a number of its own, as rows of one vec_id may hold several
    ordered = named.groupBy("key").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("weight"), F.first("vector").alias("vector")).sortWithinPartitions("key")
    distinct = checkpointed(ordered.withColumn("id", F.monotonically_increasing_id()))
    lengths = distinct.groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("n")).where("n > 1").orderBy("length").collect()
    parts = [_links(distinct.where(F.size("vector") == r["length"]), r["length"], r["n"], least, probes) for r in lengths]
    if not parts:
        parts = [distinct.sparkSession.createDataFrame([], "id long, links long, other long")]
    found = reduce(DataFrame.unionByName, parts)
    sums = found.groupBy("id").agg(F.sum("links").alias("links"))
    components = connected_components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    by_vector = distinct.select("key", "id", "first_id", "weight").join(sums, "id", "left").join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))
    named_components = by_vector.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_vector = by_vector.join(named_components, "component").select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = keyed.select("vec_id", "key").join(by_vector, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


ORACLE = """
with recursive e as (select vec_id, embedding::double[] as v from embeddings),
k as (select * from e where v is not null and len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from k a, k b where a.vec_id <> b.vec_id and list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= 0.9),
r(vec_id, reach) as (select vec_id, vec_id from e union select r.vec_id, l.b from r join l on r.reach = l.a),
c as (select vec_id, min(reach) as component_id from r group by 1), n as (select a as vec_id, count(*) as n from l group by 1)
select e.vec_id, coalesce(n.n, 0)::bigint as n_links, component_id, e.vec_id = component_id as kept from e join c using (vec_id) left join n using (vec_id)
"""
