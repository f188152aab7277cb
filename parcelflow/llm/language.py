"""Language identification by averaged hashed subword embeddings and a linear softmax.

Subwords are runs of 3 and 5 bytes of the text (A-Z folded, white space as one blank), hashed
into buckets. A document is the mean of its subwords' embeddings; a linear layer and a softmax
give the languages. Embeddings and layer are learned by stochastic gradient descent in numpy,
on about `per_language` hash-chosen documents of each language and `TRAIN_ROWS` in all, so the driver
holds a bounded sample: for each document the number of every bucket in its whole text. A step draws some subwords
of each document from all of them. A temperature, fitted on documents kept out of
training, calibrates the probabilities; the rejection threshold is the lowest score above which
those documents reach the wanted accuracy. Of more than `MOST_LANGUAGES` languages those with most rows are learned.

Scoring reads whole texts: embedding and layer fold into one table of a logit for each bucket and
language. Null texts and texts without a letter (Unicode category L) are `und` with score 0. Null languages and null
ids are not learned from. Equal texts get equal rows. Extra columns are ignored. Without any
labelled row every text is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.llm import textarrays as T

BUCKETS = 1 << 16
ORDERS = (3, 5)
DIMENSION = 16
#: Subwords of one document in one step of training, at most.
DRAWN = 600
#: Documents learned from, of each language and in all, about.
PER_LANGUAGE, TRAIN_ROWS = 1000, 4000
#: Languages that are learned; a bound for the model, which holds BUCKETS numbers for each.
MOST_LANGUAGES = 400
FOLD = T.LOWER.copy()
FOLD[T.IS_SPACE] = 0x20
_LETTER = regex.compile(r"\p{L}")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5; false for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def subwords(data: np.ndarray, order: int) -> np.ndarray:
    """Bucket of every run of `order` bytes that starts at each position but the last ones."""
    n = len(data) - order + 1
    if n <= 0:
        return np.empty(0, np.int64)
    folded = FOLD[data].astype(np.uint64)
    key = folded[:n].copy()
    for k in range(1, order):
        key = (key << np.uint64(8)) | folded[k : k + n]
    key = (key + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
    return (key >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _ranges(offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """First subword and number of subwords of each text within the chunk's."""
    return offsets[:-1], np.maximum(np.diff(offsets) - order + 1, 0)


@dataclass
class Model:
    """languages[k] has the logits table[:, k]; a text's logits are its mean row, plus bias, over the temperature."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, chunk: T.Chunk) -> np.ndarray:
        n = len(chunk.offsets) - 1
        sums, counts = np.zeros((n, len(self.languages))), np.zeros(n)
        for order in ORDERS:
            buckets = subwords(chunk.data, order)
            first, many = _ranges(chunk.offsets, order)
            rows = np.flatnonzero(many > 0)
            if len(rows):
                # pairs of bounds: the text's own subwords, then those that reach into the next text
                bounds = np.stack([first[rows], first[rows] + many[rows]], 1).ravel()
                bounds = bounds[:-1] if bounds[-1] == len(buckets) else bounds
                for k in range(len(self.languages)):
                    sums[rows, k] += np.add.reduceat(self.table[k][buckets], bounds, dtype=np.float64)[::2]
                counts[rows] += many[rows]
        return sums / np.maximum(counts, 1)[:, None] + self.bias

    def scores(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def _draw(buckets: np.ndarray, counts: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Some subwords of a text, by their numbers in it; all of a short one."""
    upto = np.cumsum(counts)
    wanted = int(rng.integers(8, DRAWN))
    if not len(counts) or upto[-1] <= wanted:
        return np.repeat(buckets, counts)
    return buckets[np.searchsorted(upto, rng.integers(0, upto[-1], wanted), side="right")]


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]], epochs: int = 6, seed: int = 5, accuracy: float = 0.99) -> Model | None:
    """A model from (buckets, their numbers, language) rows; a fifth of them calibrates it."""
    if not rows:
        return None
    rng = np.random.default_rng(seed)
    languages = sorted({lang for *_, lang in rows})
    label = np.array([languages.index(lang) for *_, lang in rows])
    order = rng.permutation(len(rows))
    check, train = (order[: len(rows) // 5], order[len(rows) // 5 :]) if len(rows) >= 20 else (order, order)
    embed = rng.uniform(-1 / DIMENSION, 1 / DIMENSION, (BUCKETS, DIMENSION))
    layer, bias = rng.normal(0, 0.1, (DIMENSION, len(languages))), np.zeros(len(languages))
    steps = epochs * max(1, -(-len(train) // 32))
    done = 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(train), max(1, -(-len(train) // 32))):
            # part of a text now and then, so that short texts are known too
            picks = [_draw(rows[k][0], rows[k][1], rng) for k in batch]
            sizes = np.array([len(p) for p in picks])
            flat, owner = np.concatenate(picks), np.repeat(np.arange(len(batch)), sizes)
            mean = np.zeros((len(batch), DIMENSION))
            np.add.at(mean, owner, embed[flat])
            mean /= np.maximum(sizes, 1)[:, None]
            z = mean @ layer + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), label[batch]] -= 1
            rate = 0.5 * (1 - done / steps)
            back = p @ layer.T / np.maximum(sizes, 1)[:, None]
            layer -= rate * mean.T @ p / len(batch)
            bias -= rate * p.sum(0) / len(batch)
            np.add.at(embed, flat, -rate * 4 * back[owner])
            done += 1
    model = Model(languages, np.ascontiguousarray((embed @ layer).T.astype(np.float32)), bias)
    logits = np.stack([model.table[:, rows[k][0]] @ (rows[k][1] / max(1, rows[k][1].sum())) for k in check]) + bias
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 60))
    loss = []
    for t in grid:
        model.temperature = float(t)
        loss.append(-np.log(np.maximum(model.scores(logits)[np.arange(len(check)), label[check]], 1e-12)).mean())
    model.temperature = float(grid[int(np.argmin(loss))])
    p = model.scores(logits)
    best, right = p.max(1), p.argmax(1) == label[check]
    falling = np.argsort(-best, kind="stable")
    good = np.flatnonzero(np.cumsum(right[falling]) >= accuracy * np.arange(1, len(check) + 1))
    model.threshold = float(best[falling][good[-1]]) if len(good) else 1.0
    return model


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE, most: int = TRAIN_ROWS) -> list[tuple[np.ndarray, np.ndarray, str]]:
    """Buckets, their numbers in the whole text, and language of about `per_language` labelled documents of each language and `most` in all."""
    usable = docs.select("doc_id", "text", "lang").where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sums = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    wanted = F.least(F.lit(per_language), F.ceil(F.lit(most) / F.count("*").over(Window.partitionBy())))  # over MOST_LANGUAGES rows
    share = F.broadcast(sums.withColumn("every", F.greatest(F.lit(1), F.ceil(F.col("n") / wanted))).drop("n"))
    chosen = usable.join(share, "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.col("every")) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[bytes, bytes]] = []
            for chunk in T.chunks(batch.column("text")):
                every = [(subwords(chunk.data, order), *_ranges(chunk.offsets, order)) for order in ORDERS]
                for k in range(chunk.last - chunk.first):
                    own = np.concatenate([buckets[first[k] : first[k] + many[k]] for buckets, first, many in every])
                    buckets, counts = np.unique(own, return_counts=True)
                    found.append((buckets.astype(np.int32).tobytes(), counts.astype(np.int32).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), *(pa.array(c, pa.binary()) for c in zip(*found, strict=True))], names=["doc_id", "lang", "buckets", "counts"])

    held = chosen.select("doc_id", "text", "lang").mapInArrow(run, "doc_id long, lang string, buckets binary, counts binary")
    rows = sorted(held.toArrow().to_pylist(), key=lambda r: (r["doc_id"], r["buckets"], r["counts"], r["lang"]))
    return [(np.frombuffer(r["buckets"], np.int32).astype(np.int64), np.frombuffer(r["counts"], np.int32).astype(np.int64), r["lang"]) for r in rows]


def identify(docs: DataFrame, model: Model | None, reject: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for every document.

    `rejected` marks scores under the model's threshold; with `reject` their lang_pred is `und`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages doubles at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            column = batch.column("text")
            letters = np.array([bool(t) and _LETTER.search(t) is not None for t in column.to_pylist()], bool)
            names, scores = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            if model is not None:
                for chunk in T.chunks(column):
                    p = model.scores(model.logits(chunk))
                    best = p.argmax(1)
                    scores[chunk.first : chunk.last] = p[np.arange(len(p)), best]
                    names[chunk.first : chunk.last] = np.array(model.languages, object)[best]
            low = scores < (model.threshold if model is not None else 1.0)
            unknown = ~letters | (low if reject else np.zeros(len(low), bool)) | np.array([model is None] * len(low), bool)
            names[unknown] = "und"
            scores[~letters] = 0.0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores), pa.array(low | ~letters)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    slim = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return slim.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
