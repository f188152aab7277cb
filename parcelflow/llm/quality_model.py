"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of a whole text are counts and shares of character classes, words, lines and
repeated word sequences. Trees of a fixed depth grow on binned statistics by second-order gains
of the logistic loss, and are kept as complete binary trees in flat arrays, which a batch of
documents walks level by level with numpy indexing.

Labels are learned from at most about `TRAIN_ROWS` hash-chosen labelled documents outside the held-out
fold; only their statistics come to the driver. Null labels and null ids are not learned from;
an id with several labels counts with its lowest. Null texts are empty texts; empty texts are
scored like any other. Without labels the score is 0.5 everywhere. Equal texts get equal scores.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow.llm import textarrays as T
from parcelflow.llm.language import held_out
from parcelflow.llm.shared import trimmed

#: Labelled documents that a model is fitted on, about.
TRAIN_ROWS = 20_000
#: Score from which a document counts as good.
GOOD = 0.3

CLASSES = ["lower", "upper", "digit", "space", "newline", "stop", "comma", "exclaim", "symbol", "quote", "other", "high"]
_CLASS_OF = np.full(256, CLASSES.index("other"), np.uint8)
for _name, _chars in (("lower", b"abcdefghijklmnopqrstuvwxyz"), ("upper", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", b"0123456789"), ("space", b" \t\r\x0b\x0c"), ("newline", b"\n"), ("stop", b".;:"), ("comma", b","), ("exclaim", b"!?"), ("symbol", b"#*$%&|<>"), ("quote", b"'\"()[]{}")):
    _CLASS_OF[list(_chars)] = CLASSES.index(_name)
_CLASS_OF[128:] = CLASSES.index("high")

FEATURES = [f"{c}_share" for c in CLASSES] + ["log_bytes", "log_words", "mean_word", "spread_word", "short_words", "distinct_words", "equal_neighbours", "repeated_3", "repeated_5", "log_lines", "repeated_lines", "words_by_line", "symbols_by_word", "exclaims_by_word"]


def statistics(chunk: T.Chunk) -> np.ndarray:
    """One row of FEATURES for each text of a chunk."""
    n = len(chunk.offsets) - 1
    size = np.diff(chunk.offsets)
    owner = np.repeat(np.arange(n), size)
    classes = np.bincount(owner * len(CLASSES) + _CLASS_OF[chunk.data], minlength=n * len(CLASSES)).reshape(n, -1)
    words, lines = T.words_of(chunk), T.lines_of(chunk)
    n_words, n_lines = words.counts(), lines.counts()
    by = np.maximum(n_words, 1)
    word_owner = np.repeat(np.arange(n), n_words)
    lengths = (words.ends - words.starts).astype(float)
    mean = np.bincount(word_owner, lengths, n) / by
    spread = np.sqrt(np.maximum(np.bincount(word_owner, lengths**2, n) / by - mean**2, 0))
    short = np.bincount(word_owner[lengths <= 2], minlength=n) / by
    same = (words.hashes[1:] == words.hashes[:-1]) & (word_owner[1:] == word_owner[:-1])
    neighbours = np.bincount(word_owner[1:][same], minlength=n) / by

    def repeated(k: int) -> np.ndarray:
        found, bounds = words.sequences(k)
        many = np.diff(bounds)
        return (many - T.distinct_counts(found, bounds)) / np.maximum(many, 1)

    columns = [classes / np.maximum(size, 1)[:, None]]
    columns += [c[:, None] for c in (np.log1p(size), np.log1p(n_words), mean, spread, short, T.distinct_counts(words.hashes, words.bounds) / by, neighbours, repeated(3), repeated(5), np.log1p(n_lines), (n_lines - T.distinct_counts(lines.hashes, lines.bounds)) / np.maximum(n_lines, 1), n_words / np.maximum(n_lines, 1), classes[:, CLASSES.index("symbol")] / by, classes[:, CLASSES.index("exclaim")] / by)]
    return np.concatenate(columns, 1)


@dataclass
class Trees:
    """Complete binary trees: node k of a tree has the children 2k + 1 and 2k + 2; value holds the leaves."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaves that each row reaches, level by level for all rows at once."""
        rows, out = np.arange(len(x)), np.full(len(x), self.base)
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            while inner and at[:1].size and at[0] < inner:
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += value[at - inner]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, reg: float = 1.0, least: float = 1.0) -> Trees:
    """Boosted trees for labels 0 and 1; without rows, a constant 0.5."""
    inner, leaves = (1 << depth) - 1, 1 << depth
    if not len(y):
        return Trees(0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    share = np.clip(y.mean(), 0.01, 0.99)
    base = float(np.log(share / (1 - share)))
    raw = np.full(len(y), base)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    width = bins + 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            start, nodes = (1 << level) - 1, 1 << level
            local = at - start
            best_gain, best_feature, best_bin = np.zeros(nodes), np.zeros(nodes, np.int64), np.full(nodes, -1)
            for f in range(x.shape[1]):
                key = local * width + binned[:, f]
                g = np.bincount(key, grad, nodes * width).reshape(nodes, width).cumsum(1)
                h = np.bincount(key, hess, nodes * width).reshape(nodes, width).cumsum(1)
                gl, hl, gt, ht = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                gain = gl**2 / (hl + reg) + (gt - gl) ** 2 / (ht - hl + reg) - gt**2 / (ht + reg)
                gain[(hl < least) | (ht - hl < least)] = 0
                k = gain.argmax(1)
                top = gain[np.arange(nodes), k]
                better = (top > best_gain + 1e-9) & (k < len(edges[f]))
                best_gain[better], best_feature[better], best_bin[better] = top[better], f, k[better]
            for node in np.flatnonzero(best_bin >= 0):
                feature[start + node], threshold[start + node] = best_feature[node], edges[best_feature[node]][best_bin[node]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > threshold[at])
        leaf = at - inner
        value = -rate * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, hess, leaves) + reg)
        raw += value[leaf]
        found.append((feature, threshold, value))
    return Trees(base, *(np.stack(part) for part in zip(*found, strict=True)))


def _measured(docs: DataFrame, others: list[str]) -> DataFrame:
    """The columns `others` of `docs` and the statistics of the texts."""
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in T.chunks(batch.column("text")):
                part = batch.slice(chunk.first, chunk.last - chunk.first)
                rows = pa.array(list(statistics(chunk)), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), rows], names=[*others, "stats"])

    return docs.select(*others, "text").mapInArrow(trimmed(run), f"{kinds}, stats array<double>")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> Trees:
    """Trees for `label` from about `rows` labelled documents outside the held-out fold."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"))
    every = max(1, -(-known.count() // rows))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(every)) == 0)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # about `rows` ids
    found = sorted(_measured(sample, ["doc_id", "y"]).collect(), key=lambda r: (r["doc_id"], r["stats"]))
    return fit(np.array([r["stats"] for r in found]).reshape(len(found), len(FEATURES)), np.array([r["y"] for r in found], float))


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shared.value.scores(statistics(chunk)) for chunk in T.chunks(batch.column("text"))]
            scores = np.concatenate(parts) if parts else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array((scores >= GOOD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    slim = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return slim.mapInArrow(trimmed(run), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Trees) -> DataFrame:
    """The rows of `docs`, all columns, whose text scores GOOD or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shared.value.scores(statistics(chunk)) for chunk in T.chunks(batch.column("text"))]
            scores = np.concatenate(parts) if parts else np.empty(0)
            yield batch.filter(pa.array(scores >= GOOD))

    return docs.mapInArrow(trimmed(run), docs.schema)
