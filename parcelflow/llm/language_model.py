"""A bigram language model by deleted interpolation: maximum-likelihood estimates mixed by the context's frequency.

The probability of a word w after v is a(k) * c(v w) / c(v) + b(k) * c(w) / N + u(k) / (V + 1): estimates
of order two, one and zero, mixed by weights of the bucket k = 1 + floor(log2 c(v)) that the context
falls in (0: never seen). Expectation-maximisation finds the weights on the counts of a tenth of
the training texts that the estimates leave out; the scores then use the counts of all of them.

All texts are cut, where they lie, into blocks of about `BLOCK_BYTES`. A block sends each of its
different words and word pairs once, as a 64-bit hash with its count, to one of many buckets of
hashes; the bucket adds up the blocks' counts and sends the sums back. So a word of any frequency
is one entry a block, no task sees more than a bucket or a block, and nothing is left out. The
number of buckets follows the size of the corpus. To the driver come totals and, for the weights, a
table of log ratios in cells of half an octave, at most about 640,000 however large the corpus is.

Null and empty texts have only the end token. Null ids are learned from and not held out. Repeated
rows count each. With nothing to learn from, every token has probability 1. Extra columns are
ignored. The rows must come in the same partitions whenever they are asked for, as those of files
do; blocks that have changed stop the run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.llm import textarrays as T
from parcelflow.llm.shared import Scratch, trimmed

U64 = np.uint64
#: Text that one block holds, but for its last text, and that one bucket of hashes answers for.
BLOCK_BYTES, BUCKET_BYTES = 16_000_000, 16_000_000
#: Kinds of texts: only scored, counted, counted and used to fit the weights.
SCORED, COUNTED, FITTED = 0, 1, 2
#: Tokens that no word is: before a text, and at its end.
START, END = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)
CONTEXTS = 64
ROUNDS = 100
#: Cells to an octave in the table that weights are fitted on.
CELLS = 2
NEVER = -(1 << 20)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 by 7; false for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _kind(doc_id: Column) -> Column:
    fitted = F.floor(F.crc32(doc_id.cast("string").cast("binary")) / 7) % 10 == 0
    return F.when(held_out(doc_id), SCORED).when(fitted, FITTED).otherwise(COUNTED)


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens of some texts, of the pairs that each ends, and the bounds of texts."""
    found, counts = [], []
    for chunk in T.chunks(texts):
        words = T.words_of(chunk, lower=True)
        n = words.counts()
        tokens = np.full(len(words.hashes) + len(n), END, U64)
        tokens[np.arange(len(words.hashes)) + np.repeat(np.arange(len(n)), n)] = words.hashes
        found.append(tokens)
        counts.append(n + 1)
    tokens = np.concatenate(found) if found else np.empty(0, U64)
    bounds = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[bounds[:-1]] = START
    return tokens, T.mix(T.mix(before, 11) + tokens, 12), bounds


def _planes(values: np.ndarray) -> bytes:
    """The bytes of numbers, all first bytes, then all second ones; sorted or small numbers then compress."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(U64).ravel()


def _in_buckets(grams: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order by bucket, then hash, of sorted grams, and the bounds of buckets in it."""
    bucket = grams % U64(n_buckets)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n_buckets + 1, dtype=U64))


def _dealt(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches (part, kind, text, ...) with the block of every row: rows of a partition and kind in a row, up to a size."""
    totals = np.zeros(3, np.int64)
    for batch in batches:
        kinds = batch.column("kind").to_numpy(zero_copy_only=False)
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        blocks = np.empty(batch.num_rows, np.int64)
        for kind in (SCORED, COUNTED, FITTED):
            here = np.flatnonzero(kinds == kind)
            ends = totals[kind] + np.cumsum(sizes[here])
            blocks[here] = ((ends - sizes[here]) // block_bytes << 2) | kind
            totals[kind] = ends[-1] if len(here) else totals[kind]
        yield batch, blocks | (batch.column("part").to_numpy(zero_copy_only=False).astype(np.int64) << 32)


def _sent(docs: DataFrame, n_buckets: int, block_bytes: int) -> DataFrame:
    """bucket, block, pairs (or words), hashes and counts: the different grams of every block."""
    names = ["bucket", "block", "pairs", "hashes", "counts"]

    def told(block: int, texts: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        tokens, pairs, _ = tokens_of(pa.chunked_array(texts).combine_chunks())
        for is_pair, hashes in ((False, tokens), (True, pairs)):
            grams, counts = np.unique(hashes, return_counts=True)
            order, bounds = _in_buckets(grams, n_buckets)
            grams, counts = grams[order], counts[order].astype(np.uint32)
            some = [b for b in range(n_buckets) if bounds[b] < bounds[b + 1]]
            columns = [some, [block] * len(some), [is_pair] * len(some), [_planes(grams[bounds[b] : bounds[b + 1]]) for b in some], [_planes(counts[bounds[b] : bounds[b + 1]]) for b in some]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()), strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, tuple[int, list[pa.Array]]] = {}
        for batch, blocks in _dealt(batches, block_bytes):
            for block in np.unique(blocks).tolist():
                now, texts = open_.get(block & 3, (block, []))
                if now != block:
                    yield from told(now, texts)
                    texts = []
                open_[block & 3] = (block, [*texts, batch.column("text").filter(pa.array(blocks == block))])
        for block, texts in open_.values():
            yield from told(block, texts)

    return docs.select("part", "kind", "text").mapInArrow(trimmed(run), "bucket int, block long, pairs boolean, hashes binary, counts binary")


def _met(table: pa.Table) -> pa.Table:
    """The sums of one bucket: for each block and kind of gram the sums of its grams in order, and a row of totals."""
    out: list[tuple] = []
    totals = (0, 0, 0, 0)
    for is_pair in (False, True):
        rows = table.filter(pc.equal(table["pairs"], is_pair))
        if not rows.num_rows:
            continue
        blocks = rows["block"].to_pylist()
        lists = [_numbers(h.as_buffer()) for h in rows["hashes"]]
        bounds = np.cumsum([0, *map(len, lists)])
        grams, place = np.unique(np.concatenate(lists), return_inverse=True)
        counts = np.concatenate([np.ascontiguousarray(np.frombuffer(c.as_buffer(), np.uint8).reshape(4, -1).T).view(np.uint32).ravel() for c in rows["counts"]])
        kinds = np.repeat(np.array(blocks, np.int64) & 3, np.diff(bounds))
        every, kept = (np.bincount(place, weights=counts * of, minlength=len(grams)).astype(U64) for of in (kinds != SCORED, kinds == COUNTED))
        if not is_pair:
            totals = tuple(int(x) for x in ((every > 0).sum(), every.sum(), (kept > 0).sum(), kept.sum()))
        for k, block in enumerate(blocks):
            own = place[bounds[k] : bounds[k + 1]]
            out.append((block, is_pair, _planes(every[own]), _planes(kept[own]) if block & 3 == FITTED else None, None))
    out.append((-1, False, None, None, totals))
    bucket = table["bucket"][0].as_py()
    found = list(zip(*out, strict=True))
    kinds_of = (pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
    return pa.table([pa.array([bucket] * len(out), pa.int32()), *(pa.array(c, t) for c, t in zip(found, kinds_of, strict=True))], names=["bucket", "block", "pairs", "every", "kept", "totals"])


def _context(counts: np.ndarray) -> np.ndarray:
    """Bucket of each context count: 0 for 0, else one more than the binary logarithm."""
    return np.where(counts > 0, np.frexp(counts)[1], 0)


def fit(cells: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of order two, one and zero for every context bucket, by expectation-maximisation.

    cells: rows (context bucket, tokens, log2 of order two by order zero, of order one by order zero; -inf: never). Contexts without a token take the weights of the next smaller ones; none is ever 0, but for
    order two where the context was never seen.
    """
    allowed = np.ones((CONTEXTS, 3))
    allowed[0, 0] = 0
    mix = allowed / allowed.sum(1, keepdims=True)
    if not len(cells):
        return mix
    context, n = cells[:, 0].astype(int), cells[:, 1]
    ratios = np.stack([np.exp2(cells[:, 2]), np.exp2(cells[:, 3]), np.ones(len(cells))], axis=1)
    for _ in range(rounds):
        share = mix[context] * ratios
        share *= (n / share.sum(1))[:, None]
        new = 0.5 * allowed
        np.add.at(new, context, share)
        mix = new / new.sum(1, keepdims=True)
    seen = np.bincount(context, minlength=CONTEXTS) > 0
    for k in range(2, CONTEXTS):
        if not seen[k] and seen[1:k].any():
            mix[k] = mix[k - 1]
    return mix


def _joined(texts: pa.Array, answers: pa.Table, n_buckets: int, which: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every token of a block's texts: the sums of its pair, its context and itself; and the bounds of texts."""
    tokens, pairs, bounds = tokens_of(texts)
    sums = {}
    for is_pair, hashes in ((False, tokens), (True, pairs)):
        grams, place = np.unique(hashes, return_inverse=True)
        order, _ = _in_buckets(grams, n_buckets)
        rows = answers.filter(pc.equal(answers["pairs"], is_pair)).sort_by("bucket")
        told = np.concatenate([_numbers(x.as_buffer()) for x in rows[which]]) if rows.num_rows else np.empty(0, U64)
        if len(told) != len(grams):
            raise RuntimeError("the rows came in other partitions than before: write them to a table first")
        counts = np.empty(len(grams), np.float64)
        counts[order] = told
        sums[is_pair] = counts[place]
    context = np.empty(len(tokens))
    context[1:] = sums[False][:-1]
    context[bounds[:-1]] = sums[False][bounds[1:] - 1]  # as many texts start as end
    return sums[True], context, sums[False], bounds


def _cells(docs: DataFrame, answers: DataFrame, n_buckets: int, block_bytes: int, types: int, tokens: int) -> np.ndarray:
    """The table that the weights are fitted on: every token of the fitting texts, in cells."""
    names = ["context", "two", "one", "n", "sum_two", "sum_one"]

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64())], names=names)
        pair, before, own, _ = _joined(left["text"].combine_chunks(), right, n_buckets, "kept")
        with np.errstate(divide="ignore", invalid="ignore"):
            two = np.log2(np.where(pair > 0, pair / before, 0) * (types + 1))
            one = np.log2(own / max(tokens, 1) * (types + 1))
        key = [np.where(np.isfinite(x), np.floor(x * CELLS), NEVER).astype(np.int64) for x in (two, one)]
        code = ((_context(before).astype(np.int64) << 48) | ((key[0] - NEVER) << 24)) | (key[1] - NEVER)
        found, place = np.unique(code, return_inverse=True)
        sums = [np.bincount(place, weights=np.where(np.isfinite(x), x, 0)) for x in (two, one)]
        low = (1 << 24) - 1
        columns = [(found >> 48).astype(np.int32), (((found >> 24) & low) + NEVER).astype(np.int32), ((found & low) + NEVER).astype(np.int32), np.bincount(place), *sums]
        return pa.table(columns, names=names)

    cells = _by_block(docs, answers.where(F.col("block").bitwiseAND(3) == FITTED), block_bytes, count, "context int, two int, one int, n long, sum_two double, sum_one double")
    found = cells.groupBy("context", "two", "one").agg(F.sum("n").alias("n"), F.sum("sum_two").alias("sum_two"), F.sum("sum_one").alias("sum_one")).orderBy("context", "two", "one").toPandas()
    logs = [np.where(found[key] == NEVER, -np.inf, found[total] / found["n"]) for key, total in (("two", "sum_two"), ("one", "sum_one"))]
    return np.stack([found["context"], found["n"], *logs], axis=1).astype(float)


def _by_block(docs: DataFrame, answers: DataFrame, block_bytes: int, work, schema: str) -> DataFrame:
    """`work` on the rows and the sums of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, blocks in _dealt(batches, block_bytes):
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), *(batch.column(c) for c in ("doc_id", "kind", "text"))], names=["block", "doc_id", "kind", "text"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    dealt = docs.mapInArrow(trimmed(run), f"block long, doc_id {id_type}, kind int, text string")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(work, schema)


def _hold_partitions(spark: SparkSession) -> None:
    """Files are cut by the number of cores there are; that number is written down, so that a lost executor does not change the partitions meanwhile."""
    name = "spark.sql.files.minPartitionNum"
    if not spark.conf.get(name, None):
        spark.conf.set(name, str(spark.sparkContext.defaultParallelism))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score (the mixture), in log10, of every row."""
    doc_id = F.col(id_col)
    rows = docs.select(F.spark_partition_id().alias("part"), doc_id.alias("doc_id"), _kind(doc_id).cast("int").alias("kind"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_buckets = 1 + size // bucket_bytes
    scratch = Scratch(docs.sparkSession)
    _hold_partitions(docs.sparkSession)
    sums = _sent(rows, n_buckets, block_bytes).groupBy("bucket").applyInArrow(_met, "bucket int, block long, pairs boolean, every binary, kept binary, totals array<long>")
    answers = scratch.write(sums, "sums")
    totals = answers.where("block = -1").agg(*(F.coalesce(F.sum(F.col("totals")[k]), F.lit(0)).alias(f"t{k}") for k in range(4))).first()
    types, tokens, kept_types, kept_tokens = totals
    told = answers.where("block >= 0").drop("totals")
    mix = fit(_cells(rows.where(F.col("kind") == FITTED), told, n_buckets, block_bytes, kept_types, kept_tokens))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        pair, before, own, bounds = _joined(left["text"].combine_chunks(), right, n_buckets, "every")
        weights = mix[_context(before)]
        with np.errstate(divide="ignore", invalid="ignore"):
            two = np.where(pair > 0, pair / before, 0)
        found = np.log10(weights[:, 0] * two + weights[:, 1] * own / max(tokens, 1) + weights[:, 2] / (types + 1)) if tokens else np.zeros(len(own))
        base = np.log10((own + 1) / (tokens + types + 1))
        starts = bounds[:-1]
        kind = left["kind"].to_numpy()
        columns = [left["doc_id"], kind == SCORED, np.diff(bounds), np.add.reduceat((own > 0).astype(np.int64), starts), np.full(len(kind), tokens), np.add.reduceat(base, starts), np.add.reduceat(found, starts)]
        return pa.table(columns, names=names)

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return _by_block(rows, told.drop("kept"), block_bytes, work, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
