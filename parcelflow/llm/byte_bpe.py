"""Byte-level BPE encoding and decoding in length-bucketed padded numpy matrices.

Texts are cut by the vocabulary's pattern. The distinct pieces of a batch are put, by
length, into padded id matrices. In each round every row merges its leftmost pair of
minimum rank; finished rows leave the matrix. Pair ranks come from an open-addressing
hash table in two numpy arrays.

Null texts encode as empty texts: no ids, empty bytes. Any code point is encoded, as UTF-8.
Equal texts get equal ids; columns other than the id and the text are never looked at.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from parcelflow.llm.shared import trimmed

NO_RANK = np.int32(2**31 - 1)
#: Pieces longer than this merge on their own, all equal pairs of a round at once.
LONG_PIECE = 256
#: Entries of the piece cache of one worker; it is emptied when full.
CACHE_ENTRIES = 100_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from lines of base64 token and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class PairTable:
    """(left id, right id) -> rank of the merged token, by linear probing."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left = ranks.get(token[:cut])
                if left is not None:
                    right = ranks.get(token[cut:])
                    if right is not None:
                        keys.append(left << 32 | right)
                        values.append(rank)
        bits = max(8, (4 * max(1, len(keys)) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, NO_RANK, np.int32)
        self.probes = 1
        todo, ranks_todo = np.array(keys, np.int64), np.array(values, np.int32)
        slot = self._home(todo)
        while len(todo):
            free = self.keys[slot] == -1
            where, first = np.unique(slot[free], return_index=True)
            placed = np.flatnonzero(free)[first]
            self.keys[where], self.values[where] = todo[placed], ranks_todo[placed]
            left = np.ones(len(todo), bool)
            left[placed] = False
            todo, ranks_todo, slot = todo[left], ranks_todo[left], (slot[left] + 1) & self.mask
            self.probes += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * MULTIPLIER) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NO_RANK where the pair makes no token."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._home(keys)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.values[slot], NO_RANK)
        open_ = np.flatnonzero((seen != keys) & (seen != -1))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & self.mask
            seen = self.keys[slot[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (seen != -1)]
        return out


class ByteBpe:
    """One vocabulary: pieces to ids and ids to bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.rank_of = ranks
        self.pairs = PairTable(ranks)
        self.find = regex.compile(pattern).findall
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.token_of: list[bytes] = [b""] * (1 + max(ranks.values()))
        for token, rank in ranks.items():
            self.token_of[rank] = token
        self.cache: dict[str, tuple[int, ...]] = {}
        self.digits: dict[str, str] = {}

    def _merge_matrix(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        rows = len(pieces)
        lens = np.fromiter(map(len, pieces), np.int64, rows)
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        cols = np.arange(width)
        ids = np.full((rows, width), -1, np.int32)
        ids[cols[None, :] < lens[:, None]] = self.byte_ids[flat]
        rank = np.full((rows, width), NO_RANK, np.int32)
        real = cols[None, : width - 1] < (lens - 1)[:, None]
        rank[:, : width - 1][real] = self.pairs.ranks(ids[:, :-1][real], ids[:, 1:][real])
        out: list[np.ndarray] = [np.empty(0, np.int32)] * rows
        row_of = np.arange(rows)
        while len(row_of):
            at = rank.argmin(axis=1)
            n = np.arange(len(row_of))
            best = rank[n, at]
            done = best == NO_RANK
            if done.any():
                for r in np.flatnonzero(done):
                    out[row_of[r]] = ids[r, : lens[r]].copy()
                keep = ~done
                most = int(lens[keep].max(initial=0))
                ids, rank, lens = ids[keep, :most], rank[keep, :most], lens[keep]
                row_of, at, best = row_of[keep], at[keep], best[keep]
                if not len(row_of):
                    break
                cols, n = np.arange(most), np.arange(len(row_of))
            shifted = cols[None, :-1] > at[:, None]
            ids[:, :-1] = np.where(shifted, ids[:, 1:], ids[:, :-1])
            rank[:, :-1] = np.where(shifted, rank[:, 1:], rank[:, :-1])
            ids[:, -1], rank[:, -1] = -1, NO_RANK
            lens -= 1
            ids[n, at] = best
            rank[n, at] = NO_RANK
            for left in (at - 1, at):
                ok = (left >= 0) & (left + 1 < lens)
                r, c = n[ok], left[ok]
                rank[r, c] = self.pairs.ranks(ids[r, c], ids[r, c + 1])
        return out

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """As one row, but every occurrence of the best pair that one merge at a time would take next merges at once."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        while len(ids) > 1:
            rank = self.pairs.ranks(ids[:-1], ids[1:])
            best = rank.min()
            if best == NO_RANK:
                break
            at = np.flatnonzero(rank == best)
            runs = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1)
            at = np.concatenate([run[::2] for run in runs])  # aaa: the left pair of the run wins
            merged = np.full(len(at), best, np.int32)
            before = np.where(at > 0, ids[np.maximum(at - 1, 0)], -1)
            before[1:][np.diff(at) == 2] = best
            after = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
            lower = np.zeros(len(at), bool)
            ok = before >= 0
            lower[ok] |= self.pairs.ranks(before[ok], merged[ok]) <= best
            ok = after >= 0
            lower[ok] |= self.pairs.ranks(merged[ok], after[ok]) <= best
            if lower.any():  # a new pair goes first
                at = at[: int(lower.argmax()) + 1]
            ids = ids.copy()
            ids[at] = best
            ids = np.delete(ids, at + 1)
        return ids

    def encode_pieces(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each piece; a piece that is a token is that token."""
        out: list[tuple[int, ...]] = [()] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            whole = self.rank_of.get(piece)
            if whole is not None:
                out[k] = (whole,)
            elif len(piece) > LONG_PIECE:
                out[k] = tuple(self._merge_long(piece).tolist())
            elif piece:
                size = len(piece)
                buckets.setdefault(size + size % 2 if size <= 16 else 1 << (size - 1).bit_length(), []).append(k)
        for width, members in sorted(buckets.items()):
            step = max(1, 1_000_000 // width)
            for start in range(0, len(members), step):
                part = members[start : start + step]
                for k, ids in zip(part, self._merge_matrix([pieces[k] for k in part], width), strict=True):
                    out[k] = tuple(ids.tolist())
        return out

    def encode(self, texts: Iterable[str | None]) -> list[list[str]]:
        """The pieces of each text, with all of them in the cache afterwards."""
        cut = [self.find(text) if text else [] for text in texts]
        if len(self.cache) > CACHE_ENTRIES:
            self.forget()
        new = list(set(chain.from_iterable(cut)).difference(self.cache))
        for piece, ids in zip(new, self.encode_pieces([p.encode("utf-8", "replace") for p in new]), strict=True):
            self.cache[piece] = ids
            self.digits[piece] = ",".join(map(str, ids))
        return cut

    def forget(self) -> None:
        """Empties the caches, at the end of a task: a worker may serve other operators next."""
        self.cache.clear()
        self.digits.clear()

    def ids(self, pieces: list[str]) -> list[int]:
        return list(chain.from_iterable(map(self.cache.__getitem__, pieces)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token_of.__getitem__, ids))


_BUILT: dict[tuple[int, str], ByteBpe] = {}


def _table(data: bytes, pattern: str) -> ByteBpe:
    key = (hash(data), pattern)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = ByteBpe(parse_ranks(data), pattern)
    return _BUILT[key]


def _slices(texts: list[str | None], most: int = 500_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` characters, so that memory does not follow the batch."""
    start = size = 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= most:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, ranks: bytes, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """All columns of `docs` and their ids as array<int>; null texts get an empty array."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary file, about 1 MB
    others = [f for f in docs.schema.fields if f.name != ids_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others) + f", `{ids_col}` array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _table(shared.value, pattern)
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            for a, b in _slices(texts):
                ids = [bpe.ids(pieces) for pieces in bpe.encode(texts[a:b])]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in others] + [pa.array(ids, pa.list_(pa.int32()))], names=[f.name for f in others] + [ids_col])
        bpe.forget()

    return docs.mapInArrow(trimmed(run), schema)


def decode(coded: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """`id_col` and the bytes of the ids; null ids decode as none."""
    shared = coded.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _table(shared.value, pattern)
        for batch in batches:
            out = [bpe.decode(ids or ()) for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(out, pa.binary())], names=[id_col, "decoded"])

    return coded.select(id_col, ids_col).mapInArrow(trimmed(run), f"`{id_col}` {coded.schema[id_col].dataType.simpleString()}, decoded binary")


def round_trip(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: each text encoded, its ids decoded, and both digested where they are made."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _table(shared.value, pattern)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts, coded, decoded = [], [], []
            for a, b in _slices(texts):
                for pieces in bpe.encode(texts[a:b]):
                    ids = bpe.ids(pieces)
                    counts.append(len(ids))
                    coded.append(hashlib.sha256(",".join(map(bpe.digits.__getitem__, pieces)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.forget()

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
