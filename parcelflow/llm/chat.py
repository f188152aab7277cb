"""Chat formatting with loss masks aligned to token offsets.

A conversation is rendered whole, in order of turn, as
`<|im_start|>role<|im_sep|>text<|im_end|>` and a newline for each turn, and encoded once with
offsets. The spans of assistant texts and the spans of tokens are both sorted; binary search
finds the tokens that meet an assistant span. The three markers are single tokens, so that no
token reaches over the edge of a text.

Inside roles and texts, `<` followed by backslashes and `|` gets one more backslash, so that no
marker can stand there; taking one away restores the text. A conversation longer than
`segment_chars` comes as several segments, cut between turns, where no token can cross.

Null texts and roles are empty. Turns sort by number, nulls first, then role and text; repeated
rows are turns of their own. Rows without conv_id are one conversation. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<(\\*)\\\|")
_TURN = re.compile(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>\n", re.DOTALL)
SEGMENT_CHARS = 1_000_000


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


@dataclass
class Segment:
    """Some turns of one conversation in a row: the rendered text, its tokens and their mask."""

    conv_id: int | None
    number: int
    turns: list[str] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)
    chars: int = 0
    last: bool = False
    formatted: str = ""
    ids: list[int] = field(default_factory=list)
    offsets: np.ndarray | None = None
    mask: np.ndarray | None = None

    def add(self, role: str, text: str, learn: bool) -> None:
        head = f"{START}{escape(role)}{SEP}"
        body = escape(text)
        if learn:
            self.spans.append((self.chars + len(head), self.chars + len(head) + len(body)))
        self.turns.append(f"{head}{body}{END}\n")
        self.chars += len(self.turns[-1])


def token_mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Whether each token (start, end) meets one of the sorted, disjoint spans."""
    if not len(spans):
        return np.zeros(len(offsets), bool)
    k = np.searchsorted(spans[:, 1], offsets[:, 0], side="right")  # the first span that ends after the token starts
    starts = np.append(spans[:, 0], np.iinfo(np.int64).max)
    return (starts[k] < offsets[:, 1]) & (offsets[:, 0] < offsets[:, 1])


def masked_spans(offsets: np.ndarray, mask: np.ndarray) -> list[tuple[int, int]]:
    """Character spans under the mask; tokens that share a character count it once."""
    at = offsets[mask]
    if not len(at):
        return []
    ends = np.maximum.accumulate(at[:, 1])
    cut = np.flatnonzero(at[1:, 0] > ends[:-1]) + 1
    return list(zip(at[np.r_[0, cut], 0].tolist(), ends[np.r_[cut - 1, len(at) - 1]].tolist(), strict=True))


class Encoder:
    """The tokenizer with the template's markers as tokens of their own."""

    def __init__(self, definition: str):
        from tokenizers import AddedToken, Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.add_special_tokens([AddedToken(x, normalized=False, special=True) for x in (START, SEP, END)])

    def encode(self, segments: list[Segment]) -> None:
        for s in segments:
            s.formatted = "".join(s.turns)
            s.turns = []
        for s, found in zip(segments, self.tokenizer.encode_batch([s.formatted for s in segments], add_special_tokens=False), strict=True):
            s.ids = found.ids
            s.offsets = np.array(found.offsets, np.int64).reshape(-1, 2)
            s.mask = token_mask(s.offsets, np.array(s.spans, np.int64).reshape(-1, 2))


_ENCODERS: dict[int, Encoder] = {}


def _segments(batches: Iterator[pa.RecordBatch], definition: str, segment_chars: int) -> Iterator[Segment]:
    """Encoded segments in order, from rows sorted by conversation and turn."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if hash(definition) not in _ENCODERS:
        _ENCODERS[hash(definition)] = Encoder(definition)
    encoder = _ENCODERS[hash(definition)]
    waiting: list[Segment] = []
    size = 0
    now: Segment | None = None

    def flush() -> list[Segment]:
        nonlocal waiting, size
        ready, waiting, size = waiting, [], 0
        encoder.encode(ready)
        return ready

    for batch in batches:
        for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    now.last = True
                    waiting.append(now)
                    size += now.chars
                    if size > segment_chars:
                        yield from flush()
                now = Segment(conv_id, 0)
            elif now.chars > segment_chars:
                waiting.append(now)
                yield from flush()
                now = Segment(conv_id, now.number + 1)
            now.add(role or "", text or "", role == "assistant")
    if now is not None:
        now.last = True
        waiting.append(now)
    yield from flush()


def _sorted(conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id")
    return rows.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text").select("conv_id", "role", "text")


def format_chats(conversations: DataFrame, definition: str, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """conv_id, segment, formatted, ids and loss_mask; one row for each segment, most conversations have one."""
    shared = conversations.sparkSession.sparkContext.broadcast(definition)  # a tokenizer file, under 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _segments(batches, shared.value, segment_chars):
            yield pa.RecordBatch.from_arrays(
                [pa.array([s.conv_id], pa.int64()), pa.array([s.number], pa.int32()), pa.array([s.formatted]), pa.array([s.ids], pa.list_(pa.int32())), pa.array([s.mask.tolist()], pa.list_(pa.bool_()))],
                names=["conv_id", "segment", "formatted", "ids", "loss_mask"],
            )

    return _sorted(conversations).mapInArrow(run, "conv_id long, segment int, formatted string, ids array<int>, loss_mask array<boolean>")


def digests(conversations: DataFrame, definition: str, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, all read back from the formatted text, its offsets and its mask."""
    shared = conversations.sparkSession.sparkContext.broadcast(definition)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for s in _segments(batches, shared.value, segment_chars):
            if s.number == 0:
                turns, learned, n_turns, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for role, text in _TURN.findall(s.formatted):
                turns.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                n_turns += 1
            for a, b in masked_spans(s.offsets, s.mask):
                piece = unescape(s.formatted[a:b])
                learned.update(piece.encode())
                loss_chars += len(piece)
            chars += len(s.formatted)
            if s.last:
                out.append((s.conv_id, n_turns, turns.hexdigest(), loss_chars, learned.hexdigest(), chars))
            if len(out) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return _sorted(conversations).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


ORACLE = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, unnest([0, 1]), unnest(['user', 'assistant']), '<|im_end|><|im_start|>assistant ok')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(33 + length(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')))::bigint as formatted_chars
from c group by conv_id
"""
