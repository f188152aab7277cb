import re

import numpy as np
import pyarrow as pa

from parcelflow.llm import textarrays as T

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
TEXTS = ["", None, "a", " a  b\tc\n", "abc", "abc abc", "é\xa0ü x\x0by", "\n\n", "end\n", "Abc", "x\n\nx\n y", "tail ", "日本 語", "a", "last"]


def test_words_lines_and_chunks():
    for most in (1, 7, 10**6):
        found, lines, hashes = [], [], {}
        for chunk in T.chunks(pa.array(TEXTS), most):
            w, l = T.words_of(chunk), T.lines_of(chunk)
            for k in range(chunk.last - chunk.first):
                a, b = w.bounds[k], w.bounds[k + 1]
                mine = [bytes(chunk.data[s:e]) for s, e in zip(w.starts[a:b], w.ends[a:b], strict=True)]
                found.append(mine)
                for word, h in zip(mine, w.hashes[a:b], strict=True):
                    assert hashes.setdefault(word, h) == h
                a, b = l.bounds[k], l.bounds[k + 1]
                lines.append([bytes(chunk.data[s:e]) for s, e in zip(l.starts[a:b], l.ends[a:b], strict=True)])
        data = [(t or "").encode() for t in TEXTS]
        assert found == [WORD.findall(t) for t in data]
        assert lines == [[x for x in t.split(b"\n") if WORD.search(x)] for t in data]
        assert len(set(hashes.values())) == len(hashes)


def test_sliced_column_and_sequences():
    column = pa.array(["skip me", "a b c d", "b c", "c"])[1:]
    (chunk,) = T.chunks(column)
    w = T.words_of(chunk)
    seq, bounds = w.sequences(2)
    assert bounds.tolist() == [0, 3, 4, 4]
    assert seq[1] == seq[3] and len(np.unique(seq)) == 3
    assert w.ranges(np.array([1]), np.array([3]))[0] == seq[1]
    assert T.distinct_counts(w.hashes, w.bounds).tolist() == [4, 2, 1]


def test_lower():
    (chunk,) = T.chunks(pa.array(["ABC abc Abç"]))
    h = T.words_of(chunk, lower=True).hashes
    assert h[0] == h[1] != h[2]
