"""The language model against one that reads all texts into dictionaries."""

import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelflow.llm import language_model as L
from parcelflow.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"


def tokens(text):
    return [*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), None]


def kind(doc_id):
    if doc_id is None:
        return L.COUNTED
    crc = zlib.crc32(str(doc_id).encode())
    return L.SCORED if crc % 7 == 2 else L.FITTED if crc // 7 % 10 == 0 else L.COUNTED


def counts(rows, kinds):
    words, pairs = Counter(), Counter()
    for doc_id, text in rows:
        if kind(doc_id) in kinds:
            found = tokens(text)
            words.update(found)
            pairs.update(zip(["<s>", *found[:-1]], found, strict=True))
    words["<s>"] = words[None]
    return words, pairs, sum(words.values()) - words["<s>"], len([w for w, n in words.items() if n]) - (words["<s>"] > 0)


def bucket(n):
    return n.bit_length()


def weights(rows):
    """Expectation-maximisation token by token, without cells."""
    words, pairs, total, types = counts(rows, {L.COUNTED})
    seen = []
    for doc_id, text in rows:
        if kind(doc_id) == L.FITTED:
            found = tokens(text)
            for v, w in zip(["<s>", *found[:-1]], found, strict=True):
                two = pairs[v, w] / words[v] if words[v] else 0
                seen.append((bucket(words[v]), two * (types + 1), words[w] / max(total, 1) * (types + 1), 1))
    allowed = np.ones((L.CONTEXTS, 3))
    allowed[0, 0] = 0
    mix = allowed / allowed.sum(1, keepdims=True)
    if not seen:
        return mix
    context, ratios = np.array([s[0] for s in seen]), np.array([s[1:] for s in seen])
    for _ in range(L.ROUNDS):
        share = mix[context] * ratios
        share /= share.sum(1, keepdims=True)
        new = 0.5 * allowed
        np.add.at(new, context, share)
        mix = new / new.sum(1, keepdims=True)
    for k in range(2, L.CONTEXTS):
        if k not in context and any(j in context for j in range(1, k)):
            mix[k] = mix[k - 1]
    return mix


def expected(rows):
    words, pairs, total, types = counts(rows, {L.COUNTED, L.FITTED})
    mix, out = weights(rows), []
    for doc_id, text in rows:
        found, base, score = tokens(text), 0.0, 0.0
        for v, w in zip(["<s>", *found[:-1]], found, strict=True):
            a, b, u = mix[bucket(words[v])]
            base += math.log10((words[w] + 1) / (total + types + 1))
            score += math.log10(a * (pairs[v, w] / words[v] if words[v] else 0) + b * words[w] / total + u / (types + 1)) if total else 0
        out.append((doc_id, kind(doc_id) == L.SCORED, len(found), sum(words[w] > 0 for w in found), total, base, score))
    return sorted(out, key=repr)


def made(n, seed):
    rnd = random.Random(seed)
    names = [f"w{i}" for i in range(200)] + ["É", "éa", "A", "a"]
    out = []
    for i in range(n):
        words, now = [], rnd.randrange(200)
        for _ in range(rnd.randrange(60)):
            now = (now * 7 + rnd.randrange(4)) % 200 if rnd.random() < 0.7 else rnd.randrange(200)
            words.append(rnd.choice([names[now], names[now].upper(), rnd.choice(names)]))
        out.append((i, rnd.choice([" ", "\n", " \t"]).join(words)))
    return out + [(None, "no id"), (n, None), (n + 1, ""), (n + 2, "  "), (3, "w1 w2"), (3, "w1 w2"), (n + 3, "w1 " * 3000)]


def assert_close(got, want):
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9, atol=1e-9)
    assert np.allclose([r[6] for r in got], [r[6] for r in want], rtol=5e-3, atol=5e-3)  # cells of half an octave in the fit


def ordered(df):
    return sorted(map(tuple, df.collect()), key=lambda r: repr(r[:3]))


@pytest.mark.parametrize("block_bytes,bucket_bytes", [(L.BLOCK_BYTES, L.BUCKET_BYTES), (700, 900)])
def test_against_dictionaries(spark, tmp_path, block_bytes, bucket_bytes):
    rows = made(300, 1)
    spark.createDataFrame(rows, SCHEMA).withColumn("kind", F.lit("x")).withColumn("block", F.lit(1)).repartition(3).write.parquet(f"{tmp_path}/d")
    got = ordered(L.score(spark.read.parquet(f"{tmp_path}/d"), block_bytes=block_bytes, bucket_bytes=bucket_bytes))
    assert_close(got, sorted(expected(rows), key=lambda r: repr(r[:3])))


def test_model_beats_the_base_on_held_out_rows(spark):
    rows = made(400, 5)
    got = [r for r in L.score(spark.createDataFrame(rows, SCHEMA)).collect() if r["held_out"]]
    assert got and sum(r["score"] for r in got) > sum(r["base_score"] for r in got) * 0.95


def test_nothing_to_learn_from_and_empty_table(spark):
    only = next(i for i in range(100) if kind(i) == L.SCORED)
    row = L.score(spark.createDataFrame([(only, "a b")], SCHEMA)).first()
    assert tuple(row) == (only, True, 3, 0, 0, 0.0, 0.0)
    assert L.score(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_query(spark):
    got = queries.op13_language_model(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert_close(ordered(got), sorted(expected(rows), key=lambda r: repr(r[:3])))
