"""Periodic runs against brute force over all periods, and the query against its contract."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from parcelflow.llm import periodic_runs as P
from parcelflow.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"


def brute(words, least=12):
    """Every period at every place."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def expected(doc_id, text):
    words = WORD.findall(text or "")
    if doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            n = len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    head = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *head, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(kept))


@pytest.mark.parametrize("seed", range(6))
def test_automaton_against_brute_force(seed):
    rnd = random.Random(seed)
    for _ in range(300):
        words = [rnd.randrange(rnd.choice([1, 2, 2, 3, 5])) for _ in range(rnd.randrange(70))]
        least = rnd.choice([2, 3, 5, 12])
        assert P.runs_of(words, least) == brute(words, least)


def texts(seed):
    rnd = random.Random(seed)
    out = []
    for k in range(250):
        names = [f"w{i}é" for i in range(rnd.choice([2, 3, 8, 60]))]
        words = [rnd.choice(names) for _ in range(rnd.randrange(120))]
        for _ in range(rnd.randrange(3)):
            piece = [rnd.choice(names) for _ in range(rnd.randrange(1, 15))] * rnd.randrange(2, 9)
            at = rnd.randrange(len(words) + 1)
            words[at:at] = piece[: len(piece) - rnd.randrange(len(piece) // 3 + 1)]
        out.append((k, "".join(w + rnd.choice([" ", "\n", "\t \r", "  "]) for w in words)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_query_against_brute_force(spark, tmp_path, seed):
    rows = texts(seed) + [(None, "a b " * 9), (900, None), (901, ""), (902, " \n "), (7, "x y " * 20), (7, "x y " * 20), (7, "other text"), (903, "  one two " * 12)]
    spark.createDataFrame(rows, SCHEMA).withColumn("lang", F.lit("en")).withColumn("runs", F.lit(1)).coalesce(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((expected(*r) for r in rows), key=repr)


def test_runs_that_touch_text_and_chunk_edges(spark, monkeypatch):
    monkeypatch.setattr(P.T, "CHUNK_BYTES", 64)
    rows = [(1, "a b c " * 6), (2, "a b c " * 6), (3, "c " * 30), (4, ("p q r s t u v " * 2).strip())]
    got = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in P.collapse(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()}
    assert got == {1: [(0, 18, 3)], 2: [(0, 18, 3)], 3: [(0, 30, 1)], 4: [(0, 14, 7)]}


def test_long_text_and_empty_table(spark):
    words = [f"n{i}" for i in range(30_000)]
    words[5000:25_000] = [f"n{i % 700}" for i in range(20_000)]
    row = P.collapse(spark.createDataFrame([(1, " ".join(words))], SCHEMA)).first()
    assert row["n_words"] == 30_000 and [tuple(r) for r in row["runs"]] == [(5000, 20_000, 700)]
    assert row["collapsed"].split(" ") == words[:5700] + words[25_000:]
    empty = P.digests(P.collapse(spark.createDataFrame([], SCHEMA)))
    assert empty.count() == 0 and "exponent_milli" in empty.columns
