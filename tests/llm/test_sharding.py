import random
import zlib
from collections import Counter, defaultdict

import pytest

from parcelflow.llm import sharding


def check(rows, got, n_shards):
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    text = {r[0]: r[1] for r in rows}
    counts = Counter(r.shard for r in got)
    sizes = [counts.get(s, 0) for s in range(n_shards)]
    assert max(sizes) - min(sizes) <= 1
    assert set(counts) <= set(range(n_shards))
    slots = defaultdict(list)
    for r in got:
        data = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
        slots[r.shard].append(r.slot)
    for s, found in slots.items():
        assert sorted(found) == list(range(counts[s]))


def kept_together(rows, got):
    text, where = {r[0]: r[1] for r in rows}, defaultdict(Counter)
    for r in got:
        if text[r.doc_id] is not None:
            where[text[r.doc_id]][r.shard] += 1
    groups = [c for c in where.values() if sum(c.values()) > 1]
    return sum(max(c.values()) for c in groups) / max(1, sum(sum(c.values()) for c in groups))


@pytest.mark.parametrize("hot", [0, 1500])
def test_even_and_together(spark, hot):
    rng = random.Random(5)
    texts = [f"text {k} é" for k in range(2500)] + [f"copy {rng.randint(0, 120)}" for _ in range(600)] + ["hot"] * hot + [None] * 40 + [""] * 30
    rng.shuffle(texts)
    rows = [(k, t, 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size int").repartition(6)
    got = sharding.shard(docs).collect()
    check(rows, got, 8)
    rest = [r for r in rows if r[1] != "hot"]
    ids = {r[0] for r in rest}
    assert kept_together(rest, [r for r in got if r.doc_id in ids]) > 0.95
    assert not hot or len({r.shard for r in got if r.doc_id not in ids}) <= 8


def test_all_linked(spark):
    rows = [(k, f"t{k // 7}") for k in range(700)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), n_shards=3).collect()
    check(rows, got, 3)
    assert kept_together(rows, got) > 0.8


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, "a"), (2, "a"), (3, "b")]])
def test_small_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, sharding.shard(docs).collect(), 8)
