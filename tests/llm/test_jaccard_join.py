import random
import re

import numpy as np
import pytest

from parcelflow.llm import jaccard_join as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(folded)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, part):
    sets = [shingles(r[1], k) for r in rows]
    up = {r[0]: r[0] for r in rows if r[0] is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if rows[i][0] is None or rows[j][0] is None or not a or not b:
                continue
            if 100 * len(a & b) >= part * len(a | b):
                x, y = root(rows[i][0]), root(rows[j][0])
                up[max(x, y)] = min(x, y)
    return sorted(((r[0], len(s), None if r[0] is None else root(r[0])) for r, s in zip(rows, sets, strict=True)), key=str)


def make(seed, groups=12, n=160, passage=True):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    shared = rng.choices(vocab, k=30)
    rows = []
    for g in range(groups):
        base = rng.choices(vocab, k=rng.choice([3, 8, 40, 60, 90]))
        for _ in range(rng.choice([1, 2, 3, 8, 30])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                at = rng.randrange(len(words))
                words[at : at + 1] = rng.choice([[], ["x%d" % rng.randint(0, 9)], [words[at], "y"]])
            if passage and rng.random() < 0.5:
                words = words + shared
            rows.append(" ".join(w.upper() if rng.random() < 0.1 else w for w in words))
    rows += [" ".join(shared + rng.choices(vocab, k=rng.randint(0, 6))) for _ in range(20)]
    rows += [None, "", " \n", "a", "A", "a b", "x " * 50, "x " * 70, "w1\tw2\nw3 w4", "w1 w2 w3 w4"]
    rng.shuffle(rows)
    return [(k, t, "clash", 1) for k, t in enumerate(rows[:n])]


@pytest.mark.parametrize(("seed", "k", "part", "cell", "rare"), [(1, 4, 85, 256, 12), (2, 5, 80, 256, 3), (3, 4, 85, 4, 1), (4, 2, 60, 3, 4)])
def test_matches_brute_force(spark, seed, k, part, cell, rare, monkeypatch):
    monkeypatch.setattr(J, "CELL_SETS", cell)
    monkeypatch.setattr(J, "RARE", rare)
    rows = make(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string, n int").repartition(4)
    got = sorted(map(tuple, J.join(docs, k, part).collect()), key=str)
    assert got == brute(rows, k, part)


def test_odd_rows(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(None, text), (5, text), (5, text), (3, text), (9, None), (None, None), (2, "long " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, J.join(docs).collect()), key=str)
    assert got == sorted([(None, 37, None), (5, 37, 3), (5, 37, 3), (3, 37, 3), (9, 0, 9), (None, 0, None), (2, 1, 2)], key=str)
    assert J.join(docs.limit(0)).count() == 0


def test_prefixes_of_linked_sets_meet():
    rng = np.random.default_rng(0)
    frequency = rng.integers(0, 3, J.FREQUENCY_CELLS).astype(np.uint8)
    for part in (80, 85):
        terms = J.Terms(4, part)
        for n in range(1, 120):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            for drop in range(n):
                if 100 * (n - drop) >= part * n:
                    b = a[rng.permutation(n)[drop:]]
                    for order in (1, 2, 3):
                        met = np.intersect1d(J.prefix_of(a, order, frequency, terms), J.prefix_of(b, order, frequency, terms)).size
                        assert met >= min(terms.common(len(a), order), terms.common(len(b), order)) >= max(terms.need(len(a), order), 1)


@pytest.mark.parametrize("common", [1, 3, 48])
def test_shared_counts(common, monkeypatch):
    monkeypatch.setattr(J, "COMMON", common)
    monkeypatch.setattr(J, "COLUMNS", 7)
    rng = np.random.default_rng(common)
    lists = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (0, 1, 5, 40, 40, 80, 3)]
    got = J._shared_counts(lists)
    for a in range(len(lists)):
        for b in range(len(lists)):
            if a != b:
                assert got[a, b] == len(np.intersect1d(lists[a], lists[b]))
    assert J._shared_counts([np.empty(0, np.uint64)] * 2).sum() == 0
