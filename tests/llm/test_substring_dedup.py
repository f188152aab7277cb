import hashlib
import random
import re

import duckdb
import pytest

from parcelflow.llm import substring_dedup as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    first, words = {}, [WORD.findall(r[1] or "") for r in rows]
    for (doc_id, *_), w in zip(rows, words, strict=True):
        for i in range(len(w) - window + 1 if doc_id is not None else 0):
            g = tuple(w[i : i + window])
            first[g] = min(first.get(g, doc_id), doc_id)
    out = []
    for (doc_id, *_), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1 if doc_id is not None else 0):
            if first[tuple(w[i : i + window])] < doc_id:
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((doc_id, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def make(seed, window, n=120):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)] + ["é", "日本"]
    passages = [rng.choices(vocab, k=rng.randint(window - 2, 3 * window)) for _ in range(4)]
    base = rng.choices(vocab, k=5 * window)
    rows = []
    for _ in range(n):
        kind, words = rng.random(), rng.choices(vocab, k=rng.randint(0, 4 * window))
        if kind < 0.5:
            p = rng.choice(passages)
            a = rng.randint(0, 2)
            words[rng.randint(0, len(words)) : 0] = p[a : len(p) - rng.randint(0, 2)]
        elif kind < 0.7:
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = "edit"
        elif kind < 0.75:
            words = ["ha"] * rng.randint(1, 4 * window)
        elif kind < 0.8:
            words = words + words
        rows.append(rng.choice([" ", "\n", "\t "]).join(words))
    rows += [None, "", rows[0], rows[0], rows[60]]
    rng.shuffle(rows)
    return [(k, t, "x") for k, t in enumerate(rows)]


@pytest.mark.parametrize(("seed", "window", "most"), [(1, 50, 256), (2, 12, 256), (3, 12, 2), (4, 5, 3), (5, 50, 0)])
def test_matches_brute_force(spark, seed, window, most, monkeypatch):
    monkeypatch.setattr(S, "SHARD_RUNS", most)
    rows = make(seed, window)
    docs = spark.createDataFrame(rows, "doc_id long, text string, th string").repartition(4)
    got = sorted(map(tuple, S.digests(docs, window).collect()), key=str)
    assert got == brute(rows, window)


def test_odd_rows(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(None, text), (4, text), (4, text), (4, "x " + text), (7, "y " + text), (None, None), (9, None), (2, "long " * 30000), (3, "long " * 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, S.digests(docs).collect()), key=str) == brute(rows, 50)
    assert S.digests(docs.limit(0)).count() == 0


def test_sql_twin(spark):
    rows = [(k, t) for k, t, _ in make(8, 50)]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, S.digests(docs).collect())) == sorted(con.execute(S.ORACLE).fetchall())


def test_strip(spark):
    head, passage = "a  b\nc", " ".join(f"p{k}" for k in range(55))
    rows = [(1, f"{head} {passage}", 5), (2, f"{head}\t{passage} tail\n", 6), (3, passage, 7), (4, None, 8), (None, passage, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in S.strip(docs).collect()}
    assert got == {1: (rows[0][1], 5), 2: ("tail", 4), 4: (None, 8), None: (passage, 9)}


def test_automaton_against_substrings():
    rng = random.Random(0)
    for _ in range(200):
        known = [[rng.choice("ab") for _ in range(rng.randint(0, 9))] for _ in range(3)]
        text = [rng.choice("abc") for _ in range(12)]
        automaton = S.SuffixAutomaton()
        for w in known:
            automaton.add(w)
        has = {tuple(w[i:j]) for w in known for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
        want = [max((n for n in range(k + 2) if n == 0 or tuple(text[k + 1 - n : k + 1]) in has)) for k in range(len(text))]
        assert automaton.statistics(text) == want
