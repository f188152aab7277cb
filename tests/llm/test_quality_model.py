import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from parcelflow.llm import quality_model as Q


def make(n=900, seed=6):
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        words = ["".join(rng.choices(["the", "re", "on", "ing", "sh"], k=rng.randint(1, 3))) for _ in range(rng.randint(20, 120))]
        bad = rng.random() < 0.25
        if bad:
            kind = rng.randint(0, 2)
            words = [w + "###" for w in words] if kind == 0 else [w.upper() + "!!" for w in words] if kind == 1 else [words[0]] * len(words)
        rows.append((k, " ".join(words) + ".", "en", "x"))
        if k % 3:
            labels.append((k, int(not bad), 0))
    return rows, labels


@pytest.fixture(scope="module")
def trained(spark):
    rows, labels = make()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(3)
    table = spark.createDataFrame([*labels, (None, 1, 0), (7, None, None), (7, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, table, Q.train(docs, table)


def test_held_out_labels(trained):
    docs, _, model = trained
    got = {r.doc_id: r for r in Q.score(docs, model).collect()}
    held = [(k, q) for k, q, _ in make()[1] if zlib.crc32(str(k).encode()) % 5 == 0]
    assert len(got) == 900 and len(held) > 80
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert sum(got[k].predicted == q for k, q in held) >= 0.97 * len(held)
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())


def test_walk_matches_plain_walk(trained):
    _, _, model = trained
    rng = np.random.default_rng(1)
    x = rng.normal(0, 2, (200, len(Q.FEATURES)))
    inner = model.feature.shape[1]
    for row, got in zip(x, model.raw(x), strict=True):
        total = model.base
        for f, t, v in zip(model.feature, model.threshold, model.value, strict=True):
            at = 0
            while at < inner:
                at = 2 * at + 1 + int(row[f[at]] > t[at])
            total += v[at - inner]
        assert total == pytest.approx(got)


def test_statistics_do_not_depend_on_neighbours():
    texts = ["", None, "a b c a b c", "x\ny\nx\n", " \n", "é ü", "A! B! #", "one"]
    (chunk,) = Q.T.chunks(pa.array(texts))
    whole = Q.statistics(chunk)
    for k, t in enumerate(texts):
        (one,) = Q.T.chunks(pa.array([t]))
        assert np.allclose(Q.statistics(one)[0], whole[k])
    assert np.isfinite(whole).all()


def test_odd_rows_and_no_labels(spark, trained):
    docs, table, model = trained
    odd = spark.createDataFrame([(1, None), (None, ""), (3, "w " * 300000), (3, "w " * 300000)], "doc_id long, text string")
    assert Q.score(odd, model).count() == 4
    none = Q.train(docs, table.limit(0))
    assert {r.score for r in Q.score(odd, none).collect()} == {0.5}
    assert Q.score(docs.limit(0), model).count() == 0
    kept = Q.keep_good(docs, model)
    assert kept.columns == docs.columns and 500 < kept.count() < 800
