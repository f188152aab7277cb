import random
import zlib

import numpy as np
import pytest

from parcelflow.llm import language


def make(n=700, seed=3):
    rng = random.Random(seed)
    vocab = {"en": ["the", "of", "and", "tion", "ing", "re"], "fr": ["le", "eau", "que", "éoi", "ment", "la"], "de": ["der", "ung", "keit", "sch", "ü", "ein"]}
    rows = []
    for k in range(n):
        lang = rng.choice(["en", "en", "fr", "de"])
        text = " ".join("".join(rng.choices(vocab[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(3, 80)))
        rows.append((k, text.capitalize(), lang, "s"))
    return rows


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.createDataFrame(make(), "doc_id long, text string, lang string, score string").repartition(3)
    return docs, language.fit(language.training_rows(docs))


def test_held_out_accuracy(trained):
    docs, model = trained
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    held = [r for r in make() if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all(got[r[0]].held_out == (zlib.crc32(str(r[0]).encode()) % 5 == 0) for r in make())
    assert len(held) > 100
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_only_the_text_decides(spark, trained):
    _, model = trained
    text = make()[0][1]
    rows = [(1, text, "de", "a"), (2, text, None, "b"), (None, text, "fr", None), (4, None, "en", "c"), (5, "12 - !", "en", "c"), (6, "", None, None), (7, "é", None, None), (8, "eau " * 50000, None, None)]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), model).collect()
    by = {r.doc_id: r for r in got}
    assert len({(r.lang_pred, r.score) for r in (by[1], by[2], by[None])}) == 1
    assert [by[k].lang_pred for k in (4, 5, 6)] == ["und"] * 3 and by[8].lang_pred == "fr"
    assert by[7].lang_pred in model.languages


def test_logits_by_text_match_single_texts(trained):
    import pyarrow as pa

    _, model = trained
    texts = ["", "ab", "the and", None, "abcd", "la", "keitung der", "x"]
    (chunk,) = language.T.chunks(pa.array(texts))
    whole = model.logits(chunk)
    for k, t in enumerate(texts):
        (one,) = language.T.chunks(pa.array([t]))
        assert np.allclose(model.logits(one)[0], whole[k])


def test_rejection_and_no_labels(spark, trained):
    _, model = trained
    docs = spark.createDataFrame([(1, "zzqq xxkk", None, None)], "doc_id long, text string, lang string, source string")
    kept = language.identify(docs, model).first()
    assert kept.lang_pred in model.languages
    assert language.identify(docs, model, reject=True).first().lang_pred == ("und" if kept.rejected else kept.lang_pred)
    assert language.fit(language.training_rows(docs)) is None
    assert language.identify(docs, None).first().lang_pred == "und"
    assert language.identify(docs.limit(0), model).count() == 0


def test_letters_are_those_of_unicode(spark, trained):
    _, model = trained
    rows = [(1, "² ½ ① Ⅷ"), (2, "² ½ ① Ⅷ ª"), (3, "٣ _ 7"), (4, "漢")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[1] == got[3] == ("und", 0.0)
    assert got[2][0] in model.languages and got[4][0] in model.languages


def test_training_rows_count_whole_texts_and_stay_bounded(spark):
    long = "abc" * 5000
    docs = spark.createDataFrame([(2, long, "en"), (2, long, "en"), (3, "xy", "fr"), (4, None, "fr")], "doc_id long, text string, lang string")
    rows = language.training_rows(docs)
    assert sorted(int(c.sum()) for _, c, _ in rows) == sorted([0, 0] + [len(long) - 2 + len(long) - 4] * 2)
    many = spark.createDataFrame([(k, f"word {k}", f"l{k % 3}") for k in range(900)], "doc_id long, text string, lang string")
    assert 100 < len(language.training_rows(many, most=150)) < 220
    assert {lang for *_, lang in language.training_rows(many, most=150)} == {"l0", "l1", "l2"}
