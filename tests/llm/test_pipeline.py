import random
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

import public_tokenizers  # noqa: E402
import tiktoken  # noqa: E402

from parcelflow.llm import byte_bpe, queries  # noqa: E402
from test_jaccard_join import brute as components  # noqa: E402
from test_mixing import brute_targets  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    vocab = [f"{a}{b}" for a in ("the", "on", "er", "re", "ing") for b in ("sh", "at", "in", "le", "ed", "or")]
    passage = " ".join(rng.choices(vocab, k=60))
    rows, labels = [], []
    for k in range(400):
        words = " ".join(rng.choices(vocab, k=rng.randint(30, 120))) + "."
        bad = k % 5 == 0
        if bad:
            words = words.upper().replace(" ", "!! ### ")
        elif k % 7 == 0:
            words += " " + passage
        elif k % 11 == 0:
            words = rows[k - 1][1] if k % 2 else rows[k - 1][1] + " tail"
        rows.append((k, words, "en", f"s{k % 4}", len(words)))
        labels.append((k, int("###" not in words), 0))
    rows += [(400, None, None, None, None), (401, "", "en", None, 0), (None, "no id here but words", None, "s1", 20), (403, "long " + "word " * 20000, None, "s2", None)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_in_turn(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(docs.collect())
    good, single, cut, mixed, coded = kept
    assert not any(r.text and "###" in r.text for r in good)
    assert len([r for r in good if r.doc_id is not None and r.doc_id < 400]) > 300
    want = {i for i, _, c in components([(r.doc_id, r.text) for r in good], 5, 80) if i == c}
    assert {r.doc_id for r in single} == want
    gone = {r.doc_id for r in single} - {r.doc_id for r in cut}
    assert all(len(r.text.split()) >= 50 for r in single if r.doc_id in gone)
    assert sum(len((r.text or "").split()) for r in cut) < sum(len((r.text or "").split()) for r in single)
    assert all(r.n_chars == len(r.text) for r in cut if r.text and r.doc_id != 403 and r.doc_id is not None)
    sizes, taken = Counter(), Counter()
    for r in cut:
        sizes[r.source] += len((r.text or "").split())
    for r in mixed:
        taken[r.source] += len((r.text or "").split())
    for source, target in brute_targets(sizes).items():
        largest = max(len((r.text or "").split()) for r in cut if r.source == source)
        assert abs(taken[source] - target) <= max(40, 0.03 * target, largest / 2 + 1 if largest > 1000 else 0)
    assert max(Counter((r.doc_id, r.text) for r in mixed).values()) <= 3
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.parse_ranks(queries.vocabulary()), special_tokens={})
    assert Counter((r.doc_id, tuple(r.ids)) for r in coded) == Counter((r.doc_id, tuple(reference.encode_ordinary(r.text or ""))) for r in mixed)
    ran = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in ran) == Counter((r.doc_id, tuple(r.ids)) for r in coded)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)] * 2, [(1, "a b", "en", "s", 3)] * 2])
def test_small_tables(spark, folder, rows):
    docs = spark.createDataFrame(rows, COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() <= 3 * len(rows)
