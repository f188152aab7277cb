"""Word stems against published examples, and full-text search against brute force."""

import random
import re

import pytest

from parcelflow.functions.stemming import STOP_WORDS, stem
from parcelflow.operators.fulltext import text_search

PAIRS = {
    "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign", "consist": "consist", "consisted": "consist", "consistency": "consist",
    "consistent": "consist", "consistently": "consist", "consolation": "consol", "consolations": "consol", "consolatory": "consolatori", "consoled": "consol", "console": "consol",
    "knack": "knack", "knackeries": "knackeri", "knaves": "knave", "knavish": "knavish", "kneaded": "knead", "knees": "knee", "knell": "knell", "knitting": "knit", "knots": "knot", "knowing": "know",
    "caresses": "caress", "ponies": "poni", "ties": "tie", "cries": "cri", "gas": "gas", "gaps": "gap", "kiwis": "kiwi", "this": "this", "hopping": "hop", "hoping": "hope", "agreed": "agre", "feed": "feed",
    "happy": "happi", "by": "by", "say": "say", "generate": "generat", "generic": "generic", "communication": "communic", "skies": "sky", "dying": "die", "news": "news", "herrings": "herring", "succeeded": "succeed",
    "relational": "relat", "conditional": "condit", "rationally": "ration", "sensibility": "sensibl", "hopefulness": "hope", "apology": "apolog", "activate": "activ", "adjustable": "adjust", "adoption": "adopt",
    "controlling": "control", "roll": "roll", "youth": "youth", "boy's": "boy", "boyish": "boyish", "fluently": "fluentli", "dwelling": "dwell", "dwellings": "dwell", "extension": "extens", "extensions": "extens",
}
WORD = re.compile(r"[^\W_]+")


@pytest.mark.parametrize("word", sorted(PAIRS))
def test_stems(word):
    assert stem(word) == PAIRS[word]


def brute(rows, queries):
    of = lambda text: {stem(w) for w in WORD.findall((text or "").lower()) if w not in STOP_WORDS}
    return sorted((q, r) for q, asked in queries for r, text in rows if of(asked) and of(asked) <= of(text))


def test_search_against_brute_force(spark):
    rnd = random.Random(2)
    names = ["house", "houses", "housing", "extension", "extended", "Extensions", "the", "of", "dún", "DÚN", "12", "garage", "garages", "single-storey", "agreed", "agree"]
    rows = [(i, rnd.choice([" ", ", "]).join(rnd.choice(names) for _ in range(rnd.randrange(9)))) for i in range(200)] + [(200, None), (201, ""), (7, "house extension garage")]
    queries = [(i, " ".join(rnd.choice(names) for _ in range(rnd.randrange(4)))) for i in range(40)] + [(40, None), (41, "the of"), (42, "zebra")]
    got = text_search(spark.createDataFrame(rows, "id int, text string"), spark.createDataFrame(queries, "q int, asked string"), "id", "text", "q", "asked")
    joined = {i: " ".join(t or "" for j, t in rows if j == i) for i, _ in rows}  # rows of one id count together
    want = brute(sorted(joined.items()), queries)
    assert got.columns == ["q", "id"] and sorted(map(tuple, got.collect())) == want


def test_empty(spark):
    none = spark.createDataFrame([], "id int, text string")
    assert text_search(none, spark.createDataFrame([(1, "a house")], "q int, asked string"), "id", "text", "q", "asked").count() == 0
    assert text_search(spark.createDataFrame([(1, "a house")], "id int, text string"), none.toDF("q", "asked"), "id", "text", "q", "asked").count() == 0


def test_query_over_all_documents(spark):
    from parcelflow.plans import registry

    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = sorted(map(tuple, registry.QUERIES["f37_text_search"](spark, sf).collect()))
    assert found == sorted(set(brute(docs, items)))
