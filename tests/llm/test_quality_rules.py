import random
import re
from collections import Counter

import duckdb
import pytest

from parcelflow.llm import quality_rules

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = SPACE.findall(text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def texts():
    rng = random.Random(4)
    out = [None, "", " \t\n", "one", "a b c d e a b c d e", "x " * 40, "line one here\nline one here\n\n \nlast", "é\xa0ü z # $ <b>", "A B C " * 3 + "d e f g h i j k l m"]
    for _ in range(30):
        out.append("".join(rng.choice(["ab", "cd", "Ef", "g!", "#", "\n"]) + rng.choice([" ", "\t", "\n", "  "]) for _ in range(rng.randint(0, 80))))
    return out + [" ".join(f"words{k}" for k in range(20000))]


def test_statistics_match_brute_force(spark):
    rows = [(k, t, "clash") for k, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = {r.doc_id: r for r in quality_rules.cascade(docs, fraction=1.0).collect()}
    assert len(got) == len(rows)
    for k, t, _ in rows:
        r = got[k]
        n, chars, symbols, dup, rep = brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep), repr(t)[:80]
        assert r.base_failed == (n < 10 or 100 * rep > 20 * n)
        assert not (r.base_failed and r.kept)
    assert got[len(rows) - 1].kept


def test_order_never_changes_the_verdict(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts())], "doc_id long, text string")
    rules = quality_rules.default_rules()
    a = quality_rules.cascade(docs, rules, fraction=1.0).collect()
    b = quality_rules.cascade(docs, rules[::-1], fraction=0.0).collect()
    assert sorted(a, key=lambda r: r.doc_id) == sorted(b, key=lambda r: r.doc_id)


def test_sql_twin(spark):
    data = [(k, t) for k, t in enumerate(texts())]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", data)
    want = sorted(con.execute(quality_rules.ORACLE).fetchall())
    assert sorted(map(tuple, quality_rules.cascade(docs, fraction=1.0).collect())) == want


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, "a"), (1, "a")]])
def test_small_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert quality_rules.cascade(docs).count() == len(rows)
