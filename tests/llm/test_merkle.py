"""The manifest against a tree built row by row."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from parcelflow.llm import merkle as M
from parcelflow.llm import queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def tree(nodes):
    """Root and, for each leaf, its siblings before and after at every level."""
    paths = [[] for _ in nodes]
    owners = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, over = [], []
        for at in range(0, len(nodes), 8):
            run = nodes[at : at + 8]
            for k in range(len(run)):
                for leaf in owners[at + k]:
                    paths[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(h("".join(run)))
            over.append([x for o in owners[at : at + 8] for x in o])
        nodes, owners = up, over
    return nodes[0], paths


def expected(rows):
    leaf = lambda r: h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[1], r[2], r[3], r[4])))
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    ordered = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in langs}
    trees = {g: tree([leaf(r) for r in ordered[g]]) for g in langs}
    root, tops = tree([trees[g][0] for g in langs])
    out = []
    for g, top in zip(langs, tops, strict=True):
        for r, path in zip(ordered[g], trees[g][1], strict=True):
            text = r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            now = leaf((*r[:4], text))
            for before, after in path + top:
                now = h(before + now + after)
            out.append((r[0], leaf(r), trees[g][0], root, h("".join(b + a for b, a in path + top)), now, now == root))
    return sorted(out, key=repr)


def made(n, langs, seed=3):
    rnd = random.Random(seed)
    return [(rnd.randrange(3 * n), rnd.choice(["a", None, "ü"]), rnd.choice(langs), rnd.choice([None, 5]), rnd.choice([None, "", "Ab Ç", "plain", f"Text {i}"])) for i in range(n)]


def query(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit(1)).withColumn("tree", F.lit("x")).withColumn("path", F.lit(2))
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return queries.op12_merkle_manifest(spark, str(tmp_path))


@pytest.mark.parametrize("n,langs", [(1, ["en"]), (8, ["en"]), (9, [None, "en"]), (70, [None, "", "en", "É"]), (300, [f"l{i}" for i in range(90)])])
def test_query_against_a_tree_built_by_hand(spark, tmp_path, n, langs):
    rows = made(n, langs)
    got = query(spark, tmp_path, rows)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)


def test_several_rounds_of_blocks(spark, tmp_path):
    rows = made(1500, ["en", "en", "en", None])
    assert sorted(map(tuple, query(spark, tmp_path, rows).collect()), key=repr) == expected(rows)


def test_many_rounds_of_small_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "LEVELS", 1)
    monkeypatch.setattr(M, "BLOCK", 8)
    rows = made(700, ["en", "de", "en"])
    assert sorted(map(tuple, query(spark, tmp_path, rows).collect()), key=repr) == expected(rows)


def test_equal_rows_null_ids_and_long_texts(spark, tmp_path):
    rows = [(None, "s", "en", 1, "Same")] * 20 + [(4, "s", "en", 1, "Same")] * 20 + [(5, None, None, None, "Long É " * 200_000)]
    assert sorted(map(tuple, query(spark, tmp_path, rows).collect()), key=repr) == expected(rows)


def test_empty_table(spark, tmp_path):
    assert query(spark, tmp_path, []).count() == 0


def test_tampering_is_seen(spark, tmp_path):
    rows = [(i, "s", "en", 1, "Upper" if i % 2 else "lower") for i in range(60)]
    for r in query(spark, tmp_path, rows).collect():
        assert r["verified"] == (not (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["doc_id"] % 2 == 1))
