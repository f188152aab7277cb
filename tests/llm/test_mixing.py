import random

import pytest

from parcelflow.llm import mixing


def brute_targets(sizes, weights=(1, 2, 3), most=3.0):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    total, fixed = float(sum(sizes.values())), {}
    while True:
        rest = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        now = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if now[s] > most * sizes[s]]
        if not over:
            return fixed | now
        fixed |= {s: most * sizes[s] for s in over}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = []
    for k in range(6000):
        source = rng.choice(["hot"] * 8 + ["b", "a", "é", "Z", None, "tiny" if k < 100 else "a"])
        n = min(400, int(rng.lognormvariate(3, 1)))
        out.append((k, rng.choice([None, ""]) if k % 97 == 0 else " ".join(["w"] * n), source, "extra"))
    return out


def test_targets_and_totals(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string").repartition(5)
    got = mixing.mix(docs, block_rows=300).collect()
    assert sorted(r.doc_id for r in got) == [r[0] for r in rows]
    source = {r[0]: r[2] for r in rows}
    sizes, taken, target = {}, {}, {}
    for r in got:
        s = source[r.doc_id]
        assert r["size"] == len((rows[r.doc_id][1] or "").split())
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
        assert r.taken == r.copies * r["size"] <= 3 * r["size"]
    for s, want in brute_targets(sizes).items():
        assert target[s] == pytest.approx(want)
        assert abs(taken[s] - want) <= max(3, 0.002 * want), s
    again = mixing.mix(docs.repartition(3), block_rows=300).collect()
    assert sorted(again) == sorted(got)


def test_documents_stay_balanced(spark):
    docs = spark.createDataFrame([(k, "w " * (1 + k % 50), "ab"[k % 2]) for k in range(2000)], "doc_id long, text string, source string")
    got = mixing.mix(docs, block_rows=200).collect()
    for side in (0, 1):
        mine = [r for r in got if r.doc_id % 2 == side]
        rate = mine[0].target / mine[0].source_size
        assert abs(sum(r.copies for r in mine) - rate * len(mine)) < 10


@pytest.mark.parametrize("rows", [[], [(None, None, None)], [(1, "", "s"), (1, "", "s")], [(1, "a b", None), (1, "a b", None), (None, "c", "x")]])
def test_small_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert mixing.mix(docs).count() == len(rows)


def test_equal_rows_fill_no_block(spark, monkeypatch):
    real = mixing._block

    def guarded(seed, level):
        run = real(seed, level)

        def check(key, rows):
            assert len(rows) <= 600, len(rows)
            return run(key, rows)

        return check

    monkeypatch.setattr(mixing, "_block", guarded)
    rows = [(None, None, "s")] * 1500 + [(7, "a b c", "s")] * 1500 + [(k, "w " * (k % 9), "t") for k in range(600)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_rows=300).collect()
    assert len(got) == len(rows) and sum(r["size"] for r in got) == sum(len((r[1] or "").split()) for r in rows)
