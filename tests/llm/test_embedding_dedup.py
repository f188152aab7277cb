import numpy as np
import pytest

from parcelflow.llm import embedding_dedup as E


def brute(rows, least=0.9):
    ids = [r[0] for r in rows]
    ok = [r[0] is not None and r[1] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1]) and any(x != 0 for x in r[1]) for r in rows]
    x = np.array([np.array(r[1], np.float32) if good else np.zeros(len(rows[0][1]), np.float32) for r, good in zip(rows, ok, strict=True)], np.float64)
    norm = np.linalg.norm(x, axis=1)
    cosine = (x @ x.T) / np.maximum(norm[:, None] * norm[None, :], 1e-300)
    link = cosine >= least
    np.fill_diagonal(link, False)
    link[~np.array(ok)] = False
    link[:, ~np.array(ok)] = False
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    order = sorted(range(len(rows)), key=lambda k: (ids[k] is None, ids[k]))
    place = {k: p for p, k in enumerate(order)}
    for a, b in np.argwhere(link):
        a, b = root(place[a]), root(place[b])
        up[max(a, b)] = min(a, b)
    out = {}
    for k, i in enumerate(ids):
        if i is not None:
            c = ids[order[root(place[k])]]
            out[i] = (int(link[k].sum()), c, c == i)
    return out, link, cosine


def make(seed, n=900, d=64, tight=True):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 3, d))
    rows = [*base]
    while len(rows) < n:
        v = base[rng.integers(0, 30 if rng.random() < 0.5 else len(base))]
        t = rng.uniform(0.9, 1.0) if not tight else rng.uniform(0.97, 1.0)
        noise = rng.normal(size=d)
        noise -= noise @ v / (v @ v) * v
        rows.append(t * v / np.linalg.norm(v) + np.sqrt(1 - t * t) * noise / np.linalg.norm(noise))
    rows += [rows[5]] * 7 + [rows[1] * 2.0]
    order = rng.permutation(len(rows))
    return [(k, [float(np.float32(x)) for x in rows[i]], 1) for k, i in enumerate(order.tolist())]


@pytest.mark.parametrize(("tight", "block"), [(True, 1024), (False, 1024), (True, 16)])
def test_against_brute_force(spark, tight, block, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", block)
    rows = make(3, tight=tight)
    want, link, _ = brute(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df).collect()}
    assert set(got) == set(want)
    found = sum(min(got[k][0], want[k][0]) for k in want)
    assert found >= (0.999 if tight else 0.9) * link.sum()
    assert all(got[k][0] <= want[k][0] for k in want)
    if tight:
        assert sum(got[k] == want[k] for k in want) >= 0.99 * len(want)
    for k, (_, c, kept) in got.items():
        assert kept == (c == k) and c <= k


def test_all_lists_probed_is_exact(spark):
    rows = make(4, n=500, tight=False)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df, probes=10**6).collect()}
    assert got == brute(rows)[0]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [0.0, 0.0, 0.0]), (4, None), (5, [1.0, None, 0.0]), (6, [nan, 0.0, 1.0]), (7, [inf, 0.0, 0.0]), (8, [1.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0]), (9, []), (10, [-1.0, 0.0, 0.0]), (11, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df).collect()}
    assert got.pop(None) == (0, None, False)
    assert got == {k: (0, k, True) for k in (3, 4, 5, 6, 7, 9, 10, 11)} | {1: (2, 1, True), 2: (2, 1, False), 8: (2, 1, False)}
    assert E.near_duplicates(df.limit(0)).count() == 0


def test_codes_never_hide_a_member():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 20))
    q = E.fit(x, 5)
    v = E.unit(x, 24)
    residual = v - q.centres[0]
    codes, error = q.residual_codes(residual)
    tables = q.tables(residual[:50])
    near = np.sqrt(sum(tables[:, s, codes[:, s].astype(int)] for s in range(E.SUBSPACES)))
    true = np.linalg.norm(v[:50, None] - v[None], axis=2)
    assert (near - error[None] <= true + 1e-9).all()


def test_no_link_is_lost_over_many_lists(spark, monkeypatch):
    monkeypatch.setattr(E, "LIST_ROWS", 4)
    monkeypatch.setattr(E, "BLOCK", 64)
    turn = np.random.default_rng(6).uniform(0, 2 * np.pi, 1200)  # a radius reaches over a seventh of all lists
    rows = [(k, [float(np.float32(np.cos(t))), float(np.float32(np.sin(t)))], 1) for k, t in enumerate(turn)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df).collect()}
    assert got == brute(rows)[0]


def test_every_length_links(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0, 0.0, 0.0]), (4, [1.0, 0.1, 0.0]), (5, [0.9, 0.0, 0.1]), (6, [1.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (2, 3), 4: (2, 3), 5: (2, 3), 6: (0, 6)}


def test_different_vectors_of_one_id(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [1.0, 0.05, 0.0]), (5, [1.0, 0.0]), (5, [1.0, 0.1]), (4, [1.0, 0.1])]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == [(1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False), (4, 2, 4, True), (5, 2, 4, False), (5, 2, 4, False)]
