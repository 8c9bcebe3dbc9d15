import numpy as np
import pytest
from blotter.llm import whitening

SF = "/root/testdata/sf0.001"


def brute(rows, k=16):
    """{vec id: (n, deviation, whitened)} and explained shares, by plain numpy on Python integers."""
    xs = {i: tuple(int(np.floor(64 * float(c))) + 1000000 for c in v) for i, v in rows}
    fit = sorted(set(xs.values()))
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array(fit, dtype=float) - np.array(s, dtype=float) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    out = {i: (n, sum((n * c - t) ** 2 for c, t in zip(x, s)), (np.array(x) - np.array(s) / n) @ u / np.sqrt(e)) for i, x in xs.items()}
    return out, e / np.trace(y.T @ y / n)


def test_cross_products_are_exact():
    rng = np.random.default_rng(1)
    for low, high in ((-40, 40), (999_960, 1_000_040), (-(2 ** 62), 2 ** 62), (7, 8)):
        x = rng.integers(low, high, size=(300, 5))
        want = x.astype(object).T @ x.astype(object)
        assert (whitening.cross_products(x) == want).all()


def test_keys_are_canonical():
    v = np.array([[0, -128], [127, 128], [-(2 ** 40), 1], [0, -128]])
    keys = whitening.to_bytes(v)
    assert keys[0] == keys[3] and len(set(keys)) == 3 and [k[0] for k in keys] == [1, 2, 8, 1]


def test_query_equals_numpy(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    want, shares = brute(rows)
    got = {}
    for r in whitening.components_of(table).collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    assert got.keys() == want.keys()
    some = sorted(want)
    z = np.array([[got[i][c].whitened for c in range(1, 17)] for i in some])
    w = np.array([want[i][2] for i in some])
    signs = np.sign((z * w).sum(axis=0))
    assert np.allclose(z * signs, w, atol=1e-8)
    for i in some:
        for c, r in got[i].items():
            assert (r.n, r.deviation) == want[i][:2]
            assert abs(r.explained / shares[c - 1] - 1) < 1e-9 and r.identity_error < 1e-9


def test_dropped_repeated_and_odd_rows(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 0.0]),
            (7, [0.0, 0.5]), (None, [3.0, -1.0]), (9, [5.0, 5.0, 5.0]), (10, []), (11, [2.0, 2.5])]
    table = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<float>, n string, whitened int")
    got = {r.vec_id: r for r in whitening.whiten(table).collect()}
    assert got.keys() == {1, 2, 7, None, 9, 10, 11}
    assert got[1].n == 4 and got[1].whitened == got[2].whitened and len(got[1].whitened) == 2
    want, _ = brute([(i, v) for i, v in rows if i in (1, 2, 7, None, 11) and v and len(v) == 2], 2)
    for i in (1, 2, 7, None, 11):
        assert int(got[i].deviation) == want[i][1]
        assert np.allclose(np.abs(got[i].whitened), np.abs(want[i][2]))
    assert got[9].whitened == [] and got[9].n == 1 and got[9].deviation == 0 and got[10].whitened == []
    assert whitening.components_of(table.where("vec_id < 0")).count() == 0


def test_large_entries_stay_exact(spark):
    rows = [(1, [1e15, 0.0]), (2, [-1e15, 1.0]), (3, [3e14, -2.0]), (4, [1e300, 5.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in whitening.whiten(table.where("vec_id < 4")).collect()}
    want, _ = brute([r for r in rows if r[0] < 4], 2)
    for i in got:
        assert int(got[i].deviation) == want[i][1]
    assert {r.vec_id: r.deviation for r in whitening.whiten(table).collect()}.keys() == {1, 2, 3, 4}
    assert all(r.deviation is None for r in whitening.components_of(table).where("vec_id = 4").collect())


@pytest.mark.parametrize("parts", [1, 7])
def test_partitions_do_not_matter(spark, parts):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").repartition(parts)
    want = {(r.vec_id, r.component): r for r in whitening.components_of(spark.read.parquet(f"{SF}/embeddings.parquet")).collect()}
    for r in whitening.components_of(table).collect():
        w = want[r.vec_id, r.component]
        assert (r.n, r.deviation, r.explained) == (w.n, w.deviation, w.explained) and r.whitened == w.whitened
