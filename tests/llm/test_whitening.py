"""Whitening against numpy's eigenvectors of the whole covariance."""

import math

import numpy as np
import pytest

from simsift.llm import whitening as W

SCHEMA = "vec_id long, n string, embedding array<float>, component int"


def wanted(vectors):
    x = np.floor(np.asarray(vectors, dtype=np.float64) * 1024).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(0)
    away = (n * x.astype(object) - sums)
    centred = (away / n).astype(float)
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    return x, (away ** 2).sum(1), centred, values[::-1], basis[:, ::-1]


def result(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    return W.whiten(df.repartition(kw.pop("parts", 3)), **kw).collect()


def compare(got, ids, vectors, k=8):
    x, deviation, centred, values, basis = wanted(vectors)
    k = min(k, x.shape[1])
    assert len(got) == k * len(ids)
    by = {(r.vec_id, r.component): r for r in got}
    for c in range(k):
        plain = centred @ basis[:, c] / math.sqrt(values[c])
        mine = np.array([by[i, c + 1].whitened for i in ids])
        sign = np.sign(mine[np.abs(plain).argmax()] * plain[np.abs(plain).argmax()])
        assert np.abs(mine - sign * plain).max() < 1e-7
    for i, d in zip(ids, deviation.tolist()):
        assert by[i, 1].deviation == d and by[i, 1].n == len(ids)
    assert all(abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-9 for r in got)
    assert all(r.identity_error < 1e-9 for r in got)


@pytest.mark.parametrize("block", [1, 40])
def test_equals_numpy(spark, block):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(150, 12)) @ np.diag(np.linspace(0.05, 1, 12)) + 2).astype(np.float32)
    vectors[20:60] = vectors[20]                                  # a third are copies
    vectors[:, 7] = vectors[:, 6]                                 # a dimension twice
    rows = [(i, "x", v.tolist(), 9) for i, v in enumerate(vectors)]
    compare(result(spark, rows, block=block, parts=11, fan=2), range(150), vectors)


def test_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = table.orderBy("vec_id").collect()
    compare(W.whiten(table.repartition(5)).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_odd_rows(spark):
    good = [[0.5, 1.0, -2.0], [1.5, 0.25, 3.0], [-1.0, 2.0, 0.0], [0.1, 0.1, 0.1]]
    rows = [(i, "x", v, 0) for i, v in enumerate(good)]
    rows += [(10, None, None, None), (11, "x", [], 0), (12, "x", [1.0, None, 2.0], 0),
             (13, "x", [1.0, float("nan"), 2.0], 0), (14, "x", [1.0, 2.0, float("inf")], 0)]
    compare(result(spark, rows), range(4), good)
    got = result(spark, rows + [(None, None, good[0], 0), (0, "x", good[0], 0)])
    assert sorted(str(r.vec_id) for r in got if r.component == 1) == ["0", "0", "1", "2", "3", "None"]
    assert {r.n for r in got} == {6}
    assert result(spark, []) == [] and result(spark, rows[4:]) == []
    with pytest.raises(Exception, match="different lengths"):
        result(spark, rows + [(20, "x", [1.0, 2.0], 0)], parts=1)


def test_no_variance(spark):
    one = result(spark, [(1, "x", [1.0, 2.0], 0)])
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] \
        == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    line = result(spark, [(i, "x", [float(i), 2.0 * i, 1.0], 0) for i in range(5)])
    assert all((r.whitened is None) == (r.component > 1) for r in line)
    assert all(abs(r.explained - (r.component == 1)) < 1e-12 and r.identity_error < 1e-9 for r in line)


def test_deviation_beyond_a_long(spark):
    rows = [(0, "x", [2.0 ** 30, 0.0], 0), (1, "x", [-(2.0 ** 30), 0.0], 0), (2, "x", [0.0, 1.0], 0)]
    got = {(r.vec_id, r.component): r.deviation for r in result(spark, rows)}
    assert got[0, 1] is None and got[2, 1] == 4 * 1024 * 1024 and got[2, 2] == got[2, 1]


def test_updates_stay_orthogonal():
    """Thousands of updates, with equal eigenvalues and tiny and repeated rows."""
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(3000, 10)) * np.logspace(-9, 3, 10)
    rows[500:1500] = rows[500]
    s = W.Spectrum(10)
    for r in rows:
        s.add(r[None])
    centred = rows - rows.mean(0)
    whole = centred.T @ centred
    assert np.abs(s.basis.T @ s.basis - np.eye(10)).max() < 1e-11
    assert np.abs(s.basis * s.values @ s.basis.T - whole).max() < 1e-12 * np.abs(whole).max()
