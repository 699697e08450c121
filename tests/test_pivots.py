"""Pivot search against the search over all block pairs."""

import numpy as np
import pytest

from simsift.operators import pivots as P
from simsift.operators.topk import topk_similar

COLUMNS = dict(query_id="id", query_vec="v", cand_id="id", cand_vec="v")


def make(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)],
                                 "id long, v array<double>")


def rows(df):
    return sorted((r.query_id, r["rank"], r.cand_id, r.score) for r in df.collect())


def clusters(rng, n, groups, d=16, spread=0.05):
    at = rng.normal(size=(groups, d))
    return at[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, d))


def test_same_rows_on_clusters_under_half_compared(spark):
    v = clusters(np.random.default_rng(1), 900, 12)
    v[:300] = v[0] * np.linspace(1, 2, 300)[:, None]                 # a third of one direction: all tie
    df = make(spark, v)
    got = P.pivot_topk(df, df, 6, exclude_self=True, block_rows=64, **COLUMNS)
    assert rows(got.rows) == rows(topk_similar(df, df, 6, exclude_self=True, **COLUMNS))
    assert got.total == 900 * 900 and got.skipped > 0.5


def test_two_sides_ties_zero_and_null_vectors(spark):
    rng = np.random.default_rng(2)
    q = [*rng.integers(-2, 3, size=(40, 4)).astype(float), np.zeros(4), None]
    c = [*rng.integers(-2, 3, size=(70, 4)).astype(float), np.zeros(4), None, *[q[0]] * 9]
    qd, cd = make(spark, q), make(spark, c, 1000)
    for first, pivots in ((1, 9), (100, 3), (2, None)):
        got = P.pivot_topk(qd, cd, 7, first=first, pivots=pivots, block_rows=8, **COLUMNS)
        assert rows(got.rows) == rows(topk_similar(qd, cd, 7, **COLUMNS))
        assert 0 < got.compared <= got.total == 41 * 80


def test_fewer_candidates_and_empty_sides(spark):
    rng = np.random.default_rng(3)
    qd, cd = make(spark, rng.normal(size=(5, 3))), make(spark, rng.normal(size=(3, 3)))
    assert rows(P.pivot_topk(qd, cd, 10, **COLUMNS).rows) == rows(topk_similar(qd, cd, 10, **COLUMNS))
    assert P.pivot_topk(qd.limit(0), cd, 3, **COLUMNS).rows.count() == 0
    assert P.pivot_topk(qd, cd.limit(0), 3, **COLUMNS).rows.count() == 0
    with pytest.raises(Exception, match="different lengths"):
        P.pivot_topk(make(spark, [[1.0, 2.0]]), cd, 3, **COLUMNS)
    with pytest.raises(ValueError):
        P.pivot_topk(qd, cd, 0, **COLUMNS)


def test_bounds_hold():
    rng = np.random.default_rng(4)
    x = clusters(rng, 400, 7, 8, 0.3)
    x /= np.linalg.norm(x, axis=1)[:, None]
    pivots = P.fit_pivots(x, 9)
    near = (x @ pivots.T).argmax(1)
    angle = np.arccos(np.clip((x @ pivots.T).max(1), -1, 1))
    radius = {g: angle[near == g].max() for g in set(near.tolist())}
    for g, pairs in P.pair_bounds(pivots, radius, radius).items():
        assert [b for b, _ in pairs] == sorted((b for b, _ in pairs), reverse=True)
        for bound, h in pairs:
            assert (x[near == g] @ x[near == h].T).max() <= bound + 1e-9


def test_chunks_are_few_and_hold_every_group():
    rng = np.random.default_rng(5)
    pivots = rng.normal(size=(50, 4))
    sizes = {g: int(n) for g, n in enumerate(rng.integers(1, 120, 50))} | {7: 1050, -1: 230}
    held = {}
    for g, (first, parts) in P.chunks_of(pivots, sizes, 200).items():
        assert parts == (6 if g == 7 else 2 if g == -1 else 1)
        for c in range(first, first + parts):
            held.setdefault(c, []).append(g)
    assert sorted(held) == list(range(len(held))) and len(held) <= 2 * sum(sizes.values()) / 200 + 2
    assert all(sum(sizes[g] for g in gs) <= 200 for gs in held.values() if 7 not in gs and -1 not in gs)
    assert all(held[c] == [g] for g in (7, -1) for c in held if g in held[c])


def test_rows_are_copied_for_chunks_not_groups(spark, monkeypatch):
    copied = []
    side = P._side
    monkeypatch.setattr(P, "_side", lambda *a: copied.append(len(a[2])) or side(*a))
    df = make(spark, np.random.default_rng(6).normal(size=(600, 12)))
    got = P.pivot_topk(df, df, 5, exclude_self=True, pivots=20, block_rows=300, **COLUMNS)
    assert rows(got.rows) == rows(topk_similar(df, df, 5, exclude_self=True, **COLUMNS))
    assert max(copied) <= 20 * 4                     # (group, chunk of the other side)
