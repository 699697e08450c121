"""Signature search: recall against the exact search, exact scores, odd rows."""

import numpy as np
import pytest

from simsift.operators import signatures as S
from simsift.operators.topk import topk_similar
from test_pivots import COLUMNS, clusters, make, rows


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    v = clusters(rng, 1500, 60, 24, 0.25)
    v[:300] = v[0]                                       # a hot bucket
    return make(spark, v).repartition(4).cache()


def test_recall_and_work(spark, table, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_ROWS", 100)
    exact = topk_similar(table, table, 10, exclude_self=True, **COLUMNS)
    got = S.signature_topk(table, table, 10, exclude_self=True, bits=6, **COLUMNS)
    said = S.recall(got.rows, exact).first()
    assert said.pairs == 15_000 and said.recall >= 0.9
    assert got.total == 1500 * 1500 and 0 < got.compared < 0.6 * got.total
    scores = {(q, c): s for q, _, c, s in rows(topk_similar(table, table, 1500, exclude_self=True, **COLUMNS))}
    assert all(abs(scores[q, c] - s) < 1e-12 for q, _, c, s in rows(got.rows))


def test_all_buckets_are_the_exact_search(spark):
    rng = np.random.default_rng(6)
    q = make(spark, [*rng.normal(size=(30, 5)), np.zeros(5), None])
    c = make(spark, [*rng.normal(size=(50, 5)), np.zeros(5), None, *[np.ones(5)] * 8], 100)
    planes = rng.normal(size=(5, 6))
    got = S.signature_topk(q, c, 4, signatures=S.Signatures(planes, 2, 3, 8), **COLUMNS)
    assert rows(got.rows) == rows(topk_similar(q, c, 4, **COLUMNS))
    assert S.signature_topk(q.limit(0), c, 4, **COLUMNS).rows.count() == 0
    assert S.signature_topk(q, c.limit(0), 4, **COLUMNS).rows.count() == 0


def test_probes_are_the_cheapest_flips():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(20, 6))
    s = S.Signatures(rng.normal(size=(6, 8)), 2, 4, 5)
    own, probed = s.buckets(x), s.probed(x)
    for i in range(20):
        for b in range(2):
            flat = (x[i] @ s.planes).reshape(2, 4)[b]
            cost = {m: sum(flat[j] ** 2 for j in range(4) if (m ^ own[i, b]) >> j & 1) for m in range(16)}
            assert own[i, b] == sum(1 << j for j in range(4) if flat[j] >= 0)
            assert set(probed[i, b].tolist()) == set(sorted(cost, key=cost.get)[:5])
    near = x + 0.1 * rng.normal(size=x.shape)
    probes = S.needed_probes(s, x, near, 0.9)
    met = np.mean([any(s.buckets(near)[i, b] in np.argsort(s.costs(x)[i, b])[:probes] for b in range(2)) for i in range(20)])
    assert met >= 0.9


def test_cell_meets_bucket_by_bucket(monkeypatch):
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(60, 6)), rng.normal(size=(300, 6))
    y[40:200] = y[0]
    x, y = (v / np.linalg.norm(v, axis=1)[:, None] for v in (x, y))
    s = S.Signatures(rng.normal(size=(6, 9)), 3, 3, 3)
    qi, ci = np.arange(60), np.arange(300)
    met = (s.probed(x)[:, :, :, None] == s.buckets(y).T[None, :, None, :]).any(axis=(1, 2))
    scores = np.where(met & (qi[:, None] != ci), np.round(np.clip(x @ y.T, -1, 1), 12), -np.inf)
    for rows_at_once in (7, 256):
        monkeypatch.setattr(S, "COST_ROWS", rows_at_once)
        got = {}
        for r, c, v in zip(*S._met(s, x, y, qi, ci, 4, True)):
            got.setdefault(int(r), []).append(int(c))
        want = {r: [int(c) for c in np.argsort(-scores[r], kind="stable")[:4] if scores[r, c] > -2] for r in range(60)}
        assert got == {r: c for r, c in want.items() if c}
