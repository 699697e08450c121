import numpy as np
import pytest
from pyspark.sql import functions as F

from simsift.operators.topk import block_topk, topk_similar


def brute(q, c, k, exclude_self=False):
    out = {}
    for qi, qv in q.items():
        scores = []
        for ci, cv in c.items():
            if cv is None or (exclude_self and ci == qi):
                continue
            nq, nc = np.linalg.norm(qv), np.linalg.norm(cv)
            # Same arithmetic as the kernel (normalise, then dot) so exact
            # mathematical ties stay ties.
            s = 0.0 if nq == 0 or nc == 0 else float(np.round(np.clip(np.dot(qv / nq, cv / nc), -1, 1), 12))
            scores.append((-s, ci))
        scores.sort()
        out[qi] = [(ci, -s) for s, ci in scores[:k]]
    return out


def make(spark, vecs):
    rows = [(i, None if v is None else [float(x) for x in v]) for i, v in vecs.items()]
    return spark.createDataFrame(rows, "id long, v array<float>")


@pytest.mark.parametrize("block_rows,bcast", [(2048, 1 << 30), (7, 0), (5, 1 << 30)])
def test_topk_matches_brute_force(spark, block_rows, bcast):
    rng = np.random.default_rng(7)
    vecs = {i: rng.integers(-2, 3, size=4).astype(np.float32) for i in range(40)}
    vecs[3] = np.zeros(4, dtype=np.float32)     # zero vector scores 0
    vecs[5] = vecs[6].copy()                      # exact ties
    vecs[9] = None                                # skipped
    df = make(spark, vecs)
    res = topk_similar(df, df, 6, query_id="id", query_vec="v", cand_id="id", cand_vec="v",
                       exclude_self=True, block_rows=block_rows, broadcast_bytes=bcast)
    got = {}
    for r in res.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.cand_id, r.score))
    f32 = {i: (None if v is None else np.asarray(v, np.float64)) for i, v in vecs.items()}
    exp = brute({i: v for i, v in f32.items() if v is not None}, f32, 6, True)
    assert got.keys() == exp.keys()
    for q in exp:
        assert [c for c, _ in got[q]] == [c for c, _ in exp[q]], q
        assert np.allclose([s for _, s in got[q]], [s for _, s in exp[q]])


def test_fewer_candidates_than_k_and_nesting(spark):
    rng = np.random.default_rng(1)
    q = make(spark, {i: rng.normal(size=3) for i in range(4)})
    c = make(spark, {100 + i: rng.normal(size=3) for i in range(3)})
    r = topk_similar(q, c, 10, query_id="id", query_vec="v", cand_id="id", cand_vec="v")
    assert r.count() == 12
    big = make(spark, {i: rng.normal(size=3) for i in range(30)})
    k3 = {(x.query_id, x.cand_id) for x in topk_similar(
        big, big, 3, query_id="id", query_vec="v", cand_id="id", cand_vec="v").collect()}
    k4 = {(x.query_id, x.cand_id) for x in topk_similar(
        big, big, 4, query_id="id", query_vec="v", cand_id="id", cand_vec="v",
        block_rows=4).collect()}
    assert k3 <= k4


def test_k_must_be_positive(spark):
    df = make(spark, {1: [1.0, 0.0]})
    with pytest.raises(ValueError):
        topk_similar(df, df, 0, query_id="id", query_vec="v", cand_id="id", cand_vec="v")


def test_mismatched_lengths_raise(spark):
    q = make(spark, {1: [1.0, 0.0]})
    c = make(spark, {2: [1.0, 0.0, 1.0]})
    with pytest.raises(Exception):
        topk_similar(q, c, 1, query_id="id", query_vec="v", cand_id="id", cand_vec="v").collect()


def test_block_topk_tie_rule():
    s = np.array([[0.5, 0.9, 0.5, 0.5, 0.1]])
    idx, vals = block_topk(s, 3)
    assert idx.tolist() == [[1, 0, 2]]
    assert vals.tolist() == [[0.9, 0.5, 0.5]]


def test_arrow_limit_is_put_back(spark):
    from simsift.operators import topk as TK
    conf, before = TK._RECORDS_CONF, spark.conf.get(TK._RECORDS_CONF, "10000")
    with TK._arrow_records(spark, 50 * 1024 * 1024):
        assert int(spark.conf.get(conf)) == 5
    assert spark.conf.get(conf) == before
    spark.conf.set(conf, "2")
    with TK._arrow_records(spark, 50 * 1024 * 1024):          # a stricter user value is kept
        assert spark.conf.get(conf) == "2"
    spark.conf.set(conf, before)


def test_limited_batches_give_the_same_rows(spark, monkeypatch):
    from simsift.operators import topk as TK
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(f"id {i:03}", rng.normal(size=5).tolist()) for i in range(90)], "id string, v array<double>")
    kw = dict(query_id="id", query_vec="v", cand_id="id", cand_vec="v", exclude_self=True)
    want = sorted(map(tuple, TK.topk_similar(df, df, 4, **kw).collect()))
    monkeypatch.setattr(TK, "ARROW_BATCH_BYTES", 1000)
    assert sorted(map(tuple, TK.topk_similar(df, df, 4, block_rows=11, **kw).collect())) == want


def test_excluded_pairs(spark):
    from simsift.operators import topk as TK
    rng = np.random.default_rng(8)
    m = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, v array<double>")
    cut = {(int(a), int(b)) for a, b in rng.integers(0, 60, size=(900, 2))}
    x = spark.createDataFrame(sorted(cut), "query_id long, cand_id long")
    n = m / np.linalg.norm(m, axis=1)[:, None]
    sims = np.round(n @ n.T, 12)
    got = {r.query_id: r.cand_id for r in TK.topk_similar(
        df, df, 1, query_id="id", query_vec="v", cand_id="id", cand_vec="v", exclude_self=True, exclude=x,
        block_rows=13).collect()}
    for q in range(60):
        free = [c for c in range(60) if c != q and (q, c) not in cut]
        assert got[q] == max(free, key=lambda c: (sims[q, c], -c))


def test_a_large_cell_needs_little_memory():
    import tracemalloc

    import pandas as pd

    from simsift.operators import topk as TK
    n = 6000
    v = np.random.default_rng(4).normal(size=(n, 4)).ravel()
    side = {"ids": [np.arange(n)], "vecs": [v], "dmin": [4], "dmax": [4]}
    pair = pd.DataFrame({f"{t}_{c}": x for t in "qc" for c, x in side.items()})
    tracemalloc.start()
    found = pd.concat(TK._kernel(2, True)([pair]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 2 * n and (found["query_id"] != found["cand_id"]).all()
    assert peak < 100 << 20                          # all pairs at once are 288 MB


@pytest.mark.parametrize("tile", [(7, 9), (512, 4096)])
def test_best_pairs_are_those_of_all_scores(monkeypatch, tile):
    from simsift.operators import topk as TK
    monkeypatch.setattr(TK, "TILE", tile)
    rng = np.random.default_rng(9)
    for step in range(12):
        q, c = rng.integers(-2, 3, size=(40, 5)).astype(float), rng.integers(-2, 3, size=(900, 5)).astype(float)
        if step % 2:
            q, c = rng.normal(size=(40, 5)), rng.normal(size=(900, 5))
            c[100:800], q[:20] = c[0], c[0]                      # copies
        c[5::50] = 0
        q, c = (TK._normalised(x.ravel(), len(x)) for x in (q, c))
        cut = rng.integers(0, 40, 3000), rng.integers(0, 900, 3000)
        s = np.round(np.clip(q @ c.T, -1, 1), 12)
        s[cut] = -np.inf
        floor = np.where(rng.random(40) < 0.5, -1.0, 0.6)
        idx, vals = TK.block_topk(s, 6)
        want = [(r, int(i)) for r in range(40) for i, x in zip(idx[r], vals[r]) if x >= floor[r] - 1e-11]
        rows, cols, _, place = TK.best_pairs(q, c, 6, floor - 1e-11, cut)
        assert list(zip(rows.tolist(), cols.tolist())) == want
        assert place.max() == 5


def test_few_pairs_are_scored_again(monkeypatch):
    from simsift.operators import topk as TK
    scored = []

    def counted(Q, C, rows, cols, plain=TK.exact_scores):
        scored.append(len(rows))
        return plain(Q, C, rows, cols)
    monkeypatch.setattr(TK, "exact_scores", counted)
    rng = np.random.default_rng(2)
    q, c = (TK._normalised(rng.normal(size=n * 16), n) for n in (300, 1024))
    rows, cols, _, place = TK.best_pairs(q, c, 20)
    assert [*zip(rows, place)] == [(r, p) for r in range(300) for p in range(20)]
    assert (cols.reshape(300, 20) == TK.block_topk(np.round(np.clip(q @ c.T, -1, 1), 12), 20)[0]).all()
    assert sum(scored) < 22 * 300                    # a threshold from half of the tile let 40 through
