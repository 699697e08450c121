"""Hard negatives against all pairs in plain Python."""

import math

import numpy as np
import pytest

from simsift.llm import hardneg as H
from simsift.llm import queries

SCHEMA = "vec_id long, label int, embedding array<float>, uid string, list int"


def brute(rows, every=50, positives=5, negatives=3):
    good = [(i, y, [math.floor(256 * float(np.float32(c))) for c in v]) for i, y, v in rows
            if None not in (i, y, v) and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a, (anchor, label, x) in enumerate(good):
        if anchor % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, v)), i, y) for b, (i, y, v) in enumerate(good) if a != b)
        for s, p, _ in [r for r in scored if r[2] == label][:positives]:
            fits = [(-t, i) for t, i, y in scored if y != label and -50 * s <= -100 * t <= -95 * s][:negatives]
            out += [(anchor, p, rank, i, -s, t) for rank, (t, i) in enumerate(fits, 1)]
    return sorted(out)


def result(spark, rows, parts=3, **kw):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted(map(tuple, H.hard_negatives(df.repartition(parts), **kw).collect()))


def corpus(n=700, d=6, seed=2):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(5, d))
    v = at[rng.integers(0, 5, n)] + 0.4 * rng.normal(size=(n, d))
    v /= np.linalg.norm(v, axis=1)[:, None]
    v[:n // 3] = v[0]                                   # a third are copies of one row
    return [(i - 100, int(y), x.tolist()) for i, (y, x) in enumerate(zip(rng.integers(0, 4, n), v.astype(np.float32)))]


def test_equals_brute_force(spark):
    rows = corpus()
    want = brute(rows, every=10)
    assert len(want) > 300
    assert result(spark, rows, every=10) == want
    assert result(spark, rows, every=10, block=64, members=7, anchor_bytes=3_000) == want    # many blocks, groups


def test_odd_rows(spark):
    rows = corpus(120)
    odd = [(None, 1, rows[3][2]), (50, None, rows[3][2]), (100, 1, None), (150, 1, []), (200, 1, [1.0] * 5 + [None]),
           (250, 1, [1.0] * 5 + [float("nan")]), (300, 2, [float("-inf")] + [0.0] * 5), (350, 1, [0.0] * 6),
           (400, 2, [3.0] * 6), (401, 2, [-3.0] * 6)]
    rows = rows + odd + [rows[100], rows[100], (0, 9, rows[7][2])]     # id 0: repeated rows, and another label
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == [] and result(spark, odd[:6]) == []
    assert result(spark, [(1, 1, [1.0]), (2, 2, [1.0])]) == []           # no anchors
    assert result(spark, [(50, 1, [1.0]), (2, 2, [1.0])]) == []          # no positives
    with pytest.raises(Exception, match="different lengths"):
        result(spark, rows + [(7, 1, [1.0])], parts=1)


def test_large_components(spark):
    """Products beyond a double's integers are exact, beyond a long they raise."""
    rows = [(50 * i, i % 2, [1e6 * math.cos(i / 20), 1e6 * math.sin(i / 20), 3.0]) for i in range(30)]
    assert result(spark, rows) == brute(rows) != []
    with pytest.raises(Exception, match="fit a long"):
        result(spark, [(0, 1, [1e8, 1.0]), (1, 1, [1e8, 1.0]), (2, 2, [1e8, 1.0])])


def test_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, list(r.embedding)) for r in table]
    got = queries.op12(spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_walk_stops():
    """Members near their centre leave the list early."""
    rng = np.random.default_rng(0)
    groups = rng.normal(size=(20, 16))
    x = np.floor(256 * (groups[np.arange(4000) % 20] + 0.05 * rng.normal(size=(4000, 16)))).astype(np.int64)
    mine = np.arange(0, 4000, 200)                      # all of one group
    walk = H.Walk(mine, np.zeros(20, int), x[mine], np.arange(20), np.full(20, 1 << 62), np.full(20, -(1 << 62)), 5, True)
    lists, ids, uids, scores = walk.run(np.arange(4000), np.arange(4000), np.zeros(4000, int), x)
    all_ = x[mine] @ x.T
    for m in range(20):
        want = sorted((-s, i) for i, s in enumerate(all_[m].tolist()) if i != mine[m])[:5]
        assert [(-s, i) for s, i in zip(scores[lists == m].tolist(), ids[lists == m].tolist())] == want
    assert walk.products < 0.2 * 20 * 4000


def test_pack_blocks(spark):
    df = spark.createDataFrame([(i, 0, [float(i)]) for i in range(25)], "id long, label long, vec array<float>")
    sizes = [len(r.ids) for r in H.pack(df.repartition(1), 1, 10).collect()]
    assert sizes == [10, 10, 5]
