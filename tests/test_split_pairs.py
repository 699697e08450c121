import numpy as np
import pytest
from pyspark.sql import functions as F

from simsift.operators import pairs, split


def test_stratified_split_exact_and_disjoint(spark):
    rows = [(i, i % 3 if i < 90 else 0) for i in range(120)]   # label 0 is the hot one
    df = spark.createDataFrame(rows, "id long, label int")
    out = split.stratified_split(df, "label", ["id"], 0.2, 123).collect()
    assert sorted(r.id for r in out) == list(range(120))
    for lab, n in {0: 60, 1: 30, 2: 30}.items():
        tests = [r for r in out if r.label == lab and r.dataset == "test"]
        assert len(tests) == round(n * 0.2)
    three = split.three_way_split(df, "label", ["id"]).collect()
    assert sorted(r.id for r in three) == list(range(120))
    assert {r.dataset for r in three} == {"train", "validation", "test"}


def test_null_label_is_a_label(spark):
    rows = [(i, None if i % 2 else 1) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, label int")
    for out in (split.stratified_split(df, "label", ["id"]), split.three_way_split(df, "label", ["id"])):
        got = [r for r in out.collect() if r.dataset == "test"]
        assert sum(r.label is None for r in got) == 10 and len(got) == 20
    ranks = split.exact_rank(df, "id", ["label"], buckets=3).where("label is null").collect()
    assert sorted(r["rank"] for r in ranks) == list(range(1, 51))


def test_exact_rank_many_buckets(spark):
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 50, 300)
    df = spark.createDataFrame([(i, int(k)) for i, k in enumerate(keys)], "id long, k long")
    got = {r.id: r["rank"] for r in split.exact_rank(df, "k", [], ["id"], buckets=7).collect()}
    exp = {i: pos + 1 for pos, i in enumerate(sorted(range(300), key=lambda i: (keys[i], i)))}
    assert got == exp


def test_sample_n(spark):
    df = spark.createDataFrame([(i,) for i in range(50)], "id long")
    s = split.sample_n(df, 10, ["id"], 1)
    assert s.count() == 10
    assert {r.id for r in s.collect()} == {r.id for r in split.sample_n(df, 10, ["id"], 1).collect()}
    with pytest.raises(ValueError):
        split.sample_n(df, 51, ["id"], 1)


def test_sample_by_cut_key_equals_top_n(spark, monkeypatch):
    df = spark.createDataFrame([(i,) for i in range(300)], "id long")
    small = {r.id for r in split.sample_n(df, 40, ["id"], 3).collect()}
    monkeypatch.setattr(split, "TOP_N_ROWS", 5)
    assert {r.id for r in split.sample_n(df, 40, ["id"], 3).collect()} == small and len(small) == 40


def test_range_of():
    from simsift.session import local_session
    spark = local_session(4)
    bounds = [1.0, 2.0, 2.5, 7.0]
    rows = spark.createDataFrame([(float(x) / 2,) for x in range(18)], "x double")
    for r in rows.select("x", split.range_of(F.col("x"), bounds).alias("n")).collect():
        assert r.n == sum(b < r.x for b in bounds)


def pos_df(spark, rows):
    return spark.createDataFrame([(a, b, 1) for a, b in rows], "text_1 string, text_2 string, label int")


def test_random_negatives(spark):
    rows = [(f"e{i}", f"h{i % 7}") for i in range(30)] + [("h3", "e1")]
    p = pos_df(spark, rows)
    neg = pairs.random_negatives(p, seed=5).collect()
    assert len(neg) == len(rows)
    keys = {(min(a, b), max(a, b)) for a, b in rows}
    got = {(r.text_1, r.text_2) for r in neg}
    assert len(got) == len(neg)
    assert all(a < b for a, b in got)
    assert not (got & keys)
    # reference orientation rule: only positives stored as t1 < t2 are excluded
    asym = pairs.random_negatives(p, n=5, seed=5, symmetric=False).count()
    assert asym == 5
    with pytest.raises(ValueError):
        pairs.random_negatives(pos_df(spark, [("a", "b")]), n=5)


@pytest.mark.parametrize("t", [7, 8])
def test_random_negatives_of_dense_positives(spark, t):
    """All pairs but a few are positive: the few are found, whatever the parity."""
    texts = [f"t{i}" for i in range(t)]
    every = [(a, b) for i, a in enumerate(texts) for b in texts[i + 1:]]
    left = {("t0", "t3"), ("t1", "t2"), ("t2", "t6")}
    p = pos_df(spark, [x for x in every if x not in left])
    neg = pairs.random_negatives(p, n=3, seed=1).collect()
    assert {(r.text_1, r.text_2) for r in neg} == left
    with pytest.raises(ValueError):
        pairs.random_negatives(p, n=4, seed=1)


def vecdf(spark, vecs):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vecs.items()],
                                 "id long, v array<float>")


def test_hard_negatives_needs_wider_search(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=6)
    vecs = {i: base + 0.01 * rng.normal(size=6) for i in range(12)}    # tight cluster
    vecs.update({100 + i: rng.normal(size=6) for i in range(10)})
    df = vecdf(spark, vecs)
    # query 0's positives: the whole cluster, so its hard negative lies outside it
    posrows = [(0, j) for j in range(1, 12)]
    pos = spark.createDataFrame(posrows, "q long, c long")
    hn = {r.query_id: r for r in pairs.hard_negatives(
        df, df, pos, query_id="id", query_vec="v", cand_id="id", cand_vec="v",
        pos_query="q", pos_cand="c", exclude_self=True).collect()}
    assert len(hn) == len(vecs)
    sims = {j: float(np.dot(vecs[0], vecs[j]) / np.linalg.norm(vecs[0]) / np.linalg.norm(vecs[j]))
            for j in vecs if j >= 100}
    assert hn[0].cand_id == max(sims, key=sims.get)
    # a query whose positives are all candidates has no hard negative
    every = spark.createDataFrame([(0, j) for j in vecs], "q long, c long")
    assert 0 not in {r.query_id for r in pairs.hard_negatives(
        df, df, every, query_id="id", query_vec="v", cand_id="id", cand_vec="v",
        pos_query="q", pos_cand="c", exclude_self=True).collect()}


def test_rejected_negatives_one_per_row(spark):
    rej = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [1.0, 0.0]), (3, "b", [0.0, 1.0])],
                                "row_id long, text string, v array<float>")
    home = spark.createDataFrame([("H1", "x", [1.0, 0.1]), ("H2", "y", [0.1, 1.0])],
                                 "code string, text string, v array<float>")
    out = pairs.rejected_negatives(rej, home, row_id="row_id", text="text", vec="v",
                                   home_id="code", home_text="text", home_vec="v")
    got = sorted((r.query_id, r.text_1, r.text_2, r.label) for r in out.collect())
    assert got == [(1, "a", "x", -1), (2, "a", "x", -1), (3, "b", "y", -1)]


def test_positive_pairs_fan_out(spark):
    art = spark.createDataFrame([("PCC", "2023", "MTH 1", "M 10"), ("PCC", "2023", "BI 2", "B 20")],
                                "inst string, year string, ext string, int string")
    ext = spark.createDataFrame([("PCC", "2023", "MTH 1", "ext math"), ("PSU", "2023", "MTH 1", "no")],
                                "i string, y string, c string, t string")
    intl = spark.createDataFrame([("M 10", "home math"), ("M 10", "home math 2")],
                                 "code string, t string")
    out = pairs.positive_pairs(art, ext, intl, ext_keys=[("inst", "i"), ("year", "y"), ("ext", "c")],
                               int_key=("int", "code"), ext_text="t", int_text="t")
    assert sorted((r.text_1, r.text_2) for r in out.collect()) == [
        ("ext math", "home math"), ("ext math", "home math 2")]


def test_split_then_random_negatives(spark):
    from simsift.plans.training import split_with_random_negatives
    rows = [(f"ext {i}", f"home {i % 9}") for i in range(40)]
    out = split_with_random_negatives(pos_df(spark, rows), 0.2, 7).collect()
    for name, n_pos in (("train", 32), ("test", 8)):
        part = [r for r in out if r.dataset == name]
        pos = {(r.text_1, r.text_2) for r in part if r.label == 1}
        neg = [(r.text_1, r.text_2) for r in part if r.label == -1]
        assert len(pos) == n_pos and len(neg) == n_pos
        texts = {t for p in pos for t in p}
        assert all(a in texts and b in texts for a, b in neg)    # drawn within the split
        assert not any((a, b) in pos or (b, a) in pos for a, b in neg)


def test_hard_negative_pairs_plan(spark):
    import os
    import tempfile

    from simsift.plans.training import hard_negative_pairs
    rows = [("intro calculus limits", "calculus limits derivatives"),
            ("intro calculus limits", "calculus integrals"),
            ("human anatomy body", "anatomy physiology body"),
            ("drawing composition", "design composition drawing")]
    cache = os.path.join(tempfile.mkdtemp(prefix="hn-"), "cache")
    out = {r.text_1: r.text_2 for r in hard_negative_pairs(pos_df(spark, rows), cache).collect()}
    assert set(out) == {r[0] for r in rows}
    for t1, t2 in out.items():
        assert (t1, t2) not in rows and t2 in {r[1] for r in rows}
