import math

import numpy as np
import pytest

from simsift.operators import metrics as MT


def sweep_brute(cs, ls):
    best = 0.0
    for t in range(-1000, 1000):
        th = t / 1000
        correct = sum(1 for c, l in zip(cs, ls)
                      if ((1 if (not math.isnan(c) and c > th) else -1) == l))
        best = max(best, correct / len(cs))
    return best


def test_accuracy_sweep_matches_loop(spark):
    rng = np.random.default_rng(3)
    cs = list(np.round(rng.uniform(-1, 1, 300), 3)) + [0.001, -0.999, 0.5, 1.0, float("nan")]
    ls = list(rng.choice([-1, 1], len(cs)))
    df = spark.createDataFrame([(float(c), int(l)) for c, l in zip(cs, ls)], "cs double, y int")
    got = MT.accuracy_sweep(df, "cs", "y").first()
    exp = sweep_brute(cs, ls)
    assert abs(got.accuracy - exp) < 1e-12
    assert abs(got.se - math.sqrt(exp * (1 - exp) / len(cs))) < 1e-12


def auc_brute(s, y):
    pos = [a for a, b in zip(s, y) if b == 1]
    neg = [a for a, b in zip(s, y) if b != 1]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_auc_and_monotone_invariance(spark):
    rng = np.random.default_rng(5)
    s = list(np.round(rng.normal(size=400), 2))
    y = [int(v) for v in rng.integers(0, 2, 400)]
    df = spark.createDataFrame([(float(a), b) for a, b in zip(s, y)], "s double, y int")
    got = MT.roc_auc(df, "s", "y").first().auc
    assert abs(got - auc_brute(s, y)) < 1e-12
    df2 = df.selectExpr("exp(3 * s) AS s", "y")
    assert abs(MT.roc_auc(df2, "s", "y").first().auc - got) < 1e-12
    one = spark.createDataFrame([(0.1, 1), (0.2, 1)], "s double, y int")
    assert MT.roc_auc(one, "s", "y").first().auc is None


def test_grouped_auc(spark):
    rows = [("a", 0.1, 0), ("a", 0.9, 1), ("b", 0.9, 0), ("b", 0.1, 1), ("b", 0.5, 1)]
    df = spark.createDataFrame(rows, "g string, s double, y int")
    got = {r.g: r.auc for r in MT.roc_auc(df, "s", "y", ["g"]).collect()}
    assert got == {"a": 1.0, "b": 0.0}


def test_classification_and_fixed(spark):
    rows = [(0.9, 1), (0.5, 1), (0.4, 1), (0.6, 0), (0.1, 0), (float("nan"), 1)]
    df = spark.createDataFrame(rows, "s double, y int")
    r = MT.classification_report(df, "s", "y", 0.5).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (2, 1, 2, 1)
    assert abs(r.precision - 2 / 3) < 1e-12 and abs(r.recall - 0.5) < 1e-12
    assert abs(r.f1 - 2 * (2 / 3) * 0.5 / (2 / 3 + 0.5)) < 1e-12
    z = MT.classification_report(df.where("s < 0.3"), "s", "y", 0.5).first()
    assert z.precision == 0.0 and z.f1 == 0.0
    a = MT.accuracy_fixed(df, "s", "y", 0.5).first()
    assert abs(a.accuracy - 2 / 6) < 1e-12     # (0.9, 1) and (0.1, 0); NaN never correct


def test_losses(spark):
    df = spark.createDataFrame([(0.5, 1), (-0.2, 0)], "x double, y int")
    bce = MT.bce_logits(df, "x", "y").first().bce
    exp = np.mean([-math.log(1 / (1 + math.exp(-0.5))), -math.log(1 - 1 / (1 + math.exp(0.2)))])
    assert abs(bce - exp) < 1e-12
    assert abs(MT.mse(df, "x", "y").first().mse - np.mean([0.25, 0.04])) < 1e-12


@pytest.mark.parametrize("q", [0.25, 0.5, 0.9])
def test_exact_quantile(spark, q):
    rng = np.random.default_rng(11)
    v = list(np.round(rng.normal(size=257), 1))
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    got = MT.exact_quantile(df, "v", q).first()[0]
    assert abs(got - float(np.quantile(v, q))) < 1e-12


def test_histogram_and_kde(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=500)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    h = MT.score_histogram(df, "v", 30).orderBy("bin").collect()
    dens, edges = np.histogram(v, bins=30, density=True)
    counts, _ = np.histogram(v, bins=30)
    assert [r["count"] for r in h] == list(counts)
    assert np.allclose([r.density for r in h], dens)
    k = MT.score_kde(df, "v", 100).orderBy("point").collect()
    bw = np.std(v, ddof=1) * len(v) ** -0.2
    grid = np.linspace(v.min(), v.max(), 100)
    exp = np.exp(-((grid[:, None] - v[None, :]) / bw) ** 2 / 2).sum(1) / (len(v) * bw * math.sqrt(2 * math.pi))
    assert np.allclose([r.density for r in k], exp)


@pytest.mark.parametrize("metric", [MT.score_histogram, MT.score_kde, MT.exact_quantile])
def test_scores_are_computed_once(spark, metric):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch
    v = np.arange(50.0)
    df = spark.createDataFrame([(float(x),) for x in v], "v double").mapInPandas(count, "v double")
    assert metric(df, "v").collect()
    assert seen.value == 50


def test_best_by_rules(spark):
    rows = [(1, 0.7), (2, float("nan")), (3, 0.9), (4, 0.9)]
    df = spark.createDataFrame(rows, "epoch int, auc double")
    assert MT.best_by(df, "auc", ["epoch"]).first().epoch == 3


def test_degenerate_inputs(spark):
    df = spark.createDataFrame([(0.5,), (0.5,), (0.5,)], "v double")
    h = MT.score_histogram(df, "v", 30).orderBy("bin").collect()
    counts, _ = np.histogram([0.5] * 3, bins=30)
    assert [r["count"] for r in h] == list(counts)
    assert all(r.density is None for r in MT.score_kde(df, "v", 5).collect())
    assert MT.exact_quantile(df, "v", 0.25).first()[0] == 0.5
    empty = spark.createDataFrame([], "cs double, y int")
    assert MT.accuracy_sweep(empty, "cs", "y").first().accuracy is None


def test_null_groups_and_string_ties(spark):
    rows = [(g, float(i % 7), i % 2) for g in (None, "a") for i in range(40)]
    df = spark.createDataFrame(rows, "g string, s double, y int")
    auc = {r.g: r.auc for r in MT.roc_auc(df, "s", "y", ["g"]).collect()}
    assert set(auc) == {None, "a"} and auc[None] == auc["a"]
    q = {r.g: r.q25 for r in MT.exact_quantile(df, "s", 0.25, ["g"]).collect()}
    assert set(q) == {None, "a"} and q[None] == q["a"] == np.quantile([i % 7 for i in range(40)], 0.25)
    runs = spark.createDataFrame([("b", 1.0), ("a", 1.0), (None, 1.0), ("0", 0.5), ("x", float("nan"))], "run string, v double")
    assert MT.best_by(runs, "v", ["run"]).first().run == "a"
