import numpy as np

from simsift.operators import learn
from simsift.operators.projection import fold_matrix, matrix_from_df, matrix_to_df, project_pairs
from simsift.operators.projection import pair_cosine


def test_gradient_matches_finite_differences():
    rng = np.random.default_rng(0)
    A, B = rng.normal(size=(5, 4)), rng.normal(size=(5, 4))
    y = np.array([1.0, 0.0, 1.0, 0.0, 1.0])
    M = rng.normal(size=(4, 3))

    def loss(m):
        s = learn._cos_parts(A, B, m)[4]
        return learn._loss_and_dlds(s, y, "bce")[0].sum()

    U, V, nu, nv, s = learn._cos_parts(A, B, M)
    _, dlds = learn._loss_and_dlds(s, y, "bce")
    inv = 1.0 / (nu * nv)
    gu = dlds[:, None] * (V * inv[:, None] - (s / nu ** 2)[:, None] * U)
    gv = dlds[:, None] * (U * inv[:, None] - (s / nv ** 2)[:, None] * V)
    g = A.T @ gu + B.T @ gv
    num = np.zeros_like(M)
    eps = 1e-6
    for i in range(4):
        for j in range(3):
            d = np.zeros_like(M)
            d[i, j] = eps
            num[i, j] = (loss(M + d) - loss(M - d)) / (2 * eps)
    assert np.allclose(g, num, atol=1e-6)


def test_fit_reduces_loss_on_separable_pairs(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(200):
        a = rng.normal(size=6)
        if i % 2:
            b = a + 0.3 * rng.normal(size=6)       # positive: near copy
            lab = 1
        else:
            b = rng.normal(size=6)
            lab = -1
        ds = "train" if i < 140 else ("validation" if i < 170 else "test")
        rows.append((i, [float(x) for x in a], [float(x) for x in b], lab, ds))
    df = spark.createDataFrame(rows, "id long, text_1_embedding array<double>, "
                                     "text_2_embedding array<double>, label int, dataset string")
    res = learn.fit_projection(df, learn.FitConfig(k=4, epochs=4, lr=0.05), id_cols=["id"])
    train = [r for r in res.epochs if r["dataset"] == "train"]
    assert train[-1]["loss"] < train[0]["loss"]
    assert res.best_epoch is not None and res.matrix.shape == (6, 4)
    back = matrix_from_df(matrix_to_df(spark, res.matrix))
    assert np.allclose(back, res.matrix)


def test_select_on_is_found_among_many_datasets(spark):
    rows = [([1.0, i / 400], [0.5, 1.0], 1 if i % 2 else -1, f"other {i}" if i < 400 else "train") for i in range(410)]
    rows += [([1.0, 0.2], [0.5, 1.0], y, "validation") for y in (1, -1)]
    df = spark.createDataFrame(rows, "text_1_embedding array<double>, text_2_embedding array<double>, "
                                     "label int, dataset string")
    assert learn.fit_projection(df, learn.FitConfig(k=1, epochs=1)).matrix.shape == (2, 1)


def test_identity_projection_keeps_cosine(spark):
    df = spark.createDataFrame([([1.0, 2.0, 0.5], [0.3, -1.0, 2.0])],
                               "text_1_embedding array<double>, text_2_embedding array<double>")
    out = project_pairs(pair_cosine(df), np.eye(3), dtype=np.float64).first()
    assert abs(out.cosine_similarity - out.cosine_similarity_custom) < 1e-12
    assert fold_matrix(4, 2).tolist() == [[1, 0], [0, 1], [1, 0], [0, 1]]


def test_v1_style_grid_with_minibatches(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(120):
        a = rng.normal(size=5)
        b = a + 0.2 * rng.normal(size=5) if i % 2 else rng.normal(size=5)
        ds = "train" if i < 80 else ("validation" if i < 100 else "test")
        rows.append((i, [float(x) for x in a], [float(x) for x in b], 1 if i % 2 else -1, ds))
    df = spark.createDataFrame(rows, "id long, text_1_embedding array<double>, "
                                     "text_2_embedding array<double>, label int, dataset string")
    base = learn.FitConfig(**{**learn.V1_CONFIG, "k": 3, "epochs": 2})
    grid = [dict(batch_size=40, lr=0.5), dict(batch_size=80, lr=0.1)]
    best, runs = learn.grid_search(df, grid, base, id_cols=["id"])
    assert best is not None and len(runs) == 2 * 2 * 3
    out = learn.run_metrics_df(spark, runs)
    assert out.count() == 12 and 0.0 <= out.agg({"accuracy": "min"}).first()[0] <= 1.0


def test_embed_column_nulls_and_chunks(spark):
    from simsift.operators import embed
    calls = []

    def fake(texts):
        calls.append(len(texts))
        return [np.full(3, float(len(t)), dtype=np.float32) for t in texts]

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["ab", None, "", "abcd", "x"])],
                               "id long, t string")
    got = {r.id: r.e for r in embed.embed_column(df, "t", "e", fake, batch_size=2).collect()}
    assert got[1] is None and got[2] is None
    assert list(got[0]) == [2.0, 2.0, 2.0] and list(got[3]) == [4.0, 4.0, 4.0]


def pair_rows(spark, n=160, d=5, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a = rng.normal(size=d)
        b = a + 0.4 * rng.normal(size=d) if i % 2 else rng.normal(size=d)
        ds = "train" if i < n * 5 // 8 else ("validation" if i < n * 7 // 8 else "test")
        rows.append((i, a.tolist(), b.tolist(), 1 if i % 2 else -1, ds))
    return spark.createDataFrame(rows, "id long, text_1_embedding array<double>, text_2_embedding array<double>, "
                                       "label int, dataset string")


def sequential(df, cfg, epochs):
    """Mini-batches one after the other on one machine, in the same order."""
    p = learn._prepared(df, "text_1_embedding", "text_2_embedding", "label", "dataset", ["id"], cfg.seed)
    rows = p.where("dataset = 'train'").collect()
    A, B = (np.array([r[c] for r in rows]) for c in ("text_1_embedding", "text_2_embedding"))
    y, h = np.array([r.label for r in rows]), np.array([r._h for r in rows])
    run = learn._started(0, cfg, A.shape[1], len(rows), None)
    for epoch in range(1, epochs + 1):
        at = learn.batch_of(h, cfg.seed, epoch, run.cfg.batches)
        for b in range(run.cfg.batches):
            m = at == b
            if m.any():
                g, _ = learn._pair_grad(learn._dropped(A[m], h[m], cfg, epoch, 0), learn._dropped(B[m], h[m], cfg, epoch, 1),
                                        learn._targets(y[m], cfg.loss), run.matrix, cfg.loss)
                run.step(g / m.sum(), epoch)
    return run.matrix


def test_barrier_epochs_equal_sequential_batches(spark, monkeypatch):
    df = pair_rows(spark)
    cfg = learn.FitConfig(k=3, epochs=2, lr=0.05, batch_size=13, dropout=0.2)
    jobs = []
    tracker = spark.sparkContext.statusTracker()
    for size, tasks in ((13, 3), (60, 2)):
        spark.sparkContext.setJobGroup(f"fit {size}", "")
        sized = learn.FitConfig(**{**cfg.__dict__, "batch_size": size})
        got = learn.fit_projection(df, sized, id_cols=["id"], tasks=tasks)
        jobs.append(len(tracker.getJobIdsForGroup(f"fit {size}")))
        assert np.allclose(got.final_matrix, sequential(df, sized, 2), atol=1e-10)
    spark.sparkContext.setJobGroup("default", "")
    assert abs(jobs[0] - jobs[1]) <= 3                  # 8 and 2 batches an epoch
    monkeypatch.setattr(learn, "GATHER_BYTES", 0)
    one = learn.FitConfig(**{**cfg.__dict__, "epochs": 1})
    assert np.allclose(learn.fit_projection(df, one, id_cols=["id"]).final_matrix, sequential(df, one, 1), atol=1e-10)


def test_batches_are_dealt_anew_every_epoch():
    h = np.arange(1000) * 7919 - 12345
    first, second = (learn.batch_of(h, 1, e, 10) for e in (1, 2))
    assert set(first) == set(range(10)) and 0.05 < (first == second).mean() < 0.2
    assert (first == learn.batch_of(h[::-1], 1, 1, 10)[::-1]).all()


def test_grid_equals_single_fits(spark):
    df = pair_rows(spark)
    base = learn.FitConfig(k=3, epochs=2, dropout=0.1)
    grid = [dict(lr=0.05), dict(lr=0.2, loss="mse", score="cosine"), dict(lr=0.1, k=2, epochs=1, optimizer="sgd")]
    cfgs = [learn.FitConfig(**{**base.__dict__, **g}) for g in grid]
    many = learn.fit_many(df, cfgs, id_cols=["id"])
    for cfg, got in zip(cfgs, many):
        alone = learn.fit_projection(df, cfg, id_cols=["id"])
        assert np.allclose(got.final_matrix, alone.final_matrix, atol=1e-10) and got.best_epoch == alone.best_epoch
        assert np.allclose(got.matrix, alone.matrix, atol=1e-10) and len(got.epochs) == len(alone.epochs)


def test_a_stopped_run_goes_on(spark, tmp_path):
    df = pair_rows(spark)
    for name, cfg in (("whole", learn.FitConfig(k=3, epochs=4, lr=0.05, dropout=0.1)),
                      ("batches", learn.FitConfig(k=3, epochs=4, lr=0.05, batch_size=50))):
        log = learn.RunLog(spark, str(tmp_path / name))
        want = learn.fit_projection(df, cfg, id_cols=["id"])
        two = learn.FitConfig(**{**cfg.__dict__, "epochs": 2})
        learn.fit_projection(df, two, id_cols=["id"], log=log, run_id="a")
        # An epoch that was cut off before its metrics were written does not count.
        log.spark.createDataFrame([("matrix", 0, [9.0])], log._STATE).write.parquet(log._path("state", "a", 3))
        assert sorted(r.epoch for r in log.matrices().select("epoch").distinct().collect()) == [1, 2]
        got = learn.fit_projection(df, cfg, id_cols=["id"], log=log, run_id="a")
        assert np.allclose(got.final_matrix, want.final_matrix, atol=1e-10)
        assert np.allclose(got.matrix, want.matrix, atol=1e-10) and got.best_epoch == want.best_epoch
        assert [(r["epoch"], r["dataset"]) for r in got.epochs] == [(r["epoch"], r["dataset"]) for r in want.epochs]
        assert np.allclose([r["loss"] for r in got.epochs], [r["loss"] for r in want.epochs])
        assert log.matrices().count() == 4 * 5
        with np.testing.assert_raises(ValueError):
            learn.fit_projection(df, learn.FitConfig(**{**cfg.__dict__, "lr": 1.0}), id_cols=["id"], log=log, run_id="a")
