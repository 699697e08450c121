"""Learning a projection matrix M so that cos(aM, bM) separates the labels.

``fit_many`` trains any number of runs (a grid) over the same pairs, in step: the
number of passes over the pairs in an epoch does not depend on the number of runs.

* Runs of one batch an epoch: one streaming Arrow pass scores all rows with every
  run's matrix and adds up every run's gradient of the train rows; a round of small tasks
  sums the partitions' gradients, and the optimiser steps on the small matrices.
* Runs of mini-batches: one barrier stage an epoch.  Its tasks hold the train rows once,
  divide them anew into batches by a hash of row and epoch, gather each batch's
  partial gradients from one another, and all take the same step, so an epoch is
  one job whatever the number of batches is.  A second pass scores all rows.  Spark's gather
  takes about a second, so batches should be large enough to be worth one.
  Gradients too large to be gathered (GATHER_BYTES) take a job for each batch instead.

Dropout masks are a hash of row, epoch and component, the same however rows are
partitioned.  With a ``RunLog`` every epoch's matrix, optimiser state and metrics are
written; a fit that is started again with the same run id goes on after the last whole epoch.

Gradient (for one pair, u = aM, v = bM, s = u.v / (|u||v|)):
  ds/dM = a^T (v/(|u||v|) - s u/|u|^2) + b^T (u/(|u||v|) - s v/|v|^2)
multiplied by dL/ds (BCE with logits: sigmoid(s) - y; MSE: 2 (s - y))."""

from __future__ import annotations

import base64
import json
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import BarrierTaskContext, TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simsift.operators import metrics
from simsift.operators.projection import matrix_to_df
from simsift.operators.split import join_null_safe
from simsift.session import materialize, release


@dataclass
class FitConfig:
    k: int = 16                     # projected width
    epochs: int = 10
    lr: float = 0.01
    dropout: float = 0.0
    loss: str = "bce"               # "bce" (0/1 labels) or "mse" (+-1 labels)
    optimizer: str = "adam"         # "adam" or "sgd"
    weight_decay: float = 1e-5
    step_size: int = 10             # learning rate x gamma every step_size epochs
    gamma: float = 0.1
    init: str = "xavier"            # "xavier" (uniform) or "normal"
    batches: int = 1                # mini-batches per epoch (hash buckets)
    batch_size: int | None = None   # if set, batches = ceil(train rows / batch_size)
    seed: int = 123
    threshold: float = 0.5          # accuracy threshold on the score
    score: str = "sigmoid"          # score for accuracy/AUC: "sigmoid" or "cosine"
    accuracy: str = "fixed"         # "fixed" (threshold) or "sweep" (best threshold)
    select_on: str = "validation"   # dataset whose AUC picks the best epoch


# The two trainer configurations and the first trainer's grid
# of (batch size, learning rate) pairs.
V1_CONFIG = dict(k=2048, batch_size=100, epochs=100, lr=100.0, dropout=0.0, loss="mse",
                 optimizer="sgd", init="normal", score="cosine", accuracy="sweep",
                 step_size=10 ** 9, select_on="test")
V1_GRID = [dict(batch_size=10, lr=10.0), dict(batch_size=100, lr=100.0),
           dict(batch_size=1000, lr=1000.0)]
V1_GRID_COMMON = dict(epochs=30, dropout=0.2)
V3_CONFIG = dict(loss="bce", optimizer="adam", init="xavier", weight_decay=1e-5, step_size=10,
                 gamma=0.1, score="sigmoid", accuracy="fixed", select_on="validation")


@dataclass
class FitResult:
    matrix: np.ndarray
    best_epoch: int | None
    epochs: list[dict] = field(default_factory=list)
    final_matrix: np.ndarray | None = None

    def metrics_df(self, spark) -> DataFrame:
        schema = "epoch int, dataset string, loss double, accuracy double, auc double"
        rows = [(r["epoch"], r["dataset"], r["loss"], r["accuracy"], r["auc"]) for r in self.epochs]
        return spark.createDataFrame(rows, schema)

    def matrix_df(self, spark) -> DataFrame:
        return matrix_to_df(spark, self.matrix)


def _cos_parts(A, B, M):
    U, Vv = A @ M, B @ M
    nu = np.linalg.norm(U, axis=1)
    nv = np.linalg.norm(Vv, axis=1)
    nu_s = np.where(nu == 0, 1.0, nu)
    nv_s = np.where(nv == 0, 1.0, nv)
    s = np.einsum("ij,ij->i", U, Vv) / (nu_s * nv_s)
    return U, Vv, nu_s, nv_s, np.clip(s, -1.0, 1.0)


def _loss_and_dlds(s, y, loss):
    if loss == "bce":
        lv = np.maximum(s, 0) - s * y + np.log1p(np.exp(-np.abs(s)))
        return lv, 1.0 / (1.0 + np.exp(-s)) - y
    lv = (s - y) ** 2
    return lv, 2.0 * (s - y)


def _pair_grad(A, B, y, M, loss):
    """(gradient sum, loss sum) of some pairs."""
    return _grad_of_parts(A, B, y, _cos_parts(A, B, M), loss)


def _grad_of_parts(A, B, y, parts, loss):
    U, Vv, nu, nv, s = parts
    lv, dlds = _loss_and_dlds(s, y, loss)
    inv = 1.0 / (nu * nv)
    gu = dlds[:, None] * (Vv * inv[:, None] - (s / nu ** 2)[:, None] * U)
    gv = dlds[:, None] * (U * inv[:, None] - (s / nv ** 2)[:, None] * Vv)
    return A.T @ gu + B.T @ gv, float(lv.sum())


def _targets(y, loss):
    """Labels +-1 or 0/1 as the loss takes them."""
    return np.where(y == -1, 0.0, y) if loss == "bce" else np.where(y == 0, -1.0, y)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _dropped(X: np.ndarray, h: np.ndarray, cfg: FitConfig, epoch: int, side: int) -> np.ndarray:
    """X with components dropped by a hash of row, side, epoch and component."""
    if cfg.dropout <= 0:
        return X
    keep = 1.0 - cfg.dropout
    salt = _mixed(np.array([cfg.seed * 4_000_037 + epoch * 2 + side], dtype=np.uint64))
    column = _mixed(np.arange(X.shape[1], dtype=np.uint64))
    chance = _mixed((h.astype(np.uint64) ^ salt)[:, None] + column[None, :]) >> np.uint64(11)
    return X * (chance.astype(np.float64) / 2.0 ** 53 < keep) / keep


def batch_of(h: np.ndarray, seed: int, epoch: int, batches: int) -> np.ndarray:
    """The batch of each row (its hash) in an epoch."""
    salt = _mixed(np.array([seed * 4_000_037 + epoch], dtype=np.uint64))
    return (_mixed(h.astype(np.uint64) ^ ~salt) % np.uint64(batches)).astype(np.int64)


@dataclass
class _Run:
    """One fit on its way."""

    number: int
    cfg: FitConfig
    matrix: np.ndarray
    m1: np.ndarray
    m2: np.ndarray
    t: int = 0
    epoch: int = 0
    best: tuple[float, int, np.ndarray] | None = None
    history: list[dict] = field(default_factory=list)

    def step(self, g: np.ndarray, epoch: int) -> None:
        cfg = self.cfg
        lr = cfg.lr * (cfg.gamma ** ((epoch - 1) // cfg.step_size))
        self.matrix, self.m1, self.m2, self.t = _step(self.matrix, g, self.m1, self.m2, self.t, lr, cfg)

    def judge(self, epoch: int, measured: dict[str, dict]) -> None:
        """The first epoch with the strictly best AUC keeps its matrix."""
        auc = measured.get(self.cfg.select_on, {}).get("auc")
        if auc is not None and not math.isnan(auc) and (self.best is None or auc > self.best[0]):
            self.best = (auc, epoch, self.matrix.copy())

    def result(self) -> FitResult:
        matrix = self.best[2] if self.best else self.matrix.copy()
        return FitResult(matrix, self.best[1] if self.best else None, self.history, self.matrix.copy())


def _arrays(pdf, e1, e2):
    return tuple(np.stack(pdf[c].to_numpy()).astype(np.float64) for c in (e1, e2))


_PASS = "run int, dataset string, y double, s double, part int, grad array<double>, loss double, n long"


def _pass_kernel(runs: list[tuple], epoch: int, e1, e2, label, dataset, scores: bool = True):
    """Rows (run, dataset, y, s) of every row and run (no dropout), and for each run that
    wants one a row with the partition's gradient sum over the train rows."""
    def kernel(batches):
        ctx = TaskContext.get()
        sums = {number: [np.zeros(M.shape), 0.0, 0] for number, _, M, wants in runs if wants}
        for pdf in batches:
            if pdf.empty:
                continue
            A, B = _arrays(pdf, e1, e2)
            raw, h = pdf[label].to_numpy(dtype=np.float64), pdf["_h"].to_numpy()
            train = (pdf[dataset] == "train").to_numpy()
            for number, cfg, M, wants in runs:
                y = _targets(raw, cfg.loss)
                parts = _cos_parts(A, B, M) if scores or not cfg.dropout else None
                if scores:
                    yield pd.DataFrame({"run": np.int32(number), "dataset": pdf[dataset].to_numpy(), "y": y, "s": parts[4],
                                        "part": None, "grad": None, "loss": None, "n": None})
                if not wants or not train.any():
                    continue
                At, Bt = _dropped(A[train], h[train], cfg, epoch, 0), _dropped(B[train], h[train], cfg, epoch, 1)
                parts = _cos_parts(At, Bt, M) if cfg.dropout > 0 else [p[train] for p in parts]
                g, loss = _grad_of_parts(At, Bt, y[train], parts, cfg.loss)
                held = sums[number]
                held[0] += g
                held[1] += loss
                held[2] += int(train.sum())
        for number, (g, loss, n) in sums.items():
            yield pd.DataFrame({"run": [np.int32(number)], "dataset": [None], "y": [None], "s": [None],
                                "part": [np.int32(ctx.partitionId() if ctx else 0)], "grad": [g.ravel()],
                                "loss": [loss], "n": [n]})
    return kernel


FAN = 16                 # partial gradients that one task adds up


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("part")
    return pd.DataFrame({"run": [pdf["run"].iloc[0]], "part": [pdf["part"].iloc[0]],
                         "grad": [np.sum(np.stack(pdf["grad"].to_numpy()), axis=0)], "loss": [pdf["loss"].sum()],
                         "n": [pdf["n"].sum()]})


def _gradients(parts: DataFrame, shapes: dict[int, tuple]) -> dict[int, tuple[np.ndarray, float, int]]:
    """Sums of the partitions' gradients by run: FAN at a time in tasks, round after
    round; at most FAN a run reach the driver."""
    rows = parts.where("part is not null").select("run", "part", "grad", "loss", "n")
    top, step = rows.agg(F.max("part")).first()[0], 1
    while top is not None and top // step >= FAN:
        step *= FAN
        rows = rows.groupBy("run", F.floor(F.col("part") / step)).applyInPandas(
            _added, "run int, part int, grad array<double>, loss double, n long")
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (r.run, r.part)):
        g, loss, n = out.get(r.run, (0.0, 0.0, 0))
        out[r.run] = (g + np.asarray(r.grad).reshape(shapes[r.run]), loss + r.loss, n + r.n)
    return out


def _scoring_pass(prepared: DataFrame, runs: list[_Run], epoch: int, names: tuple, gradients: set[int]):
    """One read of the pairs: (scores of all rows by run, {run: (gradient, loss, rows)}),
    for the runs' present matrices.  Written once, so metrics and gradients do not rescore."""
    shipped = [(r.number, r.cfg, r.matrix, r.number in gradients) for r in runs]
    out = materialize(prepared.mapInPandas(_pass_kernel(shipped, epoch, *names), _PASS), "pass")
    grads = _gradients(out, {r.number: r.matrix.shape for r in runs}) if gradients else {}
    return out, grads


GATHER_BYTES = 32 << 20  # of all tasks' gradients of one batch, which pass through the driver


def _epoch_kernel(runs: list[_Run], epoch: int, e1, e2, label):
    """A barrier task: an epoch of mini-batches of every run.  Task 0 returns the states."""
    def kernel(batches):
        ctx = BarrierTaskContext.get()
        frames = [pdf for pdf in batches if not pdf.empty]
        if frames:
            pdf = pd.concat(frames, ignore_index=True)
            pdf = pdf.iloc[np.argsort(pdf["_h"].to_numpy(), kind="stable")]
            (A, B), raw, h = _arrays(pdf, e1, e2), pdf[label].to_numpy(dtype=np.float64), pdf["_h"].to_numpy()
        else:
            d = runs[0].matrix.shape[0]
            A = B = np.zeros((0, d))
            raw, h = np.zeros(0), np.zeros(0, dtype=np.int64)
        at = {r.number: batch_of(h, r.cfg.seed, epoch, r.cfg.batches) for r in runs}
        losses = {r.number: [] for r in runs}
        for b in range(max(r.cfg.batches for r in runs)):
            live = [r for r in runs if b < r.cfg.batches]
            mine = []
            for r in live:
                rows = np.flatnonzero(at[r.number] == b)
                Ab, Bb = _dropped(A[rows], h[rows], r.cfg, epoch, 0), _dropped(B[rows], h[rows], r.cfg, epoch, 1)
                g, loss = _pair_grad(Ab, Bb, _targets(raw[rows], r.cfg.loss), r.matrix, r.cfg.loss)
                mine.append(np.concatenate([g.ravel(), [loss, len(rows)]]))
            sent = base64.b64encode(np.concatenate(mine).tobytes()).decode()
            total = sum(np.frombuffer(base64.b64decode(m)) for m in ctx.allGather(sent))
            for r in live:
                size = r.matrix.size + 2
                g, loss, n = total[:size - 2], total[size - 2], total[size - 1]
                total = total[size:]
                if n:
                    losses[r.number].append(loss / n)
                    r.step((g / n).reshape(r.matrix.shape), epoch)
        if ctx.partitionId() == 0:
            yield pd.DataFrame({"run": [np.int32(r.number) for r in runs], "t": [r.t for r in runs],
                                "losses": [losses[r.number] for r in runs], "matrix": [r.matrix.ravel() for r in runs],
                                "m1": [r.m1.ravel() for r in runs], "m2": [r.m2.ravel() for r in runs]})
    return kernel


def _barrier_epoch(train: DataFrame, runs: list[_Run], epoch: int, names: tuple, tasks: int) -> dict[int, list[float]]:
    """An epoch of mini-batches in one job; the batches' mean losses by run."""
    e1, e2, label, _ = names
    rows = train.select(e1, e2, label, "_h").repartition(tasks, "_h").mapInPandas(
        _epoch_kernel(runs, epoch, e1, e2, label),
        "run int, t int, losses array<double>, matrix array<double>, m1 array<double>, m2 array<double>", barrier=True)
    by, losses = {r.number: r for r in runs}, {}
    for row in rows.collect():                                   # one row a run
        r = by[row.run]
        r.matrix, r.m1, r.m2 = (np.array(x).reshape(r.matrix.shape) for x in (row.matrix, row.m1, row.m2))
        r.t, losses[row.run] = row.t, list(row.losses)
    return losses


def _batch_jobs(train: DataFrame, runs: list[_Run], epoch: int, names: tuple) -> dict[int, list[float]]:
    """The same epoch with a job for each batch and run."""
    losses = {r.number: [] for r in runs}
    for r in runs:
        member = F.pandas_udf(lambda h, r=r: pd.Series(batch_of(h.to_numpy(), r.cfg.seed, epoch, r.cfg.batches)), "long")
        numbered = train.withColumn("_b", member("_h"))
        for b in range(r.cfg.batches):
            parts = numbered.where(F.col("_b") == b).drop("_b").mapInPandas(
                _pass_kernel([(r.number, r.cfg, r.matrix, True)], epoch, *names, scores=False), _PASS)
            found = _gradients(parts, {r.number: r.matrix.shape}).get(r.number)
            if found and found[2]:
                losses[r.number].append(found[1] / found[2])
                r.step(found[0] / found[2], epoch)
    return losses


def _score_kernel(M, e1, e2, label, dataset):
    def run(batches):
        for pdf in batches:
            if not pdf.empty:
                s = _cos_parts(*_arrays(pdf, e1, e2), M)[4]
                yield pd.DataFrame({"dataset": pdf[dataset].to_numpy(), "y": pdf[label].to_numpy(), "s": s})
    return run


def evaluate(prepared: DataFrame, M: np.ndarray, cfg: FitConfig, e1: str, e2: str,
             label: str, dataset: str) -> dict[str, dict]:
    """Loss, accuracy and AUC per dataset for matrix M (no dropout)."""
    scored = materialize(prepared.select(e1, e2, label, dataset).mapInPandas(
        _score_kernel(M, e1, e2, label, dataset), "dataset string, y double, s double"), "scores")
    out = evaluate_scores(scored, cfg)
    release(scored)
    return out


def _score_col(cfg: FitConfig):
    return F.col("s") if cfg.score == "cosine" else 1.0 / (1.0 + F.exp(-F.col("s")))


def evaluate_scores(scored: DataFrame, cfg: FitConfig, bounds: list[float] | None = None) -> dict[str, dict]:
    """Metrics by dataset from ``dataset, y, s`` rows (a written table, so the AUC
    passes do not rescore)."""
    found = _evaluate_runs(scored.withColumn("run", F.lit(0)), cfg, bounds)
    return found.get(0, {})


def _evaluate_runs(scored: DataFrame, cfg: FitConfig, bounds: list[float] | None = None) -> dict[int, dict[str, dict]]:
    """{run: {dataset: metrics}} from ``run, dataset, y, s`` rows of runs that are
    measured alike."""
    groups = ["run", "dataset"]
    scored = scored.withColumn("p", _score_col(cfg)) \
                   .withColumn("y01", F.when(F.col("y") > 0, 1).otherwise(0))
    x, y = F.col("s"), F.col("y")
    lterm = (F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))) if cfg.loss == "bce" \
        else F.pow(x - y, 2)
    correct = ((F.col("p") > cfg.threshold) & (F.col("y01") == 1)) | \
              ((F.col("p") <= cfg.threshold) & (F.col("y01") == 0))
    base = scored.groupBy(*groups).agg(F.avg(lterm).alias("loss"),
                                       F.avg(correct.cast("double")).alias("accuracy"))
    if cfg.accuracy == "sweep":
        pm = scored.withColumn("_pm", F.when(F.col("y") > 0, 1).otherwise(-1))
        sw = metrics.accuracy_sweep(pm, "p", "_pm", groups).select(*groups, "accuracy")
        base = join_null_safe(base.drop("accuracy"), sw, groups, "left")
    auc = metrics.roc_auc(scored, "p", "y01", groups, persist_input=False, bounds=bounds)
    out: dict[int, dict[str, dict]] = {}
    for r in join_null_safe(base, auc, groups, "left").collect():
        out.setdefault(r["run"], {})[r["dataset"]] = {"loss": r["loss"], "accuracy": r["accuracy"], "auc": r["auc"]}
    return out


def _step(M, g, m1, m2, t, lr, cfg):
    """One optimiser step (Adam with L2 weight decay, or plain SGD)."""
    if cfg.optimizer != "adam":
        return M - lr * g, m1, m2, t
    b1, b2, eps = 0.9, 0.999, 1e-8
    g = g + cfg.weight_decay * M
    t += 1
    m1 = b1 * m1 + (1 - b1) * g
    m2 = b2 * m2 + (1 - b2) * g * g
    return M - lr * (m1 / (1 - b1 ** t)) / (np.sqrt(m2 / (1 - b2 ** t)) + eps), m1, m2, t


def _record(ev, batch_losses, epoch, history):
    if "train" in ev and batch_losses:
        # The train row reports the mean training-batch loss of the epoch.
        ev["train"]["loss"] = float(np.mean(batch_losses))
    for ds_name in sorted(ev, key=str):
        history.append({"epoch": epoch, "dataset": ds_name, **ev[ds_name]})


class RunLog:
    """Every epoch of every run under one folder: ``state`` (run_id, epoch, part, row_idx,
    weights: the matrix and the optimiser's moments) and ``epochs`` (run_id, epoch,
    dataset, loss, accuracy, auc, t, config).  An epoch counts once its ``epochs`` rows
    are there; they are written last, so an interrupted epoch is done again."""

    _STATE = "part string, row_idx int, weights array<double>"
    _EPOCHS = "dataset string, loss double, accuracy double, auc double, t int, config string"

    def __init__(self, spark, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, kind: str, run_id: str, epoch: int) -> str:
        return f"{self.root}/{kind}/run_id={run_id}/epoch={epoch}"

    def save(self, run_id: str, run: _Run) -> None:
        rows = [(part, i, [float(x) for x in w]) for part, m in (("matrix", run.matrix), ("m1", run.m1), ("m2", run.m2))
                for i, w in enumerate(m)]
        self.spark.createDataFrame(rows, self._STATE).coalesce(1).write.mode("overwrite") \
            .parquet(self._path("state", run_id, run.epoch))
        rows = [(r["dataset"], r["loss"], r["accuracy"], r["auc"], run.t, _config_text(run.cfg))
                for r in run.history if r["epoch"] == run.epoch]
        self.spark.createDataFrame(rows, self._EPOCHS).coalesce(1).write.mode("overwrite") \
            .parquet(self._path("epochs", run_id, run.epoch))

    def _read(self, kind: str, schema: str) -> DataFrame:
        schema = f"{schema}, run_id string, epoch int"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{kind}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def epochs(self) -> DataFrame:
        return self._read("epochs", self._EPOCHS)

    def matrices(self) -> DataFrame:
        """(run_id, epoch, row_idx, weights) of every whole epoch."""
        whole = self.epochs().select("run_id", "epoch").distinct()
        return self._read("state", self._STATE).where("part = 'matrix'").join(whole, ["run_id", "epoch"], "left_semi") \
            .select("run_id", "epoch", "row_idx", "weights")

    def _state(self, run_id: str, epoch: int, part: str) -> np.ndarray:
        rows = self._read("state", self._STATE).where(
            (F.col("run_id") == run_id) & (F.col("epoch") == epoch) & (F.col("part") == part))
        return np.array([r.weights for r in rows.orderBy("row_idx").collect()], dtype=np.float64)

    def restore(self, run_id: str, run: _Run) -> None:
        """Put a run where its last whole epoch ended; a run without one stays as it is."""
        rows = self.epochs().where(F.col("run_id") == run_id).collect()
        if not rows:
            return
        last = max(r.epoch for r in rows)
        if {r.config for r in rows} != {_config_text(run.cfg)}:
            raise ValueError(f"run {run_id!r} was logged with another configuration")
        for epoch in range(1, last + 1):
            run.history += [{"epoch": epoch, "dataset": r.dataset, "loss": r.loss, "accuracy": r.accuracy, "auc": r.auc}
                            for r in sorted(rows, key=lambda r: str(r.dataset)) if r.epoch == epoch]
        run.epoch, run.t = last, next(r.t for r in rows if r.epoch == last)
        run.matrix, run.m1, run.m2 = (self._state(run_id, last, p) for p in ("matrix", "m1", "m2"))
        for epoch in range(1, last + 1):
            chosen = {r["dataset"]: r for r in run.history if r["epoch"] == epoch}
            before = run.best
            run.judge(epoch, chosen)
            if run.best is not before:
                run.best = (run.best[0], epoch, run.best[2])
        if run.best:
            run.best = (*run.best[:2], self._state(run_id, run.best[1], "matrix"))


def _config_text(cfg: FitConfig) -> str:
    """What a logged run is told by; more epochs may be asked of it later."""
    return json.dumps({k: v for k, v in cfg.__dict__.items() if k != "epochs"}, sort_keys=True)


def _prepared(pairs, e1, e2, label, dataset, id_cols, seed) -> DataFrame:
    bucket_src = [F.col(c) for c in (id_cols or [])] or [F.col(e1), F.col(e2)]
    return materialize(
        pairs.where(F.col(e1).isNotNull() & F.col(e2).isNotNull())
             .select(F.col(e1).cast("array<double>").alias(e1), F.col(e2).cast("array<double>").alias(e2),
                     F.col(label).cast("double").alias(label), F.col(dataset),
                     F.xxhash64(F.lit(seed), *bucket_src).alias("_h")), "train")


def _started(number: int, cfg: FitConfig, d: int, n_train: int, start: np.ndarray | None) -> _Run:
    if cfg.batch_size:
        cfg = FitConfig(**{**cfg.__dict__, "batches": max(1, math.ceil(n_train / cfg.batch_size))})
    rng = np.random.default_rng(cfg.seed)
    if start is not None:
        M = np.array(start, dtype=np.float64)
        if M.shape[0] != d:
            raise ValueError(f"the start matrix has {M.shape[0]} rows, vectors have {d} components")
    elif cfg.init == "xavier":
        bound = math.sqrt(6.0 / (d + cfg.k))
        M = rng.uniform(-bound, bound, size=(d, cfg.k))
    else:
        M = rng.standard_normal((d, cfg.k))
    return _Run(number, cfg, M, np.zeros_like(M), np.zeros_like(M))


def _measured_alike(runs: list[_Run]) -> list[list[_Run]]:
    kinds: dict[tuple, list[_Run]] = {}
    for r in runs:
        kinds.setdefault((r.cfg.loss, r.cfg.score, r.cfg.accuracy, r.cfg.threshold), []).append(r)
    return list(kinds.values())


def fit_many(pairs: DataFrame, cfgs: list[FitConfig], *, e1: str = "text_1_embedding", e2: str = "text_2_embedding",
             label: str = "label", dataset: str = "dataset", id_cols: list[str] | None = None,
             start: np.ndarray | None = None, log: RunLog | None = None, run_ids: list[str] | None = None,
             tasks: int | None = None) -> list[FitResult]:
    """Train one matrix for each configuration on rows with ``dataset == 'train'``, all of
    them in step; report every dataset each epoch; keep the matrix of the epoch with
    the strictly best AUC on ``select_on`` (first wins, NaN never wins).  ``start``
    replaces the random first matrix.  With ``log`` each epoch is written under the run's id, and
    runs that the log holds go on after their last whole epoch."""
    if log is not None and (run_ids is None or len(set(run_ids)) != len(cfgs)):
        raise ValueError("a log needs a run id for every configuration")
    names = (e1, e2, label, dataset)
    seeds = {c.seed for c in cfgs}
    prepared = _prepared(pairs, e1, e2, label, dataset, id_cols, min(seeds))
    for name in {c.select_on for c in cfgs}:
        if prepared.where(F.col(dataset).eqNullSafe(F.lit(name))).isEmpty() and not prepared.isEmpty():
            known = {r[0] for r in prepared.select(dataset).distinct().limit(100).collect()}
            raise ValueError(f"no rows of dataset {name!r} to choose the best epoch on; there are {sorted(map(str, known))}")
    first = prepared.select(F.size(e1).alias("d")).first()
    if first is None:
        raise ValueError("no pairs to train on")
    train = prepared.where(F.col(dataset) == "train")
    n_train = train.count() if any(c.batch_size for c in cfgs) else 0
    runs = [_started(i, c, int(first["d"]), n_train, start) for i, c in enumerate(cfgs)]
    for r in runs if log is not None else ():
        log.restore(run_ids[r.number], r)
    spark = prepared.sparkSession
    tasks = tasks or spark.sparkContext.defaultParallelism
    whole = all(r.cfg.batches <= 1 for r in runs)
    gathered = tasks * sum(8 * (r.matrix.size + 2) for r in runs) <= GATHER_BYTES
    scored, grads, bounds = None, {}, None
    while live := [r for r in runs if r.epoch < r.cfg.epochs]:
        # Runs that a log has brought further wait for the others.
        epoch = min(r.epoch for r in live) + 1
        live = [r for r in live if r.epoch == epoch - 1]
        losses: dict[int, list[float]] = {r.number: [] for r in live}
        if whole:
            if any(r.number not in grads for r in live):
                release(scored)
                scored, grads = _scoring_pass(prepared, live, epoch, names, {r.number for r in live})
            for r in live:
                g, loss, n = grads[r.number]
                if n:
                    losses[r.number].append(loss / n)
                    r.step(g / n, epoch)
        elif gathered:
            losses = _barrier_epoch(train, live, epoch, names, tasks)
        else:
            losses = _batch_jobs(train, live, epoch, names)
        release(scored)
        # The scores after this epoch and the gradient of the next one use the same matrix.
        scored, grads = _scoring_pass(prepared, live, epoch + 1, names, {r.number for r in live} if whole else set())
        for alike in _measured_alike(live):
            mine = scored.where(F.col("part").isNull() & F.col("run").isin([r.number for r in alike]))
            if bounds is None:
                # They only balance the ranges of the AUC; it is exact for any bounds.
                parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
                bounds = metrics.range_bounds(mine.select(_score_col(alike[0].cfg).cast("double").alias("p")), "p", parts)
            found = _evaluate_runs(mine, alike[0].cfg, bounds)
            for r in alike:
                measured = found.get(r.number, {})
                _record(measured, losses[r.number], epoch, r.history)
                r.epoch = epoch
                r.judge(epoch, measured)
                if log is not None:
                    log.save(run_ids[r.number], r)
    for table in (scored, prepared):
        release(table)
    return [r.result() for r in runs]


def fit_projection(pairs: DataFrame, cfg: FitConfig | None = None, *, log: RunLog | None = None,
                   run_id: str | None = None, **names) -> FitResult:
    """``fit_many`` with one configuration."""
    return fit_many(pairs, [cfg or FitConfig()], log=log, run_ids=None if run_id is None else [run_id], **names)[0]


def grid_search(pairs: DataFrame, grid: list[dict], base: FitConfig | None = None,
                select_on: str | None = None, run_ids: list[str] | None = None, **kw) -> tuple[FitResult, list[dict]]:
    """Fit one model per grid entry, all in the same passes; keep the run whose best epoch
    has the highest accuracy on ``select_on`` (default: the configuration's; first run
    wins ties; a dataset without rows raises).  Returns the best result and one
    row per (run, epoch, dataset) with the run's parameters."""
    base = base or FitConfig()
    if select_on is not None:
        base = FitConfig(**{**base.__dict__, "select_on": select_on})
    select_on = base.select_on
    cfgs = [FitConfig(**{**base.__dict__, **params}) for params in grid]
    best, runs = None, []
    for i, (cfg, res) in enumerate(zip(cfgs, fit_many(pairs, cfgs, run_ids=run_ids, **kw) if cfgs else [])):
        for r in res.epochs:
            runs.append({"run_id": i, **r, "modified_embedding_length": cfg.k,
                         "batch_size": cfg.batch_size, "max_epochs": cfg.epochs,
                         "learning_rate": cfg.lr, "dropout_fraction": cfg.dropout})
        acc = next((r["accuracy"] for r in res.epochs
                    if r["epoch"] == res.best_epoch and r["dataset"] == select_on), None)
        if acc is not None and (best is None or acc > best[1]):
            best = (res, acc)
    return (best[0] if best else None), runs


def run_metrics_df(spark, runs: list[dict]) -> DataFrame:
    """The grid-search rows as a DataFrame (for ``write_run_metrics``)."""
    schema = ("run_id int, epoch int, dataset string, loss double, accuracy double, auc double, "
              "modified_embedding_length int, batch_size int, max_epochs int, "
              "learning_rate double, dropout_fraction double")
    cols = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(c) for c in cols) for r in runs], schema)


def process_pairs(df: DataFrame, matrix: np.ndarray, threshold: float = 0.5,
                  label: str = "label", groups: list[str] = ("dataset",)) -> DataFrame:
    """Project both pair vectors by ``matrix`` and report accuracy (with 0/1
    labels; -1 is mapped to 0) of the projected cosine at ``threshold``."""
    from simsift.operators.projection import project_pairs
    p = project_pairs(df, matrix).withColumn(
        "_y", F.when(F.col(label) == -1, 0).otherwise(F.col(label)))
    return metrics.accuracy_fixed(p, "cosine_similarity_custom", "_y", threshold, list(groups))
