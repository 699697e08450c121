"""Quality metrics as aggregations.

Cumulative quantities (threshold sweeps, AUC, exact quantiles) are computed
from histograms.  Where the histogram is bounded (2000 thresholds, 30 bins,
100 grid points) a window over it is fine; where it is not (distinct scores)
prefix sums run per value-range bucket with broadcast bucket offsets
(:func:`prefix_sums`), so no single task ever sees the whole column."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from simsift.operators.split import join_null_safe, range_of
from simsift.session import materialize

SWEEP_LOW = -1000     # thresholds -1.000 .. 0.999 in steps of 0.001
SWEEP_HIGH = 999
SWEEP_SCALE = 1000.0



def _small(df, groups):
    """Broadcast the per-(group, range) offsets only when there are no groups
    (then the table has at most ``buckets`` rows); with groups its size grows
    with the number of groups, so the join is left to the planner (AQE still
    broadcasts it when it is small)."""
    return F.broadcast(df) if not list(groups) else df

def _finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(F.col(c))


def range_bounds(df: DataFrame, col: str, buckets: int) -> list[float]:
    """Approximate quantile cut points of ``col`` (a few floats on the driver)."""
    if buckets <= 1:
        return []
    qs = df.approxQuantile(col, [i / buckets for i in range(1, buckets)], 0.001)
    return sorted(set(v for v in qs if v is not None and not math.isnan(v)))


def prefix_sums(df: DataFrame, order: str, values: list[str], groups: list[str] = (),
                buckets: int | None = None, prefix: str = "before_",
                persist_input: bool = True, bounds: list[float] | None = None) -> DataFrame:
    """Exclusive running sums of ``values`` in ``order`` within ``groups``.

    ``order`` must be unique within a group (callers aggregate first).  The
    ordering column is cut into value ranges at approximate quantiles (a few
    floats on the driver); per-range totals get offsets from a window over at
    most groups x buckets rows, and the in-range running sum is a window
    partitioned by (groups, range)."""
    groups = list(groups)
    spark = df.sparkSession
    # The input is an aggregate (one row per distinct value); materialise it
    # once so the quantile pass and the final pass do not recompute upstream
    # (callers whose input is already a written table can skip this).
    if persist_input:
        df = materialize(df, "hist")
    nb = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if bounds is None:
        # Bounds only balance the ranges; any sorted cut points give exact sums.
        bounds = range_bounds(df, order, nb)
    if bounds:
        bucket = range_of(F.col(order).cast("double"), bounds)
    else:
        bucket = F.lit(0)
    tagged = df.withColumn("_rb", bucket)
    totals = tagged.groupBy(*groups, "_rb").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    wo = Window.partitionBy(*groups).orderBy("_rb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*groups, "_rb", *[
        F.coalesce(F.sum(f"_t_{v}").over(wo), F.lit(0)).alias(f"_o_{v}") for v in values])
    wi = Window.partitionBy(*groups, "_rb").orderBy(order) \
               .rowsBetween(Window.unboundedPreceding, -1)
    out = join_null_safe(tagged, _small(offsets, groups), [*groups, "_rb"])
    for v in values:
        out = out.withColumn(f"{prefix}{v}",
                             F.col(f"_o_{v}") + F.coalesce(F.sum(v).over(wi), F.lit(0)))
    return out.drop("_rb", *[f"_o_{v}" for v in values])


def accuracy_sweep(df: DataFrame, score: str = "cosine_similarity", label: str = "label",
                   groups: list[str] = ()) -> DataFrame:
    """Best accuracy over thresholds t = -1.000 .. 0.999 (step 0.001) with the
    rule ``predict 1 if score > t else -1`` against +-1 labels, plus the
    binomial standard error and a 95 % half-width.  NaN/null scores always
    predict -1.

    Each row is mapped to m = the first threshold index with t >= score, so it
    predicts 1 exactly for thresholds below m; one histogram over m (at most
    2001 rows per group) and a running sum replace the threshold x row loop."""
    groups = list(groups)
    s = F.col(score).cast("double")
    j = F.ceil(s * SWEEP_SCALE).cast("long")
    # Exact correction at bucket edges using the same double threshold i/1000.
    j = F.when((j - 1) / SWEEP_SCALE >= s, j - 1).otherwise(j)
    j = F.when(j / SWEEP_SCALE < s, j + 1).otherwise(j)
    m = F.when(_finite(score), F.least(F.greatest(j, F.lit(SWEEP_LOW)), F.lit(SWEEP_HIGH + 1))) \
         .otherwise(F.lit(SWEEP_LOW))
    rows = df.select(*groups, m.alias("m"), F.col(label).alias("_y"))
    hist = rows.groupBy(*groups, "m").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("_y") == 1).alias("pos"), F.count_if(F.col("_y") == -1).alias("neg"))
    # The accuracy only changes at thresholds of the histogram, so its rows (and
    # the lowest threshold) are all that need comparing; totals are its sums.
    w = Window.partitionBy(*groups).orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*groups)
    swept = (hist.withColumn("n", F.sum("rows").over(whole))
                 .withColumn("p_total", F.sum("pos").over(whole))
                 .withColumn("cum_pos", F.sum("pos").over(w))
                 .withColumn("cum_neg", F.sum("neg").over(w))
                 .withColumn("acc", F.try_divide(F.col("p_total") - F.col("cum_pos") + F.col("cum_neg"), F.col("n")))
                 .withColumn("low", F.when(F.min("m").over(whole) > SWEEP_LOW,
                                           F.try_divide(F.col("p_total"), F.col("n"))))
                 .withColumn("acc", F.when(F.col("m") <= SWEEP_HIGH, F.col("acc"))))
    best = swept.groupBy(*groups).agg(F.greatest(F.max("acc"), F.max("low")).alias("accuracy"),
                                      F.coalesce(F.first("n"), F.lit(0)).alias("n"))
    return _with_se(best)


def _with_se(df: DataFrame) -> DataFrame:
    a = F.col("accuracy")
    se = F.sqrt(F.try_divide(a * (1 - a), F.col("n")))
    return df.withColumn("se", se).withColumn("ci95", 1.96 * F.col("se"))


def accuracy_fixed(df: DataFrame, score: str, label: str, threshold: float = 0.5,
                   groups: list[str] = ()) -> DataFrame:
    """0/1 labels at one threshold: correct when (score > t and label 1) or
    (score <= t and label 0); NaN/null is never correct."""
    groups = list(groups)
    s = F.col(score)
    fin = _finite(score)
    correct = (fin & (s > threshold) & (F.col(label) == 1)) | \
              (fin & (s <= threshold) & (F.col(label) == 0))
    agg = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"),
                                  F.count_if(correct).alias("correct"))
    return _with_se(agg.withColumn("accuracy", F.try_divide(F.col("correct"), F.col("n")))
                       .drop("correct"))


def _confusion(score: str, label: str, threshold: float, positive: int, strict: bool,
               suffix: str = "") -> list[Column]:
    s = F.col(score)
    pred = _finite(score) & ((s > threshold) if strict else (s >= threshold))
    truth = F.col(label) == positive
    return [F.count_if(pred & truth).alias(f"tp{suffix}"), F.count_if(pred & ~truth).alias(f"fp{suffix}"),
            F.count_if(~pred & truth).alias(f"fn{suffix}"), F.count_if(~pred & ~truth).alias(f"tn{suffix}")]


def _rates(agg: DataFrame, suffix: str = "") -> DataFrame:
    """accuracy, precision, recall, F1 from the counts; 0 where undefined."""
    def safe(num, den):
        return F.coalesce(F.try_divide(num, F.when(den == 0, None).otherwise(den)), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c + suffix) for c in ("tp", "fp", "fn", "tn"))
    p, r = F.col(f"precision{suffix}"), F.col(f"recall{suffix}")
    return (agg.withColumn(f"accuracy{suffix}", safe(tp + tn, F.col("n")))
               .withColumn(f"precision{suffix}", safe(tp, tp + fp))
               .withColumn(f"recall{suffix}", safe(tp, tp + fn))
               .withColumn(f"f1{suffix}", safe(2 * p * r, p + r)))


def classification_report(df: DataFrame, score: str, label: str, threshold: float = 0.5,
                          positive: int = 1, strict: bool = False,
                          groups: list[str] = ()) -> DataFrame:
    """accuracy, precision, recall, F1 for the positive class at a threshold
    (``score >= t`` unless ``strict``); a zero denominator gives 0."""
    agg = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"),
                                  *_confusion(score, label, threshold, positive, strict))
    return _rates(agg)


def model_delta(df: DataFrame, before: str, after: str, label: str, threshold: float = 0.5,
                positive: int = 1, strict: bool = False, groups: list[str] = ()) -> DataFrame:
    """Change of accuracy, precision, recall and F1 from score ``before`` to
    score ``after`` of the same rows, in one aggregate."""
    agg = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"),
                                  *_confusion(before, label, threshold, positive, strict, "_before"),
                                  *_confusion(after, label, threshold, positive, strict, "_after"))
    both = _rates(_rates(agg, "_before"), "_after")
    return both.select(*groups, *[(F.col(f"{m}_after") - F.col(f"{m}_before")).alias(f"{m}_delta")
                                  for m in ("accuracy", "precision", "recall", "f1")])


def roc_auc(df: DataFrame, score: str, label: str, groups: list[str] = (),
            positive: int = 1, persist_input: bool = True,
            bounds: list[float] | None = None) -> DataFrame:
    """Area under the ROC curve (Mann-Whitney with ties counted half).  Null
    (the library raises) when a group has one class only; NaN scores dropped.

    AUC = sum over distinct scores of pos(s) * (neg(<s) + neg(s)/2) / (P N)."""
    groups = list(groups)
    rows = df.where(_finite(score)).select(*groups, F.col(score).cast("double").alias("_s"),
                                           (F.col(label) == positive).alias("_p"))
    hist = rows.groupBy(*groups, "_s").agg(F.count_if("_p").alias("pos"),
                                           F.count_if(~F.col("_p")).alias("neg"))
    pre = prefix_sums(hist, "_s", ["neg"], groups, persist_input=persist_input, bounds=bounds)
    contrib = pre.groupBy(*groups).agg(
        F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2.0)).alias("_u"),
        F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    den = F.col("P") * F.col("N")
    return contrib.select(*groups, F.try_divide(F.col("_u"), F.when(den == 0, None)
                                                .otherwise(den)).alias("auc"))


def _mse(pred: str, label: str) -> Column:
    return F.avg(F.pow(F.col(pred) - F.col(label), 2)).alias("mse")


def _bce(logit: str, label: str) -> Column:
    x, y = F.col(logit), F.col(label).cast("double")
    return F.avg(F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))).alias("bce")


def mse(df: DataFrame, pred: str, label: str, groups: list[str] = ()) -> DataFrame:
    return df.groupBy(*groups).agg(_mse(pred, label))


def bce_logits(df: DataFrame, logit: str, label: str, groups: list[str] = ()) -> DataFrame:
    """Mean binary cross-entropy with logits, numerically stable form."""
    return df.groupBy(*groups).agg(_bce(logit, label))


def losses(df: DataFrame, pred: str, label: str, label01: str, groups: list[str] = ()) -> DataFrame:
    """Both losses (+-1 labels for mse, 0/1 labels for bce) in one aggregate."""
    return df.groupBy(*groups).agg(_mse(pred, label), _bce(pred, label01))


def exact_quantile(df: DataFrame, col: str, q: float = 0.25, groups: list[str] = ()) -> DataFrame:
    """Exact quantile with linear interpolation (position (n-1) q), found by
    counting instead of sorting the column into one task."""
    groups = list(groups)
    vals = df.where(_finite(col)).select(*groups, F.col(col).cast("double").alias("_v"))
    hist = vals.groupBy(*groups, "_v").agg(F.count(F.lit(1)).alias("c"))
    pre = prefix_sums(hist, "_v", ["c"], groups)       # rows before = before_c
    n = pre.groupBy(*groups).agg(F.sum("c").alias("n"))
    h = (F.col("n") - 1) * q
    lo_i, hi_i = F.floor(h), F.ceil(h)
    cover = lambda i: (F.col("before_c") <= i) & (i < F.col("before_c") + F.col("c"))
    if groups:
        j = join_null_safe(pre, n, groups)
    else:
        j = pre.withColumn("n", F.lit(n.first()["n"]))
    picked = j.where(cover(lo_i) | cover(hi_i)).groupBy(*groups).agg(
        F.max_by("_v", F.when(cover(lo_i), 1).otherwise(0)).alias("lo"),
        F.max_by("_v", F.when(cover(hi_i), 1).otherwise(0)).alias("hi"),
        F.first(h).alias("h"))
    frac = F.col("h") - F.floor("h")
    return picked.select(*groups, (F.col("lo") + (F.col("hi") - F.col("lo")) * frac)
                         .alias(f"q{int(round(q * 100))}"))


def _values(df: DataFrame, col: str) -> DataFrame:
    """The finite values of a column as a written table (``_v double``), so that
    passes over them do not recompute upstream."""
    return materialize(df.where(_finite(col)).select(F.col(col).cast("double").alias("_v")), "values")


def score_histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Density histogram over [min, max] with the last bin closed, matching
    the usual edge rule (edges min + i * (max - min) / bins).  The column is
    written once: the range and the counts both read it."""
    vals = _values(df, col)
    st = vals.agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"),
                  F.count(F.lit(1)).alias("n")).first()
    if not st["n"]:
        return _empty_hist(df)
    lo, hi = st["lo"], st["hi"]
    if lo == hi:
        # Constant data: the usual rule widens the range to [v - 0.5, v + 0.5].
        lo, hi = lo - 0.5, hi + 0.5
    rng = _scalars({"lo": float(lo), "hi": float(hi), "n": st["n"]})
    width = (F.col("hi") - F.col("lo")) / bins
    edge = lambda i: F.when(i >= bins, F.col("hi")).otherwise(F.col("lo") + i * width)  # noqa
    raw = F.floor((F.col("_v") - F.col("lo")) * (bins / (F.col("hi") - F.col("lo"))))
    b0 = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(raw, F.lit(bins - 1)))
    tagged = vals.select("_v", *rng).withColumn("b", b0.cast("int"))
    tagged = tagged.withColumn("b", F.when(F.col("_v") < edge(F.col("b")), F.col("b") - 1)
                               .otherwise(F.col("b")))
    tagged = tagged.withColumn("b", F.when((F.col("_v") >= edge(F.col("b") + 1))
                                           & (F.col("b") != bins - 1), F.col("b") + 1)
                               .otherwise(F.col("b")))
    counts = tagged.groupBy("b").agg(F.count(F.lit(1)).alias("count"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("b"), *rng)
    out = grid.join(counts, "b", "left").fillna(0, ["count"])
    return out.select(F.col("b").cast("int").alias("bin"),
                      edge(F.col("b")).alias("bin_lo"), edge(F.col("b") + 1).alias("bin_hi"),
                      F.col("count").cast("long").alias("count"),
                      F.try_divide(F.col("count"),
                                   F.col("n") * F.when(width == 0, None).otherwise(width))
                      .alias("density"))


def score_kde(df: DataFrame, col: str, points: int = 100) -> DataFrame:
    """Gaussian KDE on ``points`` evenly spaced values over [min, max];
    Scott bandwidth n^(-1/5) times the sample standard deviation.

    An Arrow kernel sums the grid over each partition's values, so ``points``
    rows per partition leave it and nothing of size n x points exists.  The
    column is written once: the range and the sums both read it."""
    vals = _values(df, col)
    st = vals.agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"),
                  F.count(F.lit(1)).alias("n"), F.stddev_samp("_v").alias("sd")).first()
    bw = None if st["sd"] is None else st["sd"] * float(st["n"]) ** -0.2
    schema = "g int, x double, s double"
    if not st["n"]:
        return df.sparkSession.createDataFrame([], "point int, x double, density double")
    lo, hi, n = float(st["lo"]), float(st["hi"]), st["n"]
    # The grid as the usual rule has it: the last point is the maximum itself.
    grid = np.array([hi if i == points - 1 else lo + i * ((hi - lo) / (points - 1)) for i in range(points)])

    def kernel(batches):
        total = np.zeros(points)
        for batch in batches:
            v = batch["_v"].to_numpy()
            for a in range(0, len(v), 4096) if bw else ():
                total += np.exp(-(((grid[:, None] - v[a:a + 4096]) / bw) ** 2) / 2).sum(axis=1)
        yield pd.DataFrame({"g": np.arange(points, dtype=np.int32), "x": grid, "s": total})
    dens = vals.mapInPandas(kernel, schema).groupBy("g", "x").agg(F.sum("s").alias("_s"))
    scale = F.lit(n * bw * math.sqrt(2 * math.pi)) if bw else F.lit(None).cast("double")
    return dens.select(F.col("g").alias("point"), "x", F.try_divide("_s", scale).alias("density"))


def best_by(df: DataFrame, metric: str, tie: list[str], groups: list[str] = (),
            skip_nan: bool = True) -> DataFrame:
    """The row with the greatest ``metric`` (ties: smallest ``tie`` values, of any
    type that can be ordered, null last), per group; NaN/null never wins."""
    groups = list(groups)
    src = df.where(_finite(metric)) if skip_nan else df
    cols = [c for c in df.columns if c not in groups]
    key = F.struct(-F.col(metric), *[c for t in tie for c in (F.col(t).isNull(), F.col(t))])
    agg = src.groupBy(*groups).agg(F.min_by(F.struct(*cols), key).alias("_b"))
    return agg.select(*groups, *[F.col("_b")[c].alias(c) for c in cols])


def _scalars(row) -> list[Column]:
    """One-row aggregate results as typed literal columns."""
    items = row.asDict() if hasattr(row, "asDict") else dict(row)
    out = []
    for k, v in items.items():
        typ = "long" if isinstance(v, int) and not isinstance(v, bool) else "double"
        out.append(F.lit(v).cast(typ).alias(k))
    return out


def _empty_hist(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [], "bin int, bin_lo double, bin_hi double, count long, density double")
