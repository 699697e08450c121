"""Seeded, exact splitting and sampling.

Rows are ordered by ``md5(seed | id ...)``; exact per-label counts come from
an exact rank in that order.  The rank is computed per value range of the
hash (range bounds from approximate quantiles, offsets from per-range counts),
so a label holding a third of all rows is still spread over many tasks.  Only keys
are ranked; the key at each cut then splits the rows themselves, which are
neither written nor shuffled."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from simsift.session import materialize



def _small(df, groups):
    """Broadcast the per-(group, range) offsets only when there are no groups
    (then the table has at most ``buckets`` rows); with groups its size grows
    with the number of groups, so the join is left to the planner (AQE still
    broadcasts it when it is small)."""
    return F.broadcast(df) if not list(groups) else df


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right``, joined on ``keys``; a null key
    equals a null key.  Without keys ``right`` has one row for all."""
    renamed = right.select(*[F.col(k).alias(f"_j_{n}") for n, k in enumerate(keys)],
                           *[c for c in right.columns if c not in keys])
    cond = None
    for n, k in enumerate(keys):
        one = F.col(k).eqNullSafe(F.col(f"_j_{n}"))
        cond = one if cond is None else cond & one
    return left.join(renamed, cond, how).drop(*[f"_j_{n}" for n in range(len(keys))])


def hash_order(seed: int | str, *cols: str) -> Column:
    """md5 of ``seed|col1|col2...`` (hex string); the sort key for sampling."""
    parts = [F.lit(str(seed))] + [F.col(c).cast("string") for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def hash_number(h: Column) -> Column:
    """An md5 string as a long in [0, HASH_RANGE), in the same order."""
    # First 15 hex digits as a non-negative long: same order as the string.
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


RANGE_ROWS = 1_000_000   # about so many rows are sorted in one task
HASH_RANGE = 1 << 60     # hash_number is uniform on [0, 2^60)


def range_of(value: Column, bounds: list[float]) -> Column:
    """How many sorted bounds are below ``value``: nested comparisons that halve
    the bounds, so a row costs log2(len(bounds)) of them."""
    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value <= F.lit(float(bounds[mid])), search(lo, mid)).otherwise(search(mid + 1, hi))
    return search(0, len(bounds))


def exact_rank(df: DataFrame, key: str, groups: list[str] = (), tiebreak: list[str] = (),
               name: str = "rank", buckets: int | None = None,
               persist_input: bool = True, uniform_range: int | None = None) -> DataFrame:
    """1-based rank by (``key``, ``tiebreak``) within ``groups``.

    ``key`` must be numeric.  Rows are tagged with a range bucket of ``key``;
    the rank is (rows in earlier buckets of the group) + row_number inside the
    (group, bucket) partition, which is exact because equal keys share a
    bucket.  Range bounds come from approximate quantiles, or are equal-width
    when the key is known to be uniform on [0, ``uniform_range``).  The input
    is read by several passes; ``persist_input`` writes it once to the shared
    checkpoint folder so an expensive upstream plan runs only once."""
    groups = list(groups)
    spark = df.sparkSession
    if persist_input:
        df = materialize(df, "split")
    nb = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                        -(-df.count() // RANGE_ROWS))
    if nb <= 1:
        bucket = F.lit(0)
    elif uniform_range is not None:
        # Keys uniform on [0, uniform_range): equal-width ranges, no quantile pass.
        bucket = F.expr(f"`{key}` div {-(-uniform_range // nb)}").cast("int")
    else:
        qs = df.approxQuantile(key, [i / nb for i in range(1, nb)], 0.001)
        bounds = sorted(set(v for v in qs if v is not None and not math.isnan(v)))
        bucket = range_of(F.col(key).cast("double"), bounds)
    tagged = df.withColumn("_rb", bucket)
    counts = tagged.groupBy(*groups, "_rb").agg(F.count(F.lit(1)).alias("_cnt"))
    wo = Window.partitionBy(*groups).orderBy("_rb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*groups, "_rb",
                            F.coalesce(F.sum("_cnt").over(wo), F.lit(0)).alias("_off"))
    wi = Window.partitionBy(*groups, "_rb").orderBy(key, *tiebreak)
    return (join_null_safe(tagged, _small(offsets, groups), [*groups, "_rb"])
                  .withColumn(name, (F.col("_off") + F.row_number().over(wi)).cast("long"))
                  .drop("_rb", "_off"))


def _hash_key(seed, ids: list[str]) -> Column:
    """The sort key of a row: hash, then ids (a total order of distinct ids)."""
    return F.struct(hash_order(seed, *ids).alias("h"), *[F.col(c).alias(f"i{n}") for n, c in enumerate(ids)])


def _cut_keys(df: DataFrame, ids: list[str], seed, groups: list[str], cuts: dict[str, Column]) -> DataFrame:
    """One row per group: for each named cut (a row count from ``_n``, the rows
    of the group) the key of that row in hash order; null for a cut of 0."""
    keys = df.select(*groups, _hash_key(seed, ids).alias("_key")) \
             .withColumn("_hn", hash_number(F.col("_key.h")))
    keys = materialize(keys, "keys")
    ranked = exact_rank(keys, "_hn", groups, ["_key"], name="_r", persist_input=False,
                        uniform_range=HASH_RANGE)
    sizes = keys.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    if groups:
        cond = [ranked[g].eqNullSafe(sizes[g]) for g in groups]
        sized = ranked.join(sizes, cond).select(*[ranked[g] for g in groups], "_key", "_r", "_n")
    else:
        sized = ranked.withColumn("_n", F.lit(sizes.first()["_n"]))
    found = sized.groupBy(*groups).agg(
        *[F.max(F.when(F.col("_r") == c, F.col("_key"))).alias(name) for name, c in cuts.items()])
    return materialize(found, "cuts")


def _with_cuts(df: DataFrame, found: DataFrame, groups: list[str], names: list[str]) -> DataFrame:
    """``df`` with the cut keys of its group (a table of one row per group; the
    planner broadcasts it when it is small)."""
    cond = None
    for g in groups:
        one = df[g].eqNullSafe(found[g])
        cond = one if cond is None else cond & one
    return df.join(found, cond, "left").select(*[df[c] for c in df.columns], *[found[n] for n in names])


def stratified_split(df: DataFrame, label: str, ids: list[str], fraction: float = 0.2,
                     seed: int = 123, names: tuple[str, str] = ("train", "test"),
                     out: str = "dataset") -> DataFrame:
    """Per label, the first ``round(fraction * n_label)`` rows in hash order go
    to ``names[1]``, the rest to ``names[0]``.  ``ids`` identify a row."""
    found = _cut_keys(df, ids, seed, [label], {"_cut": F.round(F.col("_n") * fraction, 0)})
    key = _hash_key(seed, ids)
    return _with_cuts(df, found, [label], ["_cut"]).withColumn(
        out, F.when(F.coalesce(key <= F.col("_cut"), F.lit(False)), names[1]).otherwise(names[0])).drop("_cut")


def three_way_split(df: DataFrame, label: str, ids: list[str], test: float = 0.2,
                    validation: float = 0.1, seed: int = 123, out: str = "dataset") -> DataFrame:
    """``test`` of each label to test, then ``validation`` of the remainder to
    validation (72 / 8 / 20 by default).  ``ids`` identify a row.

    Equal to two stratified splits with the same seed: the remainder keeps the
    same hash order, so one ranking with two cut points gives both."""
    t = F.round(F.col("_n") * test, 0)
    v = t + F.round((F.col("_n") - t) * validation, 0)
    found = _cut_keys(df, ids, seed, [label], {"_test": t, "_val": v})
    key = _hash_key(seed, ids)
    return _with_cuts(df, found, [label], ["_test", "_val"]).withColumn(
        out, F.when(F.coalesce(key <= F.col("_test"), F.lit(False)), "test")
              .when(F.coalesce(key <= F.col("_val"), F.lit(False)), "validation")
              .otherwise("train")).drop("_test", "_val")


TOP_N_ROWS = 100_000     # up to here a sample is a top-n; beyond it, a cut key


def sample_n(df: DataFrame, n: int, ids: list[str], seed: int = 123,
             allow_fewer: bool = False) -> DataFrame:
    """``n`` rows without replacement, the first in hash order.  Raises when
    fewer than ``n`` rows exist unless ``allow_fewer``.  ``ids`` identify a row."""
    if n < 0:
        raise ValueError("n must be >= 0")
    total = None
    if not allow_fewer or n > TOP_N_ROWS:
        total = df.count()
        if total < n and not allow_fewer:
            raise ValueError(f"cannot sample {n} rows from {total}")
        if total <= n:
            return df
    if n <= TOP_N_ROWS:
        return df.orderBy(_hash_key(seed, ids)).limit(n)
    found = _cut_keys(df, ids, seed, [], {"_cut": F.lit(n)})
    # One row: compared with every key, no shuffle.
    return df.join(F.broadcast(found), _hash_key(seed, ids) <= F.col("_cut"), "left_semi")


def sample_rows(df: DataFrame, ids: list[str], n: int = 50, seed: int = 123) -> DataFrame:
    """Inspection sample (up to ``n`` rows)."""
    return sample_n(df, n, ids, seed, allow_fewer=True)
