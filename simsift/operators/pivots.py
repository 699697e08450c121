"""Exact top-k that skips pairs of blocks: the same rows as ``topk.topk_similar``.

1. Both sides are grouped around pivots: unit vectors fitted to a bounded sample of the
   candidates.  Every row joins its nearest pivot's group (zero vectors one of their own);
   a group's radius is the widest angle between pivot and member.  Groups that are near
   one another are put together in chunks of at most ``block_rows`` rows; a group of more
   is many chunks by the hash of the id.
2. No pair of two groups scores above ``cos(max(0, angle(pivots) - both radii))``.
   For each query group the candidate groups are taken in the order of that bound, in
   rounds: first FIRST of them, then GROWTH times as many, and so on.
3. After a round every query has a k-th score, and a query group the least of its
   members'.  Candidate groups whose bound is below it can hold no better row, for any
   member; as the bounds fall, that ends the group's search.  What is left goes to the
   next round.  A round's group pairs meet in cells, one for each pair of chunks that has
   any, so a row is copied once for each chunk it meets and not for each group; inside a cell
   only the asked group pairs are scored, and a query takes only rows that reach its own k-th
   score.

Scores, ties and defined results are those of ``topk_similar``.  Only groups (at most
MOST_PIVOTS) are paired on the driver, by their pivots and radii."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simsift.operators.topk import (CELLS_PER_CORE, MAX_BLOCK_BYTES, PAIR_BATCH_BYTES, _arrow_records, _normalised,
                                    _same_ids, best_pairs)
from simsift.session import materialize, release

SAMPLE_ROWS = 8_192      # candidates that fit the pivots (the least hashes)
FIT_ROUNDS = 8
MOST_PIVOTS = 1_024
MIN_CHUNK_ROWS = 256     # of a search that has few rows
FIRST = 4                # candidate groups of a query group in the first round
GROWTH = 4               # how many times as many in each further round
_SLACK = 1e-9            # scores are rounded to 1e-12


@dataclass
class PivotSearch:
    """``rows`` is (query_id, cand_id, score, rank); ``compared`` of ``total`` pairs
    (of a query and a candidate with a vector) were scored."""

    rows: DataFrame
    compared: int
    total: int

    @property
    def skipped(self) -> float:
        return 1 - self.compared / self.total if self.total else 0.0


def fit_pivots(sample: np.ndarray, count: int, seed: int = 0) -> np.ndarray:
    """Unit vectors that a sample gathers around: farthest-first starts, then rounds of
    k-means by angle."""
    x = _normalised(sample, len(sample))
    x = x[np.linalg.norm(x, axis=1) > 0]
    if not len(x):
        return np.zeros((0, sample.shape[1]))
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(x)))]
    nearest = x @ x[chosen[0]]
    while len(chosen) < min(count, len(x)):
        weight = np.clip(1 - nearest, 0, None) ** 2
        if weight.sum() <= 1e-12:
            break
        chosen.append(int(rng.choice(len(x), p=weight / weight.sum())))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    pivots = x[chosen]
    for _ in range(FIT_ROUNDS):
        sums = np.zeros_like(pivots)
        np.add.at(sums, (x @ pivots.T).argmax(axis=1), x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        pivots = np.where(size > 1e-12, sums / np.where(size > 1e-12, size, 1), pivots)
    return pivots


def _nearest(pivots: np.ndarray):
    """(id, vec, grp, angle) of every row; -1 is the group of zero vectors."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            sizes = {len(v) for v in pdf["vec"]}
            if sizes != {pivots.shape[1]}:
                raise ValueError("vectors of different lengths cannot be compared")
            x = _normalised(np.concatenate(pdf["vec"].to_numpy()), len(pdf))
            zero = ~x.any(axis=1)
            near = x @ pivots.T if len(pivots) else np.zeros((len(x), 1))
            group = np.where(zero, -1, near.argmax(axis=1))
            angle = np.where(zero, 0.0, np.arccos(np.clip(near.max(axis=1), -1, 1)))
            yield pd.DataFrame({"id": pdf["id"], "vec": pdf["vec"], "grp": group.astype(np.int32), "angle": angle})
    return run


def _grouped(df: DataFrame, id_col: str, vec_col: str, pivots: np.ndarray) -> DataFrame:
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).where("id is not null and vec is not null")
    kind = rows.schema
    return materialize(rows.mapInPandas(
        _nearest(pivots), T.StructType([kind["id"], kind["vec"], T.StructField("grp", T.IntegerType()),
                                        T.StructField("angle", T.DoubleType())])), "pivot-rows")


def chunks_of(pivots: np.ndarray, sizes: dict[int, int], block_rows: int) -> dict[int, tuple[int, int]]:
    """{group: (its first chunk, how many chunks it has)}.  Groups are taken along a chain of
    near pivots; one of more than ``block_rows`` rows has chunks of its own."""
    chunks, at, room = {}, 0, 0
    left = sorted(g for g in sizes if g >= 0)
    last = None
    while left:
        g = left[0] if last is None else left[int((pivots[left] @ pivots[last]).argmax())]
        left.remove(g)
        last, n = g, sizes[g]
        if n > block_rows:
            parts = math.ceil(n / block_rows)
            chunks[g], at, room = (at, parts), at + parts, 0
            continue
        if n > room:
            at, room = at + 1, block_rows
        chunks[g], room = (at - 1, 1), room - n
    if -1 in sizes:
        chunks[-1] = (at, math.ceil(sizes[-1] / block_rows))
    return chunks


def _side(rows: DataFrame, chunks: dict[int, tuple[int, int]], meets: list[tuple[int, int]], own: str, other: str,
          cells: int, tag: str) -> DataFrame:
    """One row for each cell with the rows of one side; ``meets`` are (group, chunk of the other side)."""
    spark = rows.sparkSession
    # At most MOST_PIVOTS rows, and that many times the number of chunks.
    place = spark.createDataFrame([(g, c, n) for g, (c, n) in chunks.items()], "grp int, chunk int, parts int")
    asked = spark.createDataFrame(meets, f"grp int, {other} int")
    columns = ["id", "grp", "vec"] + (["floor"] if "floor" in rows.columns else [])
    packed = rows.join(F.broadcast(place), "grp").join(F.broadcast(asked), "grp") \
        .withColumn(own, F.col("chunk") + F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")) \
        .repartition(cells, "q_chunk", "c_chunk").groupBy("q_chunk", "c_chunk") \
        .agg(F.collect_list(F.struct(*columns)).alias("x"))
    return packed.select("q_chunk", "c_chunk", *[F.col(f"x.{c}").alias(f"{tag}_{c}") for c in columns if c != "vec"],
                         F.flatten("x.vec").alias(f"{tag}_vec"))


def pair_bounds(pivots: np.ndarray, q: dict[int, float], c: dict[int, float]) -> dict[int, list[tuple[float, int]]]:
    """For each query group the (bound, candidate group) pairs, the highest bound first."""
    out = {}
    for g, radius in q.items():
        pairs = []
        for h, other in c.items():
            if g < 0 or h < 0:
                pairs.append((0.0, h))
            else:
                angle = math.acos(float(np.clip(pivots[g] @ pivots[h], -1, 1)))
                pairs.append((math.cos(max(0.0, angle - radius - other - 1e-7)), h))
        out[g] = sorted(pairs, key=lambda p: (-p[0], p[1]))
    return out


def _kernel(k: int, exclude_self: bool, asked: dict[int, np.ndarray]):
    """Of each cell the (query_id, cand_id, score) that reach the query's k-th score so far, at
    most k a query and cell, from the ``asked`` candidate groups of its group."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                qi, ci, q_grp, c_grp = (np.asarray(x) for x in (r.q_id, r.c_id, r.q_grp, r.c_grp))
                order = np.argsort(ci, kind="stable")
                ci, c_grp = ci[order], c_grp[order]
                Q, C = _normalised(r.q_vec, len(qi)), _normalised(r.c_vec, len(order))[order]
                floor = np.nan_to_num(np.asarray(r.q_floor, dtype=np.float64), nan=-2.0)
                for g in np.unique(q_grp).tolist():
                    mine, theirs = np.flatnonzero(q_grp == g), np.flatnonzero(np.isin(c_grp, asked[g])) if g in asked else []
                    if not len(theirs):
                        continue
                    cut = _same_ids(qi[mine], ci[theirs]) if exclude_self else None
                    rows, cols, scores, _ = best_pairs(Q[mine], C[theirs], k, floor[mine], cut)
                    yield pd.DataFrame({"query_id": qi[mine[rows]], "cand_id": ci[theirs[cols]], "score": scores})
    return run


def pivot_topk(queries: DataFrame, candidates: DataFrame, k: int, *, query_id: str, query_vec: str, cand_id: str,
               cand_vec: str, exclude_self: bool = False, pivots: int | None = None,
               block_rows: int | None = None, first: int = FIRST) -> PivotSearch:
    """Top ``k`` candidates per query by cosine similarity, as ``topk_similar`` gives them.
    ``block_rows`` are the rows of a chunk (default: what MAX_BLOCK_BYTES hold)."""
    if k <= 0:
        raise ValueError("k must be positive")
    spark = queries.sparkSession
    same = queries is candidates and query_id == cand_id and query_vec == cand_vec
    sample = candidates.where(F.col(cand_vec).isNotNull() & F.col(cand_id).isNotNull()) \
        .orderBy(F.xxhash64(F.col(cand_id))).limit(SAMPLE_ROWS).select(F.col(cand_vec).alias("v")).collect()
    schema = T.StructType([
        T.StructField("query_id", queries.schema[query_id].dataType), T.StructField("cand_id", candidates.schema[cand_id].dataType),
        T.StructField("score", T.DoubleType())])
    empty = spark.createDataFrame([], T.StructType([*schema, T.StructField("rank", T.IntegerType())]))
    if not sample or not sample[0].v:
        return PivotSearch(empty, 0, 0)
    if len({len(r.v) for r in sample}) > 1:
        raise ValueError("vectors of different lengths cannot be compared")
    matrix = np.array([r.v for r in sample], dtype=np.float64)
    count = candidates.count()
    centres = fit_pivots(matrix, min(MOST_PIVOTS, pivots or max(1, math.ceil(math.sqrt(count) / 2))))
    c_rows = _grouped(candidates, cand_id, cand_vec, centres)
    q_rows = c_rows if same else _grouped(queries, query_id, query_vec, centres)

    def measured(rows: DataFrame) -> DataFrame:
        return materialize(rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")), "pivot-sizes")
    c_sizes = measured(c_rows)
    q_sizes = c_sizes if same else measured(q_rows)
    c_groups = {r.grp: (r.n, r.radius) for r in c_sizes.collect()}
    q_groups = {r.grp: (r.n, r.radius) for r in q_sizes.collect()}
    if not q_groups or not c_groups:
        return PivotSearch(empty, 0, 0)
    order = pair_bounds(centres, {g: r for g, (_, r) in q_groups.items()}, {g: r for g, (_, r) in c_groups.items()})
    row = 8 * (matrix.shape[1] + 3)
    if block_rows is None:
        # Enough cells for the cores, in a search of all pairs.
        spread = math.ceil(max(count, sum(n for n, _ in q_groups.values()))
                           / math.sqrt(CELLS_PER_CORE * spark.sparkContext.defaultParallelism))
        block_rows = max(1, min(MAX_BLOCK_BYTES // row, max(MIN_CHUNK_ROWS, spread)))
    c_chunks = chunks_of(centres, {g: n for g, (n, _) in c_groups.items()}, block_rows)
    q_chunks = c_chunks if same else chunks_of(centres, {g: n for g, (n, _) in q_groups.items()}, block_rows)

    def within(chunks: dict[int, tuple[int, int]], g: int) -> range:
        return range(chunks[g][0], chunks[g][0] + chunks[g][1])
    at = dict.fromkeys(order, 0)                       # pairs of the group that are done
    floor = dict.fromkeys(order, -math.inf)            # least k-th score of its members
    best, kth, step, compared = None, None, first, 0
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "cand_id")
    while True:
        todo = []
        for g, pairs in order.items():
            chosen = [h for bound, h in pairs[at[g]:at[g] + step] if bound + _SLACK >= floor[g]]
            at[g] = at[g] + step if len(chosen) == step else len(pairs)
            todo += [(g, h) for h in chosen]
        if not todo:
            break
        compared += sum(q_groups[g][0] * c_groups[h][0] for g, h in todo)
        asked: dict[int, list[int]] = {}
        for g, h in todo:
            asked.setdefault(g, []).append(h)
        cells = {(x, y) for g, h in todo for x in within(q_chunks, g) for y in within(c_chunks, h)}
        q_meets = sorted({(g, y) for g, h in todo for y in within(c_chunks, h)})
        c_meets = sorted({(h, x) for g, h in todo for x in within(q_chunks, g)})
        known = q_rows.withColumn("floor", F.lit(-2.0)) if kth is None else \
            q_rows.join(kth.select(F.col("query_id").alias("id"), "floor"), "id", "left")
        met = _side(known, q_chunks, q_meets, "q_chunk", "c_chunk", len(cells), "q").join(
            _side(c_rows, c_chunks, c_meets, "c_chunk", "q_chunk", len(cells), "c"), ["q_chunk", "c_chunk"])
        found = met.mapInPandas(_kernel(k, exclude_self, {g: np.array(h) for g, h in asked.items()}), schema)
        merged = found if best is None else found.unionByName(best)
        with _arrow_records(spark, 2 * block_rows * row, PAIR_BATCH_BYTES):
            done = materialize(merged.withColumn("rank", F.row_number().over(rank).cast("int"))
                               .where(F.col("rank") <= k).drop("rank"), "pivot-best")
        release(best)
        best = done
        release(kth)
        kth = materialize(best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor"))
                          .where(F.col("n") == k).drop("n"), "pivot-kth")
        members = q_rows.select("grp", F.col("id").alias("query_id")).join(kth, "query_id")
        for r in members.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("floor").alias("floor")).collect():
            floor[r.grp] = r.floor if r.n == q_groups[r.grp][0] else -math.inf
        step *= GROWTH
    total = sum(n for n, _ in q_groups.values()) * sum(n for n, _ in c_groups.values())
    for table in (c_rows, q_rows, c_sizes, q_sizes, kth):
        release(table)
    return PivotSearch(best.withColumn("rank", F.row_number().over(rank).cast("int")), compared, total)
