"""Approximate top-k search by sign-random-projection signatures.

1. ``bands`` groups of ``bits`` random planes; the signs of a vector's projections
   are its bucket in each band.
2. A query probes ``probes`` buckets of each band: those that are cheapest to reach by
   flipping signs, a flip costing the square of the projection (small projections
   are the likeliest to have the other sign for a near vector).
3. Both sides are cut into blocks by the hash of the id, and pairs of blocks meet in cells
   as in ``topk``: a row is copied once for each block of the other side, however
   many buckets a query probes.  A cell's kernel takes its candidates bucket by bucket and
   scores them with the cell's queries that probe the bucket; cosines are computed in
   full, so every score is exact and only the choice of candidates is approximate.
   Of a pair found in several bands one row is left.

``fit`` chooses ``probes``: for a bounded sample of queries (SAMPLE_QUERIES least hashes) the exact
search gives the neighbours, and the number is the least one with which
``target`` of them would be met.  On data without structure that can come near all
buckets; ``topk.topk_similar`` and ``pivots.pivot_topk`` stay the exact searches.

Defined results: null vectors are skipped, zero vectors score 0 (all signs positive);
scores and ties among what is found as in ``topk_similar``."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simsift.operators.pivots import PivotSearch
from simsift.operators.topk import (MAX_BLOCK_BYTES, PAIR_BATCH_BYTES, _arrow_records, _best_of_rows, _block_rows, _cells,
                                    _normalised, _same_ids, best_pairs, topk_similar)
from simsift.session import materialize, release

BLOCK_ROWS = 65_536       # rows of a block at most, and MAX_BLOCK_BYTES
QUERY_ROWS = 8_192        # queries of a cell whose probes are held at a time
COST_ROWS = 256           # and whose costs are
SAMPLE_QUERIES = 256
MOST_BITS = 12
BUCKET_ROWS = 512         # rows that a bucket should hold


@dataclass
class Signatures:
    """Planes (width x bands * bits) and the buckets that a query probes in each band."""

    planes: np.ndarray
    bands: int
    bits: int
    probes: int

    def _projected(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.planes).reshape(len(x), self.bands, self.bits)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """The bucket of each row in each band."""
        return (self._projected(x) >= 0) @ (1 << np.arange(self.bits))

    def costs(self, x: np.ndarray) -> np.ndarray:
        """What each bucket costs each row in each band: squared projections with
        another sign."""
        flips = (np.arange(1 << self.bits)[:, None] >> np.arange(self.bits)) & 1
        own = self.buckets(x)
        by_mask = (self._projected(x) ** 2) @ flips.T.astype(np.float64)     # by the mask of flipped signs
        masks = np.arange(1 << self.bits)[None, None, :] ^ own[:, :, None]
        return np.take_along_axis(by_mask, masks, axis=2)

    def probed(self, x: np.ndarray) -> np.ndarray:
        """The buckets that each row probes in each band."""
        if self.probes >= 1 << self.bits:
            return np.broadcast_to(np.arange(1 << self.bits), (len(x), self.bands, 1 << self.bits))
        return np.argpartition(self.costs(x), self.probes - 1, axis=2)[:, :, :self.probes]


def needed_probes(signatures: Signatures, queries: np.ndarray, neighbours: np.ndarray, target: float) -> int:
    """The least number of probes with which ``target`` of the (query, neighbour) rows
    meet in some band."""
    ranks = []
    for a in range(0, len(queries), 256):
        costs = signatures.costs(queries[a:a + 256])
        at = signatures.buckets(neighbours[a:a + 256])
        own = np.take_along_axis(costs, at[:, :, None], axis=2)
        ranks.append((costs < own).sum(axis=2).min(axis=1) + 1)
    ranks = np.sort(np.concatenate(ranks))
    return int(ranks[min(len(ranks) - 1, max(0, math.ceil(target * len(ranks)) - 1))])


def fit(queries: DataFrame, candidates: DataFrame, k: int, *, query_id: str, query_vec: str, cand_id: str, cand_vec: str,
        exclude_self: bool = False, target: float = 0.95, bands: int = 4, bits: int | None = None, seed: int = 7) -> Signatures | None:
    """Signatures for a search; None when either side has no vector."""
    found = candidates.where(F.col(cand_vec).isNotNull())
    n = found.count()
    sample = queries.where(F.col(query_vec).isNotNull() & F.col(query_id).isNotNull()) \
        .orderBy(F.xxhash64(F.col(query_id))).limit(SAMPLE_QUERIES)
    sample = materialize(sample.select(F.col(query_id).alias("q"), F.col(query_vec).alias("qv")), "signature-sample")
    if not n or sample.isEmpty():
        return None
    width = found.select(F.size(cand_vec).alias("d")).first().d
    bits = bits or int(np.clip(round(math.log2(max(1, n) / BUCKET_ROWS)), 2, MOST_BITS))
    planes = np.random.default_rng(seed).normal(size=(width, bands * bits))
    out = Signatures(planes, bands, bits, 1 << bits)
    near = topk_similar(sample, found, k, query_id="q", query_vec="qv", cand_id=cand_id, cand_vec=cand_vec,
                        exclude_self=exclude_self)
    # At most SAMPLE_QUERIES * k pairs of vectors.
    pairs = near.join(sample, near["query_id"] == sample["q"]) \
        .join(found.select(F.col(cand_id).alias("cand_id"), F.col(cand_vec).alias("cv")), "cand_id").select("qv", "cv").collect()
    if pairs:
        q, c = (_normalised([x for r in pairs for x in r[j]], len(pairs)) for j in range(2))
        out.probes = needed_probes(out, q, c, target)
    release(sample)
    return out


def _probes(signatures: Signatures, x: np.ndarray) -> np.ndarray:
    """``probed`` of many rows, a few at a time."""
    parts = [signatures.probed(x[a:a + COST_ROWS]).astype(np.int16 if signatures.bits < 15 else np.int32) for a in range(0, len(x), COST_ROWS)]
    return np.concatenate(parts)


def _sizes(df: DataFrame, id_col: str, vec_col: str, signatures: Signatures, probe: bool) -> DataFrame:
    """(band, bucket, n): the rows in a bucket, or that probe it."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros((signatures.bands, 1 << signatures.bits), np.int64)
        for pdf in batches:
            for a in range(0, len(pdf), COST_ROWS):
                vecs = pdf["vec"].iloc[a:a + COST_ROWS]
                if {len(v) for v in vecs} != {len(signatures.planes)}:
                    raise ValueError("vectors of different lengths cannot be compared")
                x = _normalised(np.concatenate(vecs.to_numpy()), len(vecs))
                at = signatures.probed(x) if probe else signatures.buckets(x)[:, :, None]
                for band in range(signatures.bands):
                    n[band] += np.bincount(at[:, band].ravel(), minlength=n.shape[1])
        band, bucket = np.nonzero(n)
        yield pd.DataFrame({"band": band.astype(np.int32), "bucket": bucket.astype(np.int32), "n": n[band, bucket]})
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).where("id is not null and vec is not null")
    # At most bands * 2^MOST_BITS rows.
    return materialize(rows.select("vec").mapInPandas(run, "band int, bucket int, n long")
                       .groupBy("band", "bucket").agg(F.sum("n").alias("n")), "signature-sizes")


def _met(signatures: Signatures, X: np.ndarray, Y: np.ndarray, qi: np.ndarray, ci: np.ndarray, k: int, exclude_self: bool):
    """(row, column, score) of the best ``k`` columns of each row among those it meets."""
    at = signatures.buckets(Y)
    by = [np.argsort(at[:, b], kind="stable") for b in range(signatures.bands)]
    start = [np.searchsorted(at[o, b], np.arange((1 << signatures.bits) + 1)) for b, o in enumerate(by)]
    probed = _probes(signatures, X)
    floor, held, new, count = np.full(len(X), -2.0), (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), [], 0

    def merged():
        rows, cols, scores = (np.concatenate(x) for x in zip(held, *new))
        once = np.unique(rows * len(Y) + cols, return_index=True)[1]
        rows, cols, scores, place = _best_of_rows(rows[once], cols[once], scores[once], k)
        full = place == k - 1
        floor[rows[full]] = scores[full]
        return rows, cols, scores
    for b in range(signatures.bands):
        buckets = probed[:, b].ravel()
        order = np.argsort(buckets, kind="stable")
        edges = np.searchsorted(buckets[order], np.arange((1 << signatures.bits) + 1))
        for bucket in range(1 << signatures.bits):
            cols = by[b][start[b][bucket]:start[b][bucket + 1]]             # ascending, as ids are
            mine = order[edges[bucket]:edges[bucket + 1]] // probed.shape[2]
            if not len(cols) or not len(mine):
                continue
            cut = _same_ids(qi[mine], ci[cols]) if exclude_self else None
            r, c, scores, _ = best_pairs(X[mine], Y[cols], k, floor[mine], cut)
            new.append((mine[r], cols[c], scores))
            count += len(r)
            if count >= 4 * k * len(X):
                held = merged()
                new, count = [], 0
    return merged()


def _kernel(signatures: Signatures, k: int, exclude_self: bool):
    """Of each cell the (query_id, cand_id, score) of pairs that meet, at most k a query."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                if {int(r.q_dmin), int(r.q_dmax), int(r.c_dmin), int(r.c_dmax)} != {len(signatures.planes)}:
                    raise ValueError("vectors of different lengths cannot be compared")
                qi, ci = np.asarray(r.q_ids), np.asarray(r.c_ids)
                order = np.argsort(ci, kind="stable")
                ci = ci[order]
                Q, C = _normalised(r.q_vecs, len(qi)), _normalised(r.c_vecs, len(order))[order]
                for a in range(0, len(qi), QUERY_ROWS):
                    rows, cols, scores = _met(signatures, Q[a:a + QUERY_ROWS], C, qi[a:a + QUERY_ROWS], ci, k, exclude_self)
                    yield pd.DataFrame({"query_id": qi[a + rows], "cand_id": ci[cols], "score": scores})
    return run


def signature_topk(queries: DataFrame, candidates: DataFrame, k: int, *, query_id: str, query_vec: str, cand_id: str,
                   cand_vec: str, exclude_self: bool = False, target: float = 0.95, bands: int = 4,
                   bits: int | None = None, signatures: Signatures | None = None) -> PivotSearch:
    """At most ``k`` near candidates per query: (query_id, cand_id, score, rank), and how
    many pairs were scored.  A pair that meets in several bands is counted in each."""
    if k <= 0:
        raise ValueError("k must be positive")
    names = dict(query_id=query_id, query_vec=query_vec, cand_id=cand_id, cand_vec=cand_vec)
    signatures = signatures or fit(queries, candidates, k, exclude_self=exclude_self, target=target, bands=bands,
                                   bits=bits, **names)
    schema = T.StructType([T.StructField("query_id", queries.schema[query_id].dataType),
                           T.StructField("cand_id", candidates.schema[cand_id].dataType), T.StructField("score", T.DoubleType())])
    spark = queries.sparkSession
    if signatures is None:
        return PivotSearch(spark.createDataFrame([], T.StructType([*schema, T.StructField("rank", T.IntegerType())])), 0, 0)
    c_sizes = _sizes(candidates, cand_id, cand_vec, signatures, False)
    q_sizes = _sizes(queries, query_id, query_vec, signatures, True)
    counts = q_sizes.join(c_sizes.withColumnRenamed("n", "m"), ["band", "bucket"], "left") \
        .agg(F.sum(F.col("n") * F.coalesce("m", F.lit(0))).alias("met")).first().met
    sizes = [s.where("band = 0").agg(F.sum("n")).first()[0] or 0 for s in (q_sizes, c_sizes)]
    nq, nc = sizes[0] // signatures.probes, sizes[1]
    row = 8 * (len(signatures.planes) + 1)
    limit = max(1, min(BLOCK_ROWS, MAX_BLOCK_BYTES // row))
    cores = spark.sparkContext.defaultParallelism
    q_rows, c_rows = _block_rows(nq, limit, cores), _block_rows(nc, limit, cores)
    q_blocks, c_blocks = max(1, math.ceil(nq / q_rows)), max(1, math.ceil(nc / c_rows))
    met = _cells(queries, query_id, query_vec, "q_blk", "c_blk", q_blocks, c_blocks, "q").join(
        _cells(candidates, cand_id, cand_vec, "c_blk", "q_blk", c_blocks, q_blocks, "c"), ["q_blk", "c_blk"])
    with _arrow_records(spark, (q_rows + c_rows) * row, PAIR_BATCH_BYTES):
        found = materialize(met.mapInPandas(_kernel(signatures, k, exclude_self), schema), "signature-found")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "cand_id")
    rows = found.groupBy("query_id", "cand_id").agg(F.max("score").alias("score")) \
        .withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    rows = materialize(rows, "signature-topk")
    for table in (found, q_sizes, c_sizes):
        release(table)
    return PivotSearch(rows, int(counts or 0), nq * nc)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (pairs, met, recall): how many (query_id, cand_id) of the exact lists the
    other search found."""
    both = exact.select("query_id", "cand_id").join(
        found.select("query_id", "cand_id", F.lit(1).alias("hit")), ["query_id", "cand_id"], "left")
    return both.agg(F.count(F.lit(1)).alias("pairs"), F.count("hit").alias("met")) \
        .select("pairs", "met", F.try_divide("met", "pairs").alias("recall"))
