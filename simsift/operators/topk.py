"""Exact top-k cosine similarity between two vector tables.

Plan (no ``crossJoin`` and no row per (query, candidate) pair):

1. Both sides are cut into blocks by hashing the row id
   (``pmod(xxhash64(id), n_blocks)``); ids are unique, so blocks are balanced and
   bounded no matter how skewed any business key is.  A block holds up to
   MAX_BLOCK_BYTES, so that few copies of a row are shuffled: one for each block of
   the other side.  Smaller tables get smaller blocks, for the cores.
2. Every pair of blocks is a cell.  The rows of both sides are sent to their cells
   (``explode(sequence(...))``), are packed there, and the two sides are joined on the
   cell without moving again.  A side is broadcast instead only when the other has one
   block and its own size, from a row count and the vector width, is under
   ``broadcast_bytes``.
3. A ``mapInPandas`` kernel goes through a cell tile by tile (:func:`best_pairs`):
   products in single precision choose what can reach a query's k-th score so far,
   with a margin for their rounding, and only that is scored in double precision.
   It keeps the k best candidates per query with a deterministic tie rule
   (score desc, candidate id asc).  Only k rows per query and cell leave the
   Python worker, and no array of it grows with the square of a block.
4. When there is more than one candidate block the partial lists are merged
   with ``row_number() <= k`` per query (Catalyst plans a partial
   ``WindowGroupLimit`` before the shuffle).
"""

from __future__ import annotations

import math
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from simsift.session import materialize

MIN_BLOCK_ROWS = 64
CELLS_PER_CORE = 8                       # cells of a large search
DEFAULT_BROADCAST_BYTES = 128 * 1024 * 1024
MAX_BLOCK_BYTES = 16 * 1024 * 1024       # one side of a cell
TILE = (512, 1024)                       # queries and candidates of one product
PAIR_BATCH_BYTES = 32 * 1024 * 1024      # bound on one Arrow batch of cells
ARROW_BATCH_BYTES = 256 * 1024 * 1024    # bound on one Arrow batch of block pairs
_RECORDS_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def _arrow_records(spark, row_bytes: int, batch_bytes: int | None = None):
    """A kernel input row is a whole block pair, so the default 10,000 rows per
    Arrow batch could mean gigabytes per batch at real vector widths.  Inside
    this block the session's record limit keeps a batch near ARROW_BATCH_BYTES;
    the setting is put back afterwards."""
    before = spark.conf.get(_RECORDS_CONF, "10000")
    want = max(1, (batch_bytes or ARROW_BATCH_BYTES) // max(1, row_bytes))
    if 0 < int(before) <= want:
        yield
        return
    spark.conf.set(_RECORDS_CONF, str(want))
    try:
        yield
    finally:
        spark.conf.set(_RECORDS_CONF, before)


def _count(df: DataFrame, id_col: str) -> tuple[int, int]:
    """(rows, bytes of the ids), from the id column only (no vector is read)."""
    size = F.length(F.col(id_col).cast("string")) if isinstance(df.schema[id_col].dataType, T.StringType) \
        else F.lit(8)
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b")).first()
    return int(row["n"]), 4 * int(row["b"] or 0)


def _element(df: DataFrame, vec: str) -> str:
    """Vectors are searched in their own precision: double if they are double."""
    kind = df.schema[vec].dataType
    return "double" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.DoubleType) else "float"


def _width(df: DataFrame, vec: str) -> int:
    row = df.where(F.col(vec).isNotNull()).select(F.size(vec).alias("d")).first()
    return int(row["d"]) if row else 0


def _block_rows(n: int, limit: int, parallelism: int) -> int:
    """Rows of a block: small enough that the pairs of blocks occupy all cores,
    never over ``limit``, never under MIN_BLOCK_ROWS (but for the limit)."""
    per_side = max(1, math.ceil(math.sqrt(CELLS_PER_CORE * parallelism)))
    return max(1, min(limit, max(MIN_BLOCK_ROWS, math.ceil(n / per_side))))


def _cells(df: DataFrame, id_col: str, vec_col: str, own: str, other: str, n_own: int, n_other: int,
           tag: str) -> DataFrame:
    """One row for each cell (``q_blk``, ``c_blk``) with the rows of one side."""
    items = (df.select(F.col(id_col).alias("id"),
                       F.col(vec_col).cast(f"array<{_element(df, vec_col)}>").alias("vec"))
               .where(F.col("vec").isNotNull() & F.col("id").isNotNull())
               # coalesce makes the key non-nullable, so no isnotnull filter is
               # inferred into one side only.
               .withColumn(own, F.coalesce(F.pmod(F.xxhash64("id"), F.lit(n_own)).cast("int"), F.lit(0)))
               .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))))
    # Both sides are dealt out alike, a partition for each cell: the join moves nothing.
    grouped = items.repartition(n_own * n_other, "q_blk", "c_blk").groupBy("q_blk", "c_blk").agg(
        F.collect_list(F.struct("id", "vec")).alias("items"),
        F.min(F.size("vec")).alias("dmin"), F.max(F.size("vec")).alias("dmax"))
    return grouped.select(
        "q_blk", "c_blk",
        F.transform("items", lambda x: x["id"]).alias(f"{tag}_ids"),
        F.flatten(F.transform("items", lambda x: x["vec"])).alias(f"{tag}_vecs"),
        F.col("dmin").alias(f"{tag}_dmin"), F.col("dmax").alias(f"{tag}_dmax"))


def _normalised(flat, n: int) -> np.ndarray:
    m = np.asarray(flat, dtype=np.float64).reshape(n, -1) if n else np.zeros((0, 0))
    norms = np.linalg.norm(m, axis=1)
    norms[norms == 0] = 1.0          # zero vectors score 0 against everything
    return m / norms[:, None]


def block_topk(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Column indices and scores of the k best entries per row.

    Columns must already be in ascending id order: ties then resolve to the
    smaller id because the final ordering is a stable sort.  ``-inf`` marks
    excluded cells and is dropped by the caller."""
    nq, nc = scores.shape
    kk = min(k, nc)
    if kk == 0:
        return np.zeros((nq, 0), dtype=np.int64), np.zeros((nq, 0))
    if kk < nc:
        part = np.argpartition(-scores, kk - 1, axis=1)[:, :kk]
        kth = np.take_along_axis(scores, part, axis=1).min(axis=1)
        # Ties at the boundary: argpartition picks arbitrary tied columns, so
        # rows with more tied cells than slots are recomputed exactly.
        n_ge = (scores >= kth[:, None]).sum(axis=1)
        tied = np.nonzero(n_ge > kk)[0]
        if len(tied):
            exact = np.argsort(-scores[tied], axis=1, kind="stable")[:, :kk]
            part[tied] = exact
        part = np.sort(part, axis=1)            # id order before the stable sort
    else:
        part = np.tile(np.arange(nc), (nq, 1))
    vals = np.take_along_axis(scores, part, axis=1)
    order = np.argsort(-vals, axis=1, kind="stable")
    return np.take_along_axis(part, order, axis=1), np.take_along_axis(vals, order, axis=1)


def _same_ids(qi: np.ndarray, ci: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of equal ids; ``ci`` ascending, ids may repeat."""
    if qi.dtype.kind != ci.dtype.kind:
        return np.nonzero(np.equal.outer(qi, ci))
    first = np.searchsorted(ci, qi, "left")
    many = np.searchsorted(ci, qi, "right") - first
    rows = np.repeat(np.arange(len(qi)), many)
    return rows, np.repeat(first - np.cumsum(many) + many, many) + np.arange(len(rows))


def _best_of_rows(rows, cols, scores, k: int):
    """Of (row, column, score) the best ``k`` of each row, in order; ties to the smaller column.
    Equal scores of a row must come by column.  Scores are multiples of 1e-12 from -1 to 1,
    so one integer orders row and score."""
    order = np.argsort((rows << 41) - np.rint(scores * 1e12).astype(np.int64), kind="stable")
    rows, cols, scores = rows[order], cols[order], scores[order]
    start = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, np.int64)
    place = np.arange(len(rows)) - np.repeat(start, np.diff(np.r_[start, len(rows)]))
    keep = place < k
    return rows[keep], cols[keep], scores[keep], place[keep]


def exact_scores(Q: np.ndarray, C: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Cosines of some pairs of normalised rows.  They are quantised to 1e-12 so that
    rounding noise cannot break exact ties."""
    out = np.empty(len(rows))
    step = max(1, (8 << 20) // max(1, 8 * Q.shape[1]))
    for a in range(0, len(rows), step):
        out[a:a + step] = np.einsum("ij,ij->i", Q[rows[a:a + step]], C[cols[a:a + step]])
    return np.round(np.clip(out, -1.0, 1.0), 12)


def best_pairs(Q: np.ndarray, C: np.ndarray, k: int, floor: np.ndarray | None = None,
               cut: tuple[np.ndarray, np.ndarray] | None = None):
    """(row, column, score, place from 0) of each row's best ``k`` columns that reach its
    ``floor``; ties go to the smaller column.  Rows are normalised or zero; ``cut`` are
    (rows, columns) that do not count.

    A tile of products in single precision is off by ``slack`` at most, as rows have
    length one.  What could reach the k-th score so far, less that, is scored again in
    double precision; a query for which that is much of a tile (many ties) has the
    tile's scores in double precision at once."""
    nq, nc, d = len(Q), len(C), Q.shape[1]
    slack = (d + 8) * 2.0 ** -23
    q32, c32 = Q.astype(np.float32), C.astype(np.float32)
    bad = np.flatnonzero(~np.isfinite(C).all(axis=1))            # such a score is not a number
    c32[bad] = 0
    if cut is not None:
        order = np.argsort(cut[0], kind="stable")
        cut = cut[0][order], cut[1][order]
    out = []
    for a in range(0, nq, TILE[0]):
        q, Qt = q32[a:a + TILE[0]], Q[a:a + TILE[0]]
        m = len(q)
        low = np.full(m, -2.0) if floor is None else np.maximum(floor[a:a + m], -2.0)
        if cut is not None:
            span = slice(*np.searchsorted(cut[0], [a, a + m]))
            cut_rows, cut_cols = cut[0][span] - a, cut[1][span]
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        new, count = [], 0

        def merged():
            rows, cols, scores, place = _best_of_rows(*(np.concatenate(x) for x in zip(held, *new)), k)
            last = place == k - 1
            low[rows[last]] = np.maximum(low[rows[last]], scores[last])
            # No score is above 1, and columns to come lose ties.
            low[rows[last][scores[last] >= 1.0]] = 9.0
            return (rows, cols, scores), place

        for b in range(0, nc, TILE[1]):
            S = q @ c32[b:b + TILE[1]].T
            w = S.shape[1]
            S[:, bad[(bad >= b) & (bad < b + w)] - b] = -4
            if cut is not None:
                at = (cut_cols >= b) & (cut_cols < b + w)
                S[cut_rows[at], cut_cols[at] - b] = -4
            if b == 0 and w > k:
                kth = np.partition(S, w - k, axis=1)[:, w - k]
                low = np.maximum(low, np.where(kth >= -1.5, kth - slack, -2.0))
            hit = np.flatnonzero(S >= (low - slack).astype(np.float32)[:, None])
            if not len(hit):
                continue
            rows, cols = np.divmod(hit, w)
            many = np.bincount(rows, minlength=m)
            crowded = np.flatnonzero(many > 8 * k + 64)
            if len(crowded):
                rest = many[rows] <= 8 * k + 64
                rows, cols = rows[rest], cols[rest]
                E = np.round(np.clip(Qt[crowded] @ C[b:b + w].T, -1.0, 1.0), 12)
                E[S[crowded] < -3] = -np.inf
                idx, vals = block_topk(E, k)
                r, flat = np.repeat(crowded, idx.shape[1]), vals.ravel()
                ok = flat >= low[r]
                new.append((r[ok], b + idx.ravel()[ok], flat[ok]))
                count += int(ok.sum())
            if len(rows):
                scores = exact_scores(Qt, C[b:b + w], rows, cols)
                ok = scores >= low[rows]
                new.append((rows[ok], b + cols[ok], scores[ok]))
                count += int(ok.sum())
            if count >= m * k:
                held, _ = merged()
                new, count = [], 0
        (rows, cols, scores), place = merged()
        out.append((rows + a, cols, scores, place))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _kernel(k: int, exclude_self: bool):
    def run(batches):
        for pdf in batches:
            no_pairs = [None] * len(pdf)
            for q_ids, q_vecs, q_d0, q_d1, c_ids, c_vecs, c_d0, c_d1, x_q, x_c in zip(
                    pdf["q_ids"], pdf["q_vecs"], pdf["q_dmin"], pdf["q_dmax"],
                    pdf["c_ids"], pdf["c_vecs"], pdf["c_dmin"], pdf["c_dmax"],
                    pdf.get("x_q", no_pairs), pdf.get("x_c", no_pairs)):
                if len({int(q_d0), int(q_d1), int(c_d0), int(c_d1)}) != 1:
                    raise ValueError("vectors of different lengths cannot be compared")
                qi = np.asarray(q_ids)
                ci = np.asarray(c_ids)
                order = np.argsort(ci, kind="stable")
                ci = ci[order]
                cut = []
                if exclude_self:
                    cut.append(_same_ids(qi, ci))
                if x_q is not None and len(x_q):
                    row = {v: r for r, v in enumerate(qi.tolist())}
                    col = {v: c for c, v in enumerate(ci.tolist())}
                    cells = [(row[a], col[b]) for a, b in zip(x_q, x_c) if a in row and b in col]
                    cut.append(tuple(np.array(cells, dtype=np.int64).reshape(-1, 2).T))
                rows, cols, scores, place = best_pairs(
                    _normalised(q_vecs, len(qi)), _normalised(c_vecs, len(order))[order], k,
                    cut=tuple(np.concatenate(x) for x in zip(*cut)) if cut else None)
                yield pd.DataFrame({"query_id": qi[rows], "cand_id": ci[cols], "score": scores,
                                    "rank": (place + 1).astype(np.int32)})
    return run


def topk_similar(queries: DataFrame, candidates: DataFrame, k: int, *,
                 query_id: str, query_vec: str, cand_id: str, cand_vec: str,
                 exclude_self: bool = False, exclude: DataFrame | None = None,
                 block_rows: int | None = None,
                 broadcast_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Top ``k`` candidates per query by cosine similarity.

    Returns ``query_id, cand_id, score double, rank int`` (rank is 1-based,
    ordered by score desc then candidate id asc).  Ids must be unique on each
    side.  Null vectors are skipped; zero vectors score 0.  ``exclude_self``
    drops pairs with equal ids (used when a table is matched against itself);
    ``exclude(query_id, cand_id)`` are pairs that do not count: they reach the
    kernel cut by block pair, so no query's list is ever whole in one row."""
    if k <= 0:
        raise ValueError("k must be positive")
    qid_type = queries.schema[query_id].dataType
    cid_type = candidates.schema[cand_id].dataType
    same = candidates is queries and cand_id == query_id
    nq, q_id_bytes = _count(queries, query_id)
    nc, c_id_bytes = (nq, q_id_bytes) if same else _count(candidates, cand_id)
    d = _width(candidates, cand_vec) if nq and nc else 0
    schema = T.StructType([
        T.StructField("query_id", qid_type), T.StructField("cand_id", cid_type),
        T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())])
    spark = queries.sparkSession
    if nq == 0 or nc == 0:
        return spark.createDataFrame([], schema)
    # Blocks stay under MAX_BLOCK_BYTES whatever the width of vectors and ids.
    q_row, c_row = (d * (8 if _element(df, v) == "double" else 4) + -(-b // n) for df, v, b, n in (
        (queries, query_vec, q_id_bytes, nq), (candidates, cand_vec, c_id_bytes, nc)))
    cores = spark.sparkContext.defaultParallelism

    def rows_of(n: int, row: int) -> int:
        limit = max(1, min(block_rows or n, MAX_BLOCK_BYTES // max(1, row)))
        return limit if block_rows else _block_rows(n, limit, cores)
    q_rows, c_rows = rows_of(nq, q_row), rows_of(nc, c_row)
    q_blocks = max(1, math.ceil(nq / q_rows))
    c_blocks = max(1, math.ceil(nc / c_rows))
    qb = _cells(queries, query_id, query_vec, "q_blk", "c_blk", q_blocks, c_blocks, "q")
    cb = _cells(candidates, cand_id, cand_vec, "c_blk", "q_blk", c_blocks, q_blocks, "c")
    # One block against one: no need to sort and merge.
    small = q_blocks == c_blocks == 1 and nc * c_row <= broadcast_bytes
    pairs = qb.join(F.broadcast(cb) if small else cb, ["q_blk", "c_blk"])
    columns = ["q_ids", "q_vecs", "q_dmin", "q_dmax", "c_ids", "c_vecs", "c_dmin", "c_dmax"]
    if exclude is not None:
        def block(c: str, n: int):
            return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        cut = exclude.select(F.col("query_id").cast(qid_type), F.col("cand_id").cast(cid_type)).distinct() \
            .groupBy(block("query_id", q_blocks).alias("q_blk"), block("cand_id", c_blocks).alias("c_blk")) \
            .agg(F.collect_list(F.struct("query_id", "cand_id")).alias("x"))
        pairs = pairs.join(cut, ["q_blk", "c_blk"], "left") \
            .withColumn("x_q", F.col("x.query_id")).withColumn("x_c", F.col("x.cand_id"))
        columns += ["x_q", "x_c"]
    partial = pairs.select(*columns).mapInPandas(_kernel(k, exclude_self), schema)
    row_bytes = q_rows * q_row + c_rows * c_row
    if q_blocks * c_blocks * row_bytes > min(PAIR_BATCH_BYTES, ARROW_BATCH_BYTES):
        # The record limit is read when a plan runs, so the kernel runs here.
        with _arrow_records(spark, row_bytes, PAIR_BATCH_BYTES):
            partial = materialize(partial, "topk")
    if c_blocks == 1:
        return partial
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("cand_id"))
    return (partial.withColumn("rank", F.row_number().over(w).cast("int"))
                   .where(F.col("rank") <= k))


def nearest_one(queries: DataFrame, candidates: DataFrame, **kw) -> DataFrame:
    """Argmax candidate per query (first id on ties) with its score."""
    return topk_similar(queries, candidates, 1, **kw).drop("rank")


def topk_with_attributes(queries: DataFrame, candidates: DataFrame, k: int, *,
                         query_id: str, query_vec: str, cand_id: str, cand_vec: str,
                         cand_cols: list[str] | None = None, **kw) -> DataFrame:
    """``topk_similar`` plus candidate attribute columns joined back by id.

    The attribute join is on the candidate id; it is k rows per query against
    the candidate table, so Spark picks the strategy (AQE broadcasts when the
    candidate table is small)."""
    res = topk_similar(queries, candidates, k, query_id=query_id, query_vec=query_vec,
                       cand_id=cand_id, cand_vec=cand_vec, **kw)
    if not cand_cols:
        return res
    attrs = candidates.select(F.col(cand_id).alias("cand_id"), *cand_cols)
    return res.join(attrs, "cand_id", "left")
