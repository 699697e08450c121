"""Projection of embeddings by a learned d x k matrix.

The matrix lives as a DataFrame ``(row_idx int, weights array<double>)`` or as an
array.  One of at most BLOCK_BYTES is brought to the driver and shipped to tasks inside
an Arrow UDF.  A larger table stays in Spark: its tiles are joined to slices of the vectors
(``project_tiles``).  A larger array, which is on the driver already, is multiplied row block
after row block."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simsift.functions import vectors as V
from simsift.operators.topk import _arrow_records
from simsift.session import materialize

BLOCK_BYTES = 512 * 1024 * 1024
TILE = (512, 512)        # rows and columns of a matrix tile: 2 MB of doubles
TILE_VECTORS = 512       # vectors that one tile is multiplied with at a time


def matrix_to_df(spark: SparkSession, m: np.ndarray) -> DataFrame:
    rows = [(int(i), [float(x) for x in row]) for i, row in enumerate(np.asarray(m))]
    return spark.createDataFrame(rows, "row_idx int, weights array<double>")


def _shape(df: DataFrame) -> tuple[int, int]:
    st = df.agg(F.count(F.lit(1)).alias("d"), F.countDistinct("row_idx").alias("i"),
                F.min("row_idx").alias("lo"), F.max("row_idx").alias("hi"),
                F.max(F.size("weights")).alias("k"), F.min(F.size("weights")).alias("kmin")).first()
    d, k = int(st["d"]), int(st["k"] or 0)
    if d and st["kmin"] != k:
        raise ValueError("matrix rows have different widths")
    if d and (st["i"], st["lo"], st["hi"]) != (d, 0, d - 1):
        raise ValueError("matrix row indices must be 0..d-1")
    return d, k


def matrix_blocks(matrix: DataFrame | np.ndarray, max_bytes: int = BLOCK_BYTES):
    """(first row, rows) of consecutive row blocks, each under ``max_bytes``
    (or one row)."""
    d, k = _shape(matrix) if isinstance(matrix, DataFrame) else np.asarray(matrix).shape
    step = max(1, max_bytes // max(1, 8 * k))
    for a in range(0, d, step):
        if isinstance(matrix, DataFrame):
            rows = matrix.where(F.col("row_idx").between(a, a + step - 1)).orderBy("row_idx").collect()
            yield a, np.array([r["weights"] for r in rows], dtype=np.float64).reshape(len(rows), k)
        else:
            yield a, np.asarray(matrix)[a:a + step]


def matrix_from_df(df: DataFrame) -> np.ndarray:
    """A matrix table that fits one block as an array."""
    blocks = list(matrix_blocks(df))
    if len(blocks) > 1:
        raise ValueError(f"a matrix of over {BLOCK_BYTES} bytes stays a table; pass the table itself")
    return blocks[0][1] if blocks else np.zeros((0, 0))


def _times(vec: Column, block: np.ndarray, first: int, d: int, dtype) -> Column:
    elem = T.FloatType() if np.dtype(dtype) == np.float32 else T.DoubleType()
    m = np.ascontiguousarray(block, dtype=dtype)

    @F.arrow_udf(T.ArrayType(elem))
    def product(vs: pa.Array) -> pa.Array:
        ok, rows = V.stack(vs)
        if len(ok) and rows.shape[1] != d:
            raise ValueError(f"vector length {rows.shape[1]} != matrix rows {d}")
        flat = (rows[:, first:first + len(m)].astype(dtype) @ m).ravel() if len(ok) else np.zeros(0, dtype)
        count = np.zeros(len(vs) + 1, np.int32)
        count[1:][ok] = m.shape[1]
        null = np.ones(len(vs) + 1, bool)
        null[ok] = False
        null[-1] = False
        return pa.ListArray.from_arrays(pa.array(np.cumsum(count).astype(np.int32), mask=null), pa.array(flat))
    return product(vec)


def project(df: DataFrame, vec_col: str, matrix: np.ndarray | DataFrame, out_col: str | None = None,
            dtype=np.float32, max_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``out_col = vec_col @ matrix`` in float32 by default (as the
    reference); ``dtype=np.float64`` for a double result.  A vector of the
    wrong length raises; a null vector stays null."""
    d, k = _shape(matrix) if isinstance(matrix, DataFrame) else np.asarray(matrix).shape
    if isinstance(matrix, DataFrame) and 8 * d * k > max_bytes:
        return project_tiles(df, vec_col, matrix, out_col, dtype)
    total = None
    for first, block in matrix_blocks(matrix, max_bytes):
        part = _times(F.col(vec_col), block, first, d, dtype)
        total = part if total is None else F.zip_with(total, part, lambda x, y: x + y)
    if total is None:
        raise ValueError("an empty matrix")
    return df.withColumn(out_col or vec_col, total)


def _free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _tile_products(dtype, row: str):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                s, c, ids, parts, weights = (batch.column(j)[i] for j in range(5))
                left = np.asarray(parts.values, dtype=dtype).reshape(len(ids), -1)
                right = np.asarray(weights.values, dtype=dtype).reshape(left.shape[1], -1)
                out = left @ right
                at = np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]
                yield pa.record_batch([
                    ids.values, pa.array(np.full(len(out), s.as_py(), np.int32)),
                    pa.array(np.full(len(out), c.as_py(), np.int32)),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(out.ravel()))], names=[row, "s", "c", "part"])
    return kernel


def project_tiles(df: DataFrame, vec_col: str, matrix: DataFrame, out_col: str | None = None, dtype=np.float32,
                  tile: tuple[int, int] = TILE, block: int = TILE_VECTORS) -> DataFrame:
    """``project`` with a matrix that is never brought together: blocks of vectors, cut into
    slices, meet the tiles of their matrix rows by a join; the products of a vector's slices
    are added up in the order of the slices.

    ``df`` is written once under the scratch folder, and so are the products.  Matrix rows are
    0..d-1 (checked); rows of ``df`` may repeat; a null vector stays null, one of another
    length raises."""
    spark = df.sparkSession
    d, k = _shape(matrix)
    if not d * k:
        raise ValueError("an empty matrix")
    elem = "float" if np.dtype(dtype) == np.float32 else "double"
    row = _free(df, "_row")
    rows = materialize(df.withColumn(row, F.monotonically_increasing_id()), "project-rows")
    vec = F.col(vec_col).cast("array<double>")
    checked = F.when(F.size(vec) == d, vec).otherwise(
        F.raise_error(F.concat(F.lit("vector length "), F.size(vec), F.lit(f" != matrix rows {d}"))).cast("array<double>"))
    given = rows.where(F.col(vec_col).isNotNull()).select(row, checked.alias("vec"))
    blocks = max(1, math.ceil(given.select(row).count() / block))
    slices, stripes = math.ceil(d / tile[0]), math.ceil(k / tile[1])
    # Few slices would be few tasks: tiles are repeated for groups of blocks.
    groups = min(blocks, math.ceil(2 * spark.sparkContext.defaultParallelism / slices))

    def upto(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    cut = F.slice("vec", F.col("s") * tile[0] + 1, F.lit(tile[0]))
    packed = given.select(row, "vec", F.pmod(F.xxhash64(row), F.lit(blocks)).cast("int").alias("blk"), upto(slices).alias("s")) \
        .select("blk", "s", F.struct(F.col(row), cut.alias("part")).alias("x")) \
        .groupBy("blk", "s").agg(F.collect_list("x").alias("x")) \
        .select("s", F.pmod("blk", F.lit(groups)).alias("g"), F.col("x")[row].alias("ids"),
                F.flatten(F.col("x")["part"]).alias("parts"))
    stripe = F.slice("weights", F.col("c") * tile[1] + 1, F.lit(tile[1]))
    tiles = matrix.select(F.floor(F.col("row_idx") / tile[0]).cast("int").alias("s"), "row_idx", "weights",
                          upto(stripes).alias("c")) \
        .select("s", "c", F.struct("row_idx", stripe.alias("w")).alias("x")) \
        .groupBy("s", "c").agg(F.flatten(F.array_sort(F.collect_list("x"))["w"]).alias("weights")) \
        .select("s", "c", "weights", upto(groups).alias("g"))
    met = packed.join(tiles, ["s", "g"]).select("s", "c", "ids", "parts", "weights")
    with _arrow_records(spark, 8 * (tile[0] * tile[1] + block * (tile[0] + 1))):
        products = materialize(met.mapInArrow(
            _tile_products(dtype, row), f"`{row}` long, s int, c int, part array<{elem}>"), "project-products")
    ordered = F.array_sort(F.collect_list(F.struct("s", "part")))
    zero = F.array_repeat(F.lit(0).cast(elem), F.size(F.col("p")[0]["part"]))
    # Both groupings use the one exchange by row.
    sums = products.repartition(row).groupBy(row, "c").agg(ordered.alias("p")) \
        .select(row, F.struct("c", F.aggregate("p", zero, lambda done, x: F.zip_with(
            done, x["part"], lambda a, b: a + b)).alias("v")).alias("x")) \
        .groupBy(row).agg(F.flatten(F.array_sort(F.collect_list("x"))["v"]).alias("v"))
    sums = sums.select(F.col(row).alias("r"), F.col("v").alias(_free(rows, "_v")))
    joined = rows.join(sums, rows[row] == sums["r"], "left").drop(sums["r"])
    return joined.withColumn(out_col or vec_col, F.col(sums.columns[1])).drop(row, sums.columns[1])


def project_pairs(df: DataFrame, matrix: np.ndarray | DataFrame, cols=("text_1_embedding", "text_2_embedding"),
                  suffix: str = "_custom", score: str = "cosine_similarity_custom",
                  dtype=np.float32) -> DataFrame:
    """Project both vector columns and recompute their cosine."""
    out = df
    for c in cols:
        out = project(out, c, matrix, f"{c}{suffix}", dtype)
    return out.withColumn(score, V.cosine_batch(f"{cols[0]}{suffix}", f"{cols[1]}{suffix}"))


def pair_cosine(df: DataFrame, a: str = "text_1_embedding", b: str = "text_2_embedding",
                out: str = "cosine_similarity", zero: str = "null") -> DataFrame:
    """Cosine per pair on Arrow batches (zero vector -> null, or 0 with
    ``zero="zero"``)."""
    c = V.cosine_batch(a, b)
    if zero == "zero":
        c = F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.coalesce(c, F.lit(0.0)))
    return df.withColumn(out, c)


def fold_matrix(d: int, k: int) -> np.ndarray:
    """A fixed d x k matrix that sums coordinates i, i+k, i+2k ... into output
    i (a parameter rule, used as the test projection)."""
    m = np.zeros((d, k))
    m[np.arange(d), np.arange(d) % k] = 1.0
    return m
