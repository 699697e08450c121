"""Vector column functions on ``array<float|double>`` columns.

These are native higher-order expressions (``zip_with`` / ``aggregate`` /
``transform``) and run inside the JVM.  The heavy many-to-many kernel lives
in ``simsift.operators.topk`` and works on numpy blocks instead."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def norm(a: ColumnOrName) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0).cast("double"),
                              lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: ColumnOrName, b: ColumnOrName, zero: str = "null") -> Column:
    """dot(a,b) / (|a||b|), clamped to [-1, 1].

    ``zero`` chooses the result when either vector has zero norm:
    ``"null"`` (numpy NaN, mapped to SQL null) or ``"zero"`` (the library
    convention used for search)."""
    denom = norm(a) * norm(b)
    raw = F.try_divide(dot(a, b), F.when(denom == 0, F.lit(None)).otherwise(denom))
    # greatest/least skip nulls, so the clamp must not touch a null result.
    clamped = F.when(raw.isNull(), F.lit(None).cast("double")) \
               .otherwise(F.least(F.greatest(raw, F.lit(-1.0)), F.lit(1.0)))
    if zero == "zero":
        return F.when(_c(a).isNull() | _c(b).isNull(), F.lit(None).cast("double")) \
                .otherwise(F.coalesce(clamped, F.lit(0.0)))
    return clamped


def prefix(a: ColumnOrName, dims: int) -> Column:
    """The first ``dims`` components (a fixed projection onto a subspace)."""
    return F.slice(_c(a), 1, dims)


def to_double(a: ColumnOrName) -> Column:
    return F.transform(_c(a), lambda x: x.cast("double"))


def stack(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are not null, their vectors as one double matrix): the flat
    values of an Arrow list column, reshaped.  Vectors must be of one length."""
    ok = np.flatnonzero(np.asarray(lists.is_valid()))
    sizes = pc.list_value_length(lists).drop_null().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors of different lengths")
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return ok, flat.reshape(len(ok), -1) if len(ok) else np.zeros((0, 0))


@F.arrow_udf(T.DoubleType())
def _cosine_batch(a: pa.Array, b: pa.Array) -> pa.Array:
    both = pc.and_(a.is_valid(), b.is_valid())
    out = np.full(len(a), np.nan)
    _, A = stack(a.filter(both))
    _, B = stack(b.filter(both))
    if A.shape != B.shape:
        raise ValueError("vectors of different lengths")
    if len(A):
        den = np.linalg.norm(A, axis=1) * np.linalg.norm(B, axis=1)
        num = np.einsum("ij,ij->i", A, B)
        with np.errstate(divide="ignore", invalid="ignore"):
            out[np.asarray(both)] = np.where(den == 0, np.nan, np.clip(num / den, -1.0, 1.0))
    return pa.array(out, mask=np.isnan(out))


def cosine_batch(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Same result as :func:`cosine` (``zero="null"``), computed on Arrow
    batches with numpy.  Spark has no native vector functions and its
    higher-order functions are not code-generated, so for wide vectors over
    many rows this batch form is the fast path."""
    return _cosine_batch(_c(a), _c(b))
