"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simsift.session import materialize

__all__ = ["SMALL_BYTES", "SMALL_ROWS", "is_small", "materialize", "semi", "anti", "small_bytes"]

#: A key table of at most so many rows (two or three longs each, so well under
#: 100 MB) may be broadcast; beyond it the same join shuffles.
SMALL_ROWS = 2_000_000


#: A table of at most so many bytes, as measured on its rows, may be broadcast.
SMALL_BYTES = 64 << 20


def small_bytes(table: DataFrame, limit: int = SMALL_BYTES) -> bool:
    """Whether a written table is within the broadcast bound in bytes: 16 for each
    row and 8 for each fixed-width value, the bytes of strings, and the JSON text of
    nested values."""
    size = F.lit(16)
    for field in table.schema:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            size = size + 8 + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = size + 24 + 8 * F.coalesce(F.octet_length(F.to_json(F.struct(field.name))), F.lit(0))
        else:
            size = size + 8
    return (table.agg(F.sum(size.cast("long"))).first()[0] or 0) <= limit


def is_small(table: DataFrame) -> bool:
    """Whether a written table is within the broadcast bound (a counted size)."""
    return table.count() <= SMALL_ROWS


def _keyed(rows: DataFrame, keys: DataFrame, on: str, how: str) -> DataFrame:
    keys = keys.select(on).distinct()
    return rows.join(F.broadcast(keys) if is_small(keys) else keys, on, how)


def semi(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose ``on`` is in ``keys`` (a written table)."""
    return _keyed(rows, keys, on, "left_semi")


def anti(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose ``on`` is not in ``keys`` (a written table); null stays."""
    return _keyed(rows, keys, on, "left_anti")
