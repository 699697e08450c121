"""Keep-first de-duplication and the code -> title index.

``dropDuplicates(subset)`` keeps an arbitrary row; the reference keeps the
first in file order, so every function here takes an explicit total order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per ``keys``: the first by ``order`` (columns or names).

    Implemented as ``min_by(struct(all), struct(order))`` in one hash
    aggregate: partial aggregation runs map-side, so a hot key is reduced
    before the shuffle instead of landing whole in one sorted window task."""
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    others = [c for c in df.columns if c not in keys]
    if not others:
        return df.select(*keys).distinct()
    packed = (df.groupBy(*keys)
                .agg(F.min_by(F.struct(*others), F.struct(*order_cols)).alias("_first")))
    return packed.select(*keys, *[F.col("_first")[c].alias(c) for c in others])


def with_ordinal(df: DataFrame, name: str = "_ordinal") -> DataFrame:
    """Attach the position of each row in its source file (Parquet row index
    plus file path), usable as the ``order`` of :func:`keep_first`."""
    return df.withColumn(name, F.struct(F.col("_metadata.file_path"),
                                        F.col("_metadata.row_index")))


def course_index(df: DataFrame, code: str = "COURSE CODE", title: str = "COURSE TITLE", *,
                 order: list) -> DataFrame:
    """One title per code, ordered by code: the title of the code's last row by
    ``order`` (a total order of the rows, such as :func:`with_ordinal`)."""
    key = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    return (df.where(F.col(code).isNotNull())
              .groupBy(code).agg(F.max_by(F.struct(title), key).alias("_last"))
              .select(code, F.col("_last")[title].alias(title)).orderBy(code))

