"""Row filters (predicates stay declarative so Catalyst pushes them into the
scan)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simsift.functions import scalars as S


def valid_articulations(df: DataFrame, *, flag: str = "EQUIV_EXISTS",
                        title: str = "EQUI_TITLE", code: str = "EQUIV_CRSE",
                        term: str = "TERM", accepted: str = S.ACCEPTED_FLAG,
                        rejected_title: str = S.REJECTED_TITLE,
                        placeholder_codes: Iterable[str] = S.PLACEHOLDER_CODES,
                        min_term: int = S.MIN_TERM) -> DataFrame:
    """Accepted equivalences: flag set, title not the rejection marker, code
    all ASCII digits and not a placeholder, term at or after ``min_term``.
    Null codes/titles drop out (SQL three-valued logic)."""
    return df.where(
        (F.col(flag) == accepted)
        & (F.col(title) != rejected_title)
        & S.digits_only(code)
        & ~F.col(code).isin(list(placeholder_codes))
        & (F.col(term) >= min_term))


def rejected_articulations(df: DataFrame, *, flag: str = "EQUIV_EXISTS",
                           title: str = "EQUI_TITLE", code: str = "EQUIV_CRSE",
                           term: str = "TERM", accepted: str = S.ACCEPTED_FLAG,
                           rejected_title: str = S.REJECTED_TITLE,
                           min_term: int = S.MIN_TERM) -> DataFrame:
    """Rows whose title is the rejection marker (placeholders are kept)."""
    return df.where(
        (F.col(flag) == accepted)
        & (F.col(title) == rejected_title)
        & S.digits_only(code)
        & (F.col(term) >= min_term))


def institution_in(df: DataFrame, col: str, names: Iterable[str]) -> DataFrame:
    return df.where(F.col(col).isin(list(names)))


def min_text_length(df: DataFrame, col: str, n: int = S.MIN_DESCRIPTION_LENGTH) -> DataFrame:
    """Keep texts strictly longer than ``n`` characters (null dropped)."""
    return df.where(F.length(F.col(col)) > n)


def drop_nulls(df: DataFrame, subset: list[str]) -> DataFrame:
    return df.dropna(subset=subset)


def not_null_vector(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull())


def usable_codes(df: DataFrame, code: str = "COURSE CODE") -> DataFrame:
    """Upper-case the code, drop null and the ``N/A`` placeholder."""
    up = df.withColumn(code, S.upper_code(code))
    return up.where(F.col(code).isNotNull() & (F.col(code) != S.MISSING_CODE))


def contains_filter(df: DataFrame, col: str, pattern: str, regex: bool = False) -> DataFrame:
    return df.where(F.col(col).rlike(pattern) if regex else F.col(col).contains(pattern))
