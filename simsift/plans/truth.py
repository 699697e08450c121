"""Ground-truth tables for the evaluation: from transfer records and from the
equivalence table, in one scan each (no per-institution loop)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from simsift.functions import scalars as S
from simsift.operators import dedup, filters
from simsift.session import materialize

TRUTH_COLUMNS = ["Ext_Inst", "Transfer_Year", "Ext_Course_Code", "Int_Course_Code"]


def truth_from_transfers(transfers: DataFrame, institutions: Iterable[str],
                         year_convention: str = "end") -> DataFrame:
    """Transfer rows of the listed institutions (canonical hyphenated names,
    campus suffix removed first) with the academic year of the term."""
    inst = S.canonical_institution("Institution")
    t = transfers.withColumn("Ext_Inst", inst)
    t = filters.institution_in(t, "Ext_Inst", institutions)
    return t.select(
        "Ext_Inst",
        S.academic_year(S.term_year("Transfer Term"), year_convention).alias("Transfer_Year"),
        S.course_code("Transfer Subject", "Transfer Course").alias("Ext_Course_Code"),
        F.col("OSU Course").alias("Int_Course_Code"))


def clean_articulations(adat: DataFrame, order: list, min_term: int = S.MIN_TERM,
                        renames: Mapping[str, str] | None = None) -> DataFrame:
    """Accepted equivalences, one per (institution, year, external code),
    keeping the first by ``order``: columns of ``adat`` that order its rows
    totally, such as the file ordinal of ``dedup.with_ordinal`` (there is no
    default, because no other column of the table orders it).  ``renames`` maps
    institutions to catalogue folders."""
    if not order:
        raise ValueError("order: keep-first needs a total order of the rows")
    v = filters.valid_articulations(adat, min_term=min_term)
    by = [f"_o{i}" for i in range(len(order))]
    rows = v.select(
        S.catalogue_institution("TRNS_DESCRIPTION", renames or {}).alias("TRNS_DESCRIPTION"),
        S.term_year("TERM").alias("YEAR"),
        S.course_code("TR_SUBJ", "TR_COURSE").alias("EXT COURSE CODE"),
        F.col("TR_TITLE").alias("EXT TITLE"),
        S.course_code("EQUIV_SUBJECT", "EQUIV_CRSE").alias("INT COURSE CODE"),
        F.col("EQUI_TITLE").alias("INT TITLE"),
        *[(F.col(c) if isinstance(c, str) else c).alias(n) for c, n in zip(order, by, strict=True)])
    first = dedup.keep_first(rows, ["TRNS_DESCRIPTION", "YEAR", "EXT COURSE CODE"], by)
    return first.drop(*by)


def truth_from_articulations(adat: DataFrame, order: list, institutions: Iterable[str] | None = None,
                             min_term: int = S.MIN_TERM, year_convention: str = "end") -> DataFrame:
    c = clean_articulations(adat, order, min_term)
    if institutions is not None:
        c = filters.institution_in(c, "TRNS_DESCRIPTION", institutions)
    return c.select(F.col("TRNS_DESCRIPTION").alias("Ext_Inst"),
                    S.academic_year("YEAR", year_convention).alias("Transfer_Year"),
                    F.col("EXT COURSE CODE").alias("Ext_Course_Code"),
                    F.col("INT COURSE CODE").alias("Int_Course_Code"))


def missing_institutions(requested: DataFrame, truth: DataFrame, col: str = "Ext_Inst") -> DataFrame:
    """Requested institutions without any truth row."""
    return requested.join(truth.select(col).distinct(), col, "left_anti")


def all_truth(transfers: DataFrame, adat: DataFrame, institutions: list[str], order: list,
              year_convention: str = "end") -> DataFrame:
    """Both truth sources, with a fixed row id for joining results back."""
    u = truth_from_transfers(transfers, institutions, year_convention).unionByName(
        truth_from_articulations(adat, order, institutions, year_convention=year_convention))
    return with_row_id(u, TRUTH_COLUMNS)


def with_row_id(df: DataFrame, cols: list[str] | None = None, name: str = "row_id") -> DataFrame:
    """Attach a unique row id and write the table once, so the ids stay fixed
    for every later use (``monotonically_increasing_id`` alone could change if
    the plan were recomputed).  No window over duplicates: a row repeated a
    third of the time does not end up in one task."""
    return materialize(df.withColumn(name, F.monotonically_increasing_id()), "rowid")
