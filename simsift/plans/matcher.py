"""Course matcher over the embedding store: interactive single-course lookup
and the batch evaluation pipeline (truth rows -> outcomes -> hit-rate)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from simsift.functions import scalars as S
from simsift.operators import dedup, filters, matching
from simsift.operators.projection import project
from simsift.operators.topk import topk_with_attributes
from simsift.plans.evaluation import evaluate_matches
from simsift.sources import catalogs

def _variant(keywords: bool) -> str:
    return "keywords" if keywords else "plain"


def home_catalogue(spark: SparkSession, store_root: str, home: tuple[str, str],
                   keywords: bool = False) -> DataFrame:
    """All rows of the home catalogue (institution, years), with ``row_key``: the
    course code and, as codes repeat, the row's place among the rows of its code
    in file order.  Row keys are unique, order like codes, and name the same
    course in every variant of the store."""
    h = catalogs.read_embeddings(spark, store_root, home[0], home[1], _variant(keywords), ordinal="_o")
    code = F.coalesce(F.col("COURSE CODE"), F.lit(""))
    place = F.row_number().over(Window.partitionBy(code).orderBy("_o"))
    return h.withColumn("row_key", F.concat(code, F.lit("\u0001"), F.lpad(place.cast("string"), 10, "0"))).drop("_o")


def _searchable(catalogue: DataFrame, matrix: np.ndarray | None) -> DataFrame:
    c = filters.not_null_vector(catalogue, "embedding")
    return c if matrix is None else project(c, "embedding", matrix)


def find_most_similar(spark: SparkSession, store_root: str, institution: str, years: str,
                      course_code: str, home: tuple[str, str], top_n: int = 10,
                      matrix: np.ndarray | None = None, keywords: bool = False
                      ) -> tuple[DataFrame, DataFrame]:
    """(external course info, top-N rows of the ``home`` catalogue with score,
    course number and confidence band).  Unknown institution/year/course -> two
    empty frames; a home code on several rows is one candidate per row."""
    if top_n <= 0:
        raise ValueError("top_n must be positive")
    names = {k.replace(" ", "-"): v for k, v in S.INSTITUTION_ALIASES.items()} | S.INSTITUTION_ALIASES
    inst = names.get(institution.replace(S.CAMPUS_SUFFIX, ""), institution)
    ext = catalogs.read_embeddings(spark, store_root, inst, years, _variant(keywords), ordinal="_o")
    ext = filters.usable_codes(ext, "COURSE CODE")
    ext = ext.where(F.col("COURSE CODE") == course_code.upper())
    ext = dedup.keep_first(ext, ["COURSE CODE"], ["_o"]).drop("_o") \
               .withColumn("row_id", F.lit(0))
    info = ext.select("COURSE CODE", "COURSE TITLE", "DESCRIPTION")
    if matrix is not None:
        ext = project(ext, "embedding", matrix)
    target = _searchable(home_catalogue(spark, store_root, home, keywords), matrix)
    res = topk_with_attributes(ext, target, top_n, query_id="row_id", query_vec="embedding",
                               cand_id="row_key", cand_vec="embedding",
                               cand_cols=["COURSE CODE", "COURSE TITLE", "DESCRIPTION"])
    res = res.select("COURSE CODE", "COURSE TITLE", "DESCRIPTION",
                     F.col("score").alias("similarity_score"), "rank",
                     S.course_number("COURSE CODE").alias("COURSE NUMBER"),
                     S.confidence_band("score").alias("confidence"))
    return info, res.orderBy("rank")


def evaluation_queries(spark: SparkSession, store_root: str, truth: DataFrame,
                       keywords: bool = False, matrix: np.ndarray | None = None) -> DataFrame:
    """One query vector per truth row: the external store row with the same
    (institution, years, upper-cased code); the first such row is used.
    Institutions go by their folder names (aliases included)."""
    ext = catalogs.read_embeddings(spark, store_root, variant=_variant(keywords), ordinal="_o")
    ext = filters.usable_codes(ext, "COURSE CODE")
    t = truth.select("row_id", S.store_institution("Ext_Inst").alias("_inst"), F.col("Transfer_Year"),
                     F.upper("Ext_Course_Code").alias("_code"))
    # Only store rows some truth row asks for go into the keep-first aggregate
    # (the store covers every institution and year; the truth is far smaller).
    wanted = t.select(F.col("_inst").alias("institution"), F.col("Transfer_Year").alias("years"),
                      F.col("_code").alias("COURSE CODE")).distinct()
    ext = ext.join(wanted, ["institution", "years", "COURSE CODE"], "left_semi")
    ext = dedup.keep_first(ext.select("institution", "years", "COURSE CODE", "embedding", "_o"),
                           ["institution", "years", "COURSE CODE"], ["_o"])
    cond = ((t["_inst"] == ext["institution"]) & (t["Transfer_Year"] == ext["years"])
            & (t["_code"] == ext["COURSE CODE"]))
    q = t.join(ext, cond, "inner").select("row_id", "embedding")
    return q if matrix is None else project(q, "embedding", matrix)


def evaluate(spark: SparkSession, store_root: str, truth: DataFrame, home: tuple[str, str],
             k: int = 20, keywords: bool = False, fusion: str | None = None,
             weights: tuple[float, float] = (0.5, 0.5), matrix: np.ndarray | None = None,
             available: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Outcomes per truth row and hit-rate@i (batch form of the reference's
    per-row loop).

    ``matrix`` projects both sides before the search.  ``available`` has more
    codes (column ``code``) that the home institution offers; together with all
    codes of the home catalogue, with or without a vector, they tell a miss
    (0) from a course that is not offered (-1).  With ``fusion``, a row counts as
    found only if both models have its external course."""
    q1 = evaluation_queries(spark, store_root, truth, keywords, matrix)
    home1 = home_catalogue(spark, store_root, home, keywords)
    offered = home1.select(F.col("COURSE CODE").alias("code"))
    if available is not None:
        offered = offered.unionByName(available.select("code"))
    kw = dict(k=k, row_id="row_id", truth_code="Int_Course_Code", query_vec="embedding",
              cand_id="row_key", cand_vec="embedding", cand_code="COURSE CODE", available=offered)
    if fusion:
        q2 = evaluation_queries(spark, store_root, truth, not keywords, matrix)
        home2 = home_catalogue(spark, store_root, home, not keywords)
        both = q1.select("row_id").join(q2.select("row_id"), "row_id", "left_semi")
        # The candidates' codes come from either variant.
        h1, h2 = _searchable(home1, matrix), _searchable(home2, matrix)
        outcomes = evaluate_matches(truth, q1.join(both, "row_id", "left_semi"), h1, fusion=fusion,
                                    second_queries=q2.join(both, "row_id", "left_semi"),
                                    second_catalogue=h2, weights=weights, **kw)
    else:
        outcomes = evaluate_matches(truth, q1, _searchable(home1, matrix), **kw)
    return outcomes, matching.hit_rate_at_k(outcomes)
