"""Batch evaluation of the matcher (one plan for all truth rows).

truth rows -> their external vectors -> top-k home candidates (optionally
two models fused) -> first candidate equal to the truth code -> outcome per
row -> hit-rate@i."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simsift.operators import matching as M
from simsift.operators.topk import topk_similar


def rank_codes(queries: DataFrame, catalogue: DataFrame, k: int, *, row_id: str,
               query_vec: str, cand_id: str, cand_vec: str, cand_code: str | None = None,
               exclude_self: bool = False, **kw) -> DataFrame:
    """``row_id, cand_id, code, score, rank``: top-k candidates with their code."""
    r = topk_similar(queries, catalogue, k, query_id=row_id, query_vec=query_vec,
                     cand_id=cand_id, cand_vec=cand_vec, exclude_self=exclude_self, **kw)
    r = r.withColumnRenamed("query_id", row_id)
    if cand_code is None or cand_code == cand_id:
        return r.withColumn("code", F.col("cand_id"))
    codes = catalogue.select(F.col(cand_id).alias("cand_id"), F.col(cand_code).alias("code"))
    return r.join(codes, "cand_id", "left")


def evaluate_matches(truth: DataFrame, queries: DataFrame, catalogue: DataFrame, *,
                     k: int = 20, row_id: str = "row_id",
                     truth_code: str = "Int_Course_Code", query_vec: str = "embedding",
                     cand_id: str = "COURSE CODE", cand_vec: str = "embedding",
                     cand_code: str | None = None, strip_suffix: bool = True,
                     exclude_self: bool = False, fusion: str | None = None,
                     second_queries: DataFrame | None = None,
                     second_catalogue: DataFrame | None = None,
                     weights: tuple[float, float] = (0.5, 0.5),
                     available: DataFrame | None = None, **kw) -> DataFrame:
    """Match outcomes for every truth row.

    ``cand_id`` must be unique in the catalogue (course codes need not be; they
    are ``cand_code``).  ``available`` has the codes (column ``code``) against
    which a miss is told from a course that is not offered; by default those of
    ``catalogue``.

    ``queries`` holds (``row_id``, ``query_vec``) for the truth rows whose
    external course was found; ``fusion`` = ``"mean"`` (inner) or
    ``"weighted"`` (full outer) combines a second model given by
    ``second_queries``/``second_catalogue``."""
    code_col = cand_code or cand_id
    ranked = rank_codes(queries, catalogue, k, row_id=row_id, query_vec=query_vec,
                        cand_id=cand_id, cand_vec=cand_vec, cand_code=cand_id,
                        exclude_self=exclude_self, **kw)
    if fusion:
        ranked2 = rank_codes(second_queries, second_catalogue, k, row_id=row_id,
                             query_vec=query_vec, cand_id=cand_id, cand_vec=cand_vec,
                             cand_code=cand_id, exclude_self=exclude_self, **kw)
        # Rankings are fused on candidate identity; codes are attached after.
        if fusion == "mean":
            ranked = M.fuse_mean(ranked, ranked2, query=row_id, code="cand_id")
        elif fusion == "weighted":
            ranked = M.fuse_weighted(ranked, ranked2, *weights, query=row_id, code="cand_id")
        else:
            raise ValueError(f"unknown fusion {fusion!r}")
    if code_col == cand_id:
        ranked = ranked.withColumn("code", F.col("cand_id"))
    else:
        codes = catalogue.select(F.col(cand_id).alias("cand_id"), F.col(code_col).alias("code"))
        if second_catalogue is not None:
            # A fused candidate may be in the second catalogue only.
            codes = codes.unionByName(second_catalogue.select(
                F.col(cand_id).alias("cand_id"), F.col(code_col).alias("code"))).dropDuplicates(["cand_id"])
        ranked = ranked.drop("code").join(codes, "cand_id", "left")
    if available is None:
        available = catalogue.select(F.col(code_col).alias("code"))
    return M.match_outcomes(truth, ranked, available.select("code"),
                            queries.select(row_id), row_id=row_id, truth_code=truth_code,
                            code="code", strip_suffix=strip_suffix)
