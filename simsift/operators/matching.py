"""Ranking fusion, truth matching, match outcomes and hit-rate@i.

All functions are set-based: one plan evaluates every truth row at once
instead of a per-row search loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from simsift.functions import scalars as S


def rerank(df: DataFrame, score: str, *, query: str = "row_id", code: str = "code",
           name: str = "rank") -> DataFrame:
    """1-based position per query after sorting by score desc, code asc."""
    w = Window.partitionBy(query).orderBy(F.desc(score), F.asc(code))
    return df.withColumn(name, F.row_number().over(w).cast("int"))


def fuse_mean(r1: DataFrame, r2: DataFrame, *, query: str = "row_id",
              code: str = "code", score: str = "score") -> DataFrame:
    """Inner join of two rankings on (query, code); mean score; re-ranked.

    Only codes found by both models survive (at most min(k1, k2) per query)."""
    a = r1.select(query, code, F.col(score).alias("score_1"), F.col("rank").alias("rank_1"))
    b = r2.select(query, code, F.col(score).alias("score_2"), F.col("rank").alias("rank_2"))
    fused = a.join(b, [query, code], "inner") \
             .withColumn(score, (F.col("score_1") + F.col("score_2")) / 2)
    return rerank(fused, score, query=query, code=code)


def fuse_weighted(r1: DataFrame, r2: DataFrame, w1: float = 0.5, w2: float = 0.5, *,
                  query: str = "row_id", code: str = "code", score: str = "score") -> DataFrame:
    """Full outer join on (query, code); a missing score counts as 0; weights
    are not renormalised.  Reports fused rank and each model's rank."""
    a = r1.select(query, code, F.col(score).alias("score_1"), F.col("rank").alias("rank_1"))
    b = r2.select(query, code, F.col(score).alias("score_2"), F.col("rank").alias("rank_2"))
    fused = a.join(b, [query, code], "full").withColumn(
        score, w1 * S.fill_zero("score_1") + w2 * S.fill_zero("score_2"))
    return rerank(fused, score, query=query, code=code)


def first_match(truth: DataFrame, ranked: DataFrame, *, row_id: str = "row_id",
                truth_code: str = "Int_Course_Code", code: str = "code",
                strip_suffix: bool = True) -> DataFrame:
    """For each truth row, the best-ranked candidate whose code (optionally
    with its trailing letters removed) equals the truth code.

    Returns ``row_id, matched_code, match_rank, match_score``."""
    cand = ranked.select(row_id, F.col(code).alias("_code"), "rank", "score")
    if strip_suffix:
        cand = cand.withColumn("_code", S.strip_code_suffix("_code"))
    t = truth.select(row_id, F.col(truth_code).alias("_truth"))
    hits = cand.join(t, (cand[row_id] == t[row_id]) & (cand["_code"] == t["_truth"]), "inner") \
               .select(cand[row_id], "_code", "rank", "score")
    best = hits.groupBy(row_id).agg(
        F.min_by(F.struct("_code", "rank", "score"), F.col("rank")).alias("_m"))
    return best.select(row_id, F.col("_m._code").alias("matched_code"),
                       F.col("_m.rank").alias("match_rank"),
                       F.col("_m.score").alias("match_score"))


def match_outcomes(truth: DataFrame, ranked: DataFrame, catalogue_codes: DataFrame,
                   queried: DataFrame, *, row_id: str = "row_id",
                   truth_code: str = "Int_Course_Code", code: str = "code",
                   catalogue_code: str = "code", strip_suffix: bool = True) -> DataFrame:
    """Truth rows plus the match outcome.

    ``match`` is 1 when the truth code is among the ranked candidates
    (``row_number`` = its 1-based rank, ``similar_courses_row_number`` =
    rank - 1, ``similarity_score``), 0 when it is not but exists in the
    catalogue, -1 when the external course was not found (``queried`` lacks
    the row) or the truth code is not in the catalogue; ``reason`` tells the
    two -1 cases apart."""
    hits = first_match(truth, ranked, row_id=row_id, truth_code=truth_code, code=code,
                       strip_suffix=strip_suffix)
    codes = catalogue_codes.select(F.col(catalogue_code).alias("_cat")).distinct() \
                           .withColumn("_in_cat", F.lit(True))
    q = queried.select(row_id).distinct().withColumn("_searched", F.lit(True))
    out = (truth.join(hits, row_id, "left")
                .join(q, row_id, "left")
                .join(codes, F.col(truth_code) == F.col("_cat"), "left"))
    found = F.col("match_rank").isNotNull()
    searched = F.coalesce(F.col("_searched"), F.lit(False))
    in_cat = F.coalesce(F.col("_in_cat"), F.lit(False))
    # A row that was not searched cannot be a hit, whatever was ranked for it.
    match = (F.when(~searched, -1).when(found, 1).when(in_cat, 0).otherwise(-1)).cast("int")
    reason = (F.when(~searched, "external_not_found").when(found, "hit")
               .when(in_cat, "miss").otherwise("truth_not_in_catalogue"))
    def of_hit(c):
        return F.when(searched, c)
    return out.select(
        *truth.columns,
        of_hit(F.col("matched_code")).alias("OSU_Course_Code"),
        of_hit(F.col("match_rank")).cast("int").alias("row_number"),
        match.alias("match"),
        of_hit(F.col("match_rank") - 1).cast("int").alias("similar_courses_row_number"),
        of_hit(F.col("match_score")).alias("similarity_score"),
        reason.alias("reason"))


def hit_rate_at_k(outcomes: DataFrame, *, match: str = "match",
                  rank: str = "row_number") -> DataFrame:
    """``top_i, hits, n, hit_rate`` for i = 1..max rank, over rows with
    match != -1; hit_rate = round(100 * count(rank <= i) / n, 2).

    The rank histogram has at most k rows, so the cumulative window over it is
    bounded by k, not by the data."""
    valid = outcomes.where(F.col(match) != -1)
    stats = valid.agg(F.count(F.lit(1)).alias("n"), F.max(rank).alias("_max"))
    hist = valid.where(F.col(rank).isNotNull()).groupBy(F.col(rank).alias("top_i")) \
                .agg(F.count(F.lit(1)).alias("_c"))
    grid = stats.where(F.col("_max").isNotNull()) \
                .select("n", F.explode(F.sequence(F.lit(1), F.col("_max"))).alias("top_i"))
    w = Window.orderBy("top_i").rowsBetween(Window.unboundedPreceding, 0)
    cum = grid.join(F.broadcast(hist), "top_i", "left") \
              .withColumn("hits", F.sum(F.coalesce(F.col("_c"), F.lit(0))).over(w))
    return cum.select(F.col("top_i").cast("int").alias("top_i"),
                      F.col("hits").cast("long").alias("hits"),
                      F.col("n").cast("long").alias("n"),
                      S.round_pct("hits", "n").alias("hit_rate"))
