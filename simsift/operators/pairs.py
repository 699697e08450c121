"""Labelled text pairs: positives from accepted equivalences, negatives that
are random, hard (nearest non-positive) or taken from rejected records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simsift.session import materialize

from simsift.operators import split
from simsift.operators.topk import topk_similar


def positive_pairs(articulations: DataFrame, external: DataFrame, internal: DataFrame, *,
                   ext_keys: list[tuple[str, str]], int_key: tuple[str, str],
                   ext_text: str, int_text: str, keep_left: bool = False) -> DataFrame:
    """articulation x external catalogue (on ``ext_keys`` pairs of
    articulation/catalogue columns) x internal catalogue (on ``int_key``);
    duplicate internal codes fan out.  Rows without both texts are dropped,
    so the left joins of the reference reduce to inner joins."""
    how = "left" if keep_left else "inner"
    ext = external.select(*[F.col(c).alias(f"_e{i}") for i, (_, c) in enumerate(ext_keys)],
                          F.col(ext_text).alias("text_1"))
    cond = [articulations[a] == ext[f"_e{i}"] for i, (a, _) in enumerate(ext_keys)]
    j1 = articulations.join(ext, cond, how)
    intl = internal.select(F.col(int_key[1]).alias("_ik"), F.col(int_text).alias("text_2"))
    j2 = j1.join(intl, j1[int_key[0]] == intl["_ik"], how)
    return (j2.where(F.col("text_1").isNotNull() & F.col("text_2").isNotNull())
              .select("text_1", "text_2", F.lit(1).alias("label")))


def random_negatives(positives: DataFrame, n: int | None = None, seed: int = 123,
                     symmetric: bool = True) -> DataFrame:
    """``n`` (default: number of positives) distinct unordered pairs of texts
    from the positives that are not themselves positive, label -1.

    The T distinct texts are put in seeded hash order (index 0 .. T-1).  All
    unordered pairs have a number p: distance d = p div T + 1 and first index
    i = p mod T give the pair (i, i + d mod T).  Among the first n + E numbers
    at most E can be positives (E = number of positives), so these hold n
    negatives, and the first n of them are the result: one pass, linear in
    n + E, never all T^2/2 pairs, and never a short sample.  Every text takes
    part about equally often.  ``symmetric=False`` keeps the reference's
    behaviour of excluding a positive only in its stored orientation."""
    spark = positives.sparkSession
    positives = materialize(positives.select("text_1", "text_2"), "pairs")
    texts = (positives.select(F.col("text_1").alias("text"))
             .unionByName(positives.select(F.col("text_2").alias("text")))
             .where(F.col("text").isNotNull()).distinct()
             .withColumn("_h", split.hash_order(seed, "text"))
             .withColumn("_hn", split.hash_number(F.col("_h"))))
    texts = materialize(texts, "pairs")
    t = texts.count()
    a, b = F.col("text_1"), F.col("text_2")
    low, high = (F.least(a, b), F.greatest(a, b)) if symmetric else (a, b)
    excl = materialize(positives.where(a.isNotNull() & b.isNotNull())
                       .select(low.alias("a"), high.alias("b")).distinct(), "pairs")
    sizes = positives.agg(F.count(F.lit(1)).alias("n")).first()
    n = sizes["n"] if n is None else n
    if n == 0:
        return spark.createDataFrame([], "text_1 string, text_2 string, label int")
    if t < 2:
        raise ValueError("need at least two distinct texts")
    all_pairs = t * (t - 1) // 2
    taken = excl.where(F.col("a") < F.col("b")).count()
    if n > all_pairs - taken:
        raise ValueError(f"cannot draw {n} negatives from {all_pairs - taken} candidate pairs")
    texts = split.exact_rank(texts, "_hn", [], ["_h", "text"], name="idx", persist_input=False,
                             uniform_range=split.HASH_RANGE).select(
        (F.col("idx") - 1).alias("idx"), "text")
    texts = materialize(texts, "pairs")
    drawn = spark.range(min(all_pairs, n + taken)).select(
        F.col("id").alias("p"), F.expr(f"id % {t}").alias("i"),
        F.expr(f"(id % {t} + id div {t} + 1) % {t}").alias("j"))
    one = texts.select(F.col("idx").alias("i"), F.col("text").alias("x"))
    two = texts.select(F.col("idx").alias("j"), F.col("text").alias("y"))
    negatives = (drawn.join(one, "i").join(two, "j")
                 .select("p", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
                 .join(excl, ["a", "b"], "left_anti"))
    negatives = split.exact_rank(negatives, "p", [], [], name="_r",
                                 uniform_range=min(all_pairs, n + taken))
    return negatives.where(F.col("_r") <= n).select(
        F.col("a").alias("text_1"), F.col("b").alias("text_2"), F.lit(-1).alias("label"))


def hard_negatives(queries: DataFrame, candidates: DataFrame, positives: DataFrame, *,
                   query_id: str, query_vec: str, cand_id: str, cand_vec: str,
                   pos_query: str, pos_cand: str, exclude_self: bool = False) -> DataFrame:
    """For each query, the most similar candidate that is not one of its
    positives (``query_id, cand_id, score``).

    The positives are left out inside the block kernel, so one search with
    k = 1 is exact however many positives a query has.  A query whose positives
    are all candidates has no row."""
    pos = positives.select(F.col(pos_query).alias("query_id"), F.col(pos_cand).alias("cand_id"))
    return topk_similar(queries, candidates, 1, query_id=query_id, query_vec=query_vec,
                        cand_id=cand_id, cand_vec=cand_vec, exclude_self=exclude_self,
                        exclude=pos).drop("rank")


def rejected_negatives(rejected: DataFrame, home: DataFrame, *, row_id: str, text: str,
                       vec: str, home_id: str, home_text: str, home_vec: str) -> DataFrame:
    """For every rejected row (duplicates kept), its nearest home course:
    ``text_1`` = rejected text, ``text_2`` = nearest home text, label -1."""
    r = topk_similar(rejected, home, 1, query_id=row_id, query_vec=vec, cand_id=home_id,
                     cand_vec=home_vec)
    left = rejected.select(F.col(row_id).alias("query_id"), F.col(text).alias("text_1"))
    right = home.select(F.col(home_id).alias("cand_id"), F.col(home_text).alias("text_2"))
    return (r.join(left, "query_id").join(right, "cand_id")
             .select("query_id", "text_1", "text_2", "score", F.lit(-1).alias("label")))
