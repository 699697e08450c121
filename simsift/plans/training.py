"""Pair building and projection training over the course schema.

catalogues + equivalences -> composite (optionally keyword) texts ->
positive pairs; rejected equivalences -> nearest home course as negatives ->
embeddings through the cache -> 72/8/20 split -> fitted projection."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simsift.functions import scalars as S
from simsift.operators import embed, filters, keywords, learn, pairs, split
from simsift.plans import truth
from simsift.session import materialize


def course_texts(catalogue: DataFrame, use_keywords: bool = False,
                 min_length: int | None = S.MIN_DESCRIPTION_LENGTH,
                 doc_id: str = "_doc") -> DataFrame:
    """Adds ``text`` = lower(code, title, description) with ``*``/``+``
    removed; with ``use_keywords`` the description is first replaced by its
    RAKE keyword text.  Rows with a short or null description are dropped."""
    df = catalogue
    if min_length is not None:
        df = filters.min_text_length(df, "DESCRIPTION", min_length)
    if use_keywords:
        # Equal descriptions share one keyword text, computed once: repeats of a
        # course (other years, other institutions) must not mix their tokens.
        df = df.withColumn(doc_id, F.sha2("DESCRIPTION", 256))
        texts = df.select(doc_id, "DESCRIPTION").where(F.col(doc_id).isNotNull()).dropDuplicates([doc_id])
        kw = keywords.rake_keywords(texts, "DESCRIPTION", doc_id, out="_kw")
        df = df.join(kw, doc_id, "left").withColumn("DESCRIPTION", F.col("_kw")) \
               .drop("_kw", doc_id)
    text = S.clean_markup(S.composite_text("COURSE CODE", "COURSE TITLE", "DESCRIPTION"))
    return df.withColumn("text", text).where(F.col("text").isNotNull())


def build_pairs(articulations: DataFrame, external: DataFrame, internal: DataFrame,
                cache_path: str, embedder: embed.Embedder | None = None,
                use_keywords: bool = False, min_term: int = S.MIN_TERM, *, order: list,
                renames: Mapping[str, str] = S.INSTITUTION_RENAMES) -> DataFrame:
    """Labelled, embedded pairs: positives from accepted equivalences and, for
    every rejected equivalence, its nearest home course as a negative.
    ``order`` orders the equivalences (keep-first)."""
    clean = truth.clean_articulations(articulations, order, min_term=min_term, renames=renames)
    rejected = filters.rejected_articulations(articulations, min_term=min_term)
    # Keyword text and embeddings only for catalogue rows some equivalence uses.
    used = clean.select(F.col("TRNS_DESCRIPTION").alias("INSTITUTION"),
                        F.col("EXT COURSE CODE").alias("COURSE CODE"), "YEAR").unionByName(
        rejected.select(S.catalogue_institution("TRNS_DESCRIPTION", renames).alias("INSTITUTION"),
                        S.course_code("TR_SUBJ", "TR_COURSE").alias("COURSE CODE"),
                        S.term_year("TERM").alias("YEAR"))).distinct()
    ext = external.withColumn("INSTITUTION", S.catalogue_institution("INSTITUTION", renames)) \
                  .join(used, ["INSTITUTION", "YEAR", "COURSE CODE"], "left_semi")
    ext = course_texts(ext, use_keywords)
    intl = course_texts(internal, use_keywords, min_length=None)
    pos = pairs.positive_pairs(
        clean, ext, intl,
        ext_keys=[("TRNS_DESCRIPTION", "INSTITUTION"), ("YEAR", "YEAR"),
                  ("EXT COURSE CODE", "COURSE CODE")],
        int_key=("INT COURSE CODE", "COURSE CODE"), ext_text="text", int_text="text")
    rej = rejected.select(
        S.catalogue_institution("TRNS_DESCRIPTION", renames).alias("inst"),
        S.term_year("TERM").alias("year"),
        S.course_code("TR_SUBJ", "TR_COURSE").alias("code"), "TERM", "EQUIV_CRSE")
    rej = truth.with_row_id(rej, ["inst", "year", "code", "TERM", "EQUIV_CRSE"])
    rej = rej.join(ext.select(F.col("INSTITUTION").alias("inst"), F.col("YEAR").alias("year"),
                              F.col("COURSE CODE").alias("code"), "text"),
                   ["inst", "year", "code"], "inner")
    rej = embed.embed_with_cache(rej, ["text"], cache_path, embedder)
    # The nearest home text, whatever courses share it.
    home = embed.embed_with_cache(intl.select("text").distinct().withColumn("text_id", embed.text_key("text")),
                                  ["text"], cache_path, embedder)
    neg = pairs.rejected_negatives(rej, home, row_id="row_id", text="text",
                                   vec="text_embedding", home_id="text_id",
                                   home_text="text", home_vec="text_embedding")
    # Written once: the search would otherwise run for every use of the pairs.
    neg = materialize(neg.select("text_1", "text_2", "label"), "rejected")
    all_pairs = pos.unionByName(neg)
    return embed.embed_with_cache(all_pairs, ["text_1", "text_2"], cache_path, embedder)


def split_with_random_negatives(positives: DataFrame, test: float = 0.2,
                                seed: int = 123) -> DataFrame:
    """First trainer's flow: positives are split train/test first, then each
    split gets as many random negatives as it has positives, drawn only from
    its own texts (no text leaks across the split)."""
    keyed = truth.with_row_id(positives.select("text_1", "text_2", "label"), name="pair_id")
    parts = split.stratified_split(keyed, "label", ["pair_id"], test, seed)
    out = None
    for name in ("train", "test"):
        pos = parts.where(F.col("dataset") == name).select("text_1", "text_2", "label")
        neg = pairs.random_negatives(pos, seed=seed)
        both = pos.unionByName(neg).withColumn("dataset", F.lit(name))
        out = both if out is None else out.unionByName(both)
    return out


def hard_negative_pairs(positives: DataFrame, cache_path: str,
                        embedder: embed.Embedder | None = None) -> DataFrame:
    """Second trainer's negatives: for each distinct ``text_1``, the most
    similar distinct ``text_2`` that is not one of its positives (label -1).
    Texts are searched by key, not as ids, so blocks hold keys and vectors."""
    pos = positives.select("text_1", "text_2").distinct()
    q = embed.embed_with_cache(pos.select("text_1").distinct(), ["text_1"], cache_path, embedder)
    c = embed.embed_with_cache(pos.select("text_2").distinct(), ["text_2"], cache_path, embedder)
    q = materialize(q.withColumn("key_1", embed.text_key("text_1")), "hard")
    c = materialize(c.withColumn("key_2", embed.text_key("text_2")), "hard")
    hn = pairs.hard_negatives(
        q, c, pos.select(embed.text_key("text_1").alias("p1"), embed.text_key("text_2").alias("p2")),
        query_id="key_1", query_vec="text_1_embedding", cand_id="key_2",
        cand_vec="text_2_embedding", pos_query="p1", pos_cand="p2")
    return hn.join(q.select(F.col("key_1").alias("query_id"), "text_1"), "query_id") \
             .join(c.select(F.col("key_2").alias("cand_id"), "text_2"), "cand_id") \
             .select("text_1", "text_2", F.lit(-1).alias("label"))


def train(pairs_df: DataFrame, cfg: learn.FitConfig | None = None) -> learn.FitResult:
    """72/8/20 split by label, then the projection fit."""
    keyed = truth.with_row_id(pairs_df, name="pair_id")
    data = split.three_way_split(keyed, "label", ["pair_id", "text_1", "text_2"])
    return learn.fit_projection(data, cfg or learn.FitConfig(**learn.V3_CONFIG),
                                id_cols=["pair_id"])
