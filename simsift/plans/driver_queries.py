"""Registered queries over the driver's tables, each with its DuckDB oracle.

Every query reads whole tables (or data Spark derives from them).  Floats
are rounded to 6 digits on both sides so the order-insensitive hash compare
is stable across engines."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simsift import sql
from simsift.functions import scalars as S
from simsift.functions import vectors as V
import numpy as np

from simsift.operators import dedup, embed, filters, keywords, learn, matching, metrics, pairs
from simsift.operators import pivots, projection, signatures, split
from simsift.operators.topk import nearest_one, topk_similar
from simsift.plans import evaluation, training, truth
from simsift.plans.tables import (articulation_view, external_catalogue, internal_catalogue,
                                  table, vectors)
from simsift.session import materialize, scratch_table_path
from simsift.sources import catalogs

TOP_K = 10          # interactive matcher / fused paths
EVAL_K = 20         # single-model evaluation path
DIMS = 64           # width of the given vectors
SECOND_DIMS = 32    # second "model": all dimensions folded onto 32
MIN_TERM = 199700   # the data's ship dates span 1995-2001; the cut keeps 1997 on

Query = Callable[[SparkSession, str], DataFrame]


def _r(c, digits: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# --------------------------------------------------------------------------
# top-k matching family


def _fold(df, k):
    return projection.project(df, "embedding", projection.fold_matrix(DIMS, k), dtype=np.float64)


def _neighbours(spark, sf, k=TOP_K, fold=None):
    e = vectors(spark, sf)
    if fold:
        e = _fold(e, fold)
    return topk_similar(e, e, k, query_id="vec_id", query_vec="embedding",
                        cand_id="vec_id", cand_vec="embedding", exclude_self=True)


def q_topk_match(spark, sf):
    r = _neighbours(spark, sf)
    lab = vectors(spark, sf).select(F.col("vec_id").alias("cand_id"),
                                    F.col("label").alias("cand_label"))
    return r.join(lab, "cand_id").select(
        "query_id", "cand_id", "cand_label", _r("score").alias("score"), "rank",
        S.confidence_band("score").alias("confidence"))


def _outcomes(spark, sf, k=EVAL_K, fusion=None, fold=None):
    e = vectors(spark, sf)
    if fold:
        e = _fold(e, fold)
    truth = e.select(F.col("vec_id").alias("row_id"), F.col("label").alias("truth_code"))
    queries = e.select(F.col("vec_id").alias("row_id"), "embedding")
    kw = dict(k=k, row_id="row_id", truth_code="truth_code", query_vec="embedding",
              cand_id="vec_id", cand_vec="embedding", cand_code="label",
              strip_suffix=False, exclude_self=True)
    if fusion:
        kw.update(fusion=fusion, second_queries=_fold(queries, SECOND_DIMS),
                  second_catalogue=_fold(e, SECOND_DIMS))
    return evaluation.evaluate_matches(truth, queries, e, **kw)


def q_match_outcomes(spark, sf):
    o = _outcomes(spark, sf)
    return o.withColumn("similarity_score", _r("similarity_score"))


def q_hit_rate(spark, sf):
    return matching.hit_rate_at_k(_outcomes(spark, sf))


def _two_models(spark, sf):
    r1 = _neighbours(spark, sf).withColumnRenamed("query_id", "row_id") \
                               .withColumnRenamed("cand_id", "code")
    r2 = _neighbours(spark, sf, fold=SECOND_DIMS).withColumnRenamed("query_id", "row_id") \
                                                 .withColumnRenamed("cand_id", "code")
    return r1, r2


def _fused_out(df):
    return df.select("row_id", "code", _r("score_1").alias("score_1"),
                     _r("score_2").alias("score_2"), _r("score").alias("score"),
                     "rank", "rank_1", "rank_2")


def q_fuse_mean(spark, sf):
    return _fused_out(matching.fuse_mean(*_two_models(spark, sf)))


def q_fuse_weighted(spark, sf):
    return _fused_out(matching.fuse_weighted(*_two_models(spark, sf), 0.5, 0.5))


def q_fused_hit_rate(spark, sf):
    return matching.hit_rate_at_k(_outcomes(spark, sf, k=TOP_K, fusion="mean"))


# --------------------------------------------------------------------------
# labelled pairs (nearest neighbours labelled by class agreement) and metrics


def _pairs(spark, sf):
    lab = vectors(spark, sf).select("vec_id", "label")
    r = _neighbours(spark, sf)
    a = lab.select(F.col("vec_id").alias("query_id"), F.col("label").alias("l1"))
    b = lab.select(F.col("vec_id").alias("cand_id"), F.col("label").alias("l2"))
    return (r.join(a, "query_id").join(b, "cand_id")
             .select("query_id", "cand_id", F.col("score").alias("cosine_similarity"),
                     F.when(F.col("l1") == F.col("l2"), 1).otherwise(-1).alias("label")))


def _written(pairs_df):
    """Pairs that a query reads more than once: the search runs once."""
    return materialize(pairs_df, "pairs")


def q_accuracy_sweep(spark, sf):
    a = metrics.accuracy_sweep(_pairs(spark, sf), "cosine_similarity", "label")
    return a.select(_r("accuracy").alias("accuracy"), F.col("n").cast("long").alias("n"),
                    _r("se").alias("se"), _r("ci95").alias("ci95"))


def q_accuracy_fixed(spark, sf):
    p = _pairs(spark, sf).withColumn("label", S.relabel_binary("label"))
    a = metrics.accuracy_fixed(p, "cosine_similarity", "label", 0.5)
    return a.select(_r("accuracy").alias("accuracy"), F.col("n").cast("long").alias("n"),
                    _r("se").alias("se"), _r("ci95").alias("ci95"))


def q_classification_report(spark, sf):
    rep = metrics.classification_report(_pairs(spark, sf), "cosine_similarity", "label", 0.5)
    return rep.select(F.col("n").cast("long").alias("n"), *[F.col(c).cast("long").alias(c)
                      for c in ("tp", "fp", "fn", "tn")],
                      *[_r(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


def q_roc_auc(spark, sf):
    return metrics.roc_auc(_pairs(spark, sf), "cosine_similarity", "label") \
                  .select(_r("auc").alias("auc"))


def q_losses(spark, sf):
    p = _pairs(spark, sf).withColumn("y01", S.relabel_binary("label"))
    both = metrics.losses(p, "cosine_similarity", "label", "y01")
    return both.select(_r("mse").alias("mse"), _r("bce").alias("bce"))


def _scores(spark, sf):
    return _outcomes(spark, sf).where(F.col("similarity_score").isNotNull())


def q_score_quantile(spark, sf):
    return metrics.exact_quantile(_scores(spark, sf), "similarity_score", 0.25) \
                  .select(_r("q25").alias("q25"))


def q_score_histogram(spark, sf):
    h = metrics.score_histogram(_scores(spark, sf), "similarity_score", 30)
    return h.select("bin", _r("bin_lo").alias("bin_lo"), _r("bin_hi").alias("bin_hi"),
                    "count", _r("density", 4).alias("density"))


def q_score_kde(spark, sf):
    k = metrics.score_kde(_scores(spark, sf), "similarity_score", 100)
    return k.select("point", _r("x").alias("x"), _r("density", 4).alias("density"))


# --------------------------------------------------------------------------
# scalars, filters, keep-first, truth tables


def q_code_scalars(spark, sf):
    p = table(spark, sf, "part")
    code = F.concat(F.col("p_brand"), F.lit(" "), F.col("p_size").cast("string"),
                    F.substring("p_type", 1, 1))
    return p.select(
        "p_partkey",
        S.course_number("p_brand").alias("brand_number"),
        code.alias("raw_code"),
        S.strip_code_suffix(code).alias("stripped_code"),
        S.course_code("p_type", "p_size").alias("course_code"),
        S.composite_text("p_brand", "p_name", "p_type").alias("composite"),
        S.clean_markup(F.concat(F.col("p_name"), F.lit(" *+"), F.col("p_type"))).alias("clean"),
        S.confidence_band(F.col("p_retailprice") / 2000.0).alias("band"),
    )


def q_articulation_truth(spark, sf):
    adat = filters.valid_articulations(articulation_view(spark, sf), min_term=MIN_TERM)
    rows = adat.select(
        F.col("TRNS_DESCRIPTION").alias("Ext_Inst"), S.term_year("TERM").alias("YEAR"),
        S.course_code("TR_SUBJ", "TR_COURSE").alias("Ext_Course_Code"),
        S.course_code("EQUIV_SUBJECT", "EQUIV_CRSE").alias("Int_Course_Code"),
        "l_orderkey", "l_linenumber", "EQUIV_CRSE")
    first = dedup.keep_first(rows, ["Ext_Inst", "YEAR", "Ext_Course_Code"],
                             ["l_orderkey", "l_linenumber", F.col("EQUIV_CRSE").cast("int")])
    return first.select("Ext_Inst", S.academic_year("YEAR").alias("Transfer_Year"),
                        "Ext_Course_Code", "Int_Course_Code")


def q_rejected_rows(spark, sf):
    rej = filters.rejected_articulations(articulation_view(spark, sf), min_term=MIN_TERM)
    return rej.groupBy("TRNS_DESCRIPTION", S.term_year("TERM").alias("YEAR")).agg(
        F.count(F.lit(1)).alias("n_rejected"),
        F.countDistinct(S.course_code("TR_SUBJ", "TR_COURSE")).alias("n_courses"))


def q_course_index(spark, sf):
    p = table(spark, sf, "part")
    return dedup.course_index(p, code="p_brand", title="p_name", order=["p_partkey"]) \
                .select(F.col("p_brand").alias("code"), F.col("p_name").alias("title"))


def q_term_years(spark, sf):
    o = table(spark, sf, "orders")
    term = (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("int")
    return (o.select(term.alias("term"))
             .groupBy("term").agg(F.count(F.lit(1)).alias("n_orders"))
             .select("term", S.term_year("term").alias("year"),
                     S.academic_year(S.term_year("term")).alias("academic_year"), "n_orders"))


# --------------------------------------------------------------------------
# splits, sampling, pairs


def q_stratified_split(spark, sf):
    e = vectors(spark, sf).select("vec_id", "label")
    return split.stratified_split(e, "label", ["vec_id"], 0.2, 123)


def q_three_way_split(spark, sf):
    e = vectors(spark, sf).select("vec_id", "label")
    return split.three_way_split(e, "label", ["vec_id"], 0.2, 0.1, 123)


def q_split_null_labels(spark, sf):
    """Both splits with rows whose label is null: null is a label of its own."""
    e = vectors(spark, sf).select("vec_id", F.when(F.col("label") < 7, F.col("label")).alias("label"))
    two = split.stratified_split(e, "label", ["vec_id"], 0.2, 123)
    three = split.three_way_split(e, "label", ["vec_id"], 0.2, 0.1, 123, out="three_way")
    return two.join(three.drop("label"), "vec_id")


def q_grouped_metrics(spark, sf):
    """AUC and quartile of the pairs' scores by the querying class, one class null."""
    labels = vectors(spark, sf).select(F.col("vec_id").alias("query_id"),
                                       F.when(F.col("label") != 3, F.col("label")).alias("class"))
    p = _written(_pairs(spark, sf).join(labels, "query_id"))
    auc = metrics.roc_auc(p, "cosine_similarity", "label", ["class"])
    quartile = metrics.exact_quantile(p, "cosine_similarity", 0.25, ["class"])
    both = split.join_null_safe(auc, quartile, ["class"])
    return both.select("class", _r("auc").alias("auc"), _r("q25").alias("q25"))


def q_sample_negatives(spark, sf):
    p = _written(_pairs(spark, sf))
    n_pos = p.where(F.col("label") == 1).count()
    neg = split.sample_n(p.where(F.col("label") == -1), n_pos, ["query_id", "cand_id"], 123)
    return neg.select("query_id", "cand_id", _r("cosine_similarity").alias("cosine_similarity"),
                      "label")


def _valid_truth_rows(spark, sf):
    adat = filters.valid_articulations(articulation_view(spark, sf), min_term=MIN_TERM)
    rows = adat.select("TRNS_DESCRIPTION", S.term_year("TERM").alias("YEAR"),
                       "TR_COURSE", S.course_code("TR_SUBJ", "TR_COURSE").alias("EXT COURSE CODE"),
                       S.course_code("EQUIV_SUBJECT", "EQUIV_CRSE").alias("INT COURSE CODE"),
                       "l_orderkey", "l_linenumber", "EQUIV_CRSE")
    return dedup.keep_first(rows, ["TRNS_DESCRIPTION", "YEAR", "EXT COURSE CODE"],
                            ["l_orderkey", "l_linenumber", F.col("EQUIV_CRSE").cast("int")])


def _composite(df):
    return df.withColumn("text", S.composite_text("COURSE CODE", "COURSE TITLE", "DESCRIPTION"))


def _positives(spark, sf):
    ext = _composite(external_catalogue(spark, sf))
    intl = _composite(internal_catalogue(spark, sf))
    return pairs.positive_pairs(_valid_truth_rows(spark, sf), ext, intl,
                                ext_keys=[("TR_COURSE", "number"),
                                          ("EXT COURSE CODE", "COURSE CODE")],
                                int_key=("INT COURSE CODE", "COURSE CODE"),
                                ext_text="text", int_text="text")


def q_positive_pairs(spark, sf):
    return _positives(spark, sf)


def q_random_negatives(spark, sf):
    return pairs.random_negatives(_positives(spark, sf), seed=123)


def q_hard_negatives(spark, sf):
    e = vectors(spark, sf)
    p = _pairs(spark, sf).where(F.col("label") == 1)
    hn = pairs.hard_negatives(e, e, p, query_id="vec_id", query_vec="embedding",
                              cand_id="vec_id", cand_vec="embedding", pos_query="query_id",
                              pos_cand="cand_id", exclude_self=True)
    return hn.select("query_id", "cand_id", _r("score").alias("score"))


def _embedded(spark, df, text_col, name):
    """Whole counts (not normalised), so SQL can repeat the vectors exactly."""
    cache = scratch_table_path(spark, f"embedding_cache_{name}")
    return embed.embed_with_cache(df, [text_col], cache, embed.hashing_embedder(64, normalise=False))


def q_rejected_negatives(spark, sf):
    rej = filters.rejected_articulations(articulation_view(spark, sf), min_term=MIN_TERM)
    ext = _composite(external_catalogue(spark, sf)).select("number", "text")
    rows = rej.select("l_orderkey", "l_linenumber", "TR_COURSE") \
              .join(ext, F.col("TR_COURSE") == F.col("number")).drop("number", "TR_COURSE")
    rows = truth.with_row_id(rows)
    vecs = _embedded(spark, rows.select("row_id", "text"), "text", "external")
    home = _embedded(spark, _composite(internal_catalogue(spark, sf)), "text", "internal")
    out = pairs.rejected_negatives(vecs, home, row_id="row_id", text="text",
                                   vec="text_embedding", home_id="COURSE CODE",
                                   home_text="text", home_vec="text_embedding")
    keys = rows.select(F.col("row_id").alias("query_id"), "l_orderkey", "l_linenumber")
    return out.join(keys, "query_id").select("l_orderkey", "l_linenumber", "text_1", "text_2",
                                             _r("score").alias("score"), "label")


def q_rake_keywords(spark, sf):
    return keywords.rake_keywords(table(spark, sf, "documents"), "text", "doc_id")


def q_keyword_texts(spark, sf):
    """Course texts over a catalogue with repeated descriptions (``documents``
    holds exact copies under several codes)."""
    d = table(spark, sf, "documents").select(
        "doc_id", F.concat_ws(" ", "source", F.col("doc_id").cast("string")).alias("COURSE CODE"),
        F.col("lang").alias("COURSE TITLE"), F.col("text").alias("DESCRIPTION"))
    return training.course_texts(d, use_keywords=True).select("doc_id", "text")


def q_embed_documents(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    e = _embedded(spark, d, "text", "documents")
    best = F.array_position("text_embedding", F.array_max("text_embedding"))
    return e.select("doc_id", F.size("text_embedding").alias("dims"),
                    _r(V.norm("text_embedding"), 4).alias("norm"),
                    best.cast("int").alias("top_dim"))


FOLD_K = 16


def _vector_pairs(spark, sf):
    vec = vectors(spark, sf)
    a = vec.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("text_1_embedding"))
    b = vec.select(F.col("vec_id").alias("cand_id"), F.col("embedding").alias("text_2_embedding"))
    return _pairs(spark, sf).join(a, "query_id").join(b, "cand_id")


def q_project_pairs(spark, sf):
    j = _vector_pairs(spark, sf)
    j = projection.pair_cosine(j)
    m = projection.fold_matrix(DIMS, FOLD_K)
    out = projection.project_pairs(j, m, dtype=np.float64)
    return out.select("query_id", "cand_id", _r("cosine_similarity").alias("cosine_similarity"),
                      _r("cosine_similarity_custom").alias("cosine_similarity_custom"))


def q_fit_projection(spark, sf):
    j = _written(_vector_pairs(spark, sf))
    j = split.three_way_split(j, "label", ["query_id", "cand_id"], 0.2, 0.1, 123)
    cfg = learn.FitConfig(k=16, epochs=3, lr=0.05, loss="bce", optimizer="adam")
    res = learn.fit_projection(j, cfg, id_cols=["query_id", "cand_id"])
    return res.metrics_df(spark)


RATES = (0.5, 5.0)


def _first_epoch(spark, sf, log=None):
    """A grid of two learning rates, one full-batch epoch of SGD from a fixed matrix."""
    j = split.three_way_split(_written(_vector_pairs(spark, sf)), "label", ["query_id", "cand_id"], 0.2, 0.1, 123)
    base = learn.FitConfig(k=FOLD_K, epochs=1, loss="mse", optimizer="sgd", score="cosine")
    return learn.grid_search(j, [dict(lr=r) for r in RATES], base, id_cols=["query_id", "cand_id"],
                             start=projection.fold_matrix(DIMS, FOLD_K), log=log,
                             run_ids=[f"rate {r}" for r in RATES] if log else None)


def q_grid_first_epoch(spark, sf):
    """Metrics of every run and dataset after an epoch of the grid, and the run that is chosen."""
    rows = learn.run_metrics_df(spark, _first_epoch(spark, sf)[1])
    best = metrics.best_by(rows.where(F.col("dataset") == "validation"), "accuracy", ["run_id"]).first()["run_id"]
    return rows.select(
        "run_id", "dataset", "learning_rate", _r("loss").alias("loss"), _r("accuracy").alias("accuracy"),
        _r("auc").alias("auc"), (F.col("run_id") == best).alias("chosen"))


def q_logged_matrices(spark, sf):
    """The matrices that the run log holds after an epoch of the grid."""
    log = learn.RunLog(spark, scratch_table_path(spark, f"runs-{uuid.uuid4().hex}"))
    _first_epoch(spark, sf, log)
    return log.matrices().select("run_id", "epoch", "row_idx", _r(F.col("weights")[0]).alias("first"),
                                 _r(V.norm("weights")).alias("norm"))


def q_run_files(spark, sf):
    """Matrix and metrics files: the fixed matrix saved and loaded, its metrics by
    dataset written as CSV under two run ids (the first twice) and read back."""
    root = scratch_table_path(spark, f"run-files-{uuid.uuid4().hex}")
    catalogs.save_matrix(projection.matrix_to_df(spark, projection.fold_matrix(DIMS, FOLD_K)), f"{root}/matrix")
    matrix = projection.matrix_from_df(catalogs.load_matrix(spark, f"{root}/matrix"))
    j = split.stratified_split(_written(_vector_pairs(spark, sf)), "label", ["query_id", "cand_id"], 0.2, 123)
    for run_id, threshold in (("a", 0.9), ("b", 0.4), ("a", 0.5)):
        rows = learn.process_pairs(j, matrix, threshold).select("dataset", "n", "accuracy")
        catalogs.write_run_metrics(rows, f"{root}/runs", run_id=run_id)
    back = catalogs.read_run_metrics(spark, f"{root}/runs", "dataset string, n long, accuracy double")
    return back.select("run_id", "dataset", "n", _r("accuracy").alias("accuracy"))


def q_epoch_metrics(spark, sf):
    """Loss, accuracy and AUC of a fixed matrix on each dataset of the split."""
    j = _written(_vector_pairs(spark, sf))
    j = split.three_way_split(j, "label", ["query_id", "cand_id"], 0.2, 0.1, 123)
    j = j.withColumn("label", F.when(F.col("label") == 1, 1.0).otherwise(0.0))
    found = learn.evaluate(j, projection.fold_matrix(DIMS, FOLD_K), learn.FitConfig(),
                           "text_1_embedding", "text_2_embedding", "label", "dataset")
    rows = [(name, round(m["loss"], 6), round(m["accuracy"], 6), round(m["auc"], 6)) for name, m in sorted(found.items())]
    return spark.createDataFrame(rows, "dataset string, loss double, accuracy double, auc double")


def q_process_pairs(spark, sf):
    """Accuracy of the projected cosine per dataset."""
    j = split.stratified_split(_written(_vector_pairs(spark, sf)), "label", ["query_id", "cand_id"], 0.2, 123)
    a = learn.process_pairs(j, projection.fold_matrix(DIMS, FOLD_K), 0.4)
    return a.select("dataset", F.col("n").cast("long").alias("n"), _r("accuracy").alias("accuracy"))


def _split_pairs(spark, sf):
    return split.stratified_split(_written(_pairs(spark, sf)), "label", ["query_id", "cand_id"], 0.2, 123)


def q_accuracy_by_dataset(spark, sf):
    a = metrics.accuracy_sweep(_split_pairs(spark, sf), "cosine_similarity", "label", ["dataset"])
    return a.select("dataset", _r("accuracy").alias("accuracy"),
                    F.col("n").cast("long").alias("n"), _r("ci95").alias("ci95"))


def q_model_delta(spark, sf):
    j = projection.project_pairs(_vector_pairs(spark, sf),
                                 projection.fold_matrix(DIMS, FOLD_K), dtype=np.float64)
    d = metrics.model_delta(j, "cosine_similarity", "cosine_similarity_custom", "label", 0.5)
    return d.select(*[_r(c).alias(c) for c in d.columns])


def q_text_filters(spark, sf):
    d = table(spark, sf, "documents")
    kept = filters.min_text_length(filters.drop_nulls(d, ["text"]), "text")
    return kept.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count_if(F.col("text").contains("http")).alias("n_with_link"),
        F.count_if(F.col("text").rlike("[0-9]{3}-[0-9]{4}")).alias("n_with_number"))


def q_row_filters(spark, sf):
    """Membership, substring, regular expression and usable-code filters."""
    d = table(spark, sf, "documents")
    listed = filters.institution_in(d, "source", ["src0", "src1", "src2"])
    linked = filters.contains_filter(listed, "text", "the")
    numbered = filters.contains_filter(linked, "text", "[0-9]{2}", regex=True)
    p = table(spark, sf, "part").withColumn(
        "code", F.when(F.col("p_size") > 40, "N/A").when(F.col("p_size") < 3, None).otherwise(F.lower("p_brand")))
    usable = filters.usable_codes(p, "code")
    return (numbered.groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("n"))
            .unionByName(usable.groupBy(F.col("code").alias("name")).agg(F.count(F.lit(1)).alias("n"))))


def q_nearest_one(spark, sf):
    """The nearest other vector, over vectors that are not null."""
    e = vectors(spark, sf)
    e = filters.not_null_vector(e.withColumn("embedding", F.when(F.col("label") != 0, F.col("embedding"))),
                                "embedding")
    r = nearest_one(e, e, query_id="vec_id", query_vec="embedding", cand_id="vec_id", cand_vec="embedding",
                    exclude_self=True)
    return r.select("query_id", "cand_id", _r("score").alias("score"))


def _reasons(spark, sf, fusion=None):
    """Truth rows from ``documents``: its vector is that of the same id (others
    are not found), its code is among 12 of which the catalogue has 10."""
    e = vectors(spark, sf)
    t = table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_id"), (F.col("n_chars") % 12).cast(e.schema["label"].dataType).alias("truth_code"))
    queries = e.select(F.col("vec_id").alias("row_id"), "embedding").join(t.select("row_id"), "row_id", "left_semi")
    kw = {}
    if fusion:
        # The second model lacks the courses of one code; weighted fusion keeps
        # what either model found, for rows that both could search.
        second = _fold(e.where(F.col("label") != 4), SECOND_DIMS)
        kw = dict(fusion=fusion, second_queries=_fold(queries, SECOND_DIMS), second_catalogue=second,
                  weights=(0.7, 0.3))
    return evaluation.evaluate_matches(t, queries, e, k=TOP_K, row_id="row_id", truth_code="truth_code",
                                       query_vec="embedding", cand_id="vec_id", cand_vec="embedding",
                                       cand_code="label", strip_suffix=False, **kw)


def q_outcome_reasons(spark, sf):
    o = _reasons(spark, sf)
    return o.withColumn("similarity_score", _r("similarity_score"))


def q_fused_outcomes(spark, sf):
    o = _reasons(spark, sf, "weighted")
    return o.withColumn("similarity_score", _r("similarity_score"))


def q_projected_hit_rate(spark, sf):
    return matching.hit_rate_at_k(_outcomes(spark, sf, fold=FOLD_K))


def q_available_outcomes(spark, sf):
    """Courses of one code have no vector: still offered, so misses, not -1."""
    e = vectors(spark, sf)
    found = filters.not_null_vector(
        e.withColumn("embedding", F.when(F.col("label") != 3, F.col("embedding"))), "embedding")
    truth_rows = e.select(F.col("vec_id").alias("row_id"), F.col("label").alias("truth_code"))
    o = evaluation.evaluate_matches(
        truth_rows, e.select(F.col("vec_id").alias("row_id"), "embedding"), found, k=TOP_K, row_id="row_id",
        truth_code="truth_code", query_vec="embedding", cand_id="vec_id", cand_vec="embedding", cand_code="label",
        strip_suffix=False, exclude_self=True, available=e.select(F.col("label").alias("code")))
    return o.groupBy("truth_code", "match", "reason").agg(F.count(F.lit(1)).alias("n"))


def q_transfer_truth(spark, sf):
    """Truth from transfer records (orders as transfers), and the requested
    institutions that have none."""
    o = table(spark, sf, "orders").select(
        F.concat(F.col("o_orderpriority"), F.lit(" (PCC)")).alias("Institution"),
        (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("int").alias("Transfer Term"),
        F.lit("C").alias("Transfer Subject"), F.col("o_custkey").cast("string").alias("Transfer Course"),
        F.col("o_orderstatus").alias("OSU Course"))
    names = ["1-URGENT", "3-MEDIUM", "4-NOT-SPECIFIED", "Nowhere-College"]
    t = truth.truth_from_transfers(o, names)
    counted = t.groupBy("Ext_Inst", "Transfer_Year").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("Ext_Course_Code").alias("n_codes"))
    asked = spark.createDataFrame([(x,) for x in names], "Ext_Inst string")
    none = truth.missing_institutions(asked, t).select(
        "Ext_Inst", F.lit(None).cast("string").alias("Transfer_Year"), F.lit(0).cast("long").alias("n"),
        F.lit(0).cast("long").alias("n_codes"))
    return counted.unionByName(none)


def q_best_by(spark, sf):
    """Per customer segment the order with the highest total (ties: least key)."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"),
                                        F.col("o_custkey") == F.col("c_custkey"))
    rows = o.select("c_mktsegment", "o_orderkey", F.col("o_totalprice").cast("double").alias("total"))
    best = metrics.best_by(rows, "total", ["o_orderkey"], ["c_mktsegment"])
    return best.select("c_mktsegment", "o_orderkey", _r("total", 2).alias("total"))


def q_best_by_name(spark, sf):
    """Per nation the customer with the highest rounded balance; ties by market segment,
    then by name."""
    c = table(spark, sf, "customer").select(
        "c_nationkey", F.round(F.col("c_acctbal") / 1000).alias("thousands"), "c_mktsegment", "c_name")
    return metrics.best_by(c, "thousands", ["c_mktsegment", "c_name"], ["c_nationkey"])


def _all_vectors(spark, sf):
    """(vectors, the arguments of a search of all of them against all)."""
    return vectors(spark, sf), dict(query_id="vec_id", query_vec="embedding", cand_id="vec_id", cand_vec="embedding",
                                    exclude_self=True)


def q_pivot_topk(spark, sf):
    """The exact search that skips pairs of groups by their bounds."""
    e, names = _all_vectors(spark, sf)
    return pivots.pivot_topk(e, e, TOP_K, **names).rows.select("query_id", "cand_id", _r("score").alias("score"), "rank")


def q_signature_recall(spark, sf):
    """The approximate search, measured against the exact one: the exact lists' pairs, and
    whether at least 0.9 of them are found."""
    e, names = _all_vectors(spark, sf)
    near = signatures.signature_topk(e, e, TOP_K, **names).rows
    said = signatures.recall(near, topk_similar(e, e, TOP_K, **names))
    return said.select("pairs", (F.col("recall") >= 0.9).alias("enough"))


def _views(spark, sf):
    """The tables that the SQL statements read, as temporary views; a name of its own for
    each call, as views are looked up when a statement is analysed."""
    sql.register(spark, {"fold": projection.fold_matrix(DIMS, SECOND_DIMS)})
    tag = uuid.uuid4().hex
    vectors(spark, sf).createOrReplaceTempView(f"vectors_{tag}")
    table(spark, sf, "documents").createOrReplaceTempView(f"documents_{tag}")
    return f"vectors_{tag}", f"documents_{tag}"


def q_sql_rake(spark, sf):
    """RAKE as a table function over a view."""
    _, docs = _views(spark, sf)
    return spark.sql(f"""SELECT doc_id, keywords
                         FROM rake_keywords(TABLE(SELECT doc_id, text FROM {docs}), text => 'text')""")


def q_sql_projection(spark, sf):
    """Projection as a table function over a view."""
    vecs, _ = _views(spark, sf)
    return spark.sql(f"""SELECT vec_id, label, size(short) AS dims, round(short[0], 6) AS first, round(short[31], 6) AS last
                         FROM project_vectors(TABLE({vecs}), vec => 'embedding', matrix => 'fold', out => 'short')""")


def q_project_tiles(spark, sf):
    """The projection with its matrix as a table of tiles (16 rows, 8 columns each)."""
    m = projection.matrix_to_df(spark, projection.fold_matrix(DIMS, SECOND_DIMS))
    out = projection.project_tiles(vectors(spark, sf), "embedding", m, "short", np.float64, (16, 8))
    total = F.aggregate("short", F.lit(0.0), lambda a, x: a + x)
    return out.select("vec_id", "label", F.size("short").alias("dims"), _r(F.col("short")[0]).alias("first"),
                      _r(F.col("short")[31]).alias("last"), _r(total, 4).alias("total"))


def q_sql_topk(spark, sf):
    """The top-k search as one SQL statement over views."""
    vecs, _ = _views(spark, sf)
    e = spark.table(vecs)
    found = spark.sql(sql.topk_statement(vecs, vecs, TOP_K, query_id="vec_id", query_vec="embedding", cand_id="vec_id",
                                         cand_vec="embedding", exclude_self=True,
                                         cells=sql.topk_cells_of(e, e, "embedding", "embedding")))
    return found.select("query_id", "cand_id", _r("score").alias("score"), "rank")


def q_store_round_trip(spark, sf):
    """The embedding store written and read, one set of years."""
    root = scratch_table_path(spark, f"store-{uuid.uuid4().hex}")
    e = vectors(spark, sf).select(
        F.concat(F.lit("C "), F.col("vec_id").cast("string")).alias("COURSE CODE"),
        F.lit("t").alias("COURSE TITLE"), F.lit("d").alias("DESCRIPTION"), F.lit("c").alias("CODE TITLE DESC"),
        F.col("embedding").cast("array<float>").alias("embedding"),
        F.concat(F.lit("I "), F.col("label").cast("string")).alias("institution"),
        F.lit("2020-2021").alias("years"), F.lit("plain").alias("variant"))
    catalogs.write_embeddings(e, root)
    return catalogs.read_embeddings(spark, root, years="2020-2021").select(
        F.col("COURSE CODE").alias("code"), "institution", "years",
        F.size("embedding").alias("dims"), _r(V.norm("embedding"), 4).alias("norm"))


def q_articulation_files(spark, sf):
    """The equivalence table through a Latin-1 CSV file (leading zeros kept)."""
    path = scratch_table_path(spark, f"articulations-{uuid.uuid4().hex}")
    rows = articulation_view(spark, sf).select(*catalogs.ARTICULATION_SCHEMA.fieldNames()) \
        .withColumn("TR_COURSE", F.concat(F.lit("00"), F.col("TR_COURSE")))
    rows.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    back = catalogs.read_articulations(spark, path)
    return back.groupBy("TRNS_DESCRIPTION", S.term_year("TERM").alias("YEAR")).agg(
        F.count(F.lit(1)).alias("n"), F.min("TR_COURSE").alias("first_course"),
        F.countDistinct("EQUI_TITLE").alias("n_titles"))


def q_catalog_records(spark, sf):
    """Catalogues as JSON array files, one folder a language, some records cut off by a
    faulty export: the records read by many tasks, and the rejected ones counted."""
    path = scratch_table_path(spark, f"catalogs-{uuid.uuid4().hex}")
    text = F.to_json(F.struct(F.col("doc_id").cast("string").alias("COURSE CODE"),
                              F.col("source").alias("COURSE TITLE"), F.col("text").alias("DESCRIPTION")))
    fault = F.coalesce(F.col("n_chars") % 16 == 5, F.lit(False))
    table(spark, sf, "documents") \
        .select(F.coalesce("lang", F.lit("none")).alias("lang"),
                F.when(fault, F.substring(text, F.lit(1), F.length(text) - 2)).otherwise(text).alias("value")) \
        .write.partitionBy("lang").option("lineSep", ",\n").text(path)
    rows, rejected = catalogs.read_catalog_records(spark, path, glob="*")
    n = rejected.groupBy("INSTITUTION").agg(F.count(F.lit(1)).alias("n_rejected"))
    # A row for each language: at most as many as there are folders.
    return rows.join(F.broadcast(n), "INSTITUTION", "left").select(
        F.substring_index("INSTITUTION", "=", -1).alias("institution"), F.col("COURSE CODE").alias("code"),
        F.col("COURSE TITLE").alias("title"), F.md5("DESCRIPTION").alias("digest"),
        F.coalesce("n_rejected", F.lit(0)).cast("long").alias("n_rejected"))


def q_inspection_sample(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return split.sample_rows(d, ["doc_id"], 50, 123)


def q_pair_predictions(spark, sf):
    p = _pairs(spark, sf)
    return p.select("query_id", "cand_id", "label",
                    _r(S.sigmoid("cosine_similarity")).alias("sigmoid_score"),
                    S.threshold_predict("cosine_similarity", 0.3, strict=True).alias("pred_strict"),
                    S.threshold_predict("cosine_similarity", 0.5, strict=False).alias("pred_ge"),
                    S.relabel_binary("label").alias("label01"))


def q_name_scalars(spark, sf):
    c = table(spark, sf, "customer")
    name = F.concat(F.col("c_mktsegment"), F.lit(" "), F.col("c_name"), F.lit(" (PCC)"))
    return c.select("c_custkey",
                    S.rename_with("c_mktsegment", {"AUTOMOBILE": "AUTO", "MACHINERY": "MACH"})
                     .alias("segment"),
                    S.canonical_institution(name).alias("canonical"),
                    S.dehyphenate(S.hyphenate(name)).alias("round_trip"),
                    S.upper_code(F.lower("c_name")).alias("upper_name"))


def q_url_parts(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", S.path_segment("url", 3).alias("host"),
                    S.path_segment("url", 4).alias("lang"),
                    S.path_segment("url", -1).alias("last"))


def q_catalog_years(spark, sf):
    o = table(spark, sf, "orders")
    years = o.select(S.academic_year(F.year("o_orderdate").cast("string")).alias("years"))
    return catalogs.list_catalog_years(years)


# --------------------------------------------------------------------------
# registry


def queries() -> dict[str, Query]:
    return {
        "topk_match": q_topk_match,
        "match_outcomes": q_match_outcomes,
        "hit_rate_at_k": q_hit_rate,
        "fuse_mean": q_fuse_mean,
        "fuse_weighted": q_fuse_weighted,
        "fused_hit_rate": q_fused_hit_rate,
        "accuracy_sweep": q_accuracy_sweep,
        "accuracy_fixed": q_accuracy_fixed,
        "classification_report": q_classification_report,
        "roc_auc": q_roc_auc,
        "losses": q_losses,
        "score_quantile": q_score_quantile,
        "score_histogram": q_score_histogram,
        "score_kde": q_score_kde,
        "code_scalars": q_code_scalars,
        "articulation_truth": q_articulation_truth,
        "rejected_rows": q_rejected_rows,
        "course_index": q_course_index,
        "term_years": q_term_years,
        "stratified_split": q_stratified_split,
        "three_way_split": q_three_way_split,
        "sample_negatives": q_sample_negatives,
        "positive_pairs": q_positive_pairs,
        "random_negatives": q_random_negatives,
        "hard_negatives": q_hard_negatives,
        "rejected_negatives": q_rejected_negatives,
        "rake_keywords": q_rake_keywords,
        "embed_documents": q_embed_documents,
        "project_pairs": q_project_pairs,
        "fit_projection": q_fit_projection,
        "pair_predictions": q_pair_predictions,
        "accuracy_by_dataset": q_accuracy_by_dataset,
        "text_filters": q_text_filters,
        "inspection_sample": q_inspection_sample,
        "model_delta": q_model_delta,
        "name_scalars": q_name_scalars,
        "url_parts": q_url_parts,
        "catalog_years": q_catalog_years,
        "keyword_texts": q_keyword_texts,
        "row_filters": q_row_filters,
        "nearest_one": q_nearest_one,
        "outcome_reasons": q_outcome_reasons,
        "fused_outcomes": q_fused_outcomes,
        "projected_hit_rate": q_projected_hit_rate,
        "available_outcomes": q_available_outcomes,
        "transfer_truth": q_transfer_truth,
        "run_files": q_run_files, "grid_first_epoch": q_grid_first_epoch, "logged_matrices": q_logged_matrices,
        "pivot_topk": q_pivot_topk, "signature_recall": q_signature_recall,
        "sql_rake": q_sql_rake, "sql_projection": q_sql_projection, "sql_topk": q_sql_topk,
        "best_by": q_best_by, "best_by_name": q_best_by_name,
        "split_null_labels": q_split_null_labels, "grouped_metrics": q_grouped_metrics,
        "store_round_trip": q_store_round_trip,
        "articulation_files": q_articulation_files,
        "catalog_records": q_catalog_records, "project_tiles": q_project_tiles,
        "epoch_metrics": q_epoch_metrics,
        "process_pairs": q_process_pairs,
    }
