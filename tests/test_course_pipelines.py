"""The course pipelines: repeated courses and codes, names, fusion, availability,
projection, file order and the embedding cache."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from simsift.functions import scalars as S
from simsift.operators import dedup, embed
from simsift.plans import matcher, training, truth
from simsift.sources import catalogs

HOME = ("Home-University", "2023-2024")
TRUTH = "Ext_Inst string, Transfer_Year string, Ext_Course_Code string, Int_Course_Code string"


def store(spark, rows):
    """rows: (code, vector, institution, variant)."""
    root = os.path.join(tempfile.mkdtemp(prefix="store-"), "store")
    df = spark.createDataFrame([(c, f"title {i}", "d", "c", v, inst, "2023-2024", variant)
                                for i, (c, v, inst, variant) in enumerate(rows)], catalogs.STORE_SCHEMA)
    catalogs.write_embeddings(df, root)
    return root


def truth_rows(spark, *rows):
    df = spark.createDataFrame([(inst, "2023-2024", ext, home) for inst, ext, home in rows], TRUTH)
    return truth.with_row_id(df, truth.TRUTH_COLUMNS)


def test_keyword_text_of_repeated_courses(spark):
    text = "Organic chemistry of carbon compounds and of their reactions in the laboratory."
    rows = [("CH 1", "Chem", text), ("CH 1", "Chem", text), ("CH 2", "More", text),
            ("CH 3", "None", None), ("CH 4", "Chem", text + " Also polymers.")]
    df = spark.createDataFrame(rows, "`COURSE CODE` string, `COURSE TITLE` string, DESCRIPTION string")
    one = training.course_texts(df.limit(1), use_keywords=True).first()["text"]
    got = training.course_texts(df, use_keywords=True).collect()
    assert len(got) == 4
    assert [r["text"] for r in got if r["COURSE CODE"] == "CH 1"] == [one, one]
    assert "organic chemistry" in one and "organic organic" not in one


def duplicate_store(spark):
    rows = []
    for variant, turn in (("plain", 0.0), ("keywords", 0.02)):
        rows += [("MTH 1", [1.0, turn, 0.0], HOME[0], variant), ("MTH 1", [0.95, 0.1, turn], HOME[0], variant),
                 ("BI 2", [0.0, 1.0, turn], HOME[0], variant), ("CS 3", None, HOME[0], variant),
                 ("MTH 9", [1.0, 0.05, 0.0], "PCC", variant)]
    rows += [("WR 7", [0.0, 0.0, 1.0], "PCC", "plain")]                 # the first model alone knows it
    rows += [("ART 8", [1.0, 0.0, 0.0], "PCC", "keywords")]             # the second model alone
    return store(spark, rows)


def test_duplicate_home_codes(spark):
    root = duplicate_store(spark)
    _, res = matcher.find_most_similar(spark, root, "PCC", "2023-2024", "MTH 9", HOME, top_n=2)
    got = res.collect()
    assert [r["COURSE CODE"] for r in got] == ["MTH 1", "MTH 1"] and len({r["COURSE TITLE"] for r in got}) == 2
    from simsift.operators import matching
    q = matcher.evaluation_queries(spark, root, truth_rows(spark, ("PCC", "MTH 9", "MTH 1")))
    from simsift.plans.evaluation import rank_codes
    ranks = []
    for keywords in (False, True):
        home = matcher.home_catalogue(spark, root, HOME, keywords).where("embedding is not null")
        ranks.append(rank_codes(q, home, 3, row_id="row_id", query_vec="embedding", cand_id="row_key",
                                cand_vec="embedding"))
    fused = matching.fuse_mean(*ranks, query="row_id", code="code").collect()
    assert len(fused) == 3 and sorted(r["rank"] for r in fused) == [1, 2, 3]


@pytest.mark.parametrize("fusion", ["mean", "weighted"])
def test_fusion_needs_both_models(spark, fusion):
    root = duplicate_store(spark)
    t = truth_rows(spark, ("PCC", "MTH 9", "MTH 1"), ("PCC", "ART 8", "MTH 1"), ("PCC", "WR 7", "BI 2"))
    out, rate = matcher.evaluate(spark, root, t, HOME, k=2, fusion=fusion)
    got = {r.Ext_Course_Code: (r.match, r.reason, r.row_number) for r in out.collect()}
    assert got == {"MTH 9": (1, "hit", 1), "ART 8": (-1, "external_not_found", None),
                   "WR 7": (-1, "external_not_found", None)}
    assert [(r.hits, r.n) for r in rate.collect()] == [(1, 1)]


def test_outcomes_of_every_kind(spark):
    root = duplicate_store(spark)
    t = truth_rows(spark, ("PCC", "MTH 9", "MTH 1"), ("PCC", "WR 7", "MTH 1"), ("PCC", "MTH 9", "CS 3"),
                   ("PCC", "MTH 9", "ZZ 1"), ("PCC", "XX 1", "MTH 1"), ("PCC", "MTH 9", "EXTRA 5"))
    more = spark.createDataFrame([("EXTRA 5",)], "code string")
    out, _ = matcher.evaluate(spark, root, t, HOME, k=1, available=more)
    got = {(r.Ext_Course_Code, r.Int_Course_Code): (r.match, r.reason) for r in out.collect()}
    assert got[("MTH 9", "MTH 1")] == (1, "hit")
    assert got[("WR 7", "MTH 1")] == (0, "miss")
    assert got[("MTH 9", "CS 3")] == (0, "miss")                       # offered, but without a vector
    assert got[("MTH 9", "ZZ 1")] == (-1, "truth_not_in_catalogue")
    assert got[("XX 1", "MTH 1")] == (-1, "external_not_found")
    assert got[("MTH 9", "EXTRA 5")] == (0, "miss")                    # in the second catalogue


def test_aliases_in_batch_and_lookup(spark):
    root = duplicate_store(spark)
    names = ["Portland-Community-College", "Portland Community College", "Portland Community College (PCC)", "PCC"]
    t = truth_rows(spark, *[(n, "MTH 9", "MTH 1") for n in names])
    out, _ = matcher.evaluate(spark, root, t, HOME, k=2)
    assert [r.match for r in out.collect()] == [1] * 4
    for n in names:
        info, _ = matcher.find_most_similar(spark, root, n, "2023-2024", "MTH 9", HOME)
        assert info.count() == 1


def test_projected_evaluation(spark):
    root = duplicate_store(spark)
    t = truth_rows(spark, ("PCC", "MTH 9", "BI 2"))
    plain, _ = matcher.evaluate(spark, root, t, HOME, k=1)
    assert plain.first().match == 0
    swap = np.array([[0.0, 1.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]])   # both first axes become one
    projected, _ = matcher.evaluate(spark, root, t, HOME, k=3, matrix=swap)
    assert projected.first().match == 1


def articulations(spark, rows):
    df = spark.createDataFrame(rows, catalogs.ARTICULATION_SCHEMA)
    return df.withColumn("line", F.monotonically_increasing_id())


def test_rename_map_reaches_the_catalogue_folders(spark):
    ext = spark.createDataFrame(
        [("Mt.-Hood-Community-College", "2008", "MTH 1", "Calc", "Differential calculus of functions of one variable, limits."),
         ("Central-Oregon-Community-College", "2008", "BI 2", "Bio", "Human anatomy and physiology of the body systems, lab work.")],
        "INSTITUTION string, YEAR string, `COURSE CODE` string, `COURSE TITLE` string, DESCRIPTION string")
    intl = spark.createDataFrame([("M 1", "Calculus", "Limits"), ("B 2", "Anatomy", "Bodies"), ("B 2", "Anatomy", "Bodies")],
                                 "`COURSE CODE` string, `COURSE TITLE` string, DESCRIPTION string")
    art = articulations(spark, [
        ("Y", "Mt Hood Community College", "MTH", "1", "C", 200801, "M", "1", "C"),
        ("Y", "Central Oregon Com College", "BI", "2", "B", 200802, "B", "2", "NOT ACCEPTED IN TRANSFER")])
    cache = os.path.join(tempfile.mkdtemp(prefix="cache-"), "emb")
    got = training.build_pairs(art, ext, intl, cache, order=["line"]).collect()
    assert sorted((r.label, r.text_1[:5]) for r in got) == [(-1, "bi 2,"), (1, "mth 1")]


def test_keep_first_needs_an_order(spark):
    rows = [("Y", "Lane Community College", "BI", "231", "x", 200801, s, "101", "t") for s in ("ZZZ", "AAA")]
    for order_of_rows in (rows, rows[::-1]):
        t = truth.truth_from_articulations(articulations(spark, order_of_rows), ["line"]).first()
        assert t.Int_Course_Code == f"{order_of_rows[0][6]} 101"
    with pytest.raises(ValueError):
        truth.clean_articulations(articulations(spark, rows), [])


def test_year_convention(spark):
    art = articulations(spark, [("Y", "Lane", "BI", "1", "x", 200801, "B", "1", "t")])
    years = [truth.truth_from_articulations(art, ["line"], year_convention=c).first().Transfer_Year
             for c in ("end", "start")]
    assert years == ["2007-2008", "2008-2009"]
    with pytest.raises(ValueError):
        S.academic_year("x", "middle")


def test_course_index_takes_the_last_title(spark):
    df = spark.createDataFrame([(1, "A", "zebra"), (2, "A", "ant"), (3, "B", None), (4, None, "x")],
                               "n int, code string, title string")
    got = [tuple(r) for r in dedup.course_index(df, "code", "title", order=["n"]).collect()]
    assert got == [("A", "ant"), ("B", None)]


def test_cache_knows_the_embedder(spark):
    cache = os.path.join(tempfile.mkdtemp(prefix="cache-"), "emb")
    df = spark.createDataFrame([("a b",), ("a b",), (None,), ("c",)], "t string")
    for dim in (8, 16, 8):
        got = embed.embed_with_cache(df, ["t"], cache, embed.hashing_embedder(dim)).collect()
        assert len(got) == 4
        assert [len(r.t_embedding) for r in got if r.t is not None] == [dim] * 3
    assert embed.read_cache(spark, cache).count() == 4                  # two texts, two embedders
    assert sum(name.startswith("batch=") for name in os.listdir(cache)) == 2        # the last call found all texts
    with pytest.raises(ValueError):
        embed.embed_with_cache(df, ["t"], cache, lambda texts: [[0.0] for _ in texts])


def test_only_a_missing_store_is_empty(spark):
    assert catalogs.read_embeddings(spark, "/nowhere/at/all", ordinal="o").count() == 0
    with pytest.raises(Exception, match="(?i)scheme|filesystem"):
        catalogs.read_embeddings(spark, "noscheme://x/y").count()


def test_long_course_numbers(spark):
    df = spark.createDataFrame([("A 12345678901",), ("B",), ("C 7x8",)], "c string")
    assert [r[0] for r in df.select(S.course_number("c")).collect()] == [12345678901, None, 7]


def test_large_matrix_by_row_blocks(spark):
    from simsift.operators.projection import matrix_to_df, project
    rng = np.random.default_rng(1)
    m = rng.normal(size=(10, 4))
    vecs = rng.normal(size=(6, 10))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)] + [(9, None)], "id int, v array<double>")
    for matrix in (m, matrix_to_df(spark, m)):
        got = {r.id: r.v for r in project(df, "v", matrix, dtype=np.float64, max_bytes=96).collect()}
        assert got[9] is None
        assert np.allclose([got[i] for i in range(6)], vecs @ m)
    with pytest.raises(Exception, match="vector length"):
        project(df, "v", m[:7]).collect()


@pytest.mark.parametrize("tile, block", [((3, 2), 2), ((1, 1), 100), ((512, 512), 512), ((4, 3), 1)])
def test_matrix_product_by_tiles(spark, tile, block):
    from simsift.operators.projection import matrix_to_df, project_tiles
    rng = np.random.default_rng(2)
    m, vecs = rng.normal(size=(10, 5)), rng.normal(size=(7, 10))
    rows = [(i, v.tolist(), i) for i, v in enumerate(vecs)] + [(9, None, 1), (0, vecs[0].tolist(), 5)]
    df = spark.createDataFrame(rows, "id int, v array<double>, _row int").repartition(3)
    shuffled = matrix_to_df(spark, m).orderBy(F.rand(1))
    out = project_tiles(df, "v", shuffled, "w", np.float64, tile, block)
    assert out.columns == ["id", "v", "_row", "w"]
    got = out.collect()
    assert sorted((r.id, r._row) for r in got) == sorted((i, x) for i, _, x in rows)
    for r in got:
        assert r.w is None if r.v is None else np.allclose(r.w, vecs[r.id] @ m, atol=1e-12)
    assert project_tiles(df.limit(0), "v", shuffled, dtype=np.float64).count() == 0
    short = project_tiles(df, "v", shuffled, tile=tile, block=block)
    assert short.columns == df.columns and short.schema["v"].dataType.simpleString() == "array<float>"
    with pytest.raises(Exception, match="vector length 10 != matrix rows 7"):
        project_tiles(df, "v", matrix_to_df(spark, m[:7])).collect()


def test_written_tables_are_removed(spark):
    from simsift.session import materialize, release, scratch
    table = materialize(spark.range(5))
    path = table._scratch_path
    assert os.path.isdir(path) and table.count() == 5
    release(table)
    assert not os.path.exists(path)
    with scratch():
        inner = materialize(spark.range(3))._scratch_path
        assert os.path.isdir(inner)
    assert not os.path.exists(inner)


def test_best_epoch_dataset_must_exist(spark):
    from simsift.operators import learn
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist(), rng.normal(size=4).tolist(), 1 if i % 2 else -1, "train" if i % 3 else "test")
            for i in range(60)]
    df = spark.createDataFrame(rows, "id int, text_1_embedding array<double>, text_2_embedding array<double>, "
                                     "label int, dataset string")
    with pytest.raises(ValueError, match="validation"):
        learn.fit_projection(df, learn.FitConfig(k=2, epochs=1), id_cols=["id"])
    base = learn.FitConfig(k=2, epochs=2, loss="mse", score="cosine", optimizer="sgd")
    best, runs = learn.grid_search(df, [dict(lr=0.1, batch_size=10), dict(lr=0.2, batch_size=20)], base, "test", id_cols=["id"])
    assert best is not None and {r["run_id"] for r in runs} == {0, 1}
    assert best.best_epoch in (1, 2)


def test_home_catalogue_transfers_and_run_metrics_files(spark):
    root = tempfile.mkdtemp(prefix="files-")
    home = spark.createDataFrame([("M 1", "Calculus", "d"), ("M 1", None, None)],
                                 ", ".join(f"`{c}` string" for c in catalogs.INTERNAL_COLUMNS))
    for fmt in ("parquet", "csv"):
        w = home.write.option("header", True)
        w.format(fmt).save(f"{root}/home-{fmt}")
        got = catalogs.read_internal_catalog(spark, f"{root}/home-{fmt}", fmt)
        assert got.columns == ["COURSE CODE", "COURSE TITLE", "DESCRIPTION"]
        assert sorted(map(tuple, got.collect()), key=str) == sorted([("M 1", "Calculus", "d"), ("M 1", None, None)], key=str)
    moves = spark.createDataFrame([("Lane (PCC)", 202401, "MTH", "0112", "MTH 1")], catalogs.TRANSFER_SCHEMA)
    for fmt in ("parquet", "csv"):
        moves.write.option("header", True).format(fmt).save(f"{root}/moves-{fmt}")
        assert [tuple(r) for r in catalogs.read_transfers(spark, f"{root}/moves-{fmt}", fmt).collect()] == [
            ("Lane (PCC)", 202401, "MTH", "0112", "MTH 1")]
    from simsift.operators import learn, metrics
    runs = [{"run_id": i, "epoch": 1, "dataset": "test", "loss": 1.0 - i / 10, "accuracy": 0.5, "auc": 0.5,
             "modified_embedding_length": 2, "batch_size": 10, "max_epochs": 1, "learning_rate": 0.1,
             "dropout_fraction": 0.0} for i in range(3)]
    table = learn.run_metrics_df(spark, runs)
    catalogs.write_run_metrics(table, f"{root}/runs", "csv")
    back = spark.read.option("header", True).option("inferSchema", True).csv(f"{root}/runs")
    assert back.count() == 3 and back.columns == table.columns
    assert metrics.best_by(back, "accuracy", ["run_id"]).first().run_id == 0
