import json
import os
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from simsift.plans import matcher, truth
from simsift.sources import catalogs


def write_catalogs(root):
    os.makedirs(f"{root}/PCC")
    os.makedirs(f"{root}/Lane-Community-College")
    with open(f"{root}/PCC/2023-2024.json", "w") as f:
        json.dump([{"COURSE CODE": "MTH 112Z", "COURSE TITLE": "Trig", "DESCRIPTION": "angles"},
                   {"COURSE CODE": "N/A", "COURSE TITLE": "x", "DESCRIPTION": None}], f)
    with open(f"{root}/Lane-Community-College/2022-2023.json", "w") as f:
        json.dump([{"COURSE CODE": "BI 231", "COURSE TITLE": "Anatomy", "DESCRIPTION": "body"}], f)


def test_read_catalogs_path_columns(spark):
    root = tempfile.mkdtemp(prefix="cat-")
    write_catalogs(root)
    rows = sorted(tuple(r) for r in catalogs.read_catalogs(spark, root).collect())
    assert rows[0] == ("Lane-Community-College", "2022", "BI 231", "Anatomy", "body")
    assert ("PCC", "2023", "MTH 112Z", "Trig", "angles") in rows


def test_read_articulations_latin1(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="art-"), "a.csv")
    df = pd.DataFrame([["Y", "Portland Community College (PCC)", "MTH", "112", "Trigonométrie",
                        200801, "MTH", "0112", "TRIG"]],
                      columns=catalogs.ARTICULATION_SCHEMA.fieldNames())
    df.to_csv(path, index=False, encoding="ISO-8859-1")
    r = catalogs.read_articulations(spark, path).first()
    assert r.TR_TITLE == "Trigonométrie" and r.EQUIV_CRSE == "0112" and r.TERM == 200801


HOME = ("Oregon-State-University", "2023-2024")


def store_rows():
    rows = []
    home = [("MTH 112", "Trig", [1.0, 0.0, 0.0]), ("MTH 111", "Alg", [0.9, 0.1, 0.0]),
            ("BI 231", "Anat", [0.0, 1.0, 0.0]), ("CS 161", "Prog", [0.0, 0.0, 1.0])]
    for code, title, v in home:
        for variant in ("plain", "keywords"):
            rows.append((code, title, "d", "c", v, "Oregon-State-University", "2023-2024", variant))
    ext = [("MTH 112Z", [1.0, 0.05, 0.0]), ("bi 231", [0.1, 1.0, 0.0]), ("N/A", [1.0, 1.0, 1.0]),
           ("WR 121", [0.0, 0.1, 1.0])]
    for code, v in ext:
        for variant in ("plain", "keywords"):
            rows.append((code, "t", "d", "c", v, "PCC", "2023-2024", variant))
    return rows


def test_store_matcher_and_evaluation(spark):
    root = os.path.join(tempfile.mkdtemp(prefix="store-"), "store")
    df = spark.createDataFrame(store_rows(), catalogs.STORE_SCHEMA)
    catalogs.write_embeddings(df, root)
    assert catalogs.read_embeddings(spark, root, "PCC", "1999-2000").count() == 0
    assert catalogs.read_embeddings(spark, root, "Nowhere").count() == 0
    years = [r.years for r in catalogs.list_catalog_years(catalogs.read_embeddings(spark, root, variant=None)).collect()]
    assert years == ["2023-2024"]
    info, res = matcher.find_most_similar(spark, root, "PCC", "2023-2024", "mth 112z", HOME, top_n=2)
    assert info.count() == 1
    got = [(r["COURSE CODE"], r.rank, r["COURSE NUMBER"]) for r in res.collect()]
    assert got == [("MTH 112", 1, 112), ("MTH 111", 2, 111)]
    _, none = matcher.find_most_similar(spark, root, "PCC", "2023-2024", "ZZ 999", HOME)
    assert none.count() == 0
    t = spark.createDataFrame([
        ("PCC", "2023-2024", "MTH 112Z", "MTH 112"), ("PCC", "2023-2024", "BI 231", "BI 231"),
        ("PCC", "2023-2024", "WR 121", "WR 121"), ("PCC", "2023-2024", "XX 1", "MTH 112")],
        "Ext_Inst string, Transfer_Year string, Ext_Course_Code string, Int_Course_Code string")
    t = truth.with_row_id(t, truth.TRUTH_COLUMNS)
    out, hr = matcher.evaluate(spark, root, t, HOME, k=2)
    m = {r.Ext_Course_Code: (r.match, r.row_number) for r in out.collect()}
    assert m == {"MTH 112Z": (1, 1), "BI 231": (1, 1), "WR 121": (-1, None), "XX 1": (-1, None)}
    assert [tuple(r) for r in hr.collect()] == [(1, 2, 2, 100.0)]
    fused, _ = matcher.evaluate(spark, root, t, HOME, k=2, fusion="weighted")
    assert {r.Ext_Course_Code: r.match for r in fused.collect()}["MTH 112Z"] == 1
    mpath = os.path.join(os.path.dirname(root), "matrix")
    from simsift.operators.projection import matrix_to_df
    catalogs.save_matrix(matrix_to_df(spark, np.eye(3)), mpath)
    assert catalogs.load_matrix(spark, mpath).count() == 3


def test_truth_builders(spark):
    tr = spark.createDataFrame([("Portland Community College (PCC)", 202401, "MTH", "112", "MTH 112"),
                                ("Lane Community College", 201903, "BI", "231", "BI 231"),
                                ("Elsewhere", 202001, "X", "1", "X 1")],
                               catalogs.TRANSFER_SCHEMA)
    got = sorted(tuple(r) for r in truth.truth_from_transfers(
        tr, ["Portland-Community-College", "Lane-Community-College"]).collect())
    assert got == [("Lane-Community-College", "2018-2019", "BI 231", "BI 231"),
                   ("Portland-Community-College", "2023-2024", "MTH 112", "MTH 112")]
    art = spark.createDataFrame([
        ("Y", "Lane Community College", "BI", "231", "Anat", 200801, "BI", "231", "ANAT"),
        ("Y", "Lane Community College", "BI", "231", "Anat", 200802, "BI", "232", "ANAT2"),
        ("Y", "Lane Community College", "BI", "101", "Bio", 200699, "BI", "101", "BIO")],
        catalogs.ARTICULATION_SCHEMA)
    art = art.withColumn("line", F.monotonically_increasing_id())
    t = truth.truth_from_articulations(art, ["line"]).collect()
    assert [tuple(r) for r in t] == [("Lane-Community-College", "2007-2008", "BI 231", "BI 231")]


def test_training_pipeline(spark):
    from simsift.operators import learn
    from simsift.plans import training
    ext = spark.createDataFrame([
        ("Lane Community College", "2008", "MTH 251", "Calculus I",
         "Differential calculus of functions of one variable, limits and derivatives."),
        ("Lane Community College", "2008", "BI 231", "Anatomy",
         "Human anatomy and physiology of the body systems with laboratory work included."),
        ("Lane Community College", "2008", "ART 101", "Drawing",
         "Introduction to drawing media, perspective and composition for beginning artists."),
        ("Lane Community College", "2008", "WR 1", "Short", "Too short to keep.")],
        "INSTITUTION string, YEAR string, `COURSE CODE` string, `COURSE TITLE` string, "
        "DESCRIPTION string")
    intl = spark.createDataFrame([
        ("MTH 251", "Differential Calculus", "Limits, derivatives and applications."),
        ("BI 231", "Human Anatomy", "Body systems, anatomy and physiology."),
        ("ART 115", "Basic Design", "Design, drawing and composition.")],
        "`COURSE CODE` string, `COURSE TITLE` string, DESCRIPTION string")
    art = spark.createDataFrame([
        ("Y", "Lane Community College", "MTH", "251", "Calc", 200801, "MTH", "251", "CALC"),
        ("Y", "Lane Community College", "BI", "231", "Anat", 200802, "BI", "231", "ANAT"),
        ("Y", "Lane Community College", "ART", "101", "Draw", 200803, "ART", "000",
         "NOT ACCEPTED IN TRANSFER")], catalogs.ARTICULATION_SCHEMA)
    cache = os.path.join(tempfile.mkdtemp(prefix="cache-"), "emb")
    p = training.build_pairs(art.withColumn("line", F.monotonically_increasing_id()), ext, intl, cache,
                             use_keywords=True, order=["line"])
    rows = p.collect()
    assert sorted(r.label for r in rows) == [-1, 1, 1]
    neg = [r for r in rows if r.label == -1][0]
    assert neg.text_1.startswith("art 101") and neg.text_2.startswith("art 115")
    assert all(r.text_1_embedding is not None and r.text_2_embedding is not None for r in rows)


def test_missing_institutions_and_nearest_one(spark):
    from simsift.operators.topk import nearest_one
    req = spark.createDataFrame([("A",), ("B",), ("C",)], "Ext_Inst string")
    tr = spark.createDataFrame([("A", "x"), ("A", "y"), ("C", "z")], "Ext_Inst string, v string")
    assert [r.Ext_Inst for r in truth.missing_institutions(req, tr).collect()] == ["B"]
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<float>")
    c = spark.createDataFrame([(10, [1.0, 0.1]), (11, [1.0, 0.1]), (12, [0.1, 1.0])],
                              "id long, v array<float>")
    got = {r.query_id: r.cand_id for r in nearest_one(q, c, query_id="id", query_vec="v",
                                                      cand_id="id", cand_vec="v").collect()}
    assert got == {1: 10, 2: 12}                  # tie between 10 and 11 -> first id
