import math

from pyspark.sql import functions as F

from simsift.functions import scalars as S
from simsift.functions import vectors as V


def one(spark, expr, schema, rows):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(expr).collect()]


def test_course_number_and_suffix(spark):
    rows = [("MTH 112Z",), ("CS 161",), ("WR",), (None,), ("BI 231A B",)]
    assert one(spark, S.course_number("c"), "c string", rows) == [112, 161, None, None, 231]
    assert one(spark, S.strip_code_suffix("c"), "c string", rows) == [
        "MTH 112", "CS 161", "WR", None, "BI 231"]


def test_institution_names(spark):
    rows = [("Portland Community College (PCC)",), ("Lane Community College",)]
    assert one(spark, S.canonical_institution("c"), "c string", rows) == [
        "Portland-Community-College", "Lane-Community-College"]
    assert one(spark, S.rename_with("c", S.INSTITUTION_ALIASES), "c string",
               [("Portland State University",), ("Other",), (None,)]) == ["PSU", "Other", None]


def test_text_builders(spark):
    rows = [("MTH 112", "Trig", "Angles *and+ more"), ("CS 1", None, "x")]
    df = spark.createDataFrame(rows, "c string, t string, d string")
    got = df.select(S.composite_text("c", "t", "d").alias("x"),
                    S.clean_markup("d").alias("y"), S.course_code("c", "t").alias("z")).collect()
    assert got[0]["x"] == "mth 112, trig, angles *and+ more"
    assert got[0]["y"] == "angles and more"
    assert got[1]["x"] is None and got[1]["z"] is None


def test_terms_and_years(spark):
    rows = [(200699,), (200700,), (202401,)]
    assert one(spark, S.term_year("t"), "t int", rows) == ["2006", "2007", "2024"]
    assert one(spark, S.academic_year(S.term_year("t")), "t int", rows) == [
        "2005-2006", "2006-2007", "2023-2024"]
    assert one(spark, S.start_year("y"), "y string", [("2023-2024",), ("x",)]) == [2023, None]


def test_confidence_band_edges(spark):
    rows = [(0.66,), (0.65,), (0.36,), (0.35,), (-1.0,)]
    assert one(spark, S.confidence_band("s"), "s double", rows) == [
        "High Confidence", "Low Confidence", "Low Confidence", "No Confidence", "No Confidence"]


def test_threshold_predict_nan(spark):
    rows = [(float("nan"),), (0.6,), (0.5,), (None,)]
    assert one(spark, S.threshold_predict("s", 0.5), "s double", rows) == [-1, 1, -1, -1]
    assert one(spark, S.threshold_predict("s", 0.5, strict=False), "s double", rows) == [
        -1, 1, 1, -1]
    sig = one(spark, S.sigmoid("s"), "s double", [(0.0,), (1.0,)])
    assert sig[0] == 0.5 and abs(sig[1] - 1 / (1 + math.exp(-1))) < 1e-12


def test_cosine_zero_and_clamp(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 2.0]), ([1.0, 1.0], [-1.0, -1.0]),
            (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    got = df.select(V.cosine("a", "b").alias("n"), V.cosine("a", "b", zero="zero").alias("z")) \
            .collect()
    assert got[0]["n"] == 1.0 and got[1]["n"] is None and got[1]["z"] == 0.0
    assert abs(got[2]["n"] + 1.0) < 1e-12 and got[3]["z"] is None


def test_path_segments(spark):
    rows = [("PCC/2023-2024.json",), ("a/b/c",)]
    assert one(spark, S.path_segment("p", -2), "p string", rows) == ["PCC", "b"]
    assert one(spark, S.path_segment("p", 5), "p string", rows) == [None, None]


def test_cosine_batch_matches_native(spark):
    rows = [([1.0, 2.0, 3.0], [0.5, -1.0, 2.0]), ([0.0, 0.0, 0.0], [1.0, 1.0, 1.0]),
            (None, [1.0, 0.0, 0.0]), ([1.0, 1.0, 1.0], [2.0, 2.0, 2.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    got = df.select(V.cosine("a", "b").alias("n"), V.cosine_batch("a", "b").alias("b")).collect()
    for r in got:
        assert (r.n is None and r.b is None) or abs(r.n - r.b) < 1e-12


def test_digits_only(spark):
    df = spark.createDataFrame([("12",), ("12\n",), ("",), ("1a",), (None,)], "c string")
    assert [r[0] for r in df.select(S.digits_only("c")).collect()] == [True, False, False, False, None]
