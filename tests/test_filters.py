from simsift.operators import dedup, filters

ART = "EQUIV_EXISTS string, TRNS_DESCRIPTION string, EQUI_TITLE string, EQUIV_CRSE string, TERM int, k int"
ROWS = [
    ("Y", "A", "CALCULUS", "251", 200700, 1),
    ("N", "A", "CALCULUS", "251", 200700, 2),
    ("Y", "A", "NOT ACCEPTED IN TRANSFER", "251", 200800, 3),
    ("Y", "A", "X", "000", 200800, 4),
    ("Y", "A", "X", "0000", 200800, 5),
    ("Y", "A", "X", "LDT", 200800, 6),
    ("Y", "A", "X", None, 200800, 7),
    ("Y", "A", "X", "101", 200699, 8),
    ("Y", "A", None, "101", 200900, 9),
    ("Y", "A", "NOT ACCEPTED IN TRANSFER", "000", 200900, 10),
    ("Y", "A", "Ünïcode", "1٣", 200900, 11),
]


def test_valid_and_rejected(spark):
    df = spark.createDataFrame(ROWS, ART)
    valid = sorted(r.k for r in filters.valid_articulations(df).collect())
    assert valid == [1]
    rej = sorted(r.k for r in filters.rejected_articulations(df).collect())
    assert rej == [3, 10]          # placeholder codes are kept on the rejected side


def test_length_and_codes(spark):
    df = spark.createDataFrame([("x" * 47, "a"), ("x" * 48, "n/a"), (None, "N/A"), ("y" * 60, None)],
                               "d string, c string")
    assert filters.min_text_length(df, "d").count() == 2
    codes = [r.c for r in filters.usable_codes(df, "c").collect()]
    assert codes == ["A"]


def test_keep_first_and_index(spark):
    df = spark.createDataFrame([("a", 3, "late"), ("a", 1, "early"), ("b", 2, "only"),
                                ("a", 2, "mid")], "k string, o int, v string")
    got = {r.k: r.v for r in dedup.keep_first(df, ["k"], ["o"]).collect()}
    assert got == {"a": "early", "b": "only"}
    cat = spark.createDataFrame([(1, "MTH 2", "B"), (2, "MTH 1", "A"), (3, "MTH 2", "C"), (4, None, "Z")],
                                "n int, code string, title string")
    idx = [tuple(r) for r in dedup.course_index(cat, "code", "title", order=["n"]).collect()]
    assert idx == [("MTH 1", "A"), ("MTH 2", "C")]
