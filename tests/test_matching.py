from simsift.operators import matching as M


def test_outcomes_and_hit_rate(spark):
    truth = spark.createDataFrame(
        [(1, "MTH 112"), (2, "CS 161"), (3, "BI 101"), (4, "WR 121"), (5, "XX 999")],
        "row_id long, Int_Course_Code string")
    ranked = spark.createDataFrame([
        (1, "MTH 111", 0.9, 1), (1, "MTH 112Z", 0.8, 2), (1, "MTH 112", 0.7, 3),
        (2, "CS 161", 0.95, 1),
        (3, "BI 102", 0.5, 1),
        (5, "AA 100", 0.4, 1),
    ], "row_id long, code string, score double, rank int")
    catalogue = spark.createDataFrame([("MTH 112",), ("CS 161",), ("BI 101",), ("WR 121",)],
                                      "code string")
    queried = spark.createDataFrame([(1,), (2,), (3,), (5,)], "row_id long")
    out = {r.row_id: r for r in M.match_outcomes(truth, ranked, catalogue, queried).collect()}
    assert (out[1].match, out[1].row_number, out[1].similar_courses_row_number) == (1, 2, 1)
    assert out[1].OSU_Course_Code == "MTH 112" and out[1].similarity_score == 0.8
    assert (out[2].match, out[2].row_number) == (1, 1)
    assert (out[3].match, out[3].reason) == (0, "miss")
    assert (out[4].match, out[4].reason) == (-1, "external_not_found")
    assert (out[5].match, out[5].reason) == (-1, "truth_not_in_catalogue")
    hr = [tuple(r) for r in M.hit_rate_at_k(
        M.match_outcomes(truth, ranked, catalogue, queried)).orderBy("top_i").collect()]
    # n = rows with match != -1 = 3; ranks 1 and 2 found
    assert hr == [(1, 1, 3, 33.33), (2, 2, 3, 66.67)]


def test_hit_rate_empty(spark):
    o = spark.createDataFrame([(1, -1, None)], "row_id long, match int, row_number int")
    assert M.hit_rate_at_k(o).count() == 0


def test_fusion(spark):
    r1 = spark.createDataFrame([(1, "A", 0.9, 1), (1, "B", 0.8, 2), (1, "C", 0.1, 3)],
                               "row_id long, code string, score double, rank int")
    r2 = spark.createDataFrame([(1, "B", 0.9, 1), (1, "A", 0.5, 2), (1, "D", 0.4, 3)],
                               "row_id long, code string, score double, rank int")
    mean = [(r.code, round(r.score, 6), r.rank) for r in
            M.fuse_mean(r1, r2).orderBy("rank").collect()]
    assert mean == [("B", 0.85, 1), ("A", 0.7, 2)]
    w = [(r.code, round(r.score, 6), r.rank, r.rank_1, r.rank_2) for r in
         M.fuse_weighted(r1, r2, 0.6, 0.4).orderBy("rank").collect()]
    assert w == [("B", 0.84, 1, 2, 1), ("A", 0.74, 2, 1, 2), ("D", 0.16, 3, None, 3),
                 ("C", 0.06, 4, 3, None)]
