"""Table functions in SQL against the DataFrame forms."""

import numpy as np
import pytest

from simsift import sql
from simsift.operators.keywords import rake_keywords, rake_text
from simsift.operators.projection import fold_matrix, project
from simsift.operators.topk import topk_similar
from test_keywords import TEXTS, rake_brute


@pytest.fixture(scope="module")
def session(spark):
    sql.register(spark, {"fold": fold_matrix(6, 2)})
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-2, 3, 6).astype(float).tolist(), f"n{i % 3}") for i in range(60)]
    rows += [(60, None, "null"), (61, [0.0] * 6, "zero"), (62, rows[0][1], "copy")]
    spark.createDataFrame(rows, "id long, v array<double>, name string").createOrReplaceTempView("vecs")
    spark.createDataFrame(list(enumerate(TEXTS)), "id long, t string").createOrReplaceTempView("texts")
    return spark


def test_rake(session):
    got = session.sql("SELECT * FROM rake_keywords(TABLE(texts), text => 't', out => 'said')")
    assert got.columns == ["id", "said"]
    frame = {r.id: r.keywords for r in rake_keywords(session.table("texts"), "t", "id").collect()}
    assert {r.id: r.said for r in got.collect()} == frame == {i: rake_brute(t) for i, t in enumerate(TEXTS)}
    assert rake_text(TEXTS[0]) == rake_brute(TEXTS[0])
    assert session.sql("SELECT * FROM rake_keywords(TABLE(SELECT * FROM texts WHERE id < 0), text => 't')").collect() == []


def test_projection(session):
    got = session.sql("SELECT * FROM project_vectors(TABLE(vecs), vec => 'v', matrix => 'fold', out => 'short')")
    assert got.columns == ["id", "v", "name", "short"]
    frame = project(session.table("vecs"), "v", fold_matrix(6, 2), "short", dtype=np.float64)
    assert sorted(got.collect()) == sorted(frame.collect())


def test_partitions_of_a_caller(session):
    """PARTITION BY sends all rows of a key to one call; blocks are flushed at its end."""
    got = session.sql("SELECT name, count(*) AS n, count(short) AS made FROM project_vectors("
                      "TABLE(vecs) PARTITION BY name, vec => 'v', matrix => 'fold', out => 'short') GROUP BY name")
    assert {r.name: (r.n, r.made) for r in got.collect()} == {
        "n0": (20, 20), "n1": (20, 20), "n2": (20, 20), "null": (1, 0), "zero": (1, 1), "copy": (1, 1)}


@pytest.mark.parametrize("cells, own", [(1, False), (3, True)])
def test_topk(session, cells, own):
    text = sql.topk_statement("vecs", "vecs", 5, query_id="id", query_vec="v", cand_id="id", cand_vec="v", cells=cells,
                              exclude_self=own)
    v = session.table("vecs")
    frame = topk_similar(v, v, 5, query_id="id", query_vec="v", cand_id="id", cand_vec="v", exclude_self=own)
    got = session.sql(text)
    assert got.columns == ["query_id", "cand_id", "score", "rank"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, frame.collect()))


@pytest.mark.parametrize("statement, message", [
    ("SELECT * FROM rake_keywords(TABLE(texts), text => 'nope')", "no column 'nope'"),
    ("SELECT * FROM rake_keywords(TABLE(vecs), text => 'v')", "column 'v' is"),
    ("SELECT * FROM project_vectors(TABLE(vecs), vec => 'v', matrix => 'other')", "no matrix 'other'"),
    ("SELECT * FROM topk_cells(TABLE(SELECT 'q' AS side, id, v AS vec FROM vecs), k => 0)", "positive"),
    ("SELECT * FROM topk_cells(TABLE(SELECT 'q' AS side, id, v AS vec FROM vecs), k => 2)", "no column 'q_cell'"),
    ("SELECT * FROM topk_cells(TABLE(vecs), k => 3)", "no column 'id'|no column 'side'")])
def test_errors_when_analysed(session, statement, message):
    with pytest.raises(Exception, match=message):
        session.sql(statement)


def test_large_matrices_are_refused(session, monkeypatch):
    monkeypatch.setattr(sql, "MATRIX_BYTES", 8)
    with pytest.raises(ValueError, match="bytes"):
        sql.register(session, {"m": np.eye(2)})


def test_topk_cells_by_size_and_in_little_memory(spark):
    import tracemalloc
    v = np.random.default_rng(6).normal(size=(4500, 3))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v[:200])] + [(900, None)], "id long, v array<float>")
    assert sql.topk_cells_of(df, df, "v", "v") == sql.MIN_CELLS
    before, sql.CELL_BYTES = sql.CELL_BYTES, 600
    try:
        assert sql.topk_cells_of(df, df, "v", "v") == 8          # 200 vectors of 24 bytes
    finally:
        sql.CELL_BYTES = before
    cell = sql.TopkCells()
    tracemalloc.start()
    for i, x in enumerate(v.tolist()):
        for side in "qc":
            list(cell.eval({"side": side, "id": i, "vec": x}, 2, True) or ())
    found = list(cell.terminate())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 9000 and all(q != c for q, c, _ in found)
    assert peak < 80 << 20                                       # all scores at once are 162 MB
