"""Brute-force checks of queries over the whole sf0.001 tables, beside their SQL."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from conftest import SF
from simsift.operators.embed import hashing_embedder
from simsift.plans import driver_queries as D
from test_keywords import rake_brute


def test_random_negatives_invariants(spark):
    pos = {(r.text_1, r.text_2) for r in D._positives(spark, SF).collect()}
    n_pos = D._positives(spark, SF).count()
    neg = D.q_random_negatives(spark, SF).collect()
    got = [(r.text_1, r.text_2) for r in neg]
    assert len(got) == n_pos == len(set(got))
    assert all(a < b for a, b in got)
    assert not any((a, b) in pos or (b, a) in pos for a, b in got)
    assert all(r.label == -1 for r in neg)


def test_rejected_negatives_brute_force(spark):
    out = D.q_rejected_negatives(spark, SF).toPandas()
    emb = hashing_embedder(64, normalise=False)
    rej = D.filters.rejected_articulations(D.articulation_view(spark, SF), min_term=D.MIN_TERM)
    known = D.external_catalogue(spark, SF).select("number")
    assert len(out) == rej.join(known, F.col("TR_COURSE") == F.col("number")).count()
    home = D._composite(D.internal_catalogue(spark, SF)).select("text").toPandas()
    hv = np.stack(emb(home["text"])).astype(np.float64)
    hv /= np.where(np.linalg.norm(hv, axis=1) == 0, 1, np.linalg.norm(hv, axis=1))[:, None]
    codes = D.internal_catalogue(spark, SF).select("COURSE CODE").toPandas()["COURSE CODE"]
    order = np.argsort(codes.to_numpy(), kind="stable")       # ties -> smaller code
    for t1, t2, score in zip(out["text_1"], out["text_2"], out["score"]):
        q = np.asarray(emb(pd.Series([t1]))[0], dtype=np.float64)
        q /= np.linalg.norm(q) or 1.0
        s = np.round(hv[order] @ q, 12)
        best = order[int(np.argmax(s))]
        assert home["text"][best] == t2
        assert abs(s.max() - score) < 1e-6


def test_rake_on_all_documents(spark):
    got = {r.doc_id: r.keywords for r in D.q_rake_keywords(spark, SF).collect()}
    docs = D.table(spark, SF, "documents").toPandas()
    assert len(got) == len(docs)
    for doc_id, text in zip(docs["doc_id"], docs["text"]):
        assert got[doc_id] == rake_brute(text), doc_id


def test_embed_documents(spark):
    rows = D.q_embed_documents(spark, SF).collect()
    assert len(rows) == D.table(spark, SF, "documents").count()
    assert all(r.dims == 64 and 1 <= r.top_dim <= 64 for r in rows if r.dims is not None)
    v = hashing_embedder(64)(pd.Series(["a b c a", "", None]))
    assert abs(np.linalg.norm(v[0]) - 1) < 1e-6 and v[1] is None and v[2] is None


def test_fit_projection_metrics(spark):
    rows = D.q_fit_projection(spark, SF).collect()
    assert sorted({(r.epoch, r.dataset) for r in rows}) == [
        (e, d) for e in (1, 2, 3) for d in ("test", "train", "validation")]
    assert all(np.isfinite(r.loss) and 0 <= r.accuracy <= 1 for r in rows)
    assert all(r.auc is None or 0 <= r.auc <= 1 for r in rows)
