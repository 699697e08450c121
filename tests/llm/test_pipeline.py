"""The pipeline against a brute-force version of its five stages."""

import re

import corpus_pipeline
from simsift.llm import decontaminate as D
from simsift.llm import hostquality, pseudonyms, queries, unigram
from test_neardup import brute, sets

SF = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {r.doc_id for r in hostquality.host_quality(docs).collect() if r.kept}
    groups = brute([(d, rows[d].text) for d in sorted(kept)], corpus_pipeline.NEAR_PERCENT)
    kept = {d for d in kept if groups[d][1] == d}
    items = [D.normalise(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {d: D.normalise(rows[d].text or "") for d in kept}
    matcher = D.Matcher(list(enumerate(items)))
    kept = {d for d in kept if not matcher.matches(rows[d].text or "")}
    assert not any(i in texts[d] for d in kept for i in items)
    model = unigram.read_model(spark, queries.PIECES)
    worker = pseudonyms.Pseudonymizer(queries.DEMO_KEY)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == kept
    for d in kept:
        text = worker.replace(rows[d].text)[0]
        assert got[d].ids == model.encode(text) and model.decode(got[d].ids) == text
        assert not re.search(r"AKIA[A-Z0-9]{16}", text) or text != rows[d].text


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = docs.unionByName(spark.createDataFrame([(10_000, None, None, None, None), (None, "", "en", "s", 0)], docs.schema))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        odd = stage(spark, odd, SF)
        assert odd.schema.names == docs.schema.names
        assert [f.dataType for f in odd.schema] == [f.dataType for f in docs.schema]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_near_duplicates_from_four_fifths_on(spark):
    """The stage against all pairs at 0.8: 100 words have 96 shingles; cutting the
    tail to n words leaves a similarity of (n - 4) / 96."""
    rows = []
    for g, sizes in enumerate([(100, 81), (100, 80), (100, 85), (100, 86), (100, 84, 81), (100, 60)]):
        words = [f"g{g}w{i}" for i in range(100)]
        rows += [(10 * g + j, " ".join(words[:n])) for j, n in enumerate(sizes)]
    shingles = {d: sets(t) for d, t in rows}
    gone = set()
    for b in shingles:
        for a in shingles:
            both = len(shingles[a] & shingles[b])
            if a < b and 10 * both >= 8 * (len(shingles[a]) + len(shingles[b]) - both):
                gone.add(b)
    assert gone == {1, 21, 31, 41, 42}                    # 11 is below 0.8, 31 the only one from 0.85 on
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows],
                               "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, SF).collect()}
    assert kept == set(shingles) - gone


def test_encoding_is_decoded(spark):
    df = spark.createDataFrame([(1, "a b\u2581c é", "en", "s", 7), (2, "", "en", "s", 0), (3, None, None, None, None)],
                               "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.encoding(spark, df, SF).collect()}
    assert len(got) == 3 and all(r.round_trip for r in got.values())
