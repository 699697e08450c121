"""Near duplicates against brute force over all pairs."""

import random
import re

import pytest

from simsift.llm import neardup

SCHEMA = "doc_id long, text string, kept string"


def sets(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def brute(docs, percent=85):
    """{doc_id: (n_shingles, component)} by comparing every pair."""
    shingles = {d: sets(t) for d, t in docs}
    parent = {d: d for d in shingles}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(shingles)
    where = {}
    for d in ids:
        for s in shingles[d]:
            where.setdefault(s, []).append(d)
    pairs = {(a, b) for v in where.values() if len(v) > 1 for i, b in enumerate(v) for a in v[:i]}
    for a, b in pairs:
        both = len(shingles[a] & shingles[b])
        if 100 * both >= percent * len(shingles[a] | shingles[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(shingles[d]), root(d)) for d in ids}


def result(spark, docs, **kw):
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], SCHEMA)
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept)
            for r in neardup.near_duplicates(df, **kw).collect()}


def family(rng, base, share, n):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, int(len(words) * share))):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    texts = []
    for share, n in ((0.02, 60), (0.05, 40), (0.2, 20), (0.0, 30)):
        base = [f"v{rng.randrange(10**6)}" for _ in range(rng.randint(60, 400))]
        texts += family(rng, base, share, n)
    chain = [f"c{i}" for i in range(300)]
    for _ in range(12):                       # each a few words away from the one before
        chain = chain[6:] + [f"c{rng.randrange(10**6)}" for _ in range(6)]
        texts.append(" ".join(chain))
    texts += ["", None, " \t\n", "one two", "ONE  two", "one two three", "a b c d e", "A B C D E f", "é à ü ß ö É"]
    texts.append(" ".join(f"l{i}" for i in range(30_000)))
    rng.shuffle(texts)
    return list(enumerate(texts, 100))


def test_equals_brute_force(spark, corpus):
    want = brute(corpus)
    got = result(spark, corpus)
    assert {d: v[:2] for d, v in got.items()} == want
    assert all(v[2] == (d == v[1]) for d, v in got.items())


def test_residual_blocks(spark, corpus, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 3)
    assert {d: v[:2] for d, v in result(spark, corpus).items()} == brute(corpus)


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect()}
    assert got == want


def test_edges(spark):
    assert result(spark, []) == {}
    df = spark.createDataFrame([(None, "a b c", ""), (3, "a b c", ""), (3, "a b c", ""), (5, "A b c", ""),
                                (7, "", ""), (8, None, "")], SCHEMA)
    rows = sorted(neardup.near_duplicates(df).collect(), key=lambda r: (r.doc_id or 0))
    assert [tuple(r) for r in rows] == [(None, 1, None, True), (3, 1, 3, True), (3, 1, 3, True),
                                        (5, 1, 3, False), (7, 0, 7, True), (8, 0, 8, True)]
    kept = neardup.drop_near_duplicates(df)
    assert kept.columns == ["doc_id", "text", "kept"] and kept.count() == 5


def test_repeated_ids_close_over_links(spark):
    """9 is near a row of 5, another row of 5 equals 3: all are 3's."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    near_b = b + " more"
    rows = [(3, a, ""), (5, a, ""), (5, b, ""), (9, near_b, ""), (11, "c d e", ""), (11, "c d e", ""),
            (21, a + " x y z q r s t u v w x1 x2", ""), (31, "k l m", ""), (33, "k l m", ""), (33, "n o p", ""), (35, "n o p", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}
    assert got == {(3, 3, True), (5, 3, False), (9, 3, False), (11, 11, True), (21, 21, True),
                   (31, 31, True), (33, 31, False), (35, 31, False)}
    assert sorted(r.doc_id for r in neardup.drop_near_duplicates(df).collect()) == [3, 11, 11, 21, 31]


def test_estimate_is_corrected(spark):
    base = [f"x{i}" for i in range(2000)]
    a, b = " ".join(base), " ".join(base[400:] + [f"y{i}" for i in range(400)])
    rows = spark.createDataFrame([(1, a), (2, b), (3, " ".join(f"z{i}" for i in range(2000)))], "id long, text string")
    signed = rows.mapInArrow(neardup._signatures, neardup.SIGNATURES)
    p = signed.selectExpr("id a", "planes pa").crossJoin(signed.selectExpr("id b", "planes pb"))
    e = {(r.a, r.b): r.e for r in p.select("a", "b", neardup.COARSE.estimate("pa", "pb").alias("e")).collect()}
    assert e[1, 1] == 1.0 and abs(e[1, 2] - 1596 / 2396) < 0.15 and abs(e[1, 3]) < 0.1
