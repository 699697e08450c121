"""Pigeonhole matching against dynamic programming over whole texts."""

import random
import re

import pytest

from simsift.llm import decontaminate as D

DOCS = "doc_id long, text string, item_id string"
BENCH = "item_id long, text string"


def distances(pattern, text, prefix):
    """Edit distances of the pattern to the substrings (or prefixes) by end."""
    row = list(range(len(text) + 1)) if prefix else [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row


def test_myers_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(60):
        p = "".join(rng.choice("abc ") for _ in range(rng.randint(24, 90)))
        t = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 140)))
        item = D.Item(0, p)
        for prefix in (False, True):
            row = distances(p, t, prefix)
            best, end = item._myers(t, item.bits, prefix)
            assert best == min(row) and (end == 0 or row[end] == best)


def edited(rng, text, k):
    out = list(text)
    for _ in range(k):
        at = rng.randrange(1, len(out) - 1)
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice("xyz")
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, rng.choice("xyz"))
    return "".join(out)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(6, 40)))) for i in range(25)] + [(90, "too short"), (91, None), (92, "!?")]
    docs = []
    for d in range(36):
        text = rng.choices(words, k=rng.randint(5, 120))
        if d % 3:
            item = rng.choice(items[:25])[1]
            text.insert(rng.randrange(len(text)), edited(rng, item, rng.randint(0, len(item) // 8)))
        docs.append((d, " ".join(text).upper() if d % 5 == 0 else ", ".join(text), "x"))
    docs += [(500, None, "x"), (501, "", "x"), (502, items[0][1] + " " + items[3][1], "x"),
             (502, items[0][1] + " " + items[3][1], "x"), (None, items[1][1], "x"), (503, "too short", "x"),
             (504, "v " * 50_000 + items[2][1], "x")]
    return docs, items


CJK = r"\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\ua4cf\uf900-\ufaff\uff66-\uff9d\U00020000-\U0003ffff"


def plain_whole(item, text):
    """Whether a short item stands in a normalised text as its own words."""
    left = "" if re.match(f"[{CJK}]", item) else f"(?<![^ {CJK}])"
    right = "" if re.match(f"[{CJK}]", item[-1]) else f"(?![^ {CJK}])"
    return bool(re.search(left + re.escape(item) + right, text))


def brute(docs, items):
    out = []
    for d, text, _ in docs:
        text = D.normalise(text or "")
        for i, item in items:
            item = D.normalise(item or "")
            if 0 < len(item) < 20:
                if plain_whole(item, text):
                    out.append((d, i, 0))
            elif item:
                if d == 504:                          # too long for the plain programme
                    if item in text:
                        out.append((d, i, 0))
                    continue
                best = min(distances(item, text, False))
                if best <= D.budget(len(item)):
                    out.append((d, i, best))
    return sorted(out, key=str)


def test_equals_brute_force(spark, case):
    docs, items = case
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, BENCH)
    got = D.contaminated(df, bench).collect()
    assert sorted([(r.doc_id, r.item_id, r.distance) for r in got], key=str) == brute(docs, items)
    texts = {d: D.normalise(t or "") for d, t, _ in docs}
    wanted = {i: D.normalise(t or "") for i, t in items}
    for r in got:
        assert distances(wanted[r.item_id], texts[r.doc_id][r.start:r.end], True)[-1] == r.distance
    hit = {r.doc_id for r in got}
    kept = D.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted([d for d, _, _ in docs if d not in hit], key=str)


def test_blocks_lose_nothing(spark, case, monkeypatch):
    docs, items = case
    df, bench = spark.createDataFrame(docs[:20], DOCS), spark.createDataFrame(items, BENCH)
    whole = sorted(map(tuple, D.contaminated(df, bench).collect()), key=str)
    monkeypatch.setattr(D, "BLOCK_CHARS", 800)
    assert len(list(D.blocks(bench))) > 2
    assert sorted(map(tuple, D.contaminated(df, bench).collect()), key=str) == whole


def test_empty_tables(spark, case):
    docs, items = case
    none, bench = spark.createDataFrame([], DOCS), spark.createDataFrame(items, BENCH)
    assert D.contaminated(none, bench).count() == 0 and D.drop_contaminated(none, bench).count() == 0
    df = spark.createDataFrame(docs[:3], DOCS)
    empty = spark.createDataFrame([], BENCH)
    assert D.contaminated(df, empty).count() == 0 and D.drop_contaminated(df, empty).count() == 3


def test_given_table_exact_leaks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs, bench).where("distance = 0").collect()}
    items = [(r.item_id, D.normalise(r.text)) for r in bench.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items if t in D.normalise(r.text or "")}
    assert got == want and want


def test_short_items(spark):
    """Items of 1 to 24 characters, with and without spaces between words."""
    rng = random.Random(11)
    long_one = "wieviel kostet das ganze"
    items = [long_one[:n] for n in range(1, 25)] + ["中", "中国", "是不是", "日本語の文", "a中", "中a", "é", "Caf\u00e9!", "c'est", "  ", None]
    items = [(f"i{n}", t) for n, t in enumerate(items)]
    words = ["w", "wie", "wieviel", "kostet", "das ganze", "ganze", "中国", "中", "人是不是", "日本語の文章", "a", "é", "café", "cafés", "C'EST", long_one]
    docs = [(f"d{n}", rng.choice([" ", "", ", "]).join(rng.choices(words, k=rng.randint(1, 6)))) for n in range(150)]
    docs += [(f"x{n}", t) for n, (_, t) in enumerate(items)] + [(None, "中国"), ("d0", docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id string, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = brute([(d, t, "") for d, t in docs], items)
    got = D.contaminated(df, bench).collect()
    assert sorted([(r.doc_id, r.item_id, r.distance) for r in got], key=str) == want
    assert len({i for _, i, _ in want}) == 33
    hit = {d for d, _, _ in want}
    kept = sorted([r.doc_id for r in D.drop_contaminated(df, bench).collect()], key=str)
    assert kept == sorted([d for d, _ in docs if d not in hit], key=str)
