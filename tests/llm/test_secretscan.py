"""Secret scan against a plain scan of every text with every rule."""

import hashlib
import random
import re

import pytest

from simsift.llm import secretscan as S
from simsift.llm import trigrams as G

SCHEMA = "doc_id long, text string, spans string, hash int, rules string"
#: The contract's own words, apart from the operator's patterns.
PLAIN = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, re.I),
    ("access", r"AKIA[A-Z0-9]+", 0, 20, 0),
    ("hex", r"[0-9a-f]+", 0, 24, 0),
]
PIECES = ["password: hunter22", "PASSWD = 'short", "passwd='abcdef'", "API_KEY=xyz/123+=", "apikey:\"k.k-k_k", "Secret  == abcdef",
          "token\n=abcdef", "to ken=abcdef", "secretsecret=abcdef12", "AKIA" + "A1" * 8, "AKIA" + "A" * 15, "xAKIAAKIA" + "Z9" * 9,
          "0123456789abcdef01234567", "0123456789abcdef0123456", "deadbeef" * 9, "DEADBEEF" * 4, "é" * 3, "K", "toKen=abcdef",
          "ghp_" + "a" * 36, "xoxb-1234-5678-abcdefghij", "AIza" + "B" * 35, "sk_live_" + "9" * 24, "-----BEGIN RSA PRIVATE KEY-----",
          "https://user:pa55@host/x", "https://host/x", "\U0001f511", "plain words"]


def plain(text):
    text = text or ""
    found = []
    for k, (kind, pattern, group, least, flags) in enumerate(PLAIN):
        found += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text, flags | re.A)
                  if len(m.group(group)) >= least]
    base = ",".join(s for _, _, s in sorted(found))
    for k, rule in enumerate(S.ADDED, len(PLAIN)):
        found += [(m.start(), k, f"{rule.kind}:{m.start()}:{m.end()}") for m in re.finditer(rule.pattern, text, re.A)
                  if len(m.group(rule.group)) >= rule.least]
    counts = [sum(k == i for _, k, _ in found) for i in range(3)]
    return (*counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(s for _, _, s in sorted(found)))


def texts():
    rng = random.Random(7)
    out = [None, "", "a", "ab", *PIECES]
    out += [rng.choice(["", " ", "\n", "-", "x"]).join(rng.choices(PIECES, k=rng.randint(1, 12))) for _ in range(150)]
    out += ["".join(rng.choices("tokenapisecr=: 'AKI0f", k=60)) for _ in range(60)]
    return out


def check(got, rows):
    want = sorted((str(d), *plain(t)) for d, t in rows)
    assert sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in got) == want


def test_equals_plain(spark):
    rows = list(enumerate(texts()))
    rows += [(None, PIECES[0]), (None, None), (3, PIECES[9]), (3, PIECES[9]), (5, "no secret")]
    rows.append((10_000, "words and more " * 70_000 + "token=abcdef12 é " + "f" * 30))
    df = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], SCHEMA)
    got = S.secret_report(df.repartition(5)).collect()
    check(got, rows)
    assert sum(bool(r.spans) for r in got) > 100
    assert S.secret_report(df.limit(0)).count() == 0


def test_small_segments_and_shuffled_joins(spark, monkeypatch):
    monkeypatch.setattr(S, "small_bytes", lambda table: False)
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(str(d), t) for d, t in rows], "doc_id string, text string")
    found = S.find_secrets(df, segment_bytes=200)
    got = found.select("doc_id", S.written(found["spans"], S.BASE + S.ADDED).alias("s")).collect()
    assert {r.doc_id: r.s for r in got} == {str(d): plain(t)[-1] for d, t in rows}


def test_candidates_hold_the_trigrams(spark):
    rows = list(enumerate(texts()))
    keyed = S.keyed(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    rules = S.BASE + S.ADDED
    terms, full = S.queries_of(rules)
    assert [rules[r].kind for r in full] == ["hex"]
    index = S.build_index(keyed, sorted({t[3] for t in terms}), 500)
    got = {r.id: set(r.rules) for r in S.candidates(index, terms).collect()}
    patterns = S.compiled(rules)
    for d, text in rows:
        low = G.fold(text or "")
        for r, rule in enumerate(rules):
            if r in full:
                continue
            answers = any(all(g in low for g in c) for c in G.clauses(rule.pattern))
            assert (r in got.get(d, ())) == answers, (d, rule.kind)
            assert answers or not patterns[r].search(text or "")
    assert 0 < len(got) < len(rows)


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = S.secret_report(docs).collect()
    check(got, rows)
    assert any(r.n_assign for r in got)


@pytest.mark.parametrize("pattern, want", [
    ("abc", [{"abc"}]), ("ab", [set()]), ("abcd", [{"abc", "bcd"}]), ("ABC", [{"abc"}]),
    ("abc|xyzw", [{"abc"}, {"xyz", "yzw"}]), ("abc|x", [set()]), ("abc(d|e)", [{"abc", "bcd"}, {"abc", "bce"}]),
    ("abc?d", [{"abd"}, {"abc", "bcd"}]), ("abc*", [set()]), ("abc.*def", [{"abc", "def"}]), ("(?:abc)+", [{"abc"}]),
    ("(?:ab){2}", [{"aba", "bab"}]), ("a[xy]c", [{"axc"}, {"ayc"}]), ("a[^x]c", [set()]), (r"\bfoo\d+bar$", [{"foo", "bar"}]),
    ("ab[^x]{3}cde", [{"cde"}]), ("(abc)x\\1", [{"abc", "bcx"}]), ("abc(?=def)", [{"abc"}]),
])
def test_clauses(pattern, want):
    assert G.clauses(pattern) == frozenset(map(frozenset, want))


def test_clauses_never_lose_a_match():
    """Random patterns over a small alphabet: whatever matches answers the query."""
    rng = random.Random(3)

    def pattern(depth):
        kind = rng.choice("llllcsrgo" if depth else "lc")
        if kind == "l":
            return "".join(rng.choices("abAB", k=rng.randint(1, 4)))
        if kind == "c":
            return rng.choice(["[ab]", "[^a]", ".", "[A-C]", "b?"])
        if kind == "s":
            return pattern(depth - 1) + pattern(depth - 1)
        if kind == "r":
            return f"(?:{pattern(depth - 1)}){rng.choice(['*', '+', '?', '{2}', '{1,3}', '{2,}', '+?'])}"
        if kind == "g":
            return f"({pattern(depth - 1)})"
        return f"(?:{pattern(depth - 1)}|{pattern(depth - 1)})"
    matched = useful = 0
    for _ in range(400):
        p = pattern(4) + pattern(3)
        found = G.clauses(p)
        useful += frozenset() not in found
        for _ in range(60):
            text = "".join(rng.choices("aabbABc", k=rng.randint(0, 14)))
            if re.search(p, text, re.A):
                matched += 1
                assert any(all(g in G.fold(text) for g in c) for c in found), (p, text)
    assert matched > 2000 and useful > 50
