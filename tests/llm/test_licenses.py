"""License scan against plain phrase search."""

import re

from simsift.llm import licenses as L

SCHEMA = "doc_id long, text string, labels string"


def base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at, labels = [], set()
    for phrase, label in L.BASE.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


MIT = list(L.NOTICES)[9]
TEXTS = ["", None, "MIT", "mit license", "MIT-License, mit\nLICENSE; apache license", "cc by cc by cc by",
         "gnu general public general public license", "GNU General Public License " * 3, "é cc\u00a0by by", MIT.upper(),
         MIT.replace("free of charge", "FREE, of any charge"),            # words put in: neighbouring diagonals
         MIT.replace("hereby granted ", ""), " ".join(MIT.split()[:6]),
         "filler " * 20_000 + "apache license", "cc by nc 4.0"]


def test_base_and_notices(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "mit license", ""), (3, "mit license", "")],
                               SCHEMA)
    rows = L.scan_licenses(df).collect()
    assert len(rows) == len(TEXTS) + 2 and sum(r.doc_id == 3 for r in rows) == 2
    got = {r.doc_id: r for r in rows}
    for i, t in enumerate(TEXTS):
        g = got[i]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == base(t), t
        assert 0 <= g.score <= 1 and (g.score > 0) == bool(g.labels)
    mit = TEXTS.index(MIT.upper())
    assert got[mit].labels == "mit" and got[mit].score == 1.0
    assert got[mit + 1].labels == "mit" and 0.8 <= got[mit + 1].score < 1
    assert got[mit + 2].labels == "mit"
    assert got[mit + 3].labels == ""
    assert got[len(TEXTS) - 1].labels == "cc-by,cc-by-nc"
    assert L.scan_licenses(df.limit(0)).count() == 0


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for g in L.scan_licenses(docs).collect():
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == base(texts[g.doc_id])


def test_spans_are_verified(spark):
    """Repeated and reversed parts of a template are not the template."""
    terms = list(L.NOTICES)[12]
    words = terms.split()
    cases = [("CC BY, CC BY-SA", "cc-by,cc-by-sa", 1.0), ("cc by cc by", "cc-by", 1.0), ("cc by cc by cc by", "cc-by", 1.0),
             ("public license or public license", "", 0.0), ("by nc cc by", "cc-by", 1.0),
             ("mozilla public or public license", "mpl", 1.0), ("cc by by nc", "cc-by,cc-by-nc", 1.0),
             (" ".join(words[:6] * 4), "", 0.0), (" ".join(words[:7] + ["x"] + words[7:]), "gpl", 14 / 15),
             ("public license " * 5_000, "", 0.0), (" ".join(words[:15] + words[13:]), "gpl", 1.0)]
    df = spark.createDataFrame([(i, t, "") for i, (t, _, _) in enumerate(cases)], SCHEMA)
    got = {r.doc_id: (r.labels, r.score) for r in L.scan_licenses(df).collect()}
    for i, (text, labels, score) in enumerate(cases):
        assert got[i] == (labels, score), text[:80]
