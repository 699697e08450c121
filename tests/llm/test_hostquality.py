"""Quality measures against plain Python; the host prior; the filter."""

import re
from collections import Counter

from simsift.llm import hostquality as H

SCHEMA = "doc_id long, text string, source string, kept string, n_words int"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if runs[tuple(words[i:i + 3])] > 1 for j in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered),
            len(words) < 50 or 100 * len(covered) > 50 * len(words))


GOOD = " ".join(f"word{i}" for i in range(60))
TEXTS = ["", None, "a b c a b c", "x\nx\n\nx \n x", "### $$$ é||é", "a a a a a", "one\r\ntwo\r\none\r\n", "\x1c \x85", GOOD,
         GOOD + "\n" + GOOD, "l1 é\nl1 é\nl2\n" * 30, " ".join(f"w{i}" for i in range(30_000))]


def test_measures(spark):
    df = spark.createDataFrame([(i, t, "s", "", 1) for i, t in enumerate(TEXTS)], SCHEMA)
    for r in H.host_quality(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(TEXTS[r.doc_id])
        assert not (r.base_failed and r.kept)


def symbols(n):
    return " ".join(f"word{i}" for i in range(60)) + " #" * n


def test_hosts_change_the_verdict(spark):
    """One failed rule passes on a good host, not on one where most fail."""
    rows = [(i, GOOD + f" x{i}", "good", "", 1) for i in range(50)] + [(100, symbols(30), "good", "", 1)]
    rows += [(200 + i, symbols(25 + i), "bad", "", 1) for i in range(30)] + [(300, GOOD + " y", "bad", "", 1)]
    rows += [(400, symbols(30), "one", "", 1), (500, symbols(200), "good", "", 1), (600, symbols(30), None, "", 1),
             (100, symbols(30), "good", "", 1)]
    rows += [(1000 + i, GOOD + f" z{i}", f"host{i}", "", 1) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = H.host_quality(df).collect()
    assert len(out) == len(rows)
    kept = {r.doc_id: r.kept for r in out}
    assert kept[100] and not kept[205] and kept[300] and not kept[500]
    assert kept[400], "one failure of a host seen once is shrunk towards the others"
    assert all(kept[i] for i in range(50))
    left = H.drop_low_quality(df)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(r.doc_id for r in out if r.kept)
    assert H.host_quality(df.limit(0)).count() == 0 and H.drop_low_quality(df.limit(0)).count() == 0


def test_single_documents_condemn_no_host(spark):
    """A long tail of hosts with one document each tells nothing about any of them."""
    rows = [(i, symbols(30) + f" y{i}" if i % 5 < 2 else GOOD + f" y{i}", f"h{i}", "", 1) for i in range(200)]
    assert all(r.kept and not r.host_strict for r in H.host_quality(spark.createDataFrame(rows, SCHEMA)).collect())
    # Hosts of many documents still are told apart.
    more = rows + [(1000 + i, symbols(25 + i), "bad", "", 1) for i in range(40)] \
        + [(2000 + i, GOOD + f" z{i}", "good", "", 1) for i in range(300)]
    out = {r.doc_id: (r.kept, r.host_strict) for r in H.host_quality(spark.createDataFrame(more, SCHEMA)).collect()}
    assert all(out[1000 + i] == (False, True) for i in range(40))
    assert all(out[2000 + i] == (True, False) for i in range(300))


def test_rules_have_rates_of_their_own(spark):
    """Documents that fail different rules don't add up to a strict host."""
    long = " ".join("x" * 20 for _ in range(2)) + " " + " ".join(f"{'y' * 17}{i}" for i in range(60))
    lines = "\n".join(["one line here"] * 4 + [f"word{i} a{i} b{i} c{i} d{i} e{i} f{i} g{i} h{i}" for i in range(7)])
    kinds = [symbols(30), long, lines, GOOD]
    rows = [(i, kinds[i % 4] + f" {i}", "mixed", "", 1) for i in range(80)]
    rows += [(100 + i, GOOD + f" {i}", f"other{i % 9}", "", 1) for i in range(90)]
    out = H.host_quality(spark.createDataFrame(rows, SCHEMA)).collect()
    assert not any(r.host_strict for r in out) and all(r.kept for r in out)


def test_prior():
    assert H.likeness(0, 0, 0, 0, 0.0) == 0 and H.likeness(1, 9, 81, 4, 16 / 9) == 0
    assert H.likeness(200, 200, 200, 80, 80.0) == 0 and H.weight(0.0) == H.MAX_PRIOR
    assert H.likeness(2, 20, 200, 10, 10.0) == 1 and H.weight(1.0) == H.MIN_PRIOR       # all or none
    # Four hosts of ten documents, 8, 6, 4 and 2 of them failed: 2 / 3 between, 2 / 9 within.
    assert abs(H.weight(H.likeness(4, 40, 400, 20, 12.0)) - 5) < 1e-9


def test_clashing_columns(spark):
    rows = [(1, symbols(30), "a"), (2, GOOD, "b"), (3, "short", None)]
    df = spark.createDataFrame([r + (7, "k", "h", 0, "x") for r in rows],
                               "doc_id long, text string, source string, _q_n_words int, _Q_kept string, host string, "
                               "c0 int, `a.b` string")
    left = H.drop_low_quality(df)
    assert left.schema == df.schema
    assert sorted((r.doc_id, r._q_n_words, r["a.b"]) for r in left.collect()) == [(1, 7, "x"), (2, 7, "x")]


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in H.host_quality(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(texts[r.doc_id])
