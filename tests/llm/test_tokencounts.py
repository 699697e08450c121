"""Section token counts against one token and one section after another."""

import public_tokenizers
import pytest

from simsift.llm import tokencounts as T
from simsift.llm.queries import RANKS

SCHEMA = "doc_id long, text string, lang string, source string, n_tokens string"


@pytest.fixture(scope="module")
def ranks(spark):
    return T.read_ranks(spark, RANKS)


def brute(encoder, fields):
    whole = "\n".join(fields)
    sections, at = [], 0
    for f in fields[:-1]:
        sections.append((at, at + len(f)))
        at += len(f) + 1
    for line in fields[-1].split("\n") if fields[-1] else []:
        sections.append((at, at + len(line)))
        at += len(line) + 1
    chars = [0]
    for b in whole.encode():
        chars.append(chars[-1] + ((b & 0xC0) != 0x80))
    count, crossing, pos, ids = [0] * len(sections), 0, 0, encoder.bpe.encode_ordinary(whole)
    for i in ids:
        n = len(encoder.bpe.decode_single_token_bytes(i))
        a, b = chars[pos], chars[pos + n]
        pos += n
        overlap = [max(0, min(b, y) - max(a, x)) for x, y in sections]
        k = overlap.index(max(overlap)) if max(overlap) else max((j for j, s in enumerate(sections) if s[0] <= a), default=0)
        count[k] += 1
        crossing += a < sections[k][0] or b > sections[k][1]
    n = len(fields) - 1
    return len(ids), crossing, count[:n], count[n:]


def test_equals_brute_force(spark, ranks):
    rows = [(-1, None, None, None, ""), (-2, "\n\n\n", "", "", ""), (-3, "\n日本\n\n😀x\n", "é😀", "", ""), (-4, "c", "a", "b", ""),
            (-5, "", "a\nb", "", ""), (None, "x\ny", "en", "s", ""), (-4, "c", "a", "b", ""),
            (-6, "tail\n \n \n  deep " + "long word " * 20_000, "en", "s", "")]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows += [(r.doc_id, r.text, r.lang, r.source, "") for r in docs.collect()]
    encoder = T.Encoder(ranks, public_tokenizers.PATTERN)
    df = spark.createDataFrame(rows, SCHEMA)
    out = T.count_tokens(df, ranks, public_tokenizers.PATTERN, ["lang", "source"], "text").collect()
    assert len(out) == len(rows)
    want = {r[0]: brute(encoder, [r[2] or "", r[3] or "", r[1] or ""]) for r in rows}
    for r in out:
        assert (r.n_tokens, r.n_crossing, [r.n_lang, r.n_source], r.line_tokens) == want[r.doc_id]
        assert r.n_lang + r.n_source + r.n_text == r.n_tokens and r.n_text == sum(r.line_tokens)
        assert r.n_lines == len(r.line_tokens)
    assert T.count_tokens(df.limit(0), ranks, public_tokenizers.PATTERN, ["lang"], "text").count() == 0
