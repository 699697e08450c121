"""The numpy word scanner against Python's regular expressions."""

import re

import pyarrow as pa

from simsift.llm import words as W

TEXTS = ["", None, "a", "one two  three\tfour five six", "É é Ab aB", "x\x0by\x1cz", "tail ", " head", "\n\n",
         "a b c d", "ünï cödé 日本語 😀 ok", "Same same SAME sAme same same", "w " * 3000]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def check(members, pattern, limit):
    seen, back = {}, {}
    for lo, hi, chunk in W.chunks(pa.array(TEXTS), limit):
        starts, ends, ptr = chunk.spans(members)
        hashes = chunk.hashes(starts, ends, lower=True)
        for whole in (True, False):
            runs, rptr = W.windows(hashes, ptr, 5, whole)
            distinct, dptr = W.distinct_sorted(runs.copy(), rptr)
            for i in range(lo, hi):
                words = re.findall(pattern, lower(TEXTS[i]))
                a, b = ptr[i - lo], ptr[i - lo + 1]
                assert [lower(chunk.text(x, y)) for x, y in zip(starts[a:b], ends[a:b])] == words
                want = [tuple(words[j:j + 5]) for j in range(len(words) - 4)]
                if whole and 0 < len(words) < 5:
                    want = [tuple(words)]
                got = runs[rptr[i - lo]:rptr[i - lo + 1]].tolist()
                assert len(got) == len(want)
                assert dptr[i - lo + 1] - dptr[i - lo] == len(set(want))
                for key, value in [*zip(want, got), *zip(words, hashes[a:b].tolist())]:
                    assert seen.setdefault(key, value) == value and back.setdefault(value, key) == key


def test_spaced_words():
    check(W.SPACED, r"[^\x20\x09-\x0D]+", 1 << 20)
    check(W.SPACED, r"[^\x20\x09-\x0D]+", 10)


def test_alnum_words():
    check(W.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", 30)


def test_slices_and_empty():
    assert list(W.chunks(pa.array([], pa.string()))) == []
    column = pa.array(["x", "one two", "three"]).slice(1)
    (lo, hi, chunk), = W.chunks(column)
    assert (lo, hi) == (0, 2) and chunk.text(*chunk.off[:2]) == "one two"
