"""Unigram Viterbi against the sentencepiece library and plain dynamic programming."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from simsift.llm import unigram as U
from simsift.llm.queries import PIECES

TEXTS = ["", " ", "a", "  x  y ", "\n\t\x00z", "日本語 テキスト 😀 é", "The quick brown fox jumps over the lazy dog. " * 20,
         "x" * 300 + " " + "é" * 100 + " end", "word " * 40, "ß" * 30]


@pytest.fixture(scope="module")
def file_model(spark):
    return U.read_model(spark, PIECES)


def test_equals_sentencepiece(spark, file_model):
    """The library's own unigram encoder over the same pieces, with scores that
    leave no ties."""
    proto = pb.ModelProto()
    with open(PIECES.removeprefix("file://"), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    rng = random.Random(3)
    scores = [float(np.float32(s + rng.uniform(-0.5, 0.5))) if k == "n" else float(s)
              for s, k in zip(file_model.scores, file_model.kinds)]
    for piece, score in zip(proto.pieces, scores):
        piece.score = score
    model = U.Model(file_model.pieces, scores, file_model.kinds)
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = TEXTS + [r.text for r in docs.collect()]
    for text in texts:
        ids = model.encode(text)
        if ids != library.encode(text):               # float32 sums in the library may order near ties otherwise
            def total(x):
                return sum(model.scores[i] for i in x if model.kinds[i] == "n")
            assert abs(total(ids) - total(library.encode(text))) < 1e-2 * (1 + len(ids) / 100)
        assert model.decode(ids) == text.replace("▁", " ") == library.decode(ids)


def plain(model, text):
    """Best score by dynamic programming over characters."""
    if not text:
        return 0.0, 0
    text = " " + text.replace("▁", " ")
    known = {p.replace("▁", " "): model.scores[i] for i, p in enumerate(model.pieces) if model.kinds[i] == "n"}
    best = [0.0] + [-math.inf] * len(text)
    for i in range(len(text)):
        for j in range(i + 1, len(text) + 1):
            score = known.get(text[i:j], best[0] + model.unknown if j == i + 1 else -math.inf)
            best[j] = max(best[j], best[i] + score)
    return best[-1], len(text)


@pytest.mark.parametrize("inner", [False, True])
def test_equals_plain_programme(inner):
    """A small vocabulary; with a marker inside a piece whole texts are encoded."""
    pieces = ["<unk>", "<s>", "▁", "a", "b", "ab", "ba", "▁a", "▁ab", "▁▁", "aba", "é", "éa"] + ["b▁a"] * inner
    rng = random.Random(2)
    scores = [0.0, 0.0] + [-rng.uniform(1, 9) for _ in pieces[2:]]
    model = U.Model(pieces, scores, "uc" + "n" * (len(pieces) - 2))
    assert model.split is not inner and not model.fallback
    for n in list(range(40)) + [200]:
        text = "".join(rng.choice("aabb é?") for _ in range(n))
        ids = model.encode(text)
        total = sum(model.scores[i] if model.kinds[i] == "n" else model.unknown for i in ids)
        assert total == pytest.approx(plain(model, text)[0])


def test_table(spark, file_model):
    rows = [(i, t, "ids") for i, t in enumerate(TEXTS)] + [(None, None, ""), (3, "  x  y ", ""), (99, "a▁b", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = U.encode(df, file_model, check=True)
    out = encoded.collect()
    decoded = {r.doc_id: r.back for r in U.decode(encoded.drop("round_trip"), file_model, to="back").collect()}
    assert decoded[None] is None and decoded[99] == "a b" and all(decoded[i] == t for i, t in enumerate(TEXTS))
    assert len(out) == len(rows) and all(r.round_trip for r in out)
    by = {r.doc_id: r for r in out}
    assert by[None].ids is None and by[0].ids == [] and by[0].n_tokens == 0
    assert all(r.ids == file_model.encode(TEXTS[r.doc_id]) for r in out if r.doc_id not in (None, 99))
    assert by[4].n_byte_tokens >= 3
    assert U.encode(df.limit(0), file_model, check=True).count() == 0


def test_decode_odd_ids(file_model):
    lists = pa.array([[1, 2, 0x7FFFFFF, -5], [3 + 0xC3], None, [], [file_model.unknown_id]], pa.list_(pa.int32()))
    assert file_model.decode_lists(lists).to_pylist() == [
        None if i is None else file_model.decode(i) for i in lists.to_pylist()]


def test_given_table_round_trip(spark, file_model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = U.encode(docs, file_model, check=True)
    assert out.count() == docs.count() and out.where("not round_trip").count() == 0


def test_double_array_holds_exactly_the_keys():
    rng = random.Random(4)
    keys = {bytes(rng.randrange(256) for _ in range(rng.randint(1, 6))): i for i in range(3000)}
    trie = U.DoubleArray.build(list(keys.items()))

    def find(key):
        state = 0
        for b in key:
            nxt = trie.base[state] + b + 1
            if trie.check[nxt] != state:
                return -1
            state = nxt
        return trie.value[state]
    assert all(find(k) == v for k, v in keys.items())
    for _ in range(3000):
        key = bytes(rng.randrange(256) for _ in range(rng.randint(1, 6)))
        assert find(key) == keys.get(key, -1)
