"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The model is a list of pieces with log scores (from a SentencePiece file; a file
of the BPE kind has ranks instead of scores, which are read as the log
frequencies of Zipf's law).  Encoding marks a space before the text, reads every
space as the marker U+2581, and takes the segmentation with the highest sum of
scores; characters that no piece covers cost the lowest score minus 10 and become
byte pieces.  Decoding joins the pieces, turns byte pieces back into bytes and
markers into spaces, and drops the first space.

Pieces have markers only at their start, so the best segmentation of a text is
that of its space-delimited segments one after another; each distinct segment of
a chunk is encoded once.  Short segments are walked through the trie and the
dynamic programme side by side with numpy, long ones one by one.  A vocabulary
with a marker inside a piece is encoded by whole texts.

In the trie a marker is the byte 0x20, which no piece contains otherwise.

Defined results: a null text has null ids, an empty one none; U+2581 in a text is
read as a space (as in SentencePiece); equal scores: the piece that starts first
wins; ids that are no piece decode to nothing; repeated rows are encoded each; an
empty table gives an empty result; other columns are not looked at."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simsift.llm import words as W

MARK = "▁"
UNKNOWN_COST = 10.0
SHORT = 48                      # bytes of a segment that numpy walks
CHUNK_BYTES = 1 << 19
DECODE_ROWS = 500
SEGMENTS = 8_000                # short segments that are walked side by side
MAX_MODEL_BYTES = 64 << 20


class DoubleArray:
    """Double-array trie over bytes: ``check[base[s] + byte + 1] == s`` marks the
    transition, ``value`` the id of the piece that ends in a state (or -1)."""

    def __init__(self, base: np.ndarray, check: np.ndarray, value: np.ndarray):
        self.base, self.check, self.value = base, check, value

    @classmethod
    def build(cls, keys: list[tuple[bytes, int]]) -> DoubleArray:
        children: list[dict[int, int]] = [{}]
        ends = {}
        for key, value in keys:
            node = 0
            for b in key:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                node = children[node][b]
            ends[node] = value
        size = max(1024, 2 * len(children) + 1024)
        base, check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        value = np.full(size, -1, np.int32)
        used = np.zeros(size, bool)
        used[0] = True
        place, free = {0: 0}, 1
        for node in range(len(children)):                     # parents come before children
            state = place[node]
            value[state] = ends.get(node, -1)
            codes = np.array(sorted(children[node]), np.int64) + 1
            if not len(codes):
                continue
            while True:                                       # first fit, a window of slots at a time
                while free + 4096 > len(used):
                    more = len(used)
                    base, check = np.append(base, np.zeros(more, np.int32)), np.append(check, np.full(more, -1, np.int32))
                    value, used = np.append(value, np.full(more, -1, np.int32)), np.append(used, np.zeros(more, bool))
                at = np.flatnonzero(~used[free:free + 2048]) + free - codes[0]
                at = at[at >= 0]
                fits = np.flatnonzero(~used[at[:, None] + codes].any(axis=1))
                if len(fits):
                    at = int(at[fits[0]])
                    break
                free += 1024                                  # too full for this node: leave it behind
            base[state] = at
            check[at + codes], used[at + codes] = state, True
            for c in codes.tolist():
                place[children[node][c - 1]] = at + c
        n = int(np.flatnonzero(used)[-1]) + 300               # every state + byte stays in bounds
        pad = max(0, n - len(base))
        return cls(np.pad(base, (0, pad))[:n], np.pad(check, (0, pad), constant_values=-1)[:n],
                   np.pad(value, (0, pad), constant_values=-1)[:n])


class Model:
    """Pieces, scores and the trie.  ``kinds``: n normal, b byte, u unknown,
    c control (never used for text)."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: str, trie: DoubleArray | None = None):
        self.pieces, self.kinds = pieces, kinds
        self.scores = np.array(scores, np.float64)
        normal = [i for i, k in enumerate(kinds) if k == "n"]
        self.unknown_id = kinds.index("u")
        self.unknown = float(self.scores[normal].min()) - UNKNOWN_COST if normal else -UNKNOWN_COST
        self.byte_ids = np.full(256, -1, np.int64)
        for i, k in enumerate(kinds):
            if k == "b":
                self.byte_ids[int(pieces[i][3:5], 16)] = i
        self.fallback = bool((self.byte_ids >= 0).all())
        raw = [p.replace(MARK, " ").encode() for p in pieces]
        self.trie = trie or DoubleArray.build([(raw[i], i) for i in normal if raw[i]])
        self.longest = max((len(raw[i]) for i in normal), default=1)
        self.split = all(b" " not in raw[i].lstrip(b" ") for i in normal)
        # What a piece decodes to.
        self.bytes = [bytes([int(p[3:5], 16)]) if k == "b" else r if k == "n" else b" \xe2\x81\x87 " if k == "u" else b""
                      for p, k, r in zip(pieces, kinds, raw, strict=True)]

    def __reduce__(self):
        return Model, (self.pieces, self.scores.tolist(), self.kinds, self.trie)    # workers don't build it again

    # -- encoding ---------------------------------------------------------------
    def _long(self, raw: bytes) -> list[int]:
        """Viterbi over one segment, one position after another."""
        base, check, value = (a.tolist() for a in (self.trie.base, self.trie.check, self.trie.value)) \
            if not hasattr(self, "_lists") else self._lists
        self._lists = base, check, value
        scores = self._score_list = getattr(self, "_score_list", None) or self.scores.tolist()
        n = len(raw)
        best, back, piece = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for at in range(n):
            if best[at] == -math.inf:
                continue
            b = raw[at]
            width = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
            state, here, single = 0, best[at], False
            for end in range(at + 1, min(n, at + self.longest) + 1):
                nxt = base[state] + raw[end - 1] + 1
                if check[nxt] != state:
                    break
                state = nxt
                if value[state] >= 0:
                    single = single or end - at == width
                    score = here + scores[value[state]]
                    if score > best[end]:
                        best[end], back[end], piece[end] = score, at, value[state]
            if not single and here + self.unknown > best[at + width]:
                best[at + width], back[at + width], piece[at + width] = here + self.unknown, at, -1
        out, at = [], n
        while at:
            out.append((back[at], at, piece[at]))
            at = back[at]
        ids = []
        for a, b, p in reversed(out):
            ids += [p] if p >= 0 else self.byte_ids[list(raw[a:b])].tolist() if self.fallback else [self.unknown_id]
        return ids

    def _short(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi over many segments at once: (ids, pointers)."""
        size = (ends - starts).astype(np.int32)
        wide, rows = int(size.max(initial=0)), len(starts)
        text = np.zeros((rows, wide), np.int32)
        inside = np.arange(wide) < size[:, None]
        text[inside] = buf[(starts[:, None] + np.arange(wide))[inside]]
        head = inside & ((text & 0xC0) != 0x80)
        width = np.where(text < 0x80, 1, np.where(text < 0xE0, 2, np.where(text < 0xF0, 3, 4)))
        best = np.full((rows, wide + 1), -np.inf)
        best[:, 0] = 0.0
        back, piece = np.zeros((rows, wide + 1), np.int32), np.full((rows, wide + 1), -1, np.int32)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for at in range(wide):
            row = np.flatnonzero(head[:, at])
            if not len(row):
                continue
            here, one = best[row, at], width[row, at]
            single = np.zeros(len(row), bool)
            live, state = np.arange(len(row)), np.zeros(len(row), np.int64)
            for end in range(at + 1, min(wide, at + self.longest) + 1):
                r = row[live]
                nxt = base[state] + text[r, end - 1] + 1
                ok = (check[nxt] == state) & (size[r] >= end)
                live, state = live[ok], nxt[ok]
                if not len(live):
                    break
                hit = value[state] >= 0
                who, ids = live[hit], value[state[hit]]
                single[who[one[who] == end - at]] = True
                r, score = row[who], here[who] + self.scores[ids]
                won = score > best[r, end]
                r = r[won]
                best[r, end], back[r, end], piece[r, end] = score[won], at, ids[won]
            lost = ~single
            r, end, score = row[lost], at + one[lost], here[lost] + self.unknown
            won = score > best[r, end]
            r, end = r[won], end[won]
            best[r, end], back[r, end], piece[r, end] = score[won], at, -1
        # Walk back, all rows together; unknown characters become their bytes.
        at, row = size.copy(), np.arange(rows)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []       # (row, byte place, id)
        while True:
            row = row[at[row] > 0]
            if not len(row):
                break
            a, b, p = back[row, at[row]], at[row], piece[row, at[row]]
            known = p >= 0
            parts.append((row[known], a[known], p[known]))
            r, a2, b2 = row[~known], a[~known], b[~known]
            if self.fallback:
                for j in range(4):
                    more = a2 + j < b2
                    parts.append((r[more], (a2 + j)[more], self.byte_ids[text[r[more], (a2 + j)[more]]]))
            else:
                parts.append((r, a2, np.full(len(r), self.unknown_id)))
            at[row] = a
        if not parts:
            return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64)
        r, a, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(r * (wide + 1) + a, kind="stable")
        return ids[order].astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(r, minlength=rows))])

    def encode_chunk(self, chunk: W.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """(ids, pointers) of the chunk's texts, each beginning with its marker
        (byte 0x20) unless it is empty."""
        buf, off = chunk.buf, chunk.off
        first = np.zeros(len(buf) + 1, bool)
        first[off[:-1][off[:-1] < off[1:]]] = True
        if self.split:
            space = buf == 0x20
            first[1:-1] |= space[1:] & ~space[:-1]
        starts = np.flatnonzero(first[:-1])
        ends = np.append(starts[1:], len(buf))
        keys = chunk.hashes(starts, ends)
        _, where, which = np.unique(keys, return_index=True, return_inverse=True)
        a, b = starts[where], ends[where]
        order = np.argsort(b - a, kind="stable")                # blocks of alike length
        short = order[(b - a)[order] <= SHORT]
        ids: list[np.ndarray] = []
        size = np.zeros(len(a), np.int64)
        place = np.zeros(len(a), np.int64)
        total = 0
        for part in np.array_split(short, max(1, len(short) // SEGMENTS)):
            made, ptr = self._short(buf, a[part], b[part])
            size[part], place[part] = np.diff(ptr), total + ptr[:-1]
            total += len(made)
            ids.append(made)
        for i in order[(b - a)[order] > SHORT].tolist():
            made = self._long(buf[a[i]:b[i]].tobytes())
            size[i], place[i] = len(made), total
            total += len(made)
            ids.append(np.array(made, np.int32))
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        n = size[which]
        to = np.concatenate([[0], np.cumsum(n)])
        out = flat[np.repeat(place[which] - to[:-1], n) + np.arange(to[-1])]
        return out, to[np.searchsorted(starts, off)]

    def encode(self, text: str) -> list[int]:
        return self.encode_chunk(next(marked(pa.array([text])))[2])[0].tolist()

    # -- decoding ---------------------------------------------------------------
    def decode(self, ids) -> str:
        table = self.bytes
        raw = b"".join([table[i] for i in ids if 0 <= i < len(table)])
        return raw[raw[:1] == b" ":].decode("utf-8", "replace")

    def decode_lists(self, lists: pa.ListArray) -> pa.Array:
        """The texts of a column of id lists."""
        n, null = len(lists), np.asarray(lists.is_null())
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        count = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
        size = np.array([len(b) for b in self.bytes] + [0], np.int64)
        place = np.concatenate([[0], np.cumsum(size)])[:-1]
        ids = np.where((ids >= 0) & (ids < len(self.bytes)), ids, len(self.bytes))
        ends = np.cumsum(size[ids])
        table = np.frombuffer(b"".join(self.bytes), np.uint8)
        raw = table[np.repeat(place[ids] - (ends - size[ids]), size[ids]) + np.arange(ends[-1] if len(ends) else 0)]
        off = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(count)])]
        # Drop the space that encoding put before each text.
        full = off[:-1] < off[1:]
        first = off[:-1][full]
        drop = np.zeros(len(raw), bool)
        drop[first] = raw[first] == 0x20
        off = off - np.concatenate([[0], np.cumsum(drop)])[off]
        texts = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), n, [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(raw[~drop].tobytes())])
        try:
            out = texts.cast(pa.large_string())
        except pa.ArrowInvalid:                               # ids that do not spell UTF-8
            out = pa.array([b.decode("utf-8", "replace") for b in texts.to_pylist()], pa.large_string())
        return pc.if_else(pa.array(null), pa.scalar(None, pa.large_string()), out).cast(pa.string())


def read_model(spark: SparkSession, path: str) -> Model:
    """A SentencePiece model file from any path that Spark reads; the file is
    refused beyond MAX_MODEL_BYTES."""
    import sentencepiece

    found = spark.read.format("binaryFile").load(path).select("length", "content")
    if (size := found.select("length").first()[0]) > MAX_MODEL_BYTES:
        raise ValueError(f"{path}: {size} bytes; a model may have {MAX_MODEL_BYTES}")
    p = sentencepiece.SentencePieceProcessor(model_proto=bytes(found.first()["content"]))
    n = p.get_piece_size()
    kinds = "".join("b" if p.is_byte(i) else "u" if p.is_unknown(i) else "c" if p.is_control(i) or p.is_unused(i)
                    else "n" for i in range(n))
    scores = [p.get_score(i) for i in range(n)]
    # Ranks (of the BPE kind) are whole numbers that fall by one, with gaps.
    normal = [s for s, k in zip(scores, kinds, strict=True) if k == "n" and s > -1e8]
    if normal and max(normal) - min(normal) > len(normal) / 2 and all(s == int(s) for s in normal):
        scores = [zipf(s, n) for s in scores]
    return Model([p.id_to_piece(i) for i in range(n)], scores, kinds)


def zipf(score: float, n: int) -> float:
    """Log probability of the piece with rank -score among n, by Zipf's law."""
    rank = min(-score, n) + 1
    return -math.log(rank) - math.log(math.log(n) + 0.5772)


def marked(column: pa.Array) -> Iterator[tuple[int, int, W.Chunk]]:
    """Chunks of the texts with a space before each that is not empty, and the
    literal marker read as a space."""
    column = pc.replace_substring(column.fill_null("").cast(pa.large_string()), MARK, " ")
    space, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    column = pc.if_else(pc.equal(column, none), column, pc.binary_join_element_wise(space, column, none))
    yield from W.chunks(column, CHUNK_BYTES)


_MODELS: dict[str, Model] = {}


def _model(broadcast, key: str) -> Model:
    """The broadcast model, built once in each Python worker."""
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = broadcast.value
    return _MODELS[key]


def _key(model: Model) -> str:
    return hashlib.sha256(repr((model.pieces, model.scores.tolist(), model.kinds)).encode()).hexdigest()


def encode(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
           check: bool = False) -> DataFrame:
    """(id_col, ids, n_tokens, n_byte_tokens) for every row; with ``check`` also
    ``round_trip``: the ids are decoded again and the text compared (U+2581 read
    as a space)."""
    shipped, key = docs.sparkSession.sparkContext.broadcast(model), _key(model)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(shipped, key)
        is_byte = np.array([k == "b" for k in m.kinds])
        for batch in batches:
            for lo, hi, chunk in marked(batch.column(1)):
                ids, ptr = m.encode_chunk(chunk)
                null = np.asarray(batch.column(1).slice(lo, hi - lo).is_null())
                before = np.concatenate([[0], np.cumsum(is_byte[ids])])
                lists = pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32), mask=np.append(null, False)),
                                                 pa.array(ids, pa.int32())) if null.any() else W.list_array(ids, ptr)
                columns = [batch.column(0).slice(lo, hi - lo), lists, pa.array(np.diff(ptr), pa.int64(), mask=null),
                           pa.array(np.diff(before[ptr]), pa.int64(), mask=null)]
                if check:
                    text = batch.column(1).slice(lo, hi - lo).cast(pa.string())
                    same = pc.equal(m.decode_lists(lists), pc.replace_substring(text, MARK, " "))
                    columns.append(pc.if_else(text.is_null(), lists.is_null(), pc.fill_null(same, False)))
                yield pa.record_batch(columns, names=names)

    names = ["id", "ids", "n_tokens", "n_byte_tokens"] + ["round_trip"] * check
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(kernel, f"id {kind}, ids array<int>, n_tokens long, n_byte_tokens long"
                           + ", round_trip boolean" * check).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model: Model, ids_col: str = "ids", to: str = "text") -> DataFrame:
    """``encoded`` with the decoded text in column ``to``; null ids: null."""
    shipped, key = encoded.sparkSession.sparkContext.broadcast(model), _key(model)
    names, at = encoded.columns, encoded.columns.index(ids_col)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(shipped, key)
        for batch in batches:
            for lo in range(0, len(batch), DECODE_ROWS):
                part = batch.slice(lo, DECODE_ROWS)
                yield pa.record_batch(list(part.columns) + [m.decode_lists(part.column(at))], names=names + [to])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields] + [f"`{to}` string"])
    return encoded.mapInArrow(kernel, schema)
