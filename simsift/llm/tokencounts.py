"""Token counts of sections by offset mapping.

The fields of a row are joined by a newline into one document and encoded once,
as a whole, with a byte-level BPE, so a token may cross from one section to the
next.  The bytes of the tokens give every token's character span; sections are
the fields, and within the body field its lines; the spans are joined to the
sections as intervals (both sorted: binary search for a whole batch at once).

Allocation rule: a token counts for the section it overlaps with the most
characters, for the earlier one if equal; a token inside separators only (the
newline between two sections) counts for the section before it, or the first.  So
section counts always add up to the tokens of the document.  A character belongs
to the token that holds its first byte.

Defined results: null fields are empty; a document without characters has one
section per field, an empty body has no line, and no tokens; empty sections count
0; repeated rows are counted each; an empty table gives an empty result; other
columns are not looked at."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simsift.llm import words as W

SEPARATOR = "\n"
CHUNK_BYTES = 1 << 19
MAX_VOCABULARY_BYTES = 64 << 20


def read_ranks(spark: SparkSession, path: str) -> bytes:
    """A vocabulary file (base64 token, rank) from any path that Spark reads;
    refused beyond MAX_VOCABULARY_BYTES."""
    found = spark.read.format("binaryFile").load(path).select("length", "content")
    if (size := found.select("length").first()[0]) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path}: {size} bytes; a vocabulary may have {MAX_VOCABULARY_BYTES}")
    return bytes(found.first()["content"])


class Encoder:
    """tiktoken's byte-level BPE with the byte length of every token."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.bpe = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.size = np.zeros(max(table.values()) + 1, np.int64)
        for token, rank in table.items():
            self.size[rank] = len(token)

    def spans(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Byte ends of all tokens over the concatenated texts, and pointers."""
        ids = [np.asarray(self.bpe.encode_to_numpy(t, disallowed_special=())) for t in texts]
        ptr = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int64)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        return np.cumsum(self.size[flat]), ptr


def allocate(ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The section of every token.  Tokens tile 0 .. ends[-1] (characters, in
    order, possibly empty); sections [a, b) are sorted and do not overlap, and a
    token touches at most the sections between its first and last one."""
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    before = np.maximum(np.searchsorted(a, begins, side="right") - 1, 0)      # last that starts at or before
    last = np.maximum(np.searchsorted(a, ends, side="left") - 1, before)      # last that starts before the end
    best, most = before.copy(), np.maximum(np.minimum(ends, b[before]) - np.maximum(begins, a[before]), 0)
    step, live = 1, np.flatnonzero(last > before)
    while len(live):
        at = before[live] + step
        overlap = np.minimum(ends[live], b[at]) - np.maximum(begins[live], a[at])
        won = overlap > most[live]
        best[live[won]], most[live[won]] = at[won], overlap[won]
        step += 1
        live = live[last[live] >= before[live] + step]
    return best


_ENCODERS: dict[int, Encoder] = {}


def _encoder(ranks: bytes, pattern: str) -> Encoder:
    key = hash((ranks, pattern))
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(ranks, pattern)
    return _ENCODERS[key]


def _sections(batch: pa.RecordBatch, chunk: W.Chunk, lo: int, hi: int, chars: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, field or -1, start, end) of the sections of a chunk in order;
    the last field's sections are its lines (field -1)."""
    fields = batch.columns[2:]
    at = chunk.off[:-1].astype(np.int64)
    rows, kinds, starts, ends = [], [], [], []
    n = hi - lo
    for i, column in enumerate(fields[:-1]):
        size = pc.binary_length(column.slice(lo, n).cast(pa.binary())).to_numpy(zero_copy_only=False).astype(np.int64)
        rows.append(np.arange(n))
        kinds.append(np.full(n, i))
        starts.append(at)
        ends.append(at + size)
        at = at + size + 1
    # Lines of the body; a body without characters has none.
    newline = np.flatnonzero(chunk.buf == 0x0A)
    doc = np.searchsorted(chunk.off, newline, side="right") - 1
    newline, doc = newline[newline >= at[doc]], doc[newline >= at[doc]]
    full = np.flatnonzero(at < chunk.off[1:])
    a = np.concatenate([at[full], newline + 1])
    b = np.concatenate([newline, chunk.off[1:][full]])
    a.sort()
    b.sort()
    rows.append(np.sort(np.concatenate([full, doc])))
    kinds.append(np.full(len(a), -1))
    starts.append(a)
    ends.append(b)
    rows, kinds, starts, ends = (np.concatenate(x) for x in (rows, kinds, starts, ends))
    order = np.lexsort((np.arange(len(rows)), starts, rows))
    return rows[order], kinds[order], chars[starts[order]], chars[ends[order]]


def _kernel(ranks, pattern: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks.value, pattern)
        for batch in batches:
            for lo, hi, chunk in W.chunks(batch.column(1), CHUNK_BYTES):
                n = hi - lo
                # Characters before each byte; a character counts where it begins.
                chars = np.concatenate([[0], np.cumsum((chunk.buf & 0xC0) != 0x80)])
                raw = chunk.buf.tobytes()
                byte_ends, ptr = encoder.spans([raw[a:b].decode() for a, b in zip(
                    chunk.off[:-1].tolist(), chunk.off[1:].tolist(), strict=True)])
                rows, kinds, a, b = _sections(batch, chunk, lo, hi, chars)
                # One axis for all texts: each text is moved one character on, so
                # no token can touch a section of its neighbours.
                text = np.repeat(np.arange(n), np.diff(ptr))
                ends = chars[byte_ends] if len(byte_ends) else np.zeros(0, np.int64)
                section = np.zeros(len(text), np.int64)
                sptr = np.searchsorted(rows, np.arange(n + 1))
                for d in range(n):
                    s, e = ptr[d], ptr[d + 1]
                    if e > s:
                        base = chars[chunk.off[d]]
                        section[s:e] = sptr[d] + allocate(ends[s:e] - base, a[sptr[d]:sptr[d + 1]] - base,
                                                          b[sptr[d]:sptr[d + 1]] - base)
                count = np.bincount(section, minlength=len(rows)) if len(rows) else np.zeros(0, np.int64)
                begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                crossing = (begins < a[section]) | (ends > b[section]) if len(ends) else np.zeros(0, bool)
                crossed = np.bincount(text[crossing], minlength=n)
                out = [batch.column(0).slice(lo, n), pa.array(np.diff(ptr)), pa.array(crossed.astype(np.int64))]
                for i in range(len(names)):
                    out.append(pa.array(count[kinds == i].astype(np.int64)))
                line = kinds == -1
                lptr = np.searchsorted(rows[line], np.arange(n + 1))
                out.append(W.list_array(count[line].astype(np.int64), lptr))
                yield pa.record_batch(out, names=["id", "n_tokens", "n_crossing", *[f"n_{x}" for x in names], "line_tokens"])
    return run


def count_tokens(docs: DataFrame, ranks: bytes, pattern: str, fields: list[str], body: str,
                 id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_tokens, n_crossing, n_<field> for each field, n_<body>,
    n_lines, line_tokens) for every row; ``line_tokens`` has the tokens of each
    line of the body, ``n_<body>`` their sum."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [*fields, body]]
    whole = reduce(lambda x, y: F.concat(x, F.lit(SEPARATOR), y), parts)
    rows = docs.select(F.col(id_col).alias("id"), whole.alias("whole"),
                       *[p.alias(f"f{i}") for i, p in enumerate(parts[:-1])], F.lit("").alias("body"))
    kind = rows.schema["id"].dataType.simpleString()
    names = [f"f{i}" for i in range(len(fields))]
    counted = rows.mapInArrow(
        _kernel(docs.sparkSession.sparkContext.broadcast(ranks), pattern, names),
        f"id {kind}, n_tokens long, n_crossing long, " + "".join(f"n_{x} long, " for x in names) + "line_tokens array<long>")
    own = sum((F.col(f"n_{x}") for x in names), F.lit(0))
    return counted.select(
        F.col("id").alias(id_col), "n_tokens", "n_crossing",
        *[F.col(f"n_{x}").alias(f"n_{f}") for x, f in zip(names, fields, strict=True)],
        (F.col("n_tokens") - own).cast("long").alias(f"n_{body}"),
        F.size("line_tokens").cast("long").alias("n_lines"), "line_tokens")
