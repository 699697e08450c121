"""JSON arrays of flat records, read by many tasks even from one file.

Spark's ``multiLine`` JSON reader takes a file in one task and gives up a file at its first
fault.  Here the text reader splits files at every ``}`` (its line separator, so blocks of
one file go to different tasks) and an Arrow kernel puts records together again: a piece
that begins with ``{"key":`` starts a record, and a brace inside a string only goes on with
the open one.  Such a start cannot stand inside a string (its quotes would be escaped), so a
fault never spreads beyond the next start.  What reaches from one block into the next is one
open record a block; these pieces are joined afterwards.

Every byte is part of a record, of a rejected piece, or of the separators between them.

Defined results: records are flat, a nested object and an object without keys are rejected;
a missing field is null;
``NaN``, bytes that are not UTF-8 and a last record without its ``}`` are rejected; a record
over MAX_RECORD bytes is rejected, in pieces if it holds braces; keys do not begin with a
colon; an empty file has no records."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from simsift.session import materialize

#: Longest record in bytes; what a task holds of one open record.
MAX_RECORD = 16 << 20
#: Measured size up to which the table of blocks (file name and offset) is broadcast.
BLOCKS_BYTES = 64 << 20
#: Bytes of text that a kernel gathers for one batch of its output.
OUT_BYTES = 1 << 20

_START = re.compile(rb'(?:\A[\s\xef\xbb\xbf]*\[?|,)\s*(\{\s*"(?:[^"\\]|\\.)*"\s*:)', re.DOTALL)
_FILLER = re.compile(rb"[\s,\[\]\xef\xbb\xbf]*")
_ESCAPE = re.compile(rb"\\.", re.DOTALL)

_PIECES = "file string, block long, size long, kind string, pos long, text binary, total long"
_ARROW = pa.schema([("file", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("kind", pa.string()),
                    ("pos", pa.int64()), ("text", pa.binary()), ("total", pa.int64())])

Piece = tuple[str, int, bytes]


def _constant(name: str):
    raise ValueError(name)


def _whole(text: bytes) -> bool:
    try:
        json.loads(text.decode(), parse_constant=_constant)
    except (ValueError, RecursionError):
        return False
    return True


def _odd_quotes(text: bytes) -> bool:
    return _ESCAPE.sub(b"", text).count(b'"') % 2 == 1


class Assembler:
    """Pieces between closing braces, in order, to (kind, position, bytes)."""

    def __init__(self, max_record: int = MAX_RECORD):
        self.max_record = max_record
        self.open: list[bytes] = []         # of a record whose last piece ends inside a string
        self.at = self.held = 0

    def _rejected(self, pos: int, text: bytes) -> Iterator[Piece]:
        if not _FILLER.fullmatch(text):
            lead = len(text) - len(text.lstrip(b" \t\r\n,"))
            yield "reject", pos + lead, text[lead:].rstrip(b" \t\r\n,")

    def _extend(self, text: bytes) -> None:
        self.open.append(text)
        self.held += len(text)

    def finish(self) -> Iterator[Piece]:
        """Gives up the open record."""
        if self.open:
            yield from self._rejected(self.at, b"".join(self.open))
        self.open, self.held = [], 0

    def add(self, pos: int, value: bytes, closed: bool = True) -> Iterator[Piece]:
        """A piece at ``pos``; ``closed``: a ``}`` follows it."""
        end = b"}" if closed else b""
        if not self.open and closed:
            first = _START.match(value)
            if first:
                text = value[first.start(1):] + end
                if len(text) <= self.max_record and _whole(text):
                    yield "record", pos + first.start(1), text
                    return
        starts = [m.start(1) for m in _START.finditer(value)]
        lead = value[:starts[0]] if starts else value + end
        if self.open and not starts and closed:
            self._extend(lead)
            if self.held <= self.max_record and not _odd_quotes(lead):
                return                              # still inside the string
            text = b"".join(self.open)
            if self.held <= self.max_record and _whole(text):
                yield "record", self.at, text
                self.open, self.held = [], 0
            else:
                yield from self.finish()
            return
        if self.open:
            self._extend(lead)
            yield from self.finish()
        else:
            yield from self._rejected(pos, lead)
        for a, b in zip(starts, starts[1:]):
            yield from self._rejected(pos + a, value[a:b])
        if starts:
            text = value[starts[-1]:] + end
            if closed and len(text) <= self.max_record and _whole(text):
                yield "record", pos + starts[-1], text
            elif closed and len(text) <= self.max_record and _odd_quotes(text):
                self.at = pos + starts[-1]
                self._extend(text)
            else:
                yield from self._rejected(pos + starts[-1], text)


class _Block:
    """One block of a file: what stands before its first record start (``head``) and the
    record open at its end (``tail``) are left to ``_join_blocks``."""

    def __init__(self, file: str, block: int, size: int, max_record: int):
        self.key = (file, block)
        self.size, self.max_record = size, max_record
        self.head: list[bytes] = []
        self.headed = self.pos = self.held = 0
        self.begun = False
        self.records = Assembler(max_record)

    def _row(self, kind: str, pos: int, text: bytes, total: int | None = None) -> tuple:
        return *self.key, self.size, kind, pos, text, total

    def add(self, value: bytes) -> Iterator[tuple]:
        pos = self.pos
        self.pos += len(value) + 1
        if not self.begun:
            first = _START.search(value)
            lead = value[:first.start(1)] if first else value + b"}"
            if self.held + len(lead) > self.max_record:
                # Longer than any record: nothing open reaches through it.
                self.begun = True
            else:
                self.head.append(lead)
                self.held += len(lead)
                if not first:
                    return
                self.begun = True
                pos, value = pos + len(lead), value[len(lead):]
        for kind, at, text in self.records.add(pos, value):
            yield self._row(kind, at, text)

    def close(self) -> Iterator[tuple]:
        yield self._row("head", 0, b"".join(self.head), self.pos)
        if self.begun:
            yield self._row("tail", self.records.at, b"".join(self.records.open))


def _batches(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Output batches of about OUT_BYTES."""
    out, held = [], 0
    for row in rows:
        out.append(row)
        held += 64 + len(row[5])
        if held >= OUT_BYTES:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW)], schema=_ARROW)
            out, held = [], 0
    if out:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW)], schema=_ARROW)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows as Python values, one at a time: texts may be long."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(column[i].as_py() for column in batch.columns)


def _pieces_kernel(max_record: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        block = None
        for file, start, size, value in _rows(batches):
            if block is None or block.key != (file, start):
                if block is not None:
                    yield from block.close()
                block = _Block(file, start, size, max_record)
            yield from block.add(value)
        if block is not None:
            yield from block.close()
    return lambda batches: _batches(pieces(batches))


def _joined_kernel(max_record: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for file, size, pos, text in _rows(batches):
            for kind, at, piece in _assembled(text, max_record):
                yield file, 0, size, kind, pos + at, piece, None
    return lambda batches: _batches(pieces(batches))


def _assembled(text: bytes, max_record: int) -> Iterable[Piece]:
    """The records of consecutive bytes; a last piece without ``}`` is not closed."""
    records, pos = Assembler(max_record), 0
    values = text.split(b"}")
    for i, value in enumerate(values):
        closed = i + 1 < len(values)
        if closed or value:
            yield from records.add(pos, value, closed)
        pos += len(value) + 1
    yield from records.finish()


def _join_blocks(pieces: DataFrame, max_record: int) -> DataFrame:
    """Records that reach over block ends: an open tail and the heads that follow it up to
    the next block with a record start.  Two rows a block, with positions in the file."""
    ends = pieces.where(F.col("kind").isin("head", "tail"))
    order = Window.partitionBy("file").orderBy("block", "kind")          # head, then tail
    runs = ends.withColumn("run", F.sum((F.col("kind") == "tail").cast("long")).over(order)) \
               .where(F.octet_length("text") > 0) \
               .groupBy("file", "size", "run") \
               .agg(F.min("pos").alias("pos"),
                    F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("parts"))
    text = F.aggregate("parts", F.lit(b""), lambda done, part: F.concat(done, part["text"]))
    return runs.select("file", "size", "pos", text.alias("text")).mapInArrow(_joined_kernel(max_record), _PIECES)


def read_records(spark: SparkSession, path: str, schema: T.StructType, glob: str = "*.json",
                 max_record: int = MAX_RECORD) -> tuple[DataFrame, DataFrame]:
    """(records, rejected) of all files under ``path``.

    Records: ``file_path``, ``position`` (byte offset) and the fields of ``schema``.
    Rejected: ``file_path``, ``position``, ``length`` in bytes, ``text`` (bytes), ``reason``:
    ``truncated`` for a record that the end of the file cuts off, else ``malformed``.
    The files are read once; the pieces are written under the scratch folder."""
    fragments = (spark.read.option("lineSep", "}").option("recursiveFileLookup", True)
                 .option("pathGlobFilter", glob).text(path)
                 .select(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
                         F.col("_metadata.file_size"), F.col("value").cast("binary")))
    written = materialize(fragments.mapInArrow(_pieces_kernel(max_record), _PIECES), "records")
    blocks = written.where(F.col("kind") == "head").select("file", "block", "total")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = materialize(blocks.select("file", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")),
                       "blocks")
    size = base.agg(F.sum(F.octet_length("file") + 48)).first()[0] or 0
    placed = written.join(F.broadcast(base) if size <= BLOCKS_BYTES else base, ["file", "block"]) \
        .withColumn("pos", F.col("pos") + F.col("base")).drop("base").select(*_ARROW.names)
    pieces = placed.where(F.col("kind").isin("record", "reject")) \
        .unionByName(_join_blocks(placed, max_record))
    # The reader does not tell whether the last piece of a file had its ``}``.
    over = F.col("pos") + F.octet_length("text") - F.col("size")
    pieces = pieces.withColumn("over", over > 0)
    good = (F.col("kind") == "record") & ~F.col("over")
    records = pieces.where(good) \
        .select(F.col("file").alias("file_path"), F.col("pos").alias("position"),
                F.from_json(F.col("text").cast("string"), schema).alias("r")) \
        .select("file_path", "position", *[F.col(f"r.`{name}`").alias(name) for name in schema.fieldNames()])
    text = F.when(F.col("over"), F.expr("substring(text, 1, octet_length(text) - 1)")).otherwise(F.col("text"))
    rejected = pieces.where(~good).withColumn("text", text) \
        .select(F.col("file").alias("file_path"), F.col("pos").alias("position"),
                F.octet_length("text").cast("long").alias("length"), "text",
                F.when(F.col("over"), "truncated").otherwise("malformed").alias("reason"))
    # At a file's end the added ``}`` makes the closing ``]`` look like a fault.
    filler = F.col("text").cast("string").rlike(r"\A[\s,\[\]]*\z")
    return records, rejected.where((F.col("reason") != "truncated") | ~filler)
