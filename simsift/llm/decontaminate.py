"""Benchmark decontamination by pigeonhole edit matching.

Texts and benchmark items are normalised (lower case; everything but ASCII
letters, digits and non-ASCII characters becomes one space).  An item of m
characters may differ by k = floor(m * ERROR_RATE) edits.  Cut into k + 1 pieces,
at least one piece of every such occurrence stands unchanged, so an Aho-Corasick
automaton over all pieces finds a place for each occurrence; the place is then
verified by Myers' bit-parallel approximate matching of the whole item.

The automaton is built from items of at most BLOCK_CHARS characters at once; a
larger benchmark is matched block by block, each block over all texts, so the
size of what a task holds is bounded and no item is left out.

An item too short for an edit (under 1 / ERROR_RATE characters) has no budget and is
one piece: it matches where it stands whole, as its own words.  Between letters or digits of
scripts without spaces (Chinese, Japanese, Thai, ...) every place is a word boundary.

Defined results: a null or empty text contains nothing; null items and items
without a letter or digit match nothing; repeated items are matched each, repeated rows give repeated matches; a
null id is carried, ids keep their type; empty tables give an empty result; other columns are not
looked at and pass ``drop_contaminated`` unchanged."""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from simsift.llm.common import materialize

ERROR_RATE = 0.05
BLOCK_CHARS = 4_000_000

_SPACE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32
               for b in range(256))


def normalise(text: str) -> str:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_SPACE).split()).decode()


#: Ranges of characters that are written without spaces between words.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0xA4CF), (0xF900, 0xFAFF),
            (0xFF66, 0xFF9D), (0x20000, 0x3FFFF))


def _joins(a: str, b: str) -> bool:
    """Whether no word can end between two neighbouring characters."""
    return a != " " and b != " " and not any(lo <= ord(c) <= hi for c in (a, b) for lo, hi in UNSPACED)


def whole(text: str, start: int, end: int) -> bool:
    """Whether ``text[start:end]`` stands between word boundaries."""
    return not (start > 0 and _joins(text[start - 1], text[start])) \
        and not (end < len(text) and _joins(text[end - 1], text[end]))


def budget(size: int) -> int:
    """Edits that an item of so many characters may differ by."""
    return int(size * ERROR_RATE)


class Item:
    """One benchmark item: its pieces, and Myers' matching."""

    def __init__(self, item_id: int, text: str):
        self.id, self.text, self.size = item_id, text, len(text)
        self.budget = budget(self.size)
        cuts = [self.size * j // (self.budget + 1) for j in range(self.budget + 2)]
        self.pieces = [(a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.bits = self._positions(text)
        self.reversed_bits = self._positions(text[::-1])

    @staticmethod
    def _positions(text: str) -> dict[str, int]:
        bits: dict[str, int] = defaultdict(int)
        for i, c in enumerate(text):
            bits[c] |= 1 << i
        return dict(bits)

    def _myers(self, text: str, bits: dict[str, int], anchored: bool) -> tuple[int, int]:
        """(least distance, first end where it is reached) of the item to a
        substring of ``text``; to a prefix if ``anchored``."""
        mask, top = (1 << self.size) - 1, 1 << (self.size - 1)
        up, down, distance = mask, 0, self.size
        best, end = distance, 0
        for j, c in enumerate(text, 1):
            eq = bits.get(c, 0)
            across = eq | down
            diagonal = (((eq & up) + up) ^ up) | eq
            rise = down | (~(diagonal | up) & mask)
            fall = up & diagonal
            distance += bool(rise & top) - bool(fall & top)
            rise = (rise << 1) | anchored
            fall <<= 1
            up = (fall | ~(across | rise)) & mask
            down = rise & across
            if distance < best:
                best, end = distance, j
        return best, end

    def verify(self, text: str, place: int) -> tuple[int, int, int] | None:
        """The occurrence around ``place`` (where the item would begin) as
        (distance, start, end), if it is within the budget."""
        start = max(0, place - self.budget)
        window = text[start:place + self.size + self.budget]
        distance, end = self._myers(window, self.bits, False)
        if distance > self.budget:
            return None
        _, size = self._myers(window[:end][::-1], self.reversed_bits, True)
        return distance, start + end - size, start + end


class Matcher:
    """All items of one block of the benchmark."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [Item(i, t) for i, t in items]
        at: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, item in enumerate(self.items):
            for offset, piece in item.pieces:
                at[piece].append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in at.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if at:
            self.automaton.make_automaton()
        self.empty = not at

    def matches(self, raw: str) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, end) of the best occurrence of each item in
        a text; start and end count characters of the normalised text."""
        if self.empty or not raw:
            return []
        text = normalise(raw)
        places: dict[int, set[int]] = defaultdict(set)
        short: dict[int, tuple[int, int]] = {}
        for end, (size, owners) in self.automaton.iter(text):
            for n, offset in owners:
                if self.items[n].budget:
                    places[n].add(end + 1 - size - offset)
                elif n not in short and whole(text, end + 1 - size, end + 1):
                    short[n] = (end + 1 - size, end + 1)
        out = [(self.items[n].id, 0, *at) for n, at in sorted(short.items())]
        for n, found in sorted(places.items()):
            item, best, done = self.items[n], None, None
            for place in sorted(found):
                if done is not None and place == done:
                    continue
                got = item.verify(text, place)
                if got and (best is None or got < best):
                    best = got
                    done = got[1]
                    if got[0] == 0:
                        break
            if best:
                out.append((item.id, *best))
        return out


def blocks(benchmark: DataFrame, id_col: str = "item_id",
           text_col: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The usable items in blocks of at most BLOCK_CHARS characters (or one
    item).  Items are numbered into blocks by Spark; one block at a time comes
    to the driver."""
    normal = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")) \
        .where("text is not null")
    sized = normal.withColumn("size", F.length("text"))
    total = sized.agg(F.sum("size")).first()[0] or 0
    if total <= BLOCK_CHARS:
        parts = [sized]
    else:
        n = -(-2 * total // BLOCK_CHARS)
        spread = materialize(sized.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(n))), "benchmark")
        running = F.sum("size").over(Window.partitionBy("part").orderBy("id", "text"))
        spread = materialize(spread.withColumn("cut", (running / BLOCK_CHARS).cast("long")), "benchmark")
        keys = [(r.part, r.cut) for r in spread.select("part", "cut").distinct().collect()]
        parts = [spread.where((F.col("part") == p) & (F.col("cut") == c)) for p, c in sorted(keys)]
    for part in parts:
        items = [(r.id, normalise(r.text)) for r in part.select("id", "text").collect()]
        items = [(i, t) for i, t in sorted(items, key=lambda x: (x[0] is None, x)) if t]
        if items:
            yield items


_MATCHERS: dict[str, Matcher] = {}


def _matcher(shipped) -> Matcher:
    """The matcher of a broadcast block, built once in each Python worker."""
    if shipped.id not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[shipped.id] = Matcher(shipped.value)
    return _MATCHERS[shipped.id]


class _Shipped:
    """A broadcast block with a key that workers can cache by."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value


def _ship(docs: DataFrame, items: list[tuple[int, str]]) -> _Shipped:
    return _Shipped(docs.sparkSession.sparkContext.broadcast(items))


def _kind(table: DataFrame, column: str) -> str:
    return table.schema[column].dataType.simpleString()


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, start, end): every benchmark item that a
    document contains, with its best occurrence in the normalised text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"doc_id {_kind(docs, id_col)}, item_id {_kind(benchmark, item_col)}, distance long, start long, end long"
    names = ["doc_id", "item_id", "distance", "start", "end"]
    empty = docs.sparkSession.createDataFrame([], schema)
    kinds = [f.type for f in to_arrow_schema(empty.schema)]
    out = empty
    for items in blocks(benchmark, item_col, item_text):
        shipped = _ship(docs, items)

        def kernel(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shipped)
            for batch in batches:
                found = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                         for m in matcher.matches(t or "")]
                if found:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)],
                                          names=names)
        out = out.union(rows.mapInArrow(kernel, schema))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
                      item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item; columns unchanged."""
    at = docs.columns.index(text_col)
    for items in blocks(benchmark, item_col, item_text):
        shipped = _ship(docs, items)

        def kernel(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shipped)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.matches(t or "") for t in batch.column(at).to_pylist()],
                                            pa.bool_()))
        docs = docs.mapInArrow(kernel, docs.schema)
    return docs
