"""Secret scan over a trigram inverted index.

1. Every rule is a regular expression; ``trigrams.clauses`` derives from it a
   Boolean query, alternatives of trigrams that a text with a match must hold.
2. One pass indexes the documents: texts are taken in segments, and for each
   trigram that some rule asks for the segment has a posting list, the ascending
   places of the texts that hold it (A-Z lower-cased).  The index is a written
   table of (segment, trigram, places) and of the documents' keys.
3. Posting lists of an alternative's trigrams are intersected inside each segment;
   the rest are no candidates.  A document's candidate rules are what any alternative leaves.
4. Candidates are verified: the rules run over the whole texts of their candidates.
   Rules without mandatory trigrams run over all texts.

A rule's matches are leftmost and do not overlap; a match whose group is shorter than
the rule's ``least`` characters is dropped.  Spans count code points, end exclusive.

A document's key is its id and a 64-bit hash of its text, so texts are joined only
to verify, and rows that repeat an id are told apart.

Defined results: a null text is empty and has no spans; an empty table, one row out
for each row in (repeated rows too, null ids too); a long text is scanned whole; two
rules may give the same span; spans are ordered by start, then by the order of the
rules; other columns are not looked at."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simsift.llm import trigrams
from simsift.llm import words as W
from simsift.llm.common import materialize, small_bytes

SEGMENT_BYTES = 1 << 20      # texts of a segment of the index (at least one text)


@dataclass(frozen=True)
class Rule:
    """``group`` of every match must have ``least`` code points."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


def either_case(word: str) -> str:
    """A pattern for ``word`` with its ASCII letters in either case."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isascii() and c.isalpha() else c for c in word)


# The rules that always count.
NAMES = "|".join(either_case(n) for n in ("password", "passwd", "secret", "token", "api_?key"))
BASE = (
    Rule("assign", rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),           # runs of [0-9a-f]+ with 24 characters or more
)
# Rules that the method adds, public formats of keys.
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("google", r"AIza[0-9A-Za-z_-]+", 0, 39),
    Rule("slack", r"xox[abprs]-[0-9A-Za-z-]+", 0, 20),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]+", 0, 32),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("url_login", r"://[^\x09-\x0D\x20/:@]+:[^\x09-\x0D\x20/:@]+@"),
)


# --- the index ---------------------------------------------------------------------

def _codes(gram: str) -> list[int]:
    """Byte trigrams of a trigram of characters."""
    b = gram.encode()
    return [b[i] << 16 | b[i + 1] << 8 | b[i + 2] for i in range(len(b) - 2)]


def queries_of(rules: tuple[Rule, ...]) -> tuple[list[tuple[int, int, int, int]], list[int]]:
    """((rule, alternative, trigrams in it, trigram) of all rules with mandatory trigrams,
    rules without)."""
    terms, full = [], []
    for r, rule in enumerate(rules):
        found = trigrams.clauses(rule.pattern)
        if frozenset() in found:
            full.append(r)
            continue
        for c, clause in enumerate(sorted(map(sorted, found))):
            codes = sorted({x for gram in clause for x in _codes(gram)})
            terms += [(r, c, len(codes), x) for x in codes]
    return terms, full


def _index(wanted: list[int], size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = np.zeros(1 << 24, dtype=bool)
        asked[wanted] = True
        segment = TaskContext.get().partitionId() << 32
        names = ["segment", "gram", "places", "ids", "hashes"]
        for batch in batches:
            for lo, hi, chunk in W.chunks(batch.column(2), size):
                low = W._LOWER[chunk.buf].astype(np.int32)
                codes = low[:-2] << 16 | low[1:-1] << 8 | low[2:]
                at = np.flatnonzero(asked[codes]) if len(codes) else np.zeros(0, np.int64)
                text = np.searchsorted(chunk.off, at, side="right") - 1
                inside = at + 2 < chunk.off[text + 1]
                pairs = np.unique(codes[at[inside]].astype(np.int64) * chunk.n + text[inside])
                grams, places = pairs // chunk.n, pairs % chunk.n
                each, starts = np.unique(grams, return_index=True)
                n, ends = len(each), np.append(starts, len(grams)).astype(np.int32)
                ids, hashes = (batch.column(c).slice(lo, hi - lo) for c in (0, 1))
                yield pa.record_batch([
                    pa.array(np.full(n, segment)), pa.array(each.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(places.astype(np.int32))),
                    pa.nulls(n, pa.list_(ids.type)), pa.nulls(n, pa.list_(pa.int64()))], names=names)
                whole = pa.array([0, hi - lo], pa.int32())
                yield pa.record_batch([
                    pa.array([segment]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.list_(pa.int32())),
                    pa.ListArray.from_arrays(whole, ids), pa.ListArray.from_arrays(whole, hashes)], names=names)
                segment += 1
    return run


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, hash, text), the key of every row first."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))


def build_index(rows: DataFrame, wanted: list[int], segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The written index of keyed rows, over the trigrams ``wanted`` (byte codes):
    (segment, gram, places) rows, and one (segment, ids, hashes) row a segment."""
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"segment long, gram int, places array<int>, ids array<{kind}>, hashes array<long>"
    return materialize(rows.mapInArrow(_index(wanted, segment_bytes), schema), "trigram-index")


def candidates(index: DataFrame, terms: list[tuple[int, int, int, int]]) -> DataFrame:
    """(id, hash, rules): the rules whose queries a document answers.  Posting lists are
    intersected segment by segment."""
    asked = index.sparkSession.createDataFrame(terms, "rule int, alternative int, needed int, gram int")
    lists = index.where("gram is not null").select("segment", "gram", "places") \
        .join(F.broadcast(asked), "gram") \
        .groupBy("segment", "rule", "alternative", "needed").agg(F.collect_list("places").alias("lists")) \
        .where(F.size("lists") == F.col("needed"))
    common = F.aggregate(F.slice("lists", 2, F.size("lists")), F.col("lists")[0], F.array_intersect)
    found = lists.select("segment", "rule", F.explode(common).alias("place")) \
        .groupBy("segment", "place").agg(F.collect_set("rule").alias("rules"))
    keys = index.where("gram is null").select("segment", "ids", "hashes")
    return found.join(keys, "segment").select(
        F.col("ids")[F.col("place")].alias("id"), F.col("hashes")[F.col("place")].alias("hash"), "rules") \
        .groupBy("id", "hash").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("rules"))


# --- verification --------------------------------------------------------------------

def compiled(rules: tuple[Rule, ...]) -> list[re.Pattern]:
    return [re.compile(r.pattern, re.ASCII) for r in rules]


def spans_of(text: str, rule: Rule, pattern: re.Pattern) -> list[tuple[int, int]]:
    return [m.span() for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _verify(rules: tuple[Rule, ...], given: list[int] | None):
    """(id, hash, spans) of every row: of the rules ``given``, or of the row's own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = compiled(rules)
        for batch in batches:
            ptr, found = [0], []
            own = batch.column(3).to_pylist() if given is None else None
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py()
                for r in (own[i] if own is not None else given):
                    found += [(a, r, b) for a, b in spans_of(text, rules[r], patterns[r])]
                ptr.append(len(found))
            parts = np.array(found, dtype=np.int32).reshape(-1, 3)
            spans = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(parts[:, c])) for c in range(3)],
                                               names=["start", "kind", "end"])
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), spans)],
                names=["id", "hash", "spans"])
    return run


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 rules: tuple[Rule, ...] = BASE + ADDED, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """(id_col, spans) of every row; spans are (start, kind, end), kind the place of
    the rule in ``rules``, in order."""
    rows = keyed(docs, id_col, text_col)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, hash long, spans {_SPANS}"
    terms, full = queries_of(rules)
    out = rows.mapInArrow(_verify(rules, full), schema)
    if terms:
        index = build_index(rows, sorted({t[3] for t in terms}), segment_bytes)
        asked = materialize(candidates(index, terms), "secret-candidates")
        if small_bytes(asked):
            asked = F.broadcast(asked)
        key = rows["id"].eqNullSafe(asked["id"]) & (rows["hash"] == asked["hash"])
        found = materialize(
            rows.join(asked, key).select(rows["id"], rows["hash"], "text", "rules")
            .mapInArrow(_verify(rules, None), schema).where(F.size("spans") > 0).dropDuplicates(["id", "hash"]),
            "secret-spans").select(F.col("id").alias("f_id"), F.col("hash").alias("f_hash"), F.col("spans").alias("more"))
        if small_bytes(found):
            found = F.broadcast(found)
        out = out.join(found, F.col("id").eqNullSafe(F.col("f_id")) & (F.col("hash") == F.col("f_hash")), "left") \
            .withColumn("spans", F.concat("spans", F.coalesce("more", F.array().cast(_SPANS))))
    return out.select(F.col("id").alias(id_col), F.array_sort("spans").alias("spans"))


def written(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """``kind:start:end``, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", kinds[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is_kind(k: int):
    return lambda s: s["kind"] == k


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_assign, n_access, n_hex, base_sha256, spans)."""
    rules = BASE + ADDED
    found = find_secrets(docs, id_col, text_col, rules)
    counts = [F.size(F.filter("spans", _is_kind(k))).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(BASE)]
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return found.select(id_col, *counts, F.sha2(written(base, rules), 256).alias("base_sha256"),
                        written(F.col("spans"), rules).alias("spans"))
