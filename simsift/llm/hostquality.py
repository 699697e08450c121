"""Host-level quality rules.

Every text is measured by document rules; the failures of each rule are aggregated by
host (domain); each host's rate of each rule is shrunk towards all hosts by the rule's
empirical beta prior; the host's verdict is joined back and sets how much a document of
that host may fail.  A document without failures is kept whatever its host is.

The prior is fitted by beta-binomial moments: the spread between hosts, weighted by their
documents, less what chance alone gives within hosts (analysis of variance).  So hosts with
few documents don't pass for extreme ones; where no host has two documents, nothing tells
hosts apart and all rates are the common one.

Document rules, on words ``[^\\x20\\x09-\\x0D]+``:

* base: under 50 words, or repeated words over half of the words (always drops);
* symbols: more than 1 of ``#*$%&|<>`` for 4 words; more than 1 a word counts
  as two failures;
* lines: over 3 in 10 lines with words repeat an earlier line;
* length: under 2 or over 15 characters a word on average.

A document of a host whose shrunk rate of any rule (the five conditions above, base
included) exceeds ``HOST_LIMIT`` may fail no rule, any other document one (besides base).

Defined results: a null or empty text has no words and fails base; a null host
counts as the host ''; repeated rows are judged and counted each; an empty table
gives an empty result; columns besides id, text and host are not looked at and, whatever
their names, pass through ``drop_low_quality`` unchanged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simsift.llm import words as W
from simsift.llm.common import materialize, small_bytes

MIN_WORDS = 50
WINDOW = 3
HOST_LIMIT = 0.5
MIN_PRIOR = 2.0      # documents that the prior counts for at least (as a uniform one does)
MAX_PRIOR = 1e6      # and at most (no spread between hosts)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

_SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
_NOT_NEWLINE = np.arange(256) != 0x0A


def _per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[off[1:]] - total[off[:-1]]


def measures(chunk: W.Chunk) -> list[np.ndarray]:
    """The columns MEASURES of a chunk's texts."""
    buf, off = chunk.buf, chunk.off
    starts, ends, ptr = chunk.spans(W.SPACED)
    inside = W.SPACED[buf]
    chars = _per_text(inside & ((buf & 0xC0) != 0x80), off)
    symbols = _per_text(_SYMBOL[buf], off)

    a, b, lines = chunk.spans(_NOT_NEWLINE)
    filled = np.concatenate([[0], np.cumsum(inside)])
    worded = filled[b] > filled[a]
    lines = np.concatenate([[0], np.cumsum(worded)])[lines]
    _, distinct = W.distinct_sorted(chunk.hashes(a[worded], b[worded]), lines)
    n_lines = np.diff(lines)

    runs, rptr = W.windows(chunk.hashes(starts, ends), ptr, WINDOW, False)
    text = np.repeat(np.arange(chunk.n), np.diff(rptr))
    runs = W.mix(runs ^ W.mix(text.astype(np.uint64)))      # equal only within one text
    order = runs.copy()
    W.distinct_sorted(order, rptr)
    again = np.unique(order[1:][order[1:] == order[:-1]])
    covered = np.zeros(len(starts), dtype=bool)
    if len(again):
        hit = np.flatnonzero(np.isin(runs, again))
        first = hit - rptr[text[hit]] + ptr[text[hit]]
        for j in range(WINDOW):
            covered[first + j] = True
    return [np.diff(ptr), chars, symbols, n_lines, n_lines - np.diff(distinct), _per_text(covered, ptr)]


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def measure(docs: DataFrame, text_col: str, prefix: str = "") -> DataFrame:
    """``docs`` with the columns MEASURES (names prefixed) added."""
    names = docs.columns
    at = names.index(text_col)
    added = [prefix + m for m in MEASURES]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, chunk in W.chunks(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                yield pa.record_batch(
                    list(part.columns) + [pa.array(m.astype(np.int64)) for m in measures(chunk)],
                    names=names + added)

    schema = ", ".join([f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in docs.schema.fields]
                       + [f"`{a}` long" for a in added])
    return docs.mapInArrow(kernel, schema)


def _base_failed(p: str) -> Column:
    return (F.col(p + "n_words") < MIN_WORDS) | (100 * F.col(p + "n_repeat_words") > 50 * F.col(p + "n_words"))


def _rules(p: str) -> dict[str, Column]:
    """The rules besides base."""
    words, chars, symbols = F.col(p + "n_words"), F.col(p + "word_chars"), F.col(p + "n_symbols")
    return {"symbols": 4 * symbols > words, "dense": symbols > words,
            "lines": 10 * F.col(p + "n_dup_lines") > 3 * F.col(p + "n_lines"),
            "length": (chars < 2 * words) | (chars > 15 * words)}


def _failures(p: str) -> Column:
    """How many rules besides base a document fails."""
    return sum((rule.cast("int") for rule in _rules(p).values()), F.lit(0))


def likeness(hosts: int, docs: int, squares: float, failed: int, spread: float) -> float:
    """How alike the documents of a host are in failing a rule, 0 to 1 (the intraclass
    correlation of the beta-binomial, by analysis of variance).  ``squares`` is the sum of the
    hosts' squared numbers of documents, ``spread`` the sum of failed * failed / documents."""
    if hosts < 2 or docs == hosts:
        return 0.0
    between = (spread - failed * failed / docs) / (hosts - 1)
    within = (failed - spread) / (docs - hosts)
    usual = (docs - squares / docs) / (hosts - 1)
    return (between - within) / (between + (usual - 1) * within) if between > within else 0.0


def weight(alike: float) -> float:
    """How many documents the prior counts for."""
    return max(MIN_PRIOR, min(MAX_PRIOR, 1 / alike - 1)) if alike > 0 else MAX_PRIOR


def strict_hosts(measured: DataFrame, host_col: str, prefix: str = "") -> tuple[DataFrame, bool]:
    """(hosts with a shrunk failure rate over HOST_LIMIT, whether their names are within the
    broadcast bound).  ``host`` is the only column."""
    rules = {"base": _base_failed(prefix)} | _rules(prefix)
    hosts = materialize(
        measured.groupBy(F.coalesce(F.col(_quoted(host_col)), F.lit("")).alias("host"))
        .agg(F.count("*").alias("n"), *[F.sum(rule.cast("long")).alias(name) for name, rule in rules.items()]), "hosts")
    # Two rows: what the priors are fitted to, and their means, where a host counts for as many
    # independent documents as its own are worth.
    n = F.col("n").cast("double")
    at = hosts.agg(F.count("*").alias("hosts"), F.sum("n").alias("docs"), F.sum(n * n).alias("squares"),
                   *[F.sum(name).alias(name) for name in rules],
                   *[F.sum(F.col(name) * F.col(name) / n).alias(f"{name}_spread") for name in rules]).first()
    over = F.lit(False)
    if at["hosts"]:
        alike = {name: likeness(at["hosts"], at["docs"], at["squares"], at[name], at[f"{name}_spread"]) for name in rules}
        worth = {name: n / (1 + (n - 1) * F.lit(alike[name])) for name in rules}
        means = hosts.agg(*[(F.sum(worth[name] * F.col(name) / n) / F.sum(worth[name])).alias(name) for name in rules]).first()
        for name in rules:
            docs = weight(alike[name])
            over = over | ((F.lit(means[name] * docs) + F.col(name)) / (F.lit(docs) + n) > HOST_LIMIT)
    strict = hosts.where(over).select("host")
    return strict, small_bytes(strict)


def _judged(measured: DataFrame, hosts: DataFrame, small: bool, host_col: str, prefix: str) -> DataFrame:
    """``measured`` with prefix+'kept'."""
    flagged = hosts.select(F.col("host").alias(prefix + "host"), F.lit(True).alias(prefix + "strict"))
    joined = measured.join(F.broadcast(flagged) if small else flagged,
                           F.coalesce(measured[_quoted(host_col)], F.lit("")) == F.col(prefix + "host"), "left")
    allowed = F.when(F.col(prefix + "strict"), 0).otherwise(1)
    return joined.withColumn(prefix + "kept", ~_base_failed(prefix) & (_failures(prefix) <= allowed))


def host_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 host_col: str = "source") -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, host_strict) for every row."""
    rows = docs.select(F.col(_quoted(id_col)).alias("_id"), F.col(_quoted(host_col)).alias("_host"),
                       F.col(_quoted(text_col)).alias("_text"))
    measured = materialize(measure(rows, "_text", "_q_").drop("_text"), "measured")
    judged = _judged(measured, *strict_hosts(measured, "_host", "_q_"), "_host", "_q_")
    return judged.select(
        F.col("_id").alias(id_col), *[F.col("_q_" + m).alias(m) for m in MEASURES if m != "n_lines"],
        _base_failed("_q_").alias("base_failed"), F.col("_q_kept").alias("kept"),
        F.coalesce("_q_strict", F.lit(False)).alias("host_strict"))


def drop_low_quality(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass; columns unchanged.  The texts are measured
    twice (once for the hosts, once to filter) rather than shuffled."""
    names = [f"c{i}" for i in range(len(docs.columns))]      # clash with nothing
    text, host = (names[docs.columns.index(c)] for c in (text_col, host_col))
    plain = docs.toDF(*names)
    hosts, small = strict_hosts(measure(plain.select(host, text), text, "_q_"), host, "_q_")
    return _judged(measure(plain, text, "_q_"), hosts, small, host, "_q_") \
        .where("_q_kept").select(names).toDF(*docs.columns)
