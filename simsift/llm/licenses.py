"""License scan by diagonal voting.

Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased text (A-Z) are
hashed in rolling k-grams; Spark joins all of them to the positions of the
templates' k-grams (a fixed table of a few hundred rows, broadcast), the words
of a k-gram are compared as text where the hash agrees, and each match votes for
the diagonal ``text position - template position``.  A diagonal with all votes
is a whole phrase in place.  Neighbouring diagonals are merged (a few words put
in or left out shift the diagonal).  A merged span is verified before it is
accepted: the longest row of its matches that goes forward both in the text and
in the template must hold enough of the template's k-grams, so a k-gram that the
text repeats or has out of order counts once or not at all.

Defined results: null or empty text: no words, no labels, score 0; one row out
for each row in (repeated rows too, null ids too); an empty table gives an empty
result; other columns are not looked at."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from simsift.llm import words as W

K = 2            # words in a k-gram; the shortest phrase has two
GAP = 3          # diagonals at most so far apart are neighbours
COVERED = 0.8    # share of a template's k-grams that a span must match

# Phrases that always count, and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Notices that the method adds, and their labels.
NOTICES = {
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "all rights reserved": "proprietary",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "released into the public domain": "public-domain",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "you may not use this file except in compliance with the license": "apache",
    "this program is free software you can redistribute it and or modify it under the terms": "gpl",
}

ROWS = "row long, id long, n_words long, pos long, hash long, gram string"


def _grams(chunk: W.Chunk) -> tuple[np.ndarray, ...]:
    starts, ends, ptr = chunk.spans(W.ALNUM)
    grams, gptr = W.windows(chunk.hashes(starts, ends, lower=True), ptr, K, False)
    return starts, ends, ptr, grams, gptr


def template_grams(templates: dict[str, str]) -> list[tuple]:
    """(hash, gram, template, label, template position, grams in the template)."""
    out = []
    for t, (phrase, label) in enumerate(templates.items()):
        words = phrase.split()
        chunk = next(W.chunks(pa.array([phrase])))[2]
        hashes = _grams(chunk)[3].view(np.int64).tolist()
        out += [(h, " ".join(words[p:p + K]), t, label, p, len(hashes)) for p, h in enumerate(hashes)]
    return out


def _kernel(wanted: np.ndarray):
    """Rows of all k-grams of each text, and one row (pos null) for the text.
    The words are added where the hash is one of a template's."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, hi, chunk in W.chunks(batch.column(1)):
                starts, ends, ptr, grams, gptr = _grams(chunk)
                n, count = hi - lo, np.diff(gptr)
                text = np.repeat(np.arange(n), count)
                pos = np.arange(len(grams)) - gptr[text]
                yield pa.record_batch([
                    pa.array(row + np.arange(n)), batch.column(0).slice(lo, n), pa.array(np.diff(ptr)),
                    pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())],
                    names=["row", "id", "n_words", "pos", "hash", "gram"])
                hit = np.flatnonzero(np.isin(grams, wanted))
                at = pos[hit] + ptr[text[hit]]
                said = [" ".join(chunk.text(starts[w + j], ends[w + j]) for j in range(K)).lower() for w in at.tolist()]
                index = np.full(len(grams), len(said))
                index[hit] = np.arange(len(said))
                yield pa.record_batch([
                    pa.array(row + text), pa.nulls(len(grams), pa.int64()), pa.nulls(len(grams), pa.int64()),
                    pa.array(pos), pa.array(grams.view(np.int64)),
                    pa.array(said + [None], pa.string()).take(pa.array(index))],
                    names=["row", "id", "n_words", "pos", "hash", "gram"])
                row += n
    return run


def _templates(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(
        template_grams(templates),
        "t_hash long, t_gram string, template int, label string, t_pos long, grams long")


def diagonals(docs: DataFrame, id_col: str, text_col: str, templates: dict[str, str]) -> DataFrame:
    """(row, template, label, grams, diagonal, votes, lo, hi, at, id, n_words): one
    row for each diagonal with votes, at which template positions, and one with
    template null for each text."""
    wanted = np.array([g[0] for g in template_grams(templates)], dtype=np.int64).view(np.uint64)
    grams = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")) \
        .mapInArrow(_kernel(wanted), ROWS)
    places = F.broadcast(_templates(docs.sparkSession, templates))
    voted = grams.join(places, (F.col("hash") == F.col("t_hash")) & (F.col("gram") == F.col("t_gram")), "left") \
        .where("pos is null or template is not null")
    return voted.groupBy("row", "template", "label", "grams", (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(
        F.count("t_pos").alias("votes"), F.min("pos").alias("lo"), (F.max("pos") + K).alias("hi"),
        F.collect_list("t_pos").alias("at"),
        F.max("id").alias("id"), F.max("n_words").alias("n_words"))


def spans(diags: DataFrame) -> DataFrame:
    """Merge neighbouring diagonals of one text and template: (row, template,
    label, grams, span, votes, lo, hi, whole, first_whole, last_whole, matches, id,
    n_words), matches as (text position, less the template position)."""
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    jump = (F.col("diagonal") - F.lag("diagonal").over(order) > GAP).cast("int")
    merged = diags.withColumn("span", F.sum(F.coalesce(jump, F.lit(0))).over(order))
    return merged.groupBy("row", "template", "label", "grams", "span").agg(
        F.sum("votes").alias("votes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.sum((F.col("votes") == F.col("grams")).cast("long")).alias("whole"),
        F.min(F.when(F.col("votes") == F.col("grams"), F.col("diagonal"))).alias("first_whole"),
        F.max(F.when(F.col("votes") == F.col("grams"), F.col("diagonal"))).alias("last_whole"),
        F.flatten(F.collect_list(F.transform("at", lambda t: F.struct(
            (F.col("diagonal") + t).alias("pos"), (-t).alias("back"))))).alias("matches"),
        F.max("id").alias("id"), F.max("n_words").alias("n_words"))


def covered() -> Column:
    """The most matches of a span that go forward in the text and the template.
    ``best[t]`` is that number for matches ending at template position t; of one
    text position the larger template positions come first, so it counts once."""
    def step(best: Column, match: Column) -> Column:
        at = (-match["back"]).cast("int")
        longer = F.coalesce(F.array_max(F.slice(best, F.lit(1), at)), F.lit(0)) + 1
        return F.transform(best, lambda b, t: F.when(t == at, F.greatest(b, longer)).otherwise(b))
    return F.array_max(F.aggregate(
        F.array_sort("matches"), F.array_repeat(F.lit(0), F.col("grams").cast("int")), step))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, labels,
    score) for every row.  ``n_base`` counts whole base phrases; ``labels`` adds
    the labels of accepted spans; ``score`` is the best share of a template that
    an accepted span covers."""
    found = spans(diagonals(docs, id_col, text_col, BASE | NOTICES))
    base = F.coalesce(F.col("template") < len(BASE), F.lit(False)) & (F.col("whole") > 0)
    # Votes are never fewer than what they cover, so only spans with enough are verified.
    found = found.withColumn("share", F.when(F.col("whole") > 0, F.lit(1.0)).when(
        F.col("votes") / F.col("grams") >= COVERED, covered() / F.col("grams")).otherwise(0.0))
    share = F.col("share")
    accepted = (F.col("whole") > 0) | (F.coalesce(F.col("template") >= len(BASE), F.lit(False)) & (share >= COVERED))

    def names(condition):
        return F.array_join(F.array_sort(F.collect_set(F.when(condition, F.col("label")))), ",")
    return found.groupBy("row").agg(
        F.max("id").alias(id_col), F.max("n_words").alias("n_words"),
        F.sum(F.when(base, F.col("whole")).otherwise(0)).cast("long").alias("n_base"),
        F.min(F.when(base, F.col("first_whole"))).alias("first_word"),
        F.max(F.when(base, F.col("last_whole"))).alias("last_word"),
        names(base).alias("base_labels"), names(accepted).alias("labels"),
        F.coalesce(F.max(F.when(accepted, share)), F.lit(0.0)).alias("score")).drop("row")
