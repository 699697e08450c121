"""RAKE keyword text (Rose et al., 2010).

text -> lower-cased word/punctuation tokens -> phrases between break tokens (stop
words, punctuation) -> word frequency and degree (sum of the lengths of the
phrases it occurs in) -> phrase score = sum of degree/frequency of its words ->
phrases ordered by (score desc, phrase desc) and joined with one space.  Repeated
phrases are kept.

A text's keywords depend on that text alone, so they are an Arrow function of the
column: nothing is shuffled and no row per word exists.  (As windows and joins over
exploded words the same took a shuffle of the text and several of its words.)"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The default English stop-word list (the matcher's keyword
# variant depends on it; callers may pass their own list).
STOPWORDS = tuple("""
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
she her hers herself it its itself they them their theirs themselves what which who whom
this that these those am is are was were be been being have has had having do does did
doing a an the and but if or because as until while of at by for with about against
between into through during before after above below to from up down in out on off over
under again further then once here there when where why how all any both each few more
most other some such no nor not only own same so than too very s t can will just don
should now d ll m o re ve y ain aren couldn didn doesn hadn hasn haven isn ma mightn
mustn needn shan shouldn wasn weren won wouldn
""".split())

_TOKENS = re.compile(r"\w+|[^\w\s]+")
_WORD = re.compile(r"\w+")


def rake_text(text: str, stopwords: Iterable[str] = STOPWORDS) -> str:
    """The ranked phrases of one text (what ``rake_keywords`` gives for it)."""
    stop = stopwords if isinstance(stopwords, frozenset) else frozenset(stopwords)
    words = [w if _WORD.fullmatch(w) and w not in stop else None for w in _TOKENS.findall(text.lower())]
    phrases = [list(p) for is_word, p in groupby(words, lambda w: w is not None) if is_word]
    freq, degree = Counter(), Counter()
    for phrase in phrases:
        for w in phrase:
            freq[w] += 1
            degree[w] += len(phrase)
    ranked = sorted(((reduce(lambda total, w: total + degree[w] / freq[w], p, 0.0), " ".join(p)) for p in phrases), reverse=True)
    return " ".join(p for _, p in ranked)


def rake_column(text: Column | str, stopwords: Iterable[str] = STOPWORDS) -> Column:
    """The ranked phrases of a text column (``""`` without phrases, null for null)."""
    stop = frozenset(stopwords)

    @F.arrow_udf(T.StringType())
    def ranked(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else rake_text(t, stop) for t in texts.to_pylist()], pa.string())
    return ranked(F.col(text) if isinstance(text, str) else text)


def rake_keywords(df: DataFrame, text: str, doc_id: str, out: str = "keywords",
                  stopwords: Iterable[str] = STOPWORDS) -> DataFrame:
    """``doc_id, out``: the RAKE ranked phrases of each row's text joined by spaces
    (``""`` for a text without phrases, null for a null text)."""
    return df.select(F.col(doc_id), rake_column(text, stopwords).alias(out))
