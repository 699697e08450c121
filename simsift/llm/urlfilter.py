"""URL filter: host rules, then a weighted vocabulary.

Host rules (``host/path``) fit their host and all its subdomains where the url's
path starts with the rule's; the longest rule decides.  Every distinct host is
joined to the rules on its suffixes, so rules of any number are an equi-join.

Other urls are judged by vocabulary: an Aho-Corasick automaton finds strict and
soft terms in the lower-cased url (A-Z); a hit counts only between boundaries
(start, end, or a character that is no ASCII letter or digit).  One strict hit or
MIN_SOFT distinct soft terms block.  ``score`` adds the weight of each distinct
term found.

Defined results: a null url or one without ``://`` has an empty host and path,
fits no rule, and its vocabulary is that of the string (null: none); equal rules
of both verdicts: block; repeated rows are judged each; an empty table gives an
empty result; other columns are not looked at."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simsift.llm.common import is_small, materialize

MIN_SOFT = 2
# Terms and their weights.
STRICT = {
    "porn": 1.0, "porno": 1.0, "xxx": 1.0, "hentai": 1.0, "nsfw": 1.0, "camgirls": 1.0,
    "sexcam": 1.0, "onlinecasino": 1.0, "warez": 1.0, "keygen": 1.0,
}
SOFT = {
    "adult": 0.4, "sex": 0.4, "nude": 0.4, "escort": 0.4, "dating": 0.2, "webcam": 0.2,
    "casino": 0.4, "poker": 0.3, "bet": 0.2, "betting": 0.3, "slots": 0.2, "viagra": 0.4,
    "pills": 0.2, "crack": 0.3, "torrent": 0.3, "hack": 0.2, "replica": 0.2,
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _automaton(strict: dict[str, float], soft: dict[str, float]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, terms in (("soft", soft), ("strict", strict)):   # a term in both is strict
        for term, weight in terms.items():
            found.add_word(term, (term, kind, weight))
    found.make_automaton()
    return found


def _is_part(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def terms_in(url: str, automaton: ahocorasick.Automaton) -> tuple[int, int, int, float]:
    """(strict hits, soft hits, distinct soft terms, weight of distinct terms);
    ``url`` is lower-case."""
    hits, seen = {"strict": 0, "soft": 0}, {}
    for end, (term, kind, weight) in automaton.iter(url):
        start = end + 1 - len(term)
        if (start and _is_part(url[start - 1])) or (end + 1 < len(url) and _is_part(url[end + 1])):
            continue
        hits[kind] += 1
        seen[term] = (kind, weight)
    return (hits["strict"], hits["soft"], sum(k == "soft" for k, _ in seen.values()),
            sum(w for _, w in sorted(seen.values())))


def _vocabulary(column: int, names: list[str], strict: dict[str, float], soft: dict[str, float]):
    table = str.maketrans(UPPER, LOWER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(strict, soft)
        for batch in batches:
            found = [terms_in((u or "").translate(table), automaton) for u in batch.column(column).to_pylist()]
            hits, soft_hits, distinct, score = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.record_batch(
                list(batch.columns) + [pa.array(hits, pa.int64()), pa.array(soft_hits, pa.int64()),
                                       pa.array(distinct, pa.int64()), pa.array(score, pa.float64())],
                names=names + ["n_strict", "n_soft", "n_distinct", "score"])
    return run


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): for every host that some rule fits, the rules of its
    suffixes as an array of (size, blocks, path, rule, verdict).  ``rules`` has
    rule (``host/path``) and verdict."""
    parsed = rules.select(
        F.translate(F.substring_index("rule", "/", 1), UPPER, LOWER).alias("suffix"),
        F.struct(F.length("rule").alias("size"), (F.col("verdict") == "block").alias("blocks"),
                 F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)").alias("path"),
                 "rule", "verdict").alias("fit"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = hosts.select("host").distinct().where("host <> ''").select("host", F.explode(suffixes).alias("suffix"))
    parsed = materialize(parsed, "url-rules")
    return each.join(F.broadcast(parsed) if is_small(parsed) else parsed, "suffix") \
        .groupBy("host").agg(F.collect_set("fit").alias("rules"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               strict: dict[str, float] = STRICT, soft: dict[str, float] = SOFT,
               min_soft: int = MIN_SOFT) -> DataFrame:
    """(id_col, host, path, rule, verdict, n_strict, n_soft, n_distinct, score)
    for every row of ``pages``."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce("url", F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    found = rows.mapInArrow(
        _vocabulary(1, ["id", "url"], strict, soft),
        f"id {rows.schema['id'].dataType.simpleString()}, url string, n_strict long, n_soft long, "
        "n_distinct long, score double")
    split = found.withColumn("host", F.translate(F.regexp_extract(url, parts, 1), UPPER, LOWER)) \
        .withColumn("path", F.regexp_extract(url, parts, 2))
    hosts = rows.select(F.translate(F.regexp_extract(url, parts, 1), UPPER, LOWER).alias("host"))
    fitting = materialize(host_rules(hosts, rules), "host-rules")
    joined = split.join(F.broadcast(fitting) if is_small(fitting) else fitting, "host", "left")
    best = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])))
    own = F.when((F.col("n_strict") > 0) | (F.col("n_distinct") >= min_soft), "block").otherwise("allow")
    return joined.withColumn("best", best).select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", own).alias("verdict"), "n_strict", "n_soft", "n_distinct", "score")
