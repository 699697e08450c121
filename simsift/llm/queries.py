"""Registered queries of this subpackage, with production parameters, and DuckDB
SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simsift.llm import (chat, decontaminate, hardneg, hostquality, licenses, neardup, pseudonyms, secretscan,
                         tokencounts, unigram, urlfilter, warc, whitening)
from simsift.session import materialize

TOKENIZERS = "file:///opt/tokenizers"
PIECES = f"{TOKENIZERS}/piece_bpe_32k.model"
RANKS = f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken"
#: Stands for a key from the caller's secret store; anyone can read this one.
DEMO_KEY = b"public key of the registered query"
WARC_DATE = "2024-01-01T00:00:00Z"
#: Host rules of the contract.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: The conversation that op3 adds, and what both of its rows say.
EXTRA_ID, EXTRA_TEXT = -7, "\\### Assistant: </turn> ok"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.encode(_table(spark, sf_dir, "documents"), unigram.read_model(spark, PIECES), check=True)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(EXTRA_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA_TEXT).alias("text"))
    trees = materialize(chat.linear_trees(given.unionByName(extra), "conv_id", "turn", "role", "text"), "trees")
    return chat.digests(chat.format_conversations(trees))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostquality.host_quality(_table(spark, sf_dir, "documents"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencounts.count_tokens(_table(spark, sf_dir, "documents"), tokencounts.read_ranks(spark, RANKS),
                                    public_tokenizers.PATTERN, ["lang", "source"], "text")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(sorted(RULES.items()), "rule string, verdict string")
    judged = urlfilter.judge_urls(_table(spark, sf_dir, "pages"), rules)
    return judged.withColumn("score", F.round("score", 6))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymized_documents(_table(spark, sf_dir, "documents"), DEMO_KEY)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derivatives(warc.responses(_table(spark, sf_dir, "pages"), WARC_DATE))
    return made.withColumn("record", F.col("record").cast("string"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.secret_report(_table(spark, sf_dir, "documents"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(_table(spark, sf_dir, "embeddings"), label=label)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pigeonhole_decontamination": op1, "op2_unigram_pieces": op2, "op3_reply_tree_chat": op3,
        "op4_license_diagonals": op4, "op5_host_quality": op5, "op6_section_tokens": op6,
        "op7_bbit_minhash": op7, "op8_url_vocabulary": op8, "op9_feistel_pseudonyms": op9,
        "op10_warc_derivatives": op10, "op11_trigram_secrets": op11,
        "op12_cluster_hard_negatives": op12, "op13_incremental_whitening": op13,
    }


# --- DuckDB SQL ----------------------------------------------------------------

_A_TO_Z = f"'{urlfilter.UPPER}', '{urlfilter.LOWER}'"
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


OP3_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'),
                                    (-7, 1, 'assistant', '\### Assistant: </turn> ok')) v(conv_id, turn, role, text)),
escaped AS (
    SELECT *, replace(replace(replace(text, '\', '\\'), '### ', '#\## '), '</turn>', '<\/turn>') AS body,
           replace(replace(replace(replace(role, '\', '\\'), '### ', '#\## '), '</turn>', '<\/turn>'),
                   ': ', ':\ ') AS head
    FROM turns),
whole AS (
    SELECT conv_id, count(*) AS n_turns,
           string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
           coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
           sum(length('### ' || head || ': ' || body || '</turn>' || chr(10))) AS size
    FROM escaped GROUP BY conv_id)
SELECT CAST(conv_id AS BIGINT) AS conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(size AS BIGINT) AS formatted_chars
FROM whole
"""

_PHRASES = licenses.BASE | licenses.NOTICES
OP4_SQL = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS row, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), {_A_TO_Z}), '{_ALNUM}') AS words FROM documents),
phrases AS (SELECT * FROM (VALUES {_values((i, p, c) for i, (p, c) in enumerate(_PHRASES.items()))})
            t(template, phrase, label)),
split AS (SELECT *, string_split(phrase, ' ') AS parts FROM phrases),
places AS (SELECT template, label, len(parts) - 1 AS grams, i - 1 AS t_pos, parts[i] || ' ' || parts[i + 1] AS gram
           FROM split, unnest(range(1, len(parts))) u(i)),
grams AS (SELECT row, i - 1 AS pos, words[i] || ' ' || words[i + 1] AS gram
          FROM docs, unnest(range(1, len(words))) u(i)),
diagonals AS (SELECT row, template, label, grams.pos - t_pos AS diagonal, any_value(places.grams) AS grams, count(*) AS votes
              FROM grams JOIN places USING (gram) GROUP BY ALL),
jumps AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER w > {licenses.GAP} THEN 1 ELSE 0 END AS jump
          FROM diagonals WINDOW w AS (PARTITION BY row, template ORDER BY diagonal)),
numbered AS (SELECT *, sum(jump) OVER (PARTITION BY row, template ORDER BY diagonal) AS span FROM jumps),
spans AS (SELECT row, template, label, span, least(sum(votes) / any_value(grams), 1.0) AS share,
                 count(*) FILTER (votes = grams) AS whole, min(diagonal) FILTER (votes = grams) AS first_whole,
                 max(diagonal) FILTER (votes = grams) AS last_whole
          FROM numbered GROUP BY ALL),
marked AS (SELECT *, template < {len(licenses.BASE)} AND whole > 0 AS base,
                  whole > 0 OR (template >= {len(licenses.BASE)} AND share >= {licenses.COVERED}) AS accepted FROM spans),
found AS (SELECT row, sum(whole) FILTER (base) AS n_base, min(first_whole) FILTER (base) AS first_word,
                 max(last_whole) FILTER (base) AS last_word,
                 array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ',') AS base_labels,
                 array_to_string(list_sort(list_distinct(list(label) FILTER (accepted))), ',') AS labels,
                 max(share) FILTER (accepted) AS score
          FROM marked GROUP BY row)
SELECT doc_id, len(words) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM docs LEFT JOIN found USING (row)
"""

_RULES = {"symbols": "4 * n_symbols > n_words", "dense": "n_symbols > n_words",
          "lines": "10 * n_dup_lines > 3 * n_lines",
          "length": "word_chars < 2 * n_words OR word_chars > 15 * n_words"}
_FAILS = " + ".join(f"CASE WHEN {_rule} THEN 1 ELSE 0 END" for _rule in _RULES.values())
OP5_SQL = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS row, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS words FROM documents),
lines AS (
    SELECT row, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
    FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM docs)
    WHERE regexp_matches(line, '{_SPACED}') GROUP BY row),
runs AS (
    SELECT row, i, words[i:i + 2] AS run FROM docs, unnest(range(1, len(words) - 1)) u(i)),
again AS (SELECT row, i FROM runs QUALIFY count(*) OVER (PARTITION BY row, run) > 1),
repeated AS (SELECT row, count(DISTINCT i + j) AS n FROM again, (VALUES (0), (1), (2)) v(j) GROUP BY row),
measured AS (
    SELECT docs.row, doc_id, host, len(words) AS n_words,
           CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
           coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
           coalesce(repeated.n, 0) AS n_repeat_words
    FROM docs LEFT JOIN lines USING (row) LEFT JOIN repeated USING (row)),
judged AS (
    SELECT *, n_words < {hostquality.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
           {_FAILS} AS fails FROM measured),
failed AS (SELECT host, unnest([base_failed, {", ".join(_RULES.values())}]) AS failed,
                  unnest(range({len(_RULES) + 1})) AS rule FROM judged),
hosts AS (SELECT host, rule, count(*) AS n, count(*) FILTER (failed) AS f FROM failed GROUP BY ALL),
totals AS (SELECT rule, count(*) AS hosts, sum(n) AS docs,
                  (sum(f * f / n) - sum(f) * sum(f) / sum(n)) / (count(*) - 1) AS between_hosts,
                  (sum(f) - sum(f * f / n)) / (sum(n) - count(*)) AS within_hosts,
                  (sum(n) - sum(n * n) / sum(n)) / (count(*) - 1) AS usual FROM hosts GROUP BY rule),
alike AS (SELECT rule, CASE WHEN hosts < 2 OR docs = hosts OR between_hosts <= within_hosts THEN 0
                       ELSE (between_hosts - within_hosts) / (between_hosts + (usual - 1) * within_hosts) END AS rho FROM totals),
priors AS (SELECT rule, sum(f / (1 + (n - 1) * rho)) / sum(n / (1 + (n - 1) * rho)) AS mean,
                  CASE WHEN rho > 0 THEN greatest({hostquality.MIN_PRIOR}, least({hostquality.MAX_PRIOR}, 1 / rho - 1))
                       ELSE {hostquality.MAX_PRIOR} END AS weight
           FROM hosts JOIN alike USING (rule) GROUP BY rule, rho),
strict AS (SELECT host, bool_or((mean * weight + f) / (weight + n) > {hostquality.HOST_LIMIT}) AS host_strict
           FROM hosts JOIN priors USING (rule) GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND fails <= CASE WHEN host_strict THEN 0 ELSE 1 END AS kept, host_strict
FROM judged JOIN strict USING (host)
"""

OP7_SQL = rf"""
WITH RECURSIVE docs AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_A_TO_Z}), '{_SPACED}') AS words FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(words[i:i + {neardup.SHINGLE - 1}], ' ') AS shingle
    FROM docs, unnest(range(1, greatest(len(words) - {neardup.SHINGLE - 2}, least(len(words), 1) + 1))) u(i)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
    SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * pairs.n >= {neardup.PERCENT} * (x.n + y.n - pairs.n)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
least_id AS (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id,
       doc_id <= coalesce(low, doc_id) AS kept
FROM docs LEFT JOIN sizes USING (doc_id) LEFT JOIN least_id USING (doc_id)
"""

_STRICT, _SOFT = sorted(urlfilter.STRICT.items()), sorted(urlfilter.SOFT.items())
_RULE_CASES = {"rule": [], "verdict": []}
for _rule, _verdict in sorted(RULES.items(), key=lambda x: -len(x[0])):
    _host, _, _path = _rule.partition("/")
    _fits = f"(host = '{_host}' OR ends_with(host, '.{_host}')) AND starts_with(path, '/{_path}')"
    _RULE_CASES["rule"].append(f"WHEN {_fits} THEN '{_rule}'")
    _RULE_CASES["verdict"].append(f"WHEN {_fits} THEN '{_verdict}'")
OP8_SQL = rf"""
WITH urls AS (
    SELECT row_number() OVER () AS row, page_id, coalesce(url, '') AS url,
           translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), {_A_TO_Z}) AS host,
           regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
tokens AS (SELECT row, unnest(string_split_regex(translate(url, {_A_TO_Z}), '[^a-z0-9]+')) AS term FROM urls),
vocabulary AS (SELECT * FROM (VALUES {_values([(t, 'strict', w) for t, w in _STRICT]
                                              + [(t, 'soft', w) for t, w in _SOFT])}) v(term, kind, weight)),
counted AS (SELECT row, term, kind, weight, count(*) AS hits FROM tokens JOIN vocabulary USING (term) GROUP BY ALL),
found AS (SELECT row, sum(hits) FILTER (kind = 'strict') AS n_strict, sum(hits) FILTER (kind = 'soft') AS n_soft,
                 count(*) FILTER (kind = 'soft') AS n_distinct, sum(weight) AS score FROM counted GROUP BY row)
SELECT page_id, host, path, CASE {' '.join(_RULE_CASES['rule'])} END AS rule,
       CASE {' '.join(_RULE_CASES['verdict'])}
            WHEN coalesce(n_strict, 0) > 0 OR coalesce(n_distinct, 0) >= {urlfilter.MIN_SOFT} THEN 'block'
            ELSE 'allow' END AS verdict,
       CAST(coalesce(n_strict, 0) AS BIGINT) AS n_strict, CAST(coalesce(n_soft, 0) AS BIGINT) AS n_soft,
       CAST(coalesce(n_distinct, 0) AS BIGINT) AS n_distinct, CAST(round(coalesce(score, 0), 6) AS DOUBLE) AS score
FROM urls LEFT JOIN found USING (row)
"""

def _secret_spans(k: int, rule: secretscan.Rule) -> str:
    """A rule's spans: between the matches stand the pieces that the text splits into."""
    pattern = rule.pattern.replace("'", "''")
    return f"""
    SELECT row, {k} AS kind, '{rule.kind}' AS name, {int(k < len(secretscan.BASE))} AS base,
           CAST(list_sum(list_transform(pieces[1:i], lambda p: length(p)))
                + coalesce(list_sum(list_transform(found[1:i - 1], lambda m: length(m))), 0) AS BIGINT) AS start,
           length(found[i]) AS size
    FROM (SELECT row, regexp_extract_all(text, '{pattern}') AS found,
                 regexp_extract_all(text, '{pattern}', {rule.group}) AS judged,
                 string_split_regex(text, '{pattern}') AS pieces FROM docs),
         unnest(range(1, len(found) + 1)) u(i)
    WHERE length(judged[i]) >= {rule.least}"""


OP11_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join(_secret_spans(k, r) for k, r in enumerate(secretscan.BASE + secretscan.ADDED))}),
said AS (SELECT *, name || ':' || start || ':' || (start + size) AS span FROM spans),
joined AS (
    SELECT row, {", ".join(f"count(*) FILTER (kind = {k}) AS n_{r.kind}" for k, r in enumerate(secretscan.BASE))},
           coalesce(string_agg(span, ',' ORDER BY start, kind) FILTER (base = 1), '') AS base,
           string_agg(span, ',' ORDER BY start, kind) AS spans FROM said GROUP BY row)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secretscan.BASE)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN joined USING (row)
"""

OP12_SQL = """
WITH vecs AS (
    SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS x
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
scores AS (
    SELECT a.row AS a_row, a.vec_id AS anchor_id, b.row, b.vec_id, a.label = b.label AS same,
           CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
    FROM vecs a JOIN vecs b ON a.row <> b.row WHERE a.vec_id % 50 = 0),
positives AS (
    SELECT a_row, row_number() OVER w AS place, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
    WINDOW w AS (PARTITION BY a_row ORDER BY score DESC, vec_id, row) QUALIFY place <= 5),
ranked AS (
    SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
           row_number() OVER (PARTITION BY a_row, place ORDER BY score DESC, vec_id, row) AS rank
    FROM positives JOIN scores USING (a_row)
    WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_reply_tree_chat": OP3_SQL, "op4_license_diagonals": OP4_SQL, "op5_host_quality": OP5_SQL,
            "op7_bbit_minhash": OP7_SQL, "op8_url_vocabulary": OP8_SQL, "op11_trigram_secrets": OP11_SQL,
            "op12_cluster_hard_negatives": OP12_SQL}
