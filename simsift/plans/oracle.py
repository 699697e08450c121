"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

The oracle is deliberately naive (a full self-join for the similarity
search); it only has to run at the small check scale."""

from __future__ import annotations

from simsift.operators.keywords import STOPWORDS
from simsift.plans.tables import (ARTICULATION_VIEW_SQL, EXTERNAL_CATALOGUE_SQL,
                                  INTERNAL_CATALOGUE_SQL)

# Shared CTEs -------------------------------------------------------------

_E = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"


def _folded(k: int, v: str = "v", dims: int = 64) -> str:
    """The vector folded onto k dimensions: coordinates i, i + k, ... added."""
    terms = " + ".join(f"{v}[j + {a}]" if a else f"{v}[j]" for a in range(0, dims, k))
    return f"list_transform(range(1, {k + 1}), lambda j: {terms})"


def _fold_cte(name: str, k: int, source: str = "e") -> str:
    return f"{name} AS (SELECT vec_id, {_folded(k)} AS v, label FROM {source})"


def _ranked(name: str, e: str = "e", where: str = "a.vec_id <> b.vec_id") -> str:
    return f"""{name} AS (
  SELECT query_id, cand_id, score,
         row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cand_id) AS rank
  FROM (SELECT a.vec_id AS query_id, b.vec_id AS cand_id,
               greatest(least(coalesce(list_cosine_similarity(a.v, b.v), 0.0), 1.0), -1.0)
                 AS score
        FROM {e} a JOIN {e} b ON {where}))"""


def _match(truth: str, ranked: str, k: int, codes: str = "SELECT DISTINCT label AS code FROM e",
           searched: str = "TRUE") -> str:
    """outcomes over truth(row_id, truth_code) from ranked(query_id, cand_id,
    score, rank) and the labels of the candidates; ``codes`` are those on offer,
    ``searched`` says which truth rows q have a vector."""
    return f"""cand AS (SELECT r.query_id, r.rank, r.score, b.label AS code
         FROM {ranked} r JOIN e b ON b.vec_id = r.cand_id WHERE r.rank <= {k}),
truth AS ({truth}),
best AS (SELECT c.query_id, min(c.rank) AS mr
         FROM cand c JOIN truth q ON q.row_id = c.query_id AND c.code = q.truth_code GROUP BY 1),
hits AS (SELECT c.* FROM cand c JOIN best ON best.query_id = c.query_id AND best.mr = c.rank),
cat AS ({codes}),
outcomes AS (
  SELECT q.row_id, q.truth_code, hits.code AS OSU_Course_Code,
         CAST(hits.rank AS INTEGER) AS row_number,
         CAST(CASE WHEN NOT ({searched}) THEN -1 WHEN hits.rank IS NOT NULL THEN 1
                   WHEN cat.code IS NOT NULL THEN 0 ELSE -1 END AS INTEGER) AS match,
         CAST(hits.rank - 1 AS INTEGER) AS similar_courses_row_number,
         hits.score AS similarity_score,
         CASE WHEN NOT ({searched}) THEN 'external_not_found' WHEN hits.rank IS NOT NULL THEN 'hit'
              WHEN cat.code IS NOT NULL THEN 'miss' ELSE 'truth_not_in_catalogue' END AS reason
  FROM truth q LEFT JOIN hits ON hits.query_id = q.row_id LEFT JOIN cat ON cat.code = q.truth_code)"""


_SELF_TRUTH = "SELECT vec_id AS row_id, label AS truth_code FROM e"
_OUTCOMES = f"""{_E},
{_ranked("ranked")},
{_match(_SELF_TRUTH, "ranked", 20)}"""

_PAIRS = f"""{_E},
{_ranked("ranked")},
pairs AS (SELECT r.query_id, r.cand_id, r.score AS cs,
                 CASE WHEN a.label = b.label THEN 1 ELSE -1 END AS y
          FROM ranked r JOIN e a ON a.vec_id = r.query_id JOIN e b ON b.vec_id = r.cand_id
          WHERE r.rank <= 10)"""


def _hit_rate(outcomes_cte: str) -> str:
    return f"""WITH {outcomes_cte},
v AS (SELECT * FROM outcomes WHERE match <> -1),
g AS (SELECT unnest(range(1, (SELECT max(row_number) FROM v) + 1)) AS top_i)
SELECT CAST(top_i AS INTEGER) AS top_i,
       CAST((SELECT count(*) FROM v WHERE v.row_number <= g.top_i) AS BIGINT) AS hits,
       CAST((SELECT count(*) FROM v) AS BIGINT) AS n,
       round_even(100.0 * (SELECT count(*) FROM v WHERE v.row_number <= g.top_i)
                  / (SELECT count(*) FROM v), 2) AS hit_rate
FROM g"""


def _fused(kind: str) -> str:
    join = "JOIN" if kind == "mean" else "FULL OUTER JOIN"
    score = ("(a.score + b.score) / 2" if kind == "mean"
             else "0.5 * coalesce(a.score, 0.0) + 0.5 * coalesce(b.score, 0.0)")
    return f"""{_E},
{_fold_cte("e2", 32)},
{_ranked("r1")},
{_ranked("r2", "e2")},
{_fuse(join, score)}"""


def _fuse(join: str, score: str) -> str:
    return f"""a AS (SELECT * FROM r1 WHERE rank <= 10),
b AS (SELECT * FROM r2 WHERE rank <= 10),
f AS (SELECT coalesce(a.query_id, b.query_id) AS row_id, coalesce(a.cand_id, b.cand_id) AS code,
             a.score AS score_1, b.score AS score_2, {score} AS score,
             CAST(a.rank AS INTEGER) AS rank_1, CAST(b.rank AS INTEGER) AS rank_2
      FROM a {join} b ON a.query_id = b.query_id AND a.cand_id = b.cand_id),
fr AS (SELECT *, CAST(row_number() OVER (PARTITION BY row_id ORDER BY score DESC, code)
                      AS INTEGER) AS rank FROM f)"""


ORACLE: dict[str, str] = {}

ORACLE["topk_match"] = f"""WITH {_E},
{_ranked("ranked")}
SELECT r.query_id, r.cand_id, b.label AS cand_label, round(r.score, 6) AS score,
       CAST(r.rank AS INTEGER) AS rank,
       CASE WHEN r.score > 0.65 THEN 'High Confidence'
            WHEN r.score > 0.35 AND r.score <= 0.65 THEN 'Low Confidence'
            ELSE 'No Confidence' END AS confidence
FROM ranked r JOIN e b ON b.vec_id = r.cand_id WHERE r.rank <= 10"""

ORACLE["match_outcomes"] = f"""WITH {_OUTCOMES}
SELECT row_id, truth_code, OSU_Course_Code, row_number, match, similar_courses_row_number,
       round(similarity_score, 6) AS similarity_score, reason
FROM outcomes"""

ORACLE["hit_rate_at_k"] = _hit_rate(_OUTCOMES)

ORACLE["fuse_mean"] = f"""WITH {_fused("mean")}
SELECT row_id, code, round(score_1, 6) AS score_1, round(score_2, 6) AS score_2,
       round(score, 6) AS score, rank, rank_1, rank_2 FROM fr"""

ORACLE["fuse_weighted"] = f"""WITH {_fused("weighted")}
SELECT row_id, code, round(score_1, 6) AS score_1, round(score_2, 6) AS score_2,
       round(score, 6) AS score, rank, rank_1, rank_2 FROM fr"""

_BY_QUERY = "(SELECT row_id AS query_id, code AS cand_id, score, rank FROM fr)"
_FUSED_OUTCOMES = f"""{_fused("mean")},
{_match(_SELF_TRUTH, _BY_QUERY, 10 ** 9)}"""

ORACLE["fused_hit_rate"] = _hit_rate(_FUSED_OUTCOMES)

ORACLE["accuracy_sweep"] = f"""WITH {_PAIRS},
t AS (SELECT CAST(i AS DOUBLE) / 1000 AS th FROM range(-1000, 1000) r(i)),
acc AS (SELECT th, avg(CASE WHEN (cs > th AND y = 1) OR (NOT (cs > th) AND y = -1)
                            THEN 1.0 ELSE 0.0 END) AS a
        FROM t, pairs GROUP BY th),
best AS (SELECT max(a) AS a, (SELECT count(*) FROM pairs) AS n FROM acc)
SELECT round(a, 6) AS accuracy, CAST(n AS BIGINT) AS n,
       round(sqrt(a * (1 - a) / n), 6) AS se, round(1.96 * sqrt(a * (1 - a) / n), 6) AS ci95
FROM best"""

ORACLE["accuracy_fixed"] = f"""WITH {_PAIRS},
p AS (SELECT cs, CASE WHEN y = -1 THEN 0 ELSE 1 END AS y FROM pairs),
s AS (SELECT avg(CASE WHEN (cs > 0.5 AND y = 1) OR (cs <= 0.5 AND y = 0) THEN 1.0 ELSE 0.0 END)
               AS a, count(*) AS n FROM p)
SELECT round(a, 6) AS accuracy, CAST(n AS BIGINT) AS n,
       round(sqrt(a * (1 - a) / n), 6) AS se, round(1.96 * sqrt(a * (1 - a) / n), 6) AS ci95
FROM s"""

ORACLE["classification_report"] = f"""WITH {_PAIRS},
c AS (SELECT count(*) AS n,
             count(*) FILTER (WHERE cs >= 0.5 AND y = 1) AS tp,
             count(*) FILTER (WHERE cs >= 0.5 AND y <> 1) AS fp,
             count(*) FILTER (WHERE NOT (cs >= 0.5) AND y = 1) AS fn,
             count(*) FILTER (WHERE NOT (cs >= 0.5) AND y <> 1) AS tn FROM pairs),
m AS (SELECT *, (tp + tn) * 1.0 / n AS accuracy,
             CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp * 1.0 / (tp + fp) END AS precision,
             CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp * 1.0 / (tp + fn) END AS recall FROM c)
SELECT CAST(n AS BIGINT) AS n, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn,
       round(accuracy, 6) AS accuracy, round(precision, 6) AS precision,
       round(recall, 6) AS recall,
       round(CASE WHEN precision + recall = 0 THEN 0.0
                  ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1
FROM m"""

ORACLE["roc_auc"] = f"""WITH {_PAIRS},
h AS (SELECT cs, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg
      FROM pairs GROUP BY cs),
c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY cs ROWS BETWEEN UNBOUNDED PRECEDING
                                        AND 1 PRECEDING), 0) AS below FROM h)
SELECT round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS auc FROM c"""

ORACLE["losses"] = f"""WITH {_PAIRS}
SELECT round(avg((cs - y) * (cs - y)), 6) AS mse,
       round(avg(greatest(cs, 0) - cs * (CASE WHEN y = -1 THEN 0 ELSE 1 END)
                 + ln(1 + exp(-abs(cs)))), 6) AS bce
FROM pairs"""

_SCORES = f"""{_OUTCOMES},
s AS (SELECT similarity_score AS v FROM outcomes WHERE similarity_score IS NOT NULL)"""

ORACLE["score_quantile"] = f"""WITH {_SCORES}
SELECT round(quantile_cont(v, 0.25), 6) AS q25 FROM s"""

ORACLE["score_histogram"] = f"""WITH {_SCORES},
st AS (SELECT min(v) AS lo, max(v) AS hi, count(*) AS n FROM s),
b0 AS (SELECT v, lo, hi, n, CAST(least(floor((v - lo) * (30 / (hi - lo))), 29) AS INTEGER) AS b
       FROM s, st),
b1 AS (SELECT v, lo, hi, n, CASE WHEN v < lo + b * ((hi - lo) / 30) THEN b - 1 ELSE b END AS b
       FROM b0),
b2 AS (SELECT v, lo, hi, n,
              CASE WHEN b <> 29 AND v >= (CASE WHEN b + 1 >= 30 THEN hi
                                          ELSE lo + (b + 1) * ((hi - lo) / 30) END)
                   THEN b + 1 ELSE b END AS b FROM b1),
c AS (SELECT b, count(*) AS cnt FROM b2 GROUP BY b),
g AS (SELECT CAST(i AS INTEGER) AS b, lo, hi, n FROM range(0, 30) r(i), st)
SELECT g.b AS bin, round(lo + g.b * ((hi - lo) / 30), 6) AS bin_lo,
       round(CASE WHEN g.b + 1 >= 30 THEN hi ELSE lo + (g.b + 1) * ((hi - lo) / 30) END, 6)
         AS bin_hi,
       CAST(coalesce(cnt, 0) AS BIGINT) AS count,
       round(coalesce(cnt, 0) / (n * ((hi - lo) / 30)), 4) AS density
FROM g LEFT JOIN c ON c.b = g.b"""

ORACLE["score_kde"] = f"""WITH {_SCORES},
st AS (SELECT min(v) AS lo, max(v) AS hi, count(*) AS n,
              stddev_samp(v) * pow(count(*), -0.2) AS bw FROM s),
g AS (SELECT CAST(i AS INTEGER) AS point,
             CASE WHEN i = 99 THEN hi ELSE lo + i * ((hi - lo) / 99) END AS x, n, bw
      FROM range(0, 100) r(i), st)
SELECT point, round(x, 6) AS x,
       round(sum(exp(-pow((x - v) / bw, 2) / 2)) / (n * bw * sqrt(2 * pi())), 4) AS density
FROM g, s GROUP BY point, x, n, bw"""

ORACLE["code_scalars"] = r"""SELECT p_partkey,
  CAST(nullif(regexp_extract(p_brand, '([0-9]+)', 1), '') AS BIGINT) AS brand_number,
  p_brand || ' ' || CAST(p_size AS VARCHAR) || substr(p_type, 1, 1) AS raw_code,
  regexp_replace(p_brand || ' ' || CAST(p_size AS VARCHAR) || substr(p_type, 1, 1),
                 '([0-9]+)[^0-9]*$', '\1') AS stripped_code,
  p_type || ' ' || CAST(p_size AS VARCHAR) AS course_code,
  lower(p_brand || ', ' || p_name || ', ' || p_type) AS composite,
  lower(regexp_replace(p_name || ' *+' || p_type, '[*+]', '', 'g')) AS clean,
  CASE WHEN p_retailprice / 2000.0 > 0.65 THEN 'High Confidence'
       WHEN p_retailprice / 2000.0 > 0.35 AND p_retailprice / 2000.0 <= 0.65
         THEN 'Low Confidence'
       ELSE 'No Confidence' END AS band
FROM part"""

ORACLE["articulation_truth"] = f"""WITH a AS ({ARTICULATION_VIEW_SQL}),
v AS (SELECT * FROM a WHERE EQUIV_EXISTS = 'Y' AND EQUI_TITLE <> 'NOT ACCEPTED IN TRANSFER'
        AND regexp_full_match(EQUIV_CRSE, '[0-9]+') AND EQUIV_CRSE NOT IN ('000', '0000')
        AND TERM >= 199700),
r AS (SELECT TRNS_DESCRIPTION AS Ext_Inst, CAST(CAST(floor(TERM / 100) AS INTEGER) AS VARCHAR)
             AS YEAR, TR_SUBJ || ' ' || TR_COURSE AS Ext_Course_Code,
             EQUIV_SUBJECT || ' ' || EQUIV_CRSE AS Int_Course_Code,
             row_number() OVER (PARTITION BY TRNS_DESCRIPTION, floor(TERM / 100),
                                TR_SUBJ || ' ' || TR_COURSE
                                ORDER BY l_orderkey, l_linenumber, CAST(EQUIV_CRSE AS INTEGER))
               AS rn
      FROM v)
SELECT Ext_Inst, CAST(CAST(YEAR AS INTEGER) - 1 AS VARCHAR) || '-' || YEAR AS Transfer_Year,
       Ext_Course_Code, Int_Course_Code
FROM r WHERE rn = 1"""

ORACLE["rejected_rows"] = f"""WITH a AS ({ARTICULATION_VIEW_SQL})
SELECT TRNS_DESCRIPTION, CAST(CAST(floor(TERM / 100) AS INTEGER) AS VARCHAR) AS YEAR,
       count(*) AS n_rejected, count(DISTINCT TR_SUBJ || ' ' || TR_COURSE) AS n_courses
FROM a WHERE EQUIV_EXISTS = 'Y' AND EQUI_TITLE = 'NOT ACCEPTED IN TRANSFER'
  AND regexp_full_match(EQUIV_CRSE, '[0-9]+') AND TERM >= 199700
GROUP BY 1, 2"""

ORACLE["course_index"] = """SELECT p_brand AS code, arg_max(p_name, p_partkey) AS title FROM part
WHERE p_brand IS NOT NULL GROUP BY p_brand"""

ORACLE["term_years"] = """WITH t AS (SELECT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER)
                  AS term FROM orders)
SELECT term, CAST(CAST(floor(term / 100) AS INTEGER) AS VARCHAR) AS year,
       CAST(CAST(floor(term / 100) AS INTEGER) - 1 AS VARCHAR) || '-'
         || CAST(CAST(floor(term / 100) AS INTEGER) AS VARCHAR) AS academic_year,
       count(*) AS n_orders
FROM t GROUP BY term"""

ORACLE["stratified_split"] = """WITH r AS (
  SELECT vec_id, label,
         row_number() OVER (PARTITION BY label ORDER BY md5('123|' || CAST(vec_id AS VARCHAR)),
                            vec_id) AS rn,
         count(*) OVER (PARTITION BY label) AS n FROM embeddings)
SELECT vec_id, label, CASE WHEN rn <= round(n * 0.2) THEN 'test' ELSE 'train' END AS dataset
FROM r"""

ORACLE["three_way_split"] = """WITH r AS (
  SELECT vec_id, label,
         row_number() OVER (PARTITION BY label ORDER BY md5('123|' || CAST(vec_id AS VARCHAR)),
                            vec_id) AS rn,
         count(*) OVER (PARTITION BY label) AS n FROM embeddings),
c AS (SELECT *, round(n * 0.2) AS t FROM r)
SELECT vec_id, label,
       CASE WHEN rn <= t THEN 'test' WHEN rn - t <= round((n - t) * 0.1) THEN 'validation'
            ELSE 'train' END AS dataset
FROM c"""

ORACLE["split_null_labels"] = """WITH e AS (SELECT vec_id, CASE WHEN label < 7 THEN label END AS label FROM embeddings),
r AS (
  SELECT vec_id, label,
         row_number() OVER (PARTITION BY label ORDER BY md5('123|' || CAST(vec_id AS VARCHAR)),
                            vec_id) AS rn,
         count(*) OVER (PARTITION BY label) AS n FROM e),
c AS (SELECT *, round(n * 0.2) AS t FROM r)
SELECT vec_id, label, CASE WHEN rn <= t THEN 'test' ELSE 'train' END AS dataset,
       CASE WHEN rn <= t THEN 'test' WHEN rn - t <= round((n - t) * 0.1) THEN 'validation'
            ELSE 'train' END AS three_way
FROM c"""

ORACLE["grouped_metrics"] = f"""WITH {_PAIRS},
p AS (SELECT pairs.*, CASE WHEN label <> 3 THEN label END AS class
      FROM pairs JOIN embeddings ON vec_id = query_id),
h AS (SELECT class, cs, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg
      FROM p GROUP BY ALL),
c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY class ORDER BY cs ROWS BETWEEN UNBOUNDED PRECEDING
                                        AND 1 PRECEDING), 0) AS below FROM h),
a AS (SELECT class, sum(pos * (below + neg / 2.0)) / nullif(sum(pos) * sum(neg), 0) AS auc FROM c GROUP BY class),
q AS (SELECT class, quantile_cont(cs, 0.25) AS q25 FROM p GROUP BY class)
SELECT a.class, round(auc, 6) AS auc, round(q25, 6) AS q25 FROM a JOIN q ON a.class IS NOT DISTINCT FROM q.class"""

ORACLE["best_by_name"] = """WITH c AS (
  SELECT c_nationkey, round(c_acctbal / 1000) AS thousands, c_mktsegment, c_name FROM customer)
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY c_nationkey
                                           ORDER BY thousands DESC, c_mktsegment, c_name) = 1"""

ORACLE["sample_negatives"] = f"""WITH {_PAIRS},
neg AS (SELECT *, row_number() OVER (ORDER BY md5('123|' || CAST(query_id AS VARCHAR) || '|'
                                                  || CAST(cand_id AS VARCHAR)), query_id, cand_id)
               AS rn FROM pairs WHERE y = -1)
SELECT query_id, cand_id, round(cs, 6) AS cosine_similarity, y AS label FROM neg
WHERE rn <= (SELECT count(*) FROM pairs WHERE y = 1)"""

_VALID_TRUTH = f"""a AS ({ARTICULATION_VIEW_SQL}),
v AS (SELECT * FROM a WHERE EQUIV_EXISTS = 'Y' AND EQUI_TITLE <> 'NOT ACCEPTED IN TRANSFER'
        AND regexp_full_match(EQUIV_CRSE, '[0-9]+') AND EQUIV_CRSE NOT IN ('000', '0000')
        AND TERM >= 199700),
r AS (SELECT TRNS_DESCRIPTION, TR_COURSE, TR_SUBJ || ' ' || TR_COURSE AS ext_code,
             EQUIV_SUBJECT || ' ' || EQUIV_CRSE AS int_code,
             row_number() OVER (PARTITION BY TRNS_DESCRIPTION, floor(TERM / 100),
                                TR_SUBJ || ' ' || TR_COURSE
                                ORDER BY l_orderkey, l_linenumber, CAST(EQUIV_CRSE AS INTEGER))
               AS rn
      FROM v),
t AS (SELECT * FROM r WHERE rn = 1),
ext AS ({EXTERNAL_CATALOGUE_SQL}),
intl AS ({INTERNAL_CATALOGUE_SQL})"""

ORACLE["positive_pairs"] = f"""WITH {_VALID_TRUTH}
SELECT lower(ext."COURSE CODE" || ', ' || ext."COURSE TITLE" || ', ' || ext."DESCRIPTION")
         AS text_1,
       lower(intl."COURSE CODE" || ', ' || intl."COURSE TITLE" || ', ' || intl."DESCRIPTION")
         AS text_2,
       1 AS label
FROM t JOIN ext ON t.TR_COURSE = ext.number AND t.ext_code = ext."COURSE CODE"
       JOIN intl ON t.int_code = intl."COURSE CODE"
WHERE ext."COURSE TITLE" IS NOT NULL AND ext."DESCRIPTION" IS NOT NULL
  AND intl."COURSE TITLE" IS NOT NULL AND intl."DESCRIPTION" IS NOT NULL"""

ORACLE["hard_negatives"] = f"""WITH {_PAIRS},
pos AS (SELECT query_id, cand_id FROM pairs WHERE y = 1),
neg AS (SELECT r.* FROM ranked r ANTI JOIN pos USING (query_id, cand_id)),
best AS (SELECT query_id, min(rank) AS mr FROM neg GROUP BY 1)
SELECT n.query_id, n.cand_id, round(n.score, 6) AS score
FROM neg n JOIN best b ON b.query_id = n.query_id AND b.mr = n.rank"""

ORACLE["project_pairs"] = f"""WITH {_PAIRS},
pv AS (SELECT p.query_id, p.cand_id, p.cs, a.v AS va, b.v AS vb
       FROM pairs p JOIN e a ON a.vec_id = p.query_id JOIN e b ON b.vec_id = p.cand_id),
f AS (SELECT *, {_folded(16, "va")} AS fa, {_folded(16, "vb")} AS fb FROM pv)
SELECT query_id, cand_id, round(cs, 6) AS cosine_similarity,
       round(greatest(least(list_cosine_similarity(fa, fb), 1.0), -1.0), 6)
         AS cosine_similarity_custom
FROM f"""

ORACLE["pair_predictions"] = f"""WITH {_PAIRS}
SELECT query_id, cand_id, y AS label, round(1.0 / (1.0 + exp(-cs)), 6) AS sigmoid_score,
       CASE WHEN cs > 0.3 THEN 1 ELSE -1 END AS pred_strict,
       CASE WHEN cs >= 0.5 THEN 1 ELSE -1 END AS pred_ge,
       CASE WHEN y = -1 THEN 0 ELSE 1 END AS label01
FROM pairs"""

ORACLE["name_scalars"] = """WITH c AS (
  SELECT *, c_mktsegment || ' ' || c_name || ' (PCC)' AS nm FROM customer)
SELECT c_custkey,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'AUTO' WHEN 'MACHINERY' THEN 'MACH'
            ELSE c_mktsegment END AS segment,
       replace(replace(nm, ' (PCC)', ''), ' ', '-') AS canonical,
       replace(replace(nm, ' ', '-'), '-', ' ') AS round_trip,
       upper(lower(c_name)) AS upper_name
FROM c"""

ORACLE["url_parts"] = """SELECT page_id, string_split(url, '/')[3] AS host,
       string_split(url, '/')[4] AS lang, string_split(url, '/')[-1] AS last
FROM pages"""

ORACLE["catalog_years"] = """SELECT DISTINCT CAST(year(o_orderdate) - 1 AS VARCHAR) || '-'
       || CAST(year(o_orderdate) AS VARCHAR) AS years FROM orders"""

ORACLE["accuracy_by_dataset"] = f"""WITH {_PAIRS},
r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('123|' || CAST(query_id AS VARCHAR)
                                   || '|' || CAST(cand_id AS VARCHAR)), query_id, cand_id) AS rn,
             count(*) OVER (PARTITION BY y) AS ny FROM pairs),
d AS (SELECT cs, y, CASE WHEN rn <= round(ny * 0.2) THEN 'test' ELSE 'train' END AS dataset
      FROM r),
t AS (SELECT CAST(i AS DOUBLE) / 1000 AS th FROM range(-1000, 1000) r(i)),
acc AS (SELECT dataset, th, avg(CASE WHEN (cs > th AND y = 1) OR (NOT (cs > th) AND y = -1)
                                     THEN 1.0 ELSE 0.0 END) AS a
        FROM t, d GROUP BY dataset, th),
best AS (SELECT dataset, max(a) AS a FROM acc GROUP BY dataset),
n AS (SELECT dataset, count(*) AS n FROM d GROUP BY dataset)
SELECT best.dataset, round(a, 6) AS accuracy, CAST(n AS BIGINT) AS n,
       round(1.96 * sqrt(a * (1 - a) / n), 6) AS ci95
FROM best JOIN n USING (dataset)"""

ORACLE["model_delta"] = f"""WITH {_PAIRS},
pv AS (SELECT p.cs, p.y, a.v AS va, b.v AS vb
       FROM pairs p JOIN e a ON a.vec_id = p.query_id JOIN e b ON b.vec_id = p.cand_id),
f AS (SELECT cs, y,
             greatest(least(list_cosine_similarity({_folded(16, "va")}, {_folded(16, "vb")}),
               1.0), -1.0) AS cc FROM pv),
m AS (SELECT count(*) AS n,
             count(*) FILTER (WHERE cs >= 0.5 AND y = 1) AS tp0,
             count(*) FILTER (WHERE cs >= 0.5 AND y <> 1) AS fp0,
             count(*) FILTER (WHERE NOT (cs >= 0.5) AND y = 1) AS fn0,
             count(*) FILTER (WHERE NOT (cs >= 0.5) AND y <> 1) AS tn0,
             count(*) FILTER (WHERE cc >= 0.5 AND y = 1) AS tp1,
             count(*) FILTER (WHERE cc >= 0.5 AND y <> 1) AS fp1,
             count(*) FILTER (WHERE NOT (cc >= 0.5) AND y = 1) AS fn1,
             count(*) FILTER (WHERE NOT (cc >= 0.5) AND y <> 1) AS tn1 FROM f),
r AS (SELECT (tp0 + tn0) * 1.0 / n AS a0, (tp1 + tn1) * 1.0 / n AS a1,
             CASE WHEN tp0 + fp0 = 0 THEN 0.0 ELSE tp0 * 1.0 / (tp0 + fp0) END AS p0,
             CASE WHEN tp1 + fp1 = 0 THEN 0.0 ELSE tp1 * 1.0 / (tp1 + fp1) END AS p1,
             CASE WHEN tp0 + fn0 = 0 THEN 0.0 ELSE tp0 * 1.0 / (tp0 + fn0) END AS r0,
             CASE WHEN tp1 + fn1 = 0 THEN 0.0 ELSE tp1 * 1.0 / (tp1 + fn1) END AS r1 FROM m)
SELECT round(a1 - a0, 6) AS accuracy_delta, round(p1 - p0, 6) AS precision_delta,
       round(r1 - r0, 6) AS recall_delta,
       round(CASE WHEN p1 + r1 = 0 THEN 0.0 ELSE 2 * p1 * r1 / (p1 + r1) END
             - CASE WHEN p0 + r0 = 0 THEN 0.0 ELSE 2 * p0 * r0 / (p0 + r0) END, 6) AS f1_delta
FROM r"""

ORACLE["text_filters"] = """SELECT lang, source, count(*) AS n_docs,
       count(*) FILTER (WHERE contains(text, 'http')) AS n_with_link,
       count(*) FILTER (WHERE regexp_matches(text, '[0-9]{3}-[0-9]{4}')) AS n_with_number
FROM documents WHERE text IS NOT NULL AND length(text) > 47
GROUP BY lang, source"""

ORACLE["inspection_sample"] = """SELECT doc_id, lang, n_chars FROM documents
ORDER BY md5('123|' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 50"""


# Random negatives: texts in md5 order, pairs numbered by distance and first index.
ORACLE["random_negatives"] = f"""WITH p AS ({ORACLE["positive_pairs"]}),
texts AS (SELECT text, row_number() OVER (ORDER BY md5('123|' || text), text) - 1 AS idx
          FROM (SELECT text_1 AS text FROM p UNION SELECT text_2 FROM p)),
t AS (SELECT count(*) AS t FROM texts),
excl AS (SELECT DISTINCT least(text_1, text_2) AS a, greatest(text_1, text_2) AS b FROM p),
n AS (SELECT count(*) AS n FROM p),
drawn AS (SELECT num, num % t AS i, (num % t + num // t + 1) % t AS j
          FROM t, n, (SELECT count(*) FILTER (a < b) AS e FROM excl),
               unnest(range(least(t * (t - 1) // 2, n + e))) u(num)),
neg AS (SELECT num, least(x.text, y.text) AS a, greatest(x.text, y.text) AS b
        FROM drawn JOIN texts x ON x.idx = i JOIN texts y ON y.idx = j),
kept AS (SELECT neg.*, row_number() OVER (ORDER BY num) AS r FROM neg ANTI JOIN excl USING (a, b))
SELECT a AS text_1, b AS text_2, CAST(-1 AS INTEGER) AS label FROM kept, n WHERE r <= n"""


def _hashed(source: str, name: str) -> str:
    """name(text, v): whole-count hashing vectors of source(text), 64 wide."""
    return f"""{name}_t AS (SELECT DISTINCT text FROM {source} WHERE text IS NOT NULL),
{name}_k AS (SELECT text, md5('0|' || tok) AS h
             FROM (SELECT text, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS tok FROM {name}_t)),
{name}_c AS (SELECT text, CAST(('0x' || substr(h, 1, 15)) AS BIGINT) % 64 AS d,
                    sum(CASE WHEN right(h, 1) >= '8' THEN 1.0 ELSE -1.0 END) AS x FROM {name}_k GROUP BY ALL),
{name} AS (SELECT text, list(coalesce(x, 0.0) ORDER BY d) AS v
           FROM (SELECT text, unnest(range(64)) AS d FROM (SELECT DISTINCT text FROM {name}_c))
           LEFT JOIN {name}_c USING (text, d) GROUP BY text)"""


ORACLE["embed_documents"] = f"""WITH docs AS (SELECT doc_id, text FROM documents),
{_hashed("docs", "h")},
z AS (SELECT text, list_transform(range(64), lambda i: 0.0) AS v FROM docs
      WHERE text <> '' AND text NOT IN (SELECT text FROM h)),
vec AS (SELECT * FROM h UNION ALL SELECT DISTINCT * FROM z)
SELECT doc_id, CAST(len(v) AS INTEGER) AS dims,
       round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 4) AS norm,
       CAST(list_position(v, list_max(v)) AS INTEGER) AS top_dim
FROM docs LEFT JOIN vec USING (text)"""

ORACLE["rejected_negatives"] = f"""WITH a AS ({ARTICULATION_VIEW_SQL}),
ext AS ({EXTERNAL_CATALOGUE_SQL}),
intl AS ({INTERNAL_CATALOGUE_SQL}),
rows AS (SELECT l_orderkey, l_linenumber,
                lower("COURSE CODE" || ', ' || "COURSE TITLE" || ', ' || "DESCRIPTION") AS text
         FROM a JOIN ext ON a.TR_COURSE = ext.number
         WHERE EQUIV_EXISTS = 'Y' AND EQUI_TITLE = 'NOT ACCEPTED IN TRANSFER'
           AND regexp_full_match(EQUIV_CRSE, '[0-9]+') AND TERM >= 199700),
home AS (SELECT "COURSE CODE" AS code,
                lower("COURSE CODE" || ', ' || "COURSE TITLE" || ', ' || "DESCRIPTION") AS text FROM intl),
{_hashed("rows", "q")},
{_hashed("home", "c")},
scored AS (SELECT q.text AS text_1, home.code, home.text AS text_2,
                  round(list_cosine_similarity(q.v, c.v), 12) AS score
           FROM q, home JOIN c ON c.text = home.text),
best AS (SELECT *, row_number() OVER (PARTITION BY text_1 ORDER BY score DESC, code) AS rn FROM scored)
SELECT l_orderkey, l_linenumber, rows.text AS text_1, text_2, round(score, 6) AS score,
       CAST(-1 AS INTEGER) AS label
FROM rows JOIN best ON best.text_1 = rows.text AND rn = 1"""


def _rake(source: str) -> str:
    """rake(id, keywords) of source(id, text): phrases between stop words and
    punctuation, scored by the sum of degree / frequency of their words."""
    stops = ", ".join(f"'{w}'" for w in STOPWORDS)
    word = "[\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+"
    return f"""toks AS (SELECT id, i AS pos, t[i] AS tok FROM
      (SELECT id, regexp_extract_all(lower(text), '{word}|[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}\\s]+') AS t FROM {source}),
      unnest(range(1, len(t) + 1)) u(i)),
marked AS (SELECT *, CASE WHEN tok IN ({stops}) OR NOT regexp_full_match(tok, '{word}') THEN 1 ELSE 0 END AS brk
           FROM toks),
numbered AS (SELECT *, sum(brk) OVER (PARTITION BY id ORDER BY pos) AS phrase FROM marked),
words AS (SELECT id, phrase, pos, tok, count(*) OVER (PARTITION BY id, phrase) AS size
          FROM numbered WHERE brk = 0),
scored AS (SELECT *, sum(size) OVER w / count(*) OVER w AS ws FROM words WINDOW w AS (PARTITION BY id, tok)),
phrases AS (SELECT id, phrase, list_reduce(list(CAST(ws AS DOUBLE) ORDER BY pos), lambda x, y: x + y) AS score,
                   string_agg(tok, ' ' ORDER BY pos) AS said FROM scored GROUP BY id, phrase),
joined AS (SELECT id, string_agg(said, ' ' ORDER BY score DESC, said DESC) AS keywords FROM phrases GROUP BY id),
rake AS (SELECT id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(keywords, '') END AS keywords
         FROM {source} LEFT JOIN joined USING (id))"""


ORACLE["rake_keywords"] = f"""WITH src AS (SELECT doc_id AS id, text FROM documents),
{_rake("src")}
SELECT id AS doc_id, keywords FROM rake"""

ORACLE["keyword_texts"] = f"""WITH src AS (SELECT DISTINCT md5(text) AS id, text FROM documents WHERE length(text) > 47),
{_rake("src")}
SELECT doc_id, lower(regexp_replace(lower(source || ' ' || CAST(doc_id AS VARCHAR) || ', ' || lang || ', ' || keywords),
                                    '[*+]', '', 'g')) AS text
FROM documents JOIN rake ON rake.id = md5(text)
WHERE length(text) > 47 AND lang IS NOT NULL"""

ORACLE["sql_rake"] = ORACLE["rake_keywords"]

ORACLE["sql_projection"] = """SELECT vec_id, label, CAST(32 AS INTEGER) AS dims,
       round(CAST(embedding[1] AS DOUBLE) + CAST(embedding[33] AS DOUBLE), 6) AS first,
       round(CAST(embedding[32] AS DOUBLE) + CAST(embedding[64] AS DOUBLE), 6) AS last FROM embeddings"""

ORACLE["project_tiles"] = """SELECT vec_id, label, CAST(32 AS INTEGER) AS dims,
       round(CAST(embedding[1] AS DOUBLE) + CAST(embedding[33] AS DOUBLE), 6) AS first,
       round(CAST(embedding[32] AS DOUBLE) + CAST(embedding[64] AS DOUBLE), 6) AS last,
       round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings"""

ORACLE["sql_topk"] = f"""WITH {_E},
{_ranked("ranked")}
SELECT query_id, cand_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10"""

ORACLE["pivot_topk"] = ORACLE["sql_topk"]

ORACLE["signature_recall"] = """SELECT sum(least(10, n - 1)) :: BIGINT AS pairs, TRUE AS enough
FROM (SELECT count(*) OVER () AS n FROM embeddings WHERE embedding IS NOT NULL)"""

ORACLE["row_filters"] = """SELECT source AS name, count(*) AS n FROM documents
WHERE source IN ('src0', 'src1', 'src2') AND contains(text, 'the') AND regexp_matches(text, '[0-9]{2}')
GROUP BY source
UNION ALL
SELECT upper(p_brand), count(*) FROM part WHERE p_size BETWEEN 3 AND 40 AND p_brand IS NOT NULL GROUP BY 1"""

ORACLE["nearest_one"] = f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings
                                       WHERE label <> 0),
{_ranked("ranked")}
SELECT query_id, cand_id, round(score, 6) AS score FROM ranked WHERE rank = 1"""

_DOC_TRUTH = "SELECT doc_id AS row_id, n_chars % 12 AS truth_code FROM documents"
_FOUND = "q.row_id IN (SELECT vec_id FROM e)"
_OUTCOME_COLUMNS = """SELECT row_id, CAST(truth_code AS INTEGER) AS truth_code, OSU_Course_Code, row_number, match,
       similar_courses_row_number, round(similarity_score, 6) AS similarity_score, reason FROM outcomes"""

ORACLE["outcome_reasons"] = f"""WITH {_E},
{_ranked("ranked", where="a.vec_id IN (SELECT doc_id FROM documents)")},
{_match(_DOC_TRUTH, "ranked", 10, searched=_FOUND)}
{_OUTCOME_COLUMNS}"""

ORACLE["fused_outcomes"] = f"""WITH {_E},
{_fold_cte("e2", 32)},
{_ranked("r1", where="a.vec_id IN (SELECT doc_id FROM documents)")},
{_ranked("r2", "e2", where="a.vec_id IN (SELECT doc_id FROM documents) AND b.label <> 4")},
{_fuse("FULL OUTER JOIN", "0.7 * coalesce(a.score, 0.0) + 0.3 * coalesce(b.score, 0.0)")},
{_match(_DOC_TRUTH, _BY_QUERY, 10 ** 9, searched=_FOUND)}
{_OUTCOME_COLUMNS}"""

ORACLE["projected_hit_rate"] = _hit_rate(f"""e0 AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
{_fold_cte("e", 16, "e0")},
{_ranked("ranked")},
{_match(_SELF_TRUTH, "ranked", 20)}""")

ORACLE["available_outcomes"] = f"""WITH {_E},
{_ranked("ranked", where="a.vec_id <> b.vec_id AND b.label <> 3")},
{_match(_SELF_TRUTH, "ranked", 10)}
SELECT truth_code, match, reason, count(*) AS n FROM outcomes GROUP BY ALL"""

ORACLE["transfer_truth"] = """WITH t AS (
  SELECT replace(o_orderpriority, ' ', '-') AS Ext_Inst, year(o_orderdate) AS y,
         'C ' || CAST(o_custkey AS VARCHAR) AS code FROM orders),
names AS (SELECT unnest(['1-URGENT', '3-MEDIUM', '4-NOT-SPECIFIED', 'Nowhere-College']) AS Ext_Inst)
SELECT Ext_Inst, CAST(y - 1 AS VARCHAR) || '-' || CAST(y AS VARCHAR) AS Transfer_Year, count(*) AS n,
       count(DISTINCT code) AS n_codes
FROM t JOIN names USING (Ext_Inst) GROUP BY Ext_Inst, y
UNION ALL
SELECT Ext_Inst, NULL, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM names ANTI JOIN t USING (Ext_Inst)"""

ORACLE["best_by"] = """WITH r AS (
  SELECT c_mktsegment, o_orderkey, CAST(o_totalprice AS DOUBLE) AS total,
         row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderkey) AS rn
  FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT c_mktsegment, o_orderkey, round(total, 2) AS total FROM r WHERE rn = 1"""

ORACLE["store_round_trip"] = """SELECT 'C ' || CAST(vec_id AS VARCHAR) AS code,
       'I ' || CAST(label AS VARCHAR) AS institution, '2020-2021' AS years,
       CAST(len(embedding) AS INTEGER) AS dims,
       round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 4) AS norm
FROM embeddings"""

ORACLE["articulation_files"] = f"""WITH a AS ({ARTICULATION_VIEW_SQL})
SELECT TRNS_DESCRIPTION, CAST(CAST(floor(TERM / 100) AS INTEGER) AS VARCHAR) AS YEAR, count(*) AS n,
       min('00' || TR_COURSE) AS first_course, count(DISTINCT EQUI_TITLE) AS n_titles
FROM a GROUP BY 1, 2"""

ORACLE["catalog_records"] = """WITH d AS (
    SELECT coalesce(lang, 'none') AS institution, CAST(doc_id AS VARCHAR) AS code, source AS title, md5(text) AS digest,
           coalesce(n_chars % 16 = 5, false) AS fault FROM documents),
n AS (SELECT institution, count(*) FILTER (fault) AS n_rejected FROM d GROUP BY institution)
SELECT institution, code, title, digest, n_rejected FROM d JOIN n USING (institution) WHERE NOT fault"""

_SPLIT_PAIRS = f"""{_PAIRS},
pv AS (SELECT p.query_id, p.cand_id, p.cs, p.y, a.v AS va, b.v AS vb
       FROM pairs p JOIN e a ON a.vec_id = p.query_id JOIN e b ON b.vec_id = p.cand_id),
f AS (SELECT *, greatest(least(list_cosine_similarity({_folded(16, "va")}, {_folded(16, "vb")}), 1.0), -1.0) AS cc,
             row_number() OVER (PARTITION BY y ORDER BY md5('123|' || CAST(query_id AS VARCHAR) || '|'
                                || CAST(cand_id AS VARCHAR)), query_id, cand_id) AS rn,
             count(*) OVER (PARTITION BY y) AS ny FROM pv)"""

ORACLE["epoch_metrics"] = f"""WITH {_SPLIT_PAIRS},
d AS (SELECT cc, CASE WHEN y = 1 THEN 1.0 ELSE 0.0 END AS y,
             CASE WHEN rn <= round(ny * 0.2) THEN 'test'
                  WHEN rn - round(ny * 0.2) <= round((ny - round(ny * 0.2)) * 0.1) THEN 'validation'
                  ELSE 'train' END AS dataset FROM f),
h AS (SELECT dataset, cc, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM d GROUP BY ALL),
c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY dataset ORDER BY cc ROWS BETWEEN UNBOUNDED PRECEDING
                                        AND 1 PRECEDING), 0) AS below FROM h),
auc AS (SELECT dataset, sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc FROM c GROUP BY dataset),
m AS (SELECT dataset, avg(greatest(cc, 0) - cc * y + ln(1 + exp(-abs(cc)))) AS loss,
             avg(CASE WHEN (1 / (1 + exp(-cc)) > 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS accuracy
      FROM d GROUP BY dataset)
SELECT dataset, round(loss, 6) AS loss, round(accuracy, 6) AS accuracy, round(auc, 6) AS auc
FROM m JOIN auc USING (dataset)"""

_FIRST_EPOCH = f"""{_SPLIT_PAIRS},
t AS (SELECT va, vb, {_folded(16, "va")} AS u, {_folded(16, "vb")} AS v, cc, y,
             CASE WHEN rn <= round(ny * 0.2) THEN 'test'
                  WHEN rn - round(ny * 0.2) <= round((ny - round(ny * 0.2)) * 0.1) THEN 'validation'
                  ELSE 'train' END AS dataset, row_number() OVER () AS pair FROM f),
tr AS (SELECT *, sqrt(list_inner_product(u, u)) AS nu, sqrt(list_inner_product(v, v)) AS nv, 2 * (cc - y) AS dl
       FROM t WHERE dataset = 'train'),
gj AS (SELECT va, vb, j, dl * (v[j] / (nu * nv) - cc * u[j] / (nu * nu)) AS gu,
              dl * (u[j] / (nu * nv) - cc * v[j] / (nv * nv)) AS gv FROM tr, unnest(range(1, 17)) r(j)),
g AS (SELECT i, j, sum(va[i] * gu + vb[i] * gv) / (SELECT count(*) FROM tr) AS g
      FROM gj, unnest(range(1, 65)) q(i) GROUP BY i, j),
m1 AS (SELECT run_id, rate, i, j, CASE WHEN (i - 1) % 16 = j - 1 THEN 1.0 ELSE 0.0 END - rate * g AS w
       FROM g, (VALUES (0, 0.5 :: DOUBLE), (1, 5.0 :: DOUBLE)) x(run_id, rate))"""

ORACLE["grid_first_epoch"] = f"""WITH {_FIRST_EPOCH},
cols AS (SELECT run_id, rate, j, list(w ORDER BY i) AS col FROM m1 GROUP BY ALL),
p AS (SELECT run_id, rate, pair, any_value(dataset) AS dataset, any_value(y) AS y,
             sum(list_inner_product(va, col) * list_inner_product(vb, col))
               / (sqrt(sum(list_inner_product(va, col) ** 2)) * sqrt(sum(list_inner_product(vb, col) ** 2))) AS s
      FROM t, cols GROUP BY run_id, rate, pair),
h AS (SELECT run_id, dataset, s, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y <> 1) AS neg FROM p GROUP BY ALL),
c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY run_id, dataset ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING
                                        AND 1 PRECEDING), 0) AS below FROM h),
a AS (SELECT run_id, dataset, sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc FROM c GROUP BY ALL),
l AS (SELECT run_id, rate, dataset, CASE WHEN dataset = 'train' THEN (SELECT avg((cc - y) ** 2) FROM tr)
                                         ELSE avg((s - y) ** 2) END AS loss,
             avg(CASE WHEN (s > 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS accuracy FROM p GROUP BY run_id, rate, dataset),
b AS (SELECT run_id FROM l WHERE dataset = 'validation' ORDER BY accuracy DESC, run_id LIMIT 1)
SELECT run_id, dataset, rate AS learning_rate, round(loss, 6) AS loss, round(accuracy, 6) AS accuracy,
       round(auc, 6) AS auc, run_id = (SELECT run_id FROM b) AS chosen
FROM l JOIN a USING (run_id, dataset)"""

ORACLE["logged_matrices"] = f"""WITH {_FIRST_EPOCH}
SELECT 'rate ' || CASE run_id WHEN 0 THEN '0.5' ELSE '5.0' END AS run_id, CAST(1 AS INTEGER) AS epoch,
       CAST(i - 1 AS INTEGER) AS row_idx, round(sum(w) FILTER (j = 1), 6) AS first, round(sqrt(sum(w * w)), 6) AS norm
FROM m1 GROUP BY run_id, i"""

ORACLE["process_pairs"] = f"""WITH {_SPLIT_PAIRS},
d AS (SELECT CASE WHEN rn <= round(ny * 0.2) THEN 'test' ELSE 'train' END AS dataset, cc, y FROM f)
SELECT dataset, count(*) AS n,
       round(avg(CASE WHEN (cc > 0.4 AND y = 1) OR (cc <= 0.4 AND y = -1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM d GROUP BY dataset"""


ORACLE["run_files"] = f"""WITH {_SPLIT_PAIRS},
d AS (SELECT CASE WHEN rn <= round(ny * 0.2) THEN 'test' ELSE 'train' END AS dataset, cc, y FROM f)
SELECT run_id, dataset, count(*) AS n,
       round(avg(CASE WHEN (cc > t AND y = 1) OR (cc <= t AND y = -1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM d, (VALUES ('a', 0.5), ('b', 0.4)) x(run_id, t) GROUP BY run_id, dataset"""

def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
