"""A document pipeline of five operators of ``simsift.llm``.

Quality rules, near-duplicate removal, benchmark decontamination, pseudonyms for
personal data, and SentencePiece encoding and decoding.  Every stage works on all that the
stage before it kept; its result is written as Parquet (under the shared folder
of ``spark.checkpoint.dir``) and read again for the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simsift.llm import decontaminate, hostquality, neardup, pseudonyms, queries, unigram
from simsift.session import materialize, prepare


#: Documents on 5-word shingles are near copies from this similarity on; the 85 of
#: ``neardup.PERCENT`` binds op7 only.
NEAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the host-level quality rules keep."""
    prepare(spark)
    return hostquality.drop_low_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    prepare(spark)
    return neardup.drop_near_duplicates(docs, percent=NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    prepare(spark)
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return decontaminate.drop_contaminated(docs, benchmark)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data; ``n_chars`` follows the text."""
    prepare(spark)
    done = pseudonyms.pseudonymize(docs, queries.DEMO_KEY)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, n_byte_tokens, round_trip) of every document; for
    ``round_trip`` the ids are decoded and compared with the text."""
    prepare(spark)
    return unigram.encode(docs, unigram.read_model(spark, queries.PIECES), check=True)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("encoding", encoding),
]

#: SQL has no Viterbi search and no Feistel network; tests/llm compares run() with
#: a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
