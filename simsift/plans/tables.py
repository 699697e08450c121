"""Loading the driver's tables and the views that map them onto the course
matching data model (see README: "Mapping onto the test tables")."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simsift.functions import scalars as S

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as the vector store: id, vector, and the label that
    plays the role of the equivalent course code."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def articulation_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` in the shape of the equivalence table.

    institution = return flag, term = yyyymm of the ship date, external
    course = (``P``, part key) described by ``part``, home course = (``S``,
    supplier key) described by ``supplier``, accepted flag = line status ``F``
    -> ``Y``, rejection title on zero-tax lines."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.when(F.col("l_linestatus") == "F", F.lit("Y")).otherwise(F.lit("N")).alias("EQUIV_EXISTS"),
        F.col("l_returnflag").alias("TRNS_DESCRIPTION"),
        F.lit("P").alias("TR_SUBJ"),
        F.col("l_partkey").cast("string").alias("TR_COURSE"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("TR_TITLE"),
        (F.year("l_shipdate") * 100 + F.month("l_shipdate")).cast("int").alias("TERM"),
        F.lit("S").alias("EQUIV_SUBJECT"),
        F.col("l_suppkey").cast("string").alias("EQUIV_CRSE"),
        F.when(F.col("l_tax") == 0, F.lit(S.REJECTED_TITLE))
         .otherwise(F.concat(F.lit("qty "), F.col("l_quantity").cast("int").cast("string")))
         .alias("EQUI_TITLE"),
        F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_extendedprice"),
    )


ARTICULATION_VIEW_SQL = """
SELECT CASE WHEN l_linestatus = 'F' THEN 'Y' ELSE 'N' END AS EQUIV_EXISTS,
       l_returnflag AS TRNS_DESCRIPTION,
       'P' AS TR_SUBJ,
       CAST(l_partkey AS VARCHAR) AS TR_COURSE,
       'part ' || CAST(l_partkey AS VARCHAR) AS TR_TITLE,
       CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INTEGER) AS TERM,
       'S' AS EQUIV_SUBJECT,
       CAST(l_suppkey AS VARCHAR) AS EQUIV_CRSE,
       CASE WHEN l_tax = 0 THEN 'NOT ACCEPTED IN TRANSFER'
            ELSE 'qty ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS EQUI_TITLE,
       l_orderkey, l_linenumber, l_extendedprice
FROM lineitem
"""


def external_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as the external catalogue: code ``P <key>``, title, description."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").cast("string").alias("number"),
                    F.concat(F.lit("P "), F.col("p_partkey").cast("string")).alias("COURSE CODE"),
                    F.col("p_name").alias("COURSE TITLE"),
                    F.concat_ws(" ", "p_type", "p_brand").alias("DESCRIPTION"))


def internal_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``supplier`` as the home catalogue: code ``S <key>``, title, description."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.concat(F.lit("S "), F.col("s_suppkey").cast("string")).alias("COURSE CODE"),
                    F.col("s_name").alias("COURSE TITLE"),
                    F.concat(F.lit("nation "), F.col("s_nationkey").cast("string"))
                     .alias("DESCRIPTION"))


EXTERNAL_CATALOGUE_SQL = """
SELECT CAST(p_partkey AS VARCHAR) AS number, 'P ' || CAST(p_partkey AS VARCHAR) AS "COURSE CODE",
       p_name AS "COURSE TITLE", concat_ws(' ', p_type, p_brand) AS "DESCRIPTION"
FROM part
"""

INTERNAL_CATALOGUE_SQL = """
SELECT 'S ' || CAST(s_suppkey AS VARCHAR) AS "COURSE CODE", s_name AS "COURSE TITLE",
       'nation ' || CAST(s_nationkey AS VARCHAR) AS "DESCRIPTION"
FROM supplier
"""
