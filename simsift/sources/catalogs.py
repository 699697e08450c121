"""Readers and writers for catalogues, equivalence tables, the embedding store,
the projection matrix and run metrics.

Every reader takes an explicit schema (no inference) and reads a whole
directory or glob in one scan; columns that the reference took from file
names come from ``_metadata.file_path``."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simsift.functions import scalars as S
from simsift.sources import records

CATALOG_SCHEMA = T.StructType([
    T.StructField("COURSE CODE", T.StringType()),
    T.StructField("COURSE TITLE", T.StringType()),
    T.StructField("DESCRIPTION", T.StringType()),
])

ARTICULATION_SCHEMA = T.StructType([
    T.StructField("EQUIV_EXISTS", T.StringType()),
    T.StructField("TRNS_DESCRIPTION", T.StringType()),
    T.StructField("TR_SUBJ", T.StringType()),
    T.StructField("TR_COURSE", T.StringType()),
    T.StructField("TR_TITLE", T.StringType()),
    T.StructField("TERM", T.IntegerType()),
    T.StructField("EQUIV_SUBJECT", T.StringType()),
    T.StructField("EQUIV_CRSE", T.StringType()),
    T.StructField("EQUI_TITLE", T.StringType()),
])

# Column headings of the home catalogue export.
INTERNAL_COLUMNS = {
    "Code": "COURSE CODE",
    "Catalog Title (long_title)": "COURSE TITLE",
    "Description (50 to 80 words is ideal) (description)": "DESCRIPTION",
}

TRANSFER_SCHEMA = T.StructType([
    T.StructField("Institution", T.StringType()),
    T.StructField("Transfer Term", T.IntegerType()),
    T.StructField("Transfer Subject", T.StringType()),
    T.StructField("Transfer Course", T.StringType()),
    T.StructField("OSU Course", T.StringType()),
])

STORE_SCHEMA = T.StructType([
    T.StructField("COURSE CODE", T.StringType()),
    T.StructField("COURSE TITLE", T.StringType()),
    T.StructField("DESCRIPTION", T.StringType()),
    T.StructField("CODE TITLE DESC", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("institution", T.StringType()),
    T.StructField("years", T.StringType()),
    T.StructField("variant", T.StringType()),
])


def read_catalogs(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue files ``<root>/<institution>/<yyyy-yyyy>.json`` (each a JSON
    array of course records) as one DataFrame with ``INSTITUTION`` (the
    folder) and ``YEAR`` (the start year of the file name) prepended."""
    df = (spark.read.schema(CATALOG_SCHEMA).option("multiLine", True)
               .option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
               .json(path))
    fp = F.col("_metadata.file_path")
    fname = S.path_segment(fp, -1)
    return df.select(
        S.path_segment(fp, -2).alias("INSTITUTION"),
        F.regexp_extract(fname, r"^([0-9]+)", 1).alias("YEAR"),
        *[F.col(f"`{c}`") for c in CATALOG_SCHEMA.fieldNames()])


def read_catalog_records(spark: SparkSession, path: str, glob: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """(rows of ``read_catalogs``, rejected records) with every file read by many tasks and
    faults kept apart, see ``records.read_records``."""
    rows, rejected = records.read_records(spark, path, CATALOG_SCHEMA, glob)
    fp = F.col("file_path")
    rows = rows.select(S.path_segment(fp, -2).alias("INSTITUTION"),
                       F.regexp_extract(S.path_segment(fp, -1), r"^([0-9]+)", 1).alias("YEAR"),
                       *[F.col(f"`{c}`") for c in CATALOG_SCHEMA.fieldNames()])
    return rows, rejected.withColumn("INSTITUTION", S.path_segment(fp, -2))


def read_articulations(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """Equivalence CSV; codes stay strings (leading zeros matter)."""
    return (spark.read.schema(ARTICULATION_SCHEMA).option("header", True)
                 .option("encoding", encoding).option("mode", "PERMISSIVE").csv(path))


def _read_any(spark: SparkSession, path: str, fmt: str, schema=None) -> DataFrame:
    r = spark.read
    if fmt == "csv":
        r = r.option("header", True)
        if schema is not None:
            r = r.schema(schema)
    return r.format(fmt).load(path)


def read_internal_catalog(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Home catalogue: code, title, description under the catalogue names."""
    df = _read_any(spark, path, fmt)
    return df.select(*[F.col(f"`{src}`").cast("string").alias(dst)
                       for src, dst in INTERNAL_COLUMNS.items()])


def read_transfers(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    df = _read_any(spark, path, fmt, TRANSFER_SCHEMA)
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name)
                       for f in TRANSFER_SCHEMA.fields])


def write_embeddings(df: DataFrame, root: str, mode: str = "overwrite") -> None:
    """Embedding store partitioned by institution / years / variant.  Only
    the partitions present in ``df`` are replaced."""
    (df.select(*STORE_SCHEMA.fieldNames()).write
       .option("partitionOverwriteMode", "dynamic")
       .partitionBy("institution", "years", "variant").mode(mode).parquet(root))


def read_embeddings(spark: SparkSession, root: str, institution: str | None = None,
                    years: str | None = None, variant: str | None = "plain",
                    ordinal: str | None = None) -> DataFrame:
    """Store rows for one (institution, years, variant); the filters prune
    partitions.  A missing store or partition gives an empty DataFrame.
    ``ordinal`` names an added column with each row's place in the files."""
    try:
        df = spark.read.schema(STORE_SCHEMA).parquet(root)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise                        # denied access, a bad root: not an empty store
        empty = spark.createDataFrame([], STORE_SCHEMA)
        return empty if ordinal is None else empty.withColumn(
            ordinal, F.lit(None).cast("struct<file_path:string,row_index:bigint>"))
    if ordinal is not None:
        df = df.withColumn(ordinal, F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index")))
    if institution is not None:
        df = df.where(F.col("institution") == institution)
    if years is not None:
        df = df.where(F.col("years") == years)
    if variant is not None:
        df = df.where(F.col("variant") == variant)
    return df


def list_catalog_years(store: DataFrame, institution: str | None = None) -> DataFrame:
    """Distinct ``years`` values, latest start year first."""
    df = store if institution is None else store.where(F.col("institution") == institution)
    return (df.select("years").distinct()
              .orderBy(S.start_year("years").desc_nulls_last(), F.col("years").desc()))


def save_matrix(df: DataFrame, path: str) -> None:
    df.select("row_idx", "weights").write.mode("overwrite").parquet(path)


def load_matrix(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("row_idx int, weights array<double>").parquet(path)


def write_run_metrics(df: DataFrame, path: str, fmt: str = "csv", run_id: str | None = None) -> None:
    """A run's metrics as CSV or Parquet.  With ``run_id`` they go to a folder of their own
    under ``path`` (``run_id=<id>``), so other runs' results stay; writing a run again replaces it."""
    to = path if run_id is None else f"{path.rstrip('/')}/run_id={run_id}"
    w = df.coalesce(1).write.mode("overwrite")
    (w.option("header", True).csv(to) if fmt == "csv" else w.parquet(to))


def read_run_metrics(spark: SparkSession, path: str, schema: str, fmt: str = "csv") -> DataFrame:
    """All runs' metrics under ``path`` with their ``run_id`` (a string)."""
    reader = spark.read.schema(f"{schema}, run_id string")
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.parquet(path)
