"""Incremental matching of newly landed catalogue files.

``readStream`` over the catalogue landing folder (same layout as
``sources.catalogs.read_catalogs``), embed each micro-batch, rank it against
the static home catalogue with the blocked top-k operator, and write each
batch's matches under ``batch_id=<n>`` with overwrite, so a replayed batch
after a failure rewrites the same folder instead of duplicating rows.  Offsets
and progress live in the query's checkpoint location."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from simsift.functions import scalars as S
from simsift.operators import embed as E
from simsift.operators.topk import topk_similar
from simsift.plans.truth import with_row_id
from simsift.sources.catalogs import CATALOG_SCHEMA


def catalogue_stream(spark: SparkSession, landing: str, max_files: int = 1000) -> DataFrame:
    df = (spark.readStream.schema(CATALOG_SCHEMA).option("multiLine", True)
               .option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", True)
               .option("pathGlobFilter", "*.json").json(landing))
    fp = F.col("_metadata.file_path")
    return df.select(S.path_segment(fp, -2).alias("institution"),
                     F.regexp_extract(S.path_segment(fp, -1), r"^([0-9]+)", 1).alias("YEAR"),
                     *[F.col(f"`{c}`") for c in CATALOG_SCHEMA.fieldNames()])


def match_batches(stream: DataFrame, home: DataFrame, out_path: str, checkpoint: str,
                  k: int = 10, embedder: E.Embedder | None = None, *,
                  home_id: str = "COURSE CODE", home_vec: str = "embedding",
                  available_now: bool = True) -> StreamingQuery:
    """Start the query; ``home`` must already carry vectors in ``home_vec``."""

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        rows = (batch.withColumn("COURSE CODE", S.upper_code("COURSE CODE"))
                     .where(F.col("COURSE CODE").isNotNull()
                            & (F.col("COURSE CODE") != S.MISSING_CODE))
                     .withColumn("text", S.composite_text("COURSE CODE", "COURSE TITLE",
                                                          "DESCRIPTION")))
        # Equal rows keep ids of their own; the id is fixed by writing the rows.
        rows = with_row_id(rows)
        rows = E.embed_column(rows, "text", "embedding", embedder)
        top = topk_similar(rows, home, k, query_id="row_id", query_vec="embedding",
                           cand_id=home_id, cand_vec=home_vec)
        meta = rows.select(F.col("row_id").alias("query_id"), "institution", "YEAR",
                           F.col("COURSE CODE").alias("ext_code"))
        out = top.join(meta, "query_id").select(
            "institution", "YEAR", "ext_code", F.col("cand_id").alias("home_code"),
            "score", "rank", S.confidence_band("score").alias("confidence"))
        out.write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch_id={batch_id}")

    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
