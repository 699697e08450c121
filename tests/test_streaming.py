import json
import os
import tempfile

from pyspark.sql import functions as F

from simsift.operators import embed as E
from simsift.streaming.incremental import catalogue_stream, match_batches


def test_incremental_match(spark):
    base = tempfile.mkdtemp(prefix="stream-")
    landing = os.path.join(base, "landing", "PCC")
    os.makedirs(landing)
    with open(os.path.join(landing, "2023-2024.json"), "w") as f:
        json.dump([{"COURSE CODE": "mth 112", "COURSE TITLE": "Trigonometry",
                    "DESCRIPTION": "angles triangles trigonometry"},
                   {"COURSE CODE": "N/A", "COURSE TITLE": "skip", "DESCRIPTION": "x"}], f)
    home = spark.createDataFrame([("MTH 112", "trigonometry angles triangles"),
                                  ("BI 231", "human anatomy body")], "`COURSE CODE` string, text string")
    home = E.embed_column(home, "text", "embedding")
    q = match_batches(catalogue_stream(spark, os.path.join(base, "landing")), home,
                      os.path.join(base, "out"), os.path.join(base, "ckpt"), k=1)
    q.awaitTermination(120)
    out = spark.read.parquet(os.path.join(base, "out")).collect()
    assert [(r.institution, r.YEAR, r.ext_code, r.home_code, r["rank"]) for r in out] == [
        ("PCC", "2023", "MTH 112", "MTH 112", 1)]
