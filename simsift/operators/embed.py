"""Text embedding with a reusable cache.

The embedder is a pluggable callable ``pandas.Series[str] -> list of vectors``
applied to Arrow batches; the default is a deterministic signed feature-hashing
embedder (no model download, no service).  The cache is a Parquet table keyed
by ``sha2(text, 256)`` and the embedder's id: only texts absent from it are
embedded, new vectors are appended, and results are read back from the written
table (which also cuts the lineage)."""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simsift.session import materialize, remove_path

Embedder = Callable[[pd.Series], list]
_TOKEN = re.compile(r"\w+", re.UNICODE)


def hashing_embedder(dim: int = 64, seed: int = 0, normalise: bool = True) -> Embedder:
    """Signed feature hashing of lower-cased word tokens, L2-normalised unless
    ``normalise`` is off (then whole counts).  Null or empty text -> None.

    A token's place is the first 15 hex digits of ``md5(seed|token)`` modulo
    ``dim``; its sign is positive when the last digit is 8 or more."""
    def place(token: str) -> tuple[int, float]:
        h = hashlib.md5(f"{seed}|{token}".encode()).hexdigest()
        return int(h[:15], 16) % dim, 1.0 if h[-1] >= "8" else -1.0

    def embed(texts: pd.Series) -> list:
        known: dict[str, tuple[int, float]] = {}       # of one chunk of texts
        out = []
        for t in texts:
            if not isinstance(t, str) or not t:
                out.append(None)
                continue
            v = np.zeros(dim, dtype=np.float64)
            for tok in _TOKEN.findall(t.lower()):
                at = known.get(tok)
                if at is None:
                    at = known[tok] = place(tok)
                v[at[0]] += at[1]
            n = np.linalg.norm(v) if normalise else 0
            out.append((v / n if n else v).astype(np.float32))
        return out
    embed.embedder_id = f"hashing-{dim}-{seed}-{int(normalise)}"
    return embed


def embedder_id(embedder: Embedder) -> str:
    """What the cache knows an embedder by: its ``embedder_id``, which must
    change with everything that changes its vectors (name, width, seed)."""
    found = getattr(embedder, "embedder_id", None)
    if not found:
        raise ValueError("an embedder used with a cache needs an embedder_id attribute")
    return str(found)


def embed_column(df: DataFrame, text_col: str, out_col: str = "embedding",
                 embedder: Embedder | None = None, batch_size: int = 16) -> DataFrame:
    """Add ``out_col`` (array<float>) computed by ``embedder`` on chunks of
    ``batch_size`` texts within each Arrow batch (null/empty text -> null)."""
    fn = embedder or hashing_embedder()

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _embed(texts: pd.Series) -> pd.Series:
        out = []
        for i in range(0, len(texts), max(1, batch_size)):
            chunk = texts.iloc[i:i + batch_size]
            ok = chunk.map(lambda t: isinstance(t, str) and len(t) > 0)
            vecs = iter(fn(chunk[ok]) if ok.any() else [])
            out.extend(next(vecs) if flag else None for flag in ok)
        return pd.Series(out, dtype=object)

    return df.withColumn(out_col, _embed(F.col(text_col)))


def text_key(col: str) -> F.Column:
    return F.sha2(F.col(col), 256)


_CACHE_SCHEMA = "key string, embedder string, text string, embedding array<float>"
_MANIFEST_SCHEMA = "batch string"


def _cache_batches(spark, cache_path: str) -> list[str]:
    """Committed batches of the cache: those its manifest lists (one short row
    for each call that found new texts)."""
    try:
        listed = spark.read.schema(_MANIFEST_SCHEMA).parquet(os.path.join(cache_path, "manifest"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(os.path.join(cache_path, f"batch={r.batch}") for r in listed.distinct().collect())


def read_cache(spark, cache_path: str) -> DataFrame:
    """The cache as of now.  Reads name the committed batch folders
    explicitly: two reads of different cache states are then different plans,
    so Spark can never reuse one read's exchange for the other (a plain re-read
    of the same root path could be served from a stale listing)."""
    dirs = _cache_batches(spark, cache_path)
    if not dirs:
        return spark.createDataFrame([], _CACHE_SCHEMA)
    return spark.read.schema(_CACHE_SCHEMA).parquet(*dirs)


def embed_with_cache(df: DataFrame, text_cols: list[str], cache_path: str,
                     embedder: Embedder | None = None, suffix: str = "_embedding") -> DataFrame:
    """Embed the distinct texts of ``text_cols`` once, through the cache, and
    join the vectors back as ``<col><suffix>`` columns.

    Layout: ``<cache_path>/batch=<id>/`` per call that found new texts, named in
    ``<cache_path>/manifest/`` once written; a batch that is not (an interrupted
    write) is ignored and its texts are embedded again next time."""
    spark = df.sparkSession
    fn = embedder or hashing_embedder()
    name = embedder_id(fn)
    df = materialize(df, "embed")                # read for the texts, and for the result
    texts = None
    for c in text_cols:
        t = df.select(F.col(c).alias("text")).where(F.col("text").isNotNull())
        texts = t if texts is None else texts.unionByName(t)
    texts = texts.distinct().withColumn("key", text_key("text"))
    own = read_cache(spark, cache_path).where(F.col("embedder") == name)
    missing = texts.join(own.select("key"), "key", "left_anti")
    computed = embed_column(missing, "text", "embedding", fn) \
        .select("key", F.lit(name).alias("embedder"), "text", "embedding")
    batch = uuid.uuid4().hex
    path = os.path.join(cache_path, f"batch={batch}")
    computed.write.mode("errorifexists").parquet(path)
    if spark.read.schema(_CACHE_SCHEMA).parquet(path).isEmpty():
        remove_path(path)                        # no new texts: nothing stays
    else:
        spark.createDataFrame([(batch,)], _MANIFEST_SCHEMA).coalesce(1) \
             .write.mode("append").parquet(os.path.join(cache_path, "manifest"))
    # Only the keys needed here; a duplicate key (two concurrent writers) is
    # collapsed.
    cache = (read_cache(spark, cache_path).where(F.col("embedder") == name)
             .join(texts.select("key"), "key", "left_semi")
             .groupBy("key").agg(F.first("embedding").alias("embedding")))
    out = df
    for c in text_cols:
        vec = cache.select(F.col("key").alias(f"_k_{c}"),
                           F.col("embedding").alias(f"{c}{suffix}"))
        out = out.withColumn(f"_k_{c}", text_key(c)).join(vec, f"_k_{c}", "left") \
                 .drop(f"_k_{c}")
    return out
