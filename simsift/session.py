"""Session helpers: build a local session for tests/bench, and resolve the
shared checkpoint folder from the session instead of inventing one."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "simsift", extra: dict | None = None,
                  memory: str = "6g") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(256 * 1024 * 1024))
        .config("spark.driver.memory", memory)
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: dict[int, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Make ``simsift`` importable in Python workers (Arrow kernels).

    Zips the package once per driver process and registers it with
    ``addPyFile`` so executors receive it the same way ``--py-files`` would."""
    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="simsift-pkg-"), "simsift.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _dirs, files in os.walk(pkg_dir):
            if "__pycache__" in root:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(out)
    _SHIPPED[key] = out


#: Records of one Arrow batch.  Texts and pages are kilobytes each, so Spark's
#: default of 10,000 makes batches of tens of megabytes, held several times over
#: by every running task and its Python worker.
BATCH_RECORDS = 1_000
_RECORDS_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """What an application does once at its start: the checkpoint folder, the
    package on the executors, and Arrow batches of BATCH_RECORDS (a value that
    the user has set stays)."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    if spark.conf.get(_RECORDS_CONF, "10000") == "10000":
        spark.conf.set(_RECORDS_CONF, str(BATCH_RECORDS))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this must be a shared folder configured by the operator; we
    only pick a local scratch folder when nothing is configured (tests,
    single-machine runs)."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            # A machine-local folder is invisible to other executors.
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        configured = tempfile.mkdtemp(prefix="simsift-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


#: Folder of this process under ``tables``; everything ``materialize`` writes is in it.
RUN = f"run-{uuid.uuid4().hex}"


def scratch_table_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for materialised tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tables", RUN, name)


def materialize(df, label: str = "stage", partition_by: str | None = None):
    """Write ``df`` once as Parquet under the shared checkpoint folder and read
    it back: cuts the lineage, and unlike an unpersisted ``checkpoint()`` the
    upstream plan runs only once.  Survives executor loss (the table lives in
    the shared folder, not in executor storage).  ``release`` removes one table,
    ``scratch`` all tables that were written inside it."""
    spark = df.sparkSession
    path = scratch_table_path(spark, f"{label}-{uuid.uuid4().hex}")
    w = df.write.mode("overwrite")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    _WRITTEN.append(path)
    out = spark.read.parquet(path)
    out._scratch_path = path
    return out


_WRITTEN: list[str] = []


def remove_path(path: str) -> None:
    """Delete a written table; stores that pyarrow cannot reach keep it (their
    own lifetime rules apply)."""
    try:
        store, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:")
                                              else os.path.abspath(path))
        store.delete_dir(inner)
    except (FileNotFoundError, NotImplementedError, pa.ArrowInvalid, OSError):
        return


def release(table) -> None:
    """Remove the files of a DataFrame that ``materialize`` returned, once
    nothing reads it any more."""
    path = getattr(table, "_scratch_path", None)
    if path and path in _WRITTEN:
        _WRITTEN.remove(path)
        remove_path(path)


@contextmanager
def scratch():
    """Tables written inside are removed at the end: consume results (write,
    collect) before leaving."""
    before = len(_WRITTEN)
    try:
        yield
    finally:
        while len(_WRITTEN) > before:
            remove_path(_WRITTEN.pop())


@atexit.register
def _remove_all() -> None:
    """What is left when the driver ends."""
    while _WRITTEN:
        remove_path(_WRITTEN.pop())
