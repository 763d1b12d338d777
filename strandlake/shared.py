"""The folder that the driver and all executors share, and the size of what Python tasks are given at once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


#: Schemes of Hadoop's connectors, and what Arrow calls the same stores.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def store_uri(path: str) -> str:
    """A path or address as Arrow's file systems name it."""
    scheme, sign, rest = path.partition("://")
    if not sign and path.startswith("file:/"):
        return "file://" + path[5:]
    return f"{SCHEMES.get(scheme, scheme)}{sign}{rest}"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Only a local session that has none gets a temporary folder; a cluster
    without the setting is an error.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="strandlake-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else has."""
    return f"{shared_dir(spark)}/strandlake/{name}-{uuid.uuid4().hex}"


def bounded_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Lowers the bytes of an Arrow batch to ``size`` where the session allows more: a row may hold a very long text or a block of vectors.

    The setting counts when a plan runs, so it stays; it changes no result.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name, "64m"))
    if not 0 < now <= size:
        spark.conf.set(name, str(size))
