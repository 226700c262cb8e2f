"""The folder that all machines share, for files that one job writes and another reads."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Only a session within one process, as in tests, may leave it unset: it
    gets a folder of our own. On a cluster that would be another disk for each machine, so there it is an error."""
    global _own
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="quillon-")
    return f"file://{_own}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
