"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local_dir() -> str:
    """A local folder of this process, deleted at its end."""
    path = tempfile.mkdtemp(prefix="marlstone-")
    atexit.register(shutil.rmtree, path, True)
    return f"file://{path}"


def scratch_dir(spark: SparkSession) -> str:
    """A new folder's path below the shared folder that the cluster names in spark.checkpoint.dir.

    Only a local session, as in tests, may go without: it gets a folder of its
    own. On a cluster that would be another one on each machine: an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _local_dir()
    return f"{base.rstrip('/')}/marlstone-{uuid.uuid4().hex}"


#: Scratch tables that results not yet read may still need.
_LEFT: dict[str, SparkSession] = {}


def kept(spark: SparkSession, path: str) -> None:
    """Have ``path`` deleted when the process ends, if not before."""
    if not _LEFT:
        atexit.register(_sweep)
    _LEFT[path] = spark


def written(df: DataFrame, codec: str = "zstd") -> tuple[DataFrame, str]:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs no recomputation of what is
    before it. What isn't dropped is deleted when the process ends.
    """
    spark = df.sparkSession
    path = scratch_dir(spark)
    kept(spark, path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing will read again."""
    jvm = spark.sparkContext._jvm
    jsc = spark.sparkContext._jsc
    conf = jsc.hadoopConfiguration() if jsc is not None else jvm.org.apache.hadoop.conf.Configuration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
        _LEFT.pop(path, None)


def _sweep() -> None:
    for path, spark in list(_LEFT.items()):
        try:
            drop(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may be gone; nothing can be done at a process's end
            return
