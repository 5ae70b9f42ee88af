"""Tables written once and read again, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders made inside go when it ends, so results must be written by then; without it they last as long as the JVM."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            drop_dir(spark, path)


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or the one set on the context; a temporary one only on a local master."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = sc._jsc.sc().getCheckpointDir()
        root = current.get() if current.isDefined() else None
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = getattr(sc, "_lexifix_root", None) or "file://" + tempfile.mkdtemp(prefix="lexifix-")
        sc._lexifix_root = root
    return root.rstrip("/")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder under the shared root, removed when the driver's JVM ends."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop_path)
    fs.deleteOnExit(hadoop_path)
    if _scopes:
        _scopes[-1].append(path)
    return path


def drop_dir(spark: SparkSession, path: str) -> None:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
