"""Tables written between jobs, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where the session names none (tests), a new one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-emberlog-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/emberlog/{uuid.uuid4().hex}/{name}"


def kept(df: DataFrame, path: str, codec: str = "snappy") -> DataFrame:
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and safe when executors go."""
    return kept(df, new_path(df.sparkSession, name), codec)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, whichever the shared folder is on."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """``keep(df, name)`` as ``written``, in a folder that goes at the end.

    What is returned from inside must not read these tables any more: its own result is ``written``.
    """
    path, number = new_path(spark, "scratch"), iter(range(1 << 30))
    try:
        yield lambda df, name, codec="snappy": kept(df, f"{path}/{next(number)}_{name}", codec)
    finally:
        removed(spark, path)
