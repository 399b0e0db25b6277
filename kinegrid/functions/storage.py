"""Stored intermediate tables."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one of our own if all runs in this process, else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="kinegrid-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_last_release = 0.0
_stored: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def release_shuffles(spark: SparkSession, every: float = 1.0) -> None:
    """Has the driver collect garbage, once in `every` seconds at most."""
    global _last_release
    if time.monotonic() - _last_release >= every:
        _last_release = time.monotonic()
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it back: its lineage is cut and survives lost executors.

    Spark deletes the files of finished shuffles when the driver collects garbage, which is asked for here: otherwise a job
    of many stored steps would hold the shuffles of all of them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    release_shuffles(spark)
    out = spark.read.schema(df.schema).parquet(path)
    _stored[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of `materialise`; whatever is derived from them must be stored itself by then."""
    for table in tables:
        if path := _stored.pop(table, None):
            context = table.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
