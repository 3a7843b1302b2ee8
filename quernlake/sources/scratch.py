"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where that is unset, as in tests on one machine, a folder of our own."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="quernlake-"))
    return _own[0]


def saved(df: DataFrame) -> DataFrame:
    """Writes ``df`` once and reads it back, so that its lineage ends there and readers prune its columns."""
    path = f"{shared_dir(df.sparkSession)}/scratch-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quern_scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what :func:`saved` wrote."""
    path = getattr(df, "_quern_scratch", None)
    if path:
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
