"""Helpers shared by the operators of this subpackage: written intermediate tables and safe column names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; only where that is unset, as in
    tests on one machine, a folder of our own."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="quernlake-"))
    return _own[0]


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once as Parquet in the shared folder and reads it back: its lineage ends there, so a
    lost executor costs no recomputation, and later readers prune its columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what :func:`saved` wrote, once nothing reads it any more."""
    path = getattr(df, "_quern_path", None)
    if path:
        spark = df.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any Hadoop file system; none of what isn't there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(hadoop)] if fs.exists(hadoop) else []


def discarded(df: DataFrame, table: DataFrame) -> DataFrame:
    """``df``, which :func:`discard` takes for ``table``, that it is made of."""
    df._quern_path = table._quern_path
    return df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever extra columns came with it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def texts(docs: DataFrame, *others: str) -> DataFrame:
    """Just ``doc_id`` (as bigint), ``text`` and the columns named, whatever else the table carries."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *others)


def dropped_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows of which (doc_id, hash of the text) is in ``gone``, and with one row, the first, of those
    that repeat both.  ``docs`` must give its rows alike each time it is read, as a table does.  Repeats are found by an
    aggregation over ids and hashes; the rows themselves are shuffled once, with what is known of them."""
    names = [fresh(docs, c) for c in ("unit_id", "unit_key", "unit_row")]
    keyed = docs.withColumns({names[0]: F.col("doc_id").cast("bigint"), names[1]: F.xxhash64("text"), names[2]: F.monotonically_increasing_id()})
    units = keyed.where("doc_id is not null and text is not null").groupBy(*names[:2]).agg(F.count("*").alias("n"), F.min(names[2]).alias("stays"))
    marks = units.where("n > 1").select(*names[:2], "stays").union(gone.select("doc_id", "text_key", F.lit(-1).cast("bigint")))
    stays = fresh(keyed, "stays")
    marks = marks.groupBy(*names[:2]).agg(F.min("stays").alias(stays))
    return keyed.join(marks, names[:2], "left").where(F.col(stays).isNull() | (F.col(stays) == F.col(names[2]))).select(*docs.columns)
