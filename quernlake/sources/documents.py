"""Document sources: a JSON column of Parquet files by their row groups, JSON lines, typed tables; listings and S3."""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernlake.operators.observe import observed

_FOOTER = "file string, column boolean, rows array<bigint>"
FILES = 64  # files whose footers a task reads
ROWS = 1 << 17  # rows of a row group that a task reads at most


def _opened(uri: str, options: dict[str, str]) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system of a Hadoop path, and the path in it; also in a task, which has no JVM to ask."""
    u = urlparse(uri)
    if u.scheme in ("s3", "s3a", "s3n"):
        endpoint = urlparse(options.get("fs.s3a.endpoint", ""))
        keys = {"access_key": options.get("fs.s3a.access.key"), "secret_key": options.get("fs.s3a.secret.key"), "region": options.get("fs.s3a.endpoint.region"), "endpoint_override": endpoint.netloc or endpoint.path or None, "scheme": endpoint.scheme or None}
        return pafs.S3FileSystem(**{k: v for k, v in keys.items() if v}), f"{u.netloc}/{u.path.lstrip('/')}"
    if u.scheme in ("", "file"):
        return pafs.LocalFileSystem(), unquote(u.path) if u.scheme else uri
    return pafs.FileSystem.from_uri(uri)


def _options(spark: SparkSession) -> dict[str, str]:
    """The S3 settings of the session, for tasks."""
    conf = spark._jsc.hadoopConfiguration()
    names = ("fs.s3a.endpoint", "fs.s3a.endpoint.region", "fs.s3a.access.key", "fs.s3a.secret.key")
    return {n: conf.get(n) for n in names if conf.get(n)}


def arrow_file(spark: SparkSession, file: str) -> tuple[pafs.FileSystem, str]:
    return _opened(file, _options(spark))


def _footers(column: str, options: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, there, rows = batch.column(0).to_pylist(), [], []
            for file in files:
                fs, path = _opened(file, options)
                with fs.open_input_file(path) as f:
                    meta = pq.read_metadata(f)
                there.append(column in meta.schema.to_arrow_schema().names)
                rows.append([meta.row_group(k).num_rows for k in range(meta.num_row_groups)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(there), pa.array(rows, pa.list_(pa.int64()))], names=["file", "column", "rows"])

    return run


def _groups(column: str, options: dict[str, str]):
    """The documents of row groups, or of a range of a large one's rows: each task reads the column's chunks of its own ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, k, rg, first, skip, take in zip(*(c.to_pylist() for c in batch.columns)):
                fs, path = _opened(file, options)
                with fs.open_input_file(path) as f:
                    for part in pq.ParquetFile(f).iter_batches(row_groups=[k], columns=[column], batch_size=8192):
                        if skip >= len(part):
                            skip -= len(part)
                            continue
                        part, skip = part.slice(skip, take), 0
                        take -= len(part)
                        text = part.column(0).cast(pa.string())
                        seq = pa.array(range(first, first + len(text)), pa.int64())
                        first += len(text)
                        some = pc.is_valid(text)
                        yield pa.RecordBatch.from_arrays([pa.array([rg] * len(text), pa.int64()), seq, text], names=["rg_id", "doc_seq", "json"]).filter(some)
                        if not take:
                            break

    return run


@observed("read_parquet")
def parquet_documents(spark: SparkSession, source: str | list[str], column: str) -> tuple[DataFrame, int]:
    """((rg_id, doc_seq, json) of the JSON column of Parquet files by their real row groups, the number of those).

    ``source``: a file, folder or glob of any Hadoop file system, or a list of files.  Files count in the order of
    their names; row groups and rows are numbered through.  Footers are read in tasks, and then the driver holds one
    entry a row group (or 2^17 rows of one, as a row group may hold all rows of a file); a task reads the column of those
    rows, so documents find theirs without a join.  Null cells are no documents, and row groups keep their own number even when all their cells are null.
    """
    files = sorted(dict.fromkeys(source if isinstance(source, list) else data_files(spark, source)))
    if not files:
        raise FileNotFoundError(str(source))
    options = _options(spark)
    listed = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, -(-len(files) // FILES)))
    found = sorted(tuple(r) for r in listed.mapInArrow(_footers(column, options), _FOOTER).collect())
    units, rg, at = [], 0, 0
    for file, there, rows in found:
        if not there:
            raise KeyError(f"{file} has no column {column!r}")
        for k, n in enumerate(rows):
            units += [(file, k, rg, at + skip, skip, min(ROWS, n - skip)) for skip in range(0, n, ROWS)]
            rg, at = rg + 1, at + n
    tasks = max(1, min(len(units), 100_000))
    groups = spark.createDataFrame(spark.sparkContext.parallelize(units, tasks), "file string, k int, rg bigint, first bigint, skip bigint, take bigint")
    return groups.mapInArrow(_groups(column, options), "rg_id bigint, doc_seq bigint, json string"), rg


def jsonl_documents(spark: SparkSession, path: str, rg_size: int, sample: int | None = None) -> DataFrame:
    """(rg_id, doc_seq, json) of JSON lines, ``rg_size`` to a synthetic row group; ``sample`` takes the first lines.

    Lines are numbered through in the order of the files' names and of their places there: those of each split of a file are
    counted, and each line adds its place in the split.  A carriage return at the end goes, a blank line is a
    document that fails to parse.
    """
    if rg_size <= 0:
        raise ValueError("rg_size must be positive")
    lines = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("json"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    counts = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))  # one row a split
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = lines.join(counts.select("file", "block", "first", "before"), ["file", "block"]).select("json", (F.col("before") + F.col("at") - F.col("first")).alias("doc_seq"))
    if sample is not None:
        numbered = numbered.where(F.col("doc_seq") < sample)
    return numbered.select(F.floor(F.col("doc_seq") / rg_size).cast("bigint").alias("rg_id"), "doc_seq", "json")


def accepted_positions(docs: DataFrame, rejected: DataFrame, rg_size: int) -> DataFrame:
    """Documents renumbered over the accepted ones only, so that a skipped one takes no place."""
    kept = docs.join(rejected.select("doc_seq").distinct(), "doc_seq", "left_anti")
    parts = kept.withColumn("part", F.floor(F.col("doc_seq") / 65536))
    counts = parts.groupBy("part").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("part").orderBy("doc_seq")) - 1 + F.col("before")
    return parts.join(counts.select("part", "before"), "part").withColumn("place", place).select(F.floor(F.col("place") / rg_size).cast("bigint").alias("rg_id"), F.col("place").cast("bigint").alias("doc_seq"), "json")


def table_documents(df: DataFrame, rg_id, doc_seq) -> DataFrame:
    """Rows of a typed table as JSON documents, nulls kept."""
    return df.select(rg_id.cast("bigint").alias("rg_id"), doc_seq.cast("bigint").alias("doc_seq"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def is_s3(path: str) -> bool:
    return path.startswith(("s3://", "s3a://"))


def parse_s3(path: str) -> tuple[str, str]:
    u = urlparse(path)
    if u.scheme not in ("s3", "s3a") or not u.netloc:
        raise ValueError(f"{path!r} is no S3 path")
    return u.netloc, u.path.lstrip("/")


def s3_options(env: dict[str, str] | None = None) -> dict[str, str]:
    """Hadoop options of the usual environment variables; set them with ``spark.hadoop.`` before."""
    env = os.environ if env is None else env
    out = {"fs.s3a.endpoint.region": env.get("AWS_REGION") or env.get("AWS_DEFAULT_REGION") or "us-east-1"}
    endpoint = env.get("AWS_ENDPOINT_URL") or env.get("AWS_S3_ENDPOINT")
    if endpoint:
        out |= {"fs.s3a.endpoint": endpoint, "fs.s3a.path.style.access": "true"}
    if env.get("AWS_ACCESS_KEY_ID"):
        out |= {"fs.s3a.access.key": env["AWS_ACCESS_KEY_ID"], "fs.s3a.secret.key": env.get("AWS_SECRET_ACCESS_KEY", "")}
    return out


def data_files(spark: SparkSession, source: str) -> list[str]:
    """The Parquet files of a path: itself, those in a folder (not below it), or those that a glob matches."""
    p = spark._jvm.org.apache.hadoop.fs.Path(source.replace("s3://", "s3a://"))
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for status in fs.globStatus(p) or []:
        inside = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
        out += [_name(s.getPath()) for s in inside if s.isFile() and (not status.isDirectory() or s.getPath().getName().endswith(".parquet"))]
    return sorted(out)


def _name(path) -> str:
    """A path as this library writes it: local ones without a scheme."""
    uri = path.toUri()
    return uri.getPath() if uri.getScheme() in (None, "file") else path.toString()


def list_files(spark: SparkSession, folder: str, suffix: str) -> list[str]:
    """Entries of a folder (not below it) with a suffix, by Hadoop's file systems, so local and S3 alike."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder.replace("s3://", "s3a://"))
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise FileNotFoundError(folder)
    return sorted(_name(s.getPath()) for s in fs.listStatus(p) if s.getPath().getName().endswith(suffix))


def list_parquet(spark: SparkSession, folder: str) -> list[str]:
    return list_files(spark, folder, ".parquet")


def list_indexes(spark: SparkSession, folder: str) -> list[str]:
    return list_files(spark, folder, ".idx")
