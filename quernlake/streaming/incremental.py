"""Indexing of document streams: each micro-batch becomes a segment, and segments are merged on reading.

A segment's row groups follow those of the segments before it.  A batch that is run again overwrites its own segment
(its folder is named by the batch), so the sink is idempotent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from quernlake.operators.index import ADAPTIVE, BLOOM_ONLY, EXACT_MODE, Index, build_index
from quernlake.plans.config import Config
from quernlake.sources import store


def numbered(batch: DataFrame, column: str, rg_size: int) -> DataFrame:
    """(rg_id, doc_seq, json) of a batch; numbers follow the order of the texts' hashes, so a repeated run agrees."""
    rows = batch.select(F.col(column).alias("json")).where("json is not null")
    keyed = rows.withColumn("part", F.pmod(F.xxhash64("json"), F.lit(64)))
    counts = keyed.groupBy("part").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.xxhash64("json"), "json")) - 1 + F.col("before")
    out = keyed.join(F.broadcast(counts.select("part", "before")), "part").withColumn("doc_seq", place.cast("bigint"))
    return out.select(F.floor(F.col("doc_seq") / rg_size).cast("bigint").alias("rg_id"), "doc_seq", "json")


def index_stream(stream: DataFrame, column: str, folder: str, checkpoint: str, rg_size: int = 1000, config: Config | None = None) -> StreamingQuery:
    """Writes a segment for each micro-batch of a stream's JSON column; soft failure modes are advisable."""
    config = config or Config(parser_failure="soft", numeric_failure="soft")

    def sink(batch: DataFrame, batch_id: int) -> None:
        docs = numbered(batch, column, rg_size).cache()
        n = docs.count()
        if n:
            index = build_index(docs, -(-n // rg_size), config)
            store.write_index(index, f"{folder}/segment-{batch_id:012d}")
            index.discard()
        docs.unpersist()

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_index(spark: SparkSession, folder: str) -> Index:
    """One index over all segments: tables are unions with shifted row groups.  A path is as loose as in its loosest
    segment: without pruning by equality, adaptive (segment by segment), or exact."""
    names = sorted(p.rsplit("/", 1)[-1] for p in _segments(spark, folder))
    parts = [store.read_index(spark, f"{folder}/{n}", check=False) for n in names]
    if not parts:
        raise store.NoIndex(folder)
    config = parts[0].config
    if any(p.config != config for p in parts):
        raise store.FormatError("segments differ in their configuration")
    offsets, at = [], 0
    for p in parts:
        offsets.append(at)
        at += p.num_row_groups

    def provide(name: str, path: str | None) -> DataFrame:
        out = None
        for k, (p, offset) in enumerate(zip(parts, offsets)):
            df = p.table(name, path)
            if "rg_id" in df.columns:
                df = df.withColumn("rg_id", F.col("rg_id") + offset)
            if "segment" in df.columns:
                df = df.withColumn("segment", F.lit(k))
            out = df if out is None else out.unionByName(df)
        if name == "path_directory":
            out = out.groupBy("path").agg(
                F.bit_or("types").alias("types"), F.sum("cardinality").alias("cardinality"), F.min("len_min").alias("len_min"), F.max("len_max").alias("len_max"),
                F.min("imin").alias("imin"), F.max("imax").alias("imax"), F.min("dmin").alias("dmin"), F.max("dmax").alias("dmax"),
                F.when(F.max(F.col("mode") == BLOOM_ONLY), BLOOM_ONLY).when(F.max(F.col("mode") == ADAPTIVE), ADAPTIVE).otherwise(EXACT_MODE).alias("mode"),
                F.max("has_trigrams").alias("has_trigrams"), F.max(F.coalesce("numeric", F.lit(""))).alias("numeric"),
            ).withColumn("numeric", F.when(F.col("numeric") != "", F.col("numeric")))
        return out

    return Index(config, at, spark, provide, written=True)


def _segments(spark: SparkSession, folder: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [str(s.getPath()) for s in fs.listStatus(p) if s.isDirectory() and s.getPath().getName().startswith("segment-")] if fs.exists(p) else []
