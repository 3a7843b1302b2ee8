"""A training corpus from ``documents``: quality, near duplicates, decontamination, mixing, sharding.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs.  The last adds slot, shard and version; the others return the columns
they were given, whatever their names.  An empty table passes all stages as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernlake.llm import fmindex, minhash, mixing, quality, sharding
from quernlake.llm.tables import discard, saved


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, and null and blank texts.  It is trained on labelled rows of the corpus as
    it came.  Rows with a null id and repeated rows are judged by their texts."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id, and one of rows that repeat id and
    text.  An id on several texts is as many documents.  Rows with a null id or text stay, and texts without words."""
    return minhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut from the texts; a document that was nothing else goes.  Null and empty texts stay, rows
    with a null id are cut too, repeated rows alike."""
    return fmindex.decontaminated(docs, fmindex.benchmark_of(spark, sf_dir))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A balanced sample, in which sources (null is one) have their target weights.  Rows with a null id go; rows that
    repeat an id stay or go together."""
    return mixing.mixed(docs)


def sharding_slots(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their slot and shard by the newest version of the stored map, edited for them.  Rows with a
    null id lie in slot 0; no row goes."""
    return sharding.placed(docs, sharding.map_path(docs, "pipeline"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources", source_mixing),
    ("sharding", sharding_slots),
]

#: Trained models, approximate search and sampling have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that all stages kept, with slot, shard and version.  What a stage wrote is deleted once the next one's rows
    are written; only the last one's, which the result reads, stays.  A row with a null id, a null text or another
    oddity has the result that its stages define; a document may come out with a shorter text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"stage-{k}")
            discard(before)
    return docs
