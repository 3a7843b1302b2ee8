"""Algebra of row-group sets, as DataFrames of distinct ``rg_id`` over a universe.  Rows of a typed table without a key are a row
group too, NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def universe(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("rg_id"))


def of(spark: SparkSession, ids: list[int], n: int) -> DataFrame:
    """The ids within 0 .. n - 1; others are ignored."""
    return spark.createDataFrame([(i,) for i in sorted(set(ids)) if 0 <= i < n], "rg_id bigint")


def everything(rgs: DataFrame) -> DataFrame:
    return rgs


def nothing(rgs: DataFrame) -> DataFrame:
    return rgs.limit(0)


def matched(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    return a.join(b.select(F.col("rg_id").alias("__rg")), F.col("rg_id").eqNullSafe(F.col("__rg")), how)


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return matched(a, b, "left_semi")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def invert(a: DataFrame, all_: DataFrame) -> DataFrame:
    return matched(all_, a, "left_anti")


def added(a: DataFrame, rg: int, all_: DataFrame) -> DataFrame:
    return union(a, all_.where(F.col("rg_id") == rg))


def removed(a: DataFrame, rg: int) -> DataFrame:
    return a.where(F.col("rg_id") != rg)


def has(a: DataFrame, rg: int) -> bool:
    return not a.where(F.col("rg_id") == rg).isEmpty()


def compact(a: DataFrame, by: list[str]) -> DataFrame:
    """One sorted array of row groups for each key."""
    return a.groupBy(*by).agg(F.array_sort(F.collect_set("rg_id")).alias("rgs"))


def to_list(a: DataFrame) -> list[int]:
    return [r[0] for r in a.select("rg_id").distinct().orderBy("rg_id").collect()]
