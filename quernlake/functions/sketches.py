"""Bloom filter, distinct-count sketches, front coding and composite document ids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernlake.functions.text import common_prefix, hash_columns, hash_pair


@dataclass(frozen=True)
class Bloom:
    """A Bloom filter over strings.  Its bits are set in the cluster; the driver holds them, a fixed number."""

    bits: int
    hashes: int
    on: frozenset[int]

    def may_contain(self, text: str) -> bool:
        return all(p in self.on for p in _positions(text, self.bits, self.hashes))

    @property
    def occupancy(self) -> float:
        return len(self.on) / self.bits


def _positions(text: str, bits: int, hashes: int) -> list[int]:
    a, b = hash_pair(text)
    wrap = lambda x: (x + (1 << 63)) % (1 << 64) - (1 << 63)
    return [wrap(a + k * b) % bits for k in range(hashes)]


def bloom_positions(column: Column, bits: int, hashes: int) -> Column:
    a, b = hash_columns(column)
    # sums wrap around; decimals would not
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda k: F.pmod(_wrapping_sum(a, b, k), F.lit(bits)))


def _wrapping_sum(a: Column, b: Column, k: Column) -> Column:
    """a + b * k modulo 2^64, by halves, none of which overflows."""
    half = F.lit(0xFFFFFFFF)
    low = a.bitwiseAND(half) + b.bitwiseAND(half) * k
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) * k + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high.bitwiseAND(half), 32).bitwiseOR(low.bitwiseAND(half))


def bits_on(values: DataFrame, column: str, bits: int, hashes: int) -> DataFrame:
    """(p) the bits that are set in the Bloom filter of a column's values."""
    return values.select(F.explode(bloom_positions(F.col(column), bits, hashes)).alias("p")).distinct()


def build_bloom(values: DataFrame, column: str, bits: int, hashes: int) -> Bloom:
    return Bloom(bits, hashes, frozenset(r[0] for r in bits_on(values, column, bits, hashes).collect()))


def distinct_sketch(column: str, precision: int = 12) -> Column:
    return F.hll_sketch_agg(column, precision)


def sketch_estimate(column: str) -> Column:
    return F.hll_sketch_estimate(column)


def sketch_union(column: str) -> Column:
    return F.hll_union_agg(column)


def front_coded(terms: DataFrame, by: str, term: str = "term", block: int = 16) -> DataFrame:
    """(by, block, position, prefix, suffix): sorted terms in blocks, each as the length it shares with the one before it
    in its block and the rest."""
    order = Window.partitionBy(by).orderBy(term)
    placed = terms.select(by, term).distinct().withColumn("n", F.row_number().over(order) - 1).withColumn("block", F.floor(F.col("n") / block)).withColumn("position", F.col("n") % block)
    before = F.lag(term).over(Window.partitionBy(by, "block").orderBy(term))
    shared = placed.withColumn("prefix", F.when(F.col("position") == 0, 0).otherwise(common_prefix(before, F.col(term))))
    return shared.select(by, "block", "position", "prefix", F.expr(f"substring({term}, prefix + 1)").alias("suffix"))


def front_decoded(coded: DataFrame, by: str) -> DataFrame:
    """(by, term) of :func:`front_coded`."""
    rows = coded.groupBy(by, "block").agg(F.sort_array(F.collect_list(F.struct("position", "prefix", "suffix"))).alias("rows"))
    step = lambda acc, r: F.concat(acc, F.array(F.concat(F.substring(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("")), F.lit(1), r["prefix"]), r["suffix"])))
    return rows.select(by, F.explode(F.aggregate("rows", F.array().cast("array<string>"), step)).alias("term"))


def encode_doc_id(file: Column, row_group: Column, per_file: int) -> Column:
    return file * max(1, per_file) + row_group


def decode_doc_id(doc_id: Column, per_file: int) -> tuple[Column, Column]:
    k = max(1, per_file)
    return F.floor(doc_id / k).cast("bigint"), doc_id % k
