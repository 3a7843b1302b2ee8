"""Exact rows: pruned row groups first, then the residual filter on the surviving documents."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernlake.operators.evaluate import candidates
from quernlake.operators.index import Index
from quernlake.operators.shred import epoch_ms
from quernlake.plans.predicates import Aliased, Predicate, as_term, is_number
from quernlake.sources import scratch


def column_predicate(column: Column, kind: str, p: Predicate) -> Column:
    """A predicate on a typed column; NULL is an explicit null, which only IS NULL and IS NOT NULL accept
    (a column is always present)."""
    value = p.value
    numeric = kind not in ("string", "boolean")
    if kind == "date" or kind.startswith("timestamp"):
        column = epoch_ms(column, kind)
    if p.op == "IS NULL":
        return column.isNull()
    if p.op == "IS NOT NULL":
        return F.lit(True)
    if isinstance(value, Aliased):
        raise ValueError("companions aren't columns; filter on the transformed column")

    def comparable(v: Any) -> bool:
        return is_number(v) if numeric else as_term(v) is not None

    text = column.cast("string") if not numeric else column

    def lit(v: Any) -> Column:
        return F.lit(v) if numeric else F.lit(as_term(v))

    if p.op in ("=", "!="):
        same = text == lit(value) if comparable(value) else F.lit(False)
        return same if p.op == "=" else column.isNotNull() & ~F.coalesce(same, F.lit(False))
    if p.op in ("IN", "NOT IN"):
        values = [v for v in value if comparable(v)]
        inside = text.isin(*[v if numeric else as_term(v) for v in values]) if values else F.lit(False)
        return inside if p.op == "IN" else column.isNotNull() & ~F.coalesce(inside, F.lit(False))
    if p.op in (">", ">=", "<", "<="):
        if not numeric or not is_number(value):
            return F.lit(False)
        return {">": column > value, ">=": column >= value, "<": column < value, "<=": column <= value}[p.op]
    if numeric or not isinstance(value, str):
        return F.lit(False)
    if p.op == "CONTAINS":
        return F.contains(F.lower(text), F.lit(value.lower()))
    return text.rlike(value)


def filtered_rows(df: DataFrame, rg_id: Column, index: Index, predicates: list[Predicate], mode: str = "sound") -> DataFrame:
    """Rows of a typed table that satisfy all predicates.  Simple column predicates reach the scan.  The candidate row
    groups of a written index join by semi-join, broadcast when Spark finds them small; an index that isn't written would be
    made of the rows that the filter reads anyhow, so it is asked only where it decides (``compat``)."""
    kinds = dict(df.dtypes)
    out = df
    if index.written or mode == "compat":
        rgs = candidates(index, predicates, mode).select(F.col("rg_id").alias("__rg"))
        out = df.join(rgs, rg_id.cast("bigint").eqNullSafe(F.col("__rg")), "left_semi")
    for p in predicates:
        name = p.path[2:]
        out = out.where(column_predicate(F.col(f"`{name}`"), kinds[name], p))
    return out


def matching_documents(docs: DataFrame, index: Index, predicates: list[Predicate], mode: str = "sound") -> DataFrame:
    """Documents (rg_id, doc_seq, json) that satisfy all predicates, each by some value of its path.  An index that was made of
    the documents in this session has their values, so texts are parsed again only after a written one, and once;
    of the former, row groups are asked only where they decide (``compat``)."""
    from quernlake.operators import shred as shredding

    made = index.raw is not None
    kept = docs
    if not made or mode == "compat":
        kept = docs.join(candidates(index, predicates, mode), "rg_id", "left_semi")
    obs = index.provide("observations", None) if made else shredding.shred(kept, index.config, keep=scratch.saved).observations
    out = kept
    for p in predicates:
        hits = obs.where(observation_predicate(index, p)).select("doc_seq").distinct()
        out = out.join(hits, "doc_seq", "left_semi")
    return out.select(*docs.columns)


def observation_predicate(index: Index, p: Predicate) -> Column:
    value, path = p.value, p.path
    first = value[0] if isinstance(value, tuple) and value else value
    if isinstance(first, Aliased):
        path = index.representations[(p.path, first.alias)]
        value = tuple(v.value for v in value) if isinstance(value, tuple) else value.value
    at, kind = F.col("path") == path, F.col("kind")
    valued = kind.isin("string", "bool", "int", "float")

    def same(v: Any) -> Column:
        if as_term(v) is not None:
            return kind.isin("string", "bool") & (F.col("s") == as_term(v))
        if isinstance(v, int):
            return F.when(kind == "int", F.col("i") == v).otherwise(F.col("d") == float(v))
        return F.col("d") == v if is_number(v) else F.lit(False)

    def any_of(values: tuple) -> Column:
        out = F.lit(False)
        for v in values:
            out = out | F.coalesce(same(v), F.lit(False))
        return out

    tests = {
        "=": lambda: same(value),
        "!=": lambda: valued & ~F.coalesce(same(value), F.lit(False)),
        "IN": lambda: any_of(value),
        "NOT IN": lambda: valued & ~any_of(value),
        "IS NULL": lambda: kind == "null",
        "IS NOT NULL": lambda: F.lit(True),
        "CONTAINS": lambda: F.contains(F.lower("s"), F.lit(str(value).lower())),
        "REGEX": lambda: F.col("s").rlike(value),
        ">": lambda: F.col("d") > value, ">=": lambda: F.col("d") >= value, "<": lambda: F.col("d") < value, "<=": lambda: F.col("d") <= value,
    }
    return at & F.coalesce(tests[p.op](), F.lit(False))


def pruning(index: Index, predicates: list[Predicate], mode: str = "sound") -> DataFrame:
    """(total, matched, pruned, ratio) of a conjunction."""
    total = index.num_row_groups
    out = candidates(index, predicates, mode).agg(F.count("*").alias("matched"))
    return out.select(F.lit(total).cast("bigint").alias("total"), "matched", (F.lit(total) - F.col("matched")).alias("pruned"), ((F.lit(total) - F.col("matched")) / F.lit(float(total or 1))).alias("ratio"))
