"""JSON documents to typed path observations.

Raw JSON goes through one Arrow-batched pass (``shred``): number literals keep their exact kind, trailing garbage and
overflow are rejected, duplicate keys keep the last value; a variant column can't tell these apart.  Tables whose columns
are typed already never become JSON: ``observe_columns`` makes the same rows by built-in expressions.

An observation is (rg_id, doc_seq, path, kind, s, i, d): ``s`` holds strings and booleans (as true/false), ``i`` exact
integers, ``d`` any number as a double.  Objects, arrays and nulls have a row too, as their path is present.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernlake.functions import transformers
from quernlake.plans import jsonpath
from quernlake.plans.config import HARD, Config
from quernlake.plans.predicates import INT_MAX, INT_MIN

FIELDS = "rg_id bigint, doc_seq bigint, path string, kind string, s string, i bigint, d double"
_ARROW = pa.schema([("rg_id", pa.int64()), ("doc_seq", pa.int64()), ("path", pa.string()), ("kind", pa.string()), ("s", pa.string()), ("i", pa.int64()), ("d", pa.float64())])
PARSER, TRANSFORMER, NUMERIC = "parser", "transformer", "numeric"
_REJECT = "!"  # kinds !parser and !numeric carry a rejected document's reason in s
EXACT = 1 << 53


class IngestError(ValueError):
    """A document that can't be indexed: its layer, path and value."""

    def __init__(self, layer: str, path: str | None, value: str | None, cause: str):
        super().__init__(f"ingest {layer} failure" + (f" at {path}" if path else "") + f": {cause}")
        self.layer, self.path, self.value, self.cause = layer, path, value, cause


class _Number(str):
    """A number literal as it was written."""


class _Reject(Exception):
    def __init__(self, layer: str, path: str, value: str, cause: str):
        self.row = (layer, path, value, cause)


def _constant(name: str):
    raise ValueError(f"{name} isn't JSON")


_DECODER = json.JSONDecoder(parse_int=_Number, parse_float=_Number, parse_constant=_constant)


def classify(literal: str) -> tuple[str, int | None, float]:
    """(kind, integer, double) of a number literal: a float if it has a point or an exponent."""
    if not any(c in literal for c in ".eE"):
        value = int(literal)
        if not INT_MIN <= value <= INT_MAX:
            raise OverflowError("the integer exceeds 64 bits")
        return "int", value, float(value)
    d = float(literal)
    if not math.isfinite(d):
        raise OverflowError("the number isn't finite")
    return "float", None, d


def walk(value, path: str, out: list[tuple]) -> None:
    """Appends (path, kind, s, i, d) of a value and all below it.  Array elements stand under [position] and [*]."""
    if value is None:
        out.append((path, "null", None, None, None))
    elif isinstance(value, bool):
        out.append((path, "bool", "true" if value else "false", None, None))
    elif isinstance(value, _Number):
        try:
            out.append((path, *(lambda k, i, d: (k, None, i, d))(*classify(value))))
        except OverflowError as e:
            raise _Reject(NUMERIC, path, str(value), str(e)) from None
    elif isinstance(value, str):
        out.append((path, "string", value, None, None))
    elif isinstance(value, dict):
        out.append((path, "object", None, None, None))
        for key in sorted(value):
            child = f"{path}.{key}"
            walk(value[key], jsonpath.normalized(child) if "['" in child or '["' in child else child, out)
    else:
        out.append((path, "array", None, None, None))
        for k, x in enumerate(value):
            walk(x, f"{path}[{k}]", out)
            walk(x, f"{path}[*]", out)


def observe(text: str) -> list[tuple]:
    """Observations of one document; a rejected one has a single row."""
    out: list[tuple] = []
    try:
        body = text.strip(" \t\r\n")
        value, end = _DECODER.raw_decode(body)
        if end != len(body):
            raise ValueError("there is more after the document")
        walk(value, "$", out)
    except _Reject as r:
        layer, path, value, cause = r.row
        return [(path, _REJECT + layer, f"{value}\x00{cause}", None, None)]
    except (ValueError, RecursionError) as e:
        return [(None, _REJECT + PARSER, f"\x00{e}", None, None)]
    return out


def _shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for rg, seq, text in zip(*(c.to_pylist() for c in batch.columns)):
            if text is not None:
                rows += [(rg, seq, *o) for o in observe(text)]
            if len(rows) > 100_000:
                yield _batch(rows)
                rows = []
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


@dataclass
class Shredded:
    """Observations of the accepted documents, and (doc_seq, layer, path, value, message) of the others; ``all_``: the
    observations where it is known that no document is rejected; ``raw``: what the pass over the texts gave."""

    observations: DataFrame
    rejects: DataFrame
    skipped_representations: DataFrame
    all_: DataFrame
    raw: DataFrame


def epoch_ms(column: Column, kind: str) -> Column:
    """Milliseconds since 1970 of a date or timestamp column; one without a zone counts as UTC."""
    days = F.unix_date(column.cast("date")).cast("bigint") * 86400000
    if kind == "date":
        return days
    if kind == "timestamp":
        return F.unix_millis(column)
    return days + (F.hour(column) * 3600 + F.minute(column) * 60) * 1000 + F.floor(F.date_part(F.lit("SECOND"), column) * 1000)


def observe_columns(df: DataFrame, rg_id: Column, doc_seq: Column, columns: list[str] | None = None) -> DataFrame:
    """Observations of the columns of a typed table, path ``$.name``; SQL NULL is an explicit null.
    Timestamps and dates are observed as milliseconds since 1970, like the date transformers."""
    parts = []
    kinds = dict(df.dtypes)
    for c in columns if columns is not None else df.columns:
        col, kind = F.col(f"`{c}`"), kinds[c]
        s, i, d, name = F.lit(None).cast("string"), F.lit(None).cast("bigint"), F.lit(None).cast("double"), "string"
        if kind == "string":
            s = col
        elif kind == "boolean":
            s, name = col.cast("string"), "bool"
        elif kind in ("tinyint", "smallint", "int", "bigint"):
            i, d, name = col.cast("bigint"), col.cast("double"), "int"
        elif kind in ("float", "double") or kind.startswith("decimal"):
            d, name = col.cast("double"), "float"
        elif kind == "date" or kind.startswith("timestamp"):
            i, name = epoch_ms(col, kind), "int"
            d = i.cast("double")
        else:
            continue
        parts.append(F.struct(F.lit(f"$.{c}").alias("path"), F.when(col.isNull(), "null").otherwise(name).alias("kind"), s.alias("s"), i.alias("i"), d.alias("d")))
    if not parts:
        raise ValueError("no column can be observed")
    return df.select(rg_id.cast("bigint").alias("rg_id"), doc_seq.cast("bigint").alias("doc_seq"), F.inline(F.array(*parts)))


def companions(observations: DataFrame, config: Config) -> tuple[DataFrame | None, DataFrame | None]:
    """Observations of the companion representations, and (rg_id, doc_seq, path, alias, mode) where one failed."""
    if not config.representations:
        return None, None
    kind, s, d = (F.col(c) for c in ("kind", "s", "d"))
    made, failed = None, None
    for r in config.representations:
        source = observations.where(F.col("path") == r.path)
        value, out_kind = transformers.apply(r.transformer, r.params, kind, s, d)
        rows = source.withColumn("value", value)
        if out_kind == "number":
            # by value: a whole number is an integer
            whole = (F.col("value") == F.floor("value")) & (F.abs("value") < F.lit(2.0**63))
            rows2 = rows.select("rg_id", "doc_seq", F.lit(r.target).alias("path"), F.when(whole, "int").otherwise("float").alias("kind"), F.lit(None).cast("string").alias("s"), F.when(whole, F.col("value").cast("bigint")).alias("i"), F.col("value").cast("double").alias("d"))
        else:
            rows2 = rows.select("rg_id", "doc_seq", F.lit(r.target).alias("path"), F.lit("bool" if out_kind == "bool" else "string").alias("kind"), F.col("value").cast("string").alias("s"), F.lit(None).cast("bigint").alias("i"), F.lit(None).cast("double").alias("d"))
        keep = rows.where("value is null").select("rg_id", "doc_seq", F.lit(r.path).alias("path"), F.lit(r.alias).alias("alias"), F.lit(r.failure_mode).alias("mode"))
        rows2 = rows2.where("s is not null or d is not null")
        made = rows2 if made is None else made.unionByName(rows2)
        failed = keep if failed is None else failed.unionByName(keep)
    return made, failed


FLOAT, HUGE, BOTH = 1, 2, 3  # what a document has of a path: a float, an integer beyond 2^53, both


def _huge() -> Column:
    return (F.col("kind") == "int") & ((F.col("i") > EXACT) | (F.col("i") < -EXACT))


def _risky(good: DataFrame) -> DataFrame:
    """(path) of the paths that have floats and integers beyond 2^53; no others can make promotion reject a document."""
    numbers = good.where("kind in ('int', 'float')")
    return numbers.groupBy("path").agg(F.max(_huge()).alias("large"), F.max(F.col("kind") == "float").alias("floats")).where("large and floats").select("path")


def _promotions(good: DataFrame) -> DataFrame:
    """Documents that the ordered numeric promotion rejects.  A path's first number decides whether it holds integers
    only; a float later makes it mixed, unless an integer so far is beyond 2^53, and a mixed path takes no
    such integer.

    So of each path the first accepted document with either decides, and those with the other are rejected, as are those
    with both.  The first documents are aggregated path by path.  Only where one that decides is rejected for another
    path does the order of documents matter across paths: then, and then only, they are read in order.
    """
    numbers = good.where("kind in ('int', 'float')")
    huge = _huge()
    events = numbers.where((F.col("kind") == "float") | huge).join(_risky(good), "path", "left_semi")
    events = events.groupBy("path", "doc_seq").agg(F.bit_or(F.when(huge, HUGE).otherwise(FLOAT)).alias("has"))
    both = events.where(F.col("has") == BOTH)
    single = events.join(both.select("doc_seq"), "doc_seq", "left_anti")
    first = single.groupBy("path").agg(F.min("doc_seq").alias("doc_seq"), F.min_by("has", "doc_seq").alias("takes"))
    other = single.join(first.select("path", "takes"), "path").where(F.col("has") != F.col("takes"))
    # a document that decides and is rejected all the same
    tangled = first.join(other.select("doc_seq").distinct(), "doc_seq", "left_semi").select(F.lit(True).alias("tangled")).distinct()
    why = F.when(F.col("has") == FLOAT, "an integer beyond 2^53 stands in the way of a float").otherwise("the integer is beyond 2^53 on a path of floats")
    rejected = both.union(other.select(*both.columns)).select("doc_seq", "path", why.alias("message"))
    plain = rejected.withColumn("tangled", F.lit(True)).join(tangled, "tangled", "left_anti").drop("tangled")
    ordered = single.withColumn("tangled", F.lit(True)).join(tangled, "tangled", "left_semi").select("doc_seq", "path", "has")
    ordered = ordered.repartition(1).sortWithinPartitions("doc_seq", "path").mapInArrow(_in_order, "doc_seq bigint, path string, message string")
    late = ordered.union(both.withColumn("tangled", F.lit(True)).join(tangled, "tangled", "left_semi").select("doc_seq", "path", why.alias("message")))
    return plain.union(late).groupBy("doc_seq").agg(F.min(F.struct("path", "message")).alias("r")).select("doc_seq", "r.path", "r.message")


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads documents in order and remembers what each path takes; a rejected document decides nothing."""
    takes: dict[str, int] = {}
    doc: list[tuple[int, str, int]] = []

    def judge() -> tuple[int, str, str] | None:
        for seq, path, has in doc:
            if takes.get(path, has) != has:
                return seq, path, "an integer beyond 2^53 stands in the way of a float" if has == FLOAT else "the integer is beyond 2^53 on a path of floats"
        takes.update((path, has) for _, path, has in doc)
        return None

    for batch in itertools.chain(batches, [None]):
        out = []
        for row in zip(*(c.to_pylist() for c in batch.columns)) if batch is not None else [(None, "", 0)]:
            if doc and doc[0][0] != row[0]:
                out.append(judge())
                doc = []
            doc.append(row)
        rows = [r for r in out if r]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["doc_seq", "path", "message"])


def shred(docs: DataFrame, config: Config | None = None, parser=None, keep=None) -> Shredded:
    """Observations of ``docs`` (rg_id, doc_seq, json).  A null json is no document.

    Hard failure modes leave it to the caller to raise the first reject (:func:`raise_first`); soft ones drop the
    document.  ``parser`` may turn the json column into one of strict JSON first; ``keep`` may store what the one pass
    over the texts gives, which is read several times; then two looks at what is stored tell whether any document is rejected,
    and if none is, nothing is joined.
    """
    config = config or Config()
    rows = docs.select(F.col("rg_id").cast("bigint"), F.col("doc_seq").cast("bigint"), (parser(F.col("json")) if parser else F.col("json")).alias("json"))
    raw = rows.mapInArrow(_shred, FIELDS)
    raw = keep(raw) if keep else raw
    bad = raw.where(F.col("kind").startswith(_REJECT))
    parts = F.split("s", "\x00")
    rejects = bad.select("rg_id", "doc_seq", F.substring("kind", 2, 20).alias("layer"), "path", parts[0].alias("value"), parts[1].alias("message"))
    good = raw.where(~F.col("kind").startswith(_REJECT))
    made, failed = companions(good, config)
    none = rejects.where("false").select("rg_id", "doc_seq", "path", F.lit("").alias("alias"))
    if keep and failed is None and bad.isEmpty() and _risky(good).isEmpty():
        return Shredded(good, rejects, none, good, raw)
    skipped = none
    if failed is not None:
        hard = failed.where(F.col("mode") == HARD).select("rg_id", "doc_seq", F.lit(TRANSFORMER).alias("layer"), "path", F.lit(None).cast("string").alias("value"), F.concat(F.lit("the transformer of alias "), "alias", F.lit(" gave nothing")).alias("message"))
        rejects = rejects.unionByName(hard)
        skipped = failed.where(F.col("mode") != HARD).select("rg_id", "doc_seq", "path", "alias")
        good = good.unionByName(made)
    late = _promotions(good.join(rejects.select("doc_seq").distinct(), "doc_seq", "left_anti"))
    numeric = late.select(F.lit(None).cast("bigint").alias("rg_id"), "doc_seq", F.lit(NUMERIC).alias("layer"), "path", F.lit(None).cast("string").alias("value"), "message")
    rejects = rejects.unionByName(numeric)
    gone = rejects.select("doc_seq").distinct()
    good = good.select("rg_id", "doc_seq", "path", "kind", "s", "i", "d")
    return Shredded(good.join(gone, "doc_seq", "left_anti"), rejects, skipped.join(gone, "doc_seq", "left_anti"), good, raw)


def all_hard(config: Config) -> bool:
    return config.parser_failure == config.numeric_failure == HARD and all(r.failure_mode == HARD for r in config.representations)


def raise_first(shredded: Shredded, config: Config) -> None:
    """Raises the reject of the first document whose layer's failure mode is hard."""
    hard = [layer for layer, mode in ((PARSER, config.parser_failure), (NUMERIC, config.numeric_failure), (TRANSFORMER, HARD)) if mode == HARD]
    first = shredded.rejects.where(F.col("layer").isin(hard)).orderBy("doc_seq").first()
    if first:
        path = first["path"]
        raise IngestError(first["layer"], path, first["value"], first["message"])
