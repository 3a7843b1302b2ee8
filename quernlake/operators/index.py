"""The pruning index: tall tables keyed by path.

``string_postings`` (path, term, rg_id), ``numeric_stats`` (path, rg_id, imin, imax, dmin, dmax), ``strlen_stats``, ``null_stats``
(path, rg_id, has_null, is_present), ``trigrams`` (path, gram, rg_id), ``promoted``/``buckets`` of adaptive paths (with the
segment they are of, as a term may be promoted in some segments only) and the ``path_directory``.  Each is a lazy plan over the observations, so a query builds only what it asks for; a
written index (sources.store) serves the same tables from Parquet, sorted by path for row-group skipping.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cache, cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernlake.functions.sketches import Bloom, build_bloom, distinct_sketch
from quernlake.functions.text import ngrams
from quernlake.operators import shred as shredding
from quernlake.operators.observe import observed
from quernlake.plans import jsonpath
from quernlake.plans.config import Config
from quernlake.sources import scratch

EXACT_MODE, BLOOM_ONLY, ADAPTIVE = "exact", "bloom-only", "adaptive-hybrid"
TYPES = {"string": 1, "int": 2, "float": 4, "bool": 8, "null": 16}
TYPE_NAMES = ("string", "int", "float", "bool", "null")
TASK_BYTES = 2 << 20  # of values whose rows one task turns into tables: trigrams are some hundred times that in memory
TABLES = ("row_groups", "path_directory", "string_postings", "promoted", "buckets", "numeric_stats", "strlen_stats", "null_stats", "trigrams", "hll", "doc_id_map")


def bucket(term: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(n)).cast("int")


def string_postings(obs: DataFrame) -> DataFrame:
    return obs.where("kind in ('string', 'bool')").select("path", F.col("s").alias("term"), "rg_id").distinct()


def numeric_stats(obs: DataFrame) -> DataFrame:
    out = obs.where("kind in ('int', 'float')").groupBy("path", "rg_id")
    return out.agg(F.min("i").alias("imin"), F.max("i").alias("imax"), F.min("d").alias("dmin"), F.max("d").alias("dmax"), F.max(F.col("kind") == "float").alias("floats"))


def strlen_stats(obs: DataFrame) -> DataFrame:
    n = F.octet_length("s")
    return obs.where("kind in ('string', 'bool')").groupBy("path", "rg_id").agg(F.min(n).alias("len_min"), F.max(n).alias("len_max"))


def null_stats(obs: DataFrame) -> DataFrame:
    return obs.groupBy("path", "rg_id").agg(F.max(F.col("kind") == "null").alias("has_null"), F.lit(True).alias("is_present"))


def trigrams(obs: DataFrame, config: Config) -> DataFrame:
    """(path, gram, rg_id) of the paths with full-text search, from strings and booleans."""
    rows = obs.where("kind in ('string', 'bool')").where(F.octet_length("s") >= config.trigram_min_length)
    rows = rows.where(full_text(F.col("path"), config))
    return rows.select("path", "rg_id", F.explode(ngrams(F.col("s"))).alias("gram")).distinct().select("path", "gram", "rg_id")


def full_text(path: Column, config: Config) -> Column:
    if not config.enable_trigrams:
        return F.lit(False)
    if not config.fts_paths:
        return F.lit(True)
    out = F.lit(False)
    for p in config.fts_paths:
        out = out | (path == p)
        if p.endswith(".*"):
            out = out | (path == p[:-2]) | path.startswith(p[:-1])
    return out


def distinct_sketches(obs: DataFrame, config: Config) -> DataFrame:
    return obs.where("kind in ('string', 'bool')").groupBy("path").agg(distinct_sketch("s", config.hll_precision).alias("sketch"))


def promoted_terms(postings: DataFrame, config: Config, row_groups: int) -> DataFrame:
    """(path, term, coverage) of the terms that adaptive paths index exactly: in enough row groups but not nearly all,
    most frequent first."""
    coverage = postings.groupBy("path", "term").agg(F.count("*").alias("coverage"))
    fit = coverage.where((F.col("coverage") >= config.adaptive_min_coverage) & (F.col("coverage") / row_groups <= config.adaptive_ceiling))
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("coverage"), "term"))
    return fit.withColumn("rank", rank).where(F.col("rank") <= config.adaptive_cap).drop("rank")


def path_directory(obs: DataFrame, config: Config) -> DataFrame:
    """One row for each path: types, cardinality, mode, lengths and numeric range."""
    type_bit = F.coalesce(*[F.when(F.col("kind") == k, bit) for k, bit in TYPES.items()], F.lit(0))
    term = F.when(F.col("kind").isin("string", "bool"), F.col("s"))
    rows = obs.groupBy("path").agg(
        F.bit_or(type_bit).alias("types"),
        F.approx_count_distinct(term, 0.01).alias("cardinality"),
        F.min(F.octet_length(term)).alias("len_min"),
        F.max(F.octet_length(term)).alias("len_max"),
        F.min("i").alias("imin"), F.max("i").alias("imax"), F.min("d").alias("dmin"), F.max("d").alias("dmax"),
    )
    mode = F.when(F.col("cardinality") <= config.cardinality_threshold, EXACT_MODE).otherwise(ADAPTIVE if config.adaptive else BLOOM_ONLY)
    return rows.withColumn("mode", mode).withColumn("has_trigrams", full_text(F.col("path"), config) & (F.col("types").bitwiseAND(9) > 0)).withColumn("numeric", F.when(F.col("types").bitwiseAND(4) > 0, "mixed").when(F.col("types").bitwiseAND(2) > 0, "int"))


@dataclass
class Entry:
    """A path's row of the directory, as the planner needs it."""

    path: str
    types: int
    cardinality: int
    mode: str
    len_min: int | None
    len_max: int | None
    numeric: str | None
    has_trigrams: bool
    imin: int | None = None
    imax: int | None = None
    dmin: float | None = None
    dmax: float | None = None

    @property
    def has_strings(self) -> bool:
        return self.types & 9 > 0


@dataclass
class Index:
    """The tables of an index.  ``provide(name, path)`` gives a table, pruned to a path where one is named."""

    config: Config
    num_row_groups: int
    spark: SparkSession
    provide: Callable[[str, str | None], DataFrame]
    rejects: DataFrame | None = None
    skipped: DataFrame | None = None
    bloom: Bloom | None = None
    raw: DataFrame | None = None
    written: bool = False  # whether the tables are stored, so that reading them is cheaper than making them
    spread: Callable[[], tuple["Index", int]] | None = None  # the same index over rows that lie by row groups in that many tasks
    _entries: dict[str, Entry | None] = field(default_factory=dict)

    def table(self, name: str, path: str | None = None) -> DataFrame:
        df = self.provide(name, path)
        return df.where(F.col("path") == path) if path is not None and "path" in df.columns else df

    def entries(self, paths: list[str]) -> dict[str, Entry | None]:
        """Directory rows of the predicates' paths, read in one job and remembered."""
        new = [p for p in dict.fromkeys(paths) if p not in self._entries]
        if new:
            found = {}
            directory = reduce(DataFrame.union, [self.table("path_directory", p) for p in new])  # each scans its column only
            for r in directory.collect():
                found[r["path"]] = Entry(**{f: r[f] for f in Entry.__dataclass_fields__})
            self._entries.update({p: found.get(p) for p in new})
        return {p: self._entries[p] for p in paths}

    @cached_property
    def representations(self) -> dict[tuple[str, str], str]:
        return {(r.path, r.alias): r.target for r in self.config.representations}

    def discard(self) -> None:
        """Deletes the intermediate table of :func:`build_index`; the index isn't to be asked any more."""
        if self.raw is not None:
            scratch.discard(self.raw)

    def header(self) -> DataFrame:
        """(num_row_groups, num_docs, num_paths)."""
        docs = self.table("doc_id_map").agg(F.count("*").alias("num_docs"))
        paths = self.table("path_directory").agg(F.count("*").alias("num_paths"))
        return docs.crossJoin(paths).select(F.lit(self.num_row_groups).cast("bigint").alias("num_row_groups"), "num_docs", "num_paths")

    def build_bloom(self) -> Bloom:
        """The global Bloom filter over ``path=value`` of all terms and numbers."""
        if self.bloom is None:
            obs = self.provide("observations", None).where("s is not null or d is not null")
            value = F.coalesce("s", F.col("i").cast("string"), F.col("d").cast("string"))
            self.bloom = build_bloom(obs.select(F.concat("path", F.lit("="), value).alias("v")), "v", self.config.bloom_bits, self.config.bloom_hashes)
        return self.bloom


def _provider(spark: SparkSession, observe: Callable[[str | None], DataFrame], row_groups: DataFrame, n: int, config: Config, doc_ids: DataFrame | None) -> Callable[[str, str | None], DataFrame]:
    groups = cache(lambda: n or row_groups.count())  # coverage is a share of them

    def provide(name: str, path: str | None) -> DataFrame:
        if name == "row_groups":
            return row_groups
        if name == "doc_id_map":
            return doc_ids if doc_ids is not None else row_groups.select("rg_id", F.col("rg_id").alias("doc_id"))
        obs = observe(path)
        if path is not None:
            obs = obs.where(F.col("path") == path)
        if name == "observations":
            return obs
        if name == "path_directory":
            return path_directory(obs, config)
        if name == "numeric_stats":
            return numeric_stats(obs)
        if name == "strlen_stats":
            return strlen_stats(obs)
        if name == "null_stats":
            return null_stats(obs)
        if name == "hll":
            return distinct_sketches(obs, config)
        if name == "trigrams":
            return trigrams(obs, config)
        postings = string_postings(obs)
        if name == "string_postings":
            return postings
        hot = promoted_terms(postings, config, groups())
        if name == "promoted":
            return postings.join(hot.select("path", "term"), ["path", "term"], "left_semi").withColumn("segment", F.lit(0))
        if name == "buckets":
            cold = postings.join(hot.select("path", "term"), ["path", "term"], "left_anti")
            return cold.select("path", bucket(F.col("term"), config.adaptive_buckets).alias("bucket"), "rg_id").distinct().withColumn("segment", F.lit(0))
        raise KeyError(name)

    return provide


def index_table(df: DataFrame, rg_id: Column, row_groups: DataFrame, num_row_groups: int, columns: list[str] | None = None, config: Config | None = None) -> Index:
    """Index of a typed table, with no JSON in between: a predicate's table scans just its column."""
    config = config or Config()
    names = columns if columns is not None else df.columns

    def observe(path: str | None) -> DataFrame:
        source = next((r.path for r in config.representations if r.target == path), path)
        some = [c for c in names if source is None or source == f"$.{c}"]
        if not some:
            return shredding.observe_columns(df, rg_id, F.lit(0), names[:1]).where("false")
        obs = shredding.observe_columns(df, rg_id, F.lit(0), some)
        made, _ = shredding.companions(obs, config)
        return obs if made is None else obs.unionByName(made)

    def spread() -> tuple[Index, int]:
        kinds = dict(df.dtypes)
        size = sum((F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) if kinds[c] == "string" else F.lit(8) for c in names), F.lit(0))
        tasks = _tasks(df, size)
        rows = df.select(*[f"`{c}`" for c in names], rg_id.cast("bigint").alias("__rg_id")).repartition(tasks, "__rg_id")
        return index_table(rows, F.col("__rg_id"), row_groups, num_row_groups, names, config), tasks

    return Index(config, num_row_groups, df.sparkSession, _provider(df.sparkSession, observe, row_groups, num_row_groups, config, None), spread=spread)


def _tasks(rows: DataFrame, size: Column) -> int:
    """Of how many tasks each has a bounded part of the rows, however few files they come from."""
    return min(100_000, -(-(rows.agg(F.sum(size.cast("bigint"))).first()[0] or 1) // TASK_BYTES))


@observed("build")
def build_index(docs: DataFrame, num_row_groups: int, config: Config | None = None, keep=None, parser=None) -> Index:
    """Index of JSON documents (rg_id, doc_seq, json and, if ids aren't positions, doc_id).

    ``keep`` stores what the one pass over the texts gives, which all tables are made of: a function from DataFrame to
    DataFrame (by default a table in the shared folder, which :meth:`Index.discard` deletes).
    """
    config = config or Config()
    if num_row_groups <= 0:
        raise ValueError("the number of row groups must be positive")
    spark = docs.sparkSession
    shredded = shredding.shred(docs, config, parser, keep or scratch.saved)
    if not shredded.raw.where((F.col("rg_id") >= num_row_groups) | (F.col("rg_id") < 0)).isEmpty():
        scratch.discard(shredded.raw)
        raise ValueError("a document lies beyond the last row group")
    shredding.raise_first(shredded, config)
    # where every failure is hard, no document is rejected from here on
    obs = shredded.all_ if shredding.all_hard(config) else shredded.observations
    row_groups = spark.range(num_row_groups).select(F.col("id").alias("rg_id"))
    ids = docs.select(F.col("rg_id").cast("bigint"), F.col("doc_id").cast("bigint")).distinct() if "doc_id" in docs.columns else None
    made = Index(config, num_row_groups, spark, _provider(spark, lambda _: obs, row_groups, num_row_groups, config, ids), shredded.rejects, shredded.skipped_representations, raw=shredded.raw)

    def spread() -> tuple[Index, int]:
        tasks = _tasks(shredded.raw, F.coalesce(F.octet_length("s"), F.lit(0)) + 8)
        rows = obs.repartition(tasks, "rg_id")
        return replace(made, provide=_provider(spark, lambda _: rows, row_groups, num_row_groups, config, ids), spread=None, _entries={}), tasks

    made.spread = spread
    return made


def type_names(types: int) -> list[str]:
    return [n for n in TYPE_NAMES if types & TYPES[n]]


def path_report(index: Index) -> DataFrame:
    """(path, types, cardinality, mode, promoted, buckets, representations) of the paths that aren't derived."""
    directory = index.table("path_directory").where(~F.col("path").startswith(jsonpath.DERIVED))
    names = F.concat_ws(",", *[F.when(F.col("types").bitwiseAND(bit) > 0, F.lit(n)) for n, bit in TYPES.items()])
    adaptive = F.col("mode") == ADAPTIVE
    promoted = index.table("promoted").select("path", "term").distinct().groupBy("path").agg(F.count("*").alias("promoted"))
    aliases = F.lit("")
    for source in dict.fromkeys(r.path for r in index.config.representations):
        aliases = F.when(F.col("path") == source, ",".join(r.alias for r in index.config.representations if r.path == source)).otherwise(aliases)
    out = directory.join(promoted, "path", "left")
    return out.select("path", names.alias("types"), "cardinality", "mode", F.when(adaptive, F.coalesce("promoted", F.lit(0))).otherwise(0).alias("promoted"), F.when(adaptive, index.config.adaptive_buckets).otherwise(0).alias("buckets"), aliases.alias("representations"))
