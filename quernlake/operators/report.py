"""Experiment report over JSON lines: summary, failures by layer, a row for each path, an optional predicate test."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernlake.operators import shred as shredding
from quernlake.operators.index import Index, build_index, path_report
from quernlake.operators.rows import pruning
from quernlake.plans.config import SOFT, Config
from quernlake.plans.predicates import Predicate
from quernlake.sources.documents import accepted_positions, jsonl_documents

LAYERS = ("parser", "transformer", "numeric", "schema", "unknown")
SAMPLES = 3


@dataclass
class Report:
    status: str
    summary: dict
    failures: list[dict]
    paths: list[dict]
    predicate: dict | None = None
    index: Index | None = field(default=None, repr=False)

    def to_json(self) -> str:
        body = {"status": self.status, "summary": self.summary, "failures": self.failures, "paths": self.paths}
        return json.dumps(body | ({"predicate_test": self.predicate} if self.predicate else {}), ensure_ascii=False)

    def to_text(self) -> str:
        out = [f"status: {self.status}"] + [f"{k}: {v}" for k, v in self.summary.items()]
        for f in self.failures:
            out.append(f"failures in {f['layer']}: {f['count']}")
            out += [f"  line {s['line']}: {s['message']}" for s in f["samples"]]
        out += [f"{p['path']} types={p['types']} cardinality={p['cardinality']} mode={p['mode']}" for p in self.paths]
        if self.predicate:
            p = self.predicate
            out.append(f"{p['predicate']}: matched {p['matched']}, pruned {p['pruned']} of {p['total']} (ratio {p['ratio']:.4f})")
        return "\n".join(out)


def occupancy(n: int, bits: int, hashes: int) -> float:
    """Expected share of a Bloom filter's bits that n values set."""
    return 1 - math.exp(-hashes * n / bits) if bits else 0.0


def failure_groups(rejects: DataFrame) -> DataFrame:
    """(layer, count, samples) in the order of the layers; samples are the first three by line."""
    rank = F.row_number().over(Window.partitionBy("layer").orderBy("doc_seq"))
    one = rejects.groupBy("doc_seq").agg(F.min(F.struct("layer", "path", "message")).alias("r")).select("doc_seq", "r.*")
    placed = one.withColumn("rank", rank)
    sample = F.when(F.col("rank") <= SAMPLES, F.struct((F.col("doc_seq") + 1).alias("line"), "path", "message"))
    return placed.groupBy("layer").agg(F.count("*").alias("count"), F.array_sort(F.collect_list(sample)).alias("samples"))


def experiment(spark: SparkSession, path: str, rg_size: int, config: Config | None = None, sample: int | None = None, predicate: Predicate | None = None, on_error: str = "abort") -> Report:
    """Indexes JSON lines and reports.  ``on_error``: ``abort`` stops at the first bad line, ``continue`` skips them."""
    config = config or Config()
    lines = jsonl_documents(spark, path, rg_size)
    total = lines.count()
    docs = lines.where(F.col("doc_seq") < sample) if sample is not None and on_error == "abort" else lines
    shredded = shredding.shred(docs, config)
    if on_error == "abort":
        shredding.raise_first(shredded, config)
    rejects = shredded.rejects.cache()
    accepted = accepted_positions(docs, rejects, rg_size)
    if sample is not None:
        accepted = accepted.where(F.col("doc_seq") < sample)
    n = accepted.count()
    bad = rejects.select("doc_seq").distinct().count()
    failures = [{"layer": r["layer"], "count": r["count"], "samples": [s.asDict() for s in r["samples"]]} for r in failure_groups(rejects).collect()]
    failures.sort(key=lambda f: (LAYERS.index(f["layer"]) if f["layer"] in LAYERS else len(LAYERS), f["layer"]))
    rgs = -(-n // rg_size)
    status = "partial" if bad else "truncated" if sample is not None and n < total else "complete"
    summary = {"lines": total, "documents": n, "rejected": bad, "row_groups": rgs, "paths": 0}
    if not n:
        return Report(status, summary, failures, [])
    index = build_index(accepted, rgs, replace(config, parser_failure=SOFT, numeric_failure=SOFT))
    rows = [r.asDict() for r in path_report(index).orderBy("path").collect()]
    summary |= {"paths": len(rows), "bloom_occupancy": round(index.build_bloom().occupancy, 6)}
    test = None
    if predicate is not None:
        test = {"predicate": str(predicate), **pruning(index, [predicate]).first().asDict()}
    return Report(status, summary, failures, rows, test, index)
