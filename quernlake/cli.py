"""Command line: build, query, info, extract, experiment.  Exit status 1 if anything failed."""

from __future__ import annotations

import argparse
import sys
import tempfile
import uuid

from pyspark.sql import SparkSession

from quernlake.operators.evaluate import candidates
from quernlake.operators.index import build_index, path_report
from quernlake.operators.report import experiment
from quernlake.operators.rgset import to_list
from quernlake.plans.config import Config
from quernlake.plans.predicates import parse_predicate
from quernlake.sources import documents, store


def _files(spark: SparkSession, target: str) -> list[str]:
    """What a target names: an index, or the files of a path, folder or glob of any Hadoop file system."""
    return [target] if store.exists(spark, f"{target}/manifest.json") else documents.data_files(spark, target) or [target]


def _work(spark: SparkSession) -> str:
    """A folder for indexes under way, that all executors share; of this machine's own only where Spark runs on it alone."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(place or tempfile.gettempdir()).rstrip('/')}/quernlake-{uuid.uuid4().hex}"


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quernlake", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="index a JSON column of Parquet files")
    b.add_argument("target")
    b.add_argument("-c", "--column", required=True)
    b.add_argument("-o", "--output", help="one index of all files, with their row groups numbered through; else each file has a sidecar")
    b.add_argument("--embed", action="store_true")
    b.add_argument("--key", default=store.KEY)
    q = sub.add_parser("query", help="row groups that may match a predicate")
    q.add_argument("target")
    q.add_argument("predicate")
    q.add_argument("--compat", action="store_true")
    i = sub.add_parser("info", help="paths of an index")
    i.add_argument("target")
    e = sub.add_parser("extract", help="write an embedded index as a folder")
    e.add_argument("target")
    e.add_argument("-o", "--output", required=True)
    x = sub.add_parser("experiment", help="index JSON lines and report")
    x.add_argument("input")
    x.add_argument("--rg-size", type=int, default=1000)
    x.add_argument("--sample", type=int)
    x.add_argument("--test")
    x.add_argument("--json", action="store_true")
    x.add_argument("--on-error", choices=["abort", "continue"], default="abort")
    x.add_argument("-o", "--output")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("quernlake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    work = _work(spark)
    try:
        if args.command == "experiment":
            return _experiment(spark, args, work)
        failed = 0
        targets = _files(spark, args.target)
        if args.command == "build" and args.output and not args.embed:  # one index of all files
            targets = [targets]
        for t in targets:
            try:
                _one(spark, args, t, work)
            except Exception as e:
                failed += 1
                print(f"{t}: {e}", file=sys.stderr)
        if len(targets) > 1:
            print(f"{len(targets) - failed} of {len(targets)} files done")
        return 1 if failed else 0
    finally:
        store.remove(spark, work)


def _open(spark: SparkSession, target: str, work: str):
    if store.exists(spark, f"{target}/manifest.json"):
        return store.read_index(spark, target)
    return store.load_index(spark, target, work)


def _one(spark: SparkSession, args: argparse.Namespace, target: str | list[str], work: str) -> None:
    if args.command == "build":
        docs, n = documents.parquet_documents(spark, target, args.column)
        index = build_index(docs, n, Config())
        if args.embed:
            store.embed_index(index, target, work, args.key)
            print(f"{target}: index embedded")
        elif args.output:
            store.write_index(index, args.output)
            print(f"{args.target}: index in {args.output}")
        else:
            print(f"{target}: index in {store.write_sidecar(index, target)}")
        index.discard()
    elif args.command == "query":
        index = _open(spark, target, work)
        found = to_list(candidates(index, [parse_predicate(args.predicate)], "compat" if args.compat else "sound"))
        print(f"{target}: Matching row groups ({len(found)}/{index.num_row_groups}): {found}")
    elif args.command == "info":
        index = _open(spark, target, work)
        print(f"{target}: {index.num_row_groups} row groups")
        for r in path_report(index).orderBy("path").collect():
            print(f"  {r['path']}  types={r['types']}  cardinality={r['cardinality']}  mode={r['mode']}" + (f"  promoted={r['promoted']} buckets={r['buckets']}" if r["buckets"] else "") + (f"  representations={r['representations']}" if r["representations"] else ""))
    else:
        store.write_index(store.read_embedded(spark, target, work), args.output)
        print(f"{target}: index in {args.output}")


def _experiment(spark: SparkSession, args: argparse.Namespace, work: str) -> int:
    path = args.input
    if path == "-":
        path = f"{work}/stdin.jsonl"
        store.write_bytes(spark, path, sys.stdin.read().encode())
    try:
        report = experiment(spark, path, args.rg_size, sample=args.sample, predicate=parse_predicate(args.test) if args.test else None, on_error=args.on_error)
        if args.output and report.index is not None:
            store.write_index(report.index, args.output)
        print(report.to_json() if args.json else report.to_text())
        return 0
    except Exception as e:
        print(f"{args.input}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
