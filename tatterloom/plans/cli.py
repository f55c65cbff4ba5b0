"""The command line: analyze, benchmark, review, normalize and materialize; each runs the phases it needs."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from tatterloom.operators.schemas import Synonyms
from tatterloom.plans import pipeline
from tatterloom.plans.artifacts import Contracts, save_mapping, write_artifacts
from tatterloom.plans.control import EngineError, Sandbox, load_config
from tatterloom.sources.tables import Tables


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tatterloom", description="Ragged delimited text on Spark")
    verbs = top.add_subparsers(dest="verb", required=True)
    for verb in ("analyze", "benchmark", "review", "normalize", "materialize"):
        sub = verbs.add_parser(verb)
        sub.add_argument("inputs", nargs="+", help="files or folders")
        sub.add_argument("--profile", default="low_memory")
        sub.add_argument("--config")
        if verb == "benchmark":
            sub.add_argument("--log", default="artifacts/benchmarks.jsonl")
            continue
        sub.add_argument("--output", default={"analyze": "output_data/mapping.json"}.get(verb, f"mapping.{verb}.json"))
        sub.add_argument("--include-samples", action="store_true")
        sub.add_argument("--tables", help="folder of the engine's own tables")
        if verb != "analyze":
            sub.add_argument("--synonyms")
        if verb in ("normalize", "materialize"):
            sub.add_argument("--contracts")
        if verb == "materialize":
            sub.add_argument("--dest", default="output_data/")
            sub.add_argument("--plan")
            sub.add_argument("--checkpoint-dir")
            sub.add_argument("--writer-format", choices=("csv", "parquet", "json", "database"), default="csv")
            sub.add_argument("--telemetry-log")
            sub.add_argument("--db-url")
            sub.add_argument("--job-id", "--resume", dest="job_id")
    return top


_PATHS = ("inputs", "config", "log", "output", "tables", "synonyms", "contracts", "dest", "plan", "checkpoint_dir", "telemetry_log")


def sandbox(args: argparse.Namespace) -> Sandbox:
    """The folder that the command runs in; absolute paths that its arguments name are allowed too."""
    named = [p for k in _PATHS for p in (lambda v: v if isinstance(v, list) else [v])(getattr(args, k, None)) if p]
    return Sandbox(os.getcwd(), tuple(p for p in named if os.path.isabs(p)))


def checked(args: argparse.Namespace) -> argparse.Namespace:
    """args with paths inside the sandbox, which a relative path must not leave; other file systems' URIs stay as they are."""
    box = sandbox(args)
    inside = lambda p: p if "://" in p or p.startswith("file:") else str(box.resolve(p))
    for k in _PATHS:
        if value := getattr(args, k, None):
            setattr(args, k, [inside(v) for v in value] if isinstance(value, list) else inside(value))
    return args


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        args = checked(args)
    except EngineError as e:
        print(e, file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("tatterloom").getOrCreate()
    try:
        config = load_config(args.profile, args.config)
        if args.verb == "benchmark":
            print(json.dumps(pipeline.benchmark(spark, args.inputs, config, args.log)))
            return 0
        mapping = pipeline.analyze(spark, args.inputs, config)
        bound = {}
        if args.verb != "analyze":
            mapping = pipeline.review(mapping, Synonyms.read(args.synonyms or config.synonym_dictionary))
        if args.verb in ("normalize", "materialize"):
            mapping, bound = pipeline.normalize(mapping, Contracts.read(args.contracts or config.canonical_schema_path))
        document = mapping.document()
        save_mapping(document, args.output, args.include_samples)
        if args.verb == "analyze":
            write_artifacts(document, args.output)
        if args.tables:
            tables = Tables(spark, args.tables)
            tables.migrate()
            tables.persist_mapping(mapping)
            tables.audit("mapping", args.verb, args.output)
        if args.verb == "materialize":
            if args.plan:
                pipeline.plan(mapping, args.plan)
            for s in pipeline.materialize(mapping, args.dest, config, args.writer_format, bound, args.job_id, args.db_url, args.checkpoint_dir, args.telemetry_log):
                print(f"{s.schema_name}: {s.rows_written} rows to {s.target}, {s.validation}")
                if args.tables:
                    tables.job_metrics(schema_id=s.schema_id, schema_name=s.schema_name, rows_written=s.rows_written, duration_seconds=s.duration_seconds, rows_per_second=s.rows_per_second, **s.validation)
    except EngineError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
