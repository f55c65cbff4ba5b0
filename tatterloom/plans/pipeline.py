"""The phases: analyze files, review and normalize their schemas, materialize datasets, and measure.

A phase hands on a Mapping, a bundle of DataFrames with a row per block, header, column or schema; lines stay in the
files. What is written as JSON is that bundle, which is small beside the data.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tatterloom.functions.scalars import BUCKETS, split_line, strip
from tatterloom.operators import align, blocks, headers, offsets, profile, sampling, schemas
from tatterloom.operators.durable import durable, partitioned, small
from tatterloom.plans.artifacts import Contract, Contracts
from tatterloom.plans.control import Config, Job, JobState, Manifests, append_line, progress, throughput
from tatterloom.sources.lines import file_lines, input_files, raw_lines
from tatterloom.sources.sinks import distinct_names, write_rows


@dataclass
class Mapping:
    """files: delimiter and headers; blocks; columns: the blocks' columns; profiles; clusters; entries: the column mapping."""

    lines: DataFrame
    files: DataFrame
    blocks: DataFrame
    columns: DataFrame
    profiles: DataFrame
    variants: DataFrame
    clusters: DataFrame
    entries: DataFrame
    schemas: DataFrame | None = None
    schema_columns: DataFrame | None = None

    def document(self) -> dict:
        """The mapping as the JSON document between phases."""
        rows = lambda df: [r.asDict(True) for r in df.collect()] if df is not None else []
        return {
            "blocks": rows(self.blocks), "schemas": rows(self.schemas), "header_clusters": [{**c, "confidence_score": c.pop("confidence"), "variants": [{"raw_name": h} for h in c.pop("headers")]} for c in rows(self.clusters)],
            "schema_mapping": rows(self.entries), "column_profiles": rows(self.profiles), "file_headers": rows(self.files.select("file_id", "headers")),
        }


def analyze(spark: SparkSession, targets: list[str], config: Config) -> Mapping:
    """Reads the files once into numbered lines and derives plan, signatures, profiles, clusters and offsets from them."""
    p = config.profile
    lines = raw_lines(spark, input_files(spark, targets))
    files = durable(sampling.first_headers(lines))
    plan = durable(sampling.block_plan(file_lines(lines), p.block_size, p.min_gap_lines))
    found, columns = sampling.signatures(sampling.sampled_lines(lines, plan), p.sample_values_cap)
    own = durable(plan.join(found, ["file_id", "block_id"], "left"))
    columns = durable(columns)
    body = blocks.without_headers(lines, _header_texts(files))
    cells = body.where(strip(F.col("raw")) != "").join(small(files.select("file_id", "delimiter")), "file_id").select("file_id", "line_no", split_line(F.col("raw"), F.col("delimiter")).alias("cells"))
    profiles = durable(profile.profile_rows(cells, files.select("file_id", "headers")))
    counts = {"n_empty": F.col("n_null"), **{f"n_{b}": F.col(f"n_{b}") for b in BUCKETS if b != "empty"}}
    variants = durable(profiles.select("file_id", "idx", F.col("header").alias("raw"), *[c.alias(n) for n, c in counts.items()], F.xxhash64("file_id", "idx").alias("ord")))
    clusters = durable(headers.header_clusters(variants))
    named = clusters.select(F.explode("headers").alias("raw"), "canonical_name").join(variants, "raw")
    entries = durable(offsets.detect_offsets(named, variants))
    return Mapping(lines, files, own, columns, profiles, variants, clusters, entries)


def _header_texts(files: DataFrame) -> DataFrame:
    """(file_id, header): the header line as it stands in the file."""
    return files.select("file_id", F.col("header_line").alias("header"))


def review(mapping: Mapping, synonyms: schemas.Synonyms | None = None) -> Mapping:
    """Groups blocks into schemas. Blocks inside a file share its header; clusters, profiles and offsets stay."""
    names = synonyms or schemas.Synonyms({})
    whole = mapping.files.select("file_id", F.col("delimiter").alias("d"), F.size("headers").alias("w"), "headers")
    own = mapping.blocks.join(small(whole), "file_id").withColumns({"delimiter": F.col("d"), "column_count": F.col("w"), "header_sample": F.array_join("headers", "\x1f")})
    own = own.withColumn("header_sample", F.replace("header_sample", F.lit("\x1f"), F.col("delimiter"))).withColumn("ord", F.xxhash64("file_id", "block_id").bitwiseAND((1 << 62) - 1))
    own = durable(own.drop("d", "w", "headers"))
    founded = durable(schemas.cluster_blocks(own.select("ord", "delimiter", "column_count", "header_sample"), names))
    joined = own.join(founded, "ord").withColumn("schema_id", F.lower(F.hex("schema_ord")))
    firsts = durable(joined.where("ord = schema_ord").select("schema_id", "file_id", "header_sample", "delimiter"))
    kinds = mapping.profiles.join(firsts.select("schema_id", "file_id"), "file_id").select("schema_id", "idx", _profile_type().alias("data_type"))
    columns = durable(schemas.schema_columns(firsts, kinds, names))
    found = columns.groupBy("schema_id").agg(F.min_by("name", "index").alias("name"), F.count(F.lit(1)).alias("width"))
    found = durable(found.join(firsts.select("schema_id", F.col("file_id").alias("founder")), "schema_id"))
    return replace(mapping, blocks=durable(joined.drop("ord", "schema_ord")), schemas=found, schema_columns=columns)


def _profile_type():
    """A column's type by its profile: what all its cells that aren't blank are."""
    some = F.col("total_values") - F.col("n_null")
    return F.when(some == 0, "string").when(F.col("n_integer") == some, "int").when(F.col("n_integer") + F.col("n_float") == some, "decimal").when(F.col("n_date") == some, "date").otherwise("string")


def normalize(mapping: Mapping, contracts: Contracts) -> tuple[Mapping, dict[str, Contract]]:
    """Binds schemas to contracts, whose types then are the columns'. A row per schema and contract goes over the driver."""
    bound = {}
    for s in mapping.schemas.collect():
        if c := contracts.resolve(None, s["name"]):
            bound[s["schema_id"]] = c
    if not bound:
        return mapping, bound
    spark = mapping.lines.sparkSession
    specs = spark.createDataFrame([(sid, col.name, col.data_type) for sid, c in bound.items() for col in c.columns], "schema_id string, column string, spec_type string")
    typed = schemas.contract_types(mapping.schema_columns, specs).join(mapping.schema_columns.select("schema_id", "index", "raw_name"), ["schema_id", "index"])
    return replace(mapping, schema_columns=durable(typed)), bound


def _slug(name: str) -> str:
    return "_".join("".join(c if c.isalnum() else " " for c in name.lower()).split())


@dataclass
class Summary:
    """What materializing a schema did."""

    schema_id: str
    schema_name: str
    target: str
    rows_written: int
    duration_seconds: float
    rows_per_second: float
    validation: dict


def materialize(
    mapping: Mapping, dest: str, config: Config, fmt: str = "csv", contracts: dict[str, Contract] | None = None, job_id: str | None = None, db_url: str | None = None, checkpoint_dir: str | None = None, telemetry: str | None = None,
) -> list[Summary]:
    """Writes each schema's rows, aligned, fitted and validated, in one plan per schema; counts come from the same pass.

    The lines are split and dealt out by schema in one pass, so a schema's plan reads only its own rows.
    A job that is run again under its id skips the schemas that its manifest has and replaces the others' output, so
    every row is there once.
    """
    job = Job(job_id or uuid.uuid4().hex, telemetry and f"{telemetry}.jobs")
    manifests = Manifests(checkpoint_dir) if checkpoint_dir else None
    done = manifests.load(job.job_id, "materialize") if manifests else {}
    job.transition(JobState.MATERIALIZING)
    known = {r["schema_id"]: r for r in mapping.schemas.collect()}  # a row per schema
    columns: dict[str, list] = {}
    for r in mapping.schema_columns.orderBy("schema_id", "index").collect():
        columns.setdefault(r["schema_id"], []).append(r)
    owned = mapping.blocks.where("schema_id is not null").select("file_id", "block_id", "start_line", "end_line", "schema_id", F.xxhash64("schema_id").alias("schema_ord"))
    intervals = durable(blocks.compacted(owned))
    body = blocks.without_headers(mapping.lines, _header_texts(mapping.files))
    lines = blocks.assigned_lines(body, intervals).join(small(mapping.files.select("file_id", "delimiter")), "file_id")
    cells = lines.select("file_id", "line_no", "schema_id", F.transform(split_line(F.col("raw"), F.col("delimiter")), strip).alias("cells"))
    cells = partitioned(cells, "schema_id")  # the lines are read once, whatever the number of schemas
    out, used = [], {}
    try:
        for sid, schema in sorted(known.items(), key=lambda kv: (kv[1]["name"], kv[0])):
            own = columns[sid]
            slug = _slug(schema["name"]) or sid
            used[slug] = used.get(slug, 0) + 1
            target = slug if used[slug] == 1 else f"{slug}_{sid}"
            if sid in done:
                out.append(Summary(**done[sid]))
                continue
            contract = (contracts or {}).get(sid)
            place = {_slug(c["name"]): c["index"] for c in reversed(own)}
            specs = [replace(s, index=place.get(_slug(s.name))) for s in contract.columns] if contract else []
            entries, width = offsets.targets_within(mapping.entries, schema["founder"]), len(own)
            rows = align.validated(align.align_rows(cells.where(F.col("schema_id") == sid), entries.where(F.col("target_index") < width)), width, specs)
            rows, counts = align.observed(rows, f"v{sid}")
            names = distinct_names([c["name"] or c["raw_name"] for c in own])
            numbers: list[str] = []
            if fmt == "database":  # rows are numbered in the order of their files, in chunks of the profile's size
                numbers = ["chunk_index", "row_in_chunk"]
                rows = blocks.chunked(rows, ["file_id", "line_no"], config.profile.writer_chunk_rows)
                names = distinct_names([*numbers, *names])[2:]
            table = rows.select(*[F.get("cells", k).alias(n) for k, n in enumerate(names)], *numbers)
            start = time.time()
            write_rows(table, fmt, f"{dest.rstrip('/')}/{target}", config.profile.writer_chunk_rows, db_url, target)
            seen = counts.get
            taken = time.time() - start
            summary = Summary(sid, schema["name"], target, seen["total_rows"], taken, throughput(seen["total_rows"], taken), dict(seen))
            out.append(summary)
            if telemetry:
                append_line(telemetry, {**asdict(summary), **progress(summary.rows_written, summary.rows_written, taken), "timestamp": time.time()})
            if manifests:
                done[sid] = asdict(summary)
                manifests.save(job.job_id, "materialize", done)
    except BaseException as e:
        job.fail(str(e)[:300])
        raise
    job.transition(JobState.VALIDATING)
    job.transition(JobState.DONE)
    if manifests:
        manifests.clear(job.job_id, "materialize")
    return out


def plan(mapping: Mapping, path: str | None = None) -> list[dict]:
    """What materialize() would do: a row per schema, by name."""
    rolled = blocks.plan_rollup(mapping.blocks, mapping.schemas).orderBy("schema_name")
    found = [{**r.asDict(), "output_path": f"{_slug(r['schema_name']) or 'dataset'}.csv"} for r in rolled.collect()]
    if path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps(found, indent=2), "utf-8")
    return found


def benchmark(spark: SparkSession, targets: list[str], config: Config, log: str) -> dict:
    """Times analyze() and adds a line to the log."""
    start = time.time()
    found = analyze(spark, targets, config)
    rows = found.lines.count()
    seconds = time.time() - start
    result = {"dataset": ",".join(targets), "seconds": seconds, "rows": rows, "rows_per_second": throughput(rows, seconds), "timestamp": time.time()}
    append_line(log, result)
    return result


def batch(spark: SparkSession, folder: str, dest: str, config: Config, fmt: str = "csv") -> list[Summary]:
    """All phases over a folder."""
    return materialize(review(analyze(spark, [folder], config)), dest, config, fmt)


def delimiters(mapping: Mapping) -> dict[str, int]:
    """How many files use each delimiter."""
    return {r["delimiter"]: r["n"] for r in mapping.files.groupBy("delimiter").agg(F.count(F.lit(1)).alias("n")).collect()}
