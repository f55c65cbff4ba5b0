"""The engine's own tables as Parquet folders: replaced or appended to, with their versions."""

from __future__ import annotations

import json
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tatterloom.functions.scalars import BUCKETS
from tatterloom.operators import blocks
from tatterloom.operators.headers import type_profiles

#: Columns of the tables, by the version that brought them (fixed values).
VERSIONS: dict[int, dict[str, str]] = {
    1: {
        "schemas": "id string, name string, columns_json string, updated_at string",
        "blocks": "block_key string, file_path string, block_id int, schema_id string, start_line long, end_line long",
        "stats": "id long, schema_id string, column_name string, metrics_json string, updated_at string",
        "synonyms": "canonical_name string, variant string, created_at string",
        "audit_log": "entity string, action string, detail string, created_at string",
        "job_metrics": "schema_id string, schema_name string, rows_written long, duration_seconds double, rows_per_second double, error_count long, warnings_json string, spill_count long, rows_spilled long, created_at string",
        "job_progress_events": "schema_id string, schema_name string, file_path string, processed_rows long, total_rows long, eta_seconds double, rows_per_second double, spill_rows long, created_at string",
    },
    2: {"header_occurrences": "raw_header string, file_id string, column_index int", "header_profiles": "raw_header string, type_profile_json string", "file_headers": "file_id string, headers_json string"},
    3: {"column_profiles": "file_id string, column_index int, header string, type_distribution_json string, unique_estimate long, null_count long, total_values long, numeric_min double, numeric_max double, date_min string, date_max string"},
    4: {"job_status": "job_id string, state string, detail string, last_error string, metadata_json string, created_at string, updated_at string", "job_events": "job_id string, state string, detail string, created_at string"},
    5: {"artifact_metadata": "key string, value string, updated_at string"},
}
_ADDED = {"schemas": (5, ", canonical_schema_id string, canonical_namespace string, canonical_schema_version string")}


class Tables:
    """Tables in a folder that only Spark reads and writes, and the versions that were applied to it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def schema(self, name: str) -> str:
        base = next(t[name] for t in VERSIONS.values() if name in t)
        return base + _ADDED.get(name, (0, ""))[1]

    def migrate(self) -> list[int]:
        """Makes what is missing, a version at a time; gives the versions that were new."""
        new = []
        for version, tables in VERSIONS.items():
            missing = [t for t in tables if not self._there(t)]
            for t in missing:
                self.spark.createDataFrame([], self.schema(t)).write.mode("ignore").parquet(f"{self.folder}/{t}")
            if missing:
                new.append(version)
        return new

    def _there(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schema(name)).parquet(f"{self.folder}/{name}")

    def replace(self, name: str, rows: DataFrame) -> None:
        self._fit(name, rows).write.mode("overwrite").parquet(f"{self.folder}/{name}")

    def append(self, name: str, rows: DataFrame | list[dict]) -> None:
        if isinstance(rows, list):
            names = [c.strip().split(" ")[0] for c in self.schema(name).split(",")]
            rows = self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], self.schema(name))
        self._fit(name, rows).write.mode("append").parquet(f"{self.folder}/{name}")

    def _fit(self, name: str, rows: DataFrame) -> DataFrame:
        want = [c.strip().split(" ") for c in self.schema(name).split(",")]
        return rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in want])

    def persist_mapping(self, mapping) -> None:
        """Replaces the tables of schemas, blocks, profiles and headers by a mapping's."""
        stamp = F.lit(_now())
        kinds = F.to_json(F.create_map(*[x for b in BUCKETS for x in (F.lit(b), F.col(f"n_{b}"))]))
        self.replace("blocks", mapping.blocks.withColumns({"block_key": F.concat_ws(":", "file_id", "block_id"), "file_path": F.col("file_id")}))
        self.replace("file_headers", mapping.files.withColumn("headers_json", F.to_json("headers")))
        profiles = mapping.profiles.withColumn("n_empty", F.col("n_null"))
        self.replace("column_profiles", profiles.withColumns({"column_index": F.col("idx"), "null_count": F.col("n_null"), "type_distribution_json": kinds}))
        self.replace("header_occurrences", mapping.variants.select(F.col("raw").alias("raw_header"), "file_id", F.col("idx").alias("column_index")))
        self.replace("header_profiles", type_profiles(mapping.variants.withColumnRenamed("raw", "raw_header")).withColumn("type_profile_json", kinds))
        if mapping.schemas is not None:
            own = mapping.schema_columns.groupBy("schema_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("index", "raw_name", "name", "data_type")))).alias("columns_json"))
            self.replace("schemas", mapping.schemas.join(own, "schema_id").withColumns({"id": F.col("schema_id"), "updated_at": stamp}))

    def audit(self, entity: str, action: str, detail: str | None = None) -> None:
        self.append("audit_log", [{"entity": entity, "action": action, "detail": detail, "created_at": _now()}])

    def job_metrics(self, **values: object) -> None:
        """A schema's figures; empty rows are no errors."""
        errors = sum(int(values.get(k) or 0) for k in ("short_rows", "long_rows", "missing_required", "type_mismatches"))
        self.append("job_metrics", [{**values, "error_count": errors, "warnings_json": json.dumps(values.get("warnings") or []), "created_at": _now()}])

    def progress(self, **values: object) -> None:
        """A progress event; without a schema it goes by its file's stem."""
        known = {"schema_id": Path(str(values.get("file_path") or "")).stem, **{k: v for k, v in values.items() if v is not None}}
        self.append("job_progress_events", [{"created_at": _now(), **known}])

    def progress_events(self, schema_id: str | None = None, limit: int = 100) -> DataFrame:
        """The newest events, newest first."""
        rows = self.read("job_progress_events")
        rows = rows if schema_id is None else rows.where(F.col("schema_id") == schema_id)
        return rows.orderBy(F.desc("created_at"), F.desc("processed_rows")).limit(limit)

    def prune_progress(self, most: int = 500, schema_id: str | None = None) -> None:
        """Keeps the newest events of a schema, or of every one."""
        from tatterloom.operators.durable import durable

        rows = durable(self.read("job_progress_events"))
        own = rows if schema_id is None else rows.where(F.col("schema_id") == schema_id)
        kept = blocks.newest(own, "schema_id", [F.desc("created_at"), F.desc("processed_rows")], most)
        self.replace("job_progress_events", kept if schema_id is None else kept.unionByName(rows.where(~F.col("schema_id").eqNullSafe(schema_id))))

    def job_event(self, job_id: str, state: str, detail: str | None = None, metadata: dict | None = None, error: str | None = None) -> None:
        """Adds to a job's history and to its states."""
        now = _now()
        self.append("job_events", [{"job_id": job_id, "state": state, "detail": detail, "created_at": now}])
        self.append("job_status", [{"job_id": job_id, "state": state, "detail": detail, "last_error": error, "metadata_json": json.dumps(metadata or {}), "created_at": now, "updated_at": now}])

    def job_status(self, job_id: str | None = None) -> DataFrame:
        """The last state of each job, with the time of its first."""
        rows = self.read("job_status")
        rows = rows if job_id is None else rows.where(F.col("job_id") == job_id)
        return blocks.latest(rows.withColumn("order", F.col("updated_at")), "job_id", F.col("order"), "updated_at").drop("events", "order")


def _now() -> str:
    return f"{time.strftime('%Y-%m-%dT%H:%M:%S', time.gmtime())}.{time.time_ns() % 1_000_000_000:09d}Z"
