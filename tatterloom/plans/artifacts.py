"""The JSON documents between phases: mappings, contracts, schema statistics, and their upgrades."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field
from pathlib import Path

from tatterloom.operators.align import Spec

ARTIFACT_VERSION, CLUSTER_VERSION = "2.0.0", "1.1.0"
SECTIONS = ("blocks", "schemas", "header_clusters", "schema_mapping", "column_profiles", "file_headers", "header_occurrences", "header_profiles")
_SAMPLES = "sample_values"


def _without(value: object, key: str) -> object:
    if isinstance(value, dict):
        return {k: _without(v, key) for k, v in value.items() if k != key}
    return [_without(v, key) for v in value] if isinstance(value, list) else value


def upgraded(data: dict) -> dict:
    """A mapping of any version as one of the current one."""
    clusters = [{**{k: v for k, v in c.items() if k != "algorithm_version"}, "version": c.get("version") or c.get("algorithm_version") or CLUSTER_VERSION} for c in data.get("header_clusters", [])]
    for c in clusters:
        c["version"] = CLUSTER_VERSION
    return {"artifact_version": ARTIFACT_VERSION, **{s: data.get(s, []) for s in SECTIONS}, "header_clusters": clusters}


def save_mapping(data: dict, path: str | Path, include_samples: bool = False) -> None:
    """Writes a mapping; samples only if asked for, and sections without entries are left out but for blocks and schemas."""
    kept = {k: v for k, v in upgraded(data).items() if v or k in ("blocks", "schemas")}
    _write(kept if include_samples else _without(kept, _SAMPLES), path)


def load_mapping(path: str | Path) -> dict:
    return upgraded(json.loads(Path(path).read_text("utf-8")))


def write_artifacts(data: dict, mapping_path: str | Path) -> list[Path]:
    """The clusters and profiles beside a mapping, each in a file of its own if there are any."""
    path, out = Path(mapping_path), []
    now = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
    for section, name, extra in (("header_clusters", "clusters", True), ("column_profiles", "profiles", False)):
        if rows := data.get(section):
            target = path.with_name(f"{path.stem}.{section}.json")
            _write({"generated_at": now, **({"cluster_count": len(rows)} if extra else {}), name: _without(rows, _SAMPLES)}, target)
            out.append(target)
    return out


def _write(data: object, path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(data, indent=2, ensure_ascii=False, default=str), "utf-8")


def save_schema_stats(stats: list[dict], path: str | Path) -> None:
    """Statistics (schema_id, row_count, columns: name, unique_count_estimate, top_values)."""
    _write(stats, path)


def load_schema_stats(path: str | Path) -> list[dict]:
    return json.loads(Path(path).read_text("utf-8"))


@dataclass(frozen=True)
class Contract:
    """A versioned canonical schema."""

    schema_id: str
    columns: tuple[Spec, ...]
    namespace: str = "default"
    version: str = "1.0.0"
    display_name: str = ""
    description: str = ""
    primary_key: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    notes: dict = field(default_factory=dict, compare=False, hash=False)

    @classmethod
    def of(cls, data: dict) -> Contract:
        columns, notes = [], {}
        for c in data.get("columns", []):
            columns.append(Spec(str(c["name"]), c.get("data_type", "string"), bool(c.get("required", True)), bool(c.get("allow_null", False)), tuple(c.get("allowed_values") or ()), c.get("min_value"), c.get("max_value")))
            notes[c["name"]] = {k: c.get(k) for k in ("description", "example", "pattern")}
        return cls(data["schema_id"], tuple(columns), data.get("namespace") or "default", data.get("version", "1.0.0"), data.get("display_name", ""), data.get("description", ""), tuple(data.get("primary_key") or ()), tuple(sorted(data.get("tags") or ())), notes)

    def to_dict(self) -> dict:
        columns = [
            {"name": c.name, "data_type": c.data_type, "required": c.required, "allow_null": c.allow_null, "allowed_values": sorted(c.allowed_values) or None, "min_value": c.min_value, "max_value": c.max_value, **{k: v for k, v in (self.notes.get(c.name) or {}).items()}}
            for c in self.columns
        ]
        return {"schema_id": self.schema_id, "display_name": self.display_name, "version": self.version, "namespace": self.namespace, "description": self.description, "primary_key": list(self.primary_key), "tags": list(self.tags), "columns": columns}

    @property
    def column_names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def required_columns(self) -> list[str]:
        return [c.name for c in self.columns if c.required]


class Contracts:
    """Contracts by namespace and id; registering one again replaces it."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, str], Contract] = {}

    @classmethod
    def read(cls, path: str | Path) -> Contracts:
        """From {"schemas": […]} or a bare list; a missing file has none."""
        out = cls()
        try:
            data = json.loads(Path(path).read_text("utf-8"))
        except FileNotFoundError:
            return out
        for c in data["schemas"] if isinstance(data, dict) else data:
            out.register(Contract.of(c))
        return out

    def register(self, contract: Contract) -> None:
        self.known[contract.namespace, contract.schema_id] = contract

    def get(self, schema_id: str, namespace: str = "default") -> Contract | None:
        return self.known.get((namespace, schema_id))

    def resolve(self, schema_id: str | None, name: str | None, namespace: str | None = None) -> Contract | None:
        """By namespace and id, then by namespace and name, then by either in any namespace."""
        ns = namespace or "default"
        for key in (schema_id, name):
            if key and (found := self.get(key, ns)):
                return found
        return next((c for key in (schema_id, name) if key for c in self.known.values() if c.schema_id == key), None)
