"""The driver's side: configuration, path guard, budgets, job states, manifests, progress and telemetry lines."""

from __future__ import annotations

import json
import math
import os
import shutil
import threading
import time
from collections import deque
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from enum import Enum
from pathlib import Path


class ErrorCode(str, Enum):
    CONFIG = "CONFIG_ERROR"
    SCHEMA = "SCHEMA_ERROR"
    IO = "IO_ERROR"
    STATE = "STATE_ERROR"


class EngineError(RuntimeError):
    """An error with a code and what it is about."""

    def __init__(self, code: ErrorCode, message: str, context: dict | None = None):
        super().__init__(f"[{code.value}] {message}")
        self.code, self.context = code, context or {}


# Configuration


@dataclass(frozen=True)
class Limits:
    memory_mb: int | None = None
    spill_mb: int | None = None
    max_workers: int | None = None
    temp_dir: str = "artifacts/tmp"


@dataclass(frozen=True)
class Profile:
    description: str
    block_size: int
    min_gap_lines: int
    max_parallel_files: int
    sample_values_cap: int
    writer_chunk_rows: int
    resource_limits: Limits = field(default_factory=Limits)


@dataclass(frozen=True)
class Config:
    profile: Profile
    encoding: str = "utf-8"
    error_policy: str = "fail-fast"
    synonym_dictionary: str = "storage/synonyms.json"
    canonical_schema_path: str = "storage/canonical_schemas.json"
    version: int = 1


#: The profiles that are there without a file (fixed values).
PROFILES = {
    "low_memory": Profile("2-core CPU, <=2 GB RAM, spinning disk", 1000, 200, 1, 24, 25_000, Limits(1536, 4096, 2)),
    "workstation": Profile("8-core CPU, >=16 GB RAM, SSD", 10_000, 100, 4, 64, 100_000, Limits(8192, 16384, 4)),
}
POLICIES = {"fail-fast": "fail-fast", "strict": "fail-fast", "replace": "replace"}


def _bad(what: str) -> EngineError:
    return EngineError(ErrorCode.CONFIG, what)


def _positive(value: object, name: str) -> int:
    try:
        number = int(value)  # type: ignore[call-overload]
    except (TypeError, ValueError):
        raise _bad(f"{name} must be an integer") from None
    if number <= 0:
        raise _bad(f"{name} must be greater than zero")
    return number


def _text(value: object, name: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise _bad(f"{name} must be a non-empty string")
    return value.strip()


def _profile(name: str, data: object) -> Profile:
    if not isinstance(data, Mapping):
        raise _bad(f"profile {name} must be an object")
    numbers = [f.name for f in fields(Profile) if f.name not in ("description", "resource_limits")]
    if missing := [k for k in ("description", *numbers) if k not in data]:
        raise _bad(f"profile {name} misses {', '.join(missing)}")
    limits = data.get("resource_limits") or {}
    if not isinstance(limits, Mapping):
        raise _bad(f"profiles.{name}.resource_limits must be an object")
    own = {k: None if limits.get(k) is None else _positive(limits[k], f"profiles.{name}.{k}") for k in ("memory_mb", "spill_mb", "max_workers")}
    temp = _text(limits.get("temp_dir", Limits.temp_dir), f"profiles.{name}.temp_dir")
    return Profile(_text(data["description"], f"profiles.{name}.description"), **{k: _positive(data[k], f"profiles.{name}.{k}") for k in numbers}, resource_limits=Limits(**own, temp_dir=temp))


def load_config(profile: str = "low_memory", path: str | None = None, overrides: Mapping[str, Mapping] | None = None) -> Config:
    """The configuration of a JSON file, or the built-in one; overrides hold `global` and `profile` entries."""
    changed = overrides or {}
    if unknown := set(changed) - {"global", "profile"}:
        raise _bad(f"unknown overrides: {', '.join(sorted(unknown))}")
    if path is None:
        from dataclasses import asdict

        raw: object = {"version": 1, "global": {}, "profiles": {k: asdict(p) for k, p in PROFILES.items()}}
    else:
        try:
            raw = json.loads(Path(path).read_text("utf-8"))
        except FileNotFoundError:
            raise _bad(f"{path} isn't there") from None
        except json.JSONDecodeError as e:
            raise _bad(f"{path} isn't JSON: {e}") from None
    if not isinstance(raw, Mapping) or not isinstance(raw.get("global"), Mapping) or not isinstance(raw.get("profiles"), Mapping) or not raw["profiles"]:
        raise _bad("a configuration needs `global` and `profiles`")
    found = {k: _profile(k, {**p, **(changed.get("profile") or {})} if k == profile and isinstance(p, Mapping) else p) for k, p in raw["profiles"].items()}
    if profile not in found:
        raise _bad(f"there is no profile {profile}")
    top = {**raw["global"], **(changed.get("global") or {})}
    policy = _text(top.get("error_policy", Config.error_policy), "global.error_policy").lower()
    if policy not in POLICIES:
        raise _bad(f"error_policy {policy} is none of {', '.join(sorted(POLICIES))}")
    rest = {k: _text(top.get(k, getattr(Config, k)), f"global.{k}") for k in ("encoding", "synonym_dictionary", "canonical_schema_path")}
    return Config(found[profile], error_policy=POLICIES[policy], version=_positive(raw.get("version"), "version"), **rest)


def error_mode(policy: str) -> str:
    """What a reader does with bytes that don't decode."""
    return "strict" if POLICIES.get(policy.lower()) == "fail-fast" else "replace"


# Paths


class Sandbox:
    """Resolves paths under a root; others only if they are on the list."""

    def __init__(self, root: str | os.PathLike, allowed: tuple[str | os.PathLike, ...] = ()):
        self.root, self.allowed = Path(root).expanduser().resolve(), tuple(Path(p).expanduser().resolve() for p in allowed)

    def resolve(self, *parts: str | os.PathLike, must_exist: bool = False) -> Path:
        path = self.root.joinpath(*parts).expanduser().resolve()
        if not any(path.is_relative_to(p) for p in (self.root, *self.allowed)):
            raise EngineError(ErrorCode.STATE, f"{path} is outside the sandbox", {"root": str(self.root)})
        if must_exist and not path.exists():
            raise EngineError(ErrorCode.STATE, f"{path} isn't there", {"root": str(self.root)})
        return path

    def ensure_dir(self, *parts: str | os.PathLike) -> Path:
        path = self.resolve(*parts)
        path.mkdir(parents=True, exist_ok=True)
        return path

    def child(self, *parts: str | os.PathLike) -> Sandbox:
        return Sandbox(self.resolve(*parts), self.allowed)


def segment(name: str) -> str:
    """A name as a folder's: what isn't a letter or digit is a dash."""
    return "".join(c if c.isalnum() else "-" for c in name).strip("-") or "segment"


# Budgets


class OverBudget(RuntimeError):
    """A reservation that the limits don't allow."""


class Budget:
    """Reservations of memory, disk and workers, and a job's scratch folders."""

    def __init__(self, limits: Limits | None = None):
        self.limits = limits or Limits()
        self.used = {"memory_mb": 0, "disk_mb": 0, "workers": 0}
        self._most = {"memory_mb": self.limits.memory_mb, "disk_mb": self.limits.spill_mb, "workers": self.limits.max_workers}
        self._lock = threading.Lock()
        self.root = Path(self.limits.temp_dir).expanduser()

    def plan_workers(self, asked: int) -> int:
        return max(1, min(max(1, asked), self.limits.max_workers or max(1, asked)))

    def available(self, what: str) -> int | None:
        return None if self._most[what] is None else max(0, self._most[what] - self.used[what])

    def reserve(self, **amounts: int) -> Lease:
        asked = {k: max(0, int(v)) for k, v in amounts.items()}
        with self._lock:
            for k, v in asked.items():
                if self._most[k] is not None and self.used[k] + v > self._most[k]:
                    raise OverBudget(f"{k}: {v} asked for, {self.available(k)} left")
            for k, v in asked.items():
                self.used[k] += v
        return Lease(self, asked)

    def release(self, amounts: dict[str, int]) -> None:
        with self._lock:
            for k, v in amounts.items():
                self.used[k] = max(0, self.used[k] - v)

    @staticmethod
    def megabytes(size: int) -> int:
        return max(0, math.ceil(size / (1 << 20)))

    def scratch_dir(self, job_id: str, *parts: str) -> Path:
        path = self.root.joinpath(segment(job_id or "job"), *(segment(p) for p in parts if p))
        path.mkdir(parents=True, exist_ok=True)
        return path

    def cleanup(self, job_id: str) -> None:
        shutil.rmtree(self.root / segment(job_id or "job"), ignore_errors=True)


class Lease:
    """A reservation; releasing it twice does nothing more."""

    def __init__(self, budget: Budget, amounts: dict[str, int]):
        self._budget, self._amounts = budget, amounts

    def release(self) -> None:
        self._budget.release(self._amounts)
        self._amounts = {}

    def __enter__(self) -> Lease:
        return self

    def __exit__(self, *_: object) -> None:
        self.release()


class Throttle:
    """How many tasks to run at once, by the mean of the last durations."""

    def __init__(self, most: int, least: int = 1, slow: float = 4.0, fast: float = 1.5, window: int = 8):
        self.most, self.least, self.slow, self.fast = most, least, slow, fast
        self.seen: deque[float] = deque(maxlen=window)
        self.limit = most

    def report(self, seconds: float) -> int:
        self.seen.append(seconds)
        mean = sum(self.seen) / len(self.seen)
        step = -1 if mean > self.slow else 1 if mean < self.fast else 0
        self.limit = min(self.most, max(self.least, self.limit + step))
        return self.limit


# Jobs


class JobState(str, Enum):
    PENDING = "PENDING"
    ANALYZING = "ANALYZING"
    MAPPING = "MAPPING"
    MATERIALIZING = "MATERIALIZING"
    VALIDATING = "VALIDATING"
    DONE = "DONE"
    FAILED = "FAILED"
    CANCELLED = "CANCELLED"


class Job:
    """A job's state; every change is an event, kept as a line of JSON if there is a log."""

    _order = (JobState.PENDING, JobState.ANALYZING, JobState.MAPPING, JobState.MATERIALIZING, JobState.VALIDATING, JobState.DONE)

    def __init__(self, job_id: str, log: str | os.PathLike | None = None, metadata: dict | None = None):
        self.job_id, self.log, self.metadata = job_id, log, metadata or {}
        self.state = JobState.PENDING
        self._record("job registered")

    def transition(self, to: JobState, detail: str | None = None) -> None:
        """Forward, also past states; to FAILED or CANCELLED from any that isn't final; to the same state nothing happens."""
        if to == self.state:
            return
        final = self.state in (JobState.DONE, JobState.FAILED, JobState.CANCELLED)
        if final or (to in self._order and self._order.index(to) < self._order.index(self.state)):
            raise ValueError(f"no way from {self.state.value} to {to.value}")
        self.state = to
        self._record(detail)

    def fail(self, detail: str | None = None) -> None:
        self.state = JobState.FAILED
        self._record(detail)

    def cancel(self, detail: str | None = None) -> None:
        self.state = JobState.CANCELLED
        self._record(detail)

    def _record(self, detail: str | None) -> None:
        if self.log:
            append_line(self.log, {"job_id": self.job_id, "state": self.state.value, "detail": detail, "metadata": self.metadata, "timestamp": time.time()})


class Manifests:
    """What a job's phases have finished, a JSON file each; a file that is missing or broken has nothing."""

    def __init__(self, base: str | os.PathLike):
        self.base = Path(base)

    def _path(self, job_id: str, phase: str) -> Path:
        return self.base / phase / f"{job_id}.json"

    def load(self, job_id: str, phase: str) -> dict:
        try:
            return json.loads(self._path(job_id, phase).read_text("utf-8"))
        except (OSError, json.JSONDecodeError):
            return {}

    def save(self, job_id: str, phase: str, data: dict) -> None:
        path = self._path(job_id, phase)
        path.parent.mkdir(parents=True, exist_ok=True)
        part = path.with_suffix(".part")
        part.write_text(json.dumps({**data, "updated_at": time.time()}), "utf-8")
        part.replace(path)

    def clear(self, job_id: str, phase: str) -> None:
        self._path(job_id, phase).unlink(missing_ok=True)


def append_line(path: str | os.PathLike, data: dict) -> None:
    """Adds a line of JSON to a log: progress, telemetry, benchmarks, audit events."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(data, ensure_ascii=False, default=str) + "\n")


def progress(done: int, total: int, seconds: float) -> dict:
    """Rate and time left; totals of none, or of over ten million, are estimates that aren't told."""
    known = total if 0 < total <= 10_000_000 else 0
    rate = done / seconds if done > 0 and seconds > 0 else None
    return {"processed_rows": done, "total_rows": known, "rows_per_second": rate, "eta_seconds": max(known - done, 0) / rate if known and rate else None}


def throughput(rows: int, seconds: float) -> float:
    return rows / seconds if seconds > 0 else float(rows)
