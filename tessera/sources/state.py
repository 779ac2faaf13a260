"""State beside the tables: extraction cache, result cache, jobs, build locks, manifests, run logs, reports."""

from __future__ import annotations

import contextlib
import fcntl
import json
import os
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import values as V
from tessera.operators import extract, incremental

CACHE_VERSION = 1


def cached_extraction(files: DataFrame, cache: DataFrame | None, parse: Callable[[DataFrame], DataFrame] = extract.extract) -> tuple[DataFrame, DataFrame]:
    """(rows, cache) of files (path, text): rows of unchanged files come from the cache, and only the others are parsed.

    The cache is the rows with their file's hash; a hit is anchored to the path that the file has now."""
    hashed = files.withColumn("file_hash", V.file_hash(CACHE_VERSION, F.col("text"), F.col("path")))
    if cache is None:
        new, old = hashed, None
    else:
        known = cache.select("file_hash").distinct()
        new = hashed.join(known, "file_hash", "left_anti")
        old = cache.join(hashed.select("file_hash", F.col("path").alias("_now")), "file_hash").withColumn("source_file", V.reanchored(F.col("source_file"), F.col("_now"))).drop("_now")
    made = parse(new).join(new.select(F.col("path").alias("source_file"), "file_hash"), "source_file")
    every = made if old is None else made.unionByName(old)
    return every.drop("file_hash"), every


@dataclass
class ResultCache:
    """Replies of the driver by query, for `ttl` seconds and as long as the index's token stays the same."""

    token: Callable[[], str]
    ttl: float = 300.0
    clock: Callable[[], float] = time.monotonic
    held: dict[str, tuple[float, str, list[dict]]] = field(default_factory=dict)

    def get(self, query: str, repos: list[str] | None, top_k: int, search: Callable[[], DataFrame]) -> list[dict]:
        now, token = self.clock(), self.token()
        key = V.cache_key(query, repos, top_k, token)
        if key in self.held and now - self.held[key][0] < self.ttl:
            return self.held[key][2]
        rows = [r.asDict(recursive=True) for r in search().collect()]  # at most top_k
        if self.token() == token:
            self.held[key] = (now, token, rows)
        return rows

    def invalidate(self, slug: str) -> int:
        gone = [k for k, (_, _, rows) in self.held.items() if any(r.get("slug") == slug for r in rows)]
        for k in gone:
            del self.held[k]
        return len(gone)


@dataclass
class Jobs:
    """Build jobs by slug; one at a time for a slug, and at most `most` slugs in flight."""

    most: int = 5
    ttl: float = 3600.0
    clock: Callable[[], float] = time.time
    table: dict[str, dict] = field(default_factory=dict)

    def submit(self, slug: str) -> dict:
        active = [s for s, j in self.table.items() if j["status"] in ("pending", "running")]
        if slug in active or len(active) >= self.most:
            raise RuntimeError(f"{slug} is being built" if slug in active else f"{self.most} builds are in flight")
        self.table[slug] = {"slug": slug, "status": "pending", "started_at": self.clock(), "completed_at": None}
        return self.table[slug]

    def run(self, slug: str, work: Callable[[], str]) -> dict:
        job = self.table[slug]
        job["status"] = "running"
        try:
            job["result"], job["status"] = work(), "completed"
        except Exception as e:
            job["error"], job["status"] = str(e), "failed"
        job["completed_at"] = self.clock()
        return job

    def status(self, slug: str) -> dict | None:
        self.evict()
        return self.table.get(slug)

    def evict(self) -> None:
        for s in [s for s, j in self.table.items() if j["completed_at"] is not None and self.clock() - j["completed_at"] > self.ttl]:
            del self.table[s]

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(j["slug"], j["status"], j["started_at"], j["completed_at"]) for j in self.table.values()]
        return spark.createDataFrame(rows, "slug string, status string, started_at double, completed_at double")


@contextlib.contextmanager
def build_lock(folder: str, slug: str) -> Iterator[None]:
    """One build of a slug at a time, across the driver's processes."""
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, f".{slug}.lock"), "w") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        yield


def manifest(files: DataFrame) -> DataFrame:
    """(path, mtime): what a later scan is compared with (operators.incremental.split)."""
    return files.select("path", "mtime")


def changed_since(files: DataFrame, old: DataFrame) -> DataFrame:
    return incremental.split(old, manifest(files))


def append_runs(runs: list[dict], path: str) -> None:
    """Rows at the end of a JSONL log, flushed one by one."""
    with open(path, "a") as f:
        for r in runs:
            f.write(json.dumps(r, sort_keys=True) + "\n")
            f.flush()


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def report(profile: DataFrame, title: str = "Profile") -> str:
    """A profile of few rows as a Markdown table."""
    rows = profile.orderBy(profile.columns[0]).collect()
    said = lambda v: f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = [f"# {title}", "", "| " + " | ".join(profile.columns) + " |", "|" + "---|" * len(profile.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(said, r)) + " |" for r in rows]) + "\n"
