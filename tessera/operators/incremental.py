"""What changed, what can be used again, what has expired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import values as V


def split(old: DataFrame, new: DataFrame, key: str = "path", mark: str = "mtime") -> DataFrame:
    """(key, state): new, changed, unchanged or deleted, by the mark of each file then and now."""
    j = old.select(key, F.col(mark).alias("_a")).join(new.select(key, F.col(mark).alias("_b")), key, "full_outer")
    state = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "deleted").when(F.col("_a") == F.col("_b"), "unchanged").otherwise("changed")
    return j.select(key, state.alias("state"))


def changed_paths(discovered: DataFrame, old: DataFrame, changes: DataFrame) -> DataFrame:
    """(path): files that came or went, and those that the change feed (status, path, old_path) names; a rename names both."""
    came = discovered.select("path").join(old.select("path"), "path", "left_anti")
    went = old.select("path").join(discovered.select("path"), "path", "left_anti")
    renamed = changes.where(F.col("status").startswith("R") & F.col("old_path").isNotNull()).select(F.col("old_path").alias("path"))
    return came.union(went).union(changes.select("path")).union(renamed).distinct()


def parse_changes(output: str) -> list[tuple[str, str, str | None]]:
    """(status, path, old_path) of a NUL-separated name-status listing; renames and copies have two paths."""
    parts, out, i = output.split("\0"), [], 0
    while i < len(parts) and parts[i]:
        status = parts[i][0]
        if status in "RC":
            out.append((status, parts[i + 2], parts[i + 1]))
            i += 3
        else:
            out.append((status, parts[i + 1], None))
            i += 2
    return out


def reusable(prior: DataFrame, wanted: DataFrame, changed: DataFrame, key: str = "vector_id", path: str = "path") -> DataFrame:
    """Prior rows that the new generation takes over: still wanted, and of a file that didn't change."""
    return prior.join(wanted.select(key), key, "left_semi").join(changed.select(path), path, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The new rows, and the old ones with other keys."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def deleted(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids.select(key), key, "left_anti")


def cache_split(files: DataFrame, cache: DataFrame, key: str = "file_hash") -> DataFrame:
    """files with `hit`, and the cached `result` where there is one."""
    return files.join(cache.select(key, F.col("result").alias("result"), F.lit(True).alias("_hit")), key, "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def by_source(nodes: DataFrame) -> DataFrame:
    """(source_file, ids): what a semantic cache keeps for each file."""
    return nodes.groupBy("source_file").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def expired(jobs: DataFrame, now: Column, ttl: int, final: tuple[str, ...] = ("completed", "failed")) -> DataFrame:
    """Finished jobs (status, completed_at) older than ttl seconds."""
    return jobs.where(F.col("status").isin(*final) & V.older_than(F.col("completed_at"), now, ttl))


def mismatches(expected: DataFrame, actual: DataFrame, key: str = "vector_id", check: str = "hash") -> DataFrame:
    """(key, problem) of a vector snapshot against what it should hold: missing, unexpected, empty, other content."""
    a = expected.select(key, F.col(check).alias("_want"))
    b = actual.select(key, F.col(check).alias("_have"), "document", "embedding")
    j = a.join(b, key, "full_outer")
    problem = (
        F.when(F.col("_have").isNull() & F.col("_want").isNotNull(), "missing").when(F.col("_want").isNull(), "unexpected")
        .when(F.coalesce(F.trim("document"), F.lit("")) == "", "empty document").when(F.coalesce(F.size("embedding"), F.lit(0)) == 0, "empty embedding")
        .when(F.col("_want") != F.col("_have"), "other content")
    )
    return j.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def can_reuse(meta: dict | None, *, schema: int, fingerprint: str, branch: str, commit: str, snapshot_ok: bool) -> str:
    """full, incremental or same: what a build has to do, given the metadata of the last one."""
    if not meta or meta.get("schema") != schema or meta.get("fingerprint") != fingerprint or meta.get("branch") != branch or not snapshot_ok:
        return "full"
    return "same" if meta.get("commit") == commit else "incremental"
