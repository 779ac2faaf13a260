"""Sharding by size-tiered compaction, with a versioned manifest.

A store is a folder: `data/` has immutable Parquet files (runs), `manifest/` has one JSON file for each version, which lists the
runs that make up the table then. `append` writes what arrives as small runs, one for each of its partitions. `compact` puts
the runs of like size (a tier is a power of `fanout` in bytes, below `target`) together: a tier with `fanout` runs or more is
read and written again as files of about `target` bytes, or as one file if it has less, and so moves up a tier; this goes on
until no tier is full. A tier's runs are like in size, so merging neighbours without a shuffle (coalesce) gives even files; a task
streams a target's worth of rows at most. `final` also merges what is left below the target.

A version is committed by linking its manifest under the final name, which fails where that exists: on a local file system a hard
link, elsewhere FileContext's rename without overwriting, which a name node does as one step. So readers see the old version or the
new one, and of two writers one fails and can try again. Runs that no version lists (of a writer that failed) are never
read. `vacuum` deletes old versions, files that only they list, and files that no version ever listed once they are older than a
grace period, as a writer may be about to commit them. A manifest holds the whole list of a version's runs, some hundred bytes each.

Edge cases: an empty arrival adds a version but no run, nor does an empty partition. Rows are never changed or reordered between
versions, nor dropped; nulls, repeated rows and extra columns are kept as they are. A store whose versions have no rows reads as an
empty table of the schema that arrived last; a store without a version gives an error that says so.
"""

from __future__ import annotations

import json
import math
import os
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, *, target: int = 128 << 20, fanout: int = 4) -> None:
        self.spark, self.path, self.target, self.fanout = spark, path.rstrip("/"), target, fanout
        self.jvm = spark._jvm
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        folder = self._path("manifest")
        if not self.fs.exists(folder):
            return []
        return sorted(int(f.getPath().getName()[1:-5]) for f in self.fs.listStatus(folder) if f.getPath().getName().startswith("v"))

    def manifest(self, version: int | None = None) -> dict:
        """The runs of a version (the latest if none is named): path under the store, bytes, tier."""
        if version is None:
            known = self.versions()
            if not known:
                return {"version": 0, "schema": None, "runs": []}
            version = known[-1]
        stream = self.fs.open(self._path(f"manifest/v{version:08d}.json"))
        try:
            reader = self.jvm.java.io.BufferedReader(self.jvm.java.io.InputStreamReader(stream, "UTF-8"))
            return json.loads("\n".join(iter(reader.readLine, None)))
        finally:
            stream.close()

    def _link(self, draft, final) -> bool:
        """The draft under its final name, in one step; false where that name is taken."""
        if self.fs.getUri().getScheme() == "file":
            try:
                os.link(draft.toUri().getPath(), final.toUri().getPath())
            except FileExistsError:
                return False
            return True
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark._sc._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(context.makeQualified(draft), context.makeQualified(final), none)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def _commit(self, was: int, runs: list[dict], schema: str | None) -> int:
        version = was + 1
        draft, final = self._path(f"manifest/.{uuid.uuid4().hex}"), self._path(f"manifest/v{version:08d}.json")
        out = self.fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps({"version": version, "schema": schema, "runs": runs}).encode()))
        finally:
            out.close()
        done = self._link(draft, final)
        self.fs.delete(draft, False)
        if not done:
            raise RuntimeError(f"version {version} was committed by another writer")
        return version

    def tier(self, size: int) -> int:
        """Runs of target size and beyond are done: the highest tier."""
        top = max(1, math.ceil(math.log(max(2, self.target / 4096), self.fanout)))
        return top if size >= 0.5 * self.target else min(top - 1, int(math.log(max(1.0, size / 4096), self.fanout)))

    def done(self, run: dict) -> bool:
        return run["bytes"] >= 0.5 * self.target

    def _write(self, df: DataFrame) -> list[dict]:
        name = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return self._runs(name, df.schema)

    def _runs(self, name: str, schema: StructType) -> list[dict]:
        """The files of a folder that was just written, without those that have no rows, which are deleted."""
        if not self.fs.exists(self._path(name)):
            return []
        files = [f for f in self.fs.listStatus(self._path(name)) if f.getPath().getName().startswith("part-")]
        if not files:
            return []
        read = self.spark.read.schema(schema).parquet(f"{self.path}/{name}").select(F.col("_metadata.file_name").alias("f"))
        rows = {r["f"]: r["count"] for r in read.groupBy("f").count().collect()}
        out = []
        for f in sorted(files, key=lambda f: f.getPath().getName()):
            file, size = f.getPath().getName(), int(f.getLen())
            if rows.get(file):
                out.append({"path": f"{name}/{file}", "bytes": size, "rows": rows[file], "tier": self.tier(size)})
            else:
                self.fs.delete(f.getPath(), False)
        return out

    def append(self, df: DataFrame) -> int:
        """Commit what arrives as new runs; the version."""
        return self.append_all(df, None, 1)[0]

    def append_all(self, df: DataFrame, key: str | None, arrivals: int, between=lambda k, version: None) -> list[int]:
        """Several arrivals from one scan of df, dealt by a hash of `key`, each committed as a version of its own; `between` is
        called after each with its number and version. The versions."""
        name = f"data/{uuid.uuid4().hex}"
        if arrivals == 1:
            df.write.parquet(f"{self.path}/{name}")
            folders = [name]
        else:
            mark = "_arrival"
            while mark in df.columns:
                mark = "_" + mark
            df.withColumn(mark, F.pmod(F.xxhash64(key), F.lit(arrivals)).cast("int")).write.partitionBy(mark).parquet(f"{self.path}/{name}")
            folders = [f"{name}-{k}" for k in range(arrivals)]
            for k, to in enumerate(folders):  # a name with = in it would be read as a column
                at = self._path(f"{name}/{mark}={k}")
                if self.fs.exists(at):
                    self.fs.rename(at, self._path(to))
            self.fs.delete(self._path(name), True)
        out = []
        for k, folder in enumerate(folders):
            made, now = self._runs(folder, df.schema), self.manifest()
            out.append(self._commit(now["version"], now["runs"] + made, df.schema.json()))
            between(k, out[-1])
        return out

    def _merge(self, runs: list[dict], schema: str | None) -> list[dict]:
        size = sum(r["bytes"] for r in runs)
        return self._write(self._rows(runs, schema).coalesce(max(1, round(size / self.target))))

    def _rows(self, runs: list[dict], schema: str | None) -> DataFrame:
        if not schema:
            raise ValueError(f"no runs in {self.path}")
        kind = StructType.fromJson(json.loads(schema))
        if not runs:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[f"{self.path}/{r['path']}" for r in runs])

    def compact(self, final: bool = False) -> int:
        """Merge full tiers, lowest first, until none is; one commit. `final` merges all runs below the target as well."""
        now = self.manifest()
        runs, changed, between = now["runs"], False, set()
        while True:
            tiers: dict[int, list[dict]] = {}
            for r in runs:
                if not self.done(r):
                    tiers.setdefault(r["tier"], []).append(r)
            full = [t for t in sorted(tiers) if len(tiers[t]) >= self.fanout]
            if not full:
                break
            gone = {r["path"] for r in tiers[full[0]]}
            made = self._merge(tiers[full[0]], now["schema"])
            between |= {r["path"] for r in made}
            runs, changed = [r for r in runs if r["path"] not in gone] + made, True
        small = [r for r in runs if not self.done(r)]
        if final and len(small) > 1:
            gone = {r["path"] for r in small}
            runs, changed = [r for r in runs if r["path"] not in gone] + self._merge(small, now["schema"]), True
        if not changed:
            return now["version"]
        version = self._commit(now["version"], runs, now["schema"])
        listed = {r["path"] for r in runs}
        for p in between - listed:  # merged again before any version had them
            self.fs.delete(self._path(p), False)
        return version

    def read(self, version: int | None = None) -> DataFrame:
        found = self.manifest(version)
        return self._rows(found["runs"], found["schema"])

    def assignments(self, columns: list[str], version: int | None = None) -> DataFrame:
        """These columns of a version's rows, with shard (its number in the manifest), shard_bytes, and version."""
        found = self.manifest(version)
        rows = self._rows(found["runs"], found["schema"])
        if not found["runs"]:
            return rows.select(*columns, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("shard_bytes"), F.lit(found["version"]).alias("version"))
        names = [(r["path"].split("/")[-2] + "/" + r["path"].split("/")[-1], i, r["bytes"]) for i, r in enumerate(found["runs"])]
        listed = self.spark.createDataFrame(names, "_run string, shard int, shard_bytes long")
        path = F.col("_metadata.file_path")
        rows = rows.select(*columns, F.concat_ws("/", F.element_at(F.split(path, "/"), -2), F.element_at(F.split(path, "/"), -1)).alias("_run"))
        return rows.join(listed, "_run").drop("_run").withColumn("version", F.lit(found["version"]))

    def vacuum(self, versions: list[int], grace_seconds: float = 3600.0) -> int:
        """Delete these versions, the files that only they list, and files older than the grace period that no version lists or
        listed; the number of data files deleted."""
        gone = set(versions)
        listed = {r["path"] for v in self.versions() if v not in gone for r in self.manifest(v)["runs"]}
        only = {r["path"] for v in self.versions() if v in gone for r in self.manifest(v)["runs"]} - listed
        for v in self.versions():
            if v in gone:
                self.fs.delete(self._path(f"manifest/v{v:08d}.json"), False)
        before = (time.time() - grace_seconds) * 1000
        for folder in (f for f in self.fs.listStatus(self._path("data")) if f.isDirectory()) if self.fs.exists(self._path("data")) else ():
            files = [f for f in self.fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-") or f.isDirectory()]
            for f in files:
                name = f"data/{folder.getPath().getName()}/{f.getPath().getName()}"
                if name not in listed and name not in only and f.getModificationTime() < before:
                    only.add(name)
        for p in sorted(only):
            self.fs.delete(self._path(p), True)
        for f in self.fs.listStatus(self._path("manifest")) if self.fs.exists(self._path("manifest")) else ():
            if f.getPath().getName().startswith(".") and not f.getPath().getName().endswith(".crc") and f.getModificationTime() < before:
                self.fs.delete(f.getPath(), False)
        return len(only)


def shard(docs: DataFrame, path: str, *, arrivals: int = 1, key: str = "doc_id", target: int = 128 << 20, fanout: int = 4) -> ShardStore:
    """A store at path with the rows of docs, appended in `arrivals` parts by a hash of `key` and compacted after each. Versions
    that this call made and replaced are vacuumed, as no reader has them; those that were there before stay."""
    store = ShardStore(docs.sparkSession, path, target=target, fanout=fanout)
    made: list[int] = []

    def compacted(k: int, version: int) -> None:
        made.append(version)
        last = store.compact(final=k == arrivals - 1)
        if last != version:
            made.append(last)
        store.vacuum(made[:-1])
        del made[:-1]

    store.append_all(docs, key, arrivals, compacted)
    return store
