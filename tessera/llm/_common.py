"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of an Arrow batch, about; a longer text has a batch of its own.
BATCH_BYTES = 4 << 20
#: Bytes of text that a numpy step works on at once.
CHUNK_BYTES = 1 << 20
#: Tables that were written between steps and not yet deleted.
WRITTEN: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: str | Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % m


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where it is unset, a folder of our own on a single machine, as in
    tests, and an error on a cluster, whose executors would each write to their own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it again. `release` deletes it, at the latest when
    the driver's Python ends, as what is made of it is evaluated later."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    WRITTEN.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete the tables written between steps from the `since`-th on, but for those that `keep` reads."""
    kept = {f.rsplit("/", 2)[-2] for f in keep.inputFiles()} if keep is not None else set()
    stay = [w for w in WRITTEN[since:] if w[1].rsplit("/", 1)[-1] in kept]
    for spark, path in WRITTEN[since:]:
        if (spark, path) not in stay:
            delete(spark, path)
    WRITTEN[since:] = stay


@atexit.register
def _release_all() -> None:
    with contextlib.suppress(Py4JError, OSError, AttributeError):  # the session has ended before, with its folder or without
        release()


#: Keys of rows that are broadcast, at most: some 64 MB.
BROADCAST_KEYS = 1_000_000


def row_key(docs: DataFrame, doc_id: str, text: str) -> Column:
    """What a row is known by where ids may repeat: its id and a hash of its text."""
    return F.struct(docs[doc_id].alias("id"), F.xxhash64(docs[text].cast("string")).alias("h"))


def keyed_join(docs: DataFrame, keys: DataFrame, doc_id: str, text: str, how: str, most: int | None = None) -> DataFrame:
    """The rows of docs whose row_key is (left_semi) or is not (left_anti) in the column `_key` of keys, a written table. Up to
    `most` of them are counted and broadcast, so that no document is shuffled; more are joined by a shuffle."""
    most = BROADCAST_KEYS if most is None else most
    side = keys.select(F.col("_key.id").alias("_key_id"), F.col("_key.h").alias("_key_h"))
    if side.limit(most + 1).count() <= most:
        side = F.broadcast(side)
    return docs.join(side, (F.xxhash64(docs[text].cast("string")) == side["_key_h"]) & docs[doc_id].eqNullSafe(side["_key_id"]), how)


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of the batches that Python workers get, as texts may be very long. Spark reads this when a plan runs, so
    it is set for the session, where it is larger or none."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower().rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def id_type(docs: DataFrame, *columns: str) -> str:
    """The DDL of these columns of docs."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)


def whole_groups(batches: Iterator[pa.RecordBatch], group: str, least: int) -> Iterator[pa.Table]:
    """Batches sorted by the column `group`, as tables of `least` rows or more that hold whole groups."""
    held, size, check = [], 0, least
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= check:
            t = pa.Table.from_batches(held).combine_chunks()
            g = t.column(group).to_numpy()
            cut = int(np.searchsorted(g, g[-1]))
            if cut:
                yield t.slice(0, cut)
                t = t.slice(cut)
            held, size = t.to_batches(), t.num_rows
            check = least if cut and size < least else 2 * size
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def power_floor(counts: DataFrame, n: str, most: int) -> int:
    """The least power of two such that at most `most` rows of counts have n of it or more; 1 if all rows may."""
    found = {int(r["e"]): r["count"] for r in counts.groupBy(F.floor(F.log2(n) + 1e-9).alias("e")).count().collect()}
    floor, total = 1 << (max(found, default=0) + 1), 0
    for e in sorted(found, reverse=True):
        total += found[e]
        if total > most:
            return floor
        floor = 1 << e
    return 1


def chunks_of(texts: list, limit: int = CHUNK_BYTES):
    """Index ranges of whole texts with about `limit` bytes together, at least one text each."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def merge_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sum counts by key; keys come back sorted."""
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    keys, n = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    if not len(keys):
        return keys, n
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(n, first)


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in sorted_keys, -1 where absent."""
    if not len(sorted_keys):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)
