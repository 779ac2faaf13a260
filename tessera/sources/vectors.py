"""A vector collection as a Parquet table: reads by id, upserts, copies, deletes, searches.

Every change writes the whole new table beside the old one and then points at it (sources.store), so readers never see half
of a change. Rows: vector_id, embedding, document, file, slug, and whatever metadata come with them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import incremental, retrieval
from tessera.sources.store import Store


class VectorStore(Protocol):
    """What search needs of a collection; any other kind of store can stand in."""

    def rows(self) -> DataFrame: ...

    def by_ids(self, ids: DataFrame) -> DataFrame: ...

    def search(self, vector: list[float], k: int, where: Column | None = None) -> DataFrame: ...


@dataclass
class Collection:
    store: Store
    name: str

    def exists(self) -> bool:
        return self.store.current(self.name) is not None

    def rows(self) -> DataFrame:
        return self.store.read(self.name, "vectors")

    def ids(self) -> DataFrame:
        return self.rows().select("vector_id")

    def count(self) -> int:
        return self.rows().count() if self.exists() else 0

    def by_ids(self, ids: DataFrame) -> DataFrame:
        return self.rows().join(ids.select("vector_id"), "vector_id", "left_semi")

    def missing(self, ids: DataFrame) -> DataFrame:
        return ids.select("vector_id").join(self.ids(), "vector_id", "left_anti")

    def _replace(self, df: DataFrame) -> int:
        self.store.publish(self.name, {"vectors": df})
        return self.count()

    def upsert(self, new: DataFrame) -> int:
        """Rows by vector_id, the new ones winning; how many there are then."""
        return self._replace(incremental.upsert(self.rows(), new, "vector_id") if self.exists() else new)

    def copy_from(self, other: Collection, ids: DataFrame) -> int:
        """Rows of another collection by id, without embedding anew; ids that it lacks are left out."""
        return self.upsert(other.by_ids(ids))

    def update(self, metadata: DataFrame) -> int:
        """New values of the columns of `metadata`, by vector_id."""
        own = [c for c in metadata.columns if c != "vector_id"]
        renamed = metadata.select("vector_id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in own])
        j = self.rows().join(renamed, "vector_id", "left")
        for c in own:
            j = j.withColumn(c, F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)))
        return self._replace(j.drop("_hit", *[f"_new_{c}" for c in own]))

    def delete(self, where: Column) -> int:
        """Drop rows that fit; how many went."""
        before = self.count()
        return before - self._replace(self.rows().where(~F.coalesce(where, F.lit(False))))

    def delete_ids(self, ids: DataFrame) -> int:
        before = self.count()
        return before - self._replace(incremental.deleted(self.rows(), ids, "vector_id"))

    def delete_file(self, file: str) -> int:
        return self.delete(F.col("file") == file)

    def delete_slug(self, slug: str) -> int:
        return self.delete(F.col("slug") == slug)

    def drop(self, strict: bool = False) -> None:
        if not self.store.drop(self.name) and strict:
            raise FileNotFoundError(self.name)

    def search(self, vector: list[float], k: int, where: Column | None = None) -> DataFrame:
        return retrieval.dense(self.rows(), vector, k, key="vector_id", where=where)

    def validate(self, expected: DataFrame) -> DataFrame:
        return incremental.mismatches(expected, self.rows())


def approximate(vectors: DataFrame, query: list[float], k: int, *, buckets: float = 0.5, tables: int = 8, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, distance) of about the k nearest by cosine, from random-projection buckets of unit vectors."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    raw = vectors.select(F.col(key).alias("id"), array_to_vector(F.col(embedding).cast("array<double>")).alias("raw"))
    unit = Normalizer(inputCol="raw", outputCol="v").transform(raw)
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=buckets, numHashTables=tables, seed=7).fit(unit)
    size = sum(x * x for x in query) ** 0.5 or 1.0
    near = model.approxNearestNeighbors(unit, Vectors.dense([x / size for x in query]), k)
    return near.select("id", (F.col("distCol") ** 2 / 2).alias("distance")).orderBy("distance", "id")


Embedder = Callable[[list[str]], list[list[float]]]
