"""Approximate nearest neighbours by collision counting over single projections.

Each of `projections` random lines gives every vector one number. A block of vectors keeps, for each line, these numbers sorted
and cut into `cells` runs of equal size, and for each cut a bitmap of the vectors below it. A query opens on every line a
window about its own number; the vectors in it are the difference of two bitmaps, and a vector's collisions are the lines on
which it lies inside, counted for all vectors at once by bitwise adders. A vector with collisions on `threshold` of the lines is verified by
its exact inner product. Windows start at a width that fits the block's own vectors and widen together by virtual rehashing (the
arrays stay as they are, other cuts of them are read) until a query is done.

A query is done when its windows are so wide that a vector as near as its k-th best one so far would have passed the threshold
with the probability `sure`: projections of a difference of length d are normal with deviation d, so that width is a
multiple of d, and nearer vectors pass more surely. How many vectors are verified thus depends on the data, and on nothing else: few
where neighbours stand out, more where all are about as far. A query whose windows hold a whole block has verified all of it.

The measure is the largest inner product. It becomes a distance by one more coordinate, sqrt(M^2 - |x|^2) with M the
greatest norm, and queries of norm M (their direction alone counts), so nearest is largest product for vectors of any norms.

Every row is in the index and no row is sampled. Equal vectors are kept k + 1 times at most before the search, by the
smallest ids, which is exact: no more of them can be in a result. Queries and vectors meet in blocks of at most about
`block` vectors and `query_block` queries, so a task's memory has a bound and any task can be run again by itself.

Edge cases: vectors null, zero, or with a null or non-finite component take no part, nor do those of another length than
most have (of lengths as common, the smallest); a null id takes no part. Rows that repeat a vec_id are candidates of one
id, and the better is listed; the caps of k + 1 count ids. Ties go to the smaller vec_id. An empty table gives an empty result.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm._common import materialize

PROJECTIONS, CELLS, THRESHOLD, SURE = 192, 64, 0.5, 0.9
#: Vectors of a block that tell how wide its first windows are.
PROBES = 16
#: Queries that are counted for together.
TOGETHER = 16


def width_per_distance(projections: int, threshold: float, sure: float) -> float:
    """Half the width of windows, for a distance of 1, at which the collisions reach the threshold with the probability `sure`."""
    normal, p = NormalDist(), threshold
    for _ in range(50):  # the chance of a collision on one line that leaves so many deviations above the threshold
        p = min(1 - 1e-9, threshold + normal.inv_cdf(sure) * (p * (1 - p) / projections) ** 0.5)
    return normal.inv_cdf((1 + p) / 2)


class Collisions:
    """Counts of bitmaps by bitwise adders: `planes` has a bitmap for each binary digit."""

    def __init__(self) -> None:
        self.planes: list[np.ndarray] = []
        self.waiting: list[np.ndarray | None] = []

    def add(self, x: np.ndarray) -> None:
        digit = 0
        while True:
            if digit == len(self.planes):
                self.planes.append(np.zeros_like(x))
                self.waiting.append(None)
            other = self.waiting[digit]
            if other is None:
                self.waiting[digit] = x
                return
            self.waiting[digit] = None
            odd = other ^ x
            other &= x
            carry = odd & self.planes[digit]
            carry |= other
            self.planes[digit] ^= odd
            x, digit = carry, digit + 1

    def at_least(self, n: int) -> np.ndarray:
        """The bitmap of those counted n times or more."""
        for digit in range(len(self.planes)):
            x, self.waiting[digit], d = self.waiting[digit], None, digit
            while x is not None:
                if d == len(self.planes):
                    self.planes.append(np.zeros_like(x))
                    self.waiting.append(None)
                carry = self.planes[d] & x
                self.planes[d] ^= x
                x, d = (carry if carry.any() else None), d + 1
        if n >= 1 << len(self.planes):
            return np.zeros_like(self.planes[0])
        more, equal = np.zeros_like(self.planes[0]), ~np.zeros_like(self.planes[0])
        for digit in range(len(self.planes) - 1, -1, -1):
            if n >> digit & 1:
                equal &= self.planes[digit]
            else:
                more |= equal & self.planes[digit]
                equal &= ~self.planes[digit]
        return more | equal


class Index:
    """The sorted projections of a block of vectors, as bitmaps of those below each cut."""

    def __init__(self, vectors: np.ndarray, greatest: float, projections: int = PROJECTIONS, seed: int = 11, cells: int = CELLS, threshold: float = THRESHOLD, sure: float = SURE, k: int = 21) -> None:
        self.vectors, self.greatest, self.k, self.m = vectors, greatest, k, projections
        self.n, dim = vectors.shape
        self.lines = np.random.default_rng(seed).standard_normal((projections, dim + 1))
        extra = np.sqrt(np.maximum(greatest**2 - (vectors**2).sum(1), 0))
        words = -(-self.n // 64)
        ranks = np.arange(cells + 1) * self.n // cells
        self.below = np.zeros((projections, cells + 1, words * 8), np.uint8)
        self.cuts = np.empty((projections, cells - 1))
        place = np.empty(self.n, np.int32)
        for j, line in enumerate(self.lines):
            values = vectors @ line[:-1] + extra * line[-1]
            order = np.argsort(values)
            place[order] = np.arange(self.n, dtype=np.int32)
            self.cuts[j] = values[order[np.minimum(ranks[1:-1], self.n - 1)]]
            packed = np.packbits(place[None, :] < ranks[:, None], axis=1, bitorder="little")
            self.below[j, :, : packed.shape[1]] = packed
        self.below = self.below.view(np.uint64)
        # one array for all lines: line j's cuts lie about j * gap
        self.low = float(self.cuts.min()) - greatest if cells > 1 else 0.0
        self.gap = 3 * (float(self.cuts.max()) - self.low + greatest) + 1 if cells > 1 else 1.0
        self.flat = (self.cuts - self.low + np.arange(self.m)[:, None] * self.gap).ravel()
        self.base = np.arange(self.m) * (cells - 1)
        self.cells = cells
        self.need = max(1, int(np.ceil(threshold * self.m)))
        self.per_distance = width_per_distance(self.m, threshold, sure)
        probes = vectors[:: max(1, self.n // PROBES)][:PROBES]
        far = [self._distance(q, np.sort(vectors @ q)[-min(self.n, k)]) for q in probes]
        far = [d for d in far if d > 1e-6 * greatest] or [0.1 * greatest]
        self.start = self.per_distance * float(np.median(far))

    def _distance(self, query: np.ndarray, product: float) -> float:
        """Of a vector with this product, from the query at the greatest norm."""
        return float(np.sqrt(max(0.0, 2 * self.greatest**2 - 2 * self.greatest / np.linalg.norm(query) * product)))

    def _cells(self, at: np.ndarray) -> np.ndarray:
        """How many cuts of each line (a column) are below these numbers (a row for each query)."""
        inside = np.clip(at - self.low, -self.gap / 3, 2 * self.gap / 3) + np.arange(self.m) * self.gap
        return np.clip(np.searchsorted(self.flat, inside) - self.base, 0, self.cells - 1)

    def _collide(self, centres: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bitmaps of the vectors with enough collisions, and whether a query's windows hold the whole block."""
        left, right = self._cells(centres - widths[:, None]), self._cells(centres + widths[:, None])
        right = np.where(right == self.cells - 1, self.cells, right)  # the last cut has nothing beyond
        right = np.where((right <= left) & (left < self.cells), left + 1, right)
        counts = Collisions()
        for j in range(self.m):
            counts.add(self.below[j][right[:, j]] ^ self.below[j][left[:, j]])
        return counts.at_least(self.need), ((left == 0) & (right == self.cells)).all(1)

    def search(self, queries: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each query the places of the vectors that were verified, and their exact products."""
        out: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0))] * len(queries)
        for i in range(0, len(queries), TOGETHER):
            some = queries[i : i + TOGETHER]
            centres = (some * (self.greatest / np.linalg.norm(some, axis=1))[:, None]) @ self.lines[:, :-1].T
            widths, left = np.full(len(some), self.start), np.arange(len(some))
            while len(left):
                passed, whole = self._collide(centres[left], widths[left])
                rows = np.unpackbits(passed.view(np.uint8), axis=1, bitorder="little")[:, : self.n]
                again = []
                for q, row, all_ in zip(left, rows, whole):
                    found = np.arange(self.n) if all_ else np.flatnonzero(row)
                    known, score = out[i + q]
                    new = np.setdiff1d(found, known, assume_unique=True) if len(known) else found
                    found, score = np.r_[known, new], np.r_[score, self.vectors[new] @ some[q]]
                    out[i + q] = found, score
                    if all_:
                        continue
                    if len(found) < self.k:
                        widths[q] *= 1.3
                        again.append(q)
                        continue
                    wanted = self.per_distance * self._distance(some[q], np.partition(score, -self.k)[-self.k])
                    if wanted > widths[q] * (1 + 1e-9):
                        widths[q] = wanted
                        again.append(q)
                left = np.array(again, np.int64)
        return out


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v) of the rows that take part; v in double precision."""
    v = F.col(embedding).cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", fine) & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (common["n"] if common else -1))


def nearest(vectors: DataFrame, queries: Column, vec_id: str = "vec_id", embedding: str = "embedding", *, k: int = 20, block: int = 16_384, query_block: int = 16_384, projections: int = PROJECTIONS, cells: int = CELLS, threshold: float = THRESHOLD, sure: float = SURE, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for each row where `queries` (on the column vec_id) holds."""
    spark = vectors.sparkSession
    rows = materialize(usable(vectors, vec_id, embedding), "vectors")
    stats = rows.agg(F.count("*").alias("n"), F.count_if(queries).alias("q"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).first()
    blocks = max(1, -(-stats["n"] // block))
    # queries are dealt further where there are few blocks, so that all cores have work
    parts = max(1, -(-stats["q"] // query_block), min(-(-2 * spark.sparkContext.defaultParallelism // blocks), -(-stats["q"] // 256)))
    greatest = float(np.sqrt(stats["m"] or 1.0)) * (1 + 1e-12)
    place = lambda salt, n: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    some = rows.distinct().withColumn("_r", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("_r") <= k + 1).drop("_r")
    data = some.withColumn("b", place(1, blocks)).withColumn("q", each(parts))
    asked = rows.where(queries).distinct().withColumn("q", place(2, parts)).withColumn("b", each(blocks))
    empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty
        matrix = lambda t: t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        ids, names = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        index = Index(matrix(left)[order], greatest, projections, seed, cells, threshold, sure, k + 1)
        out_q, out_v, out_s = [], [], []
        for name, (found, score) in zip(names, index.search(matrix(right))):
            other = ids[found] != name
            found, score = ids[found][other], score[other]
            best = np.lexsort((found, -score))
            # ids in order of their best rows: the cap is on ids, as rows may repeat one
            best = best[np.sort(np.unique(found[best], return_index=True)[1])][: k + 1]
            out_q.append(np.full(len(best), name))
            out_v.append(found[best])
            out_s.append(score[best])
        return pa.table({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s)})

    met = data.groupBy("b", "q").cogroup(asked.groupBy("b", "q")).applyInArrow(search, "query_id long, vec_id long, score double")
    once = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
