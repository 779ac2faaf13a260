"""SimHash near duplicates, found with vantage-point trees.

Fingerprints: ASCII capitals lowered, words `[^\\x20\\x09-\\x0D]+`, all 3-word shingles (one of all words if there are
fewer), XXH64 with seed 42; a bit is set if over half the hashes have it. Texts link at `radius` or fewer differing bits.

Equal fingerprints are one point. Two points within 2r+1 bits are within r in the upper or in the lower half, which are
metrics of their own; so each half has a vantage-point tree, and each point goes to one leaf in each. A node sends points
at most mu from its vantage left and the others right; by the triangle inequality a partner of a left point can be right
only if the point is within r of the boundary, so those points go to the right as well (and on from there in the same
way). Any pair within reach thus meets in some leaf, where distances on all 64 bits decide. Leaves that stay large are
searched by a further tree over all 64 bits, and what no tree cuts (many points about one centre) by the points' own
neighbourhoods: two points are within an even radius r if some fingerprint is within r / 2 of both. A leaf gives a spanning forest of
its links, not its pairs, so a group of copies costs a row each; components follow by alternating large and small stars.

The trees are fitted on fingerprints of the least hash, so many that a leaf of `leaf` points has 16 of them, `sample` at least and
`most_sample` (8 MB) at most; that decides only the shapes of leaves. So a leaf has about `leaf` points up to `leaf` * `most_sample`
/ 16 fingerprints (250 million), and a 62,500th of them beyond, which a task searches in time about linear in it.

Edge cases: null and empty texts have fingerprint zero and link like any other. Rows that repeat a doc_id each come
back, with the same component if the texts link. A null doc_id gets a component, but is never its smallest id.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import keyed_join, materialize, row_key, small_batches

ZERO = np.uint64(0)
HALVES = (np.uint64(0xFFFFFFFF00000000), np.uint64(0x00000000FFFFFFFF))
BRUTE = 2048


def fingerprint(text: str | None, width: int = 3) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    n = max(1, len(words) - width + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        part = hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""
    small_batches(docs.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(make, f"doc_id {kind}, fp long")


def distance(points: np.ndarray, to: np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((points ^ to) & mask)


class Node:
    """vantage and mu, or a leaf with its name."""

    def __init__(self, leaf: int = -1) -> None:
        self.leaf, self.vantage, self.mu, self.left, self.right = leaf, ZERO, 0, None, None


def grow(points: np.ndarray, size: int, mask: np.uint64, radius: int, names: Iterator[int]) -> Node:
    """A tree whose leaves hold about `size` of these points."""
    node = Node()
    best = None
    if len(points) > size:
        for v in points[:: max(1, len(points) // 12)][:12]:
            d = distance(points, v, mask)
            seen = np.bincount(d, minlength=65)
            upto = np.cumsum(seen)
            for mu in range(64):
                left, right = upto[mu], len(points) - (upto[mu - radius] if mu >= radius else 0)
                cost = float(left) ** 2 + float(right) ** 2
                if left and upto[mu] < len(points) and (best is None or cost < best[0]):
                    best = (cost, v, mu)
    if best is None or best[0] > 0.9 * float(len(points)) ** 2:
        node.leaf = next(names)
        return node
    _, node.vantage, node.mu = best
    d = distance(points, node.vantage, mask)
    node.left = grow(points[d <= node.mu], size, mask, radius, names)
    node.right = grow(points[d > node.mu - radius], size, mask, radius, names)
    return node


def route(node: Node, at: np.ndarray, points: np.ndarray, mask: np.uint64, radius: int):
    """(leaf, places) for all points, boundary ones in each leaf that they reach."""
    stack = [(node, at)]
    while stack:
        node, at = stack.pop()
        if not len(at):
            continue
        if node.leaf >= 0:
            yield node.leaf, at
            continue
        d = distance(points[at], node.vantage, mask).astype(np.int64)
        stack += [(node.left, at[d <= node.mu]), (node.right, at[d > node.mu - radius])]


def forest(points: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join whatever is linked among distinct points: (point, root) arrays."""
    if len(points) <= BRUTE:
        return _brute(points, radius)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    node = grow(points, BRUTE // 2, full, radius, iter(range(1 << 62)))
    out = []
    for _, at in route(node, np.arange(len(points)), points, full, radius):
        out += _brute(points[at], radius) if len(at) <= 4 * BRUTE or radius % 2 else _balls(points[at], radius)
    return out


def _balls(points: np.ndarray, radius: int, most: int = 1 << 24) -> list[tuple[np.ndarray, np.ndarray]]:
    """Points in the ball of radius / 2 about some fingerprint are linked in a row: they are all within the radius. The balls of all
    points are taken by ranges of their keys, so that some `most` keys at most are held."""
    flips = [ZERO]
    for k in range(1, radius // 2 + 1):
        flips += [np.uint64(sum(1 << b for b in c)) for c in itertools.combinations(range(64), k)]
    out, parts = [], max(1, -(-len(points) * len(flips) // most))
    for part in range(parts):
        keys, owners = [], []
        for f in flips:
            key = points ^ f
            here = np.flatnonzero((key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(parts) == np.uint64(part))
            keys.append(key[here])
            owners.append(here)
        key, owner = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(key, kind="stable")
        key, owner = key[order], owner[order]
        same = np.flatnonzero(key[1:] == key[:-1])
        pairs = np.unique(np.sort(np.stack([owner[same], owner[same + 1]]), axis=0), axis=1)
        if pairs.shape[1]:
            out.append((points[pairs[0]], points[pairs[1]]))
    return out


def _brute(points: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Breadth-first over all distances, in blocks; each point leaves the rest once reached."""
    out, rest = [], points
    if len(points) <= 4 * BRUTE:  # most points have no partner: set those aside first
        some = np.zeros(len(points), bool)
        for i in range(0, len(points), 256):
            some[i : i + 256] = (np.bitwise_count(points[i : i + 256, None] ^ points[None, :]) <= radius).sum(1) > 1
        rest = points[some]
    while len(rest) > 1:
        root, front, rest = rest[0], rest[:1], rest[1:]
        reached = []
        while len(front) and len(rest):
            near = np.zeros(len(rest), bool)
            for i in range(0, len(front), 256):
                near |= (np.bitwise_count(front[i : i + 256, None] ^ rest[None, :]) <= radius).any(0)
            front, rest = rest[near], rest[~near]
            reached.append(front)
        found = np.concatenate(reached) if reached else np.empty(0, np.uint64)
        if len(found):
            out.append((found, np.full(len(found), root)))
    return out


def links(points: DataFrame, radius: int = 2, *, sample: int = 20_000, most_sample: int = 1_000_000, leaf: int = 4096) -> DataFrame:
    """(a, b) links among distinct fingerprints `fp` that span every component of Hamming distance `radius`."""
    spark = points.sparkSession
    count = points.count()
    wanted = min(most_sample, max(sample, 16 * count // leaf))
    picked = points.select("fp", F.xxhash64("fp").alias("h"))
    if wanted < count:  # a hash's share, not a sort of all
        picked = picked.where(F.pmod("h", F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.1 * wanted / count)))
    picked = picked.toArrow()
    picked = picked.column("fp").to_numpy()[np.argsort(picked.column("h").to_numpy())][:wanted].astype(np.uint64)
    each = radius // 2
    names = iter(range(1 << 31))
    trees = [(grow(picked, max(8, int(leaf * len(picked) / max(count, 1))), m, each, names), m) for m in HALVES]
    leaves = next(names)
    shared = spark.sparkContext.broadcast(trees)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def placed(held: list[np.ndarray]):
            fp = np.concatenate(held).astype(np.uint64)
            for tree, mask in shared.value:
                for name, at in route(tree, np.arange(len(fp)), fp, mask, each):
                    for i in range(0, len(at), 1 << 16):
                        part = fp[at[i : i + (1 << 16)]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), name, np.int32)), pa.array(part.astype(np.int64))], ["leaf", "fp"])

        held: list[np.ndarray] = []
        for batch in batches:
            held.append(batch.column(0).to_numpy())
            if sum(map(len, held)) >= 1 << 18:
                yield from placed(held)
                held = []
        if held:
            yield from placed(held)

    def search(group: pa.Table) -> pa.Table:
        fp = np.unique(group.column("fp").to_numpy().astype(np.uint64))
        got = forest(fp, radius)
        a = np.concatenate([x for x, _ in got]) if got else np.empty(0, np.uint64)
        b = np.concatenate([y for _, y in got]) if got else np.empty(0, np.uint64)
        return pa.table({"a": a.astype(np.int64), "b": b.astype(np.int64)})

    placed = points.select("fp").mapInArrow(place, "leaf int, fp long")
    if leaves == len(trees):  # few fingerprints: one leaf has all, in both trees
        placed = placed.where("leaf = 0")
    return placed.groupBy("leaf").applyInArrow(search, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(fp, root): the least vertex that each vertex of the edges (a, b) can reach, by large and small stars."""
    spark = edges.sparkSession

    def both(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        near = both(e) if large else e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = near.join(least, "u")
        if large:
            return joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        return joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    now = materialize(edges.where("a <> b").distinct(), "edges")
    seen = state(now)
    while seen[0]:
        now = materialize(star(star(now, True), False), "edges")
        was, seen = seen, state(now)
        if was == seen:
            break
    return now.select(F.col("a").alias("fp"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b"))).distinct() if seen[0] else spark.createDataFrame([], "fp long, root long")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = 2, **fit) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs."""
    prints = materialize(fingerprints(docs, text, doc_id), "prints")
    return prints.join(by_fingerprint(prints, F.col("doc_id"), radius, **fit), "fp").select("doc_id", "fp", "component_id")


def by_fingerprint(prints: DataFrame, name: Column, radius: int = 2, **fit) -> DataFrame:
    """(fp, component_id) of the distinct fingerprints of `prints`: the least name in the component."""
    points = materialize(prints.groupBy("fp").agg(F.min(name).alias("least")), "points")
    roots = materialize(components(links(points, radius, **fit)), "roots")
    owned = points.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = owned.groupBy("root").agg(F.min("least").alias("component_id"))
    return owned.join(least, "root").select("fp", "component_id")


def as_hex(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **fit) -> DataFrame:
    """docs with one document of each component: that of the smallest id, and of different texts that share it the one of the
    smallest hash. Rows that share an id and are no near duplicates are documents of their own; rows that repeat an id and its
    text are one document; rows without an id cannot be named and stay."""
    keyed = docs.select(row_key(docs, doc_id, text).alias("key"), F.col(text).alias("t"))
    prints = materialize(fingerprints(keyed, "t", "key").groupBy("doc_id", "fp").agg(F.count("*").alias("n")), "prints")
    named = F.when(F.col("doc_id.id").isNotNull(), F.col("doc_id"))
    first = by_fingerprint(prints, named, **fit).select(F.col("component_id").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    kept = materialize(prints.join(first, "doc_id").select(F.col("doc_id").alias("_key"), "n"), "kept")
    once, more = kept.where("n = 1").select("_key"), kept.where("n > 1").select("_key")
    out = keyed_join(docs, once, doc_id, text, "left_semi").unionByName(docs.where(F.col(doc_id).isNull()))
    if more.limit(1).count():
        out = out.unionByName(keyed_join(docs, more, doc_id, text, "left_semi").dropDuplicates([doc_id, text]))
    return out
