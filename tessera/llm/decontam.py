"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Words are Unicode letter and digit runs of the lowered text. A seed is a fixed mask of positions, such as 11011: the hash
of a window takes the words at its ones and ignores the others, so a substituted word there does not matter. Every
window of every document is hashed under every mask and looked up among the benchmark's; a hit fixes which item word
lies on which document word. The overlap around a hit is then verified on that alignment: a document is contaminated by
an item if some `window` item words in a row (all of a shorter item) agree with the document's in `share` of places.

The masks together hit every pattern of agreement that verification accepts by default, whatever the item's length: each
set of 9 places of 13, and of as many as `share` and `least` ask of a shorter item, holds one of them (a test enumerates all).

The benchmark is taken in blocks of about `block` words. A block's seeds (a row of item, place and hash for each word and mask) and its
words are broadcast apart; the documents are read once for a block. So what is broadcast is bounded whatever
the benchmark's size, and no pair is lost. No document row is shuffled, only the alignments that were hit. A benchmark of more than
`scans` blocks is joined by seed instead: the documents' windows are shuffled once and their words come to the alignments that were
hit by another join, with the same result.

Edge cases: null or empty texts, and items of fewer than `least` words, are never contaminated nor contaminate. Rows
that repeat a doc_id or item_id are one document or item in the result. Overlaps that tie are reported by the least start.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import keyed_join, materialize, row_key

MASKS = ("11011", "1101001", "1111", "1100101", "10111", "111001")


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def seed(hashes: str, mask: str) -> Column:
    """Hash of the window at `pos` under the mask, which is hashed too; null where the window does not fit."""
    ones = [F.get(F.col(hashes), F.col("pos") + i) for i, c in enumerate(mask) if c == "1"]
    return F.when(F.col("pos") + len(mask) <= F.size(hashes), F.xxhash64(F.lit(mask), *ones))


def seeded(table: DataFrame, hashes: str, masks: tuple[str, ...]) -> DataFrame:
    """Rows of the table by window, with its place `pos` (from 0) and `seed`. Places come first and hashes after them, so
    that hashing is compiled code and not a lambda; the outer form keeps Spark from splitting each text again in a filter."""
    placed = table.select("*", F.posexplode_outer(hashes).alias("pos", "_word")).drop("_word")
    return placed.select("*", F.explode(F.array(*[seed(hashes, m) for m in masks])).alias("seed")).where("seed IS NOT NULL")


def blocks(items: DataFrame, block: int) -> Iterator[DataFrame]:
    """The items in parts of about `block` words; the sizes are counted, not assumed."""
    total = items.agg(F.sum(F.size("ih").cast("long"))).first()[0] or 0
    parts = max(1, -(-total // block))
    for k in range(parts):
        yield items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k)


def verified(hits: DataFrame, window: int, share: float, least: int) -> DataFrame:
    """The best window of each document and item, of hits (doc_id, item_id, diag, dh, ih): the alignment and the words of both."""
    # the item's words against the document's on the hit's alignment; places outside the document do not agree
    aligned = F.transform(F.col("ih"), lambda h, j: F.coalesce((F.get(F.col("dh"), j + F.col("diag")) == h).cast("tinyint"), F.lit(0).cast("tinyint")))
    # once for each alignment and not for each hit; as an aggregate's result, so that Spark verifies after this and not before
    once = hits.select("doc_id", "item_id", "diag", aligned.alias("flags")).groupBy("doc_id", "item_id", "diag", "flags")
    flags = once.agg(F.max("flags").alias("same")).select("doc_id", "item_id", "diag", "same")
    length = F.least(F.size("same"), F.lit(window))
    runs = F.transform(
        F.sequence(F.lit(0), F.size("same") - length),
        lambda i: F.struct(F.aggregate(F.slice(F.col("same"), i + 1, length), F.lit(0), lambda a, x: a + x).alias("matched"), (-(i + F.col("diag"))).alias("back"), length.alias("compared")),
    )
    best = flags.select("doc_id", "item_id", F.array_max(runs).alias("best")).where((F.col("best.matched") >= F.ceil(F.col("best.compared") * share)) & (F.col("best.matched") >= least))
    return best.groupBy("doc_id", "item_id").agg(F.max("best").alias("best"))


def joined_by_seed(hashed: DataFrame, items: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """Hits of a benchmark of any size. Rows of documents and items have numbers here, as their ids may repeat."""
    docs = materialize(hashed.withColumn("_doc", F.monotonically_increasing_id()), "words")
    parts = materialize(items.withColumn("_item", F.monotonically_increasing_id()), "items")
    found = seeded(parts.select("_item", "ih"), "ih", masks).select("seed", "_item", F.col("pos").alias("ipos"))
    met = seeded(docs.select("_doc", "dh"), "dh", masks).select("seed", "_doc", "pos").join(found, "seed")
    hit = met.select("_doc", "_item", (F.col("pos") - F.col("ipos")).alias("diag")).distinct()
    return hit.join(docs, "_doc").join(parts, "_item").select("doc_id", "item_id", "diag", "dh", "ih")


def overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", *, masks: tuple[str, ...] = MASKS, window: int = 13, share: float = 0.69, least: int = 5, block: int = 500_000, scans: int = 8) -> DataFrame:
    """(doc_id, item_id, start, matched, compared) for each document and item that overlap: where on the document's
    words the best window begins, how many of its words agree, and of how many."""
    items = (
        benchmark.select(F.col("item_id"), word_hashes(F.col("text")).alias("ih"))
        .where(F.size("ih") >= least)
    )
    hashed = docs.select(F.col(doc_id).alias("doc_id"), word_hashes(F.col(text)).alias("dh"))
    out = None
    parts = list(blocks(items, block))
    for part in parts if len(parts) <= scans else ():
        found = seeded(part, "ih", masks).select("seed", F.col("item_id").alias("_item"), F.col("pos").alias("ipos"))
        met = seeded(hashed, "dh", masks).join(F.broadcast(found), "seed")
        hits = met.join(F.broadcast(part), met["_item"].eqNullSafe(part["item_id"]))
        found = verified(hits.withColumn("diag", F.col("pos") - F.col("ipos")), window, share, least)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = verified(joined_by_seed(hashed, items, masks), window, share, least)
    return out.select("doc_id", "item_id", (-F.col("best.back")).cast("long").alias("start"), F.col("best.matched").cast("long").alias("matched"), F.col("best.compared").cast("long").alias("compared"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """docs without the contaminated rows. A row is known by its id and text, so a clean one that shares a contaminated one's id stays."""
    keyed = docs.select(row_key(docs, doc_id, text).alias("key"), F.col(text).alias("t"))
    bad = materialize(overlaps(keyed, benchmark, "t", "key", **how).select(F.col("doc_id").alias("_key")).distinct(), "contaminated")
    return keyed_join(docs, bad, doc_id, text, "left_anti")
