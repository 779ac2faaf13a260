"""Language identification by prediction by partial matching over bytes.

One variable-order context tree per language gives the exact code length of a text under frozen statistics; the
language with the shortest code wins. At a context of the longest known order a byte seen n times of T with q
distinct bytes costs -log2(n / (T + q)); an unseen byte costs the escape -log2(q / (T + q)) and goes on at the next
shorter context, at last to a uniform byte of 8 bits. Nothing is excluded after an escape.

Counts come from every training text, and every context is in the trees. The counts are a table of (gram, language);
orders up to SPLIT (at most 256 ^ (SPLIT + 1) grams a language) are broadcast, and the trees below fall into parts by the
SPLIT + 1 bytes before, each worked out by one task (a part of an order-3 tree has at most 65,536 grams a language).
Scoring looks grams up in a broadcast table of those seen most, of at most `max_cells` numbers (grams times languages).
Any other gram of a text, rare or never seen, leaves the task by its key; the distinct ones of all texts are worked out in
the parts of the trees and joined back. So `max_cells` decides what is joined, and not what is the result.

`max_languages` bounds the number of trees: more learned values raise an error.

Edge cases: null text, empty text or no letter (Unicode category L) -> `und`, score 0. Nothing to learn from -> every text is
`und`. Ties go to the alphabetically first language. Repeated rows are scored like any other; a null lang is not learned
from. The score is the posterior of the winner at equal priors, 1 / sum(2 ** (shortest - length)).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import chunks_of, find, materialize, power_floor, small_batches, whole_groups
from tessera.llm.grams import Codes, GramCounter, cold_by_text, gram_keys, sums_by_text

ORDER = 3
#: The longest order that is broadcast whole.
SPLIT = 1
MAX_CELLS = 1 << 22

Orders = list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def order_of(grams: np.ndarray, langs: np.ndarray, n: np.ndarray, width: int):
    """One order of the trees: grams, their counts by language, contexts, their totals and distinct counts."""
    keys, row = np.unique(grams, return_inverse=True)
    counted = np.zeros((len(keys), width))
    np.add.at(counted, (row, langs), n)
    contexts, c = np.unique(keys >> np.uint64(8), return_inverse=True)
    total, distinct = np.zeros((len(contexts), width)), np.zeros((len(contexts), width))
    np.add.at(total, c, counted)
    np.add.at(distinct, c, counted > 0)
    return keys, counted, contexts, total, distinct


def bits_of(keys: np.ndarray, orders: Orders, width: int) -> np.ndarray:
    """Code length of the last byte of each gram, by language; orders from 0 up."""
    out = np.zeros((len(keys), width))
    still = np.ones(out.shape, bool)
    for d in range(len(orders) - 1, -1, -1):
        grams, n, contexts, total, distinct = orders[d]
        if not len(grams):
            continue
        key = keys & np.uint64((1 << (8 * (d + 1))) - 1)
        g, c = find(grams, key), find(contexts, key >> np.uint64(8))
        seen = np.where((g >= 0)[:, None], n[g], 0)
        t = np.where((c >= 0)[:, None], total[c], 0)
        q = np.where((c >= 0)[:, None], distinct[c], 0)
        known = still & (t > 0)
        share = np.where(seen > 0, seen, q) / np.maximum(t + q, 1)
        out[known] -= np.log2(share[known])
        still &= ~(known & (seen > 0))
    out[still] += 8
    return out


@dataclass
class PPM:
    """languages; counts: (gram, lang, n) of the longest order, a written table; top: the orders that are broadcast whole; codes:
    the hot grams and their code lengths by language."""

    languages: list[str]
    counts: DataFrame | None = None
    order: int = ORDER
    top: Orders = field(default_factory=list)
    codes: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.uint64), np.empty((0, 0)))

    def evaluate(self, asked: DataFrame) -> DataFrame:
        """(gram, bits): code lengths by language of each gram of `asked` (gram), of any gram at all."""
        counted = self.counts.select("gram", "lang", "n", F.lit(False).alias("ask"))
        return self._worked_out(counted.unionByName(asked.select("gram", F.lit(0).alias("lang"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("ask"))))

    def _worked_out(self, rows: DataFrame) -> DataFrame:
        order, width, split = self.order, len(self.languages), len(self.top) - 1
        shared = rows.sparkSession.sparkContext.broadcast(self.top)
        least = max(1 << 10, (1 << 20) // width)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in whole_groups(batches, "g", least):
                part, ask = t.column("g").to_numpy(), t.column("ask").to_numpy(zero_copy_only=False)
                gram, n, lang = t.column("gram").to_numpy().astype(np.uint64), t.column("n").to_numpy().astype(np.float64), t.column("lang").to_numpy().astype(np.int64)
                wanted = np.unique(gram[ask])
                if not len(wanted):
                    continue
                used = (n > 0) & np.isin(part, part[ask])
                orders = shared.value + [order_of(gram[used] & np.uint64((1 << (8 * (d + 1))) - 1), lang[used], n[used], width) for d in range(split + 1, order + 1)]
                for i in range(0, len(wanted), least):
                    k = wanted[i : i + least]
                    bits = pa.array(bits_of(k, orders, width).ravel())
                    yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(len(k) + 1, dtype=np.int32) * width), bits)], ["gram", "bits"])

        part = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << (8 * (split + 1))) - 1))
        return rows.withColumn("g", part).repartition("g").sortWithinPartitions("g").mapInArrow(run, "gram long, bits array<double>")


def _partials(order: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = GramCounter()

        def rows():
            keys, n = counter.drain()
            for i in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 16)].astype(np.int64)), pa.array(n[i : i + (1 << 16)])], ["key", "n"])

        for batch in batches:
            tags, texts = batch.column(0).to_pylist(), [t.encode() for t in batch.column(1).to_pylist()]
            for a, b in chunks_of(texts):
                keys, lens = gram_keys(texts[a:b], order)
                counter.add(keys | (np.repeat(np.array(tags[a:b], np.uint64), lens) << np.uint64(8 * (order + 1))))
                if counter.full():
                    yield from rows()
        yield from rows()

    return count


def train(texts: DataFrame, text: str = "text", lang: str = "lang", *, order: int = ORDER, max_cells: int = MAX_CELLS, max_languages: int = 1000, split: int = SPLIT) -> PPM:
    """Frozen trees from all rows of `texts` that have a text and a language."""
    spark = texts.sparkSession
    small_batches(spark)
    split = min(split, order)
    known = texts.select(F.col(lang).cast("string").alias("l"), F.col(text).cast("string").alias("t")).where("l is not null and t is not null")
    languages = sorted(r[0] for r in known.select("l").distinct().limit(max_languages + 1).collect())
    if len(languages) > max_languages:
        raise ValueError(f"more than {max_languages} languages to learn")
    if not languages:
        return PPM([])
    tags = spark.createDataFrame(list(enumerate(languages)), "tag int, l string")
    shift = 8 * (order + 1)
    raw = known.join(F.broadcast(tags), "l").select("tag", "t").mapInArrow(_partials(order), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counts = materialize(raw.select(F.col("key").bitwiseAND(F.lit((1 << shift) - 1)).alias("gram"), F.shiftright("key", shift).cast("int").alias("lang"), "n"), "ppm")
    low = counts.groupBy(F.col("gram").bitwiseAND(F.lit((1 << (8 * (split + 1))) - 1)).alias("g"), "lang").agg(F.sum("n").alias("n")).toArrow()
    g, tag, n = low.column("g").to_numpy().astype(np.uint64), low.column("lang").to_numpy().astype(np.int64), low.column("n").to_numpy()
    width = len(languages)
    model = PPM(languages, counts, order, [order_of(g & np.uint64((1 << (8 * (d + 1))) - 1), tag, n, width) for d in range(split + 1)])
    by_gram = counts.groupBy("gram").agg(F.sum("n").alias("n"))
    least = power_floor(by_gram, "n", max(1, max_cells // width))
    found = model.evaluate(by_gram.where(F.col("n") >= least)).toArrow()
    keys = found.column("gram").to_numpy().astype(np.uint64)
    values = found.column("bits").combine_chunks().flatten().to_numpy() if len(keys) else np.empty(0)
    at = np.argsort(keys)
    model.codes = (keys[at], values.reshape(-1, width)[at])
    return model


def predict(docs: DataFrame, model: PPM, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_byte) of every row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    width = len(model.languages)
    if not width:
        return docs.select(F.col(doc_id), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte"))
    shared, order = spark.sparkContext.broadcast(model.codes), model.order

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Codes(*shared.value)
        for batch in batches:
            texts = [t.encode() if has_letter(t) else b"" for t in batch.column(1).to_pylist()]
            bits, size, cold, times, held = [], [], [], [], [0]
            for a, b in chunks_of(texts):
                keys, lens = gram_keys(texts[a:b], order)
                values = table(keys)
                offsets, k, n = cold_by_text(keys, values, lens)
                bits.append(sums_by_text(values, lens))
                size.append(lens)
                cold.append(k)
                times.append(n)
                held += (held[-1] + offsets[1:]).tolist()
            flat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.empty(0, kind)
            pieces = pa.StructArray.from_arrays([pa.array(flat(cold, np.uint64).astype(np.int64)), pa.array(flat(times, np.int32))], ["gram", "times"])
            sums = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * width), pa.array(flat(bits, np.float64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(flat(size, np.int64)), sums, pa.ListArray.from_arrays(pa.array(np.array(held, np.int32)), pieces)], ["id", "bytes", "bits", "pieces"])

    own = docs.select(F.col(doc_id), F.col(text).cast("string").alias("_text")).mapInArrow(sums, f"id {kind}, bytes long, bits array<double>, pieces array<struct<gram:bigint,times:int>>")
    own = materialize(own.withColumn("_row", F.monotonically_increasing_id()), "ppm-sums")
    pieces = own.select("_row", F.explode("pieces").alias("p")).select("_row", "p.*")
    codes = model.evaluate(pieces.select("gram").distinct())
    more = pieces.join(codes, "gram").groupBy("_row").agg(F.array(*[F.sum(F.col("times") * F.get("bits", F.lit(i))) for i in range(width)]).alias("more"))
    full = own.drop("pieces").join(more, "_row", "left").withColumn("bits", F.when(F.col("more").isNull(), F.col("bits")).otherwise(F.zip_with("bits", "more", lambda a, b: a + b)))
    least = F.array_min("bits")
    best = F.get(F.array(*map(F.lit, model.languages)), F.array_position("bits", least).cast("int") - 1)
    post = 1 / F.aggregate("bits", F.lit(0.0), lambda a, x: a + F.pow(F.lit(2.0), F.greatest(least - x, F.lit(-1000.0))))
    some = F.col("bytes") > 0
    return full.select(F.col("id").alias(doc_id), F.when(some, best).otherwise("und").alias("lang_pred"), F.when(some, post).otherwise(0.0).alias("score"), F.when(some, least / F.col("bytes")).alias("bits_per_byte"))
