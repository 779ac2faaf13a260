"""Toxicity: class-conditional Kneser-Ney models, compared by length-normalised log-likelihood.

Words are Unicode letter and digit runs of the lowered text. Both classes' models have Kneser-Ney continuation counts: n_c(w)
is the number of different words that stand before w in texts of class c, and n_c(u, w) that of different words before the pair;
so what one text or its copies repeat counts once, and an expression counts as often as it is used in a new place. With
the discount D and the strength S, and a start of text before the first word,
    P(w)       = (n(w) + 1/2) / (N + 1)                                          n(w): different words before w in either class
    P_c(w)     = (max(n_c(w) - D, 0) + left_c P(w)) / N_c                        left_c: what all words lose by the discount
    P_c(w | u) = (max(n_c(u, w) - D, 0) + (left_c(u) + S) P_c(w)) / (n_c(u) + S) left_c(u): what all pairs after u lose
Every word of a text is scored. A rare expression, one with at most D places in a class, is smoothed to the shared backoff P(w)
there; the backoff is the same for both classes, so that noise of rare words cancels. As such an expression adds nothing of its own,
only those with more than D places in a class need be kept, and dropping the others changes no score.

A text's score is a logistic function of length-normalised log-likelihood ratios, log P_toxic - log P_ordinary a word: over the whole
text, and the largest over any `windows` words in a row (a few toxic words in a long text are not averaged away). Its
coefficients are fitted on training rows that were not counted (crc32(doc_id) mod 5 = 0 of them).

Bounds: about `max_rows` labelled rows at most are learned from (beyond it an even share of the rows, by a hash of the id; whole
texts). All else covers all data; what is broadcast grows with those rows and no further.

Edge cases: null and empty texts have ratios of zero and score like a text without evidence. Labels other than 0 and 1, or
null, are not learned from. With no row of one of the classes, every score is the share of toxic rows (0 if no rows).
Rows that repeat a doc_id are each scored; a doc_id with several labels counts once for each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import crc_mod, find, id_type, materialize, small_batches

WORD = re.compile(r"[^\W_]+")
WINDOWS = (1, 2, 4, 8, 64, 256)
#: Labelled rows that are learned from, about, at most.
MAX_ROWS = 200_000
DISCOUNT, STRENGTH = 3, 1000.0
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Different uses of words that a task holds before it hands them on.
FLUSH = 2_000_000
START = np.uint64(0)
#: A word is known by so many bits of its hash: of ten million words no two are expected to share them.
WORD_BITS = 48


def word_keys(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) & np.uint64((1 << WORD_BITS) - 1)


def join_keys(before: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return (before * MIX + (keys ^ (keys >> np.uint64(29)))) * MIX


def shifted(keys: np.ndarray, by: int) -> np.ndarray:
    """The word `by` places before each; the start of text before the first."""
    return np.r_[np.full(min(by, len(keys)), START), keys[: max(0, len(keys) - by)]]


@dataclass
class KneserNey:
    """Sorted keys of words and of pairs with more than D places in a class, and of words before which such pairs stand; arrays
    have two columns, ordinary and toxic."""

    words: np.ndarray
    counts: np.ndarray
    shared: np.ndarray
    befores: np.ndarray
    after: np.ndarray
    left_after: np.ndarray
    pairs: np.ndarray
    pair_counts: np.ndarray
    n: np.ndarray
    left: np.ndarray
    discount: float = DISCOUNT
    strength: float = STRENGTH
    windows: tuple[int, ...] = WINDOWS
    weights: np.ndarray = field(default_factory=lambda: np.zeros(2 + len(WINDOWS)))
    prior: float | None = None

    def ratios(self, keys: np.ndarray) -> np.ndarray:
        """log P_toxic - log P_ordinary of each word in turn."""
        if not len(keys):
            return np.empty(0)
        w, before = find(self.words, keys), shifted(keys, 1)
        u, p = find(self.befores, before), find(self.pairs, join_keys(before, keys))
        take = lambda values, at, none: np.where((at >= 0)[:, None], values[at], none) if len(values) else np.full((len(at), 2), none, float)
        own, pair = take(self.counts, w, 0.0), take(self.pair_counts, p, 0.0)
        # of a word that is not kept P(w) is a common factor, and any value serves
        backoff = np.where(w >= 0, self.shared[w], 1.0) if len(self.shared) else np.ones(len(keys))
        word = (np.maximum(own - self.discount, 0) + self.left * backoff[:, None]) / self.n
        size, left = take(self.after, u, 0.0), take(self.left_after, u, 0.0)
        full = (np.maximum(pair - self.discount, 0) + (left + self.strength) * word) / (size + self.strength)
        return np.log(full[:, 1] / full[:, 0])

    def features(self, text: str | None) -> list[float]:
        r = self.ratios(word_keys(WORD.findall((text or "").lower())))
        if not len(r):
            return [0.0] * (1 + len(self.windows))
        sums = np.r_[0.0, np.cumsum(r)]
        best = [float((sums[k:] - sums[:-k]).max() / w) for w in self.windows for k in [min(w, len(r))]]
        return [float(sums[-1] / len(r)), *best]


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2): each word w of a class y with the word u before, and 31 bits of a hash of the one before that, packed as
    w (48 bits), u (48), hash (31), y (1) into two numbers; each once a task, about."""
    held, size = [], 0

    def rows():
        if not held:
            return
        u, w, a, y = (np.concatenate(x) for x in zip(*held))
        held.clear()
        k1 = w << np.uint64(16) | u >> np.uint64(32)
        k2 = u << np.uint64(32) | (a * MIX >> np.uint64(33)) << np.uint64(1) | y.astype(np.uint64)
        order = np.lexsort((k2, k1))  # in order of the word, so that what is shuffled has like bytes together
        k1, k2 = k1[order], k2[order]
        first = np.flatnonzero(np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]) if len(k1) else np.empty(0, np.int64)
        for i in range(0, len(first), 1 << 16):
            at = first[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(k1[at].astype(np.int64)), pa.array(k2[at].astype(np.int64))], ["k1", "k2"])

    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            keys = word_keys(WORD.findall(text.lower()))
            held.append((shifted(keys, 1), keys, shifted(keys, 2), np.full(len(keys), label, np.int8)))
            size += len(keys)
            if size > FLUSH:
                yield from rows()
                size = 0
    yield from rows()


def train(labelled: DataFrame, text: str = "text", label: str = "toxic", doc_id: str = "doc_id", *, max_rows: int = MAX_ROWS, discount: float = DISCOUNT, strength: float = STRENGTH, windows: tuple[int, ...] = WINDOWS) -> KneserNey:
    spark = labelled.sparkSession
    small_batches(spark)
    rows = labelled.select(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")).alias("h"), F.col(label).cast("int").alias("y"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).where("y in (0, 1)")
    size = rows.groupBy("y").agg(F.count("*").alias("n"), F.count_if(F.col("h") % 5 == 0).alias("tuned")).collect()
    found, share = sum(r["n"] for r in size), sum(r["n"] * r["y"] for r in size) / max(1, sum(r["n"] for r in size))
    if found > max_rows:  # the documented bound: an even share of all labelled rows, by a hash of the id
        rows = rows.where(F.pmod(F.xxhash64("h"), F.lit(1_000_000)) < int(1_000_000 * max_rows / found))
    counted, tuned = rows.where("h % 5 <> 0"), rows.where("h % 5 = 0")
    # all places of a pair are dealt to one task, by the word and 16 bits of the word before, and are told apart and counted there
    places = counted.select("y", "t").mapInArrow(_places, "k1 long, k2 long").repartition("k1").dropDuplicates(["k1", "k2"])
    toxic = F.col("k2").bitwiseAND(F.lit(1))
    pairs = places.groupBy("k1", F.shiftrightunsigned("k2", 32).alias("low")).agg(F.sum(1 - toxic).cast("double").alias("n0"), F.sum(toxic).cast("double").alias("n1"))
    u = F.shiftleft(F.col("k1").bitwiseAND(F.lit(0xFFFF)), 32).bitwiseOR(F.col("low"))
    pairs = materialize(pairs.select(u.alias("u"), F.shiftrightunsigned("k1", 16).alias("w"), "n0", "n1").sortWithinPartitions("w", "u"), "toxic-pairs")
    one = lambda c: F.sum((F.col(c) > 0).cast("double")).alias(c)
    words = materialize(pairs.groupBy("w").agg(one("n0"), one("n1"), F.count("*").cast("double").alias("n")), "toxic-words")
    lost = lambda c: F.sum(F.least(F.col(c), F.lit(float(discount))))
    total = words.agg(*[F.coalesce(x, F.lit(0.0)) for x in (F.sum("n0"), F.sum("n1"), lost("n0"), lost("n1"), F.sum("n"))]).first()
    more = (F.col("n0") > discount) | (F.col("n1") > discount)
    kept_words, kept_pairs = words.where(more).toArrow(), pairs.where(more).toArrow()
    befores = pairs.groupBy("u").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), lost("n0").alias("l0"), lost("n1").alias("l1")).where("l0 < n0 OR l1 < n1").toArrow()
    key = lambda t, c: t.column(c).to_numpy().astype(np.uint64)
    cols = lambda t, *c: np.stack([t.column(x).to_numpy() for x in c], 1)
    wk, uk, pk = key(kept_words, "w"), key(befores, "u"), join_keys(key(kept_pairs, "u"), key(kept_pairs, "w"))
    w, u, p = np.argsort(wk), np.argsort(uk), np.argsort(pk)
    model = KneserNey(
        wk[w], cols(kept_words, "n0", "n1")[w], (kept_words.column("n").to_numpy()[w] + 0.5) / (total[4] + 1),
        uk[u], cols(befores, "n0", "n1")[u], cols(befores, "l0", "l1")[u], pk[p], cols(kept_pairs, "n0", "n1")[p],
        np.maximum(np.array(total[:2]), 1), np.maximum(np.array(total[2:4]), 1), discount, strength, windows,
    )
    if any(r["n"] == r["tuned"] for r in size) or len(size) < 2 or not any(r["tuned"] for r in size):
        model.prior = share
        return model
    shared = spark.sparkContext.broadcast(model)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [shared.value.features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f, pa.list_(pa.float64()))], ["y", "f"])

    table = tuned.select("y", "t").mapInArrow(featured, "y int, f array<double>").toArrow()
    x = np.array(table.column("f").to_pylist()).reshape(-1, 1 + len(windows))
    model.weights = logistic(x, table.column("y").to_numpy().astype(float))
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Coefficients (intercept first) of a ridge-penalised logistic regression, by Newton's method."""
    if not len(y):
        return np.r_[0.0, np.ones(x.shape[1])]
    scale = np.maximum(np.abs(x).max(0), 1e-9)
    z = np.c_[np.ones(len(x)), x / scale]
    b = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        pull = np.r_[0.0, np.full(len(b) - 1, ridge)]
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pull + 1e-6), z.T @ (y - p) - pull * b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return np.r_[b[0], b[1:] / scale]


def score(docs: DataFrame, model: KneserNey, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted, mean_ratio, window_ratio) of every row of docs; window_ratio is that of the narrowest windows."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            f = np.array([m.features(t) for t in b.column(1).to_pylist()]).reshape(-1, 1 + len(m.windows))
            s = 1 / (1 + np.exp(-np.clip(m.weights[0] + f @ m.weights[1:], -500, 500)))
            s = s if m.prior is None else np.full(len(f), m.prior)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(f[:, 0]), pa.array(f[:, 1])], [doc_id, "score", "predicted", "mean_ratio", "window_ratio"])

    return docs.select(doc_id, F.col(text).cast("string").alias("_text")).mapInArrow(rows, f"{id_type(docs, doc_id)}, score double, predicted int, mean_ratio double, window_ratio double")


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS) -> DataFrame:
    """Documents with their label, outside the held-out third; of more than `max_rows` labels an even share, by a hash of the id.

    So the labels that are left have a bound, and are broadcast: no text is shuffled. A label given twice counts once.
    """
    known = labels.where((crc_mod("doc_id", 3) != 1) & F.col(label).cast("int").isin(0, 1)).select("doc_id", label)
    found = known.count()
    if found > max_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_rows / found))
    return docs.where(crc_mod("doc_id", 3) != 1).select("doc_id", "text").join(F.broadcast(known.distinct()), "doc_id")
