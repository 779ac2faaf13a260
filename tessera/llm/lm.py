"""Language-model scores: context-tree weighting over bytes, beside a unigram base.

A text is its words (ASCII capitals lowered) joined by one space, then one end byte. Each byte is eight binary
decisions, the node of a decision being the bits before it; every node has a context tree over the bytes before, to
depth `depth`. A tree's node s weighs its Krichevsky-Trofimov estimate of its own counts against the product of its
children, P(s) = (KT(s) + product P(child)) / 2, so all depths are mixed. The statistics of training texts are frozen;
a decision then costs what the mixture along its path says, and a text's code length is the sum over its bytes.

The tree holds every context of every training text: nothing is left out, whatever the corpus. It is never in one place.
The counts of all grams are a table. Below the depth `SPLIT` the tree falls into parts, one for each run of the SPLIT + 1
bytes before; a task builds the parts that it is dealt (a part has at most 2^24 grams) and hands up the sums of their
children's probabilities. The driver builds depths 0 to SPLIT alone, of at most 2^24 grams (in UTF-8 text some millions).
What a gram costs is worked out where its part is, under the top that is broadcast.

Scoring looks grams up in a broadcast table of those seen most, at most `max_hot` of them. Any other gram of a text, rare
or never seen, leaves the task with its number; the distinct ones of all texts are worked out in the parts of the tree and
joined back by key. So `max_hot` decides what is joined and not what is the result. The base needs the exact count of every
token, and goes the same way: frequent ones are broadcast, and others joined by their hash (64 bits, XXH64) with the vocabulary.

Edge cases: null and empty texts are one end token. Without training texts every count is zero, and bytes cost one bit
per decision. Repeated rows are scored each for itself; a null doc_id counts as empty text in the split.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import chunks_of, find, materialize, power_floor, small_batches, whole_groups
from tessera.llm.grams import Codes, GramCounter, cold_by_text, gram_keys, sums_by_text

END = b"\n"
DEPTH = 5
#: The deepest level that the driver builds.
SPLIT = 2
TOKENS, GRAMS = 0, 1
#: Grams that are worked on at once, beyond a part of the tree.
PART_ROWS = 1 << 18
LOG_GAMMA_HALF = math.lgamma(0.5)
#: Log-gamma is kept for counts below this.
TABLED = 1 << 16


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma of large x, by Stirling's series."""
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)


_TABLES: list[np.ndarray] = []


def _half(n: np.ndarray, tabled: np.ndarray) -> np.ndarray:
    """log gamma of n + 1/2; one of two large counts may itself be small."""
    return np.where(n < TABLED, tabled[np.minimum(n, TABLED - 1).astype(np.int64)], _lgamma(np.maximum(n, TABLED) + 0.5))


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a zeros and b ones; small counts by table."""
    if not _TABLES:
        _TABLES.extend(np.array([math.lgamma(k + x) for k in range(TABLED)]) for x in (0.5, 1.0))
    half, one = _TABLES
    out = np.empty(len(a))
    few = a + b < TABLED
    i, j = a[few].astype(np.int64), b[few].astype(np.int64)
    out[few] = half[i] + half[j] - one[i + j]
    i, j = a[~few], b[~few]
    out[~few] = _half(i, half) + _half(j, half) - _lgamma(i + j + 1)
    return out - 2 * LOG_GAMMA_HALF


@dataclass
class Level:
    """One depth: its grams in order and, for each bit, the node of each gram; of each node its name (context, then the bits
    before, after a leading one), the counts of zeros and ones, and once weighted, the estimate that the bit is 1, the weight
    of that estimate, and the log probability of all below."""

    depth: int
    grams: np.ndarray
    nodes: np.ndarray
    names: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    one: np.ndarray | None = None
    weight: np.ndarray | None = None
    whole: np.ndarray | None = None

    def weigh(self, product: np.ndarray | None) -> None:
        """`product` is the log product of the children of each node; none at the last depth."""
        own = log_kt(self.zeros, self.ones)
        self.one = (self.ones + 0.5) / (self.zeros + self.ones + 1)
        if product is None:
            self.whole, self.weight = own, np.ones(len(own))
        else:
            self.whole = np.logaddexp(own, product) - math.log(2)
            self.weight = np.exp(np.minimum(own - self.whole - math.log(2), 0))

    def above(self) -> np.ndarray:
        """Of each node, the name of its parent: the same bits after a context that lacks the oldest byte."""
        return self.names & np.uint64((1 << (8 * self.depth)) - 1)

    def mix(self, keys: np.ndarray, p: np.ndarray) -> np.ndarray:
        """`p` is what the depths below say of each bit of the keys' last bytes, by key and bit; with this depth on top of them."""
        if not len(self.grams):
            return p
        key = keys & np.uint64((1 << (8 * (self.depth + 1))) - 1)
        shared, row = np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        at = np.searchsorted(self.grams, key)
        for near in (np.minimum(at, len(self.grams) - 1), np.maximum(at - 1, 0)):
            differ = self.grams[near] ^ key
            # the bits that the byte shares with this gram's, where the contexts agree
            common = np.where(differ >> np.uint64(8) == 0, 8 - LENGTHS[(differ & np.uint64(255)).astype(np.int64)], -1)
            better = common > shared
            shared, row = np.where(better, common, shared), np.where(better, near, row)
        for k in range(8):
            here = np.flatnonzero(shared >= k)  # the node of the first k bits exists
            node = self.nodes[k][row[here]]
            w = self.weight[node]
            p[here, k] = w * self.one[node] + (1 - w) * p[here, k]
        return p


#: Bits that a byte needs.
LENGTHS = np.array([int(i).bit_length() for i in range(256)])


def level(depth: int, keys: np.ndarray, n: np.ndarray) -> Level:
    """The unweighted level of sorted distinct grams and their counts."""
    starts, nodes, names, zeros, ones = 0, np.zeros((8, len(keys)), np.int32), [], [], []
    for k in range(8):
        if not len(keys):
            break
        prefix = keys >> np.uint64(8 - k)
        new = np.r_[True, prefix[1:] != prefix[:-1]]
        first = np.flatnonzero(new)
        nodes[k] = starts + np.cumsum(new) - 1
        starts += len(first)
        head = keys[first]
        names.append((head >> np.uint64(8) << np.uint64(8)) | np.uint64(1 << k) | ((head & np.uint64(255)) >> np.uint64(8 - k)))
        bit = ((keys >> np.uint64(7 - k)) & np.uint64(1)).astype(np.float64)
        ones.append(np.add.reduceat(n * bit, first))
        zeros.append(np.add.reduceat(n * (1 - bit), first))
    cat = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
    return Level(depth, keys, nodes, cat(names, np.uint64), cat(zeros, float), cat(ones, float))


def levels_of(keys: np.ndarray, n: np.ndarray, first: int, last: int, product: dict | None = None) -> list[Level]:
    """The weighted levels `first` to `last` of grams of the depth `last`; `product` has (sorted names, log products) of the
    last one's nodes, if there are depths below."""
    out: list[Level] = []
    for d in range(last, first - 1, -1):
        keys, back = np.unique(keys & np.uint64((1 << (8 * (d + 1))) - 1), return_inverse=True)
        n = np.bincount(back, n, len(keys)) if len(keys) else np.empty(0)
        now = level(d, keys, n)
        if out:
            order = np.argsort(now.names)
            at = order[np.searchsorted(now.names[order], out[-1].above())]
            below = np.bincount(at, out[-1].whole, len(now.names)) if len(now.names) else np.empty(0)
        elif product is not None:
            below = np.zeros(len(now.names))
            if len(now.names):
                below = product["p"][np.searchsorted(product["names"], now.names)]
        else:
            below = None
        now.weigh(below)
        out.append(now)
    return out[::-1]


def log2_of(keys: np.ndarray, levels: list[Level]) -> np.ndarray:
    """log2 of the probability of the last byte of each gram, by the levels (in order of depth) of a whole tree."""
    p = np.full((len(keys), 8), 0.5)
    for x in reversed(levels):
        p = x.mix(keys, p)
    byte = (keys & np.uint64(255)).astype(np.int64)
    bits = (byte[:, None] >> np.arange(7, -1, -1)) & 1
    return np.log2(np.where(bits == 1, p, 1 - p)).sum(1)


def _count(depth: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, tokens = GramCounter(), Counter()

        def rows(kind: int, keys: np.ndarray, n: np.ndarray):
            for i in range(0, len(keys), 1 << 16):
                k = keys[i : i + (1 << 16)].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(k), pa.array(n[i : i + (1 << 16)].astype(np.int64))], ["kind", "key", "n"])

        def words():
            keys = np.fromiter((xxhash.xxh64_intdigest(w) for w in tokens), np.uint64, len(tokens))
            n = np.fromiter(tokens.values(), np.int64, len(tokens))
            tokens.clear()
            return rows(TOKENS, keys, n)

        for batch in batches:
            split = [words_of(t) for t in batch.column(0).to_pylist()]
            for w in split:
                tokens.update(w)
            tokens[END] += len(split)
            texts = [b" ".join(w) + END for w in split]
            for a, b in chunks_of(texts):
                counter.add(gram_keys(texts[a:b], depth)[0])
                if counter.full():
                    yield from rows(GRAMS, *counter.drain())
            if len(tokens) > 1_000_000:
                yield from words()
        yield from words()
        yield from rows(GRAMS, *counter.drain())

    return count


def part_of(key: str, split: int) -> Column:
    """The part of the tree that a gram is in: the split + 1 bytes before its last."""
    return F.shiftright(key, 8).bitwiseAND(F.lit((1 << (8 * (split + 1))) - 1))


def by_part(grams: DataFrame, split: int) -> DataFrame:
    return grams.withColumn("g", part_of("key", split)).repartition("g").sortWithinPartitions("g")


@dataclass
class Model:
    """counts: every gram's and token's (kind, key, n), a written table; top: the levels that the driver built; the rest is
    bounded and broadcast."""

    counts: DataFrame
    top: list[Level]
    depth: int
    codes: tuple[np.ndarray, np.ndarray]
    hot: np.ndarray
    hot_n: np.ndarray
    hot_floor: float
    tokens: int
    types: int

    @property
    def split(self) -> int:
        return len(self.top) - 1

    def evaluate(self, asked: DataFrame) -> DataFrame:
        """(key, bits): log2 of the probability of each gram of `asked` (key), of any gram at all."""
        counted = self.counts.where(F.col("kind") == GRAMS).select("key", "n", F.lit(False).alias("ask"))
        return self._worked_out(counted.unionByName(asked.select("key", F.lit(0).cast("long").alias("n"), F.lit(True).alias("ask"))))

    def _worked_out(self, rows: DataFrame) -> DataFrame:
        shared, split, depth = rows.sparkSession.sparkContext.broadcast(self.top), self.split, self.depth

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in whole_groups(batches, "g", PART_ROWS):
                g, ask = t.column("g").to_numpy(), t.column("ask").to_numpy(zero_copy_only=False)
                key, n = t.column("key").to_numpy().astype(np.uint64), t.column("n").to_numpy().astype(np.float64)
                wanted = key[ask]
                if not len(wanted):
                    continue
                used = (n > 0) & np.isin(g, g[ask])
                levels = shared.value + (levels_of(key[used], n[used], split + 1, depth) if depth > split else [])
                for i in range(0, len(wanted), PART_ROWS):
                    k = wanted[i : i + PART_ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(log2_of(k, levels))], ["key", "bits"])

        return by_part(rows, split).mapInArrow(run, "key long, bits double")


def _tops(grams: DataFrame, depth: int, split: int) -> list[Level]:
    """The levels 0 to split: the counts of their nodes, and the product of their children from the parts below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "g", PART_ROWS):
            key, n = t.column("key").to_numpy().astype(np.uint64), t.column("n").to_numpy().astype(np.float64)
            if depth > split:
                low = levels_of(key, n, split + 1, depth)[0]
                names, back = np.unique(low.above(), return_inverse=True)
                a, b, w = (np.bincount(back, x, len(names)) for x in (low.zeros, low.ones, low.whole))
            else:
                low = levels_of(key, n, depth, depth)[0]
                names, a, b, w = low.names, low.zeros, low.ones, low.whole * 0
            yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array(a), pa.array(b), pa.array(w)], ["name", "a", "b", "w"])

    nodes = by_part(grams, split).mapInArrow(run, "name long, a double, b double, w double").groupBy("name").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("w").alias("w")).toArrow()
    names = nodes.column("name").to_numpy().astype(np.uint64)
    order = np.argsort(names)
    names, a, b, w = names[order], *(nodes.column(c).to_numpy()[order] for c in ("a", "b", "w"))
    last = (names & np.uint64(128)) > 0  # the nodes of the last bit have the counts of whole bytes
    head = (names[last] >> np.uint64(8) << np.uint64(8)) | ((names[last] & np.uint64(127)) << np.uint64(1))
    keys, n = np.r_[head, head | np.uint64(1)], np.r_[a[last], b[last]]
    keys, n = keys[n > 0], n[n > 0]
    return levels_of(keys, n, 0, min(split, depth), {"names": names, "p": w} if depth > split else None)


def train(texts: DataFrame, text: str = "text", *, depth: int = DEPTH, max_hot: int = 1 << 21, split: int = SPLIT) -> Model:
    """Count every token and gram of all rows, and weigh the tree."""
    small_batches(texts.sparkSession)
    split = min(split, depth)
    raw = texts.select(F.col(text).cast("string").alias("t")).mapInArrow(_count(depth), "kind byte, key long, n long")
    counts = materialize(raw.groupBy("kind", "key").agg(F.sum("n").alias("n")), "lm-counts")
    vocabulary, grams = counts.where(F.col("kind") == TOKENS), counts.where(F.col("kind") == GRAMS).select("key", "n")
    total = vocabulary.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    tokens, types = total["n"] or 0, total["v"]
    floor = tokens / max_hot
    hot = vocabulary.where(F.col("n") >= floor).select("key", "n").toArrow()
    keys = hot.column("key").to_numpy().astype(np.uint64)
    order = np.argsort(keys)
    model = Model(counts, _tops(grams, depth, split), depth, (np.empty(0, np.uint64), np.empty((0, 1))), keys[order], hot.column("n").to_numpy()[order], floor, tokens, types)
    least = power_floor(grams, "n", max_hot)
    found = model._worked_out(grams.withColumn("ask", F.col("n") >= least)).toArrow()
    keys = found.column("key").to_numpy().astype(np.uint64)
    order = np.argsort(keys)
    model.codes = (keys[order], found.column("bits").to_numpy()[order][:, None])
    return model


class Memo(dict):
    """Place of a token among the hot ones, -1 where it isn't; forgets all when it grows large."""

    def __init__(self, hot: np.ndarray) -> None:
        super().__init__()
        self.hot = hot

    def learn(self, texts: list[list[bytes]]) -> None:
        """Look up what these texts hold and was not met yet."""
        if len(self) > 300_000:
            self.clear()
        new = list(set().union((END,), *texts).difference(self))
        keys = np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new))
        self.update(zip(new, find(self.hot, keys).tolist()))


PIECES = "array<struct<kind:byte,key:bigint,times:int>>"


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of every row of docs, with n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    small_batches(spark)
    keep = keep if keep is not None else ["doc_id"]
    depth = model.depth
    norm = math.log10(model.tokens + 0.5 * (model.types + 1))  # taken off every term, as sums of small terms are exact
    shared = spark.sparkContext.broadcast((model.codes, model.hot, np.log10(model.hot_n + 0.5) - norm))
    names = [f.name for f in docs.select(*keep).schema]
    # columns of docs may be called as those below, so they go by place until the end
    own_names = [f"_keep{i}" for i in range(len(names))]
    schema = ", ".join(f"{a} {f.dataType.simpleString()}" for a, f in zip(own_names, docs.select(*keep).schema))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, hot, logs = shared.value
        place, table = Memo(hot), Codes(*codes)
        for batch in batches:
            split = [words_of(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            n_tokens, n_hot, base, rare, total, size = [], [], [], [], [], []
            place.learn(split)
            for w in split:
                at = np.fromiter(map(place.__getitem__, w), np.int64, len(w))
                end = place[END]
                n_tokens.append(len(w) + 1)
                known = at[at >= 0]
                n_hot.append(len(known) + (end >= 0))
                base.append(float(logs[known].sum()) + (float(logs[end]) if end >= 0 else 0.0))
                cold = Counter([w[i] for i in np.flatnonzero(at < 0)] + ([END] if end < 0 else []))
                rare.append((np.fromiter(map(xxhash.xxh64_intdigest, cold), np.uint64, len(cold)), np.fromiter(cold.values(), np.int64, len(cold))))
            texts = [b" ".join(w) + END for w in split]
            pieces, k = [], 0
            for a, b in chunks_of(texts):
                keys, lens = gram_keys(texts[a:b], depth)
                values = table(keys)
                offsets, cold, times = cold_by_text(keys, values, lens)
                total += sums_by_text(values, lens)[:, 0].tolist()
                size += lens.tolist()
                for i in range(b - a):
                    pieces.append((*rare[k], cold[offsets[i] : offsets[i + 1]], times[offsets[i] : offsets[i + 1]]))
                    k += 1
            lengths = [len(t) + len(g) for t, _, g, _ in pieces]
            cat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.empty(0, kind)
            struct = pa.StructArray.from_arrays(
                [
                    pa.array(cat([np.repeat([TOKENS, GRAMS], [len(t), len(g)]) for t, _, g, _ in pieces], np.int8)),
                    pa.array(cat([x for t, _, g, _ in pieces for x in (t, g)], np.uint64).astype(np.int64)),
                    pa.array(cat([x for _, m, _, n in pieces for x in (m, n)], np.int32)),
                ],
                ["kind", "key", "times"],
            )
            found = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]).astype(np.int32)), struct)
            made = [pa.array(n_tokens, pa.int64()), pa.array(n_hot, pa.int64()), pa.array(base, pa.float64()), pa.array(total, pa.float64()), pa.array(size, pa.int64()), found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*own_names, "n_tokens", "n_hot", "hot_sum", "hot_bits", "bytes", "pieces"])

    own = docs.select(*keep, F.col(text).cast("string").alias("_text")).toDF(*own_names, "_text")
    own = own.mapInArrow(rows, f"{schema}, n_tokens long, n_hot long, hot_sum double, hot_bits double, bytes long, pieces {PIECES}")
    own = materialize(own.withColumn("_row", F.monotonically_increasing_id()), "lm-scores")
    pieces = own.select("_row", F.explode("pieces").alias("p")).select("_row", "p.*")
    tokens = model.counts.where((F.col("kind") == TOKENS) & (F.col("n") < model.hot_floor)).select("kind", "key", (F.log10(F.col("n") + 0.5) - norm).alias("value"))
    grams = model.evaluate(pieces.where(F.col("kind") == GRAMS).select("key").distinct()).select(F.lit(GRAMS).cast("byte").alias("kind"), "key", F.col("bits").alias("value"))
    part = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x).otherwise(0.0))
    times = F.col("times") * F.col("value")
    found = (
        pieces.join(tokens.unionByName(grams), ["kind", "key"])
        .groupBy("_row")
        .agg(F.sum(F.when(F.col("kind") == TOKENS, F.col("times")).otherwise(0)).alias("found"), part(TOKENS, times).alias("found_sum"), part(GRAMS, times).alias("cold_bits"))
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    unknown = F.col("n_tokens") - F.col("n_hot") - zero("found")
    bits = F.col("hot_bits") + F.coalesce("cold_bits", F.lit(0.0))
    base = F.col("hot_sum") + F.coalesce("found_sum", F.lit(0.0)) + unknown * (math.log10(0.5) - norm)
    return own.drop("pieces").join(found, "_row", "left").select(
        *[F.col(a).alias(n) for a, n in zip(own_names, names)],
        "n_tokens",
        (F.col("n_hot") + zero("found")).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (bits * math.log10(2)).alias("score"),
        (-bits / F.col("bytes")).alias("bits_per_byte"),
    )
