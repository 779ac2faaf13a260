"""Secret scans, in DataFrame functions only: fixed patterns, and character Markov models of random strings.

The base finds three kinds, leftmost and non-overlapping for each: assignments, access keys and long hex strings. The
method adds the kind `markov`: in what the base leaves of a text (spans of assignments are taken out first, then access keys and
hex strings of the rest), runs of 20 or more of `[A-Za-z0-9+/_=-]` with both a letter and a digit, whose mean
log-likelihood ratio a character under a model of random strings against one of ordinary identifiers is at least
`threshold`, over the run or over any 20 characters of it with both (so that a name or path before a value does not
average it away). Both models are first-order Markov chains over characters with one count
added to each transition, trained from labelled samples (text, label: 1 random, 0 ordinary). `labelled_samples` makes some:
digests in the alphabets that keys use against identifiers, paths, numbers and words put together from common parts.

Places are running sums of the lengths of matches and of what is between them, taken in blocks, so that the work is about in
proportion to a text and its matches, also where a text has a hundred thousand.

Spans are kind:start:end in code points, end exclusive. Edge cases: null text is empty text, with no spans; repeated
rows are scanned each for itself; spans that start together are ordered as the kinds are listed.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kind, pattern, and the condition on a match; a run is as long as can be, so its least length can be in the pattern.
KINDS = (
    ("assign", ASSIGN, lambda m: F.length(F.regexp_extract(m, "^" + ASSIGN, 1)) >= 12),
    ("access", r"AKIA[A-Z0-9]{14,}", None),
    ("hex", r"[0-9a-f]{16,}", None),
)
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
PARTS = "get set user name id file path load save data list item count index value config parse read write open close start stop http https www com org html json test main page view model node edge table row column key token hash code line text word size time date year month day last first next prev left right top order total price image photo video audio content static assets public private class function return import export default module package version release build debug error warning info".split()


SPAN = "array<struct<start:int,rank:int,kind:string,end:int,m:string>>"
#: Matches whose places are summed up in one go; the sums of such blocks are summed in turn.
BLOCK = 64


def let(value: Column, body) -> Column:
    """body of the value, which is worked out once however often the body has it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column) -> Column:
    """The sums of an integer array before each of its elements. A fold that appends copies what it has, so blocks are folded by
    themselves and their sums in turn, and neither array gets long."""

    def fold(items: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(items, start, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]

    def by_blocks(items: Column, deeper: int) -> Column:
        n = F.ceil(F.size(items) / F.lit(BLOCK)).cast("int")
        cut_up = F.transform(F.sequence(F.lit(1), n), lambda k: F.slice(items, (k - 1) * BLOCK + 1, F.lit(BLOCK)))

        def whole(blocks: Column) -> Column:
            sums = let(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x)), lambda t: either(t, deeper - 1))
            return F.flatten(F.zip_with(blocks, sums, lambda b, s: F.transform(fold(b), lambda x: x + s)))

        return let(cut_up, whole)

    def either(items: Column, deeper: int) -> Column:
        return F.when(F.size(items) > BLOCK, by_blocks(items, deeper)).otherwise(fold(items)) if deeper else fold(items)

    return let(values, lambda v: either(v, 2))


def cut(text: Column, pattern: str) -> tuple[Column, Column]:
    """The matches of a pattern, and what is before, between and after them."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def spans(text: Column, kind: str, pattern: str, keep=None) -> Column:
    """Array of (start, rank, kind, end, m) of a pattern's matches: what lies between them gives the places."""
    rank = {"assign": 0, "access": 1, "hex": 2}.get(kind, 3)
    found, between = cut(text, pattern)

    def placed(x: Column, at: Column) -> Column:
        start = at + F.length(x["g"])
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (start + F.length(x["m"])).alias("end"), x["m"].alias("m"))

    both = F.filter(F.arrays_zip(found.alias("m"), between.alias("g")), lambda x: x["m"].isNotNull())
    all_ = let(both, lambda v: F.zip_with(v, running(F.transform(v, lambda x: F.length(x["g"]) + F.length(x["m"]))), placed))
    return F.when(text.rlike(pattern), F.filter(all_, lambda s: keep(s["m"])) if keep else all_).otherwise(F.array().cast(SPAN))


def without(text: Column, pattern: str, keep=None) -> Column:
    """The text with a kind's spans blanked, so that all else stays in its place."""
    found, between = cut(text, pattern)
    blank = lambda m: F.repeat(F.lit("\n"), F.length(m))
    plain = lambda m: F.when(keep(m), blank(m)).otherwise(m) if keep else blank(m)
    pieces = F.zip_with(between, F.concat(found, F.array(F.lit(""))), lambda g, m: F.concat(g, F.when(m == "", m).otherwise(plain(m))))
    return F.when(text.rlike(pattern), F.array_join(pieces, "")).otherwise(text)


def labelled_samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """(text, label): n made strings of each kind, the same every time."""
    ids = spark.range(n)
    part = lambda salt: F.element_at(F.array(*map(F.lit, PARTS)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(PARTS))) + 1).cast("int"))
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")).cast("binary"), 512)
    packed = F.base64(F.unhex(digest))
    pick = lambda *forms: F.element_at(F.array(*forms), (F.col("id") % len(forms) + 1).cast("int"))
    random = pick(digest, packed, F.upper(F.regexp_replace(packed, "[^A-Za-z0-9]", "")), F.regexp_replace(packed, "[+/=]", ""))
    number = F.pmod(F.xxhash64("id"), F.lit(10_000)).cast("string")
    year = (F.pmod(F.xxhash64("id", F.lit(9)), F.lit(130)) + 1900).cast("string")
    ordinary = pick(
        F.concat_ws("_", part(1), part(2), part(3), part(4)),
        F.concat(part(1), F.initcap(part(2)), F.initcap(part(3)), F.initcap(part(4))),
        F.concat_ws("/", part(1), part(2), year, part(3), number),
        F.concat_ws("-", part(1), part(2), part(3), number),
        F.concat(part(1), part(2), part(3), part(4), part(5)),
        F.concat_ws("_", F.upper(part(1)), F.upper(part(2)), number, F.upper(part(3))),
        F.concat_ws("-", year, F.substring(number, 1, 2), F.substring(year, 3, 2), part(1), part(2)),
        F.repeat(F.substring(number, 1, 1), 24),
    )
    return ids.select(random.alias("text"), F.lit(1).alias("label")).union(ids.select(ordinary.alias("text"), F.lit(0).alias("label")))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of the 128 x 128 transitions, from labelled samples; at most 32,768 counts come back."""
    text = F.coalesce(F.col("text"), F.lit(""))
    steps = F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.ascii(F.substr(text, i, F.lit(1))) * 128 + F.ascii(F.substr(text, i + 1, F.lit(1))))
    rows = samples.where((F.length(text) >= 2) & text.rlike(r"^[\x00-\x7f]*$") & F.col("label").isin(0, 1)).select("label", F.explode(steps).alias("step")).groupBy("label", "step").count().collect()
    counts = [[0.0] * 16384, [0.0] * 16384]
    for r in rows:
        counts[r["label"]][r["step"]] += r["count"]
    totals = [[sum(c[u * 128 : u * 128 + 128]) for u in range(128)] for c in counts]
    return [math.log((counts[1][i] + 1) / (totals[1][i // 128] + 64)) - math.log((counts[0][i] + 1) / (totals[0][i // 128] + 64)) for i in range(16384)]


def mixed(text: Column) -> Column:
    return text.rlike("[0-9]") & text.rlike("[A-Za-z]")


def random_like(text: Column, model: list[float], threshold: float) -> Column:
    """Whether the mean log-likelihood ratio of the text's transitions, or of those of any WINDOW characters, is high enough."""
    table = F.from_json(F.lit(json.dumps([round(x, 4) for x in model])), "array<double>")
    step = lambda i: F.element_at(table, F.ascii(F.substr(text, i, F.lit(1))) * 128 + F.ascii(F.substr(text, i + 1, F.lit(1))) + 1)
    n = WINDOW - 1

    def add(a: Column, i: Column) -> Column:
        moved = a["part"] + step(i) - F.when(i > n, step(i - n)).otherwise(0.0)
        here = (i >= n) & mixed(F.substr(text, i - n + 1, F.lit(WINDOW))) & (moved >= n * threshold)
        return F.struct((a["whole"] + step(i)).alias("whole"), moved.alias("part"), (a["found"] | here).alias("found"))

    start = F.struct(F.lit(0.0).alias("whole"), F.lit(0.0).alias("part"), F.lit(False).alias("found"))
    return F.aggregate(F.sequence(F.lit(1), F.length(text) - 1), start, add, lambda a: a["found"] | (a["whole"] / (F.length(text) - 1) >= threshold))


def scan(docs: DataFrame, model: list[float], text: str = "text", doc_id: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """(doc_id, base, added): the spans of every row, as arrays of structs in order of start, then kind."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rest = docs.select(F.col(doc_id).alias("doc_id"), body.alias("_t")).withColumn("_left", F.col("_t"))
    for _, pattern, keep in KINDS:
        rest = rest.withColumn("_left", without(F.col("_left"), pattern, keep))
    found = rest.select("doc_id", *[spans(F.col("_t"), *k).alias(k[0]) for k in KINDS], spans(F.col("_left"), "markov", CANDIDATE, mixed).alias("candidates"))
    added = F.filter("candidates", lambda s: random_like(s["m"], model, threshold))
    return found.select("doc_id", F.array_sort(F.concat("assign", "access", "hex")).alias("base"), F.when(F.size("candidates") > 0, added).otherwise(F.col("candidates")).alias("added"))


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
