"""Token counts by field or section, from one encoding of the whole document.

A document is encoded once, so a token that spans two sections is one token, as it is in training. The tokens' byte lengths
give their places exactly; places in bytes become places in code points; and the tokens are joined with the sections'
intervals by binary search. A token that crosses a boundary goes by an explicit `rule`:
    first   to the section with its first character (a token that begins inside a character begins with it)
    last    to the section with its last character
    share   to each in proportion to its bytes there (counts are then fractions)
The counts of a document's sections sum to its tokens under each rule.

Sections are given as an array column of start places in code points (ascending, the first 0), or are the text's lines, each
with its line feed. The vocabulary is a file of byte ranks at `vocabulary`, read on the driver and broadcast (about 1 MB); it is
a parameter and no part of this package.

Edge cases: null and empty texts are one empty section without tokens. A section start beyond the text is an empty section.
Repeated rows are each encoded. A word of any length is encoded whole, and so is a run of blanks: the split's pattern would
overflow its stack on a long one, so such a run is cut out first, as the pattern would cut it, and encoded as the piece that it is.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split that this vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("first", "last", "share")
#: Blanks (Unicode White_Space, the pattern's \s) in runs that may be long, and how long ones are cut out.
BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{64,}")
LONG = 10_000


def around_blanks(text: str, encode: Callable[[str], list[int]], piece: Callable[[str], list[int]]) -> list[int]:
    """What `encode` gives for the text, with long runs of blanks handed to `piece`. The pattern takes a run but for its last
    blank as one piece, and that one goes with what follows; at the end of the text it takes the whole run."""
    out, start = [], 0
    for m in BLANKS.finditer(text) if len(text) >= LONG else ():
        if m.end() - m.start() >= LONG:
            end = m.end() if m.end() == len(text) else m.end() - 1
            out += encode(text[start : m.start()]) + piece(text[m.start() : end])
            start = end
    return out + encode(text[start:]) if start else encode(text)


def encoder(ranks: bytes, pattern: str = PATTERN):
    """(encode, lengths in bytes by id) of a rank file's content. A pattern of one's own has to treat blanks as PATTERN does."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    sizes = np.zeros(max(table.values()) + 1, np.int64)
    for piece, i in table.items():
        sizes[i] = len(piece)
    coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return lambda text: around_blanks(text, coder.encode_ordinary, coder._encode_single_piece), sizes


def line_starts(text: str) -> np.ndarray:
    at = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 10) + 1
    return np.r_[0, at[at < len(text)]]


def attribute(sizes: np.ndarray, text: str, starts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them cross its end (those whose first character it holds)."""
    n = len(starts)
    if not len(sizes):
        return np.zeros(n), np.zeros(n, np.int64)
    data = np.frombuffer(text.encode(), np.uint8)
    char = np.cumsum((data & 0xC0) != 0x80) - 1  # of each byte
    ends = np.cumsum(sizes)
    first = np.searchsorted(starts, char[ends - sizes], "right") - 1
    last = np.searchsorted(starts, char[ends - 1], "right") - 1
    crossing = np.bincount(first[first != last], minlength=n)
    if rule == "first":
        return np.bincount(first, minlength=n).astype(float), crossing
    if rule == "last":
        return np.bincount(last, minlength=n).astype(float), crossing
    section = np.searchsorted(starts, char, "right") - 1
    return np.bincount(section, 1 / np.repeat(sizes, sizes), n), crossing


def section_tokens(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", sections: str | None = None, *, rule: str = "first", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, section, start, end, n_tokens, n_crossing, doc_tokens): a row for each section of each row of docs."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    spark = docs.sparkSession
    small_batches(spark)
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sizes = encoder(shared.value, pattern)
        for batch in batches:
            ids, texts, given = (c.to_pylist() for c in batch.columns)
            at, section, start, end, n, crossing, whole = [], [], [], [], [], [], []
            for i, (t, s) in enumerate(zip(texts, given)):
                t = t or ""
                starts = np.array(s, np.int64) if s else line_starts(t)
                lengths = sizes[np.array(encode(t), np.int64)]
                counts, over = attribute(lengths, t, starts, rule)
                at.append(np.full(len(starts), i))
                section.append(np.arange(len(starts)))
                start.append(starts)
                end.append(np.maximum(np.r_[starts[1:], len(t)], starts))
                n.append(counts)
                crossing.append(over)
                whole.append(np.full(len(starts), len(lengths)))
            if not at:
                continue
            col = [np.concatenate(x) for x in (section, start, end, n, crossing, whole)]
            ids = batch.column(0).take(pa.array(np.concatenate(at)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(col[0].astype(np.int32)), *(pa.array(c.astype(np.int64)) for c in col[1:3]), pa.array(col[3].astype(np.float64)), *(pa.array(c.astype(np.int64)) for c in col[4:])], [doc_id, "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"])

    kind = docs.schema[doc_id].dataType.simpleString()
    given = F.col(sections).cast("array<long>") if sections else F.lit(None).cast("array<long>")
    return docs.select(doc_id, F.col(text).cast("string").alias("_text"), given.alias("_starts")).mapInArrow(rows, f"`{doc_id}` {kind}, section int, start long, end long, n_tokens double, n_crossing long, doc_tokens long")
