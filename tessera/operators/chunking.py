"""Chunks: windows of lines, windows aligned to spans of code, and their identities.

Windows are made inside each row (sequence and explode), so chunking shuffles nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import values as V


def lines(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, line, content) of every line, numbered from 1; a feed at the end of the text opens no line."""
    split = F.split(F.regexp_replace(F.col(text), r"\n\z", ""), "\n")
    return files.select(F.col(path).alias("path"), F.posexplode(split).alias("p", "content")).select("path", (F.col("p") + 1).alias("line"), "content")


def linear(files: DataFrame, size: int = 100, overlap: int = 20, path: str = "path", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Windows of `size` lines that share `overlap` lines with the one before; the last is clipped, and none follows a
    window that reaches the end. An empty file is one chunk that is not to be embedded."""
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be below size")
    body = F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\n\z", ""), "\n")
    n = F.size("_lines")
    last = F.greatest(F.ceil((n - size) / F.lit(step)), F.lit(0)).cast("int")
    cut = files.select(*keep, F.col(path).alias("path"), body.alias("_lines")).withColumn("_k", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("_k") * step
    content = F.array_join(F.slice("_lines", start + 1, F.lit(size)), "\n")
    out = cut.select(*keep, "path", (start + 1).alias("start_line"), F.least(start + size, n).alias("end_line"), content.alias("content"))
    return identified(out)


def identified(chunks: DataFrame) -> DataFrame:
    """Adds hash, embeddable and vector_id."""
    return chunks.withColumn("hash", V.content_hash(F.col("content"))).withColumn("embeddable", F.trim("content") != "").withColumn("vector_id", V.vector_id(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("hash")))


def islands(spans: DataFrame) -> DataFrame:
    """(path, island, start_line, end_line): spans (path, start_line, end_line, structural, ordinal) put together.

    A span opens an island if it is structural, the first of its file, or doesn't begin on the line after the one before."""
    order = W.partitionBy("path").orderBy("ordinal")
    before = F.lag("end_line").over(order)
    opens = (F.col("structural") | before.isNull() | (F.col("start_line") != before + 1)) & ~(F.coalesce(before + 1 == F.col("start_line"), F.lit(False)) & ~F.col("structural"))
    numbered = spans.withColumn("_o", opens.cast("int")).withColumn("island", F.sum("_o").over(order))
    return numbered.groupBy("path", "island").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"))


def aligned(files: DataFrame, spans: DataFrame, size: int = 100, overlap: int = 20, text: str = "text") -> DataFrame:
    """Chunks that follow the islands of a file's spans; longer ones are cut into windows, each from its island's start."""
    step = size - overlap
    long = F.col("end_line") - F.col("start_line") + 1
    last = F.greatest(F.ceil((long - size) / F.lit(step)), F.lit(0)).cast("int")
    windows = islands(spans).withColumn("_k", F.explode(F.sequence(F.lit(0), last)))
    cut = windows.select("path", (F.col("start_line") + F.col("_k") * step).alias("start_line"), F.least(F.col("start_line") + F.col("_k") * step + size - 1, F.col("end_line")).alias("end_line"))
    body = files.select("path", F.split(F.col(text), "\n").alias("_lines"))
    joined = cut.join(body, "path").withColumn("end_line", F.least("end_line", F.size("_lines")))
    return identified(joined.where("start_line <= end_line").select("path", "start_line", "end_line", F.array_join(F.slice("_lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n").alias("content")))


def content_of(chunks: DataFrame, files: DataFrame, text: str = "text") -> DataFrame:
    """Chunks with the text of their line range, clamped to the file; empty where the file is gone."""
    body = files.select("path", F.split(F.col(text), "\n").alias("_lines"))
    at = F.greatest(F.col("start_line"), F.lit(1))
    size = F.greatest(F.least(F.col("end_line"), F.size("_lines")) - at + 1, F.lit(0))
    return chunks.join(body, "path", "left").withColumn("content", F.coalesce(F.array_join(F.slice("_lines", at, size), "\n"), F.lit(""))).drop("_lines")


def first_of_each(chunks: DataFrame, key: str = "vector_id", *order: str) -> DataFrame:
    """The first chunk of each id in the given order."""
    by = W.partitionBy(key).orderBy(*(order or ("path", "start_line")))
    return chunks.withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r")
