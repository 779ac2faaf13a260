"""From documents to training shards: language ID, near duplicates, benchmark leaks, source mix, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes what a stage returns as Parquet in the shared
folder and reads it again for the next. All stages but the last return the columns of documents.

Rows are known by id and text (`row_key`), so that ids may repeat. What a stage drops or keeps is found by such keys, which are
broadcast up to a counted number and joined by a shuffle beyond.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _common, decontam, langid, mixing, shards, simhash
from tessera.llm._common import keyed_join, materialize, release, row_key, shared_dir, table
from tessera.llm.queries import WEIGHTS

#: A text that no learned language codes in so many bits a byte is no text of theirs.
MOST_BITS = 7.0
#: Of all tokens, what the mix keeps.
FRACTION = 0.8


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that are in no learned language: `und`, or coded worse than MOST_BITS a byte."""
    keyed = docs.select(row_key(docs, "doc_id", "text").alias("key"), "text")
    guesses = langid.predict(keyed, langid.train(docs), doc_id="key")
    bad = guesses.where((F.col("lang_pred") == "und") | (F.col("bits_per_byte") > MOST_BITS)).select(F.col("key").alias("_key")).distinct()
    return keyed_join(docs, materialize(bad, "rejected"), "doc_id", "text", "left_anti")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates. Documents without an id stay."""
    return simhash.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold passages of the benchmark."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target weights take, in one epoch. Rows that repeat an id and its text are taken together."""
    keyed = docs.select(row_key(docs, "doc_id", "text").alias("doc_id"), "text", "lang", "source")
    taken = mixing.mix(keyed, fraction=FRACTION, weights=WEIGHTS, epochs=1).select(F.col("doc_id").alias("_key")).distinct()
    return keyed_join(docs, materialize(taken, "taken"), "doc_id", "text", "left_semi")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document is in the compacted shards of the last version."""
    store = shards.shard(docs, f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}")
    return store.assignments(["doc_id"])


STAGES = [("language_id", identify), ("near_duplicates", deduplicate), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]
#: Language ID and fingerprint components are not expressible in SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again; what lies between them is deleted as soon as it was read."""
    docs, since = table(spark, sf_dir, "documents"), len(_common.WRITTEN)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        release(since, keep=docs)
    return docs
