"""The registered queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ann, decontam, langid, lm, mixing, oracles, secrets, shards, simhash, tokens, toxicity
from tessera.llm._common import crc_mod, shared_dir, table

#: Target weights of the mix: domains and languages by name, sources alike.
WEIGHTS = {"domain": {"domain0": 3.0, "domain1": 2.0, "domain2": 1.0, "domain3": 1.0}, "lang": {"en": 2.0, "de": 1.0, "fr": 1.0, "es": 1.0}}


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted", "mean_ratio", "window_ratio")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(crc_mod("doc_id", 5) != 0))
    return langid.predict(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex().alias("fingerprint"), "component_id")


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = shards.shard(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}", arrivals=4)
    return store.assignments(["doc_id"])


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.section_tokens(table(spark, sf_dir, "documents"))


def op7_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lm.train(docs.where(crc_mod("doc_id", 5) != 1))
    scored = lm.score(docs, model)
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), fraction=0.5, weights=WEIGHTS, epochs=2)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), secrets.train(secrets.labelled_samples(spark)))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", n("assign"), n("access"), n("hex"),
        F.sha2(secrets.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secrets.listed(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_markov"),
    )


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_toxicity, op2_language, op3_simhash, op4_shards, op5_decontaminate, op6_tokens, op7_ctw, op8_mix, op9_secrets, op10_neighbours)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op5_decontaminate": oracles.DECONTAMINATE, "op8_mix": oracles.mix(0.5, WEIGHTS, 2)}
