"""Mixing sources to target weights by hierarchical budgeting.

Leaves are domain-language-source triples, and a leaf's capacity is its tokens times `epochs`. The budget goes down the
tree: a node's children share it in proportion to their weights, none above its capacity; what a child cannot take goes to
its siblings, in proportion, until they are full (the exact level is solved, not iterated). As a node's capacity is that of
all leaves below it, a shortage is made up by siblings first and goes to an ancestor's siblings only if they are full.

Every leaf then takes a prefix of seeded epochs: in each epoch its documents stand in the order of md5(seed:epoch:doc_id),
and documents are taken while the running sum of tokens stays within the leaf's budget. The order is cut into 256 buckets by
the hash's first two digits, with sums of each, and the boundary bucket into 256 again by the next two; all buckets before
the boundary are taken whole, and only the rows of the one innermost boundary bucket of a leaf, a 65,536th of an epoch, are
ordered. So a leaf with a third of all rows isn't sorted in one task.

Tokens are words `[^\\x20\\x09-\\x0D]+`. Edge cases: null or empty texts have no tokens, and come along as the prefix passes
them; null lang or source is a child of its own, named empty; a missing weight is 1 and a weight of 0 or less takes no
part; a budget beyond all capacity takes everything. Rows that repeat a doc_id stand side by side and are taken or left
by their running sum in turn (order of text). Without rows the result is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm._common import materialize

LEVELS = ("domain", "lang", "source")
DIGITS = 2
#: Leaves whose limits are broadcast: some tens of MB at most.
BROADCAST_LEAVES = 100_000


def domain_of(source: Column, domains: int = 4) -> Column:
    """The domain of a source where the data name none: the first hex digit of its md5, modulo `domains`."""
    digit = F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(F.coalesce(source, F.lit("")).cast("binary")), 1, 1)) - 1
    return F.concat(F.lit("domain"), (digit % domains).cast("string"))


def n_words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long")


def share(children: DataFrame, parent: list[str], budget: str, out: str) -> DataFrame:
    """Adds `out`: the child's part of its parent's budget, by weight `w` and never above `capacity`."""
    by = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    full = F.when(F.col("w") > 0, F.col("capacity") / F.col("w")).otherwise(F.lit(None))
    c = children.withColumn("_r", full).withColumn("_cap", F.when(F.col("w") > 0, F.col("capacity")).otherwise(0)).withColumn("_w", F.greatest(F.col("w"), F.lit(0.0)))
    order = by.orderBy(F.col("_r").asc_nulls_last(), *LEVELS[: len(parent) + 1])
    before = order.rowsBetween(W.unboundedPreceding, -1)
    c = c.withColumn("_full", F.coalesce(F.sum("_cap").over(before), F.lit(0))).withColumn("_left", F.sum("_w").over(by) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    # the level is set by the first child, in order of capacity per weight, that need not be filled
    level = F.when((F.col("_left") > 0) & (F.col("_full") + F.col("_r") * F.col("_left") >= F.col(budget)), (F.col(budget) - F.col("_full")) / F.col("_left"))
    c = c.withColumn("_level", F.first(level, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return c.withColumn(out, F.when(F.col("_level").isNull(), F.col("_cap").cast("double")).otherwise(F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_w")))).drop("_r", "_cap", "_w", "_full", "_left", "_level")


def weight(level: str, weights: dict[str, dict[str, float]]) -> Column:
    given = weights.get(level) or {}
    return F.coalesce(F.create_map(*[F.lit(x) for kv in given.items() for x in (kv[0], float(kv[1]))])[F.col(level)], F.lit(1.0)) if given else F.lit(1.0)


def budgets(leaves: DataFrame, fraction: float, weights: dict[str, dict[str, float]], epochs: int) -> DataFrame:
    """leaves (domain, lang, source, tokens) with each one's budget in tokens; `fraction` is of all tokens."""
    tree = leaves.withColumn("capacity", F.col("tokens") * epochs)
    top = tree.groupBy("domain").agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
    top = top.withColumn("b0", F.sum("tokens").over(W.partitionBy(F.lit(0))) * fraction).withColumn("w", weight("domain", weights))
    top = share(top, [], "b0", "b1").select("domain", "b1")
    mid = tree.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity")).join(top, "domain").withColumn("w", weight("lang", weights))
    mid = share(mid, ["domain"], "b1", "b2").select("domain", "lang", "b2")
    low = tree.join(mid, ["domain", "lang"]).withColumn("w", weight("source", weights))
    return share(low, ["domain", "lang"], "b2", "b3").select(*LEVELS, "tokens", F.floor(F.round("b3", 6)).cast("long").alias("budget"))


def mix(docs: DataFrame, *, domain: Column | None = None, fraction: float = 0.5, weights: dict[str, dict[str, float]] | None = None, epochs: int = 2, seed: int = 7) -> DataFrame:
    """(doc_id, epoch, domain, lang, source, n_tokens, budget): what is taken, a row for each time."""
    source, lang = F.coalesce(F.col("source").cast("string"), F.lit("")), F.coalesce(F.col("lang").cast("string"), F.lit(""))
    base = docs.select("doc_id", lang.alias("lang"), source.alias("source"), n_words(F.col("text")).alias("n_tokens"), (domain if domain is not None else domain_of(F.col("source").cast("string"))).alias("domain"))
    name = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    base = base.withColumn("domain", F.coalesce(F.col("domain").cast("string"), F.lit("")))
    rows = materialize(base, "mix-rows")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    budget = materialize(budgets(leaves, fraction, weights or {}, epochs), "mix-budgets")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("h", name).withColumn("bucket", F.substring("h", 1, DIGITS))
    buckets = rows.groupBy(*LEVELS, "epoch", "bucket").agg(F.sum("n_tokens").alias("n"))
    run = W.partitionBy(*LEVELS).orderBy("epoch", "bucket")
    placed = buckets.withColumn("upto", F.sum("n").over(run)).join(budget.select(*LEVELS, "budget"), list(LEVELS))
    # boundary: the first bucket that does not fit whole; those after it are left
    cut = placed.where("upto > budget").groupBy(*LEVELS).agg(F.min(F.struct("epoch", "bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("cut"))
    limits = materialize(budget.join(cut, list(LEVELS), "left").select(*LEVELS, "budget", "cut"), "mix-limits")
    few = limits.count() <= BROADCAST_LEAVES  # so that a hot leaf's rows stay where they are; beyond it they are joined by a shuffle
    joined = rows.join(F.broadcast(limits) if few else limits, list(LEVELS))
    here, there = F.struct("epoch", "bucket"), F.struct(F.col("cut.epoch").alias("epoch"), F.col("cut.bucket").alias("bucket"))
    whole = joined.where(F.col("cut").isNull() | (here < there))
    # the boundary bucket is cut in the same way by the next digits
    edge = joined.where(here == there).withColumn("inner", F.substring("h", DIGITS + 1, DIGITS))
    parts = edge.groupBy(*LEVELS, "inner").agg(F.sum("n_tokens").alias("n"), F.first("budget").alias("budget"), F.first("cut.before").alias("before"))
    parts = parts.withColumn("upto", F.col("before") + F.sum("n").over(W.partitionBy(*LEVELS).orderBy("inner")))
    last = parts.where("upto > budget").groupBy(*LEVELS).agg(F.min(F.struct("inner", (F.col("upto") - F.col("n")).alias("before"))).alias("last"))
    edge = edge.join(last, list(LEVELS))
    whole = whole.drop("cut").unionByName(edge.where(F.col("inner") < F.col("last.inner")).drop("cut", "inner", "last"))
    edge = edge.where(F.col("inner") == F.col("last.inner"))
    order = W.partitionBy(*LEVELS).orderBy("h", "doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, 0)
    edge = edge.withColumn("upto", F.sum("n_tokens").over(order) + F.col("last.before")).where("upto <= budget")
    columns = ["doc_id", F.col("epoch").cast("int").alias("epoch"), *LEVELS, "n_tokens", "budget"]
    return whole.select(*columns).unionByName(edge.select(*columns))
