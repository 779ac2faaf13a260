"""Evaluation of runs: citations, verdicts, and the statistics of a profile."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import values as V
from tessera.operators._plan import cut, mean_ranks

FLAG, LEAST = 0.3, 5


def cited(runs: DataFrame, key: str = "run_id", answer: str = "answer") -> DataFrame:
    """(key, citation, file, line) of every citation of every answer."""
    one = runs.select(key, F.explode(T.citations(F.coalesce(F.col(answer), F.lit("")))).alias("citation"))
    return one.withColumn("file", T.citation_path(F.col("citation"))).withColumn("line", T.citation_line(F.col("citation")))


def existing(citations: DataFrame, files: DataFrame, root: str = "") -> DataFrame:
    """Adds `exists`: the file is one of files(path), as written, under the root, or from the root."""
    known = files.select("path", F.lit(True).alias("_e")).distinct()
    forms = [F.col("file"), F.regexp_replace("file", "^" + root + "/", "") if root else F.col("file"), F.regexp_replace("file", "^/+", "")]
    tried = citations.withColumn("_n", F.monotonically_increasing_id()) if "_n" not in citations.columns else citations
    found = tried.select("*", F.explode(F.array_distinct(F.array(*forms))).alias("path")).join(known, "path", "left")
    rest = [c for c in tried.columns if c != "_n"]
    return found.groupBy("_n", *rest).agg(F.coalesce(F.bool_or("_e"), F.lit(False)).alias("exists")).drop("_n")


def existence_rate(citations: DataFrame, key: str = "run_id") -> DataFrame:
    return citations.groupBy(key).agg(F.avg(F.col("exists").cast("int")).alias("rate"), F.count("*").alias("n"))


def wilson(wins: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The interval of a share of wins; 0 to 1 without trials."""
    p, size = F.try_divide(wins.cast("double"), n), n.cast("double")
    centre, spread = p + z * z / (2 * size), z * F.sqrt((p * (1 - p) + z * z / (4 * size)) / size)
    over = 1 + z * z / size
    none = n == 0
    return F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), (centre - spread) / over)), F.when(none, 1.0).otherwise(F.least(F.lit(1.0), (centre + spread) / over))


def mean_rank(column: str, *partition: str) -> Column:
    """Rank from 1, ties at the mean of their places."""
    by = W.partitionBy(*partition) if partition else W.partitionBy(F.lit(1))
    peers = W.partitionBy(*partition, column)
    return F.rank().over(by.orderBy(column)) + (F.count("*").over(peers) - 1) / 2


def pearson(x: str, y: str) -> Column:
    """Aggregate: the correlation, 0 where a side is constant or empty."""
    mx, my, n = F.avg(x), F.avg(y), F.count(x)
    cov = F.sum(F.col(x) * F.col(y)) - n * mx * my
    vx, vy = F.sum(F.col(x) * F.col(x)) - n * mx * mx, F.sum(F.col(y) * F.col(y)) - n * my * my
    return F.coalesce(F.when((vx > 1e-9) & (vy > 1e-9), F.try_divide(cov, F.sqrt(vx * vy))), F.lit(0.0))


def spearman(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """(by, rho, n): the correlation of mean ranks of the rows that have both; without `by`, ranks over all rows."""
    rows = df.select(*by, F.col(x).alias("_vx"), F.col(y).alias("_vy")).where("_vx IS NOT NULL AND _vy IS NOT NULL")
    if by:
        r = rows.select(*by, mean_rank("_vx", *by).alias("_x"), mean_rank("_vy", *by).alias("_y"))
        return r.groupBy(*by).agg(pearson("_x", "_y").alias("rho"), F.count("*").alias("n"))
    r = rows.join(mean_ranks(rows, "_vx", "_x"), "_vx").join(mean_ranks(rows, "_vy", "_y"), "_vy")
    return r.agg(pearson("_x", "_y").alias("rho"), F.count("*").alias("n"))


def length_bias(df: DataFrame, length: str, won: str, threshold: float = FLAG, least: int = LEAST) -> DataFrame:
    """(rho, n, flagged): whether longer answers win; nothing is said of fewer than `least` pairs."""
    s = spearman(df, length, won)
    enough = F.col("n") >= least
    return s.select(F.when(enough, F.col("rho")).alias("rho"), "n", (enough & (F.col("rho") > threshold)).alias("flagged"))


def sign_test(wins: Column, losses: Column) -> Column:
    """Two-sided exact p of a fair coin, ties left out."""
    n, k = wins + losses, F.least(wins, losses)
    # each term of the tail from the one before, by logarithms
    start = F.struct((-n * math.log(2)).cast("double").alias("log"), F.lit(0.0).alias("sum"))
    step = lambda a, i: F.struct((a["log"] + F.log((n - i) / (i + 1))).alias("log"), (a["sum"] + F.exp(a["log"])).alias("sum"))
    tail = F.aggregate(F.sequence(F.lit(0), k.cast("int")), start, step)["sum"]
    return F.when(n > 0, F.least(F.lit(1.0), 2 * tail))


def signed_rank_p(n: int, k: int, up: float, ties: float) -> float | None:
    """Two-sided p of the signed-rank test by the normal approximation, of n pairs of which k differ, with the rank sum `up` of the
    positive ones and the sum `ties` of t^3 - t; none for under five pairs or no differences."""
    if n < LEAST or not k:
        return None
    var = k * (k + 1) * (2 * k + 1) / 24 - ties / 48
    return math.erfc(abs(up - k * (k + 1) / 4) / math.sqrt(2 * var)) if var > 0 else 1.0


def wilcoxon(scores: DataFrame, first: str, second: str) -> DataFrame:
    """(p, n) of two tools' scores (task, tool, score), paired by task: ranks and sums are relational, and the last step has one row."""
    wide = scores.where(F.col("tool").isin(first, second)).groupBy("task").agg(F.avg(F.when(F.col("tool") == first, F.col("score"))).alias("a"), F.avg(F.when(F.col("tool") == second, F.col("score"))).alias("b")).dropna()
    wide = cut(wide.select((F.col("a") - F.col("b")).alias("d")))
    moved = wide.where("d <> 0").select("d", F.abs("d").alias("size"))
    ranked = moved.join(mean_ranks(moved, "size", "rank"), "size")
    ties = moved.groupBy("size").count().agg(F.coalesce(F.sum(F.pow("count", F.lit(3)) - F.col("count")), F.lit(0.0)).alias("ties"))
    sums = ranked.agg(F.count("*").alias("k"), F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("rank"))), F.lit(0.0)).alias("up"))

    def p_of(batches):
        for b in batches:
            yield pd.DataFrame({"p": [signed_rank_p(*r) for r in b[["n", "k", "up", "ties"]].itertuples(index=False)], "n": b["n"]})

    return wide.agg(F.count("*").alias("n")).join(sums).join(ties).mapInPandas(p_of, "p double, n long")


def verdict(ab: Column, ab_conf: Column, ba: Column, ba_conf: Column) -> tuple[Column, Column]:
    """(winner, confidence) of two judgements in swapped order: agreed, or a tie of low confidence."""
    same = ab == ba
    return F.when(same, ab).otherwise("Tie"), F.when(same, V.lower_confidence(ab_conf, ba_conf)).otherwise("low")


def majority(verdicts: DataFrame) -> DataFrame:
    """(task, winner, confidence, n): the only leader of a task's verdicts, else a tie; a single one stands as it is."""
    votes = verdicts.groupBy("task", "winner").agg(F.count("*").alias("k"), F.min("confidence").alias("c"))
    by = W.partitionBy("task")
    top = votes.withColumn("n", F.sum("k").over(by)).withColumn("most", F.max("k").over(by))
    lead = top.where("k = most").groupBy("task").agg(F.count("*").alias("leaders"), F.min("winner").alias("w"), F.min("c").alias("c"), F.max("k").alias("k"), F.max("n").alias("n"))
    winner = F.when(F.col("leaders") == 1, F.col("w")).otherwise("Tie")
    confidence = F.when(F.col("n") == 1, F.col("c")).when((F.col("leaders") == 1) & (2 * F.col("k") > F.col("n")), "medium").otherwise("low")
    return lead.select("task", winner.alias("winner"), confidence.alias("confidence"), "n")


def profile(runs: DataFrame) -> DataFrame:
    """(tool, n, means, medians, win rate and its interval) of runs (tool, score, tokens, seconds, won)."""
    a = runs.groupBy("tool").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.median("tokens").alias("median_tokens"), F.median("seconds").alias("median_seconds"), F.count_if("won").alias("wins"))
    low, high = wilson(F.col("wins"), F.col("n"))
    return a.select("*", low.alias("low"), high.alias("high"))


def agreement(runs: DataFrame, subset: int = 3) -> DataFrame:
    """(task, agreement, pairs): the mean cosine of a task's runs (task, seed, embedding), over all pairs of seeds of a task.

    A task has a few seeds; the pairs are within a task and grow with its seeds only."""
    a, b = runs.alias("a"), runs.alias("b")
    pairs = a.join(b, (F.col("a.task") == F.col("b.task")) & (F.col("a.seed") < F.col("b.seed")))
    sim = F.greatest(F.lit(0.0), V.cosine(F.col("a.embedding"), F.col("b.embedding")))
    return pairs.groupBy(F.col("a.task").alias("task")).agg(F.avg(sim).alias("agreement"), F.count("*").alias("pairs"))


def reconciled(flagged: DataFrame, files: DataFrame) -> DataFrame:
    """(run_id, file, kind): flagged paths that are missing, and those that exist but support nothing."""
    f = flagged.withColumn("file", T.entry_file(F.col("entry"))).where(T.looks_like_path(F.col("file")))
    return f.join(files.select(F.col("path").alias("file"), F.lit(True).alias("_e")).distinct(), "file", "left").select("run_id", "file", F.when(F.col("_e"), "unsupported").otherwise("missing").alias("kind"))
