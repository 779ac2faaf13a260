"""Cutting plans between steps that are read several times, and numbering rows without a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage, so that loops and several readers do not work it out again: a checkpoint in the cluster's shared
    folder (spark.checkpoint.dir) where there is one, else kept in memory and on disk."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            return df.persist()
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Adds the place of each row in the order, from 0. Ranges of the order are numbered apart, from the sizes of those before."""
    parts = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").count()
    before = sizes.withColumn("_before", F.coalesce(F.sum("count").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    within = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn(name, within).join(F.broadcast(before), "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


def mean_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """(column, name): the rank of each value from 1, ties at the mean of their places; sums over ranges of values, and no single task."""
    counts = cut(df.groupBy(column).count().repartitionByRange(column).withColumn("_part", F.spark_partition_id()))
    sizes = counts.groupBy("_part").agg(F.sum("count").alias("_all"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_all").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_all")
    upto = F.sum("count").over(W.partitionBy("_part").orderBy(column))
    ranked = counts.withColumn("_upto", upto).join(F.broadcast(before), "_part")
    return ranked.select(column, (F.col("_before") + F.col("_upto") - (F.col("count") - 1) / 2).alias(name))
