"""Graphs and chunk maps as JSON, and as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = "struct<id:string,label:string,file_type:string,source_file:string,source_location:string,community:int,end_line:int,chunks:array<struct<hash:string,vector_id:string>>>"
EDGE = "struct<source:string,target:string,relation:string,confidence:string,confidence_score:double,weight:double,source_file:string,_src:string,_tgt:string>"


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a node-link file, whose edges are under `links` or `edges`."""
    if not path.endswith(".json"):
        raise ValueError("a graph file ends in .json")
    doc = spark.read.schema(f"nodes array<{NODE}>, links array<{EDGE}>, edges array<{EDGE}>").json(path, multiLine=True)
    nodes = doc.select(F.posexplode("nodes").alias("seq", "n")).select("seq", "n.*")
    edges = doc.select(F.posexplode(F.coalesce("links", "edges")).alias("seq", "e")).select("seq", "e.*")
    start = F.when(F.col("source_location").startswith("L"), F.expr("try_cast(substr(source_location, 2) AS int)"))
    return nodes.withColumn("start_line", start), edges


def read_chunk_map(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of a JSON object from paths to lists of chunks."""
    text = spark.read.text(path, wholetext=True)
    kind = "map<string,array<struct<file:string,start_line:int,end_line:int,hash:string,embeddable:boolean>>>"
    return text.select(F.explode(F.from_json("value", kind)).alias("path", "list")).select("path", F.explode("list").alias("c")).select("path", "c.*")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One JSON file of both, for other tools; our own form is Parquet. The two lists meet in a row, so it is for graphs of a repository."""
    n = nodes.agg(F.array_sort(F.collect_list(F.struct(*nodes.columns))).alias("nodes"))
    e = edges.agg(F.array_sort(F.collect_list(F.struct(*edges.columns))).alias("links"))
    n.join(e).write.mode("overwrite").json(path)
