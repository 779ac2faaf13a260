"""Retrieval: BM25, dense search, fusion, candidates, relevance, overlap removal, hybrid search.

Nothing here collects a corpus: query terms are few and are broadcast (their number is checked), lists are cut by top-k.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import values as V
from tessera.operators._plan import cut

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K, DENSE_SHARE, SPARSE_SHARE = 60, 0.6, 0.4
MOST_TERMS = 10_000


@dataclass
class Postings:
    """What BM25 needs of a corpus: postings (id, term, tf, len), terms (term, df, idf), and one row of totals (n, mean)."""

    postings: DataFrame
    terms: DataFrame
    totals: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        """The tables of a generation; postings by term, so that a query reads the files of its terms."""
        return {"postings": self.postings.repartitionByRange("term").sortWithinPartitions("term"), "terms": self.terms.repartitionByRange("term").sortWithinPartitions("term"), "totals": self.totals}


def postings(docs: DataFrame, key: str, text: str) -> Postings:
    """Counted once for a generation of the index; idf as ln(N - n + 0.5) - ln(n + 0.5), and a quarter of the mean idf
    of all terms where that is negative."""
    words = docs.select(F.col(key).alias("id"), T.tokens(F.coalesce(F.col(text), F.lit(""))).alias("w")).withColumn("len", F.size("w"))
    post = cut(words.select("id", "len", F.explode("w").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len")))
    totals = cut(docs.agg(F.count("*").alias("n")).join(post.agg(F.sum("tf").alias("all"))).select("n", F.try_divide(F.col("all"), F.col("n")).alias("mean")))
    return weighed_terms(post, post.groupBy("term").agg(F.count("*").alias("df")), totals)


def weighed_terms(post: DataFrame, counts: DataFrame, totals: DataFrame) -> Postings:
    raw = cut(counts.join(F.broadcast(totals)).select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw")))
    floor = raw.agg((F.lit(EPSILON) * F.avg("raw")).alias("floor"))
    return Postings(post, raw.join(F.broadcast(floor)).select("term", "df", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf")), totals)


def asked_postings(docs: DataFrame, key: str, text: str, query: str) -> Postings:
    """As `postings`, for one query: each text is read once and the postings are those of the query's terms; only numbers by term are
    shuffled. Totals and idf are of all terms. Where keys repeat it is `postings`."""
    if docs.groupBy(key).count().where("count > 1").limit(1).count():
        return postings(docs, key, text)
    asked = set(re.findall(r"[a-z0-9_]+", query.lower()))
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total, id_type = Counter(), 0, 0, None

        def rows(kind: int, ids: list | None, terms: list, ns: list[int], lens: list[int]) -> pa.RecordBatch:
            id_column = pa.nulls(len(ns), id_type) if ids is None else pa.array(ids, id_type)
            return pa.RecordBatch.from_arrays([pa.array([kind] * len(ns), pa.int32()), id_column, pa.array(terms, pa.string()), pa.array(ns, pa.int64()), pa.array(lens, pa.int64())], ["kind", "id", "term", "n", "len"])

        for b in batches:
            id_type = b.schema.field(0).type
            found = ([], [], [], [])
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = re.findall(r"[a-z0-9_]+", (x or "").lower())
                tf = Counter(words)
                df.update(tf.keys())
                n, total = n + 1, total + len(words)
                for w in asked & tf.keys():
                    for column, value in zip(found, (i, w, tf[w], len(words))):
                        column.append(value)
            yield rows(2, *found)
            if len(df) > 1_000_000:
                yield rows(1, None, list(df), list(df.values()), [0] * len(df))
                df.clear()
        if n:
            yield rows(1, None, list(df), list(df.values()), [0] * len(df))
            yield rows(0, None, [None], [n], [total])

    told = cut(docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"kind int, id {kind.simpleString()}, term string, n long, len long"))
    totals = cut(told.where("kind = 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("len").alias("all")).select("n", F.try_divide(F.col("all"), F.col("n")).alias("mean")))
    post = told.where("kind = 2").select("id", "term", F.col("n").alias("tf"), F.col("len").cast("int").alias("len"))
    return weighed_terms(post, told.where("kind = 1").groupBy("term").agg(F.sum("n").alias("df")), totals)


def bm25(index: Postings, query: str, k: int | None = None) -> DataFrame:
    """(id, score) of documents with a positive score, best first; a term that the query repeats counts as often. Only the
    postings of the query's terms are read."""
    spark = index.postings.sparkSession
    asked = Counter(re.findall(r"[a-z0-9_]+", query.lower()))
    if len(asked) > MOST_TERMS:
        raise ValueError(f"a query has over {MOST_TERMS} different terms")
    times = spark.createDataFrame(list(asked.items()), "term string, times long")
    # the terms in the filter too, where they are few, for the files' statistics
    wanted = (lambda d: d.where(F.col("term").isin(list(asked)))) if len(asked) <= 200 else (lambda d: d)
    terms = wanted(index.terms).join(F.broadcast(times), "term").select("term", "times", "idf")
    scored = wanted(index.postings).join(F.broadcast(terms), "term").join(F.broadcast(index.totals))
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    out = scored.groupBy("id").agg(F.sum(part).alias("score")).where("score > 0")
    return out.orderBy(F.desc("score"), "id").limit(k) if k else out


def distances(vectors: DataFrame, query: list[float] | DataFrame, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, distance) of every vector by cosine."""
    if isinstance(query, DataFrame):
        vectors = vectors.join(F.broadcast(query.select(F.col(embedding).alias("_q")).limit(1)))
        other = F.col("_q")
    else:
        other = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(F.col(key).alias("id"), (1 - V.cosine(F.col(embedding), other)).alias("distance"))


def dense(vectors: DataFrame, query: list[float] | DataFrame, k: int, key: str = "vec_id", embedding: str = "embedding", where: Column | None = None) -> DataFrame:
    """(id, distance) of the k vectors nearest by cosine, exactly; `where` filters before."""
    return distances(vectors if where is None else vectors.where(where), query, key, embedding).orderBy("distance", "id").limit(k)


def ranked(df: DataFrame, *order: Column | str) -> DataFrame:
    """Adds `rank` from 0, in the order; for lists already cut to a few rows."""
    return df.withColumn("rank", F.row_number().over(W.orderBy(*order)) - 1)


def fuse(first: DataFrame, second: DataFrame) -> DataFrame:
    """(id, rrf, dense_rank, sparse_rank) of two ranked lists: reciprocal ranks, weighted 0.6 and 0.4."""
    a, b = first.select("id", F.col("rank").alias("dense_rank")), second.select("id", F.col("rank").alias("sparse_rank"))
    part = lambda c, share: F.coalesce(share / (F.col(c) + RRF_K), F.lit(0.0))
    return a.join(b, "id", "full_outer").withColumn("rrf", part("dense_rank", DENSE_SHARE) + part("sparse_rank", SPARSE_SHARE))


def candidates(first: DataFrame, second: DataFrame, k: int, path: str = "path") -> DataFrame:
    """(id, ordinal): the best k of the fusion, then the best k sparse ones, then the best k sparse ones outside tests and docs.

    second has the column `path`. Ties of the fusion stand dense first, as they were put in."""
    fused = fuse(first, second)
    by_rrf = fused.withColumn("o", F.row_number().over(W.orderBy(F.desc("rrf"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank")))).where(F.col("o") <= k)
    sparse = second.where(F.col("rank") < k).select("id", (F.col("rank") + k + 1).alias("o"))
    source = second.where(~T.test_or_docs(F.col(path))).withColumn("o", F.row_number().over(W.orderBy("rank")) + 2 * k).where(F.col("o") <= 3 * k)
    every = by_rrf.select("id", "o").union(sparse).union(source.select("id", "o"))
    return every.groupBy("id").agg(F.min("o").alias("o")).select("id", F.row_number().over(W.orderBy("o")).alias("ordinal"))


def sparse_distance(score: Column, best: Column) -> Column:
    """A score as a distance, against the best one of its list."""
    return F.greatest(F.lit(0.05), F.least(F.lit(0.95), 1 - score / best))


def graph_distance(seed_distance: Column, weight: Column, most: Column) -> Column:
    """The estimated distance of what was reached by walking, from its seed's distance."""
    d = F.coalesce(seed_distance, F.lit(0.8))
    return F.greatest(F.lit(0.1), F.least(d * 0.8, d * (1 - F.least(F.lit(0.8), weight / most))))


def relevance(provenance: Column, distance: Column, weight: Column) -> Column:
    """One score for hits of every provenance."""
    near = 1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), distance))
    walked = F.when(weight > 0, F.least(F.lit(0.95), weight / 3)).otherwise(0.3) * 0.95
    return F.when(provenance.isin("vector", "sparse") & distance.isNotNull(), near).when(provenance == "graph", walked).otherwise(0.0)


def dominant(hits: DataFrame) -> DataFrame:
    """(community): those that the first five hits (ordinal, community_ids) name often: half as often as there are names, or once."""
    named = hits.orderBy("ordinal").limit(5).select(F.explode("community_ids").alias("community"))
    total = named.agg(F.count("*").alias("n"))
    return named.groupBy("community").count().join(F.broadcast(total)).where(F.col("count") >= F.greatest(F.lit(1), F.floor(F.col("n") / 2))).select("community")


def drop_overlaps(hits: DataFrame) -> DataFrame:
    """hits (query_id, file, ordinal, start_line, end_line, relevance, ...) without the worse of overlapping ones.

    In a file every hit is compared with the later ones in turn, and one that was itself removed meanwhile goes on comparing;
    so the outcome depends on the order and is worked out group by group (a group is a query's hits in one file)."""

    def keep(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ordinal")
        s, e, r = group["start_line"].tolist(), group["end_line"].tolist(), group["relevance"].tolist()
        gone = [False] * len(s)
        for i in range(len(s)):
            if gone[i]:
                continue
            for j in range(i + 1, len(s)):
                if not gone[j] and s[i] <= e[j] and s[j] <= e[i]:
                    gone[j if r[i] >= r[j] else i] = True
        return group[[not g for g in gone]]

    return hits.groupBy("query_id", "file").applyInPandas(keep, hits.schema)


def top_by_slug(hits: DataFrame, each: int, most: int) -> DataFrame:
    """The best `each` hits (slug, id, relevance, distance) of every repository, and the best `most` of all."""
    order = W.partitionBy("slug").orderBy(F.desc("relevance"), F.asc_nulls_last("distance"), "id")
    return hits.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= each).drop("_r").orderBy(F.desc("relevance"), F.asc_nulls_last("distance"), "id").limit(most)


def display_order(hits: DataFrame, path: str = "path") -> DataFrame:
    """Hits as a reader is shown them: files outside folders `test` and `docs` first, then by path and line."""
    aside = F.arrays_overlap(F.split(path, "/"), F.array(F.lit("test"), F.lit("docs")))
    return hits.orderBy(aside, path, "start_line")


def merged_vectors(parts: DataFrame) -> DataFrame:
    """(id, embedding) of vectors of a text's parts (id, embedding, length), averaged by length (1 at least)."""
    w = F.greatest(F.col("length"), F.lit(1)).cast("double")
    rows = parts.select("id", w.alias("w"), F.posexplode("embedding").alias("i", "x"))
    mean = rows.groupBy("id", "i").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("x"))
    return mean.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("embedding"))


def hybrid(chunks: DataFrame, vectors: DataFrame, query: str, query_vector: list[float], *, nodes: DataFrame | None = None, edges: DataFrame | None = None, pairs: DataFrame | None = None, top_k: int = 10, depth: int = 2, index: Postings | None = None) -> DataFrame:
    """Hybrid search: dense and BM25 lists, fusion, expansion on the graph, one order by relevance.

    chunks: id, path, start_line, end_line, content. vectors: id, embedding. nodes: id, label, community; edges: source,
    target, relation, confidence_score, seq; pairs (node id, chunk id). Without a graph the candidates are the result.
    Returns id, path, start_line, end_line, provenance, distance, weight, graph_path, relevance, best first.
    """
    from tessera.operators import traverse

    near = cut(ranked(dense(vectors, query_vector, top_k, key="id"), "distance", "id"))
    places = chunks.select("id", "path", "start_line", "end_line")
    found = cut(ranked(bm25(index or asked_postings(chunks, "id", "content", query), query, 5 * top_k).join(places.select("id", "path"), "id"), F.desc("score"), "id"))
    if not found.limit(1).count():
        chosen = near.select("id", (F.col("rank") + 1).alias("ordinal"))
    else:
        chosen = candidates(near, found, top_k)
    best = found.agg(F.max("score").alias("best"))
    hits = chosen.join(near.select("id", "distance"), "id", "left").join(found.select("id", "score"), "id", "left").join(F.broadcast(best))
    hits = cut(hits.select("id", "ordinal", F.when(F.col("distance").isNotNull(), "vector").otherwise("sparse").alias("provenance"), F.coalesce("distance", sparse_distance(F.col("score"), F.col("best"))).alias("distance"), F.lit(None).cast("double").alias("weight"), F.lit(None).cast("array<string>").alias("graph_path")))
    out = hits
    if nodes is not None and pairs is not None:
        by_node = pairs.select(F.col("node"), F.col("chunk").alias("id")).join(F.broadcast(hits.select("id", "ordinal", "distance")), "id")
        seeds = cut(by_node.groupBy("node").agg(F.min("ordinal").alias("rank"), F.min_by("distance", "ordinal").alias("seed_distance")))
        if seeds.limit(1).count():
            shown = hits.select("id", "ordinal").join(pairs.select(F.col("chunk").alias("id"), "node").join(nodes.select(F.col("id").alias("node"), "community"), "node"), "id")
            main = dominant(shown.groupBy("id", "ordinal").agg(F.array_sort(F.collect_set("community")).alias("community_ids")).join(hits.where("provenance = 'vector'").select("id"), "id", "left_semi"))
            weights = traverse.edge_weight(traverse.weights_for(query), [r[0] for r in main.collect()])
            c = nodes.select("id", "community")
            weighed = edges.join(c.withColumnRenamed("id", "source").withColumnRenamed("community", "c_source"), "source").join(c.withColumnRenamed("id", "target").withColumnRenamed("community", "c_target"), "target").withColumn("w", F.coalesce(weights, F.lit(0.0)))
            walked = traverse.expand_greedy(weighed, nodes, seeds.select(F.lit(0).alias("query_id"), F.col("node").alias("id"), (F.row_number().over(W.orderBy("rank", "node")) - 1).alias("rank")), depth)
            most = walked.agg(F.greatest(F.max("weight"), F.lit(1e-12)).alias("most"))
            new = walked.join(pairs.select(F.col("node").alias("id"), "chunk"), "id").join(hits.select(F.col("id").alias("chunk")), "chunk", "left_anti")
            new = new.join(seeds.select(F.col("node").alias("origin"), "seed_distance"), "origin", "left").join(F.broadcast(most))
            last = new.groupBy("chunk").agg(F.max_by(F.struct("weight", "path", graph_distance(F.col("seed_distance"), F.col("weight"), F.col("most")).alias("distance")), "ordinal").alias("b"), F.min("ordinal").alias("o"))
            out = hits.unionByName(last.select(F.col("chunk").alias("id"), (F.col("o") + 1000).alias("ordinal"), F.lit("graph").alias("provenance"), F.col("b.distance").alias("distance"), F.col("b.weight").alias("weight"), F.col("b.path").alias("graph_path")))
    full = out.join(places, "id").withColumn("relevance", relevance(F.col("provenance"), F.col("distance"), F.col("weight")))
    kept = drop_overlaps(full.withColumn("query_id", F.lit(0)).withColumnRenamed("path", "file")).withColumnRenamed("file", "path").drop("query_id")
    return kept.orderBy(F.desc("relevance"), F.asc_nulls_last("distance"), "ordinal")
