"""Queries of the retrieval and evaluation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import evaluate, retrieval
from tessera.operators._plan import cut
from tessera.plans.derive import FILES, Tables, big, query, r6
from tessera.plans.engine import hashed_embedding

ASKED = "SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM {benchmark} WHERE item_id = 0"
BM25 = f"""WITH w AS (SELECT path AS id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')) AS term FROM ({FILES}) f),
l AS (SELECT path AS id, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')) AS len FROM ({FILES}) f),
s AS (SELECT count(*) AS n, avg(len) AS mean FROM l), tf AS (SELECT id, term, count(*) AS tf FROM w GROUP BY 1, 2),
i0 AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1) d, s),
i AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM i0) ELSE raw END AS idf FROM i0),
q AS (SELECT term, count(*) AS times FROM ({ASKED}) a GROUP BY 1),
b AS (SELECT tf.id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))) AS score FROM tf JOIN q USING (term) JOIN i USING (term) JOIN l ON l.id = tf.id, s GROUP BY 1 HAVING score > 0)"""
DENSE = "SELECT vec_id AS id, 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM {embeddings} WHERE vec_id = 0)) AS distance, label FROM {embeddings}"


def question(t: Tables) -> str:
    return t.benchmark.where("item_id = 0").select("text").first()[0]


def probe(t: Tables) -> DataFrame:
    return t.embeddings.where("vec_id = 0").select("embedding")


def sparse(t: Tables, k: int | None = None) -> DataFrame:
    q = question(t)
    return retrieval.bm25(retrieval.asked_postings(t.files, "path", "text", q), q, k)


@query(BM25 + " SELECT id, round(score, 6) AS score FROM b ORDER BY b.score DESC, id LIMIT 20")
def bm25_topk(t: Tables) -> DataFrame:
    return sparse(t, 20).select("id", r6("score"))


@query(f"SELECT id, round(distance, 6) AS distance FROM ({DENSE}) d ORDER BY d.distance, id LIMIT 10")
def dense_topk(t: Tables) -> DataFrame:
    return retrieval.dense(t.embeddings, probe(t), 10).select("id", r6("distance"))


@query(f"SELECT id, round(distance, 6) AS distance FROM ({DENSE}) d WHERE label = 3 ORDER BY d.distance, id LIMIT 10")
def dense_filtered(t: Tables) -> DataFrame:
    return retrieval.dense(t.embeddings, probe(t), 10, where=F.col("label") == 3).select("id", r6("distance"))


def lists(t: Tables) -> tuple[DataFrame, DataFrame]:
    """A dense list and a sparse one over documents: the vector of a number stands for the document of that number."""
    path = t.files.select(F.col("doc_id").alias("id"), "path")
    near = retrieval.dense(t.embeddings, probe(t), 10).join(path, "id").select(F.col("path").alias("id"), "distance")
    found = sparse(t, 50).withColumn("path", F.col("id"))
    return retrieval.ranked(near, "distance", "id"), retrieval.ranked(found.withColumn("score", F.round("score", 9)), F.desc("score"), "id")


_LISTS = (
    BM25
    + f""", sp AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM (SELECT id, round(score, 9) AS score FROM b ORDER BY b.score DESC, id LIMIT 50) x),
de AS (SELECT path AS id, distance, row_number() OVER (ORDER BY distance, path) - 1 AS rank FROM (SELECT * FROM ({DENSE}) d ORDER BY distance, id LIMIT 10) y JOIN ({FILES}) f ON f.doc_id = y.id),
fu AS (SELECT coalesce(de.id, sp.id) AS id, coalesce(0.6 / (de.rank + 60), 0) + coalesce(0.4 / (sp.rank + 60), 0) AS rrf, de.rank AS dr, sp.rank AS sr FROM de FULL JOIN sp ON de.id = sp.id)"""
)


@query(_LISTS + " SELECT id, round(rrf, 8) AS rrf FROM fu")
def rrf_fusion(t: Tables) -> DataFrame:
    return retrieval.fuse(*lists(t)).select("id", F.round("rrf", 8).alias("rrf"))


_CANDIDATES = (
    _LISTS
    + """, c AS (SELECT id, min(o) AS o FROM (SELECT id, o FROM (SELECT id, row_number() OVER (ORDER BY rrf DESC, dr ASC NULLS LAST, sr ASC NULLS LAST) AS o FROM fu) x WHERE o <= 10
UNION ALL SELECT id, rank + 11 FROM sp WHERE rank < 10 UNION ALL SELECT id, o FROM (SELECT id, row_number() OVER (ORDER BY rank) + 20 AS o FROM sp WHERE NOT contains('/' || id, '/tests/')) x WHERE o <= 30) y GROUP BY 1)"""
)


@query(_CANDIDATES + " SELECT id, CAST(row_number() OVER (ORDER BY o) AS BIGINT) AS ordinal FROM c")
def candidate_union(t: Tables) -> DataFrame:
    return retrieval.candidates(*lists(t), 10).select("id", *big("ordinal"))


@query(
    _CANDIDATES
    + " SELECT c.id, round(CASE WHEN de.distance IS NOT NULL THEN 1 - least(1.0, greatest(0.0, de.distance)) ELSE 1 - greatest(0.05, least(0.95, 1 - sp.score / (SELECT max(score) FROM sp))) END, 6) AS relevance FROM c LEFT JOIN de ON de.id = c.id LEFT JOIN sp ON sp.id = c.id"
)
def relevance_rank(t: Tables) -> DataFrame:
    near, found = lists(t)
    best = found.agg(F.max("score").alias("best"))
    j = retrieval.candidates(near, found, 10).join(near.select("id", "distance"), "id", "left").join(found.select("id", "score"), "id", "left").join(F.broadcast(best))
    kind = F.when(F.col("distance").isNotNull(), "vector").otherwise("sparse")
    d = F.coalesce("distance", retrieval.sparse_distance(F.col("score"), F.col("best")))
    return j.select("id", r6(retrieval.relevance(kind, d, F.lit(None).cast("double")), "relevance"))


@query(f"SELECT slug, id, round(relevance, 6) AS relevance FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY relevance DESC, distance, id) AS r FROM (SELECT CAST(label AS STRING) AS slug, id, distance, 1 - least(1.0, greatest(0.0, distance)) AS relevance FROM ({DENSE}) d) x) y WHERE r <= 5 ORDER BY y.relevance DESC, distance, id LIMIT 20")
def multi_source_topk(t: Tables) -> DataFrame:
    hits = retrieval.distances(t.embeddings, probe(t)).join(t.embeddings.select(F.col("vec_id").alias("id"), "label"), "id")
    hits = hits.select(F.col("label").cast("string").alias("slug"), "id", "distance", retrieval.relevance(F.lit("vector"), F.col("distance"), F.lit(None).cast("double")).alias("relevance"))
    return retrieval.top_by_slug(hits, 5, 20).select("slug", "id", r6("relevance"))


@query(f"SELECT CAST(label AS BIGINT) AS community FROM (SELECT * FROM ({DENSE}) d ORDER BY distance, id LIMIT 5) x GROUP BY 1 HAVING count(*) >= 2")
def dominant_communities(t: Tables) -> DataFrame:
    top = retrieval.ranked(retrieval.dense(t.embeddings, probe(t), 10), "distance", "id").withColumnRenamed("rank", "ordinal")
    hits = top.join(t.embeddings.select(F.col("vec_id").alias("id"), F.array(F.col("label").cast("long")).alias("community_ids")), "id")
    return retrieval.dominant(hits)


@query("SELECT label AS id, i, round(sum(x * w) / sum(w), 6) AS x FROM (SELECT label, vec_id % 3 + 1 AS w, unnest(range(0, len(embedding))) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM {embeddings}) y GROUP BY 1, 2")
def vector_merge(t: Tables) -> DataFrame:
    parts = t.embeddings.select(F.col("label").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), (F.col("vec_id") % 3 + 1).alias("length"))
    return retrieval.merged_vectors(parts).select("id", F.posexplode("embedding").alias("i", "x")).select("id", *big("i"), r6("x"))


@query()
def overlap_dedup(t: Tables) -> DataFrame:
    """Every vector is a hit; each two hundred in a row are those of one query."""
    hits = t.embeddings.select(F.floor(F.col("vec_id") / 200).cast("int").alias("query_id"), F.concat(F.lit("f"), F.col("label")).alias("file"), F.col("vec_id").cast("int").alias("ordinal"), (F.col("vec_id") * 3 % 50).cast("int").alias("start_line"), (F.col("vec_id") * 3 % 50 + 4).cast("int").alias("end_line"), (F.col("vec_id") % 7 / 7).alias("relevance"))
    return retrieval.drop_overlaps(hits)


@query()
def hybrid_search(t: Tables) -> DataFrame:
    """The flagship: dense and BM25 lists over the chunks of documents, fused, expanded on the graph of documents by source, ranked."""
    from tessera.operators import graph
    from tessera.plans.engine import embed

    chunks = cut(t.chunks).withColumnRenamed("path", "file").select(F.col("vector_id").alias("id"), F.col("file").alias("path"), "start_line", "end_line", "content", "vector_id")
    vectors = embed(chunks.select("vector_id", "content")).select(F.col("vector_id").alias("id"), "embedding")
    d = t.files
    nodes = d.select(F.concat(F.lit("d_"), F.col("doc_id")).alias("id"), F.col("path").alias("label"), F.col("path").alias("source_file"), F.lit(1).alias("start_line"), F.lit(1000).alias("end_line"), (F.col("doc_id") % 5).cast("int").alias("community"))
    near = d.select(F.concat(F.lit("d_"), F.col("doc_id")).alias("source"), F.concat(F.lit("d_"), F.col("doc_id") + 1).alias("target"), F.lit("calls").alias("relation"), F.lit(0.9).alias("confidence_score"), F.col("doc_id").alias("seq"))
    edges = graph.without_dangling(near, nodes)
    pairs = graph.node_chunks(nodes, chunks.select(F.col("path"), "start_line", "end_line", "vector_id", F.lit("").alias("hash"))).select(F.col("id").alias("node"), F.col("vector_id").alias("chunk"))
    q = question(t)
    return retrieval.hybrid(chunks.drop("vector_id"), vectors, q, hashed_embedding([q])[0], nodes=nodes, edges=edges, pairs=pairs)


_CITED = "SELECT doc_id, 'see ' || source || '/a.py:' || CAST(doc_id % 9 AS STRING) || ' and b.ts line ' || CAST(doc_id % 4 + 1 AS STRING) || ', b.ts:' || CAST(doc_id % 4 + 1 AS STRING) || '-9' AS answer, source FROM {documents}"


def answers(t: Tables) -> DataFrame:
    return t.sql(_CITED).withColumnRenamed("doc_id", "run_id")


@query(f"SELECT doc_id AS run_id, source || '/a.py:' || CAST(doc_id % 9 AS STRING) AS citation, source || '/a.py' AS file, doc_id % 9 AS line FROM {{documents}} UNION ALL SELECT doc_id, 'b.ts:' || CAST(doc_id % 4 + 1 AS STRING), 'b.ts', doc_id % 4 + 1 FROM {{documents}}")
def citations(t: Tables) -> DataFrame:
    return evaluate.cited(answers(t)).select("run_id", "citation", "file", *big("line"))


@query("SELECT doc_id AS run_id, CASE WHEN source IN ('src0', 'src1', 'src2') THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS rate, CAST(2 AS BIGINT) AS n FROM {documents}")
def citation_existence(t: Tables) -> DataFrame:
    files = t.spark.createDataFrame([(f"src{i}/a.py",) for i in range(3)], "path string")
    return evaluate.existence_rate(evaluate.existing(evaluate.cited(answers(t)), files))


RUNS = "SELECT doc_id AS task, CASE WHEN doc_id % 2 = 0 THEN 'hybrid' ELSE 'grep' END AS tool, CAST(quality AS DOUBLE) AS score, CAST(length(text) AS BIGINT) AS tokens, CAST(doc_id % 17 AS DOUBLE) AS seconds, quality = 1 AS won FROM {labels} JOIN {documents} USING (doc_id)"
_WILSON = "greatest(0.0, (p + 1.9208 / n - 1.96 * sqrt((p * (1 - p) + 0.9604 / n) / n)) / (1 + 3.8416 / n)) AS low, least(1.0, (p + 1.9208 / n + 1.96 * sqrt((p * (1 - p) + 0.9604 / n) / n)) / (1 + 3.8416 / n)) AS high"


@query(f"SELECT tool, n, round(mean_score, 6) AS mean_score, median_tokens, median_seconds, wins FROM (SELECT tool, count(*) AS n, avg(score) AS mean_score, median(tokens) AS median_tokens, median(seconds) AS median_seconds, count(*) FILTER (WHERE won) AS wins FROM ({RUNS}) r GROUP BY 1) x")
def tool_profile(t: Tables) -> DataFrame:
    return evaluate.profile(t.sql(RUNS)).select("tool", "n", r6("mean_score"), "median_tokens", "median_seconds", "wins")


@query(f"SELECT tool, round(low, 6) AS low, round(high, 6) AS high FROM (SELECT tool, {_WILSON} FROM (SELECT tool, count(*) AS n, avg(CAST(won AS INT)) AS p FROM ({RUNS}) r GROUP BY 1) x) y")
def wilson(t: Tables) -> DataFrame:
    return evaluate.profile(t.sql(RUNS)).select("tool", r6("low"), r6("high"))


_RANKS = f"SELECT rank() OVER (ORDER BY tokens) + (count(*) OVER (PARTITION BY tokens) - 1) / 2.0 AS x, rank() OVER (ORDER BY won) + (count(*) OVER (PARTITION BY won) - 1) / 2.0 AS y FROM ({RUNS}) r"


@query(f"SELECT round(corr(x, y), 6) AS rho, count(*) AS n, corr(x, y) > 0.3 AS flagged FROM ({_RANKS}) z")
def spearman_length_win(t: Tables) -> DataFrame:
    b = evaluate.length_bias(t.sql(RUNS), "tokens", "won")
    return b.select(r6("rho"), "n", "flagged")


@query("SELECT CAST(k AS BIGINT) AS wins, CAST(m AS BIGINT) AS losses, round(least(1.0, 2 * (SELECT sum(exp(lgamma(k + m + 1.0) - lgamma(i + 1.0) - lgamma(k + m - i + 1.0) - (k + m) * ln(2))) FROM (SELECT unnest(range(0, least(k, m) + 1)) AS i) s)), 6) AS p FROM (SELECT count(*) FILTER (WHERE label < 4) AS k, count(*) FILTER (WHERE label >= 4 AND label < 8) AS m FROM {embeddings}) x")
def sign_test(t: Tables) -> DataFrame:
    a = t.embeddings.agg(F.count_if(F.col("label") < 4).alias("wins"), F.count_if((F.col("label") >= 4) & (F.col("label") < 8)).alias("losses"))
    return a.select("wins", "losses", r6(evaluate.sign_test(F.col("wins"), F.col("losses")), "p"))


_VOTES = "SELECT doc_id // 5 AS task, CASE WHEN quality = 1 AND doc_id % 3 = 0 THEN 'grep' WHEN quality = 1 THEN 'hybrid' ELSE 'Tie' END AS winner FROM {labels}"


@query(f"SELECT task, CASE WHEN leaders = 1 THEN w ELSE 'Tie' END AS winner, CASE WHEN n = 1 THEN 'high' WHEN leaders = 1 AND 2 * k > n THEN 'medium' ELSE 'low' END AS confidence, CAST(n AS BIGINT) AS n FROM (SELECT task, count(*) AS leaders, min(winner) AS w, max(k) AS k, max(n) AS n FROM (SELECT task, winner, k, max(k) OVER (PARTITION BY task) AS most, sum(k) OVER (PARTITION BY task) AS n FROM (SELECT task, winner, count(*) AS k FROM ({_VOTES}) v GROUP BY 1, 2) a) b WHERE k = most GROUP BY 1) c")
def majority_verdict(t: Tables) -> DataFrame:
    v = t.labels.select(F.floor(F.col("doc_id") / 5).cast("long").alias("task"), F.when((F.col("quality") == 1) & (F.col("doc_id") % 3 == 0), "grep").when(F.col("quality") == 1, "hybrid").otherwise("Tie").alias("winner"), F.lit("high").alias("confidence"))
    return evaluate.majority(v)


@query("SELECT task, round(avg(greatest(0.0, s)), 6) AS agreement, count(*) AS pairs FROM (SELECT a.vec_id // 6 AS task, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM {embeddings} a JOIN {embeddings} b ON a.vec_id // 6 = b.vec_id // 6 AND a.vec_id < b.vec_id) x GROUP BY 1")
def run_agreement(t: Tables) -> DataFrame:
    """Each six vectors in a row stand for the runs of a task."""
    runs = t.embeddings.select(F.floor(F.col("vec_id") / 6).cast("long").alias("task"), F.col("vec_id").alias("seed"), "embedding")
    return evaluate.agreement(runs).select("task", r6("agreement"), "pairs")


@query()
def wilcoxon(t: Tables) -> DataFrame:
    runs = t.sql(RUNS).select(F.floor(F.col("task") / 20).alias("task"), "tool", F.col("tokens").alias("score"))
    return evaluate.wilcoxon(runs, "hybrid", "grep")
