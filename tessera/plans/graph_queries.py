"""Queries of the graph operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import constants as C
from tessera.operators import analyze, community, extract, graph, traverse
from tessera.plans.derive import CHUNKS, EDGES, FILES, NODES, SIMPLE, Tables, big, query, r6

ATTRS = ["relation", "confidence", "confidence_score"]
#: Nodes with the number of their edges.
DEGREE = f"SELECT id, count(*) AS degree FROM (SELECT source AS id FROM ({SIMPLE}) s UNION ALL SELECT target FROM ({SIMPLE}) s) x GROUP BY 1"
WEIGHT = "CASE relation WHEN 'contains' THEN 0.15 WHEN 'method' THEN 0.3 ELSE 0.7 END * confidence_score"


def changed(t: Tables) -> DataFrame:
    """Nodes twice, the second time with another label for some and none for others."""
    again = t.nodes.where("seq % 3 = 0").withColumn("label", F.when(F.col("seq") % 2 == 0, F.upper("label"))).withColumn("seq", F.col("seq") + 10_000_000_000)
    return t.nodes.unionByName(again)


@query(f"SELECT id, CASE WHEN seq % 6 = 0 THEN upper(label) ELSE label END AS label, source_file, seq AS first_seq FROM ({NODES}) n")
def node_merge_last_wins(t: Tables) -> DataFrame:
    return graph.merge_nodes(changed(t), ["label", "source_file"])


@query(f"SELECT lo, hi, source, target, relation, confidence, round(confidence_score, 6) AS confidence_score, n FROM ({SIMPLE}) s")
def edge_collapse(t: Tables) -> DataFrame:
    return graph.collapse_edges(t.edges, ATTRS).select("lo", "hi", "source", "target", "relation", "confidence", r6("confidence_score"), "n")


@query(f"SELECT source, target, 'source' AS missing FROM ({EDGES}) e WHERE source LIKE 's%' AND CAST(substr(source, 3) AS BIGINT) % 5 = 0 UNION ALL SELECT source, target, 'target' FROM ({EDGES}) e WHERE target LIKE 's%' AND CAST(substr(target, 3) AS BIGINT) % 5 = 0")
def dangling_edges(t: Tables) -> DataFrame:
    gone = t.nodes.where("NOT (id LIKE 's%' AND CAST(substr(id, 3) AS BIGINT) % 5 = 0)")
    return graph.dangling(t.edges, gone)


@query(f"SELECT 'node' AS kind, id AS key, 'missing field' AS problem FROM ({NODES}) n WHERE seq % 50 = 0 UNION ALL SELECT 'node', id, 'file type' FROM ({NODES}) n WHERE seq % 70 = 0 UNION ALL SELECT 'edge', source || '>' || target, 'score' FROM ({EDGES}) e WHERE mark % 90 = 0 UNION ALL SELECT 'edge', source || '>' || target, 'confidence' FROM ({EDGES}) e WHERE mark % 110 = 0")
def extraction_violations(t: Tables) -> DataFrame:
    s, m = F.col("seq"), F.col("mark")
    nodes = t.nodes.withColumn("label", F.when(s % 50 != 0, F.col("label"))).withColumn("file_type", F.when(s % 70 == 0, "sound").otherwise("code"))
    edges = t.edges.withColumn("confidence_score", F.when(m % 90 == 0, 1.5).otherwise(F.col("confidence_score"))).withColumn("confidence", F.when(m % 110 == 0, "SURE").otherwise(F.col("confidence")))
    return graph.violations(nodes, edges)


@query(f"SELECT source, target, confidence, CAST(count(*) AS BIGINT) AS n FROM ({EDGES}) e WHERE relation = 'calls' GROUP BY 1, 2, 3")
def fuzzy_ids(t: Tables) -> DataFrame:
    """Ends written otherwise (S-12 for s_12) find their node again."""
    e = t.edges.where("relation = 'calls'").withColumn("source", F.upper(F.replace("source", F.lit("_"), F.lit("-"))))
    ok = graph.without_dangling(graph.remap_ends(e, t.nodes), t.nodes)
    return ok.groupBy("source", "target", "confidence").agg(F.count("*").alias("n"))


@query(f"SELECT id, label, CAST(degree AS BIGINT) AS degree FROM (SELECT n.id, n.label, d.degree, n.seq FROM ({NODES}) n JOIN ({DEGREE}) d ON n.id = d.id WHERE NOT contains(n.label, '/')) x ORDER BY degree DESC, seq LIMIT 10")
def degree_hubs(t: Tables) -> DataFrame:
    return graph.hubs(t.nodes.withColumnRenamed("seq", "first_seq"), t.simple, 10)


@query(f"SELECT id, vector_id FROM (SELECT 'e' || CAST(doc_id AS STRING) AS id, path, 1 + doc_id % 4 AS s, 6 + doc_id % 4 AS e FROM ({FILES}) f) n JOIN (SELECT path, start_line, end_line, sha256(concat_ws(chr(0), path, CAST(start_line AS STRING), CAST(end_line AS STRING), sha256(content))) AS vector_id FROM ({CHUNKS}) c0) c USING (path) WHERE s <= end_line AND e >= start_line")
def node_chunk_overlap(t: Tables) -> DataFrame:
    return graph.node_chunks(entities(t), t.chunks).select("id", "vector_id")


def entities(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    return t.files.select(F.concat(F.lit("e"), d.cast("string")).alias("id"), F.col("path").alias("source_file"), (1 + d % 4).alias("start_line"), (6 + d % 4).alias("end_line"), F.col("source").alias("label"), (d % 3).alias("community"), d.alias("first_seq"))


_PAIRS = f"SELECT id, label, community, doc_id, vector_id FROM (SELECT doc_id, 'e' || CAST(doc_id AS STRING) AS id, source AS label, doc_id % 3 AS community, path, 1 + doc_id % 4 AS s, 6 + doc_id % 4 AS e FROM ({FILES}) f) n JOIN (SELECT path, start_line, end_line, sha256(concat_ws(chr(0), path, CAST(start_line AS STRING), CAST(end_line AS STRING), sha256(content))) AS vector_id FROM ({CHUNKS}) c0) c USING (path) WHERE s <= end_line AND e >= start_line"


@query(f"SELECT vector_id AS chunk_id, list_sort(list(DISTINCT id)) AS ids FROM ({_PAIRS}) p GROUP BY 1")
def reverse_index(t: Tables) -> DataFrame:
    return graph.reverse_index(graph.node_chunks(entities(t), t.chunks))


@query(f"SELECT vector_id, string_agg(label, '|' ORDER BY doc_id) AS labels, min(community) AS community FROM ({_PAIRS}) p GROUP BY 1")
def chunk_metadata(t: Tables) -> DataFrame:
    m = graph.chunk_metadata(graph.node_chunks(entities(t), t.chunks), entities(t))
    return m.select("vector_id", F.array_join("labels", "|").alias("labels"), F.col("communities")[0].alias("community"))


#: Parts whose names repeat: two names for each brand and size, in either case and with marks.
_TWICE = "SELECT 'p_' || lpad(CAST(p_partkey AS STRING), 8, '0') AS id, CASE WHEN p_partkey % 3 = 0 THEN upper(p_brand) || '!' ELSE lower(p_brand) END || ' ' || CAST(p_size AS STRING) AS label, CAST(p_partkey AS BIGINT) AS seq FROM {part}"


@query(f"SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY regexp_replace(lower(label), '[^a-z0-9 ]', '', 'g') ORDER BY seq, label) AS r FROM ({_TWICE}) t) x WHERE r = 1")
def label_dedup(t: Tables) -> DataFrame:
    kept, _, _ = graph.dedup_labels(t.sql(_TWICE), t.simple.select("source", "target"))
    return kept.select("id", "label")


_OLD = "SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM {lineitem} WHERE l_linestatus = 'F'"
_NEW = "SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM {lineitem} WHERE l_linestatus = 'O'"


def snapshot(t: Tables, status: str) -> DataFrame:
    return t.lineitem.where(F.col("l_linestatus") == status).select(F.concat(F.lit("s_"), F.col("l_suppkey")).alias("source"), F.concat(F.lit("p_"), F.col("l_partkey")).alias("target"), F.lit("calls").alias("relation"))


@query(f"SELECT 'p_' || CAST(p AS STRING) AS id, 'added' AS change FROM (SELECT p FROM ({_NEW}) a EXCEPT SELECT p FROM ({_OLD}) b) x UNION ALL SELECT 'p_' || CAST(p AS STRING), 'removed' FROM (SELECT p FROM ({_OLD}) a EXCEPT SELECT p FROM ({_NEW}) b) x")
def graph_diff_nodes(t: Tables) -> DataFrame:
    side = lambda s: snapshot(t, s).select(F.col("target").alias("id"))
    return graph.diff_nodes(side("F"), side("O"))


@query(f"SELECT 'p_' || CAST(p AS STRING) AS lo, 's_' || CAST(s AS STRING) AS hi, 'calls' AS relation, change FROM (SELECT *, 'added' AS change FROM (({_NEW}) EXCEPT ({_OLD})) x UNION ALL SELECT *, 'removed' FROM (({_OLD}) EXCEPT ({_NEW})) y) z")
def graph_diff_edges(t: Tables) -> DataFrame:
    return graph.diff_edges(snapshot(t, "F"), snapshot(t, "O"))


@query(f"SELECT c.community, c.size, CAST(coalesce(i.inside, 0) AS BIGINT) AS inside, CASE WHEN c.size <= 1 THEN 1.0 ELSE round(coalesce(i.inside, 0) / (c.size * (c.size - 1) / 2.0), 4) END AS cohesion FROM (SELECT community, count(*) AS size FROM ({NODES}) n GROUP BY 1) c LEFT JOIN (SELECT a.community, count(*) AS inside FROM ({SIMPLE}) e JOIN ({NODES}) a ON e.source = a.id JOIN ({NODES}) b ON e.target = b.id WHERE a.community = b.community GROUP BY 1) i ON c.community = i.community")
def cohesion_by_community(t: Tables) -> DataFrame:
    return analyze.cohesion(t.nodes, t.simple)


@query(f"SELECT community, list_sort(list(id)) AS ids FROM ({NODES}) x GROUP BY 1")
def community_members(t: Tables) -> DataFrame:
    return analyze.members(t.nodes)


_ENDS = f"SELECT e.source, e.target, e.relation, e.confidence, a.source_file AS uf, b.source_file AS vf, a.community AS uc, b.community AS vc, a.label AS ul, b.label AS vl, da.degree AS ud, db.degree AS vd FROM ({SIMPLE}) e JOIN ({NODES}) a ON e.source = a.id JOIN ({NODES}) b ON e.target = b.id JOIN ({DEGREE}) da ON da.id = a.id JOIN ({DEGREE}) db ON db.id = b.id"
_CAT = "CASE WHEN {0} LIKE '%.py' OR {0} LIKE '%.ts' THEN 'code' ELSE 'doc' END"
_SURPRISE = f"CASE confidence WHEN 'AMBIGUOUS' THEN 3 WHEN 'INFERRED' THEN 2 ELSE 1 END + CASE WHEN {_CAT.format('uf')} <> {_CAT.format('vf')} THEN 2 ELSE 0 END + CASE WHEN split_part(uf, '/', 1) <> split_part(vf, '/', 1) THEN 2 ELSE 0 END + CASE WHEN uc <> vc THEN 1 ELSE 0 END + CASE WHEN least(ud, vd) <= 2 AND greatest(ud, vd) >= 5 THEN 1 ELSE 0 END"


@query(f"SELECT source, target, relation, confidence, CAST({_SURPRISE} AS BIGINT) AS score FROM ({_ENDS}) x WHERE relation NOT IN ('imports', 'imports_from', 'contains', 'method') AND uf <> vf")
def surprise_scores(t: Tables) -> DataFrame:
    return analyze.cross_file(t.simple, t.nodes)


@query(f"SELECT a, b, source, target, relation, confidence FROM (SELECT least(uc, vc) AS a, greatest(uc, vc) AS b, source, target, relation, confidence, row_number() OVER (PARTITION BY least(uc, vc), greatest(uc, vc) ORDER BY CASE confidence WHEN 'AMBIGUOUS' THEN 0 WHEN 'INFERRED' THEN 1 ELSE 2 END, source, target) AS r FROM ({_ENDS}) x WHERE uc <> vc AND relation NOT IN ('contains', 'method')) y WHERE r = 1")
def cross_community_edges(t: Tables) -> DataFrame:
    return analyze.cross_community(t.simple, t.nodes)


@query(f"SELECT n.id, n.label, CAST(coalesce(d.degree, 0) AS BIGINT) AS degree FROM ({NODES}) n LEFT JOIN ({DEGREE}) d ON n.id = d.id WHERE coalesce(d.degree, 0) <= 1")
def isolated_nodes(t: Tables) -> DataFrame:
    return analyze.isolated(t.nodes, t.simple)


@query(f"SELECT id, CAST(degree AS BIGINT) AS degree, CAST(inferred AS BIGINT) AS inferred FROM (SELECT id, count(*) AS degree, count(*) FILTER (WHERE confidence = 'INFERRED') AS inferred FROM (SELECT source AS id, confidence FROM ({SIMPLE}) s UNION ALL SELECT target, confidence FROM ({SIMPLE}) s) x GROUP BY 1) y WHERE inferred >= 2 ORDER BY degree DESC, id LIMIT 5")
def verify_inferred(t: Tables) -> DataFrame:
    return analyze.doubtful(t.nodes, t.simple)


@query(f"WITH e AS (SELECT source AS a, target AS b FROM ({SIMPLE}) s UNION ALL SELECT target, source FROM ({SIMPLE}) s), l1 AS (SELECT DISTINCT b AS id FROM e WHERE a = 'r_0' AND b <> 'r_0'), l2 AS (SELECT DISTINCT b AS id FROM e JOIN l1 ON e.a = l1.id WHERE b <> 'r_0' AND b NOT IN (SELECT id FROM l1)) SELECT 'r_0' AS id, CAST(0 AS BIGINT) AS level UNION ALL SELECT id, 1 FROM l1 UNION ALL SELECT id, 2 FROM l2")
def bfs_levels(t: Tables) -> DataFrame:
    return traverse.bfs(t.simple, t.nodes.where("id = 'r_0'").select("id"), 2).select("id", *big("level"))


def weighed(edges: DataFrame) -> DataFrame:
    return edges.withColumn("w", traverse.edge_weight(C.RELATION_WEIGHTS)).withColumn("seq", F.xxhash64("lo", "hi"))


@query(f"WITH e AS (SELECT source AS a, target AS b, {WEIGHT} AS w FROM ({SIMPLE}) s UNION ALL SELECT target, source, {WEIGHT} FROM ({SIMPLE}) s), h1 AS (SELECT b AS id, w, ['s_1', b] AS path FROM e WHERE a = 's_1'), h2 AS (SELECT e.b AS id, h1.w + e.w AS w, ['s_1', h1.id, e.b] AS path FROM h1 JOIN e ON e.a = h1.id WHERE e.b <> 's_1'), best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC, path DESC) AS r FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) x WHERE id <> 's_1') SELECT id, round(w, 6) AS weight, path FROM best WHERE r = 1 ORDER BY best.w DESC, id LIMIT 50")
def expand_bounded(t: Tables) -> DataFrame:
    return traverse.expand_bounded(weighed(t.simple), t.nodes.where("id = 's_1'").select("id")).select("id", r6("weight"), "path")


@query()
def expand_greedy(t: Tables) -> DataFrame:
    seeds = t.nodes.where("id IN ('s_1', 's_2', 'n_3')").select(F.when(F.col("id") == "n_3", 1).otherwise(0).alias("query_id"), "id", F.lit(0).alias("rank"))
    return traverse.expand_greedy(weighed(t.simple), t.nodes, seeds)


@query(f"SELECT o_orderkey, CAST(count(*) AS BIGINT) AS members FROM {{orders}} JOIN {{lineitem}} ON l_orderkey = o_orderkey GROUP BY 1")
def hyperedge_members(t: Tables) -> DataFrame:
    parts = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.col("l_partkey")).alias("nodes"))
    h = parts.join(t.orders.select(F.col("o_orderkey").alias("id")), "id").withColumn("relation", F.lit("order"))
    return graph.hyperedge_members(h).groupBy(F.col("id").alias("o_orderkey")).agg(F.count("*").alias("members"))


@query()
def louvain(t: Tables) -> DataFrame:
    return community.louvain(t.nodes, t.simple)


@query()
def betweenness(t: Tables) -> DataFrame:
    return community.betweenness(t.nodes, t.simple)


@query()
def label_propagation(t: Tables) -> DataFrame:
    return community.label_propagation(t.nodes, t.simple)


@query()
def graph_questions(t: Tables) -> DataFrame:
    return analyze.questions(t.nodes, t.simple)


#: Code of each document: as many functions as its number says, each of which calls the next.
_CALLED = "SELECT path, CASE WHEN path LIKE '%.py' THEN 'py' ELSE 'js' END AS kind, unnest(range(0, CAST(doc_id % 4 + 1 AS BIGINT))) AS k, doc_id % 4 AS last FROM (" + FILES + ") f WHERE doc_id % 5 < 2"
_STEM = "lower(regexp_replace(regexp_replace(path, '[.][^.]*$', ''), '[^0-9A-Za-z]+', '_', 'g')) || '_f'"


def coded(t: Tables) -> DataFrame:
    n = F.sequence(F.lit(0), (F.col("doc_id") % 4).cast("int"))
    body = lambda k: F.when(k == F.col("doc_id") % 4, F.lit("1")).otherwise(F.concat(F.lit("f"), (k + 1).cast("string"), F.lit("()")))
    py = lambda k: F.concat(F.lit("def f"), k.cast("string"), F.lit("():\n    x = 1\n    return "), body(k), F.lit("\n"))
    js = lambda k: F.concat(F.lit("function f"), k.cast("string"), F.lit("() {\n  return "), body(k), F.lit(";\n}\n"))
    code = F.when(F.col("path").endswith(".py"), F.array_join(F.transform(n, py), "")).when(F.col("path").endswith(".js"), F.array_join(F.transform(n, js), "")).otherwise(F.col("text"))
    return t.files.select("path", code.alias("text"))


@query(f"SELECT {_STEM} || CAST(k AS STRING) AS id, 'f' || CAST(k AS STRING) || '()' AS label, path AS source_file, CAST(3 * k + 1 AS BIGINT) AS start_line, CAST(3 * k + 3 AS BIGINT) AS end_line FROM ({_CALLED}) c UNION ALL SELECT lower(regexp_replace(path, '[^0-9A-Za-z]+', '_', 'g')), split_part(path, '/', -1), path, 1, NULL FROM ({FILES}) f WHERE doc_id % 5 < 2")
def extract_entities(t: Tables) -> DataFrame:
    return extract.extract(coded(t)).where("kind = 'node'").select("id", "label", "source_file", *big("start_line", "end_line"))


@query(f"SELECT {_STEM} || CAST(k AS STRING) AS source, {_STEM} || CAST(k + 1 AS STRING) AS target, path AS source_file, CASE kind WHEN 'py' THEN CAST(3 * k + 3 AS BIGINT) ELSE CAST(3 * k + 2 AS BIGINT) END AS line FROM ({_CALLED}) c WHERE k < last")
def extract_calls(t: Tables) -> DataFrame:
    return extract.extract(coded(t)).where("kind = 'edge' AND relation = 'calls'").select("source", "target", "source_file", F.col("start_line").cast("long").alias("line"))
