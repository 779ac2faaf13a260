"""Every registered query against its SQL in another engine, on the smallest tables."""

import duckdb
import pytest

from tessera.operators import graph, traverse
from tessera.plans import graph_queries, registry
from tessera.plans.derive import TABLES, Tables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return round(float(v), 4) + 0.0 if isinstance(v, float) or hasattr(v, "quantize") else v


def overlap_dedup(spark, columns, rows):
    """Against a plain walk over each query's hits of a file, one after the other."""
    groups = {}
    for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").orderBy("vec_id").collect():
        i = r["vec_id"]
        groups.setdefault((i // 200, r["label"]), []).append((i, i * 3 % 50, i * 3 % 50 + 4, i % 7 / 7))
    kept = set()
    for hits in groups.values():
        gone = set()
        for a, hit in enumerate(hits):
            for later in hits[a + 1 :] if hit[0] not in gone else ():
                if later[0] not in gone and hit[0] not in gone and hit[1] <= later[2] and later[1] <= hit[2]:
                    gone.add(later[0] if hit[3] >= later[3] else hit[0])
                elif later[0] not in gone and hit[1] <= later[2] and later[1] <= hit[2]:  # gone itself, and goes on comparing
                    gone.add(later[0] if hit[3] >= later[3] else hit[0])
        kept |= {h[0] for h in hits} - gone
    return kept == {r[columns.index("ordinal")] for r in rows}


def wilcoxon(spark, columns, rows):
    from tests.test_evaluate import plain_wilcoxon

    labels = {r["doc_id"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    tasks = {}
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect():
        if r["doc_id"] in labels:
            tasks.setdefault(r["doc_id"] // 20, {}).setdefault(r["doc_id"] % 2, []).append(len(r["text"]))
    pairs = [(sum(t[0]) / len(t[0]), sum(t[1]) / len(t[1])) for t in tasks.values() if len(t) == 2]
    return rows == [(round(plain_wilcoxon(*zip(*pairs)), 4), len(pairs))]


def whole(column):
    """A row for each node; that values are right is for test_graph, on small graphs and by brute force."""
    return lambda spark, columns, rows: sorted(r[columns.index("id")] for r in rows) == sorted(r["id"] for r in Tables(spark, FOLDER).nodes.collect()) and all(r[columns.index(column)] >= 0 for r in rows)


def hybrid_search(spark, columns, rows):
    """In order of relevance, each chunk once, and no two chunks of a file overlap."""
    hit = [dict(zip(columns, r)) for r in rows]
    apart = all(a["path"] != b["path"] or a["end_line"] < b["start_line"] or b["end_line"] < a["start_line"] for i, a in enumerate(hit) for b in hit[:i])
    found = [h["relevance"] for h in hit]
    return len(hit) > 5 and apart and found == sorted(found, reverse=True) and {h["provenance"] for h in hit} >= {"vector", "sparse"}


def expand_greedy(spark, columns, rows):
    """Against the plain walk over the whole graph in memory."""
    t = Tables(spark, FOLDER)
    label = {r["id"]: r["label"] for r in t.nodes.collect()}
    near = {}
    for r in graph.both_ways(graph_queries.weighed(t.simple).select("source", "target", "relation", "w", "seq")).orderBy("seq", "target").collect():
        near.setdefault(r["source"], []).append((r["target"], r["relation"], r["w"]))
    want = []
    for q, seeds in ((0, ["s_1", "s_2"]), (1, ["n_3"])):
        want += [(q, i, n, tuple(p), round(w, 4), o) for i, (n, p, w, o) in enumerate(traverse.greedy(near, label, seeds, 2))]
    return sorted(rows) == sorted(want)


def graph_questions(spark, columns, rows):
    return len(rows) == 7 and len(set(rows)) == 7 and {r[0] for r in rows} <= {"ambiguous", "verify", "isolated", "cohesion"}


CHECKED = {"overlap_dedup": overlap_dedup, "wilcoxon": wilcoxon, "louvain": whole("community"), "label_propagation": whole("community"), "betweenness": whole("betweenness"), "hybrid_search": hybrid_search, "expand_greedy": expand_greedy, "graph_questions": graph_questions}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, FOLDER)
    rows = [tuple(map(plain, r)) for r in df.collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert name in CHECKED and CHECKED[name](spark, df.columns, rows)
        return
    found = duck.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in df.columns]
    assert sorted(rows, key=repr) == sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)
