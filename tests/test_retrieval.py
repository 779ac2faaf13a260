import math
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import values as V
from tessera.operators import retrieval as R
from tessera.plans import registry


def plain_bm25(docs, query):
    toks = {k: re.findall(r"[a-z0-9_]+", t.lower()) for k, t in docs.items()}
    n, mean = len(docs), sum(map(len, toks.values())) / len(docs)
    df = {}
    for t in toks.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: floor if x < 0 else x for w, x in idf.items()}
    out = {}
    for k, t in toks.items():
        s = sum(idf.get(q, 0) * t.count(q) * 2.5 / (t.count(q) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for q in re.findall(r"[a-z0-9_]+", query.lower()))
        if s > 0:
            out[k] = s
    return out


def test_bm25_against_a_plain_one(spark):
    docs = {"a": "red fox red", "b": "blue fox", "c": "green tree and fox", "d": "red", "e": ""}
    index = R.postings(spark.createDataFrame(list(docs.items()), "id string, text string"), "id", "text")
    for q in ("red fox", "red red", "nothing", "tree"):
        assert {r["id"]: pytest.approx(r["score"]) for r in R.bm25(index, q).collect()} == plain_bm25(docs, q)


def test_postings_of_a_query_are_of_its_terms_and_weigh_as_those_of_all(spark):
    docs = {"a": "red fox red", "b": "blue fox", "c": "green tree and fox", "d": "red", "e": "", "f": None}
    d = spark.createDataFrame(list(docs.items()), "id string, text string")
    for q in ("red fox", "red red", "nothing", "tree"):
        index = R.asked_postings(d, "id", "text", q)
        assert {r["term"] for r in index.postings.collect()} <= set(q.split())
        assert {r["id"]: pytest.approx(r["score"]) for r in R.bm25(index, q).collect()} == plain_bm25({k: t or "" for k, t in docs.items()}, q)
    twice = R.asked_postings(d.union(d), "id", "text", "red")
    assert twice.postings.where("id = 'a' AND term = 'red'").first()["tf"] == 4


def hits(spark, rows):
    return spark.createDataFrame([(0, "f", i, a, b, r) for i, (a, b, r) in enumerate(rows)], "query_id int, file string, ordinal int, start_line int, end_line int, relevance double")


def test_removed_rows_still_remove(spark):
    # the first loses to the second, and still removes the third, which it beats and which the second does not touch
    got = R.drop_overlaps(hits(spark, [(1, 10, 0.5), (1, 4, 0.9), (8, 12, 0.1)])).collect()
    assert [r["ordinal"] for r in got] == [1]


def test_sparse_distance_and_relevance(spark):
    one = spark.range(1)
    d = lambda s: one.select(R.sparse_distance(F.lit(s), F.lit(10.0))).first()[0]
    assert d(9.0) == pytest.approx(0.1) and d(1.0) == pytest.approx(0.9) and d(10.0) == 0.05
    rel = lambda k, dist, w: one.select(R.relevance(F.lit(k), F.lit(dist).cast("double"), F.lit(w).cast("double"))).first()[0]
    assert rel("vector", 0.2, None) == pytest.approx(0.8) and rel("graph", 0.2, 1.5) == pytest.approx(0.475) and rel("graph", 0.2, None) == pytest.approx(0.285) and rel("odd", 0.2, 1.0) == 0.0


def test_sparse_hits_survive_the_cut(spark):
    near = spark.createDataFrame([("v", 0)], "id string, rank int")
    found = spark.createDataFrame([("t", 0, "tests/a.py"), ("s", 1, "src/a.py")], "id string, rank int, path string")
    assert [r["id"] for r in R.candidates(near, found, 1).orderBy("ordinal").collect()] == ["v", "t", "s"]


def test_display_order(spark):
    h = spark.createDataFrame([("docs/a.md", 1), ("src/b.py", 9), ("src/b.py", 2), ("a/test/x.py", 1), ("tests/y.py", 1)], "path string, start_line int")
    assert [tuple(r) for r in R.display_order(h).collect()] == [("src/b.py", 2), ("src/b.py", 9), ("tests/y.py", 1), ("a/test/x.py", 1), ("docs/a.md", 1)]


def test_dominant(spark):
    h = spark.createDataFrame([(i, c) for i, c in enumerate([[1], [1], [2], [1, 2], [3], [9]])], "ordinal int, community_ids array<int>")
    assert [r[0] for r in R.dominant(h).collect()] == [1]


def test_vectors_merge_by_length(spark):
    p = spark.createDataFrame([("a", [1.0, 0.0], 3), ("a", [0.0, 1.0], 1), ("a", [4.0, 4.0], 0)], "id string, embedding array<double>, length int")
    assert R.merged_vectors(p).first()["embedding"] == pytest.approx([7 / 5, 1.0])


def test_cosine_zero_and_unequal(spark):
    one = spark.range(1)
    a = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one.select(V.cosine(a(0, 0), a(1, 2))).first()[0] == 0.0
    with pytest.raises(Exception, match="differ in length"):
        one.select(V.cosine(a(1), a(1, 2))).collect()


def test_identical_text_has_two_identities(spark):
    r = spark.createDataFrame([("a.py",), ("b.py",)], "p string").select(V.vector_id(F.col("p"), F.lit(1), F.lit(2), F.lit("h")).alias("v")).distinct()
    assert r.count() == 2


def test_overlap_query_takes_every_vector(spark):
    """Hits of each two hundred vectors: none of a query removes one of another, and each query keeps some."""
    folder = "/root/testdata/sf0.01"
    ids = {r["vec_id"] for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    got = registry.queries()["overlap_dedup"](spark, folder).collect()
    assert {r["query_id"] for r in got} == {i // 200 for i in ids} and len(got) > 200 // 5
