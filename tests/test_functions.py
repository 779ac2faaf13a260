"""Columns and small operators, each by what it should give."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import errors
from tessera.functions import text as T
from tessera.functions import values as V
from tessera.operators import chunking, evaluate, extract, graph
from tessera.operators._plan import mean_ranks, numbered
from tessera.plans.engine import embed
from tessera.sources import graphs, state


def of(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


def test_clamp(spark):
    for raw, want in (("0.4", 0.4), ("7", 1.0), ("-2", 0.0), ("odd", 0.0)):
        assert of(spark, V.clamp(F.lit(raw), 0.0, 1.0)) == want
    assert of(spark, V.clamp(F.lit("9"), 1, 5)) == 5 and of(spark, V.clamp(F.lit("x"), 1, 5)) == 1


def test_json_in_replies(spark):
    for raw in ('Sure:\n```json\n{"a": [1]}\n``` done', 'see {"a": [1]} there', '{"a": [1]}'):
        assert json.loads(of(spark, F.to_json(V.json_block(F.lit(raw))))) == {"a": [1]}
    assert json.loads(of(spark, F.to_json(V.json_block(F.lit("list: [1, 2]"))))) == [1, 2] and of(spark, V.json_block(F.lit("none")).isNull())


def test_slugs_in_cached_replies(spark):
    body = lambda x: V.names_slug(F.lit(json.dumps(x)), "o-r")
    assert [of(spark, body(x)) for x in ({"slug": "o-r"}, {"repos": ["x", "o-r"]}, {"results": [{"slug": "o-r"}]}, {"slug": "o-r2"}, {})] == [True, True, True, False, False]
    assert of(spark, V.distinct_trimmed(F.array(F.lit(" a"), F.lit("b "), F.lit("a")))) == ["a", "b"]


def test_candidates_as_tools(spark):
    assert [of(spark, V.candidate_tool(F.lit(x), F.lit("grep"), F.lit("hybrid"))) for x in ("Candidate 1", "Candidate 2", "Tie", "?")] == ["grep", "hybrid", "Tie", "Tie"]


def test_front_matter_and_packing(spark):
    assert of(spark, T.without_front_matter(F.lit("---\na: 1\n---\nbody\n---\n"))) == "body\n---\n" and of(spark, T.without_front_matter(F.lit("x\n---\ny\n---"))) == "x\n---\ny\n---"
    assert of(spark, T.packed(F.array(F.lit(1), F.lit(2)))) == "1|2" and of(spark, T.unpacked(F.lit("1|2"))) == ["1", "2"] and of(spark, T.unpacked(F.lit(""))) == []


def test_chunk_contents_and_firsts(spark):
    files = spark.createDataFrame([("a", "1\n2\n3\n4")], "path string, text string")
    chunks = spark.createDataFrame([("a", 2, 3, "v"), ("a", 0, 99, "w"), ("gone", 1, 2, "v")], "path string, start_line int, end_line int, vector_id string")
    assert {(r["path"], r["start_line"]): r["content"] for r in chunking.content_of(chunks, files).collect()} == {("a", 2): "2\n3", ("a", 0): "1\n2\n3\n4", ("gone", 1): ""}
    assert sorted((r["vector_id"], r["path"]) for r in chunking.first_of_each(chunks).collect()) == [("v", "a"), ("w", "a")]


def test_reconciled_paths(spark):
    flagged = spark.createDataFrame([(1, "src/a.py:3"), (1, "gone.py"), (2, "words")], "run_id int, entry string")
    got = evaluate.reconciled(flagged, spark.createDataFrame([("src/a.py",)], "path string"))
    assert sorted(map(tuple, got.collect())) == [(1, "gone.py", "missing"), (1, "src/a.py", "unsupported")]


def test_merge_and_grow(spark):
    node = lambda *rows: spark.createDataFrame(list(rows), "id string, source_file string, seq long")
    old = node(("a", "f", 0), ("b", "g", 1))
    both = graph.merge_and_grow(old, node(("a", "f", 0), ("c", "h", 1)))
    assert sorted(r["seq"] for r in both.collect()) == [0, 1, 2, 3] and graph.merge_nodes(both, ["source_file"]).count() == 3
    assert sorted(r["id"] for r in graph.merge_and_grow(old, node(("c", "h", 0)), spark.createDataFrame([("g",)], "source_file string")).collect()) == ["a", "c"]


def test_graph_files_go_round(spark, tmp_path):
    doc = {"nodes": [{"id": "a", "label": "A", "file_type": "code", "source_file": "a.py", "source_location": "L7", "end_line": 9}, {"id": "b", "label": "B", "source_location": "top"}], "links": [{"source": "a", "target": "b", "relation": "calls", "confidence_score": 0.5}]}
    (tmp_path / "graph.json").write_text(json.dumps(doc))
    n, e = graphs.read_graph(spark, f"file://{tmp_path}/graph.json")
    assert [(r["seq"], r["id"], r["start_line"], r["end_line"]) for r in n.orderBy("seq").collect()] == [(0, "a", 7, 9), (1, "b", None, None)]
    assert [(r["source"], r["target"], r["relation"], r["confidence_score"]) for r in e.collect()] == [("a", "b", "calls", 0.5)]
    (tmp_path / "edges.json").write_text(json.dumps({"nodes": doc["nodes"], "edges": doc["links"]}))
    assert graphs.read_graph(spark, f"file://{tmp_path}/edges.json")[1].count() == 1
    graphs.write_graph(n.select("id", "label"), e.select("source", "target", "relation"), f"file://{tmp_path}/out.json")
    assert sorted(r["id"] for r in graphs.read_graph(spark, f"file://{tmp_path}/out.json")[0].collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        graphs.read_graph(spark, "graph.txt")
    (tmp_path / "map.json").write_text(json.dumps({"a.py": [{"file": "a.py", "start_line": 1, "end_line": 4, "hash": "h", "embeddable": True}], "b.py": []}))
    assert [(r["path"], r["start_line"], r["end_line"], r["hash"]) for r in graphs.read_chunk_map(spark, f"file://{tmp_path}/map.json").collect()] == [("a.py", 1, 4, "h")]


def test_files_changed_since_a_manifest(spark, tmp_path):
    now = spark.createDataFrame([("a", 1), ("b", 2)], "path string, mtime int")
    later = spark.createDataFrame([("a", 1), ("b", 3), ("c", 1)], "path string, mtime int")
    assert {r["path"]: r["state"] for r in state.changed_since(later, now).collect()} == {"a": "unchanged", "b": "changed", "c": "new"}


class Failed(Exception):
    def __init__(self, status, text="", body=None):
        super().__init__(text)
        self.status_code, self.body = status, body


def test_errors_of_services():
    assert errors.too_long(Failed(400, "", {"error": {"message": "The request has 9000 tokens, which exceeds the limit"}})) and errors.too_long(Failed(400, "Context_Length_Exceeded"))
    assert not errors.too_long(Failed(400, "bad key")) and not errors.too_long(Failed(500, "context length")) and errors.too_long(ValueError()) and not errors.too_long(KeyError())
    assert errors.limited(Failed(429)) and errors.passing(Failed(503)) and errors.passing(RuntimeError("llama.cpp terminated unexpectedly")) and not errors.passing(Failed(404))


def test_retries():
    def after(*failures):
        left = list(failures)

        def call():
            if left:
                raise left.pop(0)
            return "done"

        return call

    slept = []
    assert errors.with_retries(after(*[Failed(429)] * 4, *[Failed(500)] * 3), slept.append) == "done" and slept == [5.0] * 4 + [2.0, 4.0, 6.0]
    for bad in ([Failed(500)] * 4, [Failed(401)], [Failed(429)] * (errors.MOST_WAITS + 1)):
        with pytest.raises(Failed):
            errors.with_retries(after(*bad), slept.append)


def test_other_errors_of_embedding_end_the_build(spark):
    def broken(texts):
        raise KeyError("no key")

    c = spark.createDataFrame([("a", "1234")], "vector_id string, content string")
    with pytest.raises(Exception, match="no key"):
        embed(c, broken).collect()


def test_script_entities_have_last_lines():
    text = "class A extends B {\n  go() {\n    f();\n  }\n}\nfunction f() {\n  return 1;\n}\nconst g = x => x + 1;\nif (g(1)) {\n  f();\n}\nconst h = async (x) => {\n  g(x);\n};\n"
    rows = extract.script_rows("w/a.ejs", text)
    assert {r["label"]: (r["start_line"], r["end_line"]) for r in rows if r["kind"] == "node"} == {"a.ejs": (1, None), "A": (1, 5), ".go()": (2, 4), "f()": (6, 8), "g()": (9, 9), "h()": (13, 15)}
    calls = {(r["source"], r["target"]) for r in rows if r.get("relation") == "calls"}
    assert calls == {("w_a_a_go", "w_a_f"), ("w_a_h", "w_a_g")}


def test_numbers_and_ranks_over_ranges(spark):
    d = spark.createDataFrame([(i * 7 % 50 // 2,) for i in range(50)], "v int").repartition(5)
    got = [(r["v"], r["k"]) for r in numbered(d, "k", F.desc("v")).orderBy("k").collect()]
    assert [k for _, k in got] == list(range(50)) and [v for v, _ in got] == sorted((r["v"] for r in d.collect()), reverse=True)
    assert {r["v"]: r["r"] for r in mean_ranks(d, "v", "r").collect()} == {v: 2 * v + 1.5 for v in range(25)}
