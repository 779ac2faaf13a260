import pytest
from pyspark.sql import functions as F

from tessera.operators import judge
from tessera.sources import state
from tessera.sources.store import Store
from tessera.sources.vectors import Collection, approximate

ROW = "vector_id string, embedding array<double>, document string, file string, slug string, hash string"


def test_collection(spark, tmp_path):
    c, other = (Collection(Store(spark, f"file://{tmp_path}"), n) for n in ("one", "two"))
    rows = spark.createDataFrame([("a", [1.0, 0.0], "x", "f", "s", "h1"), ("b", [0.0, 1.0], "y", "g", "s", "h2"), ("c", [1.0, 1.0], "z", "g", "t", "h3")], ROW)
    assert not c.exists() and c.count() == 0 and c.upsert(rows) == 3
    assert [r["id"] for r in c.search([1.0, 0.1], 2).collect()] == ["a", "c"]
    assert [r["id"] for r in c.search([1.0, 0.1], 2, F.col("slug") == "t").collect()] == ["c"]
    assert c.update(spark.createDataFrame([("a", "new")], "vector_id string, document string")) == 3
    assert {r["vector_id"]: r["document"] for r in c.rows().collect()} == {"a": "new", "b": "y", "c": "z"}
    ids = spark.createDataFrame([("a",), ("zz",)], "vector_id string")
    assert other.copy_from(c, ids) == 1 and [r[0] for r in c.missing(ids).collect()] == ["zz"]
    assert {r["problem"] for r in c.validate(rows.where("vector_id <> 'b'").withColumn("hash", F.lit("h1"))).collect()} == {"other content", "unexpected"}
    assert c.delete_file("g") == 2 and c.delete_slug("none") == 0 and c.delete_ids(ids) == 1
    c.drop(strict=True)
    with pytest.raises(FileNotFoundError):
        c.drop(strict=True)


def test_approximate_finds_the_nearest(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    q = e.where("vec_id = 0").first()["embedding"]
    assert approximate(e, q, 5, buckets=4.0).first()["id"] == 0


def test_extraction_cache_parses_only_what_changed(spark):
    f = spark.createDataFrame([("a.py", "def f():\n    pass\n"), ("b.py", "x = 1\n")], "path string, text string")
    rows, cache = state.cached_extraction(f, None)
    cache = spark.createDataFrame(cache.collect(), cache.schema)
    g = spark.createDataFrame([("a.py", "def f():\n    pass\n"), ("b.py", "def g():\n    pass\n")], "path string, text string")
    parsed = []
    again, _ = state.cached_extraction(g, cache, lambda d: parsed.extend(r["path"] for r in d.collect()) or state.extract.extract(d))
    assert parsed == ["b.py"] and {r["label"] for r in again.where("kind = 'node'").collect()} == {"a.py", "f()", "b.py", "g()"}


def test_result_cache_lives_by_token_and_time(spark):
    now, token, asked = [0.0], ["t"], []
    cache = state.ResultCache(lambda: token[0], 10, lambda: now[0])
    ask = lambda: cache.get("q", None, 1, lambda: asked.append(1) or spark.createDataFrame([("s",)], "slug string"))
    assert ask() == ask() == [{"slug": "s"}] and len(asked) == 1
    now[0] = 11
    ask()
    token[0] = "u"
    ask()
    assert len(asked) == 3 and cache.invalidate("s") == 2 and cache.invalidate("s") == 0


def test_jobs(spark):
    now = [0.0]
    jobs = state.Jobs(most=2, ttl=5, clock=lambda: now[0])
    jobs.submit("a")
    with pytest.raises(RuntimeError, match="being built"):
        jobs.submit("a")
    jobs.submit("b")
    with pytest.raises(RuntimeError, match="in flight"):
        jobs.submit("c")
    assert jobs.run("a", lambda: "g1")["status"] == "completed" and jobs.run("b", lambda: 1 / 0)["status"] == "failed"
    assert jobs.frame(spark).count() == 2
    now[0] = 6
    assert jobs.status("a") is None


def test_logs_locks_reports(spark, tmp_path):
    with state.build_lock(str(tmp_path), "s"):
        pass
    log = str(tmp_path / "runs.jsonl")
    state.append_runs([{"tool": "a", "n": 1}], log)
    state.append_runs([{"tool": "b", "n": 2}], log)
    got = state.read_runs(spark, log, "tool string, n int")
    assert state.report(got).splitlines()[2:] == ["| tool | n |", "|---|---|", "| a | 1 |", "| b | 2 |"]


def test_judging_with_a_stub(spark):
    def stub(prompt):
        if "Candidate 1" in prompt:
            return {"winner": "Candidate 1" if prompt.index("good") < prompt.index("bad") else "Candidate 2", "confidence": "high"}
        return {"grounding": "9", "faithfulness": None}

    runs = spark.createDataFrame([(1, "t", "x", "q", "good a.py:1"), (2, "t", "y", "q", "bad"), (3, "u", "x", "q", ""), (4, "u", "y", "q", "bad")], "run_id int, task string, tool string, question string, answer string")
    scores, verdicts = judge.judge_all(runs, spark.createDataFrame([("a.py",)], "path string"), stub, "x", "y")
    assert {r["run_id"]: (r["grounding"], r["faithfulness"], r["unsupported"]) for r in scores.collect()} == {1: (5, 0, []), 2: (5, 0, ["no citation"]), 3: (0, 0, []), 4: (5, 0, ["no citation"])}
    assert {r["task"]: (r["winner"], r["confidence"]) for r in verdicts.collect()} == {"t": ("x", "high"), "u": ("y", "high")}
