import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import evaluate as E
from tessera.operators.incremental import can_reuse, parse_changes


def value(spark, c):
    return spark.range(1).select(c).first()[0]


def test_wilson(spark):
    low, high = E.wilson(F.lit(5), F.lit(10))
    assert [round(value(spark, x), 2) for x in (low, high)] == [0.24, 0.76]
    low, high = E.wilson(F.lit(0), F.lit(0))
    assert (value(spark, low), value(spark, high)) == (0.0, 1.0)


def test_spearman_with_ties(spark):
    d = spark.createDataFrame([(1, 1), (2, 2), (2, 3), (4, 4)], "x int, y int")
    assert E.spearman(d, "x", "y").first()["rho"] == pytest.approx(0.9487, abs=1e-3)
    flat = spark.createDataFrame([(1, 1), (1, 2)], "x int, y int")
    assert E.spearman(flat, "x", "y").first()["rho"] == 0.0


def test_length_bias(spark):
    d = spark.createDataFrame([(100, False), (200, False), (300, False), (400, True), (500, True), (600, True)], "length int, won boolean")
    r = E.length_bias(d.withColumn("won", F.col("won").cast("int")), "length", "won").first()
    assert r["flagged"] and r["rho"] == pytest.approx(0.878, abs=0.02)
    few = E.length_bias(d.limit(4).withColumn("won", F.col("won").cast("int")), "length", "won").first()
    assert not few["flagged"] and few["rho"] is None


def test_sign_test(spark):
    assert value(spark, E.sign_test(F.lit(7), F.lit(0))) == pytest.approx(2 / 128)
    assert value(spark, E.sign_test(F.lit(1), F.lit(1))) == pytest.approx(1.0)
    assert value(spark, E.sign_test(F.lit(0), F.lit(0))) is None


def plain_wilcoxon(a, b):
    d = [x - y for x, y in zip(a, b) if x != y]
    if len(a) < 5 or not d:
        return None
    size = sorted(abs(x) for x in d)
    rank = {v: sum(i for i, s in enumerate(size, 1) if s == v) / size.count(v) for v in set(size)}
    n, up = len(d), sum(rank[abs(x)] for x in d if x > 0)
    var = n * (n + 1) * (2 * n + 1) / 24 - sum(size.count(v) ** 3 - size.count(v) for v in set(size)) / 48
    return math.erfc(abs(up - n * (n + 1) / 4) / math.sqrt(2 * var)) if var > 0 else 1.0


def test_wilcoxon(spark):
    rng = random.Random(2)
    for a, b in ([1, 2, 3, 4], [0] * 4), ([1] * 6, [1] * 6), ([1, 2, 3, 4, 5, 6], [0] * 6), ([rng.randint(0, 9) for _ in range(60)], [rng.randint(2, 9) for _ in range(60)]):
        d = spark.createDataFrame([(i, t, float(x)) for t, v in (("a", a), ("b", b)) for i, x in enumerate(v)] + [(99, "a", 1.0)], "task int, tool string, score double")
        r, want = E.wilcoxon(d, "a", "b").first(), plain_wilcoxon(a, b)
        assert r["n"] == len(a) and (r["p"] is None if want is None else r["p"] == pytest.approx(want))
    assert plain_wilcoxon([1, 2, 3, 4, 5, 6], [0] * 6) < 0.05


def test_sign_test_of_many(spark):
    want = 2 * sum(math.exp(math.lgamma(901) - math.lgamma(i + 1) - math.lgamma(901 - i) - 900 * math.log(2)) for i in range(421))
    assert value(spark, E.sign_test(F.lit(480), F.lit(420))) == pytest.approx(want)


def test_spearman_over_all_rows_equals_that_of_one_group(spark):
    rng = random.Random(5)
    d = spark.createDataFrame([(0, rng.randint(0, 20), rng.random()) for _ in range(200)] + [(0, None, 1.0)], "g int, x int, y double")
    assert E.spearman(d, "x", "y").first()["rho"] == pytest.approx(E.spearman(d, "x", "y", "g").first()["rho"])


def test_verdicts(spark):
    w, c = E.verdict(F.lit("a"), F.lit("high"), F.lit("a"), F.lit("medium"))
    assert (value(spark, w), value(spark, c)) == ("a", "medium")
    w, c = E.verdict(F.lit("a"), F.lit("high"), F.lit("b"), F.lit("high"))
    assert (value(spark, w), value(spark, c)) == ("Tie", "low")
    v = spark.createDataFrame([(1, "a", "low"), (2, "a", "high"), (2, "a", "high"), (2, "b", "low"), (3, "a", "high"), (3, "b", "high")], "task int, winner string, confidence string")
    assert {r["task"]: (r["winner"], r["confidence"]) for r in E.majority(v).collect()} == {1: ("a", "low"), 2: ("a", "medium"), 3: ("Tie", "low")}


def test_citations(spark):
    text = "see src/a.py:10-20, b.ts line 7 and b.ts (line 7), src/a.py:10"
    assert value(spark, T.citations(F.lit(text))) == ["src/a.py:10", "b.ts:7"]


def test_change_feed():
    z = "M\0a b\tc.py\0R087\0then.py\0now.py\0C100\0src\nx.py\0copy.py\0D\0gone.py\0"
    assert parse_changes(z) == [("M", "a b\tc.py", None), ("R", "now.py", "then.py"), ("C", "copy.py", "src\nx.py"), ("D", "gone.py", None)]


def test_reuse():
    meta = {"schema": 1, "fingerprint": "f", "branch": "b", "commit": "c"}
    ask = lambda **k: can_reuse(meta, **{"schema": 1, "fingerprint": "f", "branch": "b", "commit": "c", "snapshot_ok": True, **k})
    assert ask() == "same" and ask(commit="d") == "incremental" and ask(snapshot_ok=False) == ask(schema=2) == ask(branch="x") == "full"
