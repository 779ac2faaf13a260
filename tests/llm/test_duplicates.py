"""SimHash, decontamination, neighbours: against brute force, with hot groups and odd rows."""

import itertools
import math
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import ann, decontam, oracles, simhash

SF = "/root/testdata/sf0.001"


def plain_print(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    if not words:
        return 0
    n = max(1, len(words) - 2)
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > n)


def classes(prints, radius=2):
    """Smallest id reachable, by all pairs of distinct fingerprints."""
    by = {}
    for i, p in prints:
        by.setdefault(p, []).append(i)
    keys, root = list(by), {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    a = np.array(keys, np.uint64)
    for k, p in enumerate(keys):
        for j in np.flatnonzero(np.bitwise_count(a ^ np.uint64(p)) <= radius):
            root[find(p)] = find(keys[j])
    least = {}
    for p, ids in by.items():
        known = [i for i in ids if i is not None]
        if known:
            least[find(p)] = min([min(known), *([least[find(p)]] if find(p) in least else [])])
    return {i: (f"{p:016x}", least.get(find(p))) for p, ids in by.items() for i in ids}


def test_simhash_against_brute_force(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = simhash.near_duplicates(d, sample=300, leaf=40).select("doc_id", simhash.as_hex().alias("p"), "component_id").collect()
    want = classes([(r["doc_id"], plain_print(r["text"])) for r in d.select("doc_id", "text").collect()])
    assert {r["doc_id"]: (r["p"], r["component_id"]) for r in got} == want and len({c for _, c in want.values()}) < len(want)


def test_simhash_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (None, "one two three four"), (9, "One two  three four"), (9, "one two three four"), (10, "x"), (11, "x y"), (12, "long " * 50000)]
    d = spark.createDataFrame([(i, t, "clash", 1, "c") for i, t in rows], "doc_id long, text string, fp string, leaf int, _n string")
    got = simhash.near_duplicates(d).collect()
    assert len(got) == len(rows)
    want = classes([(i if i is not None else None, plain_print(t)) for i, t in rows])
    assert all(r["component_id"] == want[r["doc_id"]][1] for r in got)
    kept = simhash.deduplicate(d)
    assert kept.columns == d.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 1), (False, 9), (False, 10), (False, 11), (False, 12), (True, 0)]
    two = spark.createDataFrame([(1, "a b c d"), (1, "e f g h"), (1, "a b c d"), (2, "a b c d"), (2, "x y z w"), (3, "x y z w"), (4, None), (4, ""), (None, "q")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in simhash.deduplicate(two).collect()) == [(0, "q"), (1, "a b c d"), (1, "e f g h"), (2, "x y z w"), (4, "")]
    assert simhash.near_duplicates(d.limit(0)).count() == 0 and simhash.deduplicate(d.limit(0)).count() == 0


def near(rng, centre, n, flips):
    out = []
    for _ in range(n):
        p = int(centre)
        for b in rng.integers(0, 64, flips):
            p ^= 1 << int(b)
        out.append(p)
    return out


@pytest.mark.parametrize("n", [6000, 300])
def test_forest_links_all_of_a_tight_cluster(n):
    rng = np.random.default_rng(5)
    points = np.unique(np.array(near(rng, 0x123456789ABCDEF0, n, 3) + rng.integers(0, 2**62, n).tolist(), np.uint64))
    got = simhash.forest(points, 2)
    pairs = [(int(a), int(b)) for x, y in got for a, b in zip(x, y)]
    assert all((a ^ b) for a, b in pairs) and len(pairs) < 40 * len(points)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    for i in range(0, len(points), 97):
        for j in np.flatnonzero(np.bitwise_count(points ^ points[i]) <= 2):
            assert find(int(points[i])) == find(int(points[j]))


def test_a_cluster_that_no_tree_cuts(monkeypatch):
    """Half of all points within three bits of one centre, and a tail of points a step apart: in one leaf, by their neighbourhoods."""
    rng = np.random.default_rng(9)
    centre, full = np.uint64(0x0F0F0F0F33335555), [np.uint64(1 << b) for b in range(64)]
    ball = [centre ^ full[a] ^ full[b] ^ full[c] for a, b, c in itertools.combinations(range(64), 3)]
    chain = [np.uint64((1 << 60) + (1 << k) - 1) for k in range(0, 40, 2)]
    points = np.unique(np.array([*rng.permutation(np.array(ball))[:20_000], *chain, *rng.integers(0, 2**62, 200).astype(np.uint64)], np.uint64))
    monkeypatch.setattr(simhash, "_brute", None)
    for most in (1 << 24, 1 << 16):
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = x = root.setdefault(root[x], root[x])
            return x

        links = [(int(a), int(b)) for x, y in simhash._balls(points, 2, most) for a, b in zip(x, y)]
        assert all(0 < (a ^ b).bit_count() <= 2 for a, b in links)
        for a, b in links:
            root[find(a)] = find(b)
        assert len({find(int(c)) for c in chain}) == 1
        for i in range(0, len(points), 501):
            for j in np.flatnonzero(np.bitwise_count(points ^ points[i]) <= 2):
                assert find(int(points[i])) == find(int(points[j]))


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r["fp"]: r["root"] for r in simhash.components(e).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_decontamination_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = sorted(con.execute(oracles.DECONTAMINATE).fetchall())
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    got = decontam.overlaps(read("documents"), read("benchmark"))
    assert sorted(map(tuple, got.collect())) == want and want
    blocked = decontam.overlaps(read("documents"), read("benchmark"), block=100)
    assert sorted(map(tuple, blocked.collect())) == want
    joined = decontam.overlaps(read("documents"), read("benchmark"), block=100, scans=2)
    assert sorted(map(tuple, joined.collect())) == want


def test_decontamination_tolerates_substitutions_and_odd_rows(spark):
    item = [f"w{i}" for i in range(24)]
    every3 = [w if i % 4 != 2 else "other" for i, w in enumerate(item)]
    rows = [(1, " ".join(["pre"] * 5 + item)), (2, "x " * 1000 + " ".join(every3).upper()), (3, " ".join(item[:8])), (4, None), (5, ""), (6, " ".join(reversed(item))), (7, ", ".join(item)), (7, ", ".join(item)), (8, "of the same id"), (8, " ".join(item)), (None, " ".join(item))]
    d = spark.createDataFrame([(i, t, 0, "c") for i, t in rows], "doc_id long, text string, pos int, seed string")
    b = spark.createDataFrame([(1, " ".join(item), 1), (2, None, 1), (3, "too short", 1), (1, " ".join(item), 1)], "item_id long, text string, diag int")
    got = {(r["doc_id"], r["item_id"]): r["matched"] for r in decontam.overlaps(d, b).collect()}
    assert got == {(1, 1): 13, (2, 1): 10, (7, 1): 13, (8, 1): 13, (None, 1): 13}
    by_seed = {(r["doc_id"], r["item_id"]): r["matched"] for r in decontam.overlaps(d, b, block=1, scans=0).collect()}
    assert by_seed == got
    clean = decontam.decontaminate(d, b)  # the clean one of the two rows of id 8 stays, and so would one without an id
    assert sorted(r["doc_id"] for r in clean.collect()) == [3, 4, 5, 6, 8] and clean.where("doc_id = 8").first()["text"] == "of the same id"
    assert sorted(map(str, decontam.keyed_join(d, spark.createDataFrame([((8, 1),)], "_key struct<id:bigint,h:bigint>"), "doc_id", "text", "left_anti", most=0).collect())) == sorted(map(str, d.collect()))
    assert decontam.decontaminate(d, b).columns == d.columns
    assert decontam.overlaps(d.limit(0), b).count() == 0 and decontam.overlaps(d, b.limit(0)).count() == 0


def exact(ids, vectors, k):
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        s = vectors @ vectors[q]
        other = ids != ids[q]
        best = np.lexsort((ids[other], -s[other]))[:k]
        out[int(ids[q])] = [(int(i), float(x)) for i, x in zip(ids[other][best], s[other][best])]
    return out


def test_collisions_are_counted_by_adders():
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2, (37, 3, 128)).astype(np.uint8)
    for n in (1, 5, 18, 20, 32, 37, 38, 99):
        counts = ann.Collisions()
        for b in bits:
            counts.add(np.packbits(b, axis=1, bitorder="little").view(np.uint64))
        got = np.unpackbits(counts.at_least(n).view(np.uint8), axis=1, bitorder="little")
        assert (got == (bits.sum(0) >= n)).all()


@pytest.mark.parametrize("n", [1, 63, 500, 3000])
def test_windows_hold_what_lies_between_the_cuts(n):
    """The vectors that pass are those that lie in the runs of enough lines' sorted numbers, counted one by one."""
    rng = np.random.default_rng(n)
    v = rng.standard_normal((n, 8))
    greatest = float(np.linalg.norm(v, axis=1).max())
    index = ann.Index(v, greatest, projections=24, cells=8, k=5)
    queries = rng.standard_normal((3, 8))
    centres = (queries * (greatest / np.linalg.norm(queries, axis=1))[:, None]) @ index.lines[:, :-1].T
    passed, _ = index._collide(centres, np.array([0.2, 1.0, 3.0]) * greatest)
    values = np.c_[v, np.sqrt(np.maximum(greatest**2 - (v**2).sum(1), 0))] @ index.lines.T
    for q, w in enumerate((0.2 * greatest, greatest, 3 * greatest)):
        count = np.zeros(n, int)
        for j in range(24):
            run = np.empty(n, int)
            run[np.argsort(values[:, j])] = np.searchsorted(np.arange(9) * n // 8, np.arange(n), "right") - 1
            left, right = (np.searchsorted(index.cuts[j], centres[q, j] + x) for x in (-w, w))
            right = 8 if right == 7 else max(right, left + 1)
            count += (run >= left) & (run < right)
        assert (np.unpackbits(passed[q].view(np.uint8), bitorder="little")[:n] == (count >= 12)).all()


def test_few_vectors_are_verified_where_neighbours_stand_out():
    """Of 200 groups of 40 about one point each, a query verifies a small part of the block and finds its group."""
    rng = np.random.default_rng(2)
    v = np.repeat(rng.standard_normal((200, 32)), 40, axis=0) + 0.1 * rng.standard_normal((8000, 32))
    index = ann.Index(v, float(np.linalg.norm(v, axis=1).max()) * 1.0001)
    found = index.search(v[::400])
    assert np.mean([len(f) for f, _ in found]) < 0.02 * len(v)
    hit = [len(set(np.argsort(-(v @ q))[:21]) & set(f)) / 21 for q, (f, _) in zip(v[::400], found)]
    assert np.mean(hit) > 0.95


def test_neighbours_recall_and_scores(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = e.orderBy("vec_id").collect()
    ids, v = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got = {}
    for r in ann.nearest(e, F.col("vec_id") % 20 == 0, block=700).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = exact(ids, v, 20)
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    at = {int(i): k for k, i in enumerate(ids)}
    assert all(abs(s - v[at[q]] @ v[at[i]]) < 1e-12 for q, x in got.items() for i, s in x)


def test_neighbours_of_equal_vectors_other_norms_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 1.0, 0.0]) for i in range(0, 120)]  # one vector for a third of the rows and more
    rows += [(i, (rng.standard_normal(3) * rng.uniform(0.1, 5)).tolist()) for i in range(200, 320)]
    rows += [(400, None), (420, [0.0, 0.0, 0.0]), (440, [1.0, None, 2.0]), (460, [float("nan"), 1.0, 1.0]), (480, [float("inf"), 1.0, 1.0]), (500, [1.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    e = spark.createDataFrame([(i, v, "c", 1) for i, v in rows], "vec_id long, embedding array<double>, b string, q int")
    got = {}
    for r in ann.nearest(e, F.col("vec_id") % 20 == 0, block=64, query_block=5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], pytest.approx(r["score"])))
    good = [(i, v) for i, v in rows if i is not None and i < 400]
    want = exact(np.array([i for i, _ in good]), np.array([v for _, v in good]), 20)
    assert got.keys() == want.keys()
    hit = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(hit) > 0.95
    assert got[0][:3] == want[0][:3]
    few = ann.nearest(e.where("vec_id IN (0, 1, 2)"), F.col("vec_id") % 20 == 0)
    assert [(r["rank"], r["vec_id"]) for r in few.orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert ann.nearest(e.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_neighbours_of_a_table_that_repeats_its_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(100)]
    rows += [(i, [1.0] * 8) for i in range(100, 130)] + [(100, [1.0] * 8)] * 40  # one id hides none of the same vector
    rows += [(7, (rng.standard_normal(8) / 9).tolist()) for _ in range(30)]  # an id with many vectors
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    listed = lambda d: sorted(map(tuple, ann.nearest(d, F.col("vec_id") == 0, threshold=0.01).collect()))
    once, twice = listed(e), listed(e.union(e).union(e))
    assert len(once) == 20 and len({r[2] for r in once}) == 20
    assert [r[1:3] for r in twice] == [r[1:3] for r in once]
    same = listed(spark.createDataFrame([(0, [1.0] * 8)], "vec_id long, embedding array<double>").union(e.where("vec_id >= 100")))
    assert [r[2] for r in same] == list(range(100, 120))


def test_masks_hit_every_pattern_that_is_accepted():
    masks = [[i for i, c in enumerate(m) if c == "1"] for m in decontam.MASKS]
    for n in range(5, 14):
        for same in itertools.combinations(range(n), max(5, math.ceil(n * 0.69))):
            assert any({i + o for o in m} <= set(same) for m in masks for i in range(n)), (n, same)
