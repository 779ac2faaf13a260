"""Toxicity, language ID and context-tree scores: against plain versions, on held-out rows, and on odd rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import grams, langid, lm, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long, _text string, score double, t string"
SF = "/root/testdata/sf0.01"


def docs(spark, rows):
    """Rows (doc_id, text, lang) with columns that clash with what the operators name theirs."""
    return spark.createDataFrame([(i, t, l, "s", 1, "clash", 0.5, "clash") for i, t, l in rows], DOC)


ODD = [(1, None, "en"), (2, "", None), (None, "the cat", "en"), (3, "12 34 --", "en"), (4, "word " * 20000, "en"), (5, "the cat", "en"), (5, "the cat", "en"), (6, "été " * 3, "fr"), (7, "\x00\x00", "fr"), (8, "a" * 300_000, "en"), (9, "½ ² Ⅷ", "en")]


def test_gram_keys_are_the_bytes_before():
    texts = [b"abcab", b"", b"x"]
    keys, lens = grams.gram_keys(texts, 3)
    want = [int.from_bytes((b"\0" * 3 + t)[i : i + 4], "big") for t in texts for i in range(len(t))]
    assert keys.tolist() == want and lens.tolist() == [5, 0, 1]


def plain_ppm(train, order, key):
    """Code length of a gram by plain dictionaries."""
    counts = {}
    for t in train:
        for i in range(len(t)):
            ctx = (b"\0" * order + t)[i : i + order]
            for d in range(order + 1):
                counts.setdefault(ctx[order - d :], Counter())[t[i]] += 1
    raw = int(key).to_bytes(order + 1, "big")
    bits = 0.0
    for d in range(order, -1, -1):
        c = counts.get(raw[order - d : order])
        if not c:
            continue
        if raw[-1] in c:
            return bits - math.log2(c[raw[-1]] / (sum(c.values()) + len(c)))
        bits -= math.log2(len(c) / (sum(c.values()) + len(c)))
    return bits + 8


@pytest.mark.parametrize(("max_cells", "split"), [(1 << 22, 1), (1 << 22, 0), (40, 1), (1, 0)])
def test_code_lengths_are_of_the_whole_trees_whatever_is_broadcast(spark, max_cells, split):
    """Every context of every training text is in the tree of its language, for texts that hold what no training text holds too."""
    train = [(0, "abracadabra", "xx"), (1, "abba", "xx"), (2, "cab été", "yy"), (3, "bread and bran", "yy"), (4, "abba", "yy")]
    held = ["abrazo", "zzz", "cad " * 40, "a", "bran été \U0001f600", "12", "abba"]
    d = docs(spark, train + [(10 + i, t, None) for i, t in enumerate(held)]).repartition(3)
    model = langid.train(d, order=2, max_cells=max_cells, split=split)
    got = {r["doc_id"]: r for r in langid.predict(d.where("doc_id >= 10"), model).collect()}
    for i, t in enumerate(held):
        if t == "12":
            continue
        keys, _ = grams.gram_keys([t.encode()], 2)
        bits = [sum(plain_ppm([x.encode() for _, x, y in train if y == lang], 2, k) for k in keys) for lang in ("xx", "yy")]
        r = got[10 + i]
        assert r["bits_per_byte"] * len(t.encode()) == pytest.approx(min(bits)) and r["lang_pred"] == ("xx", "yy")[bits[1] < bits[0]]
        assert r["score"] == pytest.approx(1 / sum(2 ** (min(bits) - b) for b in bits))
    assert got[15]["lang_pred"] == "und"


def test_language_on_held_out_rows(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = langid.predict(d.where(held), langid.train(d.where(~held))).join(d.select("doc_id", "lang"), "doc_id")
    r = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert r["a"] > 0.95 and 0 <= r["lo"] and r["hi"] <= 1


def test_language_of_odd_rows(spark):
    d = docs(spark, ODD)
    got = langid.predict(d, langid.train(d)).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["lang_pred"] == by[2]["lang_pred"] == by[3]["lang_pred"] == by[9]["lang_pred"] == "und" and by[1]["score"] == 0.0
    assert by[6]["lang_pred"] == "fr" and by[4]["lang_pred"] == by[8]["lang_pred"] == "en"
    none = langid.predict(d, langid.train(d.limit(0)))
    assert {r["lang_pred"] for r in none.collect()} == {"und"} and langid.predict(d.limit(0), langid.train(d)).count() == 0
    with pytest.raises(ValueError, match="languages"):
        langid.train(d, max_languages=1)


def plain_ctw(train, depth):
    """log2 P(byte | context) by the recursive definition on the whole tree."""
    counts = {}
    for t in train:
        for i in range(len(t)):
            ctx = (b"\0" * depth + t)[i : i + depth]
            for d in range(depth + 1):
                for k in range(8):
                    node = (ctx[depth - d :], (1 << k) | (t[i] >> (8 - k)) if k else 1)
                    counts.setdefault(node, [0, 0])[(t[i] >> (7 - k)) & 1] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)
    children = {}
    for c, n in counts:
        if len(c):
            children.setdefault((c[1:], n), []).append((c, n))

    def whole(node):
        a, b = counts[node]
        if len(node[0]) == depth:
            return kt(a, b)
        x, y = kt(a, b), sum(whole(c) for c in children[node])
        return max(x, y) + math.log1p(math.exp(-abs(x - y))) - math.log(2)

    memo = {n: whole(n) for n in counts}

    def bit(ctx, prefix, d):
        node = (ctx[depth - d :], prefix)
        if node not in counts:
            return 0.5
        a, b = counts[node]
        own = (b + 0.5) / (a + b + 1)
        if d == depth:
            return own
        w = math.exp(kt(a, b) - memo[node] - math.log(2))
        return w * own + (1 - w) * bit(ctx, prefix, d + 1)

    def log2(key):
        raw, out, prefix = int(key).to_bytes(depth + 1, "big"), 0.0, 1
        for k in range(8):
            b, p = (raw[-1] >> (7 - k)) & 1, bit(raw[:depth], prefix, 0)
            out += math.log2(p if b else 1 - p)
            prefix = prefix << 1 | b
        return out

    return log2


def tree_of(train, depth):
    keys, n = np.unique(grams.gram_keys(train, depth)[0], return_counts=True)
    return lm.levels_of(keys, n.astype(float), 0, depth)


def test_ctw_against_the_definition():
    train = [b"abracadabra\n", b"banana band\n", b"cab\n"]
    tree, plain = tree_of(train, 2), plain_ctw(train, 2)
    keys, _ = grams.gram_keys([b"banda\n", b"zab", b"abr"], 2)
    assert lm.log2_of(keys, tree) == pytest.approx([plain(k) for k in keys], abs=1e-9)


def test_log_kt_of_small_and_large_counts():
    a = np.array([0, 3, 5, 70_000, 10, 3_000_000, 65_535.0])
    b = np.array([0, 0, 2, 3, 90_000, 8_000_000, 1.0])
    want = [math.lgamma(x + 0.5) + math.lgamma(y + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(x + y + 1) for x, y in zip(a, b)]
    assert lm.log_kt(a, b) == pytest.approx(want, rel=1e-11, abs=1e-12)


def test_ctw_probabilities_sum_to_one():
    tree = tree_of([b"the cat sat on the mat\n" * 3, b"a dog\n"], 3)
    for ctx in (b"the", b"zzz", b"\0\0\0", b" ma"):
        keys = np.array([int.from_bytes(ctx + bytes([b]), "big") for b in range(256)], np.uint64)
        assert np.exp2(lm.log2_of(keys, tree)).sum() == pytest.approx(1.0, abs=1e-9)


@pytest.mark.parametrize(("max_hot", "split", "part"), [(1 << 21, 2, 1 << 18), (1 << 21, 0, 7), (30, 1, 7), (1, 2, 1), (1, 3, 100)])
def test_scores_are_of_the_whole_tree_whatever_is_broadcast(spark, monkeypatch, max_hot, split, part):
    """Every context of every training text is in the tree, also in texts that were not learned from."""
    monkeypatch.setattr(lm, "PART_ROWS", part)
    rows = ["the cat sat on the mat", "The  catalogue of mats", "a rat", "zyx qqq", "", None, "été", "the cat sat on the mat", "x" * 300]
    d = docs(spark, [(i, t, "en") for i, t in enumerate(rows)]).repartition(3)
    whole = lambda t: b" ".join((t or "").encode().lower().split()) + b"\n"
    used = [whole(t) for t in rows[:3] + rows[7:8]]
    plain = plain_ctw(used, 3)
    got = lm.score(d, lm.train(d.where("doc_id < 3 OR doc_id = 7"), depth=3, max_hot=max_hot, split=split)).collect()
    want = {i: sum(plain(k) for k in grams.gram_keys([whole(t)], 3)[0]) * math.log10(2) for i, t in enumerate(rows)}
    assert {r["doc_id"]: r["score"] for r in got} == pytest.approx(want, rel=1e-9)


def plain_base(train, text):
    tok = lambda t: re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower()) + [b"<end>"]
    c = Counter(w for t in train for w in tok(t))
    n, v, w = sum(c.values()), len(c), tok(text)
    return len(w), sum(x in c for x in w), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)


@pytest.mark.parametrize("max_hot", [1 << 22, 40, 1])
def test_base_score_is_exact_whatever_is_broadcast(spark, max_hot):
    d = docs(spark, ODD)
    train = [t for i, t, _ in ODD if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    used = d.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 != 1)
    got = lm.score(d, lm.train(used, max_hot=max_hot, depth=2)).collect()
    assert len(got) == len(ODD)
    want = sorted((i or -1, *plain_base(train, t)) for i, t, _ in ODD)
    have = sorted((r["doc_id"] or -1, r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got)
    for a, b in zip(have, want):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9)


def test_lm_without_training_rows_and_without_rows(spark):
    d = docs(spark, ODD)
    empty = lm.train(d.limit(0), depth=2)
    r = {x["doc_id"]: x for x in lm.score(d, empty).collect()}
    assert r[2]["n_tokens"] == 1 and r[2]["n_known"] == 0 and r[2]["score"] == pytest.approx(8 * math.log10(0.5))
    assert lm.score(d.limit(0), empty).count() == 0


def test_held_out_scores_beat_the_base_on_most_texts(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    r = lm.score(d.where(held), lm.train(d.where(~held))).agg(F.avg("score").alias("s"), F.avg("base_score").alias("b")).first()
    assert r["s"] > r["b"]


def test_toxicity_on_held_out_rows(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(toxicity.training_rows(d, labels))
    held = d.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)
    got = toxicity.score(held, model).join(labels, "doc_id").select("score", "predicted", "toxic").toPandas()
    assert got.score.between(0, 1).all()
    rank = got.score.rank()
    n1, n0 = (got.toxic == 1).sum(), (got.toxic == 0).sum()
    assert (rank[got.toxic == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.95
    assert got.predicted[got.toxic == 0].mean() < 0.03


def plain_kneser_ney(rows, D, S):
    """A function from texts to their words' log-likelihood ratios, by plain sets and sums over every word and pair."""
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    uses = [set(), set()]
    for t, y in rows:
        w = words(t)
        for i, x in enumerate(w):
            uses[y].add((w[i - 2] if i > 1 else None, w[i - 1] if i else None, x))
    pair, word, after = [], [], []
    for y in (0, 1):
        pair.append(Counter((u, w) for _, u, w in uses[y]))
        word.append(Counter(w for u, w in pair[y]))
        after.append(Counter())
        for (u, _), n in pair[y].items():
            after[y][u] += n
    shared = Counter(w for u, w in set(pair[0]) | set(pair[1]))
    lost = lambda c: sum(min(n, D) for n in c.values())

    def p(y, u, w):
        base = (shared[w] + 0.5) / (sum(shared.values()) + 1)
        one = (max(word[y][w] - D, 0) + lost(word[y]) * base) / sum(word[y].values())
        left = sum(min(n, D) for (v, _), n in pair[y].items() if v == u)
        return (max(pair[y][u, w] - D, 0) + (left + S) * one) / (after[y][u] + S)

    def ratios(t):
        w = words(t)
        return [math.log(p(1, w[i - 1] if i else None, x) / p(0, w[i - 1] if i else None, x)) for i, x in enumerate(w)]

    return ratios


@pytest.mark.parametrize(("discount", "strength"), [(3, 1000.0), (1, 2.0)])
def test_kneser_ney_ratios_against_plain_ones(spark, discount, strength):
    """Of every word, rare and unseen ones too, though only what has more places than the discount is kept."""
    rng = np.random.default_rng(4)
    usual, rude = "the a you go now cat dog runs far away and so it is".split(), ["clod", "oaf", "absolute clod"]
    rows = [(i, " ".join(rng.choice(usual + (rude if i % 2 else ["sir"]), 14)) + f" w{i}", "x") for i in range(120)]
    d = docs(spark, rows).withColumn("toxic", (F.col("doc_id") % 2).cast("int")).repartition(3)
    m = toxicity.train(d.select("doc_id", "text", "toxic"), discount=discount, strength=strength)
    counted = [(t, i % 2) for i, t, _ in rows if zlib.crc32(str(i).encode()) % 5]
    plain = plain_kneser_ney(counted, discount, strength)
    for t in ["you absolute clod go away", "the new cat", "w3 w4", "Sir, the oaf", "oaf", rows[0][1]]:
        assert m.ratios(toxicity.word_keys(re.findall(r"[^\W_]+", t.lower()))) == pytest.approx(plain(t), rel=1e-9)
    assert 0 < len(m.words) < 40
    r = plain("go now you clod")
    sums = np.r_[0, np.cumsum(r)]
    assert m.features("go now you clod") == pytest.approx([sum(r) / 4, *[(sums[min(k, 4) :] - sums[: -min(k, 4)]).max() / k for k in m.windows]])
    x = m.weights[0] + np.array(m.features("you clod")) @ m.weights[1:]
    got = toxicity.score(docs(spark, [(1, "you clod", "x")]), m).first()
    assert got["score"] == pytest.approx(1 / (1 + math.exp(-x))) and got["mean_ratio"] == pytest.approx(np.mean(plain("you clod")))
    hit = {r["doc_id"]: r["predicted"] for r in toxicity.score(d, m).collect()}
    assert np.mean([hit[i] == i % 2 for i in range(120)]) > 0.9


def test_toxicity_of_odd_rows_and_one_class(spark):
    d = docs(spark, ODD)
    one = d.select("doc_id", "text", F.lit(1).alias("toxic"))
    assert {r["score"] for r in toxicity.score(d, toxicity.train(one)).collect()} == {1.0}
    none = toxicity.train(one.limit(0))
    assert {r["score"] for r in toxicity.score(d, none).collect()} == {0.0} and toxicity.score(d.limit(0), none).count() == 0
    odd = one.withColumn("toxic", F.when(F.col("doc_id") == 5, 7).when(F.col("doc_id") == 6, None).otherwise(F.col("doc_id") % 2))
    assert toxicity.score(d, toxicity.train(odd)).count() == len(ODD)


def test_toxic_words_are_kept_however_many_counts_there_are(spark):
    """A word in 12 toxic texts and no other has a ratio of its own, beside over four million counts of other words too."""
    counted = [i for i in range(1500) if zlib.crc32(str(i).encode()) % 5]
    rude = [i for i in counted if i % 2][:12]
    before = F.concat(F.lit("w"), F.col("id").cast("string"))  # another word before it each time
    filler = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3499)), lambda k: F.concat(F.lit("w"), k.cast("string"))), " ")
    d = spark.range(1500).select(F.col("id").alias("doc_id"), F.concat(filler, F.when(F.col("id").isin(rude), F.concat(F.lit(" "), before, F.lit(" clod"))).otherwise("")).alias("text"), (F.col("id") % 2).cast("int").alias("toxic"))
    m = toxicity.train(d)
    at = m.words.tolist().index(int(toxicity.word_keys(["clod"])[0]))
    shared = m.left * m.shared[at]  # what the backoff gives it in each class
    assert m.counts[at].tolist() == [0.0, 12.0]
    assert m.ratios(toxicity.word_keys(["clod"]))[0] == pytest.approx(math.log((9 + shared[1]) / m.n[1]) - math.log(shared[0] / m.n[0])) and shared[1] < 13


def test_of_many_labelled_rows_an_even_share_is_learned_from(spark):
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id")).alias("text"), (F.col("id") % 2).cast("int").alias("toxic"))
    rows = toxicity.training_rows(d, d, max_rows=500)
    assert 350 < rows.count() < 650 and {r["toxic"] for r in rows.collect()} == {0, 1}
    assert toxicity.train(d, max_rows=400).n.sum() < 500
