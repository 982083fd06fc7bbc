"""Recall near the threshold, work bounded by buckets, and the filter before shuffles."""

import random
from collections import Counter

from pyspark.sql import functions as F
from test_llm_operators import brute_links

from ampliq.llm import ngram_join
from ampliq.llm.common import maybe_in


def pair(rng, similarity, n=200):
    """Two texts of n 5-grams whose Jaccard similarity is about that, by a changed tail."""
    words = [f"w{rng.randrange(10**7)}" for _ in range(n + 4)]
    shared = round(2 * n * similarity / (1 + similarity))
    other = words[: shared + 4] + [f"v{rng.randrange(10**7)}" for _ in range(n - shared)]
    return " ".join(words), " ".join(other), shared / (2 * n - shared)


def test_recall_just_above_the_threshold(spark):
    rng = random.Random(11)
    rows, linked = [], 0
    for k in range(700):
        a, b, s = pair(rng, rng.uniform(0.801, 0.85))
        assert s >= 0.8
        rows += [(2 * k, a), (2 * k + 1, b)]
        linked += 1
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    caught = sum(r["class_id"] == r["doc_id"] - 1 for r in got if r["doc_id"] % 2)
    assert caught >= 0.99 * linked
    assert all(r["class_id"] // 2 == r["doc_id"] // 2 for r in got)


def test_sizes_too_far_apart_are_not_sent(spark):
    """Texts around one passage: of levels that can't be linked, none meet; the result is that of brute force."""
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(80)]
    rows = [(i, " ".join([*passage, *(f"x{rng.randrange(10**6)}" for _ in range(extra))])) for i, extra in enumerate([0, 1, 2, 5, 18, 22, 40, 90, 200, 500, 1500] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (1, 2, 128):
        got = ngram_join.near_duplicates(df, block=block)
        assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got.collect()) == brute_links(rows)


def test_no_pair_is_verified_twice(spark, monkeypatch):
    rng = random.Random(13)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(150)] = f"e{rng.randrange(999)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    named = df.select(ngram_join.words_of("text").alias("text")).withColumn("node", ngram_join.node_name(F.col("text")))
    bands, r = ngram_join.choose_bands()
    nodes = ngram_join._hashed(named, bands, r, 5).selectExpr("node", "grams", "bands", "1L AS copies").dropDuplicates(["node"])
    members = ngram_join.buckets_of(nodes)
    blocked = ngram_join.blocks_of(members, nodes, 0.8, 8)
    tasks = ngram_join.tasks_of(members, blocked).collect()
    assert max(Counter((t["i"], t["j"], t["block"]) for t in tasks).values()) <= 24  # blocks are cut by hash
    pairs = Counter()
    sent = {}
    for t in tasks:
        sent.setdefault((t["i"], t["j"]), []).append(t)
    for (i, j), rows_ in sent.items():
        left = [t["node"] for t in rows_ if t["block"] == i]
        right = [t["node"] for t in rows_ if t["block"] == j]
        pairs.update(frozenset((a, b)) for a in left for b in right if a != b and (i != j or a < b))
    assert max(pairs.values()) == 1
    by_bucket = {}
    for m in members.collect():
        by_bucket.setdefault(m["bucket"], []).append(m["node"])
    level = {b["node"]: b["level"] for b in blocked.collect()}
    for group in by_bucket.values():
        for a in group:
            for b in group:
                assert a == b or abs(level[a] - level[b]) > 1 or frozenset((a, b)) in pairs


def test_blank_and_empty_tables(spark):
    df = spark.createDataFrame([(1, " "), (1, ""), (None, None), (3, "\t\n")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["class_id"] or 0, r["n_links"], r["n_ngrams"], r["is_first"]) for r in ngram_join.near_duplicates(df).collect()) == [(0, 0, 0, 0, True), (1, 1, 0, 0, True), (1, 1, 0, 0, True), (3, 3, 0, 0, True)]
    assert ngram_join.near_duplicates(df.limit(0)).count() == 0


def test_components_of_odd_edges(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("d", "d"), ("e", None), (None, "f"), ("x", "y")], "a string, b string")
    assert sorted(map(tuple, ngram_join.components(edges, "t").collect())) in ([("b", "a"), ("c", "a"), ("y", "x")], [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")])
    assert ngram_join.components(edges.limit(0), "t").count() == 0


def test_maybe_in_misses_no_key(spark):
    df = spark.range(20000).selectExpr("id", "IF(id % 7 = 0, NULL, CAST(id AS string)) AS name", "'x' AS other")
    keys = df.where("id % 50 < 3").select("id", "name")
    out = maybe_in(df, keys, "id", "name")
    assert out.columns == [*df.columns, "_maybe"] and out.count() == 20000
    assert out.where("id % 50 < 3 and not _maybe").count() == 0
    assert out.where("id % 50 >= 3 and _maybe").count() < 0.25 * 18800
    assert maybe_in(df, keys.limit(0), "id", "name").where("_maybe").count() == 0
