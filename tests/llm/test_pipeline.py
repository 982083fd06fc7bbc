"""The stages of the pipeline on odd rows with clashing columns against plain Python, and the whole of it."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_llm_operators import brute_links, brute_repeats

import corpus_pipeline
from ampliq.llm import quality_model

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = "doc_id long, text string, lang string, source string, n_chars long, node string, a long, n_bytes long, _k1 long, row string, predicted int, copies int, k1 string, first boolean, keep_text string"


def rows():
    rng = random.Random(3)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60))
    base = [f"w{rng.randrange(4000)}" for _ in range(120)]
    near = list(base)
    near[60] = "changed"
    body = " ".join(base)
    long = " ".join(f"x{rng.randrange(10**6)}" for _ in range(20000))
    texts = [(1, None, None), (1, None, None), (2, "", "a"), (3, " \n\t ", "a"), (None, body, None), (None, body + " ", None), (4, body, "a"), (4, body, "a"), (4, body + "\n", "b"), (5, " ".join(near), None),
             (6, long, "b"), (7, "é漢" * 400, "b"), (8, f"start {passage} end", "a"), (9, f"{passage} other tail", "c"), (10, "ab" * 300, "c"), (11, "two words", "c"), (11, "two words", "c"), (12, "two words", "c")]
    texts += [(20 + i, " ".join(f"y{rng.randrange(10**6)}" for _ in range(5 + i)), "abc"[i % 3]) for i in range(20)]
    return [(i, t, "en", s, len(t or ""), "node", k % 2, 3, 4, "row", 0, 7, "k", False, "keep") for k, (i, t, s) in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows(), CLASH)


def bag(df):
    return Counter(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.collect())


STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_columns_reruns_and_empty_tables(spark, odd, name):
    out = STAGES[name](spark, odd, SF)
    if name != "byte_bpe":
        assert out.columns == odd.columns and out.dtypes == odd.dtypes
    assert bag(out) == bag(STAGES[name](spark, odd.repartition(5, "text"), SF))
    assert STAGES[name](spark, odd.limit(0), SF).count() == 0


def test_quality_classifier_keeps_whole_rows(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    both = odd.unionByName(docs.limit(60), allowMissingColumns=True)
    verdict = {r["text"]: r["predicted"] for r in quality_model.classify(both, spark.read.parquet(f"{SF}/labels.parquet"), keep=("text",)).select("text", "predicted").collect()}
    want = Counter({r: n for r, n in bag(both).items() if verdict[r[1]]})
    assert bag(STAGES["quality_classifier"](spark, both, SF)) == want and want


def test_one_document_of_each_group_stays(spark, odd):
    data = odd.collect()
    kept = bag(STAGES["ngram_join"](spark, odd, SF))
    assert not kept - Counter(map(tuple, data))
    classes = {}
    links = brute_links([(k, r["text"]) for k, r in enumerate(data)])
    root = {k: c for (k, c, _) in links}
    for k, r in enumerate(data):
        classes.setdefault(root[k], []).append(tuple(r))
    for group in classes.values():
        stays = [r for r in group if kept[r]]
        if not WORDS.search(group[0][1] or ""):
            assert kept[group[0]] == group.count(group[0])
        else:
            assert len(set(stays)) == 1 and kept[stays[0]] == 1
            assert stays[0][0] == min((r[0] for r in group if r[0] is not None), default=None)


def test_repeated_passages_go(spark, odd):
    data = odd.collect()
    want = Counter()
    for r, (_, _, _, digest) in zip(data, brute_repeats([r["text"] for r in data]), strict=True):
        want[(r["doc_id"], r["source"], r["a"], digest)] += 1
    got = STAGES["suffix_dedup"](spark, odd, SF).collect()
    cut = {r["doc_id"] for r in got if "é" in (r["text"] or "")}  # a character of which a part goes is left out whole
    assert Counter((r["doc_id"], r["source"], r["a"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in got if r["doc_id"] not in cut | {7}) == Counter({k: n for k, n in want.items() if k[0] not in cut | {7}})
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_the_mix_copies_each_row(spark, odd):
    data, got = bag(odd), bag(STAGES["mixing"](spark, odd, SF))
    size = lambda r: len(WORDS.findall(r[1] or ""))
    assert set(got) <= set(data)
    for r, n in data.items():
        assert got[r] == n if size(r) == 0 else got[r] <= 3 * n
    whole = sum(size(r) * n for r, n in data.items())
    assert abs(sum(size(r) * n for r, n in got.items()) - whole) <= 4 * 20000
    same = spark.createDataFrame([(5, "one two three four five", "s")] * 100 + [(6, "x " * 1300, "t")], "doc_id long, text string, source string")
    out = STAGES["mixing"](spark, same, SF)
    taken = out.where("source = 's'").count() * 5
    target = 5 / 7 * 1800
    assert abs(taken - min(target, 1500)) <= 5


def test_run_is_its_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = spark.createDataFrame(out.collect(), docs.schema)
    got = corpus_pipeline.run(spark, SF)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert bag(got.select("doc_id", "ids_sha256", "decoded_sha256")) == bag(last.select("doc_id", "ids_sha256", "decoded_sha256"))
    assert got.where(F.col("n_tokens") > 0).count() > 50
