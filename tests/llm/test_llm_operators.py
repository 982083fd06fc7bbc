"""Operators against brute force, exact round trips, other implementations and held-out accuracy; edge cases of each."""

import hashlib
import os
import random
import re
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pytest

from ampliq.llm import bpe, langid, licenses, media, mixing, ngram_join, quality_model, quality_rules, suffix_dedup, urls
from ampliq.llm.common import WORD

SF = os.environ.get("TEST_SF", "/root/testdata/sf0.001")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, k1 int, size int, score string"


def odd_rows():
    rng = random.Random(3)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60))
    base = [f"w{rng.randrange(4000)}" for _ in range(120)]
    near = list(base)
    near[60] = "changed"
    long = " ".join(f"x{rng.randrange(10**6)}" for _ in range(20000))
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (None, " ".join(base), None, None), (4, " ".join(base), "en", "a"), (4, " ".join(base), "en", "a"),
            (5, " ".join(near), "en", None), (6, long, "de", "b"), (7, "é漢" * 400, "fr", "b"), (8, f"start {passage} end", "en", "a"), (9, f"{passage} other tail", None, "c"), (10, "ab" * 300, "en", "c"), (11, "two words", "en", "c")]
    return [(i, t, g, s, None, "clash", 1, 2, "clash") for i, t, g, s in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def tokenizer():
    import public_tokenizers as P

    return P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN


def test_bpe_is_tiktoken(spark, docs, odd, empty):
    import tiktoken

    path, pattern = tokenizer()
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    for df in (docs, odd):
        want = Counter()
        for r in df.collect():
            ids = other.encode_ordinary(r["text"] or "")
            want[(r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())] += 1
        assert Counter(tuple(r) for r in bpe.encode_decode(df, path, pattern).collect()) == want
    assert bpe.encode_decode(empty, path, pattern).count() == 0


def test_bpe_spaces_and_long_pieces():
    import tiktoken

    path, pattern = tokenizer()
    own, other = bpe.Bpe(path, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rng = random.Random(1)
    texts = ["a\x1cb\x1d \x85　 c", "x" * 5000, "<|endoftext|>"] + ["".join(rng.choice("abéßあ \n\t!01\U0001F600'") for _ in range(rng.randint(1, 600))) for _ in range(50)]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids == other.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_bpe_cache_is_small_and_cleared(monkeypatch):
    import tiktoken

    path, pattern = tokenizer()
    own, other = bpe.Bpe(path, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(15000)) for _ in range(12)]
    tracemalloc.start()
    for text in texts:
        assert sum(map(len, own.encode([text]))) > 15000
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(own.cache) > 170_000 and held / len(own.cache) < 230  # bytes a piece
    for most in ("CACHE_PIECES", "CACHE_CHARACTERS"):
        with monkeypatch.context() as m:
            m.setattr(bpe, most, 400)
            own = bpe.Bpe(path, pattern)
            mixed = [t[i : i + 900] for t in texts[:3] for i in range(0, 9000, 900)] + ["", "z" * 700, texts[0][:900]]
            for text in mixed:
                assert list(own.encode([text, ""])) == [other.encode_ordinary(text), []]
                assert len(own.cache) <= 400


def test_bpe_ids_of_odd_rows(spark):
    import tiktoken

    path, pattern = tokenizer()
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rows = [(1, None), (None, ""), (2, "😀 é\x1c漢" * 300), (3, "word " * 150000), (3, "x" * 3000), (4, "end")]
    for df in (spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), spark.createDataFrame(rows[:2], "doc_id long, text string").coalesce(1)):
        got = Counter((r["doc_id"], r["n_tokens"], tuple(r["ids"])) for r in bpe.encode_decode(df, path, pattern, with_ids=True).collect())
        assert got == Counter((i, len(x), x) for i, x in ((r["doc_id"], tuple(other.encode_ordinary(r["text"] or ""))) for r in df.collect()))


def brute_links(rows):
    sets = []
    for _, text in rows:
        w = WORDS.findall(text or "")
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    least = {i: min((rows[j][0] for j in g if rows[j][0] is not None), default=None) for g in groups.values() for i in g}
    return Counter((rows[i][0], least[i], links[i]) for i in range(len(rows)))


@pytest.mark.parametrize("which", ["docs", "odd", "group"])
def test_near_duplicates(spark, docs, odd, which):
    if which == "group":  # a chain of near copies larger than two blocks
        rng = random.Random(5)
        base = [f"w{rng.randrange(9999)}" for _ in range(150)]
        data = []
        for i in range(40):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(150)] = f"e{rng.randrange(99)}"
            data.append((i, " ".join(words)))
        df = spark.createDataFrame(data, "doc_id long, text string")
        got = ngram_join.near_duplicates(df, block=16)
    else:
        df = {"docs": docs, "odd": odd}[which]
        got = ngram_join.near_duplicates(df)
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got.collect()) == brute_links(rows)


def test_bands_reach_their_recall():
    bands, rows = ngram_join.choose_bands()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999


def same(spark_df, sql, table, **views):
    con = duckdb.connect()
    for name, value in views.items():
        con.register(name, value)
    want = con.sql(sql)
    assert sorted(want.columns) == sorted(spark_df.columns)
    order = sorted(want.columns)
    key = lambda columns, r: repr([r[columns.index(c)] for c in order])
    assert sorted(key(spark_df.columns, tuple(r)) for r in spark_df.collect()) == sorted(key(want.columns, r) for r in want.fetchall())


@pytest.mark.parametrize("module, f", [(quality_rules, quality_rules.quality_rules), (licenses, licenses.license_scan)])
def test_against_sql(spark, docs, odd, empty, module, f):
    for df in (docs, odd):
        same(f(df), module.ORACLE, "documents", documents=df.select("doc_id", "text", "lang", "source").toArrow())
    assert f(empty).count() == 0


def test_quality_rules_keep_clean_texts(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality_rules.quality_rules(docs).where("not base_failed").join(labels, "doc_id").select("kept", "quality").collect()
    assert np.mean([r["kept"] for r in rows if r["quality"] == 1]) > 0.95
    assert np.mean([r["kept"] for r in rows if r["quality"] == 0]) < 0.3


def brute_repeats(texts, n=200):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + n] for b in bodies for i in range(len(b) - n + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i] += 1
                gone[i + n] -= 1
        on = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.concatenate(([0], on.astype(int)))) > 0).sum())
        out.append((len(b), int(on.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, on, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("size", [1 << 17, 60])
def test_suffix_dedup(spark, odd, size, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", size)
    rows = odd.select("doc_id", "text").collect()
    want = Counter((r["doc_id"], *b) for r, b in zip(rows, brute_repeats([r["text"] for r in rows]), strict=True))
    assert Counter(tuple(r) for r in suffix_dedup.remove_repeats(odd).collect()) == want


def test_suffix_dedup_documents(spark, docs, empty):
    rows = docs.select("doc_id", "text").collect()
    want = Counter((r["doc_id"], *b) for r, b in zip(rows, brute_repeats([r["text"] for r in rows]), strict=True))
    assert Counter(tuple(r) for r in suffix_dedup.remove_repeats(docs).collect()) == want
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_interval_tree_finds_maximal_repeats():
    rng = random.Random(2)
    a = bytes(rng.randrange(97, 100) for _ in range(60))
    found = suffix_dedup.maximal_repeats([b"x" + a + b"y", b"z" + a + b"w", b"q" + a[:30] + b"p"], [40, 40, 10], 20)
    assert (60, [(0, 1), (1, 1)]) in [(n, sorted(p)) for n, p in found]
    assert (30, [(0, 1), (1, 1), (2, 1)]) in [(n, sorted(p)) for n, p in found]


def test_quality_model(spark, odd, empty):
    big = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    got = quality_model.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in got)
    assert quality_model.classify(odd, labels).count() == odd.count()
    assert {r["score"] for r in quality_model.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert quality_model.classify(empty, labels).count() == 0


def test_isotonic():
    x, y = quality_model.isotonic(np.arange(4.0), np.array([1.0, 0, 2, 3]), np.array([2.0, 2, 3, 3]))
    assert (np.diff(y) >= 0).all() and np.isclose(y[0], 0.25) and len(x) == len(y)


def test_mixing(spark, docs, odd, empty):
    for df in (docs, odd):
        rows = mixing.mix_sources(df, keep=("source",)).collect()
        again = mixing.mix_sources(df.repartition(5), keep=("source",)).collect()
        assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
        texts = Counter((r["doc_id"], len(WORDS.findall(r["text"] or ""))) for r in df.collect())
        assert Counter((r["doc_id"], r["size"]) for r in rows) == texts
        assert all(r["taken"] <= 3 * r["size"] for r in rows)
        sizes = {}
        for r in rows:
            sizes.setdefault(r["source"], []).append(r)
        names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
        total, weight = {s: sum(r["size"] for r in g) for s, g in sizes.items()}, {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
        stopped = set()
        while True:  # the rule as it is stated
            left = sum(total.values()) - sum(3 * total[s] for s in stopped)
            share = {s: 3 * total[s] if s in stopped else left * weight[s] / sum(w for t, w in weight.items() if t not in stopped) for s in names}
            more = {s for s in names if s not in stopped and share[s] > 3 * total[s]}
            if not more:
                break
            stopped |= more
        for s, g in sizes.items():
            assert g[0]["target"] == pytest.approx(share[s]) and g[0]["source_size"] == total[s]
            assert abs(sum(r["taken"] for r in g) - share[s]) <= max(r["size"] for r in g)
    assert mixing.mix_sources(empty).count() == 0


def test_media_round_trip(spark, odd, empty):
    rng = np.random.default_rng(1)
    payloads = [bytes(64), rng.bytes(6400), b"\xff" * 640, bytes([0, 255]) * 320]
    for p, (back, _, _) in zip(payloads, media.decode_files(media.encode_payloads(payloads)), strict=True):
        assert back == p
    table = media.media_table(odd, with_media=True).collect()
    texts = Counter()
    for r in odd.collect():
        b = (r["text"] or "").encode()
        b += bytes(-len(b) % 64 or (0 if b else 64))
        texts[(r["doc_id"], len((r["text"] or "").encode()), len(b), hashlib.sha256(b).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) for r in table) == texts
    for r in table:
        assert hashlib.sha256(r["media"]).hexdigest() == r["media_sha256"] and len(r["media"]) == r["media_bytes"]
        assert sum(c["frames"] for c in r["clips"]) == len(media.parse_avi(bytes(r["media"]))[0])
    assert media.media_table(empty).count() == 0


def test_shots():
    frames = np.concatenate((np.full((10, 1024), 20), np.full((10, 1024), 200))).astype(np.uint8)
    assert media.shots(frames) == [(0, 10), (10, 10)]


def test_language_id(spark, docs, odd, empty):
    got = langid.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95
    rows = langid.language_id(odd).collect()
    assert len(rows) == odd.count() and {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert langid.language_id(empty).count() == 0


def test_language_spans(spark, docs):
    model = langid.train(docs, "text", "lang")
    parts = {g: next(r["text"] for r in docs.where(f"lang = '{g}' and n_chars between 400 and 3000").orderBy("doc_id").collect()) for g in ("en", "de")}
    df = spark.createDataFrame([(1, parts["en"] + " " + parts["de"])], "doc_id long, text string")
    spans = langid.identify(df, model, spans=True).first()["spans"]
    assert spans[0]["lang"] == "en" and spans[-1]["lang"] == "de"


def test_viterbi_is_exact():
    rng = np.random.default_rng(4)
    scores = [rng.normal(size=(n, 3)) * 4 for n in (1, 5, 6)]
    import itertools

    for s, path in zip(scores, langid.viterbi(scores, 3.0), strict=True):
        worth = lambda p: sum(s[i, l] for i, l in enumerate(p)) - 3.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731, E741
        assert np.isclose(worth(path.tolist()), max(map(worth, itertools.product(range(3), repeat=len(s)))))


def test_urls(spark):
    data = [(1, "https://A.Example.org/es/x"), (2, "http://example.org/en/19"), (3, "http://example.org/en/29"), (4, "http://x.com/fr/a?b=//de/"), (5, "http://x.com/de/"), (6, None), (7, "no scheme"), (8, "http://notorg/"), (9, "http://h.net?x#y"), (9, "http://h.net?x#y"), (10, "http://x.com#f/de/"), (11, "http://example.org.evil.net/es/")]
    rows = {r["page_id"]: r for r in urls.url_filter(spark.createDataFrame([(i, u, "clash") for i, u in data], "page_id long, url string, host string")).collect()}
    assert [rows[i]["rule"] for i in range(1, 12)] == ["example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/", None, None, None, None, None, None]
    assert [rows[i]["verdict"] for i in range(1, 6)] == ["block", "block", "allow", "allow", "block"]
    assert (rows[1]["host"], rows[1]["path"], rows[9]["host"], rows[9]["path"], rows[10]["path"]) == ("a.example.org", "/es/x", "h.net", "", "")
    assert {r["verdict"] for r in rows.values()} <= {"allow", "block"}
    assert urls.url_filter(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_trees_learn_from_labels(spark):
    rng = random.Random(1)
    good = [f"http://site{i}.net/page" for i in range(200)]
    bad = [f"http://s{rng.randrange(10**9)}.net/a/b/c?x={rng.randrange(10**9)}&y={rng.randrange(10**9)}" for _ in range(200)]
    labelled = spark.createDataFrame([(u, 0) for u in good] + [(u, 1) for u in bad], "url string, blocked int")
    pages = spark.createDataFrame([(1, "http://site999.net/page"), (2, "http://s424242424.net/a/b/c?x=123456789&y=987654321")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in urls.url_filter(pages, labelled).collect()} == {1: "allow", 2: "block"}


def test_word_pattern():
    assert re.findall(WORD, "a\xa0b c\x1fd") == ["a\xa0b", "c\x1fd"]
