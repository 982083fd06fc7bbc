"""Sharding, phrases and fill-in-middle against plain Python, on odd rows too."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_llm_operators import SCHEMA, odd_rows

from ampliq.llm import fim, phrases, sharding


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def frame(spark, rows):
    """doc_id, text, lang of each row, with columns whose names clash with the operators' own."""
    names = "rank string, phrase string, shard string, slot string, size string, n string, form string, key string, own string, output string"
    return spark.createDataFrame([(*r, *["clash"] * 10) for r in rows], f"doc_id long, text string, lang string, {names}")


def plain_shard(key, weights):
    def score(k, w):
        u = (int(hashlib.md5(f"{key}:{k}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return math.log(u) / w, -k

    return max(range(len(weights)), key=lambda k: score(k, weights[k]))


def check_shards(df, rows, weights=sharding.WEIGHTS):
    got = sharding.shard_documents(df, weights).collect()
    data = [(i, (t or "").encode()) for i, t, *_ in rows]
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len(b) + 1, zlib.crc32(b)) for i, b in data)
    slots = defaultdict(list)
    for r in got:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert (r.law, r.shard, r.grown_shard) == ("key", plain_shard(key, weights), plain_shard(key, (*weights, 1.0))) and r.grown_shard in (r.shard, len(weights))
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return got


def test_shards(spark, odd, empty, monkeypatch):
    check_shards(odd, odd_rows())
    assert sharding.shard_documents(empty).count() == 0
    rows = [(k % 50 if k % 3 else 7, f"text {k % 20}", "en") for k in range(600)] + [(None, None, None), (None, "é漢", "xx"), (7, "", "en")] + [(9, "same", "en")] * 40
    first = check_shards(frame(spark, rows), rows, (3.0, 1.0, 0.5))
    monkeypatch.setattr(sharding, "COPIES", 4)
    again = check_shards(frame(spark, rows[::-1]).repartition(5), rows, (3.0, 1.0, 0.5))
    assert Counter(map(tuple, first)) == Counter(map(tuple, again))


def test_shards_follow_their_weights_and_move_little(spark):
    docs = spark.range(20000).withColumnRenamed("id", "doc_id")
    counts = Counter(r.shard for r in sharding.with_shard(docs, "doc_id", (4.0, 2.0, 1.0, 1.0)).collect())
    assert all(abs(counts[k] / 20000 - w / 8) < 0.012 for k, w in enumerate((4, 2, 1, 1)))
    moved = {(r.from_shard, r.to_shard): r.records for r in sharding.moves(docs, "doc_id", (1.0,) * 4, (1.0,) * 5).collect()}
    assert all(a == b or b == 4 for a, b in moved) and abs(sum(n for (a, b), n in moved.items() if a != b) / 20000 - 1 / 5) < 0.012
    heavier = {(r.from_shard, r.to_shard) for r in sharding.moves(docs, "doc_id", (1.0, 1.0, 1.0), (1.0, 2.0, 1.0)).collect()}
    assert all(a == b or b == 1 for a, b in heavier)
    with pytest.raises(ValueError):
        sharding.with_shard(docs, "doc_id", (1.0, 0.0))


def plain_collocations(rows, least=10, most_words=3, inside_pct=50, top=2000):
    counts, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang, text = lang if lang is not None else "und", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, most_words + 1):
                counts[lang].update(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = []
        candidates = {p: a for p, a in f.items() if a >= least and " " in p}
        for p, a in candidates.items():
            w = p.split(" ")
            cuts = []
            for k in range(1, len(w)):
                left, right = f[" ".join(w[:k])], f[" ".join(w[k:])]
                cuts.append((1000000 * a * a // (left * right), k, left, right))
            inside = any(len(q.split(" ")) > len(w) and f" {p} " in f" {q} " and 100 * b >= inside_pct * a for q, b in candidates.items())
            if not inside:
                score, _, left, right = min(cuts)
                found.append((-score, -a, p.encode(), left, right))
        out += [(lang, rank, p.decode(), -a, x, y, n[lang], -s) for rank, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def collocation_rows():
    rng = random.Random(4)
    vocabulary = [f"{c}{k}" for c in ("w", "é", "漢", " x") for k in range(6)]
    rows = []
    for k in range(150):
        words = [rng.choice(vocabulary) if rng.random() < 0.7 else w for _ in range(rng.randrange(40)) for w in ("new", "york", "city")]
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "!?"]) for w in words)
        rows.append((k, text.upper() if k % 5 == 0 else text, rng.choice(["en", "en", "de", None, "und"])))
    return rows + [(1, None, "en"), (2, "", None), (3, " .,\n", "fr"), (4, "a a a a a a a a a a a a a a", "aa"), (5, "one " * 9, "few"), rows[7], rows[7]]


@pytest.mark.parametrize("block,window", [(1 << 17, 1 << 22), (7, 11), (64, 300)])
def test_collocations(spark, monkeypatch, block, window):
    rows = collocation_rows()
    blocks = {"BLOCK": block, "WINDOW": window}
    for name, value in blocks.items():
        monkeypatch.setattr(phrases, name, value)
    for texts in ([t.encode() for _, t, *_ in rows if t],):
        got = [(b.column("own")[0].as_py(), *x[2:]) for b in phrases.occurrence_blocks("en", texts, 2) for x in phrases._unpacked(b, 1)]
        owned = [words[c].as_py() for own, words, codes, _, _ in got for c in codes[:own, 0].tolist()]
        assert owned == [w for t in texts for w in re.findall(r"[^\x20\x09.,;:!?\x0A-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t.decode()))]
    if block == 7:
        return  # module values aren't seen by workers; the blocks above are what they change
    df = frame(spark, rows)
    assert sorted(map(tuple, phrases.collocations(df).collect())) == plain_collocations(rows)
    for options in ({"least": 3, "most_words": 4, "inside_pct": 80, "top": 5}, {"most_words": 2}):
        assert sorted(map(tuple, phrases.collocations(df, **options).collect())) == plain_collocations(rows, **options)


def test_collocations_of_odd_rows(spark, odd, empty):
    rows = [(r[0], r[1], r[2]) for r in odd_rows()]
    assert sorted(map(tuple, phrases.collocations(odd, least=2).collect())) == plain_collocations(rows, least=2)
    assert phrases.collocations(empty).count() == 0


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    rows = collocation_rows()
    monkeypatch.setattr(phrases, "BITS_A_KEY", 0)
    monkeypatch.setattr(phrases, "CHUNK", 1 << 15)
    monkeypatch.setattr(phrases, "frequent_filter", lambda frequent: np.full(4096, 255, np.uint8))  # all bits are set
    assert sorted(map(tuple, phrases.collocations(frame(spark, rows)).collect())) == plain_collocations(rows)


def test_blocks_of_a_piece_over_many_blocks():
    texts = [("ab cd " * 500).encode()]
    found = Counter()
    for batch in phrases.occurrence_blocks("en", texts, 2):
        for _, own, words, codes, at, pieces in phrases._unpacked(batch, 1):
            two, at2, _ = phrases.extended(codes, at, pieces)
            found.update(map(tuple, two[at2 < own].tolist()))
    assert sum(found.values()) == 999


def plain_cut(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    low, high = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    p, m, s = text[:low], text[low:high], text[high:]
    form = "plain" if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return doc_id, len(text), form, None if form == "plain" else low, None if form == "plain" else high - low, sha(out), sha(text), out


def test_fill_in_middle(spark, odd, empty):
    rng = random.Random(5)
    letters = "ab é漢😀́\x00<>PSM\n"
    rows = [(k, "".join(rng.choices(letters, k=rng.randrange(60))), "en") for k in range(400)]
    rows += [(None, "null id", "en"), (1, None, "en"), (2, "", "en"), (3, "has <S> mark", "en"), (3, "has <S> mark", "en"), (4, "<" * 50, "en"), (5, "<P" * 9 + "<S" * 9, "en"), (6, "😀" * 70000 + "a", "en"), (7, ">" * 30, None)]
    got = fim.fill_in_middle(frame(spark, rows), with_output=True).collect()
    want = [plain_cut(i, t) for i, t, _ in rows]
    assert Counter(map(tuple, got)) == Counter(want) and {r.form for r in got} == {"plain", "psm", "spm"}
    assert Counter(map(tuple, fim.fill_in_middle(odd).collect())) == Counter(plain_cut(r[0], r[1])[:-1] for r in odd_rows())
    assert fim.fill_in_middle(empty).count() == 0
    every = fim.fill_in_middle(frame(spark, rows), plain_pct=100).collect()
    assert {r.form for r in every} == {"plain"} and {r.form for r in fim.fill_in_middle(frame(spark, rows[:50]), plain_pct=0, spm_pct=100).collect()} == {"plain", "spm"} - ({"plain"} if all(t and not re.search("<[PSM]>", t) for _, t, _ in rows[:50]) else set())


def test_cuts_convert_both_ways(monkeypatch):
    monkeypatch.setattr(fim, "WINDOW", 5)
    text = "aé漢😀b" * 20 + "end"
    index = fim.CutIndex(np.frombuffer(text.encode(), np.uint8))
    at = np.arange(len(text) + 1)
    starts = np.array([len(text[:k].encode()) for k in at])
    assert (index.to_byte(at) == starts).all() and (index.to_char(starts) == at).all() and len(index.byte) == 60
