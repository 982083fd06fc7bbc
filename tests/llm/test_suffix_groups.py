"""No group of segments that one task holds grows with the texts that share a passage."""

import random
from collections import Counter

import numpy as np
import pytest
from test_llm_operators import brute_repeats

from ampliq.llm import suffix_dedup


def test_shared_passage_gives_bounded_groups(spark, monkeypatch):
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n))
    passage = words(40)
    texts = [f"{words(30)} {passage} {words(30)}" for _ in range(60)] + [passage + passage, passage, passage, words(60)]
    whole = suffix_dedup.maximal_repeats

    def bounded(segments, starts, length, runs):
        assert sum(starts) <= 400, sum(starts)
        return whole(segments, starts, length, runs)

    monkeypatch.setattr(suffix_dedup, "SLICE", 400)
    monkeypatch.setattr(suffix_dedup, "ARRAY", 0)  # every group in an array of its own
    monkeypatch.setattr(suffix_dedup, "maximal_repeats", bounded)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = Counter((i, *b) for i, b in enumerate(brute_repeats(texts)))
    assert Counter(tuple(r) for r in suffix_dedup.remove_repeats(df).collect()) == want


def occurrences(bodies, piece):
    found = set()
    for k, body in enumerate(bodies):
        at = body.find(piece)
        while at >= 0:
            found.add((k, at))
            at = body.find(piece, at + 1)
    return found


@pytest.mark.parametrize("size", [1 << 17, 100, 25])
def test_repeat_groups_have_all_occurrences(spark, monkeypatch, size):
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n))
    a, b = words(50), words(30)
    texts = [a, a, f"{words(9)} {a} {words(9)}", f"{b} {words(5)} {b}", f"x{b[:230]}y", "", None, "ab" * 400, words(40)]
    monkeypatch.setattr(suffix_dedup, "SLICE", size)
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, id int")
    bodies = [(t or "").encode() for t in texts]
    groups = {}
    for r in suffix_dedup.repeat_groups(df).collect():
        groups.setdefault((r["id"], r["length"]), []).append((r["doc_id"], r["start"]))
    assert groups
    covered = [np.zeros(len(body) + 1, int) for body in bodies]
    for (_, size), places in groups.items():
        k, at = places[0]
        assert size >= 200 and len(places) == len(set(places)) > 1
        assert set(places) == occurrences(bodies, bodies[k][at : at + size])
        for k, at in places:
            covered[k][at : at + size] = 1
    assert [int(c.sum()) for c in covered] == [n for _, n, _, _ in brute_repeats(texts)]
    assert suffix_dedup.repeat_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("length", [32, 60, 300, 1000])
def test_other_lengths(spark, length):
    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n))
    a = words(200)
    texts = [f"{words(3)}{a}{words(4)}", f"{a[:700]}{words(9)}", a[100:], words(100), "z" * 2500, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = Counter((i, *b) for i, b in enumerate(brute_repeats(texts, length)))
    assert Counter(tuple(r) for r in suffix_dedup.remove_repeats(df, length).collect()) == want
    for bad in (31, 1 << 15):
        with pytest.raises(ValueError):
            suffix_dedup.remove_repeats(df, bad)


def test_equal_segments_are_leaves_of_the_tree():
    seg = b"q" * 100 + b"w" * 100
    assert suffix_dedup.maximal_repeats([seg], [1], 200, [3]) == [(200, [(0, 0)])]
    assert suffix_dedup.maximal_repeats([seg], [1], 200, [1]) == []
    assert suffix_dedup.maximal_repeats([], [], 200) == []


def plain_repeats(suffixes, anchors, times, least, most, length):
    """{(suffix, length, id)} of the maximal repeats, from all common prefixes of two suffixes."""
    sizes = {(m, s[:d]) for m, s, t in zip(anchors, suffixes, times, strict=True) for d in ([len(s)] if t > 1 else [])}
    for m, s in zip(anchors, suffixes, strict=True):
        for k, t in zip(anchors, suffixes, strict=True):
            if m == k and s != t:
                sizes.add((m, s[: suffix_dedup.common_prefix(s, t)]))
    out = set()
    for m, body in sizes:
        inside = [k for k in range(len(suffixes)) if anchors[k] == m and suffixes[k].startswith(body)]
        if len(body) >= length and min(least[k] for k in inside) < max(most[k] for k in inside):
            out |= {(k, len(body), suffix_dedup._name(body)) for k in inside}
    return out


@pytest.mark.parametrize("seed", range(40))
def test_slices_of_an_array_give_the_repeats_of_the_whole(seed):
    """However a sorted array is cut, closed and open repeats together are those of all pairs of suffixes."""
    rng = random.Random(seed)
    rows = {}
    for _ in range(rng.randrange(2, 40)):
        body = "".join(rng.choice("ab") for _ in range(rng.randrange(3, 12))).encode()
        a, b = sorted((rng.randrange(3), rng.randrange(3)))
        rows[rng.randrange(2), body] = (rng.choice([1, 1, 2]), a, b) if rng.random() < 0.8 else (rng.choice([1, 2]), -1, 256)
    keys = sorted(rows)
    anchors, suffixes = [k[0] for k in keys], [k[1] for k in keys]
    times, least, most = ([rows[k][i] for k in keys] for i in range(3))
    times = [max(t, 1 + (0 <= a < b)) for t, a, b in zip(times, least, most, strict=True)]
    least = [b if t == 1 and b < 256 else a for t, a, b in zip(times, least, most, strict=True)]
    want = plain_repeats(suffixes, anchors, times, least, most, 3)
    for parts in (1, 2, 5, len(keys)):
        cuts = [0, *sorted(rng.sample(range(1, len(keys)), min(parts - 1, len(keys) - 1))), len(keys)]
        got, slices, edges = set(), [], []
        for at, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            found, open_, summary = suffix_dedup.scan_slice(suffixes[a:b], anchors[a:b], times[a:b], least[a:b], most[a:b], 3)
            got |= {(a + k, size, suffix_dedup._name(suffixes[a + k][:size])) for k, size in found}
            edges += [(2 * at, side, a + k, d) for k, side, d in open_]
            slices.append((2 * at, summary))
        borders = suffix_dedup.border_repeats(slices, 3)
        got |= {(k, depth, name) for at, side, k, d in edges for at_, side_, depth, name in borders if (at, side) == (at_, side_) and depth <= d}
        assert got == want


def test_anchor_with_300000_windows(spark):
    """More windows round one anchor than a slice has: as brute force, in removed bytes and in groups."""
    rng = np.random.default_rng(14)
    letters = rng.integers(97, 123, 2_000_000, np.uint8)
    at = int(suffix_dedup.gram_hashes(letters).argmin())
    gram = letters[at : at + suffix_dedup.GRAM].tobytes().decode()  # less than the hashes of other strings, so an anchor
    words = lambda n: rng.integers(97, 123, n, np.uint8).tobytes().decode()
    ends = [words(250) for _ in range(40)]
    texts = [words(180) + gram + words(180) for _ in range(1900)] + [words(150 + k) + gram + ends[k % 40][: 190 + 9 * (k // 40)] + words(30) for k in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    named = suffix_dedup.named_texts(df, "doc_id", "text")
    runs = suffix_dedup._runs(named, 200).selectExpr("mh", "(place >> 16) & 65535 AS n").groupBy("mh").sum("n")
    assert runs.agg({"sum(n)": "max"}).first()[0] > 300_000
    want = Counter((i, *b) for i, b in enumerate(brute_repeats(texts)))
    assert any(r[2] for r in want)
    assert Counter(tuple(r) for r in suffix_dedup.remove_repeats(df).collect()) == want
    bodies = [t.encode() for t in texts]
    for (_, size), places in groups_of(df).items():
        k, at = places[0]
        assert sorted(places) == sorted(occurrences(bodies, bodies[k][at : at + size]))


def groups_of(df):
    groups = {}
    for r in suffix_dedup.repeat_groups(df).collect():
        groups.setdefault((r["id"], r["length"]), []).append((r["doc_id"], r["start"]))
    assert groups
    return groups
