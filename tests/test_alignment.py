"""Affine and progressive alignments against plain Python."""

import random
import tracemalloc

import numpy as np
import pytest

from ampliq.functions import gotoh
from ampliq.operators import alignment, haplotypes, progressive

FAR = 10**12


def plain_cost(a: str, b: str, mismatch=gotoh.MISMATCH, start=gotoh.OPEN, base=gotoh.EXTEND) -> int:
    """The least cost by three states, cell by cell."""
    best = {(0, 0): 0}
    down, across = {}, {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i or j:
                down[i, j] = min(best.get((i - 1, j), FAR) + start, down.get((i - 1, j), FAR)) + base
                across[i, j] = min(best.get((i, j - 1), FAR) + start, across.get((i, j - 1), FAR)) + base
                met = best[i - 1, j - 1] + mismatch * (a[i - 1] != b[j - 1]) if i and j else FAR
                best[i, j] = min(met, down[i, j], across[i, j])
    return best[len(a), len(b)]


def changed(rng: random.Random, s: str, times: int, most: int = 6) -> str:
    out = list(s)
    for _ in range(times):
        k = rng.randrange(len(out) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            out[k:k] = rng.choices("ACGT", k=rng.randrange(1, most))
        elif kind == 1:
            del out[k : k + rng.randrange(1, most)]
        elif k < len(out):
            out[k] = rng.choice("ACGT")
    return "".join(out)


@pytest.mark.parametrize("costs", [(gotoh.MISMATCH, gotoh.OPEN, gotoh.EXTEND), (1, 0, 1), (3, 20, 1)])
def test_pairs_have_the_least_cost(costs):
    rng = random.Random(1)
    pairs = [("", ""), ("", "ACG"), ("ACG", ""), ("A", "T"), ("ACGT", "ACGT")]
    for _ in range(150):
        a = "".join(rng.choices("ACGT", k=rng.randrange(40)))
        pairs.append((a, changed(rng, a, rng.randrange(5)) if rng.random() < 0.8 else "".join(rng.choices("ACGT", k=rng.randrange(40)))))
    for cells in (gotoh.CELLS, 500):
        for (a, b), hit in zip(pairs, gotoh.align_pairs([a.encode() for a, _ in pairs], [b.encode() for _, b in pairs], *costs, cells=cells), strict=True):
            assert (hit.first.replace(b"-", b""), hit.second.replace(b"-", b"")) == (a.encode(), b.encode()) and len(hit.first) == len(hit.second)
            assert hit.cost == plain_cost(a, b, *costs) == hit.mismatches * costs[0] + hit.runs * costs[1] + hit.gaps * costs[2]
            assert hit.gaps == hit.first.count(b"-") + hit.second.count(b"-")


def test_long_pairs_take_bounded_memory():
    rng = random.Random(2)
    master = "".join(rng.choices("ACGT", k=3000)).encode()
    others = [changed(rng, master.decode(), 6, 40).encode() for _ in range(12)] + [master[500:2500]]
    tracemalloc.start()
    hits = gotoh.align_pairs([master] * len(others), others)
    assert tracemalloc.get_traced_memory()[1] < 1 << 30
    tracemalloc.stop()
    assert all(h.second.replace(b"-", b"") == s for h, s in zip(hits, others, strict=True)) and all(h.gaps <= 6 * 40 for h in hits[:-1]) and (hits[-1].gaps, hits[-1].mismatches) == (1000, 0)


def star(seqs: list[bytes]) -> list[bytes]:
    """All sequences around the first one, insertions filled up on the right."""
    hits = alignment.align(seqs[0], seqs)
    wide = [max(h[1][p] for h in hits) for p in range(len(seqs[0]) + 1)]
    out = []
    for s, (bases, inserted) in zip(seqs, hits, strict=True):
        at, parts = 0, []
        for p, n in enumerate(inserted):
            parts.append(s[at : at + n] + b"-" * (wide[p] - n))
            at += n
            if p < len(bases):
                parts.append(bases[p : p + 1])
                at += bases[p] != ord("-")
        out.append(b"".join(parts))
    return out


def test_progressive_alignment_costs_no_more_than_the_star():
    rng = random.Random(3)
    for _ in range(8):
        base, inserted = "".join(rng.choices("ACGT", k=200)), "".join(rng.choices("ACGT", k=6))
        seqs = [base]
        for _ in range(10):
            x = list(base)
            for _ in range(3):
                x[rng.randrange(200)] = rng.choice("ACGT")
            if rng.random() < 0.5:
                x[100:100] = inserted[rng.randrange(2) : rng.randrange(4, 7)]
            elif rng.random() < 0.5:
                del x[40:43]
            seqs.append("".join(x))
        seqs = [s.encode() for s in dict.fromkeys(seqs)]
        rows = progressive.align(seqs)
        assert [r.replace(b"-", b"") for r in rows] == seqs and len({len(r) for r in rows}) == 1
        assert progressive.pair_cost(rows) <= progressive.pair_cost(star(seqs))


def test_pair_cost_is_that_of_each_pair():
    rng = random.Random(4)
    rows = ["".join(rng.choice("AC-") for _ in range(30)) for _ in range(6)]

    def cost(a: str, b: str) -> int:
        columns = [(x, y) for x, y in zip(a, b, strict=True) if (x, y) != ("-", "-")]
        kind = [1 if x == "-" else 2 if y == "-" else 0 for x, y in columns]
        runs = sum(k > 0 and (n == 0 or kind[n - 1] != k) for n, k in enumerate(kind))
        return gotoh.MISMATCH * sum(k == 0 and x != y for k, (x, y) in zip(kind, columns, strict=True)) + gotoh.EXTEND * sum(k > 0 for k in kind) + gotoh.OPEN * runs

    assert progressive.pair_cost([r.encode() for r in rows]) == sum(cost(rows[i], rows[j]) for i in range(6) for j in range(i + 1, 6))


def test_odd_sequences():
    assert progressive.align([]) == [] and progressive.align([b"ACGT"]) == [b"ACGT"]
    rows = progressive.align([b"ACG", b"", b"ANG", b"TTTTTTTT"])
    assert [r.replace(b"-", b"") for r in rows] == [b"ACG", b"", b"ANG", b"TTTTTTTT"] and len({len(r) for r in rows}) == 1
    tree = progressive.guide_tree(np.ones((9, 9)))
    assert len(tree) == 8 and {j for _, j in tree} == set(range(1, 9))  # every cluster but the first is taken up once


def test_strands_meet_in_one_alignment(spark):
    rng = random.Random(5)
    base = "".join(rng.choices("ACGT", k=180))
    insert, longer = base[:90] + "GATTA" + base[90:], base[:90] + "GATTACA" + base[90:]
    rows = [("P", 1, s, x, n) for s in ("fw", "rv") for x, n in ((base, 60), (insert, 25), (longer, 14))] + [("P", 1, "fw", base[:50] + base[53:], 1), ("P", 1, "fw", "ACGT", 1), ("Q", 2, "rv", base, 5)]
    kept = alignment.aligned_strands(spark.createDataFrame(rows, "pool string, patient long, strand string, seq string, nr long"), 0.2, 150)
    both = {r.seq: r for r in alignment.aligned_consensus(kept).collect()}
    assert {s: r.nr for s, r in both.items()} == {base: 120, insert: 50, longer: 28} and {len(r.aln) for r in both.values()} == {187}
    #: The insertions of both share five columns, although the master has none of them.
    columns = [{k for k in range(187) if both[base].aln[k] == "-" and both[s].aln[k] != "-"} for s in (insert, longer)]
    assert len(columns[0] & columns[1]) == 5 and len(columns[1]) == 7
    profile = haplotypes.indel_profile(alignment.aligned_consensus(kept).select("pool", "patient", "aln", "nr")).collect()
    assert sorted((r.kind, r.reads) for r in profile) == [(2, 28)] * 2 + [(2, 78)] * 5
    with pytest.raises(ValueError):
        alignment.aligned_strands(kept, 0.001)
    assert alignment.aligned_strands(kept.where("false")).count() == 0
