"""Searches of tags and primers against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from ampliq.functions.dna import IUPAC, first_match, reverse_complement
from ampliq.operators import demux


def plain_match(window: str, motif: str, most: int, overhang: bool = False) -> int | None:
    edge = most if overhang else 0
    for p in range(1 - edge, len(window) - len(motif) + 2 + edge):
        wrong = sum(not 0 <= p + i - 1 < len(window) or not IUPAC.get(window[p + i - 1], 0) & IUPAC[c] for i, c in enumerate(motif))
        if wrong <= most:
            return p
    return None


@pytest.mark.parametrize("most", [0, 1, 3])
def test_bit_search_is_the_plain_search(spark, most):
    rng, rows = random.Random(most), []
    for _ in range(700):
        motif = "".join(rng.choice("ACGT" if rng.random() < 0.93 else "RYSWKMBDHVN") for _ in range(rng.choice([1, 3, 20, 20, 47, 48, 49, 60])))
        window = [rng.choice("ACGT" if rng.random() < 0.97 else "NRYxa-") for _ in range(rng.choice([0, 10, 61, 62, 63, 64, 101, 130, 200]))]
        if len(window) >= len(motif) and rng.random() < 0.8:
            at = rng.choice([0, len(window) - len(motif), rng.randrange(len(window) - len(motif) + 1)])
            copy = [rng.choice([b for b in "ACGT" if IUPAC[b] & IUPAC[c]]) for c in motif]
            for _ in range(rng.randrange(most + 3)):
                copy[rng.randrange(len(copy))] = rng.choice("ACGTN")
            window[at : at + len(motif)] = copy
        rows.append(("".join(window), motif))
    w, m = F.col("w"), F.col("m")
    found = spark.createDataFrame(rows, "w string, m string").select("w", "m", first_match(w, m, most, True).alias("inside"), first_match(w, m, most, True, True).alias("over")).collect()
    for r in found:
        assert r.inside == plain_match(r.w, r.m, most)
        if len(r.w) + 2 * most >= len(r.m):
            assert r.over == plain_match(r.w, r.m, most, True)


def test_overhang_by_hand(spark):
    primer = "ACGTTGCAAC"
    rows = [("GTTGCAACTTTTTTTT", -1), ("TTGCAACTTTTTTTTT", -2), ("TGCAACTTTTTTTTTT", None), ("TTTTTTTTACGTTGC", 9), ("TTTTTTTTACGTTG", None), ("TTTACGTTGCAACTTT", 4)]
    got = spark.createDataFrame([(i, w) for i, (w, _) in enumerate(rows)], "i int, w string").select("i", first_match(F.col("w"), F.lit(primer), 3, True, True).alias("p")).orderBy("i").collect()
    assert [r.p for r in got] == [p for _, p in rows]
    with pytest.raises(ValueError):
        first_match(F.col("w"), F.lit(primer), 3, False, True)


def test_primers_may_pass_the_read_start(spark):
    fw, rv = "ACGTTGCAACGGATTACAGG", "TTGACCGATAGGCATCAAGC"
    body = "".join(random.Random(6).choices("ACGT", k=200))
    tail = spark.range(1).select(reverse_complement(F.lit(rv))).first()[0]
    reads = spark.createDataFrame([("P", fw[2:] + body + tail, 1, 7)], "pool string, seq string, n long, patient long")
    samples = spark.createDataFrame([("P", 7, fw, rv)], "pool string, patient long, fw_primer string, rv_primer string")
    inside, over = (demux.match_primers(reads, samples, overhang=o).first() for o in (False, True))
    assert inside.trimmed is None and (over.strand, over.pos5, over.trimmed) == ("fw", -1, body)


def plain_hits(reads, tags, most, start, end):
    for pool, seq, n in reads:
        for of, patient, tag, order in tags:
            window = seq[start - 1 : end]
            spots = [p for p in range(len(window) - len(tag) + 1) if sum(a != b for a, b in zip(window[p : p + len(tag)], tag)) <= most]
            if of == pool and spots:
                yield pool, seq, n, patient, order, spots[0] + start


@pytest.mark.parametrize("most,sizes", [(1, (10,)), (2, (9, 12)), (1, (1, 10))])
def test_tags_meet_reads_by_their_pieces(spark, most, sizes):
    rng = random.Random(most)
    tags = [(pool, k, "".join(rng.choices("ACGT", k=rng.choice(sizes))), k) for pool in "PQ" for k in range(1, 9)]
    reads = []
    for _ in range(120):
        head = list(rng.choices("ACGT", k=60))
        tag = rng.choice(tags)[2]
        at = rng.randrange(45)
        head[at : at + len(tag)] = [rng.choice("ACGTN") if rng.random() < 0.1 else c for c in tag]
        reads.append((rng.choice("PQR"), "".join(head) + "A" * 100, rng.randrange(1, 9)))
    reads = list({(p, s): (p, s, n) for p, s, n in reads}.values()) + [("P", "ACGT", 1), ("P", "", 1)]
    r = spark.createDataFrame(reads, "pool string, seq string, n long")
    t = spark.createDataFrame(tags, "pool string, patient long, mid_seq string, mid_order int")
    for start, end, longer in ((1, 40, 150), (5, 33, -1)):
        kept = [x for x in reads if len(x[1]) > longer]
        want = sorted(plain_hits(kept, tags, most, start, end))
        assert sorted(tuple(x) for x in demux.mid_hits(r, t, most, start, end, longer).collect()) == want
        first = {}
        for pool, seq, _, patient, order, _ in want:
            first[pool, seq] = min(first.get((pool, seq), (order, patient)), (order, patient))
        assigned = {(x.pool, x.seq): (x.n, x.patient) for x in demux.assign_mid(r, t, most=most, start=start, end=end, longer_than=longer).collect()}
        assert assigned == {(p, s): (n, first.get((p, s), (0, None))[1]) for p, s, n in kept}


def test_ten_thousand_tags_need_no_product(spark):
    rng = random.Random(9)
    tags = [("P", k, "".join(rng.choices("ACGT", k=14)), k) for k in range(10_000)]
    reads = [("P", "".join(rng.choices("ACGT", k=8)) + (tags[rng.randrange(10_000)][2] if k % 3 else "") + "".join(rng.choices("ACGT", k=180)), 1) for k in range(20)]
    t = spark.createDataFrame(tags, "pool string, patient long, mid_seq string, mid_order int")
    found = demux.mid_hits(spark.createDataFrame(reads, "pool string, seq string, n long"), t)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "seed" in plan
    assert sorted(tuple(x) for x in found.collect()) == sorted(plain_hits(reads, tags, 1, 1, 40))
