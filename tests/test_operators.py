"""Operators on small frames and by plain Python; accounting identities; published figures."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ampliq.functions import dna
from ampliq.operators import alignment, demux, dimensions, haplotypes as hap, merge, yields
from ampliq.plans import catalog

SF = "/root/testdata/sf0.001"


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_alignments_are_of_least_cost():
    rng = random.Random(1)
    master = "".join(rng.choice("ACGT") for _ in range(40))
    others = []
    for _ in range(60):
        s = list(master)
        for _ in range(rng.randrange(6)):
            k = rng.randrange(len(s))
            s[k : k + rng.randrange(3)] = rng.choice(["", "A", "GT", "TTT"])
        others.append("".join(s))
    for s, (bases, inserted) in zip(others, alignment.align(master.encode(), [s.encode() for s in others]), strict=True):
        cost = sum(x != y for x, y in zip(bases.decode(), master, strict=True)) + sum(inserted)
        assert cost == edit_distance(s, master)
        assert len(bases.replace(b"-", b"")) + sum(inserted) == len(s)


def test_star_alignment(spark):
    rng = random.Random(2)
    rows = []
    for sample in range(3):
        master = "".join(rng.choice("ACGT") for _ in range(30))
        rows.append(("p", sample, master, 100))
        for k in range(8):
            at = rng.randrange(28)
            rows.append(("p", sample, rng.choice([master[:at] + master[at + 2 :], master[:at] + "GG" + master[at:], master[:at] + "A" + master[at + 1 :], master + "TT", "C" + master]), k + 1))
    rows.append(("p", 0, None, 5))
    df = spark.createDataFrame(rows, "pool string, patient int, seq string, nr long")
    got = alignment.star_alignment(df).collect()
    assert Counter((r["patient"], r["seq"], r["nr"]) for r in got) == Counter(r[1:] for r in rows if r[2])
    for sample in range(3):
        own = [r for r in got if r["patient"] == sample]
        assert len({len(r["aln"]) for r in own}) == 1
        assert all(r["aln"].replace("-", "") == r["seq"] for r in own)
    assert alignment.star_alignment(df.limit(0)).count() == 0


def test_differences_of_unequal_widths(spark):
    df = spark.createDataFrame([("AC-T", "ACGT"), ("ACT", "ACGT"), ("", "AC"), (None, "A"), ("AAAA", "TTTT")], "a string, b string")
    assert [r[0] for r in df.select(dna.differences(F.col("a"), F.col("b"))).collect()] == [1, 1, 2, None, 4]


def test_haplotypes_of_other_widths_keep_their_rows(spark):
    df = spark.createDataFrame([("p", 1, "ACGTACGT", 9), ("p", 1, "ACGTACG", 4), ("p", 1, "ACGTACGTT", 3)], "pool string, patient int, aln string, nr long")
    assert sorted((r["name"], r["nm"]) for r in hap.name_haplotypes(df).collect()) == [("Hpl.0.0001", 0), ("Hpl.1.0001", 1), ("Hpl.1.0002", 1)]


def brute_merge(a, qa, b, qb, min_ov, max_ov, err):
    best = None
    for o in range(min(len(a), len(b)), min_ov - 1, -1):
        seen = min(o, max_ov)
        d = sum(x != y for x, y in zip(a[len(a) - o :][:seen], b[:seen], strict=True)) / seen
        if best is None or d < best[0]:
            best = (d, o)
    if best is None or best[0] > err:
        return None, None, None
    o = best[1]
    mid = [(x if p >= q else y, max(p, q) if x == y else chr(max(abs(ord(p) - ord(q)) + 33, 35))) for x, p, y, q in zip(a[len(a) - o :], qa[len(a) - o :], b[:o], qb[:o], strict=True)]
    return a[: len(a) - o] + "".join(x for x, _ in mid) + b[o:], qa[: len(a) - o] + "".join(q for _, q in mid) + qb[o:], o


@pytest.mark.parametrize("max_ov", [300, 25])
def test_merge_is_that_of_plain_python(spark, max_ov):
    rng = random.Random(max_ov)
    rows, want = [], Counter()
    for i in range(150):
        whole = "".join(rng.choice("ACGT") for _ in range(rng.randint(15, 90)))
        la, lb = rng.randint(10, len(whole)) if len(whole) > 10 else len(whole), rng.randint(10, len(whole)) if len(whole) > 10 else len(whole)
        a, b = whole[:la], list(whole[len(whole) - lb :])
        for _ in range(rng.randrange(4)):
            b[rng.randrange(lb)] = rng.choice("ACGTN")
        b = "".join(b)
        qa, qb = ("".join(rng.choice("#,5AIJ") for _ in range(n)) for n in (la, lb))
        rows.append((i, a, qa, b, qb))
        want[(i, *brute_merge(a, qa, b, qb, 12, max_ov, 0.1))] += 1
    back = str.maketrans("ACGTN", "TGCAN")
    r1 = spark.createDataFrame([("p", i, a, qa) for i, a, qa, _, _ in rows] + [("p", 900, None, None), ("p", 901, "", ""), ("p", 902, "ACGT" * 9, "I")], "pool string, read_id long, seq string, qual string")
    r2 = spark.createDataFrame([("p", i, b[::-1].translate(back), qb[::-1]) for i, _, _, b, qb in rows] + [("p", k, "ACGT" * 9, "I" * 36) for k in (900, 901, 902)], "pool string, read_id long, seq string, qual string")
    want.update([(k, None, None, None) for k in (900, 901, 902)])
    assert Counter((r["read_id"], r["seq"], r["qual"], r["overlap"]) for r in merge.merge_pairs(r1, r2, 12, max_ov).collect()) == want
    assert sum(k[3] is not None for k in want) > 30
    assert merge.merge_pairs(r1.limit(0), r2).count() == 0


def test_first_of_two_tags_wins_and_boundaries(spark):
    tags = [("p", "x", "ACGTACGTAC", 2), ("p", "y", "TTTTTGGGGG", 1)]
    samples = spark.createDataFrame(tags, "pool string, patient string, mid_seq string, mid_order int")
    body = "C" * 160
    reads = ["AACGTACGTACC" + body, "ACGTACGTAC" + "TTTTTGGGGG" + body, "ACGTTCGTAC" + body, "ACGTTCGTAG" + body, "G" * 31 + "ACGTACGTAC" + body, "G" * 30 + "ACGTACGTAC" + body, "ACGTACGTAC"]
    col = spark.createDataFrame([("p", s, 1) for s in reads], "pool string, seq string, n long")
    got = {r["seq"]: r["patient"] for r in demux.assign_mid(col, samples).collect()}
    assert [got.get(s, "short") for s in reads] == ["x", "y", "x", None, None, "x", "short"]


def test_dimensions(spark):
    samples = spark.createDataFrame([("1", "2", "A1", "S", "r", "Q"), ("1", "1", "A1", "S", "r", "P"), ("2", "3", "A2", "X", "r", "P"), ("3", "9", "none", "X", "r", "P")], ", ".join(f"`{c}` string" for c in ("Patient.ID", "MID", "Primer.ID", "Region", "RefSeq.ID", "Pool.Nm")))
    primers = spark.createDataFrame([("A1", "S", "ACGT", "GG", 10, 100), ("A2", "X", "AC", "GGG", 10, 60), ("A3", "X", "AC", "GGG", 10, 900)], "`Ampl.Nm` string, Region string, `Primer.FW` string, `Primer.RV` string, `FW.pos` int, `RV.pos` int")
    assert {r["Ampl.Nm"]: (r["FW.tpos"], r["RV.tpos"]) for r in dimensions.inner_positions(primers).collect()} == {"A1": (14, 98), "A2": (12, 57), "A3": (12, 897)}
    assert {r["Ampl.Nm"] for r in dimensions.used_primers(primers, samples).collect()} == {"A1", "A2"}
    assert dict(map(tuple, dimensions.expected_length(samples, primers).collect())) == {"P": 91, "Q": 91}
    assert dict(map(tuple, dimensions.expected_length(samples, primers, raw=True).collect())) == {"P": 151, "Q": 151}
    results = spark.createDataFrame([(1, "A1"), (9, "A1"), (2, "A2"), (2, "A9")], "patient int, amplicon string")
    assert {(r["patient"], r["amplicon"]): r["pool"] for r in dimensions.pool_of(results, samples).collect()} == {(1, "A1"): "P", (9, "A1"): None, (2, "A2"): "P", (2, "A9"): None}
    assert {r["amplicon"]: r["region"] for r in dimensions.with_region(results, primers).collect()} == {"A1": "S", "A2": "X", "A9": None}
    tags = spark.createDataFrame([(1, "AAAA"), (2, "CCCC"), (3, "GGGG")], "`MID.ID` int, `MID.Seq` string")
    got = {(r["pool"], r["patient"]): (r["mid_seq"], r["mid_order"]) for r in dimensions.resolved_samples(samples, tags, primers).collect()}
    assert got == {("P", "1"): ("AAAA", 1), ("P", "2"): ("GGGG", 2), ("Q", "1"): ("CCCC", 1)}


def test_genotype_call_without_and_with_one_type(spark):
    df = spark.createDataFrame([("h", "A", 0), ("h", "B", 4), ("i", "B", 2), ("i", "A", 2), ("j", "A", None), ("k", "C", 3)], "key string, type string, distance int")
    got = {r["key"]: tuple(r)[1:] for r in hap.genotype_call(df).collect()}
    assert got == {"h": ("A", 0, 4, None), "i": ("A", 2, 2, 1.0), "k": ("C", 3, None, None)}


def test_gap_columns_that_all_share_go(spark):
    df = spark.createDataFrame([("p", 1, "A-C-", 2), ("p", 1, "AG--", 1), ("p", 2, "-T", 5)], "pool string, patient int, aln string, nr long")
    assert sorted((r["patient"], r["aln"], r["nr"]) for r in hap.drop_gap_columns(df).collect()) == [(1, "A-C", 2), (1, "AG-", 1), (2, "T", 5)]


@pytest.fixture(scope="module")
def stage(spark):
    return lambda name: catalog.QUERIES[name](spark, SF).collect()


def test_accounting_identities(stage):
    metrics = stage("strand_metrics")
    for r in metrics:
        assert r["all"] == r["lowf"] + r["in"] and r["in"] == r["unq"] + r["com"]
    counters = stage("primer_counters")
    for r in counters:
        assert r["fn_reads"] == r["fw_fn_match"] + r["rv_fn_match"] and r["fw_match"] + r["rv_match"] <= r["tot_reads"] - r["shorts"]
    both = {(r["pool"], r["patient"]): r["fn_rd"] for r in stage("strand_overlap")}
    com = Counter()
    for r in metrics:
        com[(r["pool"], r["patient"])] += r["com"]
    assert all(both.get(k, 0) == n for k, n in com.items())
    files = Counter()
    for r in stage("hap_file_stats"):
        files[(r["pool"], r["patient"])] += r["reads"]
    assert all(files[(r["pool"], r["patient"])] == r["fn_reads"] for r in counters)
    tagged = {(r["pool"], r["patient"]): r["reads"] for r in stage("mid_counts") if r["patient"] != -1}
    assert {(r["pool"], r["patient"]): r["tot_reads"] for r in counters} == tagged
    for r in stage("pool_mid_coverage"):
        assert r["mid_reads"] == sum(n for (p, _), n in tagged.items() if p == r["pool"])
    funnel = {r["pool"]: r for r in stage("yield_funnel")}
    for name in yields.STAGES:
        assert funnel["TOTAL"][name] == sum(r[name] for p, r in funnel.items() if p != "TOTAL")
    for r in funnel.values():
        steps = [r[name] for name in yields.STAGES if name != "filt"]
        assert all(a >= b for a, b in itertools.pairwise(steps))


#: Reads of a published run by pool after each stage, and the yields printed for it.
PUBLISHED = {"35X": (1018058, 841939, 635783, 334067, 263647, 175135), "PRES1": (1180629, 936326, 649631, 405959, 327642, 190659)}
MERGE_YIELDS = {"35X": 82.7, "PRES1": 79.3}
STEP_YIELDS = {"fq30": 72.28, "mid": 57.57, "primer": 79.90, "ints": 61.86}
RAW_YIELDS = {"35X": 17.20, "PRES1": 16.15, "TOTAL": 16.64}
PRIMER_YIELDS = {"35X": 78.92040, "PRES1": 80.70815}


def test_published_yields_come_out_to_the_printed_digits(spark):
    names = ("raw", "flash", "fq30", "mid", "primer", "ints")
    wide = yields.join_counts([spark.createDataFrame([(p, *v) for p, v in PUBLISHED.items()], "pool string, " + ", ".join(f"{n} long" for n in names))], names)
    rows = {(r["pool"], r["stage"]): r for r in yields.long_funnel(wide, names).collect()}
    assert {p: round(rows[p, "flash"]["step_pct"], 1) for p in MERGE_YIELDS} == MERGE_YIELDS
    assert {n: rows["TOTAL", n]["step_pct"] for n in STEP_YIELDS} == STEP_YIELDS
    assert {p: rows[p, "ints"]["raw_pct"] for p in RAW_YIELDS} == RAW_YIELDS
    counters = spark.createDataFrame([(p, v[3], v[4]) for p, v in PUBLISHED.items()], "pool string, tot_reads long, fn_reads long")
    for r in demux.pool_primer_yield(counters).collect():
        assert r["pct"] == pytest.approx(PRIMER_YIELDS[r["pool"]], abs=6e-5)
