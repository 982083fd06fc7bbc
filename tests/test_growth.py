"""Steps whose cost must not grow faster than their rows: what is scanned once, what never becomes rows, how work is spread."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from ampliq.functions.dna import bases_below
from ampliq.operators import alignment, merge, quality
from ampliq.sources import derived


def plan(df, name):
    return df._jdf.queryExecution().optimizedPlan().toString().count(name)


def test_bases_are_counted_without_becoming_rows(spark, monkeypatch):
    rows = [("A", "II#", 1), ("A", "I", 2), ("B", "", 1), ("B", None, 1), (None, "é~I", 1), ("B", "I" * 700, 1)] * 3
    df = spark.createDataFrame(rows, "pool string, qual string, run int")
    for by in (("pool",), ("run", "pool")):
        want = Counter((*({"pool": p, "run": r}[c] for c in by), k + 1, ord(x) - 33) for p, q, r in rows for k, x in enumerate(q or ""))
        for cells in (quality.CELLS, 5):
            monkeypatch.setattr(quality, "CELLS", cells)
            got = quality.position_counts(df, by)
            assert {tuple(r)[:-1]: r.n for r in got.collect()} == want and got.columns == [*by, "pos", "q", "n"]
            assert plan(got, "Generate") == 0


def test_reads_below_their_q99_are_scanned_once(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("pool"), F.lit("IIII").alias("seq"), F.when(F.col("id") < 900, "#III").otherwise("##II").alias("qual"))
    got = quality.below_own_q99(df)
    assert plan(got, "Range (") == 1 and sorted(map(tuple, got.collect())) == [("A", 1, 450), ("B", 1, 450)]


def test_pairs_are_spread_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(merge, "PER_TASK", 10)
    r1 = spark.range(200).select(F.lit("A").alias("pool"), F.col("id").alias("read_id"), F.lit("ACGT" * 10).alias("seq"), F.lit("I" * 40).alias("qual"))
    got = merge.merge_pairs(r1, r1)
    assert plan(got, "RepartitionByExpression [read_id") == 2 and ", 20" in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.count() == 200


def test_samples_are_spread_before_they_are_aligned(spark):
    rows = [("A", k, s, "ACGT" * 50, 10) for k in range(3) for s in ("fw", "rv")]
    got = alignment.aligned_strands(spark.createDataFrame(rows, "pool string, patient long, strand string, seq string, nr long"))
    assert plan(got, "RepartitionByExpression") == 1 and got.count() == 6


def test_merged_pairs_of_many_sizes(spark):
    a, b = [b"ACGTACGTAA", b"TTTTT", b"ACGTACGTAA"], [b"CGTAAGG", b"GGGGG", b"ACGTACGTAA"]
    qa, qb = [b"IIIIIIIII#", b"IIIII", b"I" * 10], [b"5555555", b"IIIII", b"J" * 10]
    assert merge.merge_batch(a, qa, b, qb, 4, 300, 0.1) == ([b"ACGTACGTAAGG", None, b"ACGTACGTAA"], [b"IIIIIIIII555", None, b"J" * 10], [5, None, 10])


@pytest.mark.parametrize("least", [0, 1, 30, 60])
def test_bases_below_a_quality(spark, least):
    texts = ["", "!>?~", "II##II>", None, "]\\^-"]
    got = spark.createDataFrame([(t,) for t in texts], "qual string").select("qual", bases_below(F.col("qual"), least).alias("n")).collect()
    assert {r.qual: r.n for r in got} == {t: None if t is None else sum(33 <= ord(c) < 33 + least for c in t) for t in texts}


def test_reads_of_odd_events_are_the_recipe(spark, tmp_path):
    events = [(k * 37 - 500, k * 5 - 40) for k in range(400)] + [(None, 3), (90001, None), (None, None), (7919 * 10**9, 10**12), (7919 * 10**9, 10**12)]
    spark.createDataFrame(events, "event_id long, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    want = spark.sql(derived.RECIPE.replace("FROM events", "FROM {events}"), events=spark.read.parquet(str(tmp_path / "events.parquet")))
    got = derived.derived_reads(spark, str(tmp_path))
    assert got.dtypes == want.dtypes and Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    made = spark.read.parquet(str(tmp_path / "events.parquet")).select(derived._kind().alias("k"))
    assert made.where("k is null").count() == 0
