"""Quality profiles and the Q30 filter."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ampliq.functions.dna import PHRED_OFFSET, bases_below

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)
#: Bases that are counted together.
CELLS = 1 << 22


def by_read(reads: DataFrame) -> DataFrame:
    """Append width, below_q30 and fraction_below (0 for an empty read)."""
    low, n = bases_below(F.col("qual")), F.length("seq")
    return reads.withColumns({"width": n, "below_q30": low, "fraction_below": F.when(n > 0, low / n).otherwise(0.0)})


def filter_q30(reads: DataFrame, max_pct: float = 0.05) -> DataFrame:
    """Reads whose share of bases under Q30 is at most ``max_pct``."""
    return by_read(reads).where(F.col("fraction_below") <= max_pct)


def q30_counts(reads: DataFrame, max_pct: float = 0.05) -> DataFrame:
    """pool, raw, kept, yield_pct."""
    scored = by_read(reads)
    out = scored.groupBy("pool").agg(F.count("*").alias("raw"), F.count_if(F.col("fraction_below") <= max_pct).alias("kept"))
    return out.withColumn("yield_pct", F.round(F.col("kept") * 100 / F.col("raw"), 2))


def read_quantiles(reads: DataFrame) -> DataFrame:
    """Per pool, quantiles 50, 80, 95 and 99 of the counts and shares below Q30."""
    shares = (0.5, 0.8, 0.95, 0.99)
    agg = by_read(reads).groupBy("pool").agg(F.percentile("below_q30", F.array(*map(F.lit, shares))).alias("a"), F.percentile("fraction_below", F.array(*map(F.lit, shares))).alias("b"))
    return agg.select("pool", *(F.round(F.col(c)[k], 6).alias(f"{n}_{int(100 * q)}") for c, n in (("a", "count"), ("b", "share")) for k, q in enumerate(shares)))


def _cells(batch: pa.RecordBatch, by: tuple[str, ...]) -> pa.RecordBatch:
    """(``by``, pos, q, n) of some reads: each base is a cell of (group, position, character), and cells are counted."""
    group = np.zeros(batch.num_rows, np.int64)
    for c in by:
        coded = batch.column(c).dictionary_encode()
        group = group * (len(coded.dictionary) + 1) + coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)
    _, first, group = np.unique(group, return_index=True, return_inverse=True)
    texts = batch.column("qual").fill_null("").to_pylist()
    letters = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    sizes = np.array([len(t) for t in texts])
    wide, top = max(int(sizes.max()), 1), int(letters.max(initial=0)) + 1
    place = np.arange(len(letters)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    cell = (np.repeat(group, sizes) * wide + place) * top + letters
    if len(first) * wide * top <= 4 * CELLS:
        counts = np.bincount(cell)
        at = np.flatnonzero(counts)
        counts = counts[at]
    else:
        at, counts = np.unique(cell, return_counts=True)
    rows = pa.array(first[at // (wide * top)])
    numbers = [pa.array(x, kind) for x, kind in ((at // top % wide + 1, pa.int32()), (at % top - PHRED_OFFSET, pa.int32()), (counts, pa.int64()))]
    return pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in by), *numbers], [*by, "pos", "q", "n"])


def position_counts(reads: DataFrame, by: tuple[str, ...] = ("pool",)) -> DataFrame:
    """(pool, pos, q, n): bases by position and quality, counted within Arrow batches, so that bases never become rows."""
    rows = reads.select(*by, "qual")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            longest = pc.max(pc.binary_length(batch.column("qual"))).as_py() or 1
            step = max(1, CELLS // longest)
            for start in range(0, batch.num_rows, step):
                yield _cells(batch.slice(start, step), by)

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    return rows.mapInArrow(run, f"{kinds}, pos int, q int, n long").groupBy(*by, "pos", "q").agg(F.sum("n").alias("n"))


def by_position(reads: DataFrame, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """Exact quantiles of quality by pool and position.

    Bases are counted by (pool, position, quality) first, so that the quantiles
    are taken from a few dozen counts, however many reads there are.
    """
    return profile_of_counts(position_counts(reads), quantiles)


def profile_of_counts(counts: DataFrame, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """The same from (pool, pos, q, n), of one run or of several together."""
    agg = counts.groupBy("pool", "pos").agg(F.percentile("q", F.array(*map(F.lit, quantiles)), F.col("n")).alias("x"), F.sum("n").alias("reads"))
    return agg.select("pool", "pos", "reads", *(F.round(F.col("x")[k], 6).alias(f"q{int(100 * q)}") for k, q in enumerate(quantiles)))


def side_by_side(profiles: dict[str, DataFrame], expected: DataFrame, slack: int = 0) -> DataFrame:
    """Profiles by position of several kinds of reads (R1, R2, merged), one below the other, up to each pool's expected length plus ``slack``."""
    every = reduce(lambda a, b: a.unionByName(b), (df.withColumn("kind", F.lit(name)) for name, df in profiles.items()))
    return every.join(F.broadcast(expected), "pool").where(F.col("pos") <= F.col("expected") + slack)  # one row a pool


def sliding_quality(profile: DataFrame, width: int = 10, whole: bool = False) -> DataFrame:
    """Means of ``width`` positions; windows begin at 1 to the last position less ``width``, ``whole`` adds the last window."""
    ahead = Window.partitionBy("pool").orderBy("pos").rowsBetween(0, width - 1)
    last = F.max("pos").over(Window.partitionBy("pool"))
    lines = [c for c in profile.columns if c.startswith("q")]
    out = profile.withColumn("_last", last).select("pool", "pos", "_last", *(F.round(F.avg(c).over(ahead), 6).alias(c) for c in lines))
    return out.where(F.col("pos") <= F.col("_last") - width + int(whole)).drop("_last")


def length_quantiles(reads: DataFrame, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    agg = reads.groupBy("pool").agg(F.percentile(F.length("seq"), F.array(*map(F.lit, quantiles))).alias("x"))
    return agg.select("pool", *(F.round(F.col("x")[k], 6).alias(f"len{int(100 * q)}") for k, q in enumerate(quantiles)))


def length_histogram(reads: DataFrame) -> DataFrame:
    """pool, len, n, share_pct and cumulative cum_n."""
    counts = reads.groupBy("pool", F.length("seq").alias("len")).agg(F.count("*").alias("n"))
    of_pool = Window.partitionBy("pool")
    return counts.withColumns({"share_pct": F.round(100 * F.col("n") / F.sum("n").over(of_pool), 4), "cum_n": F.sum("n").over(of_pool.orderBy("len").rowsBetween(Window.unboundedPreceding, 0))})


def length_peaks(reads: DataFrame, least_pct: float = 5.0) -> DataFrame:
    return length_histogram(reads).where(F.col("share_pct") >= least_pct).select("pool", "len", "n", "share_pct")


def threshold_curve(reads: DataFrame, cuts: tuple[float, ...] = (0.01, 0.02, 0.05)) -> DataFrame:
    """Percent of reads whose share below Q30 is at most each cut."""
    return by_read(reads).groupBy("pool").agg(*(F.round(F.avg((F.col("fraction_below") <= c).cast("int")) * 100, 4).alias(f"le_{int(100 * c)}") for c in cuts))


def below_own_q99(reads: DataFrame) -> DataFrame:
    """Reads strictly below the 99th percentile of their pool's counts below Q30, counted by value.

    The percentile is taken from the counts, whose rows are at most as many as a
    pool's longest read has bases, so reads are scanned once.
    """
    counts = by_read(reads).groupBy("pool", "below_q30").agg(F.count("*").alias("n"))
    cut = F.percentile("below_q30", 0.99, F.col("n")).over(Window.partitionBy("pool"))
    return counts.withColumn("_q99", cut).where("below_q30 < _q99").select("pool", "below_q30", "n")


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int = 30) -> DataFrame:
    """(pool, bin, starts_at, n) of ``value`` in ``bins`` equal bins from ``low`` to ``high``; bin 0 lies below, bins + 1 from ``high`` on."""
    cell = F.when(F.col(value) < low, 0).when(F.col(value) >= high, bins + 1).otherwise(F.floor((F.col(value) - low) * bins / (high - low)) + 1)
    counts = rows.where(F.col(value).isNotNull()).groupBy("pool", cell.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return counts.select("pool", "bin", F.round(low + (F.col("bin") - 1) * (high - low) / bins, 6).alias("starts_at"), "n")
