"""Alignment of haplotypes to their sample's master, and from it a multiple alignment per sample.

Each haplotype is aligned to its master on its own, so the work spreads over
all haplotypes of all samples; what a sample's alignment needs from the others
is how many columns they open before each position of the master, an aggregate
that is bounded by the master's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampliq.functions import gotoh
from ampliq.functions.gotoh import align_pairs
from ampliq.operators import progressive
from ampliq.operators.haplotypes import abundant
from ampliq.sources.shared import small

SAMPLE = ("pool", "patient")
#: Costs of a mismatch and of a gap column in the star alignment.
MISMATCH, GAP = 1, 1


def align(master: bytes, others: list[bytes]) -> list[tuple[bytes, list[int]]]:
    """Of each sequence, (bases at the master's positions, '-' where it has none; bases inserted before each position and at the end).

    Global alignments of least cost; of equal ones substitutions before gaps,
    gaps as far to the left as that allows.
    """
    out = []
    for hit in align_pairs([master] * len(others), others, MISMATCH, 0, GAP):
        opened = np.frombuffer(hit.first, np.uint8) == ord("-")
        places = np.cumsum(~opened)[opened]
        out.append((np.frombuffer(hit.second, np.uint8)[~opened].tobytes(), np.bincount(places, minlength=len(master) + 1).tolist()))
    return out


def _with_master(haplotypes: DataFrame) -> DataFrame:
    """(pool, patient, seq, nr, master): the master has most reads, then comes first; one row a sample, broadcast after it was counted."""
    known = haplotypes.where("seq is not null").select(*SAMPLE, "seq", "nr")
    masters = known.groupBy(*SAMPLE).agg(F.min_by("seq", F.struct(-F.col("nr"), F.col("seq"))).alias("master"))
    return known.join(small(masters), list(SAMPLE))


def master_alignments(haplotypes: DataFrame, mismatch: int = gotoh.MISMATCH, start: int = gotoh.OPEN, base: int = gotoh.EXTEND) -> DataFrame:
    """(pool, patient, seq, nr, master, mismatches, gaps, runs, aln, master_aln): each haplotype's global alignment with its sample's master.

    Gaps have affine costs; mismatches are columns of two bases that differ,
    gaps those of one base, runs how many gaps there are.  The exact optimum, at
    every length; work spreads over all haplotypes, and a batch's matrices are
    bounded by their cells.  Null sequences are left out; an empty one has gaps alone.
    """
    pairs = _with_master(haplotypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [[s.encode() for s in batch.column(c).to_pylist()] for c in ("seq", "master")]
            hits = align_pairs(*sides, mismatch, start, base)
            numbers = [pa.array([getattr(h, c) for h in hits], pa.int32()) for c in ("mismatches", "gaps", "runs")]
            texts = [pa.array([x.decode() for x in column], pa.string()) for column in ((h.first for h in hits), (h.second for h in hits))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *numbers, *texts], [*batch.schema.names, "mismatches", "gaps", "runs", "aln", "master_aln"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema)
    return pairs.mapInArrow(run, f"{kinds}, mismatches int, gaps int, runs int, aln string, master_aln string")


def align_to_master(haplotypes: DataFrame) -> DataFrame:
    """(pool, patient, seq, nr, master, bases, inserts) of haplotypes (pool, patient, seq, nr), the master being that of most reads, then the first.

    ``inserts`` are (pos, n): bases that the haplotype has before position pos
    of the master (from 0; the master's length for those after its end).
    Masters come from an aggregate, one row a sample; null sequences are left out.
    """
    pairs = _with_master(haplotypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs, masters = batch.column("seq").to_pylist(), batch.column("master").to_pylist()
            found: list = [None] * batch.num_rows
            by_master: dict[str, list[int]] = {}
            for k, name in enumerate(masters):
                by_master.setdefault(name, []).append(k)
            for name, every in by_master.items():
                for k, hit in zip(every, align(name.encode(), [seqs[k].encode() for k in every]), strict=True):
                    found[k] = hit
            inserts = [[{"pos": p, "n": n} for p, n in enumerate(ins) if n] for _, ins in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([b.decode() for b, _ in found], pa.string()), pa.array(inserts, pa.list_(pa.struct([("pos", pa.int32()), ("n", pa.int32())])))], [*batch.schema.names, "bases", "inserts"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema)
    return pairs.mapInArrow(run, f"{kinds}, bases string, inserts array<struct<pos: int, n: int>>")


def star_alignment(haplotypes: DataFrame) -> DataFrame:
    """(pool, patient, seq, nr, aln): a multiple alignment of each sample around its master; rows of a sample are of one width.

    Before each position of the master a sample has as many columns as its
    haplotype with most inserted bases there; those with fewer are filled with
    gaps on the right.  The order in which equal insertions are placed is that
    of the pairwise alignments.
    """
    pairs = align_to_master(haplotypes)
    opened = pairs.select(*SAMPLE, F.explode("inserts").alias("x")).groupBy(*SAMPLE, "x.pos").agg(F.max("x.n").alias("n"))
    #: At most one entry for each position of the master and one more.
    opened = opened.groupBy(*SAMPLE).agg(F.array_sort(F.collect_list(F.struct("pos", "n"))).alias("opened"))
    joined = pairs.join(opened, list(SAMPLE), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for seq, bases, inserts, room in zip(*(batch.column(c).to_pylist() for c in ("seq", "bases", "inserts", "opened")), strict=True):
                own, parts, at = {x["pos"]: x["n"] for x in inserts}, [], 0
                wide = {x["pos"]: x["n"] for x in room or ()}
                for pos in range(len(bases) + 1):
                    n = own.get(pos, 0)
                    parts.append(seq[at : at + n] + "-" * (wide.get(pos, 0) - n))
                    at += n
                    if pos < len(bases):
                        parts.append(bases[pos])
                        at += bases[pos] != "-"
                out.append("".join(parts))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*SAMPLE, "seq", "nr")), pa.array(out, pa.string())], [*SAMPLE, "seq", "nr", "aln"])

    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in (*SAMPLE, "seq", "nr"))
    return joined.mapInArrow(run, f"{kinds}, aln string")


#: The least abundance for which a sample's haplotypes are aligned together: at most 100 / LEAST_PCT sequences a strand.
LEAST_PCT = 0.05


def aligned_strands(haplotypes: DataFrame, pct: float = 0.2, min_len: int = 150) -> DataFrame:
    """(pool, patient, strand, seq, nr, aln): the abundant haplotypes of both strands of each sample in one multiple alignment.

    Equal sequences of both strands are one row of it, so the strands can be
    intersected by ``aln``.  A sample has at most 2 * 100 / pct sequences, since
    each has that share of its strand's reads; a ``pct`` under LEAST_PCT, for
    which that bound is no use, is refused.  Samples are spread over tasks, as
    their alignments cost far more than their rows weigh.
    """
    if pct < LEAST_PCT:
        raise ValueError(f"pct must be at least {LEAST_PCT}")
    kept = abundant(haplotypes, pct, min_len)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(set(table.column("seq").to_pylist()))
        aligned = progressive.align([s.encode() for s in rows])
        sample = [pa.array([k.as_py()] * len(rows), k.type) for k in key]
        return pa.table([*sample, pa.array(rows, pa.string()), pa.array([a.decode() for a in aligned], pa.string())], [*SAMPLE, "seq", "aln"])

    kinds = ", ".join(f"{c} {kept.schema[c].dataType.simpleString()}" for c in SAMPLE)
    spread = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    aligned = kept.select(*SAMPLE, "seq").distinct().repartition(spread, *SAMPLE).groupBy(*SAMPLE).applyInArrow(run, f"{kinds}, seq string, aln string")
    return kept.select(*SAMPLE, "strand", "seq", "nr").join(aligned, [*SAMPLE, "seq"])


def aligned_consensus(strands: DataFrame) -> DataFrame:
    """(pool, patient, aln, seq, fw, rv, nr): aligned haplotypes that both strands have, their reads summed."""
    both = strands.groupBy(*SAMPLE, "aln").agg(F.min("seq").alias("seq"), *(F.sum(F.when(F.col("strand") == s, F.col("nr")).otherwise(0)).alias(s) for s in ("fw", "rv")))
    return both.where("fw > 0 and rv > 0").withColumn("nr", F.col("fw") + F.col("rv"))
