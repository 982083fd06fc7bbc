"""Merging of read pairs by their overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampliq.functions.dna import COMPLEMENT

#: Pairs scored together.
TOGETHER = 4096
#: Pairs that a task joins, some hundred MB when sorted.
PER_TASK = 200_000


def _matrix(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, sizes): one row for each value, zeros after its end."""
    sizes = np.array([len(v) for v in values])
    out = np.zeros((len(values), int(sizes.max())), np.uint8)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(values), np.uint8)
    return out, sizes


def _planes(codes: np.ndarray, planes: int) -> np.ndarray:
    """(planes, rows, words): bit k of a word is one bit of the code at place k; rows are filled up to whole words."""
    wide = -(-codes.shape[1] // 64) * 64
    bits = np.zeros((planes, len(codes), wide), bool)
    for p in range(planes):
        bits[p, :, : codes.shape[1]] = codes >> p & 1
    return np.packbits(bits, axis=2, bitorder="little").view(np.uint64)


def _shifted(words: np.ndarray, by: int) -> np.ndarray:
    """Rows of words moved towards place 0 by some places."""
    whole, rest = divmod(by, 64)
    out = np.zeros_like(words)
    kept = words.shape[-1] - whole
    if rest:
        out[..., :kept] = words[..., whole:] >> np.uint64(rest)
        out[..., : kept - 1] |= words[..., whole + 1 :] << np.uint64(64 - rest)
    else:
        out[..., :kept] = words[..., whole:]
    return out


def best_overlaps(right: np.ndarray, la: np.ndarray, left: np.ndarray, lb: np.ndarray, min_ov: int, max_ov: int) -> tuple[np.ndarray, np.ndarray]:
    """(least mismatch density, its overlap) of each pair: reads ``right`` all end in the last column, reads ``left`` begin in the first one.

    Bases are packed into planes of bits.  For each overlap one side's planes
    are shifted and compared with the other's by XOR; the bits that differ in
    any plane are counted, 64 bases at once.
    """
    letters = np.unique(np.concatenate([np.unique(right), np.unique(left)]))
    planes = max(1, int(len(letters) - 1).bit_length())
    code = np.zeros(256, np.uint8)
    code[letters] = np.arange(len(letters))
    wide = -(-max(right.shape[1], left.shape[1]) // 64) * 64
    grown = lambda x, before: np.pad(x, ((0, 0), (wide - x.shape[1], 0) if before else (0, wide - x.shape[1])))
    a, b = _planes(code[grown(right, True)], planes), _planes(code[grown(left, False)], planes)
    best, size, most = np.full(len(la), np.inf), np.zeros(len(la), np.int64), np.minimum(la, lb)
    for o in range(int(most.max()), min_ov - 1, -1):
        seen = min(o, max_ov)
        words = -(-seen // 64)
        differ = np.bitwise_or.reduce(_shifted(a, wide - o)[..., :words] ^ b[..., :words], 0)
        if seen % 64:
            differ[:, -1] &= np.uint64((1 << seen % 64) - 1)
        density = np.bitwise_count(differ).sum(1) / seen
        better = (density < best) & (most >= o)
        best[better], size[better] = density[better], o
    return best, size


def merge_batch(a: list[bytes], qa: list[bytes], b: list[bytes], qb: list[bytes], min_ov: int, max_ov: int, err: float) -> tuple[list[bytes | None], list[bytes | None], list[int | None]]:
    """(merged, qualities, overlap) of each pair, nulls where none is good enough; ``b`` is in the orientation of ``a``.

    All pairs are scored together, one overlap at a time, whatever their sizes:
    ``a`` is moved to the right so that all its reads end in one column.
    """
    (right, la), (left, lb) = _matrix([x[::-1] for x in a]), _matrix(b)
    right = right[:, ::-1]
    (quality_a, _), (quality_b, _) = _matrix([x[::-1] for x in qa]), _matrix(qb)
    quality_a, wa = quality_a[:, ::-1], right.shape[1]
    best, size = best_overlaps(right, la, left, lb, min_ov, max_ov)
    merged: list = [None] * len(a)
    quality: list = [None] * len(a)
    sizes: list = [None] * len(a)
    good = np.flatnonzero(best <= err)
    _, which = np.unique(np.stack([la[good], lb[good], size[good]], 1), axis=0, return_inverse=True)
    order = np.argsort(which.ravel(), kind="stable")
    for rows in np.split(good[order], np.flatnonzero(np.diff(which.ravel()[order])) + 1) if len(good) else ():
        #: Pairs of the same sizes and overlap: what is R1's alone, the overlap, what is R2's alone.
        n_a, n_b, o = int(la[rows[0]]), int(lb[rows[0]]), int(size[rows[0]])
        s, p, t, q = right[rows, wa - n_a :], quality_a[rows, wa - n_a :], left[rows, :n_b], quality_b[rows, :n_b]
        x, y, px, py = s[:, n_a - o :], t[:, :o], p[:, n_a - o :], q[:, :o]
        apart = np.maximum(np.abs(px.astype(np.int16) - py) + 33, 35).astype(np.uint8)
        bases = np.concatenate([s[:, : n_a - o], np.where(px >= py, x, y), t[:, o:]], 1).tobytes()
        marks = np.concatenate([p[:, : n_a - o], np.where(x == y, np.maximum(px, py), apart), q[:, o:]], 1).tobytes()
        whole = n_a + n_b - o
        for k, i in enumerate(rows.tolist()):
            merged[i], quality[i], sizes[i] = bases[k * whole : (k + 1) * whole], marks[k * whole : (k + 1) * whole], o
    return merged, quality, sizes


def merge_pairs(r1: DataFrame, r2: DataFrame, min_ov: int = 20, max_ov: int = 300, err: float = 0.10) -> DataFrame:
    """(pool, read_id, seq, qual, overlap) of every pair with one id, as ``merge_mates`` gives them; pairs meet by an equi-join on pool and id.

    Reads are some hundred bytes that shrink to a few in a shuffle, so partitions
    are cut by rows (PER_TASK), not by what they weigh there: sorts stay in memory.
    """
    spread = max(int(r1.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-r1.count() // PER_TASK))
    one = r1.select("read_id", "pool", "seq", "qual").repartition(spread, "read_id", "pool")
    two = r2.select("read_id", "pool", F.col("seq").alias("seq2"), F.col("qual").alias("qual2")).repartition(spread, "read_id", "pool")
    return merge_mates(one.join(two, ["read_id", "pool"]), min_ov, max_ov, err)


def merge_mates(mates: DataFrame, min_ov: int = 20, max_ov: int = 300, err: float = 0.10) -> DataFrame:
    """(pool, read_id, seq, qual, overlap) of mates (pool, read_id, seq, qual, seq2, qual2); nulls where no overlap is good enough.

    The overlap of the least mismatch density wins, of equal ones the longest;
    densities of overlaps over ``max_ov`` are taken from their first ``max_ov``
    bases.  Where bases differ the one of the higher quality stays (of equal
    ones that of R1), with the difference as its quality, 2 at least; where they
    agree the higher quality stays.  Pairs with a null, an empty read or
    qualities of another length have no overlap.

    Second mates are turned round here; pairs are scored in matrices of TOGETHER
    pairs, and nothing is shuffled.
    """
    pairs = mates.select("pool", "read_id", "seq", "qual", "seq2", "qual2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(start, TOGETHER)
                columns = [batch.column(c).cast(pa.binary()).to_pylist() for c in ("seq", "qual", "seq2", "qual2")]
                rows = [i for i, (s, q, t, u) in enumerate(zip(*columns, strict=True)) if s and t and q and u and len(s) == len(q) and len(t) == len(u)]
                seqs: list = [None] * batch.num_rows
                quals: list = [None] * batch.num_rows
                sizes: list = [None] * batch.num_rows
                if rows:
                    a, qa, b, qb = ([c[i] for i in rows] for c in columns)
                    turned = [s.translate(COMPLEMENT)[::-1] for s in b], [q[::-1] for q in qb]
                    for i, s, q, o in zip(rows, *merge_batch(a, qa, *turned, min_ov, max_ov, err), strict=True):
                        seqs[i], quals[i], sizes[i] = s, q, o
                yield pa.RecordBatch.from_arrays([batch.column("pool"), batch.column("read_id"), pa.array(seqs, pa.binary()).cast(pa.string()), pa.array(quals, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int32())], ["pool", "read_id", "seq", "qual", "overlap"])

    return pairs.mapInArrow(run, f"pool string, read_id {pairs.schema['read_id'].dataType.simpleString()}, seq string, qual string, overlap int")


def merge_report(merged: DataFrame) -> DataFrame:
    """pool, extended, no_ext, raw (both) and yield_pct."""
    out = merged.groupBy("pool").agg(F.count("seq").alias("extended"), F.count_if(F.col("seq").isNull()).alias("no_ext"), F.count("*").alias("raw"))
    return out.withColumn("yield_pct", F.round(F.col("extended") * 100 / F.col("raw"), 1))


def overlap_histogram(merged: DataFrame) -> DataFrame:
    """(pool, overlap, n) of the pairs that were merged."""
    return merged.where("overlap is not null").groupBy("pool", "overlap").agg(F.count("*").alias("n"))
