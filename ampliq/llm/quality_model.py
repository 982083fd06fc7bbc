"""Quality classifier: random Fourier features, ridge regression by normal equations, isotonic calibration.

Document statistics are computed once on DataFrame functions.  Their random
Fourier features approximate a Gaussian kernel; features are rounded to a fixed
grid, so that the normal equations add up exactly, alike in any order and
partitioning.  Ridge scores of labelled rows that had no part in the fit are
counted in bins and calibrated by pooling adjacent violators.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampliq.llm.common import fold, written
from ampliq.llm.quality_rules import text_counts

#: Fourier features, kernel width over standardised statistics, ridge penalty, bins of scores, fraction bits of a feature.
N_FEATURES, GAMMA, RIDGE, SCORE_BINS, BITS = 256, 0.05, 1e-3, 512, 10
THRESHOLD = 0.7
#: Sums of the normal equations that are added up side by side before the last level.
PARTS = 256
STATS = ("s_words", "s_word_length", "s_symbols", "s_upper", "s_digits", "s_bangs", "s_other", "s_lines", "s_dup_lines", "s_distinct", "s_repeat")


def _ratio(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def document_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text but with STATS (doubles); a null text counts as empty."""
    c = F.col
    counted = text_counts(docs, text).drop(text)
    #: Distinct words fall with length; the exponent levels that out.
    stats = {
        "s_words": F.log1p("n_words"), "s_word_length": F.log1p(_ratio(c("word_chars"), c("n_words"))), "s_symbols": F.sqrt(_ratio(c("n_symbols"), c("word_chars"))),
        "s_upper": _ratio(c("n_upper"), c("n_letters")), "s_digits": F.sqrt(_ratio(c("n_digits"), c("word_chars"))), "s_bangs": F.sqrt(_ratio(c("n_bangs"), c("word_chars"))),
        "s_other": _ratio(c("word_chars") - c("n_letters"), c("word_chars")), "s_lines": F.log1p(_ratio(c("n_words"), c("n_lines"))), "s_dup_lines": _ratio(c("n_dup_lines"), c("n_lines")),
        "s_distinct": F.log1p("n_distinct_words") - F.lit(0.8) * F.log1p("n_words"), "s_repeat": _ratio(c("n_repeat_words"), c("n_words")),
    }
    plain = [x for x in docs.columns if x != text]
    return counted.select(*plain, *(F.round(x, 6).alias(n) for n, x in stats.items()))


class Fourier:
    """cos(x W + b) of standardised statistics, as integers of BITS fraction bits, with a constant in front."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, n: int = N_FEATURES, gamma: float = GAMMA):
        draw = np.random.Generator(np.random.PCG64(6))
        self.mean, self.spread = mean, spread
        self.w = draw.normal(0, np.sqrt(2 * gamma), (len(mean), n))
        self.b = draw.uniform(0, 2 * np.pi, n)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        z = np.rint(np.cos(z @ self.w + self.b) * (1 << BITS))
        return np.concatenate((np.full((len(x), 1), 1 << BITS), z), 1)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in STATS], 1).astype(float)


def fit_ridge(labelled: DataFrame, features: Fourier, ridge: float = RIDGE) -> np.ndarray:
    """Weights from partition sums of the normal equations, added up in two levels; the driver gets their fixed number of rows."""
    n = N_FEATURES + 2

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                z = np.concatenate((features(_matrix(part)), part.column("label").to_numpy(zero_copy_only=False)[:, None] * (1 << BITS)), 1)
                total += np.rint(z.T @ z).astype(np.int64)  # whole numbers under 2^53: exact
        if total.any():
            part = TaskContext.get().partitionId() % PARTS
            yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([part] * n, pa.int32()), pa.array(total.tolist(), pa.list_(pa.int64()))], ["i", "part", "row"])

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.array(r, np.int64) for r in table["row"].to_pylist()], 0)
        return pa.table({"i": table["i"][:1], "part": table["part"][:1], "row": pa.array([total.tolist()], pa.list_(pa.int64()))})

    shape = "i int, part int, row array<long>"
    parts = labelled.select(*STATS, "label").mapInArrow(sums, shape)
    total = np.zeros((n, n))
    for r in parts.groupBy("i", "part").applyInArrow(add, shape).groupBy("i").applyInArrow(add, shape).collect():
        total[r["i"]] = r["row"]
    total /= float(1 << 2 * BITS)
    rows = total[0, 0]
    penalty = ridge * max(rows, 1.0) * np.eye(n - 1)
    penalty[0, 0] = 1e-9
    return np.linalg.solve(total[:-1, :-1] + penalty, total[:-1, -1])


def isotonic(position: np.ndarray, good: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of good / seen by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for x, y, n in zip(position, good, seen, strict=True):
        blocks.append([y, n, x * n])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            y, n, m = blocks.pop()
            blocks[-1] = [blocks[-1][0] + y, blocks[-1][1] + n, blocks[-1][2] + m]
    return np.array([m / n for _, n, m in blocks]), np.array([y / n for y, n, _ in blocks])


def _score(rows: DataFrame, features: Fourier, weights: np.ndarray, knots: tuple[np.ndarray, np.ndarray] | None, keep: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for at in range(0, batch.num_rows, 4096):
                parts.append(features(_matrix(batch.slice(at, 4096))) @ weights / (1 << BITS))
            raw = np.concatenate(parts) if parts else np.empty(0)
            score = raw if knots is None else np.interp(raw, *knots)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(score, pa.float64())], [*keep, "score"])

    picked = rows.select(*keep, *STATS)
    return picked.mapInArrow(run, T.StructType([*(f for f in picked.schema if f.name in keep), T.StructField("score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, holdout: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, and the columns in ``keep``.

    Rows whose id falls in fold ``holdout`` are never learnt from.  Of the other
    labelled rows all are used: those of fold 3 calibrate, the rest fit.  Labels
    are averaged by id first, so a repeated id counts once per document row and
    joins nothing twice; null labels and ids are not learnt from.  Null and
    empty texts are scored by the statistics of an empty text.  Without any
    label, every score is 0.5; with one kind only, that kind's share.  Repeated
    rows stay; other columns are ignored; an empty table gives an empty result.

    Texts are read once; what follows works on a table of statistics.
    """
    plain = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"), *(docs[c].alias(f"keep_{c}") for c in keep))
    stats = written(document_statistics(plain), "quality-stats").withColumn("fold", fold("doc_id"))
    kept = [f"keep_{c}" for c in keep]
    back = [F.col(f"keep_{c}").alias(c) for c in keep]
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.avg("quality").alias("label"))
    labelled = written(stats.where(F.col("fold") != holdout).join(known, F.col("doc_id") == F.col("_id")).select("fold", "label", *STATS), "quality-labelled")
    calibrate = 3 if holdout != 3 else 0
    fitting = labelled.where(F.col("fold") != calibrate)
    exact = lambda x: F.sum(x.cast("decimal(28,9)")).cast("double")
    sums = fitting.agg(F.count("*").alias("n"), exact(F.col("label")).alias("good"), *(exact(F.col(s)).alias(s) for s in STATS), *(exact(F.col(s) * F.col(s)).alias(f"{s}_2") for s in STATS)).first()
    if not sums["n"] or sums["good"] in (0.0, float(sums["n"])):
        score = F.lit(0.5 if not sums["n"] else sums["good"] / sums["n"])
        return stats.select("doc_id", (F.col("fold") == holdout).alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"), *back)
    mean = np.array([sums[s] for s in STATS]) / sums["n"]
    spread = np.sqrt(np.maximum(np.array([sums[f"{s}_2"] for s in STATS]) / sums["n"] - mean**2, 1e-6))
    features = Fourier(mean, spread)
    weights = fit_ridge(fitting, features)
    raw = _score(labelled.where(F.col("fold") == calibrate), features, weights, None, ["label"])
    cell = F.floor(F.least(F.lit(1.5), F.greatest(F.lit(-0.5), F.col("score"))) * (SCORE_BINS / 2)).cast("int")
    bins = raw.groupBy(cell.alias("cell")).agg(exact(F.col("label")).alias("good"), F.count("*").cast("double").alias("seen")).orderBy("cell").collect()
    if bins:
        knots = isotonic(np.array([(r["cell"] + 0.5) * 2 / SCORE_BINS for r in bins]), np.array([r["good"] for r in bins]), np.array([r["seen"] for r in bins]))
    else:  # too few labels to calibrate: the ridge score itself, cut to 0 to 1
        knots = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    scored = _score(stats, features, weights, knots, ["doc_id", "fold", *kept])
    return scored.select("doc_id", (F.col("fold") == holdout).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *back)
