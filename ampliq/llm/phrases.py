"""Phrases mined by set-oriented joins of sorted occurrence relations (SETM), scored as collocations.

Relation k has one row for each occurrence of a phrase of k words: its piece,
its place and the words, in this order.  It is kept in blocks of bounded size,
and a block of relation k + 1 is the merge-join of relation k with itself: two
occurrences of one piece at adjacent places overlap in k - 1 words and make one
of k + 1.  Phrases are counted by Spark; a relation is reduced to frequent
phrases (semi-join) before it is extended.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ampliq.llm.common import BITS_A_KEY, CHUNK, MOST_BITS, discard, text_or_empty, written

#: Words of a block, and bytes that are looked at together when words are found.
BLOCK, WINDOW = 1 << 17, 1 << 22
#: What a byte is: 0 a part of a word, 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_RELATION = "lang string, own int, block binary"
_COUNTS = "lang string, phrase string, n long"
#: Parts among which a language's phrases are ranked before the last ranking.
PARTS = 64


def find_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, piece of each word) of bytes; pieces are numbered from 0 and may be empty."""
    starts, ends, pieces, piece, before = [], [], [], 0, True
    for at in range(0, len(data), WINDOW):
        kind = _KIND[data[at : at + WINDOW]]
        apart = kind > 0
        shifted = np.concatenate(([before], apart[:-1]))
        first = np.flatnonzero(~apart & shifted)
        starts.append(first + at)
        ends.append(np.flatnonzero(apart & ~shifted) + at)
        breaks = np.flatnonzero(kind == 2)
        pieces.append(np.searchsorted(breaks, first) + piece)
        piece, before = piece + len(breaks), bool(apart[-1])
    if not before:
        ends.append(np.array([len(data)]))
    empty = [np.zeros(0, np.int64)]
    return tuple(np.concatenate(x or empty) for x in (starts, ends, pieces))


def _relation_batch(lang: str, own: int, words: pa.Array, codes: np.ndarray, at: np.ndarray, pieces: np.ndarray) -> pa.RecordBatch:
    """One block as a row, compressed; places and pieces as differences, which take next to no space."""
    def one(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    less = lambda x: pa.array(np.diff(x, prepend=0), pa.int32())
    inner = pa.RecordBatch.from_arrays([one(words), one(pa.array(codes.ravel(), pa.int32())), one(less(at)), one(less(pieces))], ["words", "codes", "gaps", "pieces"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, inner.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(inner)
    return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([own], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["lang", "own", "block"])


def occurrence_blocks(lang: str, texts: list[bytes], more: int) -> Iterator[pa.RecordBatch]:
    """Relation 1 of some texts of a language; each block ends with ``more`` words that the next one owns, so that no phrase is cut."""
    data = _LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
    starts, ends, pieces = find_words(data)
    for low in range(0, len(starts), BLOCK):
        part = slice(low, min(low + BLOCK + more, len(starts)))
        first, own = starts[part][0], min(BLOCK, len(starts) - low)
        edges = np.stack([starts[part], ends[part]], 1).ravel() - first
        held = data[first : first + edges[-1]].tobytes()
        every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64).tobytes()), pa.py_buffer(held)])
        found = every.take(pa.array(np.arange(0, len(edges) - 1, 2))).dictionary_encode()
        words = found.dictionary.cast(pa.large_string()).cast(pa.string())
        yield _relation_batch(lang, own, words, found.indices.to_numpy(), np.arange(len(found)), pieces[part] - pieces[low])


def occurrences(docs: DataFrame, lang: str, text: str, more: int) -> DataFrame:
    """Relation 1 in blocks: lang, own (places below it are counted here), and distinct words, codes, places and pieces as compressed bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("lang").dictionary_encode()
            for k, name in enumerate(names.dictionary.to_pylist()):
                texts = batch.column("text").filter(pc.equal(names.indices, k)).cast(pa.large_string()).cast(pa.large_binary())
                #: Some megabytes at a time, a longer text by itself.
                part = np.cumsum(pc.binary_length(texts).to_numpy()) // WINDOW
                for run_of in np.split(np.arange(len(part)), np.flatnonzero(np.diff(part)) + 1):
                    yield from occurrence_blocks(name, texts.slice(run_of[0], len(run_of)).to_pylist(), more)

    return docs.select(F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"), text_or_empty(docs[text]).alias("text")).mapInArrow(run, _RELATION)


def _unpacked(batch: pa.RecordBatch, k: int) -> Iterator[tuple[str, int, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(lang, own, words, codes by row, places, pieces) of each block."""
    for i in range(batch.num_rows):
        inner = pa.ipc.open_stream(batch.column("block")[i].as_buffer()).read_next_batch()
        words, codes, gaps, pieces = (inner.column(c)[0].values for c in ("words", "codes", "gaps", "pieces"))
        yield batch.column("lang")[i].as_py(), batch.column("own")[i].as_py(), words, codes.to_numpy().reshape(-1, k), np.cumsum(gaps.to_numpy()), np.cumsum(pieces.to_numpy())


_ODD, _HALF = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


def phrase_hashes(lang: str, words: list[str], codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each row of ``codes``, places in ``words``."""
    of_word = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    out = np.full(len(codes), xxhash.xxh64_intdigest(lang), np.uint64)
    for j in range(codes.shape[1]):
        out = (out ^ of_word[codes[:, j]]) * _ODD
        out ^= out >> _HALF
    return out


def frequent_filter(frequent: DataFrame) -> np.ndarray:
    """Bits by hash that are set for all phrases of ``frequent`` (lang, phrase): at most MOST_BITS, 32 MB, however many phrases there are."""
    bits = CHUNK
    while bits < min(MOST_BITS, BITS_A_KEY * frequent.count()):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [int(phrase_hashes(lang, w := phrase.split(" "), np.arange(len(w))[None])[0]) % bits for lang, phrase in zip(*(batch.column(c).to_pylist() for c in ("lang", "phrase")), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64())], ["at"])

    spots = frequent.select("lang", "phrase").mapInArrow(run, "at long").select(F.floor(F.col("at") / CHUNK).alias("chunk"), (F.col("at") % CHUNK).alias("bit"))
    out = np.zeros((bits // CHUNK, CHUNK // 8), np.uint8)
    for chunk, held in spots.groupBy("chunk").agg(F.bitmap_construct_agg("bit")).toLocalIterator():
        out[chunk] = np.frombuffer(held, np.uint8)
    return out.ravel()


def _passing(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes % np.uint64(len(bits) * 8)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def extended(codes: np.ndarray, at: np.ndarray, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge-join of a sorted relation with itself by piece and adjacent place: the phrases that are one word longer.

    Rows are sorted and places unique, so a row's partner, if it has one, is the next row.
    """
    meet = np.flatnonzero((at[1:] == at[:-1] + 1) & (pieces[1:] == pieces[:-1]))
    return np.concatenate([codes[meet], codes[meet + 1, -1:]], 1), at[meet], pieces[meet]


def _counted(lang: str, words: pa.Array, codes: np.ndarray) -> pa.RecordBatch:
    """Phrases of a block with their number."""
    key = codes[:, 0].astype(np.int64)
    for j in range(1, codes.shape[1]):
        key = np.unique(key, return_inverse=True)[1] if j > 1 else key
        key = key * len(words) + codes[:, j]
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    parts = [words.take(pa.array(codes[first, j])) for j in range(codes.shape[1])]
    phrase = pc.binary_join_element_wise(*parts, " ") if len(parts) > 1 else parts[0]
    return pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(n), np.int32))), phrase, pa.array(n, pa.int64())], ["lang", "phrase", "n"])


def _group_counts(relation: DataFrame, k: int, frequent: np.ndarray | None = None) -> DataFrame:
    """(lang, phrase, n): phrases of k words of relation k, or, with a filter of frequent phrases, of k + 1 words made of such."""
    bits = relation.sparkSession.sparkContext.broadcast(frequent) if frequent is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, own, words, codes, at, pieces in _unpacked(batch, k):
                if bits is not None:
                    ok = _passing(bits.value, phrase_hashes(lang, words.to_pylist(), codes))
                    codes, at, pieces = extended(codes[ok], at[ok], pieces[ok])
                codes = codes[at < own]
                if len(codes):
                    yield _counted(lang, words, codes)

    return relation.mapInArrow(run, _COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _next_relation(relation: DataFrame, k: int, frequent: np.ndarray) -> DataFrame:
    """Relation k + 1 out of the frequent rows of relation k; blocks without a row are left out."""
    bits = relation.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, own, words, codes, at, pieces in _unpacked(batch, k):
                ok = _passing(bits.value, phrase_hashes(lang, words.to_pylist(), codes))
                codes, at, pieces = extended(codes[ok], at[ok], pieces[ok])
                if len(codes):
                    used, codes = np.unique(codes, return_inverse=True)
                    yield _relation_batch(lang, own, words.take(pa.array(used)), codes.reshape(len(at), -1), at, pieces)

    return relation.mapInArrow(run, _RELATION)


def frequent_phrases(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 10, most_words: int = 3) -> tuple[list[DataFrame], DataFrame]:
    """([(lang, phrase, n) of phrases of 1 to ``most_words`` words with n >= ``least``], (lang, words) of every language).

    A phrase is frequent only if all its parts are, so a relation is reduced to
    frequent rows before it is joined.  The reduction goes by a filter of at most
    32 MB that never loses a frequent row; what it lets through by chance (more,
    beyond some 27 million phrases) is counted and then left out, so counts are
    exact at every size.  Phrases are counted within blocks and tasks before
    they are shuffled; no join has occurrences as its keys.
    """
    relation = written(occurrences(docs, lang, text, most_words - 1), "phrases-relation")
    totals = written(relation.groupBy("lang").agg(F.sum("own").cast("long").alias("words")), "phrases-totals")
    found = [written(_group_counts(relation, 1).where(F.col("n") >= least), "phrases-counts")]
    for k in range(1, most_words):
        bits = frequent_filter(found[-1])
        found.append(written(_group_counts(relation, k, bits).where(F.col("n") >= least), "phrases-counts"))
        if k + 1 < most_words:
            relation = written(_next_relation(relation, k, bits), "phrases-relation", relation)
    discard(relation)
    return found, totals


def _exact_score(a: str, left: str, right: str) -> str:
    whole = lambda c: f"cast({c} as decimal(20, 0))"
    return f"cast(1000000 as decimal(7, 0)) * ({whole(a)} * {whole(a)}) div ({whole(left)} * {whole(right)})"


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 10, most_words: int = 3, inside_pct: int = 50, top: int = 2000) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Words are lower-cased (A-Z); pieces end at .,;:!? and line ends.  a is the
    number of occurrences of a phrase of 2 to ``most_words`` words, at least
    ``least``; l and r those of its two parts at the cut of least score
    floor(1000000 * a * a / (l * r)), of equal ones the first.  n are the words
    of the language.  Phrases within a longer candidate that has ``inside_pct``
    percent of their occurrences are left out.

    A null language is ``und``, a null text is empty; repeated rows count as
    often as they occur; ties are settled by the phrase; other columns are
    ignored; an empty table gives an empty result; a text of any length is cut
    into blocks without losing a phrase.
    """
    found, totals = frequent_phrases(docs, lang, text, least, most_words)
    counts = reduce(DataFrame.unionByName, found[:-1])
    every = reduce(DataFrame.unionByName, found[1:]).withColumn("_w", F.split("phrase", " "))
    size = F.size("_w")
    joined = lambda start, n: F.array_join(F.slice("_w", start, n), " ")
    cuts = every.select("lang", "phrase", F.col("n").alias("a"), "_w", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("_left"), joined(F.col("k") + 1, size - F.col("k")).alias("_right"))
    for side, name in (("_left", "l"), ("_right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr(_exact_score("a", "l", "r")).alias("score"), "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    #: Each shorter phrase that a longer candidate holds, with the occurrences of the most frequent one.
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda at: joined(at, m))))
    longer = every.where(size > 2).select("lang", F.explode(spans).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("_longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.col("_longer").isNull() | (F.col("_longer") * 100 < F.col("a") * inside_pct)).drop("_longer")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
    ahead = kept.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= top).drop("_r")  # at most PARTS * top rows a language go on
    ranked = ahead.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals.withColumnRenamed("words", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM p),
o AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM o),
t AS (SELECT lang, count(*) AS n FROM g GROUP BY lang),
f1 AS (SELECT lang, a AS phrase, count(*) AS n FROM g GROUP BY ALL),
f2 AS (SELECT lang, a, b, a || ' ' || b AS phrase, count(*) AS n FROM g WHERE b IS NOT NULL GROUP BY lang, a, b),
f3 AS (SELECT lang, a, b, c, a || ' ' || b || ' ' || c AS phrase, count(*) AS n FROM g WHERE c IS NOT NULL GROUP BY lang, a, b, c HAVING count(*) >= 10),
q AS (SELECT lang, phrase, n AS a, 1 AS k, a AS lp, b AS rp FROM f2 WHERE n >= 10 UNION ALL SELECT lang, phrase, n, 1, a, b || ' ' || c FROM f3 UNION ALL SELECT lang, phrase, n, 2, a || ' ' || b, c FROM f3),
s AS (SELECT lang, phrase, n FROM f1 UNION ALL SELECT lang, phrase, n FROM f2),
d AS (SELECT q.lang, q.phrase, q.a, q.k, x.n AS l, y.n AS r, (1000000::HUGEINT * q.a * q.a) // (x.n::HUGEINT * y.n) AS score FROM q JOIN s x ON x.lang = q.lang AND x.phrase = q.lp JOIN s y ON y.lang = q.lang AND y.phrase = q.rp),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM d),
h AS (SELECT lang, phrase, max(n) AS longer FROM (SELECT lang, a || ' ' || b AS phrase, n FROM f3 UNION ALL SELECT lang, b || ' ' || c, n FROM f3) GROUP BY ALL),
k AS (SELECT b.* FROM b LEFT JOIN h USING (lang, phrase) WHERE nth = 1 AND (longer IS NULL OR 100 * longer < 50 * a)),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, CAST(r.score AS BIGINT) AS score FROM r JOIN t ON t.lang = r.lang WHERE r.rank <= 2000"""
