"""Byte-level BPE encoding and decoding.

The merges of many pieces run together: pieces are put into padded integer
matrices by length, and in each round every row merges its leftmost pair of
minimum rank.  Pair ranks come from an open-addressing hash table in numpy.
Rows without a pair left leave the matrix, and its width shrinks with them.
Ids are kept as 32-bit numbers in bytes, not as objects of Python.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

NO_RANK = np.int32(2**31 - 1)
PAD = np.int32(-1)
#: Widths of the matrices; longer pieces take the blocked row of ``_merge_long``.
WIDTHS = (4, 8, 12, 16, 24, 32, 64, 128, 256)
#: Pieces whose ids a task remembers, their characters together, cells of one matrix, and characters of the texts encoded at once.
CACHE_PIECES, CACHE_CHARACTERS, MATRIX_CELLS, GROUP = 200_000, 1 << 22, 1 << 18, 1 << 19

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
    T.StructField("ids", T.ArrayType(T.IntegerType()))])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def split_pattern(pattern: str) -> regex.Pattern:
    """The splitting pattern with ``\\s`` as Unicode White_Space (U+001C to U+001F aren't in it)."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


class PairTable:
    """(left id, right id) to the rank of their concatenation, by linear probing."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        key, value = np.array(keys, np.int64), np.array(values, np.int32)
        self.bits = max(4, int(4 * len(key)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NO_RANK, np.int32)
        slot, left = self._slot(key), np.arange(len(key))
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            self.keys[slot[free]] = key[free]  # of several, the last stays
            won = left[self.keys[slot[left]] == key[left]]
            self.ranks[slot[won]] = value[won]
            left = left[self.keys[slot[left]] != key[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        key = np.where((left < 0) | (right < 0), np.int64(-2), key)
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.ranks[slot], NO_RANK)
        again = np.flatnonzero((found != key) & (found >= 0) & (key >= 0))
        while len(again):
            slot[again] = (slot[again] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[again]]
            hit = found == key[again]
            out[again[hit]] = self.ranks[slot[again[hit]]]
            again = again[~hit & (found >= 0)]
        return out


class Bpe:
    """Encoder and decoder for one rank file and splitting pattern."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.pairs = PairTable(self.ranks)
        self.split = split_pattern(pattern)
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.text_of = {rank: str(rank) for rank in self.bytes_of}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.cache: dict[str, bytes] = {}
        self.cached = 0

    def _merge_matrix(self, pieces: list[bytes], width: int) -> list[bytes]:
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
        lengths = np.array([len(p) for p in pieces])
        ids = np.where(np.arange(width) < lengths[:, None], self.single[flat], PAD)
        rank = self.pairs.look_up(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width - 1)
        out: list = [None] * len(pieces)
        rows = np.arange(len(pieces))
        while len(rows):
            at = rank.argmin(1)
            line = np.arange(len(rows))
            best = rank[line, at]
            done = best == NO_RANK
            if done.any():
                for r, row, n in zip(rows[done].tolist(), ids[done], (ids[done] >= 0).sum(1).tolist(), strict=True):
                    out[r] = row[:n].tobytes()
                keep = ~done
                rows, at, best = rows[keep], at[keep], best[keep]
                if not len(rows):
                    break
                used = int((ids[keep] >= 0).sum(1).max())
                ids, rank = ids[keep][:, :used], rank[keep][:, : max(used - 1, 1)]
                line = np.arange(len(rows))
            width = ids.shape[1]
            ids[line, at] = best
            source = np.arange(width)[None, :] + (np.arange(width)[None, :] > at[:, None])
            ids = np.where(source < width, np.take_along_axis(ids, np.minimum(source, width - 1), 1), PAD)
            source = source[:, : width - 1]
            rank = np.where(source < width - 1, np.take_along_axis(rank, np.minimum(source, width - 2), 1), NO_RANK)
            right = np.where(at + 1 < width, ids[line, np.minimum(at + 1, width - 1)], PAD)
            here = np.minimum(at, width - 2)
            rank[line, here] = np.where(at < width - 1, self.pairs.look_up(ids[line, at], right), rank[line, here])
            inner = at > 0
            rank[line[inner], at[inner] - 1] = self.pairs.look_up(ids[line, at - 1][inner], ids[line, at][inner])
        return out

    def _merge_long(self, piece: bytes) -> bytes:
        """One long row as a square of blocks: block minima find the leftmost minimum without shifting."""
        n = len(piece)
        side = int(np.ceil(np.sqrt(n)))
        ids = np.full(side * side + 1, PAD, np.int32)
        ids[:n] = self.single[np.frombuffer(piece, np.uint8)]
        rank = np.full(side * side, NO_RANK, np.int32)
        rank[: n - 1] = self.pairs.look_up(ids[: n - 1], ids[1:n])
        blocks = rank.reshape(side, side)
        least = blocks.min(1)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)

        def renew(i: int) -> None:
            j = after[i]
            rank[i] = self.pairs.look_up(ids[i : i + 1], ids[j : j + 1])[0] if j < n else NO_RANK
            least[i // side] = blocks[i // side].min()

        while True:
            block = int(least.argmin())
            if least[block] == NO_RANK:
                break
            i = block * side + int(blocks[block].argmin())
            j = int(after[i])
            ids[i], ids[j], rank[j] = rank[i], PAD, NO_RANK
            least[j // side] = blocks[j // side].min()
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            renew(i)
            if before[i] >= 0:
                renew(int(before[i]))
        return ids[:n][ids[:n] >= 0].tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Put the ids of new pieces into the cache."""
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8")
            known = self.ranks.get(raw)
            if known is not None:
                self.cache[piece] = known.to_bytes(4, sys.byteorder)
            elif len(raw) > WIDTHS[-1]:
                self.cache[piece] = self._merge_long(raw)
            else:
                groups.setdefault(WIDTHS[bisect_left(WIDTHS, len(raw))], []).append((piece, raw))
        for width, members in groups.items():
            step = max(1, MATRIX_CELLS // width)
            for i in range(0, len(members), step):
                part = members[i : i + step]
                for (piece, _), ids in zip(part, self._merge_matrix([raw for _, raw in part], width), strict=True):
                    self.cache[piece] = ids

    def encode_arrays(self, texts: list[str]) -> Iterator[np.ndarray]:
        split = [self.split.findall(text) for text in texts]
        every = set().union(*split)
        new = {piece for piece in every if piece not in self.cache}
        more = sum(map(len, new))
        if self.cache and (len(self.cache) + len(new) > CACHE_PIECES or self.cached + more > CACHE_CHARACTERS):
            self.cache.clear()
            new, more, self.cached = every, sum(map(len, every)), 0
        self.cached += more
        self.learn(new)
        for pieces in split:
            yield np.frombuffer(b"".join(map(self.cache.__getitem__, pieces)), np.int32)

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        yield from (ids.tolist() for ids in self.encode_arrays(texts))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _groups(column: pa.Array, most: int = GROUP) -> Iterator[list[str]]:
    """Runs of a column's texts of about ``most`` characters; only one is in memory as texts of Python."""
    part: list[str] = []
    size = 0
    for text in column:
        part.append(text.as_py() or "")
        size += len(part[-1])
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode_decode(docs: DataFrame, path: str, pattern: str, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text and decode the ids again.

    One row per input row: the number of ids, the SHA-256 of the decimal ids
    joined by commas, the SHA-256 of the decoded bytes and, ``with_ids``, the
    ids.  A null text counts as empty (no ids); repeated rows stay repeated, a
    null ``doc_id`` stays null, other columns are ignored, an empty table gives
    an empty result.  The rank file must be readable on the executors.  No
    shuffle: a task holds one Arrow batch, some texts of it as texts of Python and
    a cache of pieces, bounded by their number and characters.
    """
    schema = T.StructType(SCHEMA.fields if with_ids else SCHEMA.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = pa.default_memory_pool()
        pool.release_unused()  # of earlier tasks: the worker outlives them
        bpe = None
        for batch in batches:
            bpe = bpe or Bpe(path, pattern)
            at = 0
            for texts in _groups(batch.column(1)):
                keys, n, sha, back, all_ids = batch.column(0).slice(at, len(texts)), [], [], [], []
                at += len(texts)
                for array in bpe.encode_arrays(texts):
                    ids = array.tolist()
                    n.append(len(ids))
                    sha.append(hashlib.sha256(",".join(map(bpe.text_of.__getitem__, ids)).encode()).hexdigest())
                    back.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                    if with_ids:
                        all_ids.append(array)
                columns = [keys.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(np.concatenate(all_ids), pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
            batch = keys = columns = None
            pool.release_unused()

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, schema)
