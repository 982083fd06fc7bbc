"""Suffix-array dedup: remove every byte that a repeated string of LENGTH bytes covers.

Window starts are grouped so that equal windows always meet: each window is
filed under the least-hashed GRAM-byte string in it, its anchor.  Consecutive
starts with one anchor form a run; a run's segment is the text its windows
cover.  Runs whose anchor is found nowhere else hold no repeat.  The different
segments around one anchor, with the number of runs that have each, go through
an enhanced suffix array: suffixes sorted, a stack scan of the common prefixes
for the interval tree, and a test of the bytes to the left that keeps the maximal
repeats, each with all its occurrences.  The suffixes of an anchor with very many
windows are sorted by Spark: each range of the order is a slice of one suffix
array, scanned by a task, and the intervals that pass the slices' borders are
put together from a summary of each slice.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampliq.llm.common import maybe_in, text_or_empty, written

LENGTH, GRAM = 200, 32
#: Bytes hashed at once; bytes of segments that one task sorts at once; suffixes in a slice of an array that Spark sorts, as it does for anchors with more windows in different segments.
REGION, ARRAY, SLICE = 1 << 20, 1 << 18, 1 << 17
#: Bounds of the bytes to the left of several occurrences where one of them is unknown: they differ from any.
UNKNOWN = (-1, 256)
_POSITION = np.uint64((1 << 22) - 1)
_DRAW = np.random.Generator(np.random.PCG64(4))
_TABLE = _DRAW.integers(0, 1 << 63, 256, np.int64).astype(np.uint64)
_FACTORS = _DRAW.integers(0, 1 << 62, 8, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position, by doubling."""
    h, step = _TABLE[data], 1
    for factor in _FACTORS[: GRAM.bit_length() - 1]:
        h = h[:-step] * factor + h[step:]
        step *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs_of(data: np.ndarray, bounds: list[tuple[int, int]], length: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, first start, starts, anchor offset) of the runs in ``data``; windows lie within ``bounds``."""
    empty = (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
    if len(data) < length:
        return empty
    h = gram_hashes(data)
    packed = (h & ~_POSITION) | np.arange(len(h)).astype(np.uint64)
    anchor = (sliding_minimum(packed, length - GRAM + 1) & _POSITION).astype(np.int64)
    edge = np.zeros(len(anchor) + 1, np.int32)
    for a, b in bounds:
        if b - a >= length:
            edge[a] += 1
            edge[b - length + 1] -= 1
    inside = np.cumsum(edge)[:-1] > 0
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return empty
    last = inside.copy()
    last[:-1] &= ~inside[1:] | (anchor[1:] != anchor[:-1])
    return h[anchor[first]], first, np.flatnonzero(last) - first + 1, anchor[first] - first


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an Arrow string column, without a copy."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)


def _regions(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """(low, high, [(row, low, high)]): stretches of about REGION bytes; longer texts come in pieces that share length - 1 bytes."""
    part: list[tuple[int, int, int]] = []
    for row in range(len(offsets) - 1):
        a, b = int(offsets[row]), int(offsets[row + 1])
        if part and b - part[0][1] > REGION:
            yield part[0][1], part[-1][2], part
            part = []
        if b - a > REGION:
            for s in range(a, b - length + 1, REGION - length + 1):
                e = min(b, s + REGION)
                yield s, e, [(row, s, e)]
        elif b > a:
            part.append((row, a, b))
    if part:
        yield part[0][1], part[-1][2], part


def _runs(named: DataFrame, length: int) -> DataFrame:
    """(mh, sg, k1, k2, place) of all runs; place packs start, starts and the anchor's offset."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = _bytes_of(batch.column(3))
            for low, high, rows in _regions(offsets, length):
                part = data[low:high]
                mh, first, n, off = runs_of(part, [(a - low, b - low) for _, a, b in rows], length)
                if not len(first):
                    continue
                view = memoryview(part)
                sg = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(first.tolist(), (first + n + length - 1).tolist(), strict=True)), np.uint64, len(first))
                owner = np.searchsorted(np.array([a - low for _, a, _ in rows]), first, "right") - 1
                row = np.array([r for r, _, _ in rows])[owner]
                start = first + low - offsets[row]
                keys = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(mh.view(np.int64)), pa.array(sg.view(np.int64)), batch.column(1).take(keys), batch.column(2).take(keys), pa.array((start << 32) | (n << 16) | off)], ["mh", "sg", "k1", "k2", "place"])

    return named.mapInArrow(run, "mh long, sg long, k1 long, k2 long, place long")


def _segments(joined: DataFrame, length: int) -> DataFrame:
    """(mh, sg, n, runs, seg) of the runs in ``reps`` (array of mh, sg, windows, runs, place)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = _bytes_of(batch.column("text"))
            out: list[tuple] = []
            for row, reps in enumerate(batch.column("reps")):
                view = memoryview(data[offsets[row] : offsets[row + 1]])
                for r in reps.as_py():
                    start, n = r["place"] >> 32, (r["place"] >> 16) & 0xFFFF
                    out.append((r["mh"], r["sg"], n, r["runs"], bytes(view[start : start + n + length - 1])))
                    if len(out) > 4000:
                        yield _rows(out)
                        out = []
            if out:
                yield _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["mh", "sg", "n", "runs", "seg"])

    return joined.mapInArrow(run, "mh long, sg long, n int, runs long, seg binary")


def common_prefix_intervals(lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(prefix length, first, last) of the intervals of the tree with prefixes of ``least`` or more, by a stack scan.

    lcp[i] is the common prefix of suffixes i and i + 1 of the array.
    """
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []
    for i, value in enumerate([*lcp.tolist(), 0]):
        first = i
        while stack and stack[-1][0] > value:
            size, first = stack.pop()
            out.append((size, first, i))
        if value >= least and (not stack or stack[-1][0] < value):
            stack.append((value, first))
    return out


def maximal_repeats(segments: list[bytes], starts: list[int], length: int = LENGTH, runs: list[int] | None = None) -> list[tuple[int, list[tuple[int, int]]]]:
    """(length, [(segment, offset)]) of each maximal repeat of at least ``length`` bytes, with all occurrences.

    Suffixes begin at the first ``starts`` positions of each segment and end
    with it.  What is left of a segment is unknown and counts as different.
    A segment stands for as many ``runs``: one that has several is a leaf of
    the tree that repeats as a whole, unless an interval has all of it.  No
    segment, or none long enough, has no repeat.
    """
    positions, rest, owner, offset, joined = _suffixes(segments, starts)
    if not len(positions):
        return []
    many = np.array(runs if runs is not None else [1] * len(segments)) > 1
    alone = [(len(segments[k]), [(k, 0)]) for k in np.flatnonzero(many).tolist() if len(segments[k]) >= length and starts[k]]
    padded = np.frombuffer(joined + b"\0" * int(rest.max()), np.uint8)
    windows = np.lib.stride_tricks.sliding_window_view(padded, length)
    heads = np.ascontiguousarray(windows[positions]).view(f"S{length}").ravel()
    order = np.argsort(heads, kind="stable")
    equal = heads[order[1:]] == heads[order[:-1]]
    some = np.zeros(len(order), bool)
    some[1:] |= equal
    some[:-1] |= equal
    picked = order[some]
    if not len(picked):
        return alone
    #: Only these can be in an interval; they are sorted by their whole suffixes.
    width = int(rest[picked].max())
    whole = np.lib.stride_tricks.sliding_window_view(padded, width)[positions[picked]].copy()
    whole[np.arange(width) >= rest[picked][:, None]] = 0
    again = np.argsort(whole.view(f"S{width}").ravel(), kind="stable")
    picked, whole = picked[again], whole[again]
    differ = whole[1:] != whole[:-1]
    lcp = np.where(differ.any(1), differ.argmax(1), width)
    lcp = np.minimum(lcp, np.minimum(rest[picked[1:]], rest[picked[:-1]]))
    left = np.where(offset[picked] > 0, padded[positions[picked] - 1].astype(np.int64), -1 - picked)
    diverse = np.concatenate(([0], np.cumsum(left[1:] != left[:-1])))
    found = [(size, list(zip(owner[picked[a : b + 1]].tolist(), offset[picked[a : b + 1]].tolist(), strict=True)))
             for size, a, b in common_prefix_intervals(lcp, length) if diverse[b] > diverse[a]]
    covered = {k for size, places in found for k, at in places if at == 0 and size == len(segments[k])}
    return found + [leaf for leaf in alone if leaf[1][0][0] not in covered]


def _suffixes(segments: list[bytes], starts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    n, sizes = np.array(starts, np.int64), np.array([len(s) for s in segments], np.int64)
    base = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    owner = np.repeat(np.arange(len(segments)), n)
    offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return base[owner] + offset, sizes[owner] - offset, owner, offset, b"".join(segments)


def _name(repeat: bytes) -> int:
    return xxhash.xxh3_64_intdigest(repeat) - (1 << 63)


def _scan(segments: DataFrame, length: int, groups: bool = False) -> DataFrame:
    """(mh, sg, lo, n): stretches of repeated starts, from the maximal repeats of each anchor's segments.

    With ``groups`` one row per repeat and segment instead: (mh, sg, lo, n, id),
    where n is the repeat's length less ``length`` plus 1 and id 64 bits of its
    bytes.  Rows come sorted by mh; anchors are put together up to ARRAY bytes,
    and none has more than SLICE windows.
    """
    names = ["mh", "sg", "lo", "n", *["id"] * groups]

    def repeated(rows: list[tuple]) -> pa.RecordBatch:
        out: list[tuple] = []
        marks = [np.zeros(r[2] + 1, np.int32) for r in rows]
        for size, places in maximal_repeats([r[4] for r in rows], [r[2] for r in rows], length, [r[3] for r in rows]):
            k, at = places[0]
            name = _name(rows[k][4][at : at + size]) if groups else 0
            for k, at in places:
                marks[k][at] += 1
                marks[k][at + size - length + 1] -= 1
                if groups:
                    out.append((*rows[k][:2], at, size - length + 1, name))
        for r, mark in zip(rows, marks, strict=True):
            if not groups and mark.any():
                on = np.concatenate(([0], np.cumsum(mark)[:-1] > 0, [0])).astype(np.int8)
                step = np.diff(on)
                out += [(*r[:2], a, b - a) for a, b in zip(np.flatnonzero(step > 0).tolist(), np.flatnonzero(step < 0).tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(len(names))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple] = []
        group: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("mh", "sg", "n", "runs", "seg")), strict=True):
                if group and group[0][0] != row[0]:
                    if len(group) > 1 or group[0][3] > 1:
                        ready += group
                        size += sum(len(r[4]) for r in group)
                        if size > ARRAY:
                            yield repeated(ready)
                            ready, size = [], 0
                    group = []
                group.append(row)
        if len(group) > 1 or group and group[0][3] > 1:
            ready += group
        if ready:
            yield repeated(ready)

    return segments.repartition("mh").sortWithinPartitions("mh").mapInArrow(run, "mh long, sg long, lo long, n long" + ", id long" * groups)


def common_prefix(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle)
    return low


def scan_slice(suffixes: list[bytes], anchors: list[int], times: list[int], least: list[int], most: list[int], length: int) -> tuple[list[tuple[int, int]], list[tuple[int, str, int]], dict]:
    """(repeats, edges, summary) of a slice of a suffix array, in which each suffix stands once.

    ``times`` counts a suffix's occurrences, ``least`` and ``most`` bound the
    bytes to their left.  Repeats are (suffix, length) for each maximal repeat
    that no neighbour of the slice can change.  Edges are (suffix, side,
    length): the suffix has so many bytes in common with the first ("L") or
    last ("R") one of the slice, ``length`` or more.  The summary holds what
    ``border_repeats`` needs.
    """
    n = len(suffixes)
    lcp = np.array([common_prefix(suffixes[k], suffixes[k + 1]) if anchors[k] == anchors[k + 1] else 0 for k in range(n - 1)], np.int64)
    low, high = np.array(least), np.array(most)
    found = [(k, len(suffixes[k])) for k in range(n) if times[k] > 1 and least[k] < most[k] and len(suffixes[k]) >= length]
    for size, a, b in common_prefix_intervals(lcp, length):
        if 0 < a and b < n - 1 and low[a : b + 1].min() < high[a : b + 1].max():
            found += [(k, size) for k in range(a, b + 1)]
    edges: list[tuple[int, str, int]] = []
    summary: dict = {}
    for side, order in (("L", np.arange(n)), ("R", np.arange(n)[::-1])):
        shared = np.minimum.accumulate(np.concatenate(([len(suffixes[order[0]])], lcp if side == "L" else lcp[::-1])))
        inside = shared >= length
        edges += [(k, side, d) for k, d in zip(order[inside].tolist(), shared[inside].tolist(), strict=True)]
        #: For each depth that the common prefix falls to: the bounds of the bytes to the left so far.
        ends = np.flatnonzero(inside & np.concatenate((shared[1:] != shared[:-1], [True])))
        bounds = zip(shared[ends].tolist(), np.minimum.accumulate(low[order])[ends].tolist(), np.maximum.accumulate(high[order])[ends].tolist(), ends.tolist(), strict=True)
        summary[side] = {"anchor": int(anchors[order[0]]), "suffix": suffixes[order[0]].hex(), "depths": [list(x) for x in bounds], "through": int(shared[-1])}
    return found, edges, summary


def border_repeats(slices: list[tuple[int, dict]], length: int) -> list[tuple[int, str, int, int]]:
    """(slice, side, length, id) of the maximal repeats that reach a slice's first or last suffix; ``slices`` are in order.

    For each depth the slices are passed once; a run of suffixes with so long a
    common prefix goes on over a border, and through a slice whose suffixes all
    share as much.  It is an interval if two neighbours share no more than that.
    """
    firsts = [bytes.fromhex(s["L"]["suffix"]) for _, s in slices]
    lasts = [bytes.fromhex(s["R"]["suffix"]) for _, s in slices]
    border = [0] + [common_prefix(lasts[k], firsts[k + 1]) if slices[k][1]["R"]["anchor"] == slices[k + 1][1]["L"]["anchor"] else 0 for k in range(len(slices) - 1)]
    depths = {d for _, s in slices for side in "LR" for d, *_ in s[side]["depths"]} | {b for b in border if b >= length}
    out: list[tuple[int, str, int, int]] = []

    def edge(k: int, side: str, depth: int) -> tuple[int, int, bool]:
        """Bounds of the bytes to the left of the run at an edge, and whether it has two neighbours that share no more; an empty run bounds nothing."""
        found = slices[k][1][side]["depths"]
        reached = bisect_right(found, -depth, key=lambda x: -x[0])
        if not reached:
            return UNKNOWN[1], UNKNOWN[0], False
        at, a, b, place = found[reached - 1]
        return a, b, at == depth and place > 0

    for depth in sorted(depths):
        members: list[tuple[int, str]] = []
        low, high, exact = UNKNOWN[1], UNKNOWN[0], False

        def close() -> None:
            if exact and low < high:
                body = firsts[members[0][0]] if members[0][1] == "L" else lasts[members[0][0]]
                out.extend((slices[k][0], side, depth, _name(body[:depth])) for k, side in members)

        for k in range(len(slices)):
            if border[k] < depth:
                close()
                members, low, high, exact = [], UNKNOWN[1], UNKNOWN[0], False
            for side in "LR":
                a, b, c = edge(k, side, depth)
                members.append((k, side))
                low, high, exact = min(low, a), max(high, b), exact or c or (side == "L" and border[k] == depth)
                if side == "L" and slices[k][1]["L"]["through"] < depth:
                    close()
                    members, low, high, exact = [], UNKNOWN[1], UNKNOWN[0], False
        close()
    return out


def _scan_sorted(segments: DataFrame, windows: int, length: int, groups: bool = False) -> DataFrame:
    """As ``_scan``, for ``segments`` (written) of ``windows`` windows, which are sorted over many tasks.

    Equal suffixes become one before they are sorted, so that any range can be
    cut; a slice has about SLICE suffixes.  Each task returns the repeats within
    its slice, the suffixes at its edges, and one summary; the summaries, one
    per task and at most as long as a segment has starts, are joined on the driver.
    """
    spark = segments.sparkSession
    suffixes = segments.select("mh", "sg", "runs", "seg", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("lo"))
    suffix, before = F.expr("substring(seg, lo + 1)"), F.conv(F.hex(F.expr("substring(seg, lo, 1)")), 16, 10).cast("int")
    suffixes = suffixes.select("mh", "sg", F.col("lo").cast("long").alias("lo"), suffix.alias("suffix"), F.when(F.col("lo") == 0, F.col("runs")).otherwise(1).alias("times"), F.when(F.col("lo") > 0, before).alias("before"))
    suffixes = suffixes.withColumns({"s1": F.xxhash64("mh", "suffix"), "s2": F.xxhash64(F.lit(1), "mh", "suffix")})
    leaves = suffixes.groupBy("mh", "suffix", "s1", "s2").agg(F.sum("times").alias("times"), F.min(F.coalesce("before", F.lit(UNKNOWN[0]))).alias("least"), F.max(F.coalesce("before", F.lit(UNKNOWN[1]))).alias("most"))
    leaves = written(leaves, "suffix-leaves")
    parts = -(-windows // SLICE)
    ordered = leaves.repartitionByRange(parts, "mh", "suffix").sortWithinPartitions("mh", "suffix").withColumn("slice", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        at, bodies = table["slice"][0].as_py(), table["suffix"].to_pylist()
        found, edges, summary = scan_slice(bodies, *(table[c].to_pylist() for c in ("mh", "times", "least", "most")), length)
        if not groups:  # the longest repeat from a start has all its windows
            longest: dict[int, int] = {}
            for k, size in found:
                longest[k] = max(size, longest.get(k, 0))
            found = list(longest.items())
        s1, s2 = table["s1"].to_numpy(), table["s2"].to_numpy()
        rows = [(k, size, _name(bodies[k][:size]) if groups else 0, None) for k, size in found] + [(k, size, None, side) for k, side, size in edges]
        spots = [r[0] for r in rows]
        columns = [pa.array(s1[spots]), pa.array(s2[spots]), *(pa.array([r[i] for r in rows], kind) for i, kind in ((1, pa.int64()), (2, pa.int64()), (3, pa.string())))]
        names = ["s1", "s2", "size", "id", "side", "summary", "slice"]
        for columns, text in ((columns, None), ([pa.nulls(1, c.type) for c in columns], json.dumps(summary))):
            yield pa.RecordBatch.from_arrays([*columns, pa.array([text] * len(columns[0]), pa.string()), pa.array([at] * len(columns[0]), pa.int32())], names)

    scanned = written(ordered.mapInArrow(run, "s1 long, s2 long, size long, id long, side string, summary string, slice int"), "suffix-slices", leaves)
    slices = sorted((r["slice"], json.loads(r["summary"])) for r in scanned.where("summary is not null").select("slice", "summary").collect())
    borders = spark.createDataFrame(border_repeats(slices, length), "slice int, side string, depth long, id long")
    edges = scanned.where("side is not null").select("s1", "s2", "slice", "side", "size").join(borders, ["slice", "side"]).where("depth <= size").select("s1", "s2", F.col("depth").alias("size"), "id")
    repeats = scanned.where("summary is null and side is null").select("s1", "s2", "size", "id").unionByName(edges)
    repeats = repeats.distinct() if groups else repeats.groupBy("s1", "s2").agg(F.max("size").alias("size"))
    #: A suffix that very many segments have is one key on the right, and on the left rows that Spark can split.
    out = suffixes.select("mh", "sg", "lo", "s1", "s2").join(repeats.hint("merge"), ["s1", "s2"])
    return out.select("mh", "sg", "lo", (F.col("size") - length + 1).alias("n"), *["id"] * groups)


def named_texts(docs: DataFrame, doc_id: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, k1, k2, text, ...): 128 bits name a text, so that copies are one text and ids may be null or repeated."""
    body = text_or_empty(docs[text])
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(1), body).alias("k2"), body.alias("text"), *(docs[c].alias(f"keep_{c}") for c in keep))


def _stretches(parts: Column) -> Column:
    """Stretches (lo, n) that follow on each other become one; ``parts`` is sorted."""
    def add(acc: Column, p: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        end = F.greatest(last["lo"] + last["n"], p["lo"] + p["n"])
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["lo"].alias("lo"), (end - last["lo"]).alias("n"))))
        return F.when((F.size(acc) > 0) & (p["lo"] <= last["lo"] + last["n"]), joined).otherwise(F.concat(acc, F.array(p)))

    return F.aggregate(parts, F.array().cast("array<struct<lo:bigint,n:bigint>>"), add)


def _filed(named: DataFrame, length: int, groups: bool = False) -> tuple[DataFrame, DataFrame]:
    """(kept, scanned): the runs (mh, sg, k1, k2, n, places) of anchors that are found again, and what ``_scan`` finds in one run of each kind."""
    runs = written(_runs(named.select("doc_id", "k1", "k2", "text"), length), "suffix-runs")
    again = written(runs.groupBy("mh").agg(F.count("*").alias("total")).where("total > 1").select("mh"), "suffix-again")
    #: Nearly all runs of other anchors go here, without a join that would bring a hot anchor to one task; the rest go by the totals below.
    likely = maybe_in(runs, again, "mh").where("_maybe").drop("_maybe")
    #: A text that repeats itself has many runs with one segment: they become one row, bounded by the text.
    kept = likely.groupBy("mh", "sg", "k1", "k2").agg(F.count("*").alias("n"), F.collect_set("place").alias("places"))
    kept = written(kept, "suffix-kept", runs, again)
    kinds = kept.groupBy("mh", "sg").agg(F.sum("n").alias("runs"), F.min(F.struct("k1", "k2", F.array_min("places").alias("place"))).alias("rep"))
    kinds = written(kinds, "suffix-kinds")
    of_anchor = kinds.groupBy("mh").agg(F.sum(_windows("rep.place")).alias("windows"), F.sum("runs").alias("total")).where("total > 1").drop("total")
    reps = kinds.join(of_anchor.hint("merge"), "mh").groupBy("rep.k1", "rep.k2").agg(F.collect_list(F.struct("mh", "sg", "windows", "runs", "rep.place")).alias("reps"))
    reps = written(reps, "suffix-reps", kinds)
    large = reps.select(F.explode("reps").alias("r")).where(F.col("r.windows") > SLICE).agg(F.sum(_windows("r.place"))).first()[0]

    def segments(these: Callable[[Column], Column]) -> DataFrame:
        some = reps.select("k1", "k2", F.filter("reps", lambda r: these(r["windows"])).alias("reps")).where(F.size("reps") > 0) if large else reps
        #: Copies of a text become one before they are joined, so each segment arises once.
        texts = maybe_in(named.select("k1", "k2", "text"), some, "k1", "k2").where("_maybe").groupBy("k1", "k2").agg(F.min("text").alias("text"))
        return _segments(texts.join(some.hint("merge"), ["k1", "k2"]), length)

    scanned = _scan(segments(lambda n: n <= SLICE), length, groups)
    if large:
        scanned = scanned.unionByName(_scan_sorted(written(segments(lambda n: n > SLICE), "suffix-large"), large, length, groups))
    return kept, scanned


def _windows(place: str) -> Column:
    return F.shiftright(place, 16).bitwiseAND(F.lit(0xFFFF))


def _checked(length: int) -> None:
    if not GRAM <= length < 1 << 15:
        raise ValueError(f"a length of {GRAM} to {(1 << 15) - 1} bytes, not {length}")


def repeated_starts(named: DataFrame, length: int = LENGTH) -> DataFrame:
    """(k1, k2, starts): per text, array<struct<start, n>> of window starts whose window is found elsewhere too."""
    kept, scanned = _filed(named, length)
    found = scanned.groupBy("mh", "sg").agg(_stretches(F.array_sort(F.collect_list(F.struct("lo", "n")))).alias("parts"))
    placed = kept.select("mh", "sg", "k1", "k2", "places").join(found.hint("merge"), ["mh", "sg"])
    starts = F.flatten(F.transform("places", lambda p: F.transform("parts", lambda q: F.struct((F.shiftright(p, 32) + q["lo"]).alias("start"), q["n"].alias("n")))))
    return written(placed.groupBy("k1", "k2").agg(F.flatten(F.collect_list(starts)).alias("starts")), "suffix-starts", kept)


def repeat_groups(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The maximal repeats themselves: id, length, doc_id and start (bytes), one row per occurrence.

    A repeat is a string of ``length`` bytes or more that starts at two places
    or more, in one document or several, and that the bytes left and right of
    it don't extend at all of them; what lies beyond an anchor's segments isn't
    seen, so long repeats come as several groups, one per anchor.  Every group
    has all its occurrences.  ids are 64 bits of the bytes.  Null
    and short texts have no repeat; repeated rows and rows of one id count each;
    other columns are ignored; an empty table gives an empty result.
    """
    _checked(length)
    named = named_texts(docs, doc_id, text)
    kept, scanned = _filed(named, length, True)
    placed = kept.select("mh", "sg", "k1", "k2", F.explode("places").alias("place")).join(scanned.hint("merge"), ["mh", "sg"])
    placed = placed.select("id", (F.col("n") + length - 1).alias("length"), "k1", "k2", (F.shiftright("place", 32) + F.col("lo")).alias("start"))
    every = placed.distinct().join(named.select("doc_id", "k1", "k2").hint("merge"), ["k1", "k2"])
    several = every.groupBy("id", "length").agg(F.count("*").alias("times")).where("times > 1").select("id", "length")
    return every.join(several.hint("merge"), ["id", "length"]).select("id", "length", "doc_id", "start")


def cut(body: bytes, starts: list[dict] | None, length: int = LENGTH) -> tuple[list[bytes], int, int]:
    """(kept pieces, removed bytes, maximal removed runs)."""
    spans: list[list[int]] = []
    for a, b in sorted((s["start"], s["start"] + s["n"] + length - 1) for s in starts or ()):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    edges = [0, *(x for span in spans for x in span), len(body)]
    return [body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)], sum(b - a for a, b in spans), len(spans)


def remove_repeats(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, with ``with_text`` the kept text, and the columns in ``keep``.

    Every occurrence of a repeated string goes, the first too; overlapping
    occurrences count, and matches lie within one document.  A null text counts
    as empty; texts under ``length`` bytes stay whole; a document that is
    repeated whole loses all its bytes but keeps its row; repeated rows and null
    ids stay; an empty table gives an empty result.  In the kept text,
    characters of which a part was removed are left out.  ``length`` is from
    GRAM to 32,767 bytes, else ValueError.

    Copies of a text are counted where they arise and only their first run is
    carried on, so a large group of copies adds counts, not rows.  The suffixes
    of an anchor shared by very many texts are sorted over many tasks, so no
    group of rows is held by one task.  All per-text lists are
    bounded by the text.
    """
    _checked(length)
    named = named_texts(docs, doc_id, text, keep)
    starts = repeated_starts(named, length)
    #: Texts without repeats pass by the shuffle.
    flagged = maybe_in(named, starts, "k1", "k2")
    joined = flagged.where("_maybe").drop("_maybe").join(starts.hint("merge"), ["k1", "k2"], "left")
    joined = joined.unionByName(flagged.where("not _maybe").drop("_maybe").withColumn("starts", F.lit(None).cast(starts.schema["starts"].dataType)))
    kept = [c for c in joined.columns if c.startswith("keep_")]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), *(T.StructField(c, T.StringType()) for c in ["kept_sha256", "text"][: 1 + with_text]),
                           *(T.StructField(c[5:], joined.schema[c].dataType) for c in kept)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, bodies = [], []
            for body, starts in zip(batch.column("text").cast(pa.binary()), batch.column("starts"), strict=True):
                body = body.as_py()
                pieces, removed, spans = cut(body, starts.as_py(), length)
                rest = b"".join(pieces)
                rows.append((len(body), removed, spans, hashlib.sha256(rest).hexdigest()))
                if with_text:
                    bodies.append(b"".join(p.decode("utf-8", "ignore").encode() for p in pieces).decode())
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            arrays = [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True))]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                arrays.append(pa.array(bodies, pa.string()))
                names.append("text")
            yield pa.RecordBatch.from_arrays([*arrays, *(batch.column(c) for c in kept)], [*names, *(c[5:] for c in kept)])

    return joined.mapInArrow(run, schema)
