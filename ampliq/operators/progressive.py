"""Progressive multiple alignment of a sample's haplotypes: k-mer distances, a guide tree, and profiles merged along it."""

from __future__ import annotations

import numpy as np

from ampliq.functions.gotoh import CELLS, EXTEND, MISMATCH, OPEN, Gaps, fill, trace

#: Length of the words by which sequences are compared before they are aligned, and the first band of a merge.
KMER, BAND = 5, 16
_GAP = ord("-")
#: Rows of a profile: A, C, G, T, other letters; gaps are what is missing to the number of sequences.
_CODE = np.full(256, 4, np.uint8)
_CODE[np.frombuffer(b"ACGT", np.uint8)] = range(4)


def distances(seqs: list[bytes], k: int = KMER) -> np.ndarray:
    """One minus the share of k-mers that two sequences have in common, of the shorter one's; 1 where one has none."""
    counts = np.zeros((len(seqs), 5**k), np.int32)
    for row, s in zip(counts, seqs, strict=True):
        codes = _CODE[np.frombuffer(s, np.uint8)].astype(np.int64)
        if len(codes) >= k:
            np.add.at(row, sum(codes[i : len(codes) - k + 1 + i] * 5**i for i in range(k)), 1)
    used = counts[:, counts.any(0)]
    size = np.maximum(counts.sum(1), 1)
    return np.array([1 - np.minimum(row, used).sum(1) / np.minimum(n, size) for row, n in zip(used, size, strict=True)]).reshape(len(seqs), -1)


def guide_tree(apart: np.ndarray) -> list[tuple[int, int]]:
    """The nearest clusters, merged until one is left: pairs of clusters, each taking the first one's number.

    Distances are averages of members; of equal ones the smallest clusters come
    first, which keeps the tree low.
    """
    d, size, merges = np.round(apart, 9), np.ones(len(apart)), []
    np.fill_diagonal(d, np.inf)
    for _ in range(len(d) - 1):
        near = np.argwhere(d == d.min())
        i, j = sorted(near[(size[near[:, 0]] + size[near[:, 1]]).argmin()].tolist())
        merges.append((i, j))
        d[i] = d[:, i] = np.round((d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j]), 9)
        d[i, i] = np.inf
        d[j] = d[:, j] = np.inf
        size[i] += size[j]
    return merges


def _profiles(groups: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(shares of the letters by group and column, share of rows that have one), zeros after a group's end."""
    held = np.zeros((len(groups), max(g.shape[1] for g in groups), 5))
    for out, g in zip(held, groups, strict=True):
        for c in range(5):
            out[: g.shape[1], c] = ((g != _GAP) & (_CODE[g] == c)).mean(0)
    return held, held.sum(2)


def _outside(price: Gaps, n: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The least that leaving out ``least`` columns costs on one side of each pair, besides the start of a gap."""
    out = np.zeros(len(n), np.int64)
    for k, size in enumerate(n):
        cheapest = np.sort(price.base[k, :size])[: max(int(least[k]), 0)]
        out[k] = cheapest.sum() + price.start[k, :size].min(initial=1 << 30) if len(cheapest) else 0
    return out


def _put(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    if not rows.shape[1]:
        return np.full((len(rows), len(at)), _GAP, np.uint8)
    return np.where(at >= 0, rows[:, np.clip(at, 0, rows.shape[1] - 1)], _GAP).astype(np.uint8)


def merge(pairs: list[tuple[np.ndarray, np.ndarray]], cells: int = CELLS) -> list[np.ndarray]:
    """Each pair of alignments as one: columns are matched at the least mean cost of their letters, gaps cost by the letters that face them.

    Pairs are merged together within a band, which is doubled for those whose
    cost an alignment outside of it could have; so the optimum over all ways to
    match the columns is found, unless the matrix of one pair passes ``cells``.
    """
    out: list = [None] * len(pairs)
    todo, width = list(range(len(pairs))), BAND
    while todo:
        again = []
        longest = max(max(a.shape[1], b.shape[1]) for a, b in (pairs[k] for k in todo))
        spread = max(abs(a.shape[1] - b.shape[1]) for a, b in (pairs[k] for k in todo)) + 2 * width + 1
        step = max(1, cells // ((longest + 1) * spread))
        for start in range(0, len(todo), step):
            part = todo[start : start + step]
            (pa, full_a), (pb, full_b) = _profiles([pairs[k][0] for k in part]), _profiles([pairs[k][1] for k in part])
            la, lb = (np.array([pairs[k][side].shape[1] for k in part]) for side in (0, 1))
            apart = lb - la
            low, high = max(-int(la.max()), min(0, int(apart.min())) - width), min(int(lb.max()), max(0, int(apart.max())) + width)
            price_a, price_b = (Gaps(np.rint(OPEN * full).astype(np.int64), np.rint(EXTEND * full).astype(np.int64)) for full in (full_a, full_b))

            def sub(i: int, j: np.ndarray, pa=pa, pb=pb, full_a=full_a, full_b=full_b) -> np.ndarray:
                a, b = full_a[:, i, None], full_b[:, j]
                return np.rint(MISMATCH * (a * b - np.einsum("pwc,pc->pw", pb[:, j], pa[:, i])) + EXTEND * (a * (1 - b) + (1 - a) * b)).astype(np.int64)

            cost, directions = fill(sub, la, lb, price_a, price_b, low, high)
            beyond = np.minimum(_outside(price_a, la, width + 1 + np.maximum(-apart, 0)) + _outside(price_b, lb, width + 1 + np.minimum(apart, 0).clip(0)), _outside(price_b, lb, width + 1 + np.maximum(apart, 0)) + _outside(price_a, la, width + 1 + np.zeros_like(apart)))
            sure = (cost < beyond) | (width >= np.maximum(la, lb)) | ((la + 1) * (spread + 2 * width) > cells)
            x, y = trace(directions, la, lb, low)
            for n, k in enumerate(part):
                if sure[n]:
                    at, to = x[n][x[n] > -2][::-1], y[n][y[n] > -2][::-1]
                    out[k] = np.concatenate([_put(pairs[k][0], at), _put(pairs[k][1], to)])
                else:
                    again.append(k)
        todo, width = again, width * 2
    return out


def pair_costs(row: np.ndarray, others: np.ndarray) -> int:
    """Affine costs of the alignments that the columns give ``row`` with each of ``others``, summed."""
    gap, other = row == _GAP, others == _GAP
    state = np.where(gap & ~other, 1, np.where(~gap & other, 2, 0))
    held = ~(gap & other)  # columns of each pair
    before = np.maximum.accumulate(np.where(held, np.arange(len(row)), -1), 1)
    before = np.concatenate([np.full((len(others), 1), -1), before[:, :-1]], 1)
    previous = np.where(before >= 0, np.take_along_axis(state, np.maximum(before, 0), 1), 0)
    runs = (held & (state > 0) & (state != previous)).sum()
    return int(MISMATCH * (held & (state == 0) & (row != others)).sum() + EXTEND * (held & (state > 0)).sum() + OPEN * runs)


def pair_cost(aligned: list[bytes]) -> int:
    """The sum of the affine costs of the alignments of all pairs of rows."""
    rows = np.stack([np.frombuffer(s, np.uint8) for s in aligned])
    return sum(pair_costs(rows[k], rows[k + 1 :]) for k in range(len(rows) - 1))


def _squeezed(rows: np.ndarray) -> np.ndarray:
    return rows[:, (rows != _GAP).any(0)]


def refined(rows: np.ndarray) -> np.ndarray:
    """Each row whose gaps are not those of most rows is taken out and aligned to the others anew; it stays so if all its pairs together cost less."""
    most = (rows == _GAP).mean(0) > 0.5
    for k in np.flatnonzero(((rows == _GAP) != most).any(1)) if len(rows) > 2 else ():
        rest = np.delete(rows, k, 0)
        new = merge([(_squeezed(rows[k : k + 1]), _squeezed(rest))])[0]
        if pair_costs(new[0], new[1:]) < pair_costs(rows[k], rest):
            rows = np.insert(new[1:], k, new[0], 0)
    return rows


def align(seqs: list[bytes]) -> list[bytes]:
    """The multiple alignment of some sequences, in their order, all of one width.

    Merges of the tree that don't depend on each other are made together.  In
    the end each row that has gaps of its own is aligned to the others once more.
    """
    if not seqs:
        return []
    groups: list = [(np.frombuffer(s, np.uint8)[None], [k]) for k, s in enumerate(seqs)]
    tree = guide_tree(distances(seqs))
    level, by_level = [0] * len(seqs), {}
    for i, j in tree:
        level[i] = max(level[i], level[j]) + 1
        by_level.setdefault(level[i], []).append((i, j))
    for n in sorted(by_level):
        for (i, j), rows in zip(by_level[n], merge([(groups[i][0], groups[j][0]) for i, j in by_level[n]]), strict=True):
            groups[i] = (rows, groups[i][1] + groups[j][1])
            groups[j] = None
    rows, order = next(g for g in groups if g is not None)
    out: list = [b""] * len(seqs)
    for row, k in zip(refined(rows), order, strict=True):
        out[k] = row.tobytes()
    return out
