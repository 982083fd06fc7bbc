"""Column expressions on sequences and qualities; all of them run in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_CODES = "ACGTRYKMBVDHSWN"
_COMPLEMENTS = "TGCAYRMKVBHDSWN"
#: The same for bytes.
COMPLEMENT = bytes.maketrans((_CODES + _CODES.lower()).encode(), (_COMPLEMENTS + _COMPLEMENTS.lower()).encode())
#: Bases that an IUPAC code stands for, as bits of A, C, G, T.
IUPAC = {"A": 1, "C": 2, "G": 4, "T": 8, "R": 5, "Y": 10, "S": 6, "W": 9, "K": 12, "M": 3, "B": 14, "D": 13, "H": 11, "V": 7, "N": 15}
PHRED_OFFSET = 33


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, _CODES + _CODES.lower(), _COMPLEMENTS + _COMPLEMENTS.lower()))


def phred(qual: Column) -> Column:
    """Array of qualities."""
    return F.transform(F.filter(F.split(qual, ""), lambda c: c != ""), lambda c: F.ascii(c) - PHRED_OFFSET)


def bases_below(qual: Column, least: int = 30) -> Column:
    """Bases of a quality under ``least``, without an array: runs of characters below the cut are taken out."""
    if least < 1:
        return F.length(qual) * 0
    return F.length(qual) - F.length(F.regexp_replace(qual, f"[\\x{{{PHRED_OFFSET:x}}}-\\x{{{PHRED_OFFSET + least - 1:x}}}]+", ""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _masks(seq: Column) -> Column:
    """Each code as a character whose low four bits are the bases that it stands for; other characters have none."""
    return F.translate(F.regexp_replace(seq, f"[^{_CODES}]", "@"), "".join(IUPAC), "".join(chr(64 + bits) for bits in IUPAC.values()))


def mismatches(window: Column, start: Column, motif: Column, ambiguous: bool) -> Column:
    """Places at which ``motif``, laid over ``window`` from ``start``, differs; ``ambiguous`` takes both as ``_masks``."""
    def differs(i: Column) -> Column:
        a, b = F.substring(window, start + i - 1, F.lit(1)), F.substring(motif, i, F.lit(1))
        return F.ascii(a).bitwiseAND(F.ascii(b)).bitwiseAND(F.lit(15)) == 0 if ambiguous else a != b

    return F.size(F.filter(F.sequence(F.lit(1), F.length(motif)), differs))


#: Starts of a chunk and the motif's length must fit in one word.
_WORD, _LONGEST = 63, 48


def _planes(chunk: Column) -> Column:
    """Struct a, c, g, t: bit p - 1 is set where the code at place p stands for that base, places counted from 1."""
    bits = [F.translate(chunk, _CODES + "-", "".join("01"[IUPAC[c] >> k & 1] for c in _CODES) + "0") for k in range(4)]
    return F.struct(*(F.conv(F.reverse(F.concat(b, F.lit("0"))), 2, -10).cast("long").alias(n) for b, n in zip(bits, "acgt", strict=True)))


def _bit_match(window: Column, motif: Column, most: int) -> Column:
    """Leftmost start by bits, for all starts of a chunk at once.

    A word per motif place says at which starts it differs; ``most`` + 1 words
    gather where more than 0, 1, ... of them did.  The window is cut in chunks
    that overlap by the motif less one.
    """
    n = F.length(motif)
    starts = F.length(window) - n + 1
    step = F.lit(_WORD) - n
    none = F.lit(0).cast("long")

    def search(x: Column) -> Column:
        def differing(planes: Column) -> Column:
            def at(i: Column) -> Column:
                mask = F.ascii(F.substring(x["m"], i + 1, F.lit(1)))
                held = [F.when(mask.bitwiseAND(F.lit(1 << k)) != 0, planes[b]).otherwise(none) for k, b in enumerate("acgt")]
                return F.bitwise_not(F.call_function("shiftrightunsigned", held[0].bitwiseOR(held[1]).bitwiseOR(held[2]).bitwiseOR(held[3]), i))

            return F.transform(F.sequence(F.lit(0), n - 1), at)

        def chunk(k: Column) -> Column:
            text = F.substring(x["w"], k * step + 1, F.lit(_WORD - 1))
            more = F.aggregate(
                let(_planes(text), differing), F.struct(*(none.alias(f"g{e}") for e in range(most + 1))),
                lambda g, wrong: F.struct(*((g[f"g{e}"].bitwiseOR(g[f"g{e - 1}"].bitwiseAND(wrong) if e else wrong)).alias(f"g{e}") for e in range(most + 1))), lambda g: g[f"g{most}"])
            valid = F.call_function("shiftleft", F.lit(1).cast("long"), F.least(step, starts - k * step)) - 1
            return let(F.bitwise_not(more).bitwiseAND(valid), lambda ok: F.when(ok != 0, k * step + F.bit_count(ok.bitwiseAND(-ok) - 1) + 1))

        return F.get(F.filter(F.transform(F.sequence(F.lit(0), F.floor((starts - 1) / step).cast("int")), chunk), lambda p: p.isNotNull()), F.lit(0))

    clean = F.when(window.rlike(f"[^{_CODES}-]"), F.regexp_replace(window, f"[^{_CODES}]", "-")).otherwise(window)
    return let(F.struct(clean.alias("w"), _masks(motif).alias("m")), search)


def first_match(window: Column, motif: Column, most: int, ambiguous: bool = False, overhang: bool = False) -> Column:
    """Leftmost start of ``motif`` inside ``window`` with at most ``most`` substitutions; null if none.

    With ``ambiguous``, IUPAC codes on either side match what they share a base
    with; other characters match nothing.  With ``overhang`` as well, a match
    may pass the window's ends by up to ``most`` places, which count as
    substitutions; its start may then be below 1.
    With at most k substitutions one of k + 1 pieces of the motif is found as it
    stands, so windows that hold none of the pieces are left out at once (unless
    a code other than A, C, G, T makes pieces inexact).
    """
    if overhang:
        if not ambiguous:
            raise ValueError("overhang needs ambiguous")
        edge = F.lit("-" * most)
        return first_match(F.concat(edge, window, edge), motif, most, True) - most

    def search(x: Column) -> Column:
        w, m = x["w"], x["m"]
        n = F.length(m)
        part = F.ceil(n / (most + 1)).cast("int")
        seeded = n <= most
        for k in range(most + 1):
            piece = F.substring(m, k * part + 1, part)
            seeded = seeded | (F.length(piece) > 0) & F.contains(w, piece)
        if ambiguous:
            seeded = seeded | w.rlike("[^ACGT-]") | m.rlike("[^ACGT]")
        starts = F.sequence(F.lit(1), F.length(w) - n + 1)
        if ambiguous:
            slow = let(F.struct(_masks(w).alias("w"), _masks(m).alias("m")), lambda y: F.get(F.filter(starts, lambda p: mismatches(y["w"], p, y["m"], True) <= most), F.lit(0)))
            hit = F.when(n > _LONGEST, slow).otherwise(_bit_match(w, m, most))
        else:
            hit = F.get(F.filter(starts, lambda p: mismatches(w, p, m, False) <= most), F.lit(0))
        return F.when((n > 0) & (F.length(w) >= n) & seeded, hit)

    return let(F.struct(window.alias("w"), motif.alias("m")), search)


def hamming(a: Column, b: Column) -> Column:
    """Places at which strings of one width differ; null for different widths."""
    return F.when(F.length(a) == F.length(b), F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d)))


def differences(a: Column, b: Column) -> Column:
    """Columns that differ where both are of one width, else the edit distance of the sequences without gaps."""
    bare = [F.replace(x, F.lit("-"), F.lit("")) for x in (a, b)]
    return F.when(F.length(a) == F.length(b), hamming(a, b)).otherwise(F.levenshtein(*bare))
