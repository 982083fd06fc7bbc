"""Grey frames of baseline JPEG (sequential DCT, Huffman-coded, 8 bits), as motion-JPEG files of cameras and encoders have them.

All components are read, since their blocks alternate; the first one, the
brightness, is dequantised and transformed.  Frames without Huffman tables get
the standard ones, as is usual in AVI files.
"""

from __future__ import annotations

import re
import struct
from functools import cache

import numpy as np

#: The order of coefficients, and the standard Huffman tables as numbers of codes by length and first symbols; the other symbols follow in ascending order.
ZIGZAG = np.array([0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63])
STANDARD = {
    (0, 0): ("00010501010101010100000000000000", ""),
    (0, 1): ("00030101010101010101010000000000", ""),
    (1, 0): ("0002010303020403050504040000017d", "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282"),
    (1, 1): ("00020102040403040705040400010277", "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f1"),
}
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")
_DCT = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def standard_table(kind: int, which: int) -> tuple[bytes, bytes]:
    """(codes by length, symbols) of the standard table of DC (0) or AC (1) coefficients, of brightness (0) or colour (1)."""
    lengths, first = (bytes.fromhex(x) for x in STANDARD[kind, which])
    every = range(12) if kind == 0 else sorted([0, 0xF0, *(16 * run + size for run in range(16) for size in range(1, 11))])
    return lengths, first + bytes(s for s in every if s not in first)


@cache
def _lookup(lengths: bytes, symbols: bytes) -> tuple[list[int], list[int]]:
    """(symbol, bits of its code) by the next 16 bits; bits are 0 where no code fits."""
    symbol, bits, code, k = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0, 0
    for n, many in enumerate(lengths, 1):
        for _ in range(many):
            first = code << (16 - n)
            symbol[first : first + (1 << (16 - n))], bits[first : first + (1 << (16 - n))] = symbols[k], n
            code, k = code + 1, k + 1
        code <<= 1
    return symbol.tolist(), bits.tolist()


def _markers(frame: bytes) -> tuple[dict, int]:
    """(what the markers say, where the coded bytes begin)."""
    at, said = 2, {"quantise": {}, "huffman": {k: standard_table(*k) for k in STANDARD}, "interval": 0, "parts": None}
    while True:
        if at + 4 > len(frame) or frame[at] != 0xFF:
            raise ValueError("a marker is missing")
        if frame[at + 1] == 0xFF:  # markers may be filled up
            at += 1
            continue
        kind, n = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + n]
        at += 2 + n
        if kind == 0xDB:
            while body:
                wide, name = body[0] >> 4, body[0] & 15
                said["quantise"][name] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                body = body[65 + 64 * wide :]
        elif kind == 0xC4:
            while body:
                many = sum(body[1:17])
                said["huffman"][body[0] >> 4, body[0] & 15] = body[1:17], body[17 : 17 + many]
                body = body[17 + many :]
        elif kind in (0xC0, 0xC1):
            bits, height, width, parts = struct.unpack_from(">BHHB", body)
            if bits != 8:
                raise ValueError("samples of more than 8 bits")
            said |= {"height": height, "width": width, "parts": {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(parts)}}
        elif 0xC2 <= kind <= 0xCF and kind != 0xC8:
            raise ValueError("a JPEG process that is neither lossless nor baseline")
        elif kind == 0xDD:
            said["interval"] = struct.unpack(">H", body)[0]
        elif kind == 0xDA:
            if not said["parts"]:
                raise ValueError("no size")
            said["scan"] = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
            return said, at


def _read_interval(coded: bytes, mcus: int, plan: list[tuple[int, int, tuple, tuple]], keep: int, out: np.ndarray, at: int) -> int:
    """Coefficients of the blocks of component ``keep``, written to ``out`` from ``at`` on; returns the place after them.

    ``plan`` has (component, blocks in an MCU, DC table, AC table) of each component of the scan.
    """
    raw = np.frombuffer(coded.replace(b"\xff\x00", b"\xff") + bytes(8), np.uint8).astype(np.int64)
    word = ((raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]).tolist()
    pos, end, before = 0, 8 * (len(raw) - 8), dict.fromkeys((c for c, *_ in plan), 0)

    def code(table: tuple[list[int], list[int]]) -> int:
        nonlocal pos
        next16 = word[pos >> 3] >> (16 - (pos & 7)) & 0xFFFF
        n = table[1][next16]
        if not n or pos > end:
            raise ValueError("a frame's coded bytes end early or are damaged")
        pos += n
        return table[0][next16]

    def number(n: int) -> int:
        nonlocal pos
        if not n:
            return 0
        value = word[pos >> 3] >> (32 - (pos & 7) - n) & ((1 << n) - 1)
        pos += n
        return value if value >> (n - 1) else value - (1 << n) + 1

    for _ in range(mcus):
        for part, blocks, dc, ac in plan:
            for _ in range(blocks):
                before[part] += number(code(dc))
                own = part == keep
                if own:
                    out[at, 0] = before[part]
                k = 1
                while k < 64:
                    s = code(ac)
                    if not s & 15:
                        if s != 0xF0:
                            break
                        k += 16
                        continue
                    k += s >> 4
                    value = number(s & 15)
                    if k > 63:
                        raise ValueError("a frame's coded bytes are damaged")
                    if own:
                        out[at, k] = value
                    k += 1
                at += own
    return at


def decode(frame: bytes) -> np.ndarray:
    """The first component of a baseline JPEG as a (height, width) uint8 matrix; ValueError where the frame is of another kind or damaged."""
    said, start = _markers(frame)
    parts, scan = said["parts"], said["scan"]
    keep = next(iter(parts))
    if {c for c, _, _ in scan} != set(parts):
        raise ValueError("components in scans of their own")
    across, down = max(h for h, _, _ in parts.values()), max(v for _, v, _ in parts.values())
    h, v, table = parts[keep]
    if len(parts) == 1:  # blocks of a single component are in the order of rows
        across = down = h = v = 1
    wide, high = -(-said["width"] // (8 * across)), -(-said["height"] // (8 * down))
    try:
        plan = [(c, 1 if len(parts) == 1 else parts[c][0] * parts[c][1], _lookup(*said["huffman"][0, dc]), _lookup(*said["huffman"][1, ac])) for c, dc, ac in scan]
        quantise = said["quantise"][table]
    except KeyError as error:
        raise ValueError(f"table {error} is missing") from None
    last = frame.rfind(b"\xff\xd9")
    intervals = _RESTART.split(frame[start : last if last >= start else len(frame)])
    coefficients, at, left = np.zeros((wide * high * h * v, 64), np.int64), 0, wide * high
    for coded in intervals:
        mcus = min(said["interval"] or left, left)
        at = _read_interval(coded, mcus, plan, keep, coefficients, at)
        left -= mcus
    if left:
        raise ValueError("a frame's restart intervals are missing")
    blocks = np.zeros((len(coefficients), 64))
    blocks[:, ZIGZAG] = coefficients * quantise
    samples = np.rint(_DCT.T @ blocks.reshape(-1, 8, 8) @ _DCT + 128).clip(0, 255).astype(np.uint8)
    grid = samples.reshape(high, wide, v, h, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(high * v * 8, wide * h * 8)
    return grid[: -(-said["height"] * v // down), : -(-said["width"] * h // across)]
