"""Baseline JPEG frames, coded by the book, and clips of AVI files made of them."""

import math
import struct

import numpy as np
import pytest
from test_media import SHORT, avi, lossless_jpeg

from ampliq.llm import baseline_jpeg, media


def codes(lengths, symbols):
    out, code, k = {}, 0, 0
    for n, many in enumerate(lengths, 1):
        for _ in range(many):
            out[symbols[k]] = format(code, f"0{n}b")
            code, k = code + 1, k + 1
        code <<= 1
    return out


def bits(value):
    n = abs(value).bit_length()
    return n, (format(value if value > 0 else value + (1 << n) - 1, f"0{n}b") if n else "")


def coded_block(block, before, dc, ac):
    n, more = bits(int(block[0]) - before)
    out, run = dc[n] + more, 0
    last = max((k for k in range(1, 64) if block[k]), default=0)
    for k in range(1, last + 1):
        if not block[k]:
            run += 1
            continue
        while run > 15:
            out, run = out + ac[0xF0], run - 16
        n, more = bits(int(block[k]))
        out, run = out + ac[16 * run + n] + more, 0
    return out + (ac[0] if last < 63 else "")


def jpeg(parts, width, height, quantise, interval=0, tables=None, filled=b""):
    """``parts``: (h, v, blocks by MCU) of each component, blocks of 64 coefficients in zigzag order."""
    known = {k: tables[k] if tables else baseline_jpeg.standard_table(*k) for k in baseline_jpeg.STANDARD}
    use = {k: codes(*v) for k, v in known.items()}
    mcus = len(parts[0][2])
    pieces = []
    for start in range(0, mcus, interval or mcus):
        text, before = "", [0] * len(parts)
        for m in range(start, min(mcus, start + (interval or mcus))):
            for c, (_, _, blocks) in enumerate(parts):
                for block in blocks[m]:
                    text += coded_block(block, before[c], use[0, min(c, 1)], use[1, min(c, 1)])
                    before[c] = int(block[0])
        text += "1" * (-len(text) % 8)
        pieces.append(bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8)).replace(b"\xff", b"\xff\x00"))
    segment = lambda kind, body: b"\xff" + bytes([kind]) + struct.pack(">H", len(body) + 2) + body
    out = b"\xff\xd8" + segment(0xE0, b"AVI1" + bytes(8)) + filled + segment(0xDB, b"".join(bytes([k, *quantise]) for k in (0, 1)))
    out += segment(0xC0, struct.pack(">BHHB", 8, height, width, len(parts)) + b"".join(bytes([c + 1, 16 * h + v, min(c, 1)]) for c, (h, v, _) in enumerate(parts)))
    if tables:
        out += segment(0xC4, b"".join(bytes([16 * k + w]) + bytes(n) + bytes(s) for (k, w), (n, s) in tables.items()))
    if interval:
        out += segment(0xDD, struct.pack(">H", interval))
    out += segment(0xDA, bytes([len(parts)]) + b"".join(bytes([c + 1, 17 * min(c, 1)]) for c in range(len(parts))) + bytes([0, 63, 0]))
    return out + pieces[0] + b"".join(bytes([0xFF, 0xD0 + i % 8]) + p for i, p in enumerate(pieces[1:])) + b"\xff\xd9"


def plain_samples(block, quantise):
    """One block by the formula of the inverse transform."""
    f = [0] * 64
    for k, place in enumerate(baseline_jpeg.ZIGZAG.tolist()):
        f[place] = int(block[k]) * quantise[k]
    c = lambda u: math.sqrt(0.5) if u == 0 else 1.0
    return [[sum(c(u) * c(v) * f[8 * v + u] * math.cos((2 * x + 1) * u * math.pi / 16) * math.cos((2 * y + 1) * v * math.pi / 16) for u in range(8) for v in range(8)) / 4 + 128 for x in range(8)] for y in range(8)]


def some_blocks(rng, mcus, blocks):
    out = np.zeros((mcus, blocks, 64), np.int64)
    out[..., 0] = rng.integers(-60, 60, (mcus, blocks))
    spots = rng.random(out.shape) < 0.08
    spots[..., 0] = False
    out[spots] = rng.integers(-30, 31, spots.sum())
    out[0, 0, 1:] = 0
    out[-1, -1, 63] = 5
    return out


OWN = {(0, 0): ([0, 0, 0, 12] + [0] * 12, range(12)), (0, 1): ([0, 0, 1, 11] + [0] * 12, range(12)), (1, 0): ([0] * 7 + [162] + [0] * 8, baseline_jpeg.standard_table(1, 0)[1]), (1, 1): ([0] * 8 + [162] + [0] * 7, baseline_jpeg.standard_table(1, 1)[1])}


@pytest.mark.parametrize("tables", [None, OWN])
@pytest.mark.parametrize("sampling", [[(1, 1)], [(2, 2)], [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
@pytest.mark.parametrize("interval", [0, 2])
def test_frames_are_decoded(tables, sampling, interval):
    rng, quantise = np.random.default_rng(len(sampling) + interval), [3 + k // 8 for k in range(64)]
    width, height = 37, 21
    single = len(sampling) == 1
    h, v = (1, 1) if single else sampling[0]
    wide, high = -(-width // (8 * h)), -(-height // (8 * v))
    parts = [(a, b, some_blocks(rng, wide * high, 1 if single else a * b)) for a, b in sampling]
    got = baseline_jpeg.decode(jpeg(parts, width, height, quantise, interval, tables, b"\xff" * 3))
    want = np.zeros((high * v * 8, wide * h * 8))
    for m, blocks in enumerate(parts[0][2]):
        for k, block in enumerate(blocks):
            y, x = (m // wide) * v + k // h, (m % wide) * h + k % h
            want[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] = plain_samples(block, quantise)
    assert got.shape == (height, width) and got.dtype == np.uint8
    assert (np.abs(got - want[:height, :width].clip(0, 255)) <= 0.5 + 1e-6).all()


def flat(level, width=40, height=24):
    blocks = np.zeros((-(-width // 16) * -(-height // 16), 6, 64), np.int64)
    blocks[:, :4, 0] = level
    return jpeg([(2, 2, blocks[:, :4]), (1, 1, blocks[:, 4:5]), (1, 1, blocks[:, 5:])], width, height, [8] * 64)


def test_clips_of_baseline_files(spark):
    dark, light = flat(-100), flat(80)
    body = avi([dark] * 6 + [light] * 14, True)
    broken, progressive = dark[: len(dark) - 6], dark.replace(b"\xff\xc0", b"\xff\xc2")
    df = spark.createDataFrame([(1, bytearray(body)), (2, bytearray(avi([broken], True))), (3, bytearray(avi([progressive], False))), (4, bytearray(avi([dark, lossless_jpeg(np.full((24, 40), 28, np.uint8), 24, *SHORT)], True)))], "doc_id long, media binary")
    rows = media.clip_rows(df).orderBy("doc_id", "clip").collect()
    assert [tuple(r) for r in rows[:2]] == [(1, 0, 0, 6, 0.0, 0.6, 28.0, None), (1, 1, 6, 14, 0.6, 2.0, 208.0, None)]
    assert [r.doc_id for r in rows[2:]] == [2, 3, 4] and rows[2].error and "neither" in rows[3].error and (rows[4].frames, rows[4].error) == (2, None)
