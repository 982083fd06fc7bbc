"""Media: files of other makers, markers, clip times and digests."""

import random
import struct
import zlib

import numpy as np
import pytest

from ampliq.llm import media


def lossless_jpeg(image, interval_rows, lengths, categories):
    """A frame by the book, one code at a time: predicted from the left, rows' first samples from above."""
    codes, code, k = {}, 0, 0
    for n, many in enumerate(lengths, 1):
        for _ in range(many):
            codes[categories[k]] = format(code, f"0{n}b")
            code, k = code + 1, k + 1
        code <<= 1
    height, width = image.shape
    parts = []
    for top in range(0, height, interval_rows):
        bits = ""
        for y in range(top, min(height, top + interval_rows)):
            for x in range(width):
                before = int(image[y, x - 1]) if x else int(image[y - 1, 0]) if y > top else 128
                d = int(image[y, x]) - before
                cat = abs(d).bit_length()
                bits += codes[cat] + (format(d if d > 0 else d + (1 << cat) - 1, f"0{cat}b") if cat else "")
        bits += "1" * (-len(bits) % 8)
        parts.append(bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00"))
    body = parts[0] + b"".join(bytes([0xFF, 0xD0 + i % 8]) + p for i, p in enumerate(parts[1:]))
    dri = b"" if interval_rows >= height else b"\xff\xdd" + struct.pack(">HH", 4, interval_rows * width)
    table = bytes([0, *lengths, *categories])
    return (b"\xff\xd8\xff\xe0" + struct.pack(">H", 6) + b"JFIF" + b"\xff\xc3" + struct.pack(">HBHHB", 11, 8, height, width, 1) + bytes([1, 0x11, 0]) + b"\xff\xc4" + struct.pack(">H", 2 + len(table)) + table
            + dri + b"\xff\xda" + struct.pack(">HB", 8, 1) + bytes([1, 0, 1, 0, 0]) + body + b"\xff\xd9")


SHORT = ([0, 1, 3, 3, 1, 1] + [0] * 10, [3, 0, 1, 2, 4, 5, 6, 7, 8])
LONG = ([1] * 8 + [0] * 7 + [1], [0, 1, 2, 3, 4, 5, 6, 7, 8])  # the last code has 16 bits


@pytest.mark.parametrize("table", [SHORT, LONG])
@pytest.mark.parametrize("rows", [1, 3, 100])
def test_frames_of_other_sizes_tables_and_intervals(table, rows):
    rng = np.random.default_rng(3)
    images = [rng.integers(0, 256, (7, 13)).astype(np.uint8), np.zeros((9, 5), np.uint8), np.full((4, 4), 255, np.uint8), (np.arange(60).reshape(6, 10) * 4).astype(np.uint8)]
    for image, got in zip(images, media.decode_frames([lossless_jpeg(i, rows, *table) for i in images]), strict=True):
        assert (image == got).all()


def chunk(name, body):
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def avi(frames, index, offset=0, rate=(1, 10)):
    strh = b"vids" + b"MJPG" + bytes(12) + struct.pack("<II", *rate) + bytes(28)
    junk = chunk(b"JUNK", b"strh vids " + bytes(30))
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", bytes(56)) + junk + chunk(b"LIST", b"strl" + chunk(b"strh", b"auds" + bytes(52))) + chunk(b"LIST", b"strl" + chunk(b"strh", strh)))
    movi, entries = b"movi", b""
    start = 12 + len(hdrl) + 8
    for f in frames:
        entries += struct.pack("<4sIII", b"00dc", 16, len(movi) + (start if offset else 0), len(f))
        movi += chunk(b"00dc", f)
        entries += struct.pack("<4sIII", b"01wb", 16, len(movi) + (start if offset else 0), 3)
        movi += chunk(b"01wb", b"snd")
    return chunk(b"RIFF", b"AVI " + hdrl + chunk(b"LIST", movi) + (chunk(b"idx1", entries) if index else b""))


@pytest.mark.parametrize("index, offset", [(True, 0), (True, 1), (False, 0)])
def test_other_avi_files_have_timed_clips(spark, index, offset):
    dark, light = np.full((8, 16), 20, np.uint8), np.full((8, 16), 200, np.uint8)
    frames = [lossless_jpeg(i, 2, *SHORT) for i in [dark] * 5 + [light] * 15]
    body = avi(frames, index, offset)
    parsed, payload, rate = media.parse_avi(body)
    assert parsed == frames and payload is None and rate == 10
    df = spark.createDataFrame([(1, bytearray(body)), (2, bytearray(b"RIFFxxxxWAVE")), (3, None), (4, bytearray(b"")), (5, bytearray(avi([b"\xff\xd8\xff\xc0\x00\x04ab"], True)))], "doc_id long, media binary")
    rows = media.clip_rows(df).orderBy("doc_id", "clip").collect()
    assert [tuple(r) for r in rows[:2]] == [(1, 0, 0, 5, 0.0, 0.5, 20.0, None), (1, 1, 5, 15, 0.5, 2.0, 200.0, None)]
    assert [r["doc_id"] for r in rows[2:]] == [2, 3, 4, 5] and all(r["clip"] is None and r["error"] for r in rows[2:])
    assert media.clip_rows(df.limit(0)).count() == 0


def test_columns_of_the_table(spark):
    rng = random.Random(4)
    texts = [None, "", "a" * 64, "é" * 33, "".join(rng.choice("ab \n") for _ in range(30000)), "\x00\x7f" * 9000 + "~" * 20000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = media.media_table(df, with_media=True).collect()
    for r in table:
        body = (texts[r["doc_id"]] or "").encode()
        body += bytes(-len(body) % 64 or (0 if body else 64))
        assert (r["payload_bytes"], r["tail_crc32"]) == (len(body), zlib.crc32(body[-64:]))
        frames, payload, rate = media.parse_avi(bytes(r["media"]))
        assert payload == len(body) and rate == media.FPS
        whole = body + bytes(-len(body) % 1024)
        ends = [0, *(c["end_s"] for c in r["clips"])]
        assert [c["start_s"] for c in r["clips"]] == ends[:-1] and ends[-1] == len(frames) / media.FPS == len(whole) / 1024 / media.FPS
        for c in r["clips"]:
            part = whole[1024 * c["first_frame"] : 1024 * (c["first_frame"] + c["frames"])]
            assert c["mean"] == pytest.approx(sum(part) / len(part), abs=1e-3)
    clips = media.clip_rows(media.media_table(df, with_media=True))
    assert sorted(tuple(r)[:4] for r in clips.collect()) == sorted((r["doc_id"], c["clip"], c["first_frame"], c["frames"]) for r in table for c in r["clips"])


def test_shots_by_plain_python():
    rng = np.random.default_rng(5)
    frames = np.concatenate([rng.integers(low, low + 40, (n, 1024)) for low, n in ((0, 9), (120, 12), (60, 3), (200, 20))]).astype(np.uint8)
    def histogram(f):
        return [sum(1 for x in f.tolist() if x * media.BINS // 256 == b) for b in range(media.BINS)]
    h = [histogram(f) for f in frames]
    diff = [sum(abs(a - b) for a, b in zip(x, y, strict=True)) / 2048 for x, y in zip(h, h[1:], strict=False)]
    cuts = []
    for t, d in enumerate(diff):
        seen = diff[max(0, t - media.WINDOW) : t] or [0.0]
        mean = sum(seen) / len(seen)
        spread = max(0.0, sum(x * x for x in seen) / len(seen) - mean * mean) ** 0.5
        if d > mean + media.SIGMAS * spread and d > media.FLOOR:
            cuts.append(t + 1)
    edges = [0, *cuts, len(frames)]
    assert media.shots(frames) == [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    assert media.shots(frames[:0]) == []
