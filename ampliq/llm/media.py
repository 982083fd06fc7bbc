"""Media columns: AVI motion-JPEG.

Bytes become 8-bit grey samples, 64 to a row, in lossless JPEG frames (process
14: prediction from the left and Huffman-coded differences) inside a RIFF/AVI
file with an index.  Each row is a restart interval, so all rows of many frames
are decoded together, one sample of each row per step.

Files of others are read too, if their frames are such JPEGs (of one component of
8 bits, predicted from the left, of any size, Huffman table and restart interval)
or baseline JPEGs, as motion-JPEG usually is: of these the brightness is decoded.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ampliq.llm import baseline_jpeg

#: Samples in a row, rows in a frame, frames in a second.
WIDTH, HEIGHT, FPS = 64, 16, 25
#: A shot ends where the histogram difference passes mean + SIGMAS deviations of the last WINDOW ones, and FLOOR at least.
BINS, WINDOW, SIGMAS, FLOOR = 32, 8, 3.0, 0.25
#: Bytes handled together.
GROUP = 1 << 20


def _header(rows: int) -> bytes:
    """JPEG markers before the coded rows: one component of 8 bits, nine difference categories with codes of four bits."""
    huffman = bytes([0, 0, 0, 9, *[0] * 12, *range(9)])
    return (b"\xff\xd8" + b"\xff\xc4" + struct.pack(">HB", 3 + len(huffman), 0) + huffman + b"\xff\xc3" + struct.pack(">HBHHB", 11, 8, rows, WIDTH, 1) + bytes([1, 0x11, 0])
            + b"\xff\xdd" + struct.pack(">HH", 4, WIDTH) + b"\xff\xda" + struct.pack(">HB", 8, 1) + bytes([1, 0, 1, 0, 0]))


HEADER = _header(HEIGHT)
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def _code_tables() -> tuple[np.ndarray, np.ndarray]:
    """(code, bits) by difference + 255 for the table of ``_header``."""
    diff = np.arange(-255, 256)
    cat = np.array([int(abs(d)).bit_length() for d in diff])
    code = (cat << cat) | np.where(diff < 0, diff + (1 << cat) - 1, diff)
    return code.astype(np.int64), cat.astype(np.int64) + 4


CODE, BITS = _code_tables()


def encode_rows(samples: np.ndarray) -> list[bytes]:
    """Coded bytes of each row of a (rows, WIDTH) uint8 matrix, padded with ones and stuffed, without markers."""
    diff = samples.astype(np.int16)
    diff[:, 1:] -= samples[:, :-1]
    diff[:, 0] -= 128
    diff += 255
    value, bits = CODE[diff], BITS[diff]
    for _ in range(2):  # codes of four samples, up to 48 bits, become one number
        value = (value[:, ::2] << bits[:, 1::2]) | value[:, 1::2]
        bits = bits[:, ::2] + bits[:, 1::2]
    ends = np.cumsum(bits, 1)
    sizes = (ends[:, -1] + 7) // 8
    base = np.concatenate(([0], np.cumsum(sizes)))
    start = ends - bits + 8 * base[:-1, None]
    lanes = (value << (64 - bits - (start & 7))).astype(">i8").view(np.uint8).reshape(-1, 8)
    byte = (start >> 3).ravel()
    packed = np.zeros(int(base[-1]) + 8, np.uint8)
    for k in range(7):  # numbers start two bytes apart at least, so none meet within a lane
        packed[byte + k] |= lanes[:, k]
    spare = 8 * sizes - ends[:, -1]
    packed[base[1:] - 1] |= ((1 << spare) - 1).astype(np.uint8)
    raw = packed[: base[-1]]
    full = np.flatnonzero(raw == 255)
    cuts = (base + np.searchsorted(full, base)).tolist()
    data = np.insert(raw, full + 1, 0).tobytes()
    return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


@dataclass(frozen=True)
class Coding:
    """What the markers of a frame say: size, samples in a restart interval, and the Huffman table (codes by length, their categories)."""

    width: int
    height: int
    interval: int
    lengths: bytes
    categories: bytes


class OtherProcess(ValueError):
    """The frame isn't lossless JPEG."""


def read_frame(frame: bytes) -> tuple[Coding, list[bytes]]:
    """(coding, the coded bytes of each restart interval) of a JPEG frame; ValueError where it is of another process."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("no JPEG frame")
    at, size, interval, table = 2, None, 0, None
    while True:
        if at + 4 > len(frame) or frame[at] != 0xFF:
            raise ValueError("a marker is missing")
        kind, n = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + n]
        at += 2 + n
        if kind == 0xC4:
            if body[0] & 0xF0 or len(body) > 17 + sum(body[1:17]):
                raise OtherProcess("tables for another process")
            table = body[1:17], body[17 : 17 + sum(body[1:17])]
        elif kind == 0xC3:
            bits, height, width, parts = struct.unpack_from(">BHHB", body)
            if bits != 8 or parts != 1:
                raise ValueError("more than one component of 8 bits")
            size = width, height
        elif 0xC0 <= kind <= 0xCF and kind != 0xC8:
            raise OtherProcess("a JPEG process that isn't lossless Huffman coding")
        elif kind == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif kind == 0xDA:
            if body[3:6] != b"\x01\x00\x00":
                raise ValueError("another predictor than the left one")
            break
    if size is None or table is None:
        raise ValueError("no size or no table")
    end = frame.rfind(b"\xff\xd9")
    return Coding(*size, interval or size[0] * size[1], *table), _RESTART.split(frame[at : end if end >= 0 else len(frame)])


@cache
def _decoding(lengths: bytes, categories: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(category, bits of its code) by the next 16 bits."""
    category, bits = np.zeros(1 << 16, np.int64), np.full(1 << 16, 16, np.int64)
    code = k = 0
    for n, many in enumerate(lengths, 1):
        for _ in range(many):
            first = code << (16 - n)
            category[first : first + (1 << (16 - n))] = categories[k]
            bits[first : first + (1 << (16 - n))] = n
            code, k = code + 1, k + 1
        code <<= 1
    return category, bits


@cache
def _steps(lengths: bytes, categories: bytes) -> tuple[np.ndarray, np.ndarray, int] | None:
    """(difference, bits with its code, width) by the next ``width`` bits, where 16 bits hold every code with its difference."""
    category, bits = _decoding(lengths, categories)
    longest = max((n + c for n, c in _codes(lengths, categories)), default=0)
    if longest > 16:
        return None
    word = np.arange(1 << longest) << (16 - longest)
    cat, used = category[word], bits[word]
    return _difference((word >> np.maximum(16 - used - cat, 0)) & ((1 << cat) - 1), cat).astype(np.int32), np.minimum(used + cat, longest).astype(np.int32), longest


def _codes(lengths: bytes, categories: bytes) -> list[tuple[int, int]]:
    return list(zip([n for n, many in enumerate(lengths, 1) for _ in range(many)], categories, strict=True))


def _difference(extra: np.ndarray, cat: np.ndarray) -> np.ndarray:
    """The difference of a category by the bits after its code."""
    return np.where((cat > 0) & (extra < (1 << np.maximum(cat - 1, 0))), extra - (1 << cat) + 1, extra)


def decode_intervals(coding: Coding, parts: list[bytes], samples: int) -> np.ndarray:
    """The first ``samples`` differences of coded intervals; every step decodes one of each interval."""
    raw = np.frombuffer(b"".join(parts), np.uint8)
    stuffed = np.flatnonzero((raw[1:] == 0) & (raw[:-1] == 255)) + 1
    ends = np.cumsum(np.array([len(r) for r in parts]))
    first = np.concatenate(([0], ends[:-1]))
    data = np.concatenate((np.delete(raw, stuffed), np.zeros(8, np.uint8)))
    bit = (8 * (first - np.searchsorted(stuffed, first))).astype(np.int64)
    out = np.empty((samples, len(parts)), np.int32)
    table = _steps(coding.lengths, coding.categories)
    if table:
        step, size, width = table
        data = data.astype(np.int32)
        three = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
        for k in range(samples):
            word = (three[bit >> 3] >> (24 - width - (bit & 7))) & ((1 << width) - 1)
            out[k] = step[word]
            bit += size[word]
        return out.T
    category, bits = _decoding(coding.lengths, coding.categories)
    data = data.astype(np.int64)
    five = (data[:-4] << 32) | (data[1:-3] << 24) | (data[2:-2] << 16) | (data[3:-1] << 8) | data[4:]
    for k in range(samples):
        window, shift = five[bit >> 3], bit & 7
        word = (window >> (24 - shift)) & 0xFFFF
        cat, used = category[word], bits[word]
        out[k] = _difference((window >> (40 - shift - used - cat)) & ((1 << cat) - 1), cat)
        bit += used + cat
    return out.T


def decode_frames(frames: list[bytes]) -> list[np.ndarray]:
    """The samples of each frame as a (height, width) matrix; lossless frames of one coding are decoded together, others as baseline JPEG."""
    read, others = [], {}
    for k, frame in enumerate(frames):
        try:
            read.append(read_frame(frame))
        except OtherProcess:
            others[k] = baseline_jpeg.decode(frame)
    if others:
        plain = iter(decode_frames([f for k, f in enumerate(frames) if k not in others]))
        return [others[k] if k in others else next(plain) for k in range(len(frames))]
    groups: dict[tuple[Coding, int], list[tuple[int, int]]] = {}
    for k, (coding, parts) in enumerate(read):
        whole = coding.width * coding.height
        for j in range(-(-whole // coding.interval)):
            groups.setdefault((coding, min(coding.interval, whole - j * coding.interval)), []).append((k, j))
    out = [np.empty(c.width * c.height, np.uint8) for c, _ in read]
    for (coding, samples), places in groups.items():
        if samples % coding.width:
            raise ValueError("a restart interval that isn't of whole rows")
        diff = decode_intervals(coding, [read[k][1][j] for k, j in places], samples).reshape(len(places), -1, coding.width)
        diff[:, :, 0] = np.cumsum(diff[:, :, 0], 1) + 128  # a row's first sample is predicted from the one above
        values = np.cumsum(diff, 2, dtype=np.int32).astype(np.uint8).reshape(len(places), -1)
        for (k, j), own in zip(places, values, strict=True):
            out[k][j * coding.interval : j * coding.interval + samples] = own
    return [x.reshape(c.height, c.width) for x, (c, _) in zip(out, read, strict=True)]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def build_avi(frames: list[bytes], payload: int) -> bytes:
    """A RIFF/AVI file of JPEG frames with an idx1 index; a ``plen`` chunk has the bytes before the last frame's padding."""
    most = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 24, b"MJPG", WIDTH * HEIGHT * 3, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    body, index, at = [b"movi"], [], 4
    for frame in frames:
        body.append(_chunk(b"00dc", frame))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        at += len(body[-1])
    return _chunk(b"RIFF", b"AVI " + hdrl + _chunk(b"plen", struct.pack("<Q", payload)) + _chunk(b"LIST", b"".join(body)) + _chunk(b"idx1", b"".join(index)))


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, size) of the chunks between two offsets; a size beyond the end is cut."""
    while at + 8 <= end:
        size = min(struct.unpack_from("<I", data, at + 4)[0], end - at - 8)
        yield data[at : at + 4], at + 8, size
        at += 8 + size + (size & 1)


def parse_avi(data: bytes) -> tuple[list[bytes], int | None, float]:
    """(frames of the first video stream, payload bytes if the file says so, frames a second); ValueError where there is none.

    Frames are found by the index (idx1), whose offsets count from the movi
    list or from the file's start, or where there is none by going through movi.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no RIFF/AVI file")
    movi, index, payload, rate = None, None, None, float(FPS)
    for name, at, size in _chunks(data, 12, len(data)):
        if name == b"LIST" and data[at : at + 4] == b"hdrl":
            for inner, strl, long in _chunks(data, at + 4, at + size):
                if inner == b"LIST" and data[strl : strl + 4] == b"strl":
                    for kind, body, _ in _chunks(data, strl + 4, strl + long):
                        if kind == b"strh" and data[body : body + 4] == b"vids":
                            scale, per = struct.unpack_from("<II", data, body + 20)
                            rate = per / scale if per and scale else rate
        elif name == b"LIST" and data[at : at + 4] == b"movi":
            movi = at, size
        elif name == b"idx1":
            index = data[at : at + size]
        elif name == b"plen":
            payload = struct.unpack_from("<Q", data, at)[0]
    if movi is None:
        raise ValueError("no frames")
    is_frame = lambda name: name[2:] in (b"dc", b"db")
    if not index:
        return [data[a : a + n] for name, a, n in _chunks(data, movi[0] + 4, sum(movi)) if is_frame(name) and n], payload, rate
    frames, base = [], None
    for entry in np.frombuffer(index[: len(index) // 16 * 16], np.dtype([("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")])):
        at, size = int(entry["at"]), int(entry["size"])
        if base is None:
            base = movi[0] if data[movi[0] + at : movi[0] + at + 4] == bytes(entry["id"]) else 0
        if is_frame(bytes(entry["id"])) and size:
            frames.append(data[base + at + 8 : base + at + 8 + size])
    return frames, payload, rate


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """One AVI file for each payload (multiples of WIDTH bytes)."""
    block = WIDTH * HEIGHT
    rows = encode_rows(np.frombuffer(b"".join(p + b"\0" * (-len(p) % block) for p in payloads), np.uint8).reshape(-1, WIDTH))
    out, at = [], 0
    for p in payloads:
        frames = []
        for _ in range(-(-len(p) // block)):
            coded = [HEADER]
            for k, row in enumerate(rows[at : at + HEIGHT]):
                coded += [row, bytes([0xFF, 0xD0 + k % 8])]
            coded[-1] = b"\xff\xd9"
            frames.append(b"".join(coded))
            at += HEIGHT
        out.append(build_avi(frames, len(p)))
    return out


def decode_files(files: list[bytes]) -> list[tuple[bytes, np.ndarray, float]]:
    """(payload, frames as (n, samples), rate) of each file; ValueError where frames of one file differ in size."""
    parsed = [parse_avi(f) for f in files]
    samples = iter(decode_frames([frame for frames, _, _ in parsed for frame in frames]))
    out = []
    for frames, payload, rate in parsed:
        own = [next(samples).ravel() for _ in frames]
        if len({len(x) for x in own}) > 1:
            raise ValueError("frames of several sizes")
        matrix = np.stack(own) if own else np.empty((0, 0), np.uint8)
        out.append((matrix.tobytes()[:payload], matrix, rate))
    return out


def shots(frames: np.ndarray) -> list[tuple[int, int]]:
    """(first frame, frames) of each shot, by adaptive differences of grey histograms."""
    n = len(frames)
    if not n:
        return []
    cells = (frames.astype(np.int64) * BINS >> 8) + BINS * np.arange(n)[:, None]
    histogram = np.bincount(cells.ravel(), minlength=n * BINS).reshape(n, BINS)
    diff = np.abs(np.diff(histogram, axis=0)).sum(1) / (2 * frames.shape[1])
    sums, squares = np.concatenate(([0], np.cumsum(diff))), np.concatenate(([0], np.cumsum(diff * diff)))
    at = np.arange(len(diff))
    low = np.maximum(at - WINDOW, 0)
    seen = np.maximum(at - low, 1)
    mean = (sums[at] - sums[low]) / seen
    spread = np.sqrt(np.maximum((squares[at] - squares[low]) / seen - mean * mean, 0))
    cuts = np.flatnonzero((diff > mean + SIGMAS * spread) & (diff > FLOOR)) + 1
    edges = [0, *cuts.tolist(), n]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def media_table(docs: DataFrame, with_media: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every whole text as an AVI file, read it back and describe it.

    Columns: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature, clips (array of timed clips: clip,
    first_frame, frames, start_s, end_s, mean) and, ``with_media``, the file.
    Null and empty texts become one row of zero bytes.  Repeated rows stay;
    other columns are ignored; an empty table gives an empty result.  No
    shuffle; a task holds about GROUP bytes of texts, or one text if longer.
    """
    clip = "struct<clip: int, first_frame: int, frames: int, start_s: double, end_s: double, mean: double>"
    schema = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips array<{clip}>" + ", media binary" * with_media

    def groups(bodies: list[bytes]) -> Iterator[list[bytes]]:
        part: list[bytes] = []
        size = 0
        for body in bodies:
            part.append(body)
            size += len(body) + WIDTH * HEIGHT
            if size >= GROUP:
                yield part
                part, size = [], 0
        if part:
            yield part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for bodies in groups([b or b"" for b in batch.column(1).cast(pa.binary()).to_pylist()]):
                keys = batch.column(0).slice(at, len(bodies))
                at += len(bodies)
                files = encode_payloads([b + b"\0" * (-len(b) % WIDTH or (0 if b else WIDTH)) for b in bodies])
                rows = []
                for body, media, (payload, frames, rate) in zip(bodies, files, decode_files(files), strict=True):
                    found = _clips(frames, rate)
                    rows.append((len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(),
                                 f"frames={len(frames)};shots={len(found)};mean={frames.mean():.3f};longest={max(c['frames'] for c in found)}",
                                 found, media))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("frames", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("mean", pa.float64())])), pa.binary()]
                arrays = [keys.cast(pa.int64()), *(pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True))]
                names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips", "media"]
                yield pa.RecordBatch.from_arrays(arrays[: 9 + with_media], names[: 9 + with_media])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, schema)


def _clips(frames: np.ndarray, rate: float) -> list[dict]:
    return [{"clip": k, "first_frame": a, "frames": n, "start_s": a / rate, "end_s": (a + n) / rate, "mean": round(float(frames[a : a + n].mean()), 3)} for k, (a, n) in enumerate(shots(frames))]


def clip_rows(files: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """One row per timed clip of a column of AVI files: key, clip, first_frame, frames, start_s, end_s, mean and error.

    A file that can't be read has one row with null clip and the reason as its
    error, as has a null; a file without frames has no row.  Repeated rows stay;
    other columns are ignored; an empty table gives an empty result.
    """
    names = ["clip", "first_frame", "frames", "start_s", "end_s", "mean", "error"]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for k, body in enumerate(batch.column(1)):
                try:
                    _, frames, rate = decode_files([body.as_py() or b""])[0]
                    found = [(*c.values(), None) for c in _clips(frames, rate)]
                except (ValueError, IndexError, struct.error) as error:
                    found = [(*[None] * 6, str(error))]
                at += [k] * len(found)
                rows += found
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True))], ["key", *names])

    plain = files.select(files[key].alias("key"), files[media].alias("media"))
    return plain.mapInArrow(run, f"key {plain.schema['key'].dataType.simpleString()}, clip int, first_frame int, frames int, start_s double, end_s double, mean double, error string").withColumnRenamed("key", key)
