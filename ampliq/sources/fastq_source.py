"""FASTQ as a data source of its own: ``spark.read.format("fastq")`` and ``df.write.format("fastq")``.

A file's byte ranges are tasks, and each finds the first record of its range
by itself, so nothing is numbered or shuffled.  Block-gzipped files (gzip
members of at most 64 KB that say how long they are) are cut at their blocks;
other gzipped files are one task each.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import islice
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FIELDS = ("file", "read_id", "seq", "qual")
#: Bytes of a task's range, records of a batch, bytes read and packed together.
SPLIT, BATCH, CHUNK, PACKED = 128 << 20, 8192, 1 << 20, 65280
#: Fixed values of the block gzip format: how a member begins, and the empty one at a file's end.
_MAGIC = b"\x1f\x8b\x08\x04"
_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """A file system and the path in it, of a URI or a local path."""
    return pafs.FileSystem.from_uri(path if "://" in path else path.removeprefix("file:")) if "://" in path or path.startswith(("/", "file:/")) else (pafs.LocalFileSystem(), path)


def block_size(head: bytes) -> int | None:
    """Bytes of the gzip member that begins with ``head``, if it says so as block gzip does."""
    if len(head) < 18 or head[:4] != _MAGIC:
        return None
    extra, at = head[12 : 12 + int.from_bytes(head[10:12], "little")], 0
    while at + 4 <= len(extra):
        size = int.from_bytes(extra[at + 2 : at + 4], "little")
        if extra[at : at + 2] == b"BC" and size == 2:
            return int.from_bytes(extra[at + 4 : at + 6], "little") + 1
        at += 4 + size
    return None


def pack(data: bytes) -> bytes:
    """``data`` as one member of block gzip."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    head = _MAGIC + b"\0\0\0\0\0\xff" + (6).to_bytes(2, "little") + b"BC" + (2).to_bytes(2, "little") + (len(body) + 25).to_bytes(2, "little")
    return head + body + zlib.crc32(data).to_bytes(4, "little") + len(data).to_bytes(4, "little")


def first_block(f: BinaryIO, start: int, size: int) -> int:
    """Where the first block from ``start`` on begins: its head must say where the next one begins, which must hold."""
    at = start
    while at < size:
        f.seek(at)
        part = f.read(CHUNK)
        k = part.find(_MAGIC)
        while k >= 0:
            f.seek(at + k)
            n = block_size(f.read(1024))
            if n:
                f.seek(at + k + n)
                if at + k + n == size or block_size(f.read(1024)):
                    return at + k
            k = part.find(_MAGIC, k + 1)
        at += max(len(part) - len(_MAGIC) + 1, 1)
    return size


def _pieces(f: BinaryIO, kind: str, start: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(place, text) of what follows ``start``; places of block gzip are those of a block, times 65536, and of a byte in it."""
    if kind == "bgzf":
        at = start
        while at < size:
            f.seek(at)
            n = block_size(f.read(1024))
            if not n:
                raise ValueError(f"no gzip block at byte {at}")
            f.seek(at)
            yield at << 16, zlib.decompressobj(31).decompress(f.read(n))
            at += n
        return
    f.seek(start)
    at, unpack = start, zlib.decompressobj(31) if kind == "gzip" else None
    while data := f.read(CHUNK):
        while data and unpack:
            text = unpack.decompress(data)
            yield at, text
            at += len(text)
            data = unpack.unused_data
            if unpack.eof:
                unpack = zlib.decompressobj(31)  # members may follow one another
        if not unpack:
            yield at, data
            at += len(data)


def _lines(pieces: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """(place, line) without line ends."""
    held, place = b"", 0
    for at, text in pieces:
        begin = 0
        while (end := text.find(b"\n", begin)) >= 0:
            yield (place if held else at + begin), (held + text[begin:end]).removesuffix(b"\r")
            held, begin = b"", end + 1
        if begin < len(text):
            place = place if held else at + begin
            held += text[begin:]
    if held:
        yield place, held.removesuffix(b"\r")


def records(lines: Iterator[tuple[int, bytes]], resume: bool, last: int | None) -> Iterator[tuple[bytes, bytes, bytes]]:
    """(head, seq, qual) of records that begin at or before ``last`` (None: of all).

    With ``resume`` the first line is left to the range before, and lines are
    passed over up to one that begins with @ and is followed by one that begins
    with + two lines on: a line of qualities isn't, as a sequence has no +.
    """
    if resume:
        next(lines, None)
    held = list(islice(lines, 4))
    while len(held) == 4:
        if last is not None and held[0][0] > last:
            return
        if held[0][1][:1] == b"@" and held[2][1][:1] == b"+":
            yield held[0][1], held[1][1], held[3][1]
            held = list(islice(lines, 4))
        else:
            held = [*held[1:], *islice(lines, 1)]


class Range(InputPartition):
    def __init__(self, path: str, kind: str, start: int, end: int, size: int) -> None:
        self.path, self.kind, self.start, self.end, self.size = path, kind, start, end, size


class FastqReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.names, self.path, self.split = schema.names, options["path"], int(options.get("splitbytes", SPLIT))

    def partitions(self) -> list[InputPartition]:
        fs, top = _open(self.path)
        found = fs.get_file_info(top)
        files = [found] if found.is_file else fs.get_file_info(pafs.FileSelector(top, recursive=True))
        out = []
        for info in sorted((i for i in files if i.is_file and not any(p[:1] in "._" for p in info_parts(i.path, top))), key=lambda i: i.path):
            with fs.open_input_file(info.path) as f:
                head = f.read(1024)
            kind = "bgzf" if block_size(head) else "gzip" if head[:2] == b"\x1f\x8b" else "plain"
            step = self.split if kind != "gzip" else max(info.size, 1)
            out += [Range(info.path, kind, at, min(at + step, info.size), info.size) for at in range(0, info.size, step)]
        return out or [Range("", "plain", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.size:
            return
        fs, _ = _open(self.path)
        with fs.open_input_file(partition.path) as f:
            start, last = partition.start, partition.end if partition.end < partition.size else None
            if partition.kind == "bgzf":
                start = first_block(f, start, partition.size)
                last = last and first_block(f, last, partition.size) << 16
            rows = records(_lines(_pieces(f, partition.kind, start, partition.size)), partition.start > 0, last)
            wanted = {"read_id": lambda r: r[0][1:].split(None, 1)[0] if r[0][1:].strip() else b"", "seq": lambda r: r[1], "qual": lambda r: r[2], "file": lambda _: partition.path.encode()}
            while batch := list(islice(rows, BATCH)):
                yield pa.RecordBatch.from_arrays([pa.array([wanted[n](r) for r in batch], pa.binary()).cast(pa.string()) for n in self.names], self.names)


def info_parts(path: str, top: str) -> list[str]:
    return [p for p in path.removeprefix(top).split("/") if p] or [path.rsplit("/", 1)[-1]]


class Written(WriterCommitMessage):
    def __init__(self, name: str | None) -> None:
        self.name = name


class FastqWriter(DataSourceArrowWriter):
    """Each task writes to a folder of the job; commit moves what tasks that succeeded have written, and both ends delete the folder."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.packed, self.overwrite, self.job = options["path"], options.get("compression", "none") == "bgzf", overwrite, f"_job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, top = _open(self.path)
        name, held, at = f"part-{uuid.uuid4().hex}.fastq" + ".gz" * self.packed, [], 0
        fs.create_dir(f"{top}/{self.job}", recursive=True)
        rows = 0
        with fs.open_output_stream(f"{top}/{self.job}/{name}", compression=None) as out:
            def put(end: bool) -> None:
                nonlocal held, at
                data = b"".join(held)
                full = len(data) if end or not self.packed else len(data) // PACKED * PACKED
                if self.packed:
                    for k in range(0, full, PACKED):
                        out.write(pack(data[k : min(k + PACKED, full)]))
                else:
                    out.write(data)
                held, at = [data[full:]], len(data) - full

            for batch in iterator:
                fields = [[(v or "").encode() for v in batch.column(c).cast(pa.string()).to_pylist()] for c in FIELDS[1:]]
                for i, s, q in zip(*fields, strict=True):
                    held.append(b"@%b\n%b\n+\n%b\n" % (i, s, q))
                    at += len(held[-1])
                    rows += 1
                    if at > CHUNK:
                        put(False)
            put(True)
            if self.packed:
                out.write(_END)
        return Written(name if rows else None)

    def commit(self, messages: list[Written | None]) -> None:
        fs, top = _open(self.path)
        fs.create_dir(top, recursive=True)
        if self.overwrite:
            for info in fs.get_file_info(pafs.FileSelector(top)):
                if info.is_file:
                    fs.delete_file(info.path)
        for m in messages:
            if m and m.name:
                fs.move(f"{top}/{self.job}/{m.name}", f"{top}/{m.name}")
        self.abort([])

    def abort(self, messages: list[Written | None]) -> None:
        fs, top = _open(self.path)
        if fs.get_file_info(f"{top}/{self.job}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{top}/{self.job}")


class FastqSource(DataSource):
    """Columns file, read_id, seq, qual, or those of them that ``.schema(...)`` names: others aren't built.

    Options: splitBytes; for the writer compression (none, bgzf).  The path must
    be one that pyarrow opens from driver and executors: local or shared folders,
    hdfs, s3, gs.  What else Spark reads, ``sequences.read_fastq`` takes.
    """

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return ", ".join(f"{f} string" for f in FIELDS)

    def reader(self, schema: StructType) -> FastqReader:
        if unknown := set(schema.names) - set(FIELDS):
            raise ValueError(f"FASTQ has no {sorted(unknown)}")
        return FastqReader(schema, {k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: StructType, overwrite: bool) -> FastqWriter:
        if missing := set(FIELDS[1:]) - set(schema.names):
            raise ValueError(f"FASTQ needs {sorted(missing)}")
        return FastqWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastqSource)
