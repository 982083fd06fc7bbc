"""The FASTQ data source: ranges of plain and block-gzipped files, pruned columns, a writer that leaves nothing half done."""

import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from ampliq.sources import fastq_source


def reads(rng, n):
    sizes = [rng.choice([0, 1, 2, rng.randrange(3, 120)]) for _ in range(n)]
    return [(f"r{k}", "".join(rng.choices("ACGTN", k=s)), "".join(rng.choices("@+#IJ", k=s))) for k, s in enumerate(sizes)]


def fastq(rows, end="\n"):
    return "".join(f"@{i} more{end}{s}{end}+{end}{q}{end}" for i, s, q in rows).encode()


def packed(data, size):
    return b"".join(fastq_source.pack(data[k : k + size]) for k in range(0, len(data), size)) + fastq_source._END


@pytest.fixture(scope="module")
def source(spark):
    fastq_source.register(spark)
    return spark


@pytest.mark.parametrize("split", [97, 700, 1 << 20])
def test_every_record_once_at_every_split(source, tmp_path, split):
    rng = random.Random(split)
    files = {f"{k}.fastq": reads(rng, n) for k, n in (("a", 60), ("b", 1), ("c", 0), ("crlf", 20))} | {"block.fastq.gz": reads(rng, 50), "plain.fastq.gz": reads(rng, 30)}
    for name, rows in files.items():
        body = fastq(rows, "\r\n" if name == "crlf.fastq" else "\n")
        half = len(body) // 2
        (tmp_path / name).write_bytes(packed(body, 97) if name.startswith("block") else gzip.compress(body[:half]) + gzip.compress(body[half:]) if name.startswith("plain") else body)
    (tmp_path / "_job-left").mkdir()
    (tmp_path / "_job-left" / "part.fastq").write_bytes(fastq(reads(rng, 3)))
    df = source.read.format("fastq").option("splitBytes", split).load(str(tmp_path))
    got = [(r.file.rsplit("/", 1)[-1], r.read_id, r.seq, r.qual) for r in df.collect()]
    assert sorted(got) == sorted((n, *r) for n, rows in files.items() for r in rows)
    if split == 700:
        assert df.rdd.getNumPartitions() > 8 and source.read.format("fastq").option("splitBytes", split).load(str(tmp_path / "block.fastq.gz")).rdd.getNumPartitions() > 1


def test_blocks_are_gzip(tmp_path):
    data = os.urandom(1000) + b"A" * 100000
    assert gzip.decompress(packed(data, fastq_source.PACKED)) == data


def test_only_named_columns_are_built(source, tmp_path):
    (tmp_path / "a.fastq").write_bytes(fastq([("x", "ACG", "III"), ("y", "", "")]))
    df = source.read.format("fastq").schema("seq string").load(str(tmp_path / "a.fastq"))
    assert df.columns == ["seq"] and sorted(r.seq for r in df.collect()) == ["", "ACG"]
    with pytest.raises(Exception, match="FASTQ has no"):
        source.read.format("fastq").schema("quality string").load(str(tmp_path)).collect()


@pytest.mark.parametrize("compression", ["none", "bgzf"])
def test_written_and_read(source, tmp_path, compression):
    rows = reads(random.Random(7), 400)
    df = source.createDataFrame([*rows, (None, None, None)], "read_id string, seq string, qual string").repartition(3)
    for mode, times in (("append", 1), ("append", 2), ("overwrite", 1)):
        df.write.format("fastq").mode(mode).option("compression", compression).save(str(tmp_path / "out"))
        back = source.read.format("fastq").option("splitBytes", 3000).load(str(tmp_path / "out"))
        assert sorted((r.read_id, r.seq, r.qual) for r in back.collect()) == sorted([*rows, ("", "", "")] * times)
    assert not [n for n in os.listdir(tmp_path / "out") if not n.startswith("part-")]


def test_a_failed_task_leaves_no_part(source, tmp_path):
    df = source.range(100).select(F.col("id").cast("string").alias("read_id"), F.lit("A").alias("seq"), F.when(F.col("id") == 77, F.raise_error(F.lit("broken")).cast("string")).otherwise("I").alias("qual"))
    with pytest.raises(Exception, match="broken"):
        df.repartition(4).write.format("fastq").mode("append").save(str(tmp_path / "out"))
    assert not [f for _, _, files in os.walk(tmp_path / "out") for f in files if f.startswith("part-")]
