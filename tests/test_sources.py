"""Sequence files: round trips over splits, odd files and odd fields; shared tables; streaming."""

import gzip
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ampliq.sources import derived, sequences, shared
from ampliq.streaming import ingest

SF = "/root/testdata/sf0.001"


def records(rng, n):
    """Reads of 0 to 80 bases; qualities often begin with @ or +."""
    out = []
    for i in range(n):
        size = rng.choice([0, 1, 2, rng.randint(3, 80)])
        out.append((f"r{i}", "".join(rng.choice("ACGTN") for _ in range(size)), "".join(rng.choice("@+#IJ") for _ in range(size))))
    return out


def text(rows, end="\n"):
    return "".join(f"@{i} more words{end}{s}{end}+{end}{q}{end}" for i, s, q in rows)


def read(spark, path):
    return Counter((r["file"].rsplit("/", 1)[-1], r["read_id"], r["seq"], r["qual"]) for r in sequences.read_fastq(spark, path).collect())


@pytest.mark.parametrize("split", [97, 1000, 1 << 20])
def test_fastq_splits_and_files(spark, tmp_path, split):
    rng = random.Random(split)
    files = {"a.fastq": records(rng, 300), "b.fastq": records(rng, 7), "c.fastq": [], "d.fastq.gz": records(rng, 50), "e.fastq": records(rng, 40)}
    for name, rows in files.items():
        body = text(rows, "\r\n" if name == "e.fastq" else "\n").encode()
        (tmp_path / name).write_bytes(gzip.compress(body) if name.endswith(".gz") else body)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        assert read(spark, str(tmp_path)) == Counter((n, *r) for n, rows in files.items() for r in rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_fastq_that_ends_early(spark, tmp_path):
    rows = records(random.Random(1), 5)
    (tmp_path / "a.fastq").write_text(text(rows) + "@last\nACGT\n+\n\n\n"[:12])
    (tmp_path / "b.fastq").write_text(text(rows).rstrip("\n") + "\n\n\n")
    got = read(spark, str(tmp_path))
    assert {k[1:] for k in got if k[0] == "a.fastq"} == set(rows)
    assert {k[1:] for k in got if k[0] == "b.fastq"} >= set(rows[:4])


def test_fastq_null_fields_stay_records(spark, tmp_path):
    df = spark.createDataFrame([("p", 1, "AC", "II"), ("p", None, "G", "J"), ("p", 3, None, None)], "pool string, read_id long, seq string, qual string")
    for compression in ("gzip", "none"):
        path = str(tmp_path / compression)
        sequences.write_fastq(df, path, compression=compression)
        assert sorted((r["read_id"], r["seq"], r["qual"]) for r in sequences.read_fastq(spark, path).collect()) == [("", "G", "J"), ("1", "AC", "II"), ("3", "", "")]


def test_haplotype_names_without_counts(spark, tmp_path):
    (tmp_path / "h.fna").write_text(">a|5|2.5\nAC\nGT\n>plain\nTT\n>b|x\n\n>c|7|\nA\n")
    got = {r["name"]: (r["reads"], r["freq"], r["seq"]) for r in sequences.read_haplotypes(spark, str(tmp_path)).collect()}
    assert got == {"a": (5, 2.5, "ACGT"), "plain": (None, None, "TT"), "b": (None, None, ""), "c": (7, None, "A")}


def test_fasta_null_fields(spark, tmp_path):
    df = spark.createDataFrame([("p", 1, "n", 3, None, "AC"), ("p", 1, None, None, 0.5, None)], "pool string, patient int, name string, reads long, freq double, seq string")
    sequences.write_fasta(df, str(tmp_path / "x"))
    assert sorted((r["name"], r["reads"], r["freq"], r["seq"]) for r in sequences.read_haplotypes(spark, str(tmp_path / "x")).collect()) == [("", None, 0.5, ""), ("n", 3, None, "AC")]


def test_file_fields(spark):
    df = spark.createDataFrame([("/x/Pool_S1_L001_R1_001.fastq.gz",), ("Pool_S12_flash.fastq",), ("Other_flashFilt.fastq",), (None,)], "file string")
    assert [(r["pool"], r["sample_no"], r["mate"]) for r in sequences.file_fields(df).collect()] == [("Pool", "S1", "R1"), ("Pool", "S12", None), ("Other", None, None), (None, None, None)]


def test_sheets_by_tsv(spark, tmp_path):
    (tmp_path / "mids.tsv").write_text("MID.ID\tMID.Seq\n1\tACGTACGTAC\n12\t\n")
    assert sorted(map(tuple, sequences.read_tsv(spark, str(tmp_path / "mids.tsv"), sequences.MIDS).collect())) == [("1", "ACGTACGTAC"), ("12", None)]


def test_report_lines(spark):
    df = spark.createDataFrame([("b", 5, None), ("aa", 1234, 0.5)], "pool string, n long, pct double")
    lines = [r["value"] for r in sequences.report_lines(df, ["pool"], "Title").orderBy("line_no").collect()]
    assert lines == ["Title", "", "pool    n pct", "aa   1234 0.5", "b       5  NA"]


def test_tables_are_written_again_when_the_folder_was_cleared(spark):
    first = derived.derived_reads(spark, SF)
    n = first.count()
    shared.delete(spark, first.inputFiles()[0].rsplit("/", 1)[0])
    assert derived.derived_reads(spark, SF).count() == n


def test_small_tables_only_are_broadcast(spark):
    assert "broadcast" in shared.small(spark.range(5))._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in shared.small(spark.range(50), 5)._jdf.queryExecution().logical().toString().lower()


def test_streamed_counts_are_those_of_the_batch(spark, tmp_path):
    reads = derived.derived_reads(spark, SF).select("pool", "read_id", "seq", "qual")
    reads.repartition(5).write.parquet(str(tmp_path / "in"))
    query = ingest.start_counts(spark, str(tmp_path / "in"), "counts", str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    got = {r["pool"]: r["count"] for r in spark.table("counts").collect()}
    want = {r["pool"]: r["n"] for r in ingest.filter_q30(reads).groupBy("pool").agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_shared_tables_follow_their_input(spark, tmp_path):
    path = str(tmp_path / "events.parquet")
    read = lambda: shared.once(spark, str(tmp_path), "count", lambda: spark.read.parquet(path).groupBy().count()).first()[0]
    spark.range(5).write.parquet(path)
    assert read() == 5
    spark.range(8).write.mode("overwrite").parquet(path)
    assert read() == 8
