"""R1 and R2 files paired by the place of their records."""

import gzip
import random

import pytest

from ampliq.sources import sequences


def fastq(rows, end="\n"):
    return "".join(f"@{i}{end}{s}{end}+{end}{q}{end}" for i, s, q in rows)


def reads(rng, n, name="r"):
    return [(f"{name}{k}", "".join(rng.choices("ACGTN", k=size)), "".join(rng.choices("@+#IJ", k=size))) for k, size in ((k, rng.randrange(60)) for k in range(n))]


@pytest.fixture(params=[150, 1 << 20])
def splits(spark, request):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in names}
    spark.conf.set(names[0], str(request.param))
    spark.conf.set(names[1], "10")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_mates_meet_by_their_place(spark, tmp_path, splits):
    rng = random.Random(1)
    files = {"A_S1_L001_R1_001.fastq": reads(rng, 90), "A_S1_L001_R2_001.fastq": reads(rng, 90), "A_S1_L002_R1_001.fastq": reads(rng, 30), "A_S1_L002_R2_001.fastq": reads(rng, 25),
             "B_S2_L001_R1_001.fastq": reads(rng, 12), "C_S3_L001_R2_001.fastq": reads(rng, 4), "D_S4_R1.fastq.gz": reads(rng, 40), "D_S4_R2.fastq.gz": reads(rng, 40, "other"), "E_S5_flash.fastq": reads(rng, 9),
             "F_S6_L001_R1_001.fastq": [], "F_S6_L001_R2_001.fastq": []}
    for name, rows in files.items():
        body = fastq(rows, "\r\n" if name.startswith("B") else "\n").encode()
        (tmp_path / name).write_bytes(gzip.compress(body) if name.endswith("gz") else body)
    got = sequences.read_mates(spark, str(tmp_path)).collect()
    want = set()
    for name, rows in files.items():
        if "_R1" in name:
            others = files.get(name.replace("_R1", "_R2"), [])
            for k in range(max(len(rows), len(others))):
                want.add((name.replace("_R1", "_R"), name[0], k, *(rows[k] if k < len(rows) else (None,) * 3), *(others[k] if k < len(others) else (None,) * 3)))
    want |= {("C_S3_L001_R_001.fastq", "C", k, None, None, None, *r) for k, r in enumerate(files["C_S3_L001_R2_001.fastq"])}
    found = {(r.pair_of, r.pool, r.ordinal, r.read_id, r.seq, r.qual, r.read_id2, r.seq2, r.qual2) for r in got}
    assert sorted(map(repr, found - want))[:3] == sorted(map(repr, want - found))[:3] and len(got) == len(want)
    report = {r.pair_of: tuple(r)[2:] for r in sequences.mate_report(sequences.read_mates(spark, str(tmp_path))).collect()}
    assert report == {"A_S1_L001_R_001.fastq": (90, 0, 0, 0), "A_S1_L002_R_001.fastq": (25, 5, 0, 0), "B_S2_L001_R_001.fastq": (0, 12, 0, 0), "C_S3_L001_R_001.fastq": (0, 0, 4, 0), "D_S4_R.fastq.gz": (40, 0, 0, 40)}


def test_named_files_keep_their_order(spark, tmp_path, splits):
    rows = [(f"P{k % 3}_S1_L001_R1_001.fastq", "P", k, "ACGT"[: k % 5], "IIII"[: k % 5]) for k in range(300)]
    random.Random(2).shuffle(rows)
    sequences.write_named_fastq(spark.createDataFrame(rows, "name string, pool string, read_id long, seq string, qual string"), str(tmp_path / "out"))
    back = sequences.read_fastq_in_order(spark, str(tmp_path / "out")).select(sequences.file_name("file").alias("name"), "ordinal", "read_id").collect()
    assert {(r.name, r.ordinal, int(r.read_id)) for r in back} == {(n, k // 3, k) for n, _, k, _, _ in rows}


def test_mates_without_a_sample_number_meet_and_each_file_is_parsed_once(spark, tmp_path, splits):
    rng = random.Random(3)
    one, two = reads(rng, 40), reads(rng, 40)
    (tmp_path / "A_R1.fastq").write_text(fastq(one))
    (tmp_path / "A_R2.fastq").write_text(fastq(two))
    mates = sequences.read_mates(spark, str(tmp_path))
    assert mates._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2  # one a side
    got = {(r.pair_of, r.pool, r.sample_no, r.ordinal, r.read_id, r.seq, r.qual2) for r in mates.collect()}
    assert got == {("A_R.fastq", "A", None, k, a[0], a[1], b[2]) for k, (a, b) in enumerate(zip(one, two))}


def test_file_names_of_any_path(spark):
    names = {"/a/b=1/X_S1_R1.fastq": "X_S1_R1.fastq", "file:/a/name=Y_R2.fastq/part-00-c.txt": "Y_R2.fastq", "part-0": "part-0", "Z.fq": "Z.fq", "/part-x/W=V.fq": "V.fq"}
    rows = spark.createDataFrame([(k,) for k in names], "file string").select("file", sequences.file_name("file").alias("name")).collect()
    assert {r.file: r.name for r in rows} == names
