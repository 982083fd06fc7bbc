"""Streams and runs: what arrives in parts gives what it gives at once."""

import random

import pytest

from ampliq.operators import quality
from ampliq.sources import sequences
from ampliq.streaming import demux, ingest, profiles


def reads(rng, n):
    tags = ["ACGTACGTAC", "TTGGCCAATT"]
    out = []
    for k in range(n):
        seq = "".join(rng.choices("ACGT", k=6)) + rng.choice([*tags, "AAAAAAAAAA"]) + "".join(rng.choices("ACGT", k=rng.choice([100, 160, 200])))
        out.append((rng.choice("PQ"), k, seq, "".join(rng.choices("#I", [1, 60], k=len(seq)))))
    return out, [("P", 7, tags[0], 1), ("P", 8, tags[1], 2), ("Q", 9, tags[1], 1)]


def test_stream_equals_batch_after_a_restart(spark, tmp_path, monkeypatch):
    rows, tags = reads(random.Random(1), 120)
    samples = spark.createDataFrame(tags, "pool string, patient long, mid_seq string, mid_order int")
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for k in range(0, 120, 40):
        spark.createDataFrame(rows[k : k + 40], ingest.READS).coalesce(1).write.mode("append").parquet(source)
    write, calls = demux.write_reads_fasta, []

    def breaks_once(tagged, path):
        calls.append(path)
        write(tagged.limit(3) if len(calls) == 2 else tagged, path)  # a part of the second batch is written, then it breaks off
        if len(calls) == 2:
            raise RuntimeError("executor lost")

    monkeypatch.setattr(demux, "write_reads_fasta", breaks_once)
    with pytest.raises(Exception, match="executor lost"):
        demux.start_demux(ingest.stream_reads(spark, source, 1), samples, out, state).awaitTermination()
    demux.start_demux(ingest.stream_reads(spark, source, 1), samples, out, state).awaitTermination()
    assert len(calls) == 4 and calls[1] == calls[2]
    got = sorted((r.file.split("pool=")[1].split("/")[0], r.file.split("mid=")[1].split("/")[0], int(r.name), r.seq) for r in sequences.read_fasta(spark, out).collect())
    batch = demux.tagged_reads(spark.createDataFrame(rows, ingest.READS), samples).collect()
    assert got == sorted((r.pool, r.mid, r.read_id, r.seq) for r in batch) and {r.mid for r in batch} == {"0", "7", "8", "9"}


def test_only_new_files_are_counted(spark, tmp_path, monkeypatch):
    rows, _ = reads(random.Random(2), 60)
    paths = []
    for k in range(3):
        paths.append(str(tmp_path / f"{'PQP'[k]}_S{k}_flash.fastq"))
        with open(paths[-1], "w") as f:
            f.writelines(f"@{i}\n{s}\n+\n{q}\n" for _, i, s, q in rows[k::3])
    store = str(tmp_path / "store")
    assert profiles.stored_profile(spark, store).count() == 0
    assert profiles.add_files(spark, store, paths[:1]) == paths[:1]
    assert profiles.add_files(spark, store, paths) == sorted(paths[1:]) and profiles.add_files(spark, store, paths) == []
    every = spark.createDataFrame([("PQP"[k], *r[1:]) for k in range(3) for r in rows[k::3]], ingest.READS)
    assert sorted(map(tuple, profiles.stored_profile(spark, store).collect())) == sorted(map(tuple, quality.by_position(every).collect()))
    monkeypatch.setattr(profiles, "stored_counts", lambda *_: spark.createDataFrame([], profiles.COUNTS))
    profiles.add_files(spark, store, paths)  # as if the first addition had broken off before it was known
    monkeypatch.undo()
    assert sorted(map(tuple, profiles.stored_profile(spark, store).collect())) == sorted(map(tuple, quality.by_position(every).collect()))
