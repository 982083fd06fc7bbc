"""Demultiplexing of reads that arrive over time, into files by pool and tag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ampliq.operators import demux
from ampliq.operators.quality import filter_q30
from ampliq.sources.sequences import write_reads_fasta


def tagged_reads(reads: DataFrame, samples: DataFrame, max_pct: float = 0.05, **options: int) -> DataFrame:
    """(pool, mid, read_id, seq) of reads (pool, read_id, seq, qual) that pass the Q30 filter and are long enough; mid is the patient of the tag, 0 for none.

    Each distinct sequence is searched once.
    """
    kept = filter_q30(reads, max_pct).select("pool", "seq", "read_id")
    assigned = demux.assign_mid(demux.collapse(kept), samples, **options)
    return kept.join(assigned.select("pool", "seq", "patient"), ["pool", "seq"]).select("pool", F.coalesce(F.col("patient").cast("string"), F.lit("0")).alias("mid"), "read_id", "seq")


def start_demux(reads: DataFrame, samples: DataFrame, path: str, checkpoint: str, **options: int) -> StreamingQuery:
    """A query that writes each batch of a stream of reads as FASTA, in folders by batch, pool and tag.

    A batch's folder carries its number and is replaced whole, so a batch that
    broke off and is run again after a restart neither repeats nor loses a read.
    The samples are joined as they are when a batch runs.
    """
    def put(batch: DataFrame, number: int) -> None:
        write_reads_fasta(tagged_reads(batch, samples, **options), f"{path}/batch={number}")

    return reads.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
