"""FASTQ and FASTA files, tab-separated tables, text reports, and their sinks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampliq.sources.shared import small, written

SAMPLES = T.StructType([T.StructField(n, T.StringType()) for n in ("Patient.ID", "MID", "Primer.ID", "Region", "RefSeq.ID", "Pool.Nm")])
MIDS = T.StructType([T.StructField("MID.ID", T.StringType()), T.StructField("MID.Seq", T.StringType())])
PRIMERS = T.StructType([*(T.StructField(n, T.StringType()) for n in ("Ampl.Nm", "Region", "Primer.FW", "Primer.RV")), *(T.StructField(n, T.IntegerType()) for n in ("FW.pos", "RV.pos", "FW.tpos", "RV.tpos", "Aa.ipos", "Aa.lpos"))])


def _first_letters(values: pa.Array) -> np.ndarray:
    """The first byte of each text, 0 for an empty one."""
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)
    first = np.zeros(len(values), np.uint8)
    some = np.flatnonzero(ends[1:] > ends[:-1])
    first[some] = data[ends[some]]
    return first


def _parted(values: pa.Array, end: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """(places of headings of whole records, places of other lines, how many lines are settled); at a split's ``end`` all are."""
    first, n = _first_letters(values), len(values)
    heading = (first[: max(n - 3, 0)] == ord("@")) & (first[2 : max(n - 1, 2)] == ord("+"))
    whole, loose, k = [np.zeros(0, np.int64)], [], 0
    while n - k >= 4 or end and k < n:
        if n - k >= 4 and heading[k]:
            following = heading[k::4]
            run = len(following) if following.all() else int(following.argmin())
            whole.append(k + 4 * np.arange(run))
            k += 4 * run
        else:
            loose.append(k)
            k += 1
    return np.concatenate(whole), np.array(loose, np.int64), k


_WHOLE = "file string, block long, at long, head string, seq string, qual string"
_LOOSE = "file string, block long, at long, value string"


def _records(lines: DataFrame, whole: bool) -> DataFrame:
    """(file, block, at, head, seq, qual): ``whole`` records of each split; or (file, block, at, value), the lines left over at its ends, and a row without a value whose place is the split's number of lines.

    A split may begin anywhere in a record.  A line that begins with @ and is
    followed by one that begins with + two lines on is a heading: after a line
    of qualities, which may begin with @ too, that line would be a sequence.
    Lines stay in Arrow's arrays: what is looked at are their first letters.
    """
    names = [x.split()[0] for x in (_WHOLE if whole else _LOOSE).split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, at = None, pa.array([], pa.string()), 0

        def rows(places: np.ndarray, columns: list[pa.Array]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(here[0], pa.string()), len(places)), pa.repeat(pa.scalar(here[1], pa.int64()), len(places)), pa.array(places, pa.int64()), *columns], names)

        def taken(end: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, at
            heads, others, settled = _parted(held, end)
            if whole and len(heads):
                yield rows(at + heads, [held.take(pa.array(heads + k)) for k in (0, 1, 3)])
            if not whole and len(others):
                yield rows(at + others, [held.take(pa.array(others))])
            held, at = held.slice(settled), at + settled
            if not whole and end:
                yield rows(np.array([at]), [pa.nulls(1, pa.string())])

        for batch in batches:
            if not batch.num_rows:
                continue
            files, blocks, values = (batch.column(c) for c in ("file", "block", "value"))
            starts = blocks.to_numpy(zero_copy_only=False)
            other = (starts[1:] != starts[:-1]) | pc.not_equal(files[1:], files[:-1]).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(other) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts, cuts[1:]):
                split = files[low].as_py(), int(starts[low])
                if split != here:
                    if here:
                        yield from taken(True)
                    here, held, at = split, held.slice(0, 0), 0
                held = pa.concat_arrays([held, values.slice(low, high - low).cast(pa.string())])
            yield from taken(False)
        if here:
            yield from taken(True)

    return lines.mapInArrow(run, _WHOLE if whole else _LOOSE)


def _lines(spark: SparkSession, path: str | list[str], holding: tuple[str, ...] = ()) -> DataFrame:
    """(file, block, value) in the order of the files; of those whose path holds one of some texts, where these are given."""
    lines = spark.read.option("lineSep", "\n").text(path)
    if holding:
        lines = lines.where(reduce(lambda a, b: a | b, (F.contains(F.col("_metadata.file_path"), F.lit(x)) for x in holding)))
    plain = F.when(F.endswith("value", F.lit("\r")), F.substring("value", F.lit(1), F.length("value") - 1)).otherwise(F.col("value"))
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), plain.alias("value"))


def _joined(loose: DataFrame) -> DataFrame:
    """(file, block, at, head, seq, qual) of records that lie in two splits, from the lines left over; such a record has the place of its first line."""
    spot = F.row_number().over(Window.partitionBy("file").orderBy("block", "at")) - 1  # a few lines for each split
    loose = loose.where("value is not null").withColumn("_n", spot).withColumns({"record": F.floor(F.col("_n") / 4), "line": F.col("_n") % 4})
    first = F.min(F.struct("block", "at")).alias("_first")
    loose = loose.groupBy("file", "record").agg(first, *(F.max(F.when(F.col("line") == k, F.col("value"))).alias(name) for k, name in ((0, "head"), (1, "seq"), (3, "qual"))), F.count("*").alias("_lines")).where("_lines = 4")
    return loose.select("file", "_first.block", "_first.at", "head", "seq", "qual")


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, read_id, seq, qual) of four-line FASTQ files, plain or gzipped.

    Plain files are split as Spark splits text, gzipped ones are one task each.
    Records within a split are put together where they are read; the lines at
    its ends, a few per split, are numbered within their file and put together
    by fours.  A record that a file ends in the midst of is left out; empty
    reads have empty strings; carriage returns at line ends are no part of them.
    """
    lines = _lines(spark, path)
    return _records(lines, True).unionByName(_joined(_records(lines, False))).select("file", _head_id("head").alias("read_id"), "seq", "qual")


def _head_id(head: str) -> Column:
    return F.regexp_extract(head, r"^@(\S*)", 1)


def read_fastq_in_order(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``read_fastq`` with the ordinal of each record in its file, from 0.

    A record's line in its file is its line in its split and the lines of the
    splits before it.  These are counted by split in a pass of their own, which
    also finds the lines left over at the splits' ends, and summed along each
    file: one row a split, broadcast after they were counted.  The counts are
    written, since a filter of files that reached their scan alone would cut it
    into other splits; a record of a split without a count is an error, never
    left out.
    """
    return _in_order(spark, path).select("file", "ordinal", "read_id", "seq", "qual")


def _in_order(spark: SparkSession, path: str | list[str], mate: str | None = None) -> DataFrame:
    """(file, ordinal, read_id, seq, qual), of one ``mate``'s files with their pair_of; what a file's name tells is taken from it once a split."""
    holding = (f"_{mate}_", f"_{mate}.") if mate else ()
    ends = written(_records(_lines(spark, path, holding), False), "splits")
    before = F.coalesce(F.sum("at").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = file_fields(ends.where("value is null").select("file", "block", before.alias("_before")))
    starts = starts.select("file", "block", "_before", F.col("mate").eqNullSafe(mate).alias("_wanted") if mate else F.lit(True).alias("_wanted"), F.regexp_replace(file_name("file"), r"_R[12](?=[_.])", "_R").alias("pair_of"))
    placed = _records(_lines(spark, path, holding), True).unionByName(_joined(ends)).join(small(written(starts, "starts")), ["file", "block"], "left")
    known = F.coalesce("_before", F.raise_error(F.lit("files were split otherwise when their lines were counted")).cast("long"))
    ordinal = F.floor((known + F.col("at")) / 4).alias("ordinal")
    return placed.where("_wanted is null or _wanted").select("file", "pair_of", ordinal, _head_id("head").alias("read_id"), "seq", "qual")


def read_mates(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records of R1 and R2 files of one name, by their place: (pair_of, pool, sample_no, ordinal, read_id, seq, qual, read_id2, seq2, qual2).

    File names are ``Pool_S1_L001_R1_001.fastq`` and the like; ``pair_of`` is the
    name without its mate.  A record whose mate's file is missing or shorter has
    nulls for it; ids may differ, ``mate_report`` counts where they do.  Files
    without a mate in their name are left out.  First and second mates are read
    apart, so that each file is scanned for its own side of the join alone.
    """
    one, two = (_in_order(spark, path, m).select("ordinal", "pair_of", *(F.col(c).alias(c + end) for c in ("read_id", "seq", "qual"))) for m, end in (("R1", ""), ("R2", "2")))
    joined = one.join(two, ["ordinal", "pair_of"], "full_outer")
    return joined.select("pair_of", F.substring_index("pair_of", "_", 1).alias("pool"), F.nullif(F.regexp_extract("pair_of", r"_(S\d+)_", 1), F.lit("")).alias("sample_no"), "ordinal", "read_id", "seq", "qual", "read_id2", "seq2", "qual2")


def mate_report(mates: DataFrame) -> DataFrame:
    """(pair_of, pool, pairs, only_r1, only_r2, other_ids): what of each pair of files has a mate, what lacks one, and pairs whose ids differ."""
    r1, r2 = F.col("read_id").isNotNull(), F.col("read_id2").isNotNull()
    return mates.groupBy("pair_of", "pool").agg(F.count_if(r1 & r2).alias("pairs"), F.count_if(~r2).alias("only_r1"), F.count_if(~r1).alias("only_r2"), F.count_if(r1 & r2 & (F.col("read_id") != F.col("read_id2"))).alias("other_ids"))


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, name, seq); ``>`` never occurs within a sequence, so records are split at it."""
    rows = spark.read.option("lineSep", ">").text(path).select(F.col("_metadata.file_path").alias("file"), "value").where(F.length(F.trim("value")) > 0)
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    return rows.select("file", F.trim(head).alias("name"), F.regexp_replace(F.substring("value", F.length(head) + 1, F.length("value")), r"\s", "").alias("seq"))


def read_haplotypes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """FASTA whose names are ``name|reads|freq``; counts that a name lacks, or that are no numbers, are null."""
    part = F.split("name", r"\|")
    count = lambda k: F.get(part, F.lit(k))
    return read_fasta(spark, path).select("file", part[0].alias("name"), count(1).try_cast("long").alias("reads"), count(2).try_cast("double").alias("freq"), "seq")


def read_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=schema)


def write_tsv(table: DataFrame, path: str) -> None:
    table.write.csv(path, sep="\t", header=True)


def file_name(path: str) -> Column:
    """The last part of a path; of a folder of part files, written by ``write_named_fastq``, the folder's name."""
    last = F.substring_index(path, "/", -1)
    folder = F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    return F.substring_index(F.when(F.startswith(last, F.lit("part-")), folder).otherwise(last), "=", -1)


def file_fields(df: DataFrame, name: str = "file") -> DataFrame:
    """pool, sample_no and mate from names like ``Pool_S1_L001_R1_001.fastq.gz`` or ``Pool_S1_flash.fastq``."""
    base = file_name(name)
    return df.withColumns({"pool": F.substring_index(base, "_", 1), "sample_no": F.nullif(F.regexp_extract(base, r"_(S\d+)_", 1), F.lit("")), "mate": F.nullif(F.regexp_extract(base, r"_(R[12])[_.]", 1), F.lit(""))})


def _text(column: str | Column) -> Column:
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))


def write_fastq(reads: DataFrame, path: str, by: tuple[str, ...] = ("pool",), compression: str = "gzip") -> None:
    """Four lines for each read, in folders by ``by``; a null id, sequence or quality is an empty line."""
    text = F.concat(F.lit("@"), _text("read_id"), F.lit("\n"), _text("seq"), F.lit("\n+\n"), _text("qual"))
    reads.select(*by, text.alias("value")).write.partitionBy(*by).option("compression", compression).text(path)


def write_named_fastq(reads: DataFrame, path: str, order: str = "read_id") -> None:
    """Reads that carry the name of their file (column ``name``), in a folder of that name and in the order of ``order``; a file is one task's work."""
    spread = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    write_fastq(reads.repartition(spread, "name").sortWithinPartitions("name", order), path, ("name",), "none")


def write_fasta(haplotypes: DataFrame, path: str, by: tuple[str, ...] = ("pool", "patient")) -> None:
    """Names are ``name|reads|freq``, nulls being empty, in folders by ``by``."""
    head = F.concat(F.lit(">"), _text("name"), F.lit("|"), _text("reads"), F.lit("|"), _text("freq"))
    haplotypes.select(*by, F.concat(head, F.lit("\n"), _text("seq")).alias("value")).write.partitionBy(*by).text(path)


def write_reads_fasta(reads: DataFrame, path: str, by: tuple[str, ...] = ("pool", "mid")) -> None:
    """Reads as FASTA named by their ids, in folders by pool and tag, which are replaced whole."""
    reads.select(*by, F.concat(F.lit(">"), _text("read_id"), F.lit("\n"), _text("seq")).alias("value")).write.mode("overwrite").partitionBy(*by).text(path)


def report_lines(table: DataFrame, order: list[str], title: str | None = None) -> DataFrame:
    """(line_no, value): a small table as text, columns as wide as their longest value, in the order of ``order``.

    Numbers stand to the right, other values to the left, nulls are NA.  For
    reports of pools, samples and files: the rows pass through one window.
    """
    shown = table.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NA")).alias(c) for c in table.columns), F.row_number().over(Window.orderBy(*order)).alias("_n"))
    wide = shown.agg(*(F.max(F.length(F.col(f"`{c}`"))).alias(c) for c in table.columns)).first()
    cells, heads = [], []
    for f in table.schema:
        n = max(wide[f.name] or 0, len(f.name))
        right = isinstance(f.dataType, T.NumericType)
        cells.append((F.lpad if right else F.rpad)(F.col(f"`{f.name}`"), n, " "))
        heads.append(f.name.rjust(n) if right else f.name.ljust(n))
    top = [title, ""] if title else []
    first = table.sparkSession.createDataFrame([(k, v) for k, v in enumerate([*top, " ".join(heads)], 1 - len(top) - 1)], "line_no int, value string")
    return first.unionByName(shown.select(F.col("_n").cast("int").alias("line_no"), F.rtrim(F.concat_ws(" ", *cells)).alias("value")))


def write_report(table: DataFrame, path: str, order: list[str], title: str | None = None) -> None:
    """A small table as one text file."""
    report_lines(table, order, title).repartition(1).sortWithinPartitions("line_no").select("value").write.text(path)
