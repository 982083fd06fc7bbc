"""Every operator as a query over reads derived from the driver's tables, with its SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ampliq.operators import alignment, demux, dimensions, haplotypes as hap, merge, quality, yields
from ampliq.sources import fastq_source, sequences
from ampliq.sources.derived import RECIPE, derived_pairs, derived_reads, primer_sheet, sample_sheet, samples, tag_sheet
from ampliq.sources.shared import once, shared_dir
from ampliq.streaming import demux as stream_demux, ingest, profiles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Steps that the oracle statements share, in order; each statement takes the ones it needs.
_STEPS: dict[str, str] = {
    "reads": RECIPE,
    "mg": """SELECT pool, read_id, CASE WHEN read_id % 7 = 0 THEN NULL ELSE seq END AS seq, CASE WHEN read_id % 7 = 0 THEN NULL WHEN length(seq) > 180
              THEN concat(substr(qual, 1, length(seq) - 180), array_to_string(list_transform(range(length(seq) - 179, 181), lambda p: CASE WHEN p = 150 AND read_id % 5 = 1 THEN chr(greatest(ascii(substr(qual, p, 1)) - 2, 35)) ELSE greatest(substr(qual, p, 1), 'I') END), ''), repeat('I', length(seq) - 180))
              ELSE array_to_string(list_transform(string_split(qual, ''), lambda q: greatest(q, 'I')), '') END AS qual, CASE WHEN read_id % 7 = 0 THEN NULL WHEN length(seq) > 180 THEN 360 - length(seq) ELSE length(seq) END AS overlap FROM reads""",
    "rq": "SELECT *, length(seq) AS width, length(qual) - length(regexp_replace(qual, '[!->]', '', 'g')) AS below FROM reads",
    "ok": "SELECT * FROM rq WHERE below / width <= 0.05",
    "sm": "SELECT *, row_number() OVER (PARTITION BY pool ORDER BY patient) AS mid_order FROM (SELECT DISTINCT pool, patient, mid_seq, fw_primer, rv_primer FROM reads)",
    "col": "SELECT pool, seq, count(*) AS n FROM ok GROUP BY pool, seq",
    "hits": "SELECT c.pool, c.seq, c.n, s.patient, s.mid_order, list_filter(range(1, 32), lambda p: hamming(substr(c.seq, p, 10), s.mid_seq) <= 1)[1] AS pos FROM col c JOIN sm s ON c.pool = s.pool WHERE length(c.seq) > 150",
    "asg": "SELECT c.pool, c.seq, c.n, h.patient FROM col c LEFT JOIN (SELECT pool, seq, arg_min(patient, mid_order) AS patient FROM hits WHERE pos IS NOT NULL GROUP BY pool, seq) h ON c.pool = h.pool AND c.seq = h.seq WHERE length(c.seq) > 150",
    "p0": "SELECT a.*, s.fw_primer, s.rv_primer, length(a.seq) <= 180 AS short FROM asg a JOIN sm s ON a.pool = s.pool AND a.patient = s.patient",
    "p1": """SELECT *, CASE WHEN NOT short THEN list_filter(range(1, 82), lambda p: len(list_filter(range(1, 21), lambda i: substr(seq, p + i - 1, 1) <> substr(fw_primer, i, 1) AND substr(seq, p + i - 1, 1) <> 'N')) <= 3)[1] END AS fw5,
              CASE WHEN NOT short THEN list_filter(range(1, 82), lambda p: len(list_filter(range(1, 21), lambda i: substr(seq, p + i - 1, 1) <> substr(rv_primer, i, 1) AND substr(seq, p + i - 1, 1) <> 'N')) <= 3)[1] END AS rv5 FROM p0""",
    "p2": "SELECT *, CASE WHEN fw5 IS NOT NULL THEN 'fw' WHEN rv5 IS NOT NULL THEN 'rv' END AS strand, substr(seq, coalesce(fw5, rv5) + 20) AS r0 FROM p1",
    "p3": "SELECT *, CASE WHEN strand = 'fw' THEN r0 WHEN strand = 'rv' AND length(r0) > 105 THEN reverse(translate(r0, 'ACGTN', 'TGCAN')) END AS rest FROM p2",
    "p4": """SELECT *, CASE WHEN strand = 'fw' THEN greatest(length(rest) - 100, 1) ELSE 1 END AS low, CASE WHEN strand = 'fw' THEN length(rest) - 19 ELSE least(86, length(rest) - 19) END AS high,
              CASE WHEN strand = 'fw' THEN reverse(translate(rv_primer, 'ACGT', 'TGCA')) ELSE fw_primer END AS motif FROM p3""",
    "p5": "SELECT *, list_filter(range(low, high + 1), lambda p: len(list_filter(range(1, 21), lambda i: substr(rest, p + i - 1, 1) <> substr(motif, i, 1) AND substr(rest, p + i - 1, 1) <> 'N')) <= 3)[1] AS pos3 FROM p4",
    "mt": "SELECT pool, patient, seq, n, short, strand, coalesce(fw5, rv5) AS pos5, pos3, nullif(CASE WHEN pos3 IS NULL THEN NULL WHEN strand = 'fw' THEN substr(rest, 1, pos3 - 1) ELSE substr(rest, pos3 + 20) END, '') AS trimmed FROM p5",
    "pc": """SELECT pool, patient, sum(n) AS tot_reads, sum(CASE WHEN short THEN n ELSE 0 END) AS shorts, sum(CASE WHEN strand = 'fw' THEN n ELSE 0 END) AS fw_match, sum(CASE WHEN strand = 'rv' THEN n ELSE 0 END) AS rv_match,
              sum(CASE WHEN strand = 'fw' AND trimmed IS NOT NULL THEN n ELSE 0 END) AS fw_fn_match, sum(CASE WHEN strand = 'rv' AND trimmed IS NOT NULL THEN n ELSE 0 END) AS rv_fn_match, sum(CASE WHEN trimmed IS NOT NULL THEN n ELSE 0 END) AS fn_reads FROM mt GROUP BY pool, patient""",
    "hp": "SELECT pool, patient, strand, trimmed AS seq, sum(n) AS nr FROM mt WHERE trimmed IS NOT NULL GROUP BY ALL",
    "ab0": "SELECT *, sum(nr) OVER (PARTITION BY pool, patient, strand) AS al, sum(CASE WHEN length(seq) >= 150 THEN nr ELSE 0 END) OVER (PARTITION BY pool, patient, strand) AS all_reads FROM hp",
    "ab": "SELECT pool, patient, strand, seq, nr, all_reads, round(nr * 100 / all_reads, 2) AS freq FROM ab0 WHERE nr * 100 >= al * 0.2 AND length(seq) >= 150",
    "sj": "SELECT pool, patient, seq, sum(CASE WHEN strand = 'fw' THEN nr ELSE 0 END) AS fw, sum(CASE WHEN strand = 'rv' THEN nr ELSE 0 END) AS rv FROM ab GROUP BY ALL",
    "cs": "SELECT pool, patient, seq, fw + rv AS reads, row_number() OVER (PARTITION BY pool, patient ORDER BY fw + rv DESC, seq) AS ord FROM sj WHERE fw > 0 AND rv > 0",
    "tot": "SELECT pool, patient, strand, sum(nr) AS al FROM hp WHERE length(seq) >= 150 GROUP BY ALL",
    "kp": "SELECT pool, patient, 'fw' AS strand, sum(fw) AS i, sum(CASE WHEN rv > 0 THEN fw ELSE 0 END) AS com FROM sj GROUP BY ALL UNION ALL SELECT pool, patient, 'rv', sum(rv), sum(CASE WHEN fw > 0 THEN rv ELSE 0 END) FROM sj GROUP BY ALL",
    "me": "SELECT t.pool, t.patient, t.strand, t.al AS \"all\", t.al - coalesce(k.i, 0) AS lowf, coalesce(k.i, 0) AS \"in\", coalesce(k.i, 0) - coalesce(k.com, 0) AS unq, coalesce(k.com, 0) AS com FROM tot t LEFT JOIN kp k USING (pool, patient, strand)",
    "al": "SELECT pool, patient, amplicon_aln AS aln, count(*) AS nr FROM reads GROUP BY ALL",
    "ms": "SELECT pool, patient, first(aln ORDER BY nr DESC, aln) AS master FROM al GROUP BY ALL",
    "nm": "SELECT al.*, ms.master, hamming(al.aln, ms.master) AS nm FROM al JOIN ms USING (pool, patient)",
    "nh": "SELECT pool, patient, printf('Hpl.%d.%04d', nm, row_number() OVER (PARTITION BY pool, patient, nm ORDER BY nr DESC, aln)) AS name, nr AS reads, round(nr * 100 / sum(nr) OVER (PARTITION BY pool, patient), 2) AS freq, nm, replace(aln, '-', '') AS seq FROM nm WHERE nm <= 250",
    "cl": "SELECT pool, patient, unnest(range(1, length(aln) + 1)) AS pos, unnest(string_split(aln, '')) AS base, nr FROM al",
    "fs": "SELECT pool, patient, count(*) AS hpl, max(nm) AS max_mut, max(freq) AS master_pct, sum(reads) AS reads FROM nh GROUP BY ALL",
    "rf": "SELECT pool, chr(CAST(65 + patient AS INT)) AS type, master AS aln FROM ms WHERE patient < 4",
    "gd": "SELECT al.pool, al.patient, al.aln, al.nr, rf.type, hamming(al.aln, rf.aln) AS distance FROM al JOIN rf USING (pool)",
    "gr": "SELECT pool, patient, aln, nr, type, distance, row_number() OVER w AS k, lead(distance) OVER w AS nxt FROM gd WINDOW w AS (PARTITION BY pool, patient, aln ORDER BY distance, type)",
    "ty": "SELECT pool, patient, type, sum(nr) AS nr FROM gr WHERE k = 1 GROUP BY ALL",
    "gp": "SELECT pool, patient, A, B, C, D, {pct} FROM (SELECT pool, patient, {sums} FROM ty GROUP BY ALL)",
    "sh": "SELECT *, 'AMP.' || pool AS amplicon, CASE WHEN pool = 'POOLA' THEN 'S' ELSE 'X' END AS region, CASE WHEN pool = 'POOLA' THEN 1255 ELSE 2844 END AS fw_pos, CASE WHEN pool = 'POOLA' THEN 1255 ELSE 2844 END + length(fw_primer) + (SELECT max(length(amplicon_aln)) FROM reads) + length(rv_primer) - 1 AS rv_pos FROM sm",
    "ex": "SELECT pool, max(rv_pos - fw_pos + 1) AS expected, max(rv_pos - fw_pos + 1) + max(2 * (length(mid_seq) + 20)) AS raw FROM sh GROUP BY pool",
    "eh": "SELECT pool, patient, seq, nr, first_value(seq) OVER (PARTITION BY pool, patient ORDER BY nr DESC, seq) AS master FROM (SELECT pool, patient, seq, reads AS nr FROM cs)",
    "ea": """SELECT pool, patient, seq, nr, abs(length(seq) - length(master)) AS gaps, list_min(list_transform(range(0, length(lo) + 1), lambda p: hamming('x' || left(lo, p), 'x' || left(hi, p)) + hamming('x' || substr(lo, p + 1), 'x' || substr(hi, p + 1 + length(hi) - length(lo))))) AS mismatches
              FROM (SELECT *, CASE WHEN length(seq) < length(master) THEN seq ELSE master END AS lo, CASE WHEN length(seq) < length(master) THEN master ELSE seq END AS hi FROM eh)""",
    "aw": "SELECT pool, patient, max(length(seq)) AS width FROM sj GROUP BY ALL",
    "cn": "SELECT pool, patient, printf('Hpl.%d.%04d', mismatches, row_number() OVER (PARTITION BY pool, patient, mismatches ORDER BY nr DESC, seq)) AS name, nr AS reads, round(nr * 100 / sum(nr) OVER (PARTITION BY pool, patient), 2) AS freq, mismatches AS nm, seq FROM ea",
    "it": 'SELECT coalesce(pool, \'TOTAL\') AS pool, sum("all") AS "all", sum(lowf) AS lowf, sum("in") AS "in", sum(unq) AS unq, sum(com) AS com, ' + ", ".join(f'round(sum("{c}") * 100 / sum("all"), 2) AS {c}_pct' for c in ("lowf", "in", "unq", "com")) + " FROM me GROUP BY ROLLUP (pool)",
    "qp": "SELECT pool, pos, count(*) AS reads, round(quantile_cont(q, 0.05), 6) AS q5, round(quantile_cont(q, 0.25), 6) AS q25, round(quantile_cont(q, 0.5), 6) AS q50, round(quantile_cont(q, 0.75), 6) AS q75, round(quantile_cont(q, 0.95), 6) AS q95 FROM (SELECT pool, unnest(range(1, length(qual) + 1)) AS pos, ascii(unnest(string_split(qual, ''))) - 33 AS q FROM reads) GROUP BY pool, pos",
    "lh": "SELECT pool, len, n, round(100 * n / sum(n) OVER (PARTITION BY pool), 4) AS share_pct, sum(n) OVER (PARTITION BY pool ORDER BY len) AS cum_n FROM (SELECT pool, length(seq) AS len, count(*) AS n FROM reads GROUP BY ALL)",
    "fu": """SELECT coalesce(pool, 'TOTAL') AS pool, sum(raw) AS raw, sum(flash) AS flash, sum(fq30) AS fq30, sum(mid) AS mid, sum(primer) AS primer, sum(filt) AS filt, sum(ints) AS ints FROM
              (SELECT pool, count(*) AS raw, count(*) AS flash FROM reads GROUP BY pool) LEFT JOIN (SELECT pool, count(*) AS fq30 FROM ok GROUP BY pool) USING (pool)
              LEFT JOIN (SELECT pool, sum(tot_reads) AS mid, sum(fn_reads) AS primer FROM pc GROUP BY pool) USING (pool)
              LEFT JOIN (SELECT pool, sum(nr) AS filt FROM ab GROUP BY pool) USING (pool) LEFT JOIN (SELECT pool, sum(reads) AS ints FROM cs GROUP BY pool) USING (pool) GROUP BY ROLLUP (pool)""",
}


_TYPES = ("A", "B", "C", "D")
_STEPS["gp"] = _STEPS["gp"].format(pct=", ".join(f"round({t} * 100 / (A + B + C + D), 2) AS {t}_pct" for t in _TYPES), sums=", ".join(f"sum(CASE WHEN type = '{t}' THEN nr ELSE 0 END) AS {t}" for t in _TYPES))


def _sql(body: str, **other: str) -> str:
    """``body`` after the steps that it uses, itself or through other steps; ``other`` steps take the place of those of their name."""
    import re

    steps = _STEPS | other

    names, todo = set(), [body]
    while todo:
        text = todo.pop()
        for name in steps:
            if name not in names and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                names.add(name)
                todo.append(steps[name])
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({s.strip()})" for n, s in steps.items() if n in names) + "\n" + body


def _report(table: str, first: str, numbers: tuple[str, ...]) -> str:
    """SQL of a text report's lines: ``first`` to the left, numbers to the right, as wide as their longest value or their name."""
    cells = [(f'CAST("{c}" AS VARCHAR)', f"w{k}", "rpad" if c == first else "lpad", c) for k, c in enumerate((first, *numbers))]
    line = ", ".join(f"{pad}({text}, {wide}, ' ')" for text, wide, pad, _ in cells)
    wide = ", ".join(f"CAST(greatest({len(c)}, max(length({text}))) AS INT) AS {w}" for text, w, _, c in cells)
    return f"SELECT CAST(row_number() OVER (ORDER BY {first}) AS INT) AS line_no, rtrim(concat_ws(' ', {line})) AS value FROM {table}, (SELECT {wide} FROM {table})"


def _query(oracle: str, **other: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = _sql(oracle, **other)
        return f
    return add


def _filtered(spark: SparkSession, d: str) -> DataFrame:
    return quality.filter_q30(derived_reads(spark, d))


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    """Written once per session, as six reports read it."""
    return once(spark, d, "assigned", lambda: demux.assign_mid(demux.collapse(_filtered(spark, d)), samples(spark, d)))


def _matched(spark: SparkSession, d: str) -> DataFrame:
    """Written once per session: the searches are what costs, and a dozen reports read their result."""
    return once(spark, d, "matched", lambda: demux.match_primers(_assigned(spark, d), samples(spark, d)))


def _profile(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "profile", lambda: quality.by_position(derived_reads(spark, d)))


def _haplotypes(spark: SparkSession, d: str) -> DataFrame:
    return demux.collapse_haplotypes(_matched(spark, d))


def _consensus(spark: SparkSession, d: str) -> DataFrame:
    return hap.consensus(hap.strand_join(hap.abundant(_haplotypes(spark, d))))


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    """Written once per session, as a dozen reports read it."""
    return once(spark, d, "aligned", lambda: hap.aligned_haplotypes(derived_reads(spark, d)))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@_query("SELECT read_id, pool, width, below AS below_q30 FROM ok")
def q30_filter(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d).select("read_id", "pool", "width", "below_q30")


@_query("SELECT pool, count(*) AS raw, count(*) FILTER (below / width <= 0.05) AS kept, round(count(*) FILTER (below / width <= 0.05) * 100 / count(*), 2) AS yield_pct FROM rq GROUP BY pool")
def q30_counts(spark: SparkSession, d: str) -> DataFrame:
    return quality.q30_counts(derived_reads(spark, d))


@_query("SELECT read_id, pool, width, below AS below_q30, round(below / width, 6) AS fraction_below FROM rq")
def qc_by_read(spark: SparkSession, d: str) -> DataFrame:
    return quality.by_read(derived_reads(spark, d)).select("read_id", "pool", "width", "below_q30", F.round("fraction_below", 6).alias("fraction_below"))


@_query("SELECT pool, " + ", ".join(f"round(quantile_cont({e}, {q}), 6) AS {n}_{int(100 * q)}" for e, n in (("below", "count"), ("below / width", "share")) for q in (0.5, 0.8, 0.95, 0.99)) + " FROM rq GROUP BY pool")
def qc_read_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return quality.read_quantiles(derived_reads(spark, d))


@_query("SELECT * FROM qp")
def qc_pos_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return _profile(spark, d)


@_query("SELECT pool, pos, " + ", ".join(f"round(q{q}, 6) AS q{q}" for q in (5, 25, 50, 75, 95)) + " FROM (SELECT pool, pos, max(pos) OVER (PARTITION BY pool) AS last, " + ", ".join(f"avg(q{q}) OVER (PARTITION BY pool ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS q{q}" for q in (5, 25, 50, 75, 95)) + " FROM qp) WHERE pos <= last - 10")
def qc_pos_sliding(spark: SparkSession, d: str) -> DataFrame:
    return quality.sliding_quality(_profile(spark, d))


@_query("SELECT pool, " + ", ".join(f"round(quantile_cont(length(seq), {q}), 6) AS len{int(100 * q)}" for q in (0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM reads GROUP BY pool")
def len_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return quality.length_quantiles(derived_reads(spark, d))


@_query("SELECT * FROM lh")
def len_hist_cumulative(spark: SparkSession, d: str) -> DataFrame:
    return quality.length_histogram(derived_reads(spark, d))


@_query("SELECT pool, len, n, share_pct FROM lh WHERE share_pct >= 5")
def len_peaks(spark: SparkSession, d: str) -> DataFrame:
    return quality.length_peaks(derived_reads(spark, d))


@_query("SELECT pool, " + ", ".join(f"round(avg(CASE WHEN below / width <= {c} THEN 1 ELSE 0 END) * 100, 4) AS le_{int(100 * c)}" for c in (0.01, 0.02, 0.05)) + " FROM rq GROUP BY pool")
def q30_threshold_curve(spark: SparkSession, d: str) -> DataFrame:
    return quality.threshold_curve(derived_reads(spark, d))


@_query("SELECT rq.pool, below AS below_q30, count(*) AS n FROM rq JOIN (SELECT pool, quantile_cont(below, 0.99) AS q FROM rq GROUP BY pool) c ON rq.pool = c.pool AND below < q GROUP BY ALL")
def qc_below_q99(spark: SparkSession, d: str) -> DataFrame:
    return quality.below_own_q99(derived_reads(spark, d))


def _merged(spark: SparkSession, d: str) -> DataFrame:
    """Written once per session: four reports read it."""
    return once(spark, d, "merged", lambda: merge.merge_pairs(*derived_pairs(spark, d)))


@_query("SELECT * FROM mg")
def merge_reads(spark: SparkSession, d: str) -> DataFrame:
    """The merged pairs, against the reads from which they were cut."""
    return _merged(spark, d)


@_query("SELECT pool, count(seq) AS extended, count(*) - count(seq) AS no_ext, count(*) AS raw, round(count(seq) * 100 / count(*), 1) AS yield_pct FROM mg GROUP BY pool")
def merge_yield(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_report(_merged(spark, d))


@_query("SELECT pool, overlap, count(*) AS n FROM mg WHERE overlap IS NOT NULL GROUP BY ALL")
def merge_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return merge.overlap_histogram(_merged(spark, d))


_POSITIONS = "SELECT pool, pos, count(*) AS reads, " + ", ".join(f"round(quantile_cont(q, {q}), 6) AS q{int(100 * q)}" for q in quality.QUANTILES) + ", kind, expected FROM (SELECT pool, kind, expected, unnest(range(1, length(qual) + 1)) AS pos, ascii(unnest(string_split(qual, ''))) - 33 AS q FROM ({}) JOIN (SELECT pool, raw AS expected FROM ex) USING (pool)) WHERE pos <= expected GROUP BY pool, kind, expected, pos"


@_query(_POSITIONS.format("SELECT pool, 'R1' AS kind, substr(qual, 1, 180) AS qual FROM reads UNION ALL SELECT pool, 'R2', CASE WHEN read_id % 7 = 0 THEN repeat('I', 160) WHEN length(seq) > 180 AND read_id % 5 = 1 THEN reverse(substr(repeat('I', 149) || '#' || repeat('I', length(seq) - 150), length(seq) - 179, 180)) ELSE repeat('I', least(length(seq), 180)) END FROM reads UNION ALL SELECT pool, 'merged', qual FROM mg WHERE qual IS NOT NULL"))
def qc_pos_by_kind(spark: SparkSession, d: str) -> DataFrame:
    """First mates, second mates and merged reads side by side, up to the expected length of raw reads."""
    expected = dimensions.expected_length(sample_sheet(spark, d), primer_sheet(spark, d), raw=True)
    kinds = {"R1": derived_pairs(spark, d)[0], "R2": derived_pairs(spark, d)[1], "merged": _merged(spark, d).where("qual is not null")}
    return quality.side_by_side({k: quality.by_position(v) for k, v in kinds.items()}, expected)


@_query("SELECT pool, bin, round((bin - 1) * 10, 6) AS starts_at, n FROM (SELECT pool, CAST(CASE WHEN below >= 300 THEN 31 ELSE below * 30 // 300 + 1 END AS INT) AS bin, count(*) AS n FROM rq GROUP BY ALL)")
def below_q30_histogram(spark: SparkSession, d: str) -> DataFrame:
    return quality.histogram(quality.by_read(derived_reads(spark, d)), "below_q30", 0.0, 300.0)


@_query("SELECT pool, seq, n, patient, mid_order, pos FROM hits WHERE pos IS NOT NULL")
def mid_match(spark: SparkSession, d: str) -> DataFrame:
    return demux.mid_hits(demux.collapse(_filtered(spark, d)), samples(spark, d))


@_query("SELECT pool, seq, n, patient FROM asg")
def mid_assign_greedy(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(spark, d)


@_query("SELECT pool, coalesce(patient, -1) AS patient, sum(n) AS reads FROM asg GROUP BY ALL")
def mid_counts(spark: SparkSession, d: str) -> DataFrame:
    return demux.mid_counts(_assigned(spark, d))


@_query("SELECT t.pool, t.tot_reads, coalesce(a.no_mid, 0) AS no_mid, coalesce(a.mid_reads, 0) AS mid_reads FROM (SELECT pool, sum(n) AS tot_reads FROM col GROUP BY pool) t LEFT JOIN (SELECT pool, sum(CASE WHEN patient IS NULL THEN n ELSE 0 END) AS no_mid, sum(CASE WHEN patient IS NOT NULL THEN n ELSE 0 END) AS mid_reads FROM asg GROUP BY pool) a USING (pool)")
def pool_mid_coverage(spark: SparkSession, d: str) -> DataFrame:
    return demux.pool_mid_coverage(demux.collapse(_filtered(spark, d)), _assigned(spark, d))


@_query("SELECT pool, patient, seq, n, short, strand, pos5 FROM mt WHERE strand IS NOT NULL")
def primer_5prime(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d).where("strand is not null").select("pool", "patient", "seq", "n", "short", "strand", "pos5")


@_query("SELECT pool, patient, seq, n, pos3, trimmed FROM mt WHERE strand = 'fw' AND trimmed IS NOT NULL")
def primer_trim_fw(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d).where("strand = 'fw' and trimmed is not null").select("pool", "patient", "seq", "n", "pos3", "trimmed")


@_query("SELECT pool, patient, seq, n, pos3, trimmed FROM mt WHERE strand = 'rv' AND trimmed IS NOT NULL")
def primer_trim_rv(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d).where("strand = 'rv' and trimmed is not null").select("pool", "patient", "seq", "n", "pos3", "trimmed")


@_query("SELECT * FROM pc")
def primer_counters(spark: SparkSession, d: str) -> DataFrame:
    return demux.primer_counters(_matched(spark, d))


@_query("SELECT patient, sum(fw_fn_match) AS fw, sum(rv_fn_match) AS rv FROM pc GROUP BY patient")
def primer_by_patient(spark: SparkSession, d: str) -> DataFrame:
    return demux.primer_by_patient(demux.primer_counters(_matched(spark, d)))


@_query("SELECT pool, sum(tot_reads) AS mid_reads, sum(fn_reads) AS primer_reads, round(sum(fn_reads) * 100 / sum(tot_reads), 4) AS pct FROM pc GROUP BY pool")
def pool_primer_yield(spark: SparkSession, d: str) -> DataFrame:
    return demux.pool_primer_yield(demux.primer_counters(_matched(spark, d)))


@_query("SELECT * FROM hp")
def hap_collapse(spark: SparkSession, d: str) -> DataFrame:
    return _haplotypes(spark, d)


@_query("SELECT pool, patient, strand, sum(nr) AS reads, count(*) AS hpls, round(sum(length(seq) * nr) / sum(nr), 1) AS len_mean FROM hp GROUP BY ALL")
def hap_file_stats(spark: SparkSession, d: str) -> DataFrame:
    return demux.haplotype_files(_haplotypes(spark, d))


@_query("SELECT pool, patient, strand, length(seq) AS len, sum(nr) AS reads FROM hp GROUP BY ALL HAVING sum(nr) >= 10")
def hap_len_table(spark: SparkSession, d: str) -> DataFrame:
    return demux.haplotype_lengths(_haplotypes(spark, d))


@_query("SELECT pool, patient, strand, first(seq ORDER BY nr DESC, seq) AS seq, max(nr) AS nr FROM hp GROUP BY ALL")
def hap_master(spark: SparkSession, d: str) -> DataFrame:
    return demux.top_haplotype(_haplotypes(spark, d))


@_query("SELECT * FROM ab")
def hap_abundance_filter(spark: SparkSession, d: str) -> DataFrame:
    return hap.abundant(_haplotypes(spark, d))


@_query("SELECT * FROM sj")
def strand_full_outer(spark: SparkSession, d: str) -> DataFrame:
    return hap.strand_full_outer(hap.abundant(_haplotypes(spark, d)))


@_query("SELECT * FROM cs")
def strand_intersect(spark: SparkSession, d: str) -> DataFrame:
    return _consensus(spark, d)


@_query("SELECT pool, patient, seq FROM sj")
def strand_union(spark: SparkSession, d: str) -> DataFrame:
    return hap.strand_join(hap.abundant(_haplotypes(spark, d))).select("pool", "patient", "seq")


@_query("""SELECT pool, patient, round(sum(least(fw / greatest(sf, 1), rv / greatest(sr, 1))) * 100, 4) AS ovrlp, round(sum(CASE WHEN fw > 0 AND rv > 0 THEN fw + rv ELSE 0 END) * 100 / sum(fw + rv), 4) AS common,
 sum(CASE WHEN fw > 0 AND rv > 0 THEN fw + rv ELSE 0 END) AS fn_rd FROM (SELECT *, sum(fw) OVER (PARTITION BY pool, patient) AS sf, sum(rv) OVER (PARTITION BY pool, patient) AS sr FROM sj) GROUP BY ALL""")
def strand_overlap(spark: SparkSession, d: str) -> DataFrame:
    return hap.overlap(hap.strand_join(hap.abundant(_haplotypes(spark, d))))


@_query("SELECT * FROM me")
def strand_metrics(spark: SparkSession, d: str) -> DataFrame:
    return hap.strand_metrics(_haplotypes(spark, d))


@_query("SELECT * FROM it")
def intersect_totals(spark: SparkSession, d: str) -> DataFrame:
    return hap.metric_totals(hap.strand_metrics(_haplotypes(spark, d)))


@_query("SELECT pool, patient, aln, nr, nm FROM nm")
def hap_diffs_to_master(spark: SparkSession, d: str) -> DataFrame:
    return hap.with_master(_aligned(spark, d)).drop("master")


@_query("SELECT * FROM nh")
def hap_ranked_names(spark: SparkSession, d: str) -> DataFrame:
    return hap.name_haplotypes(_aligned(spark, d))


@_query("SELECT pool, patient, pos, bool_or(base = '-') AS any_gap, bool_and(base = '-') AS all_gap FROM cl GROUP BY ALL HAVING bool_or(base = '-')")
def gap_columns(spark: SparkSession, d: str) -> DataFrame:
    return hap.gap_columns(_aligned(spark, d))


@_query("""SELECT pool, patient, pos, kind, CASE WHEN kind = 2 THEN i ELSE g END AS reads, round(CASE WHEN kind = 2 THEN i ELSE g END * 100 / (i + g), 4) AS pct FROM
 (SELECT c.pool, c.patient, pos, c.g, c.i, CASE WHEN substr(ms.master, CAST(pos AS INT), 1) = '-' THEN 2 WHEN g > 0 THEN 3 ELSE 1 END AS kind FROM
 (SELECT pool, patient, pos, sum(CASE WHEN base = '-' THEN nr ELSE 0 END) AS g, sum(CASE WHEN base <> '-' THEN nr ELSE 0 END) AS i FROM cl GROUP BY ALL) c JOIN ms USING (pool, patient)) WHERE kind > 1""")
def indel_profile(spark: SparkSession, d: str) -> DataFrame:
    return hap.indel_profile(_aligned(spark, d))


def _funnel(spark: SparkSession, d: str) -> DataFrame:
    kept = hap.abundant(_haplotypes(spark, d))
    filt = kept.groupBy("pool").agg(F.sum("nr").alias("filt"))
    ints = hap.consensus(hap.strand_join(kept)).groupBy("pool").agg(F.sum("reads").alias("ints"))
    return yields.join_counts([yields.read_counts(quality.by_read(derived_reads(spark, d))), yields.match_counts(_matched(spark, d)), filt, ints])


@_query("SELECT * FROM fu")
def yield_funnel(spark: SparkSession, d: str) -> DataFrame:
    return _funnel(spark, d)


@_query("""SELECT pool, stage_no, stage, n, round(n * 100 / lag(n) OVER w, 2) AS step_pct, round(n * 100 / first_value(n) OVER w, 2) AS raw_pct FROM
 (SELECT pool, unnest([0, 1, 2, 3, 4, 5, 6]) AS stage_no, unnest(['raw', 'flash', 'fq30', 'mid', 'primer', 'filt', 'ints']) AS stage, unnest([raw, flash, fq30, mid, primer, filt, ints]) AS n FROM fu) WINDOW w AS (PARTITION BY pool ORDER BY stage_no)""")
def yield_step_pct(spark: SparkSession, d: str) -> DataFrame:
    return yields.long_funnel(_funnel(spark, d))


@_query("SELECT pool, patient, sum(reads) AS reads, round(log10(sum(reads)), 6) AS log_reads FROM cs GROUP BY ALL")
def final_coverage_log(spark: SparkSession, d: str) -> DataFrame:
    final = _consensus(spark, d).groupBy("pool", "patient").agg(F.sum("reads").alias("reads"))
    return yields.coverage_log(final)


@_query("SELECT * FROM fs")
def fasta_summary(spark: SparkSession, d: str) -> DataFrame:
    return hap.fasta_summary(hap.name_haplotypes(_aligned(spark, d)))


@_query("SELECT coalesce(pool, 'TOTAL') AS pool, " + ", ".join(f"round(quantile_cont(reads, {q}), 6) AS {n}" for q, n in ((0, "min"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1, "max"))) + ", round(avg(reads), 4) AS mean FROM fs GROUP BY ROLLUP (pool)")
def coverage_summary(spark: SparkSession, d: str) -> DataFrame:
    return hap.coverage_summary(hap.fasta_summary(hap.name_haplotypes(_aligned(spark, d))))


@_query("SELECT pool, seq, count(DISTINCT patient) AS patients, string_agg(DISTINCT printf('%03d', patient) || '|' || name, ';' ORDER BY printf('%03d', patient) || '|' || name) AS ids FROM nh GROUP BY pool, seq HAVING count(DISTINCT patient) > 1")
def hap_equivalencies(spark: SparkSession, d: str) -> DataFrame:
    return hap.equivalencies(hap.name_haplotypes(_aligned(spark, d)))


def _called(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(distances, calls): types are the masters of the first four patients of a pool."""
    aligned = _aligned(spark, d)
    masters = hap.with_master(aligned).where("patient < 4").select("pool", F.char((F.lit(65) + F.col("patient")).cast("long")).alias("type"), F.col("master").alias("aln")).distinct()
    distances = hap.genotype_distances(aligned, masters)
    return distances, hap.genotype_call(distances)


def _typed(spark: SparkSession, d: str) -> DataFrame:
    distances, calls = _called(spark, d)
    own = distances.groupBy("key", "pool", "patient").agg(F.max("nr").alias("nr"))
    return own.join(calls.select("key", "type"), "key").groupBy("pool", "patient", "type").agg(F.sum("nr").alias("nr"))


@_query("SELECT concat_ws(':', pool, CAST(patient AS VARCHAR), aln) AS key, type, distance AS least, nxt AS next, CASE WHEN distance > 0 THEN round(nxt / distance, 6) END AS ratio FROM gr WHERE k = 1")
def genotype_calls(spark: SparkSession, d: str) -> DataFrame:
    return _called(spark, d)[1]


@_query("SELECT * FROM gp")
def genotype_pivot(spark: SparkSession, d: str) -> DataFrame:
    return hap.genotype_pivot(_typed(spark, d), _TYPES)


@_query("SELECT pool, " + ", ".join(f"round(avg({t}_pct), 2) AS {t}_mean" for t in _TYPES) + " FROM gp GROUP BY pool")
def genotype_means(spark: SparkSession, d: str) -> DataFrame:
    return hap.genotype_means(hap.genotype_pivot(_typed(spark, d), _TYPES), _TYPES)


@_query("SELECT pool, patient, string_agg(type || ' ' || (p // 10) || '.' || (p % 10) || '%', '; ' ORDER BY p DESC, type) AS mix FROM (SELECT *, CAST(round(nr * 1000 / sum(nr) OVER (PARTITION BY pool, patient)) AS INT) AS p FROM ty) GROUP BY ALL")
def genotype_mix(spark: SparkSession, d: str) -> DataFrame:
    return hap.genotype_mix(_typed(spark, d))


@_query("SELECT pool, patient, string_agg(base, '' ORDER BY pos) AS aln, nr FROM (SELECT pool, patient, aln AS whole, nr, unnest(range(1, length(aln) + 1)) AS pos, unnest(string_split(aln, '')) AS base FROM al WHERE aln LIKE '%-%') c JOIN (SELECT pool, patient, pos FROM (SELECT pool, patient, unnest(range(1, length(aln) + 1)) AS pos, unnest(string_split(aln, '')) AS base FROM al WHERE aln LIKE '%-%') GROUP BY ALL HAVING NOT bool_and(base = '-')) k USING (pool, patient, pos) GROUP BY pool, patient, whole, nr")
def allgap_columns(spark: SparkSession, d: str) -> DataFrame:
    """Of the haplotypes with a deletion alone, the alignments without columns that are gaps in all of them."""
    return hap.drop_gap_columns(_aligned(spark, d).where("aln like '%-%'"))


@_query("SELECT pool, patient, seq, nr, levenshtein(seq, master) AS nm FROM eh")
def consensus_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Differences to the master in a multiple alignment of each sample's consensus haplotypes, whose sequences are the alignment's without gaps."""
    star = alignment.star_alignment(_consensus(spark, d).select("pool", "patient", "seq", F.col("reads").alias("nr")))
    named = hap.with_master(star.select("pool", "patient", "aln", "nr"))
    return named.select("pool", "patient", F.replace("aln", F.lit("-"), F.lit("")).alias("seq"), "nr", "nm")


@_query("SELECT pool, patient, printf('Hpl.%d.%04d', nm, row_number() OVER (PARTITION BY pool, patient, nm ORDER BY nr DESC, seq)) AS name, nr AS reads, round(nr * 100 / sum(nr) OVER (PARTITION BY pool, patient), 2) AS freq, nm, seq FROM (SELECT *, levenshtein(seq, master) AS nm FROM eh)")
def consensus_names(spark: SparkSession, d: str) -> DataFrame:
    """The consensus that passed the filters and both strands, named by its differences."""
    return hap.name_haplotypes(_consensus(spark, d).select("pool", "patient", F.col("seq").alias("aln"), F.col("reads").alias("nr")))


@_query("SELECT pool, patient, seq, nr, mismatches, gaps, CASE WHEN gaps > 0 THEN 1 ELSE 0 END AS runs FROM ea")
def consensus_mismatches(spark: SparkSession, d: str) -> DataFrame:
    """Each consensus haplotype's global alignment with its sample's master; the SQL tries every place of the one gap that it may have."""
    found = alignment.master_alignments(_consensus(spark, d).select("pool", "patient", "seq", F.col("reads").alias("nr")))
    return found.select("pool", "patient", "seq", "nr", "mismatches", "gaps", "runs")


@_query("SELECT * FROM cn")
def consensus_names_aligned(spark: SparkSession, d: str) -> DataFrame:
    """The consensus named by the mismatches of its alignments, gaps not counted."""
    return _consensus_names(spark, d)


def _consensus_names(spark: SparkSession, d: str) -> DataFrame:
    found = alignment.master_alignments(_consensus(spark, d).select("pool", "patient", "seq", F.col("reads").alias("nr")))
    return hap.ranked_names(found.select("pool", "patient", F.col("seq").alias("aln"), "nr", F.col("mismatches").alias("nm")))


@_query("SELECT pool, patient, count(*) AS hpl, max(nm) AS max_mut, max(freq) AS master_pct, sum(reads) AS reads FROM cn GROUP BY ALL")
def consensus_summary(spark: SparkSession, d: str) -> DataFrame:
    return hap.fasta_summary(_consensus_names(spark, d))


@_query("SELECT pool, seq, count(DISTINCT patient) AS patients, string_agg(DISTINCT printf('%03d', patient) || '|' || name, ';' ORDER BY printf('%03d', patient) || '|' || name) AS ids FROM cn GROUP BY pool, seq HAVING count(DISTINCT patient) > 1")
def consensus_equivalencies(spark: SparkSession, d: str) -> DataFrame:
    """Consensus haplotypes that patients share."""
    return hap.equivalencies(_consensus_names(spark, d))


def _strands(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "strands", lambda: alignment.aligned_strands(_haplotypes(spark, d)))


@_query("SELECT pool, patient, seq, fw, rv, fw + rv AS nr, CAST(width AS INT) AS width FROM sj JOIN aw USING (pool, patient) WHERE fw > 0 AND rv > 0")
def aligned_intersect(spark: SparkSession, d: str) -> DataFrame:
    """Haplotypes of both strands, met by their rows of one multiple alignment of each sample, with its width."""
    both = alignment.aligned_consensus(_strands(spark, d))
    return both.select("pool", "patient", "seq", "fw", "rv", "nr", F.length("aln").alias("width"))


@_query("SELECT pool, patient, sum((width - length(seq)) * (fw + rv)) AS gap_reads FROM sj JOIN aw USING (pool, patient) WHERE fw > 0 AND rv > 0 GROUP BY pool, patient HAVING sum(width - length(seq)) > 0")
def consensus_indels(spark: SparkSession, d: str) -> DataFrame:
    """Reads with a gap, summed over the columns of the consensus' indel profile: those with a deletion, or without an insertion that others have.

    The SQL counts missing bases, wherever they are placed and whatever the master.
    """
    both = alignment.aligned_consensus(_strands(spark, d)).select("pool", "patient", "aln", "nr")
    totals = both.groupBy("pool", "patient").agg(F.sum("nr").alias("total"))
    gaps = F.when(F.col("kind") == 3, F.col("reads")).otherwise(F.col("total") - F.col("reads"))
    return hap.indel_profile(both).join(totals, ["pool", "patient"]).groupBy("pool", "patient").agg(F.sum(gaps).alias("gap_reads"))


@_query("SELECT amplicon AS \"Ampl.Nm\", max(fw_pos + length(fw_primer)) AS \"FW.tpos\", max(rv_pos - length(rv_primer)) AS \"RV.tpos\" FROM sh GROUP BY amplicon")
def primer_positions(spark: SparkSession, d: str) -> DataFrame:
    used = dimensions.used_primers(dimensions.inner_positions(primer_sheet(spark, d)), sample_sheet(spark, d))
    return used.select("`Ampl.Nm`", "`FW.tpos`", "`RV.tpos`")


@_query("SELECT pool, expected AS merged_length, raw AS raw_length FROM ex")
def expected_lengths(spark: SparkSession, d: str) -> DataFrame:
    tables = sample_sheet(spark, d), primer_sheet(spark, d)
    plain, raw = dimensions.expected_length(*tables), dimensions.expected_length(*tables, raw=True)
    return plain.join(raw.withColumnRenamed("expected", "raw_length"), "pool").withColumnRenamed("expected", "merged_length")


@_query("SELECT pool, coalesce(patient, -1) AS patient, sum(n) AS reads FROM asg GROUP BY ALL")
def mid_counts_by_sheet(spark: SparkSession, d: str) -> DataFrame:
    """Tags assigned by the tables of samples, tags and primers, written as TSV and read again."""
    tables = []
    for name, table, schema in (("samples", sample_sheet(spark, d), sequences.SAMPLES), ("tags", tag_sheet(spark, d), None), ("primers", primer_sheet(spark, d), sequences.PRIMERS)):
        path = _folder(spark, f"sheet-{name}")
        sequences.write_tsv(table, path)
        tables.append(sequences.read_tsv(spark, path, schema or table.schema))
    resolved = dimensions.resolved_samples(*tables).withColumn("patient", F.col("patient").cast("bigint"))
    return demux.mid_counts(demux.assign_mid(demux.collapse(_filtered(spark, d)), resolved))


@_query("SELECT patient, amplicon, reads, pool, region FROM (SELECT patient, 'AMP.' || pool AS amplicon, sum(reads) AS reads FROM cs GROUP BY ALL) JOIN (SELECT pool, patient, amplicon, region FROM sh) USING (patient, amplicon)")
def consensus_by_pool(spark: SparkSession, d: str) -> DataFrame:
    """Reads by patient and amplicon with the pool of the first such sample and the amplicon's region."""
    results = _consensus(spark, d).groupBy("patient", F.concat(F.lit("AMP."), "pool").alias("amplicon")).agg(F.sum("reads").alias("reads"))
    return dimensions.with_region(dimensions.pool_of(results, sample_sheet(spark, d)), primer_sheet(spark, d)).select("patient", "amplicon", "reads", "pool", "region")


@_query("SELECT region, count(*) AS n, " + ", ".join(f"round(quantile_cont(fn_reads, {q}), 6) AS \"{n}\"" for q, n in ((0, "min"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1, "max"))) + " FROM pc JOIN (SELECT DISTINCT pool, region FROM sh) USING (pool) GROUP BY region")
def region_summary(spark: SparkSession, d: str) -> DataFrame:
    counters = demux.primer_counters(_matched(spark, d)).withColumn("amplicon", F.concat(F.lit("AMP."), "pool"))
    return dimensions.five_numbers(dimensions.with_region(counters, primer_sheet(spark, d)), "region", "fn_reads")


def _read_back(spark: SparkSession, path: str) -> DataFrame:
    back = sequences.read_fastq(spark, path)
    return back.select(F.regexp_extract("file", "pool=([^/]+)/", 1).alias("pool"), F.col("read_id").cast("long").alias("read_id"), "seq", "qual")


@_query("SELECT pool, read_id, seq, qual FROM ok")
def fastq_gzip(spark: SparkSession, d: str) -> DataFrame:
    """The filtered reads, written as gzipped FASTQ in a folder for each pool and read again."""
    path = _folder(spark, "fastq")
    sequences.write_fastq(_filtered(spark, d), path)
    return _read_back(spark, path)


@_query("SELECT pool, read_id, seq, qual FROM reads")
def fastq_plain(spark: SparkSession, d: str) -> DataFrame:
    """All reads, written as plain FASTQ and read again in splits."""
    path = _folder(spark, "fastq")
    sequences.write_fastq(derived_reads(spark, d), path, compression="none")
    return _read_back(spark, path)


@_query("SELECT pool, patient, name, reads, freq, seq FROM nh")
def fasta_haplotypes(spark: SparkSession, d: str) -> DataFrame:
    """Named haplotypes, written as FASTA in folders by pool and patient and read again."""
    path = _folder(spark, "fasta")
    sequences.write_fasta(hap.name_haplotypes(_aligned(spark, d)), path)
    back = sequences.read_haplotypes(spark, path)
    return back.select(F.regexp_extract("file", "pool=([^/]+)/", 1).alias("pool"), F.regexp_extract("file", "patient=([^/]+)/", 1).cast("long").alias("patient"), "name", "reads", "freq", "seq")


@_query("SELECT a.pool, coalesce(CAST(a.patient AS VARCHAR), '0') AS mid, r.read_id, r.seq FROM ok r JOIN asg a ON a.pool = r.pool AND a.seq = r.seq")
def fasta_by_mid(spark: SparkSession, d: str) -> DataFrame:
    """Reads with their tag, 0 for none, written as FASTA in folders by pool and tag and read again."""
    path = _folder(spark, "reads-fasta")
    tagged = _filtered(spark, d).select("pool", "seq", "read_id").join(_assigned(spark, d), ["pool", "seq"]).withColumn("mid", F.coalesce(F.col("patient").cast("string"), F.lit("0")))
    sequences.write_reads_fasta(tagged, path)
    back = sequences.read_fasta(spark, path)
    return back.select(F.regexp_extract("file", "pool=([^/]+)/", 1).alias("pool"), F.regexp_extract("file", "mid=([^/]+)/", 1).alias("mid"), F.col("name").cast("long").alias("read_id"), "seq")


@_query("SELECT CAST(row_number() OVER (ORDER BY pool) AS INT) AS line_no, concat_ws(' ', rpad(pool, 5, ' '), lpad(raw, w1, ' '), lpad(kept, w2, ' ')) AS value FROM (SELECT pool, CAST(count(*) AS VARCHAR) AS raw, CAST(count(*) FILTER (below / width <= 0.05) AS VARCHAR) AS kept FROM rq GROUP BY pool), (SELECT CAST(greatest(3, max(length(CAST(a AS VARCHAR)))) AS INT) AS w1, CAST(greatest(4, max(length(CAST(b AS VARCHAR)))) AS INT) AS w2 FROM (SELECT count(*) AS a, count(*) FILTER (below / width <= 0.05) AS b FROM rq GROUP BY pool))")
def filter_report(spark: SparkSession, d: str) -> DataFrame:
    """The filter's counts as a text report, written and read again; its lines after the heading."""
    path = _folder(spark, "report")
    table = quality.q30_counts(derived_reads(spark, d)).select("pool", "raw", "kept")
    sequences.write_report(table, path, ["pool"], "Filter")
    lines = spark.read.text(path).where("value like 'POOL%'")
    return lines.select(F.row_number().over(Window.orderBy("value")).cast("int").alias("line_no"), "value")


def _mate_files(spark: SparkSession, d: str) -> str:
    """R1 and R2 files of the run by pool and lane, written once per call."""
    path = _folder(spark, "mates")
    lane = F.format_string("%03d", (F.col("read_id") % 8 + 1).cast("int"))
    one, two = (df.withColumn("name", F.concat("pool", F.lit("_S1_L"), lane, F.lit(f"_{m}_001.fastq"))) for df, m in zip(derived_pairs(spark, d), ("R1", "R2"), strict=True))
    sequences.write_named_fastq(one.unionByName(two), path)
    return path


@_query("SELECT * FROM mg")
def fastq_mates_merged(spark: SparkSession, d: str) -> DataFrame:
    """Mates paired by their place in R1 and R2 files of one name, and merged."""
    mates = sequences.read_mates(spark, _mate_files(spark, d))
    return merge.merge_mates(mates).withColumn("read_id", F.col("read_id").cast("long"))


@_query("SELECT pool || '_S1_L' || printf('%03d', read_id % 8 + 1) || '_R_001.fastq' AS pair_of, pool, count(*) FILTER (late = 2) AS pairs, count(*) FILTER (late = 1) AS only_r1, 0 AS only_r2, 0 AS other_ids FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY pool, read_id % 8 ORDER BY read_id DESC) <= 5 THEN 1 ELSE 2 END AS late FROM reads) GROUP BY ALL")
def fastq_mate_report(spark: SparkSession, d: str) -> DataFrame:
    """Files of second mates that lack the last five records of the first ones."""
    one, two = derived_pairs(spark, d)
    named = lambda df, m: df.withColumn("name", F.concat("pool", F.format_string(f"_S1_L%03d_{m}_001.fastq", (F.col("read_id") % 8 + 1).cast("int"))))
    last = Window.partitionBy("name").orderBy(F.desc("read_id"))
    late = named(two, "R2").select("name", "read_id").withColumn("_n", F.row_number().over(last)).where("_n <= 5").select("name", "read_id")  # five rows a file
    cut = named(two, "R2").select("pool", "name", "read_id", "seq", "qual").join(F.broadcast(late), ["name", "read_id"], "left_anti").select("pool", "name", "read_id", "seq", "qual")
    path = _folder(spark, "mates")
    sequences.write_named_fastq(named(one, "R1").unionByName(cut), path)
    return sequences.mate_report(sequences.read_mates(spark, path))


@_query("SELECT * FROM fu", rq="SELECT *, length(seq) AS width, length(qual) - length(regexp_replace(qual, '[!->]', '', 'g')) AS below FROM mg WHERE seq IS NOT NULL",
        fu=_STEPS["fu"].replace("SELECT pool, count(*) AS raw, count(*) AS flash FROM reads", "SELECT pool, count(*) AS raw, count(seq) AS flash FROM mg"))
def run_funnel(spark: SparkSession, d: str) -> DataFrame:
    """A whole run, from R1 and R2 files to the funnel: pairing, merging, Q30 filter, tags, primers, abundance, both strands."""
    def merged() -> DataFrame:
        return merge.merge_mates(sequences.read_mates(spark, _mate_files(spark, d)))

    every = once(spark, d, "run-merged", merged)
    scored = quality.by_read(every.where("seq is not null"))
    tagged = demux.assign_mid(demux.collapse(scored.where("fraction_below <= 0.05")), samples(spark, d))
    matched = once(spark, d, "run-matched", lambda: demux.match_primers(tagged, samples(spark, d)))
    kept = hap.abundant(demux.collapse_haplotypes(matched))
    report = merge.merge_report(every).select("pool", "raw", F.col("extended").alias("flash"))
    passed = scored.groupBy("pool").agg(F.count_if(F.col("fraction_below") <= 0.05).alias("fq30"))
    filt = kept.groupBy("pool").agg(F.sum("nr").alias("filt"))
    ints = hap.consensus(hap.strand_join(kept)).groupBy("pool").agg(F.sum("reads").alias("ints"))
    return yields.join_counts([report, passed, yields.match_counts(matched), filt, ints])


@_query("SELECT pool, read_id, seq, qual FROM reads")
def fastq_blocks(spark: SparkSession, d: str) -> DataFrame:
    """All reads, written by the FASTQ data source as block gzip and read by it in ranges of a part's size."""
    fastq_source.register(spark)
    path = _folder(spark, "fastq-blocks")
    named = derived_reads(spark, d).select(F.concat_ws(":", "pool", "read_id").alias("read_id"), "seq", "qual")
    named.write.format("fastq").mode("append").option("compression", "bgzf").save(path)
    back = spark.read.format("fastq").schema("read_id string, seq string, qual string").option("splitBytes", 1 << 20).load(path)
    return back.select(F.substring_index("read_id", ":", 1).alias("pool"), F.substring_index("read_id", ":", -1).cast("long").alias("read_id"), "seq", "qual")


@_query("SELECT * FROM qp")
def qc_pos_over_runs(spark: SparkSession, d: str) -> DataFrame:
    """The profile by position from stored counts, after files were added in two runs, some of them twice."""
    path, store = _folder(spark, "runs"), _folder(spark, "counts")
    lane = F.concat("pool", F.format_string("_S1_L%03d_flash.fastq", (F.floor(F.col("read_id") / 2) % 4 + 1).cast("int")))
    sequences.write_named_fastq(derived_reads(spark, d).withColumn("name", lane), path)
    files = [f"{path}/name={pool}_S1_L00{k}_flash.fastq" for k in range(1, 5) for pool in ("POOLA", "POOLB")]
    profiles.add_files(spark, store, files[:3])
    profiles.add_files(spark, store, files)
    return profiles.stored_profile(spark, store)


@_query("SELECT a.pool, coalesce(CAST(a.patient AS VARCHAR), '0') AS mid, r.read_id, r.seq FROM ok r JOIN asg a ON a.pool = r.pool AND a.seq = r.seq")
def stream_by_mid(spark: SparkSession, d: str) -> DataFrame:
    """Reads that arrive in files, demultiplexed by a stream into FASTA by batch, pool and tag, and read again."""
    source, out = _folder(spark, "arriving"), _folder(spark, "stream-fasta")
    derived_reads(spark, d).select("pool", "read_id", "seq", "qual").write.parquet(source)
    stream_demux.start_demux(ingest.stream_reads(spark, source, 4), samples(spark, d), out, _folder(spark, "stream-state")).awaitTermination()
    back = sequences.read_fasta(spark, out)
    return back.select(F.regexp_extract("file", "pool=([^/]+)/", 1).alias("pool"), F.regexp_extract("file", "mid=([^/]+)/", 1).alias("mid"), F.col("name").cast("long").alias("read_id"), "seq")


def _written_report(spark: SparkSession, table: DataFrame, title: str) -> DataFrame:
    """A report by pool, written as text and read again; its lines after the heading."""
    path = _folder(spark, "report")
    sequences.write_report(table, path, ["pool"], title)
    lines = spark.read.text(path).where("value like 'POOL%' or value like 'TOTAL%'")
    return lines.select(F.row_number().over(Window.orderBy("value")).cast("int").alias("line_no"), "value")


@_query(_report("fu", "pool", yields.STAGES))
def yield_report(spark: SparkSession, d: str) -> DataFrame:
    """The funnel as a text report."""
    return _written_report(spark, _funnel(spark, d).select("pool", *yields.STAGES), "Global yield")


@_query(_report("it", "pool", ("all", "lowf", "in", "unq", "com", "lowf_pct", "in_pct", "unq_pct", "com_pct")))
def intersect_report(spark: SparkSession, d: str) -> DataFrame:
    """The intersection's totals as a text report."""
    return _written_report(spark, hap.metric_totals(hap.strand_metrics(_haplotypes(spark, d))), "Intersection of the strands")
