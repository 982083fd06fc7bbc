"""Quality rules with adaptive thresholds, on DataFrame functions only.

Every document gets counts of its whole text and, from them, integer rates that
ordinary prose has in a natural spread.  For each rate, language and source a
mergeable quantile sketch is kept: counts of its first DIGITS decimal digits, a
grid without an upper end, which add up exactly in any order, also to the
sketches of a language and of the corpus.
Thresholds come from the quantiles of these sketches alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampliq.llm.common import CHARACTER, SPACE, let, text_or_empty, written

SYMBOLS = "#*$%&|<>"
#: Decimal digits of a rate that its cell keeps, the others being 0: rates below 10 ** DIGITS are exact, and each further digit adds 9000 cells.
DIGITS = 4
#: Rate, and by how many lower half-spreads its threshold lies above the median.
RATES = (("odd_rate", 24), ("upper_rate", 20), ("word_length", 14), ("sameness", 10))
#: A group's own threshold weighs as its rows, its language's as this many; so does a language's against the corpus's.
PRIOR = 100


def _repeat_words(words: str) -> Column:
    """Words that lie in eight-word windows found twice or more in the array column ``words``.

    Windows are compared by 64-bit hashes, built by doubling: 1, 2, 4, 8 words.
    """
    w = F.col(words)

    def joined(hashes: Column, step: int) -> Column:
        n = lambda h: F.greatest(F.size(h) - step, F.lit(0))
        return let(hashes, lambda h: F.zip_with(F.slice(h, F.lit(1), n(h)), F.slice(h, F.lit(step + 1), n(h)), lambda a, b: F.xxhash64(a, b)))

    one = F.transform(w, lambda x: F.xxhash64(x))
    return joined(joined(joined(one, 1), 2), 4)


def _covered(windows: str) -> Column:
    """How many words the repeated windows of the array column of hashes cover."""
    h = F.col(windows)
    placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    pairs = let(placed, lambda x: F.zip_with(x, F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))), lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"]))))
    starts = F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))
    return F.aggregate(
        starts, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-8).cast("int").alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(8), p - acc["last"])).cast("long").alias("n"), p.cast("int").alias("last")),
        lambda acc: acc["n"])


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with integer counts of the whole text (null: empty) appended.

    n_text, n_words, word_chars, n_symbols, n_upper, n_letters, n_digits, n_bangs, n_lines,
    n_dup_lines, n_distinct_words, n_repeat_words, all long.
    """
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: x.rlike(CHARACTER))

    def matching(pattern: str) -> Column:
        """Characters that match; patterns cost much less than a translation of each character."""
        return (F.length("_t") - F.length(F.regexp_replace("_t", f"{pattern}+", ""))).cast("long")

    out = docs.withColumn("_t", text_or_empty(text))
    out = out.withColumn("_words", F.array_remove(F.split(F.col("_t"), f"{SPACE}+"), "")).withColumn("_lines", lines)
    out = out.withColumn("_windows", _repeat_words("_words"))
    repeated = F.size(F.array_distinct("_windows")) < F.size("_windows")
    return out.withColumns({
        "n_text": F.length("_t").cast("long"), "n_words": F.size("_words").cast("long"),
        "word_chars": matching(CHARACTER), "n_symbols": matching(f"[{SYMBOLS}]"),
        "n_upper": matching(r"\p{Lu}"), "n_letters": matching(r"\p{L}"), "n_digits": matching("[0-9]"), "n_bangs": matching("!"),
        "n_lines": F.size("_lines").cast("long"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_distinct_words": F.size(F.array_distinct("_words")).cast("long"),
        "n_repeat_words": F.when(repeated, _covered("_windows")).otherwise(F.lit(0)).cast("long"),
    }).drop("_t", "_words", "_lines", "_windows")


def _cell(rate: str) -> Column:
    return F.expr(f"{rate} - {rate} % CAST(rpad('1', greatest(length(CAST({rate} AS string)) - {DIGITS}, 0) + 1, '0') AS bigint)")


def _quantile(hundredths: int) -> Column:
    """The least cell at or below which that share of the rows lies; ``cells`` is sorted."""
    need = F.expr(f"(total * {hundredths} + 99) div 100")
    return F.aggregate(
        "cells", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("at")),
        lambda acc, x: F.struct((acc["seen"] + x["n"]).alias("seen"), F.when(acc["at"].isNull() & (acc["seen"] + x["n"] >= need), x["cell"]).otherwise(acc["at"]).alias("at")),
        lambda acc: acc["at"])


def merged_quantiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """(keys, rate, total, mid, spread) of the sketches (.., rate, cell, n) merged by ``keys``; a sketch is bounded by its grid."""
    cells = sketch.groupBy(*keys, "rate", "cell").agg(F.sum("n").alias("n"))
    merged = cells.groupBy(*keys, "rate").agg(F.array_sort(F.collect_list(F.struct("cell", "n"))).alias("cells"), F.sum("n").alias("total"))
    return merged.select(*keys, "rate", "total", _quantile(50).alias("mid"), _quantile(25).alias("low"), _quantile(5).alias("least")).withColumn(
        "spread", F.greatest(F.lit(1), F.col("mid") - F.col("low"), F.expr("(mid - least) div 3"))).drop("low", "least")


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, rate, most) from sketches (lang, source, rate, cell, n).

    Each sketch proposes its median plus the rate's multiple of its lower
    half-spread, which junk above can't widen; a third of the distance to the
    twentieth quantile counts if it is larger, as where copies make up the
    middle.  A language's threshold is the mean of its own, weighed by its
    rows, and the corpus's, weighed PRIOR; a source's is the mean of its own
    and its language's alike.  A source whose median passes its language's
    threshold is mostly junk and gets that one.
    """
    times = F.create_map(*(x for n, k in RATES for x in (F.lit(n), F.lit(k))))[F.col("rate")]

    def blend(total: str, above: str) -> Column:
        return F.expr(f"({total} * own + {PRIOR} * {above}) div ({total} + {PRIOR})")

    corpus = merged_quantiles(sketch).select("rate", (F.col("mid") + times * F.col("spread")).alias("above"))
    by_lang = merged_quantiles(sketch, "lang").withColumn("own", F.col("mid") + times * F.col("spread")).join(F.broadcast(corpus), "rate")  # one row a rate
    by_lang = by_lang.select(F.col("lang").alias("_lang"), F.col("rate").alias("_rate"), blend("total", "above").alias("above"))
    groups = merged_quantiles(sketch, "lang", "source").join(by_lang, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("rate") == F.col("_rate")))
    groups = groups.withColumn("own", F.col("mid") + times * F.col("spread"))
    return groups.select("lang", "source", "rate", F.when(F.col("mid") > F.col("above"), F.col("above")).otherwise(blend("total", "above")).cast("long").alias("most"))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Base counts, rates, adaptive thresholds per language and source, and the verdict.

    ``base_failed`` is true under 20 words or if repeated eight-word windows
    cover over 30 % of the words.  Of the rest, a document is kept if none of
    its rates passes its group's threshold (see ``thresholds``).  Rates, in
    whole numbers without an upper end: odd_rate, characters of words other than letters, in
    thousandths; upper_rate, capitals of letters, in thousandths; word_length,
    in hundredths of a character; sameness, the power 3/4 of the words to one
    distinct word, in thousandths.

    Null texts count as empty and fail the base; null languages and sources
    form groups of their own; repeated rows are judged each; other columns are
    ignored; an empty table gives an empty result.  The text is read once, the
    counts are written to the shared folder, and what is shuffled are the
    sketches: per group, rate and task at most 10,000 counts, and 9000 for each
    digit more than DIGITS, as where a word is a whole text.  Thresholds are
    compared with the rates as they are, not with their cells.
    """
    plain = docs.select(docs[doc_id].alias("doc_id"), docs[lang].alias("lang"), docs[source].alias("source"), docs[text].alias("text"))
    counts = text_counts(plain)
    whole = lambda part, of, scale: F.expr(f"({scale} * ({part})) div greatest({of}, 1)")
    names = [name for name, _ in RATES]
    counts = counts.withColumns({
        "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
        "odd_rate": whole("word_chars - n_letters", "word_chars", 1000), "upper_rate": whole("n_upper", "n_letters", 1000), "word_length": whole("word_chars", "n_words", 100),
        "sameness": F.floor(F.lit(1000.0) * F.sqrt("n_words") * F.sqrt(F.sqrt("n_words")) / F.greatest("n_distinct_words", F.lit(1))).cast("long"),
    }).select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *names)
    counts = written(counts, "quality-counts")
    cells = counts.where(~F.col("base_failed")).select("lang", "source", F.explode(F.array(*(F.struct(F.lit(n).alias("rate"), _cell(n).alias("cell")) for n in names))).alias("x"))
    sketch = written(cells.groupBy("lang", "source", F.col("x.rate").alias("rate"), F.col("x.cell").alias("cell")).agg(F.count("*").alias("n")), "quality-sketch")
    limits = thresholds(sketch).groupBy(F.col("lang").alias("_lang"), F.col("source").alias("_source")).agg(*(F.max(F.when(F.col("rate") == n, F.col("most"))).alias(f"{n}_max") for n in names))
    joined = counts.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    passed = F.lit(True)
    for n in names:
        passed = passed & F.coalesce(F.col(n) <= F.col(f"{n}_max"), F.lit(False))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & passed).alias("kept"), *names, *(f"{n}_max" for n in names))


#: The same result in DuckDB SQL.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: length(translate(x, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ', '')) > 0) AS ls FROM d),
grams AS (SELECT r, unnest(range(1, len(ws) - 6)) AS p, unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i+7], ' '))) AS g FROM w WHERE len(ws) >= 8),
starts AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS c FROM grams) WHERE c > 1),
cover AS (SELECT r, sum(least(8, coalesce(nxt - p, 8))) AS n FROM (SELECT r, p, lead(p) OVER (PARTITION BY r ORDER BY p) AS nxt FROM starts) GROUP BY r),
c AS (SELECT r, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(list_distinct(ws)) AS BIGINT) AS n_distinct,
        CAST(length(translate(t, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ', '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS BIGINT) AS n_upper, CAST(length(t) - length(regexp_replace(t, '\p{{L}}', '', 'g')) AS BIGINT) AS n_letters FROM w),
k AS (SELECT c.*, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words FROM c LEFT JOIN cover USING (r)),
m AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
        CAST((1000 * (word_chars - n_letters)) // greatest(word_chars, 1) AS BIGINT) AS odd_rate, CAST((1000 * n_upper) // greatest(n_letters, 1) AS BIGINT) AS upper_rate,
        CAST((100 * word_chars) // greatest(n_words, 1) AS BIGINT) AS word_length,
        CAST(floor(1000.0::DOUBLE * sqrt(n_words) * sqrt(sqrt(n_words)) / greatest(n_distinct, 1)) AS BIGINT) AS sameness FROM k),
v AS (SELECT lang, source, unnest([{quoted}]) AS rate, unnest([{names}]) AS v FROM m WHERE NOT base_failed),
x AS (SELECT lang, source, rate, v - v % CAST(rpad('1', CAST(greatest(length(CAST(v AS VARCHAR)) - {digits}, 0) + 1 AS INT), '0') AS BIGINT) AS cell FROM v),
tm(rate, times) AS (VALUES {times}),
qa AS (SELECT rate, quantile_disc(cell, 0.5) AS mid, greatest(1, quantile_disc(cell, 0.5) - quantile_disc(cell, 0.25), (quantile_disc(cell, 0.5) - quantile_disc(cell, 0.05)) // 3) AS spread FROM x GROUP BY rate),
ql AS (SELECT lang, rate, count(*) AS total, quantile_disc(cell, 0.5) AS mid, greatest(1, quantile_disc(cell, 0.5) - quantile_disc(cell, 0.25), (quantile_disc(cell, 0.5) - quantile_disc(cell, 0.05)) // 3) AS spread FROM x GROUP BY ALL),
qg AS (SELECT lang, source, rate, count(*) AS total, quantile_disc(cell, 0.5) AS mid, greatest(1, quantile_disc(cell, 0.5) - quantile_disc(cell, 0.25), (quantile_disc(cell, 0.5) - quantile_disc(cell, 0.05)) // 3) AS spread FROM x GROUP BY ALL),
la AS (SELECT rate, mid + times * spread AS above FROM qa JOIN tm USING (rate)),
ll AS (SELECT ql.lang, rate, (total * (ql.mid + times * ql.spread) + {prior} * above) // (total + {prior}) AS above FROM ql JOIN la USING (rate) JOIN tm USING (rate)),
lg AS (SELECT qg.lang, qg.source, qg.rate, CAST(CASE WHEN qg.mid > above THEN above ELSE (total * (qg.mid + times * qg.spread) + {prior} * above) // (total + {prior}) END AS BIGINT) AS most
       FROM qg JOIN tm ON tm.rate = qg.rate JOIN ll ON ll.rate = qg.rate AND ll.lang IS NOT DISTINCT FROM qg.lang),
lim AS (SELECT lang, source, {limits} FROM lg GROUP BY lang, source)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(NOT base_failed AND {passed}, false) AS kept, {names}, {maxes}
FROM m LEFT JOIN lim ON m.lang IS NOT DISTINCT FROM lim.lang AND m.source IS NOT DISTINCT FROM lim.source
""".format(
    quoted=", ".join(f"'{n}'" for n, _ in RATES), times=", ".join(f"('{n}', {k})" for n, k in RATES), prior=PRIOR, digits=DIGITS,
    limits=", ".join(f"max(most) FILTER (rate = '{n}') AS {n}_max" for n, _ in RATES),
    passed=" AND ".join(f"{n} <= {n}_max" for n, _ in RATES),
    names=", ".join(n for n, _ in RATES), maxes=", ".join(f"{n}_max" for n, _ in RATES))
