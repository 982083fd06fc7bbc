"""Mixing sources to target weights by entropy balancing, on DataFrame functions only.

Each source's documents get rates exp(a * size), cut at MOST, with the one
multiplier ``a`` for which the expected words meet the source's target: the
solution of least relative entropy under that constraint.  The multipliers are
the dual's variables; Newton's method finds all of them together, one
aggregation over (source, size) counts per iteration.  Rates become copies by
keeping their whole part and giving one copy more to the documents first in a
hashed order, up to the words that are still missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampliq.llm.common import count_words, text_or_empty, written

WEIGHTS = (5.0, 2.0, 1.0)
#: No document is taken more often, and no source's target is larger than so many times its size.
MOST = 3
NEWTON_STEPS, BINS = 24, 4096
#: Exponents beyond this aren't told apart; keeps exp() finite.
FAR = 40.0


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, size, n): weights by rank of the source's name, nulls last.

    Water-filling: sources whose share passes MOST times their size stop there,
    lowest first, and what is over goes to the others by weight.  One row per
    source goes through one window.
    """
    totals = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    every = Window.partitionBy(F.lit(0))
    named = totals.withColumn("_rank", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
    named = named.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int")))
    named = named.withColumn("_cap", MOST * F.col("source_size")).withColumn("_level", F.col("_cap") / F.col("weight"))
    upward = every.orderBy("_level", "_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = named.withColumns({"_caps": F.sum("_cap").over(upward), "_left": F.sum("weight").over(every) - F.sum("weight").over(upward), "_all": F.sum("source_size").over(every)})
    #: The sources up to here stop if the level that the rest would reach isn't below their own.
    named = named.withColumn("_before", F.coalesce(F.lag(F.col("_caps")).over(every.orderBy("_level", "_rank")), F.lit(0)))
    named = named.withColumn("_water", (F.col("_all") - F.col("_before")) / (F.col("_left") + F.col("weight")))
    named = named.withColumn("_stops", F.col("_water") >= F.col("_level"))
    free = named.where(~F.col("_stops")).agg(F.min(F.struct("_level", "_rank", "_water"))["_water"].alias("_share"))
    named = named.crossJoin(F.broadcast(free))  # one row
    target = F.when(F.col("_stops") | F.col("_share").isNull(), F.col("_cap").cast("double")).otherwise(F.col("_share") * F.col("weight"))
    return named.select("source", "source_size", target.alias("target"))


def _rate(a: Column, size: Column, scale: Column) -> Column:
    return F.least(F.lit(float(MOST)), F.exp(F.least(F.lit(FAR), F.greatest(F.lit(-FAR), a * size / scale))))


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def multipliers(sizes: DataFrame, targets: DataFrame, steps: int = NEWTON_STEPS) -> DataFrame:
    """(source, scale, a, target, source_size): Newton on the dual, kept inside a bracket.

    Sums are taken as decimals, which add up alike in any order, so that reruns
    agree.  A step that would leave the bracket becomes a bisection.
    """
    scale = sizes.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.greatest(F.sum(F.when(F.col("size") > 0, F.col("n"))), F.lit(1))).alias("scale"))
    state = targets.join(scale.withColumnRenamed("source", "_s"), _same("source", "_s")).select(
        "source", "source_size", "target", F.greatest(F.coalesce("scale", F.lit(1.0)), F.lit(1.0)).alias("scale"), F.lit(0.0).alias("a"), F.lit(-FAR).alias("low"), F.lit(FAR).alias("high"))
    state = written(state, "mix-state")
    exact = lambda x: F.sum(x.cast("decimal(30,6)")).cast("double")
    for _ in range(steps):
        rows = sizes.select(F.col("source").alias("_s"), "size", "n").join(state, _same("_s", "source"))
        rate = _rate(F.col("a"), F.col("size"), F.col("scale"))
        moment = F.col("n") * F.col("size") * rate
        sums = rows.groupBy("_s").agg(exact(moment).alias("_f"), exact(F.when(rate < MOST, moment * F.col("size") / F.col("scale")).otherwise(0.0)).alias("_d"))
        stepped = state.join(sums, _same("source", "_s"), "left").drop("_s")
        over = F.col("_f") - F.col("target")
        stepped = stepped.withColumn("_high", F.when(over > 0, F.col("a")).otherwise(F.col("high"))).withColumn("_low", F.when(over < 0, F.col("a")).otherwise(F.col("low")))
        newton = F.when(F.col("_d") > 0, F.col("a") - over / F.col("_d"))
        inside = (newton > F.col("_low")) & (newton < F.col("_high"))
        moved = F.when(over == 0, F.col("a")).when(inside, newton).otherwise((F.col("_low") + F.col("_high")) / 2)
        state = written(stepped.select("source", "source_size", "target", "scale", F.round(moved, 12).alias("a"), F.col("_low").alias("low"), F.col("_high").alias("high"), F.abs(over).alias("off")), "mix-state")
        worst = state.agg(F.max(F.col("off") / F.greatest("target", F.lit(1.0)))).first()[0]
        state = state.drop("off")
        if worst is None or worst < 1e-7:
            break
    return state.select("source", "source_size", "target", "scale", "a")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """How often the mix takes each document.

    Columns: doc_id, size (words; null text: 0), source_size, target, rate,
    copies (0 to 3), taken (copies * size) and the columns in ``keep``.
    Documents without words get one copy, since they weigh nothing.  Sources may
    be null (a source of its own).  Repeated rows with one id and size share a
    hash and come one after the other, in the order of their texts, so that
    each row has copies of its own and reruns agree; other columns are ignored;
    an empty table gives an empty result.  Every source's taken words miss its target by less than one
    document (if documents with a fractional rate are left to choose from).

    The text is read once and reduced to sizes.  Newton's iterations run on
    counts by source and size, so a hot source is summed before its shuffle.
    The last copies are settled within one of BINS bins of a source; only its
    rows are shuffled.
    """
    sized = docs.select(docs[doc_id].alias("doc_id"), docs[source].alias("source"), count_words(text_or_empty(docs[text])).alias("size"), F.xxhash64(docs[text]).alias("_tie"), *(docs[c].alias(f"keep_{c}") for c in keep if c not in (doc_id, source)))
    sized = written(sized, "mix-sizes")
    sizes = written(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-counts")
    state = multipliers(sizes, source_targets(sizes, weights))
    rated = sized.join(state.withColumnRenamed("source", "_s"), _same("source", "_s"))
    rated = rated.withColumn("rate", F.when(F.col("size") == 0, F.lit(1.0)).otherwise(F.round(_rate(F.col("a"), F.col("size"), F.col("scale")), 9)))
    whole = F.floor("rate").cast("int")
    part = F.col("rate") - F.floor("rate")
    #: A document comes early in the order if its hashed number is small against its fraction.
    hashed = (F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size")).bitwiseAND(F.lit((1 << 40) - 1)) + 1) / float(1 << 40)
    rated = rated.withColumns({"_whole": whole, "_at": F.when((part > 0) & (F.col("size") > 0), hashed / part)})
    rated = rated.withColumn("_bin", F.when(F.col("_at").isNotNull(), F.least(F.lit(BINS - 1), F.floor(F.least(F.col("_at"), F.lit(4.0)) * (BINS // 4)).cast("int"))))
    by_bin = written(rated.groupBy("source", "_bin").agg(F.sum(F.col("_whole") * F.col("size")).alias("_sure"), F.sum(F.when(F.col("_bin").isNotNull(), F.col("size"))).alias("_more"), F.max("target").alias("target")), "mix-bins")
    of_source = by_bin.groupBy("source").agg((F.max("target") - F.sum("_sure")).alias("_missing"))
    upward = Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = by_bin.where(F.col("_bin").isNotNull()).withColumn("_below", F.coalesce(F.sum("_more").over(upward), F.lit(0)))
    bins = bins.join(of_source.withColumnRenamed("source", "_s"), _same("source", "_s"))
    #: One row a source: the bin that reaches the missing words; of those below it all get their copy, of those above none.
    edges = bins.groupBy(F.col("source").alias("_e")).agg(
        F.max(F.when(F.col("_below") < F.col("_missing"), F.col("_bin"))).alias("_edge"), F.max(F.when(F.col("_below") < F.col("_missing"), F.col("_below"))).alias("_below"), F.max("_missing").alias("_missing"))
    placed = rated.drop("_s").join(written(edges, "mix-edges"), _same("source", "_e"), "left").drop("_e")
    in_edge = F.coalesce(F.col("_bin") == F.col("_edge"), F.lit(False))
    settled = placed.where(~in_edge).withColumn("_extra", F.coalesce((F.col("_bin") < F.col("_edge")).cast("int"), F.lit(0)))
    order = Window.partitionBy("source").orderBy("_at", "doc_id", "size", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = placed.where(in_edge).withColumn("_sum", F.col("_below") + F.sum("size").over(order))
    #: The document that passes the mark is taken if that comes nearer to it.
    edge = edge.withColumn("_extra", (F.col("_sum") - F.col("size") / 2 <= F.col("_missing")).cast("int")).drop("_sum")
    both = settled.unionByName(edge).withColumn("copies", F.least(F.lit(MOST), F.col("_whole") + F.col("_extra")))
    return both.select("doc_id", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(F.col(f"keep_{c}").alias(c) for c in keep if c not in (doc_id, source)), *(F.col(c) for c in keep if c == source))
