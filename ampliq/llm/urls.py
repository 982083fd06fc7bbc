"""URL filters: host and path rules, then gradient-boosted trees on lexical features.

DataFrame functions and Spark ML only.  How often urls of a host suffix are
blocked is counted out of fold for the urls that train the trees, so that no
label is part of its own row's features.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampliq.llm.common import text_or_empty, written

#: (verdict, host suffix, path prefix), as ``host/path``; the longest that fits wins.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Trees, their depth, folds by host, hashed suffix buckets (which bound the table that is broadcast), and rows that the overall share weighs.
TREES, DEPTH, FOLDS, SUFFIXES, PRIOR = 16, 3, 5, 1 << 14, 20
FEATURES = ("f_length", "f_depth", "f_digits", "f_entropy", "f_params", "f_labels", "f_hyphens", "f_suffix", "f_suffix2")


def _lower_ascii(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(pages: DataFrame, url: str = "url") -> DataFrame:
    """Append host and path; both are empty for a null url or one without ``://``.

    ``pages`` has a column named as ``url`` says; its other columns stay, but
    for host, path and _rest, which are overwritten.
    """
    u = text_or_empty(url)
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    return pages.withColumn("_rest", rest).withColumns({
        "host": _lower_ascii(F.regexp_extract("_rest", r"(?s)^[^/?#]*", 0)),
        "path": F.regexp_extract("_rest", r"(?s)^[^/?#]*([^?#]*)", 1)})


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does, as for an empty host.  No null ever comes in: hosts and paths may be empty."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def lexical(urls: DataFrame) -> DataFrame:
    """Lexical features of ``url``, host, path as they are (the trees bin them), and the host's last label and last two; of an empty or null url all are 0 but f_labels, 1.

    Columns named like a feature, suffix or suffix2 are overwritten, others stay.
    """
    u = text_or_empty("url")
    whole = F.concat("host", "path")
    chars = F.filter(F.split(F.lower(whole), ""), lambda c: c != "")
    entropy = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc + _plogp((F.length(whole) - F.length(F.replace(F.lower(whole), c))) / F.greatest(F.length(whole), F.lit(1))))
    digits = F.length(u) - F.length(F.translate(u, "0123456789", ""))
    return urls.withColumns({
        "f_length": F.length(u), "f_depth": F.regexp_count("path", F.lit("/[^/]")).cast("int"), "f_digits": F.round(digits / F.greatest(F.length(u), F.lit(1)), 4), "f_entropy": F.round(entropy, 4),
        "f_params": F.when(u.contains("?"), F.regexp_count(u, F.lit("[?&][^&#]"))).otherwise(0).cast("int"),
        "f_labels": F.size(F.split("host", r"\.")), "f_hyphens": F.length("host") - F.length(F.translate("host", "-", "")),
        "suffix": F.regexp_extract("host", r"([^.]*)$", 1), "suffix2": F.regexp_extract("host", r"([^.]*\.?[^.]*)$", 1)})


def _plogp(p: Column) -> Column:
    return F.when(p > 0, -p * F.log2(p)).otherwise(0.0)


def suffix_shares(seen: DataFrame) -> DataFrame:
    """(bucket, fold, share) from (bucket, fold, label): the share blocked of a suffix's urls in the other folds; fold -1: in all.

    Shares are drawn to that of all urls, which weighs PRIOR of them.  A bucket
    and a fold that hold no label have no row; bucket -1 is for suffixes that
    no label has.  At most SUFFIXES * (FOLDS + 1) + 1 rows, however many urls
    and suffixes there are; none without labels.
    """
    cells = seen.groupBy("bucket", "fold").agg(F.count("*").alias("n"), F.sum("label").alias("bad"))
    whole = cells.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    every = whole.agg((F.sum("bad") / F.sum("n")).alias("all"))
    parts = whole.select("bucket", F.lit(-1).alias("fold"), "n", "bad").unionByName(
        cells.alias("c").join(whole.alias("w"), "bucket").select("bucket", "fold", (F.col("w.n") - F.col("c.n")).alias("n"), (F.col("w.bad") - F.col("c.bad")).alias("bad")))
    none = every.where("all is not null").select(F.lit(-1).alias("bucket"), F.lit(-1).alias("fold"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("bad"))
    share = F.round((F.col("bad") + PRIOR * F.col("all")) / (F.col("n") + PRIOR), 4)
    return parts.unionByName(none).crossJoin(F.broadcast(every)).select("bucket", "fold", share.alias("share"))  # one row


def _vectors() -> VectorAssembler:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features")


def train(seen: DataFrame, trees: int = TREES, depth: int = DEPTH) -> GBTClassificationModel | float:
    """The trees, from rows of FEATURES and a label 0 or 1; of one kind of label its value, without any 0.

    Equal rows are counted first, so a hot host becomes one weighted row.  Rows
    are dealt and sorted by their features, so that reruns sum in one order.
    """
    training = written(seen.groupBy(*FEATURES, "label").agg(F.count("*").cast("double").alias("weight")), "url-training")
    kinds = [r["label"] for r in training.select("label").distinct().collect()]
    if len(kinds) < 2:
        return float(kinds[0]) if kinds else 0.0
    dealt = training.repartition(*FEATURES, "label").sortWithinPartitions(*FEATURES, "label")
    return GBTClassifier(maxIter=trees, maxDepth=depth, weightCol="weight", seed=7, maxBins=32, stepSize=0.3).fit(_vectors().transform(dealt))


def url_filter(pages: DataFrame, labelled: DataFrame | None = None, rules: tuple[tuple[str, str], ...] = RULES, trees: int = TREES, depth: int = DEPTH, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Host, path, rule and verdict of every url, and the trees' score.

    A url that a rule fits gets the rule's verdict.  The others get that of
    gradient-boosted trees on length, path depth, digit ratio, character
    entropy, parameter count, host labels, hyphens and how often urls of the
    same host suffix, of one label and of two, are blocked.  ``labelled`` (url, blocked 0 or 1) trains
    them; without it, the urls that a rule fits do, with its verdict as label.

    Null or malformed urls have an empty host and path and are judged alike;
    repeated rows stay; other columns, whatever their names, are ignored.  With no labels of both
    kinds the verdict is that of the only kind (allow if there are none); an
    empty table gives an empty result.  Nothing is shuffled but counts: what is
    broadcast is bounded by SUFFIXES, and scores are taken row by row.
    """
    plain = split_url(pages.select(pages[page_id].alias("page_id"), pages[url].alias("url")))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    plain = lexical(plain).withColumns({"rule": rule, "said": said})
    held = written(plain.select("page_id", "host", "path", "rule", "said", "suffix", "suffix2", *FEATURES[:-2]), "url-features")
    if labelled is None:
        seen = held.where(F.col("said").isNotNull()).withColumn("label", (F.col("said") == "block").cast("double"))
    else:
        known = split_url(labelled.select(labelled["url"].alias("url"), labelled["blocked"].alias("label")).where("label is not null"))
        seen = lexical(known).withColumn("label", F.col("label").cast("double"))
    seen = seen.withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int"))
    rated = held
    for name in ("suffix", "suffix2"):
        bucket = F.pmod(F.xxhash64(name), F.lit(SUFFIXES)).cast("int")
        shares = written(suffix_shares(seen.withColumn("bucket", bucket)), "url-suffixes")
        seen = seen.withColumn("bucket", bucket).join(F.broadcast(shares), ["bucket", "fold"]).withColumnRenamed("share", f"f_{name}").drop("bucket")
        unseen = shares.where("bucket = -1").agg(F.coalesce(F.max("share"), F.lit(0.0)).alias("_unseen"))
        of_all = shares.where("fold = -1").select("bucket", F.col("share").alias("_share"))
        rated = rated.withColumn("bucket", bucket).join(F.broadcast(of_all), "bucket", "left").crossJoin(F.broadcast(unseen))  # one row
        rated = rated.withColumn(f"f_{name}", F.coalesce("_share", "_unseen")).drop("bucket", "_share", "_unseen")
    model = train(seen, trees, depth)
    if isinstance(model, float):
        rated = rated.withColumn("score", F.lit(model))
    else:
        rated = model.transform(_vectors().transform(rated)).withColumn("score", vector_to_array("probability")[1])
    verdict = F.coalesce("said", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return rated.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round("score", 6).alias("score"))
