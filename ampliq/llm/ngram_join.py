"""N-gram Jaccard join by MinHash banding.

Documents with the same words are one node.  Nodes get MinHash signatures of
their word n-grams; band and row counts follow from the recall wanted at the
threshold.  Nodes that share a band form buckets.  Each node has a home, the
largest bucket near it; the nodes of one home and of about one size make up blocks of a
bounded number of n-grams.  A pair of blocks is a task, to which a node is sent
only if it shares a bucket with a node of the other block; there the n-gram sets
are compared in full.  Every pair of nodes has one pair of blocks, so none is
counted twice.  Tasks return link counts and spanning edges, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampliq.llm.common import maybe_in, text_or_empty, written

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Nodes in a block, and n-grams (nodes of more make blocks of their own); a task verifies two blocks.
BLOCK, BLOCK_GRAMS = 256, 1 << 20
#: Texts of which more than this share of all rows are copies are joined by broadcast: fewer than 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 4096
#: Names that a task remembers, so as to work out the n-grams of copies once.
REMEMBERED = 1 << 18
#: Columns of the incidence matrix multiplied at once.
COLUMNS = 1 << 14


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, rows: tuple[int, ...] = (5, 6, 7, 8), passage: float = 0.4) -> tuple[int, int]:
    """(bands, rows a band) that reach ``recall`` at ``threshold`` with the fewest hashes and false candidates.

    A pair of similarity s shares a band with probability 1 - (1 - s^r)^b.
    Cost: hashes, plus 300 for each expected false candidate at ``passage``.
    """
    best = None
    for r in rows:
        b = math.ceil(math.log(1 - recall) / math.log(1 - threshold**r))
        cost = b * r + 300 * (1 - (1 - passage**r) ** b)
        best = min(best or (cost, b, r), (cost, b, r))
    return best[1], best[2]


def _word_hashes(words: list[str], cache: dict[str, int]) -> np.ndarray:
    if len(cache) > 500_000:
        cache.clear()
    for w in [w for w in set(words) if w not in cache]:
        cache[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def ngram_hashes(text: str, cache: dict[str, int], n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; a shorter text is one n-gram of all its words.

    ``text`` has single spaces between its words.
    """
    h = _word_hashes(text.split(" ") if text else [], cache)
    if not len(h):
        return h
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[k : k + len(out)]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(29)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


class MinHash:
    """Signatures of ``bands`` hashes, each of ``rows`` minima of random linear maps of the n-gram hashes."""

    STEP = 256

    def __init__(self, bands: int, rows: int):
        draw = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 32, (2, bands * rows), np.uint64).astype(np.uint32)
        self.a, self.b, self.shape = (draw[0] | np.uint32(1))[:, None], draw[1][:, None], (bands, rows)
        self.cells = np.empty((bands * rows, self.STEP), np.uint32)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        short = (grams >> np.uint64(32)).astype(np.uint32)
        least = np.full(self.shape[0] * self.shape[1], 0xFFFFFFFF, np.uint32)
        for at in range(0, len(short), self.STEP):
            x = short[at : at + self.STEP]
            cells = self.cells[:, : len(x)]
            np.multiply(self.a, x, out=cells)
            cells += self.b
            np.minimum(least, cells.min(1), out=least)
        out = np.arange(1, self.shape[0] + 1).astype(np.uint64)
        for k in range(self.shape[1]):
            out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + least.reshape(self.shape)[:, k]
        return out


def words_of(text: str | Column) -> Column:
    """The words of a text with single spaces between them."""
    return F.trim(F.regexp_replace(text_or_empty(text), r"[\x20\x09-\x0D]+", " "))


def node_name(words: Column) -> Column:
    """128 bits that name a sequence of words, as ``words_of`` gives it."""
    return F.concat_ws(":", F.hex(F.xxhash64(words)), F.hex(F.xxhash64(F.lit(1), words)))


def _hashed(named: DataFrame, bands: int, rows: int, n: int) -> DataFrame:
    """``named`` with grams and bands in place of the text; null bands without a word."""
    rest = [c for c in named.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        minhash = MinHash(bands, rows)
        for batch in batches:
            size, sig = [], []
            for text in batch.column("text"):
                grams = ngram_hashes(text.as_py(), cache, n)
                size.append(len(grams))
                sig.append(minhash(grams).view(np.int64) if len(grams) else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(size, pa.int32()), pa.array(sig, pa.list_(pa.int64()))], [*rest, "grams", "bands"])

    schema = T.StructType([*(f for f in named.schema if f.name in rest), T.StructField("grams", T.IntegerType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    return named.mapInArrow(run, schema)


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b), roots being least nodes; nodes are of any ordered type.

    Alternating large-star and small-star steps until nothing changes; each
    step joins each node with its least neighbour and keeps one edge per node.
    Edges with a null end and edges of a node to itself link nothing; repeated
    edges count once; no edge gives an empty result.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    while True:
        both = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, name, now)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        now = written(small, name, large)
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == before:
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        before = seen


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of incidence matrices over the n-grams that occur twice or more."""
    every = np.concatenate([*left, *right])
    _, column, count = np.unique(every, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    shared = count[column] > 1
    rank = np.cumsum(count > 1) - 1
    column, owner = rank[column[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(left), len(right)), np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, width, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        part = np.zeros((len(left) + len(right), min(COLUMNS, width - at)), np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        out += part[: len(left)] @ part[len(left) :].T
    return out.astype(np.int64)


def _spanning(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for a, b in pairs.tolist():
        x, y = root(a), root(b)
        if x != y:
            parent[y] = x
            out.append((a, b))
    return out


def verify_blocks(table: pa.Table, threshold: float) -> pa.Table:
    """Links within one pair of blocks: per node the copies it is linked to, and edges that span what is linked."""
    first, second = table["i"][0].as_py(), table["j"][0].as_py()
    table = table.sort_by([("block", "ascending"), ("node", "ascending")])
    block, node = table["block"].to_numpy(), table["node"].to_pylist()
    copies = table["copies"].to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in table["set"].to_pylist()]
    cut = len(sets) if first == second else int((block == first).sum())
    left, right = range(cut), range(len(sets)) if first == second else range(cut, len(sets))
    sizes = np.array([len(s) for s in sets])
    shared = _overlaps([sets[k] for k in left], [sets[k] for k in right]) if len(left) and len(right) else np.zeros((len(left), len(right)), np.int64)
    union = sizes[list(left)][:, None] + sizes[list(right)][None, :] - shared
    linked = shared >= np.ceil(threshold * union - 1e-9)
    linked &= shared > 0
    if first == second:
        np.fill_diagonal(linked, False)
    count = np.zeros(len(sets), np.int64)
    count[list(left)] += linked @ copies[list(right)]
    if first != second:
        count[list(right)] += linked.T @ copies[list(left)]
    pairs = np.argwhere(linked) + (0, 0 if first == second else cut)
    edges = _spanning(pairs, len(sets))
    some = np.flatnonzero(count).tolist()
    return pa.table({
        "a": pa.array([node[k] for k in some] + [node[a] for a, _ in edges], pa.string()), "b": pa.array([None] * len(some) + [node[b] for _, b in edges], pa.string()),
        "links": pa.array(count[some].tolist() + [0] * len(edges), pa.int64())})


def buckets_of(nodes: DataFrame) -> DataFrame:
    """(node, bucket, size): the buckets of two nodes and more that each of ``nodes`` (node, bands) is in."""
    rowed = nodes.select("node", F.posexplode("bands").alias("band", "h")).select("node", F.xxhash64("band", "h").alias("bucket"))
    sizes = written(rowed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "ngram-buckets")
    likely = maybe_in(rowed, sizes, "bucket").where("_maybe").drop("_maybe")
    return written(likely.join(sizes.hint("merge"), "bucket"), "ngram-members", sizes)


def blocks_of(members: DataFrame, nodes: DataFrame, threshold: float, block: int) -> DataFrame:
    """(node, copies, level, block): the block of every node that is in a bucket.

    Its home is the largest bucket that some node in one of its own buckets is
    in, so the nodes of a group of near copies have one home.  ``level`` grows by one where sizes grow by 1 / threshold, so linked nodes
    are of one level or of two that follow on each other.
    """
    own = members.groupBy("node").agg(F.max(F.struct("size", "bucket")).alias("h"))
    tops = members.select("node", "bucket").join(own.hint("merge"), "node").groupBy("bucket").agg(F.max("h").alias("h"))
    homes = members.select("node", "bucket").join(tops.hint("merge"), "bucket").groupBy("node").agg(F.max("h").alias("h")).select("node", F.col("h.bucket").alias("home"))
    step = math.log(1 / threshold)
    placed = homes.join(nodes.select("node", "copies", "grams").hint("merge"), "node").withColumn("level", F.floor(F.log("grams") / step + 1e-9).cast("int"))
    placed = written(placed, "ngram-homes")
    room = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(float(BLOCK_GRAMS)) / F.exp((F.col("level") + 1) * step)).cast("int")))
    parts = placed.groupBy("home", "level").agg(F.count("*").alias("n")).select("home", "level", F.ceil(F.col("n") / room).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    return written(placed.join(parts.hint("merge"), ["home", "level"]).select("node", "copies", "level", F.xxhash64("home", "level", part).alias("block")), "ngram-blocks", placed)


def tasks_of(members: DataFrame, blocked: DataFrame) -> DataFrame:
    """(node, copies, block, i, j): the pairs of blocks i <= j to which each node goes.

    Blocks meet if a bucket has nodes of both.  Where those nodes, counted for
    each bucket, are a quarter of a block or more, the whole block goes to the
    pair, else they alone: so about as many rows arise as there are tasks for
    the nodes, however many buckets two blocks share.
    """
    own = written(members.select("node", "bucket").join(blocked.hint("merge"), "node").select("bucket", "node", "copies", "block", "level"), "ngram-own")
    spread = written(own.groupBy("bucket", "block", "level").agg(F.count("*").alias("n")), "ngram-spread")
    others = spread.select("bucket", F.col("block").alias("other"), F.col("level").alias("_level"))
    met = spread.join(others.hint("merge"), "bucket").where(F.abs(F.col("level") - F.col("_level")) <= 1).select("bucket", "block", "other", "n")
    sizes = blocked.groupBy("block").agg(F.count("*").alias("size"))
    pairs = met.groupBy("block", "other").agg(F.sum("n").alias("touched")).join(sizes.hint("merge"), "block").where("block <> other or size > 1")
    pairs = written(pairs.select("block", "other", (4 * F.col("touched") >= F.col("size")).alias("dense")), "ngram-pairs")
    whole = blocked.select("node", "copies", "block").join(pairs.where("dense").select("block", "other").hint("merge"), "block")
    some = met.join(pairs.where("not dense").select("block", "other").hint("merge"), ["block", "other"]).select("bucket", "block", "other")
    some = own.select("bucket", "node", "copies", "block").join(some.hint("merge"), ["bucket", "block"]).select("block", "node", "copies", "other").distinct()
    sent = whole.unionByName(some).select("node", "copies", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return written(sent, "ngram-tasks", own, spread, pairs)


def links_of(named: DataFrame, nodes: DataFrame, threshold: float, n: int, block: int) -> DataFrame:
    """(a, b, links): per task and node the copies it is linked to (b null), and edges that span what is linked."""
    members = buckets_of(nodes)
    blocked = blocks_of(members, nodes, threshold, block)
    tasks = tasks_of(members, blocked)
    sent = _gram_sets(named, blocked, n).join(tasks.hint("merge"), "node").select("i", "j", "block", "node", "copies", "set")
    found = sent.groupBy("i", "j").applyInArrow(lambda table: verify_blocks(table, threshold), "a string, b string, links long")
    return written(found, "ngram-found", members, blocked, tasks)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, n: int = WORDS, recall: float = RECALL, block: int = BLOCK, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, n_ngrams, is_first, node (the name of its words) and the columns in ``keep``.

    Two documents are linked if the Jaccard similarity of their sets of word
    n-grams is at least ``threshold``; documents with the same words always
    are.  Texts under n words have one n-gram, of all their words; texts
    without a word (null, empty, blank) are linked to nothing.  ``class_id`` is
    the least doc_id among all that links connect, ``n_links`` counts the other
    documents linked, ``is_first`` is true in one row of each class (in all
    rows of one id and the same words).  Repeated rows count as copies of each
    other; a null doc_id is never a class's id unless all its ids are null; an
    empty table gives an empty result.

    Candidates share a MinHash band (recall at the threshold as given);
    verification is exact.  Copies are merged before anything else.  Texts are
    read twice; the second time a bounded filter leaves the n-gram sets of
    nodes in buckets (and a tenth of the others) to be shuffled.
    """
    bands, rows = choose_bands(threshold, recall)
    named = docs.select(docs[doc_id].cast("long").alias("doc_id"), words_of(docs[text]).alias("text"), *(docs[c].alias(f"keep_{c}") for c in keep))
    named = named.withColumn("node", node_name(F.col("text")))
    hashed = written(_hashed(named, bands, rows, n), "ngram-docs")
    kept = [c for c in hashed.columns if c.startswith("keep_")]
    nodes = hashed.where("grams > 0").groupBy("node").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least_id"), F.min("grams").alias("grams"), F.min("bands").alias("bands"))
    nodes = written(nodes, "ngram-nodes")
    found = links_of(named.select("node", "text"), nodes, threshold, n, block)
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    groups = components(found.where("b is not null").select("a", "b"), "ngram-groups")
    described = nodes.select("node", "copies", "least_id").join(links.hint("merge"), "node", "left").join(groups.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    described = written(described, "ngram-described", nodes, found)
    #: The first document of a class: of the least id, and among the nodes of that id the least.
    classes = described.groupBy("root").agg(F.min(F.struct(F.col("least_id").isNull(), "least_id", "node")).alias("f")).select("root", F.col("f.least_id").alias("class_id"), F.col("f.node").alias("first_node"))
    classed = described.join(classes.hint("merge"), "root").select("node", "copies", "class_id", "least_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), (F.col("node") == F.col("first_node")).alias("is_first_node"))
    classed = written(classed, "ngram-classes", described)
    most = HOT_SHARE * hashed.count()
    hot, rest = F.broadcast(classed.where(F.col("copies") > most)), classed.where(F.col("copies") <= most)
    plain = hashed.select("doc_id", "node", "grams", *kept)
    worded, blank = plain.where("grams > 0"), plain.where("grams = 0")
    common = worded.join(hot, "node").unionByName(worded.join(hot.select("node"), "node", "left_anti").join(rest.hint("merge"), "node"))
    first = F.col("is_first_node") & F.col("doc_id").eqNullSafe(F.col("least_id"))
    back = [F.col(f"keep_{c}").alias(c) for c in keep]
    out = common.select("doc_id", "class_id", "n_links", F.col("grams").cast("long").alias("n_ngrams"), first.alias("is_first"), "node", *back)
    none = blank.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_ngrams"), F.lit(True).alias("is_first"), "node", *back)
    return out.unionByName(none)


def _gram_sets(named: DataFrame, blocked: DataFrame, n: int) -> DataFrame:
    """(node, set): the n-gram hashes of the nodes in ``blocked``, and of few others, computed again from one text of each."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        seen: set[str] = set()
        for batch in batches:
            names = batch.column(0).to_pylist()
            fresh = []
            for k, name in enumerate(names):
                if name not in seen:
                    fresh.append(k)
                    seen.add(name)
            if len(seen) > REMEMBERED:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in fresh], pa.string()), pa.array([ngram_hashes(batch.column(1)[k].as_py(), cache, n).tobytes() for k in fresh], pa.binary())], ["node", "set"])

    likely = maybe_in(named, blocked, "node").where("_maybe").select("node", "text")
    return likely.mapInArrow(sets, "node string, set binary").groupBy("node").agg(F.min("set").alias("set"))
