"""Operator 2: Jaccard join on word n-grams by grouped prefixes.

A document's set is its distinct n-word shingles as 64-bit hashes (with fewer
words, the whole sequence as one). Documents link when
100 * |A & B| >= percent * |A | B|; only components of that graph are returned.

1. A count sketch of fixed size (2**22 counters) over all shingles gives the
   global order: rarer counters first, then by hash. It only steers which
   shingles stand in a prefix; a poor estimate costs time, never a link.
2. Documents with equal sets become one node; nodes with equal prefix and equal
   size become one group, which stands in the prefix index once.
3. Candidate group pairs share a prefix shingle and pass the size and position
   filters. Each shingle's groups are cut into cells of neighbouring sizes. A
   first round tries every group of a cell only against the one with the fewest
   rarer shingles, so that a large set of near copies or of documents with one
   common passage never spells out its pairs. A second takes the rows of a cell
   for which a set of another component could still follow, and pairs them.
4. Group pairs are expanded to their nodes and verified exactly on whole sets.

Nulls and texts without words have size 0 and stand alone. Repeated rows have
equal sets and link. Very long texts are handled whole. An empty table gives an
empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, documents, salted_join, stash, texts, tidied

SKETCH_BITS = 22
SLICES = 64
FAN_IN = 64
SEEN_BITS = 24
KEEP_WORDS = 300_000

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_S32 = np.uint64(32)


class _Words(dict):
    """Hash of each word; holds a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < KEEP_WORDS:
            self[word] = value
        return value


def _shingles(text: str, n: int, words: _Words) -> np.ndarray:
    """Sorted distinct shingle hashes of one text. bytes.lower and bytes.split know ASCII only, as the contract asks."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = (out ^ h[k : len(h) - width + 1 + k]) * _MUL
        out ^= out >> _S32
    out = (out ^ (out >> _S32)) * _MIX
    return np.unique(out ^ (out >> _S32))


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)


def order_levels(docs: DataFrame, n: int) -> np.ndarray:
    """For each sketch counter, the base-2 logarithm of its document count times four, in one byte."""
    schema = "slice int, at long, counts binary"
    arrow = pa.schema([("slice", pa.int32()), ("at", pa.int64()), ("counts", pa.binary())])

    def sliced(counts: np.ndarray, at: int) -> pa.RecordBatch:
        z = zstandard.ZstdCompressor(level=1)
        rows = [z.compress(x.tobytes()) for x in np.split(counts, SLICES)]
        return pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([at] * SLICES, pa.int64()), pa.array(rows, pa.binary())], schema=arrow)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size, words = np.zeros(1 << SKETCH_BITS, np.uint32), [], 0, _Words()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(_slots(_shingles(text, n, words)))
                size += len(held[-1])
                if size > 2_000_000:
                    total += np.bincount(np.concatenate(held), minlength=len(total)).astype(np.uint32)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=len(total)).astype(np.uint32)
        if total.any():
            yield sliced(total, TaskContext.get().partitionId())

    def merge(key, rows):
        z, total = zstandard.ZstdDecompressor(), np.zeros((1 << SKETCH_BITS) // SLICES, np.uint64)
        for x in rows.column("counts"):
            total += np.frombuffer(z.decompress(x.as_py()), np.uint32)
        small = np.minimum(total, np.uint64(2**32 - 1)).astype(np.uint32)
        return pa.table({"slice": [key[0].as_py()], "at": [key[1].as_py()], "counts": [zstandard.ZstdCompressor(level=1).compress(small.tobytes())]}, schema=arrow)

    parts = docs.rdd.getNumPartitions()
    df = docs.select("text").mapInArrow(tidied(count), schema)
    while True:
        df = df.withColumn("at", F.floor(F.col("at") / FAN_IN).cast("long")).groupBy("slice", "at").applyInArrow(merge, schema)
        parts = -(-parts // FAN_IN)
        if parts <= 1:
            break
    levels = np.zeros(1 << SKETCH_BITS, np.uint8)
    width = len(levels) // SLICES
    for row in df.toLocalIterator():
        counts = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["counts"]), np.uint32)
        levels[row["slice"] * width : (row["slice"] + 1) * width] = (np.log2(counts + 1.0) * 4).astype(np.uint8)
    return levels


def _least(size: int, percent: int) -> int:
    """The smallest overlap of a set with a partner that links."""
    return -(-size * percent // 100)


def prefixes(docs: DataFrame, levels, n: int, percent: int) -> DataFrame:
    """doc_id, text_key, size, nid (hash of the set), gid (hash of prefix and size), prefix (shingles in global order)."""
    arrow = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("size", pa.int64()), ("nid", pa.int64()), ("gid", pa.int64()), ("prefix", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, words = levels.value, _Words()
        for batch in batches:
            sizes, nids, gids, heads = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = _shingles(text, n, words)
                keep = len(s) - _least(len(s), percent) + 1 if len(s) else 0
                rank = level[_slots(s)]
                if keep < len(s):
                    limit = np.partition(rank, keep - 1)[keep - 1]
                    near = np.flatnonzero(rank <= limit)
                    s_near, rank = s[near], rank[near]
                else:
                    s_near = s
                head = s_near[np.argsort(rank, kind="stable")][:keep]
                sizes.append(len(s))
                nids.append(xxhash.xxh3_64_intdigest(s.tobytes()))
                gids.append(xxhash.xxh3_64_intdigest(head.tobytes(), seed=len(s)))
                heads.append(head.view(np.int64))
            flat = np.concatenate(heads) if heads else np.empty(0, np.int64)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in heads])]).astype(np.int32)
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), signed(nids), signed(gids), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)).cast(pa.list_(pa.int64()))], schema=arrow)

    return docs.select("doc_id", "text", text_key(F.col("text"))).mapInArrow(tidied(run), "doc_id long, text_key long, size long, nid long, gid long, prefix array<long>")


def _sets(docs: DataFrame, seen, n: int) -> DataFrame:
    """nid and whole set of the rows whose bit is set; the bits may name some rows too many."""
    arrow = pa.schema([("nid", pa.int64()), ("members", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, words = seen.value, _Words()
        for batch in batches:
            at = np.asarray(batch.column(1))
            pick = np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            if len(pick):
                sets = [_shingles(t, n, words).tobytes() for t in batch.column(0).take(pa.array(pick)).to_pylist()]
                nids = np.array([xxhash.xxh3_64_intdigest(x) for x in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(nids), pa.array(sets, pa.binary())], schema=arrow)

    return docs.select("text", _bit().alias("bit")).mapInArrow(tidied(run), "nid long, members binary")


def _bit() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(1 << SEEN_BITS))


def _bitmap(ids: DataFrame) -> np.ndarray:
    """A bit for each hashed doc_id: 2 MB at any size."""
    h = _bit()
    bits = np.zeros(1 << (SEEN_BITS - 3), np.uint8)
    for row in ids.select(F.bitmap_bucket_number(h + 1).alias("k"), F.bitmap_bit_position(h + 1).alias("p"), h.alias("h")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("m"), F.min(F.col("h") - F.col("p")).alias("at")).toLocalIterator():
        part = np.frombuffer(bytes(row["m"]), np.uint8)
        start = row["at"] >> 3
        bits[start : start + len(part)] |= part[: len(bits) - start]
    return bits


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs of nodes (a, b) that link, by exact overlap of their whole sets.

    Only documents that stand for a node of some pair send their sets.
    """
    named = pairs.select(F.explode(F.array("a", "b")).alias("nid")).distinct().join(nodes.select("nid", "doc_id"), "nid")
    sets = _sets(docs, docs.sparkSession.sparkContext.broadcast(_bitmap(named)), n)
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                p, q = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * both >= percent * (len(p) + len(q) - both):
                    keep.append(i)
            if keep:
                few = batch.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([few.column(0), few.column(1)], schema=arrow)

    with_a = pairs.join(sets.select(F.col("nid").alias("a"), F.col("members").alias("ma")), "a")
    both = with_a.join(sets.select(F.col("nid").alias("b"), F.col("members").alias("mb")), "b")
    return both.select("a", "b", "ma", "mb").mapInArrow(tidied(run), "a long, b long")


def text_key(text: Column) -> Column:
    """Hash of a text as link_rows names it; a null text counts as empty."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def link_documents(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text)."""
    rows = link_rows(docs, n, percent)
    full = rows.where("n_shingles > 0")
    least = stash(full.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")), "least")
    out = salted_join(full, least, ["component"], "n").select("doc_id", "n_shingles", "component_id")
    return out.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def link_rows(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, text_key, n_shingles, component (a number shared by linked rows, null without shingles) for every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    docs = texts(docs)
    levels = spark.sparkContext.broadcast(order_levels(docs, n))
    heads = stash(prefixes(docs, levels, n, percent), "prefixes")
    filled = heads.where("size > 0")
    nodes = filled.groupBy("nid").agg(F.min("doc_id").alias("doc_id"), F.min("gid").alias("gid"), F.min("size").alias("size"))
    nodes = stash(nodes, "nodes")
    groups = filled.groupBy("gid").agg(F.first("prefix").alias("prefix"), F.first("size").alias("size"))
    index = groups.select("gid", F.col("size").cast("int").alias("size"), F.posexplode("prefix").alias("pos", "token")).repartition("token")
    shared = index.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token")
    index = stash(index.join(shared, "token"), "index")

    # Size and position filters, on sizes p, q and prefix positions i, j of a common shingle.
    def near(p, q):
        return F.least(p, q) * 100 >= F.greatest(p, q) * percent

    def may(p, q, i, j):
        need = F.ceil((p + q) * percent / (100 + percent) - 1e-6)
        return near(p, q) & (1 + F.least(p - i - 1, q - j - 1) + F.least(i, j) >= need)

    # At the first common shingle of a pair that links, what follows in both prefixes and sets must hold the whole overlap.
    def leads(p, q, i, j):
        return near(p, q) & (F.least(p - i, q - j) * (100 + percent) >= (p + q) * percent)

    # Overlap that c common shingles of both prefixes leave possible: one of them has been compared whole.
    def could(p, q, c):
        rest = F.ceil(F.greatest(p, q) * percent / 100 - 1e-6) - 1
        return c + rest >= F.ceil((p + q) * percent / (100 + percent) - 1e-6)

    # Sizes that may link differ by one step at most; a cell holds the sizes of two neighbouring steps.
    step = F.floor(F.log(F.col("size").cast("double")) / np.log(100 / percent) + 1e-9).cast("int") if percent < 100 else F.col("size")

    def celled(df: DataFrame) -> DataFrame:
        return df.withColumn("cell", F.explode(F.array(step, step + 1)))

    # Round one: each group against the one of each shingle and cell that has the fewest rarer ones, so the least own text; each node of a group against its first.
    # Not all common shingles are counted here; what that turns away comes again in round two.
    cells = celled(index)
    reps = cells.groupBy("token", "cell").agg(F.min(F.struct("pos", "size", "gid")).alias("r"), F.count("*").alias("n")).where("n > 1").select("token", "cell", F.col("r.gid").alias("rep"), F.col("r.size").alias("q"), F.col("r.pos").alias("j"))
    star = cells.join(reps, ["token", "cell"]).where("gid <> rep").where(may(F.col("size"), F.col("q"), F.col("pos"), F.col("j"))).groupBy(F.col("rep").alias("ga"), F.col("gid").alias("gb")).agg(F.count("*").alias("c"), F.first("size").alias("p"), F.first("q").alias("q"))
    star = star.where(could(F.col("p"), F.col("q"), F.col("c"))).select("ga", "gb")
    first = nodes.groupBy("gid").agg(F.min("nid").alias("nid"), F.count("*").alias("n"))
    within = nodes.join(first.where("n > 1").select("gid", F.col("nid").alias("a")), "gid").where("nid <> a").select("a", F.col("nid").alias("b"))
    lead = first.select("gid", "nid")
    across = star.join(lead.select(F.col("gid").alias("ga"), F.col("nid").alias("a")), "ga").join(lead.select(F.col("gid").alias("gb"), F.col("nid").alias("b")), "gb").select("a", "b")
    pairs = stash(across.unionByName(within).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs1")

    linked = stash(_verified(docs, nodes, pairs, n, percent), "links1")
    roots = components(linked)

    # Round two: what shares a shingle and is still apart.
    placed = stash(nodes.join(index.select("gid").unionByName(first.where("n > 1").select("gid")).distinct(), "gid", "left_semi").join(roots.withColumnRenamed("node", "nid"), "nid", "left").select("nid", "gid", F.coalesce("root", "nid").alias("root")), "placed")
    # A row stays where the smallest set of another component in its cell leaves a first common shingle possible.
    tokens = celled(index.join(placed, "gid").select("token", "nid", "root", "size", "pos"))
    least = tokens.groupBy("token", "cell", "root").agg(F.min("size").alias("m"))
    mixed = least.groupBy("token", "cell").agg(F.min(F.struct("m", "root")).alias("lo"), F.min("root").alias("ra"), F.max("root").alias("rb")).where("ra <> rb").select("token", "cell", F.col("lo.m").alias("m1"), F.col("lo.root").alias("r1"))
    second = least.join(mixed, ["token", "cell"]).where("root <> r1").groupBy("token", "cell").agg(F.min("m1").alias("m1"), F.min("r1").alias("r1"), F.min("m").alias("m2"))
    other = F.when(F.col("root") == F.col("r1"), F.col("m2")).otherwise(F.col("m1"))
    open_ = tokens.join(second, ["token", "cell"]).where((F.col("size") - F.col("pos")) * (100 + percent) >= (F.col("size") + other) * percent).select("token", "cell", "nid", "root", "size", "pos")
    open_ = stash(open_, "apart")
    still = open_.groupBy("token", "cell").agg(F.min("root").alias("ra"), F.max("root").alias("rb")).where("ra <> rb").select("token", "cell")
    open_ = open_.join(still, ["token", "cell"], "left_semi")
    left = open_.select("token", "cell", F.col("nid").alias("a"), F.col("root").alias("ra"), F.col("size").alias("p"), F.col("pos").alias("i"))
    right = open_.select("token", "cell", F.col("nid").alias("b"), F.col("root").alias("rb"), F.col("size").alias("q"), F.col("pos").alias("j"))
    late = left.join(right, ["token", "cell"]).where("ra < rb").where(leads(F.col("p"), F.col("q"), F.col("i"), F.col("j"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    mates = placed.join(placed.groupBy("gid").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("gid"), "gid")
    mates = mates.select("gid", F.col("nid").alias("a"), F.col("root").alias("ra")).join(mates.select("gid", F.col("nid").alias("b"), F.col("root").alias("rb")), "gid").where("a < b and ra <> rb").select("a", "b")
    late = stash(late.unionByName(mates).distinct().join(pairs, ["a", "b"], "left_anti"), "pairs2")
    more = _verified(docs, nodes, late, n, percent)
    roots = components(linked.unionByName(more))

    named = nodes.select("nid").join(roots.withColumnRenamed("node", "nid"), "nid", "left").select("nid", F.coalesce("root", "nid").alias("component"))
    copies = filled.groupBy("nid").agg(F.count("*").alias("n"))
    full = salted_join(filled.select("doc_id", "text_key", "size", "nid"), named.join(copies, "nid"), ["nid"], "n")
    full = full.select("doc_id", "text_key", F.col("size").alias("n_shingles"), "component")
    return full.unionByName(heads.where("size = 0").select("doc_id", "text_key", F.col("size").alias("n_shingles"), F.lit(None).cast("long").alias("component")))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(documents(spark, sf_dir))


QUERIES = {"op2_ngram_jaccard_join": op2}
