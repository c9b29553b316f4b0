"""Near-duplicate groups: 64-bit difference hashes, banding, Hamming filter, components, keepers."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..sources.scratch import stored

BANDS = 8
BUCKET_MOST = 400
THRESHOLD = 5
CELLS = 72
CHUNK, BLOCK = 1 << 18, 1 << 15
SMALL, FEW = 32, 8


def text_grids(documents: DataFrame) -> DataFrame:
    """hash and a 72-cell grid of each row whose text has a token: tokens counted by the first 16 bits of their md5.

    Copies of a text have equal grids. Each token is one of 72 characters of a string, in which
    the characters of a cell are counted; neither texts nor counts are shuffled.
    """
    first = F.ascii(F.lit("0"))
    cell = lambda t: F.conv(F.substring(F.md5(t.cast("binary")), 1, 4), 16, 10).cast("int") % CELLS
    tokens = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda t: t != "")
    places = F.array_join(F.transform(tokens, lambda t: F.char(first + cell(t))), "")
    count = lambda x: F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda c: (F.length(x) - F.length(F.replace(x, F.char(first + c), F.lit("")))).cast("bigint"))
    # The string is bound once, as the grid below.
    grid = F.get(F.transform(F.array(places), count), F.lit(0))
    return documents.where("text rlike '[a-zA-Z0-9]'").select(F.sha2(F.col("text").cast("binary"), 256).alias("hash"), grid.alias("grid"))


def hashes(grids: DataFrame) -> DataFrame:
    """hash, bits and phash of each distinct hash."""
    # The grid is bound once: a plan that puts its expression in place of the column would work it out for every bit.
    bits = F.get(F.transform(F.array("grid"), lambda g: S.dhash_bits(lambda at: F.get(g, at))), F.lit(0))
    # A filter would move below the bits and work them out once more.
    kept = F.explode(F.filter(F.array(bits), lambda b: ~S.degenerate(b)))
    return grids.select("hash", kept.alias("bits")).distinct().select("hash", "bits", S.hash_hex(F.col("bits")).alias("phash"))


def bands(hashed: DataFrame) -> DataFrame:
    parts = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.substr(F.col("phash"), b * 2 + 1, F.lit(2)))
    return hashed.select("hash", "bits", F.posexplode(parts).alias("band", "part"))


def pairs(hashed: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """a < b within the threshold that share a bucket of 2 to 400 members. The bound is the model's own and limits pairs a bucket."""
    rows = bands(stored(hashed, "hashed"))
    sizes = rows.groupBy("band", "part").agg(F.count("*").alias("n")).where(F.col("n").between(2, BUCKET_MOST)).drop("n")
    rows = rows.join(sizes, ["band", "part"])
    other = rows.select("band", "part", F.col("hash").alias("b"), F.col("bits").alias("bits_b"))
    met = rows.withColumnsRenamed({"hash": "a", "bits": "bits_a"}).join(other, ["band", "part"]).where("a < b")
    return met.select("a", "b", S.hamming(F.col("bits_a"), F.col("bits_b")).alias("distance")).where(F.col("distance") <= threshold).distinct()


def groups(linked: DataFrame) -> DataFrame:
    """hash, root (smallest hash of its component), by passing the smallest label along edges and through labels."""
    edges = stored(linked.select("a", "b").union(linked.select("b", "a")).distinct(), "edges")
    label = stored(edges.groupBy(F.col("a").alias("hash")).agg(F.least(F.min("b"), F.min("a")).alias("root")), "labels")
    while True:
        near = edges.join(label, F.col("b") == F.col("hash")).groupBy("a").agg(F.min("root").alias("near"))
        step = label.join(near, F.col("hash") == F.col("a"), "left").select("hash", F.least("root", "near").alias("root"))
        over = step.select(F.col("hash").alias("root"), F.col("root").alias("over"))
        new = stored(step.join(over, "root", "left").select("hash", F.least("root", F.coalesce("over", "root")).alias("root")), "labels")
        if not new.join(label.withColumnRenamed("root", "was"), "hash").where("root <> was").limit(1).count():
            return new
        label = new


def spots(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """spot and bits, a row for each set of BANDS - threshold bands: which bands, and what they hold.

    Bits within the threshold agree in so many bands at least, so they share a spot. With the
    threshold of 5 there are 56 sets of three bands, and a spot has 24 of the 64 bits.
    """
    def spot(k: int, taken: tuple[int, ...]):
        held = F.lit(k).cast("bigint")
        for b in taken:
            held = F.shiftleft(held, 8).bitwiseOR(F.shiftrightunsigned("bits", 8 * b).bitwiseAND(F.lit(255)))
        return held

    return distinct.select("bits", F.explode(F.array(*[spot(k, taken) for k, taken in enumerate(combinations(range(BANDS), BANDS - threshold))])).alias("spot"))


def _crowded(held: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places that connect what links within the threshold connect, of many values that may be near each other.

    A block of values is compared with all that are left. Where it has few links, these are the pairs, and the
    block is done; else one component is followed to its end, whose members are compared with those outside only.
    So there are a few pairs a value at most, and where most values hang together, few comparisons.
    """
    left = np.arange(len(held))
    while len(left) > 1:
        block = min(len(left), max(1, BLOCK // len(left)))
        near = np.bitwise_count(held[:block, None] ^ held) <= threshold
        links_of = np.count_nonzero(near, axis=1)
        if links_of.sum() <= FEW * block:
            one, other = np.nonzero(near)
            yield left[one], left[other]
            left, held = left[block:], held[block:]
            continue
        first = int(links_of.argmax())
        met, root, ahead = near[first], left[first], held[:0]
        while met.any() or len(ahead):
            if met.any():
                yield np.full(np.count_nonzero(met), root), left[met]
                ahead = np.concatenate([ahead, held[met]])
                left, held = left[~met], held[~met]
            if not len(left):
                break
            block = max(1, BLOCK // len(left))
            met = (np.bitwise_count(ahead[:block, None] ^ held) <= threshold).any(axis=0)
            ahead = ahead[block:]


def linked_within(spot: np.ndarray, bits: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that join all of bits that a spot holds and links within the threshold connect: one less than values of a component at most.

    spot is in order.
    """
    bits = bits.view(np.uint64)
    starts = np.flatnonzero(np.r_[True, spot[1:] != spot[:-1]]) if len(spot) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(spot)])
    end, many = np.repeat(starts + sizes, sizes), np.repeat(sizes > SMALL, sizes)
    near, with_ = [], []
    at = np.flatnonzero(~many)
    for step in range(1, SMALL):
        at = at[at + step < end[at]]
        met = at[np.bitwise_count(bits[at] ^ bits[at + step]) <= threshold]
        near.append(met)
        with_.append(met + step)
    for start, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        for one, other in _crowded(bits[start : start + size], threshold):
            near.append(start + one)
            with_.append(start + other)
    # The links of all spots, on the values themselves: a value keeps one pair, with the first of its component.
    values, ends = np.unique(np.concatenate([bits[np.concatenate(x)] for x in (near, with_)]), return_inverse=True)
    a, b = ends.reshape(2, -1)
    label = np.arange(len(values))
    while ((of_a := label[a]) != (of_b := label[b])).any():
        for of in (of_a, of_b):
            np.minimum.at(label, of, np.minimum(of_a, of_b))
        while (label[label] != label).any():
            label = label[label]
    rest = np.flatnonzero(label != np.arange(len(values)))
    return values[label[rest]].view(np.int64), values[rest].view(np.int64)


def links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """a, b of distinct bits whose components are those of all pairs within the threshold; no bucket is left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def found(whole: bool) -> Iterator[pa.RecordBatch]:
            spot, bits = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            cut = len(spot) if whole else int(np.searchsorted(spot, spot[-1]))
            held[:] = [(spot[cut:], bits[cut:])]
            a, b = linked_within(spot[:cut], bits[:cut], threshold)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            held.append(tuple(batch.column(k).to_numpy() for k in ("spot", "bits")))
            n += batch.num_rows
            if n >= CHUNK:
                yield from found(False)
                # A spot of more members waits until as many have come again.
                n = -len(held[0][0]) if len(held[0][0]) >= CHUNK else len(held[0][0])
        if held:
            yield from found(True)

    return spots(distinct, threshold).repartition("spot").sortWithinPartitions("spot").mapInArrow(run, "a long, b long")


def whole_groups(hashed: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """groups of all pairs within the threshold, buckets of any size included: components of distinct bits, then of the hashes that have them."""
    rows = stored(hashed.select("hash", "bits"), "hashed")
    # groups reads the links in both directions; worked out twice, they may be other pairs where partitions are joined otherwise.
    linked = stored(links(rows.select("bits").distinct(), threshold), "linked")
    found = groups(linked).select(F.col("hash").alias("bits"), F.col("root").alias("label"))
    named = stored(rows.join(found, "bits", "left").select("hash", F.coalesce("label", "bits").alias("label")), "named")
    roots = named.groupBy("label").agg(F.min("hash").alias("root"), F.count("*").alias("n")).where("n > 1").drop("n")
    return named.join(roots, "label").select("hash", "root")


def keepers(grouped: DataFrame, members: DataFrame) -> DataFrame:
    """Members of each group by pixels, size, time and hash; the first is kept, the others are waste."""
    order = W.partitionBy("root").orderBy(F.desc("pixels"), F.desc("size"), F.coalesce("captured_at", F.lit("9999")), "hash")
    rows = grouped.join(members, "hash").withColumn("place", F.row_number().over(order))
    return rows.withColumn("keeper", F.col("place") == 1)


def wasted(ranked_rows: DataFrame) -> DataFrame:
    return ranked_rows.groupBy("root").agg(F.count("*").alias("members"), F.sum(F.when(F.col("keeper"), 0).otherwise(F.col("size"))).cast("bigint").alias("wasted_bytes"))


def apply_outcome(ranked_rows: DataFrame, decisions: DataFrame, verified: DataFrame, min_copies: int) -> DataFrame:
    """Gated deletion: a group marked whole is refused, so is one whose keeper has too few verified copies."""
    rows = ranked_rows.join(decisions, "hash", "left").join(verified, "hash", "left").withColumn("marked", F.coalesce(F.col("action") == "delete", F.lit(False)))
    every = W.partitionBy("root")
    kept = F.min(F.when(~F.col("marked"), F.struct("place", F.coalesce("copies", F.lit(0)).alias("copies")))).over(every)
    rows = rows.withColumn("kept", kept)
    outcome = F.when(~F.col("marked"), "untouched").when(F.col("kept").isNull(), "refused_all_marked").when(F.col("kept.copies") < min_copies, "refused_unverified").otherwise("deleted")
    return rows.select("hash", "root", outcome.alias("outcome"))


def needs_hash(asset: DataFrame, limit: int | None = None) -> DataFrame:
    """Live images that were never scanned; an empty hash is a failed scan and stays out."""
    rows = asset.where(S.live(F.col("deleted_at")) & (F.col("media_kind") == "image") & F.col("phash").isNull())
    return rows.orderBy("hash").limit(limit) if limit else rows


def scannable(asset: DataFrame) -> DataFrame:
    return asset.where(S.live(F.col("deleted_at")) & F.col("phash").isNotNull() & (F.col("phash") != ""))


def scanned(asset: DataFrame, results: DataFrame) -> DataFrame:
    """asset after an incremental scan: results(hash, phash, width, height) of what had no hash; a failure is kept as the empty text."""
    new = results.select("hash", F.coalesce("phash", F.lit("")).alias("new_phash"), F.col("width").alias("new_width"), F.col("height").alias("new_height"))
    rows = asset.join(new, "hash", "left")
    take = {c: F.when(F.col("phash").isNull(), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in ("phash", "width", "height")}
    return rows.select(*[take.get(c, F.col(c)) for c in asset.columns])


def members(ranked_rows: DataFrame, hashed: DataFrame) -> DataFrame:
    """Members of groups with the group's id and their distance from its keeper."""
    bits = hashed.select("hash", "bits")
    keeper = ranked_rows.where("keeper").select("root", "hash").join(bits, "hash").select("root", F.col("bits").alias("kept"))
    rows = ranked_rows.select("root", "hash", "place").join(bits, "hash").join(keeper, "root")
    return rows.select(F.substring("root", 1, 12).alias("id"), "hash", "place", S.hamming(F.col("bits"), F.col("kept")).cast("int").alias("distance"))


def reviewed(ranked_rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Whether any member of a group has a decision."""
    rows = ranked_rows.join(decisions.select("hash", "action"), "hash", "left")
    return rows.groupBy("root").agg(F.coalesce(F.bool_or(F.col("action").isNotNull()), F.lit(False)).alias("reviewed"))


def largest(groups_: DataFrame, limit: int) -> DataFrame:
    """Groups by wasted bytes."""
    return groups_.orderBy(F.desc("wasted_bytes"), "root").limit(limit)
