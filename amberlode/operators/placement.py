"""Weighted rendezvous placement of assets on shards."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.semantics import parse_size, placement_score
from ..sources.scratch import stored

HEADROOM = 0.10


def ranked(asset: DataFrame, shards: DataFrame) -> DataFrame:
    """hash, size and all shards by falling score: one array of a struct for each shard, without a shuffle.

    shards holds a row for each drive, so it is read on the driver.
    """
    drives = [(r["replica"], float(r["weight"]), bool(r["is_offline"])) for r in shards.orderBy("replica").collect()]
    scored = [F.struct((-placement_score(F.col("hash"), F.lit(n), F.lit(w))).alias("order"), F.lit(n).alias("replica"), F.lit(off).alias("is_offline")) for n, w, off in drives]
    return asset.select("hash", "size", F.array_sort(F.array(*scored)).alias("drives"))


def plan(asset: DataFrame, shards: DataFrame, k: int, require_offline: bool = False) -> DataFrame:
    """hash, size, replica, rank of the k best shards.

    Where an offline copy is required and none is among them, the last gives way
    to the best offline drive.
    """
    rows = ranked(asset, shards).select("hash", "size", F.posexplode(_best(k, require_offline)).alias("pos", "d"))
    return rows.select("hash", "size", F.col("d.replica").alias("replica"), (F.col("pos") + 1).cast("int").alias("rank"))


def _best(k: int, require_offline: bool) -> Column:
    picked, rest = F.slice("drives", 1, k), F.filter("drives", lambda x: x["is_offline"])
    swap = ~F.exists(picked, lambda x: x["is_offline"]) & (F.size(rest) > 0) & F.lit(require_offline)
    return F.when(swap, F.concat(F.slice("drives", 1, k - 1), F.slice(rest, 1, 1))).otherwise(picked)


RANGE_CHARS = 3


def used_running(plan_rows: DataFrame) -> DataFrame:
    """replica, hash, used: the bytes planned for a replica up to each hash, in hash order; equal hashes count together.

    A window runs over a replica's hashes that share their first RANGE_CHARS characters, and the sums of the
    ranges before are added. The ranges are 4,096 for each replica at any size of the input, and hashes fall evenly on them.
    """
    rows = plan_rows.select("replica", "hash", "size", F.coalesce(F.substring("hash", 1, RANGE_CHARS), F.lit("")).alias("range"))
    sums = rows.groupBy("replica", "range").agg(F.sum("size").alias("bytes"))
    ahead = F.sum("bytes").over(W.partitionBy("replica").orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select("replica", "range", ahead.alias("ahead"))
    within = rows.withColumn("within", F.sum("size").over(W.partitionBy("replica", "range").orderBy("hash")))
    return within.join(F.broadcast(sums), ["replica", "range"]).select("replica", "hash", F.coalesce(F.col("ahead") + F.col("within"), "within", "ahead").alias("used"))


def plan_stats(plan_rows: DataFrame) -> DataFrame:
    return plan_rows.groupBy("replica").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def overflowing(plan_rows: DataFrame, capacity: dict[str, int]) -> DataFrame:
    """Shards whose planned bytes exceed their capacity. If there is none, filling drives in order would plan the same."""
    limit = F.create_map(*[F.lit(x) for kv in capacity.items() for x in kv])
    return plan_stats(plan_rows).withColumn("capacity", F.try_element_at(limit, F.col("replica"))).where(F.col("bytes") > F.col("capacity"))


def shards_needed(min_copies: int, full: int) -> int:
    """Copies that shards must add to those of the replicas that hold everything."""
    return max(0, min_copies - full)


def usable(shards: DataFrame) -> DataFrame:
    """shards with their capacity less headroom, and weight: the capacity, or 1 where it is not known or all are unknown. capacity is text such as '1.8TB' or auto."""
    room = F.floor(parse_size(F.col("capacity")) * (1 - HEADROOM)).cast("bigint")
    return shards.withColumn("room", room).withColumn("weight", F.when(F.col("room") > 0, F.col("room").cast("double")).otherwise(1.0))


def planned_for(plan_rows: DataFrame, replica: DataFrame, name: str) -> DataFrame | None:
    """Hashes that a shard should hold; None for a replica that holds everything."""
    shard = [r["is_shard"] for r in replica.where(F.col("replica") == name).select("is_shard").collect()]
    return plan_rows.where(F.col("replica") == name).select("hash") if shard and shard[0] else None


CHUNK_ROWS = 200_000


def plan_within(asset: DataFrame, shards: DataFrame, k: int, capacity: dict[str, int], require_offline: bool = False) -> DataFrame:
    """hash, size, replicas, short: assets in hash order take their k best shards that still have room.

    A drive that is full for one asset is passed over; a smaller one later may still
    fit. Where an offline copy is required and none was picked, the last pick gives
    way to the best offline drive with room. The table is cut into ranges of hashes of about CHUNK_ROWS rows. While no drive
    fills, the plan without capacities is right, so prefix sums of its bytes by range
    tell up to where all ranges can be planned at once. From there on one range
    after the other is walked on an executor. The driver sees the bytes used by each
    drive and range only, no rows.
    """
    ranks = ranked(asset, shards)
    chunks = max(1, -(-asset.count() // CHUNK_ROWS))
    of = F.floor(F.conv(F.substring("hash", 1, 8), 16, 10).cast("bigint") * chunks / 2**32).cast("int")
    rows = stored(ranks.withColumn("chunk", of), "ranked")
    chosen = _best(k, require_offline)
    free = rows.select("hash", "size", "chunk", F.transform(chosen, lambda x: x["replica"]).alias("replicas"))
    used, first = dict.fromkeys(capacity, 0), chunks
    sums: dict[int, dict[str, int]] = {}
    for r in free.select("chunk", "size", F.explode("replicas").alias("replica")).groupBy("chunk", "replica").agg(F.sum("size").alias("bytes")).collect():
        sums.setdefault(r["chunk"], {})[r["replica"]] = r["bytes"]
    for c in range(chunks):
        after = {name: n + sums.get(c, {}).get(name, 0) for name, n in used.items()}
        if any(n > capacity[name] for name, n in after.items()):
            first = c
            break
        used = after
    out = free.where(F.col("chunk") < first).select("hash", "size", "replicas", (F.size("replicas") < k).alias("short"))
    for c in range(first, chunks):
        done = stored(_walked(rows.where(F.col("chunk") == c), k, capacity, dict(used), require_offline), "planned")
        for r in done.select("size", F.explode("replicas").alias("replica")).groupBy("replica").agg(F.sum("size").alias("bytes")).collect():
            if r["replica"] in used:
                used[r["replica"]] += r["bytes"]
        out = out.unionByName(done)
    return out


def _walked(rows: DataFrame, k: int, capacity: dict[str, int], used: dict[str, int], require_offline: bool) -> DataFrame:
    """One range of hashes in order, from the bytes used before it."""

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        held, out = dict(used), []
        for row in part.sort_values("hash").itertuples():
            fits = [d for d in row.drives if held.get(d["replica"], 0) + row.size <= capacity.get(d["replica"], float("inf"))]
            picked = fits[:k]
            if require_offline and not any(d["is_offline"] for d in picked):
                other = next((d for d in fits if d["is_offline"]), None)
                if other is not None:
                    picked = [*picked[:-1], other]
            names = [d["replica"] for d in picked]
            for name in names:
                held[name] = held.get(name, 0) + row.size
            out.append((row.hash, row.size, names, len(names) < k))
        return pd.DataFrame(out, columns=["hash", "size", "replicas", "short"])

    return rows.select("chunk", "hash", F.col("size").alias("size"), "drives").groupBy("chunk").applyInPandas(walk, "hash string, size bigint, replicas array<string>, short boolean")


def fill(planned: DataFrame, capacity: dict[str, int]) -> DataFrame:
    """replica, files, bytes, capacity and fill of a plan (hash, size, replicas)."""
    limit = F.create_map(*[F.lit(x) for kv in capacity.items() for x in kv])
    sums = plan_stats(planned.select("size", F.explode("replicas").alias("replica")))
    return sums.withColumn("capacity", F.try_element_at(limit, F.col("replica")).cast("bigint")).withColumn("fill", F.col("bytes") / F.col("capacity"))


def unplaceable(planned: DataFrame, full: int = 0) -> DataFrame:
    """Assets that got fewer copies than wanted, with the number that they got."""
    return planned.where("short").select("hash", (F.size("replicas") + full).alias("copies"))


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """Copies that a plan has and the one before had not."""
    new = after.join(before.select("hash", "replica"), ["hash", "replica"], "left_anti").agg(F.count("*").alias("moved"))
    return new.crossJoin(after.agg(F.count("*").alias("total")))  # one row each


def surplus(placement: DataFrame, plan_rows: DataFrame, replica: str, min_copies: int) -> DataFrame:
    """Copies held but not planned on a replica, and whether enough other replicas hold them."""
    here = placement.where((F.col("replica") == replica) & (F.col("state") == "present")).select("hash")
    extra = here.join(plan_rows.where(F.col("replica") == replica).select("hash"), "hash", "left_anti")
    others = placement.where((F.col("replica") != replica) & (F.col("state") == "present")).groupBy("hash").agg(F.count("*").alias("others"))
    return extra.join(others, "hash", "left").select("hash", F.coalesce("others", F.lit(0)).alias("others"), (F.coalesce("others", F.lit(0)) >= min_copies).alias("removable"))
