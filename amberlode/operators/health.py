"""Redundancy assessment over asset, placement and replica."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import live

MIN_COPIES = 3


def totals(asset: DataFrame) -> DataFrame:
    return asset.where(live(F.col("deleted_at"))).agg(F.count("*").alias("assets"), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes"))


def per_replica(asset: DataFrame, placement: DataFrame, replica: DataFrame) -> DataFrame:
    """Counts by state and bytes of present copies; a replica without rows has zeros."""
    rows = placement.join(asset.where(live(F.col("deleted_at"))).select("hash", "size"), "hash")
    states = [F.count_if(F.col("state") == s).alias(s) for s in ("present", "missing", "corrupt")]
    held = rows.groupBy("replica").agg(*states, F.sum(F.when(F.col("state") == "present", F.col("size")).otherwise(0)).alias("bytes"))
    return replica.select("replica", "is_offline").join(held, "replica", "left").na.fill(0, ["present", "missing", "corrupt", "bytes"])


def copies(asset: DataFrame, placement: DataFrame, replica: DataFrame) -> DataFrame:
    """hash, copies, offline_copies, bad of every live asset: one conditional aggregation, zeros where nothing is placed."""
    offline = replica.where("is_offline").select("replica", F.lit(True).alias("off"))
    present = F.col("state") == "present"
    seen = placement.join(F.broadcast(offline), "replica", "left").groupBy("hash")  # a row for each replica
    seen = seen.agg(F.count_if(present).alias("copies"), F.count_if(present & F.coalesce("off", F.lit(False))).alias("offline_copies"), F.count_if(F.col("state") == "corrupt").alias("bad"))
    return asset.where(live(F.col("deleted_at"))).select("hash", "size").join(seen, "hash", "left").na.fill(0)


def histogram(counted: DataFrame) -> DataFrame:
    return counted.groupBy("copies").agg(F.count("*").alias("assets"))


def checks(counted: DataFrame, replica: DataFrame, require_offline: bool = True, min_copies: int = MIN_COPIES) -> DataFrame:
    """Zero copies count as single; the verdict leaves single copies out. Assets without an offline copy count only where some replica is offline."""
    require_offline = require_offline and bool(replica.where("is_offline").limit(1).count())
    out = counted.agg(
        F.count_if(F.col("copies") < min_copies).alias("underprotected"), F.count_if(F.col("copies") <= 1).alias("single_copy"),
        F.count_if((F.col("offline_copies") == 0) & F.lit(require_offline)).alias("no_offline"), F.count_if(F.col("bad") > 0).alias("corrupt"),
    )
    return out.withColumn("ok", (F.col("underprotected") == 0) & (F.col("corrupt") == 0) & (F.col("no_offline") == 0))


def never_verified(placement: DataFrame) -> DataFrame:
    return placement.where("state = 'present' and verified_at is null").agg(F.count("*").alias("never_verified"))


def copies_per_hash(placement: DataFrame) -> DataFrame:
    return placement.where("state = 'present'").groupBy("hash").agg(F.count("*").alias("copies"))
