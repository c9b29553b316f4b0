"""Timeline, browsing, trash, events, schedules and joins over the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import semantics as S


def timeline(asset: DataFrame, live_only: bool = False) -> DataFrame:
    rows = asset.where(F.col("captured_at").isNotNull() & (S.live(F.col("deleted_at")) | F.lit(not live_only)))
    return rows.groupBy(F.date_format("captured_at", "yyyy").alias("year"), F.date_format("captured_at", "MM").alias("month")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def timeline_rollup(asset: DataFrame) -> DataFrame:
    rows = asset.where("captured_at is not null").select(F.date_format("captured_at", "yyyy").alias("year"), F.date_format("captured_at", "MM").alias("month"), "size")
    return rows.rollup("year", "month").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def undated(asset: DataFrame) -> DataFrame:
    return asset.where("captured_at is null").agg(F.count("*").alias("undated"))


def browse(asset: DataFrame, year: str | None = None, month: int | None = None, kind: str | None = None, undated: bool = False, trashed: bool = False) -> DataFrame:
    """Filtered library; undated sets year and month aside."""
    keep = F.col("deleted_at").isNotNull() if trashed else S.live(F.col("deleted_at"))
    at = F.col("captured_at")
    if undated:
        keep &= at.isNull()
    elif year and month:
        start = F.make_timestamp_ntz(F.lit(int(year)), F.lit(month), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
        keep &= (at >= start) & (at < start + F.expr("interval 1 month"))  # a range, which a scan can prune by
    elif year:
        keep &= (at >= F.lit(f"{int(year):04d}-01-01").cast("timestamp_ntz")) & (at < F.lit(f"{int(year) + 1:04d}-01-01").cast("timestamp_ntz"))
    elif month:
        keep &= F.month(at) == month
    return asset.where(keep & (F.col("media_kind") == kind) if kind else keep)


def page(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(F.col("captured_at").desc(), F.col("rel_path").desc(), "hash").offset(offset).limit(limit)


def trash_summary(asset: DataFrame, due_before: str) -> DataFrame:
    out = asset.where("deleted_at is not null")
    due = F.count_if(F.col("deleted_at") < F.lit(due_before).cast("timestamp_ntz"))
    return out.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes"), S.rendered(F.min("deleted_at")).alias("oldest"), due.alias("expired"))


def scrub_due(placement: DataFrame, cutoff: str, reachable: list[str] | None = None) -> DataFrame:
    """Present copies never verified or verified before the cutoff; reachable replicas are picked before any limit."""
    rows = placement.where((F.col("state") == "present") & (F.col("verified_at").isNull() | (F.col("verified_at") < F.lit(cutoff).cast("timestamp_ntz"))))
    return rows if reachable is None else rows.where(F.col("replica").isin(reachable))


def oldest_first(due: DataFrame, limit: int) -> DataFrame:
    return due.orderBy(F.col("verified_at").asc_nulls_first(), "hash", "replica").limit(limit)


def last_run(event: DataFrame) -> DataFrame:
    return event.groupBy("kind").agg(S.rendered(F.max("at")).alias("last_at"), F.count("*").alias("n"))


def operations(event: DataFrame, kinds: dict[str, list[str]]) -> DataFrame:
    """Last run of each operation over the event kinds that it logs; none is null."""
    spark = event.sparkSession
    catalog = spark.createDataFrame([(k, v or [""]) for k, v in kinds.items()], "operation string, kinds array<string>")
    wanted = catalog.select("operation", F.explode("kinds").alias("kind"))
    return wanted.join(last_run(event), "kind", "left").groupBy("operation").agg(F.max("last_at").alias("last_at"))


def missing_on(asset: DataFrame, placement: DataFrame, replica: str) -> DataFrame:
    have = placement.where((F.col("replica") == replica) & (F.col("state") == "present")).select("hash")
    return asset.where(S.live(F.col("deleted_at"))).join(have, "hash", "left_anti")


def search(asset: DataFrame, needles: list[str]) -> DataFrame:
    """Hash prefix or path part, any of them."""
    hit = F.lit(False)
    for n in needles:
        hit |= F.col("hash").startswith(n) | F.contains("rel_path", F.lit(n))
    return asset.where(hit).select("hash", "rel_path").distinct()


def reclaim(files: DataFrame, asset: DataFrame, verified: DataFrame, min_copies: int) -> DataFrame:
    """Each staged file: not imported, short of verified copies, or safe to remove."""
    rows = files.join(asset.select("hash", F.lit(True).alias("known")), "hash", "left").join(verified, "hash", "left")
    outcome = F.when(F.col("known").isNull(), "not_imported").when(F.coalesce("copies", F.lit(0)) < min_copies, "short").otherwise("safe")
    return rows.withColumn("outcome", outcome)


def retention(snapshots: DataFrame, keep: int) -> DataFrame:
    """Newest keep snapshots by name stay for each owner and kind."""
    place = F.row_number().over(W.partitionBy("owner", "kind").orderBy(F.desc("name")))
    return snapshots.withColumn("place", place).withColumn("pruned", F.col("place") > keep)


def reconcile(asset: DataFrame, placement: DataFrame, listing: DataFrame, planned: DataFrame, replica: str, sticky_corrupt: bool = False) -> DataFrame:
    """State of every asset on one replica after its listing was read.

    On disk: present. Planned but not there: missing, unless it is corrupt.
    Neither planned nor there: the placement goes.
    """
    old = placement.where(F.col("replica") == replica).select("hash", F.col("state").alias("old"))
    rows = asset.select("hash", "rel_path").join(listing.select("rel_path", F.lit(True).alias("here")), "rel_path", "left").join(old, "hash", "left").join(planned.select("hash", F.lit(True).alias("wanted")), "hash", "left")
    corrupt = F.coalesce(F.col("old") == "corrupt", F.lit(False))
    state = F.when(F.col("here") & corrupt & F.lit(sticky_corrupt), "corrupt").when(F.col("here"), "present").when(F.col("wanted") & corrupt, "corrupt").when(F.col("wanted"), "missing")
    action = F.when(F.col("new").isNull() & F.col("old").isNotNull(), "delete").when(F.col("old").isNull() & F.col("new").isNotNull(), "insert").when(F.col("old") != F.col("new"), "update").otherwise("keep")
    return rows.withColumn("new", state).withColumn("action", action).where("old is not null or new is not null").select("hash", "old", "new", "action")


def first_seen(files: DataFrame) -> DataFrame:
    """Ingest by content: the first path of each content is imported, the others are duplicates."""
    rank = F.min(F.struct("doc_id", "abs_path")).alias("x")
    return files.groupBy("hash").agg(rank, F.count("*").alias("files"), F.first("size").alias("size")).select("hash", F.col("x.doc_id").alias("doc_id"), F.col("x.abs_path").alias("abs_path"), "files", "size")
