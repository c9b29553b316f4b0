"""The dataflows of the asset engine as tables of outcomes, and the rows that their writes leave.

disk is what storages really hold: (replica, rel_path or hash, actual), actual being the
hash of the bytes found. order says in which order replicas are asked: (replica,
place); it has a row for each replica and is broadcast. Nothing here writes; a
Store does, from the rows given back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import semantics as S


def _least(place: str = "place") -> Column:
    return F.min(F.struct(place, "replica"))["replica"]


def merged(old: DataFrame, new: DataFrame, keys: list[str], keep_if_null: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """old with the rows of new by key. Of several new rows of a key the greatest counts. Columns of keep_if_null yield to values only, those of keep never once they have one."""
    rest = [c for c in new.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("n")) if rest else new.distinct().withColumn("n", F.struct(F.lit(1).alias("there")))
    both = old.select(*keys, F.struct(*[c for c in old.columns if c not in keys]).alias("o")).join(one, keys, "full")
    out = []
    for c in [*old.columns, *[x for x in rest if x not in old.columns]]:
        if c in keys:
            out.append(F.col(c))
        elif c not in rest:
            out.append(F.col(f"o.{c}").alias(c))
        elif c not in old.columns:
            out.append(F.col(f"n.{c}").alias(c))
        elif c in keep:
            out.append(F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c))
        elif c in keep_if_null:
            out.append(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c))
        else:
            out.append(F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return both.select(*out)


def decided(old: DataFrame, new: DataFrame) -> DataFrame:
    """Decisions after new ones: an empty action clears, any other replaces."""
    return merged(old, new, ["hash"]).where(F.coalesce("action", F.lit("")) != "")


def ingest(files: DataFrame, asset: DataFrame, replica: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Outcome of each file, and rows for asset, source_file and placement.

    files: hash, device, abs_path, size, ext, captured_at, time_source. The first path of
    a content that the library does not hold is imported, all others are duplicates.
    """
    first = files.groupBy("hash").agg(F.min(F.struct("abs_path", "device")).alias("first"))
    seen = files.join(first, "hash").join(asset.select("hash", F.lit(True).alias("known")), "hash", "left")
    new = F.col("known").isNull() & (F.struct("abs_path", "device") == F.col("first"))
    rows = seen.withColumn("outcome", F.when(new, "imported").otherwise("duplicate"))
    added = rows.where("outcome = 'imported'").dropDuplicates(["hash"]).withColumn("rel_path", S.canonical_path(F.col("hash"), F.col("captured_at"), F.col("ext")))
    assets = added.select("hash", "size", "ext", S.media_kind(F.col("ext")).alias("media_kind"), "captured_at", "time_source", "rel_path")
    return rows.select("abs_path", "hash", "outcome"), assets, files.select("hash", "device", "abs_path"), added.select("hash", F.lit(replica).alias("replica"), F.lit("present").alias("state"))


def good_copies(disk: DataFrame, order: DataFrame) -> DataFrame:
    """hash, good (number of replicas whose bytes hash right), source (the first of them in order)."""
    right = disk.where(F.col("actual") == F.col("hash")).join(F.broadcast(order), "replica")
    return right.groupBy("hash").agg(F.count("*").alias("good"), _least().alias("source"))


def scrub(due: DataFrame, disk: DataFrame, order: DataFrame, repair: bool = True) -> DataFrame:
    """hash, replica, found (ok, vanished, corrupt), outcome (ok, repaired, unrepairable, or as found without repair), source, state after it.

    A broken copy is never its own source, as its bytes don't hash right.
    """
    seen = due.select("hash", "replica").join(disk.select("hash", "replica", "actual"), ["hash", "replica"], "left")
    found = F.when(F.col("actual") == F.col("hash"), "ok").when(F.col("actual").isNull(), "vanished").otherwise("corrupt")
    rows = seen.withColumn("found", found).join(good_copies(disk, order), "hash", "left")
    broken = F.col("found") != "ok"
    source = F.when(broken & F.lit(repair), F.col("source"))
    outcome = F.when(~broken | F.lit(not repair), F.col("found")).when(F.col("source").isNotNull(), "repaired").otherwise("unrepairable")
    rows = rows.select("hash", "replica", "found", outcome.alias("outcome"), source.alias("source"))
    state = F.when(F.col("outcome").isin("ok", "repaired"), "present").when(F.col("found") == "vanished", "missing").otherwise("corrupt")
    return rows.withColumn("state", state)


def scrubbed(placement: DataFrame, outcomes: DataFrame, at: str) -> DataFrame:
    """placement after a scrub: what was found or repaired is verified now, a loss keeps the time of its last check."""
    when = F.when(F.col("state") == "present", F.lit(at).cast("timestamp_ntz"))
    return merged(placement, outcomes.select("hash", "replica", "state", when.alias("verified_at")), ["hash", "replica"], ("verified_at",))


def push(missing: DataFrame, planned: DataFrame | None, placement: DataFrame, order: DataFrame, replica: str, limit: int | None = None) -> DataFrame:
    """hash, size, source, outcome of what a replica lacks and should hold; planned is None for one that holds everything.

    The source is the first other replica in order with a present copy. A limit cuts what is planned, by path.
    """
    rows = missing if planned is None else missing.join(planned.select("hash").distinct(), "hash", "left_semi")
    rows = rows.orderBy("rel_path", "hash").limit(limit) if limit else rows
    held = placement.where((F.col("state") == "present") & (F.col("replica") != replica)).join(F.broadcast(order), "replica")
    rows = rows.join(held.groupBy("hash").agg(_least().alias("source")), "hash", "left")
    return rows.select("hash", "size", "source", F.when(F.col("source").isNull(), "no_source").otherwise("copied").alias("outcome"))


def pushed(placement: DataFrame, outcomes: DataFrame, replica: str) -> DataFrame:
    """placement after a push: present, with the time of its last check as it was."""
    new = outcomes.where("outcome = 'copied'").select("hash", F.lit(replica).alias("replica"), F.lit("present").alias("state"))
    return merged(placement, new, ["hash", "replica"])


def rebuild(files: DataFrame, asset: DataFrame, placement: DataFrame, replica: str, at: str) -> tuple[DataFrame, DataFrame]:
    """New assets and the placement after all media of a replica were hashed. files: rel_path, actual, size, ext."""
    named = files.where(F.col("actual").isNotNull()).groupBy(F.col("actual").alias("hash")).agg(F.min(F.struct("rel_path", "size", "ext")).alias("x")).select("hash", "x.*")
    new = named.join(asset.select("hash"), "hash", "left_anti")
    rows = named.select("hash", F.lit(replica).alias("replica"), F.lit("present").alias("state"), F.lit(at).cast("timestamp_ntz").alias("verified_at"))
    return new, merged(placement, rows, ["hash", "replica"])


def rebalance(surplus: DataFrame, disk: DataFrame, replica: str, min_copies: int) -> DataFrame:
    """Copies held but not planned: removed where at least min_copies other replicas hold bytes that hash right."""
    others = disk.where((F.col("replica") != replica) & (F.col("actual") == F.col("hash"))).groupBy("hash").agg(F.count("*").alias("good"))
    rows = surplus.select("hash").join(others, "hash", "left").select("hash", F.coalesce("good", F.lit(0)).alias("good"))
    return rows.withColumn("outcome", F.when(F.col("good") >= min_copies, "removed").otherwise("kept"))


def trash(hashes: DataFrame, asset: DataFrame) -> DataFrame:
    """Outcome of moving hashes to the trash: moved, already there, or missing from the library. Each hash counts once."""
    rows = hashes.select("hash").distinct().join(asset.select("hash", "size", "deleted_at", F.lit(True).alias("known")), "hash", "left")
    return rows.select("hash", "size", F.when(F.col("known").isNull(), "missing").when(F.col("deleted_at").isNotNull(), "already").otherwise("moved").alias("outcome"))


def restored(hashes: DataFrame, asset: DataFrame) -> DataFrame:
    """Hashes that come back from the trash."""
    return asset.where(F.col("deleted_at").isNotNull()).join(hashes.select("hash").distinct(), "hash", "left_semi").select("hash", "size")


def purge(due: DataFrame, replicas: DataFrame) -> DataFrame:
    """All of due are purged, or none where any replica is out of reach. replicas: replica, reachable; a row for each."""
    away = replicas.where("not reachable").agg(F.array_join(F.array_sort(F.collect_list("replica")), ", ").alias("away"))  # one row
    rows = due.select("hash", "size").join(F.broadcast(away))
    return rows.select("hash", "size", F.when(F.col("away") == "", "purged").otherwise("skipped").alias("outcome"), F.nullif(F.col("away"), F.lit("")).alias("blocked_by"))


def redate(weak: DataFrame, found: DataFrame, key: str = "hash") -> DataFrame:
    """hash, old_path, new_path, captured_at, source, outcome (moved or unchanged) for weakly dated assets with a better date found (hash, at, label).

    Where another column says which asset is meant, key names it; it comes first in the result.
    """
    names = list(dict.fromkeys([key, "hash"]))
    one = found.where(F.col("at").isNotNull()).groupBy(key).agg(F.min(F.struct("at", "label")).alias("x"))
    rows = weak.select(*names, "rel_path", "ext").join(one, key)
    rows = rows.select(*names, F.col("rel_path").alias("old_path"), S.canonical_path(F.col("hash"), F.col("x.at"), F.col("ext")).alias("new_path"), F.col("x.at").alias("captured_at"), F.col("x.label").alias("source"))
    return rows.withColumn("outcome", F.when(F.col("old_path") == F.col("new_path"), "unchanged").otherwise("moved"))


def redated(asset: DataFrame, placement: DataFrame, moves: DataFrame, moved_on: DataFrame, replicas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """asset and placement after files were moved. moved_on: hash, replica of the moves that worked; every other replica (a row for each in replicas) lacks the new path."""
    new = moves.where("outcome = 'moved'").select("hash", F.col("new_path").alias("rel_path"), "captured_at", F.col("source").alias("time_source"))
    gone = new.select("hash").join(F.broadcast(replicas.select("replica"))).join(moved_on, ["hash", "replica"], "left_anti").withColumn("state", F.lit("missing"))
    return merged(asset, new, ["hash"]), merged(placement, gone, ["hash", "replica"])


def export(asset: DataFrame, disk: DataFrame, order: DataFrame) -> DataFrame:
    """hash, rel_path, source: the first replica whose bytes hash right, or none where the asset is lost."""
    rows = asset.select("hash", "rel_path").join(good_copies(disk, order), "hash", "left")
    return rows.select("hash", "rel_path", "source", F.when(F.col("source").isNull(), "unrecoverable").otherwise("restored").alias("outcome"))


def recovery_kit(asset: DataFrame, placement: DataFrame, replica: DataFrame) -> DataFrame:
    """Files and bytes of each replica, and whether it holds part of the library only."""
    held = placement.where("state = 'present'").join(asset.where(S.live(F.col("deleted_at"))).select("hash", "size"), "hash")
    sums = held.groupBy("replica").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return replica.select("replica", F.col("is_shard").alias("partial")).join(sums, "replica", "left").na.fill(0, ["files", "bytes"])


def identities(storages: DataFrame) -> DataFrame:
    """replica, outcome, uuid to remember for storages(replica, known, marker as text): first use claims, anything that doesn't fit is refused."""
    m = S.marker(F.col("marker"))
    rows = storages.select("replica", "known", m["replica"].alias("named"), m["uuid"].alias("uuid"))
    outcome = (
        F.when(F.col("uuid").isNull() & F.col("known").isNotNull(), "refused_unmarked").when(F.col("uuid").isNull(), "claimed")
        .when(~F.col("named").eqNullSafe(F.col("replica")), "refused_wrong_name").when(F.col("known").isNotNull() & (F.col("known") != F.col("uuid")), "refused_wrong_uuid").otherwise("verified")
    )
    rows = rows.withColumn("outcome", outcome)
    return rows.select("replica", "outcome", F.when(F.col("outcome") == "verified", F.col("uuid")).otherwise(F.col("known")).alias("uuid"))


def reachability(replicas: DataFrame) -> DataFrame:
    """replica, class: reachable, offline as it may be, or missing though it should be there."""
    return replicas.select("replica", F.when(F.col("reachable"), "reachable").when(F.col("is_offline"), "missing_offline").otherwise("missing_online").alias("class"))


def preflight(replicas: DataFrame, checks: DataFrame) -> DataFrame:
    """One row: counts by class, issues of health, and whether work may start."""
    classes = reachability(replicas).agg(*[F.count_if(F.col("class") == c).alias(c) for c in ("reachable", "missing_offline", "missing_online")])
    issues = F.array_compact(F.array(F.when(F.col("single_copy") > 0, "single_copy"), F.when(F.col("underprotected") > 0, "underprotected"), F.when(F.col("corrupt") > 0, "corrupt")))
    return classes.join(F.broadcast(checks)).select("reachable", "missing_offline", "missing_online", F.array_join(issues, ",").alias("issues"), (F.col("missing_online") == 0).alias("ready"))


def blocked(operations: DataFrame, needs_all: list[str], replicas: DataFrame) -> DataFrame:
    """operations with blocked_by: the replicas out of reach, for those that need all."""
    away = replicas.where("not reachable").agg(F.array_join(F.array_sort(F.collect_list("replica")), ",").alias("away"))  # one row
    rows = operations.join(F.broadcast(away))
    return rows.withColumn("blocked_by", F.when(F.col("operation").isin(*needs_all), F.col("away")).otherwise("")).drop("away")


def stale(last: DataFrame, replicas: DataFrame, now: str, after: int = 30) -> DataFrame:
    """replica, days since its last run, whether an offline one is stale, whether it is the worst of these. last: replica, at."""
    days = S.stale_days(F.col("at"), F.lit(now).cast("timestamp_ntz"))
    rows = replicas.select("replica", "is_offline").join(last, "replica", "left").select("replica", "is_offline", days.alias("days"))
    rows = rows.withColumn("stale", F.col("is_offline") & F.coalesce(F.col("days") >= after, F.lit(True)))
    worst = rows.where("is_offline").agg(F.max("days").alias("most"))  # one row
    return rows.join(F.broadcast(worst)).select("replica", "days", "stale", (F.col("is_offline") & F.col("days").eqNullSafe(F.col("most"))).alias("worst"))


def staged_summary(files: DataFrame, samples: int = 5) -> DataFrame:
    """Count, bytes and the first paths of staged files."""
    some = files.orderBy("rel_path").limit(samples).agg(F.array_join(F.array_sort(F.collect_list("rel_path")), ",").alias("samples"))  # one row
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes")).join(F.broadcast(some))


def manifest(photos: DataFrame, prefix: str) -> DataFrame:
    """Albums with their photos nested, by place: album, photo_count, photos(file, library_path, checksum). photos: album, place, file, path, checksum."""
    one = F.struct("place", "file", S.library_path(F.col("path"), prefix).alias("library_path"), "checksum")
    rows = photos.groupBy("album").agg(F.count("*").alias("photo_count"), F.array_sort(F.collect_list(one)).alias("photos"))
    return rows.select("album", "photo_count", F.transform("photos", lambda x: F.struct(x["file"].alias("file"), x["library_path"].alias("library_path"), x["checksum"].alias("checksum"))).alias("photos"))


def backup_age(snapshots: DataFrame, now: str) -> DataFrame:
    """Newest snapshot of each owner and its age in whole days. snapshots: owner, name, at."""
    last = snapshots.groupBy("owner").agg(F.max(F.struct("at", "name")).alias("x"))
    return last.select("owner", F.col("x.name").alias("newest"), S.stale_days(F.col("x.at"), F.lit(now).cast("timestamp_ntz")).alias("days"))


def by_time(snapshots: DataFrame, newest: int | None = None) -> DataFrame:
    """Snapshots with their place by time, newest first."""
    rows = snapshots.withColumn("place", F.row_number().over(W.partitionBy("owner").orderBy(F.desc("at"), F.desc("name"))))
    return rows if newest is None else rows.where(F.col("place") <= newest)
