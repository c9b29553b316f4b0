"""The asset model as views over the driver's tables.

asset from orders, replica from region, placement from lineitem through supplier
and nation, event from events, source files and texts from documents, decisions
from labels. DUCK holds the same views as SQL common table expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import semantics as S

EXTS = ("jpg", "heic", "png", "mov", "mp4", "txt")
SOURCES = ("exif", "quicktime", "filename", "mtime", "unknown")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    source = F.element_at(F.array(*map(F.lit, SOURCES)), F.substring("o_orderpriority", 1, 1).cast("int"))
    o = o.select(
        "o_orderkey", F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256).alias("hash"), F.round("o_totalprice").cast("bigint").alias("size"),
        F.element_at(F.array(*map(F.lit, EXTS)), (F.col("o_orderkey") % len(EXTS) + 1).cast("int")).alias("ext"), source.alias("time_source"), F.col("o_orderdate").alias("added_at"),
        F.when(source != "unknown", F.col("o_orderdate")).alias("captured_at"), F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate")).alias("deleted_at"),
    )
    return o.select("*", S.media_kind(F.col("ext")).alias("media_kind"), S.canonical_path(F.col("hash"), F.col("captured_at"), F.col("ext")).alias("rel_path"))


def replica(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rows: the first keeps everything, the others are shards weighted by their key; two are offline."""
    r = read(spark, sf_dir, "region")
    return r.select(F.col("r_name").alias("replica"), (F.col("r_regionkey") >= 3).alias("is_offline"), (F.col("r_regionkey") > 0).alias("is_shard"), F.col("r_regionkey").cast("double").alias("weight"), F.col("r_regionkey").alias("place"))


def named(rows: DataFrame) -> DataFrame:
    """rows whose column hash holds keys of orders, with the hashes of these keys in their place."""
    return rows.withColumn("hash", F.sha2(F.col("hash").cast("string").cast("binary"), 256))


def placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each asset and replica: the latest line wins."""
    return named(placement_by_key(spark, sf_dir))


def placement_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """placement with the key of the order as hash: dataflows that only compare hashes shuffle 8 bytes instead of 64, and name them at the end."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate", "l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag", "l_linestatus")
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").join(F.broadcast(read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")), "n_regionkey")  # five regions
    site = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey")).join(nation, "n_nationkey").select("l_suppkey", F.col("r_name").alias("replica"))
    last = F.max(F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus")).alias("x")
    held = line.join(site, "l_suppkey").groupBy("l_orderkey", "replica").agg(last)
    state = F.when(F.col("x.l_returnflag") == "N", "present").when(F.col("x.l_returnflag") == "A", "missing").otherwise("corrupt")
    return held.select(F.col("l_orderkey").alias("hash"), "replica", state.alias("state"), F.when(F.col("x.l_linestatus") == "F", F.col("x.l_shipdate")).alias("verified_at"))


def disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What storages really hold of each placement: most bytes hash right, some don't, some files are gone."""
    return _held(spark, sf_dir, placement(spark, sf_dir), asset(spark, sf_dir), F.sha2(F.concat("hash", F.lit("x")).cast("binary"), 256))


def disk_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """disk with keys of orders as hashes; bytes that hash wrong have a number that no key of theirs has."""
    return _held(spark, sf_dir, placement_by_key(spark, sf_dir), asset(spark, sf_dir).withColumn("hash", F.col("o_orderkey")), -1 - F.col("hash"))


def _held(spark: SparkSession, sf_dir: str, placed: DataFrame, assets: DataFrame, wrong: Column) -> DataFrame:
    order = F.broadcast(replica(spark, sf_dir).select("replica", "place"))  # five rows
    rows = placed.select("hash", "replica").join(assets.select("hash", "o_orderkey", "rel_path", "size", "ext"), "hash").join(order, "replica")
    k = (F.col("o_orderkey") * 7 + F.col("place") * 3) % 11
    actual = F.when(k < 8, F.col("hash")).when(k == 8, wrong)
    return rows.select("hash", "replica", "place", "rel_path", "size", "ext", actual.alias("actual"))


def event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"), F.col("event_type").alias("kind"), F.col("props").alias("detail"), "user_id")


def source_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"), F.col("source").alias("device"), F.concat(F.lit("/scan/"), F.col("doc_id").cast("string")).alias("abs_path"), F.octet_length("text").cast("bigint").alias("size"))


_CASE = " ".join(f"when '{i + 1}' then '{s}'" for i, s in enumerate(SOURCES))
_EXT = " ".join(f"when {i} then '{e}'" for i, e in enumerate(EXTS))
DUCK = f"""
asset as (
  select *, case when ext in ('mov', 'mp4') then 'video' when ext = 'txt' then 'other' else 'image' end as media_kind,
    case when captured_at is null then 'unknown/' || substr(hash, 1, 2) || '/' || substr(hash, 1, 10) || '.' || ext
         else strftime(captured_at, '%Y/%m/%Y%m%d-%H%M%S') || '_' || substr(hash, 1, 10) || '.' || ext end as rel_path
  from (select o_orderkey, sha256(cast(o_orderkey as varchar)) as hash, cast(round(o_totalprice) as bigint) as size,
    case o_orderkey % {len(EXTS)} {_EXT} end as ext, case substr(o_orderpriority, 1, 1) {_CASE} end as time_source, o_orderdate as added_at,
    case when substr(o_orderpriority, 1, 1) <> '5' then o_orderdate end as captured_at, case when o_orderstatus = 'P' then o_orderdate end as deleted_at from orders)),
replica as (select r_name as replica, r_regionkey >= 3 as is_offline, r_regionkey > 0 as is_shard, cast(r_regionkey as double) as weight, r_regionkey as place from region),
placement as (
  select sha256(cast(l_orderkey as varchar)) as hash, replica, case l_returnflag when 'N' then 'present' when 'A' then 'missing' else 'corrupt' end as state,
    case when l_linestatus = 'F' then l_shipdate end as verified_at
  from (select l.*, r_name as replica, row_number() over (partition by l_orderkey, r_name
      order by l_shipdate desc, l_linenumber desc, l_partkey desc, l_suppkey desc, l_extendedprice desc, l_returnflag desc, l_linestatus desc) as k
    from lineitem l join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey) where k = 1),
disk as (
  select p.hash, p.replica, r.place, a.rel_path, a.size, a.ext,
    case when (a.o_orderkey * 7 + r.place * 3) % 11 < 8 then p.hash when (a.o_orderkey * 7 + r.place * 3) % 11 = 8 then sha256(p.hash || 'x') end as actual
  from placement p join asset a on a.hash = p.hash join replica r on r.replica = p.replica),
event as (select event_id as id, ts as moment, event_type as kind, props as detail, user_id from events),
source_file as (select doc_id, sha256(text) as hash, source as device, '/scan/' || cast(doc_id as varchar) as abs_path, cast(octet_length(encode(text)) as bigint) as size from documents)
"""
