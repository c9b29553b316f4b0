"""What large tables move: keys of orders rather than hashes, and running sums by ranges."""

import hashlib

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from amberlode.operators import duplicates, flows, placement
from amberlode.plans import catalog_queries as Q
from amberlode.sources import tables

DATA = "/root/testdata/sf0.001"


def test_scrubs_name_hashes_after_the_last_shuffle(spark):
    for name in ("scrub_outcomes", "scrub_marks_verified"):
        plan = Q.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert 0 <= plan.rfind("sha2(") < plan.find("Exchange")


def test_views_by_key_equal_the_named_ones(spark):
    placed, held = tables.placement_by_key(spark, DATA), tables.disk_by_key(spark, DATA)
    assert placed.schema["hash"].dataType.simpleString() == held.schema["actual"].dataType.simpleString() == "bigint"
    assert sorted(map(str, tables.named(placed).collect())) == sorted(map(str, tables.placement(spark, DATA).collect()))
    say = F.when(F.col("actual") == F.col("hash"), "right").when(F.col("actual").isNotNull(), "wrong")
    rows = [d.withColumn("actual", say) for d in (held, tables.disk(spark, DATA))]
    assert sorted(map(str, tables.named(rows[0]).collect())) == sorted(map(str, rows[1].collect()))


def test_redate_by_another_key(spark):
    weak = spark.createDataFrame([(1, "aaaaaaaaaaaa", "old/1.jpg", "jpg"), (2, "bbbbbbbbbbbb", "old/2.jpg", "jpg")], "k long, hash string, rel_path string, ext string")
    found = spark.sql("select * from values (1L, timestamp_ntz'2001-02-03 04:05:06', 'exif'), (2L, null, null) as t(k, at, label)")
    got = flows.redate(weak, found, "k").collect()
    assert [(r["k"], r["hash"], r["new_path"], r["outcome"]) for r in got] == [(1, "aaaaaaaaaaaa", "2001/02/20010203-040506_aaaaaaaaaa.jpg", "moved")]


def test_running_sums_by_ranges_equal_one_window(spark):
    hashes = F.sha2((F.col("id") % 700).cast("string").cast("binary"), 256)
    rows = spark.range(2000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("replica"), hashes.alias("hash"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("size"), F.lit(1).alias("rank"))
    got = placement.used_running(rows)
    want = rows.select("replica", "hash", F.sum("size").over(W.partitionBy("replica").orderBy("hash")).alias("used"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_near_duplicate_bits_shuffle_no_counts(spark):
    rows = spark.createDataFrame([("One two, two three!",), ("One two, two three!",), ("..  ",), (None,), ("ONE two two THREE",)] + [(f"w{i} x{i * i} y z{i % 7}",) for i in range(40)], "text string")
    grids = {tuple(r) for r in duplicates.text_grids(rows).select("hash", F.array_join("grid", ",")).collect()}
    assert len(grids) == 42 and sum(map(int, min(g for h, g in grids if h == hashlib.sha256(b"ONE two two THREE").hexdigest()).split(","))) == 4
    hashed = duplicates.hashes(duplicates.text_grids(rows))
    plan = hashed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and hashed.count() == hashed.select("hash").distinct().count()
