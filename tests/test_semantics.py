import hashlib
import math

from pyspark.sql import functions as F

from amberlode.functions import semantics as S
from amberlode.operators import placement as P


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scalar_rules(spark):
    assert one(spark, S.extension(F.lit("a/B.JPEG"))) == "jpg"
    assert one(spark, S.media_kind(F.lit("mov"))) == "video"
    assert str(one(spark, S.filename_date(F.lit("scan_2011-07-04_beach")))) == "2011-07-04 12:00:00"
    assert one(spark, S.filename_date(F.lit("2023-02-30"))) is None
    assert one(spark, S.parse_size(F.lit("1.5KB"))) == 1536
    assert one(spark, S.parse_size(F.lit("many"))) is None
    assert one(spark, S.human_size(F.lit(1536))) == "1.5 KB"
    assert one(spark, S.percent(F.lit(1), F.lit(8))) == 12


def test_score_and_hash_bits(spark):
    top = int(hashlib.sha256(b"a:b").hexdigest()[:16], 16)
    assert math.isclose(one(spark, S.placement_score(F.lit("a"), F.lit("b"), F.lit(1.0))), -1 / math.log((top + 1) / (2**64 + 1)))
    falling = one(spark, S.dhash_bits(lambda at: -at))
    assert falling == -1 and one(spark, S.hash_hex(F.lit(-1).cast("bigint"))) == "f" * 16
    assert one(spark, S.hamming(F.lit(-1).cast("bigint"), F.lit(0).cast("bigint"))) == 64


def test_plan_within_capacity_equals_plain_plan_where_all_fits(spark):
    assets = spark.createDataFrame([(hashlib.sha256(str(i).encode()).hexdigest(), 10) for i in range(40)], "hash string, size bigint")
    shards = spark.createDataFrame([("s1", 1.0, False), ("s2", 2.0, False), ("s3", 1.0, True)], "replica string, weight double, is_offline boolean")
    wide = {r["hash"]: sorted(r["replicas"]) for r in P.plan_within(assets, shards, 2, {"s1": 10**6, "s2": 10**6, "s3": 10**6}).collect()}
    plain = {}
    for r in P.plan(assets, shards, 2).collect():
        plain.setdefault(r["hash"], []).append(r["replica"])
    assert wide == {k: sorted(v) for k, v in plain.items()}
    tight = P.plan_within(assets, shards, 2, {"s1": 50, "s2": 50, "s3": 50})
    assert tight.where("short").count() > 0
