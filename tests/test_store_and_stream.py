from datetime import datetime, timedelta

import pytest

from amberlode.sources.store import Store
from amberlode.streaming import settle


def test_versions_upserts_and_deletes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    cols = "hash string, replica string, state string, verified_at string"
    store.upsert("placement", spark.createDataFrame([("a", "x", "present", "t1"), ("b", "x", "missing", None)], cols), ["hash", "replica"])
    store.upsert("placement", spark.createDataFrame([("a", "x", "corrupt", None), ("c", "x", "present", "t2")], cols), ["hash", "replica"], ("verified_at",))
    got = {r["hash"]: (r["state"], r["verified_at"]) for r in store.read("placement").collect()}
    assert got == {"a": ("corrupt", "t1"), "b": ("missing", None), "c": ("present", "t2")}
    assert store.read("placement", 1).count() == 2
    store.write("asset", spark.createDataFrame([("a", 1), ("b", 2)], "hash string, size int"))
    store.delete("asset", spark.createDataFrame([("a",)], "hash string"), ["hash"], {"placement": ["hash"]})
    assert store.read("asset").count() == 1 and store.read("placement").where("hash = 'a'").count() == 0
    assert store.prune("placement", 1) == [1, 2] and store.read("placement").count() == 2


def test_repeated_keys_of_one_write_and_rows_that_stay(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    cols = "hash string, size int"
    store.insert_ignore("asset", spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], cols), ["hash"])
    store.insert_ignore("asset", spark.createDataFrame([("b", 9), ("c", 5), ("c", 4)], cols), ["hash"])
    assert sorted(map(tuple, store.read("asset").collect())) == [("a", 1), ("b", 3), ("c", 4)]
    store.upsert("asset", spark.createDataFrame([("a", 7, "x"), ("a", 8, "y")], cols + ", note string"), ["hash"])
    got = {r["hash"]: (r["size"], r["note"]) for r in store.read("asset").collect()}
    assert got == {"a": (8, "y"), "b": (3, None), "c": (4, None)}
    store.upsert("replica", spark.createDataFrame([("m", "u1", "old")], "name string, uuid string, kind string"), ["name"])
    store.upsert("replica", spark.createDataFrame([("m", "u2", "new")], "name string, uuid string, kind string"), ["name"], keep=("uuid",))
    assert store.read("replica").first().asDict() == {"name": "m", "uuid": "u1", "kind": "new"}


def test_appends_backups_events_and_prefixes(spark, tmp_path):
    store, to = Store(spark, str(tmp_path / "store")), str(tmp_path / "backup")
    cols = "device string, abs_path string"
    store.write("source_file", spark.createDataFrame([("d", "/a/1"), ("d", "/b/1"), ("e", "/a/1")], cols))
    name = store.backup("source_file", to)
    assert store.verify_backup(to, name)
    store.delete_below("source_file", "abs_path", "/a", device="d")
    assert store.read("source_file").count() == 2
    store.restore_backup("source_file", to, name)
    assert store.read("source_file").count() == 3 and store.read("source_file", 2).count() == 2
    spark.createDataFrame([("f", "/c")], cols).write.mode("append").parquet(f"{to}/{name}")
    assert not store.verify_backup(to, name)
    with pytest.raises(ValueError):
        store.restore_backup("source_file", to, name)
    assert [store.append_event("scrub", f"n{i}", "2024-01-01 00:00:00") for i in range(3)] == [1, 2, 3]
    assert [(r["id"], r["detail"]) for r in store.read("event").orderBy("id").collect()] == [(1, "n0"), (2, "n1"), (3, "n2")]
    assert store.prune("event", 1) == [1, 2] and store.read("event").count() == 3


def test_stream_ingests_each_content_once(spark, tmp_path):
    at = datetime(2024, 1, 1)
    kind = "path string, size long, hash string, at timestamp"
    changes = [("p", 1, "h1", at), ("p", 2, "h1", at + timedelta(seconds=2)), ("q", 5, "h2", at), ("r", 5, "h2", at), ("s", 1, "zz", at), ("s", 2, "aa", at + timedelta(seconds=1)), ("late", 0, "h9", at + timedelta(hours=1))]
    spark.createDataFrame(changes, kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "store"))
    store.write("staged", spark.createDataFrame([("p",), ("q",), ("stay",)], "path string"))
    changes = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    settle.run(changes, settle.replicated(store, "watch", ["mac", "hdd"]), str(tmp_path / "state")).awaitTermination(120)
    got = {r["hash"]: (r["path"], r["size"]) for r in store.read("asset").collect()}
    assert got == {"h1": ("p", 2), "h2": ("q", 5), "aa": ("s", 2)}  # the last size with the content of that moment
    assert store.read("placement").count() == 6 and [r["path"] for r in store.read("staged").collect()] == ["stay"]
    before = store.version("asset")
    body = settle.ingest(store, "watch")
    body(spark.createDataFrame([("n", 1, "h7")], "path string, size long, hash string"), 0)
    assert store.version("asset") == before  # that batch was written
    settle.ingest(store, "another")(spark.createDataFrame([("n", 1, "h7")], "path string, size long, hash string"), 0)
    assert store.read("asset").where("hash = 'h7'").count() == 1
