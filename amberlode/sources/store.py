"""Tables as immutable versions: a change writes a new folder, then a pointer names it.

Readers see whole versions only; a write that fails leaves the last version in
place. Files are reached through Hadoop's file system, so any store that Spark
reads will do. Writers of one table must take turns.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.flows import merged


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, at: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{at}" if at else self.root)

    def _pointer(self, table: str) -> dict:
        """The newest manifest; versions count up, so it is the largest name."""
        found = self._fs.globStatus(self._path(f"{table}/v-*.json"))
        if not found:
            return {"version": 0, "marks": {}, "parts": []}
        last = max(x.getPath().getName() for x in found)
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.root}/{table}/{last}").collect()))

    def version(self, table: str) -> int:
        return self._pointer(table)["version"]

    def mark(self, table: str, by: str = "") -> int:
        """Number that the last write of a writer left, such as a stream's batch."""
        return self._pointer(table)["marks"].get(by, 0)

    def exists(self, table: str) -> bool:
        return self.version(table) > 0

    def _said(self, table: str, version: int) -> dict:
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.root}/{table}/v-{version:08d}.json").collect()))

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A version: the folders that its manifest lists."""
        said = self._said(table, version) if version else self._pointer(table)
        return self.spark.read.option("mergeSchema", True).parquet(*[f"{self.root}/{table}/{p}" for p in said["parts"]])

    def write(self, table: str, rows: DataFrame, mark: dict[str, int] | None = None, append: bool = False) -> int:
        """Publish rows as the next version, or the last version and rows. An appended version lists the folders before it and writes the new rows only."""
        now = self._pointer(table)
        version = now["version"] + 1
        part = f"v={version:08d}"
        rows.write.mode("overwrite").parquet(f"{self.root}/{table}/{part}")
        said = {"version": version, "marks": now["marks"] | (mark or {}), "parts": [*(now["parts"] if append else []), part]}
        self._publish(table, version, said)
        return version

    def _publish(self, table: str, version: int, said: dict) -> None:
        hidden = self._path(f"{table}/.v-{version:08d}.part")
        out = self._fs.create(hidden, True)
        out.write(bytearray(json.dumps(said), "utf-8"))
        out.close()
        if not self._fs.rename(hidden, self._path(f"{table}/v-{version:08d}.json")):
            raise OSError(f"version {version} of {table} was written by another")

    def digest(self, table: str, version: int | None = None) -> str:
        """Checksum of a version's rows in any order: their number and the sum of their hashes, as sha-256."""
        rows = self.read(table, version)
        cols = sorted(rows.columns)
        x = rows.select(F.xxhash64(*cols).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("n"), F.sum("h").alias("s")).first()
        return hashlib.sha256(f"{','.join(cols)}:{x['n']}:{x['s']}".encode()).hexdigest()

    def backup(self, table: str, to: str) -> str:
        """Copy the last version to a folder of its own, compressed, with its checksum beside it. Returns the name, which sorts by time."""
        name = f"{table}-{self.version(table):08d}"
        self.read(table).write.option("compression", "gzip").mode("errorifexists").parquet(f"{to}/{name}")
        self.spark.createDataFrame([(name, self.digest(table))], "name string, digest string").coalesce(1).write.mode("errorifexists").json(f"{to}/{name}.sum")
        return name

    def _backed(self, to: str, name: str) -> tuple[DataFrame, bool]:
        rows = self.spark.read.parquet(f"{to}/{name}")
        cols = sorted(rows.columns)
        x = rows.select(F.xxhash64(*cols).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("n"), F.sum("h").alias("s")).first()
        said = self.spark.read.schema("name string, digest string").json(f"{to}/{name}.sum").first()
        return rows, said is not None and said["digest"] == hashlib.sha256(f"{','.join(cols)}:{x['n']}:{x['s']}".encode()).hexdigest()

    def verify_backup(self, to: str, name: str) -> bool:
        return self._backed(to, name)[1]

    def restore_backup(self, table: str, to: str, name: str) -> int:
        """Publish a backup as the next version; versions before it stay. One whose checksum is wrong is refused."""
        rows, sound = self._backed(to, name)
        if not sound:
            raise ValueError(f"the checksum of {name} does not fit its rows")
        return self.write(table, rows)

    def insert_ignore(self, table: str, rows: DataFrame, keys: list[str], mark: dict[str, int] | None = None) -> int:
        """First writer wins; of rows that repeat a key in one go the smallest stays. Only new rows are written."""
        rest = [c for c in rows.columns if c not in keys]
        one = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("n")).select(*keys, "n.*") if rest else rows.distinct()
        if not self.exists(table):
            return self.write(table, one, mark)
        return self.write(table, one.join(self.read(table).select(*keys), keys, "left_anti"), mark, append=True)

    def upsert(self, table: str, rows: DataFrame, keys: list[str], keep_if_null: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> int:
        """New rows replace old ones of their key; of rows that repeat a key the greatest counts. In columns of keep_if_null a null leaves the old value, those of keep never change."""
        if not self.exists(table):
            old = self.spark.createDataFrame([], rows.schema)
            return self.write(table, merged(old, rows, keys))
        return self.write(table, merged(self.read(table), rows, keys, keep_if_null, keep))

    def delete(self, table: str, gone: DataFrame, keys: list[str], children: dict[str, list[str]] | None = None, mark: dict[str, int] | None = None) -> int:
        """Rows of these keys go, from the child tables too; children names the key columns there.

        All new versions are written before any is published, children first, so that no row is left without its parent.
        """
        staged = []
        for name, on in [*(children or {}).items(), (table, keys)]:
            if self.exists(name):
                left = self.read(name).join(gone.select(*[F.col(a).alias(b) for a, b in zip(keys, on, strict=True)]), on, "left_anti")
                now = self._pointer(name)
                version, part = now["version"] + 1, f"v={now['version'] + 1:08d}"
                left.write.mode("overwrite").parquet(f"{self.root}/{name}/{part}")
                staged.append((name, version, {"version": version, "marks": now["marks"] | ((mark or {}) if name == table else {}), "parts": [part]}))
        for name, version, said in staged:
            self._publish(name, version, said)
        return self.version(table)

    def delete_below(self, table: str, column: str, prefix: str, **where: str) -> int:
        """Rows of a path prefix go, of one device or replica if it is named."""
        hit = F.col(column).startswith(prefix)
        for c, v in where.items():
            hit &= F.col(c) == v
        return self.write(table, self.read(table).where(~F.coalesce(hit, F.lit(False))))

    def append_event(self, kind: str, detail: str, at: str) -> int:
        """One more event, numbered on."""
        last = self.read("event").agg(F.max("id")).first()[0] if self.exists("event") else 0
        row = self.spark.createDataFrame([((last or 0) + 1, kind, detail, at)], "id long, kind string, detail string, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
        return self.write("event", row, append=True)

    def set_deleted(self, keys: DataFrame, at: str | None) -> int:
        """Trash (only what isn't yet) or, with at None, restore assets of these hashes."""
        old = self.read("asset")
        hit = old.join(keys.select("hash").distinct().withColumn("__hit", F.lit(True)), "hash", "left")
        new = F.lit(at).cast("timestamp_ntz")
        value = F.when(F.col("__hit"), F.coalesce("deleted_at", new) if at else F.lit(None)).otherwise(F.col("deleted_at")).cast(old.schema["deleted_at"].dataType)
        return self.write("asset", hit.withColumn("deleted_at", value).select(*old.columns))

    def prune(self, table: str, keep: int) -> list[int]:
        """Forget all but the newest versions, and delete the folders that none of these lists."""
        last = self.version(table)
        held = {p for v in range(max(1, last - keep + 1), last + 1) for p in self._said(table, v)["parts"]}
        gone = [v for v in range(1, last - keep + 1) if self._fs.exists(self._path(f"{table}/v-{v:08d}.json"))]
        for v in gone:
            self._fs.delete(self._path(f"{table}/v-{v:08d}.json"), False)
        for v in range(1, last - keep + 1):
            if f"v={v:08d}" not in held:
                self._fs.delete(self._path(f"{table}/v={v:08d}"), True)
        return gone
