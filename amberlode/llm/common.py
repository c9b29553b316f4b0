"""Helpers shared by the corpus operators: table access, stored intermediate tables, joins on hot keys, connected components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEAVY = 1000
SALTS = 64
FEW_EDGES = 1 << 20

_LOCAL: list[str] = []
_STASHED: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send rows to Python workers in batches of at most this many: texts are long, and a worker holds a batch several times over.

    This is a setting of the whole session, so only the queries and the stages of the
    pipeline make it. Operators leave the session as it is.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def tidied(run: Callable) -> Callable:
    """run, whose worker hands freed memory back to the system when its partition ends, as workers are used again."""

    def inner(*given):
        try:
            yield from run(*given)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                return

    return inner


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text of every row; a null text becomes empty. Other columns are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return table(spark, sf_dir, "documents")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. On one machine one is made where the session names none; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="amberlode-"))
        at = _LOCAL[0]
    return at.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone, and then so is what it could clean
        return


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and lost executors cost nothing.

    The table is deleted by release, or when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/amberlode-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STASHED.append(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete every table stashed so far. Results that still have to be read are lost with them, so call it when they are written."""
    gone = len(_STASHED)
    while _STASHED:
        _remove(spark, _STASHED.pop())
    return gone


def discard(df: DataFrame) -> None:
    """Delete the files of a stashed table that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, path)


def heavy_keys(rows: DataFrame, keys: list[str], n: str) -> DataFrame:
    """The keys of the HEAVY largest counts n, with n: no other key holds more than 1 / HEAVY of what is counted."""
    return rows.select(*keys, F.col(n).alias("n_rows")).orderBy(F.desc("n_rows"), *keys).limit(HEAVY)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], n: str, how: str = "inner") -> DataFrame:
    """left joined to right, whose keys are unique and whose column n says how many rows of left have them.

    Rows of the HEAVY largest keys are dealt by the hash of the whole row over SALTS
    copies of their partner, so that a key with a third of all rows is spread over many
    tasks. left should have a column that tells its rows apart. What is broadcast
    has HEAVY rows at most. how: inner or left. Column n is left out.
    """
    heavy = F.broadcast(heavy_keys(right, keys, n).select(*keys, F.lit(True).alias("heavy__")))
    dealt = F.when(F.col("heavy__"), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(SALTS)).cast("int")).otherwise(0)
    spread = F.when(F.col("heavy__"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    a = left.join(heavy, keys, "left").withColumn("salt__", dealt).drop("heavy__")
    b = right.drop(n).join(heavy, keys, "left").withColumn("salt__", F.explode(spread)).drop("heavy__")
    return a.join(b, [*keys, "salt__"], how).drop("salt__")


def crc_mod(of: Column, by: int) -> Column:
    """crc32 of the decimal text of an id, modulo by; a null id counts as the empty text."""
    return F.crc32(F.coalesce(of.cast("string"), F.lit("")).cast("binary")) % F.lit(by)


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and root of the graph whose edges (a, b) all come to this one task."""
    held = [(np.asarray(x.column(0)), np.asarray(x.column(1))) for x in batches]
    if not held:
        return
    ends = np.concatenate([np.concatenate(x) for x in zip(*held, strict=True)])
    nodes, at = np.unique(ends, return_inverse=True)
    a, b = np.split(at, 2)
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
        a, b = root[a], root[b]
        a, b = a[apart := a != b], b[apart]
    for lo in range(0, len(nodes), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[lo : lo + 100_000]), pa.array(nodes[root[lo : lo + 100_000]])], names=["node", "root"])


def components(edges: DataFrame, a: str = "a", b: str = "b", few: int = FEW_EDGES) -> DataFrame:
    """(node, root) for every node of an undirected graph of long ids; root is the component's smallest id.

    At most few edges are united by one task on an executor, in 16 bytes an edge and a
    few times that; a larger graph takes rounds of joins, each of which leaves plans, threads
    and code behind in the driver. Each round hooks the parents of both ends of every edge onto the smaller of
    their parents and then halves the paths, so rounds grow with the logarithm of
    a chain's length. Tables are written between rounds; nothing is collected but
    a count of changes.
    """
    e = stash(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct(), "edges")
    if e.count() <= few:
        lab = stash(e.coalesce(1).mapInArrow(_united, "node long, root long"), "roots")
        discard(e)
        return lab
    ends = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("near")), F.struct(F.col("b").alias("node"), F.col("a").alias("near")))
    first = e.select(F.explode(ends).alias("e")).select("e.*").groupBy("node").agg(F.min("near").alias("near"))
    lab = stash(first.select("node", F.least("node", "near").alias("root")), "roots")
    while True:
        ra = lab.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        rb = lab.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        apart = e.join(ra, "a").join(rb, "b").where("ra <> rb")
        low = F.least("ra", "rb")
        hooks = apart.select(F.explode(F.array(*[F.struct(F.col(k).alias("node"), low.alias("to")) for k in ("a", "b", "ra", "rb")])).alias("h")).select("h.*")
        moved = lab.join(hooks.groupBy("node").agg(F.min("to").alias("to")), "node", "left").select("node", F.least("root", F.coalesce("to", "root")).alias("root"))
        up = moved.select(F.col("node").alias("root"), F.col("root").alias("over"))
        new = stash(moved.join(up, "root", "left").select("node", F.least("root", F.coalesce("over", "root")).alias("root")), "roots")
        changed = new.alias("n").join(lab.alias("o"), "node").where("n.root <> o.root").limit(1).count()
        discard(lab)
        lab = new
        if not changed:
            discard(e)
            return lab
