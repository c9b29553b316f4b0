"""Operator 9: exact top-k inner products by dual-tree search over cover trees.

Components become floor(64 * x). The upper level of the index is made of pivots,
picked farthest first from a bounded sample; every row goes to the cell of its nearest
pivot, and a cell is cut by hash into blocks of a bounded size. Each block is indexed
once by a cover tree: a node's children are centres picked farthest first, until they
cover its points within half its radius; points go to their nearest centre. A block
is stored as one row with its vectors, its tree, its centre and its covering radius.
Queries are indexed in the same way.

With centres p, q and covering radii r, s no inner product of two nodes exceeds
p.q + r|q| + s|p| + rs, nor the product of their longest vectors. The same bound holds for
whole blocks: each query block first meets the NEAREST blocks of the highest bounds,
which gives its queries a kth score; of the other blocks only those come to it whose bound
reaches the worst of these. Within a pair of blocks, pairs of nodes are visited from the
largest bound down, and a pair is pruned if its bound is below the worst kth score of the
queries in the node. What is left is ranked over all blocks.

Where vectors lie too far from one another for FAN centres to cover a node at a smaller
scale, it stays a leaf, and its products are computed in one go; nothing is pruned
that could count. Ties go to the smaller vec_id. Rows that repeat both id and vector count
once; an id with several vectors competes with each of them. Vectors that are null or
hold null or non-finite components take no part; empty ones neither. Only vectors
of equal length meet. Products stay exact in doubles below 2**52 and are taken
in integers beyond. An empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import salted_join, stash, table

K = 20
EVERY = 20
DATA_BLOCK = 4096
QUERY_BLOCK = 1024
PIVOTS, SAMPLE = 512, 8192
NEAREST = 2
LEAF = 64
FAN = 256
SHRINK = 0.7


class Node:
    __slots__ = ("centre", "children", "length", "longest", "points", "radius")

    def __init__(self, v: np.ndarray, points: np.ndarray, centre: np.ndarray, radius: float, children: list[Node]):
        self.points, self.centre, self.radius, self.children = points, centre, radius, children
        self.length = float(np.sqrt(centre @ centre))
        self.longest = float(np.sqrt((v[points] ** 2).sum(1).max()))


def farthest_first(v: np.ndarray, points: np.ndarray, at: int, most: int, least: float) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Centres among points from at on, each the farthest from those before it, until all points lie within least of one; nearest centre of each point and its distance."""
    own = v[points]
    square = (own * own).sum(1)
    away = lambda i: np.sqrt(np.maximum(0, square - 2 * (own @ v[i]) + v[i] @ v[i]))
    centres, dist, nearest = [at], away(at), np.zeros(len(points), np.int64)
    while len(centres) < most and dist.max() > least:
        centre = int(points[int(np.argmax(dist))])
        new = away(centre)
        closer = new < dist
        dist, nearest = np.where(closer, new, dist), np.where(closer, len(centres), nearest)
        centres.append(centre)
    return centres, nearest, dist


def cover_tree(v: np.ndarray, points: np.ndarray, at: int) -> Node:
    """Tree over v[points] with v[at] as centre of its root. A node whose children would not lie at a smaller scale is a leaf."""
    radius = float(np.sqrt(np.maximum(0, ((v[points] - v[at]) ** 2).sum(1)).max()))
    if len(points) <= LEAF or radius == 0:
        return Node(v, points, v[at], radius, [])
    centres, nearest, dist = farthest_first(v, points, at, FAN, radius / 2)
    if dist.max() > SHRINK * radius:
        return Node(v, points, v[at], radius, [])
    return Node(v, points, v[at], radius, [cover_tree(v, points[nearest == i], c) for i, c in enumerate(centres) if (nearest == i).any()])


def root_of(v: np.ndarray) -> Node:
    """Tree over all rows, from the row nearest to their mean."""
    return cover_tree(v, np.arange(len(v)), int(np.argmin(((v - v.mean(0)) ** 2).sum(1))))


def search(q: np.ndarray, q_ids: np.ndarray, p: np.ndarray, p_ids: np.ndarray, k: int, trees: tuple[Node, Node] | None = None, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores and ids of the k best rows of p for each row of q, without rows of the query's own id, and how many products it took.

    Unused places hold the lowest score. floor: a kth score that each query has already; less is not looked for.
    """
    top = float(max(np.abs(q).max(), np.abs(p).max()))
    if top * top * q.shape[1] >= 2**52:
        return *_plain(q, q_ids, p, p_ids, k), len(q) * len(p)
    low = np.iinfo(np.int64).min
    score, ids = np.full((len(q), k), low), np.full((len(q), k), np.iinfo(np.int64).max)
    slack = 1e-9 * (1 + top * top * q.shape[1])
    a, b = trees or (root_of(q), root_of(p))
    floor = np.full(len(q), low) if floor is None else floor
    done = 0

    def bound(x: Node, y: Node) -> float:
        return min(float(x.centre @ y.centre) + x.radius * y.length + y.radius * x.length + x.radius * y.radius, x.longest * y.longest) + slack

    def least(x: Node) -> float:
        return np.maximum(score[x.points, -1], floor[x.points]).min()

    def leaf(x: Node, y: Node) -> None:
        nonlocal done
        done += len(x.points) * len(y.points)
        s = (q[x.points] @ p[y.points].T).astype(np.int64)
        s[q_ids[x.points][:, None] == p_ids[y.points][None, :]] = low
        rows = np.flatnonzero(s.max(1) >= np.maximum(score[x.points, -1], floor[x.points]))
        if not len(rows):
            return
        at = x.points[rows]
        both = np.concatenate([score[at], s[rows]], 1)
        names = np.concatenate([ids[at], np.broadcast_to(p_ids[y.points], (len(rows), len(y.points)))], 1)
        names = np.where(both == low, np.iinfo(np.int64).max, names)
        order = np.lexsort((names, -np.maximum(both, low + 1)), axis=1)[:, :k]
        score[at], ids[at] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)

    heap, n = [(-bound(a, b), 0, a, b)], 1
    while heap:
        up, _, x, y = heapq.heappop(heap)
        if -up < least(x):
            continue
        if not x.children and not y.children:
            leaf(x, y)
            continue
        if x.children and (not y.children or x.radius >= y.radius):
            pairs = [(c, y) for c in x.children]
        else:
            pairs = [(x, c) for c in y.children]
        for c, d in pairs:
            if (most := bound(c, d)) >= least(c):
                heapq.heappush(heap, (-most, n, c, d))
                n += 1
    return score, ids, done


def _plain(q: np.ndarray, q_ids: np.ndarray, p: np.ndarray, p_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The same in Python integers, for components so large that doubles round their products."""
    low, last = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    score, ids = np.full((len(q), k), low), np.full((len(q), k), last)
    exact = [[int(c) for c in row] for row in p]
    for i, row in enumerate(q):
        own = [int(c) for c in row]
        all_ = sorted((-sum(c * d for c, d in zip(own, r, strict=True)), int(n)) for r, n in zip(exact, p_ids, strict=True) if n != q_ids[i])[:k]
        for j, (s, n) in enumerate(all_):
            score[i, j], ids[i, j] = min(max(-s, low + 1), last), n
    return score, ids


BLOCK = "dim int, block long, n long, ids binary, vectors binary, tree binary, centre array<double>, radius double, length double, longest double"
_ARROW = pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary()), ("tree", pa.binary()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("length", pa.float64()), ("longest", pa.float64())])


def _pivots(vectors: DataFrame, cells: int) -> dict[int, np.ndarray]:
    """Up to cells pivots for each length of vectors, from a sample of SAMPLE rows by hash."""
    out: dict[int, list] = {}
    for r in vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE).collect():
        out.setdefault(r["dim"], []).append(r["v"])
    pivots = {}
    for dim, rows in out.items():
        v = np.array(rows, float)
        pivots[dim] = v[farthest_first(v, np.arange(len(v)), 0, cells, 0.0)[0]]
    return pivots


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """One row for each block of vectors(vec_id, v, dim), with its tree."""
    n = vectors.count()
    held = vectors.sparkSession.sparkContext.broadcast(_pivots(vectors, min(PIVOTS, -(-n // size)))) if n > size else None
    kind = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.float64())), ("dim", pa.int32()), ("cell", pa.int32())])

    def near(batches):
        for batch in batches:
            cells = np.zeros(batch.num_rows, np.int32)
            dims = np.asarray(batch.column(2))
            for dim in np.unique(dims) if held else []:
                pivots = held.value.get(int(dim))
                if pivots is not None:
                    at = np.flatnonzero(dims == dim)
                    for lo in range(0, len(at), 1024):
                        some = at[lo : lo + 1024]
                        v = np.array(batch.column(1).take(pa.array(some)).flatten()).reshape(len(some), -1)
                        cells[some] = (-2 * v @ pivots.T + (pivots**2).sum(1)).argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.list_(pa.float64())), batch.column(2), pa.array(cells)], schema=kind)

    placed = stash(vectors.select("vec_id", "v", "dim").mapInArrow(near, "vec_id long, v array<double>, dim int, cell int"), "cells")
    parts = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / size).alias("parts"))
    dealt = salted_join(placed, placed.groupBy("dim", "cell").agg(F.count("*").alias("n")).join(parts, ["dim", "cell"]), ["dim", "cell"], "n")
    dealt = dealt.select("vec_id", "v", "dim", "cell", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).alias("part"))

    def build(key, rows):
        dim, cell, part = (x.as_py() for x in key)
        order = np.argsort(np.asarray(rows.column("vec_id")), kind="stable")
        ids = np.asarray(rows.column("vec_id"))[order]
        v = np.asarray(rows.column("v").combine_chunks().flatten()).reshape(len(ids), dim)[order]
        root = root_of(v)
        row = (dim, (cell << 32) + part, len(ids), ids.astype("<i8").tobytes(), v.tobytes(), pickle.dumps(root, 5), root.centre.tolist(), root.radius, root.length, root.longest)
        return pa.table([[x] for x in row], schema=_ARROW)

    return stash(dealt.groupBy("dim", "cell", "part").applyInArrow(build, BLOCK), "blocks")


def top_products(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each row whose vec_id is divisible by every."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    whole = whole.where((F.size("embedding") > 0) & ~bad & F.col("vec_id").isNotNull())
    whole = whole.select("vec_id", F.transform("embedding", lambda x: F.floor(x * 64).cast("double")).alias("v")).distinct()
    whole = stash(whole.select("vec_id", "v", F.size("v").alias("dim")), "vectors")
    rows, asks = blocks(whole, DATA_BLOCK), blocks(whole.where(F.col("vec_id") % every == 0), QUERY_BLOCK)
    head = lambda df, x: df.select("dim", F.col("block").alias(f"{x}_block"), *[F.col(c).alias(f"{x}_{c}") for c in ("centre", "radius", "length", "longest")])
    dot = F.aggregate(F.zip_with("q_centre", "d_centre", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    ball = dot + F.col("q_radius") * F.col("d_length") + F.col("d_radius") * F.col("q_length") + F.col("q_radius") * F.col("d_radius")
    bound = F.least(ball, F.col("q_longest") * F.col("d_longest"))
    # Summaries of blocks only: a row for DATA_BLOCK vectors meets one for QUERY_BLOCK queries.
    pairs = head(asks, "q").join(head(rows, "d"), "dim").select("dim", "q_block", "d_block", (bound + 1e-6 * (1 + F.abs(bound))).alias("bound"))
    pairs = stash(pairs.withColumn("turn", F.row_number().over(W.partitionBy("dim", "q_block").orderBy(F.desc("bound"), "d_block"))), "pairs")
    load = lambda df, x: df.select("dim", F.col("block").alias(f"{x}_block"), *[F.col(c).alias(f"{x}_{c}") for c in ("ids", "vectors", "tree")])
    found = pa.schema([("dim", pa.int32()), ("q_block", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("at", pa.int64()), ("kth", pa.int64())])
    low = np.iinfo(np.int64).min

    def meet(table):
        """All blocks of one group against its query block; kth starts from those of earlier blocks."""
        out = []
        for row in table.to_pylist():
            q_ids, p_ids = (np.frombuffer(row[x], "<i8") for x in ("q_ids", "d_ids"))
            q, p = (np.frombuffer(row[x]).reshape(-1, row["dim"]) for x in ("q_vectors", "d_vectors"))
            floor = np.frombuffer(row["kth"], "<i8") if row["kth"] is not None else None
            score, ids, _ = search(q, q_ids, p, p_ids, k, (pickle.loads(row["q_tree"]), pickle.loads(row["d_tree"])), floor)
            used = score > low
            at = np.broadcast_to(np.arange(len(q))[:, None], score.shape)
            n = int(used.sum())
            out.append(pa.table([pa.array([row["dim"]] * n, pa.int32()), [row["q_block"]] * n, q_ids[at[used]], ids[used], score[used], at[used], np.broadcast_to(score[:, -1:], score.shape)[used]], schema=found))
        return pa.concat_tables(out) if out else found.empty_table()

    schema = "dim int, q_block long, query_id long, vec_id long, score long, at long, kth long"
    of = ["dim", "q_block"]

    def searched(some: DataFrame) -> DataFrame:
        with_q = some.join(load(asks, "q"), of)
        return with_q.join(load(rows, "d"), ["dim", "d_block"]).groupBy("dim", "q_block", "d_block").applyInArrow(meet, schema)

    first = stash(searched(pairs.where(F.col("turn") <= NEAREST).select("dim", "q_block", "d_block", F.lit(None).cast("binary").alias("kth"))), "first")
    # A query's kth score so far is the best that one block alone gives it, or none.
    best = first.groupBy(*of, "at").agg(F.max("kth").alias("kth"), F.max("query_id").alias("query_id"))
    per = best.groupBy(*of).agg(F.collect_list(F.struct("at", "kth")).alias("x"))
    packed = pa.schema([("dim", pa.int32()), ("q_block", pa.int64()), ("kth", pa.binary()), ("worst", pa.float64())])

    def pack(table):
        row = table.to_pylist()[0]
        kth = np.full(row["n"], low, np.int64)
        for x in row["x"] or []:
            kth[x["at"]] = max(x["kth"], low)
        return pa.table([pa.array([row["dim"]], pa.int32()), [row["q_block"]], [kth.astype("<i8").tobytes()], [float(kth.min())]], schema=packed)

    state = asks.select("dim", F.col("block").alias("q_block"), "n").join(per, of, "left")
    state = stash(state.groupBy(*of).applyInArrow(pack, "dim int, q_block long, kth binary, worst double"), "state")
    open_ = pairs.where(F.col("turn") > NEAREST).join(state, of).where(F.col("bound") >= F.col("worst"))
    rest = searched(open_.select("dim", "q_block", "d_block", "kth"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    every_ = first.unionByName(rest).select("query_id", "vec_id", "score")
    return every_.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"))


QUERIES = {"op9_dual_cover_tree": op9}
ORACLES = {
    "op9_dual_cover_tree": f"""
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as e
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(cast(q.e as double[]), cast(c.e as double[])) as bigint) as score
  from v q join v c on q.vec_id % {EVERY} = 0 and q.vec_id <> c.vec_id)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from pairs qualify row_number() over (partition by query_id order by score desc, vec_id) <= {K}
""",
}
