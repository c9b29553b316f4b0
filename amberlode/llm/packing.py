"""Operator 7: hierarchical multi-length packing.

Documents become subword ids with an end id. Whole windows of the longest size
are cut off first; what is left of a document goes to the tier of the smallest
window that holds it. Tiers are packed from the longest down: each window takes
the longest item of its tier, fills its gap with the longest whole items of the
same or shorter tiers that fit, and closes with a piece cut from the longest
item left. So every window is full. What remains at the end of a partition is cut
into full windows of falling tiers; less than the shortest tier makes one last
window of its own length, the only one of a partition that may need padding.

Windows of one tier fill a step group until it holds STEP tokens exactly. The
groups still open at the end of a partition are dealt anew: the windows of all
tiers go, longest first, to the least filled of as few groups as hold them, so
that those differ by one window at most.

The work is done in one pass over the input partitions without a shuffle, a
bounded number of tokens at a time; the items that don't fill a window move on
to the next portion. Sequence ids hold the partition and a counter and repeat on
a retry. Null texts count as empty and keep their end id; strings of special
tokens in a text become those tokens, as the tokenizers library has it; repeated
rows and ids are packed row by row, items of equal length last come first; a
document of any length is cut; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import documents, texts, tidied
from .tokens import Segments, encoding

TIERS = (128, 256, 512, 1024)
STEP = 65_536
PORTION = 1_500_000
END = 0

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long, step_group long"


class Item:
    """A run of ids of one document that has not been placed yet."""

    __slots__ = ("doc_id", "ids", "length", "start")

    def __init__(self, doc_id: int, ids: np.ndarray, start: int, length: int):
        self.doc_id, self.ids, self.start, self.length = doc_id, ids, start, length


class Packer:
    def __init__(self, tiers: tuple[int, ...], partition: int):
        self.tiers, self.longest = sorted(tiers), max(tiers)
        self.by: list[list[Item]] = [[] for _ in range(self.longest + 1)]
        self.mask = self.held = self.count = 0
        self.base = partition << 33
        self.open: dict[int, list[list[tuple]]] = {t: [] for t in self.tiers}
        self.groups = 0
        self.rows: list[tuple] = []

    def put(self, item: Item) -> None:
        self.by[item.length].append(item)
        self.mask |= 1 << item.length
        self.held += item.length

    def take(self, most: int) -> Item | None:
        """The longest item of at most that length."""
        if not (fit := self.mask & ((1 << (most + 1)) - 1)):
            return None
        n = fit.bit_length() - 1
        item = self.by[n].pop()
        if not self.by[n]:
            self.mask ^= 1 << n
        self.held -= n
        return item

    def write(self, window: int, pieces: list[Item]) -> None:
        seq, offset, rows = self.base + self.count, 0, []
        self.count += 1
        for x in pieces:
            crc = zlib.crc32(x.ids[x.start : x.start + x.length].tobytes())
            rows.append((x.doc_id, x.start, x.length, crc, len(x.ids), seq, offset, window))
            offset += x.length
        tier = min(t for t in self.tiers if t >= window)
        self.open[tier].append(rows)
        if window == tier and len(self.open[tier]) * tier >= STEP:
            self.close(self.open[tier])
            self.open[tier] = []

    def close(self, windows: list[list[tuple]]) -> None:
        """One step group of these windows."""
        self.rows += [(*row, self.base + self.groups) for rows in windows for row in rows]
        self.groups += 1

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        whole = len(ids) // self.longest * self.longest
        for start in range(0, whole, self.longest):
            self.write(self.longest, [Item(doc_id, ids, start, self.longest)])
        if len(ids) > whole:
            self.put(Item(doc_id, ids, whole, len(ids) - whole))

    def window(self, size: int) -> None:
        """One full window of a size of at most what is held."""
        pieces, gap = [], size
        while gap:
            item = self.take(gap)
            if item is None:  # all are longer: cut one
                item = self.take(self.longest)
                self.put(Item(item.doc_id, item.ids, item.start + gap, item.length - gap))
                item.length = gap
            pieces.append(item)
            gap -= item.length
        self.write(size, pieces)

    def pack(self) -> None:
        """Full windows from the longest tier down."""
        for size in reversed(self.tiers):
            under = max((t for t in self.tiers if t < size), default=0)
            while self.held >= size and self.mask >> (under + 1):
                self.window(size)

    def finish(self) -> None:
        self.pack()
        while self.held:
            self.window(max((t for t in self.tiers if t <= self.held), default=self.held))
        size = lambda rows: rows[0][7]
        left = sorted((w for tier in self.tiers for w in self.open[tier]), key=size, reverse=True)
        groups: list[list] = [[] for _ in range(-(-sum(map(size, left)) // STEP))]
        fill = [(0, i) for i in range(len(groups))]
        for w in left:
            tokens, i = heapq.heappop(fill)
            groups[i].append(w)
            heapq.heappush(fill, (tokens + size(w), i))
        for g in groups:
            self.close(g)

    def drain(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack_documents(docs: DataFrame, tokenizer: str, pattern: str, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """A row for each piece of docs(doc_id, text). tokenizer: path of a byte-level tokenizers file, on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, packer = Segments(encoding(tokenizer, pattern)), Packer(tiers, TaskContext.get().partitionId())
        end, seen = np.array([END], "<u4").tobytes(), 0

        def out() -> Iterator[pa.RecordBatch]:
            rows = packer.drain()
            for lo in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[lo : lo + 50_000], strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(table.ids(text) + end, "<u4")
                packer.add(doc_id, ids)
                seen += len(ids)
                if seen > PORTION:
                    packer.pack()
                    seen = 0
                    yield from out()
        packer.finish()
        yield from out()

    return texts(docs).mapInArrow(tidied(run), SCHEMA)


def public_tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), *public_tokenizer())


QUERIES = {"op7_multi_length_packing": op7}
