"""Operator 10: byte-level BPE encoding and decoding by ranked merges over distinct words.

One pass without a shuffle. A text is cut into the matches of the pre-tokenizer
pattern; a partition numbers its distinct words, and those of a portion of rows
that are new are encoded together: a fold over their byte arrays takes, in each
round, the adjacent pair of the lowest rank of every word, joins it and looks the
pairs up again, until no word has a pair with a rank. The rank map is a hash table
of packed (pair, rank) entries in which every pair has two places. The ids of a
document are those of its words; decoding concatenates the binary pieces of ids.

The same fold in Spark's higher-order functions over the same table as a literal
is encode_words. It gives the same ids but takes about 150 microseconds a word,
so the query folds in numpy (see README for figures).

Words are kept by number until there are KEEP, then numbering starts anew. The side
by side fold looks at every pair of a word in every round; words of over LONGEST
bytes take the same merges in the same order from a heap of ranked pairs, so that
their work stays near linear.

Null texts count as empty: no ids, digests of the empty string. Special tokens in
a text are ordinary text. Repeated rows get equal answers, texts of any length are
handled whole, an empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, texts, tidied

KEEP = 300_000
LONGEST = 256
PORTION_BYTES = 8_000_000
PLACES = 1 << 18
PRIMES = (213_449, 257_639)  # far from powers of two, which pairs of ids are made with
NO_RANK = (1 << 17) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """left id << 17 | right id -> rank, for every cut of a token into two tokens."""
    out = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                out[a << 17 | b] = rank
    return out


def rank_table(pairs: dict[int, int]) -> np.ndarray:
    """Cuckoo table: each pair lies at its remainder by one of the two primes; an entry is pair << 17 | rank, -1 if free."""
    slots = np.full(PLACES, -1, np.int64)
    for pair, rank in pairs.items():
        entry, which = pair << 17 | rank, 0
        for _ in range(500):
            at = (entry >> 17) % PRIMES[which]
            entry, slots[at] = int(slots[at]), entry
            if entry < 0:
                break
            which = 1 if at == (entry >> 17) % PRIMES[0] else 0
        else:
            raise ValueError("the rank table is too small for this vocabulary")
    return slots


def encode_words(words: Column, slots: np.ndarray) -> Column:
    """An array of arrays of byte ids to an array of arrays of token ids."""
    literal = F.split(F.lit(",".join(map(str, slots.tolist()))), ",").cast("array<bigint>")
    none = F.lit(NO_RANK).cast("bigint")

    def rank(t: Column, a: Column, b: Column) -> Column:
        key = F.shiftleft(a, 17).bitwiseOR(b)
        one, two = (F.get(t, (key % p).cast("int")) for p in PRIMES)
        low = F.lit(NO_RANK).cast("bigint")
        return F.when(F.shiftright(one, 17) == key, one.bitwiseAND(low)).when(F.shiftright(two, 17) == key, two.bitwiseAND(low)).otherwise(none)

    def fold(t: Column, w: Column) -> Column:
        n = F.size(w)
        ranks = F.transform(F.slice(w, 1, F.greatest(F.lit(0), n - 1)), lambda x, i: rank(t, x, F.get(w, i + 1)))
        start = F.struct(w.alias("ids"), ranks.alias("ranks"))

        def merge(acc: Column, _: Column) -> Column:
            # i counts from 1; the pair is ids[i], ids[i + 1].
            def at(i: Column, least: Column) -> Column:
                ids, r = acc["ids"], acc["ranks"]
                joined = F.concat(F.slice(ids, F.lit(1), i - 1), F.array(least), F.slice(ids, i + 2, F.size(ids)))
                before = F.when(i > 1, F.array(rank(t, F.get(ids, i - 2), least))).otherwise(F.slice(r, 1, 0))
                after = F.when(i < F.size(r), F.array(rank(t, least, F.get(ids, i + 1)))).otherwise(F.slice(r, 1, 0))
                left = F.slice(r, F.lit(1), F.greatest(F.lit(0), i - 2))
                return F.struct(joined.alias("ids"), F.concat(left, before, after, F.slice(r, i + 2, F.size(r))).alias("ranks"))

            least = F.array_min(acc["ranks"])
            found = F.transform(F.array(F.struct(F.array_position(acc["ranks"], least).cast("int").alias("i"), least.alias("least"))), lambda x: at(x["i"], x["least"]))
            return F.when(least < NO_RANK, F.get(found, F.lit(0))).otherwise(acc)

        return F.when(n < 2, w).otherwise(F.aggregate(F.sequence(F.lit(2), F.greatest(F.lit(2), n)), start, merge, lambda acc: acc["ids"]))

    held = F.transform(F.array(literal), lambda t: F.transform(words, lambda w: fold(t, w)))
    return F.get(held, F.lit(0))


def fold_words(words: list[bytes], byte_id: np.ndarray, slots: np.ndarray) -> list[list[int]]:
    """Token ids of each word, all words folded side by side."""
    out: list[list[int]] = [[] for _ in words]
    sym = byte_id[np.frombuffer(b"".join(words), np.uint8)]
    of = np.repeat(np.arange(len(words)), [len(w) for w in words])
    while len(sym):
        key = sym[:-1] << 17 | sym[1:]
        one, two = slots[key % PRIMES[0]], slots[key % PRIMES[1]]
        rank = np.where(one >> 17 == key, one, np.where(two >> 17 == key, two, NO_RANK)) & NO_RANK
        rank = np.append(np.where(of[:-1] == of[1:], rank, NO_RANK), NO_RANK)
        start = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        least = np.minimum.reduceat(rank, start)
        size = np.diff(np.append(start, len(sym)))
        done = least == NO_RANK
        if done.any():
            for w, ids in zip(of[start[done]].tolist(), np.split(sym[np.repeat(done, size)], np.cumsum(size[done])[:-1]), strict=True):
                out[w] = ids.tolist()
        hit = np.flatnonzero((rank == np.repeat(least, size)) & (rank < NO_RANK))
        hit = hit[np.append(True, of[hit][1:] != of[hit][:-1])] if len(hit) else hit
        sym[hit] = rank[hit]
        keep = np.repeat(~done, size)
        keep[hit + 1] = False
        sym, of = sym[keep], of[keep]
    return out


def merge_word(word: bytes, byte_id: np.ndarray, slots: np.ndarray) -> list[int]:
    """Token ids of one word: the lowest rank, leftmost first, comes off a heap; neighbours are linked by place."""
    sym = byte_id[np.frombuffer(word, np.uint8)].tolist()
    n = len(sym)
    before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n

    def rank(a: int, b: int) -> int:
        key = a << 17 | b
        for p in PRIMES:
            entry = int(slots[key % p])
            if entry >> 17 == key:
                return entry & NO_RANK
        return NO_RANK

    heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := rank(sym[i], sym[i + 1])) < NO_RANK]
    heapq.heapify(heap)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or sym[i] != a or j >= n or sym[j] != b:
            continue  # one of the pair has been merged since
        sym[i], alive[j], after[i] = r, False, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (x := rank(r, sym[after[i]])) < NO_RANK:
                heapq.heappush(heap, (x, i, r, sym[after[i]]))
        if before[i] >= 0 and (x := rank(sym[before[i]], r)) < NO_RANK:
            heapq.heappush(heap, (x, before[i], sym[before[i]], r))
    return [x for x, live in zip(sym, alive, strict=True) if live]


class Words:
    """Numbered distinct words with their ids as text, as bytes and by count; streams of texts as word numbers."""

    def __init__(self, ranks: dict[bytes, int], slots: np.ndarray, pattern: str):
        self.find = regex.compile(pattern).findall
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.slots, self.pieces = slots, {i: b for b, i in ranks.items()}
        self.said = {i: str(i) for i in self.pieces}
        self.clear()

    def clear(self) -> None:
        self.parts: dict[str, bytes | None] = {}
        self.number: dict[str, int] = {}
        self.fresh: list[str] = []
        self.texts: list[str] = []
        self.raws: list[bytes] = []
        self.sizes: list[int] = []

    def _of(self, words: list[str]) -> bytes:
        out = []
        for w in words:
            n = self.number.get(w)
            if n is None:
                n = self.number[w] = len(self.number)
                self.fresh.append(w)
            out.append(n)
        return array("I", out).tobytes()

    def _part(self, part: str) -> bytes | None:
        """Numbers of ' ' + part, None where white space asks for the whole text. Letters alone are one match, a mark after them another."""
        if part.isalpha():
            value = self._of([" " + part])
        elif part[:-1].isalpha() and part[-1] in ".,;:!?":
            value = self._of([" " + part[:-1], part[-1]])
        elif not part or part[0].isspace() or part[-1].isspace():
            value = None
        else:
            value = self._of(self.find(" " + part))
        self.parts[part] = value
        return value

    def stream(self, text: str) -> bytes:
        head, *rest = text.split(" ")
        if rest and head and not head[-1].isspace():
            have, out = self.parts, [self._of(self.find(head))]
            for part in rest:
                got = have[part] if part in have else self._part(part)
                if got is None:
                    break
                out.append(got)
            else:
                return b"".join(out)
        return self._of(self.find(text))

    def settle(self) -> None:
        """Encode and decode the words that are new."""
        raw = [w.encode("utf-8", "surrogatepass") for w in self.fresh]
        short = fold_words([w if len(w) <= LONGEST else b"" for w in raw], self.byte_id, self.slots)
        for w, got in zip(raw, short, strict=True):
            ids = got or merge_word(w, self.byte_id, self.slots)
            self.texts.append(" ".join([self.said[i] for i in ids]))
            self.raws.append(b"".join([self.pieces[i] for i in ids]))
            self.sizes.append(len(ids))
        self.fresh = []


def encode_and_decode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row."""
    ranks = read_ranks(vocabulary)
    slots = rank_table(pair_ranks(ranks))
    held = docs.sparkSession.sparkContext.broadcast((ranks, slots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(*held.value, pattern)

        def portion(ids: list[int], streams: list[bytes]) -> pa.RecordBatch:
            words.settle()
            sizes, n, sha, back = np.array(words.sizes, np.int64), [], [], []
            for s in streams:
                at = np.frombuffer(s, np.uint32)
                row = at.tolist()
                n.append(int(sizes[at].sum()) if row else 0)
                sha.append(hashlib.sha256(" ".join(map(words.texts.__getitem__, row)).encode()).hexdigest())
                back.append(hashlib.sha256(b"".join(map(words.raws.__getitem__, row))).hexdigest())
            if len(words.number) > KEEP:
                words.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(sha), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        ids, streams, weight = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc_id)
                streams.append(words.stream(text))
                weight += len(text)
                if weight >= PORTION_BYTES:
                    yield portion(ids, streams)
                    ids, streams, weight = [], [], 0
        if ids:
            yield portion(ids, streams)

    return texts(docs).mapInArrow(tidied(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_and_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {"op10_byte_bpe": op10}
