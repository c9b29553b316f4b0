"""Operator 6: log probabilities by a causal self-attention model trained in numpy.

The chain rule runs over words and within words, all on subword ids of a public
vocabulary. A word depends on the first subwords of the words before it: attention
gives the probability of the class of its first subword, and the word's share in
that class follows. The share is smoothed as Witten and Bell do: the word's count in
all training rows, plus the class's number of distinct words times what the model
says of the word's spelling, so that unseen words have a probability too. In a
spelling, a further subword, and the mark that ends a word, depend on the subwords
of the same word before it. Both kinds of sequence go through one model: one head of
causal attention with relative positions, a residual, and a softmax over classes.
Subwords are classed by the documents that they occur in (TOPICS clusters, in bins of
frequency each; one class of first subwords for what fewer than two documents hold,
one for the end). Windows of two chunks overlap by
one chunk: each position is scored once, in the second chunk of its window, with at
least a chunk of context where there is one. Spellings depend on the word alone and
are scored once for each distinct word that a portion of rows meets.

Texts are read and cut into words and subwords once. What the later passes read is a row
for each portion of rows, with its distinct words and their places in its texts.

The model learns from every training row, in passes without a shuffle of texts. The
first sums, over all rows, the frequencies of subwords and, by random indexing, the
clusters of their documents: each subword has a fixed random direction, a document the
sum of its subwords', a subword the sum of its documents'. The weights start from EPOCHS
passes over about START rows. Then each partition goes on from there over all its rows, a portion at
a time, and the weights of all partitions are averaged by the words that they saw. Spellings
are learned once for each distinct word of all training rows, by the first portion that holds it. Only
sums by subword and by weight reach the driver, whose number does not grow with the input.
The counts cover all training rows: each portion sends its distinct words by
64-bit hash with their counts, those of one bucket of hashes in one row; counts are summed by word and
return to the portions that asked, so that texts themselves are never shuffled.

Null texts count as empty and consist of the end token. Repeated rows are scored
and counted row by row. Texts of any length are scored whole. Without training
rows all counts are 0 and the model is untrained. An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, discard, documents, stash, texts, tidied

FOLDS, HELD_OUT = 7, 2
START = 512
EPOCHS = 3
MOST = np.float32(60)  # scores are cut here, which needs no pass for their maximum
DIRECTIONS = 32
WIDTH, CHUNK = 16, 16
TOPICS, BINS = 7, 4
RARE, END = TOPICS * BINS, TOPICS * BINS + 1  # classes of first subwords besides the bins
LEADS = END + 1
CLASSES = LEADS + 64
SHORT = (2, 4, 8, 16)
PORTION_DOCS, PORTION_BYTES = 4096, 12_000_000
KEEP_WORDS = 250_000
SPECIAL = 4  # pad, begin, end of text, end of word follow the vocabulary
END_HASH = -1
BUCKET_WORDS, FEW_BUCKETS, FEW_WORDS = 1 << 19, 64, 1 << 12  # words of all portions in a bucket of hashes; smaller tables have more buckets, for more tasks
ASKED, FOUND = np.dtype([("word", "<i8"), ("n", "<i4"), ("at", "<i4")]), np.dtype([("c", "<i8"), ("at", "<i4")])


def _even(weight: np.ndarray, parts: int) -> np.ndarray:
    """Part of each item: parts of about equal weight, from the heaviest item down."""
    out, order = np.zeros(len(weight), np.int64), np.argsort(-weight, kind="stable")
    mid = np.cumsum(weight[order]) - weight[order] / 2
    out[order] = np.minimum(parts - 1, mid / max(weight.sum(), 1e-300) * parts).astype(np.int64)
    return out


def _shares(weight: np.ndarray, part: np.ndarray, total: int, at: np.ndarray) -> np.ndarray:
    """Log of each item's share of its part's weight, placed at the item's id."""
    out = np.full(total, -1e9)
    out[at] = np.log(weight / np.bincount(part, weight)[part])
    return out


def directions(total: int) -> np.ndarray:
    """Fixed random direction of each id."""
    return np.random.default_rng(3).standard_normal((total, DIRECTIONS)).astype(np.float32)


def topics(seen: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Cluster of each id by the sum of the directions of the documents that hold it, -1 if fewer than two do."""
    out = np.full(len(seen), -1, np.int64)
    ids = np.flatnonzero(seen >= 2)
    if not len(ids):
        return out
    weight = seen[ids].astype(float)
    y = sums[ids] / weight[:, None]
    y -= (y * weight[:, None]).sum(0) / weight.sum()  # what all documents have in common
    y /= np.maximum(np.sqrt((y * y).sum(1, keepdims=True)), 1e-12)
    centres = y[[int(np.argmax(weight))]]
    while len(centres) < TOPICS:
        far = (y @ centres.T).max(1) - 0.05 * np.log(weight)
        centres = np.concatenate([centres, y[[int(np.argmin(far))]]])
    for _ in range(15):
        near = (y @ centres.T).argmax(1)
        new = np.stack([(y[near == t] * np.sqrt(weight[near == t, None])).sum(0) for t in range(TOPICS)])
        size = np.sqrt((new * new).sum(1, keepdims=True))
        centres = np.where(size > 0, new / np.maximum(size, 1e-12), centres)
    out[ids] = (y @ centres.T).argmax(1)
    return out


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums along the last axis, which stays, by one product."""
    return (x.reshape(-1, x.shape[-1]) @ np.ones(x.shape[-1], np.float32)).reshape(*x.shape[:-1], 1)


def _distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values of x, which is sorted in place."""
    x.sort()
    first = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=first[1:])
    return x[first]


class Model:
    """Parameters and the tables of projected embeddings made from them."""

    def __init__(self, n_ids: int, leads: np.ndarray, rests: np.ndarray, topic: np.ndarray, rest_topic: np.ndarray, seed: int = 7):
        """leads and rests: counts of each id as first and as further subword; topic and rest_topic: its cluster as such, or -1."""
        r = np.random.default_rng(seed)
        self.pad, self.begin, self.end, self.stop = range(n_ids, n_ids + SPECIAL)
        total = n_ids + SPECIAL
        small = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"e": (r.standard_normal((total, WIDTH)) * 0.3).astype(np.float32), "q": small(WIDTH, WIDTH), "k": small(WIDTH, WIDTH), "v": small(WIDTH, WIDTH), "r": small(WIDTH, WIDTH), "o": small(WIDTH, CLASSES), "b": np.zeros(CLASSES, np.float32), "d": np.zeros(2 * CHUNK, np.float32)}
        self.lead_class = np.full(total, RARE, np.int64)
        for t in range(TOPICS):
            at = np.flatnonzero(topic == t)
            self.lead_class[at] = t * BINS + _even(leads[at], BINS)
        self.lead_class[self.end] = END
        self.rest_class = np.zeros(total, np.int64)
        real = np.r_[:n_ids, self.stop]
        wide = (CLASSES - LEADS) // (TOPICS + 1)
        of = rest_topic[real]
        for t in range(-1, TOPICS):  # what has no cluster takes the classes that are left
            at = real[of == t]
            first, parts = (t * wide, wide) if t >= 0 else (TOPICS * wide, CLASSES - LEADS - TOPICS * wide)
            self.rest_class[at] = LEADS + first + _even(rests[at] + 0.05, parts)
        self.lead_share = _shares(leads[:n_ids] + 0.05, self.lead_class[:n_ids], total, real[:-1])
        self.lead_share[self.end] = 0
        self.rest_share = _shares(rests[real] + 0.05, self.rest_class[real], total, real)
        i, j = np.arange(CHUNK)[:, None] + CHUNK, np.arange(2 * CHUNK)[None, :]
        self.back, self.causal = np.clip(i - j, 0, 2 * CHUNK - 1), j <= i

    def joint(self) -> np.ndarray:
        """Projections of an embedding to query, key, value and residual, side by side."""
        return np.concatenate([self.p["q"] / np.float32(np.sqrt(WIDTH)), self.p["k"], self.p["v"], self.p["r"]], 1)

    def tables(self) -> None:
        self.table = self.p["e"] @ self.joint()

    def attend(self, z: np.ndarray, ids: np.ndarray, first: np.ndarray | None) -> tuple:
        """Attention weights of projected inputs z, with the queries, keys, values and residuals that they come from.

        first: which chunks begin a sequence, where ids has one chunk more, before the others,
        and each chunk but those sees the one before it; None where chunks stand alone.
        """
        width, total = ids.shape[1], len(ids) * ids.shape[1]
        z = z.reshape(len(ids), width, 4 * WIDTH)
        shut = np.where(ids == self.pad, np.float32(-1e9), np.float32(0))
        if first is None:
            q, k, v, r = (z[:, :, i * WIDTH : (i + 1) * WIDTH] for i in range(4))
            bias = self.bias[:width, CHUNK : CHUNK + width]
        else:
            n, flat = len(ids) - 1, z.reshape(total, -1)
            k, v = (np.lib.stride_tricks.as_strided(flat[:, i * WIDTH :], (n, 2 * width, WIDTH), (width * flat.strides[0], *flat.strides)) for i in (1, 2))
            q, r = z[1:, :, :WIDTH], z[1:, :, 3 * WIDTH :]
            shut = np.concatenate([np.where(first[:, None], np.float32(-1e9), shut[:-1]), shut[1:]], 1)
            bias = self.bias
        a = q @ k.transpose(0, 2, 1)
        a += bias
        a += shut[:, None, :]
        np.minimum(a, MOST, out=a)
        np.exp(a, out=a)
        a /= np.maximum(_sums(a), np.float32(1e-30))
        return a, q, k, v, r

    def score(self, before: np.ndarray | None, now: np.ndarray, want: np.ndarray, leads: bool = False) -> np.ndarray:
        """Natural log probability of want (chunks, width) given the input chunks now and the chunks before them, if any: of its class for leads, else of its id."""
        part = slice(0, LEADS) if leads else slice(LEADS, CLASSES)
        cls = self.lead_class if leads else self.rest_class - LEADS
        to, base = np.ascontiguousarray(self.p["o"][:, part]), self.p["b"][part]
        self.bias = np.where(self.causal, self.p["d"][self.back], np.float32(-1e9))
        out, batch = np.empty(want.shape), 512 * CHUNK // now.shape[1]
        for lo in range(0, len(now), batch):
            ids, first = _run(self, before, now, lo, lo + batch)
            a, _, _, v, r = self.attend(self.table.take(ids.ravel(), 0), ids, first)
            h = a @ v
            h += r
            o = np.maximum(h, 0).reshape(-1, WIDTH) @ to
            o += base
            np.clip(o, -MOST, MOST, out=o)
            flat = want[lo : lo + batch].ravel()
            hit = o[np.arange(len(flat)), np.maximum(cls[flat], 0)]
            np.exp(o, out=o)
            got = hit - np.log(_sums(o)[:, 0])
            out[lo : lo + batch] = (got if leads else got + self.rest_share[flat]).reshape(-1, now.shape[1])
        return out

    def train(self, parts: list[tuple[np.ndarray | None, np.ndarray, np.ndarray, bool]], epochs: int = EPOCHS, batch: int = 128, rate: float = 0.01, seed: int = 11, moments: tuple | None = None) -> tuple:
        """parts: chunks before (if any), now and wanted of one width, and whether the goals are first subwords. Batches are runs of chunks and hold about as many places at any width.

        Gives back the moments of the gradients and the number of steps, with which a later call goes on.
        """
        p, r = self.p, np.random.default_rng(seed)
        m, s, step = moments or ({k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0)
        root = np.float32(np.sqrt(WIDTH))
        narrow = np.uint16 if len(p["e"]) <= 1 << 16 else np.int64  # short ids are sorted faster
        for _ in range(epochs):
            turns = []
            for part in parts:
                size = batch * CHUNK // part[1].shape[1]
                turns += [(part, lo, lo + size) for lo in range(0, len(part[1]), size)]
            for turn in r.permutation(len(turns)):
                (before, now, want, leads), lo, hi = turns[turn]
                ids, first = _run(self, before, now, lo, hi)
                width, back = now.shape[1], 0 if first is None else 1
                here = slice(0, LEADS) if leads else slice(LEADS, CLASSES)
                goal = want[lo:hi].ravel()
                real = goal != self.pad
                aim = np.where(real, (self.lead_class if leads else self.rest_class - LEADS)[goal], 0)
                self.bias = np.where(self.causal, p["d"][self.back], np.float32(-1e9))
                flat, w = ids.ravel(), self.joint()
                e = p["e"].take(flat, 0)
                a, q, k, v, res = self.attend(e @ w, ids, first)
                h = a @ v
                h += res
                h = h.reshape(-1, WIDTH)
                g = np.maximum(h, 0)
                to = np.ascontiguousarray(p["o"][:, here])
                o = g @ to
                o += p["b"][here]
                np.clip(o, -MOST, MOST, out=o)
                np.exp(o, out=o)
                o *= (real / np.float32(max(1, real.sum())))[:, None] / _sums(o)
                o[np.arange(len(goal)), aim] -= real / np.float32(max(1, real.sum()))
                grad = {"o": np.zeros_like(p["o"]), "b": np.zeros_like(p["b"])}
                grad["o"][:, here], grad["b"][here] = g.T @ o, o.sum(0)
                dh = o @ to.T
                dh *= h > 0
                dh = dh.reshape(-1, width, WIDTH)
                da = dh @ v.transpose(0, 2, 1)
                da *= a
                da -= a * _sums(da)
                dz = np.zeros((*ids.shape, 4 * WIDTH), np.float32)
                dz[back:, :, :WIDTH], dz[back:, :, 3 * WIDTH :] = da @ k, dh
                for i, d in ((1, da.transpose(0, 2, 1) @ q), (2, a.transpose(0, 2, 1) @ dh)):
                    to_z = dz[:, :, i * WIDTH : (i + 1) * WIDTH]
                    to_z[back:] = d[:, -width:]
                    if back:
                        to_z[:-1] += d[:, :width]
                place = (slice(0, width), slice(0 if back else CHUNK, CHUNK + width))
                grad["d"] = np.bincount(self.back[place].ravel(), da.sum(0).ravel(), 2 * CHUNK).astype(np.float32)
                dz = dz.reshape(len(flat), -1)
                gw = e.T @ dz
                grad |= {x: gw[:, i * WIDTH : (i + 1) * WIDTH] for i, x in enumerate("qkvr")}
                grad["q"] = grad["q"] / root
                de = dz @ w.T
                order = np.argsort(flat.astype(narrow), kind="stable")
                near = flat[order]
                starts = np.flatnonzero(np.r_[True, near[1:] != near[:-1]])
                ids, ge = near[starts], np.add.reduceat(de.take(order, 0), starts)
                step += 1
                pace = float(rate * np.sqrt(1 - 0.99**step) / (1 - 0.9**step))
                for name, d in grad.items():
                    m[name] += 0.1 * (d - m[name])
                    s[name] += 0.01 * (d * d - s[name])
                    p[name] -= pace * m[name] / (np.sqrt(s[name]) + 1e-8)
                me, se = m["e"][ids], s["e"][ids]
                me += 0.1 * (ge - me)
                se += 0.01 * (ge * ge - se)
                m["e"][ids], s["e"][ids] = me, se
                p["e"][ids] -= pace * me / (np.sqrt(se) + 1e-8)
        return m, s, step


def _run(model: Model, before: np.ndarray | None, now: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Inputs of the chunks from lo to hi and, where chunks see those before them, one more ahead of these and which of them begin a sequence."""
    if before is None:
        return now[lo:hi], None
    return np.concatenate([before[lo : lo + 1], now[lo:hi]]), before[lo:hi, 0] == model.pad


def chunks(model: Model, goals: np.ndarray, lengths: np.ndarray, first: np.ndarray | int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chunks before, now and wanted for sequences laid end to end, and the place of each goal among the flattened chunks.

    The input before a sequence's first goal is first, before every other goal the goal before it.
    """
    lengths = np.asarray(lengths, np.int64)
    width = -(-lengths // CHUNK)
    starts = (np.cumsum(width) - width) * CHUNK
    ends = np.cumsum(lengths)
    place = np.repeat(starts - (ends - lengths), lengths)
    place += np.arange(len(goals))
    want = np.full(int(width.sum()) * CHUNK, model.pad, np.int32)
    want[place] = goals
    now, some = np.empty_like(want), lengths > 0
    now[1:] = want[:-1]
    now[want == model.pad] = model.pad
    now[starts[some]] = first[some] if isinstance(first, np.ndarray) else first
    now, want = now.reshape(-1, CHUNK), want.reshape(-1, CHUNK)
    before = np.roll(now, 1, 0)
    before[(starts // CHUNK)[some]] = model.pad
    return before, now, want, place


class Words(dict):
    """Number of each distinct word met; its hash, first subword and further ones are kept in arrays."""

    def __init__(self, enc: tiktoken.Encoding):
        super().__init__()
        self.enc, self.fresh, self.hashes = enc, [], np.empty(0, np.int64)
        self.lead, self.size, self.rest = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)
        self.blank = np.zeros(enc.max_token_value + 1, bool)
        self.blank[[i for x, i in enc._mergeable_ranks.items() if x[:1] == b" "]] = True

    def numbers(self, rows: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the words of the texts, end to end, and how many each text has."""
        found = pc.ascii_split_whitespace(pc.ascii_lower(rows))
        flat, ends = found.flatten(), np.concatenate([[0], np.cumsum(found.value_lengths().to_numpy())])
        real = pc.binary_length(flat).to_numpy() > 0  # white space at either end leaves an empty word
        size = np.diff(np.concatenate([[0], np.cumsum(real)])[ends])
        flat = (flat if real.all() else flat.filter(pa.array(real))).dictionary_encode()
        names = flat.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        at = np.fromiter(map(self.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(at < 0)
        at[new] = np.arange(len(self), len(self) + len(new))
        fresh = [names[i] for i in new.tolist()]
        self.fresh += fresh
        self.update(zip(fresh, at[new].tolist(), strict=True))
        return at.astype(np.int32)[flat.indices.to_numpy()], size

    def subwords(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Subwords of the words, end to end, and their number in each.

        A single blank between characters that are not white space begins a new match of the
        pre-tokenizer, so words without white space are encoded together.
        """
        flat, sizes = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for lo in range(0, len(words), 2000):
            some = words[lo : lo + 2000]
            text = (b" " + b" ".join(some)).decode("utf-8", "replace")
            ids = np.array(self.enc.encode_ordinary(text), np.int32) if len(text.split()) == len(some) else flat[0]
            starts = np.flatnonzero(self.blank[ids])
            if len(starts) == len(some):
                flat.append(ids)
                sizes.append(np.diff(np.append(starts, len(ids))))
            else:
                each = [self.enc.encode_ordinary(" " + w.decode("utf-8", "replace")) for w in some]
                flat.append(np.array([i for x in each for i in x], np.int32))
                sizes.append(np.array([len(x) for x in each], np.int64))
        return np.concatenate(flat), np.concatenate(sizes)

    def spell(self) -> None:
        """Subwords of the words that are new. The mark that ends a word follows the further ones, whose number in size counts it."""
        if not self.fresh:
            return
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.fresh), np.uint64, len(self.fresh)) >> np.uint64(1)
        self.hashes = np.concatenate([self.hashes, hashes.astype(np.int64)])
        flat, size = self.subwords(self.fresh)
        ends = np.cumsum(size)
        self.lead = np.concatenate([self.lead, flat[ends - size].astype(np.int64)])
        flat = np.append(flat[1:], np.int32(0))
        flat[ends - 1] = self.enc.max_token_value + 1 + 3
        self.size, self.rest = np.concatenate([self.size, size]), np.concatenate([self.rest, flat])
        self.fresh = []


def _pick(flat: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs numbered at of runs of these sizes laid end to end."""
    own = size[at]
    place = np.repeat(np.cumsum(size)[at] - own - (np.cumsum(own) - own), own)
    place += np.arange(len(place))
    return flat[place]


def _spellings(model: Model, lead: np.ndarray, goals: np.ndarray, size: np.ndarray) -> Iterator[tuple]:
    """Chunks before, now and wanted of words after their first subwords, the words they are of, and where goals stand among the chunks.

    Words of a few subwords go in chunks of just that width, all others in chunks of full width.
    """
    starts, under = np.cumsum(size) - size, 0
    for width in SHORT:
        at = np.flatnonzero((size > under) & (size <= width))
        under = width
        if len(at):
            cols = np.arange(width)
            want = np.where(cols < size[at, None], goals[np.minimum(starts[at, None] + cols, len(goals) - 1)], model.pad)
            yield None, np.concatenate([lead[at, None], want[:, :-1]], 1), want, at, None
    at = np.flatnonzero(size > under)
    if len(at):
        part = np.concatenate([goals[starts[i] : starts[i] + size[i]] for i in at])
        before, now, want, place = chunks(model, part, size[at], lead[at])
        yield before, now, want, at, place


def _rests(model: Model, lead: np.ndarray, goals: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Log probability of each word after its first subword."""
    out = np.zeros(len(size))
    for before, now, want, at, place in _spellings(model, lead, goals, size):
        got = model.score(before, now, want)
        out[at] = (got * (want != model.pad)).sum(1) if place is None else np.add.reduceat(got.ravel()[place], np.cumsum(size[at]) - size[at])
    return out


def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    import base64

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def training(docs: DataFrame) -> DataFrame:
    """The rows to learn from."""
    return docs.where(crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT)


def _run_sums(rows: np.ndarray, at: np.ndarray, starts: np.ndarray, step: int = 1 << 14) -> np.ndarray:
    """Sums of the rows numbered at over each of the runs that begin there, about step rows at a time."""
    out, ends = np.empty((len(starts), rows.shape[1]), rows.dtype), np.append(starts[1:], len(at))
    cuts = _distinct(np.append(np.searchsorted(starts, np.arange(0, len(at), step)), len(starts)))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        out[lo:hi] = np.add.reduceat(rows.take(at[starts[lo] : ends[hi - 1]], 0), starts[lo:hi] - starts[lo])
    return out


def _pressed(x: np.ndarray) -> bytes:
    """32-bit numbers, their lowest bytes first, then the others, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(x.view(np.uint8).reshape(-1, 4).T.tobytes())


def _loose(column: pa.Array, i: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(column[i].as_buffer()), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view(np.int32).ravel()


PORTION = "block long, doc_id array<long>, held array<boolean>, size array<long>, stream binary, word binary, n binary, spelt binary"


class Portion:
    """The texts of some rows: sizes of the texts in words and end, whether they are held out, the number of each word, and of the distinct words the first subword and the further ones with the mark that ends them."""

    def __init__(self, held: np.ndarray, size: np.ndarray, stream: np.ndarray, lead: np.ndarray, rest_size: np.ndarray, rest: np.ndarray):
        self.held, self.size, self.stream, self.lead, self.rest_size, self.rest = held, size, stream, lead, rest_size, rest

    @classmethod
    def of(cls, row: pa.RecordBatch | pa.Table, i: int) -> Portion:
        """Row i of a table of portions."""
        one = lambda c: row.column(c)[i].values.to_numpy(zero_copy_only=False)
        stream, spelt = _loose(row.column("stream"), i), _loose(row.column("spelt"), i)
        lead, rest_size, rest = np.split(spelt[1:], [spelt[0], 2 * spelt[0]])
        return cls(one("held").astype(bool), one("size"), stream, lead.astype(np.int64), rest_size.astype(np.int64), rest)

    @classmethod
    def plain(cls, rows: list[str], words: Words) -> Portion:
        """All words of rows that are learned from."""
        flat, size = words.numbers(pa.array(rows, pa.string()))
        words.spell()
        n, end = len(words), words.enc.max_token_value + 1 + 2
        stream = np.insert(flat, np.cumsum(size), n)
        return cls(np.zeros(len(rows), bool), size + 1, stream, np.append(words.lead, end), np.append(words.size, 0), words.rest)

    def count(self, into: dict[str, np.ndarray], way: np.ndarray, fresh: np.ndarray) -> None:
        """Add, by id: counts as first and as further subword, distinct words that it begins, documents that hold it as such, and the sum of their directions. fresh: the words that no portion before counts."""
        total, end = len(way), len(way) - 2
        learned = np.repeat(~self.held, self.size)
        docs, stream = np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)[learned], self.stream[learned]
        into["leads"][:, 0] += np.bincount(self.lead[stream], minlength=total)
        into["rests"][:, 0] += np.bincount(_pick(self.rest, self.rest_size, fresh), minlength=total)
        into["kinds"][:, 0] += np.bincount(self.lead[fresh], minlength=total)
        own = docs * np.int64(len(self.lead))
        own += stream
        del docs, stream, learned
        doc, word = (x.astype(np.int32) for x in np.divmod(_distinct(own), len(self.lead)))
        del own
        inner = self.lead[word] != end
        doc, word = doc[inner], word[inner]

        def held(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The distinct pairs, by id."""
            pairs = ids * np.int64(len(self.size))
            pairs += doc
            return tuple(x.astype(np.int32) for x in np.divmod(_distinct(pairs), len(self.size)))

        def add(name: str, ids: np.ndarray, doc: np.ndarray) -> None:
            if len(ids):
                starts = np.flatnonzero(np.r_[True, np.diff(ids) > 0])
                into[f"{name}_docs"][ids[starts], 0] += np.diff(np.append(starts, len(ids)))
                into[f"{name}_way"][ids[starts]] += _run_sums(ways, doc, starts)

        pair = held(self.lead.astype(np.int32)[word], doc)
        order = np.argsort(pair[1].astype(np.uint16) if len(self.size) <= 1 << 16 else pair[1], kind="stable")
        ways = np.zeros((len(self.size), way.shape[1]), np.float32)
        if len(order):
            by_doc = pair[1][order]
            starts = np.flatnonzero(np.r_[True, np.diff(by_doc) > 0])
            ways[by_doc[starts]] = _run_sums(way, pair[0][order], starts)
            del by_doc
        del order
        ways /= np.maximum(np.sqrt((ways * ways).sum(1, keepdims=True)), np.float32(1e-12))
        add("lead", *pair)
        size = np.maximum(self.rest_size - 1, 0)
        bare = self.rest[self.rest != total - 1]
        add("rest", *held(_pick(bare, size, word), np.repeat(doc, size[word])))

    def train(self, model: Model, fresh: np.ndarray, **how) -> tuple | None:
        parts = []
        if not self.held.all():
            parts.append((*chunks(model, self.lead.astype(np.int32)[self.stream[np.repeat(~self.held, self.size)]], self.size[~self.held], model.begin)[:3], True))
        if len(fresh):
            goals = _pick(self.rest, self.rest_size, fresh).astype(np.int64)
            parts += [(before, now, want, False) for before, now, want, _, _ in _spellings(model, self.lead[fresh], goals, self.rest_size[fresh])]
        return model.train(parts, **how) if parts else how.get("moments")


def fit(docs: DataFrame, vocabulary: str, pattern: str) -> Model:
    """Model of the training rows of docs(doc_id, text)."""
    return learn(docs, counted(docs, vocabulary, pattern)[0], vocabulary, pattern)


def learn(docs: DataFrame, portions: DataFrame, vocabulary: str, pattern: str) -> Model:
    """Model of the training rows of docs, whose portions have been counted."""
    spark = docs.sparkSession
    portions = portions.select("held", "size", "stream", "spelt", "fresh")
    docs = training(docs)
    n = docs.count()
    enc = encoding(vocabulary, pattern)
    n_ids = enc.max_token_value + 1
    total = n_ids + SPECIAL
    kinds = [("leads", 1), ("rests", 1), ("lead_docs", 1), ("rest_docs", 1), ("kinds", 1), ("lead_way", DIRECTIONS), ("rest_way", DIRECTIONS)]
    arrow = pa.schema([("id", pa.int64()), ("x", pa.list_(pa.float64()))])

    def table(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        ends = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel())).cast(pa.list_(pa.float64()))], schema=arrow)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, way = {k: np.zeros((total, w)) for k, w in kinds}, directions(total)
        for batch in batches:
            for i in range(len(batch)):
                Portion.of(batch, i).count(sums, way, _fresh(batch, i))
        ids = np.flatnonzero(sum(sums[k][:, 0] for k, width in kinds if width == 1))
        for lo in range(0, len(ids), 4096):
            yield table(ids[lo : lo + 4096], np.concatenate([sums[k][ids[lo : lo + 4096]] for k, _ in kinds], 1))

    def summed(rows: DataFrame, width: int) -> np.ndarray:
        """Sums of x by id; a row for each id reaches the driver."""
        sums = rows.groupBy("id").agg(*[F.sum(F.get("x", F.lit(k))).alias(f"x{k}") for k in range(width)]).toPandas()
        out = np.zeros((total, width))
        out[sums["id"].to_numpy(np.int64)] = sums.drop(columns="id").to_numpy(float)
        return out

    sums = summed(portions.mapInArrow(tidied(count), "id long, x array<double>"), 5 + 2 * DIRECTIONS)
    model = Model(n_ids, sums[:, 0], sums[:, 1], topics(sums[:, 2], sums[:, 5 : 5 + DIRECTIONS]), topics(sums[:, 3], sums[:, 5 + DIRECTIONS :]))
    model.held, model.kinds = (np.bincount(model.lead_class, sums[:, k], LEADS) for k in (0, 4))
    dealt = F.xxhash64("doc_id", "text")
    first = docs.where(F.pmod(dealt, F.lit(max(1, n // START))) == 0).orderBy(dealt, "text").limit(START).select("text").collect()
    start = Portion.plain([r["text"] for r in first], Words(enc))
    start.train(model, np.flatnonzero(start.rest_size))
    model.tables()
    if n > START:
        small = sorted(k for k in model.p if k != "e")
        held = spark.sparkContext.broadcast(model)

        def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, moments, words = copy.deepcopy(held.value), None, 0.0
            for batch in batches:
                for i in range(len(batch)):
                    portion = Portion.of(batch, i)
                    moments = portion.train(own, _fresh(batch, i), epochs=1, batch=512, rate=0.003, moments=moments)
                    words += int(portion.size[~portion.held].sum())
            if not words:
                return
            moved = np.flatnonzero((own.p["e"] != held.value.p["e"]).any(1))
            # Other weights travel in rows as wide as an embedding, numbered below zero.
            flat = np.concatenate([own.p[k].ravel() for k in small]).astype(float)
            flat = np.pad(flat, (0, -len(flat) % WIDTH)).reshape(-1, WIDTH)
            ids, x = np.concatenate([moved, -1 - np.arange(len(flat))]), np.concatenate([own.p["e"][moved].astype(float), flat]) * words
            yield table(ids, np.concatenate([x, np.full((len(x), 1), words)], 1))

        gone = portions.mapInArrow(tidied(go_on), "id long, x array<double>")
        sums_ = gone.groupBy("id").agg(*[F.sum(F.get("x", F.lit(k))).alias(f"x{k}") for k in range(WIDTH + 1)]).toPandas()
        ids, x = sums_["id"].to_numpy(np.int64), sums_.drop(columns="id").to_numpy(float)
        x = (x[:, :WIDTH] / np.maximum(x[:, WIDTH:], 1e-12)).astype(np.float32)
        model.p["e"][ids[ids >= 0]] = x[ids >= 0]
        low = x[ids < 0][np.argsort(-ids[ids < 0])].ravel()
        for k in small:
            size = model.p[k].size
            model.p[k], low = low[:size].reshape(model.p[k].shape).copy(), low[size:]
        model.tables()
    return model


def _fresh(batch: pa.RecordBatch, i: int) -> np.ndarray:
    at = batch.column("fresh")[i].values
    return np.empty(0, np.int64) if at is None else np.sort(at.to_numpy().astype(np.int64))


def _portions(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """A row for each portion: its documents, their words as numbers, and hash, training count and subwords of each word."""
    fields = {"long": pa.int64(), "boolean": pa.bool_(), "int": pa.int32(), "binary": pa.binary()}
    kinds = [x.split(" ") for x in PORTION.split(", ")]
    arrow = pa.schema([(name, pa.list_(fields[kind[6:-1]]) if kind.startswith("array") else fields[kind]) for name, kind in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, block = Words(encoding(vocabulary, pattern)), TaskContext.get().partitionId() << 32
        end = words.enc.max_token_value + 1 + 2

        def portion(ids: list[int], held: list[bool], parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            nonlocal block
            words.spell()
            flat, size = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            size = size + 1
            # 0 is the end, other words are numbered from 1.
            own = np.zeros(int(size.sum()), np.int32)
            inner = np.ones(len(own), bool)
            inner[np.cumsum(size) - 1] = False
            own[inner] = flat
            own[inner] += 1
            del flat
            counts = np.bincount(own)
            names = np.flatnonzero(counts)
            names = names[np.argsort(-counts[names], kind="stable")]
            to = np.empty(len(counts), np.int32)
            to[names] = np.arange(len(names))
            stream = to[own]
            learned = np.bincount(stream[np.repeat(~np.array(held), size)], minlength=len(names))
            hashes = np.append(END_HASH, words.hashes)[names]
            rests = np.append(0, words.size)
            leads = np.append(end, words.lead)[names].astype(np.int32)
            spelt = np.concatenate([[len(names)], leads, rests[names], _pick(words.rest, rests, names)]).astype(np.int32)
            block += 1
            row = (block - 1, ids, held, size, _pressed(stream), hashes.tobytes(), _pressed(learned.astype(np.int32)), _pressed(spelt))
            return pa.RecordBatch.from_arrays([pa.array([x], type=t) for x, t in zip(row, arrow.types, strict=True)], schema=arrow)

        ids, held, parts, weight = [], [], [], 0
        for batch in batches:
            sizes = pc.utf8_length(batch.column(1)).to_numpy().astype(np.int64)
            while len(batch):
                full = (len(ids) + np.arange(1, len(batch) + 1) >= PORTION_DOCS) | (weight + np.cumsum(sizes) >= PORTION_BYTES)
                n = int(full.argmax()) + 1 if full.any() else len(batch)
                here, batch = batch.slice(0, n), batch.slice(n)
                ids += here.column(0).to_pylist()
                parts.append(words.numbers(here.column(1)))
                held += here.column(2).to_pylist()
                weight, sizes = weight + int(sizes[:n].sum()), sizes[n:]
                if full.any():
                    yield portion(ids, held, parts)
                    ids, held, parts, weight = [], [], [], 0
                    if len(words) > KEEP_WORDS:
                        words = Words(words.enc)
        if ids:
            yield portion(ids, held, parts)

    return docs.select("doc_id", "text", (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held")).mapInArrow(tidied(run), PORTION)


def _records(column: pa.BinaryArray, kind: np.dtype) -> np.ndarray:
    """Records of all values of a column, end to end."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind) if ends[0] < ends[-1] else np.empty(0, kind)


def _cut(records: np.ndarray, ends: np.ndarray) -> pa.BinaryArray:
    """Records as values that end there, 0 being the first end."""
    offsets = (ends * records.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(records).view(np.uint8))])


def _deal(buckets: int):
    """A row for each portion and bucket of hashes, with the words that it asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                word = np.frombuffer(batch.column("word")[i].as_buffer(), np.int64)
                bucket = word % buckets
                order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
                asked = np.empty(len(word), ASKED)
                asked["word"], asked["n"], asked["at"] = word[order], _loose(batch.column("n"), i)[order], order
                bucket = bucket[order]
                starts = np.flatnonzero(np.diff(bucket, prepend=-1))
                block = np.full(len(starts), batch.column("block")[i].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array(block), _cut(asked, np.append(starts, len(word)))], names=["bucket", "block", "asked"])

    return run


def _answer(rows: pa.Table) -> pa.Table:
    """For each portion that asks in a bucket, the training counts of its words and which of them it is the first to hold."""
    rows = rows.sort_by("block").combine_chunks()
    column = rows.column("asked").combine_chunks()
    x = _records(column, ASKED)
    size = pc.binary_length(column).to_numpy() // ASKED.itemsize
    order = np.argsort(x["word"], kind="stable")
    word = x["word"][order]
    starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    c = np.add.reduceat(x["n"][order].astype(np.int64), starts)
    found, first = np.empty(len(x), FOUND), np.zeros(len(x), bool)
    found["at"], found["c"][order], first[order[starts]] = x["at"], np.repeat(c, np.diff(starts, append=len(x))), c > 0
    ends = np.concatenate([[0], np.cumsum(size)])
    fresh = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(first)])[ends].astype(np.int32)), pa.array(x["at"][first]))
    return pa.table({"block": rows.column("block"), "found": _cut(found, ends), "fresh": fresh})


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            found = _records(batch.column("found")[i].values, FOUND)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), batch.column("block")[i].as_py())), pa.array(found["at"].astype(np.int64)), pa.array(found["c"].copy()), pa.array(np.isin(found["at"], _fresh(batch, i)))], names=["block", "at", "c", "first"])


def counted(docs: DataFrame, vocabulary: str, pattern: str) -> tuple[DataFrame, DataFrame]:
    """Portions, each with the training counts of its words and the words of training rows that it is the first to hold; and, not computed before it is read, a row for each word of each portion."""
    bare = stash(_portions(docs, vocabulary, pattern), "portions")
    n_words = (bare.agg(F.sum(F.length("word"))).first()[0] or 0) // 8
    buckets = max(1, n_words // BUCKET_WORDS, min(FEW_BUCKETS, n_words // FEW_WORDS))
    asked = bare.select("block", "word", "n").mapInArrow(tidied(_deal(buckets)), "bucket long, block long, asked binary")
    answers = asked.groupBy("bucket").applyInArrow(_answer, "block long, found binary, fresh array<int>")
    mine = answers.groupBy("block").agg(F.collect_list("found").alias("found"), F.flatten(F.collect_list("fresh")).alias("fresh"))
    portions = stash(bare.drop("word", "n").join(mine.hint("merge"), "block"), "counted")
    discard(bare)
    return portions, portions.select("block", "found", "fresh").mapInArrow(_each, "block long, at long, c long, first boolean")


def score_documents(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    docs = texts(docs)
    portions, _ = counted(docs, vocabulary, pattern)
    fitted = learn(docs, portions, vocabulary, pattern)
    model, held, kinds = docs.sparkSession.sparkContext.broadcast(fitted), fitted.held, fitted.kinds
    n = int(held.sum())
    floor = float(np.log10(n + kinds.sum() + 1))
    empty = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def scored(batch: pa.RecordBatch, i: int) -> pa.RecordBatch:
        x, lm, found = Portion.of(batch, i), model.value, _records(batch.column("found")[i].values, FOUND)
        count = np.zeros(len(x.lead), np.int64)
        count[found["at"]] = found["c"]
        starts = np.cumsum(x.size) - x.size
        before, now, want, place = chunks(lm, x.lead.astype(np.int32)[x.stream], x.size, lm.begin)
        got = lm.score(before, now, want, leads=True).ravel()[place]
        del before, now, want, place
        words, spelling = np.flatnonzero(x.rest_size), np.zeros(len(x.lead))
        spelling[words] = lm.lead_share[x.lead[words]] + _rests(lm, x.lead[words], x.rest.astype(np.int64), x.rest_size[words])
        cls = lm.lead_class[x.lead]
        share = np.logaddexp(np.log(np.maximum(count, 1e-300)), np.log(kinds[cls] + 1) + spelling) - np.log(held[cls] + kinds[cls] + 1)
        score = np.add.reduceat(got + share[x.stream], starts) / np.log(10)
        base = np.add.reduceat(np.log10(count + 1.0)[x.stream], starts) - x.size * floor
        seen = np.add.reduceat((count > 0)[x.stream].astype(np.int64), starts)
        columns = [batch.column("doc_id")[i].values, batch.column("held")[i].values, x.size, seen, np.full(len(x.size), n), base, score]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=empty)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                yield scored(batch, i)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return portions.select("doc_id", "held", "size", "stream", "spelt", "found").mapInArrow(tidied(run), schema)


def public_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir), *public_vocabulary())


QUERIES = {"op6_attention_lm": op6}
