"""Operator 8: language identification by language-bitmask n-gram filters.

Training counts byte n-grams (3 and 4 bytes of lower-cased words, UTF-8) of all
labelled rows per language. An n-gram enters the filter of a language if its
share there is at least MIN_SHARE, which bounds a language's n-grams by
1 / MIN_SHARE, and at least KEEP of its largest share in any language.

The filters of all languages lie side by side: one table of slots, each slot a
bitmask with one bit per language. Two slots are and-ed per n-gram, which
returns all languages whose filter contains it. A text's hits per language are
popcounts over its n-grams; with f the share of slots that carry the language's
bit, f**2 of the other n-grams hit by chance, so hits are corrected to
(hits - n * f**2) / (1 - f**2) and divided by what training texts of that
language reach. The largest wins; ties go to the smaller name.

A null text or one without letters is `und` with score 0. Texts whose n-grams
hit nothing get the most frequent training language with score 0. Without any
labelled row everything is `und`. Repeated rows get equal answers; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, documents, stash, tidied

MIN_SHARE = 2e-5
KEEP = 0.3
SLOT_BITS = 20
FOLDS, HELD_OUT = 5, 0
BLOCK = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[128:] = True
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _grams(text: str) -> np.ndarray:
    """Keys of the 3- and 4-byte n-grams; words stand between blanks, runs of other characters count as one."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass") + b" ", np.uint8)
    letter = _LETTER[raw]
    b = np.where(letter, raw, 32).astype(np.uint32)
    keep = letter | np.concatenate([[True], letter[:-1]])
    b = b[keep]
    if len(b) < 3:
        return np.empty(0, np.uint32)
    three = b[:-2] | b[1:-1] << 8 | b[2:] << 16
    ok = b[1:-1] != 32
    if len(b) < 4:
        return three[ok]
    four = three[:-1] | b[3:] << 24
    return np.concatenate([three[ok], four[(b[1:-2] != 32) & (b[2:-1] != 32)]])


def _slots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k, shift = keys.astype(np.uint64) + np.uint64(1), np.uint64(64 - SLOT_BITS)
    return (k * _A >> shift).astype(np.int64), (k * _B >> shift).astype(np.int64)


class Filters:
    """Slots of language bitmasks, 64 languages to a plane."""

    def __init__(self, langs: list[str], members: list[np.ndarray]):
        self.langs = langs
        self.planes = [np.zeros(1 << SLOT_BITS, np.uint64) for _ in range(-(-len(langs) // 64))]
        self.chance = np.zeros(len(langs))
        for i, keys in enumerate(members):
            plane, bit = self.planes[i // 64], np.uint64(1) << np.uint64(i % 64)
            for at in _slots(keys):
                plane[at] |= bit
            self.chance[i] = np.mean(plane & bit != 0) ** 2
        self.reach = np.ones(len(langs))

    def shares(self, keys: np.ndarray) -> np.ndarray:
        """Corrected share of the n-grams that each language's filter holds."""
        hits = np.zeros(len(self.langs))
        for lo in range(0, len(keys), BLOCK):
            one, two = _slots(keys[lo : lo + BLOCK])
            for p, plane in enumerate(self.planes):
                mask = plane[one] & plane[two]
                for i in range(64 * p, min(64 * p + 64, len(self.langs))):
                    hits[i] += np.count_nonzero(mask & (np.uint64(1) << np.uint64(i % 64)))
        n = max(1, len(keys))
        return np.maximum(0, (hits / n - self.chance) / (1 - np.minimum(self.chance, 0.999))) / self.reach

    def decide(self, text: str | None) -> tuple[str, float]:
        if not self.langs or text is None or not _has_letter(text):
            return "und", 0.0
        s = self.shares(_grams(text))
        best = int(np.argmax(s))
        if s[best] <= 0:
            return self.common, 0.0
        rest = np.delete(s, best).max() if len(s) > 1 else 0.0
        return self.langs[best], float(s[best] / (s[best] + rest))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Filters:
    """Filters from all rows of labelled with a text and a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        done: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def fold(name: str) -> None:
            keys, counts = np.unique(np.concatenate(held[name]), return_counts=True)
            held[name] = []
            if name in done:
                both = np.concatenate([done[name][0], keys])
                keys, at = np.unique(both, return_inverse=True)
                counts = np.bincount(at, np.concatenate([done[name][1], counts])).astype(np.int64)
            done[name] = keys, counts

        for batch in batches:
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(name, []).append(_grams(t))
                if sum(map(len, held[name][-64:])) > 2_000_000 or len(held[name]) >= 256:
                    fold(name)
        for name in held:
            if held[name]:
                fold(name)
            keys, counts = done[name]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys)), pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])

    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    grams = rows.mapInArrow(tidied(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = stash(grams, "grams")
    total = {r["lang"]: r["n"] for r in grams.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(total)
    if not langs:
        return Filters([], [])
    size = F.create_map(*[F.lit(x) for k in langs for x in (k, float(total[k]))])
    share = grams.select("lang", "gram", (F.col("n") / size[F.col("lang")]).alias("share")).where(F.col("share") >= MIN_SHARE)
    kept = share.toPandas()  # at most 1 / MIN_SHARE rows for each language
    kept = kept[kept["share"] >= KEEP * kept.groupby("gram")["share"].transform("max")]
    filters = Filters(langs, [kept.loc[kept["lang"] == k, "gram"].to_numpy(np.uint32) for k in langs])
    filters.reach = np.array([max(1e-9, kept.loc[kept["lang"] == k, "share"].sum()) for k in langs])
    filters.common = max(langs, key=lambda k: (total[k], k))
    return filters


def predict(docs: DataFrame, filters: Filters, keep: list[Column | str], text: str = "text") -> DataFrame:
    """The columns in keep with lang_pred and score. keep has neither of these names; pack a whole row into a struct to keep it."""
    held = docs.sparkSession.sparkContext.broadcast(filters)
    kept = docs.select(*keep)
    names = kept.columns
    given = docs.select(*keep, F.col(text)).toDF(*[f"c{i}" for i in range(len(names))], "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [held.value.decide(t) for t in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array([x for x, _ in said], pa.string()), pa.array([x for _, x in said], pa.float64())], names=[*[f"c{i}" for i in range(len(names))], "lang_pred", "score"])

    schema = T.StructType([*[T.StructField(f"c{i}", f.dataType) for i, f in enumerate(kept.schema.fields)], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return given.mapInArrow(tidied(run), schema).toDF(*names, "lang_pred", "score")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows outside the held-out fold."""
    fold = crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT
    return predict(docs, fit(docs.where(~fold)), [F.col("doc_id").cast("long").alias("doc_id"), fold.alias("held_out")])


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


QUERIES = {"op8_language_filters": op8}
