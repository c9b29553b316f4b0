"""Operator 3: quality rules as learned decision lists.

Statistics of every whole text are made in one pass. A decision list is learned
from labelled rows (all of a bounded sample of LABELLED labels, picked by hash of
the id): sequential covering grows a conjunction of thresholds for bad texts by
information gain on two thirds of what is left, prunes it on the other third,
and takes what it covers away, until no rule is right more often than
MIN_PRECISION. Then rules that the others make needless are left out, the earliest
first: those without which the list is right about as many labelled rows. The
list becomes one ordered Spark conditional.

Null texts and texts without words have all statistics 0 and fail the base rule.
Null labels are ignored; without labels the list is empty and keeps what the base
rule keeps. Ties between thresholds go to the first feature and the lower
threshold, so equal labels give equal lists. Repeated rows get equal answers, an
empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, table, texts, tidied

LABELLED = 6_000
CUTS = 48
MAX_TERMS = 4
MAX_RULES = 24
MIN_PRECISION = 0.8
MIN_COVER = 5

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks", "n_digits", "n_distinct")
FEATURES = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "word_length": ("word_chars", "n_words"),
    "upper_share": ("n_upper", "n_letters"),
    "marks_per_word": ("n_marks", "n_words"),
    "digit_share": ("n_digits", "word_chars"),
    "distinct_share": ("n_distinct", "n_words"),
    "letter_share": ("n_letters", "word_chars"),
    "words_per_line": ("n_words", "n_lines"),
}


def text_statistics(text: str) -> tuple[int, ...]:
    """The counts named in _COUNTS."""
    words = text.encode("utf-8", "surrogatepass").split()
    blank = sum(map(text.count, " \t\n\v\f\r"))
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    repeated = 0
    if len(at) > 2:
        _, pair = np.unique(at[:-2] * len(ids) + at[1:-1], return_inverse=True)
        _, window, counts = np.unique(pair * len(ids) + at[2:], return_inverse=True, return_counts=True)
        twice = counts[window] > 1
        mark = np.zeros(len(at), bool)
        for k in range(3):
            mark[k : k + len(twice)] |= twice
        repeated = int(mark.sum())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    lower = text.lower()
    if len(lower) == len(text):
        upper = int(np.count_nonzero(points != np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), np.uint32)))
    else:
        upper = sum(map(str.isupper, text))
    digits = int(np.count_nonzero((points >= 48) & (points <= 57)))
    letters = int(np.count_nonzero(((points | 32) >= 97) & ((points | 32) <= 122) | (points >= 192)))
    return (len(words), len(text) - blank, sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), repeated, len(lines), upper, letters, text.count("!") + text.count("?"), digits, len(ids))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts for every row."""
    names = ["doc_id", *_COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], names=names) if rows else batch.slice(0, 0)

    return texts(docs).mapInArrow(tidied(run), ", ".join(f"{n} long" for n in names))


@dataclass(frozen=True)
class Term:
    feature: str
    at_least: bool
    value: float

    def column(self) -> Column:
        over, under = FEATURES[self.feature]
        ratio = F.coalesce(F.try_divide(F.col(over).cast("double"), F.col(under).cast("double")), F.lit(0.0))
        return ratio >= self.value if self.at_least else ratio < self.value

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.value if self.at_least else x[self.feature] < self.value


Rule = tuple[Term, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for term in rule:
        out &= term.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    rule: list[Term] = []
    now = np.ones(len(bad), bool)
    while len(rule) < MAX_TERMS and (~bad & now).any():
        p0, n0 = (bad & now).sum(), now.sum()
        best, gain = None, 1e-9
        for name in FEATURES:
            v = x[name][now]
            cuts = np.unique(np.quantile(np.concatenate([v[bad[now]], v]), np.linspace(0, 1, CUTS)))
            for cut in cuts:
                over = v >= cut
                for up, side in ((True, over), (False, ~over)):
                    n, p = side.sum(), (side & bad[now]).sum()
                    if p >= MIN_COVER and (g := p * (np.log2(p / n) - np.log2(p0 / n0))) > gain:
                        best, gain = Term(name, up, float(cut)), g
        if best is None:
            break
        rule.append(best)
        now &= best.holds(x)
    return tuple(rule)


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    def worth(r: Rule) -> float:
        c = _covers(r, x, len(bad))
        return ((c & bad).sum() - (c & ~bad).sum()) / max(1, c.sum())

    while len(rule) > 1:
        shorter = max((rule[:k] + rule[k + 1 :] for k in range(len(rule))), key=worth)
        if worth(shorter) < worth(rule):
            break
        rule = shorter
    return rule


def decision_list(x: dict[str, np.ndarray], bad: np.ndarray, turn: np.ndarray) -> list[Rule]:
    """Ordered rules for bad rows. turn: a hash of each row, which deals it to growing or pruning."""
    left, rules = np.ones(len(bad), bool), []
    while len(rules) < MAX_RULES and (left & bad).sum() >= MIN_COVER:
        grow = left & (turn % 3 != 0)
        check = left & ~grow
        pick = lambda m: {k: v[m] for k, v in x.items()}
        rule = _grow(pick(grow), bad[grow])
        if not rule:
            break
        rule = _prune(rule, pick(check), bad[check])
        covered = _covers(rule, x, len(bad)) & left
        if (covered & bad).sum() < MIN_COVER or (covered & bad).sum() < MIN_PRECISION * covered.sum():
            break
        rules.append(rule)
        left &= ~covered
    return _needed(rules, x, bad)


def _needed(rules: list[Rule], x: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """The list without the rules that it does as well without."""

    def right(some: list[Rule]) -> int:
        caught = np.zeros(len(bad), bool)
        for r in some:
            caught |= _covers(r, x, len(bad))
        return int((caught == bad).sum())

    for rule in list(rules):
        fewer = [r for r in rules if r is not rule]
        if right(fewer) >= right(rules):
            rules = fewer
    return rules


def learn(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    picked = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    few = F.broadcast(picked.select("doc_id"))  # LABELLED rows at most
    rows = docs.select("doc_id", "text").join(few, "doc_id", "left_semi")
    quality = {r["doc_id"]: r["quality"] for r in picked.collect()}
    one = statistics(rows).groupBy("doc_id").agg(F.min(F.struct(*_COUNTS)).alias("x")).select("doc_id", "x.*")  # LABELLED rows at most
    seen = one.toPandas().sort_values("doc_id")
    if seen.empty:
        return []
    x = {k: np.divide(seen[a].to_numpy(float), seen[b].to_numpy(float), out=np.zeros(len(seen)), where=seen[b].to_numpy() > 0) for k, (a, b) in FEATURES.items()}
    failed = _base_failed(seen).to_numpy()
    x = {k: v[~failed] for k, v in x.items()}
    ids = seen["doc_id"].to_numpy()[~failed]
    turn = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    return decision_list(x, np.array([quality[i] == 0 for i in ids], bool), turn)


def _base_failed(of):
    """For columns of Spark and of pandas alike."""
    return (of["n_words"] < 50) | (100 * of["n_repeat_words"] > 50 * of["n_words"])


def verdict(rules: list[Rule]) -> Column:
    """True for rows to keep."""
    out = None
    for rule in rules:
        holds = rule[0].column()
        for term in rule[1:]:
            holds = holds & term.column()
        out = F.when(holds, False) if out is None else out.when(holds, False)
    return F.lit(True) if out is None else out.otherwise(True)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, base statistics, base_failed, kept for every row."""
    rules = learn(docs, labels)
    rows = statistics(docs)
    failed = _base_failed(rows)
    return rows.select("doc_id", *_COUNTS[:5], failed.alias("base_failed"), F.when(failed, False).otherwise(verdict(rules)).alias("kept"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


QUERIES = {"op3_decision_list": op3}
