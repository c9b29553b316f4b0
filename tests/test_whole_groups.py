"""wasted_bytes: near duplicates whose buckets have more members than the model's bound."""

import os
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from amberlode.operators import duplicates as D
from amberlode.plans import catalog_queries as Q

DATA = "/root/testdata/sf0.001"


def components(values):
    """Smallest value that each one reaches by links within the threshold, by all pairs."""
    root = {}
    for v in sorted(values):
        if v not in root:
            root[v], ahead = v, [v]
            while ahead:
                x = ahead.pop()
                new = [y for y in values if y not in root and (x ^ y).bit_count() <= D.THRESHOLD]
                root |= dict.fromkeys(new, v)
                ahead += new
    return root


def some_bits(seed, ones, n):
    r = np.random.default_rng(seed)
    base = [sum(1 << int(p) for p in np.flatnonzero(r.random(64) < ones)) for _ in range(n)]
    near = [v ^ sum(1 << int(p) for p in r.choice(64, r.integers(1, 6), replace=False)) for v in base[: n // 5]]
    return sorted({v - (1 << 64) if v >> 63 else v for v in base + near})


def by_arrays(values):
    sets = list(combinations(range(D.BANDS), D.BANDS - D.THRESHOLD))
    rows = sorted(((k, *((v >> 8 * b) & 255 for b in taken)), v) for k, taken in enumerate(sets) for v in values)
    spot = np.unique([r[0] for r in rows], axis=0, return_inverse=True)[1]
    a, b = D.linked_within(spot.reshape(-1), np.array([r[1] for r in rows], np.int64))
    return list(zip(a.tolist(), b.tolist(), strict=True))


@pytest.mark.parametrize("seed, ones", [(1, 0.03), (2, 0.08), (3, 0.15), (4, 0.5)])
def test_links_connect_what_all_pairs_connect(seed, ones):
    values = some_bits(seed, ones, 700)
    got = by_arrays(values)
    assert all(len({(v & (2**64 - 1)) for v in x}) == 2 for x in got)
    near = {v: v for v in values}

    def top(v):
        while near[v] != v:
            v = near[v]
        return v

    for a, b in got:
        x, y = sorted((top(a), top(b)))
        near[y] = x
    said = {v: top(v) for v in values}
    plain = {v & (2**64 - 1): v for v in values}
    want = components(plain)
    assert {frozenset(v for v in values if said[v] == r) for r in said.values()} == {frozenset(plain[v] for v in want if want[v] == r) for r in want.values()}


def test_spots_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(D, "CHUNK", 50)
    values = some_bits(5, 0.08, 400)
    rows = spark.createDataFrame([(f"{i:04d}{k}", v) for i, v in enumerate(values) for k in "ab"[: 1 + i % 2]], "hash string, bits long")
    got = {}
    for r in D.whole_groups(rows).collect():
        got.setdefault(r["root"], set()).add(r["hash"])
    want, name = {}, {v & (2**64 - 1): i for i, v in enumerate(values)}
    for v, r in components(name).items():
        want.setdefault(r, set()).update(f"{name[v]:04d}{k}" for k in "ab"[: 1 + name[v] % 2])
    assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1) and all(r == min(x) for r, x in got.items())


def test_groups_of_more_than_400_are_whole(spark, tmp_path):
    words = [f"word{i}" for i in range(400)]
    added = spark.createDataFrame([(10**6 + i, " ".join([*words, f"x{i}"]), "aa", "s", 0) for i in range(520)], "doc_id long, text string, lang string, source string, n_chars long")
    given = spark.read.parquet(f"{DATA}/documents.parquet")
    given.unionByName(added.select([F.col(c).cast(given.schema[c].dataType) for c in added.columns])).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        p = f"{tmp_path if t == 'documents' else DATA}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    df = Q.QUERIES["wasted_bytes"](spark, str(tmp_path))
    got = sorted(map(tuple, df.collect()))
    assert max(r[df.columns.index("members")] for r in got) >= 520
    assert got == sorted(c.execute(Q.ORACLES["wasted_bytes"]).fetchall())
