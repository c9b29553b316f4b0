"""Places where an operator or a stage once did less than the whole job."""

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from amberlode.llm import attention_lm, html, pii
from amberlode.llm.common import components, crc_mod, texts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, "aa", sources[i] if sources else f"s{i % 3}", len(t)) for i, t in enumerate(texts)], DOCS)


def test_stage_drops_near_copies_of_five_words_at_four_fifths(spark):
    r = np.random.default_rng(9)
    texts = []
    for _ in range(12):
        base = [f"w{x}" for x in r.integers(0, 10**6, 90)]
        texts += [" ".join(base), " ".join([*base, *(f"v{x}" for x in r.integers(0, 10**6, 20))]), " ".join([*base[:45], "other", *base[46:]]), " ".join([*base, *(f"u{x}" for x in r.integers(0, 10**6, 30))])]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = [x if z == y else z for z in root]
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, rows_of(spark, texts), "").collect()}
    assert got == set(root) and len(got) == 24


def idents(spark, texts):
    """Text of the learned spans of each text."""
    said = {r["doc_id"]: [x.split(":") for x in r["spans"].split(",") if x] for r in pii.find_personal_data(rows_of(spark, texts)).collect()}
    return [[t[int(s) : int(e)] for k, s, e in said[i] if k == "ident"] for i, t in enumerate(texts)]


def test_phones_of_one_country_are_several_seeds(spark):
    texts = [f"please ring me on +1 (555) 555-12{i:02d} at noon" for i in range(12)] + ["please ring me on x555-12-77a at noon"]
    assert idents(spark, texts)[12] == ["x555-12-77a"]


def test_discoveries_are_seeds_of_further_patterns(spark):
    texts = [f"please write to mail{i}@x.org today" for i in range(40)] + [f"please write to key-10{i}-ab today" for i in range(4)]
    texts += [f"the secret code key-10{i}-ab ends" for i in range(4)]
    got = idents(spark, texts)
    assert got[40:48] == [[f"key-10{i}-ab"] for i in range(4)] * 2


def test_sure_patterns_reach_every_digit_token(spark):
    texts = [f"my contact: mail{i}@x.org today" for i in range(60)] + ["my contact: 123-45-6789 today", "my contact: 987654321 today", "my contact: 77 today"]
    texts += [f"row 5 mail{i}@x.org" for i in range(60)] + ["row 8 555-01-77", f"mail: {' ' * 100}a@b.org"]
    texts += [f"u{i}@x.org starts here" for i in range(60)] + ["4455-66 starts here"]
    got = idents(spark, texts)
    assert got[60:63] == [["123-45-6789"], ["987654321"], ["77"]] and got[123] == ["555-01-77"] and got[-1] == ["4455-66"]


def test_all_content_nodes_of_a_page_stay():
    long, some = ("A sentence of the text, with commas, and a full stop. " * n for n in (40, 6))
    body = "".join(f"<p>{long}{i}</p>" for i in range(4))
    for whole in (f"<article><h1>Title</h1><div class=intro><p>{some}</p></div><div class=body>{body}</div></article>", f"<div><h1>Title</h1><section><p>{some}</p><p>{some}</p></section><section>{body}</section></div>"):
        got = html.main_text(f"<html><body><nav><a href=/>Home</a></nav>{whole}<footer>foot</footer></body></html>")
        assert got.startswith("Title\n\nA sentence") and got.count("commas") == (166 if "article" in whole else 172) and "foot" not in got


def test_patterns_are_not_sure_by_their_own_votes(spark):
    texts = [f"please write to mail{i}@x.org today ok" for i in range(6)] + [f"please write to key-10{i}-ab today ok" for i in range(5)]
    assert idents(spark, texts) == [[]] * 11


def test_seeds_without_digits_and_contexts_of_both_sides(spark):
    names = "anna bert carl dora emil fred gina hans inge jana kurt lena".split()
    texts = [f"w{'x' * i} write to {n}@ab.org soon" for i, n in enumerate(names)] + ["we write to key-778812-zz soon"]
    texts += [f"{'y' * (i + 1)} and {n}@ab.org ends here" for i, n in enumerate(names)] + ["so it is id-4455-66 ends here"]
    got = idents(spark, texts)
    assert got[12] == ["key-778812-zz"] and got[-1] == ["id-4455-66"]


def test_unseen_identifiers_over_two_generations(spark):
    """Recall and precision on planted identifiers: 30 stand after a phrase that base entities have, 6 only after phrases that the 30 have."""
    r = np.random.default_rng(4)
    word = lambda: "".join(r.choice(list("abcdefgh"), 6))
    ids = [f"ZX-{a:06d}-{b}" for a, b in zip(r.integers(0, 10**6, 36), r.integers(0, 10, 36), strict=True)]
    texts = [f"{word()} {word()} contact me under {x} {word()} {word()}" for x in ids[:30]]
    for k in range(6):
        texts += [f"{word()} {word()} member{'abcdef'[k]} number is {x} {word()} {word()}".replace("number", f"no{'abcdef'[k]}") for x in [*ids[:30], ids[30 + k]]]
    seeds = [f"{word()} {word()} contact me under u{i}@mail.org {word()} {word()}" for i in range(900)]
    noise = [f"{word()} {word()} in the year {n} {word()} item-{n}-{word()} {word()}" for n in r.integers(1000, 9999, 300)]
    got = idents(spark, texts + seeds + noise)
    found = [x for row in got[: len(texts)] for x in row]
    assert set(found) == set(ids) and len(found) == len(texts) and not any(got[len(texts) :])


def test_paths_are_scored_as_defined():
    page = "<body><div class=ad>Buy now.</div><article><h1>A head</h1><p>One, two, three. Four.</p><p>Five, six and more of it.</p><ul><li><a href=x>link</a></li></ul></article><div>Short.</div></body>"
    found = html.blocks(page)
    assert [b.path for b in found] == ["/body/div!", "/body/article/h1", "/body/article/p", "/body/article/p", "/body/article/ul/li", "/body/div"]
    size = [8, 6, (22 + 25) / 2, (22 + 25) / 2, 4, 6]
    marks = [1, 0, (4 + 2) / 2, (4 + 2) / 2, 0, 1]
    w = [0.06, 0.24, 0.4, 0.24, 0.06]
    at = lambda line, i: sum(w[k] * math.log(1 + line[min(max(i + k - 2, 0), 5)]) for k in range(5))
    length, punct = [at(size, i) for i in range(6)], [at(marks, i) for i in range(6)]

    def ratio(rows):
        a, b = (sum(x[i] for i in rows) / len(rows) / max(x) for x in (length, punct))
        return math.sqrt(a * (0.3 + 0.7 * b))

    article = ratio([1, 2, 3, 4])
    want = {
        "/body/div!": (ratio([0]) + ratio([0, 5])) / 2 * 0.25 * 0.5, "/body/article/h1": (ratio([1]) + max(article, ratio([1, 2, 3]))) / 2, "/body/article/p": (ratio([2, 3]) + max(article, ratio([1, 2, 3]))) / 2,
        "/body/article/ul/li": 0.0, "/body/div": (ratio([5]) + ratio([0, 5])) / 2 * 0.5,
    }
    got = html.path_scores(found)
    assert set(got) == set(want) and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    least = 0.4 * max(want.values())
    assert html.main_text(page) == "\n\n".join(b.text for b in found if want[b.path] >= least) and "Buy" not in html.main_text(page)


def test_stray_quotes_forms_and_names_keep_their_text():
    long = "A sentence of the text, with commas, and a full stop. " * 5
    for page in (f"<p title=it's>{long}</p><p>{long}</p>", f'<div class="x""><p>{long}</p><p>{long}</p></div>', f"<form action=x><article><p>{long}</p><p>{long}</p></article><input></form>", f"<div class=comments-policy-article><p>{long}</p><p>{long}</p></div>"):
        assert html.main_text(page) == f"{long.strip()}\n\n{long.strip()}"


def test_stage_removes_spread_lines_from_all_but_copies(spark):
    spread = "a licence line that many sites hold in full"
    texts = [f"{spread}\nown words {i}" for i in range(12)] + [f"{spread}\n{spread}" for _ in range(12)]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, rows_of(spark, texts, [f"s{i % 12}" for i in range(24)]), "").collect()}
    assert got == {i: f"own words {i}" if i < 12 else t for i, t in enumerate(texts)}


def test_language_model_learns_from_every_training_row(spark):
    """A row that no share of 1 in 16 would take, beyond the rows that the weights start from, still changes the model."""
    rows = [(i, f"alpha beta w{i % 9} gamma") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    train = docs.where((crc_mod(F.col("doc_id"), 7) != 2) & (F.pmod(F.xxhash64("doc_id", "text"), F.lit(16)) != 0))
    last = train.where(F.pmod(F.xxhash64("doc_id", F.lit("alpha zebra zebra gamma")), F.lit(16)) != 0).orderBy(F.desc(F.xxhash64("doc_id", "text"))).first()["doc_id"]
    other = spark.createDataFrame([(i, "alpha zebra zebra gamma" if i == last else t) for i, t in rows], "doc_id long, text string").coalesce(1)
    one, two = (attention_lm.fit(d, *attention_lm.public_vocabulary()) for d in (docs, other))
    assert any((one.p[k] != two.p[k]).any() for k in one.p) and (one.lead_share != two.lead_share).any()


def test_components_of_a_small_graph_cost_the_driver_few_jobs(spark):
    r = np.random.default_rng(4)
    pairs = [(i * 7, i * 7 + 7) for i in range(300)] + [(10**12 + int(a), 10**12 + int(b)) for a, b in r.integers(0, 400, (300, 2))] + [(-5, 3), (3, 3), (-5, 3), (10**6, 10**6)]
    root = {x: x for p in pairs for x in p}
    for _ in root:
        new = root.copy()
        for a, b in pairs:
            new[a] = new[b] = min(new[a], new[b])
        if new == root:
            break
        root = new
    want = {x: y for x, y in root.items() if any(x in p and p[0] != p[1] for p in pairs)}
    edges, context = spark.createDataFrame(pairs, "a long, b long"), spark.sparkContext
    context.setJobGroup("united", "")
    got = components(edges)
    jobs = len(context.statusTracker().getJobIdsForGroup("united"))
    context.setJobGroup("other", "")
    assert {r["node"]: r["root"] for r in got.collect()} == want and got.count() == len(want) and jobs <= 6
    assert {r["node"]: r["root"] for r in components(edges, few=10).collect()} == want
    assert components(edges.where("a = b")).count() == 0


def test_language_model_spells_each_training_word_once(spark):
    """Over all portions and partitions; words encoded together have the subwords that they have alone."""
    rows = [(i, f"alpha b{i % 5} gamma don't ü#{i % 3}") for i in range(60)] + [(60, None), (61, "a　b \x1c  x 12ab")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    portions, counts = attention_lm.counted(texts(docs), *attention_lm.public_vocabulary())
    learned = [t or "" for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    want = Counter(w for t in learned for w in t.encode().lower().split())
    assert portions.count() == 3 and sum(len(r["fresh"] or []) for r in portions.collect()) == len(want) + 1  # and the end
    assert sum(r["c"] for r in counts.where("first").collect()) == sum(want.values()) + len(learned)
    words = attention_lm.Words(attention_lm.encoding(*attention_lm.public_vocabulary()))
    together, sizes = words.subwords(list(want))
    alone = [words.enc.encode_ordinary(" " + w.decode()) for w in want]
    assert together.tolist() == [i for x in alone for i in x] and sizes.tolist() == [len(x) for x in alone]


def test_language_model_counts_travel_in_few_rows_and_are_whole(spark):
    """A row for each portion and bucket of hashes, not for each word; also for words whose first portion has them in held-out rows only."""
    out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = [(i, "zebra yak w1" if i == out else f"w{i} w{i % 50} Alpha\x0b" + " x".join(f"{i % 9}{k}" for k in range(40))) for i in range(400)] + [(400, "zebra  yak"), (401, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.where(F.col("doc_id") == out).coalesce(1).union(docs.where(F.col("doc_id") != out).repartition(3))
    portions, counts = attention_lm.counted(texts(docs), *attention_lm.public_vocabulary())
    words = [(i, (t or "").encode().lower().split()) for i, t in rows]
    learned = Counter(w for i, t in words for w in [*t, None] if zlib.crc32(str(i).encode()) % 7 != 2)
    words_of = [len({w for i, t in words if i in r["doc_id"] for w in [*t, None]}) for r in portions.orderBy("block").collect()]
    found = [len(r["found"]) for r in portions.orderBy("block").collect()]
    assert len(found) == 4 and sum(found) < 0.1 * sum(words_of)
    assert [r["count"] for r in counts.groupBy("block").count().orderBy("block").collect()] == words_of
    assert sorted(r["c"] for r in counts.where("first").collect()) == sorted(learned.values())
    n, v = sum(learned.values()), len(learned)
    want = {i: sum(np.log10((learned[w] + 1) / (n + v + 1)) for w in [*t, None]) for i, t in words}
    got = attention_lm.score_documents(docs, *attention_lm.public_vocabulary()).collect()
    assert {r["train_tokens"] for r in got} == {n} and all(abs(r["base_score"] - want[r["doc_id"]]) < 1e-8 for r in got)
