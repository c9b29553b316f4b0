"""Every operator and every stage on odd tables: names that clash, nulls, empties, very long texts, repeated rows and ids, ties, empty tables.

Results are compared by value with those of the same rows without the extra columns.
"""

import json
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from amberlode.llm import attention_lm, bpe, html, langid, line_dedup, ngram_join, pii, quality, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = (
    "row hit_id hit_key at found span_id span_key score lang_pred __text __id __key text_key salt__ heavy__ n c0 t kept_id kept_key one n_removed component h held rank q d dim v query_id pos x base tokens spans "
    "word words line site line_key sketch pattern value seed long size nid gid prefix token cell root rep j block quality __html html_ say hit state cols"
).split()
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, "a b c d e f"), (6, "a b c d e f"), (6, "quite another text of the same id"), (7, "é ü 你好 🙂 mail a@b.org"), (8, LONG), (9, LONG + " end"), (10, "9" * 3000),
    (11, "x@y.z " * 2000), (12, "l1 w\nl1 w\nl2 w w"), (None, "a row without an id"), (13, "+1 (555) 555-1234, 4111 1111 1111 1111 1.2.3.4"), (14, "!?! 123"), (15, "\ud7ff \u0000 \u2028 z"),
]


@pytest.fixture(scope="module")
def plain(spark):
    rows = [(i, t, None if k % 5 == 0 else ["aa", "bb"][k % 2], None if k % 4 == 0 else f"s{k % 3}", None if k % 6 == 0 else len(t or "")) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, DOCS).coalesce(1)


def crowded(df):
    return df.select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES if n not in df.columns])


def stage(at, *columns):
    return lambda d: corpus_pipeline.STAGES[at][1](d.sparkSession, d, "").select(*columns)


OPERATORS = {
    "op3": lambda d: quality.judge(d, d.sparkSession.createDataFrame([(4, 1), (5, 0), (5, None), (None, 0), (8, 1), (8, 1)], "doc_id long, quality int")),
    "op4": lambda d: pii.find_personal_data(d).drop("found"), "op5": lambda d: line_dedup.drop_spread_lines(d, min_sites=2).select("doc_id", "text", "n_chars", F.col("n_removed").cast("long")),
    "op6": lambda d: attention_lm.score_documents(d, *attention_lm.public_vocabulary()), "op8": langid.identify, "op2": ngram_join.link_documents,
    "op10": lambda d: bpe.encode_and_decode(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
    "stage_language": stage(0, "doc_id", "text"), "stage_near_duplicates": stage(2, "doc_id", "text"), "stage_personal_data": stage(3, "doc_id", "text", "n_chars"), "stage_packing": stage(4, "doc_id", "start", "length", "ids_crc32"),
}


def values(df):
    return sorted(json.dumps([round(v, 6) if isinstance(v, float) else v for v in r], default=str) for r in df.collect())


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_names_change_nothing_and_empty_tables_give_none(plain, name):
    want = values(OPERATORS[name](plain))
    assert values(OPERATORS[name](crowded(plain))) == want
    if name not in ("stage_packing", "stage_language", "stage_near_duplicates"):
        assert len(want) == len(TEXTS)
    assert OPERATORS[name](crowded(plain).where("false")).count() == 0


def test_lines_stage_keeps_extra_columns(plain):
    wide = crowded(plain)
    out = corpus_pipeline.lines(wide.sparkSession, wide, "")
    assert out.columns == wide.columns and out.where("row = 'own row' and found = 'own found' and n_removed = 'own n_removed' and hit_id = 'own hit_id'").count() == len(TEXTS)


def test_language_stage_drops_what_has_no_letters(plain):
    got = sorted((r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.language(plain.sparkSession, plain, "").collect())
    assert got == sorted((i or 0, t) for i, t in TEXTS if t and any(c.isalpha() for c in t))


def test_near_duplicate_stage_keeps_texts_that_share_an_id(plain):
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in corpus_pipeline.near_duplicates(plain.sparkSession, plain, "").collect())
    gone = {(5, "one"), (9, LONG + " end")}
    want = [(i or 0, t or "") for k, (i, t) in enumerate(TEXTS) if (i, t) not in gone and k != 6]
    assert got == sorted(want)


def test_lines_and_personal_data_stages_keep_all_rows(plain):
    spark = plain.sparkSession
    spread = plain.unionByName(spark.createDataFrame([(100 + i, f"a shared line\nown {i}" if i < 11 else "a shared line", "aa", f"t{i}", 5) for i in range(12)], DOCS))
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.lines(spark, spread, "").where("doc_id >= 100").collect()}
    assert got == {100 + i: (f"own {i}", len(f"own {i}")) if i < 11 else ("a shared line", 5) for i in range(12)}
    masked = {r["doc_id"]: r["text"] for r in corpus_pipeline.personal_data(spark, plain, "").collect()}
    # In row 13 the run of digits goes on into the address: 17 digits fail Luhn, and a failing match is not tried again.
    assert masked[7] == "é ü 你好 🙂 mail <email>" and masked[11] == "<email> " * 2000 and masked[13] == "<phone>, 4111 1111 1111 1111 <ip>" and masked[8] == LONG and masked[1] is None


def test_base_kinds_equal_the_contract_in_plain_python(spark):
    """Counts and digest of rows with several kinds in any order, against the contract's patterns."""
    import hashlib
    import random
    import re

    forms = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def holds(kind, match):
        d = re.sub("[^0-9]", "", match)
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in match.split(".")), "card": 12 <= len(d) <= 19 and sum(x - 9 * (x > 9) for x in twice) % 10 == 0, "phone": 9 <= len(d) <= 15}[kind]

    r = random.Random(5)
    atoms = ["a@b.c", "@", ".", "+", "1", "12", "255", "4111 1111 1111 1111", "-", " ", " ", "\n", "é", "🙂", "_", "(", "1.2.3.4", "256.1.1.1", "+1 (555) 555-1234", "x@y-z.org", "w"]
    texts = ["1.2.3.4", "a@b.c", "+1 (555) 555-1234", "4111 1111 1111 1111", *("".join(r.choices(atoms, k=r.randint(1, 40))) for _ in range(300))]
    got = {x["doc_id"]: x for x in pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    names = list(forms)
    for i, text in enumerate(texts):
        spans = sorted((m.start(), names.index(k), m.end()) for k, p in forms.items() for m in re.finditer(p, text) if holds(k, m.group()))
        assert [got[i][f"n_{k}"] for k in names] == [sum(s[1] == n for s in spans) for n in range(4)]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()


def test_whole_pipeline_equals_its_parts_in_plain_python(spark, tmp_path):
    """The rules of all stages but the language's in plain Python on a small table."""
    import re

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    foot = "read more on our pages about all of this and that"
    rows = [(i, f"{' '.join(f'v{i}x{k}' for k in range(30))}\n{foot}\nask p{i}@mail.org", "aa", f"s{i % 12}", 1) for i in range(24)]
    rows += [(100 + i, rows[i][1].replace("ask", "please ask"), "aa", f"s{i}", 1) for i in range(3)] + [(200, None, None, None, None), (201, "123", "aa", "s1", 3)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for i, text, _, _, _ in rows[:24]:  # the copies differ by one word of 36 without the spread line, and go
        kept[i] = re.sub(r"\S+@\S+", "<email>", text.replace(f"{foot}\n", ""))
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"]))
    import numpy as np

    assert set(got) == set(kept)
    for i, text in kept.items():
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert sum(x[1] for x in got[i]) == len(ids) and all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in got[i])


def test_pages_with_odd_rows(spark):
    kind = "page_id long, url string, html string"
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>a, b.</p>"), (3, "u", "<p>a, b.</p>"), (None, "u", "x"), (4, "u", "<div>" * 3000 + "deep, text." + "</div>" * 3000), (5, "u", "<p>" + "long text, yes. " * 20_000)]
    plain = spark.createDataFrame(rows, kind)
    got = values(html.extract(plain))
    assert got == values(html.extract(crowded(plain).drop("html_"))) and len(got) == len(rows)
    said = {r["page_id"]: r["text"] for r in html.extract(plain).collect()}
    assert said[1] == said[2] == "" and said[3] == "a, b." and said[4] == "deep, text." and len(said[5]) == 16 * 20_000 - 1
    assert html.extract(plain.where("false")).count() == 0


def test_vectors_with_odd_rows(spark):
    kind = "vec_id long, embedding array<float>"
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.5, 0.5]), (3, [0.5, 0.5]), (4, [0.5, 0.5, 1.0]), (5, None), (6, [None, 1.0]), (7, [float("inf"), 0.0]), (None, [1.0, 1.0]), (8, []), (9, [1.0, 0.0])]
    plain = spark.createDataFrame(rows, kind)
    got = sorted(tuple(r) for r in topk.top_products(crowded(plain), k=2).select("query_id", "rank", "vec_id", "score").collect())
    assert got == [(0, 1, 9, 4096), (0, 2, 20, 4096), (20, 1, 0, 4096), (20, 2, 9, 4096)]
    assert topk.top_products(plain.where("false")).count() == 0


def test_lists_of_rules_equal_their_plain_reading(spark):
    texts = [" ".join((f"w{k}" if (k + i) % (2 + i % 7) else f"#{k}!") for k in range(80)) for i in range(300)]
    docs = spark.createDataFrame([(i, t, "aa", "s", 1) for i, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(i, int(i % 7 > 2)) for i in range(300)], "doc_id long, quality int")
    rules = quality.learn(docs, labels)
    assert rules and all(len({(t.feature, t.at_least) for t in r}) <= len(r) for r in rules)
    for r in quality.judge(docs, labels).collect():
        counts = dict(zip(quality._COUNTS, quality.text_statistics(texts[r["doc_id"]]), strict=True))

        def holds(term, counts=counts):
            over, under = (counts[k] for k in quality.FEATURES[term.feature])
            ratio = over / under if under else 0.0
            return ratio >= term.value if term.at_least else ratio < term.value

        assert r["kept"] == (not r["base_failed"] and not any(all(map(holds, rule)) for rule in rules))
    assert sum(r["kept"] == (i % 7 > 2) for i, r in enumerate(sorted(quality.judge(docs, labels).collect(), key=lambda r: r["doc_id"]))) >= 285


def test_filters_equal_plain_sets(spark):
    """Shares from Bloom bit slices against plain sets of n-grams."""
    words = {"aa": "lorem ipsum dolor sit amet consectetur", "bb": "alpha beta gamma delta ipsum sit", "cc": "uno dos tres cuatro cinco dolor"}
    rows = [(i, " ".join(words[k].split()[(i * j + j) % 6] for j in range(1, 12)), k) for i, k in enumerate(list(words) * 30)]
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    counts = {k: {} for k in words}
    for _, text, k in train:
        for g in langid._grams(text).tolist():
            counts[k][g] = counts[k].get(g, 0) + 1
    share = {k: {g: n / sum(c.values()) for g, n in c.items()} for k, c in counts.items()}
    top = {}
    for c in share.values():
        for g, v in c.items():
            top[g] = max(top.get(g, 0), v)
    held = {k: {g for g, v in c.items() if v >= langid.MIN_SHARE and v >= langid.KEEP * top[g]} for k, c in share.items()}
    reach = {k: sum(share[k][g] for g in held[k]) for k in words}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    for i, text, _ in rows:
        grams = langid._grams(text).tolist()
        s = {k: sum(g in held[k] for g in grams) / len(grams) / reach[k] for k in words}
        best = max(sorted(s), key=lambda k: s[k])
        rest = max(v for k, v in s.items() if k != best)
        assert got[i]["lang_pred"] == best and abs(got[i]["score"] - s[best] / (s[best] + rest)) < 0.02
