"""Corpus operators on small cases: nulls, empties, ties, repeated rows, empty tables, extra columns; brute force where SQL has no words."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from amberlode.llm import attention_lm, bpe, html, langid, line_dedup, ngram_join, packing, pii, quality, topk

KIND = "doc_id long, text string, lang string, source string, n_chars long, component_id int, score string"


def docs(spark, texts, lang=None):
    return spark.createDataFrame([(i, t, lang, f"s{i % 3}", len(t or ""), 7, "x") for i, t in enumerate(texts)], KIND)


ODD = [None, "", " \n\t ", "one", "one", "a b c d e f", "é ü 你好 🙂", "x " * 3000, "9" * 3000, "a b c d e f", "l1 w\nl1 w\nl2 w w"]


OPERATORS = {
    "op6": lambda d: attention_lm.score_documents(d, *attention_lm.public_vocabulary()), "op7": lambda d: packing.pack_documents(d, *packing.public_tokenizer()),
    "op10": lambda d: bpe.encode_and_decode(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
}


def test_pages(spark):
    page = """<html><head><title>t</title><script>var a="<p>x</p>"</script></head><body><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies.</div>
    <div id="content"><h1>Head &amp; line</h1><p>First <b>bold</b>,   text. It goes on, and on, and on, to the end.<p>Second&nbsp;one, also long enough, with commas, and more.</div>
    <div class="comments"><p>A reader says, this is great, really, thanks.</p></div><footer>&copy; us</footer></body></html>"""
    rows = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, "u", ""), (4, "u", "<p>unclosed <a")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html.extract(rows).collect()}
    assert got[1]["text"] == "Head & line\n\nFirst bold, text. It goes on, and on, and on, to the end.\n\nSecond one, also long enough, with commas, and more."
    assert got[1]["n_chars"] == len(got[1]["text"]) and got[2]["text"] == got[3]["text"] == "" and got[4]["text"] == "unclosed"


def test_links_equal_brute_force(spark):
    r = np.random.default_rng(3)
    base = [[f"w{x}" for x in r.integers(0, 400, 80)] for _ in range(12)]
    texts = []
    for i in range(150):
        w = list(base[i % 12])
        for _ in range(r.integers(0, 4)):
            w[r.integers(0, len(w))] = f"n{r.integers(0, 50)}"
        texts.append(" ".join(w))
    sets = [{tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)} for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link_documents(docs(spark, texts)).collect()}
    assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}


def test_statistics_equal_their_definitions():
    for t in ["", "a b c a b c a", "# x\n# x\n\n y|<>&", "é é é é é"]:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        marked = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert quality.text_statistics(t)[:5] == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(marked))


def test_decision_list_learns_a_threshold(spark):
    good, bad = "plain words of a text that is long enough to pass " * 3, "bad### words### of### a### text### that### is### long### " * 3
    texts = [f"{good if i % 2 else bad} {' '.join(f'v{i}w{k}' for k in range(60))}" for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(500, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs(spark, texts), labels).collect()}
    assert all(got[i] == bool(i % 2) for i in range(200) if not 100 * quality.text_statistics(texts[i])[4] > 50 * quality.text_statistics(texts[i])[0])
    assert quality.judge(docs(spark, texts), labels.where("false")).count() == 200


def test_personal_data_and_context(spark):
    texts = [f"call me at mail{i}@x.org now" for i in range(6)] + ["call me at token-12345-ab now", "1.2.3.4 999.1.2.3 x 4111 1111 1111 1111 y 4111 1111 1111 1112 z +1 (555) 555-1234"]
    got = {r["doc_id"]: r for r in pii.find_personal_data(docs(spark, texts)).collect()}
    assert got[7]["spans"] == "ip:0:7,card:20:39,phone:64:81" and got[7]["base_sha256"] == hashlib.sha256(got[7]["spans"].encode()).hexdigest()
    masked = {r["doc_id"]: r["text"] for r in pii.mask_personal_data(docs(spark, texts)).collect()}
    assert masked[0] == "call me at <email> now" and masked[7].startswith("<ip> 999.1.2.3 x <card> y")


def test_base_score_equals_definition(spark):
    texts = ["The cat sat", "the dog sat down", None, "a cat", "dog dog dog", "new words here", "the the"]
    got = {r["doc_id"]: r for r in OPERATORS["op6"](docs(spark, texts)).collect()}
    toks = {i: [*(t or "").lower().split(), None] for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in toks}
    c = Counter(w for i, v in toks.items() if not held[i] for w in v)
    for i, v in toks.items():
        want = sum(np.log10((c[w] + 1) / (sum(c.values()) + len(c) + 1)) for w in v)
        assert got[i]["held_out"] == held[i] and got[i]["n_tokens"] == len(v) and got[i]["n_known"] == sum(c[w] > 0 for w in v) and got[i]["train_tokens"] == sum(c.values())
        assert abs(got[i]["base_score"] - want) < 1e-9 and got[i]["score"] < 0


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [None, "", "word " * 3000, *(f"Some text, number {i}.\n\nAnd  more " * (i % 9 + 1) for i in range(60)), "<|endoftext|> x"]
    out = OPERATORS["op7"](docs(spark, texts).coalesce(1)).toPandas()
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = out[out.doc_id == i].sort_values("start")
        assert own["length"].sum() == len(ids) and all(zlib.crc32(ids[x.start : x.start + x.length].tobytes()) == x.ids_crc32 for x in own.itertuples())
    size = out.groupby("sequence_id")["length"].sum()
    assert size.max() <= 1024 and sum(n & (n - 1) != 0 or n < 128 for n in size) <= 1


def test_step_groups_are_full_or_balanced():
    packer = packing.Packer(packing.TIERS, 0)
    r = np.random.default_rng(1)
    for i, n in enumerate(r.integers(1, 1500, 2000)):
        packer.add(i, np.arange(n, dtype="<u4"))
        if i % 300 == 0:
            packer.pack()
    packer.finish()
    tokens, tiers = Counter(), {}
    for row in packer.drain():
        tokens[row[8]] += row[2]
        tiers.setdefault(row[8], set()).add(row[7])
    open_ = [n for n in tokens.values() if n < packing.STEP]
    assert sum(n == packing.STEP for n in tokens.values()) > 10 and max(tokens.values()) == packing.STEP and max(open_) - min(open_) <= 1024
    assert all(len(tiers[k]) == 1 for k, n in tokens.items() if n == packing.STEP)


def test_language_of_held_out_texts(spark):
    words = {"aa": "lorem ipsum dolor sit amet".split(), "bb": "żółw chrząszcz brzmi trzcinie".split(), "cc": "猫 犬 鳥 魚".split()}
    rows = [(i, " ".join(words[k][(i * j) % len(words[k])] for j in range(1, 9)), k) for i, k in enumerate(list(words) * 40)]
    d = spark.createDataFrame([*rows, (900, None, "aa"), (901, "123 !?", "aa"), (902, "", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(d).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k in rows if got[i]["held_out"]) and {got[i]["lang_pred"] for i in (900, 901, 902)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_top_products_equal_brute_force(spark):
    r = np.random.default_rng(5)
    v = r.standard_normal((300, 8)).astype(np.float32)
    v[50:90] = v[50]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(400, None), (401, [1.0, None] + [0.0] * 6), (402, [float("nan")] * 8), (7, v[7].tolist())]
    got = {}
    for x in topk.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=7).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    w = np.floor(v.astype(float) * 64).astype(int)
    for q in range(0, 300, 20):
        best = sorted((-int(w[q] @ w[i]), i) for i in range(300) if i != q)[:7]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


def test_blocks_and_trees_prune_and_lose_nothing(spark, monkeypatch):
    r = np.random.default_rng(6)
    centres = r.standard_normal((12, 16)) * 3
    v = np.concatenate([c + r.standard_normal((60, 16)) * 0.05 for c in centres])[r.permutation(720)]
    w = np.floor(v * 64)
    for name, n in (("DATA_BLOCK", 64), ("QUERY_BLOCK", 8), ("PIVOTS", 12), ("LEAF", 8)):
        monkeypatch.setattr(topk, name, n)
    score, ids, done = topk.search(w[::20], np.arange(0, 720, 20), w, np.arange(720), 5)
    assert done < 0.35 * 36 * 720
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_products(rows, k=5).collect()))
    want = []
    for q in range(0, 720, 20):
        best = sorted((-int(w[q] @ w[i]), i) for i in range(720) if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_fold_of_ranked_merges_in_spark_and_numpy(spark):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    slots = bpe.rank_table(bpe.pair_ranks(ranks))
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = [w.encode() for w in ["a", " the", " ananontion", "!!!!!", " Über", "你好", " aaaaaaaa", "x" * 40]]
    want = [enc._core_bpe.encode_single_piece(w) for w in words]
    ids = np.array([ranks[bytes([b])] for b in range(256)])
    assert bpe.fold_words(words, ids, slots) == want
    long = [" aaaaaaaa".encode() * 90, "ananontion Über 你好".encode() * 60, b"x" * 700, bytes(range(256)) * 2]
    assert [bpe.merge_word(w, ids, slots) for w in [*words, *long]] == [*want, *(enc._core_bpe.encode_single_piece(w) for w in long)]
    df = spark.createDataFrame([([[int(ids[b]) for b in w] for w in words],)], "words array<array<bigint>>")
    assert df.select(bpe.encode_words(F.col("words"), slots).alias("x")).first()["x"] == want


def test_encoding_equals_the_library(spark):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*ODD, "it's I'LL  we've\n\n x\t<|endoftext|>", "z \u0085q \x1c r", "a" * 5000]
    got = {r["doc_id"]: r for r in OPERATORS["op10"](docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_spread_lines_leave_all_documents_but_spared_copies(spark):
    rows = [(i, f"own text number {i} goes here\nshared footer line\r\nmore of {i}", f"s{i}") for i in range(12)] + [(100 + i, "copied text of many\nsites in two lines\r", f"s{i}") for i in range(12)]
    rows += [(200, "shared footer line", None), (201, " \t\r\n", ""), (202, None, "s1")]
    rows += [(300 + i, f"nine sites\nline of {i}", f"s{i}" if i < 8 else None) for i in range(9)] + [(320 + i, f"ten sites\nline  of {i}", [None, ""][i] if i < 2 else f"s{i}") for i in range(10)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.drop_spread_lines(d).collect()}
    assert got[3] == ("own text number 3 goes here\nmore of 3", 1) and got[105] == ("", 2) and got[200] == ("", 1) and got[201] == (" \t\r\n", 0) and got[202] == (None, 0)
    assert got[300] == ("nine sites\nline of 0", 0) and got[321] == ("line  of 1", 1)
    spared = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.drop_spread_lines(d, spare_copies=True).collect()}
    assert spared[105] == (rows[12][1], 0) and spared[200] == ("shared footer line", 0) and spared[3] == got[3]
    assert line_dedup.spread_lines(d, min_sites=9).count() == line_dedup.spread_lines(d, min_sites=10).count() + 1
