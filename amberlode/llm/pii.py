"""Operator 4: personal data by fixed forms and bootstrapped contextual extraction, in DataFrame functions only.

The four base kinds are matched leftmost without overlap and then validated. The
patterns below match what the contract's match, written so that Java's matcher
needs neither recursion nor a second look at a run it has read: possessive
loops, and starts only at the head of a run or where the last match ended.

Bootstrapping looks at tokens that hold a digit or an @. Base entities are the seeds,
each by the whole text of its span; other tokens count by their own text. Each
token has three lexical patterns: the two words on its left, the word on either
side, and the two words on its right, with runs of digits as one 0 and empty words
beyond the text's ends. Patterns and values form a bipartite graph. In each of ROUNDS
rounds a pattern's confidence is the mean score of its distinct values, and a value's
score is 1 for a seed, else the noisy-or of the sure patterns that reach it, the
pattern itself left out: no pattern is sure because of values that only it reaches.
A pattern is sure if at least MIN_SEEDS values score and its confidence is at least
MIN_CONFIDENCE; patterns that found values support are sure in a later round. A
token that no base span covers becomes a span of kind `ident` where a sure pattern
holds. A value of less than 6 characters or 3 digits never supports a
pattern, as it means something else elsewhere.

Null texts count as empty: no spans, the digest of the empty string. Repeated
rows are answered row by row, ties between spans go by start, then kind, an empty
table gives an empty result, whole texts are read at any length. Other columns are
ignored by find_personal_data, whatever their names, and kept by
mask_personal_data, which changes text and n_chars alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, salted_join, stash, texts

KINDS = ("email", "ip", "card", "phone", "ident")
MIN_SEEDS = 3
MIN_CONFIDENCE = 0.9
ROUNDS = 3

_LOCAL = r"[A-Za-z0-9._%+-]"
_EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9]++(?:[ -][0-9]++)*+"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_SPAN = "struct<kind:int,s:bigint,e:bigint,value:bigint,right:array<string>>"
_TOK = "struct<s:bigint,kind:int,e:bigint,value:bigint,left:array<string>,right:array<string>,long:boolean>"
PIECE = 4096


def _digits(of: Column) -> Column:
    return F.regexp_replace(of, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    size = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), size),
        F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 1, F.substr(digits, size - i + 1, F.lit(1))).otherwise(F.translate(F.substr(digits, size - i + 1, F.lit(1)), "0123456789", "0246813579")).cast("int"),
    )
    return total % 10 == 0


def _card_ok(match: Column) -> Column:
    d = _digits(match)
    return F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False)


def _phone_ok(match: Column) -> Column:
    return F.length(_digits(match)).between(9, 15)


def _ip_ok(match: Column) -> Column:
    return match.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$")


def _right(after: Column, hit: Column) -> Column:
    """The two words that follow; what hangs on the match itself is passed over."""
    return F.slice(F.split(F.concat(after, F.coalesce(hit, F.lit(""))), r"\s+", 4), 2, 2)


def _once(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _before(values: Column, over) -> Column:
    """over (sum or maximum of an array of numbers) of all values before each one.

    Blocks of about the root of their number keep the work below that of a fold, which copies what it gathers at every step.
    """

    def blocked(z: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(z["v"]) - 1) / z["w"]).cast("int")), lambda k: over(F.slice(z["v"], k * z["w"] + 1, z["w"])))
        return F.struct(z["v"].alias("v"), z["w"].alias("w"), blocks.alias("b"))

    def each(z: Column) -> Column:
        return F.transform(z["v"], lambda _, i: over(F.array(over(F.slice(z["b"], F.lit(1), F.floor(i / z["w"]).cast("int"))), over(F.slice(z["v"], i - i % z["w"] + 1, i % z["w"])))))

    wide = F.struct(values.alias("v"), F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(values)))).cast("int").alias("w"))
    return F.when(F.size(values) == 0, F.array().cast("array<bigint>")).otherwise(_once(_once(wide, blocked), each))


def _sum(of: Column) -> Column:
    return F.aggregate(of, F.lit(0).cast("long"), lambda a, x: a + x)


def _most(of: Column) -> Column:
    return F.coalesce(F.array_max(of), F.lit(0).cast("long"))


def _count(spans: Column, kind: int) -> Column:
    # The lambda takes the span alone: filter would fill a second parameter, default or not, with the span's index.
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def _matches(text: Column, pattern: str, out) -> Column:
    """Array of out(match, start, gap, hit) at the matches of a pattern, in order; gap(k) and hit(k) give the gaps and matches around, k places on."""
    both = F.struct(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))

    def placed(z: Column) -> Column:
        sizes = F.transform(z["hit"], lambda h, i: (F.length(F.get(z["gap"], i)) + F.length(h)).cast("long"))
        return F.struct(z["gap"].alias("gap"), z["hit"].alias("hit"), _before(sizes, _sum).alias("at"))

    def each(z: Column) -> Column:
        return F.transform(z["hit"], lambda h, i: out(h, F.get(z["at"], i) + F.length(F.get(z["gap"], i)), lambda k: F.get(z["gap"], i + k), lambda k: F.get(z["hit"], i + k)))

    return _once(_once(both, placed), each)


def _spans(text: Column, kind: int, pattern: str, may: Column, ok) -> Column:
    def one(hit: Column, begin: Column, gap, near) -> Column:
        return F.when(ok(hit), F.struct(F.lit(kind).alias("kind"), begin.alias("s"), (begin + F.length(hit)).cast("long").alias("e"), F.xxhash64(hit).alias("value"), _right(gap(1), near(1)).alias("right")))

    return F.when(may, F.filter(_matches(text, pattern, one), lambda x: x.isNotNull()).cast(f"array<{_SPAN}>")).otherwise(F.array().cast(f"array<{_SPAN}>"))


def base_spans(text: Column) -> Column:
    """Array of (kind, s, e, value, right) of the base kinds, by start, then kind."""
    digit = text.rlike("[0-9]")
    return F.array_sort(
        F.concat(
            _spans(text, 0, _EMAIL, F.contains(text, F.lit("@")), lambda _: F.lit(True)),
            _spans(text, 1, _IP, text.rlike(r"[0-9]\.[0-9]"), _ip_ok),
            _spans(text, 2, _CARD, text.rlike(r"[0-9](?:[ -]?[0-9]){11}"), _card_ok),
            _spans(text, 3, _PHONE, F.contains(text, F.lit("+")) & digit, _phone_ok),
        ),
        lambda a, b: F.when(a["s"] != b["s"], F.signum(a["s"] - b["s"])).otherwise(F.signum(a["kind"] - b["kind"])).cast("int"),
    )


def _tokens(text: Column) -> Column:
    """Array of tokens: place, hash, the words on both sides, whether it says enough to support a pattern."""
    words = lambda gap: F.filter(F.split(F.coalesce(gap, F.lit("")), r"\s+", -1), lambda w: w != "")

    def one(hit: Column, begin: Column, gap, near) -> Column:
        value = F.rtrim(hit, F.lit(".,;:!?)\"'"))
        said = F.filter(F.concat(F.array(near(-2)), words(gap(-1)), F.array(near(-1)), words(gap(0))), lambda w: w.isNotNull())
        left = F.slice(F.concat(F.array(F.lit(""), F.lit("")), said), -2, 2)
        long = (F.length(value) >= 6) & (F.length(_digits(value)) >= 3)
        whole = F.struct(begin.alias("s"), F.lit(0).alias("kind"), (begin + F.length(value)).cast("long").alias("e"), F.xxhash64(value).alias("value"), left.alias("left"), _right(gap(1), near(1)).alias("right"), long.alias("long"))
        return F.when(value != "", whole)

    none = F.array().cast(f"array<{_TOK}>")
    return F.when(text.rlike("[0-9@]"), F.filter(_matches(text, _TOKEN, one), lambda x: x.isNotNull()).cast(f"array<{_TOK}>")).otherwise(none)


def _seeded(rows: DataFrame) -> DataFrame:
    """row, s, e, value, long, seed, pattern: the tokens outside base spans by pattern, from rows(row, base, tokens).

    Tokens and base spans stand in one order by start, a token before the spans that
    begin where it does. As tokens don't overlap, the first span that begins in a
    token comes right after it, and a token lies in a span if one before it reaches past its start.
    """
    spans = F.transform("base", lambda x: F.struct(x["s"].alias("s"), F.lit(1).alias("kind"), x["e"].alias("e"), x["value"].alias("value"), x["right"].alias("left"), x["right"].alias("right"), F.lit(True).alias("long")).cast(_TOK))
    events = rows.select("row", F.explode(F.concat("tokens", spans)).alias("x")).select("row", "x.*")
    order = W.partitionBy("row").orderBy("s", "kind", "e")
    reach = F.max(F.when(F.col("kind") == 1, F.col("e"))).over(order.rowsBetween(W.unboundedPreceding, -1))
    after = F.lead(F.struct("kind", "s", "value", "right")).over(order)
    events = events.select("*", reach.alias("reach"), after.alias("after")).where((F.col("kind") == 0) & (F.coalesce("reach", F.lit(0)) <= F.col("s")))
    seed = F.coalesce((F.col("after.kind") == 1) & (F.col("after.s") < F.col("e")), F.lit(False))
    events = events.select("row", "s", "e", F.when(seed, F.col("after.value")).otherwise(F.col("value")).alias("value"), "left", F.when(seed, F.col("after.right")).otherwise(F.col("right")).alias("right"), "long", seed.alias("seed"))
    words = F.transform(F.array(*[F.get(side, F.lit(k)) for side in ("left", "right") for k in (0, 1)]), lambda w: F.regexp_replace(F.lower(F.coalesce(w, F.lit(""))), "[0-9]+", "0"))
    events = events.select("row", "s", "e", "value", "long", "seed", words.alias("w"))
    w = [F.get("w", F.lit(k)) for k in range(4)]
    sides = F.array(*[F.when((w[k] != "") | (w[k + 1] != ""), F.xxhash64(F.lit(k), w[k], w[k + 1])) for k in range(3)])
    return events.select("row", "s", "e", "value", "long", "seed", F.explode(F.filter(sides, lambda p: p.isNotNull())).alias("pattern"))


def learned_patterns(tokens: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """pattern, conf, n: the sure patterns of the bipartite graph of tokens(pattern, value, seed, long), with their number of tokens."""
    edges = tokens.groupBy("pattern", "value").agg(F.max("seed").alias("here"), F.max("long").alias("long"), F.count("*").alias("n"))
    edges = stash(edges, "edges")
    degree = edges.groupBy("value").agg(F.count("*").alias("n_edges"), F.max("here").alias("here"))
    seeds = degree.where("here").select("value", F.lit(True).alias("base"), "n_edges")
    edges = stash(salted_join(edges, seeds, ["value"], "n_edges", "left").select("pattern", "value", F.coalesce("base", F.lit(False)).alias("base"), (F.col("long") & F.col("base").isNull()).alias("long"), "n"), "edges")
    held = edges.groupBy("pattern").agg(F.count("*").alias("size"), F.count_if("base").alias("seeds"), F.sum("n").alias("n"))
    held = stash(held, "patterns")
    # Only patterns with a seed can ever be sure by seeds, and only values that sure patterns reach add to the others.
    sure = stash(held.select("pattern", "n", "size", (F.col("seeds") / F.col("size")).alias("conf"), "seeds").where((F.col("seeds") >= MIN_SEEDS) & (F.col("conf") >= MIN_CONFIDENCE)).select("pattern", "conf", "size", "n"), "sure")
    for _ in range(rounds - 1):
        if not sure.limit(1).count():  # no pattern votes, so no further round changes anything
            break
        miss = F.log(F.greatest(F.lit(1e-9), 1 - F.col("conf")))
        votes = salted_join(edges.where("long").select("pattern", "value"), sure.select("pattern", "conf", "size"), ["pattern"], "size").select("value", "pattern", miss.alias("miss"))
        votes = stash(votes, "votes")
        reached = votes.groupBy("value").agg(F.sum("miss").alias("miss"), F.count("*").alias("k"))
        reached = reached.join(degree.drop("here"), "value")
        own = votes.select("pattern", "value", F.col("miss").alias("own"))
        met = salted_join(edges.where("long").select("pattern", "value"), reached, ["value"], "n_edges").join(own, ["pattern", "value"], "left")
        score = F.when(F.col("k") - F.when(F.col("own").isNull(), 0).otherwise(1) > 0, 1 - F.exp(F.col("miss") - F.coalesce("own", F.lit(0.0)))).otherwise(0.0)
        more = met.select("pattern", score.alias("score")).groupBy("pattern").agg(F.sum("score").alias("score"), F.count_if(F.col("score") > 0).alias("found"))
        now = held.join(more, "pattern", "left").na.fill(0, ["score", "found"])
        now = now.select("pattern", ((F.col("seeds") + F.col("score")) / F.col("size")).alias("conf"), "size", "n", (F.col("seeds") + F.col("found")).alias("all"))
        sure = stash(now.where((F.col("all") >= MIN_SEEDS) & (F.col("conf") >= MIN_CONFIDENCE)).drop("all"), "sure")
    return sure.select("pattern", "conf", "n")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans, found (kind, start, end as an array) and a hash of the text for every row."""
    text = F.col("text")
    rows = texts(docs).select("doc_id", F.xxhash64("text").alias("text_key"), base_spans(text).alias("base"), _tokens(text).alias("tokens"))
    rows = stash(rows.withColumn("row", F.monotonically_increasing_id()), "spans")
    tokens = stash(_seeded(rows.where("size(tokens) > 0").select("row", "base", "tokens")), "tokens")
    rows = rows.select("row", "doc_id", "text_key", F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e"))).alias("base"))
    sure = learned_patterns(tokens).select("pattern", "n")
    new = salted_join(tokens.where("not seed").select("row", "s", "e", "pattern"), sure, ["pattern"], "n")
    new = new.groupBy("row").agg(F.collect_set(F.struct("s", F.lit(4).alias("kind"), "e")).alias("more"))
    out = rows.select("row", "doc_id", "text_key", "base").join(new, "row", "left")
    names = F.array(*map(F.lit, KINDS))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"], x["e"])), ",")

    every = F.array_sort(F.concat(F.col("base"), F.coalesce(F.col("more"), F.array().cast("array<struct<s:bigint,kind:int,e:bigint>>"))))
    counts = [_count(F.col("base"), k).alias(f"n_{KINDS[k]}") for k in range(4)]
    return out.select("doc_id", *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(every).alias("spans"), every.alias("found"), "text_key")


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced by its kind in angle brackets; n_chars is renewed where it exists."""
    spans = find_personal_data(docs).where("spans <> ''").select(F.col("doc_id").alias("span_id"), F.col("text_key").alias("span_key"), "found").dropDuplicates(["span_id", "span_key"])
    names = F.array(*map(F.lit, KINDS))
    # The row travels as one struct, so that its names meet none of those made here.
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.col("row")["text"]
    out = row.join(spans.hint("shuffle_hash"), (F.col("row")["doc_id"] == F.col("span_id")) & (F.xxhash64(text) == F.col("span_key")), "left")
    # Pieces of the text by position: what lies between two spans is cut from the pieces that hold its ends.
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def cut(pieces: Column, a: Column, b: Column) -> Column:
        i, j = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
        part = lambda k: F.coalesce(F.get(pieces, k), F.lit(""))
        ahead, end = (a % PIECE).cast("int"), (b % PIECE).cast("int")
        wide = F.concat(F.substr(part(i), ahead + 1), F.array_join(F.slice(pieces, i + 2, F.greatest(F.lit(0), j - i - 1)), ""), F.substr(part(j), F.lit(1), end))
        return F.when(b <= a, "").when(i == j, F.substr(part(i), ahead + 1, end - ahead)).otherwise(wide)

    def joined(z: Column) -> Column:
        def part(x: Column, i: Column) -> Column:
            done = F.get(z["reach"], i)
            tag = F.when(x["s"] >= done, F.concat(F.lit("<"), F.get(names, x["kind"]), F.lit(">"))).otherwise("")
            return F.concat(cut(z["pieces"], done, x["s"]), tag)

        return F.concat(F.array_join(F.transform(z["found"], part), ""), cut(z["pieces"], _most(F.transform(z["found"], lambda x: x["e"])), F.length(text).cast("long")))

    masked = _once(F.struct(F.col("found").alias("found"), _before(F.transform("found", lambda x: x["e"]), _most).alias("reach"), pieces.alias("pieces")), joined)
    clean = F.col("found").isNull()
    new = {"text": F.when(clean, text).otherwise(masked), "n_chars": F.when(clean, F.col("row")["n_chars"]).otherwise(F.length(masked).cast("long")) if "n_chars" in docs.columns else None}
    return out.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(documents(spark, sf_dir)).drop("found", "text_key")


QUERIES = {"op4_pii_bootstrap": op4}
