"""Operator 5: removal of lines that spread over many sites.

Lines are the \\n-separated parts of a text, trimmed of blanks, tabs and carriage
returns; empty ones do not count. A line's spread is the number of distinct sites
(source; a null source is one site of its own, apart from '') that hold it. One
aggregation merges a HyperLogLog sketch per line hash; a line whose estimate lies
within MARGIN of the threshold gets its exact distinct count, the others are
decided by the sketch.

A line with spread of at least min_sites is boilerplate and leaves every document.
With spare_copies, as the pipeline has it, a document of which every line is spread
stays whole: it is a copy of a text that many sites hold, not a text with
boilerplate in it, and belongs to near-duplicate removal.

Null texts stay null and empty texts empty. Order and content of the other lines
stay as they are, and so do all other columns, whatever their names, but n_chars,
which is renewed; the result's n_removed takes the place of a column of that name.
A line with just min_sites sites is boilerplate. Repeated rows count as one site's,
and ids may repeat as rows are matched by id and text hash. Very long texts are
handled whole; an empty table gives an empty result. Lines that a large share of
all rows hold are dealt over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, salted_join, stash

MIN_SITES = 10
MARGIN = 0.25
LOG_K = 12
BLANKS = " \t\r"


def _lines(docs: DataFrame) -> DataFrame:
    """One row for each line with words: key of its document, position, hash, site."""
    line = F.btrim(F.col("line"), F.lit(BLANKS))
    site = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    parts = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_key"), site.alias("site"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return parts.where(line != "").select("doc_id", "text_key", "pos", "site", F.xxhash64(line).alias("line_key"))


def spread_lines(docs: DataFrame, min_sites: int = MIN_SITES, margin: float = MARGIN) -> DataFrame:
    """line_key and number of rows n of every line on at least min_sites sites."""
    lines = _lines(docs)
    several = lines.groupBy("line_key").agg(F.hll_sketch_agg("site", F.lit(LOG_K)).alias("sketch"), F.count("*").alias("n"))
    several = several.select("line_key", "n", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= int(min_sites * (1 - margin)))
    several = stash(several, "several")
    near = several.where(F.col("sites") <= min_sites * (1 + margin)).select("line_key", "n")
    sites = salted_join(lines, near.withColumn("rows", F.col("n")), ["line_key"], "rows").select("line_key", "n", "site").distinct()
    exact = sites.groupBy("line_key", "n").count().where(F.col("count") >= min_sites).select("line_key", "n")
    return several.where(F.col("sites") > min_sites * (1 + margin)).select("line_key", "n").unionByName(exact)


def drop_spread_lines(docs: DataFrame, min_sites: int = MIN_SITES, spare_copies: bool = False) -> DataFrame:
    """docs with boilerplate lines gone, and the number of lines that went in n_removed."""
    spread = stash(spread_lines(docs, min_sites), "spread")
    hits = salted_join(_lines(docs).select("doc_id", "text_key", "pos", "line_key"), spread, ["line_key"], "n").select("doc_id", "text_key", "pos").distinct()
    hits = hits.groupBy("doc_id", "text_key").agg(F.collect_list("pos").alias("at")).select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key"), "at")
    # The row travels as one struct, so that its names meet none of those made here.
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    own = row["row"]
    out = row.join(hits.hint("shuffle_hash"), (own["doc_id"] == F.col("hit_id")) & (F.xxhash64(own["text"]) == F.col("hit_key")), "left")
    text, at = F.col("row")["text"], F.col("at")
    parts = F.split(text, "\n", -1)
    cut = at.isNotNull()
    if spare_copies:
        cut &= F.size(at) < F.size(F.filter(parts, lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), at)
    kept = F.when(cut, F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n")).otherwise(text)
    new = {"text": kept, "n_chars": F.length(kept).cast("long")}
    columns = [new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns if c != "n_removed"]
    return out.select(*columns, F.when(cut, F.size(at)).otherwise(0).cast("long").alias("n_removed"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_spread_lines(documents(spark, sf_dir))
    return out.select("doc_id", "source", "text", "n_removed", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op5_line_spread": op5}
ORACLES = {
    "op5_line_spread": f"""
with parts as (
  select doc_id, source, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos
  from documents where text is not null),
lines as (select *, trim(line, ' ' || chr(9) || chr(13)) as t from parts),
spread as (select t from lines where t <> '' group by t having count(distinct source) + max(case when source is null then 1 else 0 end) >= {MIN_SITES}),
agg as (
  select doc_id, text, pos, min(line) as line, bool_or(s.t is not null) as hit from lines l left join spread s on l.t = s.t and l.t <> '' group by doc_id, text, pos),
cut as (
  select doc_id, text, count(*) filter (where hit) as hits, string_agg(line, chr(10) order by pos) filter (where not hit) as rest from agg group by doc_id, text),
done as (
  select d.doc_id, d.source, case when a.hits > 0 then coalesce(a.rest, '') else d.text end as text, cast(coalesce(a.hits, 0) as bigint) as n_removed
  from documents d left join cut a on a.doc_id = d.doc_id and a.text = d.text)
select *, cast(length(text) as bigint) as n_chars from done
""",
}
