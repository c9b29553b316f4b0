"""Five stages over documents, each reading what the one before has written.

All stages take nulls in any column, empty and very long texts, repeated rows and
ids, empty tables, and extra columns of any name, which they keep up to the last
stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amberlode.llm import langid, line_dedup, ngram_join, packing, pii
from amberlode.llm.common import crc_mod, small_batches, stash, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts and texts without letters. Repeated rows stay."""
    small_batches(spark)
    fold = crc_mod(F.col("doc_id"), langid.FOLDS) == langid.HELD_OUT
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    said = langid.predict(row, langid.fit(docs.where(~fold)), ["row"])
    return said.where(F.col("lang_pred") != "und").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines of many sites from all documents but those that consist of such lines, which are copies.

    Null and empty texts stay as they are; no document goes.
    """
    out = line_dedup.drop_spread_lines(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text", "source"), spare_copies=True)
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("row")["n_chars"]) if "n_chars" in docs.columns else None}
    return out.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by five-word shingles at 0.8: the smallest id's, and of its texts the one with the smallest hash.

    Rows that repeat id and text are one document. Different texts of one id are
    documents of their own. Null texts and texts without words are linked with
    nothing; all their rows stay.
    """
    small_batches(spark)
    rows = ngram_join.link_rows(docs, n=5, percent=80)
    first = F.min(F.struct("doc_id", "text_key"))
    kept = rows.where("n_shingles > 0").groupBy("component").agg(first.alias("x")).select(F.col("x.doc_id").alias("kept_id"), F.col("x.text_key").alias("kept_key"))
    blank = rows.where("n_shingles = 0").select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key")).distinct()
    kept = stash(kept.withColumn("one", F.lit(True)).unionByName(blank.withColumn("one", F.lit(False))), "kept")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    key = ngram_join.text_key(F.col("row")["text"])
    out = row.join(kept.hint("shuffle_hash"), F.col("row")["doc_id"].eqNullSafe(F.col("kept_id")) & (key == F.col("kept_key")))
    if out.where("one").groupBy("kept_id", "kept_key").count().where("count > 1").limit(1).count():
        several = out.where("one").groupBy("kept_id", "kept_key").agg(F.min("row").alias("row")).select("row")
        out = several.unionByName(out.where("not one").select("row"))
    return out.select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind. No document goes; null and empty texts stay as they are."""
    return pii.mask_personal_data(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, of every row; a null text counts as empty, and an empty one is its end id."""
    small_batches(spark)
    return packing.pack_documents(docs, *packing.public_tokenizer())


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
