"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir), works on all rows it is given and returns a DataFrame; run() writes each stage's
result as Parquet in the shared folder and reads it again as the next one's docs. All but the last return the columns of
documents; n_chars follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vellum.llm import bagminhash, bpe, linededup, toxicity, wfq
from vellum.session import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier scores 0.7 or more go; null and empty texts stay."""
    return toxicity.scored(docs.select(COLUMNS), table(spark, sf_dir, "labels")).where("predicted = 0").select(COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines repeated over three documents or more stay in the last of them only; documents stay, though they may be empty then."""
    kept = linededup.dedup_lines(docs.select(COLUMNS), with_text=True)
    return kept.select("row.doc_id", F.col("kept").alias("text"), "row.lang", "row.source", F.length("kept").cast("long").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class stays: that of the least id, nulls last, then of the least text hash, language, source and length."""
    rest = ["lang", "source", "n_chars"]
    rows = docs.select(COLUMNS).groupBy("doc_id", bagminhash.text_md5().alias("key")).agg(F.first("text").alias("text"), F.min(F.struct(rest)).alias("rest"))
    kept = bagminhash.representatives(docs).select(F.col("doc_id").alias("kept_id"), F.col("text_md5").alias("kept_key"))
    chosen = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("kept_key")), "left_semi")
    return chosen.select("doc_id", "text", *(F.col(f"rest.{c}").alias(c) for c in rest))


def _first_words(text: Column, taken: Column, size: Column) -> Column:
    """The text where all its words are taken, else its first words with single spaces between."""
    pieces = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.when(taken >= size, text).otherwise(F.array_join(F.slice(pieces, F.lit(1), taken.cast("int")), " "))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix to target weights: a row each time a document is taken; one taken in part keeps its first words, so many, with single spaces between.

    Null and empty texts have no words and are never taken. Rows alike in id, text and source are one document, of the least language.
    """
    key = F.md5(F.coalesce("text", F.lit("")))
    sent = wfq.mix(docs).select(F.col("doc_id").alias("id_"), "text_md5", F.col("source").alias("source_"), "size", "taken")
    rest = ["lang", "n_chars"]  # of rows alike in id, text and source the least stays, so that reruns agree
    rows = docs.select(*COLUMNS, key.alias("key")).groupBy("doc_id", "source", "key").agg(F.first("text").alias("text"), F.min(F.struct(rest)).alias("rest")).select("doc_id", "source", "key", "text", "rest.lang")
    on = F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("key") == F.col("text_md5")) & F.col("source").eqNullSafe(F.col("source_"))
    text = _first_words(F.col("text"), F.col("taken"), F.col("size"))
    mixed = rows.join(sent.hint("shuffle_hash"), on).withColumn("text", text)
    return mixed.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every text: doc_id, n_tokens, ids and the digests of ids and of the text decoded from them."""
    return bpe.encode_texts(docs, digests=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode),
]

#: A trained classifier, near duplicates and BPE merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage after the other. Null ids, texts, languages and sources are kept as such by each stage until the mix, which takes texts with words alone; no documents give no rows."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k}")
    return docs
