"""The corpus pipeline: toxicity, line dedup, near-dedup, mixing, BPE. Each stage works on all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, linededup, mixing, neardup, toxicity
from quillon.llm.common import release, shared_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network rejects go."""
    return toxicity.reject(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of later occurrences of repeated three-line windows go; every document stays, with what is left of it."""
    out = linededup.dedup_lines(docs.select(COLUMNS))
    length = F.when(F.size("_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.select("doc_id", F.when(F.size("_removed") > 0, F.col("text")).otherwise(F.col("_before")).alias("text"), "lang", "source", length.alias("n_chars"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays, one of no id last (of repeated rows, one)."""
    docs = docs.select(COLUMNS)
    found = neardup.classes(docs).filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
    # What is left of a class has one doc_id, or none; a doc_id can be left in several classes.
    keys = found.groupBy("root").agg(F.min("doc_id").alias("_doc"), F.min("th").alias("_th"))
    docs = docs.withColumn("th", F.xxhash64("text"))
    out = docs.join(keys, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("th") == F.col("_th")), "left_semi")
    return out.dropDuplicates(["doc_id", "th"]).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay as often as a whole as the mix takes their words, rounded so that sources meet their targets.

    Rows that agree in doc_id, source and text are one document, which all their copies are made of."""
    docs = docs.select(COLUMNS)
    th = F.xxhash64("text")

    def key(th):
        return F.xxhash64("doc_id", F.col("doc_id").isNull(), "source", F.col("source").isNull(), th).alias("_key"), th.alias("_th")

    copies = mixing.whole_copies(mixing.mix(docs)[0]).filter("times > 0")
    copies = copies.select(*key(F.col("th")), "times").groupBy("_key", "_th").agg(F.sum("times").cast("int").alias("_times"))
    out = docs.select(*COLUMNS, *key(th)).join(copies, ["_key", "_th"]).dropDuplicates(["_key", "_th"])
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text, for every document of the mix."""
    return bpe.encode(docs.select(COLUMNS))


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("near dedup", drop_copies), ("mixing", mix_sources), ("bpe", encode)]
#: The network and the tokenizer have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Of what the stages wrote, only the input of the last one is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared_table(docs, f"stage-{k}")
            release(spark, docs)
    return docs
