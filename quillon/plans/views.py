"""Views that turn the driver's tables into elements, blocks, boxes and questions, by the same arithmetic in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import hash_embedding, retrieval_text

ELEMENTS = """
SELECT doc_id, source AS document_id, source || ':e:' || CAST(doc_id AS STRING) AS element_id,
  CASE doc_id % 5 WHEN 3 THEN 'table' WHEN 4 THEN 'figure' ELSE 'text' END AS kind,
  CAST(doc_id % 40 + 1 AS BIGINT) AS page_number,
  CASE doc_id % 5 WHEN 3 THEN 'Table A.' || CAST(doc_id % 17 AS STRING) || ' ' || substr(text, 1, 40)
    WHEN 4 THEN (CASE doc_id % 2 WHEN 0 THEN 'Fig. ' ELSE 'Figure ' END) || CAST(doc_id % 17 AS STRING) || '. ' || substr(text, 1, 40) END AS caption,
  text AS summary, text
FROM documents
"""
QUESTIONS = """
SELECT CAST(item_id AS BIGINT) AS qid,
  CASE item_id % 2 WHEN 0 THEN 'What does Figure ' || CAST(item_id % 17 AS STRING) || ' show about ' ELSE 'Explain ' END || substr(text, 1, 60) AS question
FROM benchmark
"""
#: A page is 16 orders; boxes are line items.
PRIMS = """
SELECT CAST(l_orderkey // 16 AS BIGINT) AS page_number, 'doc' AS document_id, CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS prim_no,
  CAST(l_partkey * 13 % 500 AS DOUBLE) AS x0, CAST(l_suppkey * 7 % 700 AS DOUBLE) AS y0,
  CAST(l_partkey * 13 % 500 + l_quantity AS DOUBLE) AS x1, CAST(l_suppkey * 7 % 700 + l_linenumber * 4 AS DOUBLE) AS y1,
  l_linenumber = 1 AS is_raster
FROM lineitem
"""
#: Documents of the index: a source, as old as its first document.
DOCUMENTS = """
SELECT source AS document_id, source || '.pdf' AS filename, CAST(count(*) AS BIGINT) AS pages, CAST(min(doc_id) AS BIGINT) AS created_at
FROM documents WHERE source IS NOT NULL GROUP BY source
"""
#: A page is a document; its lines alternate between two columns (doc_id even) or fill the width, some stand in the gutter
#: or reach into the next line; every seventh is a caption.
_BLOCK = """
SELECT CAST(doc_id AS BIGINT) AS page_number, 'doc' AS document_id, CAST(block_no AS BIGINT) AS block_no,
  CAST(CASE WHEN block_no % 11 = 5 THEN 280 WHEN doc_id % 2 = 0 AND block_no % 2 = 1 THEN 320 ELSE 50 END AS DOUBLE) AS x0,
  CAST(CASE WHEN block_no % 11 = 5 THEN 315 WHEN doc_id % 2 = 0 AND block_no % 2 = 0 THEN 280 ELSE 550 END AS DOUBLE) AS x1,
  CAST(40 + 20 * block_no + 30 * (block_no // 5) AS DOUBLE) AS y0, CAST(CASE block_no % 9 WHEN 4 THEN 70 ELSE 52 END + 20 * block_no + 30 * (block_no // 5) AS DOUBLE) AS y1,
  CASE block_no % 7 WHEN 2 THEN 'Table ' || CAST(block_no AS STRING) || '. ' WHEN 6 THEN 'Figure ' || CAST(block_no AS STRING) || ': ' ELSE '' END || line AS text
"""
BLOCKS_DUCK = _BLOCK + "FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS block_no FROM documents)"
BLOCKS_SPARK = (_BLOCK + "FROM (SELECT doc_id, posexplode(split(text, '\\n', -1)) AS (block_no, line) FROM documents)").replace("block_no // 5", "block_no div 5")
PAGES = "SELECT CAST(doc_id AS BIGINT) AS page_number, 'doc' AS document_id, CAST(595 AS DOUBLE) AS width, CAST(3000 AS DOUBLE) AS height FROM documents"
#: Boxes that stand for clusters: primitives grown to the size of figures.
FIGURES = """
SELECT page_number, document_id, prim_no AS box_no, x0, y0, x0 + (x1 - x0) * 12 AS x1, y0 + (y1 - y0) * 6 AS y1,
  CAST(prim_no % 5 AS BIGINT) AS primitive_count, is_raster AS has_raster FROM prims
"""


def load(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "documents")
    return spark.sql(ELEMENTS)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = elements(spark, sf_dir).withColumn("content", retrieval_text(F.col("page_number"), F.col("caption"), F.col("summary"), F.col("text")))
    return e.filter("content <> ''").select("element_id", "document_id", "kind", "content", hash_embedding(F.col("content")).alias("embedding"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "benchmark")
    none = F.expr("cast(array() as array<string>)")
    return spark.sql(QUESTIONS).select("qid", "question", hash_embedding(F.col("question")).alias("q_embedding"), none.alias("document_ids"), none.alias("kinds"))


def prims(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "lineitem")
    return spark.sql(PRIMS.replace("l_orderkey // 16", "l_orderkey div 16"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "documents")
    return spark.sql(BLOCKS_SPARK)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "documents")
    return spark.sql(PAGES)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "documents")
    return spark.sql(DOCUMENTS)


def figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    prims(spark, sf_dir).createOrReplaceTempView("prims")
    return spark.sql(FIGURES)
