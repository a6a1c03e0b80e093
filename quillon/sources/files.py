"""File scans: binary files with a content-addressed id and a status for each, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LARGEST = 100 << 20


def content_id(content: Column) -> Column:
    """16 hex digits of the SHA-256 of bytes or of a text's UTF-8."""
    return F.substring(F.sha2(content, 256), 1, 16)


def checked(files: DataFrame, largest: int = LARGEST) -> DataFrame:
    """binaryFile rows with document_id (16 hex digits of the SHA-256), filename and status; bad files stay, as rows."""
    name = F.element_at(F.split("path", "/"), -1)
    status = F.when(~F.lower("path").endswith(".pdf"), "wrong suffix").when(F.col("length") > largest, "too large").when(F.substring("content", 1, 5) != F.lit(b"%PDF-"), "not a PDF").otherwise("ok")
    return files.select(content_id(F.col("content")).alias("document_id"), name.alias("filename"), "path", "length", F.col("modificationTime").alias("modification_time"), status.alias("status"))


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """The PDF files of one folder, not of those below it."""
    return checked(spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,PDF}").load(folder))


def documents_of(files: DataFrame) -> DataFrame:
    """One row per content: equal bytes under two names are one document, named by the first."""
    return files.filter("status = 'ok'").groupBy("document_id").agg(F.min("filename").alias("filename"), F.count("*").alias("n_files"))
