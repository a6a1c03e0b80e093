"""The queries of the operators, and the SQL that gives the same rows."""

from __future__ import annotations

from quillon.llm import ann, bpe, licenses, linededup, matroska, mixing, neardup, secrets, suffixes, toxicity
from quillon.llm.common import documents


def over_documents(query):
    return lambda spark, sf_dir: query(spark, documents(spark, sf_dir))


QUERIES = {
    "op1_toxicity": lambda spark, d: toxicity.query(spark, documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")),
    "op2_probminhash": over_documents(neardup.query),
    "op3_mixing": over_documents(mixing.query),
    "op4_bpe": over_documents(bpe.query),
    "op5_suffix_dedup": over_documents(suffixes.query),
    "op6_secret_scan": over_documents(secrets.query),
    "op7_matroska": over_documents(matroska.query),
    "op8_line_dedup": over_documents(linededup.query),
    "op9_permutation_index": lambda spark, d: ann.query(spark, spark.read.parquet(f"{d}/embeddings.parquet")),
    "op10_license_scan": over_documents(licenses.query),
}
SQL = {"op8_line_dedup": linededup.SQL}
