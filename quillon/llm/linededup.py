"""Line dedup by overlapping three-line windows, with DataFrame operations only.

Every run of three consecutive lines is hashed (128 bits). Of a window that occurs more than once in the corpus, in the
order (doc_id, hash of the text, line number), the first occurrence stays; the lines of all later ones go, overlapping
windows merged. The counts are partial sums before the shuffle, so a window that a third of all rows holds is one row
per task; the join that finds later occurrences is an equi-join whose large partitions AQE splits.

Defined cases: null text is empty; a text of fewer than three lines keeps all; a document may lose every line and then
has the empty text; rows that agree in doc_id and text are one document and get the same result; an empty table gives
an empty result; other columns pass through dedup_lines, but for _lines, _removed and _before, which it sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import free, shared_table

WIDTH = 3


def later_windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, th, starts): first lines of the windows that occurred before."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("th"), F.split("text", "\n", -1).alias("lines")).filter(F.size("lines") >= width)
    lines = lines.select("doc_id", "th", F.transform("lines", lambda x: F.xxhash64(x)).alias("p"), F.transform("lines", lambda x: F.xxhash64(x, F.lit(1))).alias("q"))
    at = F.sequence(F.lit(1), F.size("p") - width + 1)
    both = F.transform(at, lambda i: F.struct((i - 1).alias("pos"), F.xxhash64(*(F.element_at("p", i + k) for k in range(width))).alias("h"), F.xxhash64(F.lit(2), *(F.element_at("q", i + k) for k in range(width))).alias("g")))
    windows = lines.select("doc_id", "th", F.inline(both))
    windows = shared_table(windows, "line-windows")
    place = F.struct("doc_id", "th", "pos")
    firsts = windows.groupBy("h", "g").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = windows.join(firsts, ["h", "g"]).filter(~place.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("starts"))


#: Documents that lose lines, and windows they lose, that may be broadcast to meet the texts.
MOST_DOCS, MOST_WINDOWS = 100_000, 1_000_000


def dedup_lines(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """All rows and columns of docs, text replaced by what is left, and _lines, _removed (line numbers), _before."""
    given = docs.withColumn("_before", F.col("text")).withColumn("text", F.coalesce("text", F.lit("")))
    later = shared_table(later_windows(given.select("doc_id", "text"), width), "later-windows")
    n, total = later.agg(F.count("*"), F.sum(F.size("starts"))).first()
    doc, th, starts = (free(given, c) for c in ("_doc", "_th", "_starts"))
    later = later.select(F.col("doc_id").alias(doc), F.col("th").alias(th), F.col("starts").alias(starts))
    # its size is known: texts stay where they are unless very many documents lose lines
    later = F.broadcast(later) if n <= MOST_DOCS and (total or 0) <= MOST_WINDOWS else later
    marked = given.join(later, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(th)), "left")
    removed = F.array_sort(F.array_distinct(F.flatten(F.transform(starts, lambda p: F.array(*(p + k for k in range(width)))))))
    marked = marked.withColumn("_lines", F.split("text", "\n", -1)).withColumn("_removed", F.coalesce(removed, F.expr("cast(array() as array<int>)")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_removed")
    left = F.array_join(F.transform(kept, lambda i: F.element_at("_lines", i + 1)), "\n")
    return marked.withColumn("text", F.when(F.size("_removed") > 0, left).otherwise(F.col("text"))).drop(doc, th, starts)


def query(spark, docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs.select("doc_id", "text"))
    spans = F.size(F.array_except("_removed", F.transform("_removed", lambda i: i + 1)))
    return out.select("doc_id", F.size("_lines").cast("long").alias("n_lines"), F.size("_removed").cast("long").alias("n_removed"), spans.cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, unnest(range(len(lines) - 2)) AS pos, lines FROM d WHERE len(lines) >= 3),
v AS (SELECT doc_id, pos, lines[pos + 1] || chr(10) || lines[pos + 2] || chr(10) || lines[pos + 3] AS win FROM w),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS nth FROM v),
c AS (SELECT DISTINCT doc_id, pos + k AS i FROM r, (SELECT unnest([0, 1, 2]) AS k) WHERE nth > 1),
g AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id)
SELECT d.doc_id, len(lines)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
  coalesce(len(list_filter(gone, lambda i: NOT list_contains(gone, i - 1))), 0)::BIGINT AS n_spans,
  sha256(coalesce(array_to_string(list_filter(lines, lambda x, i: NOT list_contains(coalesce(gone, []), i - 1)), chr(10)), '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
