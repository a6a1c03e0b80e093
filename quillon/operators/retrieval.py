"""Hybrid retrieval: filtered exact dense top-k, lexical scores over the candidates, blend, hydration, promotion.

Everything is batched over a table of questions. Questions are a stated set; they meet the vectors in blocks of bounded
size, a scan of the narrow vector columns for each, as a matrix product behind Arrow. Only the best of each Arrow batch
leave it. Texts are fetched for the candidates alone, which are written once for the steps that read them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import once, references, tokens
from quillon.operators.scratch import written

# Results, candidates for each, weight of the lexical score, bonus of a named reference.
K, MULTIPLIER, WEIGHT, BONUS = 6, 4, 0.35, 1.0
#: Questions in a block; values up to which a filter that all questions of a block share is pushed into the scan; rows
#: of candidates that may be broadcast.
BLOCK, PUSHED, BROADCAST = 4096, 500, 100_000


def allowed(wanted: str, value: str) -> Column:
    """An empty or null list filters nothing."""
    return F.coalesce(F.size(wanted), F.lit(0)).isin(0, -1) | F.array_contains(wanted, F.col(value))


def _block_topk(vectors: DataFrame, rows: list, k: int) -> DataFrame:
    """The best k or more of each Arrow batch for a block of questions (bounded rows)."""
    qids, q = np.array([r.qid for r in rows], np.int64), np.array([r.q_embedding for r in rows], np.float64)
    limits = [(c, [set(r[w]) if r[w] else None for r in rows]) for c, w in (("document_id", "document_ids"), ("kind", "kinds"))]
    for column, sets in limits:
        union = set().union(*(s for s in sets if s)) if all(sets) else set()
        if 0 < len(union) <= PUSHED:
            vectors = vectors.filter(F.col(column).isin(sorted(union)))
    limits = [(c, sets) for c, sets in limits if any(sets)]

    def run(batches):
        for batch in batches:
            flat = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            score = q @ flat.reshape(batch.num_rows, -1).T if batch.num_rows else np.zeros((len(q), 0))
            for column, sets in limits:
                values = np.array(batch.column(("element_id", "document_id", "kind").index(column)).to_pylist(), object)
                for i, s in enumerate(sets):
                    if s:
                        score[i, [v not in s for v in values]] = -np.inf
            # ties at the edge stay: the order among them is the next step's
            edge = np.partition(score, -k, axis=1)[:, -k] if batch.num_rows > k else np.full(len(q), -np.inf)
            i, j = np.nonzero((score >= edge[:, None] - 2e-9) & (score > -np.inf))
            at = pa.array(j)
            yield pa.RecordBatch.from_arrays([pa.array(qids[i]), *(batch.column(c).take(at) for c in range(3)), pa.array(score[i, j])], ["qid", "element_id", "document_id", "kind", "dense"])

    found = vectors.select(F.col("element_id"), F.col("document_id"), F.col("kind"), F.col("embedding").cast("array<double>"))
    return found.mapInArrow(run, "qid long, element_id string, document_id string, kind string, dense double")


def dense_topk(vectors: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """vectors(element_id, document_id, kind, embedding) x questions(qid, q_embedding, document_ids, kinds) -> the k
    nearest of each question with dense and pos; document and kind filters hold before the search."""
    out, block = None, []

    def done(block: list) -> None:
        nonlocal out
        found = _block_topk(vectors, block, k)
        out = found if out is None else out.unionByName(found)

    # the stated set, a bounded block of it on the driver at a time
    for r in questions.select("qid", "q_embedding", "document_ids", "kinds").toLocalIterator():
        block.append(r)
        if len(block) == BLOCK:
            done(block)
            block = []
    if block:
        done(block)
    if out is None:
        out = vectors.limit(0).select(F.lit(0).cast("long").alias("qid"), "element_id", "document_id", "kind", F.lit(0.0).alias("dense"))
    out = out.withColumn("dense", F.round("dense", 9))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("dense"), "element_id"))
    return out.withColumn("pos", place).filter(F.col("pos") <= k)


def candidates(vectors: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """dense_topk with question and content, written once."""
    found = written(dense_topk(vectors, questions, k), "dense")
    small = found.limit(BROADCAST + 1).count() <= BROADCAST
    held = vectors.select("element_id", "content").join(F.broadcast(found) if small else found, "element_id")
    return written(held.join(questions.select("qid", "question"), "qid"), "candidates")


def minmax(value: str, by: Window) -> Column:
    """value scaled to 0 ... 1 within the window; where all are equal, 1 if they are above 0."""
    low, high = F.min(value).over(by), F.max(value).over(by)
    return F.when(high - low < 1e-9, F.when(high > 0, 1.0).otherwise(0.0)).otherwise((F.col(value) - low) / (high - low))


def lexical(rows: DataFrame) -> DataFrame:
    """rows(qid, question, pos, content, ...) with lexical: idf over the candidates, length damping, reference bonus, min-max."""
    c = rows.withColumns({"_q": F.array_distinct(tokens(F.col("question"))), "_t": F.array_distinct(tokens(F.col("content"))), "_qr": references(F.col("question")), "_r": references(F.col("content"))})
    c = c.withColumn("_hit", F.array_intersect("_q", "_t"))
    # a question's candidates are few: their terms are counted within a group of that size
    own = F.collect_list("_hit").over(Window.partitionBy("qid"))
    counts = once(F.flatten(own), lambda all_: F.map_from_entries(F.transform(F.array_distinct(all_), lambda t: F.struct(t, F.size(F.filter(all_, lambda u: u == t))))))
    c = c.withColumns({"_df": counts, "_n": F.count("*").over(Window.partitionBy("qid"))})
    total = F.aggregate("_hit", F.lit(0.0), lambda s, t: s + F.ln(1 + F.col("_n") / (1 + F.element_at("_df", t))))
    raw = total / F.sqrt(1 + F.size("_t")) + F.when(F.arrays_overlap("_qr", "_r"), BONUS).otherwise(0.0)
    c = c.withColumn("_raw", F.when((F.size("_q") > 0) | (F.size("_qr") > 0), raw).otherwise(0.0))
    return c.withColumn("lexical", minmax("_raw", Window.partitionBy("qid"))).drop("_q", "_t", "_qr", "_r", "_hit", "_df", "_n", "_raw")


def hybrid_rank(rows: DataFrame, k: int = K, weight: float = WEIGHT) -> DataFrame:
    """Blend and keep the best k; equal blends keep the dense order. A weight of 0 keeps the dense order throughout."""
    if weight <= 0:
        return rows.filter(F.col("pos") <= k).withColumns({"blend": F.col("dense"), "rank": F.col("pos")})
    blend = F.round((1 - weight) * F.least(F.greatest("dense", F.lit(0.0)), F.lit(1.0)) + weight * F.col("lexical"), 9)
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("blend"), "pos"))
    return lexical(rows).withColumn("blend", blend).withColumn("rank", place).filter(F.col("rank") <= k)


def hydrated(rows: DataFrame, elements: DataFrame) -> DataFrame:
    """Stored text, caption and page of each hit; a hit without its element falls back to the indexed text."""
    e = elements.select("element_id", F.lit(True).alias("_stored"), F.col("text").alias("_text"), F.col("summary").alias("_summary"), "caption", "page_number")
    own = F.coalesce(F.nullif(F.when(F.col("kind").isin("table", "figure"), F.col("_summary")).otherwise(F.col("_text")), F.lit("")), F.col("_summary"))
    return rows.join(e, "element_id", "left").withColumn("text", F.when(F.col("_stored"), own).otherwise(F.col("content"))).drop("_stored", "_text", "_summary")


def by_reference(elements: DataFrame, asked: DataFrame) -> DataFrame:
    """elements whose caption names a reference of asked(qid, document_ids, refs), each once for a question."""
    named = elements.filter("caption is not null").select("element_id", "document_id", "kind", F.explode(references(F.col("caption"))).alias("ref"))
    wanted = asked.select("qid", "document_ids", F.explode("refs").alias("ref"))
    return named.join(wanted, "ref").filter(allowed("document_ids", "document_id")).select("qid", "element_id", "document_id", "kind").distinct()


def promoted(hits: DataFrame, elements: DataFrame, questions: DataFrame, k: int = K) -> DataFrame:
    """hits(qid, rank, element_id, document_id, kind, score, content) with the elements that the question names put first,
    without a score, unless they are among the hits; a question without hits gets none. Cut to k, ranked anew."""
    asked = questions.select("qid", "document_ids", references(F.col("question")).alias("refs")).filter(F.size("refs") > 0)
    named = by_reference(elements, asked.join(hits.select("qid").distinct(), "qid", "left_semi"))
    named = named.join(hits.select("qid", "element_id"), ["qid", "element_id"], "left_anti").withColumns({"rank": F.lit(0), "content": F.lit(""), "score": F.lit(None).cast("double")})
    both = hits.unionByName(named.select(hits.columns))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("rank", "element_id"))
    return both.withColumn("rank", place).filter(F.col("rank") <= k)


def search(vectors: DataFrame, elements: DataFrame, questions: DataFrame, k: int = K, multiplier: int = MULTIPLIER, weight: float = WEIGHT) -> DataFrame:
    """qid, rank, element_id, document_id, kind, score (dense; null if promoted), page_number, caption, text."""
    found = hybrid_rank(candidates(vectors, questions, max(k * multiplier, k)), k, weight)
    hits = written(found.select("qid", "rank", "element_id", "document_id", "kind", "content", F.col("dense").alias("score")), "hits")
    out = written(promoted(hits, elements, questions, k), "promoted")
    small = out.limit(BROADCAST + 1).count() <= BROADCAST
    if small:  # so few hits that the elements needn't move to meet them
        elements = elements.join(F.broadcast(out.select("element_id").distinct()), "element_id", "left_semi")
    return hydrated(out, elements).select("qid", "rank", "element_id", "document_id", "kind", "score", "page_number", "caption", "text")
