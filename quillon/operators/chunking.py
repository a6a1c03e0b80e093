"""Text chunks with overlap, and the page each chunk starts on."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sizes in characters, and where texts are cut, the coarsest first.
SIZE, OVERLAP, LEAST = 1400, 200, 40
SEPARATORS = ("\n\n", "\n", ". ", " ")


def fixed(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """array(struct(start, text)) of pieces of size characters, each overlap characters into the last."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(text) - overlap - 1), F.lit(size - overlap))
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.substr(text, i + 1, F.lit(size)).alias("text")))


def _pieces(text: str, a: int, b: int, size: int, level: int = 0) -> list[tuple[int, int]]:
    """[a, b) of text as ranges under size: cut before each of the coarsest separators that occur, those too long again at
    finer ones, at last between characters."""
    while level < len(SEPARATORS) and text.find(SEPARATORS[level], a, b) < 0:
        level += 1
    if level == len(SEPARATORS):
        return [(i, i + 1) for i in range(a, b)]
    out, sep, at = [], SEPARATORS[level], a
    while at < b:
        end = text.find(sep, at + len(sep) * (at > a), b)
        end = b if end < 0 else end
        if end > at:
            out += [(at, end)] if end - at < size else _pieces(text, at, end, size, level + 1)
        elif end == at == a:  # the text begins with a separator, which goes with what follows
            end = text.find(sep, a + len(sep), b)
            end = b if end < 0 else end
            out += [(a, end)] if end - a < size else _pieces(text, a, end, size, level + 1)
        at = end
    return out


def recursive(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, str]]:
    """(start, piece): neighbouring ranges are joined while they fit into size; a piece begins with as many of the last
    one's ranges as fit into overlap. White space around a piece is left out; blank pieces are."""
    out: list[tuple[int, str]] = []

    def put(a: int, b: int) -> None:
        piece = text[a:b].strip()
        if piece:
            out.append((a + len(text[a:b]) - len(text[a:b].lstrip()), piece))

    held: list[tuple[int, int]] = []
    for a, b in _pieces(text, 0, len(text), size):
        if held and b - held[0][0] > size:
            put(held[0][0], held[-1][1])
            while held and (held[-1][1] - held[0][0] > overlap or b - held[0][0] > size):
                held.pop(0)
        held.append((a, b))
    if held:
        put(held[0][0], held[-1][1])
    return out


def recursive_udf(text: str, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "text": p} for a, p in recursive(t or "", size, overlap)])

    return F.pandas_udf(run, "array<struct<start: int, text: string>>")(text)


def page_spans(pages: DataFrame) -> DataFrame:
    """pages(document_id, page_number, text) with from and to in the document's text, pages joined by a blank line."""
    before = Window.partitionBy("document_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0))
    return pages.withColumn("from", start).withColumn("to", F.col("from") + F.length("text"))


def page_of(offset: Column, spans: str) -> Column:
    """The page whose span holds offset; one between pages belongs to the last page. spans: array of (from, to, page_number)."""
    held = F.try_element_at(F.filter(spans, lambda s: (s["from"] <= offset) & (offset <= s["to"])), F.lit(1))
    return F.coalesce(held["page_number"], F.try_element_at(spans, F.lit(-1))["page_number"])


def chunked(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """pages(document_id, page_number, text) -> (document_id, ordinal, page_number, text): the chunks of whole documents.

    Ordinals count short chunks too, which are left out. A document's text is one row, as its chunks may span pages."""
    rows = page_spans(pages.filter(F.trim("text") != "")).groupBy("document_id")
    spans = F.array_sort(F.collect_list(F.struct(F.col("from"), F.col("to"), "page_number", "text"))).alias("spans")
    whole = rows.agg(spans).withColumn("text", F.array_join(F.transform("spans", lambda s: s["text"]), "\n\n"))
    whole = whole.withColumn("spans", F.transform("spans", lambda s: s.dropFields("text")))
    found = whole.select("document_id", "spans", F.posexplode(recursive_udf("text", size, overlap)).alias("ordinal", "c"))
    found = found.filter(F.length("c.text") >= least)
    return found.select("document_id", "ordinal", page_of(F.col("c.start"), "spans").alias("page_number"), F.col("c.text").alias("text"))
