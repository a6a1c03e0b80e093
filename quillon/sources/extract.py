"""Backends that take a file's bytes apart, behind one schema, and the tables of pages, blocks and primitives they give.

A backend is a function of bytes. It returns pages (objects or dictionaries with the fields of PAGES); pages it can't
read carry an error. Raising an error rejects the file. Backends of whole elements, as of an OCR service, return pages
whose `elements` are filled."""

from __future__ import annotations

import shutil
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.sources import pdf

BOX = "x0: double, y0: double, x1: double, y1: double"
PAGES = f"array<struct<page_number: int, width: double, height: double, error: string, blocks: array<struct<{BOX}, text: string>>, primitives: array<struct<{BOX}, is_raster: boolean>>, elements: array<struct<kind: string, text: string, image_path: string, category: string>>>>"
#: Programs that an OCR backend calls.
OCR_PROGRAMS, PAGE_PROGRAMS = ("tesseract",), ("pdftoppm",)
BLOCK, PRIMITIVE = ("x0", "y0", "x1", "y1", "text"), ("x0", "y0", "x1", "y1", "is_raster")


class ExtractionError(RuntimeError):
    pass


def plain(content: bytes) -> list[dict]:
    """Plain text after the first line, a page at each form feed, a block for each paragraph."""
    out = []
    for number, text in enumerate(content.partition(b"\n")[2].decode("utf-8", "replace").split("\f"), 1):
        at, blocks = 40.0, []
        for part in text.split("\n\n"):
            high = 12.0 * (1 + part.count("\n"))
            blocks.append((50.0, at, 545.0, at + high, part))
            at += high + 12
        out.append({"page_number": number, "width": 595.0, "height": max(842.0, at + 40), "blocks": [b for b in blocks if b[4].strip()]})
    return out


def missing_programs(ocr: bool = True) -> list[str]:
    return [p for p in (*PAGE_PROGRAMS, *(OCR_PROGRAMS if ocr else ())) if not shutil.which(p)]


def as_dict(metadata) -> dict:
    """Whatever describes an element, as a dictionary."""
    if metadata is None:
        return {}
    if hasattr(metadata, "to_dict"):
        return dict(metadata.to_dict())
    return dict(metadata) if isinstance(metadata, dict) else {k: v for k, v in vars(metadata).items() if not k.startswith("_")} if hasattr(metadata, "__dict__") else {}


def layout_pages(raw: list) -> list[dict]:
    """Elements of a layout service (objects or dictionaries with category, text, metadata) as pages of elements.

    Tables prefer their HTML; what has neither text nor image goes; an element without a page number is on page 0."""
    pages: dict[int, list] = {}
    for x in raw:
        get = x.get if isinstance(x, dict) else lambda k, d=None, x=x: getattr(x, k, d)
        more, category = as_dict(get("metadata")), str(get("category") or get("type") or type(x).__name__)
        kind = {"Table": "table", "Image": "figure"}.get(category, "text")
        text = str((kind == "table" and more.get("text_as_html")) or get("text") or "").strip()
        page = more.get("page_number")
        if text or more.get("image_path"):
            pages.setdefault(page if isinstance(page, int) else 0, []).append((kind, text, more.get("image_path"), category))
    last = max(pages, default=0)
    return [{"page_number": n, "width": 0.0, "height": 0.0, "elements": pages.get(n, [])} for n in range(0 if 0 in pages else 1, last + 1)]


def layout(partition: Callable[[bytes], list], programs: bool = False, ocr: bool = True) -> Callable[[bytes], list[dict]]:
    """A backend around an OCR or layout service; programs: refuse to start without the programs it calls."""
    if programs and (missing := missing_programs(ocr)):
        raise ExtractionError("not on the path: " + ", ".join(missing))
    return lambda content: layout_pages(partition(content))


BACKENDS: dict[str, Callable] = {"pdf": pdf.read, "plain": plain}


def backend(name: str | None, default: str = "pdf") -> Callable:
    """A registered backend: the one named, else the default."""
    found = BACKENDS.get(name or default)
    if found is None:
        raise ExtractionError(f"no backend {name or default}; there are " + ", ".join(sorted(BACKENDS)))
    return found


def _row(page) -> dict:
    get = page.get if isinstance(page, dict) else lambda k, d=None: getattr(page, k, d)
    named = lambda names, rows: [dict(zip(names, r, strict=True)) for r in rows or []]
    return {"page_number": get("page_number"), "width": get("width"), "height": get("height"), "error": get("error"), "blocks": named(BLOCK, get("blocks")), "primitives": named(PRIMITIVE, get("primitives")), "elements": named(("kind", "text", "image_path", "category"), get("elements"))}


def extracted(files: DataFrame, read: Callable[[bytes], list]) -> DataFrame:
    """files(..., content) with pages (PAGES) and error in place of content. Only the content goes to Python."""

    def run(contents: pd.Series) -> pd.DataFrame:
        out = []
        for content in contents:
            try:
                out.append({"pages": [_row(p) for p in read(bytes(content))], "error": None})
            except Exception as error:
                out.append({"pages": [], "error": str(error) or type(error).__name__})
        return pd.DataFrame(out, columns=["pages", "error"])

    udf = F.pandas_udf(run, f"struct<pages: {PAGES}, error: string>")
    return files.withColumn("_x", udf("content")).drop("content").select(*(c for c in files.columns if c != "content"), "_x.*")


def pages_of(found: DataFrame) -> DataFrame:
    """extracted(document_id, pages) -> (document_id, page_number, width, height, error)."""
    return found.select("document_id", F.explode("pages").alias("p")).select("document_id", "p.page_number", "p.width", "p.height", "p.error")


def blocks_of(found: DataFrame) -> DataFrame:
    """-> (document_id, page_number, block_no, sides, text); blank blocks are left out."""
    rows = found.select("document_id", F.explode("pages").alias("p")).select("document_id", "p.page_number", F.posexplode("p.blocks").alias("block_no", "b"))
    return rows.select("document_id", "page_number", "block_no", "b.*").filter(F.regexp_replace("text", r"(?U)\s", "") != "")


def primitives_of(found: DataFrame) -> DataFrame:
    """-> (document_id, page_number, prim_no, sides, is_raster)."""
    rows = found.select("document_id", F.explode("pages").alias("p")).select("document_id", "p.page_number", F.posexplode("p.primitives").alias("prim_no", "b"))
    return rows.select("document_id", "page_number", "prim_no", "b.*")


def whole_elements_of(found: DataFrame) -> DataFrame:
    """-> (element_id, document_id, kind, page_number, text, image_path, category): elements that a backend gave as such."""
    rows = found.select("document_id", F.explode("pages").alias("p")).select("document_id", F.nullif("p.page_number", F.lit(0)).alias("page_number"), F.explode("p.elements").alias("e"))
    return rows.select("document_id", "page_number", "e.*")


def warnings_of(found: DataFrame) -> DataFrame:
    """-> (document_id, warnings): a line for each page that couldn't be read."""
    bad = pages_of(found).filter("error is not null")
    lines = F.array_sort(F.collect_list(F.struct("page_number", "error")))
    return bad.groupBy("document_id").agg(F.transform(lines, lambda x: F.concat(F.lit("page "), x["page_number"].cast("string"), F.lit(": "), x["error"])).alias("warnings"))
