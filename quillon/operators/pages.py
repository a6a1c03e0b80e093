"""From laid-out pages to elements: regions with their captions, body text in chunks, one plan for all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import boxes as B
from quillon.functions.text import strip
from quillon.operators import chunking, geometry
from quillon.operators.geometry import PAGE, SIDES
from quillon.operators.scratch import written

BOX = "struct<x0: double, y0: double, x1: double, y1: double>"
ELEMENT = ["element_id", "document_id", "kind", "page_number", "caption", "text", "box", "crop", "image_path"]


def page_regions(pages: DataFrame, blocks: DataFrame, prims: DataFrame, gap: float = 14.0, low: float = 0.012, high: float = 0.95) -> DataFrame:
    """(document_id, page_number, ordinal, kind, caption, sides): clusters of primitives, and tables that only a caption shows."""
    none = F.lit(None).cast("string")
    prims = prims.join(pages.select(*PAGE), PAGE, "left_semi")  # what lies on no page isn't clustered
    found = geometry.regions(geometry.cluster_boxes(prims, gap), pages, low, high)
    found = found.select(*PAGE, *SIDES, F.lit("figure").alias("kind"), none.alias("caption"), F.lit(False).alias("from_caption"))
    tables = geometry.free_tables(geometry.anchored_tables(blocks, pages), found)
    tables = tables.select(*PAGE, *SIDES, F.lit("table").alias("kind"), "caption", F.lit(True).alias("from_caption"))
    return geometry.bind_captions(found.unionByName(tables), blocks).drop("from_caption")


def crops(regions: DataFrame, pages: DataFrame, pad: float = geometry.PADDING) -> DataFrame:
    """regions with clip (the box grown and cut to the page) and crop (its file name); those that leave less than a point go."""
    page = pages.select(*PAGE, F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("width").alias("x1"), F.col("height").alias("y1")).alias("page"))
    rows = regions.join(page, PAGE).withColumn("box", F.struct(*SIDES)).withColumn("clip", B.clip("box", "page", pad))
    name = F.format_string("p%04d_%02d_%s.png", F.col("page_number").cast("int"), F.col("ordinal").cast("int"), "kind")
    return rows.filter((F.col("clip.x1") - F.col("clip.x0") >= 1) & (F.col("clip.y1") - F.col("clip.y0") >= 1)).withColumn("crop", name).drop("page")


def visuals(regions: DataFrame, pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """An element for each region; its text is that of the blocks that lie in its clip, from the top on."""
    rows = crops(regions, pages)
    inside = geometry.named(blocks, "b_", "block_no", "text").join(rows.select(*PAGE, "ordinal", *(F.col(f"clip.{s}").alias(f"k_{s}") for s in SIDES)), PAGE)
    inside = inside.filter(B.encloses("k_", "b_"))
    parts = F.array_sort(F.collect_list(F.struct("b_y0", "b_x0", "b_block_no", strip(F.col("b_text")).alias("text"))))
    held = inside.groupBy(*PAGE, "ordinal").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"))
    name = F.format_string("%s:p%d:%s:%d", "document_id", F.col("page_number").cast("int"), "kind", F.col("ordinal").cast("int"))
    rows = rows.join(held, [*PAGE, "ordinal"], "left")
    return rows.select(name.alias("element_id"), "document_id", "kind", F.col("page_number").cast("long").alias("page_number"), "caption", F.coalesce("text", F.lit("")).alias("text"), "box", "crop", F.lit(None).cast("string").alias("image_path"))


def texts(bodies: DataFrame, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP, least: int = chunking.LEAST) -> DataFrame:
    """bodies(document_id, page_number, body) -> text elements."""
    rows = chunking.chunked(bodies.select(*PAGE, F.col("body").alias("text")), size, overlap, least)
    none = F.lit(None).cast("string")
    return rows.select(F.concat_ws(":", "document_id", F.lit("text"), "ordinal").alias("element_id"), "document_id", F.lit("text").alias("kind"), F.col("page_number").cast("long").alias("page_number"), none.alias("caption"), "text", F.lit(None).cast(BOX).alias("box"), none.alias("crop"), none.alias("image_path"))


def whole(elements: DataFrame) -> DataFrame:
    """Elements that a backend gave as such, numbered in their document."""
    place = F.row_number().over(Window.partitionBy("document_id").orderBy(F.col("page_number").asc_nulls_first(), F.monotonically_increasing_id())) - 1
    rows = elements.withColumn("ordinal", place)
    none = F.lit(None).cast("string")
    return rows.select(F.concat_ws(":", "document_id", "kind", "ordinal").alias("element_id"), "document_id", "kind", F.col("page_number").cast("long").alias("page_number"), none.alias("caption"), "text", F.lit(None).cast(BOX).alias("box"), none.alias("crop"), "image_path")


def elements(pages: DataFrame, blocks: DataFrame, prims: DataFrame, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP, least: int = chunking.LEAST, gap: float = 14.0, low: float = 0.012, high: float = 0.95) -> DataFrame:
    """Text elements, then visual ones, of all pages."""
    regions = written(page_regions(pages, blocks, prims, gap, low, high), "regions")
    bodies = geometry.body_text(blocks, pages, regions)
    return texts(bodies, size, overlap, least).unionByName(visuals(regions, pages, blocks))
