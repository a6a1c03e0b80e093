"""Page geometry: clustering of boxes, regions, caption binding, caption-anchored tables, columns, reading order, body text.

Rows of blocks are (document_id, page_number, block_no, x0, y0, x1, y1, text), of primitives (..., prim_no, sides,
is_raster), of pages (document_id, page_number, width, height). A page is a bounded group: what needs an order of
choices is a fold over it, everything else is joins and windows on (document_id, page_number)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import boxes as B
from quillon.functions.text import caption_kind, normalize_ws, strip

PAGE = ["document_id", "page_number"]
SIDES = list(B.NAMES)
# Fixed values, in points or as shares: how far a caption may be, the least primitive and region, what ends a table's
# rows, the gutter's half width, how many blocks may cross it, what counts as enclosed.
REACH, THIN, LEAST_WIDTH, LEAST_HEIGHT = 72.0, 3.0, 60.0, 40.0
ROW_GAP, ONE_ROW_GAP, ABOVE = 18.0, 24.0, 2.0
GUTTER, CROSSING, ENCLOSED, PADDING = 0.04, 0.2, 0.7, 8.0


def named(df: DataFrame, prefix: str, *more: str) -> DataFrame:
    """The page, and sides and more columns of df with a prefix to their names."""
    return df.select(*PAGE, *(F.col(c).alias(f"{prefix}{c}") for c in [*SIDES, *more]))


def caption_of(text: Column) -> Column:
    """The kind that a block names as its caption, or null; its white space is evened out first."""
    return caption_kind(normalize_ws(text))


def meaningful(prims: DataFrame) -> DataFrame:
    """Primitives that are no rules or hairlines."""
    return prims.filter((B.width() >= THIN) & (B.height() >= THIN))


def merge_boxes(boxes: list[list], gap: float) -> list[list]:
    """[x0, y0, x1, y1, primitives, raster]: merge clusters whose bounding boxes come within gap, until none do."""
    out: list[list] = []
    for box in sorted(map(list, boxes)):
        grown = True
        while grown:
            grown = False
            for other in out:
                if box[2] + gap >= other[0] and other[2] + gap >= box[0] and box[3] + gap >= other[1] and other[3] + gap >= box[1]:
                    out.remove(other)
                    box = [min(box[0], other[0]), min(box[1], other[1]), max(box[2], other[2]), max(box[3], other[3]), box[4] + other[4], box[5] or other[5]]
                    grown = True
                    break
        out.append(box)
    return sorted(out, key=lambda b: (b[1], b[0], b))


def cluster_boxes(prims: DataFrame, gap: float = 14.0) -> DataFrame:
    """Clusters of each page's meaningful primitives."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        boxes = [[*b, 1, bool(r)] for *b, r in pdf[["x0", "y0", "x1", "y1", "is_raster"]].itertuples(index=False)]
        out = pd.DataFrame(merge_boxes(boxes, gap), columns=["x0", "y0", "x1", "y1", "primitive_count", "has_raster"])
        return out.assign(document_id=pdf.document_id.iloc[0], page_number=pdf.page_number.iloc[0])

    kind = prims.schema["document_id"].dataType.simpleString()
    return meaningful(prims).groupBy(*PAGE).applyInPandas(run, f"x0 double, y0 double, x1 double, y1 double, primitive_count long, has_raster boolean, document_id {kind}, page_number long")


def regions(clusters: DataFrame, pages: DataFrame, low: float = 0.012, high: float = 0.95) -> DataFrame:
    """Clusters large enough to show, not the whole page, and of at least 3 primitives if nothing in them is raster."""
    page = pages.select(*PAGE, (F.col("width") * F.col("height")).alias("_page_area")).filter("_page_area > 0")
    ratio = B.area() / F.col("_page_area")
    large = (B.width() >= LEAST_WIDTH) & (B.height() >= LEAST_HEIGHT) & ratio.between(low, high)
    return clusters.join(page, PAGE).filter(large & (F.col("has_raster") | (F.col("primitive_count") >= 3))).drop("_page_area")


def intersecting(a: DataFrame, b: DataFrame, gap: float = 0.0, strip_height: float = 64.0) -> DataFrame:
    """Pairs of rows of a page whose boxes come within gap, columns with prefixes a_ and b_. Boxes meet in the horizontal
    strips that they reach, each pair once, in the first strip of both."""

    def dealt(df: DataFrame, prefix: str, above: float) -> DataFrame:
        rows = named(df, prefix, *(c for c in df.columns if c not in [*PAGE, *SIDES]))
        low, high = (F.floor((F.col(f"{prefix}{s}") + d) / strip_height) for s, d in (("y0", -above), ("y1", above)))
        return rows.withColumn(f"{prefix}low", low).withColumn("_strip", F.explode(F.sequence(low, F.greatest(low, high))))

    pairs = dealt(a, "a_", gap).join(dealt(b, "b_", 0.0), [*PAGE, "_strip"])
    return pairs.filter(B.intersects("a_", "b_", gap) & (F.col("_strip") == F.greatest("a_low", "b_low"))).drop("_strip", "a_low", "b_low")


def caption_candidates(regions_: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """Pairs of a region (column key) and a caption block within reach: key, block_no, away (points), caption, caption_kind."""
    captions = named(blocks.withColumn("caption_kind", caption_of(F.col("text"))).filter("caption_kind is not null"), "c_", "block_no", "text", "caption_kind")
    both = named(regions_, "r_", key).join(captions, PAGE).withColumn("away", B.distance("r_", "c_"))
    both = both.filter(B.aligned("r_", "c_") & (F.col("away") < REACH))
    return both.select(*PAGE, F.col(f"r_{key}").alias(key), F.col("c_block_no").alias("block_no"), "away", normalize_ws(F.col("c_text")).alias("caption"), F.col("c_caption_kind").alias("caption_kind"))


def bind_captions(regions_: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each region, in (y0, x0) order, takes the nearest caption that none before it took; it decides the region's kind.

    regions_ has caption and kind already, which stay where no caption is near; of equally near captions the first in the
    page's order of blocks is taken. Candidates are a join, the choice a fold over a page's candidates."""
    names = [c for c in regions_.columns if c != "ordinal"]
    place = F.row_number().over(Window.partitionBy(*PAGE).orderBy("y0", "x0", *(c for c in ("from_caption", "x1", "y1") if c in names))) - 1
    rows = regions_.select(*names).withColumn("ordinal", place.cast("long"))
    found = caption_candidates(rows, blocks, "ordinal")
    order = F.struct("ordinal", "away", "block_no", "caption", "caption_kind")
    start = F.expr("named_struct('used', cast(array() as array<bigint>), 'last', -1L, 'taken', cast(array() as array<struct<ordinal:bigint,caption:string,caption_kind:string>>))")

    def step(acc, x):
        one = F.struct(x["ordinal"].alias("ordinal"), x["caption"].alias("caption"), x["caption_kind"].alias("caption_kind"))
        take = F.struct(F.concat(acc["used"], F.array(x["block_no"].cast("long"))).alias("used"), x["ordinal"].alias("last"), F.concat(acc["taken"], F.array(one)).alias("taken"))
        return F.when((x["ordinal"] > acc["last"]) & ~F.array_contains(acc["used"], x["block_no"].cast("long")), take).otherwise(acc)

    chosen = found.groupBy(*PAGE).agg(F.aggregate(F.array_sort(F.collect_list(order)), start, step)["taken"].alias("taken"))
    chosen = chosen.select(*PAGE, F.inline("taken")).select(*PAGE, "ordinal", F.col("caption").alias("_caption"), "caption_kind")
    out = rows.join(chosen, [*PAGE, "ordinal"], "left")
    return out.withColumns({"caption": F.coalesce("_caption", "caption"), "kind": F.coalesce("caption_kind", "kind")}).select(*names, "ordinal")


def anchored_tables(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Tables without rules: a table caption and the run of aligned blocks under it, up to the first large gap or caption.

    Columns: the caption's block_no (cap), its text, the sides cut to the page, and the number of rows."""
    ranked = blocks.withColumns({"_kind": caption_of(F.col("text")), "_n": F.row_number().over(Window.partitionBy(*PAGE).orderBy("y0", "x0", "block_no"))})
    caps = named(ranked.filter("_kind = 'table'"), "c_", "block_no", "_n", "text")
    under = named(ranked, "b_", "_n", "_kind").join(caps, PAGE)
    under = under.filter((F.col("b__n") > F.col("c__n")) & (F.col("b_y0") >= F.col("c_y1") - ABOVE) & B.aligned("c_", "b_"))
    key = [*PAGE, "c_block_no"]
    order = Window.partitionBy(*key).orderBy("b__n")
    under = under.withColumns({"n": F.row_number().over(order), "gap": F.col("b_y0") - F.lag("b_y1").over(order)})
    middle = F.percentile("gap", 0.5).over(Window.partitionBy(*key))
    under = under.withColumn("limit", F.coalesce(F.greatest(2 * middle, F.lit(ROW_GAP)), F.lit(ONE_ROW_GAP)))
    stops = F.when((F.col("n") > 1) & ((F.col("gap") > F.col("limit")) | F.col("b__kind").isNotNull()), 1).otherwise(0)
    under = under.withColumn("stop", stops).withColumn("stopped", F.max("stop").over(order))
    found = under.filter("stopped = 0").groupBy(*key).agg(*(f(f"b_{c}").alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))), F.count("*").alias("n_rows"))
    found = found.join(caps.select(*key, *(f"c_{s}" for s in SIDES), "c_text"), key).join(pages.select(*PAGE, "width", "height"), PAGE)
    whole = {"x0": F.greatest(F.least("x0", "c_x0"), F.lit(0.0)), "y0": F.greatest(F.least("y0", "c_y0"), F.lit(0.0)), "x1": F.least(F.greatest("x1", "c_x1"), "width"), "y1": F.least(F.greatest("y1", "c_y1"), "height")}
    found = found.withColumns(whole).filter((B.width() >= LEAST_WIDTH) & (B.height() >= LEAST_HEIGHT))
    return found.select(*PAGE, F.col("c_block_no").alias("cap"), *SIDES, normalize_ws(F.col("c_text")).alias("caption"), "n_rows")


def free_tables(tables: DataFrame, regions_: DataFrame) -> DataFrame:
    """Tables that touch no region, nor a table accepted before them (from the top of the page on)."""
    r = named(regions_, "r_")
    t = tables.select(*PAGE, *(F.col(c).alias(f"t_{c}") for c in tables.columns if c not in PAGE))
    alone = t.join(r, [*(t[k] == r[k] for k in PAGE), B.intersects("t_", "r_")], "left_anti")
    rest = [c for c in tables.columns if c not in PAGE]
    one = F.struct(*(F.col(f"t_{c}").alias(c) for c in ["y0", "x0", "cap", *(c for c in rest if c not in ("y0", "x0", "cap"))]))
    rows = alone.groupBy(*PAGE).agg(F.array_sort(F.collect_list(one)).alias("all"))

    def touches(a, b):
        return (a["x1"] >= b["x0"]) & (b["x1"] >= a["x0"]) & (a["y1"] >= b["y0"]) & (b["y1"] >= a["y0"])

    kept = F.aggregate("all", F.slice("all", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda y: touches(x, y)), acc).otherwise(F.concat(acc, F.array(x))))
    return rows.select(*PAGE, F.inline(kept)).select(*tables.columns)


def columns(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Per page whether its blocks stand in two columns."""
    rows = blocks.join(pages.select(*PAGE, "width"), PAGE)
    c, t = F.col("width") / 2, GUTTER * F.col("width")
    across = (F.col("x0") < c - t) & (F.col("x1") > c + t)
    left = ~across & (F.col("x1") <= c + t)
    counts = rows.groupBy(*PAGE, "width").agg(F.count("*").alias("n"), F.count_if(across).alias("across"), F.count_if(left).alias("left"), F.count_if(~across & ~left).alias("right"))
    return counts.withColumn("two", (F.col("n") >= 6) & (F.col("left") >= 2) & (F.col("right") >= 2) & (F.col("across") <= CROSSING * F.col("n")))


def reading_order(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks with ord: where a page has two columns, the right one (what begins right of the gutter's left edge) last."""
    rows = blocks.join(columns(blocks, pages).select(*PAGE, "two", "width"), PAGE)
    right = (F.col("two") & (F.col("x0") >= F.col("width") / 2 - GUTTER * F.col("width"))).cast("int")
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy(*PAGE).orderBy(right, "y0", "x0", "block_no"))).drop("two", "width")


def outside(blocks: DataFrame, regions_: DataFrame) -> DataFrame:
    """Blocks that no region encloses."""
    b = blocks.select(*PAGE, *(F.col(c).alias(f"b_{c}") for c in blocks.columns if c not in PAGE))
    r = named(regions_, "r_")
    rest = b.join(r, [*(b[k] == r[k] for k in PAGE), B.encloses("r_", "b_")], "left_anti")
    return rest.select(*(F.col(c if c in PAGE else f"b_{c}").alias(c) for c in blocks.columns))


def body_text(blocks: DataFrame, pages: DataFrame, regions_: DataFrame | None = None) -> DataFrame:
    """Page text in reading order, blank lines between, without captions and blocks that lie in a region."""
    rest = blocks.filter(caption_of(F.col("text")).isNull() & (strip(F.col("text")) != ""))
    rest = reading_order(outside(rest, regions_) if regions_ is not None else rest, pages)
    parts = F.array_sort(F.collect_list(F.struct("ord", strip(F.col("text")).alias("text"))))
    return rest.groupBy(*PAGE).agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("body"))
