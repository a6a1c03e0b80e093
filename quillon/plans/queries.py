"""Queries over the driver's tables for the operators of this library, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from quillon.functions import boxes as B
from quillon.functions import text as T
from quillon.operators import chunking, context, enrich, geometry, pages, retrieval, scratch, store
from quillon.plans import views as V
from quillon.service.engine import report_rows, source_rows
from quillon.sources import files

c = F.col
STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"


def _tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '{T.TOKEN}'), lambda t: length(t) > 1 AND NOT list_contains({STOP}, t))"


def _refs(x: str) -> str:
    pattern = "(?i)" + T.REFERENCE
    one, two = (f"regexp_extract_all({x}, '{pattern}', {g})" for g in (1, 2))
    return f"list_distinct(list_transform(list_zip({one}, {two}), lambda p: (CASE WHEN lower(p[1]) LIKE 'fig%' THEN 'fig' ELSE lower(p[1]) END) || ':' || lower(ltrim(p[2], '.'))))"


def _embed(x: str) -> str:
    raw = f"list_transform(range(32), lambda i: ('0x' || substr(sha256({x}), CAST(2 * i + 1 AS INT), 2))::INT / 255.0::DOUBLE)"
    return f"(SELECT list_transform(r, lambda v: v / sqrt(list_sum(list_transform(r, lambda w: w * w)))) FROM (SELECT {raw} AS r))"


CONTENT = "concat_ws(chr(10), '[page ' || page_number || ']', nullif(trim(caption, ' ' || chr(10)), ''), coalesce(nullif(trim(summary, ' ' || chr(10)), ''), nullif(trim(text, ' ' || chr(10)), '')))"
E_ = f"e AS ({V.ELEMENTS})"
CAP = "regexp_extract({0}, '(?i)" + T.CAPTION + "', 1)"
DENSE = f"""
{E_}, v AS (SELECT *, {CONTENT} AS content FROM e), w AS (SELECT *, {_embed('content')} AS emb FROM v),
q AS (SELECT *, {_embed('question')} AS qe FROM ({V.QUESTIONS})),
d AS (SELECT qid, question, element_id, document_id, kind, content, page_number, caption, text, summary, round(list_dot_product(emb, qe), 9) AS dense FROM w, q),
p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dense DESC, element_id) AS pos FROM d QUALIFY pos <= 24)
"""
LEX = f"""{DENSE},
t AS (SELECT *, list_distinct({_tokens('question')}) AS qt, list_distinct({_tokens('content')}) AS ct, {_refs('question')} AS qr, {_refs('content')} AS cr FROM p),
df AS (SELECT qid, term, count(*) AS n FROM (SELECT qid, unnest(list_intersect(qt, ct)) AS term FROM t) GROUP BY ALL),
s AS (SELECT qid, pos, sum(ln(1 + m / (1.0 + n))) AS total FROM (SELECT qid, pos, unnest(list_intersect(qt, ct)) AS term FROM t) JOIN df USING (qid, term) JOIN (SELECT qid, count(*) AS m FROM t GROUP BY qid) USING (qid) GROUP BY ALL),
r AS (SELECT t.*, CASE WHEN len(qt) > 0 OR len(qr) > 0 THEN coalesce(total, 0) / sqrt(1 + len(ct)) + CASE WHEN list_has_any(qr, cr) THEN 1 ELSE 0 END ELSE 0 END AS raw FROM t LEFT JOIN s USING (qid, pos)),
l AS (SELECT *, min(raw) OVER (PARTITION BY qid) AS lo, max(raw) OVER (PARTITION BY qid) AS hi FROM r),
b AS (SELECT *, CASE WHEN hi - lo < 1e-9 THEN CASE WHEN hi > 0 THEN 1.0 ELSE 0.0 END ELSE (raw - lo) / (hi - lo) END AS lexical FROM l),
h AS (SELECT *, round(0.65 * least(greatest(dense, 0), 1) + 0.35 * lexical, 9) AS blend FROM b),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY blend DESC, pos) AS rank FROM h QUALIFY rank <= 6)
"""
SEARCH = f"""{LEX},
asked AS (SELECT qid, unnest({_refs('question')}) AS ref FROM q),
named AS (SELECT element_id, kind, document_id, page_number, caption, text, summary, unnest({_refs('caption')}) AS ref FROM e WHERE caption IS NOT NULL),
more AS (SELECT DISTINCT qid, element_id, kind, document_id, page_number, caption, text, summary FROM named JOIN asked USING (ref) WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.qid = asked.qid AND k.element_id = named.element_id)),
u AS (SELECT qid, rank, element_id, kind, document_id, dense AS score, page_number, caption, text, summary FROM k UNION ALL SELECT qid, 0, element_id, kind, document_id, NULL, page_number, caption, text, summary FROM more),
z AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank, element_id) AS place FROM u QUALIFY place <= 6)
"""

def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def _dense(spark, d):
    return retrieval.candidates(V.vectors(spark, d), V.questions(spark, d), 24)


def _narrow(df, *more):
    """Sides and page of df, with columns that name its rows."""
    return df.select("page_number", *more, *B.NAMES)


def _store(spark, d):
    """A store of the view's documents and elements, in the shared folder."""
    out = store.Store(spark, f"{scratch.folder(spark)}/store-{uuid.uuid4().hex}")
    e = V.elements(spark, d).filter("document_id is not null").select("element_id", "document_id", "kind", "text", "summary", "page_number", "caption", F.lit(None).cast("string").alias("image_path"))
    out.add(V.documents(spark, d), e)
    return out


# -- files and scalars


def scanned(spark, d):
    """Documents as if they were files, some of another suffix, without the header, or too large."""
    text = F.concat(F.when(c("doc_id") % 4 == 1, "").otherwise("%PDF-1.4 "), c("text"))
    path = F.concat(F.lit("file:/in/d"), c("doc_id").cast("string"), F.when(c("doc_id") % 5 == 2, ".txt").when(c("doc_id") % 5 == 3, ".PDF").otherwise(".pdf"))
    rows = _docs(spark, d).select(path.alias("path"), F.encode(text, "utf-8").alias("content"), F.current_timestamp().alias("modificationTime"))
    return files.checked(rows.withColumn("length", F.octet_length("content").cast("long")), 4000).drop("modification_time")


def vector_topk(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(c("vec_id").cast("string").alias("element_id"), c("label").cast("string").alias("document_id"), F.lit("text").alias("kind"), c("embedding").cast("array<double>").alias("embedding"))
    q = e.filter("try_cast(element_id as bigint) % 100 = 0").select(c("element_id").cast("long").alias("qid"), c("embedding").alias("q_embedding"), F.array("document_id").alias("document_ids"), F.expr("cast(array() as array<string>)").alias("kinds"))
    return retrieval.dense_topk(e, q, 5).select("qid", c("pos").cast("long").alias("pos"), "element_id", F.round("dense", 6).alias("dense"))


def caption_kinds(spark, d):
    e = V.elements(spark, d)
    return e.select("element_id", T.caption_kind(c("caption")).alias("caption_kind"), F.coalesce(F.array_join(F.array_sort(T.references(c("caption"))), ","), F.lit("")).alias("refs"))


def _nth(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))


#: Replies, and what they are split into: sections in order at the start, in capitals, or nothing but a summary.
REPLIES = ["TABLE:\n| a | b |\n| 1 | 2 |\nSUMMARY: two  ", "  TABLE: SUMMARY: none", "The table: see left. In summary: all is well.", "table:\n| a |\nsummary: x", "Note. TABLE: | a | SUMMARY: x", "TABLE: | a |\n\nSUMMARY: one\nSUMMARY: two"]
TABLES = ["intro\n| a | b |\nnote\n  | c | d |\nafter", "| one |", "no bars here", "x | y\n| z |\n| w |", "| a |\r\n| b |", ""]


def table_texts(spark, d):
    n = c("doc_id") % 6
    two = T.split_table_reply(_nth(REPLIES, n))
    kind = F.when(c("doc_id") % 7 == 0, "text").otherwise("table")
    return _docs(spark, d).select("doc_id", two["table"].alias("tbl"), two["summary"].alias("summary"), T.table_markdown(kind, _nth(TABLES, n)).alias("markdown"))


#: Messages of model providers, the status that came with them, and their class.
MESSAGES = [("Rate limit reached, try again in 1500ms please", 429, "transient"), ("Too many images in the request", 400, "image_limit"), ("This model supports up to 3 images", None, "image_limit"), ("Request too large for the model", 413, "too_large"), ("Please reduce your message size", None, "too_large"), ("too many tokens", 400, "too_large"), ("bad key id 85021", 401, "fatal"), ("internal error", 503, "transient"), ("the read timed out; Try Again In 2.5 s", None, "transient"), ("item 429 of 500 is broken", None, "fatal"), ("try again in 3 sessions", None, "fatal")]
WAITS = [1.5, None, None, None, None, None, None, None, 2.5, None, None]


def errors(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    n = (c("event_id") % len(MESSAGES)).cast("int")
    status = F.element_at(F.array(*(F.lit(s).cast("int") for _, s, _ in MESSAGES)), n + 1)
    message, header = _nth([m for m, _, _ in MESSAGES], n), F.when(c("event_id") % 5 == 0, "7").when(c("event_id") % 5 == 1, "soon")
    return e.select("event_id", T.retry_after(message, header).alias("wait"), T.error_class(message, status).alias("error_class"))


def metadata(spark, d):
    m = F.create_map(F.lit("source"), F.concat(F.lit("  "), c("source"), F.lit(" ")), F.lit(""), F.lit("x"), F.lit("blank"), F.lit("  "), F.lit("long"), c("text"))
    rows = _docs(spark, d).withColumn("m", T.clean_metadata(m))
    rows = rows.withColumn("r", F.struct(c("doc_id").alias("n"), (c("doc_id") / 4).alias("half"), (c("doc_id") % 2 == 0).alias("even"), F.array("doc_id", c("doc_id") + 1).alias("list"), F.lit(" ").alias("blank"), F.struct(c("source").alias("s")).alias("sub")))
    record = T.clean_record("r", rows.schema["r"].dataType)
    return rows.select("doc_id", c("m")["source"].alias("source"), F.size("m").cast("long").alias("n"), F.length(c("m")["long"]).cast("long").alias("n_long"), record.alias("record"))


def boxes_as_json(spark, d):
    """Boxes and extras through JSON, some of it broken."""
    text = F.to_json(F.struct(*B.NAMES))
    broken = F.when(c("prim_no") % 5 == 1, F.lit('{"x0": 1')).when(c("prim_no") % 5 == 2, F.lit('{"x0": 1.0}')).otherwise(text)
    extra = F.when(c("prim_no") % 5 == 1, F.lit("[1")).otherwise(F.to_json(F.create_map(F.lit("n"), c("prim_no").cast("string"))))
    rows = V.prims(spark, d).select("prim_no", T.decode_box(broken).alias("b"), T.decode_extra(extra).alias("e"), T.as_int(F.when(c("prim_no") % 5 == 3, "x").otherwise(c("prim_no").cast("string"))).cast("long").alias("n"))
    return rows.select("prim_no", c("b.x0").alias("x0"), c("b.y1").alias("y1"), F.try_element_at("e", F.lit("n")).alias("extra"), F.coalesce("n", F.lit(-1)).cast("long").alias("n"))


def scalar_kit(spark, d):
    """Progress, sizes of images, data URLs, message texts, prompts, fingerprints."""
    p = V.prims(spark, d)
    w, h = (c("prim_no") % 3000).cast("int"), (c("prim_no") % 1700).cast("int")
    size = T.fitted_size(w, h, 900)
    path = F.concat(F.lit("a/b."), _nth(["png", "JPG", "x", "webp"], c("prim_no") % 4))
    parts = F.array(F.struct(F.lit("text").alias("type"), F.lit(" one").alias("text")), F.struct(F.lit("image").alias("type"), F.lit("no").alias("text")), F.struct(F.lit("text").alias("type"), F.when(c("prim_no") % 2 == 0, "two").alias("text")))
    return p.select("prim_no", T.percent(c("prim_no") % 7, c("prim_no") % 5).cast("long").alias("percent"), size["width"].cast("long").alias("width"), size["height"].cast("long").alias("height"), T.data_url(F.encode(c("prim_no").cast("string"), "utf-8"), path).alias("url"), T.message_text(parts).alias("reply"), T.fingerprint(F.lit("p"), c("prim_no").cast("string")).alias("space"), F.length(T.prompt_for(_nth(["text", "table", "figure"], c("prim_no") % 3), F.lit("abc"))).cast("long").alias("n_prompt"))


# -- retrieval


def dense_filtered(spark, d):
    q = V.questions(spark, d).withColumns({"document_ids": F.array(F.concat(F.lit("src"), (c("qid") % 20).cast("string")), F.lit("src1")), "kinds": F.when(c("qid") % 3 == 0, F.array(F.lit("table"), F.lit("figure"))).otherwise(F.expr("cast(array() as array<string>)"))})
    return retrieval.dense_topk(V.vectors(spark, d), q, 5).select("qid", c("pos").cast("long").alias("pos"), "element_id", F.round("dense", 6).alias("dense"))


def search(spark, d):
    out = retrieval.search(V.vectors(spark, d), V.elements(spark, d), V.questions(spark, d))
    return out.select("qid", c("rank").cast("long").alias("rank"), "element_id", "document_id", "kind", F.round("score", 6).alias("score"), "page_number", "caption", "text")


def hydrate(spark, d):
    e = V.elements(spark, d)
    hits = e.select("element_id", "kind", F.concat(F.lit("indexed "), c("element_id")).alias("content"))
    stored = e.filter("doc_id % 11 <> 3").withColumns({"text": F.when(c("doc_id") % 4 == 1, "").otherwise(c("text")), "summary": F.concat(F.lit("s "), c("element_id"))})
    return retrieval.hydrated(hits, stored).select("element_id", "caption", F.sha2("text", 256).alias("text"))


def scaled(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_type", "event_id", F.when(c("event_type") == "click", 3.0).otherwise(c("value")).alias("value"))
    return e.select("event_id", F.round(retrieval.minmax("value", Window.partitionBy("event_type")), 9).alias("scaled"))


def promote(spark, d):
    """Made-up hits for every second question: the first three elements of its document."""
    e, q = V.elements(spark, d), V.questions(spark, d)
    hits = q.filter("qid % 2 = 0").select("qid").join(e.filter("doc_id < 3"), F.lit(True)).select("qid", (c("doc_id") + 1).cast("int").alias("rank"), "element_id", "document_id", "kind", F.lit(0.5).alias("score"), F.lit("").alias("content"))
    return retrieval.promoted(hits, e, q, 4).select("qid", c("rank").cast("long").alias("rank"), "element_id", "score")


SOURCES = [f"src{i}" for i in range(1, 15)]


def by_caption(spark, d):
    asked = V.questions(spark, d).select("qid", F.array(*map(F.lit, SOURCES)).alias("document_ids"), T.references(c("question")).alias("refs"))
    return retrieval.by_reference(V.elements(spark, d), asked).select("qid", "element_id")


def contexts(spark, d):
    image = F.when(c("kind") != "text", F.concat(c("element_id"), F.lit(".png")))
    found = context.contexts(search(spark, d).withColumn("image_path", image), 2000)
    out = context.prompts(found, V.questions(spark, d)).join(found.select("qid", "n_blocks", "labels"), "qid")
    return out.withColumns({"images": F.array_join("images", ","), "labels": F.array_join("labels", ",")})


def sources(spark, d):
    image = F.when(c("kind") != "text", F.concat(c("element_id"), F.lit(".png")))
    return source_rows(search(spark, d).withColumn("image_path", image)).select("qid", "label", "element_id", "image_url", "table_markdown")


# -- the store


def upsert_documents(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(c("o_orderkey").alias("id"), c("o_orderstatus").alias("status"), c("o_totalprice").alias("price"), c("o_orderdate").alias("created_at"))
    new = o.filter("id % 3 = 0").select((c("id") + 3000).alias("id"), F.lit("new").alias("status"), (c("price") + 1).alias("price"), c("created_at"))
    return store.upsert(o, new, "id", ["status", "price"])


def upsert_elements(spark, d):
    """Elements of three documents, written again with other texts and kinds, and new ones."""
    s = _store(spark, d)
    e = s.table("elements")
    again = e.filter("document_id in ('src1', 'src2', 'src3')").select(*(F.when(F.length("element_id") % 2 == 0, F.concat(c("element_id"), F.lit("+"))).otherwise(c("element_id")).alias(x) if x == "element_id" else F.lit("again").alias(x) if x in ("text", "kind", "caption") else c(x) for x in e.columns))
    s.add(s.table("documents").filter("document_id in ('src1', 'src2', 'src3')").withColumn("created_at", F.lit(-1).cast("long")), again)
    return s.table("elements").select("element_id", "document_id", "kind", F.sha2("text", 256).alias("text"), "caption", "page_number").join(s.table("documents").select("document_id", "created_at"), "document_id")


def deleted(spark, d):
    s = _store(spark, d)
    gone = s.delete("src5")
    left = s.table("documents").join(s.table("elements").groupBy("document_id").agg(F.count("*").alias("left_over")), "document_id", "left")
    return left.select("document_id", "left_over", F.lit(gone).cast("long").alias("gone"))


def looked_up(spark, d):
    return _store(spark, d).get_elements(["src1:e:1", "src7:e:7", "src2:e:2", "missing"]).select("element_id", "kind", "page_number")


def there(spark, d):
    s = _store(spark, d)
    return spark.createDataFrame([(s.has_document("src3"), s.has_document("none"), s.count_elements(), s.count_elements("src4"), s.count_elements("none"))], "there boolean, not_there boolean, n long, n_src4 long, n_none long")


def missing_documents(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", c("o_custkey").alias("document_id"))
    return store.orphans(o, spark.read.parquet(f"{d}/customer.parquet").select((c("c_custkey") + 10).alias("document_id"))).select("o_orderkey")


def ingest_reports(spark, d):
    e = V.elements(spark, d).filter("document_id is not null and document_id <> 'src6'")
    warnings = V.documents(spark, d).filter("pages % 2 = 0").select("document_id", F.array(F.concat(F.lit("page 1: "), c("filename"))).alias("warnings"))
    return report_rows(V.documents(spark, d), e, warnings).withColumn("warnings", F.array_join("warnings", ";"))


# -- geometry


def box_intersect_join(spark, d):
    p = _narrow(geometry.meaningful(V.prims(spark, d)), "document_id", "prim_no")
    return geometry.intersecting(p, p, 2.0).filter("a_prim_no < b_prim_no").groupBy("page_number").agg(F.count("*").alias("n_pairs"))


def box_kit(spark, d):
    """Each figure and the next one of its page: the functions over boxes."""
    f = V.figures(spark, d).filter("page_number <= 400")
    after = Window.partitionBy("page_number").orderBy("box_no", *B.NAMES)
    rows = f.select("box_no", F.struct(*B.NAMES).alias("a"), F.lead(F.struct(*B.NAMES)).over(after).alias("b")).filter("b is not null")
    both = B.merged("a", "b")
    return rows.select("box_no", F.round(B.area("a"), 6).alias("area"), F.round(B.overlap("a", "b"), 6).alias("overlap"), B.aligned("a", "b").alias("aligned"), B.distance("a", "b").alias("distance"), B.encloses("a", "b", 0.3).alias("encloses"), F.round(both["x1"] - both["x0"], 6).alias("both_width"), B.expanded("a", 2.0)["y0"].alias("grown"))


def region_filter(spark, d):
    found = geometry.regions(V.figures(spark, d), V.pages(spark, d).withColumn("height", F.lit(842.0)))
    return found.select("page_number", "box_no", "x1", "y1")


def enclosed(spark, d):
    return geometry.outside(V.blocks(spark, d), V.figures(spark, d)).select("page_number", "block_no")


def near_captions(spark, d):
    f = V.figures(spark, d).withColumn("box_no", c("box_no").cast("long"))
    return geometry.caption_candidates(f, V.blocks(spark, d), "box_no").select("page_number", "box_no", "block_no", "away", "caption_kind")


def bound(spark, d):
    none = F.lit(None).cast("string")
    boxes = V.figures(spark, d).select("document_id", "page_number", *B.NAMES, none.alias("caption"), F.lit("figure").alias("kind"), F.lit(False).alias("from_caption"))
    return geometry.bind_captions(boxes, V.blocks(spark, d)).select("page_number", "ordinal", "x0", "y0", "kind", "caption")


def anchored(spark, d):
    return geometry.anchored_tables(V.blocks(spark, d), V.pages(spark, d)).select("page_number", "cap", *B.NAMES, "n_rows")


def untouched(spark, d):
    tables = geometry.anchored_tables(V.blocks(spark, d), V.pages(spark, d))
    return geometry.free_tables(tables, V.figures(spark, d).filter("box_no % 3 = 0")).select("page_number", "cap")


def crop_clip(spark, d):
    rows = geometry.meaningful(V.prims(spark, d)).withColumns({"kind": F.when(c("is_raster"), "figure").otherwise("table"), "ordinal": c("prim_no") % 100})
    found = pages.crops(rows, rows.select("document_id", "page_number").distinct().withColumns({"width": F.lit(540.0), "height": F.lit(650.0)}))
    return found.select("prim_no", "crop", *(c(f"clip.{x}").alias(x) for x in B.NAMES))


def page_elements(spark, d):
    return pages.elements(V.pages(spark, d), V.blocks(spark, d), V.prims(spark, d)).select("element_id", "kind", "page_number", "caption", "text", "crop")


# -- text


def page_offsets(spark, d):
    spans = chunking.page_spans(V.elements(spark, d).select("document_id", c("doc_id").alias("page_number"), "text"))
    return spans.select("document_id", "page_number", c("from").cast("long").alias("start"), c("to").cast("long").alias("stop"))


def offset_pages(spark, d):
    """The page of every 997th character of a document's text, and of one beyond it."""
    spans = chunking.page_spans(V.elements(spark, d).filter("document_id is not null").select("document_id", c("doc_id").alias("page_number"), "text"))
    whole = spans.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(c("from"), c("to"), "page_number"))).alias("spans"), F.max("to").alias("n"))
    rows = whole.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), c("n").cast("long") + 997, F.lit(997).cast("long"))))
    return rows.select("document_id", "at", chunking.page_of(c("at"), "spans").alias("page_number"))


def enriched(spark, d):
    e = V.elements(spark, d).withColumn("image_path", F.when(c("doc_id") % 10 != 8, F.concat(c("element_id"), F.lit(".png"))))
    reply = F.when(c("doc_id") % 7 == 0, enrich.UNREADABLE).when(c("doc_id") % 7 == 1, f" {enrich.NO_TABLE} ").when(c("kind") == "table", F.concat(F.lit("TABLE:\n| x |\nSUMMARY: of "), c("element_id"))).otherwise(F.concat(F.lit("  shows "), c("element_id"), F.lit("\n")))
    error = F.when(c("doc_id") % 13 == 5, "timed out")
    return enrich.decide(e.drop("summary").withColumns({"reply": reply, "error": error})).select("element_id", "summary", "table_markdown")


def stubbed(spark, d):
    found = enrich.replies(V.elements(spark, d).withColumn("image_path", c("element_id")).drop("summary"), summarize_text=True)
    return enrich.decide(found, True).select("element_id", "summary")


QUERIES = {
    "scan_documents": scanned,
    "content_id": lambda s, d: _docs(s, d).select("doc_id", files.content_id(c("text")).alias("document_id")),
    "retrieval_text": lambda s, d: V.vectors(s, d).select("element_id", "content"),
    "tokenize": lambda s, d: _docs(s, d).select("doc_id", F.array_join(T.tokens(c("text")), " ").alias("tokens")),
    "extract_references": caption_kinds,
    "normalize_ws": lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", T.normalize_ws(c("html")).alias("html")),
    "table_response_split": table_texts,
    "sanitize_metadata": metadata,
    "json_roundtrip_bbox": boxes_as_json,
    "scalar_kit": scalar_kit,
    "retry_after_and_error_class": errors,
    "hash_embedding": lambda s, d: V.vectors(s, d).select("element_id", F.size("embedding").cast("long").alias("dim"), F.round(F.element_at("embedding", 1), 9).alias("first"), F.round(F.element_at("embedding", -1), 9).alias("last")),
    "idf": lambda s, d: _docs(s, d).select(F.explode(F.array_distinct(T.tokens(c("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df")),
    "vector_topk_filtered": vector_topk,
    "dense_topk": lambda s, d: _dense(s, d).select("qid", c("pos").cast("long").alias("pos"), "element_id", F.round("dense", 6).alias("dense")),
    "dense_topk_filtered": dense_filtered,
    "lexical_scores": lambda s, d: retrieval.lexical(_dense(s, d)).select("qid", "element_id", F.round("lexical", 6).alias("lexical")),
    "minmax_normalize": scaled,
    "hybrid_rank": lambda s, d: retrieval.hybrid_rank(_dense(s, d)).select("qid", c("rank").cast("long").alias("rank"), "element_id", F.round("lexical", 6).alias("lexical"), F.round("blend", 6).alias("blend")),
    "dense_order_only": lambda s, d: retrieval.hybrid_rank(_dense(s, d), weight=0.0).select("qid", c("rank").cast("long").alias("rank"), "element_id"),
    "hydrate_hits": hydrate,
    "find_by_caption_reference": by_caption,
    "promote_referenced": promote,
    "search_end_to_end": search,
    "upsert_documents": upsert_documents,
    "upsert_elements": upsert_elements,
    "delete_cascade": deleted,
    "lookup_by_ids": looked_up,
    "exists_and_count": there,
    "list_documents": lambda s, d: store.listed(V.documents(s, d), V.elements(s, d).filter("document_id <> 'src6'")),
    "counts_by_kind": lambda s, d: store.counts(V.elements(s, d)),
    "fk_violations": missing_documents,
    "ingest_report": ingest_reports,
    "box_kit": box_kit,
    "box_intersect_join": box_intersect_join,
    "region_filter": region_filter,
    "box_enclosure_anti": enclosed,
    "caption_candidates": near_captions,
    "caption_binding": bound,
    "caption_anchored_tables": anchored,
    "region_anti_overlap": untouched,
    "cluster_boxes": lambda s, d: geometry.cluster_boxes(V.prims(s, d), 5.0),
    "crop_clip": crop_clip,
    "column_split": lambda s, d: geometry.columns(V.blocks(s, d), V.pages(s, d)).select("page_number", "n", "across", c("left").alias("n_left"), c("right").alias("n_right"), "two"),
    "reading_order": lambda s, d: geometry.reading_order(V.blocks(s, d), V.pages(s, d)).select("page_number", "block_no", c("ord").cast("long").alias("ord")),
    "body_text": lambda s, d: geometry.body_text(V.blocks(s, d), V.pages(s, d), V.figures(s, d)).select("page_number", F.length("body").cast("long").alias("n"), F.sha2("body", 256).alias("h")),
    "page_elements": page_elements,
    "chunk_fixed": lambda s, d: _docs(s, d).select("doc_id", F.inline(chunking.fixed(c("text")))).select("doc_id", c("start").cast("long").alias("start"), F.sha2("text", 256).alias("h")),
    "chunk_recursive": lambda s, d: _docs(s, d).select("doc_id", F.inline(chunking.recursive_udf("text"))),
    "page_offsets": page_offsets,
    "offset_to_page": offset_pages,
    "enrich_decision": enriched,
    "enrich_stub": stubbed,
    "context_blocks": contexts,
    "source_rows": sources,
}

BL = f"b AS ({V.BLOCKS_DUCK})"
_NORM = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
_LABEL = CAP.format(_NORM)
_KIND = f"CASE WHEN lower({_LABEL}) IN ('table', 'exhibit') THEN 'table' WHEN {_LABEL} <> '' THEN 'figure' END"
_STRIP = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
_COLS = "count(*) AS n, count(*) FILTER (x0 < 273.7 AND x1 > 321.3) AS across, count(*) FILTER (NOT (x0 < 273.7 AND x1 > 321.3) AND x1 <= 321.3) AS n_left, count(*) FILTER (NOT (x0 < 273.7 AND x1 > 321.3) AND x1 > 321.3) AS n_right"
_TWO = "n >= 6 AND n_left >= 2 AND n_right >= 2 AND across <= 0.2 * n AS two"


def _ordered(table: str) -> str:
    return f"k AS (SELECT *, {_TWO} FROM (SELECT page_number, {_COLS} FROM {table} GROUP BY page_number)), o AS (SELECT {table}.*, row_number() OVER (PARTITION BY page_number ORDER BY CAST(two AND x0 >= 273.7 AS INT), y0, x0, block_no) AS ord FROM {table} JOIN k USING (page_number))"


_FIG = f"prims AS ({V.PRIMS}), f AS ({V.FIGURES})"
_WIDE, _HIGH = "greatest(0, {0}.x1 - {0}.x0)", "greatest(0, {0}.y1 - {0}.y0)"
_SHARED_AREA = "(greatest(0, least({0}.x1, {1}.x1) - greatest({0}.x0, {1}.x0)) * greatest(0, least({0}.y1, {1}.y1) - greatest({0}.y0, {1}.y0)))"
_ALIGNED = "(least({0}.x1 - {0}.x0, {1}.x1 - {1}.x0) > 0 AND least({0}.x1, {1}.x1) - greatest({0}.x0, {1}.x0) > 0.35 * least({0}.x1 - {0}.x0, {1}.x1 - {1}.x0))"
_AWAY = "CASE WHEN {1}.y0 >= {0}.y1 THEN {1}.y0 - {0}.y1 WHEN {1}.y1 <= {0}.y0 THEN {0}.y0 - {1}.y1 ELSE 0 END"
_INSIDE = f"(b.x1 - b.x0) * (b.y1 - b.y0) > 0 AND {_SHARED_AREA.format('f', 'b')} > 0 AND {_SHARED_AREA.format('f', 'b')} >= 0.7 * (b.x1 - b.x0) * (b.y1 - b.y0)"


def _case(of: str, values: list) -> str:
    """values by the whole number `of`, as a CASE."""
    said = lambda v: "NULL" if v is None else "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\r", "' || chr(13) || '") + "'" if isinstance(v, str) else str(v)
    return f"CASE {of} " + " ".join(f"WHEN {i} THEN {said(v)}" for i, v in enumerate(values)) + " END"


_ANCHORED = f"{BL}, t AS (SELECT *, {_KIND} AS kind, row_number() OVER (PARTITION BY page_number ORDER BY y0, x0, block_no) AS i FROM b), m AS (SELECT t.*, c.block_no AS cap, c.x0 AS cx0, c.y0 AS cy0, c.x1 AS cx1, c.y1 AS cy1 FROM t JOIN t c ON t.page_number = c.page_number WHERE c.kind = 'table' AND t.i > c.i AND t.y0 >= c.y1 - 2 AND {_ALIGNED.format('c', 't')}), g AS (SELECT *, row_number() OVER w AS n, y0 - lag(y1) OVER w AS gap FROM m WINDOW w AS (PARTITION BY page_number, cap ORDER BY i)), l AS (SELECT *, coalesce(greatest(2 * median(gap) OVER (PARTITION BY page_number, cap), 18), 24) AS lim FROM g), s AS (SELECT *, max(CASE WHEN n > 1 AND (gap > lim OR kind IS NOT NULL) THEN 1 ELSE 0 END) OVER (PARTITION BY page_number, cap ORDER BY i) AS stopped FROM l), r AS (SELECT page_number, cap, greatest(0, least(min(x0), any_value(cx0))) AS x0, greatest(0, least(min(y0), any_value(cy0))) AS y0, least(595, greatest(max(x1), any_value(cx1))) AS x1, least(3000, greatest(max(y1), any_value(cy1))) AS y1, count(*) AS n_rows FROM s WHERE stopped = 0 GROUP BY page_number, cap)"
_TOUCH = "{0}.x1 >= {1}.x0 AND {1}.x1 >= {0}.x0 AND {0}.y1 >= {1}.y0 AND {1}.y1 >= {0}.y0"
#: Sequential choices as recursive queries: a table, a region or a source at a time, with what was chosen before.
_FREE = f"""
WITH RECURSIVE {_FIG}, {_ANCHORED},
n AS (SELECT *, row_number() OVER (PARTITION BY page_number ORDER BY y0, x0, cap) AS i FROM r WHERE x1 - x0 >= 60 AND y1 - y0 >= 40
  AND NOT EXISTS (SELECT 1 FROM f WHERE f.page_number = r.page_number AND f.box_no % 3 = 0 AND {_TOUCH.format('f', 'r')})),
q AS (SELECT DISTINCT page_number, 0::BIGINT AS i, list_slice([struct_pack(cap := cap, x0 := x0, y0 := y0, x1 := x1, y1 := y1)], 1, 0) AS kept FROM n
  UNION ALL SELECT n.page_number, n.i, CASE WHEN len(list_filter(kept, lambda k: {_TOUCH.format('k', 'n')})) > 0 THEN kept ELSE list_append(kept, struct_pack(cap := n.cap, x0 := n.x0, y0 := n.y0, x1 := n.x1, y1 := n.y1)) END
  FROM q JOIN n ON n.page_number = q.page_number AND n.i = q.i + 1)
SELECT page_number, unnest(kept).cap AS cap FROM (SELECT page_number, arg_max(kept, i) AS kept FROM q GROUP BY page_number)
"""
_BIND = f"""
WITH RECURSIVE {_FIG}, {BL}, t AS (SELECT *, {_KIND} AS caption_kind, {_NORM} AS caption FROM b),
g AS (SELECT *, row_number() OVER (PARTITION BY page_number ORDER BY y0, x0, x1, y1) - 1 AS i FROM f),
c AS (SELECT g.page_number, g.i, list(struct_pack(away := {_AWAY.format('g', 't')}, block_no := t.block_no, caption := caption, kind := caption_kind) ORDER BY {_AWAY.format('g', 't')}, t.block_no) AS near
  FROM g JOIN t ON g.page_number = t.page_number WHERE caption_kind IS NOT NULL AND {_ALIGNED.format('g', 't')} AND {_AWAY.format('g', 't')} < 72 GROUP BY ALL),
m AS (SELECT g.*, near FROM g LEFT JOIN c USING (page_number, i)),
q AS (SELECT DISTINCT page_number, -1::BIGINT AS i, []::BIGINT[] AS used, NULL::VARCHAR AS kind, NULL::VARCHAR AS caption, 0::DOUBLE AS x0, 0::DOUBLE AS y0 FROM g
  UNION ALL SELECT page_number, i, CASE WHEN p IS NULL THEN used ELSE list_append(used, p.block_no) END, p.kind, p.caption, x0, y0
  FROM (SELECT m.page_number, m.i, m.x0, m.y0, used, list_filter(near, lambda z: NOT list_contains(used, z.block_no))[1] AS p FROM q JOIN m ON m.page_number = q.page_number AND m.i = q.i + 1))
SELECT page_number, i AS ordinal, x0, y0, coalesce(kind, 'figure') AS kind, caption FROM q WHERE i >= 0
"""
_PLAIN = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_PROMPT = f"""
WITH RECURSIVE {SEARCH},
y AS (SELECT qid, place, kind, page_number, coalesce(caption, '') AS caption, element_id || '.png' AS image, {_PLAIN.format("coalesce(coalesce(nullif(CASE WHEN kind IN ('table', 'figure') THEN summary ELSE text END, ''), summary), '')")} AS body FROM z),
x AS (SELECT *, CASE WHEN caption <> '' AND NOT contains(body, caption) THEN {_PLAIN.format("caption || chr(10) || body")} ELSE body END AS whole FROM y),
folded AS (SELECT DISTINCT qid, 0::BIGINT AS n, 2000::BIGINT AS room, '' AS said, []::VARCHAR[] AS images, []::VARCHAR[] AS labels FROM x
  UNION ALL SELECT qid, n, room - length(part), CASE WHEN n > 1 THEN said || chr(10) || chr(10) ELSE '' END || {_PLAIN.format("'[S' || n || '] (' || kind || coalesce(', page ' || page_number, '') || ')' || chr(10) || part || CASE WHEN sent THEN chr(10) || '" + context.ATTACHED + "' ELSE '' END")},
    CASE WHEN sent THEN list_append(images, image) ELSE images END, CASE WHEN sent THEN list_append(labels, 'S' || n) ELSE labels END
  FROM (SELECT folded.qid, folded.n + 1 AS n, room, said, images, labels, kind, page_number, image, kind <> 'text' AND len(images) < 2 AS sent,
    CASE WHEN length(whole) > room THEN regexp_replace(substr(whole, 1, CAST(room AS INT)), '\\s+$', '') || ' ...' ELSE whole END AS part
    FROM folded JOIN x ON x.qid = folded.qid AND x.place = folded.n + 1 WHERE room > 0)),
o AS (SELECT qid, max(n) AS n_blocks, arg_max(said, n) AS said, arg_max(images, n) AS images, arg_max(labels, n) AS labels FROM folded GROUP BY qid)
SELECT qid, n_blocks, 'SOURCES' || chr(10) || said || CASE WHEN len(labels) > 0 THEN chr(10) || chr(10) || 'Images attached, in this order: ' || array_to_string(labels, ', ') || '.' ELSE '' END || chr(10) || chr(10) || 'QUESTION' || chr(10) || {_PLAIN.format('question')} AS prompt,
  array_to_string(images, ',') AS images, array_to_string(labels, ',') AS labels FROM o JOIN (SELECT qid, question FROM q) USING (qid)
"""
#: What the replies and tables of table_texts hold.
SPLIT = [("| a | b |\n| 1 | 2 |", "two"), (None, "none"), (None, "The table: see left. In summary: all is well."), (None, "table:\n| a |\nsummary: x"), (None, "Note. TABLE: | a | SUMMARY: x"), ("| a |", "one\nSUMMARY: two")]
MARKDOWN = ["| a | b |\n  | c | d |", None, None, "| y\n| z |\n| w |", "| a |\n| b |", None]
_D = f"WITH d AS ({V.DOCUMENTS}), {E_}"
_AGAIN = "document_id IN ('src1', 'src2', 'src3')"
SQL = {
    "scan_documents": "WITH f AS (SELECT 'd' || doc_id || CASE doc_id % 5 WHEN 2 THEN '.txt' WHEN 3 THEN '.PDF' ELSE '.pdf' END AS filename, CASE WHEN doc_id % 4 = 1 THEN '' ELSE '%PDF-1.4 ' END || text AS t FROM documents) SELECT substr(sha256(t), 1, 16) AS document_id, filename, 'file:/in/' || filename AS path, strlen(t) AS length, CASE WHEN lower(filename) LIKE '%.txt' THEN 'wrong suffix' WHEN strlen(t) > 4000 THEN 'too large' WHEN NOT starts_with(t, '%PDF-') THEN 'not a PDF' ELSE 'ok' END AS status FROM f",
    "content_id": "SELECT doc_id, substr(sha256(text), 1, 16) AS document_id FROM documents",
    "retrieval_text": f"WITH {E_} SELECT element_id, {CONTENT} AS content FROM e",
    "tokenize": f"SELECT doc_id, array_to_string({_tokens('text')}, ' ') AS tokens FROM documents",
    "extract_references": f"WITH {E_} SELECT element_id, CASE WHEN lower({CAP.format('caption')}) IN ('table', 'exhibit') THEN 'table' WHEN {CAP.format('caption')} <> '' THEN 'figure' END AS caption_kind, coalesce(array_to_string(list_sort({_refs('caption')}), ','), '') AS refs FROM e",
    "normalize_ws": "SELECT page_id, trim(regexp_replace(html, '\\s+', ' ', 'g')) AS html FROM pages",
    "hash_embedding": f"WITH {E_}, w AS (SELECT element_id, {_embed(CONTENT)} AS v FROM e) SELECT element_id, len(v) AS dim, round(v[1], 9) AS first, round(v[-1], 9) AS last FROM w",
    "idf": f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({_tokens('text')})) AS term FROM documents) GROUP BY term",
    "vector_topk_filtered": "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT q.vec_id AS qid, CAST(e.vec_id AS VARCHAR) AS element_id, round(list_dot_product(e.v, q.v), 9) AS dense FROM e JOIN e q USING (label) WHERE q.vec_id % 100 = 0) SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY dense DESC, element_id) AS pos, element_id, round(dense, 6) AS dense FROM d QUALIFY pos <= 5",
    "dense_topk": f"WITH {DENSE} SELECT qid, pos, element_id, round(dense, 6) AS dense FROM p",
    "hybrid_rank": f"WITH {LEX} SELECT qid, rank, element_id, round(lexical, 6) AS lexical, round(blend, 6) AS blend FROM k",
    "search_end_to_end": f"WITH {SEARCH} SELECT qid, place AS rank, element_id, document_id, kind, round(score, 6) AS score, page_number, caption, coalesce(nullif(CASE WHEN kind IN ('table', 'figure') THEN summary ELSE text END, ''), summary) AS text FROM z",
    "upsert_documents": "WITH n AS (SELECT o_orderkey + 3000 AS id, o_totalprice + 1 AS price, o_orderdate AS created_at FROM orders WHERE o_orderkey % 3 = 0) SELECT coalesce(o_orderkey, id) AS id, CASE WHEN id IS NULL THEN o_orderstatus ELSE 'new' END AS status, CASE WHEN id IS NULL THEN o_totalprice ELSE price END AS price, coalesce(o_orderdate, created_at) AS created_at FROM orders FULL JOIN n ON o_orderkey = id",
    "chunk_fixed": "WITH s AS (SELECT doc_id, text, unnest(range(0, greatest(0, length(text) - 201) + 1, 1200)) AS start FROM documents) SELECT doc_id, start, sha256(substr(text, CAST(start + 1 AS INT), 1400)) AS h FROM s",
    "page_offsets": f"WITH {E_} SELECT document_id, doc_id AS page_number, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY document_id ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(start + length(text) AS BIGINT) AS stop FROM e",
    "table_response_split": f"SELECT doc_id, {_case('doc_id % 6', [a for a, _ in SPLIT])} AS tbl, {_case('doc_id % 6', [b for _, b in SPLIT])} AS summary, CASE WHEN doc_id % 7 <> 0 THEN {_case('doc_id % 6', MARKDOWN)} END AS markdown FROM documents",
    "sanitize_metadata": """SELECT doc_id, source, CAST(1 + CASE WHEN length(trim(text, ' ' || chr(10))) > 0 THEN 1 ELSE 0 END AS BIGINT) AS n, CASE WHEN length(trim(text, ' ' || chr(10))) > 0 THEN least(length(trim(text, ' ' || chr(10))), 1000) END AS n_long,
      '{"n":' || doc_id || ',"half":' || CAST(doc_id / 4 AS DOUBLE) || ',"even":' || (doc_id % 2 = 0) || ',"list":"[' || doc_id || ',' || (doc_id + 1) || ']","sub":"{\\"s\\":\\"' || source || '\\"}"}' AS record FROM documents""",
    "json_roundtrip_bbox": f"WITH p AS ({V.PRIMS}) SELECT prim_no, CASE WHEN prim_no % 5 NOT IN (1, 2) THEN x0 END AS x0, CASE WHEN prim_no % 5 NOT IN (1, 2) THEN y1 END AS y1, CASE WHEN prim_no % 5 <> 1 THEN CAST(prim_no AS VARCHAR) END AS extra, CASE WHEN prim_no % 5 <> 3 THEN prim_no ELSE -1 END AS n FROM p",
    "scalar_kit": f"WITH p AS ({V.PRIMS}), q AS (SELECT prim_no, prim_no % 3000 AS w, prim_no % 1700 AS h, greatest(prim_no % 3000, prim_no % 1700) AS l FROM p) SELECT prim_no, CASE WHEN prim_no % 5 > 0 THEN CAST(floor(100.0 * (prim_no % 7) / (prim_no % 5)) AS BIGINT) ELSE 0 END AS percent, CASE WHEN l > 900 THEN greatest(1, CAST(floor(w * 900.0::DOUBLE / l) AS BIGINT)) ELSE w END AS width, CASE WHEN l > 900 THEN greatest(1, CAST(floor(h * 900.0::DOUBLE / l) AS BIGINT)) ELSE h END AS height, 'data:' || {_case('prim_no % 4', ['image/png', 'image/jpeg', 'image/png', 'image/webp'])} || ';base64,' || to_base64(encode(CAST(prim_no AS VARCHAR))) AS url, CASE prim_no % 2 WHEN 0 THEN 'one' || chr(10) || 'two' ELSE 'one' END AS reply, 'p:' || prim_no AS space, CAST({_case('prim_no % 3', [len(T.PROMPTS['text']) + 3, len(T.PROMPTS['table']), len(T.PROMPTS['figure'])])} AS BIGINT) AS n_prompt FROM q",
    "retry_after_and_error_class": f"SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 7.0::DOUBLE ELSE CAST({_case(f'event_id % {len(MESSAGES)}', WAITS)} AS DOUBLE) END AS wait, {_case(f'event_id % {len(MESSAGES)}', [x for *_, x in MESSAGES])} AS error_class FROM events",
    "dense_topk_filtered": f"WITH {DENSE.partition(', p AS')[0].rpartition('d AS')[0]}d AS (SELECT qid, element_id, round(list_dot_product(emb, qe), 9) AS dense FROM w, q WHERE document_id IN ('src' || (qid % 20), 'src1') AND (qid % 3 <> 0 OR kind IN ('table', 'figure'))) SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY dense DESC, element_id) AS pos, element_id, round(dense, 6) AS dense FROM d QUALIFY pos <= 5",
    "lexical_scores": f"WITH {LEX} SELECT qid, element_id, round(lexical, 6) AS lexical FROM b",
    "dense_order_only": f"WITH {DENSE} SELECT qid, pos AS rank, element_id FROM p WHERE pos <= 6",
    "minmax_normalize": "WITH v AS (SELECT event_type, event_id, CASE WHEN event_type = 'click' THEN 3.0::DOUBLE ELSE value END AS v FROM events), m AS (SELECT *, min(v) OVER (PARTITION BY event_type) AS lo, max(v) OVER (PARTITION BY event_type) AS hi FROM v) SELECT event_id, round(CASE WHEN hi - lo < 1e-9 THEN CASE WHEN hi > 0 THEN 1.0 ELSE 0.0 END ELSE (v - lo) / (hi - lo) END, 9) AS scaled FROM m",
    "hydrate_hits": f"WITH {E_} SELECT element_id, CASE WHEN doc_id % 11 <> 3 THEN caption END AS caption, sha256(CASE WHEN doc_id % 11 = 3 THEN 'indexed ' || element_id WHEN kind <> 'text' OR doc_id % 4 = 1 OR text = '' THEN 's ' || element_id ELSE text END) AS text FROM e",
    "find_by_caption_reference": f"WITH {E_}, q AS ({V.QUESTIONS}), a AS (SELECT qid, unnest({_refs('question')}) AS ref FROM q), n AS (SELECT element_id, unnest({_refs('caption')}) AS ref FROM e WHERE caption IS NOT NULL AND document_id IN {tuple(SOURCES)}) SELECT DISTINCT qid, element_id FROM a JOIN n USING (ref)",
    "promote_referenced": f"WITH {E_}, q AS ({V.QUESTIONS}), h AS (SELECT qid, doc_id + 1 AS rank, element_id, 0.5 AS score FROM q, e WHERE qid % 2 = 0 AND doc_id < 3), a AS (SELECT qid, unnest({_refs('question')}) AS ref FROM q WHERE qid % 2 = 0), n AS (SELECT element_id, unnest({_refs('caption')}) AS ref FROM e WHERE caption IS NOT NULL), m AS (SELECT DISTINCT qid, element_id FROM a JOIN n USING (ref) WHERE (qid, element_id) NOT IN (SELECT (qid, element_id) FROM h)), u AS (SELECT qid, rank, element_id, CAST(score AS DOUBLE) AS score FROM h UNION ALL SELECT qid, 0, element_id, NULL FROM m) SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY u.rank, element_id) AS rank, element_id, score FROM u QUALIFY row_number() OVER (PARTITION BY qid ORDER BY u.rank, element_id) <= 4",
    "upsert_elements": f"{_D}, s AS (SELECT * FROM e WHERE document_id IS NOT NULL), u AS (SELECT element_id, document_id, kind, CASE WHEN {_AGAIN} AND length(element_id) % 2 = 1 THEN 'again' ELSE text END AS text, CASE WHEN {_AGAIN} AND length(element_id) % 2 = 1 THEN 'again' ELSE caption END AS caption, page_number FROM s UNION ALL SELECT element_id || '+', document_id, 'again', 'again', 'again', page_number FROM s WHERE {_AGAIN} AND length(element_id) % 2 = 0) SELECT element_id, document_id, kind, sha256(text) AS text, caption, page_number, created_at FROM u JOIN d USING (document_id)",
    "delete_cascade": f"{_D} SELECT document_id, (SELECT count(*) FROM e WHERE e.document_id = d.document_id) AS left_over, (SELECT count(*) FROM e WHERE document_id = 'src5') AS gone FROM d WHERE document_id <> 'src5'",
    "lookup_by_ids": f"WITH {E_} SELECT element_id, kind, page_number FROM e WHERE element_id IN ('src1:e:1', 'src7:e:7', 'src2:e:2', 'missing')",
    "exists_and_count": f"{_D} SELECT EXISTS (SELECT 1 FROM d WHERE document_id = 'src3') AS there, EXISTS (SELECT 1 FROM d WHERE document_id = 'none') AS not_there, (SELECT count(*) FROM e WHERE document_id IS NOT NULL) AS n, (SELECT count(*) FROM e WHERE document_id = 'src4') AS n_src4, 0::BIGINT AS n_none",
    "list_documents": f"{_D} SELECT d.*, (SELECT count(*) FROM e WHERE e.document_id = d.document_id AND document_id <> 'src6') AS element_count FROM d",
    "counts_by_kind": f"WITH {E_} SELECT document_id, CAST(count_if(kind = 'text') AS BIGINT) AS text_chunks, CAST(count_if(kind = 'table') AS BIGINT) AS tables, CAST(count_if(kind = 'figure') AS BIGINT) AS figures, count(*) AS total, bool_or(kind <> 'text') AS any_visual FROM e GROUP BY document_id",
    "fk_violations": "SELECT o_orderkey FROM orders ANTI JOIN customer ON o_custkey = c_custkey + 10",
    "ingest_report": f"{_D}, n AS (SELECT document_id, CAST(count_if(kind = 'text') AS BIGINT) AS t, CAST(count_if(kind = 'table') AS BIGINT) AS b, CAST(count_if(kind = 'figure') AS BIGINT) AS f, count(*) AS a, bool_or(kind <> 'text') AS v FROM e WHERE document_id <> 'src6' GROUP BY document_id) SELECT document_id, filename, pages, coalesce(t, 0) AS text_chunks, coalesce(b, 0) AS tables, coalesce(f, 0) AS figures, coalesce(a, 0) AS total, coalesce(v, false) AS any_visual, CASE WHEN pages % 2 = 0 THEN 'page 1: ' || filename ELSE '' END AS warnings FROM d LEFT JOIN n USING (document_id)",
    "box_kit": f"WITH {_FIG}, n AS (SELECT box_no, struct_pack(x0, y0, x1, y1) AS a, lead(struct_pack(x0, y0, x1, y1)) OVER (PARTITION BY page_number ORDER BY box_no, x0, y0, x1, y1) AS b FROM f WHERE page_number <= 400) SELECT box_no, round({_WIDE.format('a')} * {_HIGH.format('a')}, 6) AS area, round({_SHARED_AREA.format('a', 'b')}, 6) AS overlap, {_ALIGNED.format('a', 'b')} AS aligned, CAST({_AWAY.format('a', 'b')} AS DOUBLE) AS distance, {_SHARED_AREA.format('a', 'b')} > 0 AND {_SHARED_AREA.format('a', 'b')} >= 0.3 * (b.x1 - b.x0) * (b.y1 - b.y0) AND (b.x1 - b.x0) * (b.y1 - b.y0) > 0 AS encloses, round(greatest(a.x1, b.x1) - least(a.x0, b.x0), 6) AS both_width, a.y0 - 2 AS grown FROM n WHERE b IS NOT NULL",
    "box_intersect_join": f"WITH p AS (SELECT * FROM ({V.PRIMS}) WHERE x1 - x0 >= 3 AND y1 - y0 >= 3) SELECT page_number, count(*) AS n_pairs FROM p a JOIN p b USING (page_number) WHERE a.prim_no < b.prim_no AND a.x1 + 2 >= b.x0 AND b.x1 + 2 >= a.x0 AND a.y1 + 2 >= b.y0 AND b.y1 + 2 >= a.y0 GROUP BY page_number",
    "region_filter": f"WITH {_FIG}, g AS (SELECT *, (x1 - x0) * (y1 - y0) / (595.0 * 842.0) AS ratio FROM f SEMI JOIN documents ON doc_id = page_number) SELECT page_number, box_no, x1, y1 FROM g WHERE x1 - x0 >= 60 AND y1 - y0 >= 40 AND ratio >= 0.012 AND ratio <= 0.95 AND (has_raster OR primitive_count >= 3)",
    "box_enclosure_anti": f"WITH {_FIG}, {BL} SELECT page_number, block_no FROM b WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.page_number = b.page_number AND {_INSIDE})",
    "caption_candidates": f"WITH {_FIG}, {BL}, t AS (SELECT *, {_KIND} AS caption_kind FROM b) SELECT f.page_number, f.box_no, t.block_no, CAST({_AWAY.format('f', 't')} AS DOUBLE) AS away, caption_kind FROM f JOIN t ON f.page_number = t.page_number WHERE caption_kind IS NOT NULL AND {_ALIGNED.format('f', 't')} AND {_AWAY.format('f', 't')} < 72",
    "caption_anchored_tables": f"WITH {_ANCHORED} SELECT * FROM r WHERE x1 - x0 >= 60 AND y1 - y0 >= 40",
    "region_anti_overlap": _FREE,
    "caption_binding": _BIND,
    "context_blocks": _PROMPT,
    "crop_clip": f"WITH p AS (SELECT *, CASE WHEN is_raster THEN 'figure' ELSE 'table' END AS kind FROM ({V.PRIMS}) WHERE x1 - x0 >= 3 AND y1 - y0 >= 3), k AS (SELECT prim_no, printf('p%04d_%02d_%s.png', page_number, prim_no % 100, kind) AS crop, greatest(x0 - 8, 0) AS x0, greatest(y0 - 8, 0) AS y0, least(x1 + 8, 540) AS x1, least(y1 + 8, 650) AS y1 FROM p) SELECT * FROM k WHERE x1 - x0 >= 1 AND y1 - y0 >= 1",
    "column_split": f"WITH {BL} SELECT *, {_TWO} FROM (SELECT page_number, {_COLS} FROM b GROUP BY page_number)",
    "reading_order": f"WITH {BL}, {_ordered('b')} SELECT page_number, block_no, ord FROM o",
    "body_text": f"WITH {_FIG}, {BL}, r AS (SELECT * FROM b WHERE ({_KIND}) IS NULL AND {_STRIP} <> '' AND NOT EXISTS (SELECT 1 FROM f WHERE f.page_number = b.page_number AND {_INSIDE})), {_ordered('r')}, j AS (SELECT page_number, string_agg({_STRIP}, chr(10) || chr(10) ORDER BY ord) AS body FROM o GROUP BY page_number) SELECT page_number, length(body) AS n, sha256(body) AS h FROM j",
    "offset_to_page": f"WITH {E_}, s AS (SELECT document_id, doc_id AS page_number, coalesce(sum(length(text) + 2) OVER (PARTITION BY document_id ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, length(text) AS l FROM e WHERE document_id IS NOT NULL), n AS (SELECT document_id, max(a + l) AS n, max(page_number) AS last FROM s GROUP BY document_id), g AS (SELECT document_id, last, unnest(range(0, CAST(n + 998 AS BIGINT), 997)) AS at FROM n) SELECT g.document_id, g.at, coalesce((SELECT min(page_number) FROM s WHERE s.document_id = g.document_id AND s.a <= g.at AND g.at <= s.a + s.l), g.last) AS page_number FROM g",
    "enrich_decision": f"WITH {E_}, r AS (SELECT *, doc_id % 10 = 8 AS bare, doc_id % 7 IN (0, 1) AS bad, doc_id % 13 = 5 AS failed FROM e), o AS (SELECT element_id, CASE WHEN failed THEN coalesce(nullif(caption, ''), text) WHEN kind = 'text' OR bare THEN text WHEN bad THEN coalesce(nullif(caption, ''), text) WHEN kind = 'table' THEN 'of ' || element_id || chr(10) || chr(10) || '| x |' ELSE 'shows ' || element_id END AS summary, CASE WHEN kind = 'table' AND NOT bare AND NOT bad AND NOT failed THEN '| x |' END AS table_markdown FROM r) SELECT * FROM o WHERE trim(summary, ' ' || chr(10)) <> ''",
    "enrich_stub": f"WITH {E_}, w AS (SELECT element_id, array_to_string(list_slice(list_filter(string_split_regex(CASE kind WHEN 'text' THEN {_case('0', [T.PROMPTS['text']])} || text WHEN 'table' THEN {_case('0', [T.PROMPTS['table']])} ELSE {_case('0', [T.PROMPTS['figure']])} END, '\\s+'), lambda x: x <> ''), -12, -1), ' ') AS summary FROM e) SELECT * FROM w",
    "source_rows": f"WITH {SEARCH}, y AS (SELECT qid, 'S' || place AS label, element_id, kind, CASE WHEN kind <> 'text' THEN '/elements/' || element_id || '/image' END AS image_url, coalesce(nullif(CASE WHEN kind IN ('table', 'figure') THEN summary ELSE text END, ''), summary) AS t FROM z), x AS (SELECT *, list_filter(string_split_regex(substr(t, CAST(instr(t, '|') AS INT)), '\\r\\n|[\\n\\x0b\\x0c\\r]'), lambda l: starts_with(ltrim(l, ' ' || chr(9)), '|')) AS rows FROM y) SELECT qid, label, element_id, image_url, CASE WHEN kind = 'table' AND contains(t, '|') AND len(rows) >= 2 THEN rtrim(array_to_string(rows, chr(10)), ' ' || chr(10)) END AS table_markdown FROM x",
}
