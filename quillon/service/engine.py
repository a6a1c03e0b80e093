"""The engine over one store: take files in, ask, list, delete, report health."""

from __future__ import annotations

import posixpath
import time
import uuid
from collections.abc import Callable, Iterable
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.text import data_url, retrieval_text, table_markdown
from quillon.operators import context, enrich, pages, retrieval, store
from quillon.operators.models import ChatModel, Embedder, ModelError, first_block
from quillon.service.errors import InvalidInput, Misconfigured, NotFound, TooLarge, UpstreamError, WrongType
from quillon.service.jobs import Job, Jobs
from quillon.service.logs import configure
from quillon.service.settings import Settings
from quillon.sources import extract, files

KINDS = ("text", "table", "figure")
# Most sources asked for, longest question.
MOST_SOURCES, LONGEST = 25, 4000
BLANK, NOTHING = "Please ask a question.", "Nothing in the indexed documents bears on this question."


def source_rows(hits: DataFrame) -> DataFrame:
    """hits(qid, rank, element_id, kind, image_path, text, ...) with label S1, S2 ..., image_url (null without an image) and
    table_markdown."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy("rank", "element_id"))
    url = F.when(F.col("image_path").isNotNull(), F.concat(F.lit("/elements/"), F.col("element_id"), F.lit("/image")))
    more = {"label": F.concat(F.lit("S"), place.cast("string")), "image_url": url}
    if {"kind", "text"} <= set(hits.columns):
        more["table_markdown"] = table_markdown(F.col("kind"), F.col("text"))
    return hits.withColumns(more).drop("image_path")


def document_rows(documents: DataFrame) -> DataFrame:
    """What is told of documents: without the embedding space and the stored path; times as ISO 8601 in UTC."""
    told = documents.drop("fingerprint", "stored_path")
    return told.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ssXXX"))


def report_rows(documents: DataFrame, elements: DataFrame, warnings: DataFrame) -> DataFrame:
    """(document_id, filename, pages, text_chunks, tables, figures, total, any_visual, warnings) of what was taken in."""
    rows = documents.select("document_id", "filename", "pages").join(store.counts(elements), "document_id", "left").join(warnings, "document_id", "left")
    rows = rows.fillna(0, ["text_chunks", "tables", "figures", "total"]).fillna(False, ["any_visual"])
    return rows.withColumn("warnings", F.coalesce("warnings", F.expr("cast(array() as array<string>)")))


class Engine:
    """backends: extraction backends by name, beside those registered; complete: the chat model's call (text, image URLs,
    system) -> reply; render: (content, page number, clip) -> PNG bytes, where a renderer is at hand."""

    def __init__(self, spark: SparkSession, settings: Settings, backends: dict[str, Callable] | None = None, complete: Callable | None = None, embedder: Embedder | None = None, render: Callable | None = None):
        s = settings
        self.spark, self.settings, self.render = spark, s, render
        self.backends = extract.BACKENDS | (backends or {})
        self.asks_model = complete is not None
        self.model = ChatModel(complete or first_block, s.llm_max_retries, s.llm_max_backoff, s.llm_min_interval)
        if embedder is None and s.embedding_provider != "sha256":
            raise Misconfigured(f"no embedding provider {s.embedding_provider} was given")
        self.embedder = embedder or Embedder(s.embedding_provider, s.embedding_model, batch=s.embedding_batch)
        at = s.data_dir if "://" in s.data_dir else f"file://{s.data_dir}"
        self.folder = at.rstrip("/")
        self.store = store.Store(spark, f"{self.folder}/index")
        self.jobs = Jobs(spark)
        self.log = configure(s.log_level)

    # -- taking in

    def accept(self, name: str, chunks: Iterable[bytes]) -> str:
        """Store an upload in the landing folder as it arrives; one of the wrong type or size leaves nothing behind."""
        name = posixpath.basename(name.replace("\\", "/"))
        if not name.lower().endswith(".pdf"):
            raise WrongType("only PDF files are taken")
        path = self.store._path(f"{self.folder}/landing/{uuid.uuid4().hex}/{name}")
        fs, size, whole = self.store._fs, 0, False
        out = fs.create(path, True)
        try:
            for chunk in chunks:
                size += len(chunk)
                if size > self.settings.max_upload_mb << 20:
                    raise TooLarge(f"over {self.settings.max_upload_mb} MB")
                out.write(bytearray(chunk))
            whole = True
        finally:
            out.close()
            if not whole:
                fs.delete(path.getParent(), True)
        return path.getParent().toString()

    def _archived(self, parsed: DataFrame) -> DataFrame:
        """(document_id, stored_path): a copy of each source file, named by its document; null where that failed."""
        out, fs = [], self.store._fs
        conf, util = self.spark.sparkContext._jsc.hadoopConfiguration(), self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil
        for r in parsed.select("document_id", "path").toLocalIterator():
            target = self.store._path(f"{self.folder}/sources/{r.document_id}.pdf")
            try:
                if not fs.exists(target):
                    source = self.store._path(r.path)
                    util.copy(source.getFileSystem(conf), source, fs, target, False, conf)
                out.append((r.document_id, target.toString()))
            except Exception as error:
                self.log.warning("no copy of %s is kept: %s", r.path, str(error).splitlines()[0])
        return self.spark.createDataFrame(out, "document_id string, stored_path string")

    def _cropped(self, elements: DataFrame, contents: DataFrame) -> DataFrame:
        """elements whose crops are written under images/, if there is a renderer, with image_path and the bytes (image)."""
        if self.render is None:
            return elements.withColumn("image", F.lit(None).cast("binary"))
        render = self.render

        def run(batches):
            for pdf in batches:
                images = []
                for content, page, box in zip(pdf["content"], pdf["page_number"], pdf["box"], strict=True):
                    try:
                        images.append(render(bytes(content), int(page), box))
                    except Exception:
                        images.append(None)
                yield pdf[["element_id"]].assign(image=images)

        asked = elements.filter("crop is not null").select("element_id", "document_id", "page_number", "box").join(contents, "document_id")
        images = asked.select("element_id", "page_number", "box", "content").mapInPandas(run, "element_id string, image binary").filter("length(image) > 0")
        stage = f"{self.folder}/staging/{uuid.uuid4().hex}"
        images.write.parquet(stage)
        images = self.spark.read.parquet(stage)
        named = images.join(elements.select("element_id", "document_id", "crop"), "element_id")
        for r in named.select("document_id", "crop", "image").toLocalIterator():  # one image at a time
            out = self.store._fs.create(self.store._path(f"{self.folder}/images/{r.document_id}/{r.crop}"), True)
            out.write(bytearray(r.image))
            out.close()
        path = F.when(F.col("image").isNotNull(), F.concat_ws("/", F.lit(f"{self.folder}/images"), "document_id", "crop"))
        return elements.join(images, "element_id", "left").withColumn("image_path", F.coalesce("image_path", path))

    def ingest(self, folder: str, force: bool = False, progress: Callable[[int, int], None] = lambda done, total: None, backend: str | None = None) -> dict:
        """Files of a folder, in the order of their names -> stored elements and vectors. Bad files are told of, known
        contents passed over unless forced; documents are stored with their elements or not at all."""
        began, s = time.time(), self.settings
        name = backend or s.extractor_backend
        if name not in self.backends:
            raise InvalidInput(f"no backend {name}; there are " + ", ".join(sorted(self.backends)))
        raw = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,PDF}").load(folder)
        status = files.checked(raw, s.max_upload_mb << 20)
        bad = status.filter("status <> 'ok'").select(F.lit("").alias("document_id"), "filename", F.col("status").alias("error"))
        wanted, known = files.documents_of(status).drop("n_files"), self.store.table("documents")
        skipped = wanted.limit(0)
        if known is not None and not force:
            skipped = wanted.join(known.select("document_id"), "document_id", "left_semi")
            wanted = wanted.join(known.select("document_id"), "document_id", "left_anti")
        progress(0, 4)

        stage = f"{self.folder}/staging/{uuid.uuid4().hex}"
        content = raw.select(files.content_id(F.col("content")).alias("document_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), "path", "content")
        content = content.join(wanted, ["document_id", "filename"], "left_semi").dropDuplicates(["document_id"])
        extract.extracted(content, self.backends[name]).write.parquet(f"{stage}/parsed")
        parsed = self.spark.read.parquet(f"{stage}/parsed")
        progress(1, 4)

        tables = extract.pages_of(parsed).filter("error is null"), extract.blocks_of(parsed), extract.primitives_of(parsed)
        rows = pages.elements(*tables, s.chunk_size, s.chunk_overlap, s.min_chunk, s.region_merge_gap, s.min_region_area_ratio, s.max_region_area_ratio)
        rows = rows.unionByName(pages.whole(extract.whole_elements_of(parsed)))
        self._cropped(rows, content.select("document_id", "content")).write.parquet(f"{stage}/found")
        rows = self.spark.read.parquet(f"{stage}/found")
        progress(2, 4)

        none = F.lit(None).cast("string")
        if self.asks_model and enrich.needs_model(rows, s.summarize_text_chunks):
            asked = enrich.replies(rows.repartition(s.summarize_concurrency), self.model, s.summarize_text_chunks)
        else:
            asked = rows.withColumns({"reply": none, "error": F.when((F.col("kind") != "text") & F.col("image_path").isNotNull(), "no model")})
        elements = enrich.decide(asked, self.asks_model and s.summarize_text_chunks).drop("reply", "error", "image", "crop")
        elements.write.parquet(f"{stage}/elements")
        elements = self.spark.read.parquet(f"{stage}/elements")
        vectors = elements.withColumn("content", retrieval_text(F.col("page_number"), F.col("caption"), F.col("summary"), F.col("text"))).filter("content <> ''")
        vectors = vectors.select("element_id", "document_id", "kind", "content", self.embedder.column(F.col("content")).alias("embedding"))
        documents = parsed.join(elements.select("document_id").distinct(), "document_id", "left_semi")
        documents = documents.join(self._archived(documents), "document_id", "left")
        documents = documents.select("document_id", "filename", F.size("pages").alias("pages"), F.lit(name).alias("backend"), F.lit(self.embedder.fingerprint).alias("fingerprint"), "stored_path", F.date_trunc("second", F.current_timestamp()).alias("created_at"))
        documents.write.parquet(f"{stage}/documents")
        documents = self.spark.read.parquet(f"{stage}/documents")
        progress(3, 4)

        told = report_rows(documents, elements, extract.warnings_of(parsed)).withColumns({"skipped": F.lit(False), "failed": F.lit(False)})
        empty = parsed.join(documents.select("document_id"), "document_id", "left_anti").select(F.lit("").alias("document_id"), "filename", F.coalesce("error", F.lit("nothing could be read from it")).alias("error"))
        blank = {"pages": F.lit(0), **{n: F.lit(0).cast("long") for n in ("text_chunks", "tables", "figures", "total")}, "any_visual": F.lit(False)}
        lines = F.expr("cast(array() as array<string>)")
        passed = skipped.select("document_id", "filename").withColumns({**blank, "warnings": lines, "skipped": F.lit(True), "failed": F.lit(False)})
        failed = bad.unionByName(empty).withColumns({**blank, "warnings": F.array("error"), "skipped": F.lit(False), "failed": F.lit(True)}).drop("error")
        path = f"{self.folder}/reports/{uuid.uuid4().hex}"
        told.unionByName(passed).unionByName(failed).write.parquet(path)
        counts = self.spark.read.parquet(path).agg(F.count_if(~F.col("skipped") & ~F.col("failed")).alias("n"), F.count_if("skipped").alias("s"), F.count_if("failed").alias("f"), F.sum("total").alias("e")).first()
        if counts.n:
            try:
                self.store.add(documents, elements, vectors, replace=True)
            except ValueError as error:
                raise Misconfigured(str(error)) from error
        n_bad = bad.count()
        self.store._fs.delete(self.store._path(stage), True)
        progress(4, 4)
        elapsed = round(time.time() - began, 2)
        self.log.info("took in %s documents, %s elements, in %s s", counts.n, counts.e or 0, elapsed)
        return {"n_documents": counts.n, "n_elements": counts.e or 0, "n_bad_files": n_bad, "n_without_text": counts.f - n_bad, "n_skipped": counts.s, "reports": path, "elapsed": elapsed}

    def reports(self, report: dict) -> DataFrame:
        """A row for each file of an ingest, by name: document_id, counts, warnings, whether it was known already or failed."""
        return self.spark.read.parquet(report["reports"]).orderBy("filename")

    def submit_ingest(self, folder: str, force: bool = False, backend: str | None = None) -> Job:
        """ingest in the background; ask job() how far it is."""
        return self.jobs.submit(posixpath.basename(folder.rstrip("/")), lambda progress: self.ingest(folder, force, progress, backend))

    def submit_upload(self, name: str, chunks: Iterable[bytes], force: bool = False) -> Job:
        """accept, then submit_ingest. A wrong name is refused at once, a file that is no PDF by the job's report."""
        return self.submit_ingest(self.accept(name, chunks), force)

    def job(self, job_id: str) -> Job:
        found = self.jobs.get(job_id)
        if found is None:
            raise NotFound(job_id)
        return found

    # -- asking

    def retrieve(self, questions: DataFrame, k: int | None = None) -> DataFrame | None:
        """questions(qid, question, document_ids, kinds) -> their sources with image_path; None while nothing is stored."""
        s, vectors, elements = self.settings, self.store.table("vectors"), self.store.table("elements")
        if vectors is None:
            return None
        if self.store.spaces() - {self.embedder.fingerprint}:
            raise Misconfigured(f"the index lies in the space {', '.join(sorted(self.store.spaces()))}, not in {self.embedder.fingerprint}")
        asked = questions.withColumn("q_embedding", self.embedder.column(F.col("question")))
        found = retrieval.search(vectors, elements, asked, k or s.retrieval_k, s.rerank_fetch_multiplier, s.lexical_weight)
        return found.join(elements.select("element_id", "image_path"), "element_id", "left")

    def ask(self, question: str, k: int | None = None, document_ids: Iterable[str] = (), kinds: Iterable[str] = ()) -> dict:
        began, s, k = time.time(), self.settings, k or self.settings.retrieval_k
        kinds = list(kinds)
        if not 1 <= k <= MOST_SOURCES or len(question) > LONGEST or set(kinds) - set(KINDS):
            raise InvalidInput(f"k is 1 to {MOST_SOURCES}, a question at most {LONGEST} characters, a kind one of " + ", ".join(KINDS))
        out = {"question": question.strip(), "answer": BLANK, "sources": [], "images_sent": 0}
        if out["question"]:
            asked = self.spark.createDataFrame([(0, out["question"], list(document_ids), kinds)], "qid long, question string, document_ids array<string>, kinds array<string>")
            found = self.retrieve(asked, k)
            rows = [] if found is None else [r.asDict() for r in found.collect()]  # k rows at most
            for r in rows:  # an image counts while its file is there
                r["image_path"] = r["image_path"] if self._under_images(r["image_path"]) else None
            out["answer"] = NOTHING
            if rows:
                schema = "qid long, rank int, element_id string, document_id string, kind string, score double, page_number long, caption string, text string, image_path string"
                hits = self.spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
                out["sources"] = [r.asDict() for r in source_rows(hits).orderBy("rank").collect()]
                prompt = context.prompts(context.contexts(hits, s.max_context_chars, s.max_images_per_answer), asked).first()
                images = [u for u in map(self._image_url, prompt.images) if u]
                out["images_sent"] = len(images)
                try:
                    out["answer"] = self.model.complete(prompt.prompt, images, context.SYSTEM)
                except ModelError as error:
                    raise UpstreamError(str(error)) from error
        return out | {"elapsed": round(time.time() - began, 2)}

    def _image_url(self, path: str) -> str | None:
        if not self._under_images(path):
            return None
        return self.spark.read.format("binaryFile").load(path).select(data_url(F.col("content"), F.col("path"))).first()[0]

    # -- managing

    def documents(self) -> DataFrame | None:
        """Newest first, with the number of elements; without fingerprints and stored paths."""
        d = self.store.list_documents()
        return None if d is None else document_rows(d)

    def delete(self, document_id: str) -> int:
        if not self.store.has_document(document_id):
            raise NotFound(document_id)
        self.store._fs.delete(self.store._path(f"{self.folder}/images/{document_id}"), True)
        return self.store.delete(document_id)

    def _under_images(self, path: str | None) -> bool:
        """path, with all its turns, is a file under the image folder."""
        root = posixpath.normpath(unquote(urlparse(f"{self.folder}/images").path))
        clean = posixpath.normpath(unquote(urlparse(path).path)) if path else ""
        at = self.store._path(clean) if clean.startswith(root + "/") else None
        return at is not None and self.store._fs.exists(at) and self.store._fs.getFileStatus(at).isFile()

    def image_path(self, element_id: str) -> str:
        """The path of an element's image; only files under the image folder are given out."""
        e = self.store.get_elements([element_id])
        row = e.select("image_path").first() if e is not None else None
        if row is None or not self._under_images(row.image_path):
            raise NotFound(element_id)
        return posixpath.normpath(unquote(urlparse(row.image_path).path))

    def health(self, models: bool = False) -> dict:
        """degraded if the index can't be read or lies in another embedding space; with models, if these don't answer."""
        try:
            d = self.store.table("documents")
            out = {"status": "ok" if self.store.spaces() <= {self.embedder.fingerprint} else "degraded", "n_documents": 0 if d is None else d.count(), "n_elements": self.store.count_elements()}
            if models:
                out["embedding_dimension"] = self.embedder.dimension(self.spark)
                self.model.check()
            return out
        except Exception as error:
            return {"status": "degraded", "error": str(error).splitlines()[0]}
