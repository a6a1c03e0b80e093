"""The index as versioned Parquet: upserts, cascading deletes, lookups.

Each table lies in PARTS parts by the hash of document_id. A write makes new files for the parts it touches only. Numbered
manifests name the files of every part; the newest one counts, so a crash at any point leaves the index as it was before
or after a write. One writer at a time."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillon.functions.text import references
from quillon.operators import retrieval

PARTS, KEPT = 16, 2
TABLES = ("documents", "elements", "vectors")
# What an element keeps of its first version, all but these.
REPLACED = ["text", "summary", "image_path", "caption"]


def part_of(document_id: Column) -> Column:
    return F.pmod(F.xxhash64(document_id), F.lit(PARTS)).cast("int")


def upsert(old: DataFrame, new: DataFrame, key: str, replaced: list[str], order: str | None = None) -> DataFrame:
    """Rows of both by key; of rows in both, the columns in replaced come from new. In new the last row of a key wins."""
    if order:
        last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
        new = new.withColumn("_n", last).filter("_n = 1").drop("_n", order)
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    seen, fresh = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()
    pick = lambda c: F.when(fresh & (~seen | F.lit(c in replaced)), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return both.select(*(pick(c).alias(c) for c in old.columns))


def orphans(elements: DataFrame, documents: DataFrame) -> DataFrame:
    """Elements whose document is missing."""
    return elements.join(documents.select("document_id"), "document_id", "left_anti")


def listed(documents: DataFrame, elements: DataFrame) -> DataFrame:
    """documents with element_count (0 without elements), newest first."""
    n = elements.groupBy("document_id").agg(F.count("element_id").alias("element_count"))
    return documents.join(n, "document_id", "left").fillna(0, ["element_count"]).orderBy(F.desc("created_at"), "document_id")


def counts(elements: DataFrame) -> DataFrame:
    """(document_id, text_chunks, tables, figures, total, any_visual)."""
    of = lambda kind: F.count_if(F.col("kind") == kind)
    return elements.groupBy("document_id").agg(of("text").alias("text_chunks"), of("table").alias("tables"), of("figure").alias("figures"), F.count("*").alias("total"), F.bool_or(F.col("kind") != "text").alias("any_visual"))


class Store:
    """documents, elements and vectors under one folder, read and written through Spark."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- versions

    def _numbers(self) -> list[int]:
        at = self._path(f"{self.folder}/manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())

    def _manifest(self, number: int | None = None) -> dict:
        numbers = self._numbers()
        if not numbers:
            return {}
        text = self.spark.read.text(f"{self.folder}/manifests/{number or numbers[-1]}.json", wholetext=True).first().value
        return json.loads(text)

    def _commit(self, manifest: dict) -> None:
        number = (self._numbers() or [0])[-1] + 1
        fresh = self._path(f"{self.folder}/manifests/{number}.new")
        out = self._fs.create(fresh, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self._fs.rename(fresh, self._path(f"{self.folder}/manifests/{number}.json")):
            raise RuntimeError(f"manifest {number} could not be written")
        self.vacuum()

    def vacuum(self, kept: int = KEPT) -> None:
        """Remove manifests but the newest `kept`, and files that none of these names."""
        numbers = self._numbers()
        live = {p for n in numbers[-kept:] for t in self._manifest(n).values() for p in t["parts"].values()}
        for n in numbers[:-kept]:
            self._fs.delete(self._path(f"{self.folder}/manifests/{n}.json"), False)
        heads = {p.rpartition("/")[0] for p in live}
        for name in TABLES:
            at = self._path(f"{self.folder}/{name}")
            for s in self._fs.listStatus(at) if self._fs.exists(at) else []:
                if f"{name}/{s.getPath().getName()}" not in heads:
                    self._fs.delete(s.getPath(), True)

    # -- tables

    def table(self, name: str, parts: list[int] | None = None) -> DataFrame | None:
        """A table, or those parts of it; None if it was never written."""
        entry = self._manifest().get(name)
        if entry is None:
            return None
        schema = StructType.fromJson(entry["schema"])
        paths = [f"{self.folder}/{p}" for k, p in sorted(entry["parts"].items(), key=lambda x: int(x[0])) if parts is None or int(k) in parts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write(self, touched: list[int] | None = None, **tables: DataFrame) -> None:
        """New versions of the tables' parts become current together. touched: the parts that the rows stand for; others
        stay as they are."""
        manifest = self._manifest()
        for name, df in tables.items():
            base = f"{name}/{uuid.uuid4().hex}"
            df.withColumn("_part", part_of(F.col("document_id"))).hint("rebalance", F.col("_part")).write.partitionBy("_part").parquet(f"{self.folder}/{base}")
            found = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/{base}"))]
            new = {n.partition("=")[2]: f"{base}/{n}" for n in found if n.startswith("_part=")}
            old = manifest.get(name, {}).get("parts", {}) if touched is not None else {}
            manifest[name] = {"schema": json.loads(df.schema.json()), "parts": {k: p for k, p in old.items() if int(k) not in (touched or [])} | new}
        self._commit(manifest)

    def _touched(self, documents: DataFrame) -> list[int]:
        return [r.p for r in documents.select(part_of(F.col("document_id")).alias("p")).distinct().collect()]  # PARTS at most

    def add(self, documents: DataFrame, elements: DataFrame, vectors: DataFrame | None = None, replace: bool = False) -> None:
        """Upsert all; elements without their document are refused, and vectors of another embedding space. Documents keep
        created_at, elements all but four columns.

        replace: what was stored before of these documents' elements and vectors goes."""
        touched = self._touched(documents.select("document_id").union(elements.select("document_id")))
        old_d, old_e, old_v = (self.table(n, touched) for n in TABLES)
        if "fingerprint" in documents.columns:
            spaces = {r.fingerprint for r in documents.select("fingerprint").distinct().limit(3).collect()} | self.spaces()
            if len(spaces) > 1:
                raise ValueError("vectors of different embedding spaces: " + ", ".join(sorted(map(str, spaces))))
        if replace:
            keys = documents.select("document_id").distinct()
            old_e, old_v = (t.join(keys, "document_id", "left_anti").select(t.columns) if t is not None else None for t in (old_e, old_v))
        all_d = upsert(old_d, documents, "document_id", [c for c in documents.columns if c != "created_at"]) if old_d is not None else documents
        if not orphans(elements, all_d).isEmpty():
            raise ValueError("an element's document is missing")
        all_e = upsert(old_e, elements, "element_id", REPLACED) if old_e is not None else elements
        tables = {"documents": all_d, "elements": all_e}
        if vectors is not None:
            tables["vectors"] = upsert(old_v, vectors, "element_id", [c for c in vectors.columns if c != "element_id"]) if old_v is not None else vectors
        self.write(touched, **tables)

    def delete(self, document_id: str) -> int:
        """Remove a document with its elements and vectors; the number of elements removed."""
        touched = self._touched(self.spark.createDataFrame([(document_id,)], "document_id string"))
        found = {n: t for n in TABLES if (t := self.table(n, touched)) is not None}
        gone = found["elements"].filter(F.col("document_id") == document_id).count() if "elements" in found else 0
        self.write(touched, **{n: t.filter(F.col("document_id") != document_id) for n, t in found.items()})
        return gone

    # -- lookups

    def spaces(self) -> set[str]:
        """Fingerprints of the stored documents' embedding spaces; one, or none, unless files were changed by hand."""
        d = self.table("documents")
        return set() if d is None or "fingerprint" not in d.columns else {r.fingerprint for r in d.select("fingerprint").distinct().limit(3).collect()}

    def has_document(self, document_id: str) -> bool:
        part = self._touched(self.spark.createDataFrame([(document_id,)], "document_id string"))
        d = self.table("documents", part)
        return d is not None and not d.filter(F.col("document_id") == document_id).isEmpty()

    def get_elements(self, element_ids: list[str]) -> DataFrame | None:
        """The elements of these ids, in no order; none for an empty list. A short list is pushed into the scan."""
        e = self.table("elements")
        if e is None:
            return None
        if len(element_ids) <= retrieval.PUSHED:
            return e.filter(F.col("element_id").isin(element_ids))
        wanted = self.spark.createDataFrame([(i,) for i in set(element_ids)], "element_id string")
        return e.join(wanted, "element_id", "left_semi")

    def count_elements(self, document_id: str | None = None) -> int:
        e = self.table("elements")
        return 0 if e is None else (e if document_id is None else e.filter(F.col("document_id") == document_id)).count()

    def list_documents(self) -> DataFrame | None:
        d = self.table("documents")
        return None if d is None else listed(d, self.table("elements"))

    def find_by_caption_reference(self, text: str, document_ids: list[str] | None = None) -> list[str]:
        """Ids of elements whose caption names a figure or table that text names, in order."""
        e = self.table("elements")
        if e is None:
            return []
        asked = self.spark.createDataFrame([(0, text, document_ids or [])], "qid long, question string, document_ids array<string>")
        asked = asked.select("qid", "document_ids", references(F.col("question")).alias("refs"))
        return [r.element_id for r in retrieval.by_reference(e, asked).select("element_id").orderBy("element_id").collect()]
