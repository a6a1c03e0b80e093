"""The document-retrieval operators: oracles over the driver's tables, and properties."""

import os
import random
import statistics

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import chunking, context, enrich, geometry, models, pages, retrieval
from quillon.operators.store import Store
from quillon.plans import queries as Q
from quillon.plans import views as V
from quillon.sources import extract, files
from quillon.streaming import ingest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for name in os.listdir(DATA):
        db.execute(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return db


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_oracle(spark, duck, name):
    got, want = Q.QUERIES[name](spark, DATA).toPandas(), duck.execute(Q.SQL[name]).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rows = lambda df: sorted(map(tuple, df[names].astype(str).values.tolist()))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_runs(spark, name):
    assert Q.QUERIES[name](spark, DATA).count() > 0


def test_clusters_do_not_depend_on_order():
    rng = random.Random(1)
    for _ in range(50):
        boxes = [[x := rng.random() * 200, y := rng.random() * 200, x + rng.random() * 20, y + rng.random() * 20, 1, False] for _ in range(30)]
        want = geometry.merge_boxes(boxes, 5)
        rng.shuffle(boxes)
        assert geometry.merge_boxes(boxes, 5) == want == geometry.merge_boxes(want, 5)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "bc", " ", "\n", "\n\n", ". ", "word ", "x" * 30, "é"]), max_size=80), st.integers(20, 60), st.integers(0, 19))
def test_recursive_chunks(parts, size, overlap):
    """Pieces lie in the text in order, are short enough, and leave out white space only."""
    text = "".join(parts)
    out = chunking.recursive(text, size, overlap)
    assert all(text[a : a + len(p)] == p == p.strip() and 0 < len(p) <= size for a, p in out)
    held = {i for a, p in out for i in range(a, a + len(p))}
    assert all(ch.isspace() or i in held for i, ch in enumerate(text))
    assert all(a <= b for (a, _), (b, _) in zip(out, out[1:], strict=False))


def test_recursive_chunks_prefer_coarse_cuts():
    assert [p for _, p in chunking.recursive("One two three.\n\nFour five six.\n\nSeven.", 26, 5)] == ["One two three.", "Four five six.\n\nSeven."]
    pieces = chunking.recursive("alpha beta gamma delta epsilon zeta", 18, 8)
    assert all(set(p.split()) & set(q.split()) for (_, p), (_, q) in zip(pieces, pieces[1:], strict=False))


def test_references_and_captions(spark):
    cases = {"Figure 13": "fig:13", "see Fig. 13. and figure13": "fig:13", "Table A.5 and exhibit 2": "exhibit:2,table:a.5", "nothing": ""}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.v for r in df.select("t", F.array_join(F.array_sort(T.references(F.col("t"))), ",").alias("v")).collect()} == cases


def brute_context(rows, budget, images):
    """rows: (rank, kind, page, caption, text, image) -> (blocks, context, images, labels)."""
    out, sent, labels = [], [], []
    for n, (_, kind, page, caption, text, image) in enumerate(sorted(rows, key=lambda r: r[0]), 1):
        body = (text or "").strip()
        if caption and caption not in body:
            body = f"{caption}\n{body}".strip()
        if len(body) > budget:
            body = body[:budget].rstrip() + " ..."
        budget -= len(body)
        if image and kind != "text" and len(sent) < images:
            sent.append(image)
            labels.append(f"S{n}")
            body = f"{body}\n{context.ATTACHED}".strip()
        out.append(f"[S{n}] ({kind}{'' if page is None else f', page {page}'})\n{body}".strip())
        if budget <= 0:
            break
    return len(out), "\n\n".join(out), sent, labels


def test_contexts_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for q in range(150):
        for r in range(rng.randint(1, 7)):
            text = rng.choice([None, "", "x" * rng.randint(1, 90), "a b " + " " * rng.randint(0, 40) + "c" * rng.randint(0, 60), "Fig. 1. cap and more"])
            rows.append((q, r, rng.choice(["text", "table", "figure"]), rng.choice([None, 4]), rng.choice([None, "", "Fig. 1. cap"]), text, rng.choice([None, f"i{q}.{r}"])))
    df = spark.createDataFrame(rows, "qid long, rank int, kind string, page_number long, caption string, text string, image_path string")
    for budget, images in ((100, 2), (35, 1), (6000, 0)):
        got = {r.qid: (r.n_blocks, r.context, r.images, r.labels) for r in context.contexts(df, budget, images).collect()}
        assert got == {q: brute_context([r[1:] for r in rows if r[0] == q], budget, images) for q in range(150)}
    asked = spark.createDataFrame([(0, " why? ")], "qid long, question string")
    prompt = context.prompts(context.contexts(df.filter("qid = 0"), 6000, 9), asked).first().prompt
    assert prompt.startswith("SOURCES\n[S1]") and prompt.endswith("QUESTION\nwhy?")


def bind_by_hand(regions, blocks):
    """The nearest free caption of each region: regions and blocks are (x0, y0, x1, y1, ...)."""
    used, out = set(), []
    for r in sorted(regions, key=lambda r: (r[1], r[0], r[2], r[3])):
        best = None
        for n, b in enumerate(blocks):
            narrow = min(r[2] - r[0], b[2] - b[0])
            if n in used or not b[4] or narrow <= 0 or min(r[2], b[2]) - max(r[0], b[0]) <= 0.35 * narrow:
                continue
            away = b[1] - r[3] if b[1] >= r[3] else r[1] - b[3] if b[3] <= r[1] else 0
            if away < 72 and (best is None or away < best[0]):
                best = away, n
        if best:
            used.add(best[1])
        out.append((r[:4], best and blocks[best[1]][4]))
    return out


def test_captions_bind_as_by_hand(spark):
    rng = random.Random(5)
    regions, blocks, want = [], [], set()
    for page in range(60):
        own = [(x := float(rng.randint(0, 8) * 60), y := float(rng.randint(0, 12) * 30), x + rng.choice([60, 200]), y + rng.choice([40, 90])) for _ in range(rng.randint(1, 6))]
        text = [(x := float(rng.randint(0, 8) * 60), y := float(rng.randint(0, 14) * 30), x + rng.choice([50, 300]), y + 12, rng.choice(["", f"Table {k}. t", f"Fig. {k}: f"])) for k in range(rng.randint(1, 8))]
        own = list(dict.fromkeys(own))
        regions += [(f"d{page % 3}", page, *r, None, "figure", False) for r in own]
        blocks += [(f"d{page % 3}", page, k, *b[:4], b[4] or "plain text") for k, b in enumerate(text)]
        want |= {(page, *r, c) for r, c in bind_by_hand(own, text)}
    sides = "x0 double, y0 double, x1 double, y1 double"
    rows = geometry.bind_captions(spark.createDataFrame(regions, f"document_id string, page_number long, {sides}, caption string, kind string, from_caption boolean"), spark.createDataFrame(blocks, f"document_id string, page_number long, block_no long, {sides}, text string")).collect()
    assert {(r.page_number, r.x0, r.y0, r.x1, r.y1, r.caption) for r in rows} == want and len(rows) == len(regions)
    assert all(r.kind == ("table" if (r.caption or "").startswith("Table") else "figure") for r in rows)


def test_free_tables_by_hand(spark):
    tables, figures = (Q.anchored(spark, DATA).collect(), V.figures(spark, DATA).filter("box_no % 3 = 0").collect())
    touch = lambda a, b: a.x1 >= b.x0 and b.x1 >= a.x0 and a.y1 >= b.y0 and b.y1 >= a.y0
    want, kept = set(), []
    for t in sorted(tables, key=lambda t: (t.page_number, t.y0, t.x0, t.cap)):
        if not any(touch(t, f) for f in figures if f.page_number == t.page_number) and not any(touch(t, k) for k in kept if k.page_number == t.page_number):
            kept.append(t)
            want.add((t.page_number, t.cap))
    assert {tuple(r) for r in Q.untouched(spark, DATA).collect()} == want and len(want) < len(tables)


def test_clusters_by_hand(spark):
    """Clusters equal those of merging any two near boxes until none are left, page by page."""
    rows = Q.QUERIES["cluster_boxes"](spark, DATA).collect()
    found = {}
    for r in rows:
        found.setdefault(r.page_number, []).append((r.x0, r.y0, r.x1, r.y1, r.primitive_count, r.has_raster))
    boxes = {}
    for r in geometry.meaningful(V.prims(spark, DATA)).collect():
        boxes.setdefault(r.page_number, []).append((r.x0, r.y0, r.x1, r.y1, 1, r.is_raster))
    for page, own in list(boxes.items())[:40]:
        merged = True
        while merged:
            merged = False
            for i in range(len(own)):
                for j in range(i):
                    a, b = own[i], own[j]
                    if a[2] + 5 >= b[0] and b[2] + 5 >= a[0] and a[3] + 5 >= b[1] and b[3] + 5 >= a[1]:
                        own = [o for k, o in enumerate(own) if k not in (i, j)] + [(min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]), a[4] + b[4], a[5] or b[5])]
                        merged = True
                        break
                if merged:
                    break
        assert sorted(own) == sorted(found[page])


def test_anchored_table_holds_its_caption(spark):
    """All gaps count for the median, the caption's own box is part of the table, the page cuts it."""
    rows = [(0, 50.0, 100.0, 300.0, 112.0, "Table 3. Yields"), (1, 60.0, 116.0, 280.0, 130.0, "a 1"), (2, 60.0, 128.0, 280.0, 142.0, "b 2"), (3, 60.0, 146.0, 280.0, 160.0, "c 3"), (4, 60.0, 300.0, 280.0, 312.0, "far prose")]
    blocks = spark.createDataFrame([("d", 1, n, x0, y0, x1, y1, t) for n, x0, y0, x1, y1, t in rows], "document_id string, page_number long, block_no long, x0 double, y0 double, x1 double, y1 double, text string")
    page = spark.createDataFrame([("d", 1, 290.0, 500.0)], "document_id string, page_number long, width double, height double")
    t = geometry.anchored_tables(blocks, page).first()
    assert (t.x0, t.y0, t.x1, t.y1, t.n_rows, t.caption) == (50.0, 100.0, 290.0, 160.0, 3, "Table 3. Yields")
    assert statistics.median([-2, 4, 140]) == 4


def test_search_in_parts(spark, monkeypatch):
    """Questions in several blocks, with filters, give what one comparison of all gives."""
    rng = np.random.default_rng(2)
    x, q = rng.standard_normal((300, 8)), rng.standard_normal((23, 8))
    vectors = spark.createDataFrame([(f"e{i:03d}", f"d{i % 4}", ("text", "table")[i % 2], v.tolist()) for i, v in enumerate(x)], "element_id string, document_id string, kind string, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([(i, v.tolist(), ["d1", "d2"] if i % 3 == 0 else [], ["table"] if i % 5 == 0 else None) for i, v in enumerate(q)], "qid long, q_embedding array<double>, document_ids array<string>, kinds array<string>")
    for size in (4, 100):
        monkeypatch.setattr(retrieval, "BLOCK", size)
        got = {}
        for r in retrieval.dense_topk(vectors, asked, 7).orderBy("qid", "pos").collect():
            got.setdefault(r.qid, []).append(r.element_id)
        for i, v in enumerate(q):
            sound = [k for k in range(300) if (i % 3 or k % 4 in (1, 2)) and (i % 5 or k % 2)]
            assert got[i] == [f"e{k:03d}" for k in sorted(sound, key=lambda k: (-round(float(x[k] @ v), 9), k))[:7]]
    assert retrieval.dense_topk(vectors, asked.limit(0), 7).count() == 0


class Refused(Exception):
    def __init__(self, message, status=None, retry_after=None):
        super().__init__(message)
        self.status, self.retry_after = status, retry_after


@pytest.mark.parametrize(("error", "kind"), [(Refused(m, s), k) for m, s, k in Q.MESSAGES] + [(TimeoutError("x"), "transient"), (ConnectionResetError(), "transient"), (ValueError("no"), "fatal")])
def test_error_kinds(error, kind):
    assert models.kind_of(error) == kind


def test_degrading_and_retries():
    asked, waits = [], []

    def call(text, images, system):
        asked.append((len(text), len(images)))
        if len(asked) == 1:
            raise Refused("rate limit", 429, "3")
        if len(asked) == 2:
            raise Refused("rate limit: try again in 500ms")
        if len(asked) == 3:
            raise TimeoutError
        if len(images) > 1:
            raise Refused("this model supports up to 1 image")
        if images or len(text) > 1000:
            raise Refused("request too large")
        return [{"type": "text", "text": " done "}, {"type": "image"}]

    model = models.ChatModel(call, sleep=waits.append)
    assert model.complete("x" * 3000, ["a", "b", "c", "d"]) == "done"
    assert waits[:3] == [4.0, 1.5, 8.0] and [n for _, n in asked] == [3, 3, 3, 3, 2, 1, 0, 0, 0, 0]
    with pytest.raises(models.ModelError):
        models.ChatModel(lambda *a: 1 / 0, sleep=waits.append).complete("x")
    tries = []
    with pytest.raises(models.ModelError):
        models.ChatModel(lambda *a: tries.append(1) or exec("raise TimeoutError"), retries=2, sleep=waits.append).complete("x")
    assert len(tries) == 3


def test_limiter_spaces_calls():
    now, slept = [0.0], []
    limiter = models.Limiter(2.0)
    for _ in range(3):
        limiter.wait(lambda: now[0], lambda s: slept.append(s) or now.__setitem__(0, now[0] + s))
    assert slept == [0.0, 2.0, 2.0]


def test_embedders(spark):
    named = models.Embedder("own", "m1", lambda texts: [[len(t), 3.0] for t in texts], batch=2)
    df = spark.createDataFrame([("abcd",), ("",), (None,)], "t string")
    got = [r.v for r in df.select(named.column(F.col("t")).alias("v")).collect()]
    assert got[0] == pytest.approx([0.8, 0.6]) and got[1] == got[2] == [0.0, 1.0]
    assert named.fingerprint == "own:m1" and named.dimension(spark) == 2 and models.Embedder().dimension(spark) == 32
    with pytest.raises(models.ModelError):
        models.Embedder("own", "m", lambda texts: 1 / 0).dimension(spark)


def test_replies_fall_back_by_row(spark):
    seen = "a b c"

    def call(text, images, system):
        if "bad" in text or images and "data:image/png" not in images[0]:
            raise models.ModelError("broken", 400)
        return f"of {len(images)} images"

    rows = [("1", "text", "bad passage", None, None, None), ("2", "text", seen, None, None, None), ("3", "figure", "t", "cap", "a.png", bytearray(b"x")), ("4", "table", "", "tcap", "a.png", None), ("5", "figure", "own", None, None, None)]
    df = spark.createDataFrame(rows, "element_id string, kind string, text string, caption string, image_path string, image binary")
    assert enrich.needs_model(df) and not enrich.needs_model(df.filter("kind = 'text'")) and enrich.needs_model(df.filter("kind = 'text'"), True)
    got = {r.element_id: r.summary for r in enrich.decide(enrich.replies(df, models.ChatModel(call, retries=0), True), True).collect()}
    assert got == {"1": "bad passage", "2": "of 0 images", "3": "of 1 images", "4": "of 0 images", "5": "own"}
    kept = enrich.replies(df, models.ChatModel(call, retries=0))
    assert kept.filter("kind = 'text' and reply is not null").count() == 0


ELEMENT = "element_id string, document_id string, kind string, text string, summary string, image_path string, caption string"


def test_store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    assert s.table("documents") is None and not s.has_document("d1") and s.count_elements() == 0 and s.get_elements(["e"]) is None
    doc = lambda i, n, t: spark.createDataFrame([(i, n, t)], "document_id string, filename string, created_at long")
    s.add(doc("d1", "a", 1), spark.createDataFrame([("e1", "d1", "text", "old", "old", None, None)], ELEMENT))
    s.add(doc("d1", "b", 2), spark.createDataFrame([("e1", "d1", "table", "new", "new", None, None), ("e2", "d1", "text", "x", "x", None, "Fig. 7: y")], ELEMENT))
    assert s.table("documents").first().asDict() == {"document_id": "d1", "filename": "b", "created_at": 1}
    e1 = s.table("elements").filter("element_id = 'e1'").first()
    assert (e1.kind, e1.text) == ("text", "new")
    with pytest.raises(ValueError):
        s.add(doc("d2", "c", 3), spark.createDataFrame([("e3", "none", "text", "x", "x", None, None)], ELEMENT))
    s.add(doc("d3", "c", 5), spark.createDataFrame([("e9", "d3", "figure", "z", "z", None, "Figure 7. z")], ELEMENT))
    again = Store(spark, f"file://{tmp_path}/store")
    assert again.has_document("d3") and not again.has_document("d2") and (again.count_elements(), again.count_elements("d1"), again.count_elements("none")) == (3, 2, 0)
    assert {r.element_id for r in again.get_elements(["e9", "e1", "none"]).collect()} == {"e1", "e9"} and again.get_elements([]).count() == 0
    assert again.find_by_caption_reference("see figure 7") == ["e2", "e9"] and again.find_by_caption_reference("fig 7", ["d3"]) == ["e9"]
    assert again.find_by_caption_reference("figure 70") == [] == again.find_by_caption_reference("none named")
    assert [(r.document_id, r.element_count) for r in again.list_documents().collect()] == [("d3", 1), ("d1", 2)]
    assert s.delete("d1") == 2 and s.count_elements() == 1 and s.delete("d3") == 1 and s.table("elements").count() == 0
    assert s.table("documents").columns == ["document_id", "filename", "created_at"] and s.delete("none") == 0


def test_store_survives_a_crash_and_cleans_up(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    none = spark.createDataFrame([], ELEMENT)
    for k in range(5):
        s.add(spark.createDataFrame([(f"d{k}", k)], "document_id string, created_at long"), none)
    assert s.table("documents").count() == 5
    names = sorted(p.name for p in (tmp_path / "store/manifests").iterdir() if p.suffix == ".json")
    assert names == ["4.json", "5.json"]
    # a write that never got to its manifest, or only to a part of one, changes nothing
    (tmp_path / "store/manifests/6.new").write_text("{")
    assert Store(spark, f"file://{tmp_path}/store").table("documents").count() == 5
    s.add(spark.createDataFrame([("d9", 9)], "document_id string, created_at long"), none)
    assert s.table("documents").count() == 6


def test_upsert_laws(spark):
    rng = random.Random(1)
    old = {rng.randint(0, 30): (rng.randint(0, 9), rng.randint(0, 9)) for _ in range(20)}
    new = [(rng.randint(0, 40), rng.randint(10, 19), rng.randint(10, 19), n) for n in range(25)]
    want = dict(old)
    for k, a, b, _ in new:
        want[k] = (a, old[k][1] if k in old else b)
    o = spark.createDataFrame([(k, *v) for k, v in old.items()], "k int, a int, b int")
    n = spark.createDataFrame(new, "k int, a int, b int, n int")
    from quillon.operators.store import upsert

    got = upsert(o, n, "k", ["a"], order="n")
    last = {k: (a, b) for k, a, b, _ in new}
    assert {r.k: (r.a, r.b) for r in got.collect()} == {k: (v if k in old and k not in last else (last[k][0], old[k][1]) if k in old else last[k]) for k, v in want.items()}
    assert sorted(map(tuple, upsert(got, got, "k", ["a"]).collect())) == sorted(map(tuple, got.collect()))


def test_embedding_spaces_are_not_mixed(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    none = spark.createDataFrame([], ELEMENT)
    doc = lambda i, f: spark.createDataFrame([(i, f, 1)], "document_id string, fingerprint string, created_at long")
    s.add(doc("d1", "a:1"), none)
    with pytest.raises(ValueError):
        s.add(doc("d2", "b:1"), none)
    assert s.spaces() == {"a:1"} and s.table("documents").count() == 1


def test_file_scan_and_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (folder / "b.pdf").write_bytes(b"%PDF-1.4 x")
    (folder / "c.pdf").write_bytes(b"PK zip")
    (folder / "sub").mkdir()
    (folder / "sub/e.pdf").write_bytes(b"%PDF-1.4 below")
    found = files.scan(spark, str(folder))
    assert {r.filename: r.status for r in found.collect()} == {"a.pdf": "ok", "b.pdf": "ok", "c.pdf": "not a PDF"}
    assert files.documents_of(found).first().n_files == 2
    store = Store(spark, f"file://{tmp_path}/store")
    for _ in range(2):
        ingest.run_once(spark, str(folder), store, str(tmp_path / "check"))
    assert store.table("documents").count() == 1
    (folder / "d.pdf").write_bytes(b"%PDF-1.4 other")
    (folder / "f.pdf").write_bytes(b"%PDF-1.4 x")
    ingest.run_once(spark, str(folder), store, str(tmp_path / "check"))
    assert {r.filename for r in store.table("documents").collect()} >= {"d.pdf"} and store.table("documents").count() == 2


def test_layout_backend():
    class Table:
        def __init__(self, text, metadata):
            self.text, self.metadata = text, metadata

    class Meta:
        def to_dict(self):
            return {"page_number": 2, "text_as_html": "<table>"}

    raw = [Table("cells", Meta()), {"category": "Image", "text": " ", "metadata": {"page_number": 1, "image_path": "i.png"}}, {"category": "Title", "text": " Head ", "metadata": None}, {"category": "Text", "text": " ", "metadata": {}}]
    found = extract.layout_pages(raw)
    assert [(p["page_number"], p["elements"]) for p in found] == [(0, [("text", "Head", None, "Title")]), (1, [("figure", "", "i.png", "Image")]), (2, [("table", "<table>", None, "Table")])]
    with pytest.raises(extract.ExtractionError):
        extract.backend("none")
    assert extract.backend(None) is extract.BACKENDS["pdf"]
