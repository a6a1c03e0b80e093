"""Settings, jobs, the engine from landing to answer, the command line and the HTTP surface."""

import json
import threading
import urllib.error
import urllib.request

import pytest
from pdf_maker import image, pdf, text

from quillon.operators.models import Embedder, ModelError
from quillon.service import cli, errors, http, logs
from quillon.service.engine import BLANK, NOTHING, Engine
from quillon.service.jobs import Jobs
from quillon.service.settings import Settings


def test_settings(tmp_path):
    (tmp_path / ".env").write_text("# note\nQUILLON_CHUNK_SIZE=900\nQUILLON_RETRIEVAL_K='3'\nQUILLON_DATA_DIR=\n")
    s = Settings.load({"quillon_retrieval_k": "5", "QUILLON_CORS_ORIGINS": "a, ,b"}, str(tmp_path / ".env"), str(tmp_path))
    assert (s.chunk_size, s.retrieval_k, s.cors_origins, s.data_dir) == (900, 5, ("a", "b"), str(tmp_path / "data"))
    for bad in ({"chunk_overlap": 1400}, {"min_region_area_ratio": 0.96}, {"retrieval_k": 26}, {"lexical_weight": 1.5}, {"embedding_batch": 0}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_jobs():
    jobs, go = Jobs(kept=2), threading.Event()

    def work(progress):
        progress(1, 3)
        go.wait(10)
        return "x"

    a, b = jobs.submit("a", work), jobs.submit("b", lambda progress: 1 / 0)
    go.set()
    jobs.close()
    assert (jobs.get(a.job_id).status, jobs.get(a.job_id).percent, jobs.get(a.job_id).result) == ("succeeded", 33, "x")
    assert (jobs.get(b.job_id).status, jobs.get(b.job_id).error) == ("failed", "division by zero")
    assert jobs.get("none") is None


def test_engine(spark, tmp_path, capsys):
    e = Engine(spark, Settings(data_dir=str(tmp_path / "data"), chunk_size=200, chunk_overlap=20, extractor_backend="plain"))
    assert e.ask(" ")["answer"] == BLANK and e.ask("anything")["answer"] == NOTHING and e.documents() is None
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.pdf").write_bytes(b"%PDF-1.4\n" + b"Alpha particles scatter widely in gold foil. " * 3 + b"\f" + b"Beta decay emits an electron from a neutron. " * 6)
    (folder / "b.pdf").write_bytes((folder / "a.pdf").read_bytes())
    (folder / "c.pdf").write_bytes(b"zip")
    (folder / "d.pdf").write_bytes(b"%PDF-1.4\n")
    seen = []
    report = e.ingest(str(folder), progress=lambda *x: seen.append(x))
    assert (report["n_documents"], report["n_bad_files"], report["n_without_text"]) == (1, 1, 1) and seen[-1] == (4, 4)
    row = e.documents().first()
    assert (row.filename, row.pages, row.element_count) == ("a.pdf", 2, report["n_elements"])
    again = e.ingest(str(folder))
    assert (again["n_documents"], again["n_skipped"]) == (0, 1) and [(r.filename, r.skipped) for r in e.reports(again).collect()][0] == ("a.pdf", True)
    told = e.reports(report).collect()
    assert [(r.filename, r.warnings, r.failed) for r in told][1:] == [("c.pdf", ["not a PDF"], True), ("d.pdf", ["nothing could be read from it"], True)]
    assert cli.main(["ingest", str(folder)], e) == 0 and "known already" in capsys.readouterr().out
    assert (tmp_path / f"data/sources/{row.document_id}.pdf").read_bytes() == (folder / "a.pdf").read_bytes()
    assert e.ingest(str(folder), force=True)["n_elements"] == e.documents().first().element_count
    found = e.ask("Which beta decay emits an electron?", k=2)
    assert [s["label"] for s in found["sources"]] == ["S1", "S2"] and found["sources"][0]["image_url"] is None
    assert found["answer"].startswith("[S1] (text, page ")
    assert e.ask("beta", document_ids=["none"])["answer"] == NOTHING and e.health()["status"] == "ok"
    assert cli.main(["ask", "beta decay", "-k", "1"], e) == 0 and cli.main(["delete", "none"], e) == 1
    assert cli.main(["delete", row.document_id], e) == 0 and "elements removed" in capsys.readouterr().out
    for bad, kind, status in (({"k": 26}, errors.InvalidInput, 422), ({"kinds": ["sound"]}, errors.InvalidInput, 422)):
        with pytest.raises(kind) as got:
            e.ask("x", **bad)
        assert errors.status_of(got.value) == status


def test_uploads_and_images(spark, tmp_path):
    e = Engine(spark, Settings(data_dir=str(tmp_path / "data"), max_upload_mb=1))
    for name, chunks, kind in (("a.txt", [b"x"], errors.WrongType), ("a.pdf", [b"x" * (1 << 20), b"x"], errors.TooLarge)):
        with pytest.raises(kind):
            e.accept(name, chunks)
    assert not list((tmp_path / "data").rglob("*.pdf"))
    e.accept("../../b.PDF", [b"%PDF-", b"1"])
    assert [p.read_bytes() for p in (tmp_path / "data/landing").rglob("*.PDF")] == [b"%PDF-1"]
    (tmp_path / "data/images").mkdir(parents=True)
    (tmp_path / "data/images/a.png").write_bytes(b"x")
    (tmp_path / "data/secret").write_bytes(b"x")
    paths = {"in": "images/a.png", "out": "images/../secret", "gone": "images/b.png"}
    rows = [(k, f"{tmp_path}/data/{v}") for k, v in paths.items()]
    e.store.write(elements=spark.createDataFrame([("d", *r) for r in rows], "document_id string, element_id string, image_path string"))
    assert e.image_path("in").endswith("images/a.png")
    for name in ("out", "gone", "none"):
        with pytest.raises(errors.NotFound):
            e.image_path(name)


def asked_of(seen):
    def call(prompt, images, system):
        if "UNREADABLE" in prompt:  # the prompts for elements say so
            return "TABLE:\n| year | rate |\n| 2019 | 1.5 |\nSUMMARY: wear by year" if "Markdown" in prompt else " A chart of yields. "
        with open(seen, "a") as out:
            out.write(json.dumps([prompt, images, system]) + "\n")
        return "the answer [S1]"

    return call


def test_engine_with_models(spark, tmp_path):
    """PDF pages to figures, tables and text, enriched, embedded by a provider, and an answer with images."""
    seen = str(tmp_path / "seen")
    provider = Embedder("letters", "26", lambda texts: [[t.lower().count(chr(97 + k)) + 0.01 for k in range(26)] for t in texts])
    e = Engine(spark, Settings(data_dir=str(tmp_path / "data"), min_chunk=10), complete=asked_of(seen), embedder=provider, render=lambda content, page, box: b"PNG of page %d" % page)
    chart = image(60, 100, 260, 240) + text(60, 262, "Figure 1. Yield by year")
    table = b"".join(text(320, y, t) for y, t in ((100, "Table 2. Rates of wear"), (120, "year rate"), (140, "2019 1.5"), (160, "2020 2.5")))
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "r.pdf").write_bytes(pdf(chart + table + text(50, 400, "Prose about bearings, gears and their oil."), None))
    report = e.ingest(str(folder))
    (told,) = e.reports(report).collect()
    assert (told.pages, told.text_chunks, told.tables, told.figures, told.any_visual) == (2, 1, 1, 1, True) and told.warnings[0].startswith("page 2: ")
    stored = {r.kind: r for r in e.store.table("elements").collect()}
    assert stored["figure"].summary == "A chart of yields." and stored["table"].table_markdown == "| year | rate |\n| 2019 | 1.5 |"
    assert open(e.image_path(stored["figure"].element_id), "rb").read() == b"PNG of page 1"
    found = e.ask("What does table 2 say of wear?", k=3)
    assert found["answer"] == "the answer [S1]" and found["images_sent"] == 2
    shown = {s["kind"]: s for s in found["sources"]}
    assert shown["table"]["table_markdown"].startswith("| year") and shown["figure"]["image_url"] and shown["text"]["image_url"] is None
    prompt, images, system = json.loads(open(seen).read().splitlines()[-1])
    assert images[0].startswith("data:image/png;base64,") and "Images attached, in this order" in prompt and system
    assert e.health(models=True)["embedding_dimension"] == 26
    other = Engine(spark, Settings(data_dir=str(tmp_path / "data")))
    assert other.health()["status"] == "degraded"
    with pytest.raises(errors.Misconfigured):
        other.ask("anything")
    with pytest.raises(errors.Misconfigured):
        Engine(spark, Settings(data_dir=str(tmp_path / "data"), embedding_provider="local"))
    e.model.call = lambda *a: 1 / 0
    with pytest.raises(errors.UpstreamError):
        e.ask("anything")
    assert errors.status_of(ModelError("x")) == 502
    e.delete(told.document_id)
    assert not list((tmp_path / "data/images").rglob("*.png"))


def test_http(spark, tmp_path):
    e = Engine(spark, Settings(data_dir=str(tmp_path / "data"), extractor_backend="plain", max_upload_mb=1, cors_origins=("http://a",)))
    with http.server(e, port=0) as bound:
        threading.Thread(target=bound.serve_forever, daemon=True).start()
        at = "http://{}:{}".format(*bound.server_address[:2])

        def call(method, path, body=None):
            request = urllib.request.Request(at + path, data=body, method=method, headers={"Origin": "http://a"})
            try:
                with urllib.request.urlopen(request, timeout=120) as answer:
                    assert answer.headers["Access-Control-Allow-Origin"] == "http://a"
                    raw = answer.read()
                    return answer.status, json.loads(raw) if raw else None
            except urllib.error.HTTPError as error:
                return error.code, json.loads(error.read())

        assert call("GET", "/health")[1]["status"] == "ok" and call("GET", "/documents") == (200, [])
        assert call("POST", "/documents?filename=a.txt", b"x")[0] == 415 and call("GET", "/none")[0] == 404
        status, job = call("POST", "/documents?filename=a.pdf", b"%PDF-1.4\nGears turn slowly in cold oil, and bearings wear unevenly.")
        assert status == 202
        e.jobs.close()  # waits for the job
        status, job = call("GET", f"/jobs/{job['job_id']}")
        assert (job["status"], job["percent"], job["result"]["n_documents"]) == ("succeeded", 100, 1) and call("GET", "/jobs/none")[0] == 404
        (document,) = call("GET", "/documents")[1]
        assert document["filename"] == "a.pdf" and "fingerprint" not in document and document["created_at"].endswith("Z")
        assert call("POST", "/ask", b"{}")[0] == 422 and call("POST", "/ask", b"{")[0] == 422 and call("POST", "/ask", json.dumps({"question": "x", "k": 99}).encode())[0] == 422
        assert "Gears" in call("POST", "/ask", json.dumps({"question": "What of gears?"}).encode())[1]["answer"]
        assert call("GET", "/elements/none/image")[0] == 404
        assert call("DELETE", f"/documents/{document['document_id']}") == (204, None) and call("DELETE", "/documents/none")[0] == 404
        bound.shutdown()


def test_logs_and_help(capsys):
    log = logs.configure("warning")
    assert log is logs.configure("INFO") and [h.name for h in log.handlers].count(logs.NAME) == 1
    with pytest.raises(SystemExit):
        cli.main(["--help"])
    assert "serve" in capsys.readouterr().out
