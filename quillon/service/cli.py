"""python -m quillon.service.cli ingest FOLDER | ask QUESTION | documents | delete ID | health | serve"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from quillon.operators.models import ModelError
from quillon.service import http
from quillon.service.engine import Engine
from quillon.service.errors import EngineError
from quillon.service.settings import Settings
from quillon.sources.extract import ExtractionError


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quillon", description=__doc__)
    sub = out.add_subparsers(dest="command", required=True)
    ingest = sub.add_parser("ingest", help="take in the PDF files of a folder")
    ingest.add_argument("folder")
    ingest.add_argument("--force", action="store_true", help="take known contents in again")
    ingest.add_argument("--backend")
    ask = sub.add_parser("ask", help="answer a question from what was taken in")
    ask.add_argument("question")
    ask.add_argument("-k", type=int, help="number of sources")
    ask.add_argument("--document", action="append", default=[])
    ask.add_argument("--kind", action="append", default=[])
    sub.add_parser("documents", help="list what was taken in")
    sub.add_parser("delete", help="remove a document").add_argument("document_id")
    sub.add_parser("health", help="tell whether the index and the models can be used").add_argument("--models", action="store_true")
    serve = sub.add_parser("serve", help="answer over HTTP")
    serve.add_argument("--host", default="127.0.0.1")
    serve.add_argument("--port", type=int, default=8000)
    return out


def shown_answer(found: dict) -> str:
    """An answer with its sources, a line each."""
    lines = [found["answer"], ""] if found["sources"] else [found["answer"]]
    for x in found["sources"]:
        score = "named" if x["score"] is None else f"{x['score']:.3f}"
        lines.append(f"[{x['label']}] {x['kind']}, {x['document_id']}, page {x['page_number']}, {score}" + (f": {x['caption']}" if x["caption"] else ""))
    return "\n".join(lines)


def shown_reports(rows):
    """Lines about each file of an ingest."""
    for r in rows:
        counts = "known already" if r.skipped else "failed" if r.failed else f"{r.pages} pages, {r.text_chunks} text, {r.tables} tables, {r.figures} figures"
        yield f"{r.filename} {r.document_id}: {counts}"
        yield from (f"  {w}" for w in r.warnings)


def main(args: list[str] | None = None, engine: Engine | None = None) -> int:
    """0: done; 1: refused or failed, with the reason on the error stream; 130: interrupted."""
    given = parser().parse_args(args)
    try:
        engine = engine or Engine(SparkSession.builder.appName("quillon").getOrCreate(), Settings.load(file=".env"))
        if given.command == "ingest":
            tell = lambda done, total: print(f"step {done} of {total}", file=sys.stderr)
            found = engine.ingest(given.folder, given.force, tell, given.backend)
            for line in shown_reports(engine.reports(found).toLocalIterator()):
                print(line)
            print(f"{found['n_documents']} documents in {found['elapsed']} s")
        elif given.command == "ask":
            print(shown_answer(engine.ask(given.question, given.k, given.document, given.kind)))
        elif given.command == "documents":
            rows = engine.documents()
            for r in rows.toLocalIterator() if rows is not None else ():
                print(r.document_id, r.filename, r.pages, r.element_count, r.created_at)
        elif given.command == "delete":
            print(f"{engine.delete(given.document_id)} elements removed")
        elif given.command == "serve":
            http.serve(engine, given.host, given.port)
        else:
            state = engine.health(given.models)
            print(*(f"{k}: {v}" for k, v in state.items()), sep="\n")
            return int(state["status"] != "ok")
    except KeyboardInterrupt:
        return 130
    except (EngineError, ModelError, ExtractionError, ValueError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
