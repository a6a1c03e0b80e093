"""The engine over HTTP, by the standard library's threaded server.

GET /health, /documents, /jobs/ID, /elements/ID/image; POST /documents?filename=NAME (the file as body) and /ask (JSON);
DELETE /documents/ID. Errors answer with their status and {"detail": ...}."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import functions as F

from quillon.functions.text import media_type
from quillon.service.engine import Engine
from quillon.service.errors import EngineError, InvalidInput, NotFound, status_of
from quillon.service.jobs import Job

PIECE = 1 << 20


def job_row(job: Job) -> dict:
    return asdict(job) | {"percent": job.percent}


class Handler(BaseHTTPRequestHandler):
    engine: Engine
    protocol_version = "HTTP/1.1"

    def log_message(self, form: str, *args) -> None:
        self.engine.log.debug(form, *args)

    def _answer(self, status: int, body: bytes = b"", kind: str = "application/json") -> None:
        self.send_response(status)
        origin = self.headers.get("Origin")
        if origin and origin in self.engine.settings.cors_origins:
            for name, value in (("Origin", origin), ("Methods", "GET, POST, DELETE"), ("Headers", "Content-Type")):
                self.send_header(f"Access-Control-Allow-{name}", value)
        if body:
            self.send_header("Content-Type", kind)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def _json(self, value, status: int = 200) -> None:
        self._answer(status, json.dumps(value, default=str).encode())

    def _body(self) -> Iterator[bytes]:
        left = int(self.headers.get("Content-Length") or 0)
        while left > 0 and (piece := self.rfile.read(min(PIECE, left))):
            left -= len(piece)
            yield piece

    def _route(self) -> None:
        at = urlsplit(self.path)
        parts = [unquote(p) for p in at.path.strip("/").split("/")]
        asked = {k: v[-1] for k, v in parse_qs(at.query).items()}
        engine, method = self.engine, self.command
        if method == "OPTIONS":
            return self._answer(204)
        match method, *parts:
            case "GET", "health":
                return self._json(engine.health())
            case "GET", "documents":
                rows = engine.documents()
                return self._json([] if rows is None else [r.asDict() for r in rows.toLocalIterator()])
            case "POST", "documents":
                job = engine.submit_upload(asked.get("filename", ""), self._body(), asked.get("force") in ("1", "true"))
                return self._json(job_row(job), 202)
            case "DELETE", "documents", name:
                engine.delete(name)
                return self._answer(204)
            case "GET", "jobs", name:
                return self._json(job_row(engine.job(name)))
            case "POST", "ask":
                try:
                    given = json.loads(b"".join(self._body()) or b"{}")
                    if not isinstance(given, dict) or not isinstance(given.get("question"), str) or not given["question"]:
                        raise ValueError("a question is needed")
                except ValueError as error:
                    raise InvalidInput(str(error)) from error
                return self._json(engine.ask(given["question"], given.get("k"), given.get("document_ids") or (), given.get("kinds") or ()))
            case "GET", "elements", name, "image":
                path = engine.image_path(name)
                row = engine.spark.read.format("binaryFile").load(path).select("content", media_type(F.col("path")).alias("kind")).first()
                return self._answer(200, bytes(row.content), row.kind)
        raise NotFound(at.path)

    def _handle(self) -> None:
        try:
            self._route()
        except Exception as error:
            known = isinstance(error, EngineError)
            self.engine.log.log(20 if known else 40, "%s %s: %s", self.command, self.path, error)
            self.close_connection = True  # a body may be unread
            self._json({"detail": str(error) if known else type(error).__name__}, status_of(error))

    do_GET = do_POST = do_DELETE = do_OPTIONS = _handle


def server(engine: Engine, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    return ThreadingHTTPServer((host, port), type("Bound", (Handler,), {"engine": engine}))


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 8000) -> None:
    """Until interrupted; jobs that run are waited for."""
    with server(engine, host, port) as bound:
        engine.log.info("listening on %s:%s", *bound.server_address[:2])
        try:
            bound.serve_forever()
        finally:
            engine.jobs.close()
