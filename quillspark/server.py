"""The store's browsing functions and questions as JSON over HTTP.

One driver serves small answers: listings, one document's concepts and indexes, one
page, one question at a time.  Every request opens the current state of the store.
"""
from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .sources import sinks

#: Questions of more bytes are refused.
MOST_BYTES = 1 << 20


class NotFound(LookupError):
    pass


def rows(df: DataFrame) -> list[dict]:
    """Rows as JSON has them."""
    return [json.loads(r) for r in df.toJSON().collect()]


def _one(df: DataFrame, what: str) -> dict:
    found = rows(df.limit(1))
    if not found:
        raise NotFound(f"{what} not found")
    return found[0]


def answer(spark: SparkSession, root: str, path: str, body: dict | None = None, config: api.Config | None = None, provider=None, generate=None):
    """What the path below ``/api`` asks for: ``bundles``, ``registry``, ``graph/all``,
    and below ``bundle/<document>``: nothing, ``concepts``, ``concept/<id>``, ``graph``,
    ``indexes``, ``page/<n>``; ``ask`` takes a body with ``query`` and ``scope``.
    Unknown paths, documents, concepts and pages raise NotFound."""
    parts = [unquote(p) for p in urlparse(path).path.split("/") if p]
    if parts[:1] != ["api"]:
        raise NotFound("unknown path")
    parts = parts[1:]
    if body is not None:
        if parts != ["ask"]:
            raise NotFound("unknown path")
        question, scope = body.get("query"), body.get("scope", "all")
        if not isinstance(question, str) or not question.strip():
            raise ValueError("query is required")
        if scope != "all" and not isinstance(scope, list):
            raise ValueError("scope is 'all' or a list")
        return api.ask(spark, root, question.strip(), scope, config, provider, generate)
    if parts == ["bundles"]:
        return {"bundles": rows(api.list_bundles(spark, root).orderBy("document_id"))}
    if parts == ["registry"]:
        return rows(api.registry_stats(spark, root))[0]
    if parts == ["graph", "all"]:
        nodes, links = api.merged_graph(spark, root)
        return {"nodes": rows(nodes.orderBy("idx")), "links": rows(links)}
    if len(parts) < 2 or parts[0] != "bundle":
        raise NotFound("unknown path")
    document, rest, state = parts[1], parts[2:], sinks.current_snapshot(spark, root)
    here = lambda t: state.read(spark, t).where(F.col("document_id") == document)
    own = _one(here("documents"), "document")
    if not rest:
        return {"document": own, "metadata": own.get("append_metadata", {})}
    if rest == ["concepts"]:
        return {"concepts": rows(here("concepts").orderBy("concept_id"))}
    if rest[0] == "concept" and len(rest) == 2:
        return _one(here("concepts").where(F.col("concept_id") == rest[1]), "concept")
    if rest == ["graph"]:
        return {"nodes": rows(here("concepts").select(F.col("concept_id").alias("id"), F.col("name").alias("label"))), "edges": rows(here("edges").drop("document_id"))}
    if rest == ["indexes"]:
        return {"indexes": {f"{k}_index": rows(v.drop("document_id")) for k, v in api.indexes(spark, root, document).items()}}
    if rest[0] == "page" and len(rest) == 2 and rest[1].isdigit():
        return _one(here("pages").where(F.col("page_number") == int(rest[1])), "page")
    raise NotFound("unknown path")


def make_server(spark: SparkSession, root: str, port: int = 8000, host: str = "127.0.0.1", **options) -> ThreadingHTTPServer:
    """A server of the store; ``options`` go to :func:`answer`."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, data, status: int = 200) -> None:
            text = json.dumps(data, indent=2, sort_keys=True, ensure_ascii=False).encode()
            self.send_response(status)
            for name, value in (("Content-Type", "application/json; charset=utf-8"), ("Content-Length", str(len(text))), ("Access-Control-Allow-Origin", "*"), ("Access-Control-Allow-Headers", "Content-Type")):
                self.send_header(name, value)
            self.end_headers()
            self.wfile.write(text)

        def _answer(self, body=None) -> None:
            try:
                self._send(answer(spark, root, self.path, body, **options))
            except (NotFound, FileNotFoundError) as e:
                self._send({"error": str(e)}, 404)
            except ValueError as e:
                self._send({"error": str(e)}, 400)
            except Exception as e:  # a request that fails must not end the server
                self._send({"error": type(e).__name__}, 500)

        def do_GET(self) -> None:
            self._answer()

        def do_OPTIONS(self) -> None:
            self._send({})

        def do_POST(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if size > MOST_BYTES:
                return self._send({"error": "the request is too long"}, 413)
            try:
                body = json.loads(self.rfile.read(size) or b"{}")
            except ValueError:
                return self._send({"error": "the body is no JSON"}, 400)
            if not isinstance(body, dict):
                return self._send({"error": "the body is no JSON object"}, 400)
            return self._answer(body)

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def serve(spark: SparkSession, root: str, port: int = 8000, **options) -> threading.Thread:
    """Serve in a thread of its own."""
    thread = threading.Thread(target=make_server(spark, root, port, **options).serve_forever, daemon=True)
    thread.start()
    return thread
