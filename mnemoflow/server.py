"""A small HTTP server over a memory: GET /health, /stats; POST /search, /batch_search, /add. Bad requests get 422."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from mnemoflow.memory import MOST_BATCH_RESULTS, MOST_QUERIES, Memory, check_request

OPTIONS = ("project", "source", "rerank", "use_hyde", "candidates")


def answer(memory: Memory, method: str, path: str, body: dict) -> tuple[int, dict]:
    """Status and answer of one request."""
    try:
        if (method, path) == ("GET", "/health"):
            return 200, {"status": "ok", "backend": memory.embedder.backend, "total": memory.stats()["total"]}
        if (method, path) == ("GET", "/stats"):
            return 200, memory.stats()
        options = {k: body[k] for k in OPTIONS if body.get(k) is not None}
        if (method, path) == ("POST", "/search"):
            check_request(body.get("query", ""), int(body.get("top_k", 5)), int(body.get("candidates", 20)))
            return 200, {"results": memory.search(body["query"], int(body.get("top_k", 5)), **options)}
        if (method, path) == ("POST", "/batch_search"):
            queries = body.get("queries") or []
            if not 1 <= len(queries) <= MOST_QUERIES:
                raise ValueError(f"1 to {MOST_QUERIES} queries")
            for q in queries:
                check_request(q, int(body.get("top_k", 5)), int(body.get("candidates", 20)), MOST_BATCH_RESULTS)
            return 200, {"results": memory.batch_search(queries, int(body.get("top_k", 5)), **options)}
        if (method, path) == ("POST", "/add"):
            if not (body.get("text") or "").strip():
                raise ValueError("the text is empty")
            return 200, {"decisions": memory.add(body["text"], body.get("source"), body.get("project"))}
    except (ValueError, TypeError) as e:
        return 422, {"error": str(e)}
    return 404, {"error": "no such path"}


def serve(memory: Memory, port: int = 8765) -> None:
    lock = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def _do(self, method: str) -> None:
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                body = json.loads(raw) if raw else {}
            except ValueError:
                body = {}
            with lock:
                status, found = answer(memory, method, self.path, body)
            data = json.dumps(found, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self._do("GET")

        def do_POST(self) -> None:
            self._do("POST")

    ThreadingHTTPServer(("127.0.0.1", port), Handler).serve_forever()
