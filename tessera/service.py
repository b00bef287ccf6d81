"""The database over HTTP, with JSON bodies."""

from __future__ import annotations

import hmac
import json
import os
import re
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote

from tessera.database import Database

#: The environment variable with the key that writes must carry; unset: anyone may write.
KEY_VARIABLE = "TESSERA_API_KEY"


class HttpError(Exception):
    def __init__(self, status: int, message: str) -> None:
        super().__init__(message)
        self.status = status


def _need(body: dict, *names: str) -> list:
    missing = [n for n in names if n not in body]
    if missing:
        raise HttpError(400, f"missing field {missing[0]}")
    return [body[n] for n in names]


def _create(db: Database, body: dict) -> dict:
    name, dimension = _need(body, "name", "dimension")
    db.create_collection(name, int(dimension), int(body.get("max_cluster_size", 256)), int(body.get("graph_degree", 8)))
    return {"name": name, "dimension": dimension}


def _search(db: Database, name: str, body: dict) -> dict:
    vector, k = _need(body, "vector", "k")
    options = {o: int(body[o]) for o in ("entry_points", "ef_search", "probe_clusters") if body.get(o) is not None}
    found = db.search(name, vector, int(k), body.get("filter"), **options)
    return {"hits": found.hits, "stats": vars(found.stats)}


def _fetch(db: Database, name: str, doc_id: str) -> dict:
    found = db.fetch(name, doc_id)
    if found is None:
        raise HttpError(404, f"vector '{doc_id}' not found")
    return found


def _restore(db: Database, body: dict) -> dict:
    backup, name = _need(body, "backup_name", "collection")
    db.restore_collection(backup, name)
    return {"restored": True, "collection": name}


#: Method, path, whether a key is needed, and what is done: (db, parts of the path, body).
ROUTES = [
    ("GET", r"/healthz", False, lambda db, p, b: {"ok": True, "product": "tessera"}),
    ("POST", r"/collections", True, lambda db, p, b: _create(db, b)),
    ("POST", r"/collections/([^/]+)/vectors", True, lambda db, p, b: {"inserted": db.insert_batch(p[0], _need(b, "vectors")[0])}),
    ("GET", r"/collections/([^/]+)/vectors/([^/]+)", False, lambda db, p, b: _fetch(db, *p)),
    ("DELETE", r"/collections/([^/]+)/vectors/([^/]+)", True, lambda db, p, b: {"deleted": db.delete(*p)}),
    ("POST", r"/collections/([^/]+)/search", False, lambda db, p, b: _search(db, p[0], b)),
    ("POST", r"/collections/([^/]+)/compact", True, lambda db, p, b: {"compacted": True, "stats": db.compact_collection(p[0])}),
    ("GET", r"/collections/([^/]+)/stats", False, lambda db, p, b: {"stats": db.collection_stats(p[0])}),
    ("GET", r"/collections/([^/]+)/diagnostics", False, lambda db, p, b: {"diagnostics": db.collection_diagnostics(p[0])}),
    ("POST", r"/admin/collections/([^/]+)/backup", True, lambda db, p, b: {"backup_name": db.backup_collection(p[0])}),
    ("POST", r"/admin/collections/restore", True, lambda db, p, b: _restore(db, b)),
]


def handle(db: Database, method: str, path: str, body: bytes, key: str | None, given: str | None) -> tuple[int, dict]:
    """Status and answer of one request."""
    try:
        for verb, pattern, guarded, act in ROUTES:
            m = re.fullmatch(pattern, path)
            if not m or verb != method:
                continue
            if guarded and key and not hmac.compare_digest(given or "", key):
                raise HttpError(401, "missing or wrong API key")
            said = json.loads(body) if body else {}
            if not isinstance(said, dict):
                raise HttpError(400, "the body must be an object")
            return 200, act(db, [unquote(x) for x in m.groups()], said)
        raise HttpError(404, f"no route {method} {path} found")
    except HttpError as e:
        return e.status, {"error": str(e)}
    except Exception as e:
        return (404 if "not found" in str(e) else 400), {"error": str(e)}


def serve(db: Database, host: str = "127.0.0.1", port: int = 8080, key: str | None = None) -> ThreadingHTTPServer:
    """A server, not started yet: ``serve(...).serve_forever()``."""
    key = key if key is not None else os.environ.get(KEY_VARIABLE)

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            status, out = handle(db, self.command, self.path.partition("?")[0], self.rfile.read(size), key, self.headers.get("x-api-key"))
            data = json.dumps(out).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_DELETE = _answer

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
