"""Requests over HTTP: ``GET /v1/<verb>?scope=..&text=..`` or the same fields as a JSON body."""

from __future__ import annotations

import hmac
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

from .session import VERBS, Session

MOST_BODY = 1 << 20


def answer(session: Session, method: str, target: str, headers: dict[str, str], body: bytes, key: str | None = None, counts: dict[str, int] | None = None) -> tuple[int, object]:
    """Status and JSON-able reply of one request; with a key, callers must bear it."""
    parts = urlsplit(target)
    path = parts.path.strip("/").removeprefix("v1/")
    if path == "healthz":
        return 200, {"ok": True}
    if key and not hmac.compare_digest(headers.get("authorization", ""), f"Bearer {key}"):
        return 401, {"error": "a bearer key is asked for"}
    if path == "metrics":
        return 200, dict(counts or {})
    if len(body) > MOST_BODY:
        return 413, {"error": "the body is too large"}
    verb = path.replace("recall_many", "recallmany").replace("_", "")
    if verb not in VERBS:
        return 404, {"error": f"no such verb: {path}"}
    try:
        given = dict(parse_qsl(parts.query)) | (json.loads(body) if body else {})
        scope, text = given.pop("scope", ""), given.pop("text", "")
        for n, v in given.items():
            given[n] = int(v) if isinstance(v, str) and v.isdigit() else v
        return 200, session.run(verb, scope, text, **given)
    except (ValueError, TypeError, AttributeError) as e:
        return 400, {"error": str(e)}


def server(session: Session, address: str, key: str | None = None) -> ThreadingHTTPServer:
    host, _, port = address.partition(":")
    counts: dict[str, int] = {}
    one = threading.Lock()  # a write is followed by its own reads

    class Handler(BaseHTTPRequestHandler):
        def _reply(self):
            size = int(self.headers.get("content-length") or 0)
            body = self.rfile.read(size) if size <= MOST_BODY else b" " * (MOST_BODY + 1)
            with one:
                status, reply = answer(session, self.command, self.path, {k.lower(): v for k, v in self.headers.items()}, body, key, counts)
                counts[f"status_{status}"] = counts.get(f"status_{status}", 0) + 1
            data = json.dumps(reply, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("content-type", "application/json")
            self.send_header("content-length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _reply

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host or "127.0.0.1", int(port or 0)), Handler)


def serve(session: Session, address: str, key: str | None = None) -> None:
    server(session, address, key).serve_forever()
