"""The pages, actions and relay as one WSGI application that answers in JSON; any WSGI server runs it.

With a token, only public paths are open without it. A body must be a JSON object, and an answer never says more about a
failure than that there was one.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Iterable
from http import HTTPStatus
from typing import Any
from urllib.parse import parse_qsl

from .web import Actions, Pages, Relay, authorised

log = logging.getLogger(__name__)
MOST_BYTES = 1 << 20


def application(pages: Pages, actions: Actions, relay: Relay, token: str | None = None) -> Callable[[dict, Callable], Iterable[bytes]]:
    shown: dict[str, Callable[[dict], Any]] = {
        "/": pages.search, "/saved": lambda _: pages.saved(), "/applied": pages.applied, "/insights": lambda _: pages.insights(), "/chat": lambda _: {"tab": "chat"},
        "/healthz": lambda _: {"status": "ok"}, "/status": lambda _: pages.status(),
    }
    done: dict[str, Callable[[dict], tuple[dict, int]]] = {f"/api/{name}": getattr(actions, name) for name in ("save", "apply", "status", "note", "draft")} | {"/api/chat": relay.chat}

    def get(path: str, query: str) -> tuple[Any, int]:
        head, _, rest = path[1:].partition("/")
        if head == "job" and rest:
            found = pages.job(rest)
            return (found, 200) if found is not None else ({"error": "No such job."}, 404)
        if path not in shown:
            return {"error": "No such page."}, 404
        out = shown[path](dict(parse_qsl(query)))
        return out if isinstance(out, tuple) else (out, 200)

    def post(path: str, environ: dict) -> tuple[Any, int]:
        if path not in done:
            return {"error": "No such action."}, 404
        length = environ.get("CONTENT_LENGTH") or "0"
        if not length.isdigit() or int(length) > MOST_BYTES:
            return {"error": f"A body has at most {MOST_BYTES} bytes."}, 413
        try:
            body = json.loads(environ["wsgi.input"].read(int(length)) or b"{}")
        except ValueError:
            body = None
        return done[path](body) if isinstance(body, dict) else ({"error": "The body must be a JSON object."}, 400)

    def answer(environ: dict) -> tuple[Any, int]:
        method, path = environ.get("REQUEST_METHOD", "GET"), environ.get("PATH_INFO") or "/"
        if token is not None and not authorised(path, environ.get("HTTP_AUTHORIZATION"), token):
            return {"error": "A bearer token is needed."}, 401
        if method in ("GET", "HEAD"):
            return ({"error": "This is an action: send a POST."}, 405) if path in done else get(path, environ.get("QUERY_STRING", ""))
        if method == "POST":
            return ({"error": "This is a page: send a GET."}, 405) if path in shown else post(path, environ)
        return {"error": f"{method} is not served."}, 405

    def app(environ: dict, start: Callable) -> Iterable[bytes]:
        try:
            body, status = answer(environ)
        except Exception:
            log.exception("%s failed", environ.get("PATH_INFO"))
            body, status = {"error": "The request failed."}, 500
        text = json.dumps(body, default=str).encode()
        headers = [("Content-Type", "application/json; charset=utf-8"), ("Content-Length", str(len(text)))]
        start(f"{status} {HTTPStatus(status).phrase}", headers + ([("WWW-Authenticate", "Bearer")] if status == 401 else []))
        return [] if environ.get("REQUEST_METHOD") == "HEAD" else [text]

    return app
