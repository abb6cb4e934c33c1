from __future__ import annotations

import io
import json
from datetime import date
from types import SimpleNamespace
from wsgiref.util import setup_testing_defaults
from wsgiref.validate import validator

import pytest

from jobweave import web
from jobweave.serving import application


def fail(*_):
    raise RuntimeError("secret")


PAGES = SimpleNamespace(
    search=lambda form: {"tab": "search", "form": form}, saved=lambda: {"tab": "saved"}, applied=lambda form: {"tab": "applied", "form": form}, insights=lambda: {"day": date(2024, 3, 1)},
    job=lambda number: {"job": number} if number == "j1" else None, status=lambda: ({"status": "degraded"}, 503),
)
ACTIONS = SimpleNamespace(**{n: (lambda body, n=n: ({"did": n, "body": body}, 200)) for n in ("save", "apply", "status", "note")}, draft=fail)


def ask(path, method="GET", body=None, token=None, header=None, query=""):
    environ: dict = {}
    setup_testing_defaults(environ)
    data = body if isinstance(body, bytes) else b"" if body is None else json.dumps(body).encode()
    environ |= {"PATH_INFO": path, "REQUEST_METHOD": method, "QUERY_STRING": query, "wsgi.input": io.BytesIO(data), "CONTENT_LENGTH": str(len(data))} | ({"HTTP_AUTHORIZATION": header} if header else {})
    said = []
    out = validator(application(PAGES, ACTIONS, web.Relay(None), token))(environ, lambda status, headers, exc=None: said.append((status, dict(headers))) or (lambda _: None))
    text = b"".join(out)
    out.close()
    return int(said[0][0][:3]), json.loads(text) if text else None


@pytest.mark.parametrize("path, query, status, body", [
    ("/", "q=data&page=2", 200, {"tab": "search", "form": {"q": "data", "page": "2"}}), ("/saved", "", 200, {"tab": "saved"}), ("/insights", "", 200, {"day": "2024-03-01"}), ("/job/j1", "", 200, {"job": "j1"}),
    ("/job/none", "", 404, {"error": "No such job."}), ("/status", "", 503, {"status": "degraded"}), ("/healthz", "", 200, {"status": "ok"}), ("/nowhere", "", 404, {"error": "No such page."}), ("/api/save", "", 405, {"error": "This is an action: send a POST."}),
])
def test_pages(path, query, status, body):
    assert ask(path, query=query) == (status, body)


def test_actions():
    assert ask("/api/save", "POST", {"job_id": "j"}) == (200, {"did": "save", "body": {"job_id": "j"}})
    assert ask("/api/save", "POST", b"[1]")[0] == ask("/api/note", "POST", b"{")[0] == 400 and ask("/api/apply", "POST") == (200, {"did": "apply", "body": {}})
    assert ask("/api/none", "POST", {})[0] == 404 and ask("/", "POST", {})[0] == 405 and ask("/", "DELETE")[0] == 405 and ask("/api/chat", "POST", {"message": "x"})[0] == 501
    assert ask("/api/draft", "POST", {}) == (500, {"error": "The request failed."}) and ask("/", "HEAD") == (200, None)
    assert ask("/api/save", "POST", b" " * (1 << 20) + b"{}")[0] == 413


def test_a_token_guards_all_but_public_paths():
    assert ask("/saved", token="t")[0] == 401 and ask("/saved", token="t", header="bearer t")[0] == 200 and ask("/healthz", token="t")[0] == 200
    assert ask("/api/save", "POST", {}, token="", header="Bearer ")[0] == 401
