"""What is asked of each board, and how an answer becomes a payload or an error that names its source.

A board is a row of REQUESTS: an address and its parameters, filled from a source spec. `Boards` turns specs into payloads
through an injected `send`, so a run needs no network in tests and any HTTP client will do in production.
"""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from .specs import paged


class FetchError(Exception):
    """A source could not be read; never the same as a source without postings."""


@dataclass(frozen=True)
class Request:
    url: str
    params: Mapping[str, Any] = field(default_factory=dict)
    headers: Mapping[str, str] = field(default_factory=dict, repr=False)
    #: sent as JSON by POST where there is one
    body: Mapping[str, Any] | None = None

    @property
    def address(self) -> str:
        return self.url + ("?" + urllib.parse.urlencode(self.params) if self.params else "")


@dataclass(frozen=True)
class Reply:
    status: int
    text: str


Send = Callable[[Request], Reply]
SECONDS = 10.0


def send(request: Request) -> Reply:
    """The standard library's client; redirects are followed."""
    data = None if request.body is None else json.dumps(request.body).encode()
    headers = {"User-Agent": "jobweave/1", "Accept": "application/json"} | ({"Content-Type": "application/json"} if data else {}) | dict(request.headers)
    try:
        with urllib.request.urlopen(urllib.request.Request(request.address, data, headers), timeout=SECONDS) as got:
            return Reply(got.status, got.read().decode(errors="replace"))
    except urllib.error.HTTPError as exc:
        return Reply(exc.code, exc.read().decode(errors="replace"))


@dataclass(frozen=True)
class Credentials:
    """Keys of the boards that want some; they show in no repr."""

    adzuna_id: str = ""
    adzuna_key: str = field(default="", repr=False)
    usajobs_email: str = ""
    usajobs_key: str = field(default="", repr=False)

    # Where the keys come from.
    NAMES = {"adzuna": {"adzuna_id": "ADZUNA_APP_ID", "adzuna_key": "ADZUNA_APP_KEY"}, "usajobs": {"usajobs_email": "USAJOBS_EMAIL", "usajobs_key": "USAJOBS_API_KEY"}}

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> Credentials:
        return cls(**{own: env.get(name, "") for names in cls.NAMES.values() for own, name in names.items()})

    def need(self, kind: str) -> None:
        lacking = [name for own, name in self.NAMES.get(kind, {}).items() if not getattr(self, own)]
        if lacking:
            raise FetchError(f"{kind} credentials missing: set {' and '.join(lacking)}")


def _given(**params: Any) -> dict[str, Any]:
    return {k: v for k, v in params.items() if v not in (None, "")}


# Addresses, parameters and page sizes of the boards.
ADZUNA_PAGE, WORKDAY_PAGE, USAJOBS_RESULTS = 50, 20, 25


def greenhouse(spec: dict, keys: Credentials) -> Request:
    return Request(f"https://boards-api.greenhouse.io/v1/boards/{spec['slug']}/jobs", {"content": "true"})


def ashby(spec: dict, keys: Credentials) -> Request:
    return Request(f"https://api.ashbyhq.com/posting-api/job-board/{spec['slug']}", {"includeCompensation": "true"})


def lever(spec: dict, keys: Credentials) -> Request:
    return Request(f"https://api.lever.co/v0/postings/{spec['slug']}", {"mode": "json"})


def breezy(spec: dict, keys: Credentials) -> Request:
    return Request(f"https://{spec['slug']}.breezy.hr/json")


def remotive(spec: dict, keys: Credentials) -> Request:
    return Request("https://remotive.com/api/remote-jobs", {"search": spec["query"]})


def adzuna(spec: dict, keys: Credentials, page: int = 1) -> Request:
    own = _given(app_id=keys.adzuna_id, app_key=keys.adzuna_key, what_phrase=spec["query"], results_per_page=ADZUNA_PAGE, sort_by="date", where=spec.get("where"), distance=_number(spec.get("distance")), max_days_old=_number(spec.get("max_days_old")))
    return Request(f"https://api.adzuna.com/v1/api/jobs/us/search/{page}", own)


def usajobs(spec: dict, keys: Credentials) -> Request:
    own = _given(Keyword=spec["query"], ResultsPerPage=_number(spec.get("max_results")) or USAJOBS_RESULTS, LocationName=spec.get("where"), Radius=_number(spec.get("distance")), RemoteIndicator="True" if spec.get("remote_only") else None)
    return Request("https://data.usajobs.gov/api/search", own, {"Authorization-Key": keys.usajobs_key, "User-Agent": keys.usajobs_email, "Host": "data.usajobs.gov"})


def workday(spec: dict, keys: Credentials, offset: int = 0) -> Request:
    return Request(f"{workday_root(spec)}/jobs", headers={"Accept": "application/json"}, body={"appliedFacets": {}, "limit": WORKDAY_PAGE, "offset": offset, "searchText": spec["query"]})


def workday_root(spec: dict) -> str:
    return f"https://{spec['host']}/wday/cxs/{spec['tenant']}/{spec['site']}"


REQUESTS: dict[str, Callable[..., Request]] = {f.__name__: f for f in (greenhouse, ashby, lever, breezy, remotive, adzuna, usajobs, workday)}


def _number(value: Any) -> int | None:
    """A spec's number: pandas hands over missing ones as NaN."""
    return None if value is None or value != value else int(value)


class Boards:
    """A transport for `specs.fetched`: a spec in, the JSON text of its payload out. Paged boards are read until a short page or enough rows."""

    def __init__(self, credentials: Credentials | None = None, send: Send = send):
        self.keys, self.send = credentials or Credentials.from_env(), send

    def json(self, what: str, request: Request) -> Any:
        """The parsed answer; whatever goes wrong is a FetchError that says what it was."""
        try:
            got = self.send(request)
        except (OSError, TimeoutError) as exc:
            raise FetchError(f"{what} is unreachable: {exc}") from exc
        if got.status >= 400:
            raise FetchError(f"{what} returned HTTP {got.status}")
        try:
            return json.loads(got.text)
        except ValueError as exc:
            raise FetchError(f"{what} returned non-JSON") from exc

    def __call__(self, spec: dict) -> str:
        kind = spec["kind"]
        if kind not in REQUESTS:
            raise FetchError(f"no fetcher registered for kind {kind}")
        self.keys.need(kind)
        what = " ".join(x for x in (kind, spec.get("slug") or spec.get("tenant") or "", spec.get("query") or "") if x)
        most = _number(spec.get("max_results"))
        if kind == "adzuna":
            page = lambda number, _: self._rows(what, self.json(what, adzuna(spec, self.keys, number + 1)), "results")
            return json.dumps({"results": paged(page, ADZUNA_PAGE, most or ADZUNA_PAGE)})
        if kind == "workday":
            # a full page may be followed by an empty one, and the total is not to be trusted
            page = lambda _, so_far: self._rows(what, self.json(what, workday(spec, self.keys, so_far)), "jobPostings")
            return json.dumps({"jobPostings": paged(page, 1, most or WORKDAY_PAGE)})
        return json.dumps(self.json(what, REQUESTS[kind](spec, self.keys)))

    def _rows(self, what: str, payload: Any, name: str) -> list:
        rows = payload.get(name) if isinstance(payload, dict) else None
        if not isinstance(rows, list):
            raise FetchError(f"{what} returned no list of {name}")
        return rows

    def detail(self, stub: dict) -> str:
        """The payload of one search hit of a two-stage board."""
        return json.dumps(self.json(f"workday {stub['tenant']} {stub['external_path']}", Request(workday_root(stub) + stub["external_path"])))

    def robots(self, url: str) -> str | None:
        """For board discovery: a text, or None where there is none."""
        try:
            got = self.send(Request(url))
        except OSError:
            return None
        return got.text if got.status == 200 else None
