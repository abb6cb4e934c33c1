"""What the pages show, what their buttons do, and the relay to an agent: plain data, for any web framework to serve.

A page is a dictionary; an action takes the body of a request and returns (answer, HTTP status). All of them go through the
same reads and writes as the tools.
"""

from __future__ import annotations

import hmac
import json
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import functions as F

from .api import Tools, row_of, rows_of
from .functions.validation import BadArgument, clean, cleaned
from .operators.reads import PAGE, Filters, pages_of, score_band
from .operators.scoring import draft
from .schemas import STATUSES

#: Totals of the insights page, by the name it shows them under.
TOTALS = {
    "pipeline_now": "pipeline_now", "corpus_now": "corpus_now", "transitions": "status_transitions", "created": "applications_created",
    "ingested": "postings_ingested", "saved": "jobs_saved", "unsaved": "jobs_unsaved",
}


class Pages:
    def __init__(self, tools: Tools):
        self.tools, self.reads, self.user, self.clock = tools, tools.reads, tools.user, tools.clock

    def _form(self, form: dict) -> dict:
        """The filters of a request's query string; what is no number filters nothing."""
        number = lambda name: clean("form_number", form.get(name))
        return {
            "query": str(form.get("q") or "").strip(), "source": str(form.get("source") or "").strip() or None, "remote_only": form.get("remote") == "on",
            "posted_within_days": number("days"), "min_score": number("score"), "page": clean("page", form.get("page")),
        }

    def search(self, form: dict) -> dict:
        """The list, best first and by pages; with words in the box, one page of what is nearest to them."""
        own = self._form(form)
        if own["query"]:
            jobs = rows_of(self.tools.found(own | {"min_score": None}, top_k=2 * PAGE))
            total, pages = len(jobs), 1
        else:
            filters = Filters(own["source"], own["remote_only"], own["posted_within_days"], own["min_score"])
            rows = self.reads.list_jobs(self.user, self.clock(), filters, PAGE, (own["page"] - 1) * PAGE)
            jobs = rows_of(rows.withColumn("band", score_band(F.col("fit_score"))))
            total = self.reads.count_jobs(self.clock(), filters, self.user)
            pages = pages_of(total)
        return {"tab": "search", "jobs": jobs, "total": total, "pages": pages, "sources": [r["source"] for r in self.reads.sources().collect()]} | own

    def saved(self) -> dict:
        jobs = rows_of(self.reads.list_saved(self.user))
        return {"tab": "saved", "jobs": jobs, "total": len(jobs)}

    def applied(self, form: dict) -> dict:
        status = str(form.get("status") or "").strip() or None
        rows = rows_of(self.reads.list_applications(self.user, self.clock(), status))
        return {"tab": "applied", "applications": rows, "statuses": STATUSES, "current_status": status, "total": len(rows)}

    def insights(self) -> dict:
        """Totals of each metric over the window, and the last moves."""
        today = self.clock().date()
        totals = {name: [(r["dimension"], r["total"]) for r in self.reads.totals(today, metric).collect()] for name, metric in TOTALS.items()}
        return {"tab": "insights", "computed_at": self.reads.last_computed(), "by_day": [tuple(r) for r in self.reads.latest_moves(today).collect()]} | totals

    def job(self, job_id: str) -> dict | None:
        """None: no such posting, which a server answers with 404."""
        found = row_of(self.reads.get_job(job_id, self.user))
        return found and {"tab": "search", "job": found, "statuses": STATUSES}

    def status(self) -> tuple[dict, int]:
        try:
            return {"status": "ok", "counts": row_of(self.reads.stats())}, 200
        except Exception as exc:
            return {"status": "degraded", "database": type(exc).__name__}, 503


Answer = tuple[dict, int]


class Refused(Exception):
    """An action that can't be done, with the status that says why."""

    def __init__(self, status: int, why: str):
        super().__init__(why)
        self.status = status


def action(function: Callable) -> Callable[..., Answer]:
    def call(self, body: dict | None) -> Answer:
        try:
            return function(self, body or {}), 200
        except Refused as exc:
            return {"error": str(exc)}, exc.status
        except BadArgument as exc:
            return {"error": str(exc)}, 400

    return call


class Actions:
    """The buttons. A bad body is 400, a row that is not there or not the user's 404, a model that fails 502."""

    def __init__(self, tools: Tools):
        self.tools, self.writes, self.user, self.clock = tools, tools.writes, tools.user, tools.clock

    @action
    def save(self, body: dict) -> dict:
        own = cleaned(job_id=body.get("job_id"), note=body.get("note"))
        if body.get("unsave"):
            self.writes.unsave_job(self.user, own["job_id"])
            return {"saved": False}
        self.writes.save_job(self.user, own["job_id"], self.clock(), own["note"])
        return {"saved": True}

    @action
    def apply(self, body: dict) -> dict:
        own = cleaned(job_id=body.get("job_id"), status=body.get("status"), note=body.get("note"))
        row = self.writes.log_application(self.user, own["job_id"], self.clock(), own["status"], own["note"])
        return {"application_id": row["id"], "status": row["status"]}

    def _mine(self, row):
        if row is None:
            raise Refused(404, "no such application")
        return row

    @action
    def status(self, body: dict) -> dict:
        own = cleaned(application_id=body.get("application_id"), new_status=body.get("status"))
        return {"status": self._mine(self.writes.update_status(self.user, own["application_id"], own["new_status"], self.clock()))["status"]}

    @action
    def note(self, body: dict) -> dict:
        own = cleaned(application_id=body.get("application_id"), interview_note=body.get("note"))
        self._mine(self.writes.add_note(self.user, own["application_id"], own["interview_note"], self.clock()))
        return {"added": True}

    @action
    def draft(self, body: dict) -> dict:
        own = cleaned(job_id=body.get("job_id"), kind=body.get("kind"))
        job = row_of(self.tools.reads.get_job(own["job_id"], self.user))
        if job is None:
            raise Refused(404, "No such job.")
        try:
            text = draft(job, row_of(self.tools.reads.get_profile(self.user)) or {}, self.tools.provider, own["kind"])
        except Exception as exc:
            raise Refused(502, f"The drafting model is unavailable ({type(exc).__name__}).") from exc
        return {"kind": own["kind"], "text": text}


# Names of the agent protocol, in the order in which they are looked at.
REQUEST_KEYS = ("input", "messages")
LISTS = ("output", "choices", "messages", "predictions")
PLAIN = ("content", "text", "answer", "result")
INNER = ("content", "text", "message", "output_text")
SPEAKERS, RESERVED = ("user", "assistant"), ("system", "developer", "tool")
EXCHANGES, SHOWN = 8, 2000
REASONS = {
    400: "The request was malformed in the eyes of the endpoint.",
    403: "This service's account is not permitted to call the endpoint.",
    404: "Nothing answers at the configured address.",
    429: "The rate limit is used up for now.",
}


def recent(items: list[dict], exchanges: int = EXCHANGES) -> list[dict]:
    """The end of a conversation: at most so many exchanges, each begun by a user's item, so that no call is parted from its result."""
    begun = 0
    for at in range(len(items) - 1, -1, -1):
        if items[at].get("role") != "user":
            continue
        begun += 1
        if begun == exchanges and any(x.get("role") == "user" for x in items[:at]):
            return items[at:]
    return items


def _replayed(item: dict) -> dict:
    if item.get("role") in RESERVED:
        raise ValueError(f"an item's role must not be {item['role']}")
    return item


def _said(item: dict) -> dict:
    content = item.get("content")
    if item.get("role") not in SPEAKERS or not isinstance(content, str) or not content.strip():
        raise ValueError(f"a message needs content and a role of {' or '.join(SPEAKERS)}")
    return {"role": item["role"], "content": content.strip()}


def turns(body: dict) -> list[dict]:
    """What to send on: a full replay with the agent's calls and results (`items`), a conversation (`messages`), or one `message`."""
    for name, read in (("items", _replayed), ("messages", _said)):
        listed = body.get(name)
        if listed is None:
            continue
        if not isinstance(listed, list) or not listed or not all(isinstance(x, dict) for x in listed):
            raise ValueError(f"{name} must be a list of objects, and not empty")
        found = [read(x) for x in listed]
        if found[-1].get("role") != "user":
            raise ValueError(f"the last of {name} must be the user's")
        return recent(found)
    text = body.get("message")
    if not isinstance(text, str) or not text.strip():
        raise ValueError("message must not be empty")
    return [{"role": "user", "content": text.strip()}]


def pieces(node: Any) -> Iterator[str]:
    """The texts that one item of an answer carries."""
    match node:
        case str() if node:
            yield node
        case list():
            for part in node:
                yield from pieces(part)
        case dict():
            for name in INNER:
                held = list(pieces(node.get(name)))
                if held:
                    yield from held
                    return


def reply_text(payload: Any) -> str:
    """The last text of an answer, whatever its envelope; the envelope itself where there is none."""

    def candidates() -> Iterator[str]:
        if isinstance(payload, str):
            yield payload
        if isinstance(payload, dict):
            for name in LISTS:
                held = payload.get(name)
                yield from ("\n".join(pieces(item)) for item in reversed(held if isinstance(held, list) else []))
            yield from (payload[name] for name in PLAIN if isinstance(payload.get(name), str))

    return next((text for text in candidates() if text), str(payload)[:SHOWN])


class AgentFailed(RuntimeError):
    def __init__(self, status: int | None, why: str):
        super().__init__(why)
        self.status = status


def reason(failure: Exception) -> str:
    """What to tell a person: the status says what is wrong, the body of the answer is not shown."""
    status = getattr(failure, "status", None)
    if status is None:
        return f"The agent is unreachable ({type(failure).__name__})."
    return f"{REASONS[status]} (HTTP {status})" if status in REASONS else f"The agent returned HTTP {status}."


class Relay:
    """Sends a conversation to an agent's endpoint. `post` takes the body and returns (status, text)."""

    def __init__(self, post: Callable[[dict], tuple[int, str]] | None):
        self.post = post

    def ask(self, conversation: list[dict]) -> Any:
        """The endpoint's answer. A request that is refused as such is tried in the other shape; a failing endpoint is not asked twice."""
        status = None
        for name in REQUEST_KEYS:
            status, text = self.post({name: conversation})
            if status < 400:
                return json.loads(text)
            if status >= 500:
                break
        raise AgentFailed(status, f"HTTP {status}")

    def chat(self, body: dict | None) -> Answer:
        if self.post is None:
            return {"error": "No agent endpoint is configured here; everything else on the page works without one."}, 501
        try:
            conversation = turns(body or {})
        except ValueError as exc:
            return {"error": str(exc)}, 400
        try:
            payload = self.ask(conversation)
        except Exception as exc:
            return {"error": reason(exc)}, 502
        items = payload.get("output") if isinstance(payload, dict) else None
        # the raw items go back, so that the next turn can replay calls and results
        return {"reply": reply_text(payload), "items": items if isinstance(items, list) else []}, 200


PUBLIC_PATHS = ("/", "/status", "/healthz", "/favicon.ico")


def credential(header: str | None) -> str:
    """What an Authorization header presents: the word after a `bearer` of any case, or the whole where no scheme is named."""
    words = (header or "").split(None, 1)
    return words[1].strip() if len(words) == 2 and words[0].lower() == "bearer" else (header or "").strip()


def authorised(path: str, header: str | None, token: str) -> bool:
    """Whether a request may pass: a public path, or the bearer token, compared in constant time. No token configured, or none presented, opens nothing."""
    own, shown = token.strip(), credential(header)
    return path in PUBLIC_PATHS or (bool(own) and bool(shown) and hmac.compare_digest(shown.encode(), own.encode()))
