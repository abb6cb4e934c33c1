"""The arguments of the tools, as a table of rules that one interpreter applies.

A caller is a language model or a form: it sends numbers as text, blanks for nothing, and words in any case. A rule says
what a value is read as, what a blank means, and within which bounds a number is moved; what can't be used raises
BadArgument with a sentence that says what would do.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass
from datetime import date
from typing import Any

from ..operators.scoring import DRAFTS
from ..schemas import STATUSES


class BadArgument(ValueError):
    pass


@dataclass(frozen=True)
class Rule:
    """`reads` is what a value is read as: text, whole, choice, day or flag. A blank gives `default`, or is refused where `required`."""

    reads: str
    required: bool = False
    default: Any = None
    #: text: characters kept, and whether inner blanks are made single and letters lower
    most: int | None = None
    single_blanks: bool = False
    lower: bool = False
    #: whole numbers are moved into these bounds; `strict` refuses those below instead, `lenient` gives the default for what is no number
    low: int | None = None
    high: int | None = None
    strict: bool = False
    lenient: bool = False
    choices: Collection[str] = ()
    hint: str = ""


# Bounds and defaults of the tools' arguments.
RULES: dict[str, Rule] = {
    "query": Rule("text", required=True, most=500, single_blanks=True, hint="say in plain words what job is wanted"),
    "top_k": Rule("whole", default=10, low=1, high=50),
    "job_id": Rule("text", required=True, hint="take it from an earlier result"),
    "application_id": Rule("whole", required=True, low=1, strict=True, hint="take it from an earlier result"),
    "status": Rule("choice", default="applied", choices=STATUSES),
    "new_status": Rule("choice", required=True, choices=STATUSES),
    "note": Rule("text", most=4000),
    "interview_note": Rule("text", required=True, most=4000),
    "source": Rule("text", lower=True),
    "remote_only": Rule("flag"),
    "posted_within_days": Rule("whole", low=1, high=365),
    "min_score": Rule("whole", low=0, high=100),
    "stale_days": Rule("whole", low=1, high=1825),
    "follow_up_on": Rule("day"),
    "company": Rule("text", required=True, most=200),
    "name": Rule("text", required=True, most=200),
    "role": Rule("text", most=200),
    "notes": Rule("text", most=4000),
    "kind": Rule("choice", default="cover_letter", choices=tuple(DRAFTS)),
    "page": Rule("whole", default=1, low=1, lenient=True),
    "form_number": Rule("whole", lenient=True),
}
_YES = ("true", "yes", "y", "1", "on")


def _read_text(rule: Rule, value: Any) -> str | None:
    if not isinstance(value, str):
        raise BadArgument(f"must be text, not {type(value).__name__}")
    text = " ".join(value.split()) if rule.single_blanks else value.strip()
    return (text.lower() if rule.lower else text)[: rule.most] or None


def _read_whole(rule: Rule, value: Any) -> int | None:
    try:
        number = int(value)
    except (TypeError, ValueError):
        if rule.lenient:
            return rule.default
        raise BadArgument(f"must be a whole number, not {value!r}") from None
    if rule.strict and rule.low is not None and number < rule.low:
        raise BadArgument(f"must be at least {rule.low}")
    bounded = number if rule.low is None else max(rule.low, number)
    return bounded if rule.high is None else min(bounded, rule.high)


def _read_choice(rule: Rule, value: Any) -> str:
    word = "_".join(str(value).lower().replace("-", " ").split())
    if word not in rule.choices:
        raise BadArgument(f"must be one of {', '.join(rule.choices)}, not {value!r}")
    return word


def _read_day(rule: Rule, value: Any) -> date:
    try:
        return value if isinstance(value, date) else date.fromisoformat(value.strip())
    except (AttributeError, ValueError):
        raise BadArgument(f"must be a day written YYYY-MM-DD, not {value!r}") from None


def _read_flag(rule: Rule, value: Any) -> bool:
    return value.strip().lower() in _YES if isinstance(value, str) else bool(value)


READERS = {"text": _read_text, "whole": _read_whole, "choice": _read_choice, "day": _read_day, "flag": _read_flag}


def clean(name: str, value: Any) -> Any:
    """The value of an argument by its rule."""
    rule = RULES[name]
    blank = value is None or (isinstance(value, str) and not value.strip())
    try:
        found = None if blank else READERS[rule.reads](rule, value)
    except BadArgument as exc:
        raise BadArgument(f"{name} {exc}" + (f" ({rule.hint})." if rule.hint else ".")) from None
    if found is not None:
        return found
    if rule.required:
        raise BadArgument(f"{name} must not be empty" + (f"; {rule.hint}." if rule.hint else "."))
    return False if rule.reads == "flag" else rule.default


def cleaned(**arguments: Any) -> dict[str, Any]:
    """Several arguments at once, each by the rule of its name."""
    return {name: clean(name, value) for name, value in arguments.items()}
