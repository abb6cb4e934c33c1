"""Column functions on text: plain text, keys, headers, money, dates."""

from __future__ import annotations

import html
import re
from datetime import UTC, datetime
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EDGES = r"(?U)^\s+|\s+$"


_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|([A-Za-z][A-Za-z0-9]*));")


def unescape_closed(text: str) -> str:
    """As `html.unescape`, but a reference without its semicolon (`&amp` before a tag, say) stays as it is."""
    return _CLOSED.sub(lambda m: html.unescape(m[0]) if m[1] is None else html5.get(f"{m[1]};", m[0]), text)


@F.pandas_udf(T.StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


@F.pandas_udf(T.StringType())
def _unescape_closed(text: pd.Series) -> pd.Series:
    return text.map(unescape_closed, na_action="ignore")


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, _EDGES, "")


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def plain_text(markup: Column, closed: bool = False) -> Column:
    """HTML, possibly escaped twice, as one line of text. Python is entered only for texts with an entity.

    With `closed` only references that end in a semicolon are read; without it also those that browsers read without one.
    """
    markup, unescape = F.coalesce(markup, F.lit("")), _unescape_closed if closed else _unescape
    once = F.when(markup.contains("&"), unescape(markup)).otherwise(markup)
    bare = F.regexp_replace(once, r"<[^>]+>", " ")
    twice = F.when(bare.contains("&"), unescape(bare)).otherwise(bare)
    return collapse(twice)


def posting_id(source: Column, source_id: Column) -> Column:
    return F.sha2(F.concat(source, F.lit("\x00"), source_id), 256)


def content_hash(description: Column) -> Column:
    return F.sha2(F.coalesce(description, F.lit("")), 256)


def key_part(text: Column) -> Column:
    """Lower case, only a-z, 0-9 and single blanks."""
    kept = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9 ]+", " ")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def cross_source_key(company: Column, title: Column, location: Column) -> Column:
    return F.md5(F.concat_ws(" ", key_part(company), key_part(title), key_part(location)))


def embedding_id(job_id: Column, chunk_index: Column) -> Column:
    return F.concat_ws(":", job_id, chunk_index.cast("string"))


def context_header(title: Column, company: Column, location: Column) -> Column:
    """`title at company. location.` and a blank line; what is blank is left out."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    who = F.when(has(company), F.concat_ws(" at ", F.coalesce(title, F.lit("")), company)).otherwise(F.coalesce(title, F.lit("")))
    return F.concat(F.array_join(F.filter(F.array(who, F.coalesce(location, F.lit(""))), lambda p: p != ""), ". "), F.lit(".\n\n"))


_FENCE = r"(?i)</\s*job_description\s*>"


def fenced(description: Column) -> Column:
    """Untrusted text that cannot close its own fence."""
    return F.regexp_replace(description, _FENCE, "[/job_description]")


def fence_text(description: str) -> str:
    """The same of a string."""
    return re.sub(_FENCE, "[/job_description]", description)


def dollars(low: Column, high: Column) -> Column:
    """`$85,389 - $116,975`; one figure where there is one or both are equal; null where there is none."""
    said = lambda c: F.concat(F.lit("$"), F.format_number(c, 0))
    return F.when(low.isNull() & high.isNull(), None).when(low.isNull() | high.isNull() | (low == high), said(F.coalesce(low, high))).otherwise(F.concat(said(low), F.lit(" - "), said(high)))


def instant(text: Column) -> Column:
    """ISO date or time; without an offset it is UTC (the session's zone); unreadable is null."""
    return F.try_to_timestamp(text)


def instant_of(at: datetime) -> Column:
    """A point in time as a literal; one without a zone is UTC, whatever the zones of the driver and the session."""
    at = at if at.tzinfo else at.replace(tzinfo=UTC)
    return F.timestamp_micros(F.lit(round((at - datetime(1970, 1, 1, tzinfo=UTC)).total_seconds() * 1_000_000)))


def whole_days(since: Column, until: Column) -> Column:
    """Whole periods of 24 hours, as opposed to changes of the calendar day."""
    return F.floor((F.unix_micros(until.cast("timestamp")) - F.unix_micros(since.cast("timestamp"))) / 86_400_000_000).cast("int")


def truncated_at_word(text: Column, most: int) -> Column:
    """At most so many characters, cut at the last blank within them."""
    head = F.substring(text, 1, most)
    return F.when(F.char_length(text) <= most, text).otherwise(F.when(head.contains(" "), F.regexp_extract(head, r"(?s)^(.*) ", 1)).otherwise(head))
