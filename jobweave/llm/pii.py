"""Personal data: fixed patterns, and further spans by a linear-chain conditional random field over word shapes.

The patterns are e-mail addresses, IPv4 addresses, payment card numbers that pass Luhn's check, and international phone
numbers. The field tags words from their shapes and those of their neighbours; its spans that meet no pattern's span are
added (secrets after a cue, phone numbers without a plus sign). It is trained from a small labelled table that is built
here by rule, decoded by Viterbi in numpy batches, and no more than that leaves the driver.

Positions are code points, ends exclusive. A null text is an empty one; ids may be null or repeat, each row stands alone.
A text of any length is searched whole. Other columns take no part, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .textops import find_words, slices
from .workspace import arrow_limits, tidy

#: In this order at one start.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]

_LOCAL, _DOMAIN = re.compile(r"[A-Za-z0-9._%+-]*\Z"), re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# starting inside a run of digits cannot succeed where its start failed
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ outwards, so no text takes quadratic time."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        end = _DOMAIN.match(text, at)
        start = at
        if end:
            while start > free and text[start - 1] in _LOCAL_CHARS:
                start -= 1
        if end and start < at:
            out.append((start, end.end()))
            free = end.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start and then kind."""
    found = [(s, e, "email") for s, e in emails(text)]
    found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), "card"))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


# word shapes ------------------------------------------------------------------------------------------------------

#: Sizes of the attributes of a word's shape: digits, letters, at sign, dots, first byte, hyphen, cue.
ROOMS = (6, 3, 2, 4, 6, 2, 3)
SHAPES = int(np.prod(ROOMS))
TAGS = 1 + 2 * len(KINDS)  # outside; first and further words of each kind
_CUES = ("token", "secret", "key", "password", "api_key", "apikey", "passwd")

_FLAGS = {name: np.zeros(256, bool) for name in ("digit", "letter", "hex", "at", "dot", "hyphen")}
_FLAGS["digit"][48:58] = True
_FLAGS["letter"][np.r_[65:91, 97:123, 128:256]] = True
_FLAGS["hex"][np.r_[65:71, 97:103]] = True
_FLAGS["at"][64] = _FLAGS["dot"][46] = _FLAGS["hyphen"][45] = True
_FIRST = np.full(256, 5)
_FIRST[np.r_[65:91, 97:123, 128:256]], _FIRST[48:58], _FIRST[43], _FIRST[40], _FIRST[34] = 4, 3, 0, 1, 2


@functools.cache
def _cues() -> tuple[np.ndarray, int]:
    raw = "\n".join([*_CUES, "=", ":"]).encode()
    ends = np.array([0, *(k + 1 for k, c in enumerate(raw) if c == 10), len(raw)])
    hashes = find_words(np.frombuffer(raw, np.uint8), ends).hash
    return np.sort(hashes[: len(_CUES)]), np.sort(hashes[len(_CUES) :])


def shapes(data: np.ndarray, words) -> np.ndarray:
    """The shape of each word, a number below SHAPES."""
    sums = {}
    for name, flags in _FLAGS.items():
        own = np.zeros(len(data) + 1, np.int32)
        np.cumsum(flags[data], out=own[1:])
        sums[name] = own[words.stop] - own[words.start]
    digits = np.searchsorted([1, 4, 9, 14, 20], sums["digit"], "right")
    letters = np.where(sums["letter"] == 0, 0, np.where((sums["letter"] == sums["hex"]) & (sums["digit"] > 3), 1, 2))
    cue_words, marks = _cues()
    cue = np.where(np.isin(words.hash, cue_words), 1, np.where(np.isin(words.hash, marks), 2, 0))
    parts = (digits, letters, sums["at"] > 0, np.minimum(sums["dot"], 3), _FIRST[data[words.start]], sums["hyphen"] > 0, cue)
    code = np.zeros(len(words.start), np.int64)
    for value, room in zip(parts, ROOMS, strict=True):
        code = code * room + value
    return code


def _attributes() -> np.ndarray:
    """For every shape, the ids of its features: each attribute, and digits joined with letters, dots, first byte and hyphen."""
    values = np.stack(np.unravel_index(np.arange(SHAPES), ROOMS), 1)
    columns, base = [], 0
    for k, room in enumerate(ROOMS):
        columns.append(base + values[:, k])
        base += room
    for k in (1, 3, 4, 5):
        columns.append(base + values[:, 0] * ROOMS[k] + values[:, k])
        base += ROOMS[0] * ROOMS[k]
    return np.stack(columns, 1), base


def labelled_table(rows: int = 360, seed: int = 5) -> list[list[tuple[str, int]]]:
    """The labelled table: sentences of (word, tag), built by rule; numbers that are no personal data stand among the plain words."""
    rng = np.random.Generator(np.random.PCG64(seed))
    pick = lambda n: int(rng.integers(n))
    digits = lambda n: "".join(str(pick(10)) for _ in range(n))
    letters = lambda n: "".join("etaoinshrdlu"[pick(12)] for _ in range(n))
    ending = lambda: ("", "", "", ",", ".")[pick(5)]

    def plain() -> list[tuple[str, int]]:
        kind = pick(26)
        if kind > 23:
            return [(("|", "%%%", "-", "...", "*", "&", "!!", "#")[pick(8)], 0)]
        word = letters(1 + pick(9)).capitalize() if kind < 3 else digits(1 + pick(8)) if kind == 3 else digits(14 + pick(4)) if kind == 4 else f"{digits(1)}.{digits(1 + pick(2))}." if kind == 5 else f"{letters(3)}-{digits(2)}" if kind == 6 else ("=", ":", "key", "(see", "token")[pick(5)] if kind == 7 else letters(1 + pick(9))
        return [(word + (ending() if kind < 5 else ""), 0)]

    def entity(k: int) -> list[tuple[str, int]]:
        if KINDS[k] == "email":
            words = [f"{letters(4)}.{digits(2)}@{letters(5)}.com" + ending()]
        elif KINDS[k] == "ip":
            words = [".".join(str(pick(256)) for _ in range(4)) + ending()]
        elif KINDS[k] == "card":
            words = [digits(4) for _ in range(4)]
        elif KINDS[k] == "phone":
            words = [[f"+{digits(1)}"], []][pick(2)] + [f"({digits(3)})", f"{digits(3)}-{digits(4)}" + ending()]
        else:
            value = "".join("0123456789abcdef"[pick(16)] for _ in range(32 + 4 * pick(4)))
            return [(_CUES[pick(len(_CUES))], 0), (("=", ":")[pick(2)], 0), (f'"{value}"', 1 + 2 * k)]
        return [(w, 1 + 2 * k + (n > 0)) for n, w in enumerate(words)]

    return [[x for part in [*(plain() for _ in range(3 + pick(5))), *([entity(row % len(KINDS))] if row % 3 else []), *(plain() for _ in range(2 + pick(5)))] for x in part] for row in range(rows)]


def table_shapes(sentence: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(" ".join(w for w, _ in sentence).encode(), np.uint8)
    return shapes(data, find_words(data, np.array([0, len(data)]))), np.array([t for _, t in sentence])


class Tagger:
    """The trained field, as one table of scores by shape for each of the word before, the word and the word after."""

    #: Features of a word; an end of the text stands in for as many.
    edge_width = len(ROOMS) + 4

    def __init__(self, chain: crf.Chain, attributes: np.ndarray, n: int):
        self.chain = chain
        self.scores = [chain.emission[k * n + attributes].sum(1) for k in range(3)]
        self.edge = [chain.emission[3 * n + k] for k in (0, 1)]
        values = np.stack(np.unravel_index(np.arange(SHAPES), ROOMS), 1)
        self.plain = (values[:, [0, 2, 5, 6]] == 0).all(1) & (values[:, 3] <= 1) & (values[:, 4] >= 4)
        self.margin_words = self._margin_words()

    def _margin_words(self) -> int | None:
        """So many plain words beside a busy one must be decoded with it; plain words beyond are outside in any best tagging.

        Turning a run of n tagged plain words into outside gains at least n times the least emission margin, less the
        steps within the run and at its two ends. None: no such number holds, and every word is decoded.
        """
        p, step = np.flatnonzero(self.plain), self.chain.step
        margin = sum((s[p, 0, None] - s[p, 1:]).min() for s in self.scores)
        margin = min(margin, min(sum((s[p, 0, None] - s[p, 1:]).min() for s in (self.scores[1], self.scores[2 * side])) + (edge[0] - edge[1:]).min() for side, edge in ((1, self.edge_width * self.edge[0]), (0, self.edge_width * self.edge[1]))))
        within = (step[1:, 1:] - step[0, 0]).max()
        enter = max((step[:, 1:] - step[:, :1]).max(), (self.chain.first[1:] - self.chain.first[0]).max())
        leave = max((step[1:] - step[0]).max(), (self.chain.last[1:] - self.chain.last[0]).max())
        return next((k for k in range(1, 17) if margin > within and (k + 1) * margin - k * within - enter - leave > 0), None)

    @classmethod
    def trained(cls) -> Tagger:
        attributes, n = _attributes()
        edges = 3 * n + np.arange(2)
        rows = []
        for sentence in labelled_table():
            shape, tags = table_shapes(sentence)
            own = attributes[shape]
            none = np.full((1, own.shape[1]), edges[0])
            rows.append((np.concatenate([np.concatenate([none, own[:-1]]), n + own, np.concatenate([2 * n + own[1:], none + 1])], 1), tags))
        return cls(crf.train(rows, 3 * n + 2, TAGS), attributes, n)

    def tags(self, shape: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Tags of the words of several texts. Runs of plain words are outside; the rest is decoded in its whole context."""
        n = len(shape)
        if not n:
            return np.zeros(0, np.int64)
        first, last = np.zeros(n, bool), np.zeros(n, bool)
        inner = bounds[:-1][np.diff(bounds) > 0]
        first[inner] = True
        last[np.append(inner[1:], n) - 1] = True
        busy = ~self.plain[shape]
        if self.margin_words:
            near = busy.copy()
            for k in range(1, self.margin_words + 2):
                near[k:] |= busy[:-k]
                near[:-k] |= busy[k:]
        else:
            near = np.ones(n, bool)
        at = np.flatnonzero(near)
        out = np.zeros(n, np.int64)
        if not len(at):
            return out
        before, after = np.maximum(at - 1, 0), np.minimum(at + 1, n - 1)
        e = self.scores[1][shape[at]]
        e = e + np.where(first[at, None], self.edge[0] * self.edge_width, self.scores[0][shape[before]]) + np.where(last[at, None], self.edge[1] * self.edge_width, self.scores[2][shape[after]])
        starts = np.flatnonzero(first[at] | np.append(True, at[1:] != at[:-1] + 1))
        out[at] = crf.viterbi(self.chain, e, np.append(starts, len(at)))
        return out


@functools.cache
def tagger() -> Tagger:
    return Tagger.trained()


_TRIM = re.compile(r"^[\"'(\[{<]*(.*?)[\"')\]}>,.;:!?%#$*&|]*$", re.S)


def added_spans(text: str, words: list[tuple[int, int, int]], taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans of tagged words (start, end, tag, in code points), trimmed of marks, that meet none of `taken`."""
    runs: list[list] = []
    for start, end, tag in words:
        kind = KINDS[(tag - 1) // 2]
        if runs and tag % 2 == 0 and runs[-1][2] == kind and text[runs[-1][1] : start].isspace():
            runs[-1][1] = end
        else:
            runs.append([start, end, kind])
    out = []
    for start, end, kind in runs:
        piece = text[start:end]
        if kind in ("secret", "email", "ip", "card"):
            m = _TRIM.match(piece)
            start, end = start + m.start(1), start + m.end(1)
        else:
            end = start + len(piece.rstrip(",.;:!?%#$*&|"))
        digits = [c for c in text[start:end] if c.isdigit()]
        fits = {"card": 14 <= len(digits) <= 19 and luhn("".join(digits)) if all(c in "0123456789" for c in digits) else False, "phone": 7 <= len(digits) <= 15, "ip": False, "email": "@" in piece, "secret": len(piece) >= 16}[kind]
        if fits and start < end and not any(s < end and start < e for s, e, _ in taken):
            out.append((start, end, kind))
    return out


def find_pii(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, spans (array of start, end, kind, base) by start and kind."""
    spark = documents.sparkSession
    arrow_limits(spark)
    shared = spark.sparkContext.broadcast(tagger())
    digit_or_at = _FLAGS["digit"] | _FLAGS["at"]
    item = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            rows: list[list[dict]] = []
            for _, _, data, offsets in slices(batch.column("text")):
                words = find_words(data, offsets)
                tags = model.tags(shapes(data, words), words.bounds) if len(words.start) else np.zeros(0, np.int64)
                tagged = np.flatnonzero(tags)
                marked = np.concatenate([[0], np.cumsum(digit_or_at[data])])[offsets]
                owners = np.searchsorted(words.bounds, tagged, "right") - 1
                raw = data.tobytes()
                for k in range(len(offsets) - 1):
                    own = tagged[np.searchsorted(owners, k) : np.searchsorted(owners, k, "right")]
                    if marked[k] == marked[k + 1] and not len(own):
                        rows.append([])
                        continue
                    piece = raw[offsets[k] : offsets[k + 1]]
                    text = piece.decode()
                    base = base_spans(text) if marked[k] < marked[k + 1] else []
                    if len(piece) == len(text):
                        place = lambda x: int(x - offsets[k])  # noqa: E731, B023
                    else:
                        points = np.cumsum((np.frombuffer(piece, np.uint8) & 0xC0) != 0x80)
                        place = lambda x: int(points[x - offsets[k] - 1]) if x > offsets[k] else 0  # noqa: E731, B023
                    more = added_spans(text, [(place(words.start[w]), place(words.stop[w]), int(tags[w])) for w in own], base)
                    found = [(s, e, kind, True) for s, e, kind in base] + [(s, e, kind, False) for s, e, kind in more]
                    rows.append([dict(zip(("start", "stop", "kind", "base"), x, strict=True)) for x in sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(item))], ["doc_id", "spans"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, spans array<struct<start int, stop int, kind string, base boolean>>")


def pii_query(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, counts of the base kinds, base_sha256, spans (kind:start:end, comma-joined), how many spans of all kinds."""
    found = find_pii(documents)
    base = F.filter("spans", lambda s: s["base"])
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    of_kind = lambda kind: F.filter(base, lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
