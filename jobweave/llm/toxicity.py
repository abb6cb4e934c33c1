"""Counterfactual-regularised toxicity classifier.

A hashed logistic model over letter runs and their leading bytes (stems), trained by follow-the-regularised-leader
updates. In the labelled texts group mentions are swapped for others of the same kind, and the change of the score is
penalised, so naming a group does not by itself raise the score. Group mentions are the identity terms given, and terms
of the corpus' own languages that are learned from the sample: words of middling frequency that the two classes use
alike, so nothing about them is toxic, gathered into kinds that stand after the same words and so can replace each other.

A text is scored whole: every stem counts, wherever it stands and however long the text is, by one and half the
logarithm of how often it occurs. Null and empty texts score as the bias alone; labels that are null or other than 0 and
1 are left out of training; with no usable labels every score is 0.5. Repeated rows are scored each for itself; a
caller's column named score is replaced, all others are carried along. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear
from .textops import ODD, find_words, mix, range_hash
from .workspace import fresh

PLAN = linear.TrainingPlan(label="toxic", folds=3, held_out_fold=1, rows_per_class=6000, epochs=6, alpha=0.5, l1=6.0, l2=0.0, bits=24, pairing=1.0)
THRESHOLD = 0.7
STEMS = (4, 5, 6, 7, 8, 9, 10)

#: Interchangeable group mentions, by kind.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy", "transgender", "nonbinary"),
    ("gay", "lesbian", "bisexual", "straight", "queer", "trans"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "african", "european", "latino", "indigenous", "arab"),
    ("mexican", "american", "chinese", "indian", "german", "french", "spanish", "turkish", "polish"),
    ("immigrant", "refugee", "foreigner", "citizen"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("old", "young", "elderly", "teenage"),
    ("blind", "deaf", "disabled", "autistic"),
)

#: How many neutral words of the sample stand in for group mentions, and how often they must occur (share of the texts).
LEARNED, SEEN_IN = 96, (0.01, 0.2)

_U = np.uint64
_GAP = np.ones(256, bool)
_GAP[np.r_[65:91, 97:123, 128:256]] = False
_RUN = re.compile(rb"[a-z\x80-\xff]+")


def neutral_kinds(rows: list[tuple[bytes, int]], most: int = LEARNED) -> list[tuple[str, ...]]:
    """Kinds of interchangeable neutral words, learned from labelled texts.

    A word is neutral if both classes use it and its share of toxic texts is within one standard error of the share of
    all. Kinds are words that mostly stand after the same word; what is left over after that is grouped by frequency.
    """
    held, toxic, after = Counter(), Counter(), defaultdict(Counter)
    for text, y in rows:
        words = set(_RUN.findall(text.lower()))
        held.update(words)
        if y:
            toxic.update(words)
    n, share = len(rows), sum(y for _, y in rows) / max(1, len(rows))
    low, high = (max(2, s * n) for s in SEEN_IN)
    neutral = [w for w, k in held.items() if low <= k <= high and len(w) > 3 and 0 < toxic[w] < k and abs(toxic[w] - share * k) <= (share * (1 - share) * k) ** 0.5]
    neutral = sorted(neutral, key=lambda w: (-held[w], w))[:most]
    wanted = set(neutral)
    for text, _ in rows:
        words = _RUN.findall(text.lower())
        for a, b in zip(words, words[1:], strict=False):
            if b in wanted:
                after[b][a] += 1
    homes = defaultdict(list)
    for w in neutral:
        homes[max(after[w].items(), key=lambda x: (x[1], x[0]), default=(b"", 0))[0]].append(w)
    kinds, alone = [own for own in homes.values() if len(own) > 1], [w for own in homes.values() if len(own) == 1 for w in own]
    kinds += [alone[k : k + 6] for k in range(0, len(alone) - 1, 6)]
    return [tuple(w.decode(errors="ignore") for w in kind) for kind in kinds if len(kind) > 1]


class Swap:
    """A text with each group mention replaced by another of its kind; None where it names no group."""

    def __init__(self, kinds):
        self.others = {term: [x for x in kind if x != term] for kind in kinds for term in kind}
        terms = sorted((t.encode() for t in self.others), key=len, reverse=True)
        self.term = re.compile(rb"(?i)(?<![a-z\x80-\xff])(?:" + b"|".join(map(re.escape, terms)) + rb")(?![a-z\x80-\xff])")

    def __call__(self, text: bytes, place: int) -> bytes | None:
        def other(found: re.Match[bytes]) -> bytes:
            choices = self.others[found.group().lower().decode()]
            return choices[(place + found.start()) % len(choices)].encode()

        out, n = self.term.subn(other, text)
        return out if n else None


swapped = Swap(IDENTITY_TERMS)


def features(data: np.ndarray, offsets: np.ndarray, table: np.ndarray | None = None):
    """Each letter run and its leading bytes (STEMS), by 1 + log(count) / 2, after a bias."""
    words = find_words(data, offsets, blank=_GAP)
    text, n_texts, size = words.text, len(offsets) - 1, words.stop - words.start
    grams, owners = [mix(words.hash * ODD[20])], [text]
    for kind, stem in enumerate(STEMS, 21):
        long = size >= stem
        start = words.start[long]
        grams.append(mix(range_hash(words.sums, start, start + stem) * ODD[kind]))
        owners.append(text[long])
    at = (np.concatenate(grams) >> _U(64 - PLAN.bits)).astype(np.int64)
    at[at == 0] = 1
    at, owner = np.concatenate([at, np.zeros(n_texts, np.int64)]), np.concatenate([*owners, np.arange(n_texts)])
    at, counts, bounds = linear.sparse(at, owner, n_texts, table)
    return at, 1.0 + 0.5 * np.log(counts), bounds


def fit(documents: DataFrame, labels: DataFrame, plan: linear.TrainingPlan = PLAN, terms=IDENTITY_TERMS, learned: int = LEARNED) -> linear.Model:
    """The model; its `pairs` says how many counterfactual pairs it was trained on. `terms` are the kinds given, `learned` bounds those taken from the sample."""

    def swaps(rows):
        found = neutral_kinds(rows, learned) if learned else []
        kinds = [*terms, *found]
        return Swap(kinds) if kinds else None

    return linear.fitted(documents, labels, plan, features, swaps if plan.pairing else None)


def score(documents: DataFrame, labels: DataFrame, plan: linear.TrainingPlan = PLAN) -> DataFrame:
    """`documents` with score, the estimated probability of toxic 1, from its text alone."""
    return linear.scored(documents, fit(documents, labels, plan), plan, features)


def toxicity_query(documents: DataFrame, labels: DataFrame, plan: linear.TrainingPlan = PLAN) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 from THRESHOLD on)."""
    out = score(documents.select("doc_id", "text"), labels, plan)
    return out.select("doc_id", linear.held_out(plan).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(documents: DataFrame, labels: DataFrame, plan: linear.TrainingPlan = PLAN) -> DataFrame:
    """The documents that are not predicted toxic, with their own columns."""
    name = fresh(documents.columns, "__score")
    out = linear.scored(documents, fit(documents, labels, plan), plan, features, name)
    return out.where(F.col(name) < THRESHOLD).select(*documents.columns)
