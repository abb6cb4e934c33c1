"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader updates.

Features are hashed n-grams of words and of word shapes (letter case, digits, punctuation, length, repetition of the
word before). A text is scored as the sparse dot product of its n-gram shares with the weights. Null and empty texts
score as the bias alone, however long a text is, all of it is scored; labels that are null or other than 0 and 1 are
left out of training; with no usable labels every score is 0.5. Repeated rows are scored each for itself; a caller's
column named score is replaced, all others are carried along. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear
from .textops import LOWER, ODD, find_words, mix

PLAN = linear.TrainingPlan(label="quality", folds=4, held_out_fold=2, rows_per_class=4000, epochs=4, alpha=0.3, l1=0.3, l2=0.1, bits=22)
THRESHOLD = 0.7

_U = np.uint64
_UPPER, _DIGIT, _LETTER = np.zeros((3, 256), bool)
_UPPER[65:91] = True
_DIGIT[48:58] = True
_LETTER[np.r_[65:91, 97:123, 128:256]] = True


def _counts(flags: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=sums[1:])
    return sums[stop] - sums[start]


def features(data: np.ndarray, offsets: np.ndarray, table: np.ndarray | None = None):
    """Shares of hashed word 1- and 2-grams and of shape 1-, 2- and 3-grams, after a bias."""
    words = find_words(data, offsets)
    text, n_texts, h = words.text, len(offsets) - 1, words.hash
    n = len(h)
    size = words.stop - words.start
    upper, digits, letters = (_counts(flags[data], words.start, words.stop) for flags in (_UPPER, _DIGIT, _LETTER))
    last = LOWER[data[words.stop - 1]] if n else np.zeros(0, np.uint8)
    again = np.zeros(n, bool)
    if n > 1:
        again[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    marks = size - digits - letters
    shape = np.where(_LETTER[last], 0, last).astype(np.int64)
    for value, room in ((np.minimum(upper, 2), 3), (upper >= letters, 2), (np.minimum(digits, 2), 3), (np.minimum(marks, 3), 4), (np.minimum(letters // 4, 4), 5), (again, 2)):
        shape = shape * room + value
    shape = mix(shape.astype(_U) + _U(1))
    grams, owners = [], []
    for kind, base, most in ((1, h, 2), (3, shape, 3)):
        rolled = base * ODD[kind]
        for width in range(1, most + 1):
            if width > 1:
                rolled = rolled[:-1] * ODD[8] + base[width - 1 :] * ODD[kind + width]
            if len(rolled) <= 0:
                continue
            inside = text[: len(rolled)] == text[width - 1 :]
            grams.append(mix(rolled[inside] + _U(width)))
            owners.append(text[: len(rolled)][inside])
    at = np.concatenate(grams) if grams else np.zeros(0, _U)
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    per_text = np.bincount(owner, minlength=n_texts)
    at = (at >> _U(64 - PLAN.bits)).astype(np.int64)
    at[at == 0] = 1
    at, owner = np.concatenate([at, np.zeros(n_texts, np.int64)]), np.concatenate([owner, np.arange(n_texts)])
    at, counts, bounds = linear.sparse(at, owner, n_texts, table)
    x = counts * np.repeat(30.0 / np.maximum(per_text, 1), np.diff(bounds))
    return at, np.where(at == 0, 1.0, x), bounds


def fit(documents: DataFrame, labels: DataFrame, plan: linear.TrainingPlan = PLAN):
    return linear.fitted(documents, labels, plan, features)


def score(documents: DataFrame, labels: DataFrame, plan: linear.TrainingPlan = PLAN) -> DataFrame:
    """`documents` with score, the estimated probability of quality 1, from its text alone."""
    return linear.scored(documents, fit(documents, labels, plan), plan, features)


def quality_query(documents: DataFrame, labels: DataFrame, plan: linear.TrainingPlan = PLAN) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 from THRESHOLD on)."""
    out = score(documents.select("doc_id", "text"), labels, plan)
    return out.select("doc_id", linear.held_out(plan).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
