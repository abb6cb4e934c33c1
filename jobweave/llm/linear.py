"""Hashed sparse linear classifiers: a bounded labelled sample, follow-the-regularised-leader training, sparse scoring.

Training runs in one executor task on the bounded sample; only the non-zero weights leave it. Scoring is one pass over
the documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textops import slices
from .workspace import arrow_limits, tidy

#: (bytes, offsets) -> feature buckets (sorted, distinct in each text), values, bounds of each text.
Features = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
#: (bytes of one text, its place in the sample) -> bytes of its counterfactual, or None.
Counterfactual = Callable[[bytes, int], "bytes | None"]


@dataclass(frozen=True)
class TrainingPlan:
    """Parameters of a fit.

    Two bounds hold the sample: of each class about `rows_per_class` labelled rows are drawn by hash, and of these, in the
    order of their hashes, as many whole texts as `sample_bytes` hold are learned from.
    """

    label: str
    folds: int
    held_out_fold: int
    rows_per_class: int = 6000
    sample_bytes: int = 256 << 20
    epochs: int = 4
    alpha: float = 0.1
    beta: float = 1.0
    l1: float = 0.5
    l2: float = 1.0
    bits: int = 22
    pairing: float = 0.0


def held_out(plan: TrainingPlan, doc_id="doc_id"):
    """Whether a document belongs to the fold that training never sees; a null id does not."""
    fold = F.crc32(F.col(doc_id).cast("string").cast("binary")) % plan.folds
    return F.coalesce(fold == plan.held_out_fold, F.lit(False))


def labelled_sample(documents: DataFrame, labels: DataFrame, plan: TrainingPlan) -> DataFrame:
    """About `rows_per_class` labelled texts of each class, outside the held-out fold: text, label, place (a hash that orders them).

    Labels other than 0 and 1 and null ids are left out; a doc_id labelled twice counts once, with its larger label.
    """
    own = labels.select("doc_id", F.col(plan.label).cast("int").alias("label"))
    own = own.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(plan)).groupBy("doc_id").agg(F.max("label").alias("label"))
    sizes = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
    share = F.create_map(*[x for k in (0, 1) for x in (F.lit(k), F.lit(min(1.0, plan.rows_per_class / max(1, sizes.get(k, 0)))))])
    place = F.xxhash64("doc_id", F.lit(17))
    drawn = own.withColumn("place", place).where(F.pmod("place", F.lit(1 << 30)) < share[F.col("label")] * (1 << 30))
    found = documents.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", "label", "place")
    # a bounded number of rows, in one partition: the running sum is no bottleneck there
    so_far = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.orderBy("place", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn("before", F.coalesce(so_far, F.lit(0))).where(F.col("before") < plan.sample_bytes).drop("before")


class Leader:
    """Per-coordinate follow-the-regularised-leader (proximal) logistic regression over so many features."""

    def __init__(self, plan: TrainingPlan, size: int):
        self.plan, self.z, self.n = plan, np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray) -> np.ndarray:
        p, z = self.plan, self.z[at]
        w = -(z - np.sign(z) * p.l1) / ((p.beta + np.sqrt(self.n[at])) / p.alpha + p.l2)
        w[np.abs(z) <= p.l1] = 0.0
        return w

    def update(self, at: np.ndarray, gradient: np.ndarray, w: np.ndarray) -> None:
        n = self.n[at]
        new = n + gradient * gradient
        self.z[at] += gradient - (np.sqrt(new) - np.sqrt(n)) / self.plan.alpha * w
        self.n[at] = new

    def learn(self, at: np.ndarray, x: np.ndarray, y: int, weight: float) -> None:
        w = self.weights(at)
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
        self.update(at, weight * (p - y) * x, w)

    def pair(self, at: np.ndarray, gap: np.ndarray) -> None:
        """Penalise the squared change of the score between a text and its counterfactual; `gap` is the change of the features."""
        w = self.weights(at)
        self.update(at, self.plan.pairing * 2.0 * (w @ gap) * gap, w)


@dataclass
class Model:
    """Non-zero weights (buckets, values), and how many texts and how many counterfactual pairs they were learned from."""

    at: np.ndarray
    w: np.ndarray
    texts: int = 0
    pairs: int = 0


def fit(rows: list[tuple[bytes, int]], plan: TrainingPlan, features: Features, counterfactual: Counterfactual | None = None) -> Model:
    """Classes weigh alike in all; without rows of both classes the score is constant."""
    cases, pairs = [], []

    def of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
        at, x, _ = features(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        return at.astype(np.int32), x.astype(np.float32)

    sizes = np.bincount([y for _, y in rows], minlength=2)
    for place, (text, y) in enumerate(rows):
        at, x = of(text)
        cases.append((at, x, y, len(rows) / (2.0 * sizes[y])))
        swapped = counterfactual(text, place) if counterfactual else None
        if swapped is not None:
            at2, x2 = of(swapped)
            both = np.union1d(at, at2)
            gap = np.zeros(len(both), np.float32)
            gap[np.searchsorted(both, at)] += x
            gap[np.searchsorted(both, at2)] -= x2
            pairs.append((both[gap != 0], gap[gap != 0]))
        else:
            pairs.append(None)
    # the features that occur, numbered without gaps
    seen = np.zeros(1 << plan.bits, bool)
    for own in [*cases, *(p for p in pairs if p is not None)]:
        seen[own[0]] = True
    used = np.flatnonzero(seen)
    del seen
    small = lambda at: np.searchsorted(used, at).astype(np.int32)
    cases = [(small(at), *rest) for at, *rest in cases]
    pairs = [p and (small(p[0]), p[1]) for p in pairs]
    model, order = Leader(plan, len(used)), np.random.Generator(np.random.PCG64(1))
    for _ in range(plan.epochs):
        for k in order.permutation(len(cases)):
            model.learn(*cases[k])
            if pairs[k] is not None and len(pairs[k][0]):
                model.pair(*pairs[k])
    kept = np.flatnonzero(np.abs(model.z) > plan.l1)
    return Model(used[kept], model.weights(kept), len(rows), sum(p is not None and len(p[0]) > 0 for p in pairs))


def fitted(documents: DataFrame, labels: DataFrame, plan: TrainingPlan, features: Features, swaps: Callable[[list[tuple[bytes, int]]], Counterfactual] | None = None) -> Model:
    """Draw the sample and train on it in one task; only the non-zero weights come back. `swaps` makes the counterfactual from the sample."""
    arrow_limits(documents.sparkSession)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((place, y, text or "") for b in batches for text, y, place in zip(*(b.column(c).to_pylist() for c in ("text", "label", "place")), strict=True))
        texts = [(text.encode(), y) for _, y, text in rows]
        del rows
        found = fit(texts, plan, features, swaps(texts) if swaps and texts else None)
        del texts
        # the first row says how much was learned from
        yield pa.RecordBatch.from_arrays([pa.array([found.texts, *found.at], pa.int64()), pa.array([found.pairs, *found.w], pa.float64())], ["at", "w"])

    found = labelled_sample(documents, labels, plan).repartition(1).mapInArrow(tidy(train), "at long, w double").toArrow()
    at, w = found.column("at").to_numpy(), found.column("w").to_numpy()
    return Model(at[1:], w[1:], int(at[0]), int(w[0])) if len(at) else Model(at, w)


def scored(documents: DataFrame, model: Model, plan: TrainingPlan, features: Features, name: str = "score") -> DataFrame:
    """`documents` with a column `name` (in place of one they have): the logistic function of the sparse dot product with the whole text. A null text scores as an empty one."""
    spark = documents.sparkSession
    arrow_limits(spark)
    shared = spark.sparkContext.broadcast((model.at.astype(np.int64), model.w.astype(np.float32)))
    bits = plan.bits
    kept = [c for c in documents.columns if c.lower() != name.lower()]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, np.float32)
        at, w = shared.value
        table[at] = w
        for batch in batches:
            out = np.empty(batch.num_rows)
            for row, stop, data, offsets in slices(batch.column("text")):
                found, x, bounds = features(data, offsets, table)
                sums = np.zeros(len(found) + 1)
                np.cumsum(table[found] * x, out=sums[1:])
                out[row:stop] = sums[bounds[1:]] - sums[bounds[:-1]]
            out = 1.0 / (1.0 + np.exp(-np.clip(out, -35, 35)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out)], [*kept, name])

    schema = documents.select(*kept).withColumn(name, F.lit(0.0)).schema
    return documents.select(*kept).mapInArrow(tidy(score), schema)


def sparse(at: np.ndarray, text: np.ndarray, n_texts: int, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct buckets of each text, how often each occurs, and each text's bounds; with a weight table, only the buckets that weigh."""
    if table is not None:
        weighs = np.flatnonzero(table[at])
        at, text = at[weighs], text[weighs]
    key, counts = np.unique((text.astype(np.uint64) << np.uint64(32)) | at.astype(np.uint64), return_counts=True)
    return (key & np.uint64(0xFFFFFFFF)).astype(np.int64), counts, np.searchsorted(key >> np.uint64(32), np.arange(n_texts + 1))
