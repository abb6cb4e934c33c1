"""An inverted-file index beside the vectors, for cosine top-k under a filter.

Vectors lie in lists by their nearest centroid; centroids come from spherical k-means on a bounded sample, lists from all
rows. A search ranks the lists by their centroids and counts, without opening a vector, how many rows of each list pass the
filter; it opens lists in that order until `probes` of those with any have been taken and they hold `slack` times the
candidates wanted. So a selective filter reaches further instead of returning too little, and where every list is needed
the answer is the exact one. Distances within the opened lists are exact.

The lists are buckets of a store, so a search opens only the files that can hold its lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import Store

_ROWS = T.StructType([T.StructField("list", T.IntegerType()), T.StructField("job_id", T.StringType()), T.StructField("chunk_index", T.IntegerType()), T.StructField("chunk_text", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("model_name", T.StringType())])
_CENTROIDS = T.StructType([T.StructField("list", T.IntegerType()), T.StructField("centroid", T.ArrayType(T.FloatType()))])


@dataclass(frozen=True)
class IndexPlan:
    """Lists, rows of the sample that centroids are learned from, rounds of k-means, lists opened at least, rows opened for each candidate wanted."""

    lists: int = 64
    sample: int = 8192
    rounds: int = 12
    probes: int = 8
    slack: int = 4


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=-1, keepdims=True), 1e-12)


def centroids(sample: np.ndarray, plan: IndexPlan) -> np.ndarray:
    """Spherical k-means from rows spread over the sample; a list that runs empty takes the row that fits its own worst."""
    rows = _unit(sample.astype(np.float64))
    out = rows[np.linspace(0, len(rows) - 1, min(plan.lists, len(rows))).astype(int)].copy()
    for _ in range(plan.rounds):
        near = rows @ out.T
        own = near.argmax(1)
        fit = near[np.arange(len(rows)), own]
        for k in range(len(out)):
            mine = rows[own == k]
            if len(mine):
                out[k] = mine.sum(0)
            else:
                worst = int(fit.argmin())
                out[k], fit[worst] = rows[worst], np.inf
        out = _unit(out)
    return out.astype(np.float32)


class VectorIndex:
    def __init__(self, spark: SparkSession, root: str, plan: IndexPlan = IndexPlan()):
        self.spark, self.plan = spark, plan
        self.store = Store(spark, root, {"rows": _ROWS, "centroids": _CENTROIDS}, {"rows": ("list",)}, buckets=max(plan.lists // 4, 1))
        self._held: tuple[int | None, np.ndarray] = (None, np.zeros((0, 0), np.float32))

    def centroids(self) -> np.ndarray:
        version = self.store.version("centroids")
        if self._held[0] != version:
            held = self.store.read("centroids").orderBy("list").collect()  # a row for each list
            self._held = version, np.array([r["centroid"] for r in held], np.float32)
        return self._held[1]

    def build(self, embeddings: DataFrame) -> None:
        """Learn the lists and put all rows into them."""
        good = embeddings.where(F.col("embedding").isNotNull())
        order = F.xxhash64("job_id", "chunk_index")
        sample = np.array([r["embedding"] for r in good.select("embedding", order.alias("h")).orderBy("h").limit(self.plan.sample).collect()], np.float32)
        learned = centroids(sample, self.plan) if len(sample) else np.zeros((0, 0), np.float32)
        with self.store.begin() as own:
            own.write("centroids", self.spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(learned)], _CENTROIDS))
            own.write("rows", self._listed(good, learned))

    def renew(self, embeddings: DataFrame) -> None:
        """Replace all vectors of the jobs in `embeddings`; the lists stay as they were learned."""
        self.store.replace("rows", self._listed(embeddings.where(F.col("embedding").isNotNull()), self.centroids()), ["job_id"])

    def _listed(self, embeddings: DataFrame, learned: np.ndarray) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    rows = np.stack(frame["embedding"].to_numpy()).astype(np.float32)
                    yield frame.assign(list=(rows @ learned.T).argmax(1).astype(np.int32))[_ROWS.names]

        return embeddings.select(*[c for c in _ROWS.names if c != "list"]).mapInPandas(run, _ROWS)

    def chosen(self, queries: list[list[float]], wanted: DataFrame, candidates: int) -> list[int]:
        """The lists to open for rows of the jobs in `wanted` (job_id); of several queries the nearest counts."""
        learned = self.centroids()
        if not len(learned):
            return []
        near = (_unit(np.array(queries, np.float32)) @ learned.T).max(0)
        held = self.store.read("rows").select("job_id", "list").join(wanted.select("job_id").distinct(), "job_id", "left_semi").groupBy("list").agg(F.count("*").alias("n"))
        counts = {r["list"]: r["n"] for r in held.collect()}  # a row for each list
        out, rows = [], 0
        for k in np.argsort(-near, kind="stable").tolist():
            if len(out) >= self.plan.probes and rows >= self.plan.slack * candidates:
                break
            if counts.get(k):
                out.append(k)
                rows += counts[k]
        return out

    def rows(self, queries: list[list[float]], wanted: DataFrame, candidates: int) -> DataFrame:
        """The vectors among which the nearest of `wanted` are looked for."""
        return self.store.among("rows", "list", self.chosen(queries, wanted, candidates))
