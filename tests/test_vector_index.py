from __future__ import annotations

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobweave.operators import reads, vectors
from jobweave.operators.vector_index import IndexPlan, VectorIndex

NOW = datetime(2024, 3, 5, 12)
ROWS = "job_id string, chunk_index int, chunk_text string, embedding array<float>, model_name string"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Six thousand vectors around sixty centres, two chunks a job; one job in fifty is remote."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 32))
    points = centres[rng.integers(0, 60, 6000)] + 0.6 * rng.normal(size=(6000, 32))
    e = spark.createDataFrame([(f"j{k // 2}", k % 2, f"c{k}", p.tolist(), "m") for k, p in enumerate(points)], ROWS)
    p = spark.createDataFrame([(f"j{k}", f"j{k}", k % 50 == 0) for k in range(3000)], "id string, cross_source_key string, remote boolean")
    index = VectorIndex(spark, f"file://{tmp_path_factory.mktemp('index')}/i", IndexPlan(lists=64, probes=6))
    index.build(e)
    return e.cache(), p.cache(), index, points


def found(e, p, query, filters, index=None, k=10):
    return [r["id"] for r in vectors.search(e, p, query, NOW, k, filters, index=index).collect()]


def test_recall_and_share_of_vectors_opened(made):
    e, p, index, points = made
    hits = opened = 0
    wanted = p.select(F.col("id").alias("job_id"))
    for k in range(0, 6000, 600):
        exact, near = (found(e, p, points[k].tolist(), reads.Filters(), i) for i in (None, index))
        hits += len(set(exact) & set(near))
        opened += index.rows([points[k].tolist()], wanted, 100).count()
    assert hits / 100 >= 0.9 and opened / (10 * 6000) <= 0.25, (hits, opened)


def test_a_selective_filter_reaches_further_and_loses_nothing(made):
    e, p, index, points = made
    for k in (0, 3000):
        query = points[k].tolist()
        exact, near = (found(e, p, query, reads.Filters(remote_only=True), i) for i in (None, index))
        assert near == exact and len(near) == 10
    few = p.where("remote").select(F.col("id").alias("job_id"))
    assert len(index.chosen([points[0].tolist()], few, 100)) > len(index.chosen([points[0].tolist()], p.select(F.col("id").alias("job_id")), 100))


def test_only_files_of_the_chosen_lists_are_opened(made):
    _, p, index, points = made
    rows = index.rows([points[0].tolist()], p.select(F.col("id").alias("job_id")), 100)
    assert 0 < len(rows.inputFiles()) < len(index.store.manifest("rows").files)


def test_renewed_jobs_are_found_at_their_new_place(spark, tmp_path):
    index = VectorIndex(spark, f"file://{tmp_path}/i", IndexPlan(lists=4, probes=1, slack=0))
    rows = [(f"j{k}", 0, "c", [float(k % 4 == d) + 0.01 * k for d in range(4)], "m") for k in range(40)]
    index.build(spark.createDataFrame([*rows, ("none", 0, "c", None, "m")], ROWS))
    index.renew(spark.createDataFrame([("j0", 0, "new", [0.0, 0.0, 0.0, 9.0], "m")], ROWS))
    held = index.store.read("rows")
    assert held.count() == 40 and held.where("job_id = 'j0'").first()["chunk_text"] == "new"
    assert held.where("job_id = 'j0'").first()["list"] == held.where("job_id = 'j3'").first()["list"]


def test_an_index_of_nothing_finds_nothing(spark, tmp_path):
    index = VectorIndex(spark, f"file://{tmp_path}/i")
    index.build(spark.createDataFrame([], ROWS))
    assert index.rows([[1.0]], spark.createDataFrame([("j",)], "job_id string"), 10).isEmpty()
