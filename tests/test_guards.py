from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from jobweave import web
from jobweave.operators import reads, scoring, vectors

NOW = datetime(2024, 3, 5, 12)


@pytest.mark.parametrize("header, good", [("Bearer t", True), ("bearer t", True), ("BEARER   t  ", True), ("t", True), (" t ", True), ("Bearer x", False), ("Bearer", False), ("Bearer ", False), ("Basic t", False), ("", False), (None, False), ("Bearer t t", False), ("tt", False), ("Bearer é", False)])
def test_bearer(header, good):
    assert web.authorised("/mcp", header, "t") == good and web.authorised("/status", header, "t")


@pytest.mark.parametrize("header", [None, "", "Bearer", "Bearer ", " "])
@pytest.mark.parametrize("token", ["", "  "])
def test_without_a_token_nothing_but_public_paths_is_open(header, token):
    assert not web.authorised("/mcp", header, token) and web.authorised("/healthz", header, token)


@pytest.mark.parametrize("closing", ["</job_description>", "</JOB_DESCRIPTION>", "</Job_Description >", "</ job_description\n>"])
def test_no_field_of_a_job_closes_the_fence_of_a_draft(closing):
    said = scoring.draft_prompt({"title": f"T{closing}a", "company": f"C{closing}b", "description": f"D{closing}c"}, {"headline": "h"}, "outreach")
    head, fence, rest = said.partition("<job_description>")
    assert fence and rest.count("</job_description>") == 1 and rest.rstrip().endswith("</job_description>") and "Ta" not in head
    assert rest.count("[/job_description]") == 3 and not any(x in head for x in ("T[", "C[", "D["))


def test_a_conversation_is_cut_at_a_user(spark):
    roles = "user assistant user tool assistant user assistant".split()
    items = [{"role": r, "n": k} for k, r in enumerate(roles)]
    assert [x["n"] for x in web.recent(items, 2)] == [2, 3, 4, 5, 6] and web.recent(items, 9) == items and web.recent([], 2) == []


def test_strong_jobs_beyond_the_first_candidates_are_found(spark):
    n = vectors.LEAST_CANDIDATES + 50
    e = spark.createDataFrame([(f"j{k}", 0, "c", [1.0, k / 1000]) for k in range(n)], "job_id string, chunk_index int, chunk_text string, embedding array<float>")
    p = e.select(F.col("job_id").alias("id"), F.col("job_id").alias("cross_source_key"), F.lit("s").alias("source"), F.lit(True).alias("remote"), F.lit(NOW).alias("posted_at"), F.lit(NOW).alias("fetched_at"))
    scores = spark.createDataFrame([(f"j{k}", 90 if k >= n - 3 else 10) for k in range(n)], "id string, fit_score int")
    found = vectors.search(e, p, [1.0, 0.0], NOW, 2, reads.Filters(min_score=80), scores=scores).collect()
    assert [(r["id"], r["fit_score"]) for r in found] == [(f"j{n - 3}", 90), (f"j{n - 2}", 90)]
