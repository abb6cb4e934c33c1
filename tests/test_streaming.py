from __future__ import annotations

import time
from datetime import datetime, timedelta

import pytest

from jobweave.operators.store import Store
from jobweave.operators.writes import as_postings
from jobweave.streaming import ingest as stream
from jobweave.streaming.ingest import Funnel, ingest

NOW = datetime(2024, 3, 5, 12)
FIELDS = "id string, source string, source_id string, company string, title string, url string, location string, description string, posted_at timestamp, fetched_at timestamp"


def post(n, source, text="words", at=NOW, title="T", place="Austin, TX"):
    return (f"j{n}", source, str(n), "Acme", title, f"http://x/{n}", place, text, None, at)


@pytest.fixture
def feed(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")

    def take(*rows, horizon=timedelta(days=90)):
        as_postings(spark.createDataFrame(list(rows), FIELDS)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/landed")
        query = ingest(spark, f"{tmp_path}/landed", store, f"{tmp_path}/check", horizon)
        query.awaitTermination(180)
        assert query.exception() is None
        return sorted((r["id"], r["source"], r["description"]) for r in store.read("job_postings").collect())

    take.store = store
    return take


def test_a_better_source_replaces_the_stored_one(feed):
    assert feed(post(1, "adzuna"), post(2, "lever", title="Other")) == [("j1", "adzuna", "words"), ("j2", "lever", "words")]
    # a better source, and a worse one of the other job
    assert feed(post(3, "greenhouse", "x"), post(4, "remotive", "longer words", title="Other")) == [("j2", "lever", "words"), ("j3", "greenhouse", "x")]
    # a new version of the best one, an old version of it, and one of an equal source that is longer
    later = NOW + timedelta(hours=2)
    got = feed(post(3, "greenhouse", "new text", later), post(3, "greenhouse", "stale", NOW - timedelta(hours=1)), post(5, "ashby", "longer than the other", title="Other"))
    assert got == [("j3", "greenhouse", "new text"), ("j5", "ashby", "longer than the other")]
    # first seen stays, one transaction a batch
    held = {r["id"]: r["fetched_at"] for r in feed.store.read("job_postings").collect()}
    assert held["j3"] == NOW and feed.store.version("job_postings") == 3


def test_no_text_goes_to_the_state_and_the_chosen_ones_are_read_where_they_landed(spark, tmp_path, monkeypatch):
    folder, store, frame = f"{tmp_path}/a b%41c", Store(spark, f"file://{tmp_path}/store"), type(spark.range(1))
    for k, text in enumerate(("one", "two", "six")):  # as long as each other, so only the place tells them apart
        as_postings(spark.createDataFrame([post(9 - k, "lever", text), post(20 + k, "ashby", f"{text}s", title=f"Other {k}")], FIELDS)).coalesce(1).write.mode("append").parquet(f"{folder}/part[{k}]")
    seen, group = [], frame.groupBy
    monkeypatch.setattr(frame, "groupBy", lambda df, *by: seen.append(df) or group(df, *by))
    stream.chosen(stream.landed(spark, f"{folder}/*"))
    monkeypatch.undo()
    assert {"id", "fetched_at"} <= set(seen[0].columns) and not {"description", "title", "url"} & set(seen[0].columns)
    query = ingest(spark, f"{folder}/*", store, f"{tmp_path}/check")
    query.awaitTermination(180)
    assert query.exception() is None
    got = sorted((r["id"], r["description"]) for r in store.read("job_postings").collect())
    assert got == [("j20", "ones"), ("j21", "twos"), ("j22", "sixs"), ("j7", "six")]


def test_the_best_one_goes_if_it_is_out_of_reach_and_jobs_are_forgotten(feed):
    short = dict(horizon=timedelta(days=3))
    assert len(feed(post(1, "lever"), post(2, "lever", title="Other"), **short)) == 2
    # the place is part of the key, so this is another job; but the posting is the same one
    assert [i for i, _, _ in feed(post(1, "lever", at=NOW + timedelta(hours=1), place="Berlin, Germany"), **short)] == ["j2"]
    # a worse source changes nothing until the first job is forgotten, some days of event time later
    assert [i for i, _, _ in feed(post(7, "adzuna", at=NOW + timedelta(hours=2), title="Other"), **short)] == ["j2"]
    later = NOW + timedelta(days=40)
    feed(post(8, "lever", at=later, title="Clock"), **short)
    feed(post(8, "lever", at=later + timedelta(hours=1), title="Clock"), **short)
    assert ("j9", "adzuna", "back") in feed(post(9, "adzuna", "back", later + timedelta(hours=2), title="Other"), **short)


def test_the_counts_of_each_batch_land_in_the_metrics(spark, feed):
    funnel = Funnel(feed.store)
    spark.streams.addListener(funnel)
    try:
        feed(post(1, "lever"), post(2, "adzuna"), post(3, "lever", title="Far", place="Berlin, Germany"))
        wanted = {("stream_landed", 3), ("stream_chosen", 2), ("stream_eligible", 1)}
        for _ in range(60):
            got = {(r["metric"], r["value"]) for r in feed.store.read("analytics_daily").collect()}
            if got >= wanted:
                break
            time.sleep(1)
    finally:
        spark.streams.removeListener(funnel)
    assert got == wanted and funnel.failed is None
