"""A full read of all sources: fetch, hydrate what needs a second stage, land the payloads, report what failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import postings as boards
from .requests import Boards
from .specs import PAYLOAD_SCHEMA, fetched, hydrated

REPORTED = 15


def land(specs: DataFrame, transport: Boards, folder: str, keep: Column | None = None, tasks: int = 32) -> DataFrame:
    """Fetch every spec into Parquet under `folder` and return the raw rows: payloads, or errors that name their source.

    Search hits of the two-stage board are filtered by `keep` (on title, location, req_id) before any is fetched. What was
    fetched is landed first, so nothing downstream fetches again.
    """
    spark = specs.sparkSession
    fetched(specs, transport, tasks).write.mode("overwrite").parquet(f"{folder}/first")
    first = spark.read.schema(PAYLOAD_SCHEMA).parquet(f"{folder}/first")
    hydrated(boards.workday_stubs(first.where("payload IS NOT NULL")), transport.detail, keep, tasks).write.mode("overwrite").parquet(f"{folder}/second")
    second = spark.read.schema(PAYLOAD_SCHEMA).parquet(f"{folder}/second")
    return first.where("kind <> 'workday' OR payload IS NULL").unionByName(second)


def failures(raw: DataFrame) -> DataFrame:
    """One line for each source that could not be fetched or read."""
    return raw.where("payload IS NULL").select("error").unionByName(boards.errors(raw.where("payload IS NOT NULL")))


def report(raw: DataFrame, most: int = REPORTED) -> tuple[int, list[str]]:
    """How many failures there were, and the first of them in order."""
    rows = failures(raw)
    return rows.count(), [r["error"] for r in rows.orderBy(F.col("error")).limit(most).collect()]
