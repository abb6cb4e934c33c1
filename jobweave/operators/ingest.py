"""Deduplication of postings, the geographic prefilter, and the funnel that counts each stage as it streams by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import us_eligible
from ..schemas import DEFAULT_PRIORITY, SOURCE_PRIORITY


def freshest() -> list[Column]:
    return [F.desc_nulls_last("fetched_at"), F.asc("source"), F.asc("content_hash")]


def best() -> list[Column]:
    return [source_priority(F.col("source")).asc(), F.length(F.coalesce("description", F.lit(""))).desc(), F.asc("id")]


def stage_counts(postings: DataFrame) -> DataFrame:
    """Rows of the funnel's stages (stage, n) as one plan: rows are marked instead of dropped, so each window counts what it keeps."""
    mark = lambda keys, order: F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1
    rows = postings.withColumn("unique_ids", mark(["id"], freshest()))
    rows = rows.withColumn("unique_jobs", F.col("unique_ids") & mark(["cross_source_key", "unique_ids"], best()))
    rows = rows.withColumn("eligible", F.col("unique_jobs") & us_eligible(F.col("location")))
    counts = rows.agg(F.count("*").alias("fetched"), *[F.count_if(c).alias(c) for c in ("unique_ids", "unique_jobs", "eligible")])
    return counts.unpivot([], ["fetched", "unique_ids", "unique_jobs", "eligible"], "stage", "n")


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; the row-number filter lets Spark prune groups before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def source_priority(source: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in SOURCE_PRIORITY.items() for x in pair])
    return F.coalesce(known[source], F.lit(DEFAULT_PRIORITY))


def latest_by_id(postings: DataFrame) -> DataFrame:
    """The freshest row of each id; ties by source and content hash, so a run repeats itself."""
    return first_of(postings, ["id"], freshest())


def best_across_sources(postings: DataFrame) -> DataFrame:
    """One row of each real-world job: by source priority, then the longest description, then id."""
    return first_of(postings, ["cross_source_key"], best())


def eligible(postings: DataFrame) -> DataFrame:
    return postings.where(us_eligible(F.col("location")))


def funnel(postings: DataFrame, observe: bool = True) -> tuple[DataFrame, list]:
    """The three stages, and an observation for each that is filled by whatever action runs the result: no extra pass."""
    from pyspark.sql import Observation

    seen, out = [], postings
    for name, stage in (("fetched", None), ("unique_ids", latest_by_id), ("unique_jobs", best_across_sources), ("eligible", eligible)):
        out = stage(out) if stage else out
        if observe:
            seen.append(Observation(name))
            out = out.observe(seen[-1], F.count(F.lit(1)).alias("rows"))
    return out, seen


def by_source(postings: DataFrame) -> DataFrame:
    return postings.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source")
