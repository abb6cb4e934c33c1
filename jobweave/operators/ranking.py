"""Skip rules, the final order, and the digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import OTHER_US, location_tier

YEARS_WALL, DIGEST_LIMIT, DIGEST_FLOOR, PER_COMPANY = 8, 10, 65, 2


def skip_reason(wall: int = YEARS_WALL) -> Column:
    """Why a scored job is skipped; null keeps it. The first rule that holds counts; flags that are not known count for nothing."""
    years = F.col("years_required")
    return (
        F.when(years >= wall, F.concat(F.lit("requires "), years.cast("string"), F.lit(f"+ years (the limit is {wall})")))
        .when(F.col("work_authorization") == "foreign_required", "requires a foreign work authorization")
        .when(F.array_contains("skip_flags", "azure_mandatory"), "Azure is a mandatory requirement")
    )


def placed(scored: DataFrame, wall: int = YEARS_WALL) -> DataFrame:
    """`scored` with skip_reason, status and location_tier."""
    out = scored.withColumn("skip_reason", skip_reason(wall))
    out = out.withColumn("status", F.when(F.col("skip_reason").isNull(), "ranked").otherwise("skipped"))
    return out.withColumn("location_tier", location_tier(F.col("location"), F.col("remote"), F.col("workplace"), F.col("office_days_per_month")))


def final_order() -> list[Column]:
    """Kept before skipped, workable before not, score, tier, freshness (undated last), id."""
    return [
        (F.col("status") != "ranked").asc(), (F.col("location_tier") == OTHER_US).asc(), F.desc("score"), F.asc("location_tier"),
        F.coalesce("posted_at", F.timestamp_seconds(F.lit(0))).desc(), F.asc("id"),
    ]


def rank(scored: DataFrame, wall: int = YEARS_WALL) -> DataFrame:
    """Every job, best first."""
    return placed(scored, wall).orderBy(*final_order())


def _company() -> Column:
    return F.lower(F.trim(F.coalesce("company", F.lit(""))))


def limited(rows: DataFrame, keys: list[Column], most: int, order: list[Column]) -> DataFrame:
    """At most so many rows of each key in the given order; a row without a company is a key of its own."""
    own = F.when(_company() == "", F.col("id")).otherwise("")
    n = F.row_number().over(Window.partitionBy(*keys, own).orderBy(*order))
    return rows.withColumn("__n", n).where(F.col("__n") <= most).drop("__n")


def collapse_roles(rows: DataFrame, order: list[Column]) -> DataFrame:
    title = F.lower(F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), r"(?U)\s+", " ")))
    return limited(rows, [_company(), title], 1, order)


def cap_per_company(rows: DataFrame, most: int, order: list[Column]) -> DataFrame:
    return limited(rows, [_company()], most, order)


def digest(ranked: DataFrame, limit: int = DIGEST_LIMIT, floor: int = DIGEST_FLOOR, per_company: int = PER_COMPANY, workable_only: bool = True) -> DataFrame:
    """Strong, kept and workable jobs: one of each role, few of each company, the best `limit`."""
    good = ranked.where((F.col("status") == "ranked") & (F.col("score") >= floor))
    good = good.where(F.col("location_tier") != OTHER_US) if workable_only else good
    order = final_order()
    return cap_per_company(collapse_roles(good, order), per_company, order).orderBy(*order).limit(limit)


def rank_by_location(postings: DataFrame, ordinal: str = "id") -> DataFrame:
    return postings.withColumn("location_tier", location_tier(F.col("location"), F.col("remote"))).orderBy("location_tier", ordinal)
