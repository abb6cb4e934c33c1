"""The reads of the operational tables. Time-dependent ones take `as_of`; every order is total."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import instant_of, whole_days
from ..schemas import CLOSED_STATUSES
from .store import Store

PAGE = 25
INSIGHT_DAYS = 90


@dataclass(frozen=True)
class Filters:
    """What is blank or zero filters nothing. `min_score` needs a user and drops unscored postings."""

    source: str | None = None
    remote_only: bool = False
    posted_within_days: int | None = None
    min_score: int | None = None

    def predicate(self, as_of: datetime, score: Column | None = None) -> Column:
        out = F.lit(True)
        if self.source:
            out &= F.col("source") == self.source
        if self.remote_only:
            out &= F.col("remote")
        if self.posted_within_days:
            out &= F.coalesce("posted_at", "fetched_at") >= instant_of(as_of) - F.make_interval(days=F.lit(self.posted_within_days))
        if self.min_score is not None and score is not None:
            out &= score >= self.min_score
        return out


def with_user(postings: DataFrame, scores: DataFrame, saved: DataFrame, applications: DataFrame, user_id: int) -> DataFrame:
    """Each posting with this user's score, whether it is saved, and their application. The user is filtered before the joins."""
    mine = lambda df, *cols: df.where(F.col("user_id") == user_id).select(*cols)
    id_ = F.col("job_id").alias("id")
    out = postings.join(mine(scores, id_, "fit_score", F.col("reason").alias("fit_reason")), "id", "left")
    out = out.join(mine(saved, id_, F.lit(True).alias("saved")), "id", "left").withColumn("saved", F.coalesce("saved", F.lit(False)))
    return out.join(mine(applications, id_, F.col("id").alias("application_id"), F.col("status").alias("application_status")), "id", "left")


def best_first() -> list[Column]:
    return [F.desc_nulls_last("fit_score"), F.coalesce("posted_at", "fetched_at").desc_nulls_last(), F.asc("id")]


class Reads:
    def __init__(self, store: Store):
        self.t = store.read

    def _all(self, user_id: int) -> DataFrame:
        return with_user(self.t("job_postings"), self.t("job_scores"), self.t("saved_jobs"), self.t("applications"), user_id)

    def list_jobs(self, user_id: int, as_of: datetime, filters: Filters = Filters(), limit: int = PAGE, offset: int = 0) -> DataFrame:
        return self._all(user_id).where(filters.predicate(as_of, F.col("fit_score"))).orderBy(*best_first()).offset(offset).limit(limit)

    def jobs_counted(self, as_of: datetime, filters: Filters = Filters(), user_id: int | None = None) -> DataFrame:
        """One row, n. The score table is joined only if a score is asked for: the join keeps every row otherwise."""
        rows, score = self.t("job_postings"), None
        if filters.min_score is not None and user_id is not None:
            rows = rows.join(self.t("job_scores").where(F.col("user_id") == user_id).select(F.col("job_id").alias("id"), "fit_score"), "id", "left")
            score = F.col("fit_score")
        return rows.where(filters.predicate(as_of, score)).agg(F.count("*").alias("n"))

    def count_jobs(self, as_of: datetime, filters: Filters = Filters(), user_id: int | None = None) -> int:
        return self.jobs_counted(as_of, filters, user_id).first()["n"]

    def get_job(self, job_id: str, user_id: int) -> DataFrame:
        return self._all(user_id).where(F.col("id") == job_id).limit(1)

    def get_user(self, email: str) -> DataFrame:
        return self.t("users").where(F.col("email") == email).limit(1)

    def list_saved(self, user_id: int, limit: int = 100) -> DataFrame:
        saved = self.t("saved_jobs").where(F.col("user_id") == user_id).select(F.col("job_id").alias("id"), "note", "saved_at")
        out = self.t("job_postings").join(saved, "id")
        for name, cols in (("job_scores", ("fit_score",)), ("applications", ("status",))):
            out = out.join(self.t(name).where(F.col("user_id") == user_id).select(F.col("job_id").alias("id"), *cols), "id", "left")
        return out.orderBy(F.desc("saved_at"), "id").limit(limit)

    def list_applications(self, user_id: int, as_of: datetime, status: str | None = None, stale_days: int | None = None) -> DataFrame:
        """Newest change first, with whole days since it and the notes newest first ([] where there are none)."""
        own = self.t("applications").where(F.col("user_id") == user_id)
        now = instant_of(as_of)
        if status:
            own = own.where(F.col("status") == status)
        if stale_days:
            own = own.where(is_stale(F.col("updated_at"), F.col("status"), as_of, stale_days))
        jobs = self.t("job_postings").select(F.col("id").alias("job_id"), "company", "title", "url", "location", "source")
        notes = self.t("interview_notes").join(own.select(F.col("id").alias("application_id")), "application_id", "left_semi")
        out = own.join(jobs, "job_id").join(notes_of(notes), F.col("id") == F.col("application_id"), "left").drop("application_id")
        empty = F.array().cast("array<struct<created_at: timestamp, note: string>>")
        return out.withColumn("notes", F.coalesce("notes", empty)).withColumn("days_since_update", whole_days(F.col("updated_at"), now)).orderBy(F.desc("updated_at"), "id")

    def get_profile(self, user_id: int) -> DataFrame:
        skills = self.t("skills").where(F.col("user_id") == user_id).groupBy("user_id").agg(F.sort_array(F.collect_list("skill")).alias("skills"))
        own = self.t("profiles").where(F.col("user_id") == user_id)
        return own.join(skills, "user_id", "left").withColumn("skills", F.coalesce("skills", F.array().cast("array<string>")))

    def analytics(self, as_of: date, days: int = 30, metric: str | None = None) -> DataFrame:
        rows = self.t("analytics_daily").where(F.col("day") >= F.date_sub(F.lit(as_of), days))
        rows = rows.where(F.col("metric") == metric) if metric else rows
        return rows.orderBy(*by_metric())

    def computed(self) -> DataFrame:
        """One row: when the metrics were last published."""
        return self.t("analytics_daily").agg(F.max("computed_at").alias("computed_at"))

    def last_computed(self) -> datetime | None:
        return self.computed().first()["computed_at"]

    def totals(self, as_of: date, metric: str, days: int = INSIGHT_DAYS) -> DataFrame:
        """What a metric sums to over the window, for each dimension; a metric without dimensions is one total, `all`."""
        rows = self.t("analytics_daily").where((F.col("metric") == metric) & (F.col("day") >= F.date_sub(F.lit(as_of), days)))
        return rows.groupBy(F.coalesce("dimension", F.lit("all")).alias("dimension")).agg(F.sum("value").alias("total")).orderBy(F.desc("total"), "dimension")

    def latest_moves(self, as_of: date, days: int = INSIGHT_DAYS, most: int = PAGE) -> DataFrame:
        """The last rows of the metrics that say what somebody did: day, metric, dimension, value, newest first."""
        rows = self.t("analytics_daily").where(F.col("metric").isin(*MOVES) & (F.col("day") >= F.date_sub(F.lit(as_of), days)))
        return rows.select("day", "metric", "dimension", "value").orderBy(F.desc("day"), F.desc("metric"), F.desc_nulls_last("dimension"), F.desc("value")).limit(most)

    def stats(self) -> DataFrame:
        """One row of counts."""
        one = lambda table, value: self.t(table).agg(value).scalar()
        return self.t("job_postings").agg(F.count("*").alias("postings")).select(
            "postings", one("job_embeddings", F.count("*")).alias("vectors"), one("job_embeddings", F.countDistinct("job_id")).alias("embedded_jobs"),
            one("job_scores", F.count("*")).alias("scored"), one("applications", F.count("*")).alias("applications"),
        )

    def sources(self) -> DataFrame:
        return self.t("job_postings").select("source").distinct().orderBy("source")


# The metrics of what somebody did.
MOVES = ("status_transitions", "applications_created", "jobs_saved")


def by_metric() -> list[Column]:
    """The order in which metrics are shown."""
    return [F.asc("metric"), F.desc("day"), F.desc("value"), F.asc_nulls_last("dimension")]


def is_stale(updated_at: Column, status: Column, as_of: datetime, days: int) -> Column:
    """No change for so many days, and not closed."""
    return (updated_at < instant_of(as_of) - F.make_interval(days=F.lit(days))) & ~status.isin(*CLOSED_STATUSES)


def notes_of(notes: DataFrame) -> DataFrame:
    """(application_id, notes): an array of (created_at, note), newest first."""
    return notes.groupBy("application_id").agg(F.sort_array(F.collect_list(F.struct("created_at", "note")), asc=False).alias("notes"))


def score_band(score: Column) -> Column:
    """high, mid or low; a score of 0 counts as none."""
    return F.when(score >= 80, "high").when(score >= 60, "mid").when(score != 0, "low").otherwise("none")


def passage_preview(text: Column) -> Column:
    return F.substring(text, 1, 190)


def page_count(total: Column) -> Column:
    """At least one page, even of nothing."""
    return F.greatest(F.lit(1), F.ceil(total / PAGE).cast("int"))


def pages_of(total: int) -> int:
    """The same of a number."""
    return max(1, -(-total // PAGE))


def summary(jobs: DataFrame) -> DataFrame:
    """The fields of a search result: no description, similarity to four places."""
    names = [c for c in ("id", "source", "company", "title", "url", "location", "remote", "salary", "salary_is_estimated", "posted_at", "fit_score", "fit_reason", "saved", "application_status") if c in jobs.columns]
    return jobs.select(*names, *([F.round("similarity", 4).alias("similarity")] if "similarity" in jobs.columns else []), *(["passage"] if "passage" in jobs.columns else []))
