"""The mutations of the operational tables, each returning the rows it wrote. `now` is a parameter of every one."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime
from typing import TypeVar

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.text import content_hash, cross_source_key, instant_of
from ..schemas import POSTING, STATUSES, TABLES, verify_vectors
from .store import Store, Transaction, with_new_ids

Result = TypeVar("Result")


class UnknownStatus(ValueError):
    pass


def check_status(status: str) -> str:
    if status not in STATUSES:
        raise UnknownStatus(f"{status!r} is no status; use one of {', '.join(STATUSES)}")
    return status


class Writes:
    """Each mutation is one transaction, done again from a fresh state where another writer came first."""

    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark

    def _rows(self, table: str, *rows: dict) -> DataFrame:
        names = TABLES[table].names
        return self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], TABLES[table])

    def _once(self, act: Callable[[Transaction], Result]) -> Result:
        def run() -> Result:
            with self.store.begin() as own:
                return act(own)

        return self.store.retry(run)

    def upsert_postings(self, postings: DataFrame) -> DataFrame:
        """All columns are updated but id and fetched_at, which tells when a posting was first seen."""
        rows = as_postings(postings)
        self._once(lambda own: own.upsert("job_postings", rows, ["id"], keep=("fetched_at",)))
        return self.store.read("job_postings").join(rows.select("id"), "id", "left_semi")

    def replace_vectors(self, vectors: DataFrame, width: int | None = None) -> DataFrame:
        """All vectors of the jobs in `vectors` are replaced; with no rows nothing changes. Returns them as written."""
        if width:
            verify_vectors(vectors, width)
        return self._once(lambda own: own.replace("job_embeddings", vectors, ["job_id"]))

    def reset_vectors(self) -> None:
        self.store.write("job_embeddings", self._rows("job_embeddings"))

    def upsert_scores(self, scores: DataFrame, now: datetime) -> DataFrame:
        if scores.where(~F.col("fit_score").between(0, 100)).limit(1).count():
            raise ValueError("fit_score must lie between 0 and 100")
        rows = scores.withColumn("scored_at", instant_of(now))
        self._once(lambda own: own.upsert("job_scores", rows, ["job_id", "user_id"]))
        return rows

    def save_job(self, user_id: int, job_id: str, now: datetime, note: str | None = None) -> Row:
        row = self._rows("saved_jobs", dict(user_id=user_id, job_id=job_id, note=note, saved_at=now))
        self._once(lambda own: own.upsert("saved_jobs", row, ["user_id", "job_id"], fill=("note",)))
        return self.store.lookup("saved_jobs", user_id=user_id, job_id=job_id).first()

    def unsave_job(self, user_id: int, job_id: str) -> bool:
        def act(own: Transaction) -> bool:
            mine = own.lookup("saved_jobs", user_id=user_id, job_id=job_id)
            found = not mine.isEmpty()
            if found:
                own.delete("saved_jobs", mine, ["user_id", "job_id"])
            return found

        return self._once(act)

    def log_application(self, user_id: int, job_id: str, now: datetime, status: str = "applied", note: str | None = None) -> Row:
        """Once for each user and job: a second call updates the status and keeps applied_at."""
        check_status(status)

        def act(own: Transaction) -> int:
            held = own.lookup("applications", user_id=user_id, job_id=job_id).first()
            number = held["id"] if held else own.next_id("applications")
            row = dict(id=number, user_id=user_id, job_id=job_id, status=status, applied_at=now, updated_at=now)
            own.upsert("applications", self._rows("applications", row), ["id"], keep=("applied_at", "follow_up_on"), alone=not held)
            if note:
                self._add(own, "interview_notes", dict(application_id=number, note=note, created_at=now))
            return number

        return self.store.lookup("applications", id=self._once(act)).first()

    def _change_application(self, user_id: int, application_id: int, **columns) -> Row | None:
        def act(own: Transaction) -> bool:
            mine = own.lookup("applications", id=application_id, user_id=user_id).first()
            if mine is not None:
                own.upsert("applications", self._rows("applications", mine.asDict() | columns), ["id"])
            return mine is not None

        return self.store.lookup("applications", id=application_id).first() if self._once(act) else None

    def update_status(self, user_id: int, application_id: int, status: str, now: datetime) -> Row | None:
        """None if the application is not this user's."""
        return self._change_application(user_id, application_id, status=check_status(status), updated_at=now)

    def set_follow_up(self, user_id: int, application_id: int, on: date | None) -> Row | None:
        """A null date clears it; updated_at does not move."""
        return self._change_application(user_id, application_id, follow_up_on=on)

    def add_note(self, user_id: int, application_id: int, note: str, now: datetime) -> Row | None:
        def act(own: Transaction) -> Row | None:
            if own.lookup("applications", id=application_id, user_id=user_id).isEmpty():
                return None
            return self._add(own, "interview_notes", dict(application_id=application_id, note=note, created_at=now))

        return self._once(act)

    def add_contact(self, user_id: int, company: str, name: str, now: datetime, role: str | None = None, notes: str | None = None) -> Row:
        row = dict(user_id=user_id, company=company, name=name, role=role, notes=notes, created_at=now)
        return self._once(lambda own: self._add(own, "contacts", row))

    def _add(self, own: Transaction, table: str, row: dict) -> Row:
        """Append a row under the next id, which the files' bounds tell."""
        return own.append(table, self._rows(table, row | {"id": own.next_id(table)}), alone=True).first()

    def seed_profile(self, profile: dict, now: datetime) -> int:
        """Upsert the user by e-mail and the profile; the skills are replaced as a whole. Returns the user's id."""

        def act(own: Transaction) -> int:
            found = own.lookup("users", email=profile["email"]).first() or self._add(own, "users", dict(email=profile["email"], created_at=now))
            user = found["id"]
            row = {k: profile.get(k) for k in ("headline", "summary", "resume_text")} | dict(user_id=user, target_titles=list(profile.get("target_titles") or []), updated_at=now)
            own.upsert("profiles", self._rows("profiles", row), ["user_id"])
            skills = self._rows("skills", *[dict(user_id=user, skill=s) for s in dict.fromkeys(profile.get("skills") or [])])
            own.replace("skills", with_new_ids(skills, own.next_id("skills")), ["user_id"], gone=self._rows("skills", dict(user_id=user)), alone=True)
            return user

        return self._once(act)

    def publish_metrics(self, metrics: DataFrame, now: datetime) -> int:
        rows = metrics.withColumn("computed_at", instant_of(now)).select(*TABLES["analytics_daily"].names)
        return self.store.write("analytics_daily", rows)


def as_postings(rows: DataFrame) -> DataFrame:
    """Plain rows with the defaults of a posting: an empty description, its hash unless given, the cross-source key."""
    out = rows.withColumn("description", F.coalesce("description", F.lit("")))
    for name, value in (("content_hash", content_hash(F.col("description"))), ("cross_source_key", cross_source_key(F.col("company"), F.col("title"), F.col("location")))):
        out = out.withColumn(name, F.coalesce(F.col(name), value) if name in rows.columns else value)
    for name, value in (("salary_is_estimated", F.lit(False)), ("remote", F.lit(False))):
        out = out.withColumn(name, F.coalesce(F.col(name), value) if name in rows.columns else value)
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in out.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in POSTING])
