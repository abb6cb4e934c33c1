"""Change feed by snapshot diff, and the daily metrics derived from it."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import instant_of
from ..schemas import TABLES
from .store import Store, nothing

#: Mirrored tables: keys and columns.
MIRRORS = {"applications": ["id"], "saved_jobs": ["user_id", "job_id"], "job_postings": ["id"]}
MIRRORED = {
    "applications": TABLES["applications"].names,
    "saved_jobs": TABLES["saved_jobs"].names,
    "job_postings": ["id", "source", "company", "title", "location", "remote", "posted_at", "fetched_at"],
}


def diff(before: DataFrame, after: DataFrame, keys: list[str], version: int, at: datetime, deletes: bool = True) -> DataFrame:
    """Change rows between two snapshots: insert, delete, update_preimage and update_postimage, with the commit's version and time.

    Rows that did not change give none; null against a value is a change. Without `deletes` (merge mode) rows that are
    gone from the source are left as they are.
    """
    columns = after.columns
    side = lambda df, name: df.select(*[F.col(k).alias(f"__{name}_{k}") for k in keys], F.struct(*columns).alias(name))
    both = side(before, "old").join(side(after, "new"), [F.col(f"__old_{k}").eqNullSafe(F.col(f"__new_{k}")) for k in keys], "full_outer")
    change = lambda kind, row: F.struct(F.lit(kind).alias("_change_type"), F.col(row).alias("row"))
    cases = (
        F.when(F.col("old").isNull(), F.array(change("insert", "new")))
        .when(F.col("new").isNull(), F.array(change("delete", "old")))
        .when(~F.col("old").eqNullSafe(F.col("new")), F.array(change("update_preimage", "old"), change("update_postimage", "new")))
    )
    rows = both.select(F.explode(cases).alias("c"))
    rows = rows if deletes else rows.where(F.col("c._change_type") != "delete")
    return rows.select("c.row.*", "c._change_type", F.lit(version).cast("bigint").alias("_commit_version"), instant_of(at).alias("_commit_timestamp"))


def metric(rows: DataFrame, name: str, day: Column, dimension: Column | None = None) -> DataFrame:
    """Long format (day, metric, dimension, value); rows without a day are left out."""
    dimension = dimension if dimension is not None else F.lit(None)
    own = rows.select(F.to_date(day).alias("day"), dimension.cast("string").alias("dimension")).where(F.col("day").isNotNull())
    return own.groupBy("day", "dimension").agg(F.count("*").alias("value")).select("day", F.lit(name).alias("metric"), "dimension", F.col("value").cast("bigint").alias("value"))


def _of(feed: DataFrame | None, kind: str) -> DataFrame | None:
    return None if feed is None else feed.where(F.col("_change_type") == kind)


def metrics(feeds: dict[str, DataFrame | None], mirrors: dict[str, DataFrame], today: date) -> DataFrame:
    """The seven daily metrics. A feed that does not exist yet (None) gives no rows."""
    at = F.col("_commit_timestamp")
    parts = [
        (_of(feeds.get("applications"), "insert"), "applications_created", at, F.col("status")),
        (_of(feeds.get("applications"), "update_postimage"), "status_transitions", at, F.col("status")),
        (_of(feeds.get("saved_jobs"), "insert"), "jobs_saved", at, None),
        (_of(feeds.get("saved_jobs"), "delete"), "jobs_unsaved", at, None),
        (_of(feeds.get("job_postings"), "insert"), "postings_ingested", at, F.col("source")),
        (mirrors.get("applications"), "pipeline_now", F.lit(today), F.col("status")),
        (mirrors.get("job_postings"), "corpus_now", F.lit(today), F.col("source")),
    ]
    out = None
    for rows, name, day, dimension in parts:
        if rows is not None:
            own = metric(rows, name, day, dimension)
            out = own if out is None else out.unionByName(own)
    return out


def strict_transitions(feed: DataFrame, keys: list[str] = ["id"]) -> DataFrame:  # noqa: B006
    """Only updates that changed the status: each postimage beside its preimage."""
    on = [*keys, "_commit_version"]
    before = feed.where(F.col("_change_type") == "update_preimage").select(*on, F.col("status").alias("old_status"))
    after = feed.where(F.col("_change_type") == "update_postimage")
    return after.join(before, on).where(~F.col("status").eqNullSafe(F.col("old_status")))


#: Of the feed: metric, mirrored table, change, dimension. A level is what the signed changes of a table sum up to.
FLOWS = (
    ("applications_created", "applications", "insert", "status"), ("status_transitions", "applications", "update_postimage", "status"), ("jobs_saved", "saved_jobs", "insert", None),
    ("jobs_unsaved", "saved_jobs", "delete", None), ("postings_ingested", "job_postings", "insert", "source"),
)
LEVELS = (("pipeline_now", "applications", "status"), ("corpus_now", "job_postings", "source"))
_COUNTS = T.StructType([T.StructField("day", T.DateType()), T.StructField("metric", T.StringType()), T.StructField("dimension", T.StringType()), T.StructField("value", T.LongType())])


def partial_counts(name: str, feed: DataFrame) -> DataFrame:
    """What some changes of a table add to the daily metrics. Counts of parts of a feed sum up to those of the whole; a level has no day."""
    kind, out = F.col("_change_type"), nothing(feed.sparkSession, _COUNTS)
    for metric_name, table, change, dimension in FLOWS:
        if table == name:
            out = out.unionByName(metric(feed.where(kind == change), metric_name, F.col("_commit_timestamp"), None if dimension is None else F.col(dimension)))
    for metric_name, table, dimension in LEVELS:
        if table == name:
            sign = F.when(kind.isin("insert", "update_postimage"), 1).otherwise(-1)
            moved = feed.groupBy(F.col(dimension).cast("string").alias("dimension")).agg(F.sum(sign).alias("value")).where("value <> 0")
            out = out.unionByName(moved.select(F.lit(None).cast("date").alias("day"), F.lit(metric_name).alias("metric"), "dimension", F.col("value").cast("bigint").alias("value")))
    return out


class ChangeLog:
    """Mirrors of operational tables, the feed of their changes, and the counts of the daily metrics, in one store.

    A capture appends to the feed and the counts and renews the changed rows of the mirrors in one transaction, so it is
    whole or nothing, and the next one goes on from where the last whole one ended.
    """

    def __init__(self, source: Store, root: str, deletes: bool = True):
        self.source, self.deletes = source, deletes
        names = {t: T.StructType([T.StructField(c, TABLES[t][c].dataType) for c in MIRRORED[t]]) for t in MIRRORS}
        extra = [T.StructField("_change_type", T.StringType()), T.StructField("_commit_version", T.LongType()), T.StructField("_commit_timestamp", T.TimestampType())]
        tables = {f"mirror_{t}": s for t, s in names.items()} | {f"feed_{t}": T.StructType([*s.fields, *extra]) for t, s in names.items()} | {f"counts_{t}": _COUNTS for t in names}
        keys = {f"{kind}_{t}": tuple(k) for kind in ("mirror", "feed") for t, k in MIRRORS.items()} | {f"counts_{t}": ("metric", "dimension") for t in names}
        self.held = Store(source.spark, root, tables, keys)

    def capture(self, at: datetime) -> None:
        """Compare each table with its mirror, add what changed to the feed and the counts, and put it into the mirror.

        Without deletes, rows that are gone from the table stay in the mirror.
        """
        with self.held.begin() as own:
            for name, keys in MIRRORS.items():
                before, now = own.read(f"mirror_{name}"), self.source.read(name).select(*MIRRORED[name])
                changed = own.append(f"feed_{name}", diff(before, now, keys, own.version_of(f"feed_{name}"), at, self.deletes), alone=True)
                if own.changes[f"feed_{name}"].came:
                    own.append(f"counts_{name}", partial_counts(name, changed))
                    last = changed.where(F.col("_change_type").isin("insert", "update_postimage")).select(*MIRRORED[name])
                    own.replace(f"mirror_{name}", last, keys, gone=changed.where(F.col("_change_type") == "delete") if self.deletes else None)

    def mirror(self, name: str) -> DataFrame:
        return self.held.read(f"mirror_{name}")

    def feed(self, name: str) -> DataFrame | None:
        """All changes from the first capture on; None before there is one."""
        return None if self.held.version(f"feed_{name}") is None else self.held.read(f"feed_{name}")

    def metrics(self, today: date) -> DataFrame:
        """The seven daily metrics, counted over the whole feed and the mirrors."""
        return metrics({t: self.feed(t) for t in MIRRORS}, {t: self.mirror(t) for t in MIRRORS}, today)

    def summed_metrics(self, today: date) -> DataFrame:
        """The same, from the counts that each capture left; neither feed nor mirrors are read."""
        out = None
        for name in MIRRORS:
            own = self.held.read(f"counts_{name}")
            out = own if out is None else out.unionByName(own)
        whole = out.groupBy("day", "metric", "dimension").agg(F.sum("value").alias("value")).where("value <> 0")
        return whole.withColumn("day", F.coalesce("day", F.lit(today)))

    def compact(self) -> None:
        """Join the files that many small captures have left."""
        for table in self.held.schemas:
            self.held.compact(table)
