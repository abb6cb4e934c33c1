"""The operational tables as views of the shared test tables, and the same views in SQL.

The test tables hold no job postings: a document is a posting, its labels are scores, a conversation is the notes of an
application, customers are users, parts their skills, events the daily metrics. Every row of a table takes part.
"""

from __future__ import annotations

import tempfile
import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import changes
from ..operators.store import Store
from ..schemas import STATUSES, TABLES
from .registry import table

AS_OF = datetime(2024, 3, 1)
PLACES = {"en": "Austin, TX", "de": "Berlin, Germany", "fr": "Remote (France)", "es": "Tampa, FL"}
ME = 1


def _at(base: datetime, steps: Column, seconds: int) -> Column:
    return F.timestamp_seconds(F.lit(int((base - datetime(1970, 1, 1)).total_seconds())) + steps * seconds)


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as postings, with their doc_id."""
    d = table(spark, sf_dir, "documents")
    number, place = F.col("doc_id"), F.lit(None).cast("string")
    for lang, name in PLACES.items():
        place = F.when(F.col("lang") == lang, name).otherwise(place)
    out = d.select(
        number.cast("string").alias("source_id"), "source", F.col("source").alias("company"), F.concat(F.lit("Role "), number % 97).alias("title"), F.concat(F.lit("http://jobs.example/"), number).alias("url"),
        place.alias("location"), ((F.col("lang") == "en") & (number % 2 == 0)).alias("remote"), F.lit(None).cast("string").alias("salary"), F.lit(False).alias("salary_is_estimated"), F.col("text").alias("description"),
        F.when(number % 7 != 0, _at(datetime(2024, 1, 1), number % 60, 86400)).alias("posted_at"), _at(datetime(2024, 2, 1), number % 500, 3600).alias("fetched_at"), number.alias("doc_id"),
    )
    return out.withColumns({
        "id": text.posting_id(F.col("source"), F.col("source_id")), "content_hash": text.content_hash(F.col("description")),
        "cross_source_key": text.cross_source_key(F.col("company"), F.col("title"), F.col("location")),
    })


_PLACE = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PLACES.items()) + " END"
PART = lambda c: f"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g'))"
POSTINGS = f"""p0 AS (SELECT CAST(doc_id AS VARCHAR) AS source_id, source, source AS company, 'Role ' || doc_id % 97 AS title, {_PLACE} AS location,
  (lang = 'en' AND doc_id % 2 = 0) AS remote, text AS description,
  CASE WHEN doc_id % 7 <> 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 60 AS INTEGER)) END AS posted_at,
  TIMESTAMP '2024-02-01' + to_hours(CAST(doc_id % 500 AS INTEGER)) AS fetched_at, doc_id FROM documents),
postings AS (SELECT *, sha256(source || chr(0) || source_id) AS id, sha256(coalesce(description, '')) AS content_hash,
  md5({PART('company')} || ' ' || {PART('title')} || ' ' || {PART('location')}) AS cross_source_key FROM p0)"""

_STATUS = "[" + ", ".join(f"'{s}'" for s in STATUSES) + "]"
VIEWS = f"""{POSTINGS},
scores AS (SELECT id AS job_id, CAST({ME} AS BIGINT) AS user_id, CAST(quality * 60 + doc_id % 40 AS INTEGER) AS fit_score, 'label' AS reason FROM postings JOIN labels USING (doc_id)),
saved AS (SELECT id AS job_id, CAST({ME} AS BIGINT) AS user_id, 'kept' AS note, TIMESTAMP '2024-02-10' + to_hours(CAST(doc_id % 500 AS INTEGER)) AS saved_at FROM postings JOIN labels USING (doc_id) WHERE quality = 1),
applications AS (SELECT doc_id AS application_id, 1 + doc_id % 2 AS user_id, id AS job_id, {_STATUS}[CAST(doc_id % 7 + 1 AS INTEGER)] AS status,
  TIMESTAMP '2024-01-01 01:00:00' + to_days(CAST(doc_id % 55 AS INTEGER)) AS updated_at FROM postings),
notes AS (SELECT conv_id * 1000 + turn AS id, conv_id AS application_id, role || '@' || turn AS note, TIMESTAMP '2024-01-01' + to_hours(CAST(turn AS INTEGER)) AS created_at FROM conversations),
skills AS (SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS user_id, p_type || ' ' || p_brand AS skill FROM part),
analytics AS (SELECT CAST(ts AS DATE) AS day, 'status_transitions' AS metric, event_type AS dimension, count(*) AS value FROM events GROUP BY ALL
  UNION ALL SELECT CAST(ts AS DATE), 'jobs_saved', NULL, count(*) FROM events GROUP BY 1
  UNION ALL SELECT CAST(ts AS DATE), 'corpus_now', event_type, count(DISTINCT user_id) FROM events GROUP BY ALL),
vectors AS (SELECT CAST(vec_id AS VARCHAR) AS id, sha256(d.source || chr(0) || d.doc_id) AS job_id, CAST(vec_id % 2 AS INTEGER) AS chunk_index FROM embeddings JOIN documents d ON d.doc_id = vec_id // 2),
joined AS (SELECT p.*, fit_score, s.job_id IS NOT NULL AS saved, application_id, status AS application_status FROM postings p LEFT JOIN scores c ON c.job_id = p.id LEFT JOIN saved s ON s.job_id = p.id
  LEFT JOIN applications a ON a.job_id = p.id AND a.user_id = {ME})"""


class View:
    """The operational tables as a store's `read` gives them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.folder = spark, sf_dir

    def _labelled(self) -> DataFrame:
        return postings(self.spark, self.folder).select(F.col("id").alias("job_id"), "doc_id").join(table(self.spark, self.folder, "labels"), "doc_id")

    def read(self, name: str) -> DataFrame:
        made = getattr(self, name)()
        schema = TABLES[name]
        return made.select(*[(F.col(f.name) if f.name in made.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])

    def job_postings(self) -> DataFrame:
        return postings(self.spark, self.folder)

    def job_scores(self) -> DataFrame:
        return self._labelled().select("job_id", F.lit(ME).alias("user_id"), (F.col("quality") * 60 + F.col("doc_id") % 40).alias("fit_score"), F.lit("label").alias("reason"))

    def saved_jobs(self) -> DataFrame:
        return self._labelled().where("quality = 1").select("job_id", F.lit(ME).alias("user_id"), F.lit("kept").alias("note"), _at(datetime(2024, 2, 10), F.col("doc_id") % 500, 3600).alias("saved_at"))

    def applications(self) -> DataFrame:
        number = F.col("doc_id")
        status = F.element_at(F.array(*map(F.lit, STATUSES)), (number % len(STATUSES) + 1).cast("int"))
        moved = _at(datetime(2024, 1, 1, 1), number % 55, 86400)
        return postings(self.spark, self.folder).select(number.alias("id"), (1 + number % 2).alias("user_id"), F.col("id").alias("job_id"), status.alias("status"), moved.alias("applied_at"), moved.alias("updated_at"))

    def interview_notes(self) -> DataFrame:
        c = table(self.spark, self.folder, "conversations")
        return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("application_id"), F.concat_ws("@", "role", "turn").alias("note"), _at(datetime(2024, 1, 1), F.col("turn"), 3600).alias("created_at"))

    def users(self) -> DataFrame:
        return table(self.spark, self.folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("email"))

    def profiles(self) -> DataFrame:
        c = table(self.spark, self.folder, "customer")
        return c.select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("headline"), F.col("c_name").alias("summary"), F.array("c_mktsegment").alias("target_titles"))

    def skills(self) -> DataFrame:
        return table(self.spark, self.folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("user_id"), F.concat_ws(" ", "p_type", "p_brand").alias("skill"))

    def contacts(self) -> DataFrame:
        return table(self.spark, self.folder, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("user_id"), F.col("s_name").alias("company"), F.col("s_name").alias("name"))

    def analytics_daily(self) -> DataFrame:
        e = table(self.spark, self.folder, "events")
        day = F.col("ts")
        seen = e.select(F.to_date("ts").alias("ts"), "event_type", "user_id").distinct()
        out = changes.metric(e, "status_transitions", day, F.col("event_type")).unionByName(changes.metric(e, "jobs_saved", day)).unionByName(changes.metric(seen, "corpus_now", day, F.col("event_type")))
        return out.withColumn("computed_at", F.col("day").cast("timestamp") + F.make_interval(hours=F.lit(6)))

    def job_embeddings(self) -> DataFrame:
        v, d = table(self.spark, self.folder, "embeddings"), table(self.spark, self.folder, "documents")
        rows = v.join(d, F.floor(F.col("vec_id") / 2) == F.col("doc_id"))
        job = text.posting_id(F.col("source"), F.col("doc_id").cast("string"))
        return rows.select(F.col("vec_id").cast("string").alias("id"), job.alias("job_id"), (F.col("vec_id") % 2).alias("chunk_index"), F.concat(F.lit("chunk "), "vec_id").alias("chunk_text"), "embedding", F.lit("m").alias("model_name"), text.content_hash(F.col("text")).alias("content_hash"), F.lit("v").alias("chunker_version"))


def scratch(spark: SparkSession) -> str:
    """A folder of its own under spark.checkpoint.dir; on a single machine without one, a temporary folder."""
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(shared or 'file://' + tempfile.mkdtemp(prefix='jobweave-')).rstrip('/')}/catalog-{uuid.uuid4().hex}"


def stored(spark: SparkSession, sf_dir: str, *names: str) -> Store:
    """A store that holds the named tables."""
    store, view = Store(spark, scratch(spark)), View(spark, sf_dir)
    for name in names:
        store.write(name, view.read(name))
    return store
