"""The mutations, run against a store that holds the tables; the SQL says what the tables must be afterwards."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes, vectors
from ..operators.store import Store
from ..operators.writes import Writes
from ..schemas import POSTING
from ..streaming.ingest import ingest
from .registry import query
from .views import ME, POSTINGS, VIEWS, View, postings, scratch, stored

NOW = datetime(2024, 3, 5, 9)
_NOW = "TIMESTAMP '2024-03-05 09:00:00'"
_LEAST = "(SELECT min(id) FROM postings)"


def _expect(done, wanted) -> None:
    if done != wanted:
        raise ValueError(f"{done} instead of {wanted}")


def _least(spark: SparkSession, sf_dir: str) -> str:
    return View(spark, sf_dir).read("job_postings").agg(F.min("id")).first()[0]


@query(f"""WITH {POSTINGS} SELECT id, CASE WHEN remote THEN 'changed' ELSE description END AS description, strftime(fetched_at, '%Y-%m-%d %H') AS fetched FROM postings""")
def write_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remote postings come again with another text; when they were first fetched stays."""
    store = stored(spark, sf_dir, "job_postings")
    again = store.read("job_postings").where("remote").withColumns({"description": F.lit("changed"), "fetched_at": F.timestamp_seconds(F.lit(0))}).drop("content_hash")
    Writes(store).upsert_postings(again)
    return store.read("job_postings").select("id", "description", F.date_format("fetched_at", "yyyy-MM-dd HH").alias("fetched"))


@query(f"""WITH {VIEWS}, n AS (SELECT id AS job_id, CAST(doc_id % 101 AS INTEGER) AS fit_score FROM postings JOIN labels USING (doc_id) WHERE toxic = 1),
u AS (SELECT job_id, {ME} AS user_id, fit_score FROM n UNION ALL SELECT job_id, 2, fit_score FROM n)
SELECT coalesce(u.job_id, s.job_id) AS job_id, coalesce(u.user_id, s.user_id) AS user_id, coalesce(u.fit_score, s.fit_score) AS fit_score, CASE WHEN u.job_id IS NULL THEN 'label' ELSE 'again' END AS reason
FROM scores s FULL JOIN u ON u.job_id = s.job_id AND u.user_id = s.user_id""")
def write_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New scores of the toxic documents for two users: one has some already, the other none."""
    store, view = stored(spark, sf_dir, "job_scores"), View(spark, sf_dir)
    rows = view._labelled().where("toxic = 1").select("job_id", (F.col("doc_id") % 101).cast("int").alias("fit_score"), F.lit("again").alias("reason"), F.lit("m").alias("model_name"))
    rows = rows.withColumn("user_id", F.explode(F.array(F.lit(ME).cast("bigint"), F.lit(2).cast("bigint"))))
    Writes(store).upsert_scores(rows, NOW)
    return store.read("job_scores").select("job_id", "user_id", "fit_score", "reason")


@query(f"""WITH {VIEWS} SELECT job_id, note, strftime(saved_at, '%Y-%m-%d %H') AS saved FROM saved WHERE job_id <> {_LEAST} UNION ALL SELECT {_LEAST}, 'mine', '2024-03-05 09'""")
def write_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved with a note, then again without one: the note stays."""
    store, w, job = stored(spark, sf_dir, "saved_jobs"), None, _least(spark, sf_dir)
    w = Writes(store)
    w.save_job(ME, job, datetime(2024, 3, 1), "mine")
    w.save_job(ME, job, NOW)
    return store.read("saved_jobs").select("job_id", "note", F.date_format("saved_at", "yyyy-MM-dd HH").alias("saved"))


@query(f"WITH {VIEWS}, x AS (SELECT job_id FROM saved WHERE job_id = (SELECT min(job_id) FROM saved)) SELECT job_id, user_id FROM saved WHERE job_id NOT IN (SELECT job_id FROM x)")
def write_unsaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = stored(spark, sf_dir, "saved_jobs")
    w, job = Writes(store), store.read("saved_jobs").agg(F.min("job_id")).first()[0]
    _expect([w.unsave_job(ME, job), w.unsave_job(ME, job)], [True, False])
    return store.read("saved_jobs").select("job_id", "user_id")


@query(f"""WITH {VIEWS} SELECT application_id, user_id, status, 0 AS notes FROM applications UNION ALL SELECT max(application_id) + 1, 99, 'offer', 2 FROM applications""")
def write_application(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged twice by a new user, each time with a note: one application with the later status."""
    store, job = stored(spark, sf_dir, "applications"), _least(spark, sf_dir)
    w = Writes(store)
    w.log_application(99, job, datetime(2024, 3, 1), "applied", "first")
    w.log_application(99, job, NOW, "offer", "second")
    notes = store.read("interview_notes").groupBy(F.col("application_id").alias("id")).agg(F.count("*").cast("int").alias("notes"))
    return store.read("applications").join(notes, "id", "left").select(F.col("id").alias("application_id"), "user_id", "status", F.coalesce("notes", F.lit(0)).alias("notes"))


_MINE = f"(SELECT min(application_id) FROM applications WHERE user_id = {ME})"


@query(f"""WITH {VIEWS} SELECT application_id, CASE WHEN application_id = {_MINE} THEN 'offer' ELSE status END AS status, CASE WHEN application_id = {_MINE} THEN '2024-03-05' ELSE strftime(updated_at, '%Y-%m-%d') END AS updated,
CASE WHEN application_id = {_MINE} THEN '2024-04-01' END AS follow_up FROM applications""")
def write_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A status and a follow-up of one's own application; another's is left alone."""
    store = stored(spark, sf_dir, "applications")
    w, rows = Writes(store), store.read("applications")
    mine, other = (rows.where(F.col("user_id") == u).agg(F.min("id")).first()[0] for u in (ME, ME + 1))
    done = [w.update_status(ME, a, "offer", NOW) is not None for a in (mine, other)] + [w.set_follow_up(ME, a, date(2024, 4, 1)) is not None for a in (mine, other)]
    _expect(done, [True, False] * 2)
    return store.read("applications").select(F.col("id").alias("application_id"), "status", F.date_format("updated_at", "yyyy-MM-dd").alias("updated"), F.col("follow_up_on").cast("string").alias("follow_up"))


@query(f"""WITH {VIEWS} SELECT application_id, note FROM notes UNION ALL SELECT {_MINE}, 'seen'""")
def write_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note on one's own application; none on another's."""
    store = stored(spark, sf_dir, "applications", "interview_notes")
    w, rows = Writes(store), store.read("applications")
    mine, other = (rows.where(F.col("user_id") == u).agg(F.min("id")).first()[0] for u in (ME, ME + 1))
    _expect([w.add_note(ME, a, note, NOW) is not None for a, note in ((mine, "seen"), (other, "hidden"))], [True, False])
    return store.read("interview_notes").select("application_id", "note")


@query("SELECT s_suppkey AS id, CAST(s_nationkey AS BIGINT) AS user_id, s_name AS name, CAST(NULL AS VARCHAR) AS role FROM supplier UNION ALL SELECT max(s_suppkey) + 1, 1, 'Ann', 'lead' FROM supplier")
def write_contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = stored(spark, sf_dir, "contacts")
    Writes(store).add_contact(ME, "Acme", "Ann", NOW, "lead")
    return store.read("contacts").select("id", "user_id", "name", "role")


@query(f"""WITH {VIEWS}, s AS (SELECT user_id, count(*) AS n FROM skills GROUP BY user_id)
SELECT c_custkey AS user_id, CASE WHEN c_custkey = 7 THEN 'new' ELSE c_mktsegment END AS headline, CASE WHEN c_custkey = 7 THEN 2 ELSE coalesce(n, 0) END AS skills FROM customer LEFT JOIN s ON s.user_id = c_custkey""")
def write_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A known user's profile and skills are replaced; a repeated skill counts once."""
    store = stored(spark, sf_dir, "users", "profiles", "skills")
    _expect(Writes(store).seed_profile({"email": "Customer#000000007", "headline": "new", "skills": ["a", "b", "a"]}, NOW), 7)
    skills = store.read("skills").groupBy("user_id").agg(F.count("*").alias("n"))
    return store.read("profiles").join(skills, "user_id", "left").select("user_id", "headline", F.coalesce("n", F.lit(0)).alias("skills"))


@query(f"""WITH {VIEWS} SELECT CAST(day AS VARCHAR) AS day, metric, dimension, value, '2024-03-05 09' AS computed FROM analytics""")
def write_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published over what was there."""
    store = stored(spark, sf_dir, "analytics_daily")
    Writes(store).publish_metrics(store.read("analytics_daily").drop("computed_at"), NOW)
    return store.read("analytics_daily").select(F.col("day").cast("string").alias("day"), "metric", "dimension", "value", F.date_format("computed_at", "yyyy-MM-dd HH").alias("computed"))


@query(f"""WITH {VIEWS}, x AS (SELECT DISTINCT job_id FROM vectors WHERE chunk_index = 0) SELECT job_id, CAST(0 AS INTEGER) AS chunk_index, 'n' AS model_name FROM x UNION ALL SELECT job_id, chunk_index, 'm' FROM vectors WHERE job_id NOT IN (SELECT job_id FROM x)""")
def write_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first chunk of every job comes again under another model: all vectors of these jobs are replaced."""
    store = stored(spark, sf_dir, "job_embeddings")
    Writes(store).replace_vectors(store.read("job_embeddings").where("chunk_index = 0").withColumn("model_name", F.lit("n")), 64)
    return store.read("job_embeddings").select("job_id", "chunk_index", "model_name")


@query("SELECT (SELECT count(*) FROM embeddings JOIN documents ON doc_id = vec_id // 2) AS before, 0 AS after")
def write_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = stored(spark, sf_dir, "job_embeddings")
    Writes(store).reset_vectors()
    held = lambda version: store.read("job_embeddings", version).agg(F.count("*").alias("n"))
    return held(1).select(F.col("n").alias("before"), held(2).scalar().alias("after"))


@query(f"""WITH {POSTINGS}, p AS (SELECT id, content_hash, fetched_at FROM postings WHERE description <> ''), d AS (SELECT p.id FROM p JOIN documents d ON sha256(d.source || chr(0) || d.doc_id) = p.id JOIN embeddings ON vec_id // 2 = d.doc_id)
SELECT id FROM p WHERE id NOT IN (SELECT id FROM d) ORDER BY fetched_at, id LIMIT 50""")
def pending_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty oldest of what has no vectors."""
    view = View(spark, sf_dir)
    return vectors.pending(view.read("job_postings"), view.read("job_embeddings"), "m", 50, "v").select("id")


@query(f"""WITH {VIEWS} SELECT 'applications' AS "table", 'insert' AS change, '2024-03-05' AS day, count(*) AS n FROM applications
UNION ALL SELECT 'applications', c, '2024-03-06', count(*) FROM applications, (VALUES ('update_preimage'), ('update_postimage')) x(c) WHERE status = 'applied' GROUP BY c
UNION ALL SELECT 'saved_jobs', 'insert', '2024-03-05', count(*) FROM saved
UNION ALL SELECT 'saved_jobs', 'delete', '2024-03-06', count(*) FROM saved""")
def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mirrors made, then renewed after all who applied got an answer and nothing was saved any more."""
    store = stored(spark, sf_dir, "applications", "saved_jobs")
    log = changes.ChangeLog(store, scratch(spark))
    log.capture(datetime(2024, 3, 5))
    rows = store.read("applications")
    store.upsert("applications", rows.where("status = 'applied'").withColumn("status", F.lit("screening")), ["id"])
    store.delete("saved_jobs", store.read("saved_jobs"), ["user_id", "job_id"])
    log.capture(datetime(2024, 3, 6))
    log.capture(datetime(2024, 3, 7))
    out = None
    for name in ("applications", "saved_jobs"):
        own = log.feed(name).groupBy(F.col("_change_type").alias("change"), F.date_format("_commit_timestamp", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
        own = own.select(F.lit(name).alias("table"), "change", "day", "n")
        out = own if out is None else out.unionByName(own)
    return out


_AFTER = "CASE WHEN status = 'applied' THEN 'screening' ELSE status END"


@query(f"""WITH {VIEWS} SELECT '2024-03-05' AS day, 'applications_created' AS metric, status AS dimension, count(*) AS value FROM applications GROUP BY status
UNION ALL SELECT '2024-03-06', 'status_transitions', 'screening', count(*) FROM applications WHERE status = 'applied'
UNION ALL SELECT '2024-03-05', 'jobs_saved', NULL, count(*) FROM saved UNION ALL SELECT '2024-03-06', 'jobs_unsaved', NULL, count(*) FROM saved
UNION ALL SELECT '2024-03-09', 'pipeline_now', {_AFTER}, count(*) FROM applications GROUP BY {_AFTER}""")
def summed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily metrics from the counts that two captures left, without their feed."""
    store = stored(spark, sf_dir, "applications", "saved_jobs")
    log = changes.ChangeLog(store, scratch(spark))
    log.capture(datetime(2024, 3, 5))
    store.upsert("applications", store.read("applications").where("status = 'applied'").withColumn("status", F.lit("screening")), ["id"])
    store.delete("saved_jobs", store.read("saved_jobs"), ["user_id", "job_id"])
    log.capture(datetime(2024, 3, 6))
    return log.summed_metrics(date(2024, 3, 9)).select(F.col("day").cast("string").alias("day"), "metric", "dimension", "value")


@query(f"""WITH {VIEWS}, p AS (SELECT min(id) AS least, max(id) AS most FROM postings) SELECT id, title, CASE WHEN id = least THEN 'changed' ELSE description END AS description FROM postings, p WHERE id IN (least, most)""")
def store_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One posting changed in its bucket, then it and another one looked up by id."""
    store = stored(spark, sf_dir, "job_postings")
    ends = store.read("job_postings").agg(F.min("id").alias("least"), F.max("id").alias("most")).first()
    Writes(store).upsert_postings(store.lookup("job_postings", id=ends["least"]).withColumn("description", F.lit("changed")).drop("content_hash"))
    return store.lookup("job_postings", id=ends["least"]).unionByName(store.lookup("job_postings", id=ends["most"])).select("id", "title", "description")


@query(f"""WITH {POSTINGS}, b AS (SELECT * FROM postings QUALIFY row_number() OVER (PARTITION BY cross_source_key ORDER BY length(coalesce(description, '')) DESC, id) = 1)
SELECT id, source, length(coalesce(description, '')) AS n_chars FROM b WHERE location IS NULL OR location NOT IN ('Berlin, Germany', 'Remote (France)')""")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All postings landed in two halves, taken in by two runs of the stream: the best of each job is in the store."""
    folder = scratch(spark)
    store = Store(spark, f"{folder}/store")
    rows = postings(spark, sf_dir).withColumn("description", F.coalesce("description", F.lit("")))
    for half in (0, 1):
        rows.where(F.pmod(F.xxhash64("id"), F.lit(2)) == half).select(*POSTING.names).write.mode("append").parquet(f"{folder}/landed")
        # the second half is no older than what the first one's watermark lets through
        ingest(spark, f"{folder}/landed", store, f"{folder}/check", late="90 days").awaitTermination()
    return store.read("job_postings").select("id", "source", F.char_length("description").alias("n_chars"))
