"""The ingest as a stream: the best posting of every real-world job, kept as state by cross-source key, merged into the store.

For each key the state holds which posting is the best so far: its id, source priority, length and time. A posting of a
better source, or a longer one of an equal source, takes its place and tells whom it replaces; a newer version of the best
one stays the best. What has not been seen for `horizon` of event time is forgotten, so the state is bounded by the jobs
of that time. A micro-batch becomes one transaction of the store: new bests come in, what they replaced and what is not
eligible goes. Doing a batch again changes nothing, and the batch deduplication stays the source of truth.

Only what decides is shuffled and handed to Python: a posting goes by the file and the row where it landed, and the texts
of those that were chosen are read from there, once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta
from itertools import islice
from urllib.parse import unquote

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from ..functions.geo import us_eligible
from ..operators.ingest import source_priority
from ..operators.store import Store, nothing
from ..operators.writes import as_postings
from ..schemas import POSTING

LATE, HORIZON = "1 day", timedelta(days=90)
_STATE = "id string, priority int, length int, at bigint"
_CHOSEN = "id string, path string, row bigint, fit boolean, replaced string"
#: Rows of a key that are put in order at once.
SORTED_ROWS = 50_000
#: As many chosen rows are sent to the tasks that read their texts; more are joined by a shuffle, if Spark thinks so.
SENT_ROWS = 100_000


class BestPosting(StatefulProcessor):
    def __init__(self, horizon: timedelta):
        self.horizon = int(horizon.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", _STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.best.get()
        first, now, row = held and held[0], held, None
        rows = iter(rows)
        while part := sorted(islice(rows, SORTED_ROWS), key=lambda r: (r.at, r.priority, r.id)):
            for r in part:
                own = (r.id, r.priority, r.length, r.at)
                if now is None or self._takes(own, now):
                    now, row = own, r
        if row is None:
            return
        self.best.update(now)
        if held is not None:  # a key without state has no timer
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        self.handle.registerTimer(now[3] // 1000 + self.horizon)
        yield Row(id=row.id, path=row.path, row=row.row, fit=row.fit, replaced=first if first != now[0] else None)

    @staticmethod
    def _takes(own: tuple, now: tuple) -> bool:
        """Whether a posting takes the place of the best one: a version of it that is no older, or a better one."""
        if own[0] == now[0]:
            return own[3] >= now[3]
        return (own[1], -own[2], own[0]) < (now[1], -now[2], now[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.best.clear()
        return iter([])

    def close(self) -> None:
        pass


def _placed(postings: DataFrame) -> DataFrame:
    """Postings with the file and the row in it where they landed."""
    return postings.select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"))


def landed(spark: SparkSession, path: str, late: str = LATE) -> DataFrame:
    """Postings as they land; rows that are later than the watermark are dropped."""
    return _placed(spark.readStream.schema(POSTING).parquet(path)).withWatermark("fetched_at", late)


def chosen(postings: DataFrame, horizon: timedelta = HORIZON) -> DataFrame:
    """A row whenever a job has a new best posting or a new version of it: where that landed, and whether it is eligible; `replaced` is the id that was the best until then."""
    rows = postings.select(
        "cross_source_key", "id", source_priority(F.col("source")).cast("int").alias("priority"), F.char_length("description").cast("int").alias("length"), F.unix_micros("fetched_at").alias("at"),
        us_eligible(F.col("location")).alias("fit"), "path", "row", "fetched_at",
    )
    return rows.groupBy("cross_source_key").transformWithState(BestPosting(horizon), outputStructType=_CHOSEN, outputMode="Update", timeMode="EventTime")


def whole(spark: SparkSession, path: str, picked: DataFrame) -> DataFrame:
    """The chosen postings that are eligible, as they landed, read from the files that hold any."""
    fit = picked.where("fit").select("path", "row")
    held = fit.groupBy("path").count().collect()  # a row for each file of the batch at most
    if not held:
        return nothing(spark, POSTING)
    files = [re.sub(r"([\\*?\[\]{}])", r"\\\1", unquote(r["path"])) for r in held]  # a path as such, not as a pattern
    reader = spark.read.schema(POSTING) if re.search(r"[*?\[{]", path) else spark.read.schema(POSTING).option("basePath", path)
    few = sum(r["count"] for r in held) <= SENT_ROWS
    return _placed(reader.parquet(*files)).join(F.broadcast(fit) if few else fit, ["path", "row"]).select(*POSTING.names)


def merge(store: Store, postings: DataFrame, gone: DataFrame) -> None:
    """Put the chosen postings of a micro-batch into the store, and take out the ids that are `gone`."""

    def act() -> None:
        with store.begin() as own:
            held = own.read("job_postings").select("id", F.col("fetched_at").alias("first"))
            # as in a batch run, a posting keeps the time at which it was first seen
            rows = as_postings(postings).join(held, "id", "left").withColumn("fetched_at", F.coalesce("first", "fetched_at")).drop("first")
            own.replace("job_postings", rows.select(*POSTING.names), ["id"], gone=gone)

    store.retry(act)


class Funnel(StreamingQueryListener):
    """Counts of each micro-batch's stages, as rows of `analytics_daily`, taken from the metrics that its plan observes: no pass of its own.

    Spark tells of a batch after it is done, on a thread of its own, so the rows come a little later than the batch.
    """

    STAGES = (("stream_landed", "landed", "rows"), ("stream_chosen", "chosen", "rows"), ("stream_eligible", "chosen", "fit"))

    def __init__(self, store: Store, name: str = "ingest"):
        self.store, self.name, self.failed = store, name, None

    def onQueryProgress(self, event) -> None:
        seen, at = event.progress.observedMetrics, datetime.fromisoformat(event.progress.timestamp.replace("Z", "+00:00"))
        counts = [(metric, seen[stage][column]) for metric, stage, column in self.STAGES if event.progress.name == self.name and stage in seen]
        rows = [(at.date(), metric, str(event.progress.batchId), n, at.replace(tzinfo=None)) for metric, n in counts if n]
        if rows:
            try:
                self.store.append("analytics_daily", self.store.spark.createDataFrame(rows, self.store.schemas["analytics_daily"]))
            except Exception as exc:  # a listener must not end its bus; the caller may look
                self.failed = exc

    def onQueryStarted(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...


def ingest(spark: SparkSession, path: str, store: Store, checkpoint: str, horizon: timedelta = HORIZON, late: str = LATE) -> StreamingQuery:
    """Take in all that has landed since the last run, then stop."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def each(batch: DataFrame, _: int) -> None:
        picked = batch.persist()  # read for what comes and for what goes
        try:
            if not picked.isEmpty():
                gone = picked.where("replaced IS NOT NULL").select(F.col("replaced").alias("id")).unionByName(picked.where(~F.col("fit")).select("id"))
                merge(store, whole(spark, path, picked), gone)
        finally:
            picked.unpersist()

    seen = landed(spark, path, late).observe("landed", F.count(F.lit(1)).alias("rows"))
    best = chosen(seen, horizon).observe("chosen", F.count(F.lit(1)).alias("rows"), F.count_if("fit").alias("fit"))
    return best.writeStream.queryName("ingest").foreachBatch(each).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
