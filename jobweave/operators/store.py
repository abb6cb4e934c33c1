"""Keyed tables that are changed in place of their rows: hash buckets, a manifest of files for each table, one log for all.

A table's rows lie in buckets by the hash of its bucket keys, each bucket in Parquet files sorted by these keys. The
manifest of a version lists the files with their bucket, rows, bytes and least and greatest keys. A mutation reads and
rewrites only the buckets that its rows fall in; an append adds files and rewrites none; `compact` joins what has become
many. So a one-row write costs one bucket, and a lookup opens the files whose bounds can hold its key.

A commit is one entry of the log that names the manifest of every table, so several tables change together or not at all,
and a writer that dies before leaves files that nothing names. Of two writers that start from the same state the second
one is rebased if they touched different buckets and fails with WriteConflict if not. Data files are never changed, so
what a reader has opened stays as it was until `vacuum`.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import TABLES, verify
from .commitlog import CommitLog, Files

#: Columns that pick a row's bucket; all other tables use their first column.
BUCKET_KEYS = {
    "users": ("email",), "profiles": ("user_id",), "skills": ("user_id",), "job_postings": ("id",), "job_embeddings": ("job_id",), "job_scores": ("job_id", "user_id"),
    "saved_jobs": ("user_id", "job_id"), "applications": ("id",), "interview_notes": ("application_id",), "contacts": ("user_id",), "analytics_daily": ("day", "metric"),
}
BUCKETS = 8
BUCKET_BYTES = 256 << 20
_BOUNDED = (T.StringType, T.LongType, T.IntegerType)
Result = TypeVar("Result")


class WriteConflict(RuntimeError):
    """Another writer changed the same buckets first."""


@dataclass(frozen=True)
class DataFile:
    path: str
    bucket: int
    rows: int
    bytes: int
    #: column: [least, greatest], for keys and ids
    bounds: dict


@dataclass(frozen=True)
class Manifest:
    version: int
    buckets: int
    files: tuple[DataFile, ...]
    parent: str | None = None

    def of(self, buckets: Iterable[int] | None) -> list[DataFile]:
        wanted = None if buckets is None else set(buckets)
        return [f for f in self.files if wanted is None or f.bucket in wanted]

    def greatest(self, column: str):
        """Of all rows, from the bounds alone."""
        return max((f.bounds[column][1] for f in self.files if column in f.bounds), default=None)


@dataclass
class Change:
    """What a transaction does to a table: files that go and come, and the buckets it has read (None: all of them)."""

    gone: set[str]
    came: list[DataFile]
    touched: set[int] | None
    buckets: int


class Store:
    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, T.StructType] = TABLES, keys: dict[str, tuple[str, ...]] = BUCKET_KEYS, buckets: int = BUCKETS):
        self.spark, self.root, self.schemas, self.buckets = spark, root.rstrip("/"), schemas, buckets
        self.keys = {t: tuple(keys.get(t) or (s.names[0],)) for t, s in schemas.items()}
        self.disk = Files(spark, root)
        self.log = CommitLog(self.disk)

    # Reading

    def head(self) -> dict[str, str]:
        """The manifest of each table that has one."""
        return self.log.last()[1].get("tables", {})

    def _manifest(self, table: str, name: str | None) -> Manifest | None:
        held = self.disk.get(table, "manifests", name) if name else None
        return held and Manifest(held["version"], held["buckets"], tuple(DataFile(**f) for f in held["files"]), held["parent"])

    def manifest(self, table: str, version: int | None = None, head: dict[str, str] | None = None) -> Manifest | None:
        """The manifest of a version, by default the last; None before there is one."""
        name = (self.head() if head is None else head).get(table)
        while name:
            found = self._manifest(table, name)
            if found is None:
                if version is None:
                    raise FileNotFoundError(f"{table}: its manifest {name} is gone")
                break
            if version is None or found.version == version:
                return found
            name = found.parent
        if version is not None:
            raise ValueError(f"{table} has no version {version}")
        return None

    def versions(self, table: str) -> list[int]:
        out, name = [], self.head().get(table)
        while name and (found := self._manifest(table, name)):
            out.append(found.version)
            name = found.parent
        return out[::-1]

    def version(self, table: str) -> int | None:
        found = self.manifest(table)
        return found and found.version

    def _frame(self, table: str, files: Iterable[DataFile]) -> DataFrame:
        paths = [f"{self.root}/{table}/{f.path}" for f in files]
        if not paths:
            return nothing(self.spark, self.schemas[table])
        # a bucket's number is in its path only: without a recursive lookup it would come back as a column
        return self.spark.read.schema(self.schemas[table]).option("recursiveFileLookup", "true").parquet(*paths)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        found = self.manifest(table, version)
        return self._frame(table, found.files if found else ())

    def pruned(self, table: str, manifest: Manifest | None, **equal) -> list[DataFile]:
        """The files that can hold a row of these values: of the bucket, if all its keys are given, and by their bounds."""
        if manifest is None:
            return []
        keys = self.keys[table]
        bucket = None
        if all(equal.get(k) is not None for k in keys):
            typed = [F.lit(equal[k]).cast(self.schemas[table][k].dataType) for k in keys]
            bucket = [self.spark.range(1).select(self._bucket(typed, manifest.buckets)).first()[0]]
        return self._bounded(manifest.of(bucket), equal)

    @staticmethod
    def _bounded(files: Iterable[DataFile], equal: dict) -> list[DataFile]:
        return [f for f in files if all(c not in f.bounds or f.bounds[c][0] <= v <= f.bounds[c][1] for c, v in equal.items() if v is not None)]

    def lookup(self, table: str, **equal) -> DataFrame:
        """The rows whose columns have these values, from the files that can hold them."""
        return self._looked_up(table, self.manifest(table), equal)

    def _looked_up(self, table: str, manifest: Manifest | None, equal: dict) -> DataFrame:
        rows = self._frame(table, self.pruned(table, manifest, **equal))
        for column, value in equal.items():
            rows = rows.where(F.col(column).eqNullSafe(F.lit(value)))
        return rows

    def among(self, table: str, column: str, values: list) -> DataFrame:
        """The rows whose column has one of some values, from the files that can hold any of them."""
        manifest = self.manifest(table)
        if manifest is None or not values:
            return self._frame(table, ())
        files = {f.path: f for v in values for f in self._bounded(manifest.files, {column: v})}.values()
        if self.keys[table] == (column,):
            one = self.spark.createDataFrame([(v,) for v in values], T.StructType([self.schemas[table][column]]))
            buckets = {r[0] for r in one.select(self._bucket([F.col(column)], manifest.buckets)).collect()}
            files = [f for f in files if f.bucket in buckets]
        return self._frame(table, files).where(F.col(column).isin(values))

    # Writing

    @staticmethod
    def _bucket(keys: list[Column], buckets: int) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def _put(self, table: str, df: DataFrame, buckets: int) -> list[DataFile]:
        """Write `df` into files of a bucket each, in a folder that no manifest names yet."""
        keys = self.keys[table]
        folder = f"data-{uuid.uuid4().hex}"
        rows = verify(df, self.schemas[table], table).withColumn("bucket", self._bucket([F.col(k) for k in keys], buckets))
        # a rebalance keeps a bucket in one task until it is too large for one
        rows = rows.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", *keys)
        rows.write.partitionBy("bucket").parquet(f"{self.root}/{table}/{folder}")
        sizes = {p: n for p, n in self.disk.sizes(table, folder).items() if p.endswith(".parquet")}
        if not sizes:
            return []
        bounded = [c for c in dict.fromkeys((*keys, "id")) if c in self.schemas[table].names and isinstance(self.schemas[table][c].dataType, _BOUNDED)]
        held = self._frame(table, [DataFile(f"{folder}/{p}", 0, 0, 0, {}) for p in sizes])
        # a file's path as it is, one constant for all its rows: anything made of it would be made again for each row
        stats = held.groupBy(F.col("_metadata.file_path").alias("__name")).agg(F.count("*").alias("__rows"), *[f(c).alias(f"{k}_{c}") for c in bounded for k, f in (("lo", F.min), ("hi", F.max))])
        known = {"/".join(r["__name"].rsplit("/", 2)[1:]): r for r in stats.collect()}  # a row for each file
        out = []
        for path, size in sizes.items():
            row = known.get(path)
            if row is not None:
                bounds = {c: [row[f"lo_{c}"], row[f"hi_{c}"]] for c in bounded if row[f"lo_{c}"] is not None}
                out.append(DataFile(f"{folder}/{path}", int(re.search(r"bucket=(\d+)", path).group(1)), row["__rows"], size, bounds))
        return out

    def begin(self) -> Transaction:
        return Transaction(self)

    def commit(self, base: dict[str, str], changes: dict[str, Change]) -> None:
        """Publish changes made on the state `base`, over whatever was published since, unless that touched the same buckets."""
        for _ in range(100):
            number, entry = self.log.last()
            tables = dict(entry.get("tables", {}))
            for table, change in changes.items():
                tables[table] = self._apply(table, change, base.get(table), tables.get(table))
            if self.log.add(number + 1, {"tables": tables}):
                return
        raise WriteConflict("a hundred other commits came first")

    def _apply(self, table: str, change: Change, base: str | None, now: str | None) -> str:
        """Put down the manifest that a change makes of the one that is there now; its name."""
        current = self._manifest(table, now) or Manifest(0, change.buckets, ())
        if now != base:
            before = self._manifest(table, base) or Manifest(0, change.buckets, ())
            moved = {f.bucket for f in {f.path: f for f in (*before.files, *current.files)}.values() if (f in before.files) != (f in current.files)}
            if change.touched is None or current.buckets != change.buckets or moved & change.touched:
                raise WriteConflict(f"{table}: version {current.version} is there already")
        files = [f for f in current.files if f.path not in change.gone] + change.came
        name = uuid.uuid4().hex
        made = Manifest(current.version + 1, change.buckets, tuple(files), now)
        self.disk.publish(asdict(made), table, "manifests", name)
        return name

    def _alone(self, act: Callable[[Transaction], object]) -> None:
        with self.begin() as own:
            act(own)

    def write(self, table: str, df: DataFrame) -> int:
        """The whole table anew; returns its version."""
        return self.write_all({table: df})[table]

    def write_all(self, tables: dict[str, DataFrame]) -> dict[str, int]:
        with self.begin() as own:
            for table, df in tables.items():
                own.write(table, df)
        return {t: own.version_of(t) for t in tables}

    def append(self, table: str, df: DataFrame) -> None:
        self._alone(lambda t: t.append(table, df))

    def upsert(self, table: str, rows: DataFrame, keys: list[str], keep: tuple[str, ...] = (), fill: tuple[str, ...] = ()) -> None:
        self._alone(lambda t: t.upsert(table, rows, keys, keep, fill))

    def replace(self, table: str, rows: DataFrame, keys: list[str], gone: DataFrame | None = None) -> None:
        self._alone(lambda t: t.replace(table, rows, keys, gone))

    def delete(self, table: str, rows: DataFrame, keys: list[str]) -> None:
        self._alone(lambda t: t.delete(table, rows, keys))

    def retry(self, act: Callable[[], Result], times: int = 5) -> Result:
        """Do it again, from a fresh state, as long as others come first."""
        for _ in range(times - 1):
            try:
                return act()
            except WriteConflict:
                continue
        return act()

    # Upkeep

    def compact(self, table: str, most_files: int = 4, bucket_bytes: int = BUCKET_BYTES) -> bool:
        """Join the files of buckets that have more than `most_files`; a table whose buckets grew beyond `bucket_bytes` gets more of them. False if there was nothing to do."""
        with self.begin() as own:
            held = own.manifest(table)
            if held is None:
                return False
            size = sum(f.bytes for f in held.files)
            if size > 2 * bucket_bytes * held.buckets:
                own.write(table, own.read(table), buckets=-(-size // bucket_bytes))
                return True
            counts: dict[int, int] = {}
            for f in held.files:
                counts[f.bucket] = counts.get(f.bucket, 0) + 1
            crowded = {b for b, n in counts.items() if n > most_files}
            if crowded:
                own.rewrite(table, crowded, self._frame(table, held.of(crowded)))
            return bool(crowded)

    def vacuum(self, table: str, keep: int = 2) -> None:
        """Delete all but the last versions, and files that none of these names. No write may be under way."""
        name, kept, held = self.head().get(table), set(), set()
        while name and len(kept) < keep and (found := self._manifest(table, name)):
            kept.add(name)
            held |= {f.path for f in found.files}
            name = found.parent
        for other in self.disk.names(table, "manifests"):
            if other not in kept:
                self.disk.delete(table, "manifests", other)
        folders = {p.split("/", 1)[0] for p in held}
        for folder in self.disk.names(table):
            if folder.startswith("data-"):
                if folder not in folders:
                    self.disk.delete(table, folder)
                else:
                    for path in self.disk.sizes(table, folder):
                        if f"{folder}/{path}" not in held:
                            self.disk.delete(table, folder, path)
        self.log.trim()


class Transaction:
    """Mutations on one state of the store, published together when the `with` block ends; an exception publishes nothing."""

    def __init__(self, store: Store):
        self.store, self.base = store, store.head()
        self.changes: dict[str, Change] = {}
        self._known: dict[str, Manifest | None] = {}

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None and self.changes:
            self.store.commit(self.base, self.changes)

    def manifest(self, table: str) -> Manifest | None:
        if table not in self._known:
            self._known[table] = self.store.manifest(table, head=self.base)
        return self._known[table]

    def read(self, table: str) -> DataFrame:
        """As it was when the transaction began."""
        held = self.manifest(table)
        return self.store._frame(table, held.files if held else ())

    def lookup(self, table: str, **equal) -> DataFrame:
        return self.store._looked_up(table, self.manifest(table), equal)

    def version_of(self, table: str) -> int:
        """The table's version, the one that this transaction makes included."""
        return (held.version if (held := self.manifest(table)) else 0) + (table in self.changes)

    def next_id(self, table: str) -> int:
        held = self.manifest(table)
        return ((held.greatest("id") if held else None) or 0) + 1

    def _buckets(self, table: str) -> int:
        held = self.manifest(table)
        return held.buckets if held else self.store.buckets

    def _change(self, table: str, gone: Iterable[DataFile], came: list[DataFile], touched: set[int] | None, buckets: int | None = None) -> None:
        if table in self.changes:
            raise ValueError(f"{table} is changed twice in one transaction")
        self.changes[table] = Change({f.path for f in gone}, came, touched, buckets or self._buckets(table))

    def write(self, table: str, df: DataFrame, buckets: int | None = None) -> None:
        held = self.manifest(table)
        self._change(table, held.files if held else (), self.store._put(table, df, buckets or self._buckets(table)), None, buckets)

    def append(self, table: str, df: DataFrame, alone: bool = False) -> DataFrame:
        """Add rows in files of their own; returns them as written. `alone` forbids any other write beside it, as for ids that go on from the largest."""
        came = self.store._put(table, df, self._buckets(table))
        self._change(table, (), came, None if alone else set())
        return self.store._frame(table, came)

    def rewrite(self, table: str, buckets: set[int], rows: DataFrame) -> None:
        """These buckets hold `rows` from now on."""
        held = self.manifest(table)
        self._change(table, held.of(buckets), self.store._put(table, rows, held.buckets), set(buckets))

    def _staged(self, table: str, rows: DataFrame, keys: list[str]) -> tuple[DataFrame, list[DataFile], list[DataFile]]:
        """Incoming rows as written, their files, and the table's files in the buckets they fall in (all of them, if `keys` don't tell the bucket)."""
        came = self.store._put(table, rows, self._buckets(table))
        held = self.manifest(table)
        own = {f.bucket for f in came} if set(self.store.keys[table]) <= set(keys) else None
        return self.store._frame(table, came), came, held.of(own) if held else []

    def upsert(self, table: str, rows: DataFrame, keys: list[str], keep: tuple[str, ...] = (), fill: tuple[str, ...] = (), alone: bool = False) -> None:
        """The rows of `rows` put in by key, as `upsert` does, in the buckets they fall in."""
        staged, came, old = self._staged(table, rows, keys)
        if came:
            touched = None if alone else self._span(table, keys, [*old, *came])
            self._change(table, old, self.store._put(table, upsert(self.store._frame(table, old), staged, keys, keep, fill), self._buckets(table)), touched)

    def _span(self, table: str, keys: list[str], files: list[DataFile]) -> set[int] | None:
        return {f.bucket for f in files} if set(self.store.keys[table]) <= set(keys) else None

    def replace(self, table: str, rows: DataFrame, keys: list[str], gone: DataFrame | None = None, alone: bool = False) -> DataFrame:
        """All rows of the keys in `rows` are replaced by these, and those of the keys in `gone` deleted; other keys stay. Returns `rows` as written."""
        staged, came, old = self._staged(table, rows, keys)
        out, told = staged.select(*keys), set(self.store.keys[table]) <= set(keys)
        buckets = {f.bucket for f in (*old, *came)}
        if gone is not None:
            named = gone.select(*[F.col(k).cast(self.store.schemas[table][k].dataType).alias(k) for k in keys])
            out = out.unionByName(named)
            if told:
                hashed = self.store._bucket([F.col(k) for k in self.store.keys[table]], self._buckets(table))
                buckets |= {r[0] for r in named.select(hashed).distinct().collect()}  # at most all buckets
        held = self.manifest(table)
        old = held.of(buckets if told else None) if held and (came or gone is not None) else []
        if came or old:
            kept = self.store._put(table, delete_keys(self.store._frame(table, old), out, keys), self._buckets(table)) if old else []
            self._change(table, old, kept + came, buckets if told and not alone else None)
        return staged

    def delete(self, table: str, rows: DataFrame, keys: list[str]) -> None:
        self.replace(table, nothing(self.store.spark, self.store.schemas[table]), keys, gone=rows)


def nothing(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """No rows, as a plan that Spark folds away; an empty list would be dealt to tasks that start Python for it."""
    return spark.range(1).where(F.lit(False)).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def upsert(current: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = (), fill: tuple[str, ...] = ()) -> DataFrame:
    """`current` with the rows of `new` put in by key.

    A matched row takes all columns of the new one, nulls too, but for `keep` (the old value stays if there is one) and
    `fill` (the old value stays where the new one is null). Picks go by which side is present, not by coalesce.
    """
    old = current.select(*[F.col(c).alias(f"o_{c}") for c in current.columns], F.lit(True).alias("__old"))
    own = new.select(*[F.col(c).alias(f"n_{c}") for c in current.columns], F.lit(True).alias("__new"))
    on = [F.col(f"o_{k}") == F.col(f"n_{k}") for k in keys]
    both = old.join(own, on, "full_outer")

    def pick(c: str):
        o, n = F.col(f"o_{c}"), F.col(f"n_{c}")
        if c in keep:
            return F.when(F.col("__old"), o).otherwise(n)
        return F.when(F.col("__new"), F.coalesce(n, o) if c in fill else n).otherwise(o)

    return both.select(*[pick(c).alias(c) for c in current.columns])


def replace_keys(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the new keys are replaced; other keys stay."""
    return current.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def delete_keys(current: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return current.join(gone.select(*keys).distinct(), keys, "left_anti").select(*current.columns)


def with_new_ids(new: DataFrame, start: int, id_column: str = "id") -> DataFrame:
    """`new` (a small batch of writes) with ids from `start` on."""
    order = Window.orderBy(*[c for c in new.columns if c != id_column])
    return new.withColumn(id_column, (F.row_number().over(order) + F.lit(start - 1)).cast("bigint"))


def write_partitions(df: DataFrame, sink, partitions: int = 8, page: int = 200) -> None:
    """Hand pages of rows to `sink(rows)` from a bounded number of tasks, for outside databases that bound connections."""

    def send(rows) -> None:
        batch = []
        for row in rows:
            batch.append(row.asDict(recursive=True))
            if len(batch) == page:
                sink(batch)
                batch = []
        if batch:
            sink(batch)

    df.repartition(partitions).foreachPartition(send)
