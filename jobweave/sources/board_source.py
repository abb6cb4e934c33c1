"""Job boards as a data source: `spark.read.format("job_boards")` and `spark.readStream.format("job_boards")`.

The specs of a run are configuration: a JSON list in the option `specs`, which `reading` takes from a DataFrame. Each spec is
an input partition of its own (or `partitions` groups of them), fetched by one task; what a transport raises becomes the
row's error. Filters on the strings of a spec are answered by the source: a spec they exclude is never asked for.

As a stream, an offset is a round and how many specs of it have been read. A trigger reads what the round still holds, so
a restart from a checkpoint fetches nothing twice, and specs that were added meanwhile are fetched alone; a new round (the
option `round`, a number that only grows, such as a day) reads all of them again.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, StringStartsWith
from pyspark.sql.types import StructType

from .specs import PAYLOAD_SCHEMA

FORMAT = "job_boards"
TEXTS = ("kind", "slug", "company", "query", "where", "tenant", "site", "host")
STANDARD = "jobweave.sources.requests:Boards"


def loaded(name: str) -> Callable:
    """`module:attribute`, called without arguments: how an object that can't be an option reaches a task."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)()


def fetch(spec: dict, transport: Callable[[dict], str]) -> tuple:
    """The row of a spec: its strings, then payload, error and time."""
    texts = tuple(spec.get(k) or "" for k in TEXTS)
    name = ":".join(x for x in (texts[0], spec.get("company") or spec.get("slug") or spec.get("query") or "") if x)
    try:
        payload, error = transport(spec), None
    except Exception as exc:  # a dead board is a row, not the end of the run
        payload, error = None, f"{name}: {type(exc).__name__}: {exc}"
    return (*texts, payload, error, datetime.now(UTC).replace(tzinfo=None))


@dataclass
class Specs(InputPartition):
    specs: list[dict]

    def __init__(self, specs: list[dict]):
        super().__init__(None)
        self.specs = specs


def _dealt(specs: list[dict], groups: int) -> list[Specs]:
    groups = min(groups, len(specs)) or len(specs)
    return [Specs(specs[k::groups]) for k in range(groups)]


class _Fetching:
    """What batch and stream readers share."""

    def __init__(self, options: dict):
        self.specs: list[dict] = json.loads(options.get("specs") or "[]")
        self.transport = options.get("transport") or STANDARD
        self.groups = int(options.get("partitions") or 0)

    def read(self, partition: Specs | None) -> Iterator[tuple]:
        transport = loaded(self.transport)
        # without any partition Spark still reads once, with none
        for spec in partition.specs if partition is not None else ():
            yield fetch(spec, transport)


class BoardReader(_Fetching, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equalities, lists and beginnings of a spec's strings pick specs; the rest is left to Spark."""
        for one in filters:
            column = one.attribute[0] if hasattr(one, "attribute") and len(one.attribute) == 1 else None
            value = (lambda s, c=column: s.get(c) or "") if column in TEXTS else None
            if value and isinstance(one, (EqualTo, EqualNullSafe)):
                self.specs = [s for s in self.specs if value(s) == one.value]
            elif value and isinstance(one, In):
                self.specs = [s for s in self.specs if value(s) in one.value]
            elif value and isinstance(one, StringStartsWith):
                self.specs = [s for s in self.specs if value(s).startswith(one.value)]
            else:
                yield one

    def partitions(self) -> list[Specs]:
        return _dealt(self.specs, self.groups)


class BoardStreamReader(_Fetching, DataSourceStreamReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.round = int(options.get("round") or 0)

    def initialOffset(self) -> dict:
        return {"round": self.round, "read": 0}

    def latestOffset(self) -> dict:
        return {"round": self.round, "read": len(self.specs)}

    def partitions(self, start: dict, end: dict) -> list[Specs]:
        # rounds that were missed are not made up for: a board shows what it holds now
        first = start["read"] if start["round"] == end["round"] else 0
        return _dealt(self.specs[first : end["read"]], self.groups)


class BoardSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return PAYLOAD_SCHEMA.replace("where string", "`where` string")

    def reader(self, schema: StructType) -> BoardReader:
        return BoardReader(dict(self.options))

    def streamReader(self, schema: StructType) -> BoardStreamReader:
        return BoardStreamReader(dict(self.options))


def _options(specs: DataFrame, transport: str, partitions: int) -> dict[str, str]:
    # a run's specs are its configuration, a line for each board
    return {"specs": json.dumps([json.loads(s) for s in specs.toJSON().collect()]), "transport": transport, "partitions": str(partitions)}


def reading(specs: DataFrame, transport: str = STANDARD, partitions: int = 0) -> DataFrame:
    """A row for each spec, fetched when it is read; filters on a spec's strings keep others from being asked."""
    spark = registered(specs.sparkSession)
    return spark.read.format(FORMAT).options(**_options(specs, transport, partitions)).load()


def streaming(specs: DataFrame, round: int, transport: str = STANDARD, partitions: int = 0) -> DataFrame:
    """The rows of a round as a stream; the query's checkpoint knows which specs have been read."""
    spark = registered(specs.sparkSession)
    return spark.readStream.format(FORMAT).options(round=str(round), **_options(specs, transport, partitions)).load()


def registered(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BoardSource)
    return spark
