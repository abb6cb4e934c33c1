"""An outside database as a sink with a commit: `df.write.format("database_pages")`.

Tasks put pages of rows into a staging table, each under the mark of its attempt; when all tasks are done, one database
transaction on the driver moves the rows of the attempts that counted into the table and empties the staging table of this
write. A task that fails, is tried again or runs twice leaves rows that no commit names; a write that fails leaves none
visible. Connections are one for each task, so `repartition(n)` before the write bounds them.

Options: `connect` (`module:function` that opens a DB-API connection), `table`, `key` (columns, comma-separated; rows of
these keys are replaced, without it rows are added), `page` (rows of one insert), `placeholder` (`?` or `%s`). The staging
table is `{table}_staged`, made by the first write. Names go into statements as they are and must be plain identifiers.
"""

from __future__ import annotations

import importlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "database_pages"
PAGE = 200


@dataclass
class Attempt(WriterCommitMessage):
    mark: str
    rows: int


def _identifier(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"{name!r} is no plain identifier")
    return name


class PageWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.connect, self.table = options["connect"], _identifier(options["table"])
        self.columns = [_identifier(c) for c in schema.names]
        self.key = [_identifier(k.strip()) for k in (options.get("key") or "").split(",") if k.strip()]
        self.page, self.hole, self.overwrite = int(options.get("page") or PAGE), options.get("placeholder") or "?", overwrite
        self.staged, self.run = f"{self.table}_staged", uuid.uuid4().hex
        if set(self.key) - set(self.columns):
            raise ValueError(f"key {', '.join(self.key)} is not among the columns")
        self._execute([(f"CREATE TABLE IF NOT EXISTS {self.staged} AS SELECT '' AS run, '' AS mark, {', '.join(self.columns)} FROM {self.table} WHERE 1 = 0", ())])

    def _open(self):
        module, _, attribute = self.connect.partition(":")
        return getattr(importlib.import_module(module), attribute)()

    def _execute(self, statements: list[tuple[str, tuple]]) -> None:
        """All of them in one transaction."""
        connection = self._open()
        try:
            cursor = connection.cursor()
            for sql, values in statements:
                cursor.execute(sql, values)
            connection.commit()
        except BaseException:
            connection.rollback()
            raise
        finally:
            connection.close()

    def write(self, iterator: Iterator[Row]) -> Attempt:
        mark, rows, connection = uuid.uuid4().hex, 0, self._open()
        insert = f"INSERT INTO {self.staged} (run, mark, {', '.join(self.columns)}) VALUES ({', '.join([self.hole] * (len(self.columns) + 2))})"
        try:
            while page := list(islice(iterator, self.page)):
                cursor = connection.cursor()
                cursor.executemany(insert, [(self.run, mark, *row) for row in page])
                connection.commit()
                rows += len(page)
        finally:
            connection.close()
        return Attempt(mark, rows)

    def commit(self, messages: list[Attempt | None]) -> None:
        marks = [m.mark for m in messages if m is not None]
        ours = f"s.run = {self.hole} AND s.mark IN ({', '.join([self.hole] * len(marks)) or 'NULL'})"
        values = (self.run, *marks)
        statements: list[tuple[str, tuple]] = []
        if self.overwrite:
            statements.append((f"DELETE FROM {self.table}", ()))
        elif self.key:
            same = " AND ".join(f"s.{k} = {self.table}.{k}" for k in self.key)
            statements.append((f"DELETE FROM {self.table} WHERE EXISTS (SELECT 1 FROM {self.staged} s WHERE {same} AND {ours})", values))
        listed = ", ".join(self.columns)
        statements.append((f"INSERT INTO {self.table} ({listed}) SELECT {listed} FROM {self.staged} s WHERE {ours}", values))
        statements.append((f"DELETE FROM {self.staged} WHERE run = {self.hole}", (self.run,)))
        self._execute(statements)

    def abort(self, messages: list[Attempt | None]) -> None:
        self._execute([(f"DELETE FROM {self.staged} WHERE run = {self.hole}", (self.run,))])


class PageSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> PageWriter:
        return PageWriter(dict(self.options), schema, overwrite)


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(PageSink)
    return spark


def write_pages(df: DataFrame, connect: str, table: str, key: str = "", connections: int = 8, page: int = PAGE, overwrite: bool = False, placeholder: str = "?") -> None:
    """Write `df` from at most so many tasks, all of it or nothing."""
    registered(df.sparkSession)
    options = dict(connect=connect, table=table, key=key, page=str(page), placeholder=placeholder)
    df.repartition(connections).write.format(FORMAT).options(**options).mode("overwrite" if overwrite else "append").save()
