"""Tables of any DB-API database: incremental pulls as a source, and a sink that writes once.

``tally_pull`` reads a table by a cursor column. A batch read takes what lies above
``after``; a stream's offset is the highest cursor value seen, so it resumes from there.
Either is cut into ``partitions`` at quantiles of the cursor, each read by a task of its own
with its own connection.

``tally_push`` appends rows exactly once for each pair of ``query`` and batch number. A task
writes to a staging table under a token of its attempt; the driver then moves the rows of
the attempts that succeeded, notes the batch in a ledger and clears the staging table, all
in one transaction. A batch that the ledger has is not moved again, and what failed or lost
attempts have staged never is.

Options of both: ``driver`` (a DB-API module, which executors import), ``database`` (what
its ``connect`` takes), ``table``, and ``mark``, the driver's placeholder (``?``).
"""

from __future__ import annotations

import datetime
import importlib
import json
import re
import uuid
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage,
)
from pyspark.sql.types import Row, StructType

_NAME = re.compile(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)?")
LEDGER = "tally_batches"
_FETCH = 1000


def _name(text: str) -> str:
    if not _NAME.fullmatch(text):
        raise ValueError(f"not a plain name: {text!r}")
    return text


class _Table:
    """A table behind a connection that is opened anew wherever it is needed."""

    def __init__(self, options: dict):
        self.driver, self.database, self.table, self.mark = options["driver"], options["database"], _name(options["table"]), options.get("mark", "?")

    def connect(self):
        return closing(importlib.import_module(self.driver).connect(self.database))

    def ask(self, sql: str, values: tuple = ()) -> list[tuple]:
        with self.connect() as con:
            cur = con.cursor()
            cur.execute(sql, values)
            return cur.fetchall()


@dataclass
class Range(InputPartition):
    """Rows with a cursor above ``low`` (from the first, if None) up to ``high``."""

    low: object
    high: object


class _Pull:
    """What the batch and the stream reader share."""

    def __init__(self, schema: StructType, options: dict):
        self.source, self.columns = _Table(options), [_name(f.name) for f in schema]
        self.cursor, self.count = _name(options["cursor"]), int(options.get("partitions", 1))
        self.after = json.loads(options["after"]) if "after" in options else None

    def _above(self, low, high) -> tuple[str, tuple]:
        mark, parts, values = self.source.mark, [f"{self.cursor} IS NOT NULL"], []
        for op, v in ((">", low), ("<=", high)):
            if v is not None:
                parts.append(f"{self.cursor} {op} {mark}")
                values.append(v)
        return " AND ".join(parts), tuple(values)

    def highest(self):
        return self.source.ask(f"SELECT max({self.cursor}) FROM {self.source.table}")[0][0]

    def ranges(self, low, high) -> list[Range]:
        """At most ``partitions`` ranges of about as many rows each."""
        if high is None or low == high:
            return []
        where, values = self._above(low, high)
        rows = self.source.ask(f"SELECT count(*) FROM {self.source.table} WHERE {where}", values)[0][0]
        cuts = []
        for k in range(1, self.count):
            at = self.source.ask(f"SELECT {self.cursor} FROM {self.source.table} WHERE {where} ORDER BY {self.cursor} LIMIT 1 OFFSET {rows * k // self.count}", values)
            cuts += [r[0] for r in at if r[0] != high]
        cuts = [*dict.fromkeys(cuts), high]  # a value of many rows cuts once
        return [Range(a, b) for a, b in zip([low, *cuts], cuts)] if rows else []

    def rows(self, part: Range) -> Iterator[tuple]:
        where, values = self._above(part.low, part.high)
        with self.source.connect() as con:
            cur = con.cursor()
            cur.execute(f"SELECT {', '.join(self.columns)} FROM {self.source.table} WHERE {where}", values)
            while some := cur.fetchmany(_FETCH):
                yield from some


class PullReader(_Pull, DataSourceReader):
    def partitions(self) -> list[Range]:
        # Spark asks for one partition at least; one without rows is a range below everything.
        return self.ranges(self.after, self.highest()) or [Range(None, None)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return self.rows(partition) if partition.high is not None else iter(())


class PullStreamReader(_Pull, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"at": self.after}

    def latestOffset(self) -> dict:
        top = self.highest()
        return {"at": self.after if top is None else top}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.ranges(start["at"], end["at"])

    def read(self, partition: Range) -> Iterator[tuple]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class Pull(DataSource):
    """``tally_pull``: give the columns as the reader's schema, and ``cursor``, ``partitions`` and ``after`` (JSON) as options."""

    @classmethod
    def name(cls) -> str:
        return "tally_pull"

    def schema(self):
        raise ValueError("name the columns by .schema(...)")

    def reader(self, schema: StructType) -> PullReader:
        return PullReader(schema, self.options)

    def streamReader(self, schema: StructType) -> PullStreamReader:
        return PullStreamReader(schema, self.options)


@dataclass
class Staged(WriterCommitMessage):
    token: str
    rows: int


class _Push:
    def __init__(self, schema: StructType, options: dict):
        self.source, self.columns = _Table(options), [_name(f.name) for f in schema]
        self.query = options["query"]
        self.staging = self.source.table.replace(".", "_") + "_staged"

    def prepare(self) -> None:
        """Staging table and ledger, if they are not there."""
        with self.source.connect() as con:
            cur = con.cursor()
            cur.execute(f"CREATE TABLE IF NOT EXISTS {self.staging} AS SELECT '' AS tally_query, '' AS tally_token, {', '.join(self.columns)} FROM {self.source.table} WHERE 1 = 0")
            cur.execute(f"CREATE TABLE IF NOT EXISTS {LEDGER} (query VARCHAR(200), batch BIGINT, PRIMARY KEY (query, batch))")
            con.commit()

    def stage(self, rows: Iterator[Row]) -> Staged:
        token, count, mark = str(uuid.uuid4()), 0, self.source.mark
        told = f"INSERT INTO {self.staging} (tally_query, tally_token, {', '.join(self.columns)}) VALUES ({', '.join([mark] * (2 + len(self.columns)))})"
        with self.source.connect() as con:
            cur, some = con.cursor(), []
            for row in rows:
                some.append((self.query, token, *map(_plain, row)))
                if len(some) == _FETCH:
                    cur.executemany(told, some)
                    count, some = count + len(some), []
            if some:
                cur.executemany(told, some)
            con.commit()
        return Staged(token, count + len(some))

    def settle(self, messages: list[Staged | None], batch: int, good: bool) -> None:
        """Move what the tasks named, unless the ledger has the batch, and clear what this query has staged."""
        mark, columns = self.source.mark, ", ".join(self.columns)
        with self.source.connect() as con:
            cur = con.cursor()
            if good:
                cur.execute(f"SELECT count(*) FROM {LEDGER} WHERE query = {mark} AND batch = {mark}", (self.query, batch))
                if not cur.fetchone()[0]:
                    cur.execute(f"INSERT INTO {LEDGER} (query, batch) VALUES ({mark}, {mark})", (self.query, batch))
                    for m in messages:
                        if m is not None and m.rows:
                            cur.execute(f"INSERT INTO {self.source.table} ({columns}) SELECT {columns} FROM {self.staging} WHERE tally_token = {mark}", (m.token,))
            cur.execute(f"DELETE FROM {self.staging} WHERE tally_query = {mark}", (self.query,))
            con.commit()


def _plain(value):
    return value.isoformat(" ") if isinstance(value, datetime.datetime) else value


class PushWriter(_Push, DataSourceWriter):
    def __init__(self, schema: StructType, options: dict):
        super().__init__(schema, options)
        self.batch = int(options["batch"])
        self.prepare()

    def write(self, iterator: Iterator[Row]) -> Staged:
        return self.stage(iterator)

    def commit(self, messages: list[Staged | None]) -> None:
        self.settle(messages, self.batch, True)

    def abort(self, messages: list[Staged | None]) -> None:
        self.settle(messages, self.batch, False)


class PushStreamWriter(_Push, DataSourceStreamWriter):
    def __init__(self, schema: StructType, options: dict):
        super().__init__(schema, options)
        self.prepare()

    def write(self, iterator: Iterator[Row]) -> Staged:
        return self.stage(iterator)

    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        self.settle(messages, batchId, True)

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        self.settle(messages, batchId, False)


class Push(DataSource):
    """``tally_push``: options ``query`` and, outside a stream, ``batch``; the table must exist."""

    @classmethod
    def name(cls) -> str:
        return "tally_push"

    def writer(self, schema: StructType, overwrite: bool) -> PushWriter:
        if overwrite:
            raise ValueError("tally_push appends")
        return PushWriter(schema, self.options)

    def streamWriter(self, schema: StructType, overwrite: bool) -> PushStreamWriter:
        return PushStreamWriter(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make both formats known to the session."""
    spark.dataSource.register(Pull)
    spark.dataSource.register(Push)
