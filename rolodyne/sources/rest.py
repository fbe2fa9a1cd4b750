"""Paginated responses as a Spark data source.

PagedSource turns anything that gives pages into rows: reads split the accounts
(or whatever the pages belong to) over tasks. Filters on the account and on the
instant reach the source: only the accounts asked for are read, and pages end
where the instants asked for do. A stream read has a cursor of instants for each
account, so that a slow one isn't passed by the others; each batch also looks
back `overlap` seconds for late rows, whose repeats a deduplication by id takes
out downstream. Instants are compared in microseconds, however they are spelled.
What fetches a page is a plain function, so tests need no network.

ConditionalSink writes updates in batches, each under the condition that the
entry still has the tag it was read with; conflicts are reported, not raised."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

#: name -> fetch(account, cursor) -> (rows, next cursor or None)
FETCHERS: dict[str, Callable] = {}
#: Where a source begins that is given no start, and seconds a stream looks back.
EARLIEST, OVERLAP = "2015-01-01T00:00:00Z", 300
DAY = 86_400_000_000


def register(name: str, fetch: Callable) -> None:
    FETCHERS[name] = fetch


def micros(instant: str | int | datetime | None) -> int | None:
    """Microseconds since 1970 of an ISO text or a datetime (UTC where it names no
    zone); any number of digits of a second; numbers as they are. Null for null
    and for what is no instant."""
    if instant is None or isinstance(instant, int):
        return instant
    if isinstance(instant, str):
        try:
            instant = datetime.fromisoformat(instant.strip() + "-01-01" * (len(instant.strip()) == 4))
        except ValueError:
            return None
    if instant.tzinfo is None:
        instant = instant.replace(tzinfo=UTC)
    since = instant - datetime(1970, 1, 1, tzinfo=UTC)
    return (since.days * 86_400 + since.seconds) * 1_000_000 + since.microseconds


def pages(fetch: Callable, account: str, since: str | int | datetime | None = None, until: str | int | datetime | None = None, tries: int = 4, wait: float = 0.5) -> Iterator[tuple]:
    """Rows of all pages, newest first: those outside [since, until) drop out (with
    a limit also those without an instant), and a page that reaches back beyond
    since is the last. Errors are tried again with growing pauses. A row's last
    value is its instant."""
    cursor, low, high = None, micros(since), micros(until)
    while True:
        for attempt in range(tries):
            try:
                rows, cursor = fetch(account, cursor)
                break
            except OSError:
                if attempt == tries - 1:
                    raise
                time.sleep(wait * 2**attempt)
        at = [micros(r[-1]) for r in rows]
        for r, m in zip(rows, at):
            if (low is None or (m is not None and m >= low)) and (high is None or (m is not None and m < high)):
                yield r
        known = [m for m in at if m is not None]
        if cursor is None or (low is not None and known and min(known) < low):
            return


def _accounts(options: dict) -> list[str]:
    return [a for a in options.get("accounts", "").split(",") if a]


class _Account(InputPartition):
    def __init__(self, account: str, since: int | None, until: int | None):
        self.account, self.since, self.until = account, since, until


class _Batch(DataSourceReader):
    def __init__(self, options: dict, fetch: Callable, schema: StructType, count: Callable | None):
        self.fetch, self.count, self.accounts = fetch, count, _accounts(options)
        self.since, self.until = micros(options.get("since")), micros(options.get("until"))
        self.account_col, self.at_col = options.get("account", schema[0].name), None if count else schema[-1].name
        # texts compare by letters, which differs from instants by a zone at most
        self.slack = DAY if schema[-1].dataType.typeName() == "string" else 0

    def partitions(self) -> list[InputPartition]:
        if self.since is not None and self.until is not None and self.since >= self.until:
            return []
        return [_Account(a, self.since, self.until) for a in self.accounts]

    def read(self, partition: _Account | None) -> Iterator[tuple]:
        if partition is None:  # without partitions there is one call with none
            return
        if self.count is not None:
            yield (partition.account, self.count(partition.account, partition.since, partition.until))
        else:
            yield from pages(self.fetch, partition.account, partition.since, partition.until)


class _Pushed(_Batch):
    def pushFilters(self, filters: list[Filter]) -> list[Filter]:
        """Narrows accounts and instants; Spark tests the rows again."""
        for f in filters:
            column = getattr(f, "attribute", (None,))
            if column == (self.account_col,) and isinstance(f, EqualTo | In):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.accounts = [a for a in self.accounts if a in wanted]
            elif column == (self.at_col,) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                at = micros(f.value)
                if at is not None and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.since = max(x for x in (self.since, at - self.slack) if x is not None)
                if at is not None and isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    self.until = min(x for x in (self.until, at + self.slack + 1) if x is not None)
        return filters


class _Slice(InputPartition):
    """An account's instants after `since` up to and with `until`, and before that from `again` on."""

    def __init__(self, account: str, again: int, until: int):
        self.account, self.again, self.until = account, again, until


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict, fetch: Callable):
        self.fetch, self.overlap = fetch, int(float(options.get("overlap", OVERLAP)) * 1_000_000)
        self.accounts = _accounts(options)
        self.since = micros(options.get("since", EARLIEST))

    def initialOffset(self) -> dict:
        return {a: self.since for a in self.accounts}

    def latestOffset(self) -> dict:
        """Each account's newest instant, from its first page that has rows."""
        return {a: next(iter(self._newest(a)), self.since) for a in self.accounts}

    def _newest(self, account: str) -> Iterator[int]:
        cursor = None
        while True:
            rows, cursor = self.fetch(account, cursor)
            known = [m for m in (micros(r[-1]) for r in rows) if m is not None]
            if known:
                yield max(self.since, max(known))
            if known or cursor is None:
                return

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        begin = {a: micros(start.get(a, self.since)) for a in end}  # offsets of earlier versions are texts
        return [_Slice(a, begin[a], micros(end[a])) for a in sorted(end) if micros(end[a]) > begin[a]]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        fresh = partition.again == self.since
        for r in pages(self.fetch, partition.account, partition.again - self.overlap, partition.until + 1):
            if fresh or self.overlap or micros(r[-1]) > partition.again:
                yield r


def paged_source(name: str, fetch: Callable, columns: str, count: Callable | None = None) -> type[DataSource]:
    """A data source class for spark.dataSource.register(...): the first column is
    the account (or the one named by the option `account`), the last the instant.

    count(account, since, until), limits in microseconds or None, lets the source
    answer `count_rows` without sending rows."""

    class PagedSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "account string, n long" if self.options.get("counts") else columns

        def reader(self, schema) -> DataSourceReader:
            return (_Pushed if self.options.get("pushdown") else _Batch)(self.options, fetch, schema, count if self.options.get("counts") else None)

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _Stream(self.options, fetch)

    return PagedSource


def read_pages(spark: SparkSession, name: str, **options: str) -> DataFrame:
    """Rows of a registered source, with filters handed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(name).options(pushdown="1", **options).load()


def count_rows(spark: SparkSession, name: str, **options: str) -> DataFrame:
    """(account, n): how many rows each account has between the options since and
    until, as the source itself counts them."""
    return read_pages(spark, name, counts="1", **options)


# --- writing ------------------------------------------------------------------

#: So many updates go in one request.
REQUEST = 500


@dataclass
class Written(WriterCommitMessage):
    """What one task has written: ids whose tag had changed, and how many went through."""

    written: int = 0
    conflicts: list[str] = field(default_factory=list)


class _Conditional(DataSourceWriter):
    def __init__(self, options: dict, send: Callable, report: Callable | None):
        self.size, self.send, self.report = int(options.get("request", REQUEST)), send, report

    def write(self, iterator: Iterator) -> Written:
        """Sends (id, tag, body) in requests; each entry is written only if its tag
        is still the one given. A task that runs again sends the same request key,
        by which the service tells a repeat; and an entry that the first attempt
        has written holds this body, so its new tag is no conflict."""
        out, lot = Written(), []
        for row in iterator:
            lot.append((row[0], row[1], row[2]))
            if len(lot) == self.size:
                self._request(lot, out)
                lot = []
        if lot:
            self._request(lot, out)
        return out

    def _request(self, lot: list[tuple], out: Written) -> None:
        key = _request_key(lot)
        for attempt in range(4):
            try:
                answers = self.send(key, lot)
                break
            except OSError:
                if attempt == 3:
                    raise
                time.sleep(0.05 * 2**attempt)
        refused = [i for (i, _, _), ok in zip(lot, answers) if not ok]
        out.written += len(lot) - len(refused)
        out.conflicts += refused

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        if self.report:
            self.report(sum(m.written for m in done), sorted(i for m in done for i in m.conflicts))

    def abort(self, messages: list[Written | None]) -> None:
        """What was sent stays sent: a later run meets its own bodies and goes on."""


def _request_key(lot: list[tuple]) -> str:
    import hashlib

    return hashlib.sha256(json.dumps(lot, default=str).encode()).hexdigest()


def conditional_sink(name: str, send: Callable, report: Callable | None = None) -> type[DataSource]:
    """A data source class to write (id, tag, body) rows with.

    send(key, lot) -> for each (id, tag, body) of the lot whether it was written;
    report(written, conflicts) is called once, when all tasks have committed."""

    class ConditionalSink(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def writer(self, schema, overwrite: bool) -> DataSourceWriter:
            return _Conditional(self.options, send, report)

    return ConditionalSink


def write_updates(updates: DataFrame, name: str, **options: str) -> None:
    """updates (id, tag, body) to a registered sink. Rows of one id are in one task
    and sorted, so that a task that runs again makes the same requests."""
    rows = updates.select("id", "tag", "body").repartition("id").sortWithinPartitions("id", "tag", "body")
    rows.write.format(name).mode("append").options(**options).save()


def read_jdbc(spark, url: str, tables: dict[str, str], since: int | str | None = None, until: int | str | None = None, partitions: int = 1, **options):
    """Messages of a database: the message table with its handle and chat, by two
    left joins; predicates on the date reach the database. tables names the
    message, handle, chat and bridge tables (or subqueries). With both limits and
    several partitions the messages are read in as many ranges of the date, one
    task each; rows come in no order."""
    from pyspark.sql import functions as F

    t = {k: spark.read.jdbc(url, v, properties=options) for k, v in tables.items() if k != "message"}
    if partitions > 1 and since is not None and until is not None:
        m = spark.read.jdbc(url, tables["message"], column="date", lowerBound=since, upperBound=until, numPartitions=partitions, properties=options)
    else:
        m = spark.read.jdbc(url, tables["message"], properties=options)
    if since is not None:
        m = m.where(F.col("date") >= since)
    if until is not None:
        m = m.where(F.col("date") < until)
    return m.join(t["handle"], "handle_id", "left").join(t["bridge"], "message_id", "left").join(t["chat"], "chat_id", "left")
