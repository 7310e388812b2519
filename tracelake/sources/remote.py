"""Trace services as a Spark source: ``spark.read.format("trace_service")``.

A client is named by option ``client`` as ``module:factory``; the factory takes the options as a dict and gives an object
with ``pages(session, since)`` (the number of pages of a query) and ``page(session, since, number)`` (its records, JSON
texts with an ``id`` of their session). The predicates on ``session_id`` and ``since`` are pushed to the service, without a
session there is no query; each page is a partition, read with retries; at most ``limit`` records are asked for.

``DumpClient`` is a client of pages that were saved to a folder of any file system that pyarrow knows.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition

#: Most records of a query; seconds between the first attempts, and at most; attempts in all (fixed values).
LIMIT = 10_000
FIRST_WAIT, LONGEST_WAIT, ATTEMPTS = 0.5, 8.0, 6
#: What tells of an overloaded service in an error's code, or in its type's name (fixed values).
THROTTLING_CODES = ("ThrottlingException", "TooManyRequestsException", "RequestLimitExceeded", "ServiceUnavailable", "ProvisionedThroughputExceededException")
THROTTLING_TYPES = ("ModelThrottledException", "EventLoopException", "ThrottlingException")
#: Types of errors of services that did not answer in time.
TIMEOUTS = ("TimeoutError", "ReadTimeout", "ConnectTimeout")


def is_throttled(error: BaseException) -> bool:
    """Whether a service says that it is asked too often, or does not answer in time."""
    code = (getattr(error, "response", None) or {}).get("Error", {}).get("Code", "") if isinstance(getattr(error, "response", None), dict) else ""
    return code in THROTTLING_CODES or type(error).__name__ in (*THROTTLING_TYPES, *TIMEOUTS)


def with_retries(call: Callable[[], Any], attempts: int = ATTEMPTS, first: float = FIRST_WAIT, longest: float = LONGEST_WAIT, sleep: Callable[[float], None] = time.sleep) -> Any:
    """A call's answer; while it is throttled it is made again, after a wait that doubles. Other errors pass at once."""
    wait = first
    for left in range(attempts - 1, -1, -1):
        try:
            return call()
        except Exception as e:
            if not left or not is_throttled(e):
                raise
            sleep(wait)
            wait = min(longest, wait * 2)
    raise AssertionError("unreachable")


def resolve(name: str) -> Any:
    """``module:attribute``, imported."""
    module, _, attribute = name.partition(":")
    if not attribute:
        raise ValueError(f"{name} is not of the form module:attribute")
    found = getattr(importlib.import_module(module), attribute, None)
    if found is None:
        raise ValueError(f"{module} has no {attribute}")
    return found


class DumpClient:
    """Pages saved as ``<folder>/<session>/<number>.json``, each a list of records."""

    def __init__(self, options: dict[str, str]) -> None:
        from pyarrow import fs

        self.files, self.root = fs.FileSystem.from_uri(options["folder"])
        self.selector = fs.FileSelector

    def pages(self, session: str, since: str | None) -> int:
        from pyarrow import fs

        where = f"{self.root}/{session}"
        if self.files.get_file_info(where).type != fs.FileType.Directory:
            return 0
        return sum(f.base_name.endswith(".json") for f in self.files.get_file_info(self.selector(where)))

    def page(self, session: str, since: str | None, number: int) -> list[str]:
        with self.files.open_input_stream(f"{self.root}/{session}/{number}.json") as f:
            records = json.loads(f.read())
        return [json.dumps(r) for r in records if since is None or str(r.get("time", "")) >= since]


class _Page(InputPartition):
    def __init__(self, session: str, since: str | None, number: int) -> None:
        self.session, self.since, self.number = session, since, number


class TraceService(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return "trace_service"

    def schema(self) -> str:
        return "session_id string, since string, page int, pos int, record string"

    def reader(self, schema) -> DataSourceReader:
        return ServiceReader(dict(self.options))


class ServiceReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.session, self.since = options, options.get("session"), None
        self.limit = int(options.get("limit", LIMIT))
        self.per_page = int(options.get("page_size", 100))

    def _client(self) -> Any:
        return resolve(self.options.get("client", "tracelake.sources.remote:DumpClient"))(self.options)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("session_id",):
                self.session = f.value
            elif isinstance(f, GreaterThanOrEqual) and f.attribute == ("since",):
                self.since = f.value
            yield f  # checked again by Spark

    def partitions(self) -> list[InputPartition]:
        if not self.session:
            raise ValueError("a trace service is asked for one session: filter on session_id")
        n = with_retries(lambda: self._client().pages(self.session, self.since))
        most = -(-self.limit // self.per_page)
        return [_Page(self.session, self.since, i) for i in range(min(n, most))]

    def read(self, partition: _Page | None) -> Iterator[tuple]:
        if partition is None:  # a query without pages
            return
        client = self._client()
        records = with_retries(lambda: client.page(partition.session, partition.since, partition.number))
        room = self.limit - partition.number * self.per_page
        for pos, record in enumerate(records[: max(0, room)]):
            yield partition.session, partition.since, partition.number, pos, record


def fetch(spark: SparkSession, session: str, since: str | None = None, **options: str) -> DataFrame:
    """A session's records in order: pos, record (a variant). An unknown session has none."""
    spark.dataSource.register(TraceService)
    rows = spark.read.format("trace_service").options(**options).load().where(F.col("session_id") == session)
    rows = rows if since is None else rows.where(F.col("since") >= since)
    return rows.select((F.col("page") * 1_000_000 + F.col("pos")).cast("long").alias("pos"), F.try_parse_json("record").alias("record"))
