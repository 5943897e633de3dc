"""The gateway as a Spark data source that only reads: date windows are partitions, and filters on dates and ids reach the calls.

    rail.RemoteRail(spark, "shop.gateway:call").call("fetch_all_payments", "2026-03-01", "2026-03-31")

A client is a function of a tool's name and its arguments (``from`` and ``to``
in seconds, ``count`` and ``skip``, or ``id``) that gives ``{"items": [...]}``,
or the one object asked for by its id; it is imported by its name wherever a
task runs, so that no connection or key is part of a plan.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta, timezone

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from tallyspark.sources import rail, statements

FORMAT = "gateway"
SCHEMA = T.StructType([*statements.ITEM.fields, T.StructField("created_on", T.DateType())])
#: Days that one task asks for, and rows of one call, unless options name others.
DAYS, COUNT = 7, 100
ZONE = timezone(timedelta(hours=5, minutes=30))
DAY = timedelta(days=1)


@dataclass
class Window(InputPartition):
    """Dates of one task, both ends included; None leaves an end open."""

    first: date | None
    last: date | None


def day_of(seconds: int | None) -> date | None:
    """The date of a moment in the books' time zone."""
    return None if seconds is None else datetime.fromtimestamp(seconds, UTC).astimezone(ZONE).date()


def begin_of(day: date) -> int:
    return int(datetime(day.year, day.month, day.day, tzinfo=ZONE).timestamp())


class GatewaySource(DataSource):
    """Options: client, tool, and where wanted id, days and count. A tool that is not on the list of those that read is refused before anything is planned, and so is every write."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        rail.allowed(self.options["tool"])
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return GatewayReader(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool):
        raise rail.ToolRefused("the gateway is only read")

    def streamWriter(self, schema: T.StructType, overwrite: bool):
        raise rail.ToolRefused("the gateway is only read")


class GatewayReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.tool, self.client = rail.allowed(options["tool"]), options["client"]
        self.days, self.count = int(options.get("days", DAYS)), int(options.get("count", COUNT))
        self.id: str | None = options.get("id")
        self.first: date | None = None
        self.last: date | None = None
        self.none = False

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Dates narrow the range that is asked for, and an id becomes the call's; all other filters stay with Spark."""
        for f in filters:
            if getattr(f, "attribute", None) == ("created_on",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                low = f.value + DAY if isinstance(f, GreaterThan) else f.value if isinstance(f, EqualTo | GreaterThanOrEqual) else None
                high = f.value - DAY if isinstance(f, LessThan) else f.value if isinstance(f, EqualTo | LessThanOrEqual) else None
                self.first = max(x for x in (self.first, low) if x) if self.first or low else None
                self.last = min(x for x in (self.last, high) if x) if self.last or high else None
            else:
                yield f
        self.none = bool(self.first and self.last and self.first > self.last)

    def partitions(self) -> list[Window]:
        if self.none:
            return []
        if self.id is not None or self.first is None or self.last is None:
            return [Window(self.first, self.last)]
        starts = range(0, (self.last - self.first).days + 1, self.days)
        return [Window(self.first + k * DAY, min(self.first + (k + self.days - 1) * DAY, self.last)) for k in starts]

    def read(self, partition: Window | None) -> Iterator[tuple]:
        """Rows of a window, page by page; what a client gives from outside the window is left out."""
        if partition is None:
            return
        module, function = self.client.split(":")
        call = getattr(importlib.import_module(module), function)
        given = {} if self.id is None else {"id": self.id}
        if partition.first is not None:
            given["from"] = begin_of(partition.first)
        if partition.last is not None:
            given["to"] = begin_of(partition.last + DAY) - 1
        skip = 0
        while True:
            page = call(self.tool, {**given, "count": self.count, "skip": skip})
            items = page["items"] if "items" in page else [page] if page.get("id") else []
            if not isinstance(items, list):
                raise ValueError("items is not a list")
            for item in items:
                day = day_of(item.get("created_at"))
                early = partition.first is not None and (day is None or day < partition.first)
                late = partition.last is not None and (day is None or day > partition.last)
                if not early and not late:
                    yield (*(_typed(item.get(f.name), f.dataType) for f in statements.ITEM.fields), day)
            if "items" not in page or len(items) < self.count:
                return
            skip += len(items)


def _typed(value, kind: T.DataType):
    """A value of an item as its column's type; what has no such form is null, and becomes a problem of the row."""
    if isinstance(kind, T.StringType):
        return None if value is None else str(value)
    if isinstance(kind, T.LongType):
        return value if isinstance(value, int) and not isinstance(value, bool) else None
    return {str(k): None if v is None else str(v) for k, v in value.items()} if isinstance(value, dict) else None


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GatewaySource)
