"""The gateway behind a list of tools that only read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.sources import statements

#: The tools that may be called, and those that write; all that are not on the first list are refused.
READABLE = frozenset(
    [
        "fetch_all_settlements",
        "fetch_settlement_with_id",
        "fetch_settlement_recon_details",
        "fetch_all_payments",
        "fetch_payment",
        "fetch_all_refunds",
        "fetch_all_orders",
        "fetch_order_payments",
        "fetch_all_payouts",
        "fetch_payout_by_id",
    ]
)
WRITING = frozenset(
    [
        "create_order",
        "create_payment_link",
        "create_payment_link_upi",
        "capture_payment",
        "create_refund",
        "update_refund",
        "create_payout",
        "create_qr_code",
        "close_qr_code",
        "update_order",
        "edit_payment_link",
    ]
)


class ToolRefused(PermissionError):
    pass


def allowed(tool: str) -> str:
    """The tool's name, if it is on the list of those that read."""
    if tool not in READABLE:
        raise ToolRefused(f"{tool} {'writes' if tool in WRITING else 'is unknown here'}")
    return tool


class FileRail:
    """The rail over files: the same tools, read by Spark, with filters that reach the scan.

    Each tool is a kind of gateway row, taken as a list, by its own id or by
    the id of what it belongs to; orders and payouts are rows of their kinds,
    and empty where an export holds none.
    """

    #: Tool, kind of row, and the column that a given id is compared with.
    TOOLS = {
        "fetch_all_payments": ("payment", None),
        "fetch_all_refunds": ("refund", None),
        "fetch_all_settlements": ("settlement", None),
        "fetch_all_orders": ("order", None),
        "fetch_all_payouts": ("payout", None),
        "fetch_payment": ("payment", "external_id"),
        "fetch_settlement_with_id": ("settlement", "external_id"),
        "fetch_payout_by_id": ("payout", "external_id"),
        "fetch_order_payments": ("payment", "reference"),
        "fetch_settlement_recon_details": ("settlement", "external_id"),
    }

    def __init__(self, spark: SparkSession, directory: str) -> None:
        self.rows: Callable[[], DataFrame] = lambda: statements.split(statements.read_gateway(spark, directory))[0]

    def call(self, tool: str, first: str | None = None, last: str | None = None, id: str | None = None) -> DataFrame:
        kind, by = self.TOOLS[allowed(tool)]
        rows = self.rows().where(F.col("kind") == kind)
        if by is not None:
            rows = rows.where(F.col(by) == id)
        if tool == "fetch_settlement_recon_details":
            rows = rows.select("external_id", "amount_paise", "metadata", "settled_on")
        return statements.within(rows, first, last) if first and last and by is None else rows


class RemoteRail:
    """The same tools over a client, read as a Spark data source: a range of dates is split among tasks.

    Bad rows are in ``quarantine``; a detail call may give several rows of a settlement.
    """

    def __init__(self, spark: SparkSession, client: str, **options: int) -> None:
        from tallyspark.sources import gateway

        gateway.register(spark)
        self.reader: Callable[[str], DataFrame] = lambda tool: spark.read.format(gateway.FORMAT).options(client=client, tool=tool, **options)

    def items(self, tool: str, first: str | None = None, last: str | None = None, id: str | None = None) -> DataFrame:
        by = FileRail.TOOLS[allowed(tool)][1]
        if by is not None and id is None:
            raise ValueError(f"{tool} asks for an id")
        rows = (self.reader(tool).option("id", id) if by is not None else self.reader(tool)).load()
        for day, inside in ((first, F.col("created_on") >= F.lit(first).cast("date")), (last, F.col("created_on") <= F.lit(last).cast("date"))):
            if day is not None and by is None:
                rows = rows.where(inside)
        return rows

    def call(self, tool: str, first: str | None = None, last: str | None = None, id: str | None = None) -> DataFrame:
        rows = statements.split(statements.gateway_rows(self.items(tool, first, last, id), FileRail.TOOLS[allowed(tool)][0]))[0]
        return rows.select("external_id", "amount_paise", "metadata", "settled_on") if tool == "fetch_settlement_recon_details" else rows

    def quarantine(self, tool: str, first: str | None = None, last: str | None = None, id: str | None = None) -> DataFrame:
        return statements.split(statements.gateway_rows(self.items(tool, first, last, id), FileRail.TOOLS[allowed(tool)][0]))[1]
