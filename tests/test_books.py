import json
import subprocess
import sys
import tempfile
from pathlib import Path

import pytest

from tallyspark.functions import calendar as cal
from tallyspark.functions import text
from tallyspark.plans import catalogue, questions
from tallyspark.sources import rail, statements
from tallyspark.streaming import intake
from tests.oracle import SF_DIR

BANK = "﻿row_id,value_date,narration,reference,debit,credit,balance\nTR1,2026-03-01,NEFT-HDFC940235305794-PILLAI HARDWARE,,,\"12,40,000.00\",\nTR2,00/00/0000,x,,,5,\nTR3,2026-03-02,both,,1,2,\nTR4,2/3/2026,MISC,,7.50,,\n"
LEDGER = "invoice_no,invoice_date,counterparty,amount,order_id,status\nINV-1,2026-03-01,M/S Pillai Hardware Pvt Ltd,\"1,240.50\",order_1,paid\nINV-2,2026-03-01,x,12.3.4,order_2,paid\n"


def books(folder: Path) -> None:
    (folder / "bank.csv").write_text(BANK, encoding="utf-8")
    (folder / "ledger.csv").write_text(LEDGER, encoding="utf-8")
    items = [{"id": "pay_1", "amount": 124050, "currency": "INR", "order_id": "order_1", "method": "wallet", "created_at": 1772303400, "notes": {"counterparty": "Pillai Hardware"}}, {"id": "pay_2", "currency": "INR", "method": "cheque", "created_at": 1772303400}]
    (folder / "gateway_payments.json").write_text(json.dumps({"entity": "collection", "count": 2, "items": items}))
    (folder / "gateway_settlements.json").write_text(json.dumps({"entity": "collection", "count": 1, "items": [{"id": "setl_1", "amount": 100, "fees": 2, "tax": 1, "utr": "NEFT-HDFC940235305794", "created_at": 1772303400}]}))


def test_readers_and_quarantine(spark, tmp_path):
    books(tmp_path)
    good, bad = statements.split(statements.read_bank(spark, str(tmp_path / "bank.csv")))
    assert {(r.external_id, r.amount_paise, r.direction) for r in good.collect()} == {("TR1", 124000000, "credit"), ("TR4", 750, "debit")}
    assert {r.external_id: r.problem for r in bad.collect()} == {"TR2": "value_date", "TR3": "one of debit and credit is needed"}
    assert good.where("external_id = 'TR1'").first().reference == "940235305794"
    good, bad = statements.split(statements.read_ledger(spark, str(tmp_path / "ledger.csv")))
    assert (good.first().amount_paise, good.first().counterparty, good.first().parent_id, bad.count()) == (124050, "PILLAI HARDWARE", "order_1", 1)
    gateway = statements.read_gateway(spark, str(tmp_path))
    assert {(r.external_id, r.kind, r.method, r.problem) for r in gateway.collect()} == {("pay_1", "payment", "wallet", None), ("pay_2", "payment", "unknown", "amount"), ("setl_1", "settlement", "bank_transfer", None)}
    assert {r.source: r.parse_rate for r in statements.parse_rates(gateway).collect()} == {"gateway": 0.666667}
    assert gateway.select("txn_id").distinct().count() == 3


def test_rows_are_numbered_over_many_splits(spark, tmp_path):
    names = [f"{k:04d}" for k in range(900)]
    lines = [f"INV-{n},{'2026-03-01' if k % 90 else 'soon'},Firm {n},{k}.50,order_{n}" + (",paid" if k % 100 != 7 else "") + (",more" if k % 100 == 8 else "") for k, n in enumerate(names)]
    (tmp_path / "books").mkdir()
    for part, own in (("a", lines[:600]), ("b", lines[600:])):
        (tmp_path / "books" / f"{part}.csv").write_text("\n".join(["invoice_no,invoice_date,counterparty,amount,order_id,status", *own]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")
    try:
        rows = statements.read_ledger(spark, str(tmp_path / "books"))
        assert rows.rdd.getNumPartitions() > 1
        got = {r.external_id: (r.file[-5:], r.row_number) for r in rows.collect()}
        bad = {r.external_id: r for r in statements.split(rows)[1].collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {f"INV-{n}": ("a.csv" if k < 600 else "b.csv", k % 600) for k, n in enumerate(names)}
    assert {i: r.problem for i, r in bad.items()} == {f"INV-{n}": "fields" if k % 100 in (7, 8) else "invoice_date" for k, n in enumerate(names) if k % 100 in (7, 8) or k % 90 == 0}
    assert bad["INV-0607"].raw == lines[607] and bad["INV-0607"].row_number == 7 and "soon" in bad["INV-0090"].raw


def test_rail_only_reads(spark, tmp_path):
    books(tmp_path)
    files = rail.FileRail(spark, str(tmp_path))
    assert files.call("fetch_all_payments").count() == 1 and files.call("fetch_payment", id="pay_1").count() == 1
    assert files.call("fetch_all_payments", first="2026-01-01", last="2026-01-02").count() == 0
    assert files.call("fetch_order_payments", id="order_1").count() == 1 and files.call("fetch_all_payouts").count() == 0
    assert set(files.TOOLS) == rail.READABLE and all(files.call(t, id="none").count() == 0 for t in ("fetch_payout_by_id", "fetch_settlement_with_id"))
    for tool in ("create_refund", "anything"):
        with pytest.raises(rail.ToolRefused):
            files.call(tool)


def payments_client(tool, given):
    """A gateway with a payment every six hours from 1 March 2026, pages of 50 at most, and a row without an amount; every call leaves a file."""
    begin = 1772303400
    rows = [{"id": f"pay_{k}", "amount": None if k == 9 else 100 + k, "created_at": begin + 21600 * k, "order_id": f"order_{k}", "method": "upi"} for k in range(400)]
    Path(tempfile.mkstemp(prefix="call-", dir=tempfile.gettempdir() + "/tallyspark-calls")[1]).write_text(json.dumps([tool, given]))
    if "id" in given:
        return next((r for r in rows if r["id"] == given["id"]), {})
    own = [r for r in rows if given.get("from", 0) <= r["created_at"] <= given.get("to", 1 << 40)]
    return {"items": own[given["skip"] : given["skip"] + min(given["count"], 50)]}


def test_gateway_is_a_source_with_dates_pushed(spark, tmp_path):
    calls = Path(tempfile.gettempdir()) / "tallyspark-calls"
    calls.mkdir(exist_ok=True)
    before = set(calls.iterdir())
    made = lambda: [json.loads(p.read_text()) for p in set(calls.iterdir()) - before]
    remote = rail.RemoteRail(spark, "tests.test_books:payments_client", days=5, count=20)
    rows = remote.items("fetch_all_payments", "2026-03-02", "2026-03-20")
    assert rows.rdd.getNumPartitions() == 4
    assert sorted(int(r.id[4:]) for r in rows.collect()) == list(range(4, 80))
    asked = made()
    assert {g["from"] for _, g in asked} == {1772303400 + 86400 * k for k in (1, 6, 11, 16)} and max(g["to"] for _, g in asked) == 1772303400 + 86400 * 20 - 1
    good = remote.call("fetch_all_payments", "2026-03-01", "2026-03-03")
    assert good.count() == 11 and remote.quarantine("fetch_all_payments", "2026-03-01", "2026-03-03").first().external_id == "pay_9"
    assert remote.call("fetch_all_payments").count() == 399 and remote.call("fetch_all_payments", "2026-03-03", "2026-03-01").count() == 0
    assert remote.call("fetch_payment", id="pay_7").first().amount_paise == 107 and remote.call("fetch_payment", id="none").count() == 0
    for tool in ("create_refund", "anything"):
        with pytest.raises(rail.ToolRefused):
            remote.call(tool)
        with pytest.raises(Exception, match="ToolRefused"):
            spark.read.format("gateway").options(client="tests.test_books:payments_client", tool=tool).load().count()
    with pytest.raises(Exception, match="only read"):
        rows.write.format("gateway").options(client="x:y", tool="fetch_all_payments").mode("append").save()


@pytest.mark.parametrize("question", ["", "what is the weather", "will cash grow next month", "what should we do about fees", "tell me a joke"])
def test_questions_that_are_refused(question):
    assert questions.compile_question(question).intent == "unsupported"


@pytest.mark.parametrize(
    "question, intent",
    [("what happened to setl_601010000489", "settlement_detail"), ("which settlements do not balance", "unbalanced_settlements"), ("how much gst was charged", "total_fees"), ("largest exceptions", "largest_exceptions"), ("exceptions by severity", "exceptions_by_severity"), ("total cash received", "cash_total")],
)
def test_questions_that_are_answered(question, intent):
    assert questions.compile_question(question).intent == intent


def test_answers_are_grounded(spark):
    catalogue.books_views(spark, SF_DIR)
    found = questions.answer(spark, "total cash received")
    assert found["state"] == "answered" and len(found["rows"]) == 1
    assert questions.answer(spark, "total cash received", lambda q, rows: "It was 12345678901 in all")["state"] == "ungrounded"
    assert questions.answer(spark, "what about setl_nothing_1")["state"] == "empty"
    assert questions.valid("limit", 201) is None and questions.valid("as_of", "2026-02-31") is None and questions.valid("settlement_id", "x'; DROP") is None


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.sql("SELECT 'bank' AS source, concat('r', id % 5) AS reference, id % 5 AS amount_paise, timestamp_seconds(1700000000 + id % 5) AS occurred_at FROM range(20)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    intake.append(intake.without_copies(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    assert intake.windowed(events).agg({"n": "sum"}).first()[0] == events.count() == intake.sessions(events).agg({"n": "sum"}).first()[0]


def test_nothing_outside_needs_the_corpus_operators():
    root = Path(__file__).resolve().parent.parent
    for path in (root / "tallyspark").rglob("*.py"):
        if "llm" not in path.parts:
            assert "tallyspark.llm" not in path.read_text(), path
    code = "import re, sys; sys.modules['tallyspark.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()), any(re.match(r'op\\d+_', k) for k in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 40 and out[1] == "False"


def test_holidays_ids_and_narrations(spark, tmp_path):
    (tmp_path / "holidays.json").write_text('["2026-03-04", {"date": "2026-03-05"}, "2026-02-31"]')
    found = statements.read_holidays(spark, str(tmp_path / "holidays.json"))
    assert sorted(str(r.ds) for r in found.collect()) == ["2026-03-04", "2026-03-05"] and statements.read_holidays(spark, str(tmp_path / "none.json")).count() == 0
    days = cal.calendar(spark, "2026-03-01", "2026-03-10", found)
    assert [str(r.ds) for r in days.where("why_closed = 'bank holiday'").orderBy("ds").collect()] == ["2026-03-04", "2026-03-05"]
    books(tmp_path)
    bank = statements.read_bank(spark, str(tmp_path / "bank.csv"))
    named = statements.ids_of(bank, spark.createDataFrame([("TR1",), ("none",)], "external_id string"), "bank").collect()
    assert {r.external_id: r.txn_id is not None for r in named} == {"TR1": True, "none": False}
    row = statements.narration_statistics(bank).first()
    assert (row.lines, row.complete, row.settlements) == (4, 1, 0)
    rows = bank.select(text.opaque_id("external_id", "s").alias("a"), text.opaque_id("external_id", "t").alias("b")).first()
    assert rows.a != rows.b and rows.a.startswith("row_") and len(rows.a) == 20
    late = bank.select(cal.value_date().alias("v"), "occurred_on").first()
    assert late.v == late.occurred_on
