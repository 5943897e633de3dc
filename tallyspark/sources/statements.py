"""Readers of ledgers' files: typed rows on one side, quarantined rows with their problem on the other."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tallyspark.functions import calendar as cal
from tallyspark.functions import money, text

TXN = [
    "txn_id", "source", "kind", "external_id", "amount_paise", "currency", "direction", "occurred_at", "occurred_on", "settled_on", "method",
    "counterparty", "raw_counterparty", "reference", "raw_reference", "raw_narration", "parent_id", "metadata", "file", "row_number", "problem", "raw",
]
#: The books' time zone.
ZONE = "+05:30"

NOTES = T.MapType(T.StringType(), T.StringType())
ITEM = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "status", "currency", "order_id", "payment_id", "method", "utr")]
    + [T.StructField(n, T.LongType()) for n in ("amount", "fees", "tax", "created_at")]
    + [T.StructField("notes", NOTES)]
)
ENVELOPE = T.StructType([T.StructField("entity", T.StringType()), T.StructField("count", T.LongType()), T.StructField("items", T.ArrayType(ITEM)), T.StructField("_corrupt_record", T.StringType())])


def txn_id(source: str, external: str = "external_id") -> Column:
    """An id that two sources never share."""
    return F.concat(F.lit("txn_"), F.substring(F.sha2(F.concat_ws("\u001f", F.lit(source), F.col(external)), 256), 1, 32))


def _complete(rows: DataFrame, source: str, **given: Column) -> DataFrame:
    """All columns of a transaction; what a source does not have is null."""
    rows = rows.withColumns({**given, "source": F.lit(source)}).withColumn("txn_id", txn_id(source))
    have = set(rows.columns)
    kinds = {"row_number": "long", "settled_on": "date", "occurred_at": "timestamp", "metadata": "map<string,string>"}
    return rows.select(*(F.col(c) if c in have else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in TXN))


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows without the columns of the quarantine, and the quarantine: source, external_id, file, row_number, problem and raw row."""
    return rows.where("problem IS NULL").drop("problem", "raw"), rows.where("problem IS NOT NULL").select("source", "external_id", "file", "row_number", "problem", "raw")


def read_csv(spark: SparkSession, path: str, columns: list[str], multi_line: bool = False) -> DataFrame:
    """Every column as text, a byte-order mark understood; a file that is not there has no rows.

    Files are split among tasks, unless fields may hold line breaks
    (``multi_line``). ``file`` and ``row_number`` say where a row stands, the
    first one after the header being 0. ``_raw`` is the row as it was read: its
    own line where it has too few or too many fields, which ``_broken`` says.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, "_line"]])
    try:
        rows = spark.read.options(header=True, encoding="UTF-8", multiLine=multi_line, mode="PERMISSIVE", columnNameOfCorruptRecord="_line").schema(schema).csv(path)
    except AnalysisException:
        return spark.createDataFrame([], T.StructType([*schema.fields[:-1], *(T.StructField(n, t) for n, t in (("file", T.StringType()), ("row_number", T.LongType()), ("_raw", T.StringType()), ("_broken", T.BooleanType())))]))
    rows = numbered_rows(rows)
    broken = F.col("_line").isNotNull()
    return rows.withColumns({"_raw": F.when(broken, F.col("_line")).otherwise(F.to_json(F.struct(*columns))), "_broken": broken}).drop("_line")


def numbered_rows(rows: DataFrame) -> DataFrame:
    """``rows`` of files with ``file`` and ``row_number``, a row's place in its file from 0.

    A file is read in splits by many tasks. Rows of a split follow each other
    within a task, so their own numbers are counted from the split's first row;
    the splits' sizes, one row a split, are summed up to where each begins.
    """
    split = {"file": F.col("_metadata.file_path"), "_begin": F.col("_metadata.file_block_start"), "_at": F.monotonically_increasing_id()}
    rows = rows.select("*", *(c.alias(n) for n, c in split.items()))
    sizes = rows.groupBy("file", "_begin").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy("file").orderBy("_begin")) - F.col("_n")
    places = sizes.select("file", "_begin", "_first", before.alias("_before"))
    return rows.join(places, ["file", "_begin"]).withColumn("row_number", F.col("_at") - F.col("_first") + F.col("_before")).drop("_begin", "_at", "_first", "_before")


def read_bank(spark: SparkSession, path: str) -> DataFrame:
    """Bank statement lines; both or neither of debit and credit, and dates that do not exist, are problems."""
    rows = read_csv(spark, path, ["row_id", "value_date", "narration", "reference", "debit", "credit", "balance"])
    filled = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    credit = filled("credit")
    amount = money.parse_paise(F.when(credit, F.col("credit")).otherwise(F.col("debit")))
    day = cal.statement_date("value_date")
    problem = F.when(F.col("_broken"), "fields").when(filled("credit") == filled("debit"), "one of debit and credit is needed").when(amount.isNull(), "amount").when(day.isNull(), "value_date").when(~filled("row_id"), "row_id")
    parsed = text.parse_narration("narration")
    return _complete(
        rows, "bank", external_id=F.col("row_id"), kind=F.lit("bank_line"), amount_paise=F.abs(amount), currency=F.lit("INR"), direction=F.when(credit, "credit").otherwise("debit"),
        occurred_on=day, method=F.lit("bank_transfer"), raw_narration=F.col("narration"), raw_reference=F.col("reference"),
        reference=F.coalesce(F.nullif(text.normal_reference("reference"), F.lit("")), F.nullif(text.normal_reference(parsed["utr"]), F.lit(""))),
        raw_counterparty=parsed["counterparty"], counterparty=text.normal_name(parsed["counterparty"]),
        metadata=F.create_map(F.lit("utr"), parsed["utr"], F.lit("rail"), parsed["rail"]), problem=problem, raw=F.col("_raw"),
    )


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Invoices; the order is their reference and their parent."""
    rows = read_csv(spark, path, ["invoice_no", "invoice_date", "counterparty", "amount", "order_id", "status"])
    amount, day = money.parse_paise("amount"), cal.statement_date("invoice_date")
    problem = F.when(F.col("_broken"), "fields").when(amount.isNull(), "amount").when(day.isNull(), "invoice_date").when(F.coalesce(F.col("invoice_no"), F.lit("")) == "", "invoice_no")
    return _complete(
        rows, "ledger", external_id=F.col("invoice_no"), kind=F.lit("invoice"), amount_paise=amount, currency=F.lit("INR"), direction=F.lit("credit"), occurred_on=day, method=F.lit("unknown"),
        raw_counterparty=F.col("counterparty"), counterparty=text.normal_name("counterparty"), raw_reference=F.col("order_id"), reference=F.col("order_id"), parent_id=F.col("order_id"), problem=problem, raw=F.col("_raw"),
    )


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """The items of an {entity, count, items} file; a file that is not there has none, one whose items are no list is refused when read."""
    try:
        rows = spark.read.option("multiLine", True).schema(ENVELOPE).json(path)
    except AnalysisException:
        return spark.createDataFrame([], ITEM)
    sound = F.assert_true(F.col("items").isNotNull(), F.lit("items is not a list"))
    return rows.where(F.coalesce(sound.cast("boolean"), F.lit(True))).select(F.explode("items").alias("i")).select("i.*")


def gateway_rows(items: DataFrame, kind: str) -> DataFrame:
    """Items of a gateway as rows of a kind: payment, refund (debits), settlement, order or payout (debits)."""
    at = F.timestamp_seconds("created_at")
    day, none = F.to_date(F.from_utc_timestamp(at, ZONE)), F.lit(None).cast("string")
    common = {
        "external_id": F.col("id"), "amount_paise": F.col("amount"), "occurred_at": at, "occurred_on": day, "currency": F.coalesce("currency", F.lit("INR")), "kind": F.lit(kind),
        "direction": F.lit("debit" if kind in ("refund", "payout") else "credit"), "raw": F.to_json(F.struct("id", "amount", "created_at")),
        "problem": F.when(F.coalesce(F.col("id"), F.lit("")) == "", "id").when(F.col("amount").isNull(), "amount").when(F.col("created_at").isNull(), "created_at"),
    }
    own = {"method": F.lit("unknown"), "reference": none, "parent_id": none}
    if kind == "payment":
        party = F.element_at("notes", "counterparty")
        own = {"method": money.known_method("method"), "reference": F.col("order_id"), "raw_reference": F.col("order_id"), "parent_id": F.col("order_id"), "raw_counterparty": party, "counterparty": text.normal_name(party)}
    elif kind == "refund":
        own |= {"reference": F.col("payment_id"), "parent_id": F.col("payment_id")}
    elif kind in ("settlement", "payout"):
        fields = F.create_map(F.lit("utr"), F.col("utr"), F.lit("fees"), F.col("fees").cast("string"), F.lit("tax"), F.col("tax").cast("string"))
        own = {"method": F.lit("bank_transfer"), "reference": text.normal_reference("utr"), "raw_reference": F.col("utr"), "settled_on": day, "metadata": fields}
    return _complete(items, "gateway", **common, **own)


def read_gateway(spark: SparkSession, directory: str) -> DataFrame:
    """Payments, refunds (debits) and settlements of a gateway, as one table."""
    payments, refunds, settlements = (gateway_rows(read_collection(spark, f"{directory}/gateway_{k}s.json"), k) for k in ("payment", "refund", "settlement"))
    return payments.unionByName(refunds).unionByName(settlements)


def read_holidays(spark: SparkSession, path: str) -> DataFrame:
    """(ds) from a JSON list of dates or of {date} objects; a file that is not there has none."""
    try:
        rows = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], "ds date")
    dates = F.regexp_extract_all("value", F.lit(r"[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.lit(0))
    return rows.select(F.explode(dates).alias("d")).select(F.try_to_date("d").alias("ds")).where("ds IS NOT NULL").distinct()


def ids_of(rows: DataFrame, external: DataFrame, source: str) -> DataFrame:
    """``external`` (external_id) with the txn_id of a source's rows."""
    return external.join(rows.where(F.col("source") == source).select("external_id", "txn_id"), "external_id", "left")


def narration_statistics(rows: DataFrame) -> DataFrame:
    """One row: lines, complete parses, lines without a reference, and settlements, of bank lines."""
    parsed = rows.where("kind = 'bank_line'").select(text.parse_narration("raw_narration").alias("p"))
    return parsed.agg(F.count(F.lit(1)).alias("lines"), F.count_if("p.complete").alias("complete"), F.count_if(F.col("p.utr") == "").alias("without_reference"), F.count_if("p.is_settlement").alias("settlements"))


def date_range(rows: DataFrame) -> DataFrame:
    return rows.agg(F.min("occurred_on").alias("first_day"), F.max("occurred_on").alias("last_day"))


def within(rows: DataFrame, first: str, last: str) -> DataFrame:
    """Rows of a range of dates; a filter that reaches the files."""
    return rows.where(F.col("occurred_on").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def parse_rates(rows: DataFrame) -> DataFrame:
    """(source, total, corrupt, parse_rate) of rows before the split."""
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.count("problem").alias("corrupt"))
    return counts.withColumn("parse_rate", F.round(1 - F.col("corrupt") / F.col("total"), 6))
