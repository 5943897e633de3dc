"""Ten fixed questions over three views: gated, parameterised and checked."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession

#: The views and their columns.
VIEWS = {
    "v_settlements": ["settlement_id", "settled_on", "gross_paise", "net_expected_paise", "net_received_paise", "residual_paise", "balanced", "member_count", "mdr_paise", "gst_paise", "tds_paise", "refunds_paise", "chargeback_paise", "reserve_paise"],
    "v_exceptions": ["exception_id", "exception_type", "severity", "amount_paise", "as_of", "reason", "evidence_count", "stage"],
    "v_daily_cash": ["value_date", "credited_paise", "credit_count", "is_business_day"],
}

#: What each question returns, and in which order. Parameters are bound by name, never written into the text.
TEMPLATES = {
    "settlement_detail": "SELECT settlement_id, settled_on, gross_paise, mdr_paise, gst_paise, tds_paise, refunds_paise, chargeback_paise, reserve_paise, net_expected_paise, net_received_paise, residual_paise, balanced FROM v_settlements WHERE settlement_id = :settlement_id",
    "settlement_on_date": "SELECT settlement_id, settled_on, gross_paise, net_received_paise, residual_paise, balanced, member_count FROM v_settlements WHERE settled_on = CAST(:as_of AS DATE) ORDER BY settlement_id",
    "unbalanced_settlements": "SELECT settlement_id, settled_on, residual_paise, gross_paise, member_count FROM v_settlements WHERE balanced = FALSE ORDER BY ABS(residual_paise) DESC, settlement_id LIMIT :limit",
    "all_settlements": "SELECT settlement_id, settled_on, gross_paise, net_received_paise, residual_paise, balanced, member_count FROM v_settlements ORDER BY settled_on, settlement_id LIMIT :limit",
    "exceptions_by_type": "SELECT exception_type, COUNT(*) AS exception_count, CAST(SUM(amount_paise) AS BIGINT) AS total_paise FROM v_exceptions GROUP BY exception_type ORDER BY exception_count DESC, exception_type",
    "exceptions_by_severity": "SELECT severity, COUNT(*) AS exception_count, CAST(SUM(amount_paise) AS BIGINT) AS total_paise FROM v_exceptions GROUP BY severity ORDER BY exception_count DESC, severity",
    "largest_exceptions": "SELECT exception_id, exception_type, severity, amount_paise, reason FROM v_exceptions ORDER BY ABS(amount_paise) DESC, exception_id LIMIT :limit",
    "total_fees": "SELECT CAST(SUM(mdr_paise) AS BIGINT) AS mdr_paise, CAST(SUM(gst_paise) AS BIGINT) AS gst_paise, CAST(SUM(tds_paise) AS BIGINT) AS tds_paise, CAST(SUM(refunds_paise) AS BIGINT) AS refunds_paise, CAST(SUM(chargeback_paise) AS BIGINT) AS chargeback_paise, CAST(SUM(reserve_paise) AS BIGINT) AS reserve_paise, CAST(SUM(gross_paise) AS BIGINT) AS gross_paise, CAST(SUM(net_received_paise) AS BIGINT) AS net_received_paise FROM v_settlements",
    "cash_by_day": "SELECT value_date, credited_paise, credit_count, is_business_day FROM v_daily_cash ORDER BY value_date LIMIT :limit",
    "cash_total": "SELECT CAST(SUM(credited_paise) AS BIGINT) AS credited_paise, CAST(SUM(credit_count) AS BIGINT) AS credit_count, MIN(value_date) AS first_day, MAX(value_date) AS last_day FROM v_daily_cash",
}
PARAMETERS = {"settlement_detail": ("settlement_id",), "settlement_on_date": ("as_of",), "unbalanced_settlements": ("limit",), "all_settlements": ("limit",), "largest_exceptions": ("limit",), "cash_by_day": ("limit",)}
DEFAULT_LIMIT, MOST_LIMIT = 10, 200

#: What a question is about, in the order in which it is asked.
INTENTS = (
    ("settlement_detail", r"\b(?P<settlement_id>(?:setl|cr)_[A-Za-z0-9_]+)\b"),
    ("settlement_on_date", r"settle.*\b(?P<as_of>\d{4}-\d{2}-\d{2})\b"),
    ("unbalanced_settlements", r"(unbalanced|do(es)? ?n.t balance|not balance|did not close)"),
    ("total_fees", r"\b(fees?|mdr|gst|tds|charged)\b"),
    ("exceptions_by_severity", r"exceptions?.*(severity|urgent)|urgent"),
    ("largest_exceptions", r"(largest|biggest|top).*exceptions?"),
    ("exceptions_by_type", r"exceptions?"),
    ("cash_by_day", r"cash.*(by|per|each) day|daily cash"),
    ("cash_total", r"\b(cash|credited|received)\b"),
    ("all_settlements", r"settlements?"),
    ("total_fees", r"\b(disputed?|held back|withheld|reserves?|chargebacks?|refund(s|ed)?)\b"),
)
TOPIC = re.compile(r"settle|exception|cash|fee|mdr|gst|tds|credit|refund|chargeback|reserve|withheld|balance|receiv|urgent|setl_|cr_\d", re.I)
SPECULATION = re.compile(r"\b(will|predict|forecast|should (we|i)|next (week|month|year)|what if|guess)\b", re.I)


@dataclass(frozen=True)
class Compiled:
    intent: str
    parameters: dict
    refusal: str = ""


def valid(name: str, value: object) -> object | None:
    """The parameter, checked: an id, an ISO date or a limit of 1 to 200."""
    if name == "limit":
        return int(value) if str(value).isdigit() and 1 <= int(value) <= MOST_LIMIT else None
    if name == "as_of":
        try:
            return date.fromisoformat(str(value)).isoformat()
        except ValueError:
            return None
    return value if re.fullmatch(r"[a-z]+_[A-Za-z0-9_]{1,64}", str(value)) else None


def compile_question(question: str) -> Compiled:
    """The statement that answers a question, or why none does."""
    if not question.strip():
        return Compiled("unsupported", {}, "empty question")
    if not TOPIC.search(question):
        return Compiled("unsupported", {}, "not about these books")
    if SPECULATION.search(question):
        return Compiled("unsupported", {}, "asks for a guess")
    for intent, pattern in INTENTS:
        found = re.search(pattern, question, re.I)
        if not found:
            continue
        given = {**{"limit": (re.search(r"\btop (\d+)|\b(\d+) (?:largest|biggest)", question) or [None, DEFAULT_LIMIT])[1] or DEFAULT_LIMIT}, **found.groupdict()}
        bound = {p: valid(p, given[p]) for p in PARAMETERS.get(intent, ())}
        if None not in bound.values():
            return Compiled(intent, bound)
    return Compiled("unsupported", {}, "no statement answers this")


def ask(spark: SparkSession, intent: str, **parameters: object) -> DataFrame:
    return spark.sql(TEMPLATES[intent], args=parameters)


def numerals(text: str) -> list[str]:
    return re.findall(r"\d[\d,]*(?:\.\d+)?", text)


def grounded(sentence: str, rows: list[dict], question: str = "") -> bool:
    """Whether each number of a sentence is in the result, as it is or in rupees, or in the question."""
    known = {n.replace(",", "") for n in numerals(question)} | {str(len(rows))}
    for row in rows:
        for value in row.values():
            known |= {n.replace(",", "") for n in numerals(str(value))}
            if isinstance(value, int) and not isinstance(value, bool):
                known |= {f"{abs(value) / 100:.2f}", str(abs(value) // 100)}
    return all(n.replace(",", "") in known for n in numerals(sentence))


def answer(spark: SparkSession, question: str, narrate=None) -> dict:
    """State, rows and sentence: unsupported, empty, ungrounded or answered.

    ``narrate`` may turn question and rows into a sentence; one with a number
    that the rows do not hold is thrown away. Results are as small as the statements' limits.
    """
    compiled = compile_question(question)
    if compiled.intent == "unsupported":
        return {"state": "unsupported", "reason": compiled.refusal, "rows": [], "sentence": ""}
    rows = [r.asDict() for r in ask(spark, compiled.intent, **compiled.parameters).limit(MOST_LIMIT).collect()]
    if not rows:
        return {"state": "empty", "reason": "the books hold no such row", "rows": [], "sentence": ""}
    plain = f"{len(rows)} row(s) for {compiled.intent.replace('_', ' ')}"
    sentence = narrate(question, rows) if narrate else plain
    if not grounded(sentence, rows, question):
        return {"state": "ungrounded", "reason": "a number is not in the result", "rows": rows, "sentence": ""}
    return {"state": "answered", "reason": compiled.intent, "rows": rows, "sentence": sentence}
