"""Secret scans behind a trigram inverted index, in DataFrame functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import packed, table

try:
    from re import _constants as codes
    from re import _parser as parser
except ImportError:  # before Python 3.11
    import sre_constants as codes
    import sre_parse as parser


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern in the common part of Java's and RE2's syntax, and the least length of one of its groups."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def either_case(words: str) -> str:
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


ASSIGN = "(" + either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The base kinds come first. The lengths of access and hex stand in the
#: pattern: a match that is too short holds no longer one, so this finds the same.
BASE = (Rule("assign", ASSIGN, 2, 6), Rule("access", "AKIA[A-Z0-9]{16,}"), Rule("hex", "[0-9a-f]{24,}"))
MORE = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", "gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE + MORE

#: Strings that a pattern part may be expanded to, and clauses that a query may have, before it is loosened.
MOST = 64


def trigram_query(pattern: str) -> frozenset[frozenset[str]]:
    """Clauses of folded trigrams of which every match of the pattern holds at least one whole clause.

    The clauses are an OR of ANDs; an empty clause says that the pattern has no
    mandatory trigram and its rule needs a full scan.
    """
    clauses, strings = _sequence(parser.parse(pattern))
    return _both(clauses, _clauses(strings)) if strings is not None else clauses


def _fold(code: int) -> str:
    return chr(code).lower() if code < 128 else chr(code)


def _clauses(strings: frozenset[str]) -> frozenset[frozenset[str]]:
    return _least(frozenset(frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in strings))


def _least(clauses: frozenset[frozenset[str]]) -> frozenset[frozenset[str]]:
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


def _both(one: frozenset, other: frozenset) -> frozenset[frozenset[str]]:
    merged = _least(frozenset(a | b for a, b in product(one, other)))
    return merged if len(merged) <= MOST else min(one, other, key=len)


def _sequence(parts) -> tuple[frozenset, frozenset[str] | None]:
    """Clauses that hold so far, and the strings the part may be, or None if they are too many."""
    anything = frozenset([frozenset()])
    clauses, run, exact = anything, frozenset([""]), True
    for part in parts:
        own, strings = _part(*part)
        clauses = _both(clauses, own)
        joined = None if strings is None else frozenset(a + b for a, b in product(run, strings))
        if joined is None or len(joined) > MOST:
            clauses, exact = _both(clauses, _clauses(run)), False
            run = strings if strings is not None else frozenset([""])
        else:
            run = joined
    if exact:
        return clauses, run
    return _both(clauses, _clauses(run)), None


def _part(op, value) -> tuple[frozenset, frozenset[str] | None]:
    anything = frozenset([frozenset()])
    if op is codes.LITERAL:
        return anything, frozenset([_fold(value)])
    if op is codes.IN:
        found = set()
        for kind, x in value:
            if kind is codes.LITERAL:
                found.add(_fold(x))
            elif kind is codes.RANGE and x[1] - x[0] < 8:
                found |= {_fold(c) for c in range(x[0], x[1] + 1)}
            else:
                return anything, None
        return anything, frozenset(found) if len(found) <= 8 else None
    if op is codes.SUBPATTERN:
        return _sequence(value[-1])
    if op is codes.BRANCH:
        found = [_sequence(x) for x in value[1]]
        strings = None if any(s is None for _, s in found) else frozenset().union(*(s for _, s in found))
        clauses = frozenset().union(*(_both(c, _clauses(s)) if s is not None else c for c, s in found))
        return (anything, strings) if strings is not None else (_least(clauses), None)
    if op is codes.MAX_REPEAT:
        low, high, inner = value
        own, strings = _sequence(inner)
        if high == 1:
            return (own if low else anything), None if strings is None else strings | (frozenset() if low else {""})
        if low and strings is not None:
            return _both(own, _clauses(strings)), None
        return (own if low else anything), None
    return anything, None


def postings(docs: DataFrame, vocabulary: list[str] | None = None) -> DataFrame:
    """The inverted index: (doc_id, trigram), once for each trigram of a text, letters folded.

    With a ``vocabulary`` the index holds its trigrams only, which is all that a
    fixed set of rules can ask for; without, those of the whole texts.
    """
    if vocabulary is not None:
        some = F.array(*(F.lit(t) for t in vocabulary)) if vocabulary else F.array().cast("array<string>")
        held = F.transform(F.array(F.lower("text")), lambda x: F.filter(some, lambda t: F.contains(x, t)))
        return docs.where("text is not null").select("doc_id", F.explode(held[0]).alias("trigram"))
    every = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("(?s)(?=(...))"), F.lit(1)))
    return docs.where("text is not null").select("doc_id", F.explode(every).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, rules): the rules whose trigram query a document meets, from the intersection of its postings.

    A document meets a clause when it is in the postings of all its trigrams,
    and a rule when it meets any clause. The terms joined are the rules' own.
    """
    terms = []
    for rule in rules:
        for number, clause in enumerate(sorted(trigram_query(rule.pattern), key=sorted)):
            terms += [(rule.kind, number, k // 60, len(clause), 1 << k % 60, t) for k, t in enumerate(sorted(clause))]
    asked = index.sparkSession.createDataFrame(terms, "rule string, clause int, word int, need int, bit long, trigram string")
    met = index.join(F.broadcast(asked), "trigram").groupBy("doc_id", "rule", "clause")
    # A bit for each trigram of the clause, 60 to a word.
    words = range(1 + max(t[2] for t in terms))
    met = met.agg(*(F.bit_or(F.when(F.col("word") == w, F.col("bit"))).alias(f"_bits{w}") for w in words), F.max("need").alias("_need"))
    held = reduce(lambda a, b: a + b, (F.coalesce(F.bit_count(f"_bits{w}"), F.lit(0)) for w in words))
    met = met.where(held == F.col("_need"))
    return met.groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of the rule's matches; a match begins after all pieces between matches, and all matches, before it."""
    pattern = F.lit(rule.pattern)
    whole, pieces = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, rule.pattern, -1)
    held = whole if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    rows = F.zip_with(F.zip_with(F.slice(pieces, 1, F.size(whole)), whole, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("n"))), held, lambda x, g: F.struct(x["gap"].alias("gap"), x["n"].alias("n"), F.length(g).alias("own")))
    ends = _running_sums(F.transform(rows, lambda x: x["gap"] + x["n"]))
    spans = F.zip_with(rows, ends, lambda x, end: F.struct((end - x["n"]).alias("start"), F.lit(rank).alias("rank"), end.alias("stop"), x["own"].alias("own")))
    return F.filter(spans, lambda s: s["own"] >= rule.least)


def _running_sums(numbers: Column) -> Column:
    """The running sums of an array: its shifts by 1, 2, 4, ... are added to it, so that many matches of one text take few steps each."""
    size = F.size(numbers)

    def add(sums: Column, k: Column) -> Column:
        by = F.least(F.pow(F.lit(2), k).cast("int"), size)
        return F.zip_with(sums, F.concat(F.array_repeat(F.lit(0), by), F.slice(sums, 1, size - by)), lambda x, y: x + y)

    return F.when(size > 1, F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(size)).cast("int") - 1), numbers, add)).otherwise(numbers)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``spans``, an array of structs (start, rank, stop, own) by start and then rule.

    start and stop count code points, stop exclusive; rank is the rule's place
    in ``rules``. Rules with mandatory trigrams are verified on the documents
    that the index gives, the others on all. A null text counts as empty. Rows
    that share a doc_id, or have none, share candidates and are verified each by
    itself. A column called spans is replaced, others stay whatever their names;
    an empty table gives no rows.
    """
    asked = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = tuple(r for r in rules if frozenset() not in asked[r.kind])
    # The text moves once, inside its row.
    rows = docs.select(packed(docs, "spans"), F.col("doc_id").alias("key"))
    text = F.coalesce("row.text", F.lit(""))
    none = F.array().cast("array<struct<start:int,rank:int,stop:int,own:int>>")
    if indexed:
        vocabulary = sorted({t for r in indexed for clause in asked[r.kind] for t in clause})
        found = candidates(postings(docs, vocabulary), indexed).select(F.col("doc_id").alias("_id"), F.col("rules").alias("_rules"))
        rows = rows.join(found.hint("shuffle_hash"), rows["key"].eqNullSafe(found["_id"]), "left")
    spans = []
    for rank, rule in enumerate(rules):
        own = _spans(text, rule, rank)
        spans.append(F.when(F.array_contains("_rules", rule.kind), own).otherwise(none) if rule in indexed else own)
    # In two steps, as a column of the row may be called row.
    return rows.select("row", F.array_sort(F.concat(*spans)).alias("_spans")).select("row.*", F.col("_spans").alias("spans"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.array(*(F.lit(r.kind) for r in RULES))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["rank"]], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    of = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    counts = [of(rank).alias(f"n_{rule.kind}") for rank, rule in enumerate(BASE)]
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def _oracle() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    parts, lists = [], []
    for k, r in enumerate(RULES):
        parts.append(f"regexp_extract_all(t, {quoted(r.pattern)}, 0) AS m{k}, regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) AS g{k}, string_split_regex(t, {quoted(r.pattern)}) AS p{k}")
        begin = f"(list_sum([length(x) FOR x IN p{k}[1:i]]) + coalesce(list_sum([length(x) FOR x IN m{k}[1:i - 1]]), 0))::INT"
        lists.append(f"[{{'s': {begin}, 'k': {k}, 'e': {begin} + length(m{k}[i])::INT}} FOR i IN range(1, len(m{k}) + 1) IF length(g{k}[i]) >= {r.least}] AS l{k}")
    every, base = (" || ".join(f"l{k}" for k in range(n)) for n in (len(RULES), len(BASE)))
    kinds = "[" + ", ".join(f"'{r.kind}'" for r in RULES) + "]"
    written = lambda spans: f"coalesce(array_to_string([{kinds}[x.k + 1] || ':' || x.s || ':' || x.e FOR x IN list_sort({spans})], ','), '')"
    counts = ", ".join(f"len(l{k})::BIGINT AS n_{r.kind}" for k, r in enumerate(BASE))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, {', '.join(parts)} FROM d),
s AS (SELECT doc_id, {', '.join(lists)} FROM f)
SELECT doc_id, {counts}, sha256({written(base)}) AS base_sha256, {written(every)} AS spans FROM s"""


QUERIES = {"op2_secrets": op2_secrets}
ORACLES = {"op2_secrets": _oracle()}
