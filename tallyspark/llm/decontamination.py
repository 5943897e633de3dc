"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import table

#: Token positions that each seed hashes; the others are ignored. One of the two
#: meets every window of WINDOW tokens with two substitutions.
MASKS = ((0, 1, 4, 5, 6), (0, 1, 5, 7, 8))
WINDOW = 13
#: Part of a window's tokens that agree.
SIMILARITY = 0.8


def runs(n: int) -> list[tuple[int, int]]:
    """Begins and lengths of the seeds of an item of n words, fewer than WINDOW: one run more than words may be substituted, so that one is whole."""
    parts = n - math.ceil(SIMILARITY * n) + 1
    ends = [n * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


#: Benchmark seeds that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


#: White space and punctuation between words. Listed one by one, they become a lookup table in Java's class of characters.
BETWEEN = " \t\n\x0b\f\r!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SPLITTER = "[" + "".join(f"\\x{ord(c):02X}" for c in BETWEEN) + "]+"


def words(text: Column | str = "text") -> Column:
    """A whole text's words, letters folded; punctuation separates words. A text without words gives one empty word."""
    return F.split(F.trim(F.lower(F.coalesce(text, F.lit(""))), F.lit(BETWEEN)), SPLITTER)


def _exploded(rows: DataFrame, keep: str, masks: list[tuple[int, ...]]) -> DataFrame:
    """A row (keep, place, seed) for each seed of the texts in ``rows``.

    The words are exploded before they are hashed: generator, hashes and the
    join that follows are then one compiled stage, in which the array of words
    is never copied.
    """
    places = rows.select(keep, words().alias("_words")).select(keep, "_words", F.posexplode("_words").alias("place", "_word"))
    n = F.size("_words")
    seeds = [F.when(F.col("place") + mask[-1] < n, F.xxhash64(*(F.get("_words", F.col("place") + k) for k in mask))) for mask in masks]
    return places.select(keep, "place", F.explode(F.array(*seeds)).alias("seed")).where("seed is not null")


def _short(benchmark: DataFrame) -> tuple[DataFrame, list[int]]:
    """Seeds (item_id, place, seed) of the items of fewer than WINDOW words, and the lengths of their runs."""
    items = benchmark.select("item_id", words().alias("_words")).where((F.size("_words") < WINDOW) & (F.get("_words", F.lit(0)) != ""))
    sizes = [r["n"] for r in items.select(F.size("_words").alias("n")).distinct().collect()]
    at = [(n, begin, size) for n in sizes for begin, size in runs(n)]
    seeds = [F.when(F.size("_words") == n, F.struct(F.lit(begin).alias("place"), F.xxhash64(*(F.get("_words", F.lit(begin + k)) for k in range(size))).alias("seed"))) for n, begin, size in at]
    none = F.lit(None).cast("struct<place:int,seed:bigint>")
    found = items.select("item_id", F.explode(F.array(none, *seeds)).alias("_at")).where("_at is not null").select("item_id", "_at.place", "_at.seed")
    return found, sorted({size for _, _, size in at})


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, shift): where a seed of a document meets one of a benchmark item, and the item's offset in the document."""
    short, lengths = _short(benchmark)
    long = _exploded(benchmark.where(F.size(words()) >= WINDOW), "item_id", list(MASKS))
    theirs = long.unionByName(short).select("item_id", F.col("place").alias("item_place"), "seed").distinct()
    if theirs.count() <= BROADCAST_ROWS:
        theirs = F.broadcast(theirs)
    met = _exploded(docs, "doc_id", [*MASKS, *(tuple(range(n)) for n in lengths)]).join(theirs, "seed")
    return met.select("doc_id", "item_id", (F.col("place") - F.col("item_place")).alias("shift")).distinct()


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_equal, best): documents that hold a passage of a benchmark item.

    A passage is a window of WINDOW tokens, or the whole item if it is shorter,
    of which SIMILARITY or more agree with the document's at the same place, so
    single words may be substituted; best is the largest number that agree in a
    window, n_equal the largest number along the whole item. Words are compared
    with letters folded and without punctuation. An item of fewer words than a
    window is found by runs of its words, one more than may be substituted, and
    one of fewer than five words only word for word. Null texts and those
    without words, on either side, hold no passage. Documents that
    share a doc_id count as one; those without an id are compared too and come
    out as null. Further columns are ignored; an empty table gives no rows.
    """
    found = hits(docs, benchmark)
    items = benchmark.select(F.col("item_id").alias("_iid"), words().alias("_item"))
    asked = found.join(items, found["item_id"].eqNullSafe(items["_iid"])).select(F.col("doc_id").alias("_did"), "item_id", "shift", "_item")
    rows = docs.select("doc_id", "text").join(asked.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(F.col("_did")))
    # Array functions bind what their inner functions use more than once, so that a text is split once a row.
    first = F.greatest(F.lit(0), -F.col("shift"))
    theirs = F.slice("_item", first + 1, F.size("_item"))
    ours = F.slice(words(), F.col("shift") + first + 1, F.size("_item") - first)
    equal = F.concat(F.array_repeat(F.lit(0), first), F.zip_with(theirs, ours, lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0))))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def judged(equal: Column) -> Column:
        width = F.least(F.lit(WINDOW), F.size(equal))
        windows = F.transform(F.sequence(F.lit(1), F.size(equal) - width + 1), lambda k: total(F.slice(equal, k, width)))
        return F.struct(total(equal).alias("n_equal"), F.array_max(windows).alias("best"), width.alias("_width"))

    rows = rows.select("doc_id", "item_id", F.explode(F.transform(F.array(equal), judged)).alias("_at")).select("doc_id", "item_id", "_at.*")
    rows = rows.where(F.col("best") >= SIMILARITY * F.col("_width"))
    return rows.groupBy("doc_id", "item_id").agg(F.max("n_equal").alias("n_equal"), F.max("best").alias("best"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no passage of the benchmark."""
    found = overlaps(docs, benchmark).select(F.col("doc_id").alias("_did")).distinct()
    return docs.join(found.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(found["_did"]), "left_anti")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _oracle() -> str:
    quoted = BETWEEN.replace("'", "''")
    words = f"regexp_split_to_array(trim(lower(coalesce(text, '')), '{quoted}'), '{SPLITTER}')"
    seeds = lambda m: "[" + ", ".join(f"w[i + {k}]" for k in m) + "]"
    of = lambda t: " UNION ALL ".join(f"SELECT id, i, {n} AS m, {seeds(m)} AS s FROM (SELECT id, w, unnest(range(1, len(w) - {m[-1]} + 1)) AS i FROM {t})" for n, m in enumerate(MASKS))
    at = [(n, begin, size) for n in range(1, WINDOW) for begin, size in runs(n)]
    lengths = sorted({size for _, _, size in at})
    of_runs = " UNION ALL ".join(f"SELECT id, i, {n + 10} AS m, w[i:i + {n - 1}] AS s FROM (SELECT id, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM d WHERE (SELECT count(*) FROM b WHERE len(w) < {WINDOW}) > 0)" for n in lengths)
    short = " UNION ALL ".join(f"SELECT id, {begin + 1} AS i, {size + 10} AS m, w[{begin + 1}:{begin + size}] AS s FROM b WHERE len(w) = {n} AND w[1] <> ''" for n, begin, size in at)
    return rf"""
WITH d AS (SELECT doc_id AS id, {words} AS w FROM documents),
b AS (SELECT item_id AS id, {words} AS w FROM benchmark),
h AS (SELECT DISTINCT x.id AS doc_id, y.id AS item_id, x.i - y.i AS shift FROM ({of('d')} UNION ALL {of_runs}) x JOIN ({of("(SELECT * FROM b WHERE len(w) >= " + str(WINDOW) + ")")} UNION ALL {short}) y ON x.m = y.m AND x.s = y.s),
e AS (SELECT doc_id, item_id, [CASE WHEN i + shift >= 1 AND d.w[i + shift] = b.w[i] THEN 1 ELSE 0 END FOR i IN range(1, len(b.w) + 1)] AS q
      FROM h JOIN d ON d.id = h.doc_id JOIN b ON b.id = h.item_id),
g AS (SELECT doc_id, item_id, list_sum(q)::INT AS n_equal, least({WINDOW}, len(q))::INT AS width,
      list_max([list_sum(q[k:k + least({WINDOW}, len(q)) - 1]) FOR k IN range(1, len(q) - least({WINDOW}, len(q)) + 2)])::INT AS best FROM e)
SELECT doc_id, item_id, max(n_equal) AS n_equal, max(best) AS best FROM g WHERE best >= {SIMILARITY} * width GROUP BY doc_id, item_id"""


QUERIES = {"op9_decontamination": op9_decontamination}
ORACLES = {"op9_decontamination": _oracle()}
