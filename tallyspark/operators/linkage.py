"""Probabilistic linkage: agreement levels, fitting by pattern counts, and scores in bits."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyspark.functions.text import bucket_similarity, gram_bucket_of, gram_buckets, name_key, name_tokens, normal_name, normal_name_of, word_key_of
from tallyspark.operators import blocking

FIELDS = ("reference", "amount", "date", "counterparty", "narration")
DIFFER, WEAK, STRONG, EXACT, MISSING = range(5)
#: The seeds of both distributions over the four levels, the first share of matches, smoothing and clamps.
SEED_M, SEED_U, SEED_SHARE = (0.05, 0.10, 0.25, 0.60), (0.70, 0.20, 0.07, 0.03), 0.10
SMOOTHING, MOST_ROUNDS, TOLERANCE, MOST_BITS, MOST_ODDS = 0.001, 100, 1e-7, 12.0, 60.0


def _missing(*columns: Column) -> Column:
    test = F.lit(False)
    for c in columns:
        test = test | c.isNull() | (c.cast("string") == "")
    return test


def reference_level(a: str, b: str) -> Column:
    """Equal, contained in one another, sharing nine characters in a row, or different."""
    x, y = F.col(a), F.col(b)
    runs = F.when(F.length(x) >= 9, F.sequence(F.lit(1), F.length(x) - 8)).otherwise(F.array().cast("array<int>"))
    shared = F.exists(runs, lambda i: F.contains(y, F.substring(x, i, F.lit(9))))
    return F.when(_missing(x, y), MISSING).when(x == y, EXACT).when(F.contains(x, y) | F.contains(y, x), STRONG).when(shared, WEAK).otherwise(DIFFER)


def amount_level(a: str, b: str) -> Column:
    """Equal, within 3 % or within 25 % of the larger; zero is missing. Integers only."""
    x, y = F.abs(F.col(a)), F.abs(F.col(b))
    low, high = F.least(x, y), F.greatest(x, y)
    return F.when(x.isNull() | y.isNull() | (x == 0) | (y == 0), MISSING).when(x == y, EXACT).when(100 * low >= 97 * high, STRONG).when(4 * low >= 3 * high, WEAK).otherwise(DIFFER)


def date_level(a: str, b: str) -> Column:
    """Rows of the same side of a settlement: the same day, the next, the same week."""
    gap = F.abs(F.datediff(a, b))
    return F.when(gap.isNull(), MISSING).when(gap == 0, EXACT).when(gap <= 1, STRONG).when(gap <= 7, WEAK).otherwise(DIFFER)


def settlement_level(landed: str, expected: str, low: str, high: str) -> Column:
    """A payment against a credit: on the expected date, in its window, within a week of it."""
    day, due = F.col(landed), F.col(expected)
    gap = F.abs(F.datediff(day, due))
    return F.when(gap.isNull(), MISSING).when(gap == 0, EXACT).when(day.between(F.col(low), F.col(high)), STRONG).when(gap <= 7, WEAK).otherwise(DIFFER)


#: What a row needs besides its date for ``related_date_level``: whether it is dated at the bank, and where its payment is due.
DUE = ("at_bank", "settles_on", "win_low", "win_high")


def related_date_level(a: int, b: int) -> Column:
    """Dates by what two rows are to each other, over d1 and d2 and the columns of DUE with 1 and 2 behind their names.

    Rows on the same side of a settlement should have the same date; a row
    before it is due when its payment settles. Rows without a due date are
    missing one.
    """
    crosses = lambda payer, bank: settlement_level(f"d{bank}", *(f"{c}{payer}" for c in DUE[1:]))
    same = F.col(f"at_bank{a}") == F.col(f"at_bank{b}")
    return F.when(same.isNull(), MISSING).when(same, date_level(f"d{a}", f"d{b}")).when(F.col(f"at_bank{b}"), crosses(a, b)).otherwise(crosses(b, a))


def name_level(a: str, b: str) -> Column:
    """Equal names, equal name keys, or a shared word."""
    x, y = F.trim(a), F.trim(b)
    return F.when(_missing(x, y), MISSING).when(x == y, EXACT).when((name_key(x) != "") & (name_key(x) == name_key(y)), STRONG).when(F.arrays_overlap(name_tokens(x), name_tokens(y)), WEAK).otherwise(DIFFER)


def named(name: str, at: int) -> list[Column]:
    """What comparing names needs of one row, once: the normal name, its key and its words, numbered ``at``."""
    return [normal_name(name).alias(f"c{at}"), name_key(name).alias(f"ck{at}"), name_tokens(name).alias(f"ct{at}")]


def named_level(a: int, b: int) -> Column:
    """name_level of two rows with the columns of ``named``."""
    x, y, keys = F.col(f"c{a}"), F.col(f"c{b}"), (F.col(f"ck{a}"), F.col(f"ck{b}"))
    return F.when(_missing(x, y), MISSING).when(x == y, EXACT).when((keys[0] != "") & (keys[0] == keys[1]), STRONG).when(F.arrays_overlap(f"ct{a}", f"ct{b}"), WEAK).otherwise(DIFFER)


def narration_level(a: str, b: str) -> Column:
    """How alike two narrations are, given the dimensions of their grams."""
    alike = F.round(bucket_similarity(a, b), 6)
    return F.when(alike.isNull(), MISSING).when(alike >= 0.75, STRONG).when(alike >= 0.40, WEAK).otherwise(DIFFER)


def compared(pairs: DataFrame, left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id, and the level of each of FIELDS) for ``pairs`` of ids.

    Both sides have reference, amount_paise, occurred_on and counterparty. Names
    are compared once for each two that meet, however many rows bear them: what
    a name needs for it is worked out once a name, and levels come back by a
    join. Where both sides have the columns of DUE, dates are compared by
    ``related_date_level``.
    """
    related = all(c in df.columns for df in (left, right) for c in DUE)
    due = DUE if related else ()
    side = lambda df, own, k: df.select(own, *(F.col(c).alias(f"{c}{k}") for c in due), F.col("reference").alias(f"r{k}"), F.col("amount_paise").alias(f"a{k}"), F.col("occurred_on").alias(f"d{k}"), F.col("counterparty").alias(f"x{k}"))
    rows = pairs.select(left_id, right_id).join(side(left, left_id, 1), left_id).join(side(right, right_id, 2), right_id)
    names = lambda df, k: df.select(F.col("counterparty").alias(f"y{k}")).distinct().select(f"y{k}", *named(f"y{k}", k), gram_buckets(f"y{k}").alias(f"n{k}"))
    meet = rows.select("x1", "x2").distinct()
    for df, k in ((left, 1), (right, 2)):
        meet = meet.join(names(df, k), F.col(f"x{k}").eqNullSafe(F.col(f"y{k}")))
    meet = meet.select(F.col("x1").alias("y1"), F.col("x2").alias("y2"), named_level(1, 2).alias("counterparty"), narration_level("n1", "n2").alias("narration"))
    rows = rows.join(meet, F.col("x1").eqNullSafe(F.col("y1")) & F.col("x2").eqNullSafe(F.col("y2")))
    return rows.select(left_id, right_id, reference_level("r1", "r2").alias("reference"), amount_level("a1", "a2").alias("amount"), (related_date_level(1, 2) if related else date_level("d1", "d2")).alias("date"), "counterparty", "narration")


#: Cosines that round to at least 0.75 and 0.40 in six places.
STRONG_FROM, WEAK_FROM = 0.7499995, 0.3999995
RUN = 9


def _reference_levels(a: np.ndarray, b: np.ndarray, texts: list[str], grams: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``reference_level`` of numbered references, -1 for missing ones; ``grams`` has the numbers of each one's runs of RUN characters."""
    missing, out = (a < 0) | (b < 0), np.full(len(a), DIFFER)
    shared = np.zeros(len(a), bool)
    theirs = [grams[b, k] for k in range(grams.shape[1])]
    for k in range(grams.shape[1]):
        own = grams[a, k]
        for x in theirs:
            shared |= (own == x) & (own >= 0)
    out[shared] = WEAK
    # One text that holds another shares its first run with it, unless that one is shorter than a run.
    maybe = (a != b) & ~missing & (lengths[a] != lengths[b]) & (shared | (lengths[a] < RUN) | (lengths[b] < RUN))
    for k in np.flatnonzero(maybe):
        x, y = texts[a[k]], texts[b[k]]
        if x in y or y in x:
            out[k] = STRONG
    out[a == b] = EXACT
    out[missing] = MISSING
    return out


def _amount_levels(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``amount_level`` of absolute amounts, 0 for missing ones."""
    low, high = np.minimum(x, y), np.maximum(x, y)
    return np.select([low == 0, x == y, 100 * low >= 97 * high, 4 * low >= 3 * high], [MISSING, EXACT, STRONG, WEAK], DIFFER)


def _date_levels(gap: np.ndarray, known: np.ndarray) -> np.ndarray:
    return np.select([~known, gap == 0, gap <= 1, gap <= 7], [MISSING, EXACT, STRONG, WEAK], DIFFER)


#: Columns of a row that comparing needs.
COMPARED = ("reference", "amount_paise", "occurred_on", "counterparty")
#: Words and grams whose key or dimension a task remembers, and the dimensions of ``gram_bucket``.
REMEMBERED, GRAM_DIMENSIONS = 1 << 18, 256


def _compared_parts(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(rows, places left, places right, the level of each of FIELDS) of the pairs that blocks of rows with COMPARED meet."""
    keys: dict[str, str] = {}
    dimensions: dict[str, int] = {}
    for rows, parts in blocking.met(batches, names):
        references, reference_at = _distinct(rows.column("reference"))
        reference_at = np.array([-1 if t == "" else k for k, t in enumerate(references)] + [-1])[reference_at]
        runs = pa.array([[t[k : k + RUN] for k in range(len(t) - RUN + 1)] for t in references] or [[]], pa.list_(pa.string()))
        grams = blocking.padded(blocking.relisted(runs, blocking.codes(runs.flatten())[0]), -1)
        lengths = np.array([len(t) for t in references] or [0])
        amounts = np.abs(rows.column("amount_paise").fill_null(0).to_numpy().astype(np.int64))
        if int(amounts.max(initial=0)) > np.iinfo(np.int64).max // 100:
            raise OverflowError("amounts beyond a hundredth of a long")
        dates = rows.column("occurred_on").cast(pa.int32())
        day, known = dates.fill_null(0).to_numpy().astype(np.int64), dates.is_valid().to_numpy()
        name, key, tokens, counts, norms, name_at = _name_features(rows.column("counterparty"), keys, dimensions)
        for i, j, _ in parts:
            reference = _reference_levels(reference_at[i], reference_at[j], references, grams, lengths)
            amount = _amount_levels(amounts[i], amounts[j])
            date = _date_levels(np.abs(day[i] - day[j]), known[i] & known[j])
            x, y = name_at[i], name_at[j]
            overlap = np.zeros(len(i), bool)
            theirs = [tokens[y, k] for k in range(tokens.shape[1])]
            for k in range(tokens.shape[1]):
                mine = tokens[x, k]
                for other in theirs:
                    overlap |= (mine == other) & (mine >= 0)
            a, b, ka, kb = name[x], name[y], key[x], key[y]
            counterparty = np.select([(a < 0) | (b < 0), a == b, (ka >= 0) & (ka == kb), overlap], [MISSING, EXACT, STRONG, WEAK], DIFFER)
            one, other = norms[x], norms[y]
            dots = np.empty(len(i))
            for begin in range(0, len(i), 10_000):
                part = slice(begin, begin + 10_000)
                dots[part] = np.einsum("ij,ij->i", counts[x[part]], counts[y[part]])
            alike = dots / np.sqrt(np.maximum(one.astype(float) * other, 1))
            narration = np.select([(one == 0) | (other == 0), alike >= STRONG_FROM, alike >= WEAK_FROM], [MISSING, STRONG, WEAK], DIFFER)
            yield rows, i, j, [reference, amount, date, counterparty, narration]


def _name_features(column: pa.ChunkedArray, keys: dict[str, str], dimensions: dict[str, int]) -> tuple[np.ndarray, ...]:
    """Of the distinct names: numbers of normal names and of name keys (-1 for none), of words, counts of grams by dimension and their squares' sums; and each row's place among the names. Names are taken apart once each."""
    for held in (keys, dimensions):
        if len(held) > REMEMBERED:
            held.clear()
    names, at = _distinct(column)
    normal, key, words = [], [], []
    for n in names:
        x = normal_name_of(n)
        split = x.split(" ") if x else []
        for w in split:
            if w not in keys:
                keys[w] = word_key_of(w)
        normal.append(x or None)
        key.append(" ".join([keys[w] for w in split]) or None)
        words.append([w for w in split if len(w) > 1])
    # The last place is that of a missing name: the rows' -1.
    tokens = pa.array([*words, []], pa.list_(pa.string()))
    numbers = lambda texts: blocking.codes(pa.array([*texts, None], pa.string()))[0]
    counts = _gram_counts(names, dimensions)
    return numbers(normal), numbers(key), blocking.padded(blocking.relisted(tokens, blocking.codes(tokens.flatten())[0]), -1), counts, np.einsum("ij,ij->i", counts, counts).astype(np.int64), at


def _distinct(column: pa.ChunkedArray) -> tuple[list[str], np.ndarray]:
    """The distinct texts, and each row's place among them, -1 for null."""
    whole = column.combine_chunks().dictionary_encode()
    return whole.dictionary.to_pylist(), whole.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _gram_counts(names: list[str], dimensions: dict[str, int]) -> np.ndarray:
    """Each name's counts of grams by dimension, and a row without any at the end. Counts are small, so that single precision is exact."""
    padded = [f"  {n.lower()}  " for n in names]
    letters = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    grams = letters[:-2] << 42 | letters[1:-1] << 21 | letters[2:]
    row = np.repeat(np.arange(len(names)), [len(p) for p in padded])
    # A gram ends where it began: in the same name.
    inside = row[:-2] == row[2:]
    distinct, place = np.unique(grams[inside], return_inverse=True)
    texts = ["".join(chr(g >> shift & 0x1FFFFF) for shift in (42, 21, 0)) for g in distinct.tolist()]
    for g in texts:
        if g not in dimensions:
            dimensions[g] = gram_bucket_of(g)
    found = np.array([dimensions[g] for g in texts], np.int64)[place] if len(texts) else np.zeros(0, np.int64)
    return np.bincount(row[:-2][inside] * GRAM_DIMENSIONS + found, minlength=(len(names) + 1) * GRAM_DIMENSIONS).reshape(len(names) + 1, GRAM_DIMENSIONS).astype(np.float32)


def _held(only: str | None) -> tuple[str, ...]:
    return COMPARED if only is None else (*COMPARED, only)


def compared_candidates(rows: DataFrame, strategies: dict[str, Column], left_id: str, right_id: str, most: int = blocking.MAX_BLOCK, only: str | None = None) -> DataFrame:
    """(left_id, right_id, and the level of each of FIELDS): ``compared`` for the ``candidates`` of ``rows``, worked out where a pair is met.

    ``rows`` has row_id (text), source, reference, amount_paise, occurred_on and
    counterparty; the alphabetically first source is left. Rows are shuffled
    with these columns and no more, as names are taken apart where blocks are,
    once each; pairs are not shuffled. A block gives at most
    ``most`` squared pairs, so their number stays in proportion to the rows.
    """

    names = list(strategies)

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for met, i, j, found in _compared_parts(batches, names):
            if only is not None:
                open_ = met.column(only).fill_null(False).to_numpy()
                kept = np.flatnonzero(open_[i] & open_[j])
                i, j, found = i[kept], j[kept], [x[kept] for x in found]
            ids = [met.column("row_id").combine_chunks().take(pa.array(k)) for k in (i, j)]
            yield pa.RecordBatch.from_arrays([*ids, *(pa.array(x.astype(np.int32)) for x in found)], names=[left_id, right_id, *FIELDS])

    return blocking._blocks(rows, strategies, most, _held(only)).mapInArrow(levels, f"{left_id} string, {right_id} string, " + ", ".join(f"{f} int" for f in FIELDS))


def counted_candidates(rows: DataFrame, strategies: dict[str, Column], most: int = blocking.MAX_BLOCK, only: str | None = None) -> DataFrame:
    """``pattern_counts`` of ``compared_candidates``, of all pairs whatever ``only`` says, counted where pairs are met: no pair leaves its task. In one plan with those it shares their shuffles."""
    width, names = MISSING + 1, list(strategies)

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width ** len(FIELDS), np.int64)
        for *_, found in _compared_parts(batches, names):
            total += np.bincount(np.ravel_multi_index(found, [width] * len(FIELDS)), minlength=len(total))
        seen = np.flatnonzero(total)
        levels = np.unravel_index(seen, [width] * len(FIELDS))
        yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in levels), pa.array(total[seen])], names=[*FIELDS, "n"])

    found = blocking._blocks(rows, strategies, most, _held(only)).mapInArrow(patterns, ", ".join(f"{f} int" for f in FIELDS) + ", n long")
    return found.groupBy(*FIELDS).agg(F.sum("n").alias("n"))


def pattern_counts(levels: DataFrame) -> DataFrame:
    """How often each combination of levels occurs: all that fitting needs, and at most 5**5 rows."""
    return levels.groupBy(*FIELDS).agg(F.count(F.lit(1)).alias("n"))


@dataclass
class Model:
    m: list[list[float]]
    u: list[list[float]]
    share: float
    rounds: int = 0
    converged: bool = False
    log_likelihood: float = field(default=-math.inf)

    def bits(self, at: int, level: int) -> float:
        """log2(m/u), clamped; a missing field says nothing."""
        if level == MISSING:
            return 0.0
        return max(-MOST_BITS, min(MOST_BITS, math.log2(max(self.m[at][level], 1e-12) / max(self.u[at][level], 1e-12))))

    @property
    def prior_bits(self) -> float:
        return math.log2(self.share / (1 - self.share))


def fit(counts: list[tuple[tuple[int, ...], int]]) -> Model:
    """Expectation maximisation over pattern counts, which is the same as over their pairs.

    ``counts`` are the rows of pattern_counts, at most 5**5. A pattern is a row
    of zeros and ones over all levels of all fields, so that a round is two
    matrix products: the patterns' log odds, and the expected level counts.
    Patterns are taken in order, so that sums do not depend on partitions.
    Without pairs the model is uniform.
    """
    if not counts:
        return Model([[0.25] * 4] * len(FIELDS), [[0.25] * 4] * len(FIELDS), SEED_SHARE)
    counts = sorted((tuple(p), n) for p, n in counts)
    patterns, n = np.array([p for p, _ in counts]), np.array([n for _, n in counts], float)
    width = patterns.shape[1]
    shown = (patterns[:, :, None] == np.arange(4)).reshape(len(n), width * 4).astype(float)
    chances, share = np.stack([np.tile(SEED_M, width), np.tile(SEED_U, width)]), SEED_SHARE
    likelihood, done = -math.inf, False
    for rounds in range(1, MOST_ROUNDS + 1):
        joint = shown @ np.log(np.maximum(chances, 1e-12)).T + np.log([share, 1 - share])
        whole = np.logaddexp(joint[:, 0], joint[:, 1])
        parts = np.exp(joint - whole[:, None]) * n[:, None]
        expected = (parts.T @ shown + SMOOTHING).reshape(2, width, 4)
        before, likelihood = likelihood, float(n @ whole)
        chances = (expected / expected.sum(axis=2, keepdims=True)).reshape(2, -1)
        share = min(max(float(parts[:, 0].sum() / n.sum()), 1e-6), 1 - 1e-6)
        done = abs(likelihood - before) < TOLERANCE * max(abs(before), 1.0)
        if done:
            break
    m, u = chances.reshape(2, width, 4).tolist()
    return Model(m, u, share, rounds, done, likelihood)


def fitted(counts: DataFrame) -> DataFrame:
    """One row of what ``fit`` makes of pattern counts, for plans that score by it: table (the bits of each level, missing too, of each of FIELDS) and prior."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = fit([(tuple(map(int, r[:-1])), int(r[-1])) for batch in batches for r in batch[[*FIELDS, "n"]].itertuples(index=False)])
        yield pd.DataFrame({"table": [[[model.bits(at, level) for level in range(MISSING + 1)] for at in range(len(FIELDS))]], "prior": [model.prior_bits]})

    # At most 5**5 rows.
    return counts.select(*FIELDS, "n").repartition(1).mapInPandas(run, "table array<array<double>>, prior double")


def score(levels: DataFrame, model: Model | DataFrame) -> DataFrame:
    """``levels`` with each field's bits, their sum and the probability of a match; a DataFrame is a ``fitted`` one."""
    if isinstance(model, Model):
        tables = [F.array(*(F.lit(model.bits(at, level)) for level in range(MISSING + 1))) for at in range(len(FIELDS))]
        prior = F.lit(model.prior_bits)
    else:
        levels = levels.crossJoin(F.broadcast(model.select(F.col("table").alias("_table"), F.col("prior").alias("_prior"))))
        tables, prior = [F.get("_table", F.lit(at)) for at in range(len(FIELDS))], F.col("_prior")
    each = [F.get(table, F.col(name).cast("int")) for name, table in zip(FIELDS, tables, strict=True)]
    levels = levels.withColumn("bits_by_field", F.array(*each)).withColumn("bits", F.round(sum(each[1:], each[0]), 6))
    odds = F.col("bits") + prior
    p = F.when(odds > MOST_ODDS, 1.0).when(odds < -MOST_ODDS, 0.0).otherwise(F.pow(F.lit(2.0), odds) / (1 + F.pow(F.lit(2.0), odds)))
    return levels.withColumn("probability", F.round(p, 6)).drop("_table", "_prior")


def explain(scored: DataFrame, most: int = 3) -> DataFrame:
    """``scored`` with the fields that weigh most, heaviest first."""
    named = F.array(*(F.struct((-F.abs(F.get("bits_by_field", F.lit(k)))).alias("order"), F.lit(n).alias("field"), F.get("bits_by_field", F.lit(k)).alias("bits")) for k, n in enumerate(FIELDS)))
    top = F.slice(F.array_sort(named), 1, most)
    return scored.withColumn("because", F.transform(top, lambda x: F.struct(x["field"].alias("field"), F.round(x["bits"], 4).alias("bits"))))


def _patterns(spark: SparkSession) -> DataFrame:
    """All 5**5 combinations of levels."""
    place = F.col("id").cast("int")
    return spark.range((MISSING + 1) ** len(FIELDS)).select(*((F.floor(place / (MISSING + 1) ** k) % (MISSING + 1)).cast("int").alias(f) for k, f in enumerate(FIELDS)))


def scored(levels: DataFrame, model: Model | DataFrame) -> DataFrame:
    """``levels`` with bits, probability, band and because: worked out once for each of the 5**5 patterns, which the pairs look up."""
    told = explain(score(_patterns(levels.sparkSession), model)).withColumn("band", band()).drop("bits_by_field")
    return levels.join(F.broadcast(told), list(FIELDS))


#: Fixed value: candidates that a report on a row shows.
SHOWN = 6


def leading(scored: DataFrame, own: str, other: str, most: int = SHOWN) -> DataFrame:
    """(own, leading): the ``most`` candidates of each row with the most bits, as structs of other, bits and probability; equals by the smaller id.

    Tasks keep that many rows each before the shuffle, however many candidates a row has.
    """
    place = F.row_number().over(W.partitionBy(own).orderBy(F.col("bits").desc(), other))
    kept = scored.withColumn("_place", place).where(F.col("_place") <= most)
    listed = F.array_sort(F.collect_list(F.struct("_place", F.struct(other, "bits", "probability").alias("c"))))
    return kept.groupBy(own).agg(F.transform(listed, lambda x: x["c"]).alias("leading"))


def leading_candidates(rows: DataFrame, strategies: dict[str, Column], model: Model, own: str, other: str, most: int = SHOWN, most_rows: int = blocking.MAX_BLOCK) -> DataFrame:
    """``leading`` of ``scored`` ``compared_candidates``, the left ids being ``own``: a block hands on what leads there, as one list for a row.

    In a list a pair is its other id and the place of its bits among those that
    the 5**5 patterns have.
    """
    width, names = MISSING + 1, list(strategies)
    told = score(_patterns(rows.sparkSession), model).select(*FIELDS, "bits", "probability").collect()
    values = sorted({(-r["bits"], r["probability"]) for r in told})
    ranks = np.zeros(width ** len(FIELDS), np.int64)
    for r in told:
        ranks[np.ravel_multi_index([r[f] for f in FIELDS], [width] * len(FIELDS))] = values.index((-r["bits"], r["probability"]))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for met, i, j, found in _compared_parts(batches, names):
            ids = met.column("row_id").combine_chunks()
            turn = np.empty(len(ids), np.int64)
            turn[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
            rank = ranks[np.ravel_multi_index(found, [width] * len(FIELDS))] if len(i) else np.zeros(0, np.int64)
            order = np.lexsort((turn[j], rank, i))
            i, j, rank = i[order], j[order], rank[order]
            begin = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])[: len(i)])
            place = np.arange(len(i)) - np.repeat(begin, np.diff([*begin, len(i)]))
            kept = place < most
            ends = np.concatenate([[0], np.cumsum(np.add.reduceat(kept, begin, dtype=np.int64))]) if len(i) else np.zeros(1, np.int64)
            items = pa.StructArray.from_arrays([pa.array(rank[kept].astype(np.int32)), ids.take(pa.array(j[kept]))], names=["rank", "id"])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(i[begin])), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)], names=[own, "first"])

    lists = blocking._blocks(rows, strategies, most_rows, COMPARED).mapInArrow(best, f"{own} string, first array<struct<rank: int, id: string>>")
    merged = lists.groupBy(own).agg(F.slice(F.array_sort(F.flatten(F.collect_list("first"))), 1, most).alias("first"))
    bits, chances = (F.array(*(F.lit(float(v)) for v in column)) for column in ([-b for b, _ in values], [p for _, p in values]))
    named = F.transform("first", lambda x: F.struct(x["id"].alias(other), F.get(bits, x["rank"]).alias("bits"), F.get(chances, x["rank"]).alias("probability")))
    return merged.select(own, named.alias("leading"))


#: Bits from which a pair links, and from which a person reviews it.
LINK_BITS, REVIEW_BITS = 6.0, 0.0


def band(bits: str = "bits") -> Column:
    return F.when(F.col(bits) >= LINK_BITS, "link").when(F.col(bits) >= REVIEW_BITS, "review").otherwise("reject")
