"""SimHash near-duplicates by bit-sliced comparison."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tallyspark.llm.common import connected_components, cut, in_blocks, packed, small_batches, table

BITS = 64
SEED = 42
SHINGLE_WORDS = 3
RADIUS = 3
#: Widths of the bit fields; RADIUS differing bits leave two of five fields equal.
FIELDS = (13, 13, 13, 13, 12)
#: Rows in a block; a comparison task holds two.
BLOCK = 2048
#: Groups up to this size are compared as one flat list of pairs.
SMALL = 32
#: Planes that are counted between two looks at whether a block is past the radius.
STRIDE = 8
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The SimHash of a whole text; null and texts without words give 0."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles: Iterable[bytes] = [b" ".join(tokens)]
        n = 1
    else:
        shingles = map(b" ".join, zip(*(tokens[k:] for k in range(words)), strict=False))
        n = len(tokens) - words + 1
    h = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, n, 65536):
        ones += np.unpackbits(h[k : k + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        found = np.array([fingerprint(x.as_py()) for x in batch.column(at)], np.uint64).view(np.int64)
        columns = [c for k, c in enumerate(batch.columns) if k != at]
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(found)], names=[*names, "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for each row of ``docs``; fp is the fingerprint as a signed long."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs.select("doc_id", "text")).mapInArrow(_fingerprints, f"doc_id {kind}, fp long")


def past(planes: Iterable[np.ndarray], shape: tuple[int, ...], radius: int) -> np.ndarray:
    """Bit lanes with over ``radius`` set bits among the planes, by carry-save counting; gives up once all lanes are past it."""
    digits = [np.zeros(shape, np.uint64) for _ in range((radius + 1).bit_length())]
    over = np.zeros(shape, np.uint64)
    for k, carry in enumerate(planes):
        for i, digit in enumerate(digits):
            digits[i], carry = digit ^ carry, digit & carry
        over |= carry
        if k % STRIDE == STRIDE - 1:
            over |= _at_least(digits, radius + 1)
            if (over == ALL).all():
                break
    return over | _at_least(digits, radius + 1)


def _at_least(digits: list[np.ndarray], least: int) -> np.ndarray:
    """Lanes whose counter, given as binary digits from the lowest, is ``least`` or more."""
    more, same = np.zeros_like(digits[0]), np.full_like(digits[0], ALL)
    for i in reversed(range(len(digits))):
        if least >> i & 1:
            same &= digits[i]
        else:
            more |= same & digits[i]
            same &= ~digits[i]
    return more | same


def bit_planes(values: np.ndarray) -> np.ndarray:
    """64 rows, one for each bit, of the values' bits packed 64 to a word; lanes beyond the values are zero."""
    wide = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    wide[: len(values)] = values
    bits = np.unpackbits(wide.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _lanes(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=-1, bitorder="little")[..., :n].astype(bool)


def near_pairs(queries: np.ndarray, stored: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (query, stored) of fingerprints at most ``radius`` bits apart."""
    planes, left, right = bit_planes(stored), [], []
    for begin in range(0, len(queries), 256):
        some = queries[begin : begin + 256]
        masks = [np.where(some >> np.uint64(b) & np.uint64(1), ALL, np.uint64(0))[:, None] for b in range(BITS)]
        diff = (planes[b][None, :] ^ masks[b] for b in range(BITS))
        i, j = np.nonzero(_lanes(~past(diff, (len(some), planes.shape[1]), radius), len(stored)))
        left.append(i + begin)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def near_listed(x: np.ndarray, y: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For listed pairs (x[k], y[k]), whether they are at most ``radius`` bits apart."""
    out = np.zeros(len(x), bool)
    for k in range(0, len(x), 65536):
        planes = bit_planes(x[k : k + 65536] ^ y[k : k + 65536])
        out[k : k + 65536] = _lanes(~past(planes, planes.shape[1:], radius), len(planes[0]) * 64)[: len(x[k : k + 65536])]
    return out


def smallest_linked(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For items 0 to n-1 linked by the pairs (i, j): the smallest item each one reaches."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each group, links that hold its linked fingerprints together: one less than fingerprints in each class at most."""
    for batch in batches:
        items = batch.column("items")
        flat = items.flatten()
        fps = flat.field("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        sides = flat.field("side").to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(items.value_lengths().to_numpy(zero_copy_only=False))])
        lo, hi = batch.column("lo").to_numpy(), batch.column("hi").to_numpy()
        a, b = [], []
        sizes = np.diff(ends)
        for size in np.unique(sizes[sizes <= SMALL]):
            starts = ends[:-1][sizes == size]
            i, j = np.triu_indices(size, 1)
            i, j = (starts[:, None] + i).ravel(), (starts[:, None] + j).ravel()
            near = near_listed(fps[i], fps[j])
            a.append(fps[i[near]])
            b.append(fps[j[near]])
        for k in np.flatnonzero(sizes > SMALL):
            own, side = fps[ends[k] : ends[k + 1]], sides[ends[k] : ends[k + 1]]
            if lo[k] == hi[k]:
                i, j = near_pairs(own, own)
            else:
                low, high = np.flatnonzero(side == lo[k]), np.flatnonzero(side == hi[k])
                i, j = near_pairs(own[low], own[high])
                i, j = low[i], high[j]
            label = smallest_linked(len(own), i, j)
            moved = np.flatnonzero(label != np.arange(len(own)))
            a.append(own[moved])
            b.append(own[label[moved]])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) whose closure joins all fingerprints at most RADIUS bits apart; ``distinct`` has each fingerprint once.

    Two fingerprints within the radius agree on two whole fields, so each of the
    ten pairs of fields is a table of buckets, and the buckets' members are
    compared bit-sliced.
    """
    low = np.concatenate([[0], np.cumsum(FIELDS)])
    spans = [((1 << FIELDS[k]) - 1) << int(low[k]) for k in range(len(FIELDS))]
    masks = [spans[i] | spans[j] for i, j in combinations(range(len(FIELDS)), len(FIELDS) - RADIUS)]
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    buckets = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bucket")) for t, m in enumerate(signed)))
    rows = distinct.select("fp", F.explode(buckets).alias("_b")).select("fp", "_b.t", "_b.bucket")
    groups = in_blocks(rows, ["t", "bucket"], ["fp"], "fp", BLOCK)
    return small_batches(groups.select("lo", "hi", "items")).mapInArrow(_edges, "a long, b long")


def _classes(prints: DataFrame) -> DataFrame:
    """(fp, class, component_id) for each fingerprint: the smallest fingerprint and the smallest doc_id that links reach."""
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    members = connected_components(links(least.select("fp")))
    classes = least.join(members, least["fp"] == members["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("class"))
    smallest = classes.groupBy("class").agg(F.min("least").alias("component_id"))
    return classes.join(smallest, "class").select("fp", "class", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``.

    Documents link when their fingerprints differ in at most RADIUS bits;
    component_id is the smallest doc_id that links reach. A null text counts as
    empty, and texts without words share fingerprint 0. Rows that repeat a
    doc_id each give a row; a null doc_id takes part, and its row takes the
    smallest other id of its class, or null. An empty table gives no rows;
    further columns are ignored.
    """
    prints = cut(fingerprints(docs))
    return prints.join(_classes(prints).select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay when one of each near-duplicate class does: the one with the smallest doc_id, and of those the smallest text hash.

    All columns stay. The class is that of the row's own text, so rows that
    share a doc_id, or have none, stay or go each for itself; a row without an
    id stays only where its class has no id at all. Of rows with the same doc_id
    and text, which are copies, any one stays.
    """
    # Keys without nulls: what the join deals out is then grouped by the same keys.
    keys = {"_row_id": F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")), "_row_text": F.coalesce(F.sha2("text", 256), F.lit(""))}
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = small_batches(docs.select("doc_id", "text", *(c.alias(n) for n, c in keys.items())))
    prints = cut(rows.mapInArrow(_fingerprints, f"doc_id {kind}, _row_id string, _row_text string, fp long"))
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "_row_text", "_row_id")
    least = prints.groupBy("fp").agg(F.min(place).alias("least"))
    firsts = _classes(prints).join(least, "fp").groupBy("class").agg(F.min("least").alias("first")).select(*(f"first.{n}" for n in keys))
    own = docs.select(packed(docs), *(c.alias(n) for n, c in keys.items()))
    return own.join(firsts, [*keys], "left_semi").dropDuplicates([*keys]).select("row.*")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash": op4_simhash}
