"""Removal of repeated passages by content-defined chunks of lines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import cut, small_batches, table

#: Lines are wrapped after about one word in so many, chosen by the eight bytes before its end.
WRAP = 2
#: Bytes that a chunk has at least, besides two lines; shorter ones repeat by chance.
LEAST_BYTES = 20
#: Bytes before a gap that decide whether a line ends there.
DECIDING = 8
#: Repeated passages of fewer words stay.
MIN_WORDS = 30
ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
INVERSE = np.uint64(pow(int(ODD[1]), -1, 1 << 64))
BYTES = np.random.default_rng(1).integers(1, 1 << 63, 256, np.uint64)
IS_GAP = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """The first n powers of the hash's base and of its inverse, modulo 2**64; kept for the longest text so far."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((ODD[1], INVERSE)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers[k] = np.multiply.accumulate(factors)
    return _powers


def _flat(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The text with one space for each gap between words and none around them, and the place of each of its bytes."""
    own = np.frombuffer(raw, np.uint8)
    gap = IS_GAP[own]
    stays = ~gap
    stays[1:] |= ~gap[:-1]
    at = np.flatnonzero(stays)
    flat = np.where(gap[at], np.uint8(0x20), own[at])
    return (flat[:-1], at[:-1]) if len(flat) and flat[-1] == 0x20 else (flat, at)


class Layout:
    """A text's lines and its chunks of two lines or more.

    Lines end after words that their own last bytes choose, and chunks after
    lines whose rolling hash, over the line and the one before, is less than
    that of either neighbour, so that no line is left between chunks. However
    the gaps between words are written, equal words give equal lines and
    chunks. Hashes of any span of bytes come from one running sum over the
    text. ``a`` and ``b`` are where chunks begin and where the word after them
    does.
    """

    def __init__(self, raw: bytes):
        self.size = len(raw)
        flat, self.at = _flat(raw)
        self.a, self.b, self.hashes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        n = len(flat)
        if not n:
            return
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTES[flat] * up[:n], out=sums[1:])
        span = lambda a, b: (sums[b] - sums[a]) * down[a]
        self.gaps = np.flatnonzero(flat == 0x20)
        last = span(np.maximum(self.gaps - DECIDING, 0), self.gaps) * ODD[0]
        ends = np.append(self.gaps[(last >> np.uint64(40)) % np.uint64(WRAP) == 0], n)
        self.lines = np.concatenate([[0], ends[:-1] + 1])
        lines = span(self.lines, ends)
        rolled = (lines + np.concatenate([[np.uint64(0)], lines[:-1]]) * ODD[1]) * ODD[0]
        cut = np.flatnonzero((rolled[1:-1] < rolled[:-2]) & (rolled[1:-1] < rolled[2:])) + 1
        cut = np.append(cut, len(lines) - 1)
        first = np.concatenate([[0], cut[:-1] + 1])
        a, b = self.lines[first], ends[cut]
        keep = (cut > first) & (b - a >= LEAST_BYTES)
        a, b, self.first, self.last = a[keep], b[keep], first[keep], cut[keep]
        self.hashes = span(a, b) * ODD[0]
        beyond = np.append(self.at, [self.size] * 2)
        self.a, self.b, self.after = self.at[a], beyond[b + 1], beyond[ends + 1]

    def reach(self, a: int, b: int) -> tuple[int, int]:
        """How far around the run from a to b its words need comparing.

        After it, to the end of the line after the next chunk, which decides
        where that ends; before it, to the begin of the chunk there and to what
        decides that it begins there: three lines and the bytes that end the
        line before. Text that is equal so far has that chunk in common too,
        which is a repeat with a reach of its own.
        """
        k = int(np.searchsorted(self.a, b))
        high = int(self.after[min(int(self.last[k]) + 1, len(self.after) - 1)]) if k < len(self.a) else self.size
        k = int(np.searchsorted(self.b, a, "right")) - 1
        line = int(self.first[k]) - 3 if k >= 0 else 0
        if line <= 0:
            return 0, high
        g = int(np.searchsorted(self.gaps, self.lines[line] - 1 - DECIDING)) - 1
        return int(self.at[self.gaps[g] + 1]) if g >= 0 else 0, high


def chunks(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins, ends and hashes of a text's chunks of two lines or more; a chunk's end takes in the white space after it."""
    found = Layout(raw)
    return found.a, found.b, found.hashes


def _raw(value: pa.Scalar) -> bytes:
    return (value.as_py() or "").encode("utf-8", "surrogatepass")


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [chunks(_raw(text)) for text in batch.column("text")]
        rows = np.repeat(np.arange(len(found)), [len(a) for a, _, _ in found])
        picked = batch.select(["doc_id", "row_key"]).take(pa.array(rows))
        a, b, h = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else [[], [], []]))
        columns = [pa.array(a.astype(np.int32)), pa.array((b - a).astype(np.int32)), pa.array(h.astype(np.uint64).view(np.int64))]
        yield pa.RecordBatch.from_arrays([*picked.columns, *columns], names=["doc_id", "row_key", "begin", "n", "chunk"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document, the runs of neighbouring repeated chunks that repeat neighbouring chunks of one document."""
    for batch in batches:
        if not batch.num_rows:
            continue
        hits = batch.column("hits")
        flat, of = hits.flatten(), hits.flatten().field("of")
        begin, n = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("begin", "n"))
        key, of_begin, of_n = (of.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("row_key", "begin", "n"))
        row = np.repeat(np.arange(batch.num_rows), hits.value_lengths().to_numpy(zero_copy_only=False))
        order = np.lexsort((of_begin, key, n, begin, row))
        row, begin, n, key, of_begin, of_n = (x[order] for x in (row, begin, n, key, of_begin, of_n))
        goes_on = (row[1:] == row[:-1]) & (key[1:] == key[:-1]) & (of_begin[1:] - begin[1:] == of_begin[:-1] - begin[:-1]) & (begin[1:] <= begin[:-1] + n[:-1])
        first = np.flatnonzero(np.concatenate([[True], ~goes_on]))
        last = np.append(first[1:], len(row)) - 1
        columns = [batch.column("row_key").take(pa.array(row[first])), pa.array(begin[first].astype(np.int32)), pa.array(key[first])]
        columns += [pa.array(x.astype(np.int32)) for x in (of_begin[first], of_begin[last] + of_n[last] - of_begin[first])]
        yield pa.RecordBatch.from_arrays(columns, names=["row_key", "begin", "of_key", "of_begin", "n"])


def around(raw: bytes, a: int, b: int, low: int = 0, high: int | None = None) -> tuple[bytes, bytes, bytes]:
    """The bytes from a to b, those from low on before them and those up to high after them."""
    return raw[a:b], raw[low:a], raw[b:high]


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of first occurrences, with the words around it."""
    for batch in batches:
        rows: list[tuple] = []
        for k, (text, wanted) in enumerate(zip(batch.column("text"), batch.column("wanted"), strict=True)):
            raw = _raw(text)
            layout = Layout(raw)
            for w in wanted.as_py():
                a, b = w["begin"], w["begin"] + w["n"]
                rows.append((k, a, w["n"], *around(raw, a, b, *layout.reach(a, b))))
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        picked = batch.column("row_key").take(pa.array(columns[0], pa.int64()))
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([picked, *(pa.array(c, t) for c, t in zip(columns[1:], kinds, strict=True))], names=["row_key", "begin", "n", "body", "before", "after"])


def _shared(one: list[bytes], other: list[bytes]) -> int:
    """How many words two contexts share from the nearest on."""
    n = 0
    for x, y in zip(one, other, strict=False):
        if x != y:
            break
        n += 1
    return n


def without(raw: bytes, spans: list[tuple[int, bytes, bytes, bytes]]) -> tuple[bytes, int]:
    """The text without what it repeats, and the words that went.

    A span is where a repeated run may begin, the bytes of its first
    occurrence and the bytes around those. Their words are compared; the run
    then grows to the first word that is unequal. Runs that touch count
    together, and short ones stay.
    """
    mine = raw.split()
    gap = IS_GAP[np.frombuffer(raw, np.uint8)]
    begins = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]])) if raw else np.zeros(0, np.int64)
    places = []
    for a, body, before, after in spans:
        i, same = int(np.searchsorted(begins, a)), body.split()
        j = i + len(same)
        if i == len(mine) or begins[i] != a or mine[i:j] != same:
            continue
        earlier, later = before.split()[::-1], after.split()
        places.append((i - _shared(mine[max(0, i - len(earlier)) : i][::-1], earlier), j + _shared(mine[j : j + len(later)], later)))
    merged: list[list[int]] = []
    for i, j in sorted(places):
        if merged and i <= merged[-1][1]:
            merged[-1][1] = max(j, merged[-1][1])
        else:
            merged.append([i, j])
    kept, at, gone = [], 0, 0
    for i, j in merged:
        if j - i >= MIN_WORDS:
            kept.append(raw[at : begins[i]] if i else b"")
            at, gone = int(begins[j]) if j < len(mine) else len(raw), gone + j - i
    kept.append(raw[at:])
    return b"".join(kept), gone


def dedup(docs: DataFrame, hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] = _hashes) -> DataFrame:
    """``docs`` without repeated passages in ``text``, and with ``words_removed``.

    Chunks of lines are hashed; of each hash the first occurrence, by doc_id
    and place, stays. Its bytes go to the documents that repeat it, with those
    up to the next chunk to both sides; the words are compared there, and the
    repeat grows to the first unequal word. What makes up MIN_WORDS words or
    more goes. Shuffles carry hashes and places, each first occurrence's text,
    and the documents once for either join. Hashes only propose: chunks or rows
    that share one by chance cost a comparison and change nothing.

    Null texts stay null. Rows with equal doc_id and text count as one document
    and are treated alike; null ids come first. A copy of a whole document is
    left with an empty text. A column called words_removed is replaced; others,
    whatever their names, stay. An empty table gives no rows.
    """
    docs = docs.drop("words_removed")
    kind = docs.schema["doc_id"].dataType.simpleString()
    titles = docs.columns
    names = [f"c{k}" for k in range(len(titles))]
    keyed = docs.toDF(*names)
    id_at, text_at = (names[titles.index(c)] for c in ("doc_id", "text"))
    rest = [n for n in names if n not in (id_at, text_at)]
    keyed = keyed.select(F.col(id_at).alias("doc_id"), F.col(text_at).alias("text"), F.xxhash64(F.col(id_at).isNull(), id_at, text_at).alias("row_key"), *rest)

    hashed = small_batches(keyed.select("doc_id", "row_key", "text")).mapInArrow(hashes, f"doc_id {kind}, row_key long, begin int, n int, chunk long")
    # One exchange and one sort give each occurrence of a chunk the first one.
    in_order = Window.partitionBy("chunk").orderBy("doc_id", "row_key", "begin")
    again = hashed.select("row_key", "begin", "n", F.first(F.struct("row_key", "begin", "n")).over(in_order).alias("of"))
    again = again.where((F.col("row_key") != F.col("of.row_key")) | (F.col("begin") != F.col("of.begin")))
    hits = again.groupBy("row_key").agg(F.collect_set(F.struct("begin", "n", "of")).alias("hits"))
    runs = cut(hits.mapInArrow(_runs, "row_key long, begin int, of_key long, of_begin int, n int"))

    # A key without nulls: what is gathered by document is then dealt out as the join with the documents needs it.
    def met(lists: DataFrame, how: str = "inner") -> DataFrame:
        return keyed.join(lists.hint("shuffle_hash"), ["row_key"], how).select(*keyed.columns, lists.columns[-1])

    wanted = runs.select(F.col("of_key").alias("row_key"), F.col("of_begin").alias("begin"), "n").distinct()
    wanted = wanted.groupBy("row_key").agg(F.collect_list(F.struct("begin", "n")).alias("wanted"))
    regions = met(wanted).mapInArrow(_regions, "row_key long, begin int, n int, body binary, before binary, after binary")
    regions = regions.toDF("of_key", "of_begin", "n", "body", "before", "after")
    told = runs.join(regions, ["of_key", "of_begin", "n"]).select("row_key", F.struct("begin", "body", "before", "after").alias("span"))
    told = told.groupBy("row_key").agg(F.collect_list("span").alias("spans"))

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                left, n = without(_raw(text), [tuple(s.values()) for s in spans.as_py()]) if spans.is_valid else (None, 0)
                texts.append(left.decode("utf-8", "surrogatepass") if n else text.as_py())
                removed.append(n)
            by = {"text": pa.array(texts, pa.string()), "doc_id": batch.column("doc_id")}
            columns = [by[c] if c in by else batch.column(n) for c, n in zip(titles, names, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, pa.int64())], names=[*names, "words_removed"])

    fields = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema, strict=True))
    out = met(told, "left").mapInArrow(cleaned, f"{fields}, words_removed long")
    return out.toDF(*titles, "words_removed")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op1_line_dedup": op1_line_dedup}
