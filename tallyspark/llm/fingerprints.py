"""Document fingerprints: invertible Bloom lookup sketches over paragraph digests, and what differs between two versions."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from xxhash import xxh32_intdigest, xxh64_intdigest

from tallyspark.llm.common import cut, small_batches, table

SEED = 42
#: Subtables of a sketch; a digest has one cell in each.
TABLES = 3
#: Cells a subtable in a fingerprint, and in the first sketch of a comparison; each retry doubles them.
CELLS = 4
#: A paragraph of more characters is cut further, after words whose hash is divisible by STRIDE.
LONG, STRIDE = 256, 16
#: Paragraphs of texts that are compared at once in a task.
AT_ONCE = 200_000

PARAGRAPH = regex.compile(r"[^\n.!?]+[\n.!?]*|[\n.!?]+")
WORD = regex.compile(r"\s*\S+|\s+")
ODD = 0x9E3779B97F4A7C15


def paragraphs(text: str) -> list[str]:
    """A text's parts, which joined give it again: lines, cut at the ends of sentences, and long ones at words that their hash picks.

    All cuts hang on what stands around them only, so an edit moves none but its own.
    """
    out = []
    for part in PARAGRAPH.findall(text):
        if len(part) <= LONG:
            out.append(part)
            continue
        begun = []
        for word in WORD.findall(part):
            begun.append(word)
            if xxh32_intdigest(word.strip().encode()) % STRIDE == 0:
                out.append("".join(begun))
                begun = []
        if begun:
            out.append("".join(begun))
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(ODD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Digests:
    """The paragraph digests of a list of texts: ``key``, ``size`` (code points) and ``owner`` (the text's place in the list).

    Repeats of a paragraph get keys of their own by their rank, so that the keys
    of a text are distinct and two texts share as many as both have.
    """

    def __init__(self, texts: list[str]):
        parts = [paragraphs(t) for t in texts]
        flat = [p for own in parts for p in own]
        self.texts, self.counts = len(texts), np.array([len(own) for own in parts], np.int64)
        self.owner = np.repeat(np.arange(len(texts)), self.counts)
        self.size = np.fromiter(map(len, flat), np.int64, len(flat))
        hashed = np.fromiter(map(xxh64_intdigest, (p.encode() for p in flat), repeat(SEED)), np.uint64, len(flat))
        order = np.lexsort((hashed, self.owner))
        same = np.concatenate([[False], (np.diff(hashed[order]) == 0) & (np.diff(self.owner[order]) == 0)]) if len(flat) else np.zeros(0, bool)
        place = np.arange(len(flat))
        rank = np.empty(len(flat), np.int64)
        rank[order] = place - np.maximum.accumulate(np.where(same, 0, place)) if len(flat) else place
        self.key = _mix(hashed + rank.astype(np.uint64) * np.uint64(ODD))
        self.total = np.bincount(self.owner, self.size, len(texts)).astype(np.int64)

    def chosen(self, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, size, place in ``texts``) of the digests of some texts; a text may be asked for more than once."""
        starts = np.cumsum(self.counts) - self.counts
        counts = self.counts[texts]
        at = np.repeat(starts[texts] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        return self.key[at], self.size[at], np.repeat(np.arange(len(texts)), counts)


class Sketches:
    """A sketch for each of ``n`` owners: TABLES subtables of ``cells`` cells, each the sums of count, key, check and size of its digests."""

    def __init__(self, n: int, cells: int):
        self.n, self.cells = n, cells
        shape = n * TABLES * cells
        self.count, self.size = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        self.key, self.check = np.zeros(shape, np.uint64), np.zeros(shape, np.uint64)

    def places(self, key: np.ndarray, owner: np.ndarray) -> list[np.ndarray]:
        """Of each digest its cell in each subtable; other sizes deal anew."""
        spread = (_mix(key + np.uint64((t * 1_000_003 + self.cells) * ODD % 2**64)) % np.uint64(self.cells) for t in range(TABLES))
        return [(owner * TABLES + t) * self.cells + s.astype(np.int64) for t, s in enumerate(spread)]

    def add(self, key: np.ndarray, size: np.ndarray, owner: np.ndarray, sign: int | np.ndarray = 1) -> None:
        """Add digests, or take them off where ``sign`` is -1; keys and checks wrap around."""
        sign = np.broadcast_to(np.asarray(sign, np.int64), len(key))
        wrapped = sign.astype(np.uint64)
        check = _checks(key)
        for at in self.places(key, owner):
            np.add.at(self.count, at, sign)
            np.add.at(self.size, at, sign * size)
            np.add.at(self.key, at, wrapped * key)
            np.add.at(self.check, at, wrapped * check)

    def encoded(self) -> list[str]:
        """Each sketch as base64 text: its cells' counts, sizes, keys and the low halves of their checks."""
        width = TABLES * self.cells
        rows = [self.count.astype("<i4"), self.size.astype("<i8"), self.key.astype("<u8"), self.check.astype("<u4")]
        packed = [x.reshape(self.n, width).view(np.uint8) for x in rows]
        return [base64.b64encode(row.tobytes()).decode() for row in np.concatenate(packed, axis=1)] if self.n else []

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(whole, owner, key, size, sign): which owners' digests all came out, and the digests.

        A cell with one digest shows its key and confirms it by its check and
        its own place. Such digests leave their other cells, which may then
        have one left.
        """
        out: list[tuple[np.ndarray, ...]] = []
        for _ in range(len(self.count) + 1):
            at = np.flatnonzero(np.abs(self.count) == 1)
            sign = self.count[at]
            key = sign.astype(np.uint64) * self.key[at]
            owner = at // (TABLES * self.cells)
            pure = sign.astype(np.uint64) * self.check[at] == _checks(key)
            pure &= np.logical_or.reduce([p == at for p in self.places(key, owner)]) if len(at) else pure
            at, sign, key, owner = at[pure], sign[pure], key[pure], owner[pure]
            if not len(at):
                break
            size = sign * self.size[at]
            order = np.lexsort((key, owner))
            first = order[np.concatenate([[True], (np.diff(key[order]) != 0) | (np.diff(owner[order]) != 0)])]
            found = owner[first], key[first], size[first], sign[first]
            self.add(found[1], found[2], found[0], -found[3])
            out.append(found)
        empty = (self.count == 0) & (self.key == 0) & (self.check == 0)
        whole = empty.reshape(self.n, -1).all(axis=1)
        none = np.zeros(0, np.int64)
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [none, none.astype(np.uint64), none, none]
        return (whole, *columns)


def _checks(key: np.ndarray) -> np.ndarray:
    return _mix(key ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(0xFFFFFFFF)


def fingerprint_texts(texts: list[str]) -> list[str]:
    """The fingerprint of each text: its sketch of TABLES times CELLS cells."""
    d, out = Digests(texts), Sketches(len(texts), CELLS)
    out.add(d.key, d.size, d.owner)
    return out.encoded()


def differences(digests: Digests, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pair, key, size, sign, cells): what texts ``left`` have over ``right`` (sign 1) and lack (-1), and the cells that each pair took.

    The sketches of a pair are subtracted, so that common digests leave, and
    peeled. Pairs that do not come out whole are sketched again at twice the
    size, with new places, until they do.
    """
    waiting, cells, out = np.arange(len(left)), CELLS, []
    took = np.zeros(len(left), np.int64)
    while len(waiting):
        gap = Sketches(len(waiting), cells)
        gap.add(*digests.chosen(left[waiting]))
        gap.add(*digests.chosen(right[waiting]), -1)
        whole, owner, key, size, sign = gap.peel()
        inside = whole[owner]
        out.append((waiting[owner[inside]], key[inside], size[inside], sign[inside]))
        took[waiting[whole]] = cells
        waiting, cells = waiting[~whole], 2 * cells
    columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
    return (*columns, took)


def likeness(digests: Digests, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of each pair of texts the share of their characters in paragraphs that both have; 1 of two empty texts."""
    pair, _, size, _, _ = differences(digests, left, right)
    apart = np.bincount(pair, size, len(left))
    both = digests.total[left] + digests.total[right]
    return np.where(both == 0, 1.0, 1.0 - apart / np.maximum(both, 1))


def _slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    begin = held = 0
    for k, size in enumerate(sizes):
        if held and held + size > most:
            yield begin, k
            begin, held = k, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) for each row of ``docs``; one pass without a shuffle.

    A null text counts as empty. Repeated rows, null ids and further columns
    change nothing; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprint_texts(texts), pa.string())], names=["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, fingerprint string")


def compare(pairs: DataFrame, old: str, new: str) -> DataFrame:
    """``pairs`` with what differs between two texts of a row: ``likeness``, ``removed`` and ``added`` (hex digests in order), and ``cells``, the size that peeled.

    Null texts count as empty. The four columns replace those of the same names.
    """
    fields = [("likeness", pa.float64(), "double"), ("removed", pa.list_(pa.string()), "array<string>"), ("added", pa.list_(pa.string()), "array<string>"), ("cells", pa.int64(), "long")]
    names = {n for n, _, _ in fields}
    kept = [c for c in pairs.columns if c not in names]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema if f.name in kept] + [f"{n} {kind}" for n, _, kind in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([x or "" for x in batch.column(c).to_pylist()] for c in ("_old", "_new"))
            for begin, end in _slices([(len(x) + len(y)) // 16 for x, y in zip(a, b, strict=True)], AT_ONCE):
                digests, n = Digests(a[begin:end] + b[begin:end]), end - begin
                left, right = np.arange(n), np.arange(n, 2 * n)
                pair, key, _, sign, cells = differences(digests, left, right)
                lists: dict[int, list[list[str]]] = {1: [[] for _ in range(n)], -1: [[] for _ in range(n)]}
                for p, k, s in sorted(zip(pair.tolist(), key.tolist(), sign.tolist(), strict=True)):
                    lists[s][p].append(f"{k:016x}")
                found = [likeness(digests, left, right), lists[1], lists[-1], cells]
                columns = [batch.column(c).slice(begin, n) for c in kept] + [pa.array(x, t) for x, (_, t, _) in zip(found, fields, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *(n for n, _, _ in fields)])

    rows = pairs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{old}`").alias("_old"), F.col(f"`{new}`").alias("_new"))
    return small_batches(rows).mapInArrow(run, schema)


def with_next(docs: DataFrame, work: Callable[[pa.Array, pa.Array, pa.Array], list[pa.Array]], fields: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    """What ``work`` makes of (doc_id, text, next text) of all rows, in the order of doc_id; after the last row comes the first.

    Rows are range-partitioned and sorted once. Each task hands batches of its
    rows on, with a row's follower beside it, and leaves its first and last row,
    which meet across tasks afterwards: so texts move once, and what is left to
    join is two rows a task. Null ids come first, rows of equal ids go by a hash
    of their text; equal rows are spread, as it does not matter which is which.
    ``fields`` are the columns of ``work``: name, Arrow type, Spark type.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [n for n, _, _ in fields]
    arrow_id = pa.int64() if kind == "bigint" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()

        def out(edge: int, ids: pa.Array, texts: pa.Array, made: list[pa.Array] | None) -> pa.RecordBatch:
            n = len(ids)
            made = made or [pa.nulls(n, t) for _, t, _ in fields]
            head = [pa.array([task] * n, pa.int64()), pa.array([edge] * n, pa.int32()), ids, texts]
            return pa.RecordBatch.from_arrays([*head, *made], names=["_task", "_edge", "_id", "_text", *names])

        held = None
        for batch in batches:
            ids, texts = batch.column("_id"), pa.array([x or "" for x in batch.column("_text").to_pylist()], pa.string())
            if not len(ids):
                continue
            if held is None:
                yield out(1, ids.slice(0, 1), texts.slice(0, 1), None)
            else:
                ids, texts = pa.concat_arrays([held[0], ids]), pa.concat_arrays([held[1], texts])
            n = len(ids) - 1
            if n:
                yield out(0, ids.slice(0, n), pa.nulls(n, pa.string()), work(ids.slice(0, n), texts.slice(0, n), texts.slice(1, n)))
            held = ids.slice(n, 1), texts.slice(n, 1)
        if held is not None:
            yield out(2, *held, None)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("_id")
            yield pa.RecordBatch.from_arrays([ids, *work(ids, batch.column("_text"), batch.column("_after"))], names=["_id", *names])

    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.xxhash64("text").alias("_hash"), F.rand(SEED).alias("_any"))
    rows = rows.repartitionByRange("_id", "_hash", "_any").sortWithinPartitions("_id", "_hash", "_any").select("_id", "_text")
    made = ", ".join(f"{n} {t}" for n, _, t in fields)
    done = cut(small_batches(rows).mapInArrow(run, f"_task long, _edge int, _id {kind}, _text string, {made}"))
    firsts = done.where("_edge = 1").select(F.col("_task").alias("_to"), F.col("_text").alias("_after"))
    order = W.orderBy("_to")
    follow = firsts.select("_to").select(F.col("_to").alias("_task"), F.coalesce(F.lead("_to").over(order), F.first("_to").over(order)).alias("_to"))
    lasts = done.where("_edge = 2").select("_task", "_id", "_text").join(follow, "_task").join(firsts, "_to").select("_id", "_text", "_after")
    both = done.where("_edge = 0").select("_id", *names).unionByName(lasts.mapInArrow(meet, f"_id {kind}, {made}"))
    return both.withColumnRenamed("_id", "doc_id")


VERSION_FIELDS = [
    ("n_chars", pa.int64(), "long"), ("edited_sha256", pa.string(), "string"), ("fingerprint", pa.string(), "string"), ("edited_fingerprint", pa.string(), "string"),
    ("near_edited", pa.float64(), "double"), ("near_next", pa.float64(), "double"),
]


def _versions(ids: pa.Array, texts: pa.Array, after: pa.Array) -> list[pa.Array]:
    own, then = texts.to_pylist(), after.to_pylist()
    parts: list[list] = [[] for _ in VERSION_FIELDS]
    for begin, end in _slices([(2 * len(a) + len(b)) // 16 for a, b in zip(own, then, strict=True)], AT_ONCE):
        a, b, n = own[begin:end], then[begin:end], end - begin
        edited = [x[: len(x) - len(x) // 2] + y[: len(x) // 2] for x, y in zip(a, b, strict=True)]
        # A text's follower is mostly the next one's own text.
        digests, place = Digests([*a, b[-1], *edited]), np.arange(n)
        prints = Sketches(digests.texts, CELLS)
        prints.add(digests.key, digests.size, digests.owner)
        shown = prints.encoded()
        near = likeness(digests, np.concatenate([place, place]), np.concatenate([n + 1 + place, 1 + place])) if a[1:] == b[:-1] else None
        if near is None:
            digests = Digests([*a, *b, *edited])
            near = likeness(digests, np.concatenate([place, place]), np.concatenate([2 * n + place, n + place]))
        found = [len(x) for x in a], [hashlib.sha256(x.encode()).hexdigest() for x in edited], shown[:n], shown[n + 1 :], near[:n], near[n:]
        for part, values in zip(parts, found, strict=True):
            part.extend(values)
    return [pa.array(p, t) for p, (_, t, _) in zip(parts, VERSION_FIELDS, strict=True)]


def versions(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` its fingerprint, that of an edited version and what they share.

    The edited text has the last half of the characters, rounded down, replaced
    by the first as many of the next document, in the order of doc_id; the last
    one is followed by the first. Columns: doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited and near_next, the likeness to
    the edited and to the next text. Null texts count as empty; two empty texts
    have likeness 1. Order of ties and null ids as in ``with_next``; a single
    row is followed by itself, further columns are ignored, and an empty table
    gives no rows.
    """
    return with_next(docs, _versions, VERSION_FIELDS)


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(table(spark, sf_dir, "documents"))


QUERIES = {"op11_fingerprints": op11_fingerprints}
