"""Spelling variants: words at distance one of each other, found by walking broadcast tries along Levenshtein automata."""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from math import ceil

import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import cut, small_batches, table

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in so many loses a character.
DROPPED = 31
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A word's form is at least so many times as frequent.
TIMES = 10
#: Words in a trie, about; a task builds one.
SHARD_WORDS = 500_000
#: Bytes that the tries of a broadcast take in a task, NODE_BYTES a node; further ones follow in rounds of their own.
BROADCAST_BYTES, NODE_BYTES = 256 << 20, 14


def words(docs: DataFrame) -> DataFrame:
    """(word, n): the words of all whole texts with their occurrences, of LEAST_LENGTH characters and LEAST_COUNT occurrences or more.

    A word is a run of letters with A-Z lowered, less the character at place
    h % length where DROPPED divides h, the crc32 of ``<doc_id>:<run>``. A null
    text has none, a null doc_id is written as nothing.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"({RUN})"), F.lit(1))).alias("run"))
    runs = runs.where(F.length("run") >= LEAST_LENGTH).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "utf-8"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    found = runs.withColumn("h", h).select(F.when(F.col("h") % DROPPED == 0, shorter).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


class Trie:
    """A trie of words of one length in flat arrays, level by level.

    ``label`` has each node's character, ``first`` where the children of each
    node above the last level begin, and ``n`` the occurrences of the words,
    which are the nodes of the last level in order. Children of neighbours are
    neighbours, too.
    """

    def __init__(self, length: int, label: str, children: array, n: array):
        self.length, self.label, self.n = length, label, n
        self.first = array("q", accumulate(children, initial=1))
        self.words = len(label) - len(n)

    @classmethod
    def pack(cls, rows: list[tuple[str, int]]) -> tuple[int, bytes]:
        """The number of nodes and the packed trie of (word, n): words of one length, each once, in order."""
        length, label, children = len(rows[0][0]), ["\0"], array("H")
        level = [(0, len(rows))]
        for depth in range(length):
            below = []
            for begin, end in level:
                count = 0
                while begin < end:
                    c, stop = rows[begin][0][depth], begin + 1
                    while stop < end and rows[stop][0][depth] == c:
                        stop += 1
                    label.append(c)
                    below.append((begin, stop))
                    begin, count = stop, count + 1
                children.append(count)
            level = below
        parts = ["".join(label).encode(), children.tobytes(), array("q", [n for _, n in rows]).tobytes()]
        head = b"".join(x.to_bytes(8, "little") for x in (length, len(parts[0]), len(parts[1])))
        return len(label), zlib.compress(head + b"".join(parts))

    @classmethod
    def unpack(cls, packed: bytes) -> Trie:
        raw = zlib.decompress(packed)
        length, a, b = (int.from_bytes(raw[k : k + 8], "little") for k in (0, 8, 16))
        children, n = array("H"), array("q")
        children.frombytes(raw[24 + a : 24 + a + b])
        n.frombytes(raw[24 + a + b :])
        return cls(length, raw[24 : 24 + a].decode(), children, n)

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        """(neighbour, n) of the words at distance one, depth first along the word's automaton.

        The lengths say which edit it is. The automaton is in one of two states:
        so far all equal, or edit spent, when the path must spell what is left
        of the word. At each node where all is equal the edit is spent on every
        child that it may be, and each of these branches is followed down until
        a character is missing; children of all of them that begin the rest are
        looked up at once, as they are neighbours.
        """
        more = self.length - len(word)
        if not -1 <= more <= 1:
            return
        label, first, find, size = self.label, self.first, self.label.find, len(word)
        node = 0
        for depth in range(size + 1):
            own = word[depth] if depth < size else ""
            if more < 0:
                # A character less: of equal ones in a row only the last is left out.
                if own and word[depth + 1 : depth + 2] != own:
                    at = self._spelt(node, word, depth + 1)
                    if at >= 0:
                        yield self._word(at)
            elif own or more:
                begin, end = first[node], first[node + 1]
                rest = depth + 1 - more
                if rest == size:
                    # Nothing is left to spell: the children are words.
                    for at in range(begin, end):
                        if label[at] != own:
                            yield self._word(at)
                else:
                    same = find(own, begin, end) if own else -1
                    skip = (first[same], first[same + 1]) if same >= 0 else (-1, -1)
                    low, high, c = first[begin], first[end], word[rest]
                    at = find(c, low, high)
                    while at >= 0:
                        if not skip[0] <= at < skip[1]:
                            got = self._spelt(at, word, rest + 1)
                            if got >= 0:
                                yield self._word(got)
                        at = find(c, at + 1, high)
            if not own or depth == self.length:
                break
            node = find(own, first[node], first[node + 1])
            if node < 0:
                break

    def _spelt(self, node: int, word: str, at: int) -> int:
        """The node that the word's characters from ``at`` lead to, or -1."""
        first, find = self.first, self.label.find
        for k in range(at, len(word)):
            node = find(word[k], first[node], first[node + 1])
            if node < 0:
                return -1
        return node

    def _word(self, node: int) -> tuple[str, int]:
        n, out = self.n[node - self.words], []
        while node:
            out.append(self.label[node])
            node = bisect_right(self.first, node) - 1
        return "".join(reversed(out)), n


def shards(vocabulary: DataFrame, count: int) -> DataFrame:
    """(shard, length, bytes, trie): packed tries of one word length each, over ranges of about SHARD_WORDS words by length and word, and what they take unpacked.

    ``count`` is the number of words of ``vocabulary``.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length: dict[int, list[tuple[str, int]]] = {}
        for b in batches:
            for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True):
                by_length.setdefault(len(w), []).append((w, n))
        for length, rows in by_length.items():
            rows.sort()
            nodes, packed = Trie.pack(rows)
            columns = [pa.array([f"{length:09d} {rows[0][0]}"]), pa.array([length], pa.int32()), pa.array([nodes * NODE_BYTES], pa.int64()), pa.array([packed], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "length", "bytes", "trie"])

    parts = ceil(count / SHARD_WORDS)
    dealt = vocabulary.withColumn("length", F.length("word")).repartitionByRange(parts, "length", "word").coalesce(parts)
    return dealt.select("word", "n").mapInArrow(build, "shard string, length int, bytes long, trie binary")


def _walk(vocabulary: DataFrame, tries: Broadcast) -> DataFrame:
    """(word, n_near, best): each word's neighbours in the broadcast tries, counted, with the most frequent one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list[Trie]] = {}
        for t in tries.value:
            trie = Trie.unpack(t)
            own.setdefault(trie.length, []).append(trie)
        for batch in batches:
            rows = []
            for word in batch.column("word").to_pylist():
                count, best = 0, (0, "")
                # Tries of other lengths leave the automaton no state.
                for length in (len(word) - 1, len(word), len(word) + 1):
                    for trie in own.get(length, ()):
                        for other, n in trie.near(word):
                            count += 1
                            best = min(best, (-n, other))
                if count:
                    rows.append((word, count, -best[0], best[1]))
            if rows:
                kinds = pa.string(), pa.int64(), pa.int64(), pa.string()
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["word", "n_near", "best_n", "best"])

    return small_batches(vocabulary.select("word")).mapInArrow(run, "word string, n_near long, best_n long, best string")


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words of ``vocabulary`` (word, n; each word once) that have others at distance one.

    best is the most frequent of them, the smallest in code-point order of
    equals. Every word walks every shard. Shards are broadcast up to
    BROADCAST_BYTES at once; the driver holds no more of them at a time, and a
    larger vocabulary takes further rounds over the words.
    """
    spark, count = vocabulary.sparkSession, vocabulary.count()
    if not count:
        return vocabulary.select("word", *(F.lit(None).cast(t).alias(c) for c, t in (("n_near", "long"), ("best_n", "long"), ("best", "string"))))
    built = cut(shards(vocabulary, count))
    rounds: list[list[str]] = []
    room = 0
    for shard, size in sorted(tuple(r) for r in built.select("shard", "bytes").collect()):
        if size > room:
            rounds.append([])
            room = BROADCAST_BYTES
        rounds[-1].append(shard)
        room -= size
    found = None
    # Walking is the work, not reading: tasks of about a tenth of a shard's words.
    dealt = vocabulary.repartition(max(spark.sparkContext.defaultParallelism, ceil(10 * count / SHARD_WORDS)), "word")
    for names in rounds:
        tries = spark.sparkContext.broadcast([bytes(r["trie"]) for r in built.where(F.col("shard").between(names[0], names[-1])).select("trie").collect()])
        some = cut(_walk(dealt, tries))
        found = some if found is None else found.unionByName(some)
    best = F.min(F.struct((-F.col("best_n")).alias("rank"), "best")).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.rank")).alias("best_n"), "b.best")


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of ``links`` (word, form): the last form of each chain, by doubling; forms are more frequent than their words, so chains end."""
    at = cut(links.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        after = cut(at.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        at = after.select("word", "root")
        if not after.where("_moved").limit(1).count():
            return at


def variants(docs: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each word of ``words(docs)``.

    Words are near that differ by one inserted, deleted or replaced character.
    The form is the most frequent near word (the first of equals) if it has
    TIMES the word's occurrences; root is where following forms ends, the word
    itself without one. Repeated rows count, further columns are ignored, texts
    without words and empty tables give no rows.
    """
    vocabulary = cut(words(docs))
    near = neighbours(vocabulary)
    rows = vocabulary.join(near, "word", "left").withColumn("_has", F.coalesce(F.col("best_n") >= TIMES * F.col("n"), F.lit(False)))
    rows = cut(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("_has"), F.col("best")).alias("form"), F.when(F.col("_has"), F.col("best_n")).alias("form_n")))
    ends = roots(rows.where("form IS NOT NULL"))
    return rows.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {"op12_spelling": op12_spelling}
