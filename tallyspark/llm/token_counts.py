"""Token counts by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import small_batches, table

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Pre-tokens whose counts a task remembers; it then forgets them all, which changes no result.
REMEMBERED = 500_000
#: Symbols merged at once.
AT_ONCE = 400_000
#: Bytes from which a pre-token is merged by itself, by its changed places only, and is not remembered.
LONG = 128
NONE = np.iinfo(np.int32).max


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 as itself, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merger:
    """Counts the symbols that a byte-pair vocabulary leaves of pre-tokens."""

    def __init__(self, model: dict) -> None:
        vocabulary, merges, end = model["vocab"], model["merges"], model["end_of_word_suffix"] or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.width = max(vocabulary.values()) + 1
        left, right, made = (np.array([vocabulary[x] for x in part], np.int64) for part in zip(*((a, b, a + b) for a, b in pairs), strict=True))
        key = left * self.width + right
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order.astype(np.int32), made[order]
        self.inner = np.array([vocabulary[x] for x in byte_letters()], np.int64)
        self.last = np.array([vocabulary[x + end] for x in byte_letters()], np.int64)

    def count(self, words: list[str]) -> list[int]:
        """The number of tokens of each pre-token; none of them is empty."""
        raws = [w.encode() for w in words]
        out = np.zeros(len(raws), np.int64)
        short = [k for k, raw in enumerate(raws) if len(raw) < LONG]
        begin = 0
        while begin < len(short):
            size, stop = 0, begin
            while stop < len(short) and size < AT_ONCE:
                size += len(raws[short[stop]])
                stop += 1
            out[short[begin:stop]] = self._count([raws[k] for k in short[begin:stop]])
            begin = stop
        for k, raw in enumerate(raws):
            if len(raw) >= LONG:
                out[k] = self._count_long(raw)
        return out.tolist()

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair of symbols, NONE if it does not merge, and its place in the table."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NONE), at

    def _count_long(self, word: bytes) -> int:
        """As _count, for one long pre-token: each pass takes the places of the lowest rank and looks at their neighbours only."""
        n = len(word)
        symbols = self.inner[np.frombuffer(word, np.uint8)]
        symbols[-1] = self.last[word[-1]]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank, made = np.full(n, NONE, np.int32), np.zeros(n, np.int64)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def look(places: np.ndarray) -> None:
            """Enter the pairs that begin at these places, and have a right side, under their ranks."""
            found, at = self._pairs(symbols[places], symbols[after[places]])
            rank[places], made[places] = found, self.made[at]
            order = np.argsort(found, kind="stable")
            order = order[found[order] != NONE]
            for group in np.split(order, np.flatnonzero(np.diff(found[order])) + 1) if len(order) else ():
                r = int(found[group[0]])
                if r not in waiting:
                    waiting[r] = []
                    heappush(ranks, r)
                waiting[r].append(places[group])

        look(np.arange(n - 1))
        left = n
        while ranks:
            r = heappop(ranks)
            where = np.unique(np.concatenate(waiting.pop(r)))
            where = where[rank[where] == r]
            if len(where) > 1:
                touching = after[where[:-1]] == where[1:]
                if touching.any():
                    # Of overlapping pairs every second one merges, from the left.
                    first = np.concatenate([[True], ~touching])
                    offset = np.arange(len(where)) - np.flatnonzero(first)[np.cumsum(first) - 1]
                    where = where[offset % 2 == 0]
            if not len(where):
                continue
            gone = after[where]
            symbols[where], rank[gone], rank[where] = made[where], NONE, NONE
            after[where] = after[gone]
            inside = after[where] < n
            before[after[where[inside]]] = where[inside]
            left -= len(where)
            look(np.unique(np.concatenate([where[inside], before[where[before[where] >= 0]]])))
        return left

    def _count(self, words: list[bytes]) -> np.ndarray:
        sizes = np.array([len(w) for w in words], np.int64)
        symbols = self.inner[np.frombuffer(b"".join(words), np.uint8)]
        ends = np.cumsum(sizes)
        symbols[ends - 1] = self.last[np.frombuffer(b"".join(words), np.uint8)[ends - 1]]
        owner = np.repeat(np.arange(len(words)), sizes)
        out = np.zeros(len(words), np.int64)
        while len(symbols):
            rank = np.full(len(symbols), NONE, np.int32)
            found, at = self._pairs(symbols[:-1], symbols[1:])
            rank[:-1] = np.where(owner[:-1] == owner[1:], found, NONE)
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            sizes = np.diff(np.append(starts, len(owner)))
            lowest = np.minimum.reduceat(rank, starts)
            going = lowest != NONE
            out[owner[starts[~going]]] = sizes[~going]
            hit = (rank == np.repeat(lowest, sizes)) & (rank != NONE)
            # Of overlapping pairs, as in a run of one letter, every second one merges, from the left.
            where = np.flatnonzero(hit)
            if len(where) > 1 and (np.diff(where) == 1).any():
                first = np.concatenate([[True], np.diff(where) > 1])
                offset = np.arange(len(where)) - np.flatnonzero(first)[np.cumsum(first) - 1]
                where = where[offset % 2 == 0]
            symbols[where] = self.made[at[where]]
            stay = np.repeat(going, sizes)
            stay[where + 1] = False
            symbols, owner = symbols[stay], owner[stay]
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from whole texts to their token counts, for a vocabulary file of the tokenizers library with byte-level BPE.

    The file's normaliser runs as it is, and its pre-token pattern is read from
    the file; the merging is done here. Special strings inside texts are one
    token each, as is the library's default.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        config = json.load(file)
    merger, normal = Merger(config["model"]), Tokenizer.from_file(path).normalizer.normalize_str
    pattern = next(p["pattern"]["Regex"] for p in config["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"), regex.V0).findall
    special = [regex.escape(t["content"]) for t in config["added_tokens"] if t["special"]]
    specials = regex.compile("|".join(special)) if special else None
    known: dict[str, int] = {}

    def count(texts: list[str]) -> list[int]:
        if len(known) > REMEMBERED:
            known.clear()
        out, split = [], []
        for text in texts:
            parts = specials.split(text) if specials else [text]
            out.append(len(parts) - 1)
            split.append([w for part in parts if part for w in pieces(normal(part))])
        new = list({w for words in split for w in words if w not in known})
        found = dict(zip(new, merger.count(new), strict=True))
        known.update((w, n) for w, n in found.items() if len(w) < LONG)
        return [n + sum(known[w] if w in known else found[w] for w in words) for n, words in zip(out, split, strict=True)]

    return count


#: Characters whose texts are counted together.
BATCH_CHARS = 2_000_000


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for each row of ``docs``: UTF-8 bytes and tokens of its whole text.

    ``path`` names a vocabulary file that every executor has. A null text counts
    as empty; repeated rows, null ids and further columns change nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            found: list[int] = []
            some: list[str] = []
            size = 0
            for x in batch.column("text"):
                some.append(x.as_py() or "")
                size += len(some[-1])
                if size > BATCH_CHARS:
                    found += count(some)
                    some, size = [], 0
            found += count(some)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(found, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return small_batches(docs.select("doc_id", "text", n_bytes)).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)


QUERIES = {"op7_token_counts": op7_token_counts}
