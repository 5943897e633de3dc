"""Toxicity by compression distance to two zstandard dictionaries."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import small_batches, table

#: Labelled documents of each class that the dictionaries and the calibration see at most, the first by a hash of their ids.
MOST_LABELLED = 2500
#: A window is one word, with each byte of it twice over, as zstandard finds no matches in windows of a few bytes.
STRETCH = 2
PAD = b"~" * 9
#: Toxic words stand in the toxic dictionary if so many toxic documents hold them, and at so many times the ordinary rate.
LEAST_DOCUMENTS, LEAST_RATIO = 3, 6.0
TRAINED_BYTES, ORDINARY_BYTES, TOXIC_BYTES = 16_384, 1_000_000, 64_000
LEVEL = 12
#: Scores from here on count as toxic.
THRESHOLD = 0.7
#: Windows whose gains a task remembers before it forgets them all.
REMEMBERED = 500_000
WORDS = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def words(text: str | None) -> list[bytes]:
    """The letter runs of a whole text, letters folded."""
    return WORDS.findall((text or "").lower().encode("utf-8", "surrogatepass"))


def stretched(word: bytes) -> bytes:
    out = bytearray(STRETCH * len(word))
    for k in range(STRETCH):
        out[k::STRETCH] = word
    return b"\n%b\n" % out


def _joined(ranked: list[bytes], most: int) -> bytes:
    """The first of the ranked words that fit, the first of all last, where zstandard reaches it by the shortest offset."""
    out, size = [], 0
    for word in ranked:
        piece = stretched(word)
        size += len(piece)
        if size > most:
            break
        out.append(piece)
    return b"".join(reversed(out))


@dataclass(frozen=True)
class Model:
    """The dictionaries, the gain in bytes from which a window counts, and the calibration from a document's evidence to its score."""

    ordinary: bytes
    toxic: bytes
    least_gain: int
    power: float
    slope: float
    middle: float

    def gains(self) -> Callable[[list[bytes]], np.ndarray]:
        """A function from windows to the bytes that the toxic dictionary saves against the ordinary one, on each window."""
        return _gains(self.ordinary, self.toxic)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (evidence - self.middle), -40, 40)))


@lru_cache(maxsize=1)
def _gains(*contents: bytes) -> Callable[[list[bytes]], np.ndarray]:
    settings = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, window_log=20, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS
    )
    packers = []
    for content in contents:
        dictionary = zstandard.ZstdCompressionDict(content)
        dictionary.precompute_compress(compression_params=settings)
        packers.append(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings).compress)
    one, other = packers
    known: dict[bytes, int] = {}

    def gains(windows: list[bytes]) -> np.ndarray:
        if len(known) > REMEMBERED:
            known.clear()
        for word in {word for word in windows if word not in known}:
            text = stretched(word) + PAD
            known[word] = len(one(text)) - len(other(text))
        return np.fromiter(map(known.__getitem__, windows), np.int64, len(windows))

    return gains


def evidence(gains: np.ndarray, n: int, least: int, power: float) -> float:
    """Windows with the gain, over a power of the number n of all windows; nothing for a text without any."""
    return float((gains >= least).sum() / n**power) if n else 0.0


def _train_dictionary(samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(TRAINED_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on
        return b""


def _calibrate(found: np.ndarray, toxic: np.ndarray) -> tuple[float, float, float]:
    """(F1, slope, middle): the cut with the best F1 scores THRESHOLD, and twice it about 0.97."""
    cuts = np.unique(found[found > 0])
    best, cut = 0.0, 1.0
    for at in cuts:
        hit = found >= at
        f1 = 2 * (hit & toxic).sum() / max(1, hit.sum() + toxic.sum())
        if f1 > best:
            best, cut = float(f1), float(at)
    below = found[(found < cut)]
    cut = (cut + (below.max() if len(below) else 0.0)) / 2 or cut / 2
    odds = math.log(THRESHOLD / (1 - THRESHOLD))
    slope = (3.5 - odds) / cut
    return best, slope, cut - odds / slope


def _dictionaries(split: list[tuple[list[bytes], bool]]) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary: trained on ordinary windows, then the ordinary words, and for the toxic one the words of toxic text."""
    in_toxic, in_ordinary, often = Counter(), Counter(), Counter()
    for found, label in split:
        (in_toxic if label else in_ordinary).update(set(found))
        if not label:
            often.update(found)
    n_toxic = sum(label for _, label in split)
    n_ordinary = len(split) - n_toxic
    # Copies of a document repeat a word after the same word; that is no further evidence.
    after = Counter(w for _, w in {pair for found, label in split if label for pair in zip([b"", *found], found, strict=False)})
    in_toxic = Counter({w: min(n, after[w]) for w, n in in_toxic.items()})
    ratio = {w: ((n + 0.5) / max(1, n_toxic)) / ((in_ordinary[w] + 0.5) / max(1, n_ordinary)) for w, n in in_toxic.items() if n >= LEAST_DOCUMENTS}
    rich = sorted((w for w, r in ratio.items() if r >= LEAST_RATIO), key=lambda w: (-in_toxic[w], w))
    ordinary_words = sorted(often.keys() - set(rich), key=lambda w: (-often[w], w))
    windows = [found[k : k + 8] for found, label in split if not label for k in range(0, len(found), 8)]
    samples = [b"".join(map(stretched, window)) for window in windows[:: max(1, len(windows) // 20_000)]]
    base = _train_dictionary(samples) + _joined(ordinary_words, ORDINARY_BYTES)
    return base, base + _joined(rich, TOXIC_BYTES)


def train(sample: list[tuple[str | None, int]]) -> Model:
    """A model from (text, label) rows; with one class only, or none, it finds nothing toxic.

    The calibration comes from every third row, scored by dictionaries of the
    others; the dictionaries that are kept come from all rows.
    """
    split = [(words(text), bool(label)) for text, label in sample]
    base, toxic = _dictionaries([x for k, x in enumerate(split) if k % 3])
    unfit = Model(base, toxic, 1, 0.5, 1.0, 1e9)
    if not base or base == toxic or len({label for _, label in split}) < 2:
        return unfit
    gains = unfit.gains()
    judged = [(gains(found), len(found), label) for k, (found, label) in enumerate(split) if k % 3 == 0]
    labels = np.array([label for *_, label in judged])
    fits = []
    for least in range(4, 20):
        for power in (0.0, 0.25, 0.5, 0.75):
            f1, slope, middle = _calibrate(np.array([evidence(g, n, least, power) for g, n, _ in judged]), labels)
            fits.append((f1, -least, power, slope, middle))
    _, least, power, slope, middle = max(fits)
    return Model(*_dictionaries(split), -least, power, slope, middle)


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> list[tuple[str | None, int]]:
    """At most ``most`` labelled rows of each class outside the held-out third, the first by a hash of their ids."""
    learn = labels.where(~held_out() & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("_toxic")).dropDuplicates(["doc_id"])
    order = F.xxhash64("doc_id")
    some = learn.where("_toxic = 1").orderBy(order).limit(most).unionByName(learn.where("_toxic = 0").orderBy(order).limit(most))
    rows = docs.join(some, "doc_id").select("doc_id", "text", "_toxic").collect()
    return [(r["text"], r["_toxic"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"] or ""))]


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, n_windows, n_toxic) for each row of ``docs``.

    Each window of the whole text is compressed with either dictionary; windows
    that the toxic one saves ``least_gain`` bytes on count as toxic. Null texts
    and texts without letters score as no evidence does. Repeated rows, null ids
    and further columns change nothing; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = model.gains()
        for batch in batches:
            split = [words(x.as_py()) for x in batch.column("text")]
            per_text = [gains(w) for w in split]
            found = np.array([evidence(g, len(w), model.least_gain, model.power) for g, w in zip(per_text, split, strict=True)])
            counts = [pa.array(map(len, split), pa.int64()), pa.array([int((g >= model.least_gain).sum()) for g in per_text], pa.int64())]
            columns = [batch.column("doc_id"), pa.array(model.score(found)), *counts]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "n_windows", "n_toxic"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, score double, n_windows long, n_toxic long")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(training_rows(docs, table(spark, sf_dir, "labels")))
    scored = score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_windows", "n_toxic")


QUERIES = {"op3_toxicity": op3_toxicity}
