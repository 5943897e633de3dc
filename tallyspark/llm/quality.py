"""Quality classification by co-training a text view and a metadata view."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import cut, small_batches, table

#: Labelled documents that the fit sees at most, the first by a hash of their ids; each comes to the driver as at most CONTENT numbers.
MOST_LABELLED = 3000
ROUNDS = 3
#: Confidence from which a view hands a pseudo-label to the other one.
SURE = 0.95
#: Documents with a lower score are rejected.
KEEP = 0.5
LANGS = ("de", "en", "es", "fr")
#: Buckets that sources are hashed into.
SOURCES = 16
#: Principal axes of the labelled texts that the text view keeps.
AXES = 48
#: Share of the mean variance that is added to each variance.
RIDGE = 1e-3
#: Steps to a standard deviation and the largest deviation of stored features; whole numbers make sums exact in any order.
STEPS, FARTHEST = 512, 16


def _byte_classes() -> np.ndarray:
    """64 classes of bytes: one for each lower-case letter, punctuation mark and kind of white space, few for the others."""
    classes = np.full(256, 63, np.uint16)
    classes[0x61:0x7B] = np.arange(26)
    classes[0x41:0x5B] = 26
    classes[0x30:0x3A] = 27
    classes[[0x20, 0x0A]] = 28, 29
    marks = [c for c in range(0x21, 0x7F) if not chr(c).isalnum()]
    classes[marks] = 30 + np.arange(len(marks))
    classes[0x80:0xC0], classes[0xC0:] = 62, 62
    return classes


CLASSES = _byte_classes()
CONTENT = 64 * 64


def content_view(raw: bytes) -> np.ndarray:
    """Root frequencies of the pairs of neighbouring byte classes of a whole text."""
    at = CLASSES[np.frombuffer(raw, np.uint8)]
    counts = np.bincount(at[:-1] * 64 + at[1:], minlength=CONTENT) if len(at) > 1 else np.zeros(CONTENT)
    return np.sqrt(counts / max(1, len(at) - 1)).astype(np.float32)


def metadata_view(raw: bytes, lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Source, language, stated length and layout of a page: nothing of what its words are."""
    lines, words = raw.split(b"\n"), raw.split()
    at = CLASSES[np.frombuffer(raw, np.uint8)]
    n, n_words, n_lines = max(1, len(raw)), max(1, len(words)), len(lines)
    share = lambda hit: float(hit.sum()) / n
    counts = [math.log1p(max(0, n_chars or 0)), math.log1p(len(words)), math.log1p(n_lines), math.log1p(n / n_lines), len(raw) / n_words]
    repeats = [len(set(words)) / n_words, len(set(words)) / math.sqrt(n_words), len(set(lines)) / n_lines, max(map(len, lines)) / n]
    shares = [share(at == 26), share(at == 27), share((at >= 30) & (at < 62)), share(at == 28), math.sqrt(share((at >= 30) & (at < 62)))]
    of = zlib.crc32(source.encode("utf-8", "surrogatepass")) % SOURCES if source is not None else -1
    return np.array(counts + repeats + shares + [lang == x for x in LANGS] + [of == k for k in range(SOURCES)], np.float32)


class Scale(NamedTuple):
    """Turns features into whole steps of their deviation among the labelled rows."""

    mean: np.ndarray
    per: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Scale:
        spread = x.std(axis=0)
        return Scale(x.mean(axis=0), np.where(spread > 1e-6, STEPS / np.maximum(spread, 1e-6), 0.0))

    def steps(self, x: np.ndarray) -> np.ndarray:
        return np.rint(np.clip((x - self.mean) * self.per, -FARTHEST * STEPS, FARTHEST * STEPS)).astype(np.int16)


class Space(NamedTuple):
    """Both views' features: principal axes of the text view, with its entropy and its largest part, and the scales."""

    mean: np.ndarray
    axes: np.ndarray
    scales: tuple[Scale, Scale]

    @staticmethod
    def of(content: np.ndarray, metadata: np.ndarray) -> Space:
        mean = content.mean(axis=0, dtype=np.float64).astype(np.float32)
        axes = np.random.default_rng(8).normal(size=(CONTENT, AXES)).astype(np.float32)
        for _ in range(12):  # subspace iteration
            seen = content @ axes - mean @ axes
            axes = np.linalg.qr(content.T @ seen - np.outer(mean, seen.sum(axis=0)))[0]
        space = Space(mean, axes, ())
        return space._replace(scales=(Scale.of(space._content(content)), Scale.of(metadata)))

    def _content(self, own: np.ndarray) -> np.ndarray:
        out = np.empty((len(own), self.axes.shape[1] + 2))
        for k in range(0, len(own), 256):  # so that no large array is made beside the view
            some = own[k : k + 256]
            parts = some.astype(np.float64) ** 2
            out[k : k + 256, :-2] = some @ self.axes - self.mean @ self.axes
            out[k : k + 256, -2] = -(parts * np.log(parts + 1e-12)).sum(axis=1)
            out[k : k + 256, -1] = some.max(axis=1)
        return out

    def steps(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.scales[0].steps(self._content(content)), self.scales[1].steps(metadata)


class Linear(NamedTuple):
    weight: np.ndarray
    bias: float

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x @ self.weight + self.bias, -15, 15)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Sums(NamedTuple):
    """Of one view and class: rows, sums of features and sums of their products, as whole numbers or scaled."""

    n: float
    x: np.ndarray
    xx: np.ndarray

    @staticmethod
    def of(steps: np.ndarray) -> Sums:
        z = steps.astype(np.float64)
        return Sums(len(z), z.sum(axis=0), z.T @ z)

    def with_at_most(self, other: Sums) -> Sums:
        """These rows and all of the other ones, which together weigh as much as these at most."""
        part = min(1.0, self.n / other.n) if other.n else 0.0
        return Sums(self.n + part * other.n, self.x + part * other.x, self.xx + part * other.xx)


def discriminant(bad: Sums, good: Sums) -> Linear:
    """The linear discriminant of two classes with one covariance, from their sums."""
    a, b = bad.x / bad.n, good.x / good.n
    within = (bad.xx - np.outer(a, bad.x) + good.xx - np.outer(b, good.x)) / (bad.n + good.n)
    within += np.eye(len(a)) * (RIDGE * np.trace(within) / len(a) + 1e-6)
    weight = np.linalg.solve(within, b - a)
    return Linear(weight, float(-weight @ (a + b) / 2))


def calibrated(model: Linear, x: np.ndarray, y: np.ndarray) -> Linear:
    """The model with its odds rescaled to fit held-out rows: two numbers near a weak prior.

    The steps use the bound of the curvature, with which no step goes too far.
    """
    raw = model.odds(x)
    z, w, prior = np.stack([raw, np.ones_like(raw)], axis=1), np.array([1.0, 0.0]), np.array([1.0, 0.0])
    bound = np.linalg.inv(0.25 * z.T @ z + 0.05 * np.eye(2))
    for _ in range(500):
        w = w - bound @ (z.T @ (_sigmoid(z @ w) - y) + 0.05 * (w - prior))
    slope = float(max(w[0], 0.05))
    return Linear(model.weight * slope, model.bias * slope + float(w[1]))


@dataclass(frozen=True)
class Model:
    space: Space | None = None
    views: tuple[Linear, Linear] | None = None
    #: The log odds of the classes themselves, which both views' odds hold.
    share: float = 0.0

    def score(self, content: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        """A probability from the sum of both views' calibrated odds, as of views that are independent within a class; 0.5 of an unfitted model."""
        if self.space is None or self.views is None:
            return np.full(len(content), 0.5)
        one, other = (view.odds(x) for view, x in zip(self.views, self.space.steps(content, metadata), strict=True))
        return _sigmoid(one + other - self.share)


def _view_columns(docs: DataFrame) -> list:
    """text, lang, source and n_chars of ``docs``; those that it lacks are null."""
    kinds = {"text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    return [(F.col(c) if c in docs.columns else F.lit(None)).cast(k).alias(f"_{c}") for c, k in kinds.items()]


def _both(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Both views of a batch with the view columns."""
    raws = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in batch.column("_text")]
    rest = (batch.column(c).to_pylist() for c in ("_lang", "_source", "_n_chars"))
    found = [metadata_view(raw, *own) for raw, own in zip(raws, zip(*rest, strict=True), strict=True)]
    return np.stack([content_view(r) for r in raws]), np.stack(found)


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labels, with the text view's places that are not zero, what stands there, and the metadata."""
    for batch in batches:
        if batch.num_rows:
            content, metadata = _both(batch)
            places = [np.flatnonzero(row) for row in content]
            parts = [[at.astype(np.int16).tobytes() for at in places], [row[at].tobytes() for row, at in zip(content, places, strict=True)], [row.tobytes() for row in metadata]]
            yield pa.RecordBatch.from_arrays([batch.column("_quality"), *(pa.array(x, pa.binary()) for x in parts)], names=["quality", "places", "parts", "metadata"])


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text view, metadata view and labels of at most MOST_LABELLED documents, one row for each doc_id."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("_quality"))
    some = known.orderBy(F.xxhash64("doc_id", F.lit(8)), "doc_id").limit(MOST_LABELLED)
    rows = docs.select("doc_id", *_view_columns(docs)).join(some, "doc_id")
    rows = rows.groupBy("doc_id", "_quality").agg(F.min(F.struct("_text", "_lang", "_source", "_n_chars")).alias("_row")).select("doc_id", "_quality", "_row.*")
    found = small_batches(rows).mapInArrow(_labelled, "quality int, places binary, parts binary, metadata binary").collect()
    # In an order of their own, so that the split does not hang on partitions.
    found = sorted((r["quality"], bytes(r["metadata"]), bytes(r["places"]), bytes(r["parts"])) for r in found)
    content = np.zeros((len(found), CONTENT), np.float32)
    for own, (_, _, places, parts) in zip(content, found, strict=True):
        own[np.frombuffer(places, np.int16)] = np.frombuffer(parts, np.float32)
    metadata = np.stack([np.frombuffer(r[1], np.float32) for r in found]) if found else np.zeros((0, 0), np.float32)
    return content, metadata, np.array([r[0] for r in found], np.int64)


def _pool(docs: DataFrame, labels: DataFrame, space: Space) -> DataFrame:
    """The stored features of all documents without a label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                views = [pa.array([x.tobytes() for x in steps], pa.binary()) for steps in space.steps(*_both(batch))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *views], names=["doc_id", "content", "metadata"])

    known = labels.where(F.col("quality").isin(0, 1)).select("doc_id").distinct()
    kind = docs.schema["doc_id"].dataType.simpleString()
    views = small_batches(docs.select("doc_id", *_view_columns(docs))).mapInArrow(run, f"doc_id {kind}, content binary, metadata binary")
    return cut(views.join(known, "doc_id", "left_anti").select("content", "metadata"))


def _exchanged(pool: DataFrame, models: tuple[Linear, Linear]) -> list[list[Sums]]:
    """For each view and class: the sums over all documents to which the other view gives that class with confidence."""
    widths = [len(m.weight) for m in models]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [[(0, np.zeros(w, np.int64), np.zeros((w, w), np.int64)) for _ in (0, 1)] for w in widths]
        for batch in batches:
            xs = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int16).reshape(-1, w).astype(np.float64) for c, w in zip(("content", "metadata"), widths, strict=True)]
            for k, other in ((0, 1), (1, 0)):
                p = _sigmoid(models[other].odds(xs[other]))
                for label, sure in enumerate((p <= 1 - SURE, p >= SURE)):
                    n, x, xx = Sums.of(xs[k][sure])
                    old = total[k][label]
                    total[k][label] = old[0] + n, old[1] + x.astype(np.int64), old[2] + xx.astype(np.int64)
        flat = np.concatenate([np.concatenate([[n], x, xx.ravel()]) for view in total for n, x, xx in view]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat))], names=["part"])

    parts = pool.mapInArrow(run, "part array<long>").select(F.posexplode("part").alias("place", "part"))
    found = parts.groupBy("place").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()
    flat = np.zeros(sum(2 * (1 + w + w * w) for w in widths))
    for r in found:
        flat[r["place"]] = float(r["total"])
    out, at = [], 0
    for w in widths:
        out.append([])
        for _ in (0, 1):
            out[-1].append(Sums(flat[at], flat[at + 1 : at + 1 + w], flat[at + 1 + w : at + 1 + w + w * w].reshape(w, w)))
            at += 1 + w + w * w
    return out


def co_train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from ``docs`` and the rows of ``labels`` whose quality is 0 or 1.

    Each view is a linear discriminant, calibrated on every fourth labelled row
    of a class. In each round both views label all documents without a label;
    those that one is sure of are added to the other's classes, where they
    weigh as much as the labelled rows at most, however many they are. What a
    round brings to the driver are sums of a fixed number. Without both
    classes the model is unfitted and scores 0.5.
    """
    content, metadata, y = training_rows(docs, labels)
    hold = np.zeros(len(y), bool)
    for label in (0, 1):
        hold[np.flatnonzero(y == label)[::4]] = True
    if min(((y == k) & h).sum() for k in (0, 1) for h in (hold, ~hold)) < 2 if len(y) else True:
        return Model()
    space = Space.of(content[~hold], metadata[~hold])
    steps = space.steps(content, metadata)
    own = [[Sums.of(x[~hold & (y == label)]) for label in (0, 1)] for x in steps]

    def fitted(classes: list[list[Sums]]) -> tuple[Linear, Linear]:
        return tuple(calibrated(discriminant(*c), x[hold].astype(np.float64), y[hold]) for c, x in zip(classes, steps, strict=True))

    models, pool = fitted(own), _pool(docs, labels, space)
    for _ in range(ROUNDS):
        given = _exchanged(pool, models)
        models = fitted([[a.with_at_most(b) for a, b in zip(*view, strict=True)] for view in zip(own, given, strict=True)])
    return Model(space, models, math.log((y == 1).sum() / (y == 0).sum()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with quality_score, between 0 and 1; higher is better.

    Whole texts are read, with lang, source and n_chars where ``docs`` has
    them. A null text counts as empty, a null length as 0, and a language or
    source that is null as none. Repeated rows and null ids change nothing; a
    column called quality_score is replaced, others stay; an empty table gives
    no rows.
    """
    docs = docs.drop("quality_score")
    titles = docs.columns
    names = [f"c{k}" for k in range(len(titles))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.score(*_both(batch)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found.astype(np.float64))], names=[*names, "score"])

    fields = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema, strict=True))
    rows = docs.select(*(F.col(f"`{t}`").alias(n) for t, n in zip(titles, names, strict=True)), *_view_columns(docs))
    return small_batches(rows).mapInArrow(run, f"{fields}, score double").toDF(*titles, "quality_score")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that a model trained on ``labels`` does not reject."""
    return score(docs, co_train(docs, labels)).where(F.col("quality_score") >= KEEP).select(*docs.columns)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, co_train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.col("quality_score").alias("score"), (F.col("quality_score") >= KEEP).alias("keep"))


QUERIES = {"op8_quality": op8_quality}
