"""Quality classifier: random Fourier features and isotonic calibration.

Statistics of a text are standardised and mapped to random Fourier features,
whose inner products approximate a Gaussian kernel.  Ridge scores come from
normal equations summed over partitions, so the driver solves a system of fixed
size whatever the number of labels.  Each fold's sums are kept apart: models
without one fold score that fold, and isotonic regression on those honest
scores makes probabilities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.common import materialize

FOURIER = 192
WIDTH = 3.5  # of the Gaussian kernel, in standard deviations
RIDGE = 1.0
FOLDS = 4
STEPS = 256  # score bins that isotonic regression sees
THRESHOLD = 0.3
MEETS = 16
SEED = 20

_CLASSES = ["upper", "lower", "digit", "space", "line", "wide", "stop", "bar", "bang", "symbol", "quote", "other"]


def _class_table() -> np.ndarray:
    """256 x classes: which byte counts for which class."""
    table = np.zeros((256, len(_CLASSES)), np.float64)
    for b in range(256):
        c = chr(b)
        kind = (
            "wide" if b >= 128 else "upper" if c.isupper() else "lower" if c.islower() else "digit" if c.isdigit() else "line" if c == "\n"
            else "space" if c in " \t\r\v\f" else "stop" if c in ".,;:?" else "bar" if c == "|" else "bang" if c == "!"
            else "symbol" if c in "#$%&*@^~+=<>/\\_{}[]" else "quote" if c in "'\"()-`" else "other"
        )
        table[b, _CLASSES.index(kind)] = 1
    return table


_TABLE = _class_table()
STATISTICS = [f"share_{c}" for c in _CLASSES] + [
    "log_words", "word_mean", "word_spread", "word_longest", "distinct_words", "top_word", "odd_words",
    "caps_words", "line_mean", "repeated_lines", "byte_entropy", "sentence_mean",
]
_ODD = re.compile(r"[^\W\d_]+[!#$%&*|]{2,}|\|")


def statistics(text: str | None) -> list[float]:
    """The numbers that describe a text; all 0 but for defined shares if it is
    null or blank."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(np.float64)
    n = max(1.0, hist.sum())
    shares = hist @ _TABLE / n
    words = text.split()
    count = len(words)
    if not count:
        return [*shares.tolist(), *[0.0] * 12]
    sizes = np.fromiter(map(len, words), np.int64, count)
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = text.split("\n")
    p = hist[hist > 0] / n
    caps = sum(map(str.isupper, words))
    odd = len(_ODD.findall(text))
    ends = text.count(".") + text.count("?") + text.count("!")
    return [
        *shares.tolist(),
        float(np.log1p(count)),
        float(sizes.mean()),
        float(sizes.std()),
        float(np.log1p(sizes.max())),
        len(seen) / count,
        max(seen.values()) / count,
        odd / count,
        caps / count,
        float(np.log1p(count / len(lines))),
        1 - len(set(lines)) / len(lines),
        float(-(p * np.log2(p)).sum()),
        float(np.log1p(count / (ends + 1))),
    ]


def describe(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and the array ``stats`` of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [x for t in batch.column(0) for x in statistics(t.as_py())]
            width = len(STATISTICS)
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * width)
            stats = pa.ListArray.from_arrays(offsets, pa.array(flat, pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], stats], [*keep, "stats"])

    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("stats", T.ArrayType(T.DoubleType()))])
    return docs.select("text", *keep).mapInArrow(run, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


class Kernel:
    """Standardisation and a fixed random map, the same on every machine."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int = FOURIER, width: float = WIDTH, seed: int = SEED):
        made = np.random.Generator(np.random.PCG64(seed))
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.tilt = made.normal(size=(len(mean), features)) / width
        self.shift = made.uniform(0, 2 * np.pi, features)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.spread, -6, 6)
        wave = np.cos(x @ self.tilt + self.shift) * np.sqrt(2 / len(self.shift))
        return np.hstack([wave, x, np.ones((len(x), 1))])


def _sums(rows: DataFrame, kernel: Kernel, folds: int) -> np.ndarray:
    """For each fold the sums of z z', z y and 1, as one flat array."""
    size = len(kernel.shift) + len(kernel.mean) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((folds, size, size + 1))
        for batch in batches:
            z = kernel(_matrix(batch.column(0)))
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            fold = batch.column(2).to_numpy(zero_copy_only=False)
            for k in range(folds):
                own = z[fold == k]
                sums[k] += own.T @ np.hstack([own, y[fold == k, None]])
        yield pa.RecordBatch.from_pydict({"sums": pa.array([sums.tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_ = 0, False
        for batch in batches:
            for part in batch.column(0):
                total, any_ = total + np.frombuffer(part.as_py()), True
        if any_:
            yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})

    parts = rows.select("stats", "y", "fold").mapInArrow(count, "sums binary")
    total = np.zeros(folds * size * (size + 1))
    for (part,) in parts.repartition(MEETS // 4).mapInArrow(add, "sums binary").toLocalIterator():
        total += np.frombuffer(part)
    return total.reshape(folds, size, size + 1)


def _solve(sums: np.ndarray, ridge: float) -> np.ndarray:
    size = len(sums)
    weight = np.full(size, ridge)
    weight[-1] = 1e-9  # the constant is not shrunk
    return np.linalg.solve(sums[:, :-1] + np.diag(weight), sums[:, -1])


def isotonic(scores: list[float], means: list[float], weights: list[float]) -> tuple[list[float], list[float]]:
    """Knots of the non-decreasing fit, by pooling adjacent violators."""
    pools: list[list[float]] = []
    for s, m, w in sorted(zip(scores, means, weights)):
        pools.append([s * w, m * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return [p[0] / p[2] for p in pools], [p[1] / p[2] for p in pools]


class Model:
    def __init__(self, kernel: Kernel | None, weights: np.ndarray | None, knots: tuple[list[float], list[float]]):
        self.kernel, self.weights, self.knots = kernel, weights, knots

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        if self.kernel is None:
            return np.full(len(stats), self.knots[1][0])
        return np.clip(np.interp(self.kernel(stats) @ self.weights, *self.knots), 0, 1)


def fit(labelled: DataFrame) -> Model:
    """A model from rows ``stats``, ``y`` (0 or 1) and ``fold``; all rows count.

    Without any label it says 0.5 for every text, with labels of one kind
    that label's share after smoothing.
    """
    base = labelled.agg(F.count(F.lit(1)), F.sum("y")).first()
    if not base[0] or not 0 < (base[1] or 0) < base[0]:
        return Model(None, None, ([0.0], [((base[1] or 0) + 1) / (base[0] + 2)]))
    width = len(STATISTICS)
    each = [F.get("stats", i) for i in range(width)]
    row = labelled.agg(*[F.avg(c) for c in each], *[F.stddev_pop(c) for c in each]).first()
    kernel = Kernel(np.array(row[:width]), np.array(row[width:]))
    sums = _sums(labelled, kernel, FOLDS)
    whole = sums.sum(0)
    without = [_solve(whole - s, RIDGE) for s in sums]
    honest = np.array(without)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = batch.column(2).to_numpy(zero_copy_only=False)
            s = np.einsum("ij,ij->i", kernel(_matrix(batch.column(0))), honest[fold])
            at = np.clip(np.floor(np.clip(s, -0.5, 1.5) * (STEPS / 2)), -STEPS, STEPS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(s), batch.column(1)], ["at", "s", "y"])

    scored = labelled.select("stats", "y", "fold").mapInArrow(score, "at long, s double, y int")
    bins = scored.groupBy("at").agg(F.avg("s").alias("s"), F.avg("y").alias("m"), F.count(F.lit(1)).alias("w")).collect()
    return Model(kernel, _solve(whole, RIDGE), isotonic(*map(list, zip(*[(b.s, b.m, float(b.w)) for b in bins]))))


def apply(rows: DataFrame, model: Model, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns, ``score`` and ``predicted`` of rows with ``stats``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model(_matrix(batch.column(0)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*keep, "score", "predicted"])

    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return rows.select("stats", *keep).mapInArrow(run, schema)


def held_out():
    """If a document's label is never learned: crc32 of its id as text, modulo 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def learn(described: DataFrame, labels: DataFrame) -> Model:
    """A model from described documents (``doc_id, stats``) that are not held
    out and have a label; of repeated labels the lowest counts."""
    one = labels.filter(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")
    rows = described.filter(~held_out()).join(one, "doc_id").select("stats", "y", fold.alias("fold"))
    return fit(materialize(rows, "labelled"))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document.

    ``score`` is the probability of label 1, ``predicted`` 1 from a score of
    0.3 on.  Null and blank texts are scored from their statistics like any
    other.  Extra columns are not read; an empty table gives an empty result.
    """
    described = materialize(describe(docs.select("doc_id", "text"), ["doc_id"]), "described")
    model = learn(described, labels.select("doc_id", "quality"))
    return apply(described.withColumn("held_out", held_out()), model, ["doc_id", "held_out"])


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all its columns, whose score is at least
    ``threshold``.  The text is read once to learn and once to decide."""
    described = describe(docs.select("doc_id", "text"), ["doc_id"])
    model = learn(described, labels.select("doc_id", "quality"))
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = np.array([statistics(t.as_py()) for t in batch.column(at)]).reshape(-1, len(STATISTICS))
            yield batch.filter(pa.array(model(stats) >= threshold))

    return docs.mapInArrow(run, docs.schema)
