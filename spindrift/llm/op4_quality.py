"""Quality classifier: naive Bayes support vectors.

A text is a set of hashed n-grams (indicators).  Each is scaled by the log of
the ratio of its class counts, and a linear hinge-loss model is fitted on the
scaled indicators by dual coordinate descent.  Class counts come from all
training rows in a Spark aggregation; the fit takes a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm.common import slices, written

#: Buckets of n-grams: the length of every vector, whatever the corpus.
BITS = 16
#: Byte n-grams by order, and marks of character classes.
ORDERS = (1, 2, 3)
#: Rows of each class that the fit sees.
MAX_FIT_ROWS = 4_000
SMOOTHING = 1.0
COST = 0.05
EPOCHS = 12
SEED = 7
THRESHOLD = 0.3

_SHAPE = np.full(256, 9, np.uint8)
for _chars, _class in ((b" ", 0), (b"\n", 1), (b"\t\r\x0b\x0c", 0), (bytes(range(48, 58)), 2), (bytes(range(65, 91)), 3), (bytes(range(97, 123)), 4), (b".,;:'\"()-", 5), (b"!?", 6), (b"#$%&*@|~^_=+<>/\\[]{}", 7), (bytes(range(128, 256)), 4)):
    _SHAPE[list(_chars)] = _class


def features(text: str | None) -> np.ndarray:
    """Sorted buckets of a text's indicators.

    Byte n-grams of the whole text, n-grams of its character classes, and the
    shares of distinct words, of words that repeat the last one and of each character class in steps, which tell
    repeated or marked-up text from prose at any length.
    """
    raw = (text or "").encode("utf-8")
    a = np.frombuffer(raw, np.uint8)
    size, marks = 1 << BITS, []
    present = np.zeros(size, bool)
    for n in ORDERS:
        if len(a) >= n:
            h = np.full(len(a) - n + 1, n, np.uint32)
            for i in range(n):
                h = h * np.uint32(0x01000193) + a[i : len(a) - n + 1 + i]
            present[(h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)] = True
    shape = _SHAPE[a].astype(np.uint32)
    for n in (3, 5):
        if len(a) >= n:
            h = np.full(len(a) - n + 1, 100 + n, np.uint32)
            for i in range(n):
                h = h * np.uint32(10) + shape[i : len(a) - n + 1 + i]
            present[(h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)] = True
    words = raw.split()
    if words:
        counts = np.bincount(shape, minlength=10) / len(a)
        marks += [(1, min(12, int(12 * len(set(words)) / len(words))), min(5, len(words).bit_length() // 2))]
        marks += [(2 + c, min(20, int(40 * counts[c])), 0) for c in range(10)]
        marks += [(23, min(10, int(20 * sum(a == b for a, b in zip(words, words[1:])) / len(words))), 0)]
        marks += [(20, min(15, int(len(a) / len(words))), 0), (21, len(words).bit_length(), 0)]
    else:
        marks += [(22, 0, 0)]
    for kind, step, more in marks:
        present[(kind * 7919 + step * 104729 + more * 1299709) * 2654435761 % (1 << 32) >> (32 - BITS)] = True
    return np.flatnonzero(present).astype(np.int32)


@dataclass
class Model:
    """Weights of indicators, already times their log-count ratios."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, at: np.ndarray) -> float:
        return float(self.weights[at].sum() / np.sqrt(max(1, len(at))) + self.bias)

    def score(self, at: np.ndarray) -> float:
        z = np.clip(self.slope * self.margin(at) + self.shift, -30, 30)
        return float(1 / (1 + np.exp(-z)))


def class_counts_and_sample(train: DataFrame, max_fit_rows: int) -> DataFrame:
    """``y``, ``bucket``, ``n``, ``bits`` in one pass over the training texts.

    Rows with a ``bucket`` count the rows of a class, in one task, that hold the
    indicator; all training rows are counted.  Rows with ``bits`` are the sample:
    those of each class that come first by an MD5 of ``doc_id``, as bitmaps.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    first = F.lit(False)
    for label in (0, 1):  # ids alone are read for the place where the sample ends
        last = train.where(F.col("y") == label).select(key.alias("key")).orderBy("key").limit(max_fit_rows).agg(F.max("key")).first()[0]
        first = F.when(F.col("y") == label, key <= F.lit(last or "")).otherwise(first)
    names = ["y", "bucket", "n", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, (1 << BITS) + 1), np.int64)
        for batch in slices(batches):
            ys, bits = [], []
            for y, text, picked in zip(*(c.to_pylist() for c in batch.columns)):
                at = features(text)
                n[y, at] += 1
                n[y, -1] += 1  # the class itself
                if picked:
                    row = np.zeros(1 << BITS, bool)
                    row[at] = True
                    ys.append(y)
                    bits.append(np.packbits(row).tobytes())
            if ys:
                yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.nulls(len(ys), pa.int32()), pa.nulls(len(ys), pa.int64()), pa.array(bits, pa.binary())], names)
        y, bucket = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(bucket, pa.int32()), pa.array(n[y, bucket], pa.int64()), pa.nulls(len(y), pa.binary())], names)

    return train.select("y", "text", first.alias("picked")).mapInArrow(run, "y int, bucket int, n long, bits binary")


def dual_coordinate_descent(
    rows: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, cost: np.ndarray, epochs: int = EPOCHS, seed: int = SEED
) -> tuple[np.ndarray, float]:
    """Linear hinge-loss model over rows of indicators scaled by ``ratios``.

    Each row is divided by the root of its number of indicators and gets a bias
    feature of 1.  ``y`` is 1 or -1.  Returns weights of the scaled indicators
    and the bias.
    """
    rng = np.random.default_rng(seed)
    # Values are looked up at each visit: held for all rows, they'd take more than the rows.
    scale = [1 / np.sqrt(max(1, len(at))) for at in rows]
    norm = np.array([(ratios[at] ** 2).sum() * s * s + 1 for at, s in zip(rows, scale)])
    w, bias, alpha = np.zeros(len(ratios)), 0.0, np.zeros(len(rows))
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            at = rows[i]
            v = ratios[at] * scale[i]
            new = min(max(alpha[i] - (y[i] * (w[at] @ v + bias) - 1) / norm[i], 0.0), cost[i])
            if step := (new - alpha[i]) * y[i]:
                most = max(most, abs(step) / cost[i])
                w[at] += step * v
                bias += step
                alpha[i] = new
        if most < 1e-3:
            break
    return w, bias


def _platt(margins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton steps with a small ridge."""
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    b = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (p - y)) + 1e-3 * b
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        b -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(b[0], 1e-6)), float(b[1])


def fitted(counts: np.ndarray, rows: list[np.ndarray], y: np.ndarray) -> Model:
    """A model from the class counts (2 rows, the last column the class itself)
    and a sample of rows of indicators with their labels ``y``."""
    totals = counts[:, -1]
    smoothed = (counts[:, :-1] + SMOOTHING) / (totals[:, None] + 2 * SMOOTHING)
    ratios = np.log(smoothed[1] / smoothed[0])
    order = np.random.default_rng(SEED).permutation(len(y))
    rows, y = [rows[i] for i in order], y[order]
    held = (np.arange(len(y)) % 4 == 0) & (len(y) >= 40)  # calibrates only
    picked = np.bincount(y, minlength=2)
    cost = COST * len(y) / (2 * picked[y])
    seen = np.flatnonzero(~held)
    w, bias = dual_coordinate_descent([rows[i] for i in seen], 2 * y[seen] - 1, ratios, cost[seen])
    model = Model(w * ratios, bias, 1.0, 0.0)
    calibrate = np.flatnonzero(held) if held.any() else seen
    margins = np.array([model.margin(rows[i]) for i in calibrate])
    # The sample is balanced, the training rows are not: weigh them back.
    weight = (totals / totals.sum())[y[calibrate]] * len(y) / picked[y[calibrate]]
    model.slope, model.shift = _platt(margins, y[calibrate], weight)
    return model


def _fit_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of the model from summed counts and the sample, in any order."""
    size = 1 << BITS
    counts, sample = np.zeros((2, size + 1)), []
    for batch in slices(batches):
        for y, bucket, n, bits in zip(*(c.to_pylist() for c in batch.columns)):
            if bits is None:
                counts[y, bucket] = n
            else:
                sample.append((y, md5(bits).digest(), np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8))).astype(np.uint16)))
    totals = counts[:, -1]
    if totals.all():
        sample.sort(key=lambda row: row[:2])
        model = fitted(counts, [at for _, _, at in sample], np.array([y for y, _, _ in sample]))
    else:
        share = (totals[1] + 1) / (totals.sum() + 2)
        model = Model(np.zeros(size), 0.0, 1.0, float(np.log(share / (1 - share))))
    yield pa.RecordBatch.from_arrays(
        [pa.array([model.weights.tobytes()], pa.binary()), *(pa.array([float(x)]) for x in (model.bias, model.slope, model.shift))], ["weights", "bias", "slope", "shift"])


def fit(train: DataFrame, max_fit_rows: int = MAX_FIT_ROWS) -> Model:
    """A model of ``y`` (0 or 1) from ``text``.

    Class counts cover all rows of ``train``.  The hinge-loss fit and its
    calibration see at most ``max_fit_rows`` of each class, first in order of an
    MD5 of ``doc_id``.  Rows with another ``y`` are ignored; if a class has no
    rows, all scores are the share of label 1 (0.5 with no rows at all).  One
    task fits, on that bounded sample; the driver gets the weights alone.
    """
    train = train.where(F.col("y").isin(0, 1)).select(F.col("y").cast("int").alias("y"), "text", "doc_id")
    seen = written(class_counts_and_sample(train, max_fit_rows), "training")
    none = F.lit(None).cast("binary").alias("bits")
    # At most 2 * (2**BITS + 1) rows.  Written first, or the task that fits would also do the whole sum.
    given = written(seen.where("bucket is not null").groupBy("y", "bucket").agg(F.sum("n").alias("n")), "class_counts").select("y", "bucket", "n", none)
    for label in (0, 1):  # at most max_fit_rows bitmaps of 2**BITS bits
        given = given.union(seen.where(F.col("bits").isNotNull() & (F.col("y") == label)).select("y", "bucket", "n", "bits").orderBy(F.md5("bits")).limit(max_fit_rows))
    row = given.coalesce(1).mapInArrow(_fit_in_task, "weights binary, bias double, slope double, shift double").first()
    return Model(np.frombuffer(row["weights"], float), row["bias"], row["slope"], row["shift"])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns of ``docs`` with ``score`` and ``predicted`` added.

    ``score`` is in 0 to 1 and depends on ``text`` alone: null text scores as
    empty text does.  Input columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS numbers
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    docs = docs.select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches):
            scores = np.array([m.score(features(t)) for t in batch.column("text").to_pylist()], float)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], [*names, "score", "predicted"]
            )

    return docs.mapInArrow(run, T.StructType(list(docs.schema.fields)).add("score", "double").add("predicted", "integer"))


def training_rows(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """``doc_id``, ``text``, ``y`` of labelled documents outside fold ``held``.

    The fold is the CRC-32 of the id as text, modulo ``folds``.  The join has one
    form at every size: what it shuffles is the labelled texts, never more.
    """
    known = labels.where(F.crc32(F.col("doc_id").cast("string")) % folds != held).select("doc_id", F.col("quality").alias("y"))
    return docs.select("doc_id", "text").join(known.hint("merge"), "doc_id")
