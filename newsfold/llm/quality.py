"""Quality classifier (operator 6): random Fourier features, ridge, isotonic calibration.

Statistics of each whole text (one pass, no shuffle) are standardised and mapped to random
Fourier features, whose inner products approximate a Gaussian kernel. Each partition of the
training rows sums its part of the normal equations; those rows of fixed length are added up
by Spark, and only the one final matrix, whose size depends on nothing but the number of
features, is solved on the driver. Scores of rows held back from the ridge fit are counted
into a fixed number of bins, from which pooling adjacent violators gives an isotonic map
to probabilities.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import settle

#: Classes of bytes that are counted, as fixed values.
_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32, 9, 11, 12, 13), "line": (10,),
    "stop": b".,;:", "call": b"!?", "bar": b"|", "mark": b"#$%&*@^~+=<>{}[]\\/_`", "high": range(128, 256),
}
STATISTICS = [
    "log_words", "word_length", "distinct", "repeats", "top_share", "upper_share", "digit_share", "space_share", "line_share",
    "stop_share", "call_share", "bar_share", "mark_share", "high_share", "byte_entropy", "distinct_lines", "log_line_length", "longest_word", "call_words",
]
_MASK = np.zeros((256, len(_CLASSES)))
for _k, _own in enumerate(_CLASSES.values()):
    _MASK[list(_own), _k] = 1


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text; all defined for null and empty texts too."""
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    hist = np.bincount(data, minlength=256).astype(np.float64)
    size = max(len(data), 1)
    upper, lower, digit, space, line, stop, call, bar, mark, high = (hist @ _MASK).tolist()
    share = hist[hist > 0] / size
    words = text.split()
    n = max(len(words), 1)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    return [
        np.log1p(len(words)), len(data) / n, len(counts) / n, sum(map(eq, words, words[1:])) / n, max(counts.values(), default=0) / n,
        upper / max(upper + lower, 1.0), digit / size, space / size, line / size, stop / size, call / size, bar / size, mark / size, high / size,
        float(-(share * np.log2(share)).sum()), len(set(lines)) / max(len(lines), 1), np.log1p(size / max(len(lines), 1)),
        np.log1p(max(map(len, counts), default=0)), (call + mark) / n,
    ]


def described(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, stats)`` of each row; ``stats`` as listed in STATISTICS."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                made = [statistics(t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.float64()))], names=["id", "stats"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, stats array<double>")


class Model:
    """Means and scales, random features, ridge weights, calibration: all of fixed size."""

    def __init__(self, features: int, seed: int = 61, width: float = 3.0) -> None:
        draw = np.random.default_rng(seed)
        self.turn = draw.standard_normal((len(STATISTICS), features)) / width
        self.shift = draw.uniform(0, 2 * np.pi, features)
        self.mean, self.scale = np.zeros(len(STATISTICS)), np.ones(len(STATISTICS))
        self.weights = np.zeros(features + len(STATISTICS) + 1)
        self.knots, self.levels = np.array([0.0]), np.array([0.5])

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features, besides the plain standardised statistics and a constant."""
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        wave = np.cos(z @ self.turn + self.shift) * np.sqrt(2 / len(self.shift))
        return np.concatenate([wave, z / 4, np.ones((len(z), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.knots, self.levels)


def isotonic(x: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators of means good / weight over x in order; block centres and levels."""
    blocks: list[list[float]] = []
    for at, g, w in zip(x.tolist(), good.tolist(), weight.tolist()):
        blocks.append([at * w, g, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(rows: DataFrame, features: int = 192, ridge: float = 1.0, bins: int = 1000) -> Model:
    """A model from ``rows(id, stats, label, part)``: parts 1, 2 and 3 fit the ridge, part 4 calibrates.

    Without labelled rows every score is 0.5; with rows of one label only, near that label.
    """
    model = Model(features)
    fitted = rows.where("part <> 4")
    if fitted.isEmpty():
        return model
    moments = fitted.agg(Summarizer.metrics("mean", "std").summary(array_to_vector("stats")).alias("m")).select("m.*").first()
    model.mean = moments["mean"].toArray()
    model.scale = np.maximum(moments["std"].toArray(), 1e-6)
    size = features + len(STATISTICS) + 1

    def sums(batches):
        total = np.zeros((size, size + 1))
        for batch in batches:
            if batch.num_rows:
                x = model.features(np.array(batch.column(0).to_pylist()))
                y = np.array(batch.column(1).to_pylist(), np.float64)
                total += x.T @ np.concatenate([x, y[:, None]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["row", "part"])

    parts = fitted.select("stats", "label").mapInArrow(sums, "row int, part array<double>")
    whole = parts.groupBy("row").agg(vector_to_array(Summarizer.sum(array_to_vector("part"))).alias("sum")).collect()  # size rows
    normal = np.zeros((size, size + 1))
    for r in whole:
        normal[r["row"]] = r["sum"]
    model.weights = np.linalg.solve(normal[:, :size] + ridge * np.eye(size), normal[:, size])

    def binned(batches):
        for batch in batches:
            if batch.num_rows:
                raw = np.clip(model.raw(np.array(batch.column(0).to_pylist())), -1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.floor((raw + 1) / 3 * bins).astype(np.int64)), pa.array(raw), batch.column(1)], names=["bin", "raw", "label"])

    held = rows.where("part = 4").select("stats", "label").mapInArrow(binned, "bin long, raw double, label double")
    counts = sorted(held.groupBy("bin").agg(F.avg("raw"), F.sum("label"), F.count("*")).collect())  # a row a bin
    if counts:
        _, x, good, n = (np.array(c, np.float64) for c in zip(*counts))
        model.knots, model.levels = isotonic(x, good, n)
    else:
        model.knots, model.levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def classify(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.3, features: int = 192
) -> DataFrame:
    """One row per row of ``df``: doc_id, held_out, score, predicted.

    Labels (0 or 1; others are ignored; several for one id are averaged) are learned only from
    rows whose crc32 of the id as text, modulo 5, is not 0. Null and empty texts have statistics
    and a score like any other. Rows that repeat an id are each returned; a null id is never
    learned from and not held out. An empty frame gives an empty one.
    """
    stats = settle(described(df, id_col, text))
    part = F.pmod(F.crc32(F.col("id").cast("string")), F.lit(5)).cast("int")
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("double").alias("label")).where("label in (0, 1) and id is not null")
    known = known.withColumn("part", part).where("part <> 0").groupBy("id", "part").agg(F.avg("label").alias("label"))
    model = fit(settle(stats.join(known, "id").select("id", "stats", "label", "part")), features)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                score = model.score(np.array(batch.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
