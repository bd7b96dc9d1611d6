"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Each class has its own mean and a covariance shrunk first towards the pooled one and then towards a
scaled identity. Scores are differences of Gaussian log densities, whose Mahalanobis terms come from
Cholesky factors that are computed once. Moments are sums over all labelled rows, gathered by Spark;
only sums reach the driver.

Defined results: a null or empty text has the statistics of an empty document and gets a score like
any other; a null doc_id counts as the empty string for the split; several labels of one doc_id are
averaged and count as 1 from 0.5; without labelled rows of both classes every score is 0.5; repeated
rows are scored alike; other columns are ignored; an empty table gives no rows. A text is read whole, in
blocks of texts or alone if it is a very long one, and leaves its statistics only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import words as W
from quantloom.session import saved, ship

#: Shares of the pooled covariance and of the scaled identity in each class covariance.
POOL, RIDGE = 0.10, 0.02
PRIOR_ROWS = 2.0
N_STATS = 20

# Byte classes: 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line feed, 6 sentence marks, 7 brackets and symbols, 8 UTF-8 lead, 9 UTF-8 tail.
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[9, 11, 12, 13, 32]], _CLASS[10] = 4, 5
_CLASS[[ord(c) for c in ".,;:'\"?-()"]] = 6
_CLASS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 7
_CLASS[192:], _CLASS[128:192] = 8, 9


def statistics(column: pa.Array) -> np.ndarray:
    """The transformed statistics of whole texts, one row each."""
    out = np.zeros((len(column), N_STATS))
    for i, j, data, off in W.blocks(column):
        n = j - i
        h, start, end, first = W.words(data, off, lower=True)
        size = np.diff(off).astype(float)
        text = np.repeat(np.arange(n), np.diff(off))
        c = np.bincount(text * 10 + _CLASS[data], minlength=10 * n).reshape(n, 10).astype(float)
        count = np.diff(first).astype(float)
        owner = np.repeat(np.arange(n), np.diff(first))
        length = (end - start).astype(float)
        total, square = np.bincount(owner, length, n), np.bincount(owner, length**2, n)
        longest, distinct, top, grams = np.zeros((4, n))
        for k, grams_of in enumerate(W.gram_sets(h, first, 3)):
            if count[k]:
                own = np.sort(h[first[k] : first[k + 1]])
                edge = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1], [True])))
                distinct[k], top[k] = len(edge) - 1, np.diff(edge).max()
                longest[k] = length[first[k] : first[k + 1]].max()
                grams[k] = len(grams_of)
        # words that start with an upper-case letter, or end with a symbol
        caps = np.bincount(owner, _CLASS[data[start]] == 2, n) if len(start) else np.zeros(n)
        tails = np.bincount(owner, _CLASS[data[end - 1]] == 7, n) if len(start) else np.zeros(n)
        stops = np.bincount(owner, np.isin(data[end - 1], (46, 63)), n) if len(start) else np.zeros(n)
        chars, some = np.maximum(size - c[:, 9], 1), np.maximum(count, 1)
        mean = total / some
        root = lambda x, by: np.sqrt(x / by)
        out[i:j] = np.stack(
            [
                np.log1p(size), np.log1p(count), mean, np.sqrt(np.maximum(square / some - mean**2, 0)), np.log1p(longest),
                np.log((distinct + 1) / (count + 1)) / np.log(count + 2), np.log((top + 1) / (count + 1)) / np.log(count + 2), (grams + 1) / np.maximum(count - 1, 1),
                root(c[:, 2], chars), root(c[:, 3], chars), root(c[:, 4], chars), root(c[:, 5], chars), root(c[:, 6], chars), root(c[:, 7], chars), root(c[:, 8], chars), root(c[:, 0], chars),
                root(caps, some), root(tails, some), root(stops, some), root(c[:, 1], chars),
            ],
            axis=1,
        )
    return out


@dataclass(frozen=True)
class Model:
    """mean and scale standardise; means, factors (inverse Cholesky) and offsets belong to the two classes."""

    mean: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray
    shift: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, per statistic, less the calibrated shift."""
        z = np.clip((x - self.mean) / self.scale, -12, 12)
        density = [o - 0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) for m, f, o in zip(self.means, self.factors, self.offsets, strict=True)]
        return (density[1] - density[0]) / len(self.mean) - self.shift

    def score(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1 and monotone in the difference, without saturation in between."""
        d = self.difference(x)
        return 0.5 + 0.5 * d / (1 + np.abs(d))


def crc_fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text modulo 3; 1 is held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3


def one_label(labels: DataFrame, name: str) -> DataFrame:
    """doc_id, label (0 or 1): a row per doc_id."""
    return labels.where(F.col(name).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg(F.col(name)) >= 0.5).cast("int").alias("label"))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and class: the count, the sums and the products' sums, as cells."""
    p, sums = N_STATS + 1, {}
    for b in batches:
        flat = b.column(1).flatten().to_numpy(zero_copy_only=False)
        x = np.c_[np.ones(len(b)), flat.reshape(len(b), N_STATS)]
        y = b.column(0).to_numpy(zero_copy_only=False)
        for k in (0, 1):
            sums[k] = sums.get(k, np.zeros((p, p))) + x[y == k].T @ x[y == k]
    for k, m in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(p * p, k, np.int32)), pa.array(np.arange(p * p, dtype=np.int32)), pa.array(m.ravel())], ["label", "cell", "value"])


#: Edges of the bins in which the training differences are counted for the shift.
EDGES = np.linspace(-3, 3, 601)


def _histogram(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, len(EDGES) + 1), np.int64)
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(b), N_STATS)
            bins = np.searchsorted(EDGES, model.difference(x), "right")
            np.add.at(n, (b.column(0).to_numpy(zero_copy_only=False), bins), 1)
        k, at = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(n[k, at])], ["label", "bin", "n"])

    return run


def _shift(rows: DataFrame, model: Model) -> float:
    """The cut with the fewest training errors, each class weighing the same; the middle of the widest such range.

    The class of poor texts is a broad mixture, whose single Gaussian reaches into the clean class;
    the cut makes up for that.
    """
    n = np.zeros((2, len(EDGES) + 1))
    for r in rows.mapInArrow(_histogram(model), "label int, bin int, n long").groupBy("label", "bin").agg(F.sum("n").alias("n")).collect():
        n[r["label"], r["bin"]] = r["n"]
    n /= n.sum(axis=1, keepdims=True)
    wrong = np.cumsum(n[1])[:-1] + 1 - np.cumsum(n[0])[:-1]
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    runs = np.split(best, np.flatnonzero(np.diff(best) > 1) + 1)
    widest = max(runs, key=len)
    return float((EDGES[widest[0]] + EDGES[widest[-1]]) / 2)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = statistics(b.column(1))
        lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, N_STATS, dtype=np.int32), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([b.column(0), lists], ["doc_id", "x"])


def fit(docs: DataFrame, labels: DataFrame, name: str = "quality", pool: float = POOL, ridge: float = RIDGE) -> Model | None:
    """Fit on all labelled rows of the training folds; None if a class is missing.

    Texts are reduced to their statistics before the join with the labels, so the shuffle moves a
    few numbers a document.
    """
    ship(docs.sparkSession)
    train = docs.where(crc_fold() != 1).select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    x = train.mapInArrow(_featurise, f"doc_id {kind}, x array<double>")
    rows = saved(x.join(one_label(labels, name), "doc_id").select("label", "x"), "quality-rows")
    cells = rows.mapInArrow(_moments, "label int, cell int, value double").groupBy("label", "cell").agg(F.sum("value").alias("value")).collect()
    p = N_STATS + 1
    m = np.zeros((2, p * p))
    for r in cells:
        m[r["label"], r["cell"]] = r["value"]
    m = m.reshape(2, p, p)
    n = m[:, 0, 0]
    if n.min() < 1:
        return None
    both = m.sum(axis=0)
    mean = both[0, 1:] / n.sum()
    scale = np.sqrt(np.maximum(np.diag(both)[1:] / n.sum() - mean**2, 1e-12))
    scale[scale < 1e-5] = 1.0
    means = (m[:, 0, 1:] / n[:, None] - mean) / scale
    covariances = []
    for k in (0, 1):
        second = (m[k][1:, 1:] / n[k] - np.outer(mean, m[k][0, 1:] / n[k]) - np.outer(m[k][0, 1:] / n[k], mean) + np.outer(mean, mean)) / np.outer(scale, scale)
        covariances.append(second - np.outer(means[k], means[k]))
    pooled = (n[0] * covariances[0] + n[1] * covariances[1]) / n.sum()
    factors, offsets = [], []
    for k in (0, 1):
        s = (1 - pool) * covariances[k] + pool * pooled
        s = (1 - ridge) * s + ridge * max(np.trace(s) / N_STATS, 1e-6) * np.eye(N_STATS)
        lower = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(lower))
        offsets.append(np.log((n[k] + PRIOR_ROWS) / (n.sum() + 2 * PRIOR_ROWS)) - np.log(np.diag(lower)).sum())
    model = Model(mean, scale, means, np.stack(factors), np.array(offsets))
    return replace(model, shift=_shift(rows, model))


def scores(model: Model | None):
    """A mapInArrow function from (…, text last) to the same columns without text, and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(b.column(b.num_columns - 1))
            s = model.score(x) if model is not None else np.full(len(b), 0.5)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64())], [*b.schema.names[:-1], "score"])

    return run


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (crc_fold() == 1).alias("held_out"), "text")
    out = rows.mapInArrow(scores(model), f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with all their columns."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(b.column(b.schema.get_field_index("text")))
            s = model.score(x) if model is not None else np.full(len(b), 0.5)
            yield b.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
