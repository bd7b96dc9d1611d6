"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters of the lower-cased text are hashed into a fixed number of
features. Document frequencies are counted over all training rows. The weights are learned by
follow-the-regularised-leader with elastic-net penalties, which leaves most of them at zero, from a
bounded sample of training rows (SAMPLE_PER_LANG of each language, expected). A temperature fitted
on a part of that sample which training leaves out calibrates the scores.

Defined results: a null text or one without a letter is ``und`` with score 0; a null lang is never
learned from; without training rows every text is ``und`` with score 0; a null doc_id counts as the
empty string for the split; equal texts get equal results; whole texts are read whatever their
length; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import words as W
from quantloom.llm.quality import crc_fold
from quantloom.session import ship

FEATURES, ORDERS = 1 << 13, 3
#: Expected rows of each language in the training sample.
SAMPLE_PER_LANG = 800
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.02, 0.002
CALIBRATION_SHARE = 5
#: Code points that a single-text pass turns into features at a time.
PIECE = 1 << 19


def counts(text: str) -> np.ndarray:
    """How often each feature occurs in the whole text."""
    out = np.zeros(FEATURES, np.int64)
    text = f" {text.lower()} "
    for at in range(0, len(text), PIECE):
        piece = text[at : at + PIECE + ORDERS - 1]
        own = min(PIECE, len(text) - at)
        c = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        h = np.zeros(len(c), np.uint64)
        for k in range(ORDERS):
            h = h[: len(c) - k] * np.uint64(W.GRAM_BASE) + c[k:] + np.uint64(1)
            slots = (h[:own] * np.uint64(W.BASE)) >> np.uint64(64 - 13)
            out += np.bincount(slots.astype(np.int64), minlength=FEATURES)
    return out


def has_letter(text: str | None) -> bool:
    return text is not None and (text.isalpha() or any(map(str.isalpha, text)))


def vector(n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the TF-IDF vector, of length one."""
    at = np.flatnonzero(n)
    x = (1 + np.log(n[at])) * idf[at]
    return at, x / max(np.sqrt((x**2).sum()), 1e-12)


@dataclass(frozen=True)
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return "und", 0.0
        z = self.logits(*vector(counts(text), self.idf)) / self.temperature
        p = np.exp(z - z.max())
        best = int(np.argmax(p))
        return self.langs[best], float(p[best] / p.sum())


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each task: in how many texts each feature occurs."""
    df = np.zeros(FEATURES, np.int64)
    for b in batches:
        for text in b.column(0):
            df += counts(text.as_py()) > 0
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["feature", "n"])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        packs = []
        for text in b.column(2):
            n = counts(text.as_py())
            at = np.flatnonzero(n)
            packs.append(W.packed(at.astype(np.uint16)) + W.packed(n[at].astype(np.float32)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packs, pa.binary())], ["lang", "part", "x"])


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], n_langs: int) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over (class, indices, values) rows in the given order; weights and biases."""
    z, n = np.zeros((FEATURES + 1, n_langs)), np.zeros((FEATURES + 1, n_langs))

    def weights(at) -> np.ndarray:
        zi = z[at]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)

    for _ in range(EPOCHS):
        for y, at, x in rows:
            at, x = np.append(at, FEATURES), np.append(x, 0.1)
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    w = weights(slice(None))
    return w[:FEATURES], 0.1 * w[FEATURES]


def temperature(model: Model, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> float:
    """The divisor of the logits with the least log loss on rows that were not trained on."""
    if not rows:
        return 1.0
    z = np.stack([model.logits(at, x) for _, at, x in rows])
    y = np.array([r[0] for r in rows])
    best = (np.inf, 1.0)
    for t in np.geomspace(0.1, 5, 60):
        s = z / t - (z / t).max(axis=1, keepdims=True)
        loss = (np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean()
        best = min(best, (loss, t))
    return float(best[1])


def fit(docs: DataFrame, sample_per_lang: int = SAMPLE_PER_LANG) -> Model:
    """Learn from the texts and languages of the training folds of docs."""
    ship(docs.sparkSession)
    rows = docs.where((crc_fold() != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    per_lang = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(per_lang)
    if not langs:
        return Model([], np.ones(FEATURES), np.zeros((FEATURES, 0)), np.zeros(0))
    df = np.zeros(FEATURES)
    for r in rows.select("text").mapInArrow(_frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        df[r["feature"]] = r["n"]
    total = sum(per_lang.values())
    idf = np.log((1 + total) / (1 + df)) + 0.1
    # A row is in the sample if a hash of its id and text falls under its language's share; of equal rows one counts.
    share = F.create_map(*[F.lit(v) for lang in langs for v in (lang, min(1.0, sample_per_lang / per_lang[lang]))])
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id", "text"), F.lit(CALIBRATION_SHARE)).cast("int")
    sample = rows.where(draw < share[F.col("lang")]).select("lang", part.alias("part"), "text")
    learn, held = [], []
    for r in sample.mapInArrow(_sparse, "lang string, part int, x binary").distinct().collect():
        k = len(r["x"]) // 6
        at = np.frombuffer(r["x"], np.uint16, k).astype(np.int64)
        n = np.frombuffer(r["x"], np.uint8)[2 * k :].copy().view(np.float32).astype(float)
        x = (1 + np.log(n)) * idf[at]
        row = (langs.index(r["lang"]), at, x / max(np.sqrt((x**2).sum()), 1e-12))
        (held if r["part"] == 0 else learn).append(row)
    # The order is fixed by the rows themselves, not by how Spark returns them.
    learn.sort(key=lambda r: (W.mix(np.array([r[1].sum() * 31 + len(r[1])], np.uint64))[0], r[0], float(r[2].sum())))
    weights, bias = train(learn, len(langs))
    model = Model(langs, idf, weights, bias)
    return Model(langs, idf, weights, bias, temperature(model, held))


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.predict(t.as_py()) for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*b.schema.names[:-1], "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (crc_fold() == 1).alias("held_out"), "text")
    return rows.mapInArrow(_predict(model), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs whose text is in a learned language with at least that confidence, with all their columns."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.predict(t.as_py()) for t in b.column(b.schema.get_field_index("text"))]
            yield b.filter(pa.array([g[0] != "und" and g[1] >= least for g in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs))
