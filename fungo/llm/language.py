"""Language identification: multinomial logistic regression on TF-IDF of hashed character n-grams.

Weights are trained by follow-the-regularised-leader with elastic-net
penalties, one document at a time, on a bounded sample of labelled documents;
a part of the sample sets the temperature of the softmax. Document frequencies
are counted over every training document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import share, small_batches

#: Hash buckets of n-grams, and the longest n-gram.
BUCKETS, LONGEST = 1 << 15, 3
#: Bounds of the training sample: documents of one language, and in all.
SAMPLE_EACH, SAMPLE_ALL = 600, 6_000
SLICE = 1 << 20
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point: itself in lower case if it is a letter, else blank."""
    table = np.full(0x110000, 32, np.uint32)
    for block in (range(0xD800), range(0xE000, 0x110000)):
        for i in block:
            c = chr(i)
            if c.isalpha():
                table[i] = ord(low) if len(low := c.lower()) == 1 else i
    return table


def _hashes(points: np.ndarray) -> Iterator[np.ndarray]:
    rolled = np.zeros(len(points), np.uint32)
    for n in range(1, LONGEST + 1):
        if len(points) < n:
            return
        rolled = rolled[: len(points) - n + 1] * np.uint32(0x01000193) + points[n - 1 :] * np.uint32(0x9E3779B1)
        mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(n)
        yield mixed >> np.uint32(32 - (BUCKETS.bit_length() - 1))


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets and counts of a whole text; None if it has no letter. Blanks in a row count as one."""
    if not text:
        return None
    total, some, last = np.zeros(BUCKETS, np.int64), False, np.array([32], np.uint32)
    for at in range(0, len(text), SLICE):
        points = _letters()[np.frombuffer(text[at : at + SLICE].encode("utf-32-le", "surrogatepass"), "<u4")]
        some = some or bool((points != 32).any())
        points = np.concatenate([last, points])
        points = points[np.concatenate([[True], (points[1:] != 32) | (points[:-1] != 32)])]
        for h in _hashes(points):
            total += np.bincount(h, minlength=BUCKETS)
        last = points[-(LONGEST - 1) :]
    if not some:
        return None
    found = np.flatnonzero(total)
    return found, total[found]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets and a bias by languages
    temperature: float = 1.0

    def features(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf[found]
        return x / max(1e-12, math.sqrt(float(x @ x)))

    def scores(self, found: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[found] + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or (g := grams(text)) is None:
            return UNKNOWN, 0.0
        z = self.scores(g[0], self.features(*g)) / self.temperature
        p = np.exp(z - z.max())
        best = int(np.argmax(p))
        return self.languages[best], float(p[best] / p.sum())


def fit_ftrl(docs: list[tuple[np.ndarray, np.ndarray, int]], model: Model, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 3) -> None:
    """Set the model's weights from (buckets, features, class) of each document."""
    z, n = np.zeros_like(model.weights), np.zeros_like(model.weights)

    def weights(rows: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[rows]) <= l1, 0.0, -(z[rows] - np.sign(z[rows]) * l1) / ((beta + np.sqrt(n[rows])) / alpha + l2))

    for _ in range(epochs):
        for found, x, label in docs:
            rows, values = np.append(found, BUCKETS), np.append(x, 1.0)
            w = weights(rows)
            s = values @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[label] -= 1.0
            g = values[:, None] * p[None, :]
            root = np.sqrt(n[rows])
            n[rows] += g * g
            z[rows] += g - (np.sqrt(n[rows]) - root) / alpha * w
    model.weights = weights(np.arange(BUCKETS + 1))


def fit_temperature(docs: list[tuple[np.ndarray, np.ndarray, int]], model: Model) -> float:
    """The temperature of least log loss on documents that the weights have not seen."""
    if not docs:
        return 1.0
    s = np.array([model.scores(f, x) for f, x, _ in docs])
    y = np.array([c for *_, c in docs])

    def loss(t: float) -> float:
        q = s / t
        q = q - q.max(1, keepdims=True)
        return float((np.log(np.exp(q).sum(1)) - q[np.arange(len(y)), y]).mean())

    return min(np.geomspace(0.05, 5, 60), key=loss)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(a, b, g[0].tolist(), g[1].tolist()) for a, b, t in zip(batch["lang"].to_pylist(), batch["place"].to_pylist(), batch["text"], strict=True) if (g := grams(t.as_py()))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.int64())), strict=True)], names=["lang", "place", "found", "counts"])


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, docs = np.zeros(BUCKETS + 1, np.int64), 0
    for batch in batches:
        for text in batch["text"]:
            if (g := grams(text.as_py())) is not None:
                total[g[0]] += 1
                docs += 1
    total[BUCKETS] = docs
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found], pa.int64())], names=["bucket", "docs"])


def train(docs: DataFrame, key: Column, text_col: str = "text", lang_col: str = "lang", sample_each: int = SAMPLE_EACH, sample_all: int = SAMPLE_ALL) -> Model:
    """Fit on rows with a language. ``key`` places rows in the sample; it is no input of the model."""
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), share(key, "language").alias("place")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros(BUCKETS), np.zeros((BUCKETS + 1, 0)))
    each = max(1, min(sample_each, sample_all // len(sizes)))
    # a few more than wanted, so that the rows of least place are among them
    limit = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, (each + 4 * math.sqrt(each) + 4) / n)))
    sample = rows.where(F.col("place") < F.element_at(limit, F.col("lang"))).mapInArrow(_sampled, "lang string, place double, found array<int>, counts array<long>")
    picked = sorted(sample.collect(), key=lambda r: (r["place"], r["lang"], r["found"], r["counts"]))
    drawn: dict[str, int] = {}
    kept = []
    for r in picked:
        drawn[r["lang"]] = drawn.get(r["lang"], 0) + 1
        if drawn[r["lang"]] <= each:
            kept.append(r)
    picked = kept
    held = np.zeros(BUCKETS + 1, np.int64)
    for r in rows.select("text").mapInArrow(_document_counts, "bucket int, docs long").groupBy("bucket").agg(F.sum("docs").alias("docs")).collect():
        held[r["bucket"]] = r["docs"]
    languages = sorted({r["lang"] for r in picked})
    model = Model(languages, np.log((1 + held[-1]) / (1 + held[:-1])) + 1, np.zeros((BUCKETS + 1, len(languages))))
    made = [(f := np.array(r["found"]), model.features(f, np.array(r["counts"])), languages.index(r["lang"])) for r in picked]
    fit_ftrl([d for i, d in enumerate(made) if i % 6], model)
    model.temperature = fit_temperature([d for i, d in enumerate(made) if i % 6 == 0], model)
    return model


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [model.predict(t.as_py()) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, **how) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, lang_pred, score.

    Rows whose crc32 of the id leaves no remainder by ``folds`` (or whose id is
    null) are held out of training, as are rows without a language. A text that
    is null or has no letter is "und" with score 0, and so is every text if
    nothing can be trained on. Equal texts get equal predictions; an empty table
    gives no row. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(True))
    model = train(rows.where(~held), F.col("doc_id"), **how)
    return rows.select("doc_id", "text", held.alias("held_out")).mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")
