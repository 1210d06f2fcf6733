"""Toxicity by cumulative-link ordinal regression.

P(grade > k) = sigmoid(w.x - t_k): one weight for each sparse text feature,
shared by all thresholds t_0 <= t_1 <= t_2. The score is the expected grade.

Features are whole words and word beginnings, hashed into ``BUCKETS`` places, of
which those enter the fit that one class has far more often than the other, the
toxic or the harmless one (``TELLING`` and ``TIMES`` on a bounded sample of
labelled documents); weights have either sign. Labels only tell toxic from not, so the grades of
toxic documents are thirds of their evidence (log counts times log odds) by
toxic features of the other half of the sample: what a document's own words choose
does not grade it.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import share, small_batches, unused

#: Bounds: labelled documents of each class in the sample, features of the model, and grades above zero.
SAMPLE_EACH, FEATURES, GRADES = 1_500, 4_000, 3
#: Places of the hashed features; a feature tells by |z| over TELLING and a share TIMES that of the other class.
BUCKETS, TELLING, TIMES = 1 << 22, 4.0, 20
#: Penalty on the size of weights.
L1 = 1e-4
BEGINNINGS = (4, 5, 6, 7)
CACHED_WORDS = 150_000
SLICE = 1 << 20


def word_features(word: str) -> list[str]:
    """Of one blank-separated piece in lower case: its words and their beginnings."""
    out = []
    for w in "".join(c if c.isalpha() else " " for c in word).split():
        out.append(f"{w}$")
        out += [w[:n] for n in BEGINNINGS if len(w) >= n]
    return out


def word_buckets(word: str) -> list[int]:
    """Places of a piece's features in the hashed space."""
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) % BUCKETS for f in word_features(word)]


def _slices(text: str) -> Iterator[list[str]]:
    at = 0
    while at < len(text):
        end = len(text) if at + SLICE >= len(text) else text.find(" ", at + SLICE)
        end = len(text) if end < 0 else end
        yield text[at:end].lower().split()
        at = end


@dataclass
class Model:
    features: dict[int, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.full(GRADES, 50.0))
    known: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
        """Features of a whole text, how often each occurs, and the number of words."""
        hits: list[int] = []
        words = 0
        for piece in _slices(text or ""):
            words += len(piece)
            known = self.known
            if new := {w for w in piece if w not in known}:
                if len(known) + len(new) > CACHED_WORDS:
                    known.clear()
                    new = set(piece)
                for w in new:
                    known[w] = tuple(self.features[f] for f in word_buckets(w) if f in self.features)
            for found in filter(None, map(known.__getitem__, piece)):
                hits += found
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), words
        found, n = np.unique(np.array(hits), return_counts=True)
        return found, n, words

    def above(self, text: str | None) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        found, n, _ = self.counts(text)
        z = float(np.log1p(n) @ self.weights[found]) - self.thresholds
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


@dataclass
class Sparse:
    """Rows of a matrix by their non-zero values."""

    row: np.ndarray
    col: np.ndarray
    val: np.ndarray
    shape: tuple[int, int]

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], self.shape[0])

    def turned_times(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.val * g[self.row], self.shape[1])

    def steepest(self) -> float:
        """About the largest eigenvalue of X'X, by repeated products, and a tenth more."""
        v, size = np.ones(self.shape[1]) + 0.01 * np.cos(np.arange(self.shape[1])), 0.0
        for _ in range(30):
            v = self.turned_times(self.times(v / max(np.linalg.norm(v), 1e-12)))
            size = float(np.linalg.norm(v))
        return 1.1 * max(size, 1e-9)


def fit_ordinal(x: np.ndarray | Sparse, y: np.ndarray, grades: int = GRADES, l1: float = 0.0, l2: float = 1e-4, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of greatest penalised likelihood.

    Weights move by accelerated proximal steps, which set small ones to zero;
    thresholds (the first and the logs of the gaps) by steps with momentum.
    """
    if isinstance(x, np.ndarray):
        row, col = np.nonzero(x)
        x = Sparse(row, col, x[row, col], x.shape)
    n, ar = len(y), np.arange(len(y))
    # a row's likelihood curves by a half at most
    step = 1 / (0.5 * x.steepest() / n + l2)
    w = ahead = np.zeros(x.shape[1])
    cuts, pace = np.zeros(grades), 1.0
    m, v = np.zeros(grades), np.zeros(grades)
    cut = lambda q: q[0] + np.concatenate([[0.0], np.cumsum(np.exp(q[1:]))])
    edge, none = np.ones((n, 1)), np.zeros((n, 1))
    for at in range(1, steps + 1):
        up = 1 / (1 + np.exp(-np.clip(x.times(ahead)[:, None] - cut(cuts)[None, :], -40, 40)))  # P(y > k)
        full, slope = np.concatenate([edge, up, none], 1), np.concatenate([none, up * (1 - up), none], 1)
        here = np.maximum(full[ar, y] - full[ar, y + 1], 1e-9)
        upper, lower = slope[ar, y] / here, slope[ar, y + 1] / here
        by_cut = np.array([lower[y == k].sum() - upper[y == k + 1].sum() for k in range(grades)]) / n
        moved = ahead - step * (l2 * ahead - x.turned_times(upper - lower) / n)
        moved = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0)
        faster = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        w, ahead, pace = moved, moved + (pace - 1) / faster * (moved - w), faster
        grad = -np.array([by_cut.sum(), *(by_cut[k + 1 :].sum() * math.exp(cuts[k + 1]) for k in range(grades - 1))])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        cuts = cuts - rate * (m / (1 - 0.9**at)) / (np.sqrt(v / (1 - 0.999**at)) + 1e-8)
    return w, cut(cuts)


HASHED = "place double, half int, toxic long, found array<int>, n array<int>"


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.float64(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["place", "half", "toxic", "found", "n"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of each whole text and how often each occurs."""
    for batch in batches:
        rows = []
        for text, *told in zip(batch["text"], *(batch[c].to_pylist() for c in ("place", "half", "toxic")), strict=True):
            words: Counter[str] = Counter()
            for piece in _slices(text.as_py() or ""):
                words.update(piece)
            counts: Counter[int] = Counter()
            for w, n in words.items():
                for f in word_buckets(w):
                    counts[f] += n
            rows.append((*told, list(counts), list(counts.values())))
        if rows:
            yield _as_batch(rows)


def _only(wanted: np.ndarray):
    """Rows of ``_hashed`` with the wanted buckets alone, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, told in enumerate(zip(*(batch[c].to_pylist() for c in ("place", "half", "toxic")), strict=True)):
                found, n = (batch[c][i].values.to_numpy() for c in ("found", "n"))
                kept = np.flatnonzero(np.isin(found, wanted))
                kept = kept[np.argsort(found[kept])]
                rows.append((*told, found[kept], n[kept]))
            if rows:
                yield _as_batch(rows)

    return run


def _telling(seen: DataFrame, bad: Column, good: Column, n_bad: int, n_good: int, most: int) -> dict[int, float]:
    """Log odds of the buckets that tell one class from the other, the ``most`` telling ones."""
    if not n_bad or not n_good:
        return {}
    in_bad, in_good, both = bad / n_bad, good / n_good, (bad + good) / (n_bad + n_good)
    z = F.abs(in_bad - in_good) / F.sqrt(both * (1 - both) * (1 / n_bad + 1 / n_good) + F.lit(1e-12))
    odds = F.log((bad + 0.5) / (n_bad + 1)) - F.log((good + 0.5) / (n_good + 1))
    found = seen.where(F.greatest(in_bad, in_good) > TIMES * F.least(in_bad, in_good)).select("bucket", z.alias("z"), odds.alias("odds")).where(F.col("z") > TELLING)
    return {r["bucket"]: r["odds"] for r in found.orderBy(F.desc("z"), "bucket").limit(most).collect()}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_each: int = SAMPLE_EACH, features: int = FEATURES) -> Model:
    """Fit on at most about ``sample_each`` labelled documents of each class. Null labels are not used.

    The driver receives the chosen buckets (``features`` at most, and as many for
    each half) and the counts of these in the sample's documents.
    """
    small_batches(docs.sparkSession)
    told = labels.select(F.col(id_col).alias("__label_id"), F.col(label_col).cast("boolean").cast("long").alias("toxic")).where("__label_id is not null and toxic is not null")
    sizes = {r["toxic"]: r["n"] for r in told.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model()
    place = share(F.col("__label_id"), "toxicity")
    wanted = told.withColumn("place", place).where(F.col("place") < F.when(F.col("toxic") == 1, sample_each / sizes[1]).otherwise(sample_each / sizes[0]))
    wanted = wanted.groupBy("__label_id").agg(F.max("toxic").alias("toxic"), F.first("place").alias("place"))
    # its size is bounded by the two sample sizes, so a broadcast is safe and no text is shuffled
    sample = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(wanted), F.col("doc_id") == F.col("__label_id")).where("text is not null")
    sample = sample.select("text", "place", F.pmod(F.xxhash64("place"), F.lit(2)).cast("int").alias("half"), "toxic")
    hashed, seen = sample.mapInArrow(_hashed, HASHED).persist(), None
    try:
        size = {(r["half"], r["toxic"]): r["n"] for r in hashed.groupBy("half", "toxic").agg(F.count("*").alias("n")).collect()}
        in_class = {t: sum(n for (_, toxic), n in size.items() if toxic == t) for t in (0, 1)}
        if not all(in_class.values()):
            return Model()
        classes = [(h, t) for h in (0, 1) for t in (0, 1)]
        seen = hashed.select("half", "toxic", F.explode("found").alias("bucket")).groupBy("bucket").agg(*(F.count_if((F.col("half") == h) & (F.col("toxic") == t)).alias(f"in_{h}{t}") for h, t in classes))
        seen = seen.where("in_00 + in_01 + in_10 + in_11 >= 3").persist()
        bad, good = [F.col("in_01"), F.col("in_11")], [F.col("in_00"), F.col("in_10")]
        chosen = np.array(sorted(_telling(seen, bad[0] + bad[1], good[0] + good[1], in_class[1], in_class[0], features)), np.int32)
        if not len(chosen):
            return Model()
        odds = {h: {f: o for f, o in _telling(seen, bad[h], good[h], size.get((h, 1), 0), size.get((h, 0), 0), features).items() if o > 0} for h in (0, 1)}
        read = np.array(sorted({*chosen.tolist(), *odds[0], *odds[1]}), np.int32)
        rows = hashed.mapInArrow(_only(read), HASHED).collect()
    finally:
        for held in (seen, hashed):
            if held is not None:
                held.unpersist()
    rows = sorted(rows, key=lambda r: (r["place"], r["toxic"], r["found"], r["n"]))
    model = Model({f: i for i, f in enumerate(chosen.tolist())})
    y = np.array([r["toxic"] for r in rows])
    cells = [(i, model.features[f], math.log1p(n)) for i, r in enumerate(rows) for f, n in zip(r["found"], r["n"], strict=True) if f in model.features]
    row, col, val = (np.array(c) for c in zip(*cells, strict=True))
    evidence = np.array([sum(math.log1p(n) * odds[1 - r["half"]].get(f, 0.0) for f, n in zip(r["found"], r["n"], strict=True)) for r in rows])
    edges = np.quantile(evidence[y == 1], np.arange(1, GRADES) / GRADES)
    y = np.where(y == 1, 1 + np.searchsorted(edges, evidence, side="right"), 0)
    model.weights, model.thresholds = fit_ordinal(Sparse(row, col, val, (len(rows), len(chosen))), y, l1=L1)
    return model


def score_column(model: Model, text: Column) -> Column:
    """struct(severity, p_toxic): expected grade from 0 to 3, and the chance of any grade above 0."""

    @F.pandas_udf("severity double, p_toxic double")
    def of(texts: pd.Series) -> pd.DataFrame:
        up = np.array([model.above(t if isinstance(t, str) else None) for t in texts]).reshape(-1, GRADES)
        return pd.DataFrame({"severity": up.sum(1), "p_toxic": up[:, 0]})

    return of(text)


def grade(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: float = 0.5, **how) -> DataFrame:
    """One row for each row of ``docs``: doc_id, severity, p_toxic, grade, toxic.

    ``toxic`` is p_toxic >= ``limit``; grade is the rounded severity. Null and
    empty texts have no feature and score as a text without any. With labels of
    one class only, or none, nothing is toxic. Repeated rows come back repeated;
    an empty table gives no row. Other columns are not read.
    """
    model = train(docs, labels, id_col, text_col, **how)
    scored = docs.select(F.col(id_col).alias("doc_id"), score_column(model, F.col(text_col)).alias("s"))
    return scored.select("doc_id", "s.severity", "s.p_toxic", F.round("s.severity").cast("int").alias("grade"), (F.col("s.p_toxic") >= limit).alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: float = 0.5, **how) -> DataFrame:
    """``docs`` without the rows that are graded toxic; columns stay as they are."""
    model = train(docs, labels, id_col, text_col, **how)
    score = unused(docs, "toxicity")
    return docs.withColumn(score, score_column(model, F.col(text_col))).where(F.col(score)["p_toxic"] < limit).drop(score)


def held_out(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", limit: float = 0.5, folds: int = 5, **how) -> DataFrame:
    """Figures of a model on labelled texts that it did not see, one row a label.

    The fold of a text depends on the text, so its exact copies are left out of
    training too. toxic (the label), documents, rejected (p_toxic >= ``limit``)
    and severity (mean of the expected grades). Without labels there is no row.
    """
    told = labels.select(F.col(id_col).alias("__label_id"), F.col(label_col).cast("boolean").cast("long").alias("toxic")).where("__label_id is not null and toxic is not null")
    told = told.groupBy("__label_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    left_out = F.pmod(F.xxhash64("text"), F.lit(folds)) == 0
    model = train(texts.where(~left_out), labels.withColumnRenamed(id_col, "doc_id"), label_col=label_col, **how)
    rest = texts.where(left_out).join(told, F.col("doc_id") == F.col("__label_id"))
    scored = rest.select("toxic", score_column(model, F.col("text")).alias("s"))
    return scored.groupBy("toxic").agg(F.count("*").alias("documents"), F.count_if(F.col("s.p_toxic") >= limit).alias("rejected"), F.avg("s.severity").alias("severity"))
