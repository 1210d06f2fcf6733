"""The quality classifier against a plain Kneser-Ney model and on documents it has not seen."""

from __future__ import annotations

from collections import Counter, defaultdict
from math import exp, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from fungo.llm import quality

DOCS = "doc_id long, text string, lang string"


def _units(text):
    raw = text.encode("utf-16-le")
    return [0, 0, 0] + [int.from_bytes(raw[i : i + 2], "little") for i in range(0, len(raw), 2)]


def _plain_model(texts):
    tables = {4: Counter(tuple(u[i : i + 4]) for t in texts for u in [_units(t)] for i in range(len(u) - 3))}
    for k in (3, 2, 1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    cuts, sums, backs = {}, {}, {}
    for k, table in tables.items():
        of = Counter(table.values())
        cuts[k] = quality._discounts(*(of[i] for i in (1, 2, 3, 4)))
        sums[k], backs[k] = defaultdict(float), defaultdict(float)
        for g, n in table.items():
            sums[k][g[:-1]] += n
            backs[k][g[:-1]] += cuts[k][min(n, 3) - 1]

    def p(g):
        if not g:
            return 1 / (len(tables[1]) + 1)
        k, n, c = len(g), tables[len(g)].get(g, 0), g[:-1]
        direct = (n - cuts[k][min(n, 3) - 1]) / sums[k][c] if n else 0.0
        back = backs[k][c] / sums[k][c] if sums[k].get(c) else 1.0
        return direct + back * p(g[1:])

    def perplexity(text):
        u = _units(text)
        return exp(-sum(log(p(tuple(u[i : i + 4]))) for i in range(len(u) - 3)) / (len(u) - 3))

    return perplexity


@pytest.mark.parametrize("hot", [0, 200, 10**6])
def test_perplexity_equals_plain_model(spark, hot):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdeéж中😀"), 4)) for _ in range(40)]
    texts = [" ".join(rng.choice(words, 30)) for _ in range(20)] + ["", None, "zzz Q", "abc", "x" * 5_000, texts_nul := "a\0b"]
    rows = [(i if i != 23 else None, t, "aä"[i % 2] if i % 5 else None) for i, t in enumerate(texts)] + [(3, texts[3], "a")]
    assert texts_nul in texts
    got = quality.classify(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, 1) for i in range(12)] + [(13, 0), (None, 1)], "doc_id long, quality int"), hot_grams=hot).toPandas()
    model = _plain_model(texts[:12] + [texts[3]])
    assert len(got) == len(rows)
    want = sorted((-1 if i is None else i, n or "-", 0.0 if not t else model(t)) for i, t, n in rows)
    have = sorted((-1 if np.isnan(i) else int(i), n or "-", 0.0 if np.isnan(p) else p) for i, n, p in got[["doc_id", "lang", "perplexity"]].itertuples(index=False))
    assert [w[:2] for w in want] == [h[:2] for h in have]
    assert [h[2] for h in have] == pytest.approx([w[2] for w in want], rel=1e-9)
    assert not got.loc[got["doc_id"].isin([20, 21]), "keep"].any()


def test_long_text_in_parts(monkeypatch):
    rng = np.random.default_rng(1)
    text = "".join(chr(0x4E00 + x) for x in rng.integers(0, 300, 5_000))
    whole = dict(zip(*(x.tolist() for x in next(quality.grams(text))), strict=True))
    monkeypatch.setattr(quality, "SLICE", 700)
    parts = Counter()
    for g, n in quality.grams(text):
        parts.update(dict(zip(g.tolist(), n.tolist(), strict=True)))
    assert parts == whole and sum(parts.values()) == len(text)


def test_quality_of_unseen_documents(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    seen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    got = quality.classify(d, lab.where(seen)).join(lab.where(~seen).select(F.col("doc_id").alias("i"), "quality"), F.col("doc_id") == F.col("i")).toPandas()
    assert got.loc[got["quality"] == 1, "keep"].mean() > 0.97 and got.loc[got["quality"] == 0, "keep"].mean() < 0.4
