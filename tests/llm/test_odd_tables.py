"""Null and very large ids, and columns of the names that operators use inside."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fungo.llm import embeddings, media, mixing, secrets, simhash, toxicity

BIG = 1 << 60
INNER = ["__mix", "__tokens", "__clean", "__hash", "__toxicity", "row", "mix", "copy", "root", "node", "code", "label", "__kept_id"]


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, node string, rep int, dim string")


def test_vectors_without_ids_beside_large_ids(spark):
    rng = np.random.default_rng(0)
    base = [rng.normal(size=16) for _ in range(4)]
    near = lambda v: (v + 0.02 * rng.normal(size=16)).tolist()
    rows = [(BIG + 1, 1, near(base[0])), (BIG + 3, 1, near(base[0])), (None, 1, near(base[0])), (None, 1, near(base[1])), (None, 1, near(base[1])), (None, 1, near(base[2])), (9, 1, near(base[3])), (7, 2, near(base[0])), (None, None, near(base[0])), (None, 1, base[0].tolist()), (None, 1, base[0].tolist())]
    got = embeddings.near_duplicates(_vectors(spark, [(*r, "x", 1, "y") for r in rows])).collect()
    want = []
    for i, (vec_id, label, v) in enumerate(rows):
        links = [j for j, (_, other, w) in enumerate(rows) if i != j and label is not None and label == other and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93]
        ids = [x for x in [vec_id, *(rows[j][0] for j in links)] if x is not None]
        component = min(ids, default=None)
        want.append((vec_id, len(links), component, vec_id is not None and vec_id == component))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_labels_that_are_no_whole_numbers(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [(1, "a", v), (2, "a", v), (3, "b", v), (4, None, v)]
    text = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>"))
    number = embeddings.near_duplicates(spark.createDataFrame([(i, {"a": 1.2, "b": 1.7}.get(k), e) for i, k, e in rows], "vec_id long, label double, embedding array<double>"))
    for found in (text, number):
        assert {r["vec_id"]: r["n_links"] for r in found.collect()} == {1: 1, 2: 1, 3: 0, 4: 0}


def test_images_without_ids_do_not_join_strangers(spark):
    vectors = spark.createDataFrame([(i, np.random.default_rng(i).normal(size=32).tolist()) for i in (5, 9)], "vec_id long, embedding array<double>")
    drawn = media.images_of_vectors(vectors, edit_every=1000).collect()
    rows = []
    for r in drawn:
        image = np.frombuffer(r["pixels"], np.uint8).reshape(-1, r["width"])
        copy = np.ascontiguousarray(np.rint(media.edited(image.astype(float), 0)).astype(np.uint8))
        rows += [(r["media_id"], bytes(r["pixels"]), r["width"], "x"), (None, copy.tobytes(), copy.shape[1], "y")]
    got = media.find_copies(spark.createDataFrame(rows, "media_id long, pixels binary, width int, node string")).collect()
    assert sorted((r["media_id"] or 0, r["component_id"], r["kept"]) for r in got) == [(0, 5, False), (0, 9, False), (5, 5, True), (9, 9, True)]


@pytest.fixture(scope="module")
def crowded(spark):
    rows = [(i, f"some words of document number {i} and token = abcdefgh{i:04d}", "en", f"src{i % 5}", 50) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *(F.lit(k).alias(c) for k, c in enumerate(INNER)))


def test_rows_keep_columns_of_inner_names(spark, crowded):
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(40)], "doc_id long, toxic int, place string")
    for made in (secrets.redact(crowded), mixing.draw(crowded, budget_share=0.9, max_epochs=1), simhash.keep_one(crowded, budget=0), simhash.keep_one_similar(crowded), toxicity.drop_toxic(crowded, labels)):
        assert made.columns == crowded.columns
        assert {tuple(r[c] for c in INNER) for r in made.collect()} == {tuple(range(len(INNER)))}
    masked = secrets.redact(crowded)
    assert masked.where("text like '%[secret]%'").count() == 40 and masked.where("n_chars = length(text)").count() == 40


def test_mixing_of_ties_and_unnamed_rows(spark):
    rows = [(None, "a b c", "en", "src1")] * 7 + [(1, "a b c", "en", "src1")] * 5 + [(2, "", None, None), (3, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    drawn = mixing.mixture(docs, budget_share=0.5, max_epochs=1)
    assert drawn.agg(F.sum("tokens")).first()[0] == 18 and drawn.where("copies > 1").count() == 0
    assert mixing.mixture(docs.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1, 5, 20, 100, 1000])
def test_false_share_in_pools_of_any_size(size):
    """Random tokens have p spread evenly, the others gather at zero: of what is accepted at most a twentieth is false on average."""
    rng, false, found, pools = random.Random(size), 0.0, 0, 400
    for _ in range(pools):
        share = rng.choice([0.0, 0.3, 0.7, 1.0])
        tokens = [(real, rng.random() ** (1 if real else 40)) for real in (rng.random() < share for _ in range(size))]
        counts = {f"n{i}": sum(p > t for _, p in tokens) for i, t in enumerate(secrets.GRID)}
        limit = secrets.least_p([counts | {"size": size, "tail": sum(p > secrets.TAIL for _, p in tokens)}])
        taken = [real for real, p in tokens if limit is not None and p > limit]
        found += len(taken)
        false += (1 - sum(taken) / len(taken)) if taken else 0.0
    assert false / pools <= 0.05 and (found > 0 or size < 100)


def test_two_tokens_mask_nothing(spark):
    key = "kJ8sQ2vXz0Lr7Tn4Wd9Yb3Hc"
    rows = [(1, "buildArtifactSnapshot42Xq/configPath"), (2, f"see {key} there")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["text"] for r in secrets.redact(docs).orderBy("doc_id").collect()] == [t for _, t in rows]
