"""Copies among images: each kind of edit, votes against a plain comparison, and odd rows."""

from __future__ import annotations

import numpy as np
import pytest

from fungo.llm import media

SF = "/root/testdata/sf0.001"


def _image(seed, side=64, longest=16):
    """Waves in all directions, unlike each other."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:side, 0:side]
    field = sum(rng.normal() * np.cos(2 * np.pi / rng.uniform(5, longest) * (np.cos(a) * x + np.sin(a) * y) + rng.uniform(0, 7)) for a in rng.uniform(0, 7, 40))
    return np.rint(np.clip(128 + 48 * field / field.std(), 0, 255))


def _votes(a, b):
    return int(media.agreeing(a, b, np.array([len(a)]), np.array([len(b)]))[0])


def test_matches_equal_plain_comparison(monkeypatch):
    monkeypatch.setattr(media, "PAIRS_AT_ONCE", 100)
    sets = [media.describe(_image(i)) for i in range(4)] + [np.zeros(0, media.CORNER)]
    pairs = [(0, 1), (2, 2), (4, 1), (3, 0), (1, 4)]
    a, b = (np.concatenate([sets[p[k]] for p in pairs]) for k in (0, 1))
    na, nb = (np.array([len(sets[p[k]]) for p in pairs]) for k in (0, 1))
    got = set(zip(*(x.tolist() for x in media.matches(a, b, na, nb)), strict=True))
    want, at_a, at_b = set(), 0, 0
    for k, (i, j) in enumerate(pairs):
        for p, x in enumerate(sets[i]["code"]):
            for q, y in enumerate(sets[j]["code"]):
                if sum((int(u) ^ int(v)).bit_count() for u, v in zip(x, y, strict=True)) <= media.NEAR:
                    want.add((k, at_a + p, at_b + q))
        at_a, at_b = at_a + len(sets[i]), at_b + len(sets[j])
    assert got == want and len(got) > len(sets[2])


@pytest.mark.parametrize("side, change, least", [
    (64, lambda x: media.edited(x, 0), 1.0),
    (64, lambda x: media.edited(x, 1), 1.0),
    (64, lambda x: media.edited(x, 2), 1.0),
    (160, lambda x: x[100:150, 60:120], 0.9),
    (160, lambda x: np.rot90(x, 2)[20:, :-30], 1.0),
    (160, lambda x: np.rint(media.resize(x, 113, 113)), 0.9),
])
def test_edits_are_found_and_strangers_are_not(side, change, least):
    images = [_image(i, side) for i in range(20)]
    here, there = [media.describe(x) for x in images], [media.describe(change(x)) for x in images]
    keys = [[set((media.table_keys(c["code"]) & ((7 << 60) | (1 << 33) - 1)).ravel().tolist()) for c in some] for some in (here, there)]
    found = [_votes(a, b) >= media.AGREE and len(x & y) >= media.MIN_SHARED for a, b, x, y in zip(here, there, *keys, strict=True)]
    assert np.mean(found) >= least
    assert not any(_votes(here[i], there[i - 1]) >= media.AGREE for i in range(20))


def test_media_copies(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 160")
    images = media.images_of_vectors(vectors)
    odd = spark.createDataFrame([(9001, None, None), (9002, bytearray(b""), 4), (9003, bytearray(b"abc"), 2), (9004, bytearray(b"abcd"), 2), (9005, bytearray(b"abcd"), 2), (None, None, 3), (9006, bytearray(range(256)), 0)], "media_id long, pixels binary, width int")
    found = []
    for block in (2_000, 3):
        got = media.find_copies(images.unionByName(odd).unionByName(odd.limit(1)), block=block).toPandas()
        assert len(got) == 168
        got = got.dropna().drop_duplicates().set_index("media_id")
        pairs = [i for i in got.index if i < 9000 and i % 8 == 7 and i - 1 in got.index]
        assert np.mean([got.component_id[i] == got.component_id[i - 1] for i in pairs]) > 0.9
        alone = [i for i in got.index if i < 9000 and i % 8 not in (6, 7)]
        assert np.mean([got.component_id[i] == i for i in alone]) > 0.95
        assert got.component_id[9005] == 9004 and got.component_id[9001] == 9001 and (got.kept == (got.index == got.component_id)).all()
        found.append(got.component_id.sort_index().tolist())
    assert found[0] == found[1]
    assert media.find_copies(odd.limit(0)).count() == 0


def test_group_of_copies_is_one_component(spark):
    base, rng, rows = _image(1, 72), np.random.default_rng(0), []
    for i in range(60):
        y, x = rng.integers(0, 9, 2)
        rows.append((i, bytearray(np.clip(base[y : y + 64, x : x + 64] + rng.integers(-6, 7), 0, 255).astype(np.uint8).tobytes()), 64))
    rows += [(100 + i, bytearray(_image(50 + i).astype(np.uint8).tobytes()), 64) for i in range(10)]
    got = media.find_copies(spark.createDataFrame(rows, "media_id long, pixels binary, width int")).toPandas().set_index("media_id").sort_index()
    assert (got.component_id.loc[:59] == 0).all() and all(got.component_id[100 + i] == 100 + i for i in range(10))


def test_components_do_not_depend_on_the_size_of_the_table_or_of_a_bucket(spark):
    rows = []
    for i in range(40):
        image = _image(i)
        for k, x in enumerate((image, np.rint(media.turned(image, 12)))):
            rows.append((2 * i + k, bytearray(np.clip(x, 0, 255).astype(np.uint8).tobytes()), x.shape[1]))
    strangers = [(1_000 + i, bytearray(_image(500 + i).astype(np.uint8).tobytes()), 64) for i in range(600)]
    schema, found = "media_id long, pixels binary, width int", []
    for some, block in ((rows, 2_000), (rows + strangers, 2_000), (rows + strangers, 2)):
        got = media.find_copies(spark.createDataFrame(some, schema).repartition(4), block=block).toPandas().set_index("media_id").component_id
        found.append(got.sort_index().loc[:999].tolist())
    assert found[0] == found[1] == found[2]
    assert sum(a == b for a, b in zip(found[0][::2], found[0][1::2], strict=True)) > 5


def _meets(a, b):
    """Whether the rows of pairs of corners of two images meet."""
    (x, i, k, t), (y, j, m, u) = media.pair_rows(a), media.pair_rows(b)
    close = np.bitwise_count(a["code"][:, None] ^ b["code"]).sum(2) <= media.NEAR
    same = (x[:, None] == y) & ((t[:, None] - u + media.TURN_SLACK) % media.TURNS <= 2 * media.TURN_SLACK)
    return int((same & close[i[:, None], j] & close[k[:, None], m]).sum()) >= media.MIN_SHARED


def test_copies_are_candidates_and_strangers_seldom():
    images = [_image(i) for i in range(40)]
    here = [media.describe(x) for x in images]
    for kind in range(3):
        assert all(_meets(a, media.describe(np.rint(np.clip(media.edited(x, kind), 0, 255)))) for a, x in zip(here, images, strict=True))
    assert sum(_meets(here[i], here[j]) for i in range(40) for j in range(i)) <= 1


def test_strangers_of_few_directions_do_not_meet_with_their_square(spark):
    # images of like waves: single corners of strangers meet in many buckets, neighbouring pairs of them hardly
    rng, rows = np.random.default_rng(6), []
    for n in range(300):
        v = rng.normal(size=64) @ media._waves(64)
        rows.append((n, media.describe(np.rint(np.clip(128 + 48 * v / v.std(), 0, 255)).reshape(64, 64)).tobytes()))
    sets = spark.createDataFrame([(n, bytearray(c)) for n, c in rows], "node long, corners binary")
    found = sets.mapInArrow(media._keys, media.KEY_COLUMNS)
    one, two = (found.select("bucket", *(found[c].alias(f"{c}_{e}") for c in found.columns if c != "bucket")) for e in "ab")
    assert one.join(two, "bucket").where((one["node_a"] < two["node_b"]) & media._close("{}_a", "{}_b")).count() <= 30
