"""Cropped and edited copies of images, by local descriptors.

Corners are found at several scales, turned to the direction of their patch's
centroid, and described by 128 comparisons of smoothed brightness. Each corner
with each of its NEIGHBOURS nearest corners makes a row; a bucket takes BITS bits
of the one descriptor, BITS of the other, and the difference of their levels.
Images are candidates if MIN_SHARED such rows meet: in a bucket, both corners close,
the turn from one to the other the same. Two strangers often share a corner that
looks alike, but seldom two of them side by side, so few strangers meet. Of a
candidate pair all corners are compared, close ones vote for the turn, scale and
shift that would lay one image over the other, and images link when enough corners
agree. Whether two images are candidates depends on these two alone, not on the
size of the table or of a bucket.

In each bucket every image is first paired with one hub, the image of least number,
which is the same in most buckets of a group of copies. Images that are still in
different components afterwards are paired all with all, large buckets in blocks.
A group of copies costs about a star.

Images with equal pixels enter once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import drop_staged, split_hot, stage

#: Descriptor: comparisons, patch radius, directions. Corners kept of 64 x 64 pixels of a level; a level has 1 / STEP the side of the one before.
TESTS, RADIUS, TURNS, CORNERS, STEP = 128, 8, 24, 32, math.sqrt(2)
#: Orders of bits, and bits drawn for each; bits of either corner in a bucket; corners that each corner is paired with; meetings that make candidates.
TABLES, DEEP_BITS, BITS, NEIGHBOURS, MIN_SHARED = 6, 60, 16, 6, 1
#: A level's difference counts as so many pixels of distance; greatest difference of directions from corner to neighbour; levels are under 64.
LEVEL_PIXELS, TURN_SLACK, LEVELS = 3, 2, 64
#: Greatest distance of a match; corners that must agree within CELL pixels and two directions.
NEAR, AGREE, CELL = 18, 5, 8
#: Rows of a bucket in one block; comparisons and image pairs at once.
BLOCK, PAIRS_AT_ONCE, IMAGES_AT_ONCE = 2_000, 500_000, 500
CORNER = np.dtype([("x", "<i4"), ("y", "<i4"), ("scale", "u1"), ("turn", "u1"), ("code", "<u8", (2,))])


@lru_cache(1)
def _pattern() -> tuple[np.ndarray, np.ndarray]:
    """Offsets (turn, test, 2 points, y x) of the comparisons, and the order of bits in each table."""
    rng = np.random.default_rng(20)
    at = np.clip(rng.normal(0, RADIUS / 2.2, size=(TESTS, 2, 2)), -RADIUS * 0.7, RADIUS * 0.7)
    turns = 2 * np.pi * np.arange(TURNS) / TURNS
    rotate = np.stack([np.stack([np.cos(turns), np.sin(turns)], -1), np.stack([-np.sin(turns), np.cos(turns)], -1)], -2)  # y x
    offsets = np.rint(np.einsum("tij,kpj->tkpi", rotate, at)).astype(np.int64)
    return offsets, np.stack([rng.permutation(TESTS)[:DEEP_BITS] for _ in range(TABLES)])


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Mean over squares of 2r + 1, edges repeated."""
    p = np.pad(x, r + 1, mode="edge").cumsum(0).cumsum(1)
    k = 2 * r + 1
    return (p[k:-1, k:-1] - p[: -k - 1, k:-1] - p[k:-1, : -k - 1] + p[: -k - 1, : -k - 1]) / (k * k)


def resize(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear."""
    for axis, n in ((0, height), (1, width)):
        at = np.clip((np.arange(n) + 0.5) * x.shape[axis] / n - 0.5, 0, x.shape[axis] - 1)
        low = np.minimum(at.astype(np.int64), max(x.shape[axis] - 2, 0))
        part = (at - low).reshape((-1, 1) if axis == 0 else (1, -1))
        x = np.take(x, low, axis) * (1 - part) + np.take(x, np.minimum(low + 1, x.shape[axis] - 1), axis) * part
    return x


def describe(image: np.ndarray) -> np.ndarray:
    """Corners (x, y in pixels of the image, level, turn, 128 bits) of a grey image."""
    found = [np.zeros(0, CORNER)]
    offsets, _ = _pattern()
    disc = np.array([(y, x) for y in range(-RADIUS, RADIUS + 1) for x in range(-RADIUS, RADIUS + 1) if x * x + y * y <= RADIUS * RADIUS])
    level, scale = image.astype(float), 0
    while min(level.shape) > 2 * RADIUS + 4 and scale < 64:
        h, w = level.shape
        smooth = _box(level, 1)
        gy, gx = np.gradient(smooth)
        a, b, c = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        corner = a * b - c * c - 0.05 * (a + b) ** 2
        inner = corner[RADIUS : h - RADIUS, RADIUS : w - RADIUS]
        around = corner
        for axis, n in ((0, h), (1, w)):  # greatest of 5 x 5
            around = np.maximum.reduce([np.take(around, range(RADIUS + d, n - RADIUS + d), axis) for d in range(-2, 3)])
        y, x = np.nonzero((inner == around) & (inner > max(1e-6, 0.01 * inner.max(initial=0))))
        best = np.lexsort((x, y, -inner[y, x]))[: max(CORNERS, CORNERS * h * w // 4096)]
        y, x = y[best] + RADIUS, x[best] + RADIUS
        patch = smooth[y[:, None] + disc[:, 0], x[:, None] + disc[:, 1]]
        turn = np.rint(np.arctan2(patch @ disc[:, 0], patch @ disc[:, 1]) * TURNS / (2 * np.pi)).astype(np.int64) % TURNS
        at = offsets[turn]  # corner, test, point, y x
        first = smooth[y[:, None] + at[:, :, 0, 0], x[:, None] + at[:, :, 0, 1]]
        second = smooth[y[:, None] + at[:, :, 1, 0], x[:, None] + at[:, :, 1, 1]]
        some = np.zeros(len(x), CORNER)
        some["x"], some["y"] = np.rint((x + 0.5) * image.shape[1] / w - 0.5), np.rint((y + 0.5) * image.shape[0] / h - 0.5)
        some["scale"], some["turn"] = scale, turn
        some["code"] = np.packbits(first < second, axis=1, bitorder="little").view("<u8").reshape(-1, 2)
        found.append(some)
        level, scale = resize(level, round(h / STEP), round(w / STEP)), scale + 1
    return np.concatenate(found)


def table_keys(codes: np.ndarray) -> np.ndarray:
    """Chosen bits of each descriptor in each table, in the lowest bits; the table in the highest."""
    one = np.unpackbits(np.ascontiguousarray(codes).view(np.uint8).reshape(len(codes), -1), axis=1, bitorder="little")
    weight = np.int64(1) << np.arange(DEEP_BITS, dtype=np.int64)
    return np.stack([one[:, places] @ weight + (np.int64(t) << DEEP_BITS) for t, places in enumerate(_pattern()[1])], -1)


PAIR = ("c0", "c1", "n0", "n1", "turn")
KEY_COLUMNS = "node long, bucket long, c0 long, c1 long, n0 long, n1 long, turn int"


def _close(a: str, b: str) -> Column:
    """Whether two rows of PAIR, in columns named by ``a`` and ``b`` with {} for the name, hold close corners and the same turn."""
    x, y = ({c: F.col(n.format(c)) for c in PAIR} for n in (a, b))
    apart = {c: F.bit_count(x[c].bitwiseXOR(y[c])) for c in PAIR[:4]}
    turn = F.pmod(x["turn"] - y["turn"] + TURN_SLACK, F.lit(TURNS)) <= 2 * TURN_SLACK
    return (apart["c0"] + apart["c1"] <= NEAR) & (apart["n0"] + apart["n1"] <= NEAR) & turn


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), IMAGES_AT_ONCE):
            some, found = batch.slice(at, IMAGES_AT_ONCE), []
            for pixels, width in zip(some["pixels"], some["width"].to_pylist(), strict=True):
                raw = np.frombuffer(pixels.as_py() or b"", np.uint8)
                sound = width and width > 0 and len(raw) and len(raw) % width == 0
                found.append(describe(raw.reshape(-1, width)).tobytes() if sound else b"")
            yield pa.RecordBatch.from_arrays([some["media_id"], some["same"], pa.array(found, pa.binary())], names=["media_id", "same", "corners"])


def pair_rows(corners: np.ndarray) -> tuple[np.ndarray, ...]:
    """(bucket, i, k, turn): each corner with its nearest ones, by places in ``corners``."""
    at = np.stack([corners["x"], corners["y"]], 1).astype(float)
    level = corners["scale"].astype(np.int64)
    away = np.hypot(*(at[:, None] - at[None]).transpose(2, 0, 1)) + LEVEL_PIXELS * np.abs(level[:, None] - level)
    np.fill_diagonal(away, np.inf)
    nearest = np.argsort(away, axis=1, kind="stable")[:, : min(NEIGHBOURS, len(corners) - 1)]
    i, k = np.repeat(np.arange(len(corners)), nearest.shape[1]), nearest.ravel()
    keys, mask = table_keys(corners["code"]), np.int64((1 << BITS) - 1)
    bucket = (keys[i, 0] & mask) | ((keys[k, 1] & mask) << BITS) | ((level[k] - level[i] + LEVELS) << 2 * BITS)
    return bucket, i, k, (corners["turn"][k].astype(np.int32) - corners["turn"][i]) % TURNS


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, corners) to (node, bucket, c0, c1, n0, n1, turn), each descriptor of an image once."""
    for batch in batches:
        found = []
        for node, raw in zip(batch["node"].to_pylist(), batch["corners"], strict=True):
            corners = np.frombuffer(raw.as_py(), CORNER)
            corners = corners[np.sort(np.unique(corners["code"], axis=0, return_index=True)[1])]
            if len(corners) > 1:
                bucket, i, k, turn = pair_rows(corners)
                code = corners["code"].view(np.int64).reshape(-1, 2)
                found.append((np.full(len(i), node, np.int64), bucket, *code[i].T, *code[k].T, turn.astype(np.int32)))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["node", "bucket", *PAIR])


def matches(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, ...]:
    """(pair, i, j): places in ``a`` and ``b`` of close corners of each pair. Pair k has the next na[k] of ``a`` and nb[k] of ``b``."""
    pair = np.repeat(np.arange(len(na)), na)
    partners, begin = nb[pair], (np.cumsum(nb) - nb)[pair]
    total, lo, out = np.cumsum(partners), 0, []
    while lo < len(pair):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS_AT_ONCE, side="right")))
        n = partners[lo:hi]
        i = np.repeat(np.arange(lo, hi), n)
        j = begin[i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        near = np.bitwise_count(a["code"][i] ^ b["code"][j]).sum(1) <= NEAR
        out.append((pair[i[near]], i[near], j[near]))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def agreeing(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """For each pair of images, the greatest number of corners of either that agree on how b lies over a."""
    pair, i, j = matches(a, b, na, nb)
    most = np.zeros(len(na), np.int64)
    if not len(pair):
        return most
    turn = (a["turn"][i].astype(np.int64) - b["turn"][j]) % TURNS
    scale = a["scale"][i].astype(np.int64) - b["scale"][j]
    angle, s = turn * 2 * np.pi / TURNS, STEP**scale
    tx = a["x"][i] - s * (np.cos(angle) * b["x"][j] - np.sin(angle) * b["y"][j])
    ty = a["y"][i] - s * (np.sin(angle) * b["x"][j] + np.cos(angle) * b["y"][j])
    # grids half a cell apart, so that agreeing votes share a cell of one of them
    for off in (0.0, 0.5):
        for o in (0, 1):
            cell = np.stack([pair, (turn + o) // 2 % (TURNS // 2), scale, np.floor(tx / CELL + off).astype(np.int64), np.floor(ty / CELL + off).astype(np.int64)], 1)
            cell, which = np.unique(cell, axis=0, return_inverse=True)
            which = which.ravel()
            # a corner counts once in a cell
            votes = np.minimum(*(np.bincount(np.unique(which * (len(c) + 1) + k) // (len(c) + 1), minlength=len(cell)) for c, k in ((a, i), (b, j))))
            np.maximum.at(most, cell[:, 0], votes)
    return most


def _agree(agree: int):
    """Pairs with the corners of both to pairs that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), IMAGES_AT_ONCE):
                some = batch.slice(at, IMAGES_AT_ONCE)
                ca, cb = (some[c].to_pylist() for c in ("corners_a", "corners_b"))
                a, b = (np.frombuffer(b"".join(c), CORNER) for c in (ca, cb))
                na, nb = (np.array([len(x) // CORNER.itemsize for x in c]) for c in (ca, cb))
                linked = pa.array(agreeing(a, b, na, nb) >= agree)
                yield pa.RecordBatch.from_arrays([some["a"].filter(linked), some["b"].filter(linked)], names=["a", "b"])

    return run


def _checked(pairs: DataFrame, images: DataFrame, agree: int, name: str) -> DataFrame:
    """Those of ``pairs`` (a, b) that link, staged."""
    with_a = pairs.join(images.select(F.col("node").alias("a"), F.col("corners").alias("corners_a")), "a")
    both = with_a.join(images.select(F.col("node").alias("b"), F.col("corners").alias("corners_b")), "b")
    return stage(both.select("a", "b", "corners_a", "corners_b").mapInArrow(_agree(agree), "a long, b long"), name)


def _rooted(rows: DataFrame, roots: DataFrame, col: str, name: str) -> DataFrame:
    """``rows`` with the component of a node, itself where it has no link."""
    found = roots.select(F.col("node").alias("__node"), F.col("root").alias("__root"))
    return rows.join(found, F.col(col) == F.col("__node"), "left").withColumn(name, F.coalesce("__root", col)).drop("__node", "__root")


def _apart(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Those of ``pairs`` whose ends no chain of ``links`` joins."""
    roots = stage(connected_components(links), "media_roots")
    return _rooted(_rooted(pairs, roots, "a", "root_a"), roots, "b", "root_b").where("root_a <> root_b").drop("root_a", "root_b")


def _crossing(shared: DataFrame, links: DataFrame, block: int) -> DataFrame:
    """Candidates (a, b) that are in different components: all of them, ``block`` rows of a bucket against as many at once. ``shared`` is deleted."""
    placed = _rooted(shared, stage(connected_components(links), "media_roots"), "node", "root").select("node", "bucket", *PAIR, "root")
    open_ = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("bucket")
    open_rows = stage(placed.join(open_, "bucket", "left_semi"), "open_buckets")
    drop_staged(shared)
    left = split_hot(open_rows, ["bucket"], "node", block)
    keys = ["bucket", "bi", "bj"]
    one, two = (left.select(*keys, *(F.col(c).alias(f"{c}_{end}") for c in ("node", "root", "side", *PAIR))) for end in "ab")
    once = F.expr("if(bi = bj, node_a < node_b, side_a < side_b)")
    met = one.join(two, keys).where(once & (F.col("root_a") != F.col("root_b")) & _close("{}_a", "{}_b"))
    pairs = met.groupBy(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).count()
    return pairs.where(F.col("count") >= MIN_SHARED).select("a", "b")


def find_copies(media: DataFrame, id_col: str = "media_id", pixels_col: str = "pixels", width_col: str = "width", agree: int = AGREE, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``media``: media_id, component_id (least id that links reach), kept.

    ``pixels`` are grey bytes, row by row, of ``width`` columns. Images that are
    null, empty, too small for a patch or of bytes that do not fill their rows
    link with nothing but images of the same bytes. Nulls are no copies of each
    other. An image without an id links like any other and is never kept; a
    component of such images alone is null. An empty table gives no row. Other
    columns are not read. ``agree`` is two or more, as candidates share two corners.
    """
    rows = media.select(F.col(id_col).cast("long").alias("media_id"), F.col(pixels_col).alias("pixels"), F.col(width_col).cast("int").alias("width"))
    shape = F.sha2(F.concat(F.coalesce("width", F.lit(-1)).cast("string").cast("binary"), F.lit(b":"), F.col("pixels")), 256)
    same = F.coalesce(shape, F.concat(F.lit("null"), F.coalesce("media_id", F.lit(-1))))
    described = stage(rows.withColumn("same", same).mapInArrow(_describe, "media_id long, same string, corners binary"), "described_media")
    distinct = described.groupBy("same").agg(F.min("media_id").alias("rep"), F.max("corners").alias("corners"))
    # an image's node is its place in the staged table, a number that packs well in the many rows of corners
    placed_once = stage(distinct, "distinct_media")
    images = stage(placed_once.select("same", "rep", F.monotonically_increasing_id().alias("node"), "corners"), "images")
    drop_staged(placed_once)
    sets = images.where(F.octet_length("corners") > 0).select("node", "corners")
    keys = sets.mapInArrow(_keys, KEY_COLUMNS).repartition("bucket")
    hubs = keys.groupBy("bucket").agg(F.min(F.struct("node", *PAIR)).alias("hub"), F.max("node").alias("last")).where("hub.node < last")
    shared = stage(keys.join(hubs.select("bucket", F.col("hub.node").alias("hub"), *(F.col(f"hub.{c}").alias(f"hub_{c}") for c in PAIR)), "bucket"), "shared_buckets")
    to_hub = shared.where((F.col("node") != F.col("hub")) & _close("{}", "hub_{}"))
    stars = stage(to_hub.groupBy(F.col("hub").alias("a"), F.col("node").alias("b")).count().where(F.col("count") >= MIN_SHARED), "media_stars")
    # each image with the hub that it shares most with; then other hubs, where still apart; then all others
    best = stars.groupBy("b").agg(F.max_by("a", F.struct("count", "a")).alias("a")).select("a", "b")
    links = _checked(best, sets, agree, "best_links")
    links = links.unionByName(_checked(_apart(stars.select("a", "b"), links), sets, agree, "hub_links"))
    links = links.unionByName(_checked(_crossing(shared, links, block), sets, agree, "other_links"))
    placed = stage(_rooted(images.select("same", "rep", "node"), stage(connected_components(links), "media_roots"), "node", "root"), "placed_media")
    named = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    known = placed.join(named, "root").select("same", "component_id")
    out = described.select("media_id", "same").join(known, "same")
    return out.select("media_id", "component_id", F.coalesce(F.col("media_id") == F.col("component_id"), F.lit(False)).alias("kept"))


SIDE = 64


@lru_cache(8)
def _waves(dim: int) -> np.ndarray:
    """A plane wave for each component of a vector."""
    rng = np.random.default_rng([5, dim])
    y, x = np.mgrid[0:SIDE, 0:SIDE]
    angle, length, phase = rng.uniform(0, 2 * math.pi, dim), rng.uniform(5, 16, dim), rng.uniform(0, 2 * math.pi, dim)
    k = 2 * math.pi / length
    return np.cos(np.multiply.outer(k * np.cos(angle), x) + np.multiply.outer(k * np.sin(angle), y) + phase[:, None, None]).reshape(dim, -1)


#: Kinds of edited images that can be drawn.
EDITS = 5


def turned(image: np.ndarray, degrees: float) -> np.ndarray:
    """The middle of the image after a turn, bilinear; no place outside the image enters."""
    side = int(min(image.shape) / (abs(math.sin(math.radians(degrees))) + math.cos(math.radians(degrees))))
    s, c = math.sin(math.radians(degrees)), math.cos(math.radians(degrees))
    v, u = np.mgrid[0:side, 0:side] - (side - 1) / 2
    y, x = c * v + s * u + (image.shape[0] - 1) / 2, c * u - s * v + (image.shape[1] - 1) / 2
    y, x = np.clip(y, 0, image.shape[0] - 1.001), np.clip(x, 0, image.shape[1] - 1.001)
    i, j = y.astype(np.int64), x.astype(np.int64)
    a, b = y - i, x - j
    return (image[i, j] * (1 - a) + image[i + 1, j] * a) * (1 - b) + (image[i, j + 1] * (1 - a) + image[i + 1, j + 1] * a) * b


def edited(image: np.ndarray, kind: int) -> np.ndarray:
    """Cropped, darker and marked; turned by a quarter and cropped; the middle alone; three quarters of the size; turned by 12 degrees."""
    if kind == 0:
        image = 0.9 * image[3:, 5:] + 8
        image[-6:, -20:] = 255
        return image
    if kind == 1:
        return np.rot90(image)[4:, 2:]
    if kind == 2:
        return image[10:-6, 8:-8]
    if kind == 3:
        return resize(image, round(image.shape[0] * 0.75), round(image.shape[1] * 0.75))
    return turned(image, 12)


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pixels, widths = [], []
        for v, kind in zip(batch["v"].to_pylist(), batch["kind"].to_pylist(), strict=True):
            if not v or any(x is None or not math.isfinite(x) for x in v):
                pixels.append(None)
                widths.append(None)
                continue
            field = np.array(v) @ _waves(len(v))
            image = np.clip(128 + 48 * field / max(1e-9, field.std()), 0, 255).reshape(SIDE, SIDE)
            image = image if kind is None else edited(image, kind)
            pixels.append(np.rint(image).astype(np.uint8).tobytes())
            widths.append(image.shape[1])
        yield pa.RecordBatch.from_arrays([batch["media_id"], pa.array(pixels, pa.binary()), pa.array(widths, pa.int32())], names=["media_id", "pixels", "width"])


def images_of_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", edit_every: int = 8, edits: int = 3) -> DataFrame:
    """A media table (media_id, pixels, width) drawn from a vector table.

    Each vector is a sum of plane waves, so close vectors look alike. Every
    ``edit_every``-th row shows an edited image of the row before it, if there
    is such a row; the first ``edits`` kinds of ``edited`` take turns.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("media_id"), F.col(vector_col).cast("array<double>").alias("v"))
    again = F.pmod("media_id", F.lit(edit_every)) == edit_every - 1
    source = rows.where(F.pmod("media_id", F.lit(edit_every)) == edit_every - 2).select((F.col("media_id") + 1).alias("copy_id"), F.col("v").alias("source")).dropDuplicates(["copy_id"])
    kind = F.when(again & F.col("copy_id").isNotNull(), F.pmod(F.floor(F.col("media_id") / edit_every), F.lit(edits)).cast("int"))
    both = rows.join(source, rows["media_id"] == source["copy_id"], "left").select("media_id", F.coalesce("source", "v").alias("v"), kind.alias("kind"))
    return both.mapInArrow(_render, "media_id long, pixels binary, width int")
