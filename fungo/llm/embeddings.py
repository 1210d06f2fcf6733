"""Embedding near-duplicates with randomised-rotation binary codes.

A vector is turned by one random rotation; the signs of the result are its code
and the inner product of code and vector is its correction factor. Both are
worked out once and stored with the vector. Code
and factor give an unbiased estimate of the inner product with any other vector
and a bound on its error. A pair whose upper bound is under the threshold is
settled; only the rest is computed again, in double precision.

Pairs are looked for in buckets of several tables of sign bits, whose number
follows from the wanted recall at the threshold itself (pairs above it are found
more surely). Vectors that are equal in every bit enter once, with their number.
Buckets that are too large are split into pairs of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, FloatType, IntegerType, LongType, ShortType

from .components import connected_components
from .shared import split_hot, stage
from .simhash import _Forest

#: Standard deviations in the confidence bound, recall at the threshold, vectors in a block, expected vectors in a bucket.
DEVIATIONS, RECALL, BLOCK, BUCKET = 6.0, 0.998, 2_000, 64


def tables_for(n: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for a largest group of n vectors."""
    bits = min(24, max(8, round(math.log2(max(n, 1) / BUCKET))))
    hit = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - hit))


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _coded(rotations: dict[int, np.ndarray], planes: dict[int, np.ndarray], tables: int, bits: int, kind: str):
    """Adds to each vector its code (sign bits after rotation), correction factor, and bucket numbers in all tables."""
    weight = 1 << np.arange(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, raw = batch["dim"].to_numpy(), batch["vec"].to_pylist()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = _unit(np.frombuffer(b"".join(raw[i] for i in at), kind).astype(float).reshape(len(at), dim))
                turned = x @ rotations[int(dim)]
                code = np.packbits(turned > 0, axis=1, bitorder="little")
                factor = np.abs(turned).sum(1) / math.sqrt(dim)
                keys = ((x @ planes[int(dim)]).reshape(len(at), tables, bits) > 0) @ weight
                some = batch.take(pa.array(at))
                more = [pa.array([c.tobytes() for c in code], pa.binary()), pa.array(factor), pa.array(list(keys.astype(np.int32)), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*some.columns, *more], names=[*some.schema.names, "code", "factor", "keys"])

    return run


def _pairs(rotations: dict[int, np.ndarray], threshold: float, kind: str):
    """Whole groups of vectors to (a, b, n): links of a forest where b is set, else n more links of a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = [b for b in batches if b.num_rows]
        if not frames:
            return
        rows = pa.Table.from_batches(frames).combine_chunks()
        col = {c: rows[c].to_numpy() for c in ("label", "dim", "t", "key", "bi", "bj", "side", "node", "copies")}
        order = np.lexsort([col[c] for c in ("node", "side", "bj", "bi", "key", "t", "dim", "label")])
        group = np.stack([col[c][order].astype(np.int64) for c in ("label", "dim", "t", "key", "bi", "bj")])
        starts = np.flatnonzero(np.concatenate([[True], (group[:, 1:] != group[:, :-1]).any(0)]))
        vec, keys, codes, factors = (rows[c].combine_chunks() for c in ("vec", "keys", "code", "factor"))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for lo, hi in zip(starts, np.append(starts[1:], len(order)), strict=True):
            if hi - lo < 2:
                continue
            at = order[lo:hi]
            dim, own = int(group[1, lo]), group[4, lo] == group[5, lo]
            cut = hi - lo if own else int((col["side"][at] == 0).sum())
            if not own and cut in (0, hi - lo):
                continue
            some = pa.array(at)
            x = _unit(np.frombuffer(b"".join(vec.take(some).to_pylist()), kind).astype(float).reshape(len(at), dim))
            first, second = (slice(None), slice(None)) if own else (slice(0, cut), slice(cut, None))
            turned = x @ rotations[dim]
            packed = np.frombuffer(b"".join(codes.take(some).to_pylist()), np.uint8).reshape(len(at), -1)
            code = (2.0 * np.unpackbits(packed, axis=1, bitorder="little", count=dim) - 1) / math.sqrt(dim)
            factor = factors.take(some).to_numpy()
            estimate = (code[first] @ turned[second].T) / factor[first, None]
            bound = DEVIATIONS * np.sqrt(np.maximum(0, 1 - factor[first] ** 2)) / factor[first] / math.sqrt(max(1, dim - 1))
            i, j = np.nonzero(estimate + bound[:, None] >= threshold)
            i, j = (i[i < j], j[i < j]) if own else (i, j + cut)
            near = (x[i] * x[j]).sum(1) >= threshold
            i, j = i[near], j[near]
            if len(i):
                k = np.array(keys.take(some).to_pylist())
                fresh = (k[i] == k[j]).argmax(1) == group[2, lo]  # the first table in which the two meet
                i, j = i[fresh], j[fresh]
            if len(i):
                ids, copies = col["node"][at], col["copies"][at]
                links = np.bincount(i, copies[j], len(at)) + np.bincount(j, copies[i], len(at))
                forest = _Forest(len(at))
                forest.link(i, j)
                member, some_links = np.flatnonzero(forest.label != np.arange(len(at))), np.flatnonzero(links)
                out.append((ids[member], ids[forest.label[member]], np.zeros(len(member), np.int64)))
                out.append((ids[some_links], np.full(len(some_links), -1), links[some_links].astype(np.int64)))
        if out:
            a, b, n = (np.concatenate(c) for c in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64(), mask=n > 0), pa.array(n, pa.int64())], names=["a", "b", "n"])

    return run


def _to_bytes(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.dtype(kind).itemsize
        for batch in batches:
            flat = batch["v"].flatten().to_numpy(zero_copy_only=False).astype(kind).tobytes()
            offsets = np.concatenate([[0], np.cumsum(batch["dim"].to_numpy())]) * size
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], batch["dim"], pa.array([flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())], names=["vec_id", "label", "dim", "vec"])

    return run


def _label(vectors: DataFrame, label_col: str) -> Column:
    """Labels as numbers: whole ones as they are, any other kind by a hash of its text."""
    kind = vectors.schema[label_col].dataType
    label = F.col(label_col)
    return label.cast("long") if isinstance(kind, (ByteType, ShortType, IntegerType, LongType)) else F.when(label.isNotNull(), F.xxhash64(label.cast("string")))


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", seed: int = 42, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors with equal labels link at a cosine of ``threshold`` or more; none
    below it is linked. Null labels, and vectors that are null, empty, zero or
    hold null or non-finite components, link with nothing; so do vectors of
    different lengths. Rows that repeat are copies that link with each other. A
    row without an id links like any other; its component is the least id that
    links reach, null if there is none, and it is never kept. An empty table
    gives no row. Other columns are not read.
    """
    # single precision is kept where the table has it: the bytes are half as many and the same numbers
    kind = "<f4" if vectors.schema[vector_col].dataType.elementType == FloatType() else "<f8"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), _label(vectors, label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    finite: Column = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    good = rows.where(sound).withColumn("dim", F.size("v").cast("long")).mapInArrow(_to_bytes(kind), "vec_id long, label long, dim long, vec binary")
    good = stage(good.withColumn("same", F.sha2("vec", 256)), "vectors")
    reps = stage(good.groupBy("label", "dim", "same").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min("vec").alias("vec")).withColumn("node", F.monotonically_increasing_id()), "distinct_vectors")
    sizes = reps.groupBy("label", "dim").count().groupBy("dim").agg(F.max("count").alias("n")).collect()
    bits, tables = tables_for(max((r["n"] for r in sizes), default=1), threshold, recall)
    rotations = {r["dim"]: rotation(r["dim"], seed) for r in sizes}
    planes = {d: np.random.default_rng([seed, d, 1]).normal(size=(d, tables * bits)) for d in rotations}
    schema = "label long, dim long, node long, copies long, vec binary, code binary, factor double, keys array<int>"
    coded = stage(reps.select("label", "dim", "node", "copies", "vec").mapInArrow(_coded(rotations, planes, tables, bits, kind), schema), "coded_vectors")
    rows_by_key = coded.select("*", F.posexplode("keys").alias("t", "key"))
    group = ["label", "dim", "t", "key"]
    met = split_hot(rows_by_key, group, "node", block).repartition(*group, "bi", "bj").mapInArrow(_pairs(rotations, threshold, kind), "a long, b long, n long")
    met = stage(met, "vector_links")
    roots = connected_components(met.where("b is not null").select("a", "b"))
    counts = met.where("b is null").groupBy(F.col("a").alias("linked")).agg(F.sum("n").alias("n"))
    placed = reps.select("label", "dim", "same", F.col("node").alias("own"), "rep", "copies").join(counts, F.col("own") == F.col("linked"), "left").join(roots, F.col("own") == F.col("node"), "left")
    placed = stage(placed.select("label", "dim", "same", "rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "own").alias("root")), "placed_vectors")
    known = placed.join(placed.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("label", "dim", "same", "n_links", "component_id")
    linked = good.select("vec_id", "label", "dim", "same").join(known, ["label", "dim", "same"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
