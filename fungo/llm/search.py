"""Ranked lexical search by dual trees: the k best documents of every item, exactly.

Items and documents each stand in a hierarchy whose nodes hold coordinate maxima:
for every term the greatest weight below an item node, the greatest saturated
frequency below a document node. The product of two nodes bounds every score
below them, so a pair of nodes is dropped as a whole once that bound is under the
weakest kth score of the node's items. Nothing is dropped that could be ranked.

Texts are read once for each block of items: only the terms of the block are kept
of a document, as a short sparse vector, and written to the shared folder. Each
task then builds document trees over runs of vectors and walks them against the
item tree; the first walk, over a part of the documents, only finds lower bounds
of the kth scores, with which the second walk, over all of them, starts.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .alignment import ragged, slices
from .shared import stage

#: Terms of the items in one block, documents of one tree, children of a node, and the share of documents (one in so many) of the first walk.
BLOCK_TERMS, TREE_DOCS, FAN, FIRST_WALK = 200_000, 1024, 8, 32
#: Bytes that are no part of a term become blanks, capital letters small ones; the bytes of other characters stay.
_TABLE = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))
VECTORS = "doc_id long, n long, terms array<int>, times array<int>"
VECTORS_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))])
FOUND = "item_row int, doc_id long, score long"
FOUND_ARROW = pa.schema([("item_row", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and any character beyond ASCII; A-Z lower-cased."""
    return text.translate(_TABLE).split()


def _vectors(vocab: dict[bytes, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            n, ids, times, sizes = [], [], [], []
            for text in part.column("text").to_pylist():
                counts = Counter(terms_of(text or b""))
                n.append(counts.total())
                found = sorted((vocab[t], k) for t, k in counts.items() if t in vocab)
                ids += [t for t, _ in found]
                times += [k for _, k in found]
                sizes.append(len(found))
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int32())) for v in (ids, times)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), *lists], schema=VECTORS_ARROW)


class Level:
    """Sparse rows of one level of a hierarchy: terms and their maxima, and the first child of each row."""

    def __init__(self, ptr: np.ndarray, terms: np.ndarray, values: np.ndarray):
        self.ptr, self.terms, self.values = ptr, terms, values

    def __len__(self) -> int:
        return len(self.ptr) - 1

    def parents(self) -> Level:
        """Nodes of FAN neighbouring rows each, with the maximum of every coordinate."""
        owner = np.repeat(np.arange(len(self)), np.diff(self.ptr)) // FAN
        order = np.lexsort((self.terms, owner))
        o, t = owner[order], self.terms[order]
        first = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (t[1:] != t[:-1])))) if len(o) else np.zeros(0, np.int64)
        most = np.maximum.reduceat(self.values[order], first) if len(o) else self.values
        n = -(-len(self) // FAN)
        return Level(np.concatenate(([0], np.cumsum(np.bincount(o[first], minlength=n)))), t[first], most)

    def sums(self, rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """For each row the sum over its terms of value times ``dense``."""
        length = self.ptr[rows + 1] - self.ptr[rows]
        at = ragged(self.ptr[rows], length)
        total = np.concatenate(([0], np.cumsum(self.values[at] * dense[self.terms[at]])))
        ends = np.cumsum(length)
        return total[ends] - total[ends - length]


def hierarchy(rows: Level) -> list[Level]:
    """Levels from the rows up to a single node."""
    levels = [rows]
    while len(levels[-1]) > 1:
        levels.append(levels[-1].parents())
    return levels


def _ordered(rows: Level) -> tuple[np.ndarray, Level]:
    """Rows put next to those that share their weightiest terms, so that maxima stay tight."""
    n = len(rows)
    owner = np.repeat(np.arange(n), np.diff(rows.ptr))
    order = np.lexsort((rows.terms, -rows.values, owner))
    lead = np.full((2, n), -1, np.int64)
    length = np.diff(rows.ptr)
    for k in (0, 1):
        have = np.flatnonzero(length > k)
        lead[k, have] = rows.terms[order[rows.ptr[have] + k]]
    to = np.lexsort((lead[1], lead[0]))
    at = ragged(rows.ptr[to], length[to])
    return to, Level(np.concatenate(([0], np.cumsum(length[to]))), rows.terms[at], rows.values[at])


class Search:
    """Items of a block, their tree and their best documents so far."""

    def __init__(self, items: list[np.ndarray], weights: np.ndarray, k: int, floors: np.ndarray):
        ptr = np.concatenate(([0], np.cumsum([len(t) for t in items]))).astype(np.int64)
        terms = np.concatenate([*items, np.zeros(0, np.int64)]).astype(np.int64)
        self.order, rows = _ordered(Level(ptr, terms, weights[terms]))
        self.tree, self.k = hierarchy(rows), k
        self.best: list[list[tuple[int, float]]] = [[] for _ in items]
        #: the weakest score that still counts, item by item: at least 1, and never above the kth of all documents
        self.kth = np.maximum(1, floors[self.order])
        self.dense = np.zeros(len(weights), np.int64)
        self._lift()

    def _lift(self) -> None:
        self.weakest = [self.kth]
        while len(self.weakest[-1]) > 1:
            w = self.weakest[-1]
            self.weakest.append(np.minimum.reduceat(w, np.arange(0, len(w), FAN)))

    def walk(self, docs: Level, ids: list[int | None]) -> None:
        """Rank the documents of one tree; rows hold saturated frequencies, and weights lie with the items."""
        to, rows = _ordered(docs)
        tree = hierarchy(rows)
        self.ids = [ids[i] for i in to.tolist()]
        top = len(self.tree) - 1
        if len(rows) and len(self.tree[0]):
            self._pair(tree, len(tree) - 1, 0, top, np.zeros(1, np.int64))

    def _pair(self, tree: list[Level], level: int, node: int, height: int, nodes: np.ndarray) -> None:
        """A document node against item nodes: bound, prune, and go down on both sides."""
        docs = tree[level]
        span = slice(docs.ptr[node], docs.ptr[node + 1])
        at = docs.terms[span]
        if not len(at):
            return
        self.dense[at] = docs.values[span]
        while True:
            bound = self.tree[height].sums(nodes, self.dense)
            live = bound >= self.weakest[height][nodes]
            nodes = nodes[live]
            if not len(nodes) or not height:
                break
            height -= 1
            nodes = ragged(nodes * FAN, np.minimum(FAN, len(self.tree[height]) - nodes * FAN))
            if level:
                break
        self.dense[at] = 0
        if not len(nodes):
            return
        if level:
            for child in range(node * FAN, min((node + 1) * FAN, len(tree[level - 1]))):
                self._pair(tree, level - 1, child, height, nodes)
            if level == 2:
                self._lift()
        else:
            self._take(nodes, bound[live], self.ids[node])

    def _take(self, items: np.ndarray, scores: np.ndarray, doc_id: int | None) -> None:
        """Equal scores go to the smaller id; an unknown id comes last."""
        rank = -doc_id if doc_id is not None else -math.inf
        for i, score in zip(items.tolist(), scores.tolist(), strict=True):
            best = self.best[i]
            if len(best) < self.k:
                heapq.heappush(best, (score, rank))
            elif (score, rank) > best[0]:
                heapq.heapreplace(best, (score, rank))
            if len(best) == self.k:
                self.kth[i] = max(self.kth[i], best[0][0])

    def found(self) -> pa.RecordBatch:
        rows = [(i, -rank if rank != -math.inf else None, score) for i, best in zip(self.order.tolist(), self.best, strict=True) for score, rank in best]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([], [], []), FOUND_ARROW.types, strict=True)], schema=FOUND_ARROW)


def saturated(times: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * times) // (1000 * times + 8 * m)


def _search(items: list[np.ndarray], weights: np.ndarray, k: int, floors: np.ndarray, texts: int, words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    search = Search(items, weights, k, floors)
    for batch in batches:
        for start in range(0, batch.num_rows, TREE_DOCS):
            part = batch.slice(start, TREE_DOCS)
            length = np.asarray(part.column("terms").value_lengths().fill_null(0), np.int64)
            m = np.array([10 + (90 * n * texts) // words for n in part.column("n").to_pylist()], np.int64)
            times = np.asarray(part.column("times").flatten(), np.int64)
            rows = Level(np.concatenate(([0], np.cumsum(length))), np.asarray(part.column("terms").flatten(), np.int64), saturated(times, np.repeat(m, length)))
            search.walk(rows, part.column("doc_id").to_pylist())
    yield search.found()


def _blocks(items: DataFrame, most: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items with their distinct terms, so many terms at once; a longer item is a block by itself."""
    block, held = [], 0
    for item_id, text in items.toLocalIterator():
        terms = list(dict.fromkeys(terms_of(bytes(text or b""))))
        if block and held + len(terms) > most:
            yield block
            block, held = [], 0
        block.append((item_id, terms))
        held += len(terms)
    if block:
        yield block


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("item_row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _rank_block(rows: DataFrame, block: list[tuple[object, list[bytes]]], item_type: str, k: int) -> DataFrame:
    spark = rows.sparkSession
    vocab: dict[bytes, int] = {}
    items = [np.array([vocab.setdefault(t, len(vocab)) for t in terms], np.int64) for _, terms in block]
    vectors = stage(rows.mapInArrow(partial(_vectors, vocab), VECTORS), "term_vectors").where("n > 0")
    texts, words = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocab), np.int64)
    for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
        df[r[0]] = r[1]
    weights = np.array([math.floor(1000 * math.log((2 * texts + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    walk = lambda docs, floors: docs.mapInArrow(partial(_search, items, weights, k, floors, texts, words), FOUND)
    some = vectors.where(F.size("terms") > 0)
    # any k documents bound the kth score from below; which ones changes the work and not the result
    first = _top(walk(some.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(FIRST_WALK)) == 0), np.zeros(len(items), np.int64)), k)
    floors = np.zeros(len(items), np.int64)
    for r in first.where(F.col("rank") == k).select("item_row", "score").toLocalIterator():
        floors[r[0]] = r[1]
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], f"item_row int, item_id {item_type}")
    return _top(walk(some, floors), k).join(names, "item_row").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents with a score above 0 of every item.

    Every row of ``items`` is ranked by itself, also where its id is null or
    repeated; null and empty texts have no terms and no rows. Equal scores are
    ranked by ascending id (cast to long), unknown ids last, and rows that repeat
    an id each take a rank. Without documents there are no rows. Each block of
    items reads the texts once.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    queries = items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).cast("string").cast("binary").alias("text"))
    kind = queries.schema["item_id"].dataType.simpleString()
    parts = [_rank_block(rows, block, kind, k) for block in _blocks(queries, block_terms)]
    if not parts:
        return rows.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionAll, [stage(p, "ranked") for p in parts] if len(parts) > 1 else parts)


ORACLE = """
with d as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\\x{80}-\\x{10FFFF}]+')) as term from documents),
 len as (select doc_id, count(*) as n from d group by 1),
 g as (select count(*) as texts, cast(sum(n) as bigint) as words from len),
 tf as (select doc_id, term, count(*) as tf from d group by 1, 2),
 df as (select term, count(*) as df from tf group by 1),
 i as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\\x{80}-\\x{10FFFF}]+')) as term from benchmark),
 w as (select i.item_id, i.term, cast(floor(1000 * ln((2 * texts + 2) / cast(2 * df + 1 as double))) as bigint) as w from i join df on df.term = i.term cross join g),
 s as (select w.item_id, tf.doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * texts) // words)))) as bigint) as score
  from w join tf on tf.term = w.term join len on len.doc_id = tf.doc_id cross join g group by 1, 2)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score from s where score > 0
qualify row_number() over (partition by item_id order by score desc, doc_id) <= 10"""
