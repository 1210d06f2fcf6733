"""Alignment of two tokenizers by products of token-byte incidence matrices.

A text's bytes are cut twice, into tokens of A and of B. With a row for each
token and a column for each byte, both cuts are 0/1 matrices, held as index
pointers and indices (CSR). Row products A.B^T by Gustavson's rule give the links:
a token of A and one of B that share bytes, with the number of shared bytes.
Products of the token-group matrices give the pairs inside a group, a group being
the bytes between two neighbouring places where tokens of both end.

Tokens end on both sides before a blank or line feed that follows a character
which is no white space, so texts are cut there and each distinct stretch is
encoded and multiplied once for each task (in a bounded table); a document is the
sum and the concatenation of its stretches. Counts of linked id pairs are summed
over the corpus by Spark; those of the most frequent pairs (a stated number) go
to the tasks, counts of all others reach their documents by a shuffle join.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator, Sequence
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage

#: Id pairs whose counts go to the tasks, stretches held in a task, and characters worked on at once.
FREQUENT_PAIRS, CACHED_STRETCHES, SLICE_CHARS = 400_000, 300_000, 4_000_000
#: A pair of ids as one number: a * 2^32 + b.
B_BITS = 32
# Fixed value: the pattern by which byte-level BPE of this family cuts a text into pre-tokens.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CUT = re.compile(r"(?<=\S)(?=[ \n])")

Csr = tuple[np.ndarray, np.ndarray]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start .. start + length - 1 of every row, one row after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def product(a: Csr, bt: Csr, n_cols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the product of two 0/1 matrices by Gustavson's rule.

    Row i of the product is the sum of those rows of ``bt`` that row i of ``a``
    names; equal columns of a row are added up. Sorted by row and column.
    """
    a_ptr, a_idx = a
    b_ptr, b_idx = bt
    takes = b_ptr[a_idx + 1] - b_ptr[a_idx]
    row = np.repeat(np.repeat(np.arange(len(a_ptr) - 1), np.diff(a_ptr)), takes)
    key, value = np.unique(row * n_cols + b_idx[ragged(b_ptr[a_idx], takes)], return_counts=True)
    return key // n_cols, key % n_cols, value


def product_sizes(a: Csr, bt: Csr) -> np.ndarray:
    """Entries of each row of the product before equal columns are added up: the symbolic pass."""
    a_ptr, a_idx = a
    total = np.concatenate(([0], np.cumsum(np.diff(bt[0])[a_idx])))
    return total[a_ptr[1:]] - total[a_ptr[:-1]]


def owners(ends: np.ndarray) -> np.ndarray:
    """The token that each byte belongs to: the transposed incidence matrix, with one index a row."""
    return np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))


def overlap_links(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of two cuts of the same bytes, given by where tokens end: token of A, token of B, shared bytes."""
    n = int(a_ends[-1]) if len(a_ends) else 0
    token_byte = (np.concatenate(([0], a_ends)), np.arange(n))
    byte_token = (np.arange(n + 1), owners(b_ends))
    return product(token_byte, byte_token, max(len(b_ends), 1))


def shared_ends(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """Byte places where tokens of both cuts end."""
    return a_ends[np.isin(a_ends, b_ends, assume_unique=True)]


def group_matrix(ends: np.ndarray, groups: np.ndarray) -> Csr:
    """Token-group incidence: each token lies in one group."""
    return np.arange(len(ends) + 1), np.searchsorted(groups, ends)


def transposed(m: Csr, n_cols: int) -> Csr:
    ptr, idx = m
    order = np.argsort(idx, kind="stable")
    return np.concatenate(([0], np.cumsum(np.bincount(idx, minlength=n_cols)))), np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))[order]


class ByteLevel:
    """Side A: byte-level BPE of a ``tokenizers`` file. Gives ids, and the bytes of an id.

    Where ids stand in the order of merges, the ids are ranks, and the faster
    library for ranks gives the same answer; any other file is used as it is.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec["added_tokens"]}
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.bytes = [b""] * (max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for t, i in vocab.items():
            self.bytes[i] = bytes(byte[c] for c in t)
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [vocab["".join(m)] for m in pairs]
        pre = spec["pre_tokenizer"] or {}
        self.plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.ranks = None
        if self.plain and made == sorted(made) and made and made[0] >= 256:
            import tiktoken

            ranks = {b: i for i, b in enumerate(self.bytes) if b}
            self.ranks = tiktoken.Encoding("ranks", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        if self.ranks is not None:
            return [self.ranks.encode_ordinary(t) for t in texts]
        return [e.ids for e in self.model.encode_batch(list(texts), add_special_tokens=False)]


class Pieces:
    """Side B: a ``sentencepiece`` model, which itself puts a blank before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.blank = self.model.piece_to_id("▁")
        # no piece holds a line feed, or a blank after another character: what lies behind such a place does not depend on what lies before it
        self.plain = not any("\n" in p or "▁" in p.lstrip("▁") for p in pieces)

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        """Ids of stretches with their leading blank, where they have one."""
        bare = [not t.startswith(" ") for t in texts]
        ids = self.model.encode([t if b else t[1:] for t, b in zip(texts, bare, strict=True)], num_threads=1)
        # the blank of our own before a line feed is a token by itself, and goes again
        return [([self.blank] if not b else []) if not x and not b else (x[1:] if b else x) for x, b in zip(ids, bare, strict=True)]


class Aligner:
    """Stretches of text to links, groups and counts, each distinct stretch once.

    A stretch is known by its text, without the leading blank where a plain word follows it.
    """

    def __init__(self, a_path: str, b_path: str, held: int = CACHED_STRETCHES):
        self.a, self.b, self.most = ByteLevel(a_path), Pieces(b_path), held
        self.cuts = self.a.plain and self.b.plain
        self.names = [str(i) for i in range(max(len(self.a.bytes), len(self.b.bytes)))]
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.texts: list[bytes] = []
        self.figures = np.zeros((0, 6), np.int64)
        self.starts, self.links = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def cut(self, text: str) -> list[str]:
        """The stretches of a text with a blank before it."""
        if not self.cuts:
            return [" " + text]
        if " ".join(text.split()) == text.replace("\n", " "):  # single blanks and line feeds between words
            return text.replace("\n", " \n").split(" ")
        return [s if s[0] != " " or s[1:2] in ("", " ", "\n") else s[1:] for s in CUT.split(" " + text)]

    def _ids(self, side, calm: list[str], odd: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all stretches, how many each has, and whether they spell it.

        Those in ``calm`` end where tokens end, so side A takes them as one text.
        """
        counts, ids = np.zeros(0, np.int64), []
        if calm and side is self.a:
            ids = side.encode(["".join(calm)])[0]
            until = np.cumsum([len(s.encode()) for s in calm]).astype(np.int64)
            counts = np.diff(np.searchsorted(np.cumsum(side.lengths[np.array(ids, np.int64)]), until) + 1, prepend=0)
            more = side.encode(odd)
        else:
            more = side.encode(calm + odd)
        flat = np.fromiter(chain(ids, chain.from_iterable(more)), np.int64)
        counts = np.concatenate((counts, np.fromiter(map(len, more), np.int64, len(more))))
        words = calm + odd
        spelt = side.lengths[flat]
        if b"".join([side.bytes[i] for i in flat.tolist()]) == "".join(words).encode() and np.array_equal(np.concatenate(([0], np.cumsum(spelt)))[np.cumsum(counts)], np.cumsum([len(s.encode()) for s in words])):
            return flat, counts, np.ones(len(words), bool)
        cuts = np.concatenate(([0], np.cumsum(counts))).tolist()
        right = [b"".join([side.bytes[i] for i in flat[x:y].tolist()]) == s.encode() for x, y, s in zip(cuts, cuts[1:], words, strict=False)]
        return flat, counts, np.array(right, bool)

    def add(self, keys: list[str]) -> None:
        """Encode new stretches and multiply their matrices, all at once as blocks of one matrix."""
        keys.sort(key=lambda k: k[-1].isspace() or "▁" in k)
        stretches = [k if k[0] in " \n" else " " + k for k in keys]
        calm = sum(not (k[-1].isspace() or "▁" in k) for k in keys)
        if not self.cuts:
            calm = 0
        (a_ids, na, a_right), (b_ids, nb, b_right) = (self._ids(side, stretches[:calm], stretches[calm:]) for side in (self.a, self.b))
        right = a_right & b_right
        if not right.all():
            a_ids, b_ids = a_ids[np.repeat(right, na)], b_ids[np.repeat(right, nb)]
            na, nb = na * right, nb * right
        a_ends, b_ends = np.cumsum(self.a.lengths[a_ids]), np.cumsum(self.b.lengths[b_ids])
        groups = shared_ends(a_ends, b_ends)
        row, col, _ = overlap_links(a_ends, b_ends)
        shared = product_sizes(group_matrix(a_ends, groups), transposed(group_matrix(b_ends, groups), len(groups)))
        a_at = np.cumsum(na)
        until = np.concatenate(([0], a_ends))[a_at]  # bytes up to the end of each stretch
        upto = lambda places: np.diff(np.searchsorted(places, until, side="right"), prepend=0)
        n_groups = upto(groups)
        n_links = np.diff(np.searchsorted(row, a_at), prepend=0)
        n_shared = np.diff(np.concatenate(([0], np.cumsum(shared)))[a_at], prepend=0)
        self.figures = np.concatenate((self.figures, np.stack((right, na, nb, n_groups, n_links, n_shared), axis=1)))
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(n_links)))
        self.links = np.concatenate((self.links, (a_ids[row] << B_BITS) | b_ids[col]))
        # the groups as text, written group by group
        names = self.names
        sa, sb = [names[i] for i in a_ids.tolist()], [names[i] for i in b_ids.tolist()]
        ga, gb = np.searchsorted(a_ends, groups) + 1, np.searchsorted(b_ends, groups) + 1
        lines, i, j = [], 0, 0
        for x, y in zip(ga.tolist(), gb.tolist(), strict=True):
            lines.append(f"{sa[i] if x == i + 1 else ','.join(sa[i:x])}|{sb[j] if y == j + 1 else ','.join(sb[j:y])}")
            i, j = x, y
        base, at = len(self.texts), 0
        for n in n_groups.tolist():
            self.texts.append(";".join(lines[at : at + n]).encode())
            at += n
        self.known |= {k: base + i for i, k in enumerate(keys)}

    def numbers(self, docs: list[list[str]]) -> list[np.ndarray]:
        """The stretches of each document as row numbers of the table. A full table is emptied first."""
        if len(self.known) > self.most:
            self._clear()
        new = list(dict.fromkeys(s for d in docs for s in d if s not in self.known))
        if new:
            self.add(new)
        get = self.known.__getitem__
        return [np.fromiter(map(get, d), np.int64, len(d)) for d in docs]


ENCODED = "doc_id long, row long, n_a long, n_b long, n_groups long, n_links long, n_shared long, groups_sha256 string, pairs array<long>, times array<int>"
ENCODED_ARROW = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_shared")), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])


def slices(batch: pa.RecordBatch, column: str, chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows with about so many characters each, one row at least."""
    sizes = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(column)], np.int64)
    part = np.cumsum(sizes) // chars
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for i, j in zip(cuts, cuts[1:], strict=False):
        if j > i:
            yield batch.slice(i, j - i)


def _counted(aligner: Aligner, texts: list[str | None]) -> tuple[np.ndarray, list[str], pa.Array, pa.Array]:
    """Figures, digests and distinct id pairs with their times, document by document."""
    rows = aligner.numbers([aligner.cut(t) if t else [] for t in texts])
    figures, ptr, flat = aligner.figures, aligner.starts, aligner.links
    n = np.fromiter(map(len, rows), np.int64, len(rows))
    every = np.concatenate([*rows, np.zeros(0, np.int64)])
    doc = np.repeat(np.arange(len(rows)), n)
    sums = np.zeros((len(rows), 6), np.int64)
    np.add.at(sums, doc, figures[every])
    whole = (sums[:, 0] == n) & (n > 0)  # every stretch has its bytes
    sums[~whole] = 0
    held = aligner.texts
    digests = [hashlib.sha256(b";".join([held[k] for k in r.tolist()])).hexdigest() if w else "" for r, w in zip(rows, whole.tolist(), strict=True)]
    keep = whole[doc]
    span = len(held) + 1
    key, times = np.unique(doc[keep] * span + every[keep], return_counts=True)
    d, s = key // span, key % span
    length = ptr[s + 1] - ptr[s]
    pair, d, times = flat[ragged(ptr[s], length)], np.repeat(d, length), np.repeat(times, length)
    order = np.lexsort((pair, d))
    pair, d, times = pair[order], d[order], times[order]
    first = np.flatnonzero(np.concatenate(([True], (pair[1:] != pair[:-1]) | (d[1:] != d[:-1])))) if len(pair) else np.zeros(0, np.int64)
    totals = np.add.reduceat(times, first) if len(first) else times
    offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(d[first], minlength=len(rows))))), pa.int32())
    return sums, digests, pa.ListArray.from_arrays(offsets, pa.array(pair[first], pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(totals, pa.int32()))


def _encode(a_path: str, b_path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    aligner = Aligner(a_path, b_path)
    for batch in batches:
        for part in slices(batch, "text"):
            sums, digests, pairs, times = _counted(aligner, part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), *(pa.array(sums[:, k], pa.int64()) for k in range(1, 6)), pa.array(digests, pa.string()), pairs, times], schema=ENCODED_ARROW)


SCORED = "doc_id long, row long, n_a long, n_b long, n_groups long, n_links long, n_shared long, groups_sha256 string, best0 long, sum0 long, rest array<long>, rest_times array<int>"
SCORED_ARROW = pa.schema([*list(ENCODED_ARROW)[:8], ("best0", pa.int64()), ("sum0", pa.int64()), ("rest", pa.list_(pa.int64())), ("rest_times", pa.list_(pa.int32()))])


def _score(table: tuple[np.ndarray, np.ndarray, np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the pairs whose counts are at hand; the others go on as they are."""
    known, counts, best = table
    for batch in batches:
        lists = batch.column("pairs")
        length = np.asarray(lists.value_lengths().fill_null(0), np.int64)
        pair, times = np.asarray(lists.flatten(), np.int64), np.asarray(batch.column("times").flatten(), np.int64)
        doc = np.repeat(np.arange(len(length)), length)
        at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
        hit = known[at] == pair if len(known) else np.zeros(len(pair), bool)
        out = np.zeros((2, len(length)), np.int64)
        np.add.at(out[0], doc[hit], times[hit] * best[at[hit]])
        np.add.at(out[1], doc[hit], times[hit] * counts[at[hit]])
        offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(doc[~hit], minlength=len(length))))), pa.int32())
        rest = [pa.ListArray.from_arrays(offsets, pa.array(v[~hit], t)) for v, t in ((pair, pa.int64()), (times, pa.int32()))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in SCORED_ARROW.names[:8]), pa.array(out[0]), pa.array(out[1]), *rest], schema=SCORED_ARROW)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _paths(a_path: str | None, b_path: str | None) -> tuple[str, str]:
    return a_path or tokenizer_path("byte_bpe_50k.json"), b_path or tokenizer_path("piece_bpe_32k.model")


def pair_counts(encoded: DataFrame) -> DataFrame:
    """(pair, n, best) over the corpus: links that hold an id pair, and whether no pair of its B id has more."""
    counts = encoded.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n"))
    counts = stage(counts, "pair_counts")
    b_id = F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1))
    most = counts.groupBy(b_id.alias("b_id")).agg(F.max("n").alias("most"))
    return counts.withColumn("b_id", b_id).join(most, "b_id").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None, frequent: int = FREQUENT_PAIRS) -> DataFrame:
    """How the tokens of A and B overlap in each text, and how common its links are.

    One row for each row of ``docs``: its id (cast to long; null and repeated ids
    keep their rows), n_a, n_b, n_groups, n_links, n_best, count_sum, n_shared (pairs
    inside groups) and groups_sha256. Null and empty texts, and those whose tokens
    do not spell the blank and the text, have zeros and an empty digest. Texts are
    taken whole, whatever their length. Ties for the best count are all best.
    """
    paths = _paths(a_path, b_path)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    encoded = stage(rows.mapInArrow(partial(_encode, *paths), ENCODED), "aligned")
    pairs = stage(pair_counts(encoded), "pair_counts_best")
    top = pairs.orderBy(F.desc("n"), "pair").limit(frequent).toArrow().sort_by("pair")
    table = tuple(np.asarray(top.column(c), np.int64) for c in ("pair", "n", "best"))
    scored = stage(encoded.mapInArrow(partial(_score, table), SCORED), "aligned_scored")
    rest = scored.select("row", F.explode(F.arrays_zip("rest", "rest_times")).alias("p")).select("row", F.col("p.rest").alias("pair"), F.col("p.rest_times").alias("times"))
    met = rest.join(pairs, "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("best1"), F.sum(F.col("times") * F.col("n")).alias("sum1"))
    total = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return scored.join(met, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", total("best0", "best1").alias("n_best"), total("sum0", "sum1").alias("count_sum"), "groups_sha256", "n_shared")


LINKS = "doc_id long, a_ids array<int>, b_ids array<int>, links array<struct<a:int,b:int,bytes:int>>, groups array<struct<a_end:int,b_end:int>>"


def _list_links(a_path: str, b_path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = ByteLevel(a_path), Pieces(b_path)
    for batch in batches:
        for part in slices(batch, "text"):
            out = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                spelt = " " + (text or "")
                x, y = (side.encode([spelt])[0] if text else [] for side in (a, b))
                if x and not (b"".join(a.bytes[i] for i in x) == b"".join(b.bytes[i] for i in y) == spelt.encode()):
                    x, y = [], []
                ends = [np.cumsum([len(s.bytes[i]) for i in ids]).astype(np.int64) for s, ids in ((a, x), (b, y))]
                groups = shared_ends(*ends)
                links = [dict(zip(("a", "b", "bytes"), map(int, t), strict=True)) for t in zip(*overlap_links(*ends), strict=True)]
                cuts = [{"a_end": int(np.searchsorted(ends[0], g)) + 1, "b_end": int(np.searchsorted(ends[1], g)) + 1} for g in groups]
                out.append({"doc_id": doc_id, "a_ids": x, "b_ids": y, "links": links, "groups": cuts})
            link = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("bytes", pa.int32())]))
            group = pa.list_(pa.struct([("a_end", pa.int32()), ("b_end", pa.int32())]))
            kinds = pa.schema([("doc_id", pa.int64()), ("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32())), ("links", link), ("groups", group)])
            yield pa.RecordBatch.from_pylist(out, schema=kinds)


def token_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """The alignment itself: token ids of both sides, every overlap as positions with shared bytes, and where groups end."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(_list_links, *_paths(a_path, b_path)), LINKS)
