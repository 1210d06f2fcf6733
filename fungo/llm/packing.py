"""Best-two-fit packing of documents into fixed-length sequences.

A bin is filled greedily with the longest document that fits its gap. Then its
smallest document may give way to two unpacked documents that together fill the
widened gap more tightly.

Documents are tokenised where they lie; only lengths are dealt out, to groups
that a hash of the document makes even. A group takes a fixed expected number of
documents, so groups grow in number and not in size, also where one row is
repeated without end; each leaves at most about one sequence unfilled. Pieces of full length are sequences of their own.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage

#: Expected documents in a packing group; pre-tokens whose ids are held.
GROUP_DOCS, CACHED_PARTS = 8_000, 400_000
SLICE_CHARS = 1 << 20
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECE_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]
PIECE_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# What the tokenizer file states about its own steps, and its pattern for pre-tokens.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters of the short way: all are in NFC, each has one lower-case form of one character, and their classes are those below.
PLAIN = re.compile("[\t\n\r -~\u00a1-\u012f\u0131-\u017f\u2010-\u2027\u20ac]*")
_LETTERS, _NUMBERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
CUT = re.compile("[A-Za-z0-9] ")
PRE_TOKEN = re.compile(PATTERN.replace(r"\p{L}", _LETTERS).replace(r"\p{N}", _NUMBERS))


@lru_cache(1)
def _byte_names() -> dict[int, str]:
    """The character by which byte-level models name each byte: itself if it is printable, else the next from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class _Parts(dict):
    """Ids of pre-tokens, worked out on first use."""

    def __init__(self, model):
        super().__init__()
        self.tokens, self.names = model.tokenize, _byte_names()

    def __missing__(self, part: str) -> bytes:
        found = self.tokens(part.encode().decode("latin-1").translate(self.names))
        ids = self[part] = struct.pack(f"<{len(found)}I", *[t.id for t in found])
        return ids


class WordEncoder:
    """Token ids of whole texts.

    A text of PLAIN characters only is cut into pre-tokens, whose ids are looked
    up in a bounded table; new ones go to the tokenizer's model. The ids of a
    pre-token do not depend on its neighbours. Every other text, and every text
    under a tokenizer with other steps than those stated above, goes to the
    tokenizer as it is.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        steps = json.loads(tokenizer.to_str())
        self.encode, self.parts = tokenizer.encode, _Parts(tokenizer.model)
        self.added = [t["content"] for t in steps["added_tokens"]]
        pre = (steps["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.known_steps = (
            [n["type"] for n in (steps["normalizer"] or {}).get("normalizers", [])] == NORMALIZERS
            and pre[0].get("pattern") == {"Regex": PATTERN}
            and [x["type"] for x in pre] == ["Split", "ByteLevel"]
        )

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if len(text) > SLICE_CHARS + 1:
            return b"".join(map(self._ids, _slices(text)))
        return self._ids(text)

    def _ids(self, text: str) -> bytes:
        if self.known_steps and PLAIN.fullmatch(text) and not any(x in text for x in self.added):
            if len(self.parts) > CACHED_PARTS:
                self.parts.clear()
            return b"".join(map(self.parts.__getitem__, PRE_TOKEN.findall(text.lower())))
        return np.array(self.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _slices(text: str) -> Iterator[str]:
    """Parts of a very long text, cut before a blank that follows a letter or digit; one without such stays whole."""
    at = 0
    while at < len(text):
        found = CUT.search(text, at + SLICE_CHARS)
        end = found.start() + 1 if found else len(text)
        yield text[at:end]
        at = end


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _pieces(path: str, size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        tail = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = encode(text.as_py() or "") + tail
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows) if rows else [()] * 5, PIECE_TYPES, strict=True)], names=PIECE_NAMES)

    return run


def best_two_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each document. Lengths are from 1 to ``size``."""
    n = len(lengths)
    order = np.argsort(lengths, kind="stable")
    first = np.searchsorted(lengths[order], np.arange(size + 2))  # where each length begins in order
    left = np.diff(first)  # unpacked documents of each length
    below = np.zeros(size + 1, np.int64)  # the longest unpacked length up to each
    present = np.flatnonzero(left)
    below[present] = present
    np.maximum.accumulate(below, out=below)
    bins, offsets, taken = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(size + 1, np.int64)

    def take(length: int) -> None:
        left[length] -= 1
        if not left[length]:
            to = np.searchsorted(below[length:], length, side="right") + length
            below[length:to] = below[length - 1]

    def give_back(length: int) -> None:
        left[length] += 1
        if left[length] == 1:
            view = below[length:]
            view[: np.searchsorted(view, length)] = length

    done, k = 0, 0
    while done < n:
        gap, held = size, []
        while length := int(below[gap]):
            take(length)
            held.append(length)
            gap -= length
        if gap:
            small = held[-1]
            wide = gap + small
            give_back(small)
            low = np.flatnonzero(left[1 : wide // 2 + 1]) + 1  # the shorter of the two
            if len(low):
                high = below[wide - low]
                total = np.where((high > low) | ((high == low) & (left[low] > 1)), low + high, 0)
                best = int(np.argmax(total))
                if total[best] > small:
                    held[-1:] = [int(high[best]), int(low[best])]
                    small = 0
            for length in held[-2:] if not small else [small]:
                take(length)
        at = 0
        for length in held:
            i = order[first[length] + taken[length]]
            taken[length] += 1
            bins[i], offsets[i] = k, at
            at += length
        done += len(held)
        k += 1
    return bins, offsets


def _pack(size: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], kind="stable", ignore_index=True)
        bins, offsets = best_two_fit(group["length"].to_numpy(np.int64), size)
        return group.assign(sequence_id=group["grp"] * (1 << 32) + bins, offset=offsets).drop(columns="grp")

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, end_id: int = 1, tokenizer: str | None = None, group_docs: int = GROUP_DOCS) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and ``end_id``; only one longer than ``size`` is cut,
    into pieces of ``size`` and a shorter last one. A null or empty text is the
    end id alone. Repeated rows are packed each; null ids stay null; an empty
    table gives no row. Other columns are not read.
    """
    made = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_pieces(tokenizer or tokenizer_path(), size, end_id), PIECE_SCHEMA)
    # a number for each piece, written with it, so that repeated rows spread over the groups too
    made = stage(made.withColumn("at", F.monotonically_increasing_id()), "pieces")
    full = made.where(F.col("length") == size).drop("at").withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    rest = made.where(F.col("length") < size)
    groups = max(1, -(-rest.count() // group_docs))
    packed = rest.withColumns({"nameless": F.col("doc_id").isNull(), "doc_id": F.coalesce("doc_id", F.lit(0)), "grp": F.pmod(F.xxhash64("at"), F.lit(groups))}).drop("at")
    packed = packed.groupBy("grp").applyInPandas(_pack(size), f"{PIECE_SCHEMA}, nameless boolean, sequence_id long, offset long")
    return full.unionByName(packed.withColumn("doc_id", F.when(~F.col("nameless"), F.col("doc_id"))).drop("nameless"))
