"""Secret scans: fixed patterns, and a battery of randomness tests.

Tokens of key-like characters are tested as draws from the alphabet of their
inferred encoding: chi-squared uniformity over classes of the alphabet, repeated
symbols, runs about the median, and lag-one serial correlation. Tested are runs
of 20 and more such characters; shorter ones do not tell random from not. A token's p is the chance
that the least of as many p-values is no greater. Random strings have p spread over [0, 1]; ordinary words,
names and paths gather at zero. So for each encoding and pool of neighbouring
length classes, counts of p over the whole corpus tell how many tokens above a
threshold are random ones (a bound from those above one half, carried down), and the threshold is the least that keeps the share of others at
or below ``fdr``.
Counts are a table of bounded
size: encodings x length classes x bins of p.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, stage, unused

# Fixed patterns of the base scan. Minimum lengths are checked after the match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # runs are maximal, so this is AKIA[A-Z0-9]+ of 16 and more
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
ASSIGN_WORDS, ASSIGN_LEAST = ("password", "passwd", "secret", "token", "apikey", "api_key"), 8
KINDS = ("assign", "access", "hex", "random")

ALPHABETS = {
    "digits": "0123456789",
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: Thresholds of p that are tried, and bins of its histogram.
GRID = (0.001, 0.003, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5)
#: Tokens that neighbouring length classes of an encoding are pooled to.
POOL = 400
#: Chance that the bound on the number of random tokens is too high; where the upper half is cut to see whether it is even, and by how many deviations it may lean.
DOUBT, TAIL, LEAN = 0.5, 0.75, 1.0
#: Tokens above one half that a pool must have; fewer are no evidence of random ones.
EVIDENCE = 15


def infer_encoding(token: str) -> str:
    """The smallest alphabet that holds the token."""
    if token.isdigit():
        return "digits"
    seen = set(token)
    for name, chars in ALPHABETS.items():
        if seen <= set(chars) or (name == "hex" and seen <= set(chars.upper())):
            return name
    return "base64"


def _upper_tail(chi2: float, df: int) -> float:
    """Of the chi-squared distribution, by the cube-root normal approximation."""
    z = ((chi2 / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def _class_edges(encoding: str, n: int) -> list[int]:
    """Ends of alphabet classes whose expected counts are five or more, with breaks where the kind of character changes."""
    chars = ALPHABETS[encoding]
    kind = [c.isdigit() + 2 * c.islower() + 4 * c.isupper() for c in chars]
    edges, since = [], 0
    for i in range(1, len(chars) + 1):
        whole = (i - since) * n / len(chars) >= 5
        turn = i == len(chars) or kind[i] != kind[i - 1]
        if i == len(chars) or (whole and (turn or (i - since) * n / len(chars) >= 10)):
            edges.append(i)
            since = i
    if len(edges) > 1 and (edges[-1] - edges[-2]) * n / len(chars) < 3:
        del edges[-2]
    return edges


def randomness(token: str) -> tuple[str, float]:
    """Inferred encoding, and p of the battery: the chance that the least of as many independent p-values is no greater."""
    encoding = infer_encoding(token)
    chars = ALPHABETS[encoding]
    place = {c: i for i, c in enumerate(chars)}
    if encoding == "hex":
        token = token.lower()
    x = np.array([place.get(c, 0) for c in token])
    n, k = len(x), len(chars)
    edges = np.array(_class_edges(encoding, n))
    expected = np.diff(np.concatenate([[0], edges])) * n / k
    counts = np.bincount(np.searchsorted(edges, x, side="right"), minlength=len(edges))
    p = [_upper_tail(float(((counts - expected) ** 2 / expected).sum()), max(1, len(edges) - 1))]
    # repeated symbols: pairs that agree are about Poisson for a uniform draw
    same = np.bincount(x, minlength=k)
    agree, mean = float((same * (same - 1)).sum() / 2), n * (n - 1) / 2 / k
    p.append(0.5 * math.erfc((agree - mean) / math.sqrt(2 * mean * (1 - 1 / k))))
    high = x >= k / 2
    n1 = int(high.sum())
    n0 = n - n1
    if n0 and n1:
        runs, mean = 1 + int((high[1:] != high[:-1]).sum()), 1 + 2 * n0 * n1 / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        p.append(math.erfc(abs(runs - mean) / math.sqrt(2 * max(var, 1e-9))))
    else:
        p.append(0.0)
    y = x - x.mean()
    r = float((y[1:] * y[:-1]).sum() / max((y * y).sum(), 1e-9))
    p.append(math.erfc(abs(r + 1 / n) * math.sqrt(n / 2)))
    return encoding, 1 - (1 - min(p)) ** len(p)


def length_class(n: int) -> int:
    """Half powers of two."""
    return int(2 * math.log2(n))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) by start, then kind."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str, int, float]]:
    """(start, end, encoding, length class, p) of tokens that no base span touches.

    Tokens of letters of one case only are words and not tested.
    """
    out = []
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        token = m[0]
        if (token.isalpha() and (token.islower() or token.isupper() or token[1:].islower())) or any(a < e and s < b for a, _, b in base):
            continue
        encoding, p = randomness(token)
        out.append((s, e, encoding, length_class(len(token)), p))
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bases, more = [], []
        for text in batch["text"]:
            text = text.as_py() or ""
            base = base_spans(text)
            bases.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
            more.append([{"start": s, "end": e, "encoding": c, "lengths": n, "p": p} for s, e, c, n, p in candidates(text, base)])
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(bases, BASE_TYPE), pa.array(more, MORE_TYPE)], names=["doc_id", "base", "more"])


BASE_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
MORE_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.string()), ("lengths", pa.int32()), ("p", pa.float64())]))
SCAN_SCHEMA = "doc_id long, base array<struct<start: long, kind: int, end: long>>, more array<struct<start: long, end: long, encoding: string, lengths: int, p: double>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base spans and tested tokens of each row, staged."""
    small_batches(docs.sparkSession)
    return stage(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scan, SCAN_SCHEMA), "secret_scan")


def _pools(sizes: dict[int, int]) -> list[list[int]]:
    """Length classes of one encoding, neighbours together until a pool holds POOL tokens; what is left joins the last pool."""
    pools, now, held = [], [], 0
    for length in sorted(sizes):
        now.append(length)
        held += sizes[length]
        if held >= POOL:
            pools.append(now)
            now, held = [], 0
    if now and pools:
        pools[-1] += now
    elif now:
        pools.append(now)
    return pools


def least_share(n: int, above: int, split: float = 0.5, doubt: float = DOUBT) -> float:
    """Lower confidence bound of the share of random tokens among ``n`` of which ``above`` have a p over ``split``.

    Random tokens have p spread evenly, so of m of them a part 1 - split is
    expected above; the bound is that of Clopper and Pearson, by bisection of
    the binomial tail.
    """
    if not above:
        return 0.0

    def tail(p: float) -> float:  # of above or more
        if n > 1000:
            return 0.5 * math.erfc((above - 0.5 - n * p) / math.sqrt(2 * n * p * (1 - p)))
        return sum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)) for k in range(above, n + 1))

    low, high = 1e-12, min(above / n, 1 - 1e-12)
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(mid) < doubt else (low, mid)
    return low / (1 - split)


def least_p(rows: Sequence, fdr: float = 0.05) -> float | None:
    """The least threshold of GRID that keeps the false share of a pool; None if none does.

    ``rows``: size, n<i> tokens above each threshold, and tail tokens above TAIL.
    The tokens above one half tell how many random ones there are, so they are no
    test of themselves: the first threshold that is judged is the next one, and a
    threshold holds only if all higher ones do. If those above one half lean
    towards it, they are the end of another spread than the random one's, and
    none is accepted.
    """
    counts = [sum(row[f"n{i}"] for row in rows) for i in range(len(GRID))]
    size, tail, half = sum(row["size"] for row in rows), sum(row["tail"] for row in rows), counts[-1]
    part = (1 - TAIL) / (1 - GRID[-1])
    if half < EVIDENCE or half * part - tail > LEAN * math.sqrt(half * part * (1 - part)):
        return None
    random, found = least_share(size, half, GRID[-1]) * size, None
    for t, n in zip(reversed(GRID[:-1]), reversed(counts[:-1]), strict=True):
        if not n or n - random * (1 - t) > fdr * n:
            break
        found = t
    return found


def thresholds(scanned: DataFrame, fdr: float = 0.05) -> dict[str, float]:
    """Least accepted p by "encoding/length class"; classes without one are absent.

    The rule is the same at every size: of the tokens above a threshold, the
    share that random ones do not explain is ``fdr`` at most. How many are random
    is the median-unbiased bound from those with p above one half, and a pool with
    fewer than EVIDENCE of these accepts none. Pools that accept none are judged once
    more with those of all encodings together.
    """
    above = [F.count_if(F.col("c.p") > t).alias(f"n{i}") for i, t in enumerate(GRID)]
    rows = scanned.select(F.explode("more").alias("c")).groupBy("c.encoding", "c.lengths").agg(F.count("*").alias("size"), F.count_if(F.col("c.p") > TAIL).alias("tail"), *above).collect()
    out, open_ = {}, []
    for encoding in sorted({row["encoding"] for row in rows}):
        mine = {row["lengths"]: row for row in rows if row["encoding"] == encoding}
        for pool in _pools({k: row["size"] for k, row in mine.items()}):
            t = least_p([mine[k] for k in pool], fdr)
            if t is None:
                open_ += [mine[k] for k in pool]
            else:
                out |= {f"{encoding}/{k}": t for k in pool}
    t = least_p(open_, fdr) if open_ else None
    return out | ({f"{row['encoding']}/{row['lengths']}": t for row in open_} if t is not None else {})


def _accepted(limits: dict[str, float]) -> Column:
    limit = F.create_map(*(F.lit(x) for k, v in limits.items() for x in (k, v))) if limits else F.create_map(F.lit(""), F.lit(2.0))
    return F.transform(
        F.filter("more", lambda c: c["p"] > F.coalesce(F.try_element_at(limit, F.concat_ws("/", c["encoding"], c["lengths"].cast("string"))), F.lit(2.0))),
        lambda c: F.struct(c["start"].alias("start"), F.lit(3).cast("int").alias("kind"), c["end"].alias("end")),
    )


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _equals(value: int):
    return lambda x: x == value


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = 0.05) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, by start and then
    kind. A null or empty text has none; repeated rows come back repeated; an
    empty table gives no row. Other columns are not read.
    """
    scanned = scan(docs, id_col, text_col)
    of_kind = [F.size(F.filter("base.kind", _equals(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    spans = F.concat("base", _accepted(thresholds(scanned, fdr)))
    return scanned.select("doc_id", *of_kind, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(spans).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = 0.05, mark: str = "[secret]", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with each found span replaced by ``mark``; no row is dropped.

    The length column, where the table has it, is set anew for changed texts.
    """
    small_batches(docs.sparkSession)
    limits = thresholds(scan(docs, id_col, text_col), fdr)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            if isinstance(text, str):
                base = base_spans(text)
                found = [(s, e) for s, _, e in base] + [(s, e) for s, e, c, n, p in candidates(text, base) if p > limits.get(f"{c}/{n}", 2.0)]
                parts, at = [], 0
                for s, e in sorted(found):
                    if e > at:
                        parts += [text[at:s], mark] if s >= at else []
                        at = e
                text = "".join([*parts, text[at:]])
            out.append(text)
        return pd.Series(out, dtype=object)

    new = unused(docs, "clean")
    out = docs.withColumn(new, clean(F.col(text_col)))
    changed = {text_col: F.col(new)}
    if length_col in docs.columns:
        changed[length_col] = F.when(F.col(new).eqNullSafe(F.col(text_col)), F.col(length_col)).otherwise(F.char_length(new).cast(docs.schema[length_col].dataType))
    return out.select(*(changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns))
