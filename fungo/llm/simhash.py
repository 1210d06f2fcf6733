"""SimHash near-duplicates by a self-join of a binary trie.

The trie of fingerprints is joined with itself: pairs of nodes go down
together, the bits in which their prefixes differ are added up, and a pair is
dropped once the sum is over the budget. With a budget of k bits, two
fingerprints that link agree in one of k + 1 blocks. So the trie is built k + 1
times, each time with another block on top, and on that block's levels only a
node with itself is a pair. That splits the join into tasks (one for each value
of the block) at one copy of 8 bytes for each block. A task with too many
fingerprints goes down some more levels as a Spark step, its node pairs become
tasks, and so on; the rest of the walk is done with arrays inside the task.

Tasks emit a spanning forest of their links and no pairs; copies share a
fingerprint and enter the trie once.

``keep_one_similar`` is for edited copies. The trie join, with a wider budget, puts
texts into groups inside which shingles are compared exactly. No budget that the
walk can afford reaches every pair of edited copies; bands of least hashes give
groups for those that are further apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import small_batches, split_hot, stage, unused

BITS = 64
#: A task of more fingerprints than this is split at the next levels of the trie.
TASK_FINGERPRINTS = 200_000
SPLIT_BITS = 4
#: Rows of whole tasks walked at once.
ROWS_AT_ONCE = 50_000
#: Node pairs of a level, or leaf pairs, held at once inside a task, and leaf pairs below which a node pair is resolved directly.
PAIRS_AT_ONCE, LEAF_PAIRS = 100_000, 64
SLICE_BYTES = 1 << 20
#: Bits for edited copies: 0.13 of the pairs at similarity 0.8 are that close and 0.50 of those at 0.9, as calculated.
WIDE_BUDGET = 6
#: Bands of least hashes: recall 0.9998 for a pair at similarity 0.8. Groups of the trie join are one more.
BANDS, ROWS = 16, 4
#: Texts of one block, where all texts of a band are compared, and shingles counted at once.
BLOCK_TEXTS, COLUMNS = 512, 2_048
SPACE = b" \t\n\x0b\x0c\r"


def _word_slices(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time, so that a very long text needs no list of all of them."""
    at = 0
    while at < len(data):
        end = min(len(data), at + SLICE_BYTES)
        while end < len(data) and data[end] not in SPACE:
            end += 1
        yield data[at:end].split()
        at = end


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles, repeats included.

    A-Z are lowered, words are what ASCII white space separates. Fewer words
    than ``width`` make one shingle; no word, or null, gives zero.
    """
    if text is None:
        return 0
    ones, n, last, digest = np.zeros(BITS, np.int64), 0, [], xxhash.xxh64_intdigest
    for words in _word_slices(text.encode("utf-8", "surrogatepass").lower()):
        words = last + words
        if len(words) >= width:
            grams = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
            h = np.fromiter((digest(g, seed) for g in grams), np.uint64, len(words) - width + 1)
            ones += np.unpackbits(h.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            n += len(h)
        last = words[-(width - 1) :] if width > 1 else []
    if not n:
        return digest(b" ".join(last), seed) if last else 0
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprint_column(text: Column, width: int = 3, seed: int = 42) -> Column:
    """The fingerprint as a signed 64-bit number."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t if isinstance(t, str) else None, width, seed) for t in texts], np.uint64).view(np.int64))

    return of(text)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


class _Forest:
    """Union-find over array positions; each label is the least position of its set."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            la, lb = self.label[a], self.label[b]
            apart = la != lb
            if not apart.any():
                return
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            np.minimum.at(self.label, np.maximum(la, lb), np.minimum(la, lb))
            while not np.array_equal(up := self.label[self.label], self.label):
                self.label = up


def _leaf_pairs(na: np.ndarray, nb: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pair, i, j): for each node pair all places of its na leaves with all of its nb, PAIRS_AT_ONCE at once or one node pair."""
    size = na * nb
    total, lo = np.cumsum(size), 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS_AT_ONCE, side="right")))
        pair = np.repeat(np.arange(lo, hi), size[lo:hi])
        k = np.arange(len(pair)) - np.repeat(np.cumsum(size[lo:hi]) - size[lo:hi], size[lo:hi])
        yield pair, k // nb[pair], k % nb[pair]
        lo = hi


def trie_join(codes: np.ndarray, starts: tuple[np.ndarray, ...], depth: int, budget: int, forest: _Forest) -> None:
    """Link the positions of ``codes`` (unsigned) whose bits differ in ``budget`` places or fewer.

    ``starts``: node pairs as ranges of positions (a_lo, a_hi, b_lo, b_hi) and
    the bits that differ above ``depth``. Within a range the codes ascend. A
    node with itself is a pair of the same range.
    """
    stack = [(depth, *starts)]
    ones_at: dict[int, np.ndarray] = {}
    while stack:
        d, alo, ahi, blo, bhi, diff = stack.pop()
        if len(alo) > PAIRS_AT_ONCE:
            half = len(alo) // 2
            stack += [(d, *(x[half:] for x in (alo, ahi, blo, bhi, diff))), (d, *(x[:half] for x in (alo, ahi, blo, bhi, diff)))]
            continue
        # a pair of nodes whose leaves are one set by now has nothing to add
        change = np.concatenate([[0], np.cumsum(forest.label[1:] != forest.label[:-1])]) if len(codes) else np.zeros(0)
        new = ~((forest.label[alo] == forest.label[blo]) & (change[alo] == change[ahi - 1]) & (change[blo] == change[bhi - 1]))
        alo, ahi, blo, bhi, diff = (x[new] for x in (alo, ahi, blo, bhi, diff))
        na, nb, own = ahi - alo, bhi - blo, alo == blo
        few = na * nb <= LEAF_PAIRS
        first_a, first_b, same = alo[few], blo[few], own[few]
        for pair, i, j in _leaf_pairs(na[few], nb[few]):
            a, b = first_a[pair] + i, first_b[pair] + j
            near = (~same[pair] | (a < b)) & (_popcount(codes[a] ^ codes[b]) <= budget)
            forest.link(a[near], b[near])
        alo, ahi, blo, bhi, diff, own = (x[~few] for x in (alo, ahi, blo, bhi, diff, own))
        if not len(alo):
            continue
        if d >= BITS:
            # only codes that agree in every bit but the counted ones are left: one set
            spans = np.concatenate([alo, blo]), np.concatenate([ahi, bhi])
            size = spans[1] - spans[0]
            at = np.repeat(spans[0], size)
            forest.link(at, at + np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size))
            forest.link(alo, blo)
            continue
        if d not in ones_at:
            ones_at[d] = np.concatenate([[0], np.cumsum((codes >> np.uint64(BITS - 1 - d)) & np.uint64(1)).astype(np.int64)])
        ones = ones_at[d]
        amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        parts = []
        for lo_a, hi_a, lo_b, hi_b, more, mask in ((alo, amid, blo, bmid, 0, None), (amid, ahi, bmid, bhi, 0, None), (alo, amid, bmid, bhi, 1, None), (amid, ahi, blo, bmid, 1, ~own)):
            ok = (hi_a > lo_a) & (hi_b > lo_b) & (diff + more <= budget)
            ok = ok if mask is None else ok & mask
            parts.append((lo_a[ok], hi_a[ok], lo_b[ok], hi_b[ok], diff[ok] + more))
        stack.append((d + 1, *(np.concatenate(x) for x in zip(*parts, strict=True))))


def _rotate(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Bits turned to the left; ``by`` under 64."""
    by = by.astype(np.uint64)
    return (x << by) | (x >> ((np.uint64(64) - by) & np.uint64(63))) * (by > 0).astype(np.uint64)


KEY = ["turn", "depth", "pa", "pb"]


def _whole_tasks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in the order of KEY, about ROWS_AT_ONCE of them or one task at once; no task is cut."""
    held, n, due = [], 0, ROWS_AT_ONCE
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n < due:
            continue
        rows = pd.concat(held, ignore_index=True)
        ends = np.flatnonzero((rows[KEY].to_numpy(np.int64) != rows[KEY].iloc[-1].to_numpy(np.int64)).any(1))
        whole = ends[-1] + 1 if len(ends) else 0
        if whole:
            yield rows[:whole]
        held, n = [rows[whole:]], len(rows) - whole
        due = max(ROWS_AT_ONCE, 2 * n)
    if n:
        yield pd.concat(held, ignore_index=True)


def _join_tasks(budget: int):
    """mapInPandas function: rows (turn, depth, pa, pb, side, code) of whole tasks, in the order of KEY, to links (a, b)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in _whole_tasks(batches):
            yield from joined(some)

    def joined(some: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for depth, rows in some.groupby("depth"):
            code = rows["code"].to_numpy(np.int64).view(np.uint64)
            turn, pa, pb, side = (rows[c].to_numpy(np.int64) for c in ("turn", "pa", "pb", "side"))
            order = np.lexsort((code, side, pb, pa, turn))
            code, turn, pa, pb, side = (x[order] for x in (code, turn, pa, pb, side))
            task = np.flatnonzero(np.concatenate([[True], (turn[1:] != turn[:-1]) | (pa[1:] != pa[:-1]) | (pb[1:] != pb[:-1])]))
            end = np.append(task[1:], len(code))
            cut = task + np.add.reduceat(1 - side, task)  # side 0 comes first
            own = pa[task] == pb[task]
            both = (own | ((cut > task) & (cut < end))) & (end - task > 1)
            task, end, cut, own = (x[both] for x in (task, end, cut, own))
            if not len(task):
                continue
            forest = _Forest(len(code))
            diff = _popcount((pa[task] ^ pb[task]).view(np.uint64))
            trie_join(code, (task, np.where(own, end, cut), np.where(own, task, cut), end, diff), int(depth), budget, forest)
            member = np.flatnonzero(forest.label != np.arange(len(code)))
            back = (64 - turn[member]) % 64
            if len(member):
                yield pd.DataFrame({"a": _rotate(code[member], back).view(np.int64), "b": _rotate(code[forest.label[member]], back).view(np.int64)}).drop_duplicates()

    return run


def _prefix(code: Column, depth: int) -> Column:
    return F.shiftrightunsigned(code, BITS - depth)


def links(codes: DataFrame, budget: int = 3, task_fingerprints: int = TASK_FINGERPRINTS) -> DataFrame:
    """(a, b): a spanning forest, task by task, of the links among distinct ``code`` values."""
    blocks = budget + 1
    width = BITS // blocks
    turned = codes.select(
        F.explode(F.array(*(F.struct(F.lit(i * width).alias("turn"), (F.shiftleft("code", i * width).bitwiseOR(F.shiftrightunsigned("code", BITS - i * width)) if i else F.col("code")).alias("code")) for i in range(blocks)))).alias("x")
    ).select("x.*")
    tasks = turned.select("turn", F.lit(width).alias("depth"), _prefix(F.col("code"), width).alias("pa"), _prefix(F.col("code"), width).alias("pb"), F.lit(0).alias("side"), "code")
    key, depth, ready = KEY, width, []
    while True:
        sizes = tasks.groupBy(key).count()
        large = stage(sizes.where(F.col("count") > task_fingerprints).drop("count"), "large_tasks")
        if depth + SPLIT_BITS > BITS - SPLIT_BITS or not large.take(1):
            ready.append(tasks)
            break
        ready.append(tasks.join(large, key, "left_anti"))
        depth += SPLIT_BITS
        split = tasks.join(large, key, "left_semi")
        mine, low = _prefix(F.col("code"), depth), (1 << SPLIT_BITS) - 1
        # each fingerprint goes to the child pairs of which its own child is one side
        child = split.select("turn", "code", "side", "pa", "pb", mine.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(low))).alias("c"))
        same = F.col("pa") == F.col("pb")
        other = F.shiftleft(F.when(F.col("side") == 0, F.col("pb")).otherwise(F.col("pa")), SPLIT_BITS) + F.col("c")
        child = child.select("turn", "code", "own", other.alias("other"), same.alias("same"), "side").where(F.bit_count(F.col("own").bitwiseXOR(F.col("other"))) <= budget)
        side = F.when(F.col("same"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1)).otherwise(F.col("side"))
        first = side == 0
        tasks = stage(
            child.select("turn", F.lit(depth).alias("depth"), F.when(first, F.col("own")).otherwise(F.col("other")).alias("pa"), F.when(first, F.col("other")).otherwise(F.col("own")).alias("pb"), side.alias("side"), "code"),
            "trie_tasks",
        )
    out = None
    for part in ready:
        found = part.repartition(*key).sortWithinPartitions(*key).mapInPandas(_join_tasks(budget), "a long, b long")
        out = found if out is None else out.unionByName(found)
    return out


def _placed(docs: DataFrame, id_col: str, text_col: str, budget: int, width: int, seed: int, task_fingerprints: int, **more: Column) -> DataFrame:
    """doc_id, code and the root of its component for each row, and the columns ``more``."""
    small_batches(docs.sparkSession)
    prints = stage(docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col), width, seed).alias("code"), *(c.alias(n) for n, c in more.items())), "fingerprints")
    forest = links(prints.select("code").distinct(), budget, task_fingerprints)
    roots = stage(connected_components(forest), "roots")
    return prints.join(roots, prints["code"] == roots["node"], "left").select("doc_id", "code", F.coalesce("root", "code").alias("root"), *more)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 3, width: int = 3, seed: int = 42, task_fingerprints: int = TASK_FINGERPRINTS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the least id that links reach. Null or empty texts have the
    fingerprint zero and link like any other; repeated rows come back repeated;
    a null id is kept and never a component's name while an id is there; an
    empty table gives an empty result. Other columns are not read.
    """
    placed = _placed(docs, id_col, text_col, budget, width, seed, task_fingerprints)
    named = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return placed.join(named, "root").select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


def keep_rows(docs: DataFrame, placed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with one row for each ``root`` of ``placed`` (doc_id, root, text_hash): that of its least id, a null id only where there is no other.

    A row is named by id and text together, so neither a null nor a repeated id
    makes rows of different components one.
    """
    own, kept_id, kept_hash = (unused(docs, n) for n in ("hash", "kept_id", "kept_hash"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("x")
    kept = placed.groupBy("root").agg(least).select(F.col("x.doc_id").alias(kept_id), F.col("x.text_hash").alias(kept_hash)).distinct()
    hashed = docs.withColumn(own, F.xxhash64(F.col(text_col)))
    return hashed.join(kept, F.col(id_col).eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(kept_hash)), "left_semi").dropDuplicates([id_col, own]).drop(own)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 3, width: int = 3, seed: int = 42, task_fingerprints: int = TASK_FINGERPRINTS) -> DataFrame:
    """``docs`` with one row for each component: that of its least id, also where ids are null or repeated. Columns stay as they are."""
    placed = _placed(docs, id_col, text_col, budget, width, seed, task_fingerprints, text_hash=F.xxhash64(F.col(text_col)))
    return keep_rows(docs, placed, id_col, text_col)


def shingles(text: str | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct word shingles of a text, hashed and ascending; cut and shortened like those of ``fingerprint``."""
    found, last, digest = [], [], xxhash.xxh64_intdigest
    for words in _word_slices((text or "").encode("utf-8", "surrogatepass").lower()):
        words = last + words
        if len(words) >= width:
            grams = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
            found.append(np.fromiter((digest(g, seed) for g in grams), np.uint64, len(words) - width + 1))
        last = words[-(width - 1) :] if width > 1 else []
    if not found and last:
        found = [np.array([digest(b" ".join(last), seed)], np.uint64)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Shared shingles by all shingles; two texts without any are the same."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def band_keys(x: np.ndarray, seed: int = 42) -> np.ndarray:
    """BANDS keys, each of ROWS least hashes of the shingles. Texts of similarity s share one with 1 - (1 - s^ROWS)^BANDS."""
    if not len(x):
        return np.zeros(BANDS, np.int64)
    odd = np.random.default_rng(seed).integers(0, 1 << 63, (2, BANDS * ROWS)).astype(np.uint64) | np.uint64(1)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(x), 4_096):
        h = x[at : at + 4_096, None] * odd[0]
        h = (h ^ (h >> np.uint64(32))) * odd[1]
        least = np.minimum(least, (h ^ (h >> np.uint64(29))).min(0))
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def shared_counts(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shared values of each of the sets ``a`` with each of the sets ``b`` (numbers of sets), some values at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    twice = seen > 1
    number, kept = np.cumsum(twice) - 1, twice[column]
    owner, column = owner[kept], number[column[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(a), len(b)))
    for at in range(0, int(twice.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, (at, at + COLUMNS))
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[owner[lo:hi], column[lo:hi] - at] = 1
        out += held[a] @ held[b].T
    return out


def _block_forest(least: float):
    """Links between the components (``root``) of a block's texts, as few as connect what similar pairs of it connect."""

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("text_hash", ignore_index=True)
        sets, names, roots, side = [np.asarray(x, np.int64) for x in rows["shingles"]], rows["text_hash"].tolist(), rows["root"].to_numpy(), rows["side"].to_numpy()
        a = np.flatnonzero(side == 0)
        b = a if rows["bi"][0] == rows["bj"][0] else np.flatnonzero(side == 1)
        links, parent = [], {r: r for r in roots.tolist()}

        def top(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        if len(a) and len(b):
            both, sizes = shared_counts(sets, a, b), np.array([len(x) for x in sets])
            all_ = sizes[a][:, None] + sizes[b][None] - both
            alike = np.divide(both, all_, out=np.ones_like(both), where=all_ > 0) >= least
            for i, j in np.argwhere(alike & (roots[a][:, None] != roots[b][None])):
                x, y = top(int(roots[a[i]])), top(int(roots[b[j]]))
                if x != y:
                    parent[x] = y
                    links.append((names[a[i]], names[b[j]]))
        return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)

    return found


def similar_links(texts: DataFrame, least: float = 0.8, width: int = 5, seed: int = 42, budget: int = WIDE_BUDGET, task_fingerprints: int = TASK_FINGERPRINTS) -> DataFrame:
    """(a, b): links that connect what pairs of ``texts`` (text_hash, text; distinct) of similarity ``least`` or more connect.

    Candidates are one component of the trie join of their fingerprints, or share
    a band of least hashes; the component counts as a band as well. First each
    text is compared with the least of its band, so a large group of copies needs no more than a star. Bands whose texts
    are still in different components are then compared whole, in blocks of
    BLOCK_TEXTS texts: a block counts shared shingles by matrix products and gives
    a forest of its links, so no pairs leave it. Those counts grow with the square
    of a band's texts, as texts just below ``least`` cannot be told apart without.
    """

    @F.pandas_udf("array<long>")
    def bands(x: pd.Series) -> pd.Series:
        return pd.Series([band_keys(shingles(t, width, seed), seed) for t in x])

    @F.pandas_udf("array<long>")
    def sets_of(x: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, width, seed).view(np.int64) for t in x])

    @F.pandas_udf("double")
    def compare(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similarity(shingles(x, width, seed), shingles(y, width, seed)) for x, y in zip(a, b, strict=True)], dtype=float)

    prints = stage(texts.select("text_hash", fingerprint_column(F.col("text"), width, seed).alias("code"), bands("text").alias("keys")), "wide_fingerprints")
    near = stage(connected_components(links(prints.select("code").distinct(), budget, task_fingerprints)), "trie_roots")
    grouped = prints.join(near, prints["code"] == near["node"], "left").select("text_hash", F.lit(BANDS).alias("band"), F.coalesce("root", "code").alias("key"))
    keys = stage(grouped.unionByName(prints.select("text_hash", F.posexplode("keys").alias("band", "key"))), "bands")

    def checked(pairs: DataFrame, name: str) -> DataFrame:
        both = pairs.join(texts.select(F.col("text_hash").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("text_hash").alias("b"), F.col("text").alias("text_b")), "b")
        return stage(both.where(compare("text_a", "text_b") >= least).select("a", "b"), name)

    hubs = keys.groupBy("band", "key").agg(F.min("text_hash").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = stage(keys.join(hubs, ["band", "key"]), "shared_bands")
    stars = checked(shared.where("text_hash <> a").select("a", F.col("text_hash").alias("b")).distinct(), "star_links")
    roots = stage(connected_components(stars), "star_roots")
    placed = stage(shared.join(roots, shared["text_hash"] == roots["node"], "left").select("band", "key", "a", "text_hash", F.coalesce("root", "text_hash").alias("root")), "placed_bands")
    # bands whose texts are one component by now have nothing to add
    open_ = placed.groupBy("band", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band", "key")
    left = stage(placed.join(open_, ["band", "key"], "left_semi").select("band", "key", "text_hash", "root"), "open_bands")
    sets = stage(texts.join(left.select("text_hash").distinct(), "text_hash", "left_semi").select("text_hash", sets_of("text").alias("shingles")), "open_shingles")
    blocks = split_hot(left, ["band", "key"], "text_hash", BLOCK_TEXTS).join(sets, "text_hash")
    rest = blocks.groupBy("band", "key", "bi", "bj").applyInPandas(_block_forest(least), "a long, b long")
    return stars.unionByName(stage(rest, "other_links"))


def keep_one_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, width: int = 5, seed: int = 42) -> DataFrame:
    """``docs`` with one row (that of the least id) for each component of texts whose word shingles are similar by ``least`` or more.

    Fingerprints go through the trie join; what it and the bands bring together is compared exactly. Null and empty texts are one component. Columns stay as they are.
    """
    small_batches(docs.sparkSession)
    hashed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    texts = hashed.select("text_hash", "text").dropDuplicates(["text_hash"])
    roots = stage(connected_components(similar_links(stage(texts, "distinct_texts"), least, width, seed)), "roots")
    placed = hashed.select("doc_id", "text_hash").join(roots, F.col("text_hash") == roots["node"], "left").select("doc_id", "text_hash", F.coalesce("root", "text_hash").alias("root"))
    return keep_rows(docs, placed, id_col, text_col)
