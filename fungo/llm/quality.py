"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over 4-grams of UTF-16 code units, so a gram is exactly one 64-bit
number in every script (a character beyond U+FFFF is two units). Counts of
trusted text are a table sharded by gram; joins of the counts of each order with
those of its contexts give discounted probabilities and back-off weights, also
for grams that only other documents have.

Documents are scored by a join of their gram counts with that table. The most
frequent grams of the corpus, HOT_GRAMS at most, are the skewed keys of this
join and most of its rows: for them log p is broadcast, and their products are
summed by document before any shuffle. All other grams of a document go through
a shuffle join with the whole table. Both ways give the same sums.

A document is kept if its perplexity is at most a quantile of that of trusted
documents in its language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stage

ORDER, UNIT = 4, 16
#: Code units of a text, and distinct grams of a task, that are held at once.
SLICE, GRAMS_HELD = 1 << 20, 2_000_000
#: Bound of the broadcast: grams whose log p every task holds (16 bytes each).
HOT_GRAMS = 400_000
#: Bound of the other broadcast: hash buckets of trusted ids. Salts of the join by language.
ID_BUCKETS, SALTS = 1 << 21, 64
QUANTILE = 0.995


def grams(text: str | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grams of a whole text, its start padded with zeros, and their counts; a very long text comes in parts."""
    units = np.frombuffer((text or "").encode("utf-16-le", "surrogatepass"), "<u2")
    for at in range(0, len(units), SLICE):
        x = units[max(at - ORDER + 1, 0) : at + SLICE].astype(np.uint64)
        x = np.concatenate([np.zeros(max(ORDER - 1 - at, 0), np.uint64), x])
        packed = x[ORDER - 1 :].copy()
        for back in range(1, ORDER):
            packed |= x[ORDER - 1 - back : len(x) - back] << np.uint64(UNIT * back)
        g, n = np.unique(packed, return_counts=True)
        yield g.view(np.int64), n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to (gram, n), summed within the task as far as memory goes."""
    found, counts, held = [], [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        g, which = np.unique(np.concatenate(found), return_inverse=True)
        return g, np.bincount(which, np.concatenate(counts), len(g)).astype(np.int64)

    def batch_of(g: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(n, pa.int64())], names=["gram", "n"])

    for batch in batches:
        for text in batch["text"]:
            for g, n in grams(text.as_py()):
                found.append(g)
                counts.append(n)
                held += len(g)
            if held > GRAMS_HELD:
                g, n = merged()
                if len(g) > GRAMS_HELD // 2:
                    yield batch_of(g, n)
                    g, n = g[:0], n[:0]
                found, counts, held = [g], [n], len(g)
    if found:
        yield batch_of(*merged())


def count_grams(texts: DataFrame, name: str) -> DataFrame:
    """(gram, n) of a text column, staged."""
    return stage(texts.mapInArrow(_count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), name)


def _discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts of 1, 2, and 3 and more; 0.5 where the counts of counts do not allow any."""
    if not n1 or not n2:
        return np.array([0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = np.array([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2 - 3 * y * n3 / n2])
    return np.clip(d, 0.05, [0.95, 1.9, 2.9])


def _last(gram: Column, units: int) -> Column:
    """The last units of a gram."""
    return gram.bitwiseAND((1 << UNIT * units) - 1) if units < ORDER else gram


def log_probabilities(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, logp) for each of the distinct grams ``wanted``, from the trusted ``counts`` (gram, n)."""
    orders = [counts]
    for k in range(ORDER - 1, 0, -1):
        # below the highest order, a gram counts its different left neighbours
        orders.insert(0, stage(orders[0].groupBy(_last(F.col("gram"), k).alias("gram")).agg(F.count("*").alias("n")), "lower_counts"))
    units = orders[0].count()
    p = None
    for k, c in enumerate(orders, 1):
        d = [float(x) for x in _discounts(*c.agg(*(F.count_if(F.col("n") == i) for i in (1, 2, 3, 4))).first())]
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        mine = wanted if k == ORDER else wanted.select(_last(F.col("gram"), k).alias("gram")).distinct()
        seen = mine.join(c, "gram", "left")
        if k == 1:
            total, back = c.agg(F.sum("n"), F.sum(cut)).first()
            # one more unit stands for all unseen ones
            direct, weight, lower = (F.col("n") - cut) / F.lit(float(total or 1)), F.lit(back / total if total else 1.0), F.lit(1 / (units + 1))
        else:
            head = F.shiftrightunsigned("gram", UNIT)
            contexts = c.groupBy(head.alias("context")).agg(F.sum("n").alias("total"), F.sum(cut).alias("held_back"))
            seen = seen.withColumns({"context": head, "tail": _last(F.col("gram"), k - 1)}).join(contexts, "context", "left").join(p.select(F.col("gram").alias("tail"), F.col("p").alias("lower")), "tail")
            direct, weight, lower = (F.col("n") - cut) / F.col("total"), F.coalesce(F.col("held_back") / F.col("total"), F.lit(1.0)), F.col("lower")
        p = stage(seen.select("gram", (F.coalesce(direct, F.lit(0.0)) + weight * lower).alias("p")), "gram_probabilities")
    return p.select("gram", F.log("p").alias("logp"))


def frequent(corpus: DataFrame, most: int) -> DataFrame:
    """Grams of ``corpus`` (gram, n) down to a count that leaves at most ``most`` of them."""
    size = F.floor(8 * F.log2("n")).cast("int")
    least, held = 1 << 30, 0
    for row in corpus.groupBy(size.alias("size")).agg(F.count("*").alias("grams")).orderBy(F.desc("size")).collect():  # 512 rows at most
        held += row["grams"]
        if held > most:
            break
        least = row["size"]
    return corpus.where(size >= least).select("gram")


POSTINGS = "row long, gram long, n long, doc_id long, lang_key long"


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each document one row (doc_id, lang_key, n: its units) without a gram, and one for each gram and part."""
    row = TaskContext.get().partitionId() << 33
    names = [x.split()[0] for x in POSTINGS.split(", ")]
    for batch in batches:
        for lo in range(0, len(batch), 64):
            some = batch.slice(lo, 64)
            rows, found, counts, totals = [], [], [], np.zeros(len(some), np.int64)
            for i, text in enumerate(some["text"]):
                for g, n in grams(text.as_py()):
                    rows.append(np.full(len(g), row + i))
                    found.append(g)
                    counts.append(n)
                    totals[i] += n.sum()
            heads = np.arange(row, row + len(some))
            yield pa.RecordBatch.from_arrays([pa.array(heads), pa.nulls(len(some), pa.int64()), pa.array(totals), some["doc_id"], some["lang_key"]], names=names)
            if rows:
                none = pa.nulls(sum(map(len, rows)), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(np.concatenate(found)), pa.array(np.concatenate(counts)), none, none], names=names)
            row += len(some)


def perplexities(rows: DataFrame, logs: DataFrame, hot: DataFrame) -> DataFrame:
    """doc_id, lang_key, n_grams and perplexity of each of ``rows`` (doc_id, text, lang_key), staged."""
    near = logs.join(hot, "gram", "left_semi").select("gram", "logp")
    # ``hot`` is bounded by HOT_GRAMS
    joined = rows.select("doc_id", "text", "lang_key").mapInArrow(_postings, POSTINGS).join(F.broadcast(near), "gram", "left")
    left = F.when(F.col("logp").isNull(), F.col("gram"))
    of_doc = F.col("gram").isNull()
    parts = joined.groupBy("row", left.alias("rest")).agg(
        F.sum(F.col("n") * F.col("logp")).alias("part"),
        F.sum(F.when(~of_doc, F.col("n"))).alias("n"),
        F.max(F.when(of_doc, F.col("n"))).alias("n_grams"),
        F.max("doc_id").alias("doc_id"),
        F.max("lang_key").alias("lang_key"),
    )
    parts = stage(parts, "score_parts")
    rest = parts.where("rest is not null").join(logs, F.col("rest") == logs["gram"]).groupBy("row").agg(F.sum(F.col("n") * F.col("logp")).alias("more"))
    total = F.coalesce("part", F.lit(0.0)) + F.coalesce("more", F.lit(0.0))
    perplexity = F.when(F.col("n_grams") > 0, F.exp(-total / F.col("n_grams")))
    return stage(parts.where("rest is null").join(rest, "row", "left").select("doc_id", "lang_key", "n_grams", perplexity.alias("perplexity")), "perplexities")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality", quantile: float = QUANTILE, hot_grams: int = HOT_GRAMS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, lang, n_grams, perplexity, threshold, keep.

    Trusted are all documents labelled 1. ``threshold`` is the quantile of
    trusted documents in the same language, or of all trusted ones where the
    language has none. A null or empty text has no perplexity and is not kept;
    a null language is a language of its own. Without trusted text every
    document that has text is kept. Repeated rows come back repeated; an empty
    table gives no row. Other columns are not read.
    """
    lang = F.col(lang_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(lang.isNull(), lang).alias("lang_key"), lang.alias("lang"))
    good = labels.where(F.col(label_col).cast("int") == 1).select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    good = stage(good, "trusted_ids")
    # texts that are surely not trusted go first, by a table of ID_BUCKETS rows at most; the rest is matched exactly
    in_bucket = F.pmod(F.xxhash64("doc_id"), F.lit(ID_BUCKETS)).alias("id_bucket")
    likely = rows.select("doc_id", "text", in_bucket).join(F.broadcast(good.select(in_bucket).distinct()), "id_bucket", "left_semi")
    counts = count_grams(likely.join(good.hint("merge"), "doc_id", "left_semi").select("text"), "gram_counts")
    corpus = count_grams(rows.select("text"), "corpus_grams")
    scored = perplexities(rows, log_probabilities(counts, corpus.select("gram")), frequent(corpus, hot_grams))
    trusted = scored.join(good, "doc_id", "left_semi").where("perplexity is not null")
    limits = trusted.groupBy("lang_key").agg(F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000)).alias("limit"))
    # one row
    overall = trusted.agg(F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000)).alias("overall"))
    names = rows.groupBy("lang_key").agg(F.first("lang").alias("lang"))
    # a language may hold most rows, so each is there SALTS times
    salted = names.join(limits, "lang_key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = scored.withColumn("salt", F.pmod(F.xxhash64("doc_id", "perplexity"), F.lit(SALTS)).cast("int")).join(salted, ["lang_key", "salt"]).join(F.broadcast(overall))
    threshold = F.coalesce("limit", "overall")
    return joined.select("doc_id", "lang", "n_grams", "perplexity", threshold.alias("threshold"), F.coalesce(F.col("perplexity") <= F.coalesce(threshold, F.lit(float("inf"))), F.lit(False)).alias("keep"))
