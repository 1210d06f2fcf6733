"""WARC archives: written by Spark as text, read back by boundary chains.

Writing: one record a page. Of pages with equal payloads of some length the one
with the least id is a response, the others are revisits of it.

Reading: wherever the magic stands, a task emits a candidate record and the
offset of its successor (end of the block that its header declares). Magic can
stand inside payloads too; only candidates that the chain from the start of the
file reaches are records. Reachability is found by pointer jumping: pointers are
doubled until they stand still, on offsets alone, file by file.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, stage

MAGIC = b"WARC/1.1\r\n"
#: Archives are rotated at this many rows, and at this many bytes where pages are long; only a record that is longer by itself makes a longer file.
FILE_PAGES, FILE_BYTES = 2_000, 8 << 20
#: Records whose lengths differ by up to this factor are written together. HEAD_BYTES: header lines without the address, at most.
SIZE_STEP, HEAD_BYTES = 8, 1_024
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
URN = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 100, file_bytes: int = FILE_BYTES) -> str:
    """Archive ``pages`` under ``path`` and return the path.

    Spark's writer rotates by rows only. So pages are written by classes of
    length, each with as many rows a file as ``file_bytes`` allows its longest
    record; a task writes its own pages of a class.

    Null payloads are empty. Equal payloads shorter than ``least_bytes`` are
    responses all. Null ids or addresses are written as empty. Line breaks in an
    address are percent-encoded. A payload is not moved between machines unless
    the table of revisits is too large for a broadcast.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    base = base.withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    keys = stage(base.where(F.col("bytes") >= least_bytes).select("page_id", "digest"), "page_digests")
    first = keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = stage(keys.join(first, "digest").where("page_id > first").select(F.col("page_id").alias("again"), F.col("digest").alias("same"), F.col("first").alias("refers_to")).distinct(), "revisits")
    # a page that comes with several payloads is a revisit only where the payload is the earlier one
    joined = base.join(revisits, (base["page_id"] == revisits["again"]) & (base["digest"] == revisits["same"]), "left").drop("again", "same")
    http = F.concat(F.lit(HTTP_HEAD), F.col("bytes"), F.lit("\r\n\r\n"))
    block = F.when(F.col("refers_to").isNull(), F.concat(http, F.col("payload"))).otherwise(http)
    name = lambda c: F.concat(F.lit("<" + URN), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    head = [
        F.concat(F.lit("WARC-Type: "), F.when(F.col("refers_to").isNull(), F.lit("response")).otherwise(F.lit("revisit"))),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(F.col("refers_to").isNotNull(), F.concat(F.lit("WARC-Refers-To: "), name(F.col("refers_to")), F.lit(f"\r\nWARC-Profile: {PROFILE}"))),
        F.concat(F.lit("Content-Length: "), F.octet_length(block)),
    ]
    # the writer ends each value with the line separator, so a record ends in CR LF CR LF
    record = F.concat(F.lit(MAGIC.decode()), F.concat_ws("\r\n", *head), F.lit("\r\n\r\n"), block, F.lit("\r\n\r"))
    longest = F.col("bytes") + 3 * F.coalesce(F.octet_length("url"), F.lit(0)) + HEAD_BYTES
    rows = [FILE_PAGES]
    while rows[-1] > 1:
        rows.append(rows[-1] // SIZE_STEP or 1)
    size_class = F.lit(len(rows) - 1)
    for k in reversed(range(len(rows) - 1)):
        size_class = F.when(longest * rows[k] <= file_bytes, k).otherwise(size_class)
    present = sorted(r[0] for r in base.select(size_class).distinct().collect())  # a handful
    for k in present or [0]:
        joined.where(size_class == k).select(record.alias("value")).write.mode("append" if k != (present or [0])[0] else "error").option("lineSep", "\n").option("maxRecordsPerFile", rows[k]).text(path)
    return path


_FIELD = re.compile(rb"(?im)^([A-Za-z-]+):[ \t]*(.*?)\r?$")


def _candidate(data: bytes, at: int) -> dict | None:
    """What a header at ``at`` declares; None unless it is whole and its block lies in the file."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return None
    fields = {k.lower(): v for k, v in _FIELD.findall(data, at + len(MAGIC), end)}
    length = fields.get(b"content-length", b"")
    if not length.isdigit():
        return None
    body = end + 4
    after = body + int(length)
    if data[after : after + 4] != b"\r\n\r\n":
        return None
    split = data.find(b"\r\n\r\n", body, after)
    payload = memoryview(data)[split + 4 : after] if split >= 0 else memoryview(data)[after:after]
    return {"at": at, "next": after + 4, "fields": fields, "payload": payload}


def _page_id(name: bytes) -> int | None:
    m = re.fullmatch(rb"<urn:page:(-?\d+)>", name)
    return int(m[1]) if m else None


CANDIDATES = "file string, at long, next long, size long, page_id long, record_type string, refers_to long, declared string, payload_bytes long, payload_digest string"


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in CANDIDATES.split(", ")]
    types = [{"string": pa.string(), "long": pa.int64()}[x.split()[1]] for x in CANDIDATES.split(", ")]
    for batch in batches:
        for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
            data, rows, at = content.as_py(), [], -1
            while (at := data.find(MAGIC, at + 1)) >= 0:
                if c := _candidate(data, at):
                    f = c["fields"]
                    kind = f.get(b"warc-type", b"").decode("latin-1")
                    rows.append((path, at, c["next"], len(data), _page_id(f.get(b"warc-record-id", b"")), kind, _page_id(f.get(b"warc-refers-to", b"")), f.get(b"warc-payload-digest", b"").decode("latin-1").removeprefix("sha256:"), len(c["payload"]), hashlib.sha256(c["payload"]).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def reachable(at: np.ndarray, after: np.ndarray, start: int = 0) -> np.ndarray:
    """Which candidates the chain from ``start`` reaches. ``at`` ascends.

    In each round everything reached passes its mark along a pointer, and all
    pointers double, so a chain of n records takes log2(n) rounds.
    """
    n = len(at)
    to = np.searchsorted(at, after)
    to = np.where((to < n) & (at[np.minimum(to, n - 1)] == after), to, n)
    to = np.append(to, n)
    mark = np.append(at == start, False)
    while True:
        reached = mark.copy()
        reached[to[np.flatnonzero(mark)]] = True
        reached[n] = False
        further = to[to]
        if np.array_equal(reached, mark) and np.array_equal(further, to):
            return mark[:n]
        mark, to = reached, further


def _chain(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("at", ignore_index=True)
    return group[reachable(group["at"].to_numpy(np.int64), group["next"].to_numpy(np.int64))][["file", "at"]]


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives under ``path``: page_id, record_type, refers_to, declared, payload_bytes, payload_digest.

    Raises on reading if the digest of a response is not the declared one.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = stage(files.mapInArrow(_candidates, CANDIDATES), "warc_candidates")
    kept = found.select("file", "at", "next").groupBy("file").applyInPandas(_chain, "file string, at long")
    records = found.join(kept, ["file", "at"])
    sound = F.when((F.col("record_type") == "response") & (F.col("declared") != F.col("payload_digest")), F.raise_error(F.concat(F.lit("digest mismatch in "), F.col("file")))).otherwise(F.col("payload_digest"))
    return records.select("page_id", "record_type", "refers_to", "declared", "payload_bytes", sound.alias("payload_digest"))


def resolve(records: DataFrame) -> DataFrame:
    """One row a record, revisits with length and digest of the payload they refer to."""
    records = stage(records, "warc_records")
    wanted = records.where("refers_to is not null").select(F.col("refers_to").alias("t"), F.col("declared").alias("d")).distinct()
    targets = records.where("record_type = 'response'").join(wanted, (F.col("page_id") == F.col("t")) & (F.col("payload_digest") == F.col("d")), "left_semi").select(F.col("page_id").alias("target"), F.col("payload_bytes").alias("target_bytes"), F.col("payload_digest").alias("target_digest")).dropDuplicates(["target", "target_digest"])
    again = F.col("record_type") == "revisit"
    return records.join(targets, (records["refers_to"] == targets["target"]) & (records["declared"] == targets["target_digest"]), "left").select(
        "page_id",
        F.when(again, F.col("target_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(again, F.col("target_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def round_trip(pages: DataFrame, path: str | None = None, **columns) -> DataFrame:
    """Archive ``pages``, read the archives back, and return one row for each record.

    page_id, payload_bytes, payload_digest, record_type, refers_to. Repeated
    rows with one id make a record each, whether their payloads are the same or
    not, and are responses if their payload has no smaller id. A null id comes back null, as a response. An empty table
    gives no row. Other columns are not read.
    """
    spark = pages.sparkSession
    path = write(pages, path or new_path(spark, "warc"), **columns)
    return resolve(read(spark, path))
