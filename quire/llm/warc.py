"""WARC archives: records written by Spark tasks, and read back by boundary chains."""

from __future__ import annotations

import gzip
import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import cut, fresh_path

MAGIC = b"WARC/1.0\r\n"
END = b"\r\n\r\n"
SMALLEST_REVISIT = 100
ARCHIVE_BYTES = 32 << 20

FOUND = (
    "file string, at long, next long, record_id string, record_type string, refers_to string, "
    "url string, page_id long, payload_bytes long, payload_digest string, stated_digest string"
)
PLACED = FOUND + ", file_bytes long"


def record_types(pages: DataFrame, least_bytes: int = SMALLEST_REVISIT) -> DataFrame:
    """(page_id, digest, refers_to) per distinct page and payload: the page whose response it
    revisits, or null. The least page_id of a payload is combined before the shuffle, so a
    payload of a third of all rows is no hot group."""
    body = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    marks = pages.select("page_id", F.octet_length(body).alias("size"), F.sha2(body, 256).alias("digest"))
    marks = cut(marks.where(F.col("size") >= least_bytes).select("page_id", "digest").distinct(), "digests")
    first = marks.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    return marks.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", "digest", F.col("first").alias("refers_to"))


def record_id(page_id, digest):
    """A name-based UUID from the page and its payload, so that reruns agree."""
    h = F.md5(F.concat_ws(":", F.lit("page"), F.coalesce(page_id.cast("string"), F.lit("")), digest))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]], F.lit(">"))


def write_archives(pages: DataFrame, path: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Write one record per row into gzipped WARC files under ``path``; returns ``path``.

    Payloads of ``SMALLEST_REVISIT`` bytes or more that a smaller page_id has as well become
    revisit records without a body. Spark's text writer makes the files: a row is a record, and
    the line separator is the record's end. Rows are dealt by hash to as many files as keep
    each near ``archive_bytes``. A null page_id has no page header and is never referred to;
    null html is an empty payload; line breaks in a url are escaped."""
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    text = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text.alias("body"))
    total = own.agg(F.sum(F.octet_length("body") + 512)).first()[0] or 0
    files = max(1, -(-total // archive_bytes), min(spark.sparkContext.defaultParallelism, total >> 20))
    own = own.withColumn("digest", F.sha2(F.col("body").cast("binary"), 256))
    refs = record_types(own.withColumnRenamed("body", "html"))
    refs = refs.select(record_id(F.col("page_id"), F.col("digest")).alias("ident"), "refers_to")
    # The join goes by the deal into files, so payloads move once.
    rows = own.withColumn("ident", record_id(F.col("page_id"), F.col("digest"))).repartition(int(files), "ident").join(refs, "ident", "left")
    again = F.col("refers_to").isNotNull()
    body = F.when(again, F.lit("")).otherwise(F.col("body"))
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "%", "%25"), "\r", "%0D"), "\n", "%0A")
    lines = [
        F.lit("WARC/1.0"),
        F.concat(F.lit("WARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), F.col("ident")),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), safe),
        F.concat(F.lit("X-Page-Id: "), F.col("page_id").cast("string")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("refers_to"), F.col("digest")))),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    ]
    record = F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), body).alias("value")
    rows.select(record).write.option("lineSep", END.decode()).option("compression", "gzip").text(path)
    return path


def parse_at(data: bytes, at: int):
    """The record that the magic at ``at`` would start, as (next, headers, payload span), or None."""
    stop = data.find(END, at)
    if stop < 0:
        return None
    heads = {}
    for line in data[at + len(MAGIC) : stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        heads[name.strip().lower()] = value.strip()
    size = heads.get(b"content-length", b"")
    if not re.fullmatch(rb"[0-9]{1,18}", size):
        return None
    start, end = stop + len(END), stop + len(END) + int(size)
    if data[end : end + len(END)] != END:
        return None
    return end + len(END), heads, (start, end)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every place in every archive that looks like a record, true or inside a payload, with
    the place of its successor. One file is one row; files are bounded by their writer.

    A record starts the file or follows a record's end, so other magic is passed over. An end
    then stands between any two candidates, and their headers, of any length, are read once."""

    def run(frames):
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"]):
                data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else bytes(content)
                rows = []
                for hit in re.finditer(re.escape(MAGIC), data):
                    if hit.start() and data[hit.start() - len(END) : hit.start()] != END:
                        continue
                    found = parse_at(data, hit.start())
                    if found is None:
                        continue
                    nxt, heads, (a, b) = found
                    get = lambda k: heads[k].decode("utf-8", "replace") if k in heads else None
                    page, digest = get(b"x-page-id"), get(b"warc-payload-digest")
                    url = get(b"warc-target-uri")
                    rows.append((
                        file, hit.start(), nxt, get(b"warc-record-id"), get(b"warc-type"), get(b"warc-refers-to"),
                        url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
                        int(page) if page else None, b - a, hashlib.sha256(memoryview(data)[a:b]).hexdigest(), digest and digest.rpartition(":")[2], len(data),
                    ))
                if data and (not rows or rows[0][1] != 0):
                    raise ValueError(f"{file}: no record at the start")
                for i in range(0, len(rows), 10_000):
                    yield _frame(rows[i : i + 10_000])

    names = [x.split()[0] for x in PLACED.split(", ")]

    def _frame(rows):
        out = pd.DataFrame(rows, columns=names)
        for c in ("at", "next", "page_id", "payload_bytes", "file_bytes"):
            out[c] = out[c].astype("Int64")
        return out

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInPandas(run, PLACED)


def reachable(at: np.ndarray, nxt: np.ndarray, start: int = 0) -> np.ndarray:
    """Which places the chain from ``start`` passes: pointers are doubled, and each round marks
    what the marked places reach by the doubled pointer. ``at`` is sorted."""
    n = len(at)
    to = np.searchsorted(at, nxt)
    to = np.where((to < n) & (at[np.minimum(to, n - 1)] == nxt), to, n) if n else to
    jump = np.append(to, n)  # n: the end, its own successor
    mark = np.append(at == start, False)
    while True:
        reached = jump[:n][mark[:n]]
        new = mark.copy()
        new[reached] = True
        new[n] = False
        jump = jump[jump]
        if (new == mark).all() and (jump[:n][mark[:n]] == n).all():
            return mark[:n]
        mark = new


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records that the chain from the start of each file reaches. Magic inside a payload
    has a successor too, but nothing reachable leads to it. A group is the candidates of one
    archive, bounded by the archive's size. A chain that does not end where its file ends is an
    error, as the records behind it would be lost."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        keep = reachable(pdf["at"].to_numpy(np.int64), pdf["next"].to_numpy(np.int64))
        last, size = pdf["next"][keep].max(), pdf["file_bytes"].iloc[0]
        if last != size:
            raise ValueError(f"{pdf['file'].iloc[0]}: the records end at byte {last} of {size}")
        return pdf[keep].drop(columns="file_bytes")

    return candidates(spark, path).groupBy("file").applyInPandas(run, FOUND)


def resolved(records: DataFrame) -> DataFrame:
    """Records with the payload of a revisit taken from the response that it refers to: one row
    per record with page_id, payload_bytes, payload_digest, record_type, refers_to, verified."""
    records = cut(records, "records")
    again = records.where("record_type = 'revisit'")
    answers = records.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("page_id").alias("first"), F.col("payload_bytes").alias("size"), F.col("payload_digest").alias("full")
    ).dropDuplicates(["refers_to"])
    whole = again.join(answers, "refers_to", "left").select(
        "page_id", "url", F.col("size").alias("payload_bytes"), F.col("full").alias("payload_digest"), "record_type",
        F.col("first").alias("refers_to"), (F.col("full") == F.col("stated_digest")).alias("verified"),
    )
    plain = records.where("record_type = 'response'").select(
        "page_id", "url", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"),
        (F.col("payload_digest") == F.col("stated_digest")).alias("verified"),
    )
    return plain.unionByName(whole)
