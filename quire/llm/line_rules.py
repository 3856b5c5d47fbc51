"""Quality rules: lines that many documents of one host share are removed, and documents that
lose most of their words by that are rejected."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut

WHITE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
CONTINUED = bytes(range(0x80, 0xC0))
WINDOW = 5

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "line_hashes array<long>, line_words array<int>"
)


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    key, base = ids[:n], len(seen)
    for i in range(1, width):
        top = int(key.max()) + 1
        if top * base >= 1 << 62:  # renumber before the code of a window would overflow
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key * base + ids[i : i + n]
    ordered = np.sort(key)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    hit = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + width, -1)
    return int((np.cumsum(edge) > 0).sum())


def measure(data: bytes) -> tuple:
    """The counts of one text and its distinct normalised lines: (hash, words in all)."""
    words = data.split()
    seen, dup, lines = set(), 0, {}
    for line in data.split(b"\n"):
        parts = line.split()
        if not parts:
            continue
        if line in seen:
            dup += 1
        seen.add(line)
        h = xxhash.xxh3_64_intdigest(b" ".join(parts).lower())
        lines[h] = lines.get(h, 0) + len(parts)
    return (
        len(words),
        len(data.translate(None, WHITE + CONTINUED)),
        len(data) - len(data.translate(None, SYMBOLS)),
        dup,
        repeated_words(words),
        [h - (1 << 64) if h >> 63 else h for h in lines],
        list(lines.values()),
    )


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, host, measures) per document, one pass over whole texts. Null text: empty."""
    types = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.list_(pa.int32())]

    def run(batches):
        for batch in batches:
            rows = [measure(x.as_py() or b"") for x in batch.column("body")]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("host"), *cols],
                ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_hashes", "line_words"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    given = docs.select("doc_id", F.col("source").cast("string").alias("host"), F.col("text").cast("binary").alias("body"))
    return given.mapInArrow(run, f"doc_id {kind}, host string, {MEASURES}")


def line_rules(docs: DataFrame, doc_limit: int = 50, min_words: int = 10, min_share: float = 0.3) -> DataFrame:
    """Base counts, words removed as shared lines, and the verdict, one row per document.

    A line (lower case, white space collapsed) that stands in more than ``doc_limit`` rows of
    one host is removed from all of them. A document is depleted when under ``min_words`` words
    or under ``min_share`` of its words remain. Each input row counts as one document; null
    hosts form one host; a null or empty text has no line and fails the base rule."""
    given = cut(measures(docs).withColumn("rid", F.monotonically_increasing_id()), "lines")
    lines = given.select("rid", F.xxhash64("host").alias("host"), F.explode(F.arrays_zip("line_hashes", "line_words")).alias("l")).select(
        "rid", "host", F.col("l.line_hashes").alias("line"), F.col("l.line_words").alias("words")
    )
    # Counts are combined before the shuffle; only lines above the limit remain, one row each.
    common = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > doc_limit).select("host", "line")
    removed = lines.join(common, ["host", "line"]).groupBy("rid").agg(F.sum("words").cast("long").alias("removed_words"))
    left = F.col("n_words") - F.col("removed_words")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    depleted = (F.col("removed_words") > 0) & ((left < min_words) | (left < min_share * F.col("n_words")))
    return (
        given.drop("line_hashes", "line_words")
        .join(removed, "rid", "left")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "removed_words",
        )
    )


def without_common_lines(docs: DataFrame, doc_limit: int = 50) -> DataFrame:
    """``docs`` with the shared lines cut out of ``text``; the other columns stay."""
    host = F.xxhash64(F.col("source").cast("string"))
    norm = F.translate(F.trim(F.regexp_replace("l", r"[\x20\x09-\x0D]+", " ")), ascii_uppercase, ascii_lowercase)
    numbered = cut(docs.select(F.struct(*docs.columns).alias("row")).withColumn("rid", F.monotonically_increasing_id()), "rows")
    lines = numbered.select(
        "rid", F.xxhash64(F.col("row.source").cast("string")).alias("host"), F.posexplode(F.split("row.text", "\n")).alias("pos", "l")
    ).withColumn("line", F.xxhash64(norm))
    common = lines.where(norm != "").select("rid", "host", "line").distinct().groupBy("host", "line").count().where(F.col("count") > doc_limit)
    gone = lines.join(common.select("host", "line"), ["host", "line"]).groupBy("rid").agg(F.collect_set("pos").alias("gone"))
    kept = F.array_join(F.filter(F.split("row.text", "\n"), lambda x, i: ~F.array_contains(F.col("gone"), i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(kept)
    return numbered.join(gone, "rid", "left").select(*[text.alias(c) if c == "text" else F.col(f"row.{c}") for c in docs.columns])
