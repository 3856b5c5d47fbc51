"""SimHash near-duplicates: fingerprints, a grid join on segment bit counts, exact check."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import components, cut

SHINGLE = 3
CHUNK = 1 << 16  # shingles hashed at a time, so a very long text needs bounded memory
# Values of a byte as its eight bits, lowest first.
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
# The 32 two-bit segments of a fingerprint in six blocks: (first bit, bits).
BLOCKS = ((0, 10), (10, 10), (20, 10), (30, 10), (40, 12), (52, 12))
LOW = 0x5555555555555555


def fingerprint(data: bytes, width: int = SHINGLE) -> int:
    """Bits set in over half of the shingles' XXH64 (seed 42); no word: zero."""
    words = data.lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    counts = np.zeros((8, 8), np.int64)
    for i in range(0, len(starts), CHUNK):
        hashes = np.array([digest(joined[s:e], 42) for s, e in zip(starts[i : i + CHUNK], ends[i : i + CHUNK])], "<u8")
        octets = hashes.view(np.uint8).reshape(-1, 8)
        for k in range(8):
            counts[k] += np.bincount(octets[:, k], minlength=256) @ BITS
    return int(sum(1 << int(b) for b in np.flatnonzero(2 * counts.ravel() > len(starts))))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): one pass over whole texts; null text is the empty text."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(x.as_py() or b"") for x in batch.column("body")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("body")).mapInArrow(run, f"doc_id {kind}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, limit: int = 3) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints, a < b, at ``limit`` (at most 3) differing bits.

    The bit counts of the 32 segments embed a fingerprint as a point; the Manhattan distance of
    two points is at most the number of differing bits. Points within distance 3 agree in at
    least three of six blocks of coordinates, so each point goes into the 20 grid cells that
    three blocks make, and cells are joined. The join itself drops pairs beyond the Manhattan
    bound, then checks the bits exactly; only links leave it. A pair counts in its first
    common cell only."""
    if not 0 <= limit <= 3:
        raise ValueError("the grid covers distances of 0 to 3")
    # Two-bit fields of the point: each the bit count of a segment, low + high without carry.
    even, odd = F.col("fp").bitwiseAND(F.lit(LOW)), F.shiftrightunsigned("fp", 1).bitwiseAND(F.lit(LOW))
    point = even.bitwiseXOR(odd).bitwiseOR(F.shiftleft(even.bitwiseAND(odd), 1))
    masks = [_signed(((1 << n) - 1) << at) for at, n in BLOCKS]
    cells = []
    for i, combo in enumerate(combinations(range(len(BLOCKS)), 3)):
        mask = _signed(sum((((1 << n) - 1) << at) for at, n in (BLOCKS[k] for k in combo)))
        # Earlier blocks outside the cell: if one agrees as well, an earlier cell has the pair.
        earlier = [masks[k] for k in range(combo[-1]) if k not in combo]
        cells.append(F.struct(
            F.lit(i).alias("cell"),
            F.col("point").bitwiseAND(F.lit(mask)).alias("key"),
            *[F.lit(earlier[k] if k < len(earlier) else 0).cast("long").alias(f"e{k}") for k in range(3)],
        ))
    grid = distinct.select("fp", point.alias("point")).select("fp", "point", F.explode(F.array(*cells)).alias("c")).select("fp", "point", "c.*")
    a = grid.select("cell", "key", F.col("fp").alias("a"), F.col("point").alias("pa"), "e0", "e1", "e2")
    b = grid.select("cell", "key", F.col("fp").alias("b"), F.col("point").alias("pb"))
    apart = F.col("pa").bitwiseXOR(F.col("pb"))
    # |difference| of two fields in 0..2 from their xor: 1 and 3 mean one, 2 means two.
    high = F.shiftrightunsigned(apart, 1)
    manhattan = F.bit_count(apart.bitwiseAND(F.lit(LOW))) + 2 * F.bit_count(high.bitwiseAND(F.bitwise_not(apart)).bitwiseAND(F.lit(LOW)))
    first = F.lit(True)
    for k in range(3):
        first = first & ((F.col(f"e{k}") == 0) | (apart.bitwiseAND(F.col(f"e{k}")) != 0))
    near = (
        (F.col("a") < F.col("b"))
        & (manhattan <= limit)
        & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= limit)
        & first
    )
    return a.join(b, (a["cell"] == b["cell"]) & (a["key"] == b["key"]) & near).select("a", "b")


def near_duplicates(docs: DataFrame, limit: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row.

    Equal fingerprints are one point, so a group of copies costs one row in the grid. The
    component's id is its smallest doc_id; null ids are passed over (null if it has no other).
    Empty and null texts share fingerprint zero and link like any other; repeated rows stay."""
    given = cut(fingerprints(docs), "fingerprints")
    points = given.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(points.select("fp"), limit))
    named = points.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = cut(named, "points")
    # Only points with a link need the least id of their component.
    linked = named.join(roots.select(F.col("root").alias("r")).distinct(), F.col("root") == F.col("r"), "left_semi")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = named.join(least, "root", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return given.join(ids, "fp").select("doc_id", hexed, "component_id")


def without_near_duplicates(docs: DataFrame, limit: int = 3) -> DataFrame:
    """The rows of ``docs`` that are the smallest doc_id of their component, same columns. A
    repeated row (doc_id and text) stays once. Rows without a doc_id stay, as none of them can be
    named the one to keep."""
    found = near_duplicates(docs.select("doc_id", "text"), limit)
    keep = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    # Both steps go by doc_id, so texts move once.
    kept = docs.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
