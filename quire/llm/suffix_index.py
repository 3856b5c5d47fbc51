"""Exact repeats of 100 bytes or more, by a logarithmic family of sampled suffix arrays.

A suffix is kept where its first ``GRAM`` bytes have the least hash of some ``WIDTH``-byte
window, so every window contains a kept suffix, and equal windows contain the same one. An
array entry is a kept suffix with the windows that chose it: (key: hash of the gram, content:
hash of all their bytes, uid, loc). Entries sorted by (key, content) put equal stretches side
by side, as a suffix array does.

A batch of new documents becomes an array of its own. It is merge-scanned against every level
of the index: entries with equal content are long matches. Then it joins the family, in which
two levels of equal size merge into one of the next size. All levels are bucketed by key in the
same way, so scans and merges move nothing between machines.

Entries that share a gram but not all content match in part. Their windows are compared
exactly, in groups with a common core of 78 bytes."""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import cut, discard, fresh_path, release, setting, shared_dir

WIDTH = 100
GRAM = 32
SPAN = WIDTH - GRAM + 1  # grams in a window
BLOCK = 23  # window offsets that share a core: three blocks cover the 69 offsets
CORE = WIDTH - BLOCK + 1
CHUNK = 1 << 18  # bytes hashed at a time
FLUSH = 16  # chunks whose entries are sorted together
BATCH_ROWS = "1000"  # of Arrow batches
POS_BITS = 20
GROUP_ROWS = 50_000  # larger groups are not held by a task but counted by window hash
BATCHES = 4
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
COPARTITION = "spark.sql.requireAllClusterKeysForCoPartition"

U = np.uint64
BASE = 0x9E3779B97F4A7C15
BYTE_CODES = np.random.RandomState(20).randint(1, 1 << 62, 256, np.int64).astype(np.uint64) * U(2) + U(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & ((1 << 64) - 1), np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


TABLES: list[np.ndarray] = []


def tables() -> list[np.ndarray]:
    if not TABLES:
        n = CHUNK + 2 * WIDTH + 2
        TABLES.extend((_powers(BASE, n), _powers(pow(BASE, -1, 1 << 64), n)))
    return TABLES


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte codes times powers: the hash of data[s:e] is (P[e] - P[s]) / base**s."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * tables()[0][: len(data)], dtype=np.uint64, out=out[1:])
    return out


def hashes(p: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mixed((p[ends] - p[starts]) * tables()[1][starts])


def least_in_window(v: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        v = np.minimum(v[:-n], v[n:])
        n *= 2
    return np.minimum(v[: len(v) - (width - n)], v[width - n :]) if n < width else v


def pieces(bodies):
    """Cut texts into chunks: lists of (row, first byte, bytes). Long texts overlap by a window
    less one byte, so each window lies in one piece."""
    out, size = [], 0
    for row, body in enumerate(bodies):
        at = 0
        while at == 0 or at + WIDTH <= len(body):
            part = body[at : at + CHUNK]
            if size + len(part) > CHUNK + WIDTH and out:
                yield out
                out, size = [], 0
            out.append((row, at, part))
            size += len(part)
            at += CHUNK - WIDTH + 1
    if out:
        yield out


def entries(chunk):
    """Array entries of a chunk: (key, content, row, first window, gram - first, windows - 1)."""
    data = np.frombuffer(b"".join(x[2] for x in chunk), np.uint8)
    n = len(data)
    if n < WIDTH:
        return None
    p = prefix(data)
    gram = mixed((p[GRAM:] - p[:-GRAM]) * tables()[1][: n - GRAM + 1])
    place = np.arange(len(gram), dtype=np.uint64)
    # The place breaks ties, so the leftmost least gram is chosen.
    least = least_in_window((gram >> U(POS_BITS) << U(POS_BITS)) | place, SPAN) & U((1 << POS_BITS) - 1)
    sizes = np.array([len(x[2]) for x in chunk])
    ends = np.cumsum(sizes)
    inside = np.zeros(n + 1, np.int64)
    whole = sizes >= WIDTH
    np.add.at(inside, (ends - sizes)[whole], 1)
    np.add.at(inside, (ends - WIDTH + 1)[whole], -1)
    windows = np.flatnonzero(np.cumsum(inside)[: len(least)])
    if not len(windows):
        return None
    chosen = least[windows].astype(np.int64)
    cut = np.flatnonzero((chosen[1:] != chosen[:-1]) | (windows[1:] != windows[:-1] + 1))
    first = windows[np.append(0, cut + 1)]
    last = windows[np.append(cut, len(windows) - 1)]
    at = chosen[np.append(0, cut + 1)]
    content = mixed(hashes(p, first, last + WIDTH) + ((at - first) * 128 + (last - first)).astype(np.uint64))
    piece = np.searchsorted(ends, first, side="right")
    rows = np.array([x[0] for x in chunk])[piece]
    start = first - (ends - sizes)[piece] + np.array([x[1] for x in chunk])[piece]
    return gram[at], content, rows, start, at - first, last - first


def scan(texts: DataFrame) -> DataFrame:
    """(key, content, uid, loc, again) of ``texts`` (uid, text). Content that stands earlier in the
    same few chunks is marked ``again`` and dealt by its place, so copies never pile up on a key."""

    def run(batches):
        for batch in batches:
            uid = batch.column("uid").to_numpy()
            parts = []
            for chunk in pieces(x.as_py() or b"" for x in batch.column("body")):
                found = entries(chunk)
                if found is not None:
                    parts.append(found)
                if len(parts) == FLUSH:
                    yield sorted_entries(parts, uid)
                    parts = []
            if parts:
                yield sorted_entries(parts, uid)

    def sorted_entries(parts, uid):
        key, content, row, start, gram, more = (np.concatenate(c) for c in zip(*parts))
        ident = uid[row]
        loc = (start << 14) | (gram << 7) | more
        order = np.lexsort((loc, ident, content, key))
        k, c = key[order], content[order]
        again = np.zeros(len(key), bool)
        again[order[1:]] = (k[1:] == k[:-1]) & (c[1:] == c[:-1])
        key = np.where(again, mixed(loc.astype(np.uint64) + ident.astype(np.uint64) * U(BASE)), key)
        return pa.RecordBatch.from_arrays(
            [pa.array(key.view(np.int64)), pa.array(content.view(np.int64)), pa.array(ident), pa.array(loc), pa.array(again)],
            ["key", "content", "uid", "loc", "again"],
        )

    return texts.select("uid", F.col("text").cast("binary").alias("body")).mapInArrow(run, "key long, content long, uid long, loc long, again boolean")


class SuffixIndex:
    """A family of suffix arrays in the shared folder: level k holds 2**k batches."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: dict[int, tuple[str, str]] = {}
        self.hits: list[DataFrame] = []

    def _table(self, df: DataFrame) -> tuple[str, str]:
        name, path = f"suffixes_{uuid.uuid4().hex}", fresh_path(self.spark, "suffixes")
        with setting(self.spark, ARROW_ROWS, BATCH_ROWS):
            self._write(df, name, path)
        release(self.spark)
        return name, path

    def _write(self, df: DataFrame, name: str, path: str) -> None:
        df.write.bucketBy(self.buckets, "key").sortBy("key", "content").option("path", path).saveAsTable(name)

    def _drop(self, level: tuple[str, str]) -> None:
        self.spark.sql(f"drop table {level[0]}")
        discard(self.spark, level[1])

    def _level(self, k: int) -> DataFrame:
        return self.spark.table(self.levels[k][0]).where("not again")

    def insert(self, texts: DataFrame) -> None:
        """Add a batch (uid, text) whose uids come after those of all batches before it."""
        array = scan(texts).repartition(self.buckets, "key")
        # Rows of equal content are at most one per few megabytes of text here.
        nth = F.row_number().over(Window.partitionBy("key", "content").orderBy("uid", "loc"))
        array = array.withColumn("again", F.col("again") | (nth > 1))
        fresh = self._table(array)
        found = self.spark.table(fresh[0])
        hits = found.where("again").select("uid", "loc")
        for k in sorted(self.levels):
            match = found.where("not again").join(self._level(k), ["key", "content"], "left_semi")
            hits = hits.union(match.select("uid", "loc"))
        with setting(self.spark, COPARTITION, "false"):  # the common buckets by key suffice
            self.hits.append(cut(hits, "hits"))
        self._place(fresh)

    def _place(self, level: tuple[str, str]) -> None:
        k = 0
        while k in self.levels:
            both = self._level(k).union(self.spark.table(level[0]).where("not again"))
            least = both.groupBy("key", "content").agg(F.min(F.struct("uid", "loc")).alias("s"))
            merged = self._table(least.select("key", "content", "s.uid", "s.loc", F.lit(False).alias("again")))
            self._drop(self.levels.pop(k))
            self._drop(level)
            level, k = merged, k + 1
        self.levels[k] = level

    def partial(self) -> DataFrame:
        """Entries (uid, loc), first of their content, whose gram has other content as well."""
        every = None
        for k in sorted(self.levels):
            part = self._level(k).select("key", "content", "uid", "loc")
            every = part if every is None else every.union(part)
        many = every.groupBy("key").agg(F.min("content").alias("a"), F.max("content").alias("b")).where("a <> b")
        return cut(every.join(many, "key", "left_semi").select("uid", "loc"), "partial")

    def close(self) -> None:
        for level in self.levels.values():
            self._drop(level)
        self.levels = {}


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, uid, z): the bytes of each text, compressed for the two joins that need them."""

    def run(batches):
        for batch in batches:
            pack = zstandard.ZstdCompressor(level=3).compress
            z = pa.array([pack(x.as_py() or b"") for x in batch.column("body")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("uid"), z], ["doc_id", "uid", "z"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "uid", F.col("text").cast("binary").alias("body")).mapInArrow(run, f"doc_id {kind}, uid long, z binary")


def blocks(texts: DataFrame, partial: DataFrame) -> DataFrame:
    """The windows of partly matching entries, in blocks that share a core:
    (core, uid, first, offset of the first window, bytes)."""
    places = partial.groupBy("uid").agg(F.collect_list("loc").alias("locs"))  # bounded by the text

    def run(batches):
        for batch in batches:
            unpack = zstandard.ZstdDecompressor().decompress
            for uid, z, locs in zip(batch.column("uid").to_pylist(), batch.column("z"), batch.column("locs")):
                body, loc = unpack(z.as_py()), np.asarray(locs.values)
                first, gram, more = loc >> 14, (loc >> 7) & 127, loc & 127
                at, low, high = first + gram, gram - more, gram  # offsets of the windows before the gram
                for lo in range(0, len(loc), 20_000):
                    sl = slice(lo, lo + 20_000)
                    rows = []
                    for j in range(3):
                        a, b = np.maximum(low[sl], j * BLOCK), np.minimum(high[sl], j * BLOCK + BLOCK - 1)
                        some = a <= b
                        for m, x, y in zip(at[sl][some].tolist(), a[some].tolist(), b[some].tolist()):
                            core = m - j * BLOCK
                            digest = hashlib.blake2b(body[core : core + CORE], digest_size=8, person=bytes([j])).digest()
                            rows.append((int.from_bytes(digest, "little", signed=True), m - y, y, body[m - y : m - x + WIDTH]))
                    if rows:
                        core, start, offset, part = zip(*rows)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(core, pa.int64()), pa.array([uid] * len(rows), pa.int64()), pa.array(start, pa.int64()), pa.array(offset, pa.int32()), pa.array(part, pa.binary())],
                            ["core", "uid", "start", "offset", "part"],
                        )

    return texts.join(places, "uid").mapInArrow(run, "core long, uid long, start long, offset int, part binary")


def compared(parts: DataFrame) -> DataFrame:
    """Windows of blocks with equal cores, compared by hash: (uid, start, stop, core, window) are
    the ranges of windows that stand earlier, or (window not null) single windows of groups too
    large for a task, for the caller to count. ``parts`` is sorted by core within partitions."""
    names = ["uid", "start", "stop", "core", "window"]

    def windows(cores, uids, starts, offsets, bodies):
        sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
        out = []
        lo = 0
        while lo < len(bodies):  # as many blocks as fit into a chunk
            hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo:]), CHUNK)))
            p = prefix(np.frombuffer(b"".join(bodies[lo:hi]), np.uint8))
            n = sizes[lo:hi] - WIDTH + 1
            base = np.repeat(np.cumsum(sizes[lo:hi]) - sizes[lo:hi], n)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            w = hashes(p, base + step, base + step + WIDTH)
            row = np.repeat(np.arange(lo, hi), n)
            # The offset from the gram belongs to what must be equal.
            out.append((row, step, mixed(w + (offsets[row] - step).astype(np.uint64))))
            lo = hi
        row, step, w = (np.concatenate(c) for c in zip(*out))
        return cores[row], uids[row], starts[row] + step, w

    def frame(uid, start, stop, core=None, window=None):
        none = pa.nulls(len(uid), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(uid, pa.int64()), pa.array(start, pa.int64()), pa.array(stop, pa.int64()), none if core is None else pa.array(core), none if window is None else pa.array(window.view(np.int64))], names
        )

    def closed(rows):
        core, uid, at, w = windows(*rows)
        order = np.lexsort((at, uid, w, core))
        c, h, u, s = core[order], w[order], uid[order], at[order]
        again = np.flatnonzero((c[1:] == c[:-1]) & (h[1:] == h[:-1])) + 1
        if not len(again):
            return
        u, s = u[again], s[again]
        order = np.lexsort((s, u))
        u, s = u[order], s[order]
        cut = np.flatnonzero((u[1:] != u[:-1]) | (s[1:] > s[:-1] + 1))
        yield frame(u[np.append(0, cut + 1)], s[np.append(0, cut + 1)], s[np.append(cut, len(s) - 1)])

    def opened(rows):
        core, uid, at, w = windows(*rows)
        yield frame(uid, at, at, core, w)

    def joined(held):
        a, b, c, d, e = zip(*held)
        return np.concatenate(a), np.concatenate(b), np.concatenate(c), np.concatenate(d), [x for part in e for x in part]

    def run(batches):
        held, count, hot = [], 0, None
        for batch in batches:
            core, uid, start = (batch.column(c).to_numpy() for c in ("core", "uid", "start"))
            offset, part = batch.column("offset").to_numpy().astype(np.int64), batch.column("part").to_pylist()
            edges = [0, *(np.flatnonzero(core[1:] != core[:-1]) + 1).tolist(), len(core)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                rows = (core[a:b], uid[a:b], start[a:b], offset[a:b], part[a:b])
                if hot == core[a]:
                    yield from opened(rows)
                    continue
                hot = None
                if held and held[-1][0][0] != core[a] and count >= GROUP_ROWS // 5:
                    yield from closed(joined(held))
                    held, count = [], 0
                held.append(rows)
                count += b - a
                if count > GROUP_ROWS:
                    # Only the last group can be incomplete; the ones before it are done.
                    last = [h for h in held if h[0][0] == core[a]]
                    before = [h for h in held if h[0][0] != core[a]]
                    if before:
                        yield from closed(joined(before))
                    held, count = last, sum(len(h[0]) for h in last)
                    if count > GROUP_ROWS:
                        for h in held:
                            yield from opened(h)
                        held, count, hot = [], 0, core[a]
        if held:
            yield from closed(joined(held))

    return parts.mapInArrow(run, "uid long, start long, stop long, core long, window long")


def partial_hits(texts: DataFrame, partial: DataFrame) -> list[DataFrame]:
    """(uid, start, stop): windows of partly matching entries that stand earlier."""
    buckets = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = blocks(texts, partial).repartition(buckets, "core").sortWithinPartitions("core")
    with setting(texts.sparkSession, ARROW_ROWS, BATCH_ROWS):
        found = cut(compared(parts), "compared")
    release(texts.sparkSession)
    sure = found.where("window is null").select("uid", "start", "stop")
    many = found.where("window is not null")
    first = many.groupBy("core", "window").agg(F.min(F.struct("uid", "start")).alias("f"), F.count("*").alias("n")).where("n > 1").select("core", "window", "f")
    more = many.join(first, ["core", "window"]).where("uid <> f.uid or start <> f.start").select("uid", "start", "stop")
    return [sure, more]


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``uid`` in document order. Unique doc_ids are used as they are; otherwise
    rows are ordered by doc_id (null last), then text, and numbered in a written copy."""
    ids = docs.groupBy("doc_id").count().agg(F.max("count"), F.sum(F.col("doc_id").isNull().cast("int"))).first()
    if docs.schema["doc_id"].dataType.typeName() == "long" and (ids[0] or 1) == 1 and not ids[1]:
        return docs.select("doc_id", "text", F.col("doc_id").alias("uid"))
    ordered = docs.select("doc_id", "text").orderBy(F.col("doc_id").asc_nulls_last(), "text")
    return cut(ordered.withColumn("uid", F.monotonically_increasing_id()), "numbered")


def ranges(given: DataFrame, texts: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(uid, spans): per text the ranges of window starts that also stand earlier. ``given``
    (uid, text) goes into the index batch by batch in order of uid."""
    spark = given.sparkSession
    shares = F.array(*[F.lit(i / batches) for i in range(1, batches)]) if batches > 1 else F.lit(None)
    cuts = (given.agg(F.percentile_approx("uid", shares, 100)).first()[0] if batches > 1 else None) or []
    bounds = [None, *sorted({int(c) for c in cuts}), None]
    index = SuffixIndex(spark)
    for lo, hi in zip(bounds, bounds[1:]):
        batch = given if lo is None else given.where(F.col("uid") > lo)
        index.insert(batch if hi is None else batch.where(F.col("uid") <= hi))
    partial = index.partial()
    index.close()
    release(spark)
    first = F.shiftright("loc", 14)
    hits = [h.select("uid", first.alias("start"), (first + F.col("loc").bitwiseAND(F.lit(127).cast("long"))).alias("stop")) for h in index.hits]
    every = reduce(DataFrame.union, hits + partial_hits(texts, partial))
    # A text's ranges are bounded by the text.
    return cut(every.groupBy("uid").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "ranges")


def merged(ranges: np.ndarray) -> np.ndarray:
    """Removed byte runs [from, to) of window ranges [start, stop]."""
    if not len(ranges):
        return ranges.reshape(0, 2)
    r = ranges[np.lexsort((ranges[:, 1], ranges[:, 0]))]
    reach = np.maximum.accumulate(r[:, 1] + WIDTH)
    new = np.flatnonzero(r[1:, 0] > reach[:-1])
    return np.column_stack((r[np.append(0, new + 1), 0], reach[np.append(new, len(r) - 1)]))


def without_repeats(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Each text without the bytes of any 100-byte string that also starts earlier (in a smaller
    doc_id, or earlier in the same text): (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept).

    Null text is empty. Rows with equal doc_id count as documents in order of their text; null
    doc_ids come last. Texts under 100 bytes keep everything."""
    shared_dir(docs.sparkSession)
    given = numbered(docs)
    texts = packed(given)
    found = ranges(given, texts, batches)
    release(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            unpack = zstandard.ZstdDecompressor().decompress
            for z, s in zip(batch.column("z"), batch.column("spans")):
                body = unpack(z.as_py())
                runs = merged(np.array([(x["start"], x["stop"]) for x in s.as_py() or ()], np.int64).reshape(-1, 2))
                edges = [0, *runs.ravel().tolist(), len(body)]
                kept = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2]))
                rows.append((len(body), len(body) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = texts.join(found, "uid", "left").select("doc_id", "z", "spans")
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
