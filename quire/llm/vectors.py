"""Embedding near-duplicates: tiles in the order of principal components, compared with the
leading dimensions first and left as soon as the rest cannot reach the threshold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import components, cut, release, setting

SAMPLE = 4096  # vectors the axes are fitted on; the axes decide the speed, never the result
BAND_BYTES = 2 << 20  # of the vectors that one row of the band table packs
TILE = 1024
STEP = 16  # dimensions added at a time
SLACK = 1e-9  # of the bounds; pairs this near to the threshold are decided on the given vectors


def usable(column: str = "embedding"):
    """Vectors that can link: not null, not zero, without null or non-finite components."""
    v = F.col(column)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~odd & F.exists(v, lambda x: x != 0)


def unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def axes(points: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes per vector length, by falling variance, from a sample by hash."""
    picked = points.select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(SAMPLE).toPandas()["v"]
    out = {}
    for n in sorted({len(v) for v in picked}):
        m = unit(np.array([v for v in picked if len(v) == n], float))
        out[n] = np.linalg.eigh(m.T @ m)[1][:, ::-1]
    return out


def linked_pairs(a, b, ra, rb, threshold):
    """Positions (i, j) of unit vectors with cosine >= threshold; ra, rb are a, b on the axes."""
    dims = a.shape[1]
    rest = lambda r, k: np.sqrt(np.maximum(0.0, (r[:, k:] ** 2).sum(axis=1)))
    k = min(STEP, dims)
    dot = ra[:, :k] @ rb[:, :k].T
    alive = dot + rest(ra, k)[:, None] * rest(rb, k)[None, :] >= threshold - SLACK
    while k < dims and np.count_nonzero(alive) > alive.size // 32:  # dense: go on with the tile
        n = min(k + STEP, dims)
        dot += ra[:, k:n] @ rb[:, k:n].T
        k = n
        alive = dot + rest(ra, k)[:, None] * rest(rb, k)[None, :] >= threshold - SLACK
    i, j = np.nonzero(alive)
    dot = dot[i, j]
    while k < dims and len(i):  # few: go on with the pairs
        n = min(k + STEP, dims)
        dot = dot + np.einsum("ij,ij->i", ra[i, k:n], rb[j, k:n])
        k = n
        ok = dot + rest(ra, k)[i] * rest(rb, k)[j] >= threshold - SLACK
        i, j, dot = i[ok], j[ok], dot[ok]
    close = np.flatnonzero(np.abs(dot - threshold) <= 2 * SLACK)
    dot[close] = np.einsum("ij,ij->i", a[i[close]], b[j[close]])
    ok = dot >= threshold
    return i[ok], j[ok]


def compared(ids, weights, vectors, other, turn, threshold):
    """Links of two bands (or of one with itself, ``other`` None): per tile the least neighbour
    of each vector, and at the end the weight of its links: arrays (id, links, root)."""
    same = other is None
    idb, wb, vb = (ids, weights, vectors) if same else other
    a, b = unit(vectors), unit(vb)
    ra, rb = a @ turn, b @ turn
    na, nb = np.zeros(len(ids), np.int64), np.zeros(len(idb), np.int64)
    for x in range(0, len(ids), TILE):
        for y in range(x if same else 0, len(idb), TILE):
            i, j = linked_pairs(a[x : x + TILE], b[y : y + TILE], ra[x : x + TILE], rb[y : y + TILE], threshold)
            i, j = i + x, j + y
            if same and x == y:
                i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            np.add.at(na, i, wb[j])
            np.add.at(na if same else nb, j, weights[i])
            names, place = np.unique(np.concatenate([ids[i], idb[j]]), return_inverse=True)
            p, q = place[: len(i)], place[len(i) :]
            low = np.arange(len(names))
            while True:
                was = low.copy()
                least = np.minimum(low[p], low[q])
                np.minimum.at(low, p, least)
                np.minimum.at(low, q, least)
                if (low == was).all():
                    break
            yield names, np.zeros(len(names), np.int64), names[low]
    for n, own in ((na, ids),) if same else ((na, ids), (nb, idb)):
        yield own[n > 0], n[n > 0], own[n > 0]


def near_vectors(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of (vec_id, embedding, label): rows of one
    label whose cosine reaches ``threshold`` link.

    Equal vectors of a label are one point with a weight. Vectors that are null, zero or hold
    null or non-finite components, and rows without label, link with nothing; vectors of
    different length do not link. component_id is the smallest vec_id reachable; null ids are
    passed over. Repeated rows link with each other."""
    spark = vectors.sparkSession
    ok = usable() & F.col("label").isNotNull()
    v = F.transform("embedding", lambda x: x.cast("double")).alias("v")
    given = vectors.select("vec_id", "label", "embedding").where(ok).select("vec_id", "label", v)
    grouped = given.groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    points = cut(grouped.withColumn("pid", F.monotonically_increasing_id()), "points")
    turns = axes(points)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = vectors.schema["label"].dataType.simpleString()

    def lead(batches):
        """The first principal coordinate of each vector (the longest length not sampled: 0)."""
        for batch in batches:
            rows = [np.asarray(x.values) for x in batch.column("v")]
            first = [float(unit(r[None])[0] @ turns[len(r)][:, 0]) if len(r) in turns else 0.0 for r in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first, pa.float64()), pa.array([len(r) for r in rows], pa.int32())], [*batch.schema.names, "first", "dims"])

    placed = points.select("pid", "weight", "label", "v").mapInArrow(lead, f"pid long, weight long, label {kind}, v array<double>, first double, dims int")
    # Order along the first axis: bands of one label and length, split where they are too large.
    ranged = placed.repartitionByRange(buckets, "label", "dims", "first").sortWithinPartitions("label", "dims", "first")

    def pack(batches):
        held, key, part = [], None, 0

        def row():
            ids, weights, rows, first = zip(*held)
            return pa.RecordBatch.from_arrays(
                [pa.array([int(ids[0])]), pa.array([key[0]], label_type), pa.array([key[1]], pa.int32()), pa.array([min(first)]), pa.array([max(first)]),
                 pa.array([np.array(ids, np.int64).tobytes()]), pa.array([np.array(weights, np.int64).tobytes()]), pa.array([np.array(rows, float).tobytes()])],
                ["band", "label", "dims", "low", "high", "ids", "weights", "vectors"],
            )

        for batch in batches:
            label_type = batch.column("label").type
            for pid, weight, label, v, first, dims in zip(*(batch.column(c).to_pylist() for c in ("pid", "weight", "label", "v", "first", "dims"))):
                if held and (key != (label, dims) or len(held) * dims * 8 >= BAND_BYTES):
                    yield row()
                    held = []
                key = (label, dims)
                held.append((pid, weight, v, first))
        if held:
            yield row()

    bands = cut(ranged.mapInArrow(pack, f"band long, label {kind}, dims int, low double, high double, ids binary, weights binary, vectors binary"), "bands")
    # |u - v| bounds the gap on any axis, and |u - v|^2 = 2 - 2 cos.
    gap = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
    a = bands.select(F.col("band").alias("a"), "label", "dims", F.col("low").alias("alow"), F.col("high").alias("ahigh"))
    b = bands.select(F.col("band").alias("b"), "label", "dims", "low", "high")
    near = (F.col("a") <= F.col("b")) & (F.col("low") <= F.col("ahigh") + gap) & (F.col("alow") <= F.col("high") + gap)
    pairs = a.join(b, ["label", "dims"]).where(near | ((F.col("a") == F.col("b")))).select("a", "b", "dims")
    data = bands.select("band", "ids", "weights", "vectors")
    work = pairs.join(data.select(F.col("band").alias("a"), F.struct("ids", "weights", "vectors").alias("left")), "a").join(
        data.select(F.col("band").alias("b"), F.struct("ids", "weights", "vectors").alias("right")), "b"
    ).repartition(4 * buckets, "a", "b")

    def compare(batches):
        for batch in batches:
            for x, y, dims, left, right in zip(*(batch.column(c) for c in ("a", "b", "dims", "left", "right"))):
                n = dims.as_py()
                read = lambda s: (np.frombuffer(s["ids"].as_py(), np.int64), np.frombuffer(s["weights"].as_py(), np.int64), np.frombuffer(s["vectors"].as_py(), float).reshape(-1, n))  # noqa: B023,E731
                turn = turns.get(n, np.eye(n))
                for ids, links, root in compared(*read(left), None if x.as_py() == y.as_py() else read(right), turn, threshold):
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(root)], ["pid", "links", "root"])

    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "2"):
        found = cut(work.mapInArrow(compare, "pid long, links long, root long"), "links")
    release(spark)
    counts = found.groupBy("pid").agg(F.sum("links").alias("links"))
    roots = components(found.where("pid <> root").select(F.col("pid").alias("a"), F.col("root").alias("b")))
    named = points.join(counts, "pid", "left").join(roots, F.col("pid") == F.col("node"), "left")
    named = cut(named.select("label", "v", "least", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("root", "pid").alias("root"), F.col("root").isNotNull().alias("joined")), "named")
    least = named.where("joined").groupBy("root").agg(F.min("least").alias("low"))
    ids = named.join(least, "root", "left").select("label", "v", "n", F.coalesce("low", "least").alias("component"))
    rows = given.join(ids, ["label", "v"]).select("vec_id", F.col("n").cast("long").alias("n_links"), F.col("component").alias("component_id"))
    alone = vectors.where(F.coalesce(~ok, F.lit(True))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return rows.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
