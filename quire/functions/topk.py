"""Best matches of queries over a corpus of any size.

Sparse scores are joins and sums. For dense scores a bounded batch of query vectors travels to
the data: every task scores its own rows against all queries of the batch with numpy and keeps
the best k of each, so pairs of query and document are never shuffled. A batch beyond the bound
is split by query and the corpus is read once per part."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from quire.functions.scan import top_rows
from quire.session import cut

MAX_QUERIES = 2_000
DIGITS = 6


def _batches(queries: DataFrame, limit: int, key: str = "query_id") -> Iterator[pd.DataFrame]:
    """The query table, computed once, as local batches: one if it fits the limit, else parts by
    key that stay near it."""
    queries = cut(queries)
    n = -(-queries.count() // limit)
    if n <= 1:
        yield queries.toPandas()
        return
    slot = F.pmod(F.xxhash64(key), F.lit(n))
    for i in range(n):
        yield queries.where(slot == i).toPandas()


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the k best by score, ties to the smaller id."""
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


class _Keeper:
    """The best k of each query seen so far in one task."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.rows: list[tuple[np.ndarray, np.ndarray] | None] = [None] * n

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        held = self.rows[q]
        if held is not None:
            scores, ids = np.concatenate([held[0], scores]), np.concatenate([held[1], ids])
        self.rows[q] = _best(scores, ids, self.k)

    def frame(self, names: np.ndarray) -> pd.DataFrame:
        out = [(names[q], s, i) for q, r in enumerate(self.rows) if r is not None for s, i in zip(*r, strict=True)]
        return pd.DataFrame(out, columns=["query_id", "score", "id"])


def _schema(queries: DataFrame, ids: DataFrame, id: str) -> StructType:
    return StructType(
        [
            StructField("query_id", queries.schema["query_id"].dataType),
            StructField("score", DoubleType()),
            StructField("id", ids.schema[id].dataType),
        ]
    )


def sparse_topk(weighted: DataFrame, id: str, terms: DataFrame, k: int, cap: int | None = None) -> DataFrame:
    """``weighted``: (id, term, weight) postings; ``terms``: (query_id, term, weight). The score is
    the sum of weight products over shared terms; only scores above zero count. With ``cap``
    the sum is divided by max(terms of the query, min(``size`` of the document, cap)). Returns
    (query_id, id, score, rank).

    Postings meet the query terms by an equi join, the sums of a document are combined before
    their shuffle, and each task then keeps k rows per query. Nothing runs before the result is
    asked for, and no side is collected."""
    own = terms.select("query_id", "term", F.col("weight").alias("_factor"))
    size = F.col("size") if cap is not None else F.lit(1)
    docs = weighted.select(F.col(id).alias("id"), "term", F.col("weight").cast("double").alias("_weight"), size.cast("bigint").alias("_size"))
    pairs = docs.join(own, "term").groupBy("query_id", "id").agg(F.sum(F.col("_weight") * F.col("_factor")).alias("_total"), F.max("_size").alias("_size"))
    total = F.col("_total")
    if cap is not None:
        sizes = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("_terms"))
        pairs = pairs.join(sizes, "query_id")
        total = total / F.greatest(F.col("_terms"), F.least(F.col("_size"), F.lit(cap)))
    scored = pairs.select("query_id", "id", F.round(total, DIGITS).alias("score")).where(F.col("score") > 0)
    return top_rows(scored, ["query_id"], [F.desc("score"), F.col("id")], k).select("query_id", "score", "id", "rank")


def dense_topk(vectors: DataFrame, id: str, vector: str, queries: DataFrame, k: int) -> DataFrame:
    """``queries``: (query_id, vector). The score is one minus the squared distance. Returns
    (query_id, id, score, rank)."""
    parts = [_dense_part(vectors, id, vector, queries, b, k) for b in _batches(queries, MAX_QUERIES)]
    best = reduce(DataFrame.unionByName, parts)
    return top_rows(best, ["query_id"], [F.desc("score"), F.col("id")], k)


def _dense_part(vectors: DataFrame, id: str, vector: str, queries: DataFrame, batch: pd.DataFrame, k: int) -> DataFrame:
    names = batch["query_id"].to_numpy()
    m = np.vstack(batch["vector"].to_numpy()).astype("float64") if len(batch) else np.zeros((0, 1))
    square = (m * m).sum(axis=1)[:, None]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep = _Keeper(len(names), k)
        for frame in batches if len(names) else ():
            v = np.vstack(frame["vector"].to_numpy()).astype("float64")
            score = np.round(1.0 - (square + (v * v).sum(axis=1)[None, :] - 2.0 * (m @ v.T)), DIGITS)
            ids = frame["id"].to_numpy()
            for q in range(len(names)):
                keep.add(q, score[q], ids)
        out = keep.frame(names)
        if len(out):
            yield out

    rows = vectors.select(F.col(id).alias("id"), F.col(vector).alias("vector"))
    return rows.mapInPandas(run, _schema(queries, vectors, id))


def nearest_prototype(vectors: DataFrame, vector: str, prototypes: DataFrame, threshold: float, k: int = 1, default: str = "general") -> DataFrame:
    """Names of the up to k prototypes most similar to each vector with similarity above the
    threshold, best first and by name where they tie; ``default`` if none. Prototypes go to the
    tasks in parts of about ``MAX_QUERIES``; each part keeps k, and the parts are merged."""
    kind = ArrayType(StructType([StructField("low", DoubleType()), StructField("name", StringType())]))

    def part(batch: pd.DataFrame):
        batch = batch.sort_values("name")
        names = batch["name"].to_numpy()
        p = _unit(np.vstack(batch["vector"].to_numpy()))

        @F.pandas_udf(kind)
        def match(column: pd.Series) -> pd.Series:
            score = np.round(_unit(np.vstack(column.to_numpy())) @ p.T, DIGITS)
            top = np.argsort(-score, axis=1, kind="stable")[:, :k]
            best = np.take_along_axis(score, top, 1)
            return pd.Series([[{"low": -float(x), "name": names[i]} for x, i in zip(*r) if x > threshold] for r in zip(best, top)])

        return match(F.col(vector))

    found = [part(b) for b in _batches(prototypes, MAX_QUERIES, "name") if len(b)]
    none = F.array(F.struct(F.lit(default).alias("name"), F.lit(0.0).alias("similarity")))
    if not found:
        return vectors.withColumn("matches", none)
    names = [f"_part{i}" for i in range(len(found))]
    best = F.slice(F.array_sort(F.concat(*names)), 1, k)
    named = F.transform(best, lambda m: F.struct(m["name"].alias("name"), (-m["low"]).alias("similarity")))
    rows = vectors.withColumns(dict(zip(names, found)))
    return rows.withColumn("matches", F.when(F.size(named) > 0, named).otherwise(none)).drop(*names)


def _unit(m: np.ndarray) -> np.ndarray:
    m = m.astype("float64")
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; 0 for a zero norm or unequal length."""
    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)

    a, b = a.cast("array<double>"), b.cast("array<double>")
    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    norm = F.sqrt(total(F.transform(a, lambda x: x * x))) * F.sqrt(total(F.transform(b, lambda x: x * x)))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot / norm).otherwise(0.0)
