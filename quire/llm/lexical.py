"""Ranked lexical search: the documents of an item are grouped by the mask of its terms that they
hold, and masks are scored from the highest bound down until no other can reach the best k."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import cut, discard, written

TOP = 10
BLOCK_TERMS = 1 << 18  # distinct terms of items held by a task; more items go in further blocks
PIECE = 1 << 20  # bytes of a text that are split into words at a time
STEP = 32  # masks scored at a time

# Terms are runs of ASCII letters and digits and of everything beyond ASCII; A-Z are lower-cased.
_KEEP = [c for c in range(256) if c >= 128 or chr(c).isalnum()]
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c in _KEEP else 32 for c in range(256))


def pieces(data: bytes):
    """The words of a text, piece by piece, so that a very long text is never split at once."""
    at = 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and WORDS[data[end]] != 32:
            end += 1
        yield data[at:end].translate(WORDS).split()
        at = end


def term_counts(data: bytes) -> Counter:
    out = Counter()
    for words in pieces(data):
        out.update(words)
    return out


def postings(docs: DataFrame, wanted: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) per document: its number of terms and its counts of the wanted
    ones, numbered in rising order. Whole texts, one pass."""

    def run(batches):
        for batch in batches:
            sizes, terms, tfs = [], [], []
            for body in batch.column("body"):
                n, found = 0, Counter()
                for words in pieces(body.as_py() or b""):
                    n += len(words)
                    found.update(map(wanted.get, words))
                found.pop(None, None)
                held = sorted(found)
                sizes.append(n)
                terms.append(held)
                tfs.append([found[t] for t in held])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))],
                ["doc_id", "n", "terms", "tfs"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    given = docs.select("doc_id", F.col("text").cast("binary").alias("body"))
    return given.mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, tfs array<long>")


class Chunk:
    """Postings of some documents by term: rows that hold a term, and what one occurrence of the
    term in an item is worth there before the term's weight."""

    def __init__(self, n, ends, terms, tfs, N: int, L: int):
        rows = np.repeat(np.arange(len(n)), ends)
        m = 25 + (75 * n * N) // L
        value = (1_000_000_000 * tfs) // (1000 * tfs + 8 * m[rows])
        order = np.argsort(terms, kind="stable")
        self.size, self.rows, self.value = len(n), rows[order], value[order]
        self.terms, first = np.unique(terms[order], return_index=True)
        self.first = np.append(first, len(terms))
        self.best = np.maximum.reduceat(self.value, first) if len(first) else np.zeros(0, np.int64)

    def find(self, term: int):
        at = np.searchsorted(self.terms, term)
        if at == len(self.terms) or self.terms[at] != term:
            return None
        return slice(self.first[at], self.first[at + 1]), int(self.best[at])


def masks(size: int, holders: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows with a bit, distinct masks as a bit matrix, mask of each row): one bitmap a term,
    64 terms a word, and equal rows of words form a group."""
    words = np.zeros((size, -(-len(holders) // 64)), np.uint64)
    for j, rows in enumerate(holders):
        words[rows, j // 64] |= np.uint64(1 << (j % 64))
    on = np.flatnonzero(words.any(axis=1))
    words = np.ascontiguousarray(words[on])
    keys = words[:, 0] if words.shape[1] == 1 else words.view(f"V{8 * words.shape[1]}")[:, 0]
    _, first, group = np.unique(keys, return_index=True, return_inverse=True)
    picked = words[first]
    bits = np.stack([(picked[:, j // 64] >> np.uint64(j % 64)) & np.uint64(1) for j in range(len(holders))], axis=1).astype(bool)
    return on, bits, group


def best_rows(chunk: Chunk, query: list[tuple[int, int]], k: int, ids) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows of a chunk for an item, (term, weight times its repeats) each: rows and
    scores. Equal scores go by ``ids``, so a mask whose bound equals the k-th score still counts."""
    found = [(chunk.find(t), w) for t, w in query if w > 0]
    found = [(at, best, w) for hit, w in found if hit is not None for at, best in [hit]]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    holders = [chunk.rows[at] for at, _, _ in found]
    on, bits, group = masks(chunk.size, holders)
    bound = bits @ np.array([w * best for _, best, w in found], np.int64)
    order = np.argsort(-bound, kind="stable")
    by_group = np.argsort(group, kind="stable")
    ends = np.append(0, np.cumsum(np.bincount(group, minlength=len(bits))))
    rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for lo in range(0, len(order), STEP):
        if len(scores) >= k and bound[order[lo]] < scores.min():
            break  # no mask that is left can reach the best k
        take = np.sort(np.concatenate([on[by_group[ends[g] : ends[g + 1]]] for g in order[lo : lo + STEP]]))
        score = np.zeros(len(take), np.int64)
        for (at, _, w), held in zip(found, holders):
            place = np.minimum(np.searchsorted(held, take), len(held) - 1)
            score += np.where(held[place] == take, chunk.value[at][place] * w, 0)
        rows, scores = np.append(rows, take), np.append(scores, score)
        if len(rows) > k:
            first = np.lexsort((ids[rows], -scores))[:k]
            rows, scores = rows[first], scores[first]
    some = scores > 0
    return rows[some], scores[some]


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, term, times) per distinct term of an item row; ``item`` numbers the rows."""

    def run(batches):
        for batch in batches:
            held = [term_counts(b.as_py() or b"") for b in batch.column("body")]
            at = [i for i, h in enumerate(held) for _ in h]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item").take(at), batch.column("item_id").take(at), pa.array([t for h in held for t in h], pa.binary()), pa.array([n for h in held for n in h.values()], pa.int64())],
                ["item", "item_id", "term", "times"],
            )

    kind = items.schema["item_id"].dataType.simpleString()
    given = items.select(F.monotonically_increasing_id().alias("item"), "item_id", F.col("text").cast("binary").alias("body"))
    return given.mapInArrow(run, f"item long, item_id {kind}, term binary, times long")


def weights(held: DataFrame) -> tuple[int, int, dict[int, int]]:
    """N, L and the weight of every wanted term in some document. One row a wanted term."""
    total = held.agg(F.count(F.when(F.col("n") > 0, 1)).alias("N"), F.sum("n").alias("L")).first()
    counts = held.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    N = total["N"]
    return N, total["L"] or 0, {r["term"]: math.floor(1000 * math.log((2 * N + 2) / (2 * r["count"] + 1))) for r in counts}


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every row of ``items``.

    Every row of ``docs`` counts as a document and every row of ``items`` as an item, repeated ids
    included. Null or empty texts have no term: such a document is never found and is not counted
    in N, such an item has no row. Equal scores go by ascending doc_id (a null id first), so the
    order is total but for equal rows. Very long texts are read piece by piece, whole. An empty
    table gives no row. Other columns, whatever their names, are not read.

    Items go in blocks of ``block_terms`` distinct terms; each block is held against all documents.
    Tasks keep k rows an item, and the last choice is a top-k by group limit."""
    spark = docs.sparkSession
    terms, path = written(item_terms(items), "items")
    sizes = terms.groupBy("item").agg(F.count("*").alias("n"))
    blocks = max(1, -(-(sizes.agg(F.sum("n")).first()[0] or 0) // block_terms))
    out = None
    for block in range(blocks):
        own = terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        found = _block(docs, own.collect(), k, items.schema["item_id"].dataType.simpleString())
        out = found if out is None else out.union(found)
    discard(spark, path)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _block(docs: DataFrame, rows: list, k: int, item_kind: str) -> DataFrame:
    """The best rows of each task for the items of one block, (item, item_id, doc_id, score)."""
    doc_kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = {t: i for i, t in enumerate(sorted({bytes(r["term"]) for r in rows}))}
    held = cut(postings(docs, wanted), "postings")
    N, L, weight = weights(held)
    queries: dict[int, tuple] = {}
    for r in rows:
        w = weight.get(wanted[bytes(r["term"])])
        if w is not None:
            queries.setdefault(r["item"], (r["item_id"], []))[1].append((wanted[bytes(r["term"])], w * r["times"]))

    def run(batches):
        for batch in batches:
            n = batch.column("n").to_numpy(zero_copy_only=False)
            terms, tfs = batch.column("terms"), batch.column("tfs")
            flat = terms.flatten().to_numpy(zero_copy_only=False)
            if not len(flat):
                continue
            chunk = Chunk(n, np.asarray(terms.value_lengths()), flat, tfs.flatten().to_numpy(zero_copy_only=False), N, L)
            ids = np.argsort(np.argsort(_order(batch.column("doc_id")), kind="stable"), kind="stable")
            items, names, at, scores = [], [], [], []
            for item, (name, query) in queries.items():
                got, score = best_rows(chunk, query, k, ids)
                items += [item] * len(got)
                names += [name] * len(got)
                at += got.tolist()
                scores += score.tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.int64()), pa.array(names, _arrow(item_kind)), batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(scores, pa.int64())],
                ["item", "item_id", "doc_id", "score"],
            )

    return held.mapInArrow(run, f"item long, item_id {item_kind}, doc_id {doc_kind}, score long")


def _order(ids: pa.Array) -> np.ndarray:
    """The rank of every id of a batch, nulls first."""
    place = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense")
    return place.to_numpy(zero_copy_only=False).astype(np.int64)


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
