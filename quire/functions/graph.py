"""Links between the rows of a key: exact comparison in bounded blocks, and components."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut

BLOCK_ROWS = 2048
# Keys of many rows that are sent to every task, once counted.
SENT_KEYS = 200_000
Compare = Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]


def links(df: DataFrame, keys: Sequence[str], id: str, columns: Sequence[str], compare: Compare, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs (a, b) of structs (id, columns named ``carry``) inside each key for which
    ``compare(left, right)`` (a boolean matrix) holds, each pair once with a.id < b.id.

    The rows of a key are dealt into blocks of about ``block_rows``, so that a task holds two
    blocks however many rows the key has. Only pairs that hold leave a task."""
    size = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(block_rows))).cast("int").alias("_blocks"))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    dealt = df.join(size, same).select(*df.columns, "_blocks")
    dealt = dealt.withColumn("_own", F.pmod(F.xxhash64(id), F.col("_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_with")
    rows = dealt.select(*df.columns, "_own", other).withColumns({"_p": F.least("_own", "_with"), "_q": F.greatest("_own", "_with")})
    kind = df.schema[id].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        p, q = frame["_p"].iloc[0], frame["_q"].iloc[0]
        left, right = frame[frame["_own"] == p], frame[frame["_own"] == q]
        out = []
        for lo in range(0, len(left), 512):
            part = left.iloc[lo : lo + 512]
            i, j = np.nonzero(compare(part, right))
            a, b = part[id].to_numpy()[i], right[id].to_numpy()[j]
            if p == q:
                a, b = a[a < b], b[a < b]
            else:
                a, b = np.where(a < b, a, b), np.where(a < b, b, a)
            out.append(pd.DataFrame({"a": a, "b": b}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": []})

    need = rows.select(*keys, "_own", "_p", "_q", id, *[c for c in columns if c != id])
    return need.groupBy(*keys, "_p", "_q").applyInPandas(run, f"a {kind}, b {kind}")


def by_size(df: DataFrame, keys: Sequence[str], most: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of keys with at most ``most`` rows, and those of the others; None if there are none."""
    large = cut(df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).drop("_n"))
    n = large.count()
    if n == 0:
        return df, None
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    large = F.broadcast(large) if n <= SENT_KEYS else large
    return df.join(large, same, "left_anti"), df.join(large, same, "left_semi")


def each_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], run: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """``run(rows, starts)`` on tables of whole keys, each key one run of rows in order from its
    start to the next. Keys share a table, so a small key costs what its rows cost; a task holds
    one batch and one key, so keys must be small (``by_size``)."""

    def starts_of(table: pa.Table) -> np.ndarray:
        new = np.zeros(len(table), dtype=bool)
        new[:1] = True
        for k in keys:
            code = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= code[1:] != code[:-1]
        return np.flatnonzero(new)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            table = pa.concat_tables([*held, pa.Table.from_batches([batch])]).combine_chunks()
            starts = starts_of(table)
            held = [table.slice(starts[-1])] if len(starts) else []
            if len(starts) > 1:
                yield from run(table.slice(0, starts[-1]), starts[:-1]).to_batches()
        if held:
            yield from run(held[0].combine_chunks(), np.array([0])).to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(stream, schema)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable over ``edges`` (a, b). Labels fall along the
    edges and are followed to their own label until none changes; each round is written."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    for _ in range(rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("m"))
        low = labels.join(near, labels["node"] == near["a"]).select("node", F.least("root", "m").alias("root"), F.col("root").alias("was"))
        # Follow the label's own label: distances halve each round.
        up = labels.select(F.col("node").alias("via"), F.col("root").alias("far"))
        new = cut(low.join(up, low["root"] == up["via"]).select("node", F.least("root", "far").alias("root"), "was"))
        moved = new.where("root <> was").limit(1).count()
        labels = new.select("node", "root")
        if not moved:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def least_below(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, low): the smallest node reachable from each along ``links`` (hi, lo), hi > lo.
    Labels fall along the links and are followed to their own label, so paths halve each round."""
    down = cut(links.select("hi", "lo").where("hi > lo").distinct())
    ends = down.select(F.explode(F.array("hi", "lo")).alias("node")).distinct()
    low = cut(ends.join(down.groupBy("hi").agg(F.min("lo").alias("low")), ends["node"] == F.col("hi"), "left").select("node", F.coalesce("low", "node").alias("low")))
    for _ in range(rounds):
        below = down.join(low, down["lo"] == low["node"]).groupBy("hi").agg(F.min("low").alias("m"))
        near = low.join(below, low["node"] == below["hi"], "left").select("node", F.least("low", F.coalesce("m", "low")).alias("low"), F.col("low").alias("was"))
        via = low.select(F.col("node").alias("via"), F.col("low").alias("far"))
        new = cut(near.join(via, near["low"] == via["via"]).select("node", F.least("low", "far").alias("low"), "was"))
        moved = new.where("low <> was").limit(1).count()
        low = new.select("node", "low")
        if not moved:
            return low
    raise RuntimeError(f"labels did not settle in {rounds} rounds")
