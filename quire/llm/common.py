"""Shared helpers: tables, lineage cuts in the shared folder, checked broadcasts, components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of a table that a task may hold as a broadcast map; above it a shuffled join is used.
BROADCAST_ROWS = 100_000

LOCAL: dict[str, str] = {}  # folders of local sessions that name none


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it. Only a local
    session without the setting gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or LOCAL.get(spark.sparkContext.applicationId)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no later step reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, kind: str = "cut") -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet into the shared folder; the frame that reads it, and its path.
    A lost executor rereads the table instead of replaying what led to it."""
    spark = df.sparkSession
    path = fresh_path(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, kind: str = "cut") -> DataFrame:
    return written(df, kind)[0]


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of steps whose result is written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for the plans made inside."""
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal the rows of a table in few files to all cores; larger tables stay as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a written table) with a broadcast hint if it is proven small. Without the hint
    the join is shuffled, and adaptive execution splits its hot keys."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components: ``edges`` (a, b) of one orderable type; (node, root), where root
    is the smallest node reachable. Nodes without an edge to another node do not appear.

    Alternates the small-star and the large-star step on distributed edge tables, each a
    minimum per node (combined before its shuffle) and one join, until nothing changes."""
    spark = edges.sparkSession
    step = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    now, path = written(step, "edges")
    mark = _mark(now)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        # Small star: every smaller neighbour of a node, and the node, link to the least of them.
        low = now.groupBy("a").agg(F.min("b").alias("m"))
        linked = now.join(low, "a")
        star = linked.select(F.explode(F.array(
            F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))
        )).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        mid, mid_path = written(star, "edges")
        # Large star: every larger neighbour links to the least node that its centre sees.
        both = mid.select("a", "b").union(mid.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("m"))
        big = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        nxt, nxt_path = written(big.where("a <> b").distinct(), "edges")
        new = _mark(nxt)
        discard(spark, path)
        discard(spark, mid_path)
        now, path, same, mark = nxt, nxt_path, new == mark, new
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    root = now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return root.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())


def held_out(doc_id: str = "doc_id"):
    """Rows that no model learns from: crc32 of the id's text is a multiple of five."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))
