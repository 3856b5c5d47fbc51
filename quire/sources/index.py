"""An index that is appended to exactly once per id. Rows lie in buckets by the hash of their id,
and each bucket has a Bloom filter, so a batch reads only the buckets that may hold its ids.

The filter is kept as rows (bucket, word, bits) that are only ever added: the filter of a bucket is
the bitwise or of its rows. It is written before the data, so after a crash between the two it holds
more than the data, which costs a read and never a row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import cut


@dataclass(frozen=True)
class BucketedIndex:
    """``path``/data and ``path``/filter. ``buckets`` and ``words`` (of 64 bits a bucket) are fixed
    for the life of an index: about ten bits an id keep needless reads near one in a hundred."""

    path: str
    id: str
    buckets: int = 64
    words: int = 1 << 14
    hashes: int = 5

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.lit(0), self.id), F.lit(self.buckets)).cast("int")

    def probes(self, df: DataFrame) -> DataFrame:
        """(bucket, id, word, bits): the places of each id in the filter of its bucket."""
        places = F.array(*[F.pmod(F.xxhash64(F.lit(k + 1), self.id), F.lit(self.words * 64)) for k in range(self.hashes)])
        rows = df.select(self.bucket().alias("bucket"), self.id, F.explode(F.array_distinct(places)).alias("p"))
        return rows.select("bucket", self.id, F.floor(F.col("p") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("bits"))

    def _read(self, spark: SparkSession, part: str) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{self.path}/{part}")
        except Exception as e:  # the first batch finds nothing yet
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def maybe_known(self, rows: DataFrame) -> DataFrame | None:
        """The ids of ``rows`` that the filters cannot rule out; None before the first batch."""
        stored = self._read(rows.sparkSession, "filter")
        if stored is None:
            return None
        probes = self.probes(rows)
        words = stored.join(probes.select("bucket", "word").distinct(), ["bucket", "word"], "left_semi").groupBy("bucket", "word").agg(F.bit_or("bits").alias("held"))
        seen = probes.join(words, ["bucket", "word"], "left").withColumn("_hit", F.coalesce(F.col("held").bitwiseAND(F.col("bits")) != 0, F.lit(False)))
        return seen.groupBy("bucket", self.id).agg(F.bool_and("_hit").alias("_all")).where("_all").select("bucket", self.id)

    def fresh(self, rows: DataFrame) -> DataFrame:
        """One row per id that the index does not hold; rows without an id are left out."""
        rows = rows.where(F.col(self.id).isNotNull()).dropDuplicates([self.id])
        maybe = self.maybe_known(rows)
        stored = self._read(rows.sparkSession, "data")
        if maybe is None or stored is None:
            return rows
        maybe = cut(maybe)
        touched = [r["bucket"] for r in maybe.select("bucket").distinct().collect()]  # at most all buckets
        if not touched:
            return rows
        known = stored.where(F.col("bucket").isin(touched)).select(self.id).join(maybe.select(self.id), self.id, "left_semi")
        return rows.join(known, self.id, "left_anti")

    def append(self, rows: DataFrame) -> DataFrame:
        """Append the rows whose id is new and return them. A batch that is replayed adds none."""
        added = cut(self.fresh(rows))
        if added.limit(1).count():
            filters = self.probes(added).groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))
            filters.write.mode("append").parquet(f"{self.path}/filter")
            dealt = added.withColumn("bucket", self.bucket()).repartition("bucket")
            dealt.write.mode("append").partitionBy("bucket").parquet(f"{self.path}/data")
        return added

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/data").drop("bucket")

    def sink(self):
        """A ``foreachBatch`` function."""
        return lambda batch, _: self.append(batch)
