"""Ordered work per key that does not put a whole key into one task.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task. Here rows are dealt
by ranges of (key, order), so that a key spreads by its number of rows, and a range is a slice.
Rows are grouped by (key, slice); what passes between slices is small. Two forms cover the needs:

* ``running``: a prefix aggregate is the aggregate of the earlier slices plus the
  prefix inside the slice;
* ``halo``: a frame of n rows before or after needs only the n border rows of the
  neighbouring slices, which are copied in and marked as ghosts.

Only a key that a range cuts has work between its slices: at most two keys a slice, known when
the rows are placed. A caller that has slices of its own may name them by an expression that
never decreases along the order. Both forms are exact for any slicing; slices only decide the
balance.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import cut

SLICE = "_slice"
GHOST = "_ghost"
MINUTE = 60_000_000


def time_slice(ts: str, micros: int = MINUTE) -> str:
    """SQL expression for the slice number of a timestamp column."""
    return f"floor(unix_micros({ts}) / {micros})"


def id_slice(column: str, width: int = 4096) -> str:
    """SQL expression for the slice number of a whole-number position."""
    return f"floor({column} / {width})"


def _agg(kind: str, value: Column, order: Column, reverse: bool) -> Column:
    if kind == "sum":
        return F.sum(value)
    if kind == "count":
        return F.count(value)
    if kind == "max":
        return F.max(value)
    if kind == "min":
        return F.min(value)
    if kind == "last":
        pick = F.min_by if reverse else F.max_by
        return pick(value, F.when(value.isNotNull(), order))
    raise ValueError(f"unknown running aggregate {kind!r}")


def _over(kind: str, value: Column) -> Column:
    if kind in ("sum", "count"):
        return F.sum(value)
    if kind == "max":
        return F.max(value)
    if kind == "min":
        return F.min(value)
    return F.last(value, ignorenulls=True)


def _merge(kind: str, carried: Column, own: Column) -> Column:
    if kind == "sum":
        return F.when(carried.isNull() & own.isNull(), None).otherwise(
            F.coalesce(carried, F.lit(0)) + F.coalesce(own, F.lit(0))
        )
    if kind == "count":
        return F.coalesce(carried, F.lit(0)) + F.coalesce(own, F.lit(0))
    if kind == "max":
        return F.greatest(carried, own)
    if kind == "min":
        return F.least(carried, own)
    return F.coalesce(own, carried)


@dataclass(frozen=True)
class Timeline:
    """Keys, a total order inside the key, and the slice expression if there is one. Without it
    rows are placed by ranges: one shuffle, whose result is written, as the ranges of a second
    run may differ."""

    keys: Sequence[str]
    order: Sequence[str]
    slice: str | None = None

    def placed(self, df: DataFrame) -> DataFrame:
        """Rows with their slice; rows that have one keep it, so steps can follow each other.
        Slices of keys that go on in another slice are odd."""
        if SLICE in df.columns:
            return df
        if self.slice is not None:
            return df.withColumn(SLICE, F.expr(self.slice))
        by = [F.col(c).asc() for c in (*self.keys, *self.order)]
        if not by:
            raise ValueError("a timeline needs a key or an order")
        dealt = cut(df.repartitionByRange(*by).withColumn(SLICE, F.spark_partition_id().cast("long") * 2))
        shared = self._shared(dealt)
        if shared is None:
            return dealt.withColumn(SLICE, F.col(SLICE).alias(SLICE, metadata={"whole": True}))
        if not self.keys:
            return dealt.withColumn(SLICE, F.col(SLICE) + 1)
        known = F.broadcast(shared.select(*[F.col(k).alias(f"_s_{k}") for k in self.keys], F.lit(1).alias("_odd")))
        match = F.lit(True)
        for k in self.keys:
            match = match & F.col(k).eqNullSafe(F.col(f"_s_{k}"))
        odd = F.col(SLICE) + F.coalesce(F.col("_odd"), F.lit(0))
        return dealt.join(known, match, "left").withColumn(SLICE, odd).select(*dealt.columns)

    def _shared(self, dealt: DataFrame) -> DataFrame | None:
        """The keys that lie in more than one slice, fewer than there are slices; None if none.
        They are the last key of a slice and the first of a later one."""
        spark = dealt.sparkSession
        if not self.keys:
            return spark.range(1) if dealt.select(SLICE).distinct().limit(2).count() > 1 else None
        key = F.struct(*self.keys)
        ends = dealt.groupBy(SLICE).agg(F.min(key).alias("a"), F.max(key).alias("z"))
        both = ends.select(SLICE, F.explode(F.array("a", "z")).alias("k")).distinct()
        rows = both.groupBy("k").count().where("count > 1").select("k.*").collect()
        return spark.createDataFrame(rows, dealt.select(*self.keys).schema) if rows else None

    def between(self, rows: DataFrame) -> DataFrame | None:
        """The rows whose keys have work between slices. The filter is on the keys of every
        window here, so Spark applies it where the placed rows are read."""
        if self.slice is not None:
            return rows
        if rows.schema[SLICE].metadata.get("whole"):
            return None
        return rows.where(F.col(SLICE) % 2 == 1)

    def window(self, reverse: bool = False):
        order = [F.col(c).desc() if reverse else F.col(c).asc() for c in self.order]
        return Window.partitionBy(*self.keys, SLICE).orderBy(*order)

    def running(
        self, df: DataFrame, *, reverse: bool = False, strict: bool = False, **specs: tuple[str, Column]
    ) -> DataFrame:
        """Add prefix aggregates; ``name=(kind, column)`` with kind sum, count, max, min or
        last (latest value that is not null). ``reverse`` runs from the end, ``strict``
        leaves out the row itself."""
        rows = self.placed(df)
        frame = self.window(reverse).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
        own = {n: (F.count(value) if kind == "count" else _over(kind, value)).over(frame) for n, (kind, value) in specs.items()}
        between = self.between(rows)
        if between is None:
            none = {n: F.coalesce(own[n], F.lit(0)) if kind == "count" else own[n] for n, (kind, _) in specs.items()}
            return rows.withColumns(none).select(*df.columns, *specs)
        order = F.struct(*self.order)
        parts = between.groupBy(*self.keys, SLICE).agg(
            *[_agg(kind, value, order, reverse).alias(f"_p_{n}") for n, (kind, value) in specs.items()]
        )
        along = F.col(SLICE).desc() if reverse else F.col(SLICE).asc()
        earlier = (
            Window.partitionBy(*self.keys).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
        )
        carry = parts.select(
            *[F.col(k).alias(f"_c_{k}") for k in self.keys],
            F.col(SLICE).alias("_c_slice"),
            *[_over(kind, F.col(f"_p_{n}")).over(earlier).alias(f"_c_{n}") for n, (kind, _) in specs.items()],
        )
        match = F.col(SLICE).eqNullSafe(F.col("_c_slice"))
        for k in self.keys:
            match = match & F.col(k).eqNullSafe(F.col(f"_c_{k}"))
        # By ranges there are at most two rows a slice.
        joined = rows.join(carry if self.slice is not None else F.broadcast(carry), match, "left")
        added = {n: _merge(kind, F.col(f"_c_{n}"), own[n]) for n, (kind, _) in specs.items()}
        return joined.withColumns(added).select(*df.columns, *specs)

    def numbered(self, df: DataFrame, name: str = "rn", *, reverse: bool = False) -> DataFrame:
        """Exact row number along the order."""
        return self.running(df, reverse=reverse, **{name: ("count", F.lit(1))})

    def previous(self, df: DataFrame, columns: Sequence[str], name: str = "prev_{}") -> DataFrame:
        """Add the columns of the row before (null at the start)."""
        rows = self.running(df, strict=True, _before=("last", F.struct(*columns)))
        return rows.withColumns({name.format(c): F.col(f"_before.{c}") for c in columns}).drop("_before")

    def halo(self, df: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
        """Rows with their slice, plus border rows of the neighbours marked in ``_ghost``.
        Evaluate frames of at most ``before``/``after`` rows over ``window()``, then keep
        ``~_ghost``."""
        rows = self.placed(df)
        out = rows.withColumn(GHOST, F.lit(False))
        between = self.between(rows)
        if between is None:
            return out
        columns = [c for c in df.columns if c != SLICE]
        if after:
            out = out.unionByName(self._border(between, columns, after, ahead=True))
        if before:
            out = out.unionByName(self._border(between, columns, before, ahead=False))
        return out

    def _border(self, rows: DataFrame, columns: Sequence[str], n: int, ahead: bool) -> DataFrame:
        edge = rows.withColumn("_n", F.row_number().over(self.window(reverse=not ahead))).where(F.col("_n") <= n)
        along = Window.partitionBy(*self.keys).orderBy(*self.order)
        frame = along.rowsBetween(1, n) if ahead else along.rowsBetween(-n, -1)
        step = F.lead(SLICE) if ahead else F.lag(SLICE)
        return (
            edge.withColumn("_near", F.collect_list(F.struct(*columns)).over(frame))
            .withColumn("_other", step.over(along))
            .where(F.col("_other").isNotNull() & (F.col("_other") != F.col(SLICE)))
            .select(F.inline("_near"), F.col(SLICE))
            .withColumn(GHOST, F.lit(True))
        )

    def islands(self, df: DataFrame, value: Column, name: str = "island") -> DataFrame:
        """Number the runs of equal consecutive ``value`` (null equals null), from 1."""
        rows = self.placed(df.withColumn("_value", value))
        rows = self.running(rows, strict=True, _before=("last", F.struct("_value")))
        start = F.when(F.col("_before").isNotNull() & F.col("_before._value").eqNullSafe(F.col("_value")), 0).otherwise(1)
        marked = rows.withColumn("_start", start).drop("_value", "_before")
        return self.running(marked, **{name: ("sum", F.col("_start"))}).select(*df.columns, name)


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | None, name: str = "rank") -> DataFrame:
    """First ``k`` rows of every key, all for None. Spark plans a group limit before the shuffle,
    so a hot key sends at most ``k`` rows from each map task; without a limit a key is one task's
    work, which is for keys that are small by nature."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(name, F.row_number().over(w))
    return ranked if k is None else ranked.where(F.col(name) <= k)


def best_row(df: DataFrame, keys: Sequence[str], order: Column, largest: bool = True) -> DataFrame:
    """One whole row per key as a partial aggregate, never a sort of the key."""
    pick = F.max_by if largest else F.min_by
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def each(df: DataFrame, array: Column, name: str, keep: Sequence[str | Column] = ()) -> DataFrame:
    """One row per element. The outer form with a null filter stops Spark from pushing a
    ``size(array) > 0`` filter below, which would compute the array twice."""
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())
