"""Rules as DataFrames: every rule yields ``(code, path, severity)`` rows for what fails."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR, WARNING = "error", "warning"
# Rows of a part where a rule is told the number of parts.
PART_ROWS = 500_000


def rule(df: DataFrame, code: str, path: str | Column, where: Column | None = None, severity: str = ERROR) -> DataFrame:
    """One issue per row of ``df`` (that satisfies ``where``)."""
    path = F.col(path) if isinstance(path, str) else path
    rows = df if where is None else df.where(where)
    return rows.select(F.lit(code).alias("code"), path.cast("string").alias("path"), F.lit(severity).alias("severity"))


def parts_of(*tables: DataFrame) -> int:
    """How many parts keep each of these tables, read from files, at ``PART_ROWS`` rows a part."""
    return max(1, *[-(-df.count() // PART_ROWS) for df in tables])


def missing(
    df: DataFrame, target: DataFrame, on: Sequence[tuple[str, str]], code: str, path: str | Column, severity: str = ERROR, parts: int | None = None
) -> DataFrame:
    """Rows whose non-null reference has no target. With ``parts`` both sides are dealt into so
    many parts, where rows pass by the distinct keys of the target: a task sorts no rows, and does
    not hold more on a larger table or for a hot key."""
    given = F.lit(True)
    for left, _ in on:
        given = given & F.col(left).isNotNull()
    if parts is not None:
        names, lefts = [f"_t{i}" for i in range(len(on))], [left for left, _ in on]
        known = target.select(*[F.col(r).alias(n) for n, (_, r) in zip(names, on)]).repartition(parts, *names).distinct().hint("shuffle_hash")
        match = reduce(lambda a, b: a & b, [F.col(left) == F.col(n) for n, left in zip(names, lefts)])
        return rule(df.where(given).repartition(parts, *lefts).join(known, match, "left_anti"), code, path, severity=severity)
    keys = target.select(*[F.col(r).alias(f"_t{i}") for i, (_, r) in enumerate(on)]).distinct()
    match = reduce(lambda a, b: a & b, [F.col(left) == F.col(f"_t{i}") for i, (left, _) in enumerate(on)])
    return rule(df.where(given).join(keys, match, "left_anti"), code, path, severity=severity)


def repeated(df: DataFrame, keys: Sequence[str], code: str, severity: str = ERROR, parts: int | None = None) -> DataFrame:
    """Keys that occur more than once, grouped in ``parts`` parts if given."""
    dealt = df if parts is None else df.select(*keys).repartition(parts, *keys)
    twice = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    return rule(twice, code, F.concat_ws("/", *keys), severity=severity)


def all_issues(*rules: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, rules)


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("code", "severity").agg(F.count(F.lit(1)).alias("issues"))


def status(issues: DataFrame) -> DataFrame:
    """failed with any error, needs_review with any warning, else passed."""
    return issues.agg(
        F.count_if(F.col("severity") == ERROR).alias("errors"),
        F.count_if(F.col("severity") == WARNING).alias("warnings"),
    ).withColumn(
        "status",
        F.when(F.col("errors") > 0, "failed").when(F.col("warnings") > 0, "needs_review").otherwise("passed"),
    )
