"""Pattern matches with their positions, from JVM built-ins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``; inside a lambda a plain expression would
    be evaluated again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spans(text: Column, pattern: str) -> Column:
    """Every match as struct(start, end, value), 0-based, end exclusive. The text is split at
    the matches; the pieces and the matches in turn give the offsets. The pattern must not
    match the empty string."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.split(text, pattern, -1), found, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        first = acc["at"] + x["gap"]
        end = first + F.length(x["m"])
        return F.struct(
            end.alias("at"),
            F.array_append(acc["out"], F.struct(first.alias("start"), end.alias("end"), x["m"].alias("value"))).alias("out"),
        )

    return F.aggregate(F.filter(pairs, lambda x: x["m"].isNotNull()), start, step, lambda acc: acc["out"])


def outside(found: Column, covered: Column) -> Column:
    """Spans that overlap none of the covered spans."""
    return let(
        covered,
        lambda c: F.filter(found, lambda s: ~F.exists(c, lambda o: (s["start"] < o["end"]) & (o["start"] < s["end"]))),
    )
