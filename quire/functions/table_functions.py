"""Table functions for SQL, in Arrow batches: spans of a text, and a fold along the order of a group.

``register(spark)`` makes them known to a session:

    select * from text_spans(table(select doc_id as id, text from documents))
    select * from spaced_rows(table(select ...) partition by key order by at)

``spaced_rows`` handles a group row by row in one task, so a key that may be hot should carry a
slice of time or of ids among its partition columns; operators that must not restart at a slice
are built on ``Timeline`` instead."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

NUMBER = re.compile(r"[0-9]+(?:\.[0-9]+)?")
EMAIL = re.compile(r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
FORMS = (("email", EMAIL), ("number", NUMBER))
SPAN = "id long, kind string, start long, stop long, value string"


def spans(text: str) -> list[tuple[str, int, int, str]]:
    """Matches of every form in order of place; code points, the end is exclusive."""
    return sorted(((kind, *m.span(), m[0]) for kind, form in FORMS for m in form.finditer(text)), key=lambda s: (s[1], s[0]))


@arrow_udtf(returnType=SPAN)
class TextSpans:
    """(id, text) -> a row for every span. A null text has none; rows need no group."""

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        ids, rows = batch.column("id"), [spans(t.as_py() or "") for t in batch.column("text")]
        at = pa.array([i for i, found in enumerate(rows) for _ in found], pa.int64())
        flat = [s for found in rows for s in found]
        columns = [pa.array(c, t) for c, t in zip(zip(*flat), (pa.string(), pa.int64(), pa.int64(), pa.string()))] if flat else [
            pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64(), pa.string())]
        yield pa.table([ids.take(at), *columns], names=["id", "kind", "start", "stop", "value"])


@arrow_udtf(returnType="id long, kept boolean")
class SpacedRows:
    """(id, at, gap) of a group in order -> whether a row is at least its gap after the last kept
    row. State passes from batch to batch of the group."""

    def __init__(self):
        self.last = None

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        out = []
        for at, gap in zip(batch.column("at").to_pylist(), batch.column("gap").to_pylist()):
            keep = self.last is None or at - self.last >= gap
            self.last = at if keep else self.last
            out.append(keep)
        yield pa.table([batch.column("id"), pa.array(out, pa.bool_())], names=["id", "kept"])


def register(spark: SparkSession) -> None:
    spark.udtf.register("text_spans", TextSpans)
    spark.udtf.register("spaced_rows", SpacedRows)
