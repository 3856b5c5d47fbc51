"""Queries through the table functions."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quire.functions.table_functions import register
from quire.plans.registry import Tables, query


def _view(df: DataFrame, name: str) -> str:
    register(df.sparkSession)
    df.createOrReplaceTempView(name)
    return name


@query(
    "k03_text_spans",
    r"""with f as (select doc_id, kind, regexp_extract_all(text, p) as hits, string_split_regex(text, p) as gaps
      from documents, (values ('number', '[0-9]+(?:\.[0-9]+)?'), ('email', '[A-Za-z0-9._-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) as t(kind, p)),
    s as (select doc_id, kind, hits, gaps, unnest(range(1, len(hits) + 1)) as i from f),
    a as (select doc_id, kind, hits[i] as value, cast(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) as bigint) as start from s)
    select doc_id as id, kind, start, start + length(value) as stop, value from a""",
)
def k03(t: Tables) -> DataFrame:
    docs = _view(t.documents.selectExpr("doc_id as id", "text"), "quire_span_texts")
    return t.spark.sql(f"select id, kind, start, stop, value from text_spans(table({docs}))")


@query(
    "k04_spaced_rows",
    """with recursive e as (select event_id, user_id, epoch_us(ts) as us, epoch_us(ts) // 86400000000 as day from events),
    r as (select *, row_number() over (partition by user_id, day order by us, event_id) as rn from e),
    w as (select user_id, day, rn, event_id, us as last, true as kept from r where rn = 1
      union all
      select r.user_id, r.day, r.rn, r.event_id, case when r.us - w.last >= 7200000000 then r.us else w.last end, r.us - w.last >= 7200000000
      from w join r on r.user_id = w.user_id and r.day = w.day and r.rn = w.rn + 1)
    select event_id as id, kept from w""",
)
def k04(t: Tables) -> DataFrame:
    rows = t.events.selectExpr("event_id as id", "user_id", "unix_micros(ts) as at", "unix_micros(ts) div 86400000000 as day", "7200000000L as gap")
    name = _view(rows, "quire_spaced_events")
    return t.spark.sql(f"select id, kept from spaced_rows(table({name}) partition by (user_id, day) order by (at, id))")
