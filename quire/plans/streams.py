"""Batch twins of the stream operators over the given events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.scan import Timeline
from quire.operators import memory
from quire.plans.registry import Tables, query
from quire.streaming import rounds

HOUR = 3_600_000_000
BY_USER = Timeline(("user_id",), ("ts", "event_id"))


@query(
    "j01_collector_batches",
    """with recursive r as (select user_id, event_id, epoch_us(ts) as us, cast(json_extract_string(props, '$.k') as bigint) * 12 as tok,
        row_number() over (partition by user_id order by ts, event_id) as rn from events),
    a as (select user_id, event_id, rn, cast(1 as bigint) as batch, cast(1 as bigint) as n, tok as used, us as since, us,
        tok >= 1000 as closes, tok from r where rn = 1
      union all
      select r.user_id, r.event_id, r.rn, case when a.closes then a.batch + 1 else a.batch end,
        case when a.closes then 1 else a.n + 1 end, case when a.closes then r.tok else a.used + r.tok end,
        case when a.closes then a.us else a.since end, r.us,
        (case when a.closes then 1 else a.n + 1 end) >= 3 or (case when a.closes then r.tok else a.used + r.tok end) >= 1000
          or r.us - (case when a.closes then a.us else a.since end) > 28800000000, r.tok
      from a join r on r.user_id = a.user_id and r.rn = a.rn + 1)
    select user_id, batch, count(*) as rounds, cast(sum(tok) as bigint) as tokens, min(event_id) as first_id, max(event_id) as last_id,
      case when count(*) >= 3 then 'rounds' when sum(tok) >= 1000 then 'tokens' else 'idle or open' end as reason from a group by 1, 2""",
)
def j01(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "ts", "event_id", (F.get_json_object("props", "$.k").cast("bigint") * 12).alias("tokens"))
    done = rounds.collected_batches(rows, BY_USER, F.col("tokens"), 1000, 8 * HOUR)
    return rounds.batch_summary(done, ["user_id"], "event_id", F.col("tokens"), 1000)


@query(
    "j02_acknowledged",
    """select event_id from events where event_type <> 'error' and (user_id, json_extract_string(props, '$.k')) not in (
      select (user_id, json_extract_string(props, '$.k')) from events where event_type = 'signup')""",
)
def j02(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "event_type", "user_id", F.get_json_object("props", "$.k").alias("round_id"))
    return rounds.acknowledged(
        rows.where(F.col("event_type") != "error"), rows.where(F.col("event_type") == "signup"), ["user_id", "round_id"]
    ).select("event_id")


@query(
    "j03_retracted",
    """select event_id from (select *, lead(event_type) over (partition by user_id order by ts, event_id) as nxt from events)
    where event_type <> 'error' and (nxt is null or nxt <> 'error')""",
)
def j03(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "ts", "event_id", "event_type")
    named = memory.with_previous(rows, BY_USER, ["event_id"]).where(F.col("event_type") == "error")
    tombs = named.select(F.col("prev_event_id").alias("event_id"))
    return rounds.retracted(rows.where(F.col("event_type") != "error"), tombs, ["event_id"]).select("event_id")


@query(
    "j04_sessions",
    """with g as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) < 1800000000 then 0 else 1 end as fresh from events),
    s as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as session from g)
    select user_id, cast(session as bigint) as session, count(*) as events, epoch_us(min(ts)) as start_us, epoch_us(max(ts)) + 1800000000 as end_us from s group by 1, 2""",
)
def j04(t: Tables) -> DataFrame:
    rows = memory.sessions(t.events.select("user_id", "ts", "event_id"), BY_USER, "ts", HOUR // 2)
    return rows.groupBy("user_id", "session").agg(
        F.count(F.lit(1)).alias("events"), F.unix_micros(F.min("ts")).alias("start_us"), (F.unix_micros(F.max("ts")) + HOUR // 2).alias("end_us")
    )


@query(
    "j05_round_lifecycle",
    """with n as (select *, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn) as round from conversations)
    select conv_id, cast(round as bigint) as round, count(*) as turns, cast(sum(length(text)) as bigint) as chars, min(turn) as first_turn, max(turn) as last_turn
    from n where round > 0 group by 1, 2""",
)
def j05(t: Tables) -> DataFrame:
    line = Timeline(("conv_id",), ("turn",))
    return rounds.rounds_of_turns(t.conversations, line, F.col("role") == "user", F.length("text"))


@query(
    "j06_first_seen",
    "select user_id, event_type, arg_min(event_id, (ts, event_id)) as event_id, arg_min(value, (ts, event_id)) as value from events group by 1, 2",
)
def j06(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_type", "event_id", "value", "ts")
    return rounds.first_seen(rows, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query(
    "j07_cool_down",
    """with recursive e as (select user_id, event_id, epoch_us(ts) // 1000000 as s, row_number() over (partition by user_id order by ts, event_id) as rn from events),
    w as (select user_id, event_id, rn, s as last, true as passed from e where rn = 1
      union all select e.user_id, e.event_id, e.rn, case when e.s >= w.last + 43200 then e.s else w.last end, e.s >= w.last + 43200
      from w join e on e.user_id = w.user_id and e.rn = w.rn + 1)
    select user_id, event_id from w where passed""",
)
def j07(t: Tables) -> DataFrame:
    return rounds.cooled_down(t.events.select("user_id", "ts", "event_id"), "user_id", "ts", "event_id", 43200)


@query(
    "j08_tumbling_counts",
    """select epoch_us(date_trunc('day', ts)) as start_us, event_type, count(*) as uses, count(*) filter (where value > 40) as errors from events group by 1, 2""",
)
def j08(t: Tables) -> DataFrame:
    rows = t.events.select("ts", "event_type", (F.col("value") > 40).alias("is_error"))
    return rounds.window_counts(rows, "ts", ["event_type"], "1 day").select(
        F.unix_micros("w.start").alias("start_us"), "event_type", "uses", "errors"
    )


@query(
    "j08_sliding_counts",
    """with w as (select unnest([0, 1, 2, 3]) as i, * from events)
    select ((epoch_us(ts) // 21600000000) - i) * 21600000000 as start_us, event_type, count(*) as uses, count(*) filter (where value > 40) as errors from w group by 1, 2""",
)
def j08_sliding(t: Tables) -> DataFrame:
    rows = t.events.select("ts", "event_type", (F.col("value") > 40).alias("is_error"))
    return rounds.window_counts(rows, "ts", ["event_type"], "1 day", "6 hours").select(
        F.unix_micros("w.start").alias("start_us"), "event_type", "uses", "errors"
    )
