"""Run analytics over the given tables. An event is a tool call: user = run, day = task,
type = tool, value = milliseconds, ``props.k`` below ten marks an error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import runs
from quire.plans.registry import Tables, query

TOOLS = runs.ToolClasses(
    change=("purchase",), verify=("view",), finalize=("signup",), core_excluded=("view", "error"),
    first_edit_excluded=("error",),
)

CALLS_SQL = """
calls as (
  select user_id as run_id, cast(floor(epoch_us(ts) / 86400000000.0) as bigint) - 19723 as task_idx,
         event_id as call_idx, ts, event_type as tool_name, value as duration_ms,
         cast(json_extract_string(props, '$.k') as bigint) < 10 as is_error
  from events)
"""


def calls(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("user_id").alias("run_id"),
        (F.floor(F.unix_micros("ts") / 86400000000) - 19723).alias("task_idx"),
        F.col("event_id").alias("call_idx"),
        "ts",
        F.col("event_type").alias("tool_name"),
        F.col("value").alias("duration_ms"),
        (F.get_json_object("props", "$.k").cast("bigint") < 10).alias("is_error"),
    )


VERIFIED_SQL = """
marked as (
  select *, tool_name = 'purchase' and not is_error as edit_ok,
    coalesce(max(case when tool_name = 'view' and not is_error then 1 else 0 end) over (
      partition by run_id, task_idx order by ts, call_idx rows between 1 following and 3 following), 0) = 1 as ahead
  from calls)
"""
TASK_SQL = """
lasts as (
  select run_id, task_idx, count(*) as calls,
    max(case when tool_name = 'purchase' and not is_error then call_idx end) as edit,
    max(case when tool_name = 'view' and not is_error then call_idx end) as verify,
    max(case when tool_name = 'signup' and not is_error then call_idx end) as final
  from calls group by 1, 2),
loops as (
  select run_id, task_idx, calls, edit is not null as has_edit,
    coalesce(verify > edit, false) as has_verify,
    coalesce(verify > edit, false) and coalesce(final > verify, false) as safe_finalize
  from lasts),
spent as (
  select *, sum(case when tool_name <> 'error' then duration_ms else 0 end) over (
    partition by run_id, task_idx order by ts, call_idx) as spent_ms
  from calls),
firsts as (
  select run_id, task_idx,
    arg_min(spent_ms, call_idx) filter (where tool_name = 'purchase' and not is_error) / 1000 as first_edit_s
  from spent group by 1, 2)
"""
RUN_SQL = """
tasks as (
  select run_id, task_idx, sum(case when tool_name not in ('view', 'error') then duration_ms else 0 end) as core_ms,
    count(*) filter (where edit_ok) as edits, count(*) filter (where edit_ok and ahead) as verified
  from marked group by 1, 2),
run_rows as (
  select run_id, count(*) filter (where task_idx >= 2) as modify_tasks, count(*) as tasks,
    cast(sum(edits) as bigint) as edits,
    count(*) filter (where task_idx >= 2 and safe_finalize) / nullif(count(*) filter (where task_idx >= 2), 0) as closed_loop,
    sum(verified) / nullif(sum(edits), 0) as strict_verify,
    avg(case when task_idx >= 2 then first_edit_s end) as first_edit_s,
    sum(core_ms) / 1000 as core_s
  from tasks join loops using (run_id, task_idx) join firsts using (run_id, task_idx) group by 1)
"""


@query(
    "h01_run_metrics",
    f"""with {CALLS_SQL}, {VERIFIED_SQL}, {TASK_SQL}, {RUN_SQL}
    select run_id, modify_tasks, tasks, edits, round(closed_loop, 6) as closed_loop,
      round(strict_verify, 6) as strict_verify, round(first_edit_s, 9) as first_edit_s, round(core_s, 6) as core_s
    from run_rows""",
)
def h01(t: Tables) -> DataFrame:
    m = runs.run_metrics(calls(t), tools=TOOLS)
    return m.withColumns(
        {
            "closed_loop": F.round("closed_loop", 6),
            "strict_verify": F.round("strict_verify", 6),
            "first_edit_s": F.round("first_edit_s", 9),
            "core_s": F.round("core_s", 6),
        }
    )


@query(
    "h02_verify_lookahead",
    f"""with {CALLS_SQL}, {VERIFIED_SQL}
    select run_id, task_idx, count(*) filter (where edit_ok) as edits,
      count(*) filter (where edit_ok and ahead) as verified
    from marked group by 1, 2""",
)
def h02(t: Tables) -> DataFrame:
    return (
        runs.verified_ahead(calls(t), TOOLS)
        .groupBy("run_id", "task_idx")
        .agg(F.count_if("edit_ok").alias("edits"), F.count_if("verified").alias("verified"))
    )


@query("h03_closed_loop", f"with {CALLS_SQL}, {TASK_SQL} select * from loops")
def h03(t: Tables) -> DataFrame:
    return runs.closed_loops(calls(t), TOOLS)


@query(
    "h04_first_success_time",
    f"with {CALLS_SQL}, {TASK_SQL} select run_id, task_idx, round(first_edit_s, 6) as first_edit_s from firsts",
)
def h04(t: Tables) -> DataFrame:
    return runs.first_edit_time(calls(t), TOOLS).withColumn("first_edit_s", F.round("first_edit_s", 6))


@query(
    "h05_payload_normalisation",
    """select event_id, event_type as tool_name, cast(json_extract_string(props, '$.k') as double) as duration_ms,
      event_type = 'error' as is_error from events""",
)
def h05(t: Tables) -> DataFrame:
    payload = F.to_json(
        F.struct(
            F.col("event_type").alias("name"),
            F.get_json_object("props", "$.k").cast("bigint").alias("elapsed_ms"),
            F.when(F.col("event_type") == "error", "yes").otherwise("no").alias("error"),
        )
    )
    return runs.normal_calls(t.events.select("event_id", payload.alias("payload")))


PAIR_METRICS = ("closed_loop", "strict_verify", "first_edit_s", "core_s")
PAIRS_SQL = f"""{CALLS_SQL}, {VERIFIED_SQL}, {TASK_SQL}, {RUN_SQL},
named as (
  select *, run_id // 30 as model, (run_id % 30) // 4 as scenario,
    case when run_id % 2 = 0 then 'tool_only' else 'no_injection' end as arm from run_rows),
pairs as (
  select model, scenario,
    max(case when arm = 'tool_only' then run_id end) as run_a, max(case when arm <> 'tool_only' then run_id end) as run_b,
    {", ".join(f"arg_max({m}, run_id) filter (where arm = 'tool_only') as {m}_a, arg_max({m}, run_id) filter (where arm <> 'tool_only') as {m}_b" for m in PAIR_METRICS)},
    count(*) filter (where arm = 'tool_only') as runs_a, count(*) filter (where arm <> 'tool_only') as runs_b
  from named group by 1, 2)
"""


def named_runs(t: Tables) -> DataFrame:
    return runs.run_metrics(calls(t), tools=TOOLS).withColumns(
        {
            "model": F.floor(F.col("run_id") / 30),
            "scenario": F.floor((F.col("run_id") % 30) / 4),
            "arm": F.when(F.col("run_id") % 2 == 0, "tool_only").otherwise("no_injection"),
        }
    )


def pairs(t: Tables) -> DataFrame:
    return runs.pair_arms(named_runs(t), ("tool_only", "no_injection"), PAIR_METRICS, F.col("run_id"))


@query(
    "h06_arm_pairs",
    f"""with {PAIRS_SQL} select model, scenario, run_a, run_b, runs_a, runs_b,
      round(core_s_a / core_s_b, 6) as core_ratio,
      case when runs_a = 0 then 'missing tool_only' when runs_b = 0 then 'missing no_injection'
        when runs_a > 1 or runs_b > 1 then 'newest of several' else 'paired' end as status from pairs""",
)
def h06(t: Tables) -> DataFrame:
    return pairs(t).select(
        "model", "scenario", "run_a", "run_b", "runs_a", "runs_b",
        F.round(runs.safe_ratio(F.col("core_s_a"), F.col("core_s_b")), 6).alias("core_ratio"), "status",
    )


@query(
    "h07_pair_summary",
    f"""with {PAIRS_SQL},
    whole as (select * from pairs where runs_a > 0 and runs_b > 0),
    long as (
      select model, 'closed_loop' as metric, closed_loop_a as a, closed_loop_b as b, true as up from whole
      union all select model, 'strict_verify', strict_verify_a, strict_verify_b, true from whole
      union all select model, 'first_edit_s', first_edit_s_a, first_edit_s_b, false from whole
      union all select model, 'core_ratio', core_s_a / nullif(core_s_b, 0), case when core_s_b <> 0 then 1.0 end, false from whole),
    judged as (
      select *, case when a is null or b is null then 'na'
        when abs(a - b) <= greatest(1e-9 * greatest(abs(a), abs(b)), 1e-9) then 'tie'
        when (a > b) = up then 'win' else 'loss' end as verdict from long)
    select case when grouping(model) = 1 then 'Overall' else cast(model as varchar) end as "group", metric,
      count(*) filter (where verdict = 'win') as wins, count(*) filter (where verdict = 'loss') as losses,
      count(*) filter (where verdict = 'tie') as ties, count(*) filter (where verdict = 'na') as gaps,
      count(*) filter (where verdict <> 'na') as n,
      round(case when metric = 'core_ratio' then
          case when min(a) filter (where verdict <> 'na') <= 1e-12 then 0.0
            else exp(avg(ln(nullif(greatest(a, 0), 0))) filter (where verdict <> 'na')) end
        else avg(a) filter (where verdict <> 'na') end, 9) as a_value,
      round(case when metric = 'core_ratio' then 1.0 else avg(b) filter (where verdict <> 'na') end, 9) as b_value
    from judged group by grouping sets ((model, metric), (metric))""",
)
def h07(t: Tables) -> DataFrame:
    whole = pairs(t).where((F.col("runs_a") > 0) & (F.col("runs_b") > 0))
    ratio = runs.safe_ratio(F.col("core_s_a"), F.col("core_s_b"))
    metrics = [
        runs.Metric("closed_loop", F.col("closed_loop_a"), F.col("closed_loop_b")),
        runs.Metric("strict_verify", F.col("strict_verify_a"), F.col("strict_verify_b")),
        runs.Metric("first_edit_s", F.col("first_edit_s_a"), F.col("first_edit_s_b"), higher_is_better=False),
        runs.Metric("core_ratio", ratio, F.when(ratio.isNotNull(), 1.0), higher_is_better=False, geometric=True),
    ]
    # Scaled first: a mean that is half of the last digit may be a bit below it by the order of its sum.
    return runs.pair_summary(whole, metrics).withColumns(
        {c: F.round(F.col(c) * 1e9) / 1e9 for c in ("a_value", "b_value")}
    )


@query(
    "h10_dimension_rows",
    """select lang as dimension_id, count(*) as probe_count, round(avg(quality * 10.0), 6) as primary_avg_score,
      round(avg(toxic * 10.0), 6) as control_avg_score, round(avg(quality * 10.0 - toxic * 10.0), 6) as mean_score_lift,
      round(count(*) filter (where quality > toxic) / count(*), 6) as primary_win_rate
    from labels join documents using (doc_id) group by 1""",
)
def h10(t: Tables) -> DataFrame:
    scored = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").select(
        F.col("lang").alias("dimension_id"),
        (F.col("quality") * 10.0).alias("primary_score"),
        (F.col("toxic") * 10.0).alias("control_score"),
        ((F.col("quality") - F.col("toxic")) * 10.0).alias("score_lift"),
        F.when(F.col("quality") > F.col("toxic"), "primary_better").otherwise("control_better").alias("winner"),
    )
    rows = runs.dimension_rows(scored)
    return rows.select(
        "dimension_id", "probe_count",
        *[F.round(c, 6).alias(c) for c in rows.columns if c not in ("dimension_id", "probe_count")],
    )


@query(
    "h11_summary_reconcile",
    """with rebuilt as (
      select l_orderkey, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) as total, count(*) as lines
      from lineitem group by 1),
    stored as (select o_orderkey, o_totalprice as total, 4 as lines from orders),
    both_sides as (
      select coalesce(o_orderkey, l_orderkey) as id, unnest(['total', 'lines']) as field,
        unnest([s.total, s.lines]) as stored, unnest([r.total, r.lines]) as rebuilt,
        o_orderkey is not null as has_s, l_orderkey is not null as has_r
      from stored s full outer join rebuilt r on o_orderkey = l_orderkey)
    select id, field, stored, rebuilt, case when not has_s then 'missing stored row'
      when not has_r then 'missing rebuilt row' else 'mismatch' end as issue
    from both_sides where not (has_s and has_r and round(stored, 2) = round(rebuilt, 2))""",
)
def h11(t: Tables) -> DataFrame:
    gross = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    rebuilt = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.round(F.sum(gross), 2).alias("total"), F.count(F.lit(1)).alias("lines")
    )
    stored = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("total"), F.lit(4).alias("lines"))
    return runs.reconcile(stored, rebuilt, ["id"], ["total", "lines"], digits=2)


@query(
    "h12_weighted_table",
    """with means as (
      select c_mktsegment as segment, l_returnflag as flag, sum(l_extendedprice * l_quantity) / sum(l_quantity) as score,
        count(*) as sources
      from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by 1, 2)
    select segment, flag, round(score, 4) as score, sources,
      abs(score - max(score) over (partition by flag)) <= 1e-9 * score as best from means""",
)
def h12(t: Tables) -> DataFrame:
    rows = (
        t.lineitem.select("l_orderkey", "l_returnflag", "l_extendedprice", "l_quantity")
        .join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
        .select(F.col("c_mktsegment").alias("segment"), F.col("l_returnflag").alias("flag"), "l_extendedprice", "l_quantity")
    )
    table = runs.weighted_table(rows, ["segment"], "l_extendedprice", "l_quantity", "flag")
    return table.withColumn("score", F.round("score", 4))


@query(
    "h14_experiment_rollup",
    """select conv_id, count(*) as total_rounds, arg_max(length(text), turn) as final_score,
      arg_max(role = 'assistant', turn) as early_stopped, cast(sum(length(text)) as bigint) as total_duration
    from conversations group by 1""",
)
def h14(t: Tables) -> DataFrame:
    rounds = t.conversations.select(
        "conv_id", "turn", F.length("text").cast("bigint").alias("chars"), (F.col("role") == "assistant").alias("done")
    )
    return runs.experiment_rollup(rounds, ["conv_id"], ["turn"], "chars", "done", "chars")
