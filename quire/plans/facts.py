"""Numeric facts, candidates and checks over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.scan import Timeline
from quire.operators import facts
from quire.plans.registry import Tables, query

# Units and cues that occur in the given texts; every text names a "metric".
LEX = facts.Lexicon(units=("%", "$"), metrics=(("share", "ation"), ("rate", "ing")), cue="(?i)[a-z]{2,}")
NUM = r"[+-]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:[.][0-9]+)?"
NUMBERS_SQL = rf"""
  list_filter(regexp_extract_all(TEXT, '(?:^|[^0-9.])({NUM}(?:\s*[%$])?)', 1), lambda x: not regexp_matches(x, '(19|20)[0-9][0-9]'))
"""


@query(
    "c01_number_mentions",
    f"""with n as (select doc_id, {NUMBERS_SQL.replace('TEXT', 'text')} as found from documents where regexp_matches(text, '(?i)[a-z]{{2,}}'))
    select doc_id, len(found) as numbers, array_to_string(list_transform(found, lambda x: regexp_extract(x, '{NUM}')), '|') as raw from n where len(found) > 0""",
)
def c01(t: Tables) -> DataFrame:
    return (
        facts.with_mentions(t.documents.select("doc_id", "text"), "text", LEX)
        .where(F.size("found") > 0)
        .select("doc_id", F.size("found").cast("bigint").alias("numbers"), F.array_join(F.transform("found", lambda s: s["raw"]), "|").alias("raw"))
    )


@query(
    "c04_fact_ids",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, 'fact_' || left(sha256('table:' || l_orderkey || ':cell:' || l_linenumber || ':' || l_partkey), 20) as fact_id
    from lineitem""",
)
def c04(t: Tables) -> DataFrame:
    place = F.concat_ws(":", F.lit("cell"), "l_linenumber", "l_partkey")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        facts.fact_id(F.lit("table"), F.col("l_orderkey").cast("string"), place).alias("fact_id"),
    )


# Tables of a part: a cell goes through some dozens of patterns.
CELL_TABLES = 20_000


@query(
    "c05_table_facts",
    """with cells as (
      select p_partkey, p_name, 1 as c, cast(p_size as varchar) as raw, cast(p_size as double) as v, '' as unit, '2023' as period, 'segment' as scope from part
      union all select p_partkey, p_name, 2, format('{:,.2f}', p_retailprice), round(p_retailprice, 2), '元', null, 'category' from part)
    select p_partkey as source_id, 'fact_' || left(sha256('table:' || p_partkey || ':cell:0:' || c), 20) as fact_id, raw as raw_value, v as value,
      unit, coalesce(period, '') as period, p_name as label, scope,
      case when c = 2 then 'price' else 'unknown' end as metric_key, case when c = 2 then 'amount' else 'unknown' end as measure_kind from cells""",
)
def c05(t: Tables) -> DataFrame:
    tables = t.spread("part", "p_partkey", CELL_TABLES).select(
        F.lit("d").alias("doc_id"), F.col("p_partkey").alias("id"), F.array(F.lit("名称"), F.lit("2023年"), F.lit("价格（元）")).alias("columns"),
        F.array(F.array("p_name", F.col("p_size").cast("string"), F.format_number("p_retailprice", 2))).alias("rows"),
    )
    return facts.table_facts(tables).select(
        "source_id", "fact_id", "raw_value", F.col("normalized_value").cast("double").alias("value"), "unit",
        F.coalesce("period", F.lit("")).alias("period"), "label", "scope", "metric_key", "measure_kind",
    )


@query(
    "c06_cell_numbers",
    """select p_partkey, case when p_size % 5 = 0 then -1.0 else round(p_retailprice, 2) end as value,
      case when p_size % 5 <> 0 and p_size > 25 then '%' else '' end as unit from part""",
)
def c06(t: Tables) -> DataFrame:
    cell = F.when(F.col("p_size") % 5 == 0, F.element_at(F.array(F.lit("--"), F.lit("N/A"), F.lit("12 apples")), F.col("p_size") % 3 + 1)).otherwise(
        F.concat(F.format_number("p_retailprice", 2), F.when(F.col("p_size") > 25, " %").otherwise(""))
    )
    got = t.part.select("p_partkey", facts.cell_number(cell).alias("v"))
    return got.select("p_partkey", F.coalesce(F.col("v.value").cast("double"), F.lit(-1.0)).alias("value"), F.coalesce("v.unit", F.lit("")).alias("unit"))


METRICS = (("fastener", "bolt|screw"), ("machine", "gear|widget|gizmo"), ("economy", "ECONOMY"), ("large", "LARGE|hot"))


@query(
    "c07_metric_taxonomy",
    """with k as (select p_partkey, case when regexp_matches(p_name, 'bolt|screw') then 'fastener' when regexp_matches(p_name, 'gear|widget|gizmo') then 'machine'
        when regexp_matches(p_name, 'ECONOMY') then 'economy' when regexp_matches(p_name, 'LARGE|hot') then 'large' end as own,
        list_filter([case when regexp_matches(p_type, 'bolt|screw') then 'fastener' end, case when regexp_matches(p_type, 'gear|widget|gizmo') then 'machine' end,
          case when regexp_matches(p_type, 'ECONOMY') then 'economy' end, case when regexp_matches(p_type, 'LARGE|hot') then 'large' end], lambda x: x is not null) as around from part)
    select p_partkey, coalesce(own, case when len(around) = 1 then around[1] end, 'unknown') as metric_key,
      case when own is null and len(around) <> 1 then 'ratio' else 'ratio' end as measure_kind from k""",
)
def c07(t: Tables) -> DataFrame:
    typed = facts.classify(t.part, "s", F.col("p_name"), F.col("p_type"), F.lit("%"), F.lit(None).cast("string"), METRICS)
    return typed.select("p_partkey", "s.metric_key", "s.measure_kind")


@query(
    "c12_group_scores",
    """with g as (select l_orderkey, count(*) as n, count(distinct l_returnflag) as units, count(distinct year(l_shipdate)) as periods,
        count(*) between 3 and 6 and sum(l_quantity) between 95 and 105 as composed, bool_or(l_discount > 0.05) as cued from lineitem group by 1),
    s as (select l_orderkey, case when composed then 'composition' when periods >= 4 then 'trend' else 'comparison' end as intent,
      0.40 + case when composed or periods >= 4 then 0.30 else 0.25 end + case when cued then 0.10 else 0 end as score
      from g where n >= 2 and (units <= 1 or composed))
    select l_orderkey, intent, round(cast(score as double), 4) as score from s""",
)
def c12(t: Tables) -> DataFrame:
    groups = t.lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("l_returnflag").alias("units"), F.count_distinct(F.year("l_shipdate")).alias("periods"),
        F.sum("l_quantity").alias("total"), F.bool_or(F.col("l_discount") > 0.05).alias("cued"),
    )
    composed = F.col("n").between(3, 6) & F.col("total").between(95, 105)
    score = facts.score_group(F.col("n"), F.col("units"), F.col("periods"), composed, F.lit(True), F.col("cued"))
    return groups.withColumn("s", score).where(F.col("s").isNotNull()).select("l_orderkey", "s.intent", "s.score")


@query(
    "c14_composition",
    """with f as (select l_suppkey, l_returnflag, count(*) as n from lineitem group by 1, 2),
    p as (select l_suppkey, round(100.0 * n / sum(n) over (partition by l_suppkey), 2) as pct from f)
    select l_suppkey, count(*) as parts, min(pct) as least, round(sum(pct), 4) as total from p group by 1
    having count(*) between 3 and 6 and min(pct) >= 0 and round(sum(pct), 6) between 95 and 105""",
)
def c14(t: Tables) -> DataFrame:
    flags = t.lineitem.groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    whole = flags.groupBy("l_suppkey").agg(F.sum("n").alias("all"))
    shares = flags.join(whole, "l_suppkey").withColumn("pct", F.round(F.lit(100.0) * F.col("n") / F.col("all"), 2))
    return facts.compositions(shares, ["l_suppkey"], "pct").withColumn("total", F.round("total", 4))


@query(
    "c15_anchor_window",
    """with n as (select user_id, event_id, event_type, row_number() over (partition by user_id order by ts, event_id) - 1 as pos from events),
    a as (select user_id, max(pos) as anchor from n where event_type = 'error' group by 1)
    select user_id, event_id, pos from n left join a using (user_id)
    where pos >= greatest(0, coalesce(anchor, 0) - 6) and pos < greatest(0, coalesce(anchor, 0) - 6) + 12""",
)
def c15(t: Tables) -> DataFrame:
    line = Timeline(("user_id",), ("ts", "event_id"))
    rows = line.numbered(t.events.select("user_id", "ts", "event_id", "event_type"), "n").withColumn("pos", F.col("n") - 1)
    anchors = rows.where(F.col("event_type") == "error").groupBy("user_id").agg(F.max("pos").alias("pos"))
    return facts.anchor_window(rows, anchors, ["user_id"], "pos").select("user_id", "event_id", "pos")


@query(
    "c16_corpus_candidates",
    f"""with c as (select doc_id, trim(regexp_replace(regexp_replace(text, '[*_`~]+', '', 'g'), '\\s+', ' ', 'g'), ' ') as text from documents),
    n as (select doc_id, text, {NUMBERS_SQL.replace('TEXT', 'text')} as obs,
      len(list_distinct(regexp_extract_all(text, '(?i)(?:19|20)[0-9][0-9][AE]?|Q[1-4]'))) as periods from c where regexp_matches(text, '(?i)[a-z]{{2,}}')),
    u as (select *, list_filter(obs, lambda x: contains(x, '%')) as pct, list_distinct(list_filter(list_transform(obs, lambda x: right(x, 1)), lambda x: x in ('%', '$'))) as units from n),
    s as (select *, len(pct) = len(obs) and len(pct) between 3 and 6 and
        coalesce(list_sum(list_transform(pct, lambda x: try_cast(replace(regexp_extract(x, '{NUM}'), ',', '') as double))), 0) between 95 and 105 as composed from u)
    select doc_id, case when composed then 'composition' when periods >= 4 then 'trend' else 'comparison' end as chart_intent,
      round(cast(0.50 + case when composed or periods >= 4 then 0.30 else 0.25 end as double), 4) as score
    from s where len(obs) >= 2 and (len(units) <= 1 or composed)""",
)
def c16(t: Tables) -> DataFrame:
    blocks = t.documents.select("doc_id", F.col("doc_id").cast("string").alias("id"), F.lit("paragraph").alias("type"), F.col("text").alias("text_raw"))
    found = facts.block_candidates(blocks, LEX)
    return facts.best_candidates(found, ["doc_id"]).select("doc_id", "chart_intent", "score")


@query(
    "c17_best_candidates",
    """select o_custkey as id, o_orderpriority as kind, o_orderstatus as chart_intent, max(o_totalprice) as score,
      arg_max(o_orderkey, (o_totalprice, o_orderkey)) as o_orderkey from orders group by 1, 2, 3""",
)
def c17(t: Tables) -> DataFrame:
    rows = t.orders.select(
        F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("kind"), F.lit("chart").alias("visual_type"),
        F.col("o_orderstatus").alias("chart_intent"), F.col("o_totalprice").alias("score"), "o_orderkey",
    )
    return facts.best_candidates(rows).select("id", "kind", "chart_intent", "score", "o_orderkey")


@query(
    "c18_canonical_hash",
    """select o_orderkey, sha256('[["' || o_orderkey || '"],["' || o_orderstatus || '"],' || case when o_orderpriority = '5-LOW' then '[null]' else '["' || o_orderpriority || '"]' end || ']') as digest from orders""",
)
def c18(t: Tables) -> DataFrame:
    third = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
    return t.orders.select("o_orderkey", facts.canonical_hash([F.col("o_orderkey"), F.col("o_orderstatus"), third]).alias("digest"))


@query(
    "c19_plan_merge",
    """with e as (select s_nationkey as nation, cast(split_part(s_name, '#', 2) as bigint) as ref, s_acctbal as score from supplier),
    l as (select c_nationkey as nation, cast(split_part(c_name, '#', 2) as bigint) as ref, c_acctbal as score from customer),
    n as (select nation, count(*) as taken from e group by 1),
    r as (select l.*, row_number() over (partition by nation order by score desc, ref) as rn from l
      where not exists (select 1 from e where e.nation = l.nation and e.ref = l.ref))
    select nation, ref, score, 'explicit' as origin from e
    union all select r.nation, ref, score, 'located' from r left join n using (nation) where rn <= 6 and rn + coalesce(taken, 0) <= 6""",
)
def c19(t: Tables) -> DataFrame:
    def side(df: DataFrame, p: str) -> DataFrame:
        number = F.split_part(f"{p}_name", F.lit("#"), F.lit(2)).cast("bigint")
        return df.select(F.col(f"{p}_nationkey").alias("nation"), number.alias("ref"), F.col(f"{p}_acctbal").alias("score"))

    return facts.merge_plans(side(t.supplier, "s"), side(t.customer, "c"), ["nation"], ["ref"], "score", most=6)


@query(
    "c22_table_series",
    """with f as (select l_suppkey as source_id, year(l_shipdate) as col, case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as row_index,
        case when year(l_shipdate) >= 1998 then 'b' else 'a' end as unit, case when l_returnflag = 'R' then 'returned' else 'sold' end as metric
      from lineitem group by all),
    cols as (select source_id, col, min(unit) as unit from f group by 1, 2),
    grp as (select source_id, unit, count(*) as width, min(col) as first from cols group by 1, 2 having count(*) >= 2),
    best as (select source_id, arg_max(unit, (width, -first)) as unit, max(width) as width from grp group by 1),
    complete as (select f.source_id, row_index, width, min(metric) as metric from f join best using (source_id) join cols c on c.source_id = f.source_id and c.col = f.col and c.unit = best.unit
      group by 1, 2, 3 having count(*) = width),
    sizes as (select source_id, metric, count(*) as members, min(row_index) as first from complete group by 1, 2),
    winner as (select source_id, arg_max(metric, (members, -first)) as metric from sizes group by 1),
    r as (select c.source_id, row_index, c.metric, width, row_number() over (partition by c.source_id order by row_index) as series from complete c join winner w on w.source_id = c.source_id and w.metric = c.metric)
    select source_id, row_index, metric || '|amount' as signature, width, series from r""",
)
def c22(t: Tables) -> DataFrame:
    year = F.year("l_shipdate")
    rows = t.lineitem.select(
        F.lit("d").alias("doc_id"), F.lit("table").alias("source_kind"), F.col("l_suppkey").alias("source_id"), year.alias("column_index"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("row_index"),
        year.cast("string").alias("period"), F.when(year >= 1998, "b").otherwise("a").alias("unit"),
        F.when(F.col("l_returnflag") == "R", "returned").otherwise("sold").alias("metric_key"), F.lit("amount").alias("measure_kind"),
    ).distinct()
    return facts.table_series(rows, ("metric_key", "measure_kind"), keep=None).select(
        "source_id", F.col("row_index").cast("bigint").alias("row_index"), "signature", "width", F.col("series").cast("bigint").alias("series")
    )


@query(
    "c24_group_compatibility",
    """select o_custkey, count(*) as facts, case when min(o_orderstatus) <> max(o_orderstatus) then 'reject.mixed_status'
      when min(o_orderpriority) <> max(o_orderpriority) then 'reject.mixed_priority' else 'ok' end as reject
    from orders group by 1""",
)
def c24(t: Tables) -> DataFrame:
    same = (("o_orderstatus", "reject.mixed_status"), ("o_orderpriority", "reject.mixed_priority"))
    return facts.compatibility(t.orders, ["o_custkey"], same, typed=()).withColumn("reject", F.coalesce("reject", F.lit("ok")))


@query(
    "c25_forecast_boundary",
    """with p as (select o_custkey, o_orderpriority, min(case when o_orderstatus = 'O' then epoch_us(o_orderdate) end) as first,
        max(case when o_orderstatus <> 'O' then epoch_us(o_orderdate) end) as last from orders group by 1, 2)
    select o_custkey, coalesce(min(first), -1) as boundary, bool_and(first is null or last is null or last < first)
      and min(coalesce(first, -1)) = max(coalesce(first, -1)) as ordered from p group by 1""",
)
def c25(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("pos", F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    state = F.when(F.col("o_orderstatus") == "O", "estimate").otherwise("actual")
    found = facts.forecast_boundary(rows, ["o_custkey"], "o_orderpriority", "pos", state)
    return found.withColumn("boundary", F.coalesce("boundary", F.lit(-1)))


@query(
    "c29_numeric_audit",
    """with s as (select l_orderkey as id, sum(l_quantity) as v from lineitem group by 1), o as (select o_orderkey as id, round(o_totalprice / 5000) as v from orders)
    select coalesce(o.id, s.id) as id, case when s.id is null then 'unknown' when o.id is null then 'missing' when s.v = o.v then 'matched' else 'mismatch' end as status
    from o full outer join s on o.id = s.id""",
)
def c29(t: Tables) -> DataFrame:
    source = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_quantity").alias("v"))
    output = t.orders.select(F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") / 5000).alias("out"))
    return facts.numeric_audit(output, source, ["id"], "out", "v").select("id", "status")


@query(
    "c29_audit_rollup",
    """with s as (select l_orderkey as id, sum(l_quantity) as v from lineitem group by 1), o as (select o_orderkey as id, o_orderpriority as p, round(o_totalprice / 5000) as v from orders),
    a as (select p, case when s.id is null then 'unknown' when s.v = o.v then 'matched' else 'mismatch' end as status from o left join s on o.id = s.id)
    select p, count(*) filter (where status = 'matched') as matched, count(*) filter (where status = 'mismatch') as mismatch,
      count(*) filter (where status = 'unknown') as unknown, cast(0 as bigint) as missing,
      case when count(*) filter (where status <> 'matched') = 0 then 'passed' else 'failed' end as audit from a group by 1""",
)
def c29_rollup(t: Tables) -> DataFrame:
    priority = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("p"))
    source = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_quantity").alias("v")).join(priority, "id")
    output = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("p"), F.round(F.col("o_totalprice") / 5000).alias("out"))
    return facts.audit_rollup(facts.numeric_audit(output, source, ["id", "p"], "out", "v"), ["p"])


@query(
    "c32_chart_long",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, series, value from (
      select l_orderkey, l_linenumber, l_partkey, l_suppkey, unnest(['l_quantity', 'l_extendedprice', 'l_discount']) as series,
        unnest([l_quantity, l_extendedprice, l_discount]) as value from lineitem)""",
)
def c32(t: Tables) -> DataFrame:
    return facts.chart_long(t.lineitem, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], ["l_quantity", "l_extendedprice", "l_discount"])


@query(
    "c33_column_types",
    """select 'value' as "column", count(value) as "values", 'quantitative' as type from events
    union all select 'event_type', count(*), 'nominal' from events
    union all select 'props', count(*), 'nominal' from events
    union all select 'day', count(*), 'temporal' from events
    union all select 'user_id', count(*), 'quantitative' from events""",
)
def c33(t: Tables) -> DataFrame:
    rows = t.events.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return facts.column_types(rows, ["value", "event_type", "props", "day", "user_id"])
