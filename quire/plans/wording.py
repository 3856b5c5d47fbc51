"""Text and value rules over texts put together from the star schema, so that SQL can state the
results: units, scenarios, periods, labels, titles, boxes, contrast and claim plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import citations, facts, outline, pages, structure
from quire.plans.markdown import joined
from quire.plans.registry import Tables, query


@query(
    "c08_unit_meaning",
    """with p as (select p_partkey, case p_partkey % 6 when 0 then '亿元' when 1 then '%' when 2 then 'MW' when 3 then '亿美元' when 4 then 'kg' else '' end as unit from part)
    select p_partkey, case unit when '亿元' then 'currency' when '亿美元' then 'currency' when '%' then 'percentage' when 'MW' then 'capacity' when '' then 'dimensionless' else 'volume' end as family,
      case unit when '亿元' then '100000000' when '亿美元' then '100000000' else '1' end as scale,
      case unit when '亿元' then 'CNY' when '亿美元' then 'USD' else '' end as currency from p""",
)
def c08(t: Tables) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, ("亿元", "%", "MW", "亿美元", "kg", ""))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return t.part.select("p_partkey", facts.unit_semantics(unit).alias("u")).select("p_partkey", "u.*")


@query(
    "c09_scenario",
    """select o_orderkey, case when o_orderpriority like '1%' then 'guidance' when o_orderpriority like '2%' then 'target'
      when o_orderpriority like '3%' or o_orderkey % 4 = 0 then 'estimate' else 'actual' end as scenario from orders""",
)
def c09(t: Tables) -> DataFrame:
    c = F.col
    said = F.when(c("o_orderpriority").startswith("1"), "the Guidance, a target").when(c("o_orderpriority").startswith("2"), "目标 and forecast").when(c("o_orderpriority").startswith("3"), "预计").otherwise("sold")
    period = F.when(c("o_orderkey") % 4 == 0, " 2024e ").otherwise("2024")
    return t.orders.select("o_orderkey", facts.scenario(period, said).alias("scenario"))


@query(
    "c02_period_labels",
    """select o_orderkey, year(o_orderdate) || ',Q2,' || (2010 + o_orderkey % 5) || ',' || (2011 + o_orderkey % 5) || ',' || (2012 + o_orderkey % 5)
      || case when o_orderkey % 2 = 0 then ',1980,2005' else '' end as labels from orders""",
)
def c02(t: Tables) -> DataFrame:
    c = F.col
    low = c("o_orderkey") % 5 + 2010
    text = joined("In ", F.year("o_orderdate"), "年末 and q2, then ", low, "-", low + 2, "年, again ", F.year("o_orderdate"), "年", F.when(c("o_orderkey") % 2 == 0, "; 1980-2005").otherwise(""))
    return t.orders.select("o_orderkey", F.array_join(facts.period_labels(text), ",").alias("labels"))


@query(
    "c03_label_before",
    "select p_partkey, case when p_partkey % 2 = 0 then p_brand_word else '份额' end as label from (select *, replace(p_brand, '#', '') as p_brand_word from part)",
)
def c03(t: Tables) -> DataFrame:
    word = F.replace(F.col("p_brand"), F.lit("#"), F.lit(""))
    lead = F.when(F.col("p_partkey") % 2 == 0, joined("skipped，其中", word, "占比为 ")).otherwise("a；2024年份额达到")
    text = F.concat(lead, F.col("p_size").cast("string"))
    return t.part.select("p_partkey", facts.label_before(text, F.length(lead)).alias("label"))


@query(
    "e11_fallback_title",
    """with t as (select p_partkey, p_name || ' ' || p_type as short, p_name || repeat(', ' || p_type || ' by ' || p_brand, 4) as long from part)
    select p_partkey, case when p_partkey % 3 = 0 then '网页来源' when p_partkey % 3 = 1 then short when length(long) > 96 then rtrim(left(long, 96), ' ') || '…' else long end as title from t""",
)
def e11(t: Tables) -> DataFrame:
    c = F.col
    short = joined("网页发布时间：2024-01-02  ", c("p_name"), "\n ", c("p_type"), "。")
    long = F.concat(c("p_name"), F.repeat(joined(",  ", c("p_type"), " by ", c("p_brand")), F.lit(4)))
    text = F.when(c("p_partkey") % 3 == 0, " ：，").when(c("p_partkey") % 3 == 1, short).otherwise(long)
    return t.part.select("p_partkey", citations.fallback_title(text).alias("title"))


@query(
    "b08_actual_box",
    """select l_orderkey, l_linenumber, case when l_linenumber = 7 then '' else round(l_quantity * 600 / 1000, 4) || ',' || round(l_linenumber * 8.0, 4) end as corner,
      case when l_linenumber = 7 then 'missing_or_invalid_bbox' when l_linenumber = 6 or l_quantity >= 50 then 'bbox_out_of_range' else '' end as issue from lineitem""",
)
def b08(t: Tables) -> DataFrame:
    c = F.col
    d = lambda x: F.lit(float(x))
    box = F.array(c("l_quantity").cast("double"), (c("l_linenumber") * 10).cast("double"), d(50), F.when(c("l_linenumber") == 6, d(1001)).when(c("l_linenumber") != 7, d(900)))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", structure.actual_box(box, d(600), d(800)).alias("b"))
    corner = F.when(c("b.bbox").isNull(), "").otherwise(F.concat_ws(",", F.get("b.bbox", F.lit(0)), F.get("b.bbox", F.lit(1))))
    return rows.select("l_orderkey", "l_linenumber", corner.alias("corner"), F.coalesce("b.issue", F.lit("")).alias("issue"))


GREY_SQL = "case when g / 255.0 <= 0.03928 then g / 255.0 / 12.92 else pow((g / 255.0 + 0.055) / 1.055, 2.4) end"


@query(
    "i06_contrast",
    f"""with p as (select p_partkey, p_partkey % 256 as g from part), r as (select p_partkey, g, round(1.05 / ({GREY_SQL} + 0.05), 2) as contrast from p)
    select p_partkey, '#' || repeat(lpad(lower(printf('%x', g)), 2, '0'), 3) as background, contrast from r where 1.05 / ({GREY_SQL} + 0.05) < 4.5""",
)
def i06(t: Tables) -> DataFrame:
    grey = F.lpad(F.lower(F.hex(F.col("p_partkey") % 256)), 2, "0")
    html = joined("<p style=\"color: #FFF; background-color:#", grey, grey, grey, "\">x</p>")
    found = pages.contrast_issues(t.part.select("p_partkey", html.alias("html")), "p_partkey", "html", 4.5)
    return found.select("p_partkey", "background", "contrast")


@query(
    "d15_claim_plan",
    """select 'unknown_section' as code, 'd' || o_orderkey || '/s' || o_custkey as path from orders where o_orderkey % 5 = 0
    union all select 'unavailable_evidence', 'd' || o_orderkey || '/c' || o_orderkey || '/block/b' || o_orderkey from orders where o_orderkey % 7 = 0""",
)
def d15(t: Tables) -> DataFrame:
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    refs = t.orders.select("o_orderkey", key("d", "o_orderkey").alias("doc_id"), key("s", "o_custkey").alias("section_ref"))
    sections = refs.where("o_orderkey % 5 <> 0").select("doc_id", F.col("section_ref").alias("section_id"))
    claims = t.orders.select("o_orderkey", key("d", "o_orderkey").alias("doc_id"), key("c", "o_orderkey").alias("claim_id"), F.lit("block").alias("kind"), key("b", "o_orderkey").alias("id"))
    held = claims.where("o_orderkey % 7 <> 0").select("doc_id", "kind", "id")
    return outline.plan_issues(claims, refs, held, sections).select("code", "path")
