"""Structure operators over the given tables; events, orders and the star schema stand for
tables of items where the text has no Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import rules
from quire.functions.scan import Timeline
from quire.operators import structure
from quire.plans.registry import Tables, query

BY_USER = Timeline(("user_id",), ("ts", "event_id"))
DAY = 86_400_000_000

LINES_SQL = """
  split as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from documents)
"""


@query(
    "b01_text_blocks",
    f"""with {LINES_SQL},
    flagged as (select *, regexp_replace(line, '\\s+', '', 'g') = '' as blank from split),
    starts as (select *, case when not blank and coalesce(lag(blank) over (partition by doc_id order by n), true) then 1 else 0 end as s from flagged),
    numbered as (select *, sum(s) over (partition by doc_id order by n) as no from starts)
    select doc_id, cast(no as bigint) as no, 'paragraph' as type, min(n) as line_start, max(n) as line_end,
      sha256(string_agg(line, chr(10) order by n)) as digest
    from numbered where not blank group by 1, 2""",
)
def b01(t: Tables) -> DataFrame:
    return structure.parse_blocks(t.documents).select(
        "doc_id", "no", "type", "line_start", "line_end", F.sha2("raw_text", 256).alias("digest")
    )


@query(
    "b03_section_path",
    """with l as (select *, case event_type when 'signup' then 1 when 'purchase' then 2 when 'click' then 3 end as level from events),
    w as (select *, max(case when level = 1 then event_id end) over x as a, max(case when level = 2 then event_id end) over x as b,
        max(case when level = 3 then event_id end) over x as c from l window x as (partition by user_id order by ts, event_id))
    select event_id, concat_ws('/', a, case when a is null or b > a then b end,
      case when (a is null or c > a) and (b is null or c > b) then c end) as path from w""",
)
def b03(t: Tables) -> DataFrame:
    level = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "click", 3)
    rows = t.events.select("user_id", "ts", "event_id", level.alias("level"))
    return structure.open_levels(rows, BY_USER, "level", "event_id", depth=3).select(
        "event_id", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path")
    )


@query(
    "b06_next_match",
    """select event_id, coalesce(nxt, -1) as next_purchase from (
      select event_id, event_type, min(case when event_type = 'purchase' then event_id end) over (
        partition by user_id order by ts, event_id rows between 1 following and unbounded following) as nxt from events)
    where event_type = 'click'""",
)
def b06(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "ts", "event_id", "event_type")
    found = structure.next_match(rows, BY_USER, F.col("event_type") == "purchase", F.col("event_id"), "next_purchase")
    return found.where(F.col("event_type") == "click").select("event_id", F.coalesce("next_purchase", F.lit(-1)).alias("next_purchase"))


@query(
    "b07_band_containment",
    """with bands as (select s_nationkey as nation, min(s_acctbal) as low, round(avg(s_acctbal), 2) as high from supplier group by 1)
    select c_custkey, coalesce(c_acctbal >= low and c_acctbal <= high, false) as in_band from customer left join bands on c_nationkey = nation""",
)
def b07(t: Tables) -> DataFrame:
    bands = t.supplier.groupBy(F.col("s_nationkey").alias("nation")).agg(
        F.min("s_acctbal").alias("low"), F.round(F.avg("s_acctbal"), 2).alias("high")
    )
    rows = t.customer.select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal")
    return structure.in_band(rows, bands, ["nation"], "c_acctbal", "low", "high").select("c_custkey", "in_band")


@query(
    "b11_ancestry",
    """select 'n' || n_nationkey as id, 'world/r' || n_regionkey || '/n' || n_nationkey as path from nation
    union all select 'r' || r_regionkey, 'world/r' || r_regionkey from region
    union all select 's' || s_suppkey, 'world/r' || n_regionkey || '/n' || n_nationkey || '/s' || s_suppkey
      from supplier join nation on s_nationkey = n_nationkey
    union all select 'world', 'world'""",
)
def b11(t: Tables) -> DataFrame:
    def node(df: DataFrame, mark: str, id: str, up: str | None) -> DataFrame:
        parent = F.concat(F.lit(up[0]), F.col(up[1:])) if up else F.lit("world")
        return df.select(F.concat(F.lit(mark), F.col(id)).alias("id"), parent.alias("parent_id"))

    nodes = (
        node(t.region, "r", "r_regionkey", None)
        .unionByName(node(t.nation, "n", "n_nationkey", "rn_regionkey"))
        .unionByName(node(t.supplier, "s", "s_suppkey", "ns_nationkey"))
        .unionByName(t.region.select(F.lit("world").alias("id"), F.lit(None).cast("string").alias("parent_id")).distinct())
    )
    return structure.ancestry(nodes, [], "id", "parent_id").select("id", F.array_join("path", "/").alias("path"))


@query(
    "b14_chunks",
    f"""with recursive {LINES_SQL},
    walk as (
      select doc_id, cast(1 as bigint) as n, cast(1 as bigint) as chunk, cast(length(line) as bigint) as used from split where n = 1
      union all
      select w.doc_id, s.n, case when w.used + length(s.line) > 600 then w.chunk + 1 else w.chunk end,
        case when w.used + length(s.line) > 600 then length(s.line) else w.used + length(s.line) end
      from walk w join split s on s.doc_id = w.doc_id and s.n = w.n + 1)
    select doc_id, chunk, min(n) as first_line, count(*) as lines, max(used) as chars from walk group by 1, 2""",
)
def b14(t: Tables) -> DataFrame:
    return structure.chunk_lines(t.documents, 600)


@query(
    "b17_nearest_rows",
    """with near as (
      select a.event_id, unnest([-3, -2, -1, 1, 2, 3]) as off,
        unnest([lag(b, 3) over w, lag(b, 2) over w, lag(b, 1) over w, lead(b, 1) over w, lead(b, 2) over w, lead(b, 3) over w]) as other, ts
      from (select *, {'us': epoch_us(ts), 'id': event_id} as b from events) a window w as (partition by user_id order by ts, event_id)),
    r as (select event_id, other.id as id, row_number() over (partition by event_id order by abs(other.us - epoch_us(ts)), other.us, other.id) as rn
      from near where other is not null)
    select event_id, string_agg(id, ',' order by rn) as near from r where rn <= 3 group by 1""",
)
def b17(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "ts", "event_id")
    near = structure.nearest_rows(rows, BY_USER, F.unix_micros("ts"), "event_id")
    return near.select("event_id", F.array_join(F.transform("near", lambda s: s["id"].cast("string")), ",").alias("near"))


@query(
    "b18_useful_lines",
    f"""with {LINES_SQL} select doc_id, n as line_no from split where length(line) >= 12
      and not regexp_full_match(line, '[0-9\\s./-]+') and not starts_with(line, '<table')
      and not (contains(lower(line), 'license') or contains(lower(line), 'copyright'))""",
)
def b18(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.where(structure.useful_text(F.col("line"), ("license", "copyright"))).select(
        "doc_id", (F.col("n") + 1).alias("line_no")
    )


@query(
    "b20_reference_audit",
    """with issues as (
      select 'order without customer' as code, 'error' as severity from orders where o_custkey not in (select c_custkey from customer)
      union all select 'line without order', 'error' from lineitem where l_orderkey not in (select o_orderkey from orders)
      union all select 'line without part', 'error' from lineitem where l_partkey not in (select p_partkey from part)
      union all select 'customer without nation', 'error' from customer where c_nationkey not in (select n_nationkey from nation)
      union all select 'order without lines', 'warning' from orders where o_orderkey not in (select l_orderkey from lineitem)
      union all select 'repeated line number', 'error' from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1)
      union all select 'bad quantity', 'error' from lineitem where not l_quantity > 0)
    select code, severity, count(*) as issues from issues group by 1, 2""",
)
def b20(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    # Keys pack well, so Spark's own choice of parts by bytes would put ever more rows into a task.
    parts = rules.parts_of(t.orders, t.lineitem, t.customer, t.part)
    issues = rules.all_issues(
        rules.missing(t.orders, t.customer, [("o_custkey", "c_custkey")], "order without customer", "o_orderkey", parts=parts),
        rules.missing(lines, t.orders, [("l_orderkey", "o_orderkey")], "line without order", "l_orderkey", parts=parts),
        rules.missing(lines, t.part, [("l_partkey", "p_partkey")], "line without part", "l_orderkey", parts=parts),
        rules.missing(t.customer, t.nation, [("c_nationkey", "n_nationkey")], "customer without nation", "c_custkey"),
        rules.missing(t.orders, lines, [("o_orderkey", "l_orderkey")], "order without lines", "o_orderkey", rules.WARNING, parts),
        rules.repeated(lines, ["l_orderkey", "l_linenumber"], "repeated line number", parts=parts),
        rules.rule(lines, "bad quantity", "l_orderkey", ~(F.col("l_quantity") > 0)),
    )
    return rules.issue_counts(issues)


@query(
    "b21_positional_pairs",
    """with n as (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as n from events
      where event_type in ('click', 'purchase'))
    select a.user_id, a.n, a.event_id as click_id, b.event_id as purchase_id from n a join n b using (user_id, n)
    where a.event_type = 'click' and b.event_type = 'purchase'""",
)
def b21(t: Tables) -> DataFrame:
    def side(kind: str, name: str) -> tuple[DataFrame, Timeline]:
        rows = t.events.where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(name))
        # Event ids are in time order, so they are the order.
        return rows, Timeline(("user_id",), (name,))

    clicks, click_line = side("click", "click_id")
    buys, buy_line = side("purchase", "purchase_id")
    return structure.zip_lists(clicks, buys, click_line, buy_line, ["user_id"]).select("user_id", "n", "click_id", "purchase_id")


@query(
    "b22_first_run",
    """with c as (select *, case when lag(event_type) over w is distinct from event_type then 1 else 0 end as s from events
      window w as (partition by user_id order by ts, event_id)),
    g as (select *, sum(s) over (partition by user_id order by ts, event_id) as island from c),
    r as (select user_id, island, event_type as "group", count(*) as rows, min(event_id) as event_id from g
      where event_type <> 'error' group by 1, 2, 3 having count(*) >= 2)
    select user_id, arg_min("group", event_id) as "group", arg_min(rows, event_id) as rows, min(event_id) as event_id from r group by 1""",
)
def b22(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "ts", "event_id", "event_type")
    return structure.first_run(rows, BY_USER, F.col("event_type") != "error", F.col("event_type")).select(
        "user_id", "group", "rows", "event_id"
    )


@query(
    "b23_compact_excerpt",
    """with s as (select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') as t from documents),
    h as (select *, left(t, 119) as head from s),
    k as (select *, case when contains(head, ',') then left(head, length(head) - length(split_part(head, ',', -1)) - 1) else '' end as kept from h)
    select doc_id, case when length(t) <= 120 then t else
      regexp_replace(case when contains(head, ',') and length(kept) >= 59 then kept else head end, '[, ]+$', '') || '…' end as excerpt from k""",
)
def b23(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", structure.compact_excerpt(F.col("text"), 120, ",").alias("excerpt"))


@query(
    "b24_block_statistics",
    """select user_id as doc_id, count(*) as block_count, """
    + ", ".join(f"count(*) filter (where event_type = '{x}') as {x}_count" for x in ("click", "error", "view"))
    + """, coalesce(arg_min('e' || event_id, event_id) filter (where event_type = 'heading'), arg_min('e' || event_id, event_id)) as title
    from events group by 1""",
)
def b24(t: Tables) -> DataFrame:
    rows = t.events.select(
        F.col("user_id").alias("doc_id"), F.col("event_type").alias("type"), F.lit(None).cast("int").alias("level"),
        F.col("event_id").alias("no"), F.concat(F.lit("e"), "event_id").alias("text"),
    )
    return structure.block_statistics(rows, ("click", "error", "view"))


CASES = [
    {"id": "short_en", "priority": 5, "all": ["english"], "none": ["long"]},
    {"id": "numbers", "priority": 9, "any": ["digits", "percent"]},
    {"id": "any_long", "priority": 3, "all": ["long"]},
    {"id": "plain", "priority": 1, "all": ["always"], "none": ["digits"]},
]


@query(
    "b26_case_selection",
    """with f as (select source, lang, bool_or(regexp_matches(text, '[0-9]')) as digits, bool_or(contains(text, '%')) as percent,
        bool_or(length(text) > 3000) as long, lang = 'en' as english from documents group by source, lang),
    j as (select source, lang, 'short_en' as case_id, 5 as priority, concat_ws(';', case when not english then 'missing:english' end,
        case when long then 'excluded_by:long' end) as reasons from f
      union all select source, lang, 'numbers', 9, case when not (digits or percent) then 'no_any_feature_matched' else '' end from f
      union all select source, lang, 'any_long', 3, case when not long then 'missing:long' else '' end from f
      union all select source, lang, 'plain', 1, case when digits then 'excluded_by:digits' else '' end from f)
    select source, lang, case_id, reasons = '' as matched,
      reasons = '' and row_number() over (partition by source, lang order by reasons <> '', priority desc, case_id) <= 2 as selected, reasons from j""",
)
def b26(t: Tables) -> DataFrame:
    features = structure.feature_flags(
        t.documents,
        ["source", "lang"],
        {
            "digits": F.col("text").rlike("[0-9]"),
            "percent": F.col("text").contains("%"),
            "long": F.length("text") > 3000,
            "english": F.col("lang") == "en",
        },
    )
    return structure.case_matches(features, CASES, keep=2).drop("features")


@query(
    "b27_inline_cleaning",
    """select page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '[ \\t]+', ' ', 'g'), ' ') as text from
      (select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '\\*+', '', 'g'), '[_`]', '', 'g'), '\\[', '(', 'g'), '\\]', ')', 'g') as html from pages)""",
)
def b27(t: Tables) -> DataFrame:
    # Markdown marks are taken out first: the SQL twin has no back-references for them.
    plain = F.translate(F.regexp_replace(F.regexp_replace("html", r"\*+", ""), "[_`]", ""), "[]", "()")
    return t.pages.select("page_id", structure.clean_inline(plain).alias("text"))


@query(
    "b32_interval_conflicts",
    """with i as (select o_orderkey, o_custkey, o_orderdate as a, o_orderdate + interval 40 day as z from orders),
    w as (select *, max(z) over (partition by o_custkey order by a, o_orderkey rows between unbounded preceding and 1 preceding) as reach,
      lead(a) over (partition by o_custkey order by a, o_orderkey) as nxt from i)
    select o_orderkey, coalesce(reach > a, false) or coalesce(nxt < z, false) as overlaps from w""",
)
def b32(t: Tables) -> DataFrame:
    rows = t.orders.select(
        "o_orderkey", "o_custkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("a")
    ).withColumn("z", F.col("a") + 40 * DAY)
    line = Timeline(("o_custkey",), ("a", "o_orderkey"))
    return structure.interval_conflicts(rows, line, "a", "z").select("o_orderkey", "overlaps")


@query(
    "b34_length_class",
    """select doc_id, case when len(string_split(text, chr(10))) > 8 or length(text) > 3000 then 'long' else 'normal' end as class from documents""",
)
def b34(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", structure.length_class(F.col("text"), 8, 3000).alias("class"))


@query(
    "b36_union_first",
    """with u as (select split_part(c_name, '#', 2) as name, 0 as list, c_acctbal as balance from customer
      union all select split_part(s_name, '#', 2), 1, s_acctbal from supplier)
    select name, arg_min(list, list) as list, arg_min(balance, (list, balance)) as balance from u group by 1""",
)
def b36(t: Tables) -> DataFrame:
    customers = t.customer.select(F.split_part("c_name", F.lit("#"), F.lit(2)).alias("name"), F.col("c_acctbal").alias("balance"))
    suppliers = t.supplier.select(F.split_part("s_name", F.lit("#"), F.lit(2)).alias("name"), F.col("s_acctbal").alias("balance"))
    return structure.union_first([customers, suppliers], "name").select("name", "list", "balance")


@query(
    "b38_extractive_summary",
    """with l as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') as lines from documents),
    b as (select doc_id, list_filter(lines, lambda x: not starts_with(x, '#')) as body, lines from l),
    c as (select doc_id, list_filter(body, lambda x: contains(lower(x), 'ation') or contains(lower(x), 'lich')) as cued,
      list_filter(lines, lambda x: length(x) >= 40) as longer from b),
    p as (select doc_id, list_transform(case when len(cued) > 0 then cued else longer end, lambda x: regexp_replace(x, '\\s+', ' ', 'g')) as points from c),
    u as (select doc_id, list_filter(points, lambda x, i: list_position(points, x) = i) as kept from p)
    select doc_id, case when len(kept) > 0 then '## Points' || chr(10) || '- ' || array_to_string(kept, chr(10) || '- ') else '' end as summary from u""",
)
def b38(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", structure.extractive_summary(F.col("text"), ("ation", "lich"), None, (None,) * 4, None).alias("summary"))


# A page is a supplier, regions and captions are its lines of odd and even number.
@query(
    "b35_region_captions",
    """with b as (select l_suppkey as page, l_returnflag as category, l_orderkey * 8 + l_linenumber as id, l_linenumber % 2 as odd, l_partkey % 500 as x0,
        l_partkey % 500 + cast(l_quantity as int) * 3 as x1, cast(floor(l_extendedprice) as bigint) % 9000 as y0, cast(floor(l_extendedprice) as bigint) % 9000 + l_linenumber * 8 as y1 from lineitem),
    p as (select r.id, c.id as caption, case when c.y0 - r.y1 between -12 and 120 then 0 when r.y0 - c.y1 between -12 and 80 then 1 end as side,
        (least(r.x1, c.x1) - greatest(r.x0, c.x0)) / greatest(1.0, least(r.x1 - r.x0, c.x1 - c.x0)) as overlap, c.y0 - r.y1 as below, r.y0 - c.y1 as above
      from b r join b c on r.page = c.page and r.category = c.category and r.odd = 1 and c.odd = 0),
    best as (select id, arg_min(caption::varchar, struct_pack(s := side, g := abs(case when side = 0 then below else above end), o := -overlap, c := caption::varchar)) as caption
      from p where side is not null and overlap >= 0.2 group by 1)
    select b.id as region_id, coalesce(caption, '') as caption from b left join best using (id) where odd = 1""",
)
def b35(t: Tables) -> DataFrame:
    c, d = F.col, lambda x: x.cast("double")
    y = c("l_extendedprice").cast("bigint") % 9000
    rows = t.lineitem.select(
        c("l_suppkey").alias("page"), c("l_returnflag").alias("category"), (c("l_orderkey") * 8 + c("l_linenumber")).alias("region_id"), "l_linenumber",
        d(c("l_partkey") % 500).alias("x0"), d(c("l_partkey") % 500 + c("l_quantity").cast("int") * 3).alias("x1"), d(y).alias("y0"), d(y + c("l_linenumber") * 8).alias("y1"),
    )
    captions = rows.where("l_linenumber % 2 = 0").withColumn("caption_text", c("region_id").cast("string"))
    return structure.region_captions(rows.where("l_linenumber % 2 = 1"), captions).select("region_id", "caption")


@query(
    "b10_table_continuations",
    """with i as (select l_suppkey as doc, l_linenumber as page, l_orderkey * 8 + l_linenumber as id, l_returnflag = 'R' as grid, l_partkey % 11 = 0 as note, cast(l_quantity as int) as q,
        l_partkey % 800 as x0, l_partkey % 800 + 30 + cast(floor(l_extendedprice) as bigint) % 170 as x1, l_partkey % 300 as y0, l_partkey % 300 + cast(l_quantity as int) as y1 from lineitem),
    t as (select doc, page + 1 as page, id, x0, x1 from i where grid and 800 + q * 3 >= 850 and q % 2 = 0),
    n as (select doc, page, min(struct_pack(y := y0, id := id)) as n from i where not grid and note and y0 <= 250 group by 1, 2),
    m as (select t.doc, t.id as table_index, n.n.id as note_index, list(i.id order by i.id) as items from t join n using (doc, page) join i on i.doc = t.doc and i.page = t.page
      where not i.grid and i.y0 < n.n.y and i.y1 <= 250 and i.x0 >= t.x0 - 100 and i.x1 <= t.x1 + 100 group by 1, 2, 3)
    select doc as doc_id, table_index, note_index, array_to_string(items, ',') as items from m where len(items) >= 2""",
)
def b10(t: Tables) -> DataFrame:
    c, d = F.col, lambda x: x.cast("double")
    grid, q, x, y = c("l_returnflag") == "R", c("l_quantity").cast("int"), c("l_partkey") % 800, c("l_partkey") % 300
    right = x + 30 + c("l_extendedprice").cast("bigint") % 170
    items = t.lineitem.select(
        c("l_suppkey").alias("doc_id"), c("l_linenumber").alias("page_idx"), (c("l_orderkey") * 8 + c("l_linenumber")).alias("item_index"),
        F.when(grid, "table").otherwise("text").alias("type"), F.when(c("l_partkey") % 11 == 0, "Source: x").otherwise("words").alias("text"),
        F.array(d(x), d(y), d(right), d(F.when(grid, 800 + q * 3).otherwise(y + q))).alias("bbox"),
        F.when(q % 2 == 0, F.array(F.lit("caption"))).otherwise(F.array().cast("array<string>")).alias("table_caption"),
    )
    return structure.table_continuations(items).select("doc_id", "table_index", "note_index", F.array_join("items", ",").alias("items"))


# A deck is a source, its pages are documents, its assets are parts.
ASSET_CUES = (("table", None, ("ation", "lich"), 2), (None, "brushed", ("the", "que"), 3), ("figure", "copper", ("en",), 1))


@query(
    "b37_page_assets",
    r"""with a as (select 'src' || p_partkey % 20 as doc, 'img/p' || p_partkey % 40 || '.png' as path, p_partkey, 'p' || p_partkey % 40 || '.png' as filename,
        case p_size % 4 when 0 then 'figure' when 1 then 'table' when 2 then 'chart' else 'formula' end as kind,
        case when p_size % 2 = 0 then 'Table ' else 'Figure ' end || p_size % 30 || ': ' || lower(p_type) as caption, p_size % 5 as base, p_partkey % 97 as area, p_size % 30 as number from part),
    p as (select source as doc, doc_id as page, text || case doc_id % 7 when 0 then ' (x/p' || doc_id % 90 || '.png)' when 1 then ' see table  ' || doc_id % 40 when 2 then ' results' when 3 then ' attention' else '' end as text,
        doc_id % 10 = 0 as structural, doc_id % 3 = 0 as hinted from documents),
    s as (select p.doc, p.page, a.*, lower(p.text) as low, case when contains(p.text, '/' || filename || ')') then 1
        when contains(regexp_replace(lower(p.text), '\s+', ' ', 'g'), kind || ' ' || number) then 2
        when regexp_matches(lower(p.text), '架构|architecture|mechanism|attention') and kind = 'figure' then 3
        when regexp_matches(lower(p.text), '结果|bleu|result|table|chart|trend|accuracy|指标|消融|训练成本') and kind in ('table', 'chart') then 4 when hinted then 5 end as step
      from p join a using (doc) where not structural),
    r as (select *, base + case when kind = 'table' and (contains(low, 'ation') or contains(low, 'lich')) then 2 else 0 end
        + case when contains(caption, 'brushed') and (contains(low, 'the') or contains(low, 'que')) then 3 else 0 end
        + case when kind = 'figure' and contains(caption, 'copper') and contains(low, 'en') then 1 else 0 end as score from s where step is not null),
    b as (select doc, page, arg_min(struct_pack(p := path, k := kind, s := step), struct_pack(s := step, c := -score, a := -area, p := path)) as b from r group by 1, 2)
    select p.page, coalesce(b.b.p, '') as path, coalesce(b.b.s, 0) as step, case when b.b.s is null then 'none' when b.b.s = 5 then 'optional' else 'required' end as requirement from p left join b on p.doc = b.doc and p.page = b.page""",
)
def b37(t: Tables) -> DataFrame:
    c = F.col
    assets = t.part.select(
        F.concat(F.lit("src"), c("p_partkey") % 20).alias("doc_id"), F.concat(F.lit("img/p"), c("p_partkey") % 40, F.lit(".png")).alias("path"),
        F.when(c("p_size") % 4 == 0, "figure").when(c("p_size") % 4 == 1, "table").when(c("p_size") % 4 == 2, "chart").otherwise("formula").alias("kind"),
        F.concat(F.when(c("p_size") % 2 == 0, "Table ").otherwise("Figure "), c("p_size") % 30, F.lit(": "), F.lower("p_type")).alias("caption"),
        (c("p_size") % 5).alias("base"), (c("p_partkey") % 97).alias("area"),
    )
    seventh, joined = c("doc_id") % 7, F.concat
    more = (
        F.when(seventh == 0, joined(F.lit(" (x/p"), c("doc_id") % 90, F.lit(".png)"))).when(seventh == 1, joined(F.lit(" see table  "), c("doc_id") % 40))
        .when(seventh == 2, " results").when(seventh == 3, " attention").otherwise("")
    )
    pages = t.documents.select(
        c("source").alias("doc_id"), c("doc_id").alias("page"), joined("text", more).alias("text"), F.when(c("doc_id") % 10 == 0, "opening").otherwise("content").alias("purpose"),
        (c("doc_id") % 3 == 0).cast("int").alias("image_count"), F.lit(0).alias("table_count"),
    )
    got = structure.bind_pages(pages, assets, ASSET_CUES)
    return got.select("page", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("step", F.lit(0)).alias("step"), "requirement")
