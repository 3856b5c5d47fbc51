"""Markdown and HTML whose text is put together from the star schema, so that SQL can state the
blocks, grids and units that the parser must find; evidence over the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators import citations, structure
from quire.plans.registry import Tables, query
from quire.sources import readers


def joined(*parts) -> Column:
    """Text from literals (str) and columns."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def grid(t: Tables) -> Column:
    c = F.col
    return joined("| size | kind |\n|:---|---:|\n| ", c("p_size"), " | ", c("p_type"), " |\n| ", c("p_brand"), " |\n| a | b | c |")


def pages(t: Tables) -> DataFrame:
    """A heading, a cited sentence, a caption, a table with two ragged rows and a list per part."""
    c = F.col
    text = joined("# ", c("p_name"), "\n\nMade by ", c("p_brand"), "[^cite_id:p", c("p_partkey"), "]\n\nTable ", c("p_size"), ": sizes\n\n", grid(t), "\n\n- ", c("p_type"), "\n")
    return t.part.select(c("p_partkey").alias("doc_id"), text.alias("text"))


@query(
    "b02_markdown_blocks",
    """select p_partkey as doc_id, b.no as no, b.type as type, b.a as line_start, b.z as line_end, b.level as level, b.text as text from (
      select p_partkey, unnest([
        {'no': 1::bigint, 'type': 'heading', 'a': 1, 'z': 1, 'level': 1, 'text': p_name},
        {'no': 2, 'type': 'paragraph', 'a': 3, 'z': 3, 'level': -1, 'text': 'Made by ' || p_brand},
        {'no': 3, 'type': 'paragraph', 'a': 5, 'z': 5, 'level': -1, 'text': 'Table ' || p_size || ': sizes'},
        {'no': 4, 'type': 'table', 'a': 7, 'z': 11, 'level': -1, 'text': ''},
        {'no': 5, 'type': 'list', 'a': 13, 'z': 13, 'level': -1, 'text': ''}]) as b from part)""",
)
def b02(t: Tables) -> DataFrame:
    blocks = structure.parse_blocks(pages(t))
    said = F.when(F.col("type").isin("heading", "paragraph"), F.col("text")).otherwise("")
    return blocks.select("doc_id", "no", "type", "line_start", "line_end", F.coalesce("level", F.lit(-1)).alias("level"), said.alias("text"))


@query(
    "b28_ragged_tables",
    """select p_partkey as doc_id, 'size,kind' as columns, 'left,right' as alignments,
      p_size || ',' || p_type || ';' || p_brand || ',;a,b' as cells, '2,3' as ragged from part""",
)
def b28(t: Tables) -> DataFrame:
    tables = structure.parse_blocks(pages(t)).where(F.col("type") == "table")
    cells = F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), ";")
    return tables.select("doc_id", F.array_join("columns", ",").alias("columns"), F.array_join("alignments", ",").alias("alignments"), cells.alias("cells"), F.array_join("ragged", ",").alias("ragged"))


@query("b29_table_captions", "select p_partkey as doc_id, 'Table ' || p_size || ': sizes' as caption from part")
def b29(t: Tables) -> DataFrame:
    found = structure.table_captions(structure.parse_blocks(pages(t)))
    return found.where(F.col("type") == "table").select("doc_id", "caption")


@query(
    "a05_markdown_grid",
    """select p_partkey, case when p_partkey % 3 = 0 then 'no data rows' else '' end as issue,
      case when p_partkey % 3 = 0 then '' else p_size || ',' || p_type || ';' || p_brand || ',;a,b' end as cells from part""",
)
def a05(t: Tables) -> DataFrame:
    text = F.when(F.col("p_partkey") % 3 == 0, F.lit("| a | b |\n|---|---|")).otherwise(grid(t))
    grids = readers.markdown_grid(t.part.select("p_partkey", text.alias("text")), "text")
    cells = F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), ";")
    return grids.select("p_partkey", F.coalesce("issue", F.lit("")).alias("issue"), F.coalesce(cells, F.lit("")).alias("cells"))


@query(
    "a06_html_grid",
    "select p_partkey, 'size,the kind' as columns, p_size || ',' || p_type || ' & co;' || p_brand || ',' as cells from part",
)
def a06(t: Tables) -> DataFrame:
    c = F.col
    html = joined("<table><tr><th>size</th><th>the\n <b>kind</b></th></tr><tr><td>", c("p_size"), "</td><td>", c("p_type"), "&nbsp;&amp; co</td></tr><TR><td class='x'>", c("p_brand"), "</td><td></td></TR></table>")
    rows = t.part.select("p_partkey", readers.html_grid(html).alias("g"))
    cells = F.array_join(F.transform("g.rows", lambda r: F.array_join(r, ",")), ";")
    return rows.select("p_partkey", F.array_join("g.columns", ",").alias("columns"), cells.alias("cells"))


@query("e01_citation_ids", "select p_partkey as doc_id, 'p' || p_partkey || ',b' || p_size as ids from part")
def e01(t: Tables) -> DataFrame:
    c = F.col
    text = joined("x[^cite_id:p", c("p_partkey"), "] y[^cite_id: b", c("p_size"), " ][^cite_id:p", c("p_partkey"), "]")
    return t.part.select(c("p_partkey").alias("doc_id"), F.array_join(structure.citations(text), ",").alias("ids"))


@query(
    "e02_citation_units",
    """select o_orderkey as doc_id, u.unit_id as unit_id, u.text as text, u.ids as ids from (select o_orderkey, unnest([
      {'unit_id': 'b_cu_001', 'text': 'Order ' || o_orderkey || ' was placed,', 'ids': 'c' || o_custkey},
      {'unit_id': 'b_cu_002', 'text': 'Status ' || o_orderstatus || '。', 'ids': 'a,p' || o_orderkey},
      {'unit_id': 'b_cu_003', 'text': 'on ' || o_orderpriority || '）。', 'ids': 'd'}]) as u from orders)""",
)
def e02(t: Tables) -> DataFrame:
    c = F.col
    raw = joined(
        "Title!Order ", c("o_orderkey"), " was placed[^cite_id:c", c("o_custkey"), "], Status ", c("o_orderstatus"), "[^cite_id:a][^cite_id:p",
        c("o_orderkey"), "]。 Later（on ", c("o_orderpriority"), "[^cite_id:d]）。 End",
    )
    blocks = t.orders.select(c("o_orderkey").alias("doc_id"), F.lit("b").alias("block_id"), raw.alias("raw_text"))
    return citations.citation_units(blocks).select("doc_id", "unit_id", "text", F.array_join("cite_ids", ",").alias("ids"))


def evidence(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Line items as blocks, their orders as tables of two fragments, parts as figures."""
    none = F.lit(None).cast("string")
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    box = F.array(*[F.lit(float(x)) for x in (0, 0, 1, 1)])
    blocks = t.lineitem.select(
        key("d", "l_orderkey").alias("doc_id"), F.concat_ws("-", F.lit("b"), "l_orderkey", "l_linenumber").alias("id"), key("s", "l_linenumber").alias("section_id"),
        F.col("l_linenumber").cast("int").alias("page"), F.when(F.col("l_linenumber") % 2 == 0, box).alias("bbox"),
        F.when(F.col("l_linenumber") < 3, F.col("l_linenumber")).cast("int").alias("source_content_index"),
        F.when(F.col("l_linenumber") == 4, key("t", "l_orderkey")).alias("table_id"), none.alias("figure_id"),
    )
    tables = t.orders.select(
        key("d", "o_orderkey").alias("doc_id"), key("t", "o_orderkey").alias("id"), F.lit("s1").alias("section_id"),
        F.array(F.struct(F.lit(2).alias("page"), box.alias("bbox")), F.struct(F.lit(9).alias("page"), box.alias("bbox"))).alias("fragments"),
        F.array(F.concat_ws("-", F.lit("b"), "o_orderkey", F.lit("3")), F.lit("gone")).alias("caption_block_ids"), F.lit(2).alias("source_content_index"),
    )
    figures = t.orders.where("o_orderkey % 5 = 0").select(
        key("d", "o_orderkey").alias("doc_id"), key("f", "o_orderkey").alias("id"), F.lit("s2").alias("section_id"), F.lit(3).alias("page"),
        F.array(F.lit(1.0)).alias("bbox"), F.concat_ws("-", F.lit("b"), "o_orderkey", F.lit("1")).alias("source_block_id"), F.lit(None).cast("int").alias("source_content_index"),
    )
    return blocks, tables, figures


@query(
    "b12_evidence_index",
    """select 'd' || l_orderkey as doc_id, 'block' as kind, 'b-' || l_orderkey || '-' || l_linenumber as id, 's' || l_linenumber as section_id,
      cast(l_linenumber as int) as page, case when l_linenumber % 2 = 0 then 4 else 0 end as sides from lineitem
    union all select 'd' || o_orderkey, 'table', 't' || o_orderkey, 's1', 2, 4 from orders
    union all select 'd' || o_orderkey, 'figure', 'f' || o_orderkey, 's2', 3, 0 from orders where o_orderkey % 5 = 0""",
)
def b12(t: Tables) -> DataFrame:
    found = structure.evidence_index(*evidence(t))
    return found.select("doc_id", "kind", "id", "section_id", "page", F.coalesce(F.when(F.col("bbox").isNotNull(), F.size("bbox")), F.lit(0)).alias("sides"))


@query(
    "b13_block_relations",
    """with l as (select 'd' || l_orderkey as doc_id, 'b-' || l_orderkey || '-' || l_linenumber as block_id, l_linenumber as n, l_orderkey as k from lineitem)
    select distinct doc_id, block_id, 'table' as kind, 't' || k as target_id from l join orders on o_orderkey = k where n in (2, 3, 4)
    union all select distinct doc_id, block_id, 'figure', 'f' || k from l join orders on o_orderkey = k where n = 1 and k % 5 = 0""",
)
def b13(t: Tables) -> DataFrame:
    return structure.block_relations(*evidence(t)).select("doc_id", "block_id", "kind", "target_id")
