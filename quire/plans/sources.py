"""Scans and table changes over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.rules import parts_of
from quire.plans.registry import Tables, query
from quire.session import scratch, stored
from quire.sources import readers, tables
from quire.sources.index import BucketedIndex


@query(
    "a02_report_fingerprint",
    """select doc_id, sha256(text) as sha256, length(text) as chars, len(string_split(text, chr(10))) as lines from documents""",
)
def a02(t: Tables) -> DataFrame:
    return readers.fingerprints(t.documents, "doc_id", "text")


@query(
    "a04_scalar_coercion",
    """with cells as (
      select p_partkey, 'price' as field, format('{:,.2f}', p_retailprice) as cell from part
      union all select p_partkey, 'size', cast(p_size as varchar) || '%' from part
      union all select p_partkey, 'name', case when p_size > 25 then p_name else '  ' end from part)
    select p_partkey, field, case when trim(cell) = '' then 'blank'
        when regexp_full_match(replace(trim(cell), ',', ''), '-?[0-9]+') then 'int'
        when regexp_full_match(replace(trim(cell), ',', ''), '-?[0-9]+([.][0-9]+)?%?') then 'float' else 'text' end as kind,
      round(coalesce(try_cast(replace(replace(trim(cell), ',', ''), '%', '') as double), -1), 4) as number from cells""",
)
def a04(t: Tables) -> DataFrame:
    cells = t.part.select(
        "p_partkey",
        F.format_string("%,.2f", "p_retailprice").alias("price"),
        F.concat(F.col("p_size").cast("string"), F.lit("%")).alias("size"),
        F.when(F.col("p_size") > 25, F.col("p_name")).otherwise("  ").alias("name"),
    )
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("cell")) for c in ("price", "size", "name")])
    rows = readers.load_rows(t.spark, rows=cells).select("p_partkey", F.inline(fields))
    got = rows.withColumn("v", readers.coerce_scalar(F.col("cell")))
    return got.select(
        F.col("p_partkey").cast("bigint").alias("p_partkey"), "field", F.col("v.kind").alias("kind"),
        F.round(F.coalesce("v.number", F.lit(-1.0)), 4).alias("number"),
    )


@query(
    "a07_parameter_scan",
    "select o_orderkey, o_custkey, o_totalprice from orders where o_orderstatus = 'F' and o_totalprice >= 100000",
)
def a07(t: Tables) -> DataFrame:
    found = readers.scan(
        t.spark, f"{t.folder}/orders.parquet", "o_orderstatus = :status AND o_totalprice >= :low", status="F", low=100000.0
    )
    return found.select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "a08_row_changes",
    """select o_orderkey, case when o_orderpriority = '1-URGENT' then 'X' else o_orderstatus end as o_orderstatus,
      o_totalprice from orders where o_totalprice >= 50000
    union all select -s_suppkey - 1, 'N', s_acctbal from supplier where s_acctbal >= 50000 or s_acctbal < 50000""",
)
def a08(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    changed = tables.update_rows(rows, F.col("o_orderpriority") == "1-URGENT", {"o_orderstatus": F.lit("X")})
    kept = tables.delete_rows(changed, F.col("o_totalprice") < 50000).drop("o_orderpriority")
    delta = t.supplier.select((-F.col("s_suppkey") - 1).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), F.col("s_acctbal").alias("o_totalprice"))
    return tables.append_rows(kept, delta)


@query(
    "a09_upsert",
    """with delta as (select s_suppkey as k, s_name as name, s_nationkey as nation, s_acctbal as balance from supplier),
    old as (select c_custkey * 2 as k, c_name as name, c_nationkey as nation, c_acctbal as balance from customer)
    select k, coalesce(o.name, d.name) as name, coalesce(d.nation, o.nation) as nation, coalesce(d.balance, o.balance) as balance
    from old o full outer join delta d using (k)""",
)
def a09(t: Tables) -> DataFrame:
    old = t.customer.select(
        (F.col("c_custkey") * 2).alias("k"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance")
    )
    delta = t.supplier.select(
        F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")
    )
    return tables.upsert(old, delta, ["k"], keep=["name"])


@query(
    "a13_index_append",
    """select vec_id, label, 0 as added from embeddings where label < 5
    union all select vec_id, label, 1 from embeddings where label >= 5""",
)
def a13(t: Tables) -> DataFrame:
    vectors = t.embeddings.select("vec_id", "label")
    index = vectors.where(F.col("label") < 5).withColumn("added", F.lit(0))
    return tables.add_to_index(index, vectors.withColumn("added", F.lit(1)), "vec_id")


@query(
    "a15_index_candidates",
    """select event_id from events where event_type <> 'error' and event_id not in (select event_id from events where value >= 50)""",
)
def a15(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "event_type", "ts")
    indexed = t.events.where(F.col("value") >= 50).select("event_id")
    return tables.index_candidates(rows, indexed, "event_id", F.col("event_type") != "error", ["ts"], cap=None).select("event_id")


@query(
    "j06_index_batches",
    """select doc_id, case when doc_id % 3 <> 1 then 0 when doc_id % 2 = 0 then 1 else 2 end as batch from documents""",
)
def j06_index(t: Tables) -> DataFrame:
    index = BucketedIndex(f"{scratch(t.spark)}/index", "doc_id", buckets=8)
    docs = t.documents.select("doc_id")
    for n, part in enumerate((docs.where("doc_id % 3 <> 1"), docs.where("doc_id % 2 = 0"), docs)):
        index.append(part.withColumn("batch", F.lit(n)))
    return index.rows(t.spark)


# A deck is a customer, a slide an order, an artifact a line; every eleventh thing is wrong.
EXPORT_SQL = """
  slides as (select o_custkey as doc_id, o_orderkey as slide_id from orders),
  l as (select o_custkey as doc_id, l_orderkey * 8 + l_linenumber as artifact_id, case when l_partkey % 11 = 0 then -l_orderkey else l_orderkey end as slide_id,
      case l_returnflag when 'A' then 'chart' when 'N' then 'table' else 'image' end as kind, l_suppkey, l_partkey, l_linenumber, cast(l_quantity as int) as q from lineitem join orders on l_orderkey = o_orderkey),
  artifacts as (select *, case l_suppkey % 4 when 0 then 'combo' when 1 then 'pie' else 'bar' end as chart_type, l_partkey % 9 as categories, l_linenumber % 6 as cols, q % 7 as nrows, l_partkey % 13 as sources from l),
  series as (select doc_id, artifact_id, k as series_no, case when (k + l_suppkey) % 5 = 0 then ' ' else 's' || (k * l_suppkey) % 7 end as name, l_partkey % 9 + cast(l_linenumber = 6 as int) as vals
    from artifacts, unnest(range(1, 1 + q % 4)) as t(k) where kind = 'chart'),
  audit as (select c_custkey as doc_id, case when c_acctbal > 0 then 'passed' else 'failed' end as status, cast(c_custkey % 50 = 0 as int) as mismatches from customer where c_custkey % 17 <> 0),
  bindings as (select doc_id, artifact_id + cast(l_partkey % 19 = 0 as int) * 1000000000 as artifact_id, 'p' || l_partkey % 3 as output_path, l_partkey as fact_id from artifacts where l_partkey % 5 <> 0
    union all select doc_id, artifact_id, 'p' || l_partkey % 3, l_partkey + l_linenumber % 2 from artifacts where l_partkey % 7 = 0 and l_partkey % 19 <> 0),
  shape as (select a.doc_id, a.artifact_id, chart_type, categories, count(series_no) as n, count(*) filter (where trim(name, ' ') = '') as blank,
      count(distinct case when trim(name, ' ') <> '' then name end) as names, count(*) filter (where vals <> categories) as uneven
    from artifacts a left join series s on a.doc_id = s.doc_id and a.artifact_id = s.artifact_id where kind = 'chart' group by 1, 2, 3, 4),
  twice as (select doc_id, artifact_id, output_path, count(distinct fact_id) as facts, count(*) as n from bindings group by 1, 2, 3)"""


@query(
    "a14_export_issues",
    f"""with {EXPORT_SQL}
    select 'EXPORT.UNKNOWN_SLIDE' as code, doc_id || '/' || artifact_id as path from artifacts where slide_id not in (select slide_id from slides)
    union all select 'EXPORT.DUPLICATE_ARTIFACT', doc_id || '/' || artifact_id from artifacts group by doc_id, artifact_id having count(*) > 1
    union all select 'EXPORT.NO_SOURCE', doc_id || '/' || artifact_id from artifacts where sources = 0
    union all select 'EXPORT.UNSUPPORTED_CHART', doc_id || '/' || artifact_id from artifacts where kind = 'chart' and chart_type = 'combo'
    union all select 'EXPORT.EMPTY_CHART', doc_id || '/' || artifact_id from shape where n = 0 or categories = 0
    union all select 'EXPORT.SERIES_NAMES', doc_id || '/' || artifact_id from shape where blank > 0 or names < n - blank
    union all select 'EXPORT.SERIES_LENGTH', doc_id || '/' || artifact_id from shape where uneven > 0
    union all select 'EXPORT.PIE_SERIES', doc_id || '/' || artifact_id from shape where chart_type = 'pie' and n <> 1
    union all select 'EXPORT.EMPTY_TABLE', doc_id || '/' || artifact_id from artifacts where kind = 'table' and (cols = 0 or nrows = 0)
    union all select 'EXPORT.AUDIT', doc_id::varchar from audit where status <> 'passed' or mismatches > 0
    union all select 'EXPORT.AUDIT_MISSING', doc_id || '/' || artifact_id from artifacts where doc_id not in (select doc_id from audit)
    union all select 'EXPORT.NOT_AUDITED', doc_id || '/' || artifact_id from artifacts a where kind <> 'image' and not exists (select 1 from bindings b where b.doc_id = a.doc_id and b.artifact_id = a.artifact_id)
    union all select 'EXPORT.UNKNOWN_BINDING', doc_id || '/' || artifact_id from bindings b where not exists (select 1 from artifacts a where b.doc_id = a.doc_id and b.artifact_id = a.artifact_id)
    union all select 'EXPORT.BINDING', doc_id || '/' || artifact_id || '/' || output_path from twice where facts <> 1 or n <> 1""",
)
def a14(t: Tables) -> DataFrame:
    c = F.col
    slides = t.orders.select(c("o_custkey").alias("doc_id"), c("o_orderkey").alias("slide_id"))
    parts = parts_of(t.lineitem, t.orders, t.customer)
    owners = t.orders.select("o_orderkey", "o_custkey").repartition(parts, "o_orderkey").hint("shuffle_hash")
    l = t.lineitem.repartition(parts, "l_orderkey").join(owners, c("l_orderkey") == c("o_orderkey"))
    # Series and bindings are made of artifacts, so these are made once.
    artifacts = stored(l.select(
        c("o_custkey").alias("doc_id"), (c("l_orderkey") * 8 + c("l_linenumber")).alias("artifact_id"),
        F.when(c("l_partkey") % 11 == 0, -c("l_orderkey")).otherwise(c("l_orderkey")).alias("slide_id"),
        F.when(c("l_returnflag") == "A", "chart").when(c("l_returnflag") == "N", "table").otherwise("image").alias("kind"),
        F.when(c("l_suppkey") % 4 == 0, "combo").when(c("l_suppkey") % 4 == 1, "pie").otherwise("bar").alias("chart_type"),
        (c("l_partkey") % 9).alias("categories"), (c("l_linenumber") % 6).alias("columns"), (c("l_quantity").cast("int") % 7).alias("rows"),
        (c("l_partkey") % 13).alias("sources"), "l_suppkey", "l_partkey", "l_linenumber", c("l_quantity").cast("int").alias("q"),
    ))
    drawn = artifacts.where("kind = 'chart' and q % 4 > 0").withColumn("series_no", F.explode(F.sequence(F.lit(1), c("q") % 4)))
    name = F.when((c("series_no") + c("l_suppkey")) % 5 == 0, " ").otherwise(F.concat(F.lit("s"), c("series_no") * c("l_suppkey") % 7))
    series = drawn.select("doc_id", "artifact_id", "series_no", name.alias("name"), (c("categories") + (c("l_linenumber") == 6).cast("int")).alias("values"))
    audit = t.customer.where("c_custkey % 17 <> 0").select(
        c("c_custkey").alias("doc_id"), F.when(c("c_acctbal") > 0, "passed").otherwise("failed").alias("status"), (c("c_custkey") % 50 == 0).cast("int").alias("mismatches")
    )
    path = F.concat(F.lit("p"), c("l_partkey") % 3).alias("output_path")
    moved = (c("artifact_id") + (c("l_partkey") % 19 == 0).cast("int") * 1000000000).alias("artifact_id")
    bindings = artifacts.where("l_partkey % 5 <> 0").select("doc_id", moved, path, c("l_partkey").alias("fact_id")).unionByName(
        artifacts.where("l_partkey % 7 = 0 and l_partkey % 19 <> 0").select("doc_id", "artifact_id", path, (c("l_partkey") + c("l_linenumber") % 2).alias("fact_id"))
    )
    return tables.export_issues(slides, artifacts, series, audit, bindings, parts).select("code", "path")
