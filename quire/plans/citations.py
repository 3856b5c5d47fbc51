"""Citation operators over the given tables: customers and orders for sources and uses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.scan import Timeline
from quire.operators import citations
from quire.plans.registry import Tables, query

SUPPLIERS = Timeline((), ("s_suppkey",))


@query(
    "e03_reconcile",
    """select coalesce(k, c_custkey) as id, case when c_custkey is null then 'source_missing' when k is null then 'unused' else 'verified' end as state
    from (select distinct o_custkey + 5 as k from orders) full outer join customer on k = c_custkey""",
)
def e03(t: Tables) -> DataFrame:
    used = t.orders.select((F.col("o_custkey") + 5).alias("id"))
    return citations.reconcile_sources(used, t.customer.select(F.col("c_custkey").alias("id")), "id")


@query(
    "e04_eligible_units",
    """select c_custkey, coalesce(o_orderkey, -1) as unit_id from customer left join (select * from orders where o_orderstatus = 'O') on o_custkey = c_custkey""",
)
def e04(t: Tables) -> DataFrame:
    slides = t.customer.select("c_custkey")
    refs = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("block_id"), F.lit(1).alias("ref_no"))
    units = t.orders.select(
        F.col("o_orderkey").alias("block_id"), F.col("o_orderkey").alias("unit_id"), F.col("o_orderstatus").alias("cite_id")
    )
    verified = t.orders.where(F.col("o_orderstatus") == "O").select(F.col("o_orderstatus").alias("cite_id")).distinct()
    got = citations.eligible_units(slides, refs, units, verified, ["c_custkey"])
    return got.select("c_custkey", F.coalesce("unit_id", F.lit(-1)).alias("unit_id"))


@query("e05_source_numbers", "select s_suppkey, row_number() over (order by s_suppkey) as number from supplier")
def e05(t: Tables) -> DataFrame:
    return citations.number_sources(t.supplier.select("s_suppkey"), SUPPLIERS)


RESOLVED_SQL = """
  numbers as (select p_brand, row_number() over (order by p_brand) as number from (select distinct p_brand from part)),
  resolved as (select distinct l_orderkey as claim_id, number from lineitem join part on l_partkey = p_partkey join numbers using (p_brand) where l_returnflag = 'R')
"""


def resolved(t: Tables) -> DataFrame:
    brands = t.part.select(F.col("p_brand").alias("cite_id")).distinct()
    # Brands are names, so they are numbered along their text.
    numbers = citations.number_sources(brands, Timeline((), ("cite_id",)))
    mappings = t.lineitem.where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("claim_id"), F.col("l_partkey").alias("unit_id"))
    units = t.part.select(F.col("p_partkey").alias("unit_id"), F.col("p_brand").alias("cite_id"))
    return citations.resolve_claims(mappings, units, numbers)


@query("e06_resolved_numbers", f"with {RESOLVED_SQL} select claim_id, number from resolved")
def e06(t: Tables) -> DataFrame:
    return resolved(t)


@query(
    "e07_mapping_default",
    """select doc_id, case when l.doc_id is null then 'unsupported' when quality = 1 then 'supported' else 'weak' end as status
    from (select doc_id from documents) d left join labels l using (doc_id)""",
)
def e07(t: Tables) -> DataFrame:
    claims = t.documents.select("doc_id")
    mapped = t.labels.select("doc_id", F.when(F.col("quality") == 1, "supported").otherwise("weak").alias("status"))
    return citations.with_default(claims, mapped, "doc_id", "status")


@query(
    "e07_mapping_issues",
    """select 'inconsistent_status' as code, cast(doc_id as varchar) as path from labels where (quality = 1) <> (toxic = 1)
    union all select 'unknown_claim', cast(doc_id as varchar) from labels where doc_id not in (select doc_id from documents)
    union all select 'unknown_unit', doc_id || '/' || doc_id + 1 from labels where toxic = 1 and doc_id + 1 not in (select doc_id from documents where lang = 'en')""",
)
def e07_issues(t: Tables) -> DataFrame:
    none = F.array().cast("array<bigint>")
    mappings = t.labels.select(
        F.col("doc_id").alias("claim_id"), F.when(F.col("quality") == 1, "supported").otherwise("unsupported").alias("status"),
        F.when(F.col("toxic") == 1, F.array(F.col("doc_id") + 1)).otherwise(none).alias("unit_ids"),
    )
    claims = t.documents.select(F.col("doc_id").alias("claim_id"))
    units = t.documents.where(F.col("lang") == "en").select(F.col("doc_id").alias("unit_id"))
    return citations.mapping_issues(mappings, claims, units).select("code", "path")


@query(
    "e08_html_claims",
    """with f as (select page_id, list_filter(list_transform(regexp_extract_all(html, '(?i)<(?:p|h1|td|th|h2|h3|h4|h5|h6|li)(?:\\s[^>]*)?>([^<]+)</(?:p|h1|td|th|h2|h3|h4|h5|h6|li)>', 1),
      lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'), ' ')), lambda x: x <> '') as c from pages)
    select page_id, n, c[n] as text from (select page_id, c, unnest(range(1, len(c) + 1)) as n from f)""",
)
def e08(t: Tables) -> DataFrame:
    found = citations.flat_claims(t.pages, "page_id", "html")
    return found.select("page_id", F.col("n").cast("bigint").alias("n"), "text")


@query("e08_nested_claims")
def e08_nested(t: Tables) -> DataFrame:
    return citations.html_claims(t.pages, "page_id", "html")


@query(
    "e12_literal_fields",
    """with p as (select page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) as heading, regexp_extract(html, '<title>([^<]*)</title>', 1) as title,
      regexp_replace(html, '<[^>]+>', ' ', 'g') as said, split_part(split_part(url, '/', 3), '.', 2) as publisher from pages)
    select page_id, heading, heading = '' or contains(said, heading) as in_text, publisher = '' or contains(said, publisher) as publisher_in_text from p""",
)
def e12(t: Tables) -> DataFrame:
    said = F.regexp_replace("html", r"<[^>]+>", " ")
    heading = F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)
    host = F.split_part(F.split_part("url", F.lit("/"), F.lit(3)), F.lit("."), F.lit(2))
    return t.pages.select(
        "page_id", heading.alias("heading"), citations.literal_field(heading, said).alias("in_text"),
        citations.literal_field(host, said).alias("publisher_in_text"),
    )


@query("e13_batches", "select s_suppkey, (row_number() over (order by s_suppkey) - 1) // 20 as batch from supplier")
def e13(t: Tables) -> DataFrame:
    return citations.in_batches(t.supplier.select("s_suppkey"), SUPPLIERS, 20)


@query(
    "e14_batch_keys",
    """with b as (select *, (row_number() over (order by s_suppkey) - 1) // 20 as batch from supplier)
    select batch, sha256(',' || string_agg(sha256(s_suppkey || chr(1) || s_name), ',' order by s_suppkey)) as cache_key from b group by 1""",
)
def e14(t: Tables) -> DataFrame:
    batches = citations.in_batches(t.supplier.select("s_suppkey", "s_name"), SUPPLIERS, 20)
    return citations.batch_keys(batches, "batch", "s_suppkey", ["s_suppkey", "s_name"])


@query(
    "e15_reference_marks",
    f"""with {RESOLVED_SQL} select o_orderkey as claim_id, coalesce('[' || m || ']', '') as mark from orders left join (
      select claim_id, string_agg(number, ',' order by number) as m from resolved group by 1) on claim_id = o_orderkey""",
)
def e15(t: Tables) -> DataFrame:
    return citations.reference_marks(resolved(t), t.orders.select(F.col("o_orderkey").alias("claim_id")))
