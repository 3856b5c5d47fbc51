"""Search and ranking over the given tables: documents are the corpus, benchmark items the
queries, embeddings the vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import embed, topk
from quire.functions.scan import each, top_rows
from quire.operators import facts, retrieval
from quire.plans.memory import MEMORY_SQL, memory_rows
from quire.plans.registry import Tables, query
from quire.session import cut

TOKEN = "[a-z][a-z0-9]+|[一-鿿㐀-䶿豈-﫿]"
TOKENS_SQL = f"""
  toks as (select doc_id, regexp_extract_all(lower(text), '{TOKEN}') as w from documents),
  post as (select doc_id, len(w) as dl, unnest(w) as term from toks),
  tf as (select doc_id, term, dl, count(*) as tf from post group by 1, 2, 3),
  q as (select item_id as query_id, unnest(regexp_extract_all(lower(text), '{TOKEN}')) as term from benchmark),
  qt as (select query_id, term, count(*) as qw from q group by 1, 2)
"""
BM25_SQL = f"""{TOKENS_SQL},
  st as (select count(*) as n, avg(len(w)) as avgdl from toks where len(w) > 0),
  df as (select term, count(*) as df from tf group by 1),
  sc as (select query_id, doc_id as id, round(sum(qw * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score
    from qt join tf using (term) join df using (term), st group by 1, 2),
  bm as (select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank from sc where score > 0)
"""


def requests(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


def ranked(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "f01_token_counts",
    f"""with {TOKENS_SQL} select doc_id, len(w) as tokens, len(list_distinct(w)) as distinct_tokens from toks""",
)
def f01(t: Tables) -> DataFrame:
    return retrieval.token_counts(t.documents, "doc_id", "text")


@query(
    "f02_bm25_index",
    f"""with {TOKENS_SQL}, lt as (select term, lang, count(*) as df from tf join documents using (doc_id) group by 1, 2),
    st as (select lang, count(*) as docs, round(avg(len(w)), 6) as average from toks join documents using (doc_id) where len(w) > 0 group by 1)
    select lang, term, df, docs, average from lt join st using (lang)""",
)
def f02(t: Tables) -> DataFrame:
    stats = retrieval.index_stats(t.documents, "doc_id", "text", keep=["lang"])
    return retrieval.index_terms(t.documents, "text", ["lang"]).join(stats, "lang").select("lang", "term", "df", "docs", F.round("average", 6).alias("average"))


@query("f03_bm25_search", f"with {BM25_SQL} select query_id, id, score, rank from bm where rank <= 10")
def f03(t: Tables) -> DataFrame:
    asked = requests(t)
    return ranked(retrieval.bm25(t.documents, "doc_id", "text", asked, 10, few=retrieval.few_terms(asked)))


CENTROID_SQL = """
  parts as (select vec_id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings),
  cent as (select label, i, avg(x) as c from parts group by 1, 2)
"""


def centroids(t: Tables) -> DataFrame:
    """Mean vector of every label: a partial aggregate by (label, position)."""
    cells = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    means = cells.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("c"))
    return means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("vector"))


@query(
    "f04_vector_search",
    f"""with {CENTROID_SQL}, d as (select c.label as query_id, vec_id as id, round(1 - sum((x - c) * (x - c)), 6) as score from parts p join cent c on p.i = c.i group by 1, 2),
    r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from d)
    select query_id, id, score, rank from r where rank <= 10""",
)
def f04(t: Tables) -> DataFrame:
    queries = centroids(t).select(F.col("label").alias("query_id"), "vector")
    return ranked(retrieval.vector_search(t.embeddings, "vec_id", "embedding", queries, 10))


@query(
    "f05_cosine",
    f"""with {CENTROID_SQL} select vec_id, round(sum(x * c) / (sqrt(sum(x * x)) * sqrt(sum(c * c))), 6) as similarity
    from parts p join cent c on p.label = c.label and p.i = c.i group by 1""",
)
def f05(t: Tables) -> DataFrame:
    both = t.embeddings.join(centroids(t), "label")
    return both.select("vec_id", F.round(topk.cosine(F.col("embedding"), F.col("vector")), 6).alias("similarity"))


def by_column(df: DataFrame, key: str, id: str, order, k: int) -> DataFrame:
    """A ranking strategy over a table: the best k of each query group."""
    rows = df.select(F.col(key).alias("query_id"), F.col(id).alias("id"), order.cast("double").alias("score"))
    return top_rows(rows, ["query_id"], [F.desc("score"), F.col("id")], k)


RRF_SQL = """
  a as (select c_nationkey as query_id, c_custkey as id, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as rank from customer),
  b as (select c_nationkey as query_id, c_custkey as id, row_number() over (partition by c_nationkey order by length(c_mktsegment) desc, c_custkey) as rank from customer),
  u as (select *, 0 as list from a where rank <= 20 union all select *, 1 from b where rank <= 20),
  f as (select query_id, id, round(sum(1.0 / (60 + rank)), 9) as score, min(list * 1000 + rank) as first from u group by 1, 2),
  r as (select *, row_number() over (partition by query_id order by score desc, first, id) as rank from f)
"""


@query("f06_rank_fusion", f"with {RRF_SQL} select query_id, id, score, rank from r where rank <= 10")
def f06(t: Tables) -> DataFrame:
    a = by_column(t.customer, "c_nationkey", "c_custkey", F.col("c_acctbal"), 20)
    b = by_column(t.customer, "c_nationkey", "c_custkey", F.length("c_mktsegment"), 20)
    return ranked(retrieval.fuse([a, b], 10)).select("query_id", "id", "score", "rank")


@query(
    "f07_hybrid_search",
    f"""with {BM25_SQL},
    ov as (select query_id, doc_id as id, cast(count(*) as double) as score from (select distinct query_id, term from qt) join (select distinct doc_id, term from tf) using (term) group by 1, 2),
    o as (select *, row_number() over (partition by query_id order by score desc, id) as rank from ov),
    u as (select query_id, id, rank, 0 as list from bm where rank <= 10 union all select query_id, id, rank, 1 from o where rank <= 10),
    f as (select query_id, id, round(sum(1.0 / (60 + rank)), 9) as score, min(list * 1000 + rank) as first from u group by 1, 2),
    r as (select *, row_number() over (partition by query_id order by score desc, first, id) as rank from f)
    select query_id, id, score, rank from r where rank <= 5""",
)
def f07(t: Tables) -> DataFrame:
    asked = requests(t)
    scores = retrieval.lexical_scores(t.documents, "doc_id", "text", asked, few=retrieval.few_terms(asked))
    best = cut(retrieval.best_scores(scores, ["score", "shared"], 10))
    return ranked(retrieval.hybrid(best.where("list = 0"), best.where("list = 1"), 5))


@query(
    "f08_strategy_fusion",
    """with a as (select p_brand as query_id, p_partkey as id, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as rank from part),
    b as (select p_brand as query_id, p_partkey as id, row_number() over (partition by p_brand order by p_size desc, p_partkey) as rank from part),
    c as (select p_brand as query_id, p_partkey as id, row_number() over (partition by p_brand order by length(p_name) desc, p_partkey) as rank from part),
    u as (select *, 0 as list from a where rank <= 15 union all select *, 1 from b where rank <= 15 union all select *, 2 from c where rank <= 15),
    f as (select query_id, id, round(sum(1.0 / (60 + rank)), 9) as score, min(list * 1000 + rank) as first from u group by 1, 2),
    r as (select *, row_number() over (partition by query_id order by score desc, first, id) as rank from f)
    select query_id, id, score, rank from r where rank <= 8""",
)
def f08(t: Tables) -> DataFrame:
    brands = t.part.select(F.col("p_brand").alias("query_id")).distinct()

    def strategy(order):
        return lambda q: by_column(t.part, "p_brand", "p_partkey", order, 15).join(q, "query_id", "left_semi")

    plans = [
        retrieval.Search("price", strategy(F.col("p_retailprice"))),
        retrieval.Search("size", strategy(F.col("p_size"))),
        retrieval.Search("name", strategy(F.length("p_name"))),
    ]
    return ranked(retrieval.fused_search(brands, plans, 8)).select("query_id", "id", "score", "rank")


@query(
    "f09_trigram_match",
    """with q as (select distinct left(p_type, 4) as query_id, lower(substr(p_type, 2, 3)) as text from part),
    h as (select query_id, p_partkey, row_number() over (partition by query_id order by length(p_name), p_partkey) as rank
      from q join part on contains(lower(p_name || ' ' || p_type), text) where length(text) >= 3)
    select query_id, p_partkey, rank from h where rank <= 25""",
)
def f09(t: Tables) -> DataFrame:
    queries = t.part.select(F.left("p_type", F.lit(4)).alias("query_id"), F.lower(F.substring("p_type", 2, 3)).alias("text")).distinct()
    rows = t.part.select("p_partkey", "p_name", F.concat_ws(" ", "p_name", "p_type").alias("said"))
    found = retrieval.trigram_search(rows, "p_partkey", "said", queries, 25, [F.length("p_name"), F.col("p_partkey")])
    return ranked(found).select("query_id", "p_partkey", "rank")


@query(
    "f10_like_search",
    """select p_partkey, p_name, p_retailprice from part where (contains(lower(p_name), 'ring') or contains(lower(p_type), 'ring')) and p_size > 10
    order by p_retailprice desc, p_partkey limit 20""",
)
def f10(t: Tables) -> DataFrame:
    order = [F.desc("p_retailprice"), F.col("p_partkey")]
    found = retrieval.like_search(t.part, ["p_name", "p_type"], "ring", order, 20, F.col("p_size") > 10)
    return found.select("p_partkey", "p_name", "p_retailprice")


@query(
    "f11_newest_in_scope",
    """select o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey from orders
    where o_orderpriority = '1-URGENT' or (o_orderpriority = '2-HIGH' and o_orderstatus = 'O') group by 1""",
)
def f11(t: Tables) -> DataFrame:
    scope = F.when(F.col("o_orderpriority") == "1-URGENT", "global").otherwise(F.col("o_orderpriority"))
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", scope.alias("scope"), F.col("o_orderstatus").alias("value"))
    open_rows = retrieval.in_context(rows, "scope", "value", {"2-HIGH": "O"})
    return retrieval.newest_per_key(open_rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query(
    "f12_second_round",
    """with a as (select p_brand as query_id, p_partkey as id, p_size / 50.0 as score, row_number() over (partition by p_brand order by p_size desc, p_partkey) as rank from part where p_size >= 48),
    f as (select * from a where rank <= 4),
    need as (select distinct p_brand as query_id from part where p_brand not in (select query_id from f group by 1 having max(case when rank = 1 then score end) > 0.97 or count(*) >= 4)),
    b as (select p_brand as query_id, p_partkey as id, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as rank from part),
    u as (select query_id, id, 0 as list, rank from f union all select b.query_id, id, 1, rank from b join need using (query_id) where rank <= 4),
    o as (select query_id, id, min(list * 1000 + rank) as pos from u group by 1, 2),
    r as (select *, row_number() over (partition by query_id order by pos, id) as rank from o)
    select query_id, id, cast(pos // 1000 as bigint) as list, rank from r where rank <= 5""",
)
def f12(t: Tables) -> DataFrame:
    brands = t.part.select(F.col("p_brand").alias("query_id")).distinct()
    first = by_column(t.part.where(F.col("p_size") >= 48), "p_brand", "p_partkey", F.col("p_size") / 50.0, 4)
    need = retrieval.needs_second_round(brands, first, score=0.97, hits=4)
    second = by_column(t.part, "p_brand", "p_partkey", F.col("p_retailprice"), 4).join(need, "query_id", "left_semi")
    return ranked(retrieval.merge_rounds(first, [second], 5)).withColumn("list", F.col("list").cast("bigint"))


@query(
    "f13_four_paths",
    f"""with {MEMORY_SQL}, p as (
      (select event_id, score from valued where event_type = 'view' order by value desc, event_id limit 40)
      union all (select event_id, score from valued where contains(cast(k as varchar), '42') order by confidence desc, event_id limit 40)
      union all (select event_id, score from valued where event_type = 'error' and confidence >= 0.8 order by confidence desc, ts desc limit 5)
      union all (select event_id, score from valued where user_id in (select user_id from events where event_id = 7) order by confidence desc, event_id limit 5))
    select event_id, round(max(score), 6) as score from p group by 1 order by 2 desc, 1 limit 8""",
)
def f13(t: Tables) -> DataFrame:
    rows = memory_rows(t).withColumn("props_k", F.round(F.col("confidence") * 100).cast("int").cast("string"))
    users = t.events.where(F.col("event_id") == 7).select("user_id")
    paths = [
        rows.where(F.col("event_type") == "view").orderBy(F.desc("value"), "event_id").limit(40),
        rows.where(F.col("props_k").contains("42")).orderBy(F.desc("confidence"), "event_id").limit(40),
        rows.where((F.col("event_type") == "error") & (F.col("confidence") >= 0.8)).orderBy(F.desc("confidence"), F.desc("ts")).limit(5),
        rows.join(users, "user_id", "left_semi").orderBy(F.desc("confidence"), "event_id").limit(5),
    ]
    slim = [p.select("event_id", F.round("score", 6).alias("score")) for p in paths]
    return retrieval.four_paths(slim, "event_id", "score", 8)


@query("f14_decayed_value", f"with {MEMORY_SQL} select event_id, round(score, 6) as score from valued")
def f14(t: Tables) -> DataFrame:
    return memory_rows(t).select("event_id", F.round("score", 6).alias("score"))


@query(
    "f15_role_tiers",
    """select * from (select 'errors' as tier, event_id from events where event_type = 'error' order by value desc, event_id limit 10)
    union all select * from (select 'own', event_id from events where event_type in ('view', 'click') and event_type <> 'click' order by value desc, event_id limit 5)
    union all select * from (select 'patterns', event_id from events where event_type in ('purchase', 'signup') order by value desc, event_id limit 5)""",
)
def f15(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "value", F.array("event_type").alias("tags"))
    tiers = [("errors", ["error"], ["click"], 10), ("own", ["view", "click"], ["click"], 5), ("patterns", ["purchase", "signup"], [], 5)]
    return retrieval.tier_rows(rows, tiers, "tags", [F.desc("value"), F.col("event_id")]).select("tier", "event_id")


@query(
    "f16_same_project",
    """select o_orderkey from orders join customer on o_custkey = c_custkey where c_nationkey in (select c_nationkey from customer where c_name = 'Customer#000000007')""",
)
def f16(t: Tables) -> DataFrame:
    groups = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_name")
    return retrieval.same_group(t.orders, "o_custkey", groups, "c_nationkey", F.col("c_name") == "Customer#000000007").select("o_orderkey")


@query(
    "f17_quota_selection",
    """with pool as (select *, row_number() over (order by value desc, event_id) as place from events),
    n as (select *, row_number() over (partition by event_type order by place) as nth from pool),
    p as (select *, case when nth <= case event_type when 'error' then 2 when 'view' then 2 when 'click' then 4 else 0 end then 1 else 2 end as phase from n
      where nth <= case event_type when 'click' then 6 else 1000000 end),
    r as (select *, row_number() over (order by phase, place) as pick from p)
    select event_id, event_type, phase, pick from r where pick <= 14""",
)
def f17(t: Tables) -> DataFrame:
    got = retrieval.quota_pick(
        t.events, "event_type", {"error": 2, "view": 2, "click": 4}, {"click": 6}, 14, [F.desc("value"), F.col("event_id")]
    )
    return got.select("event_id", "event_type", F.col("phase").cast("bigint").alias("phase"), F.col("pick").cast("bigint").alias("pick"))


EXPERIENCE_SQL = """
  e as (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events),
  c as (select e.*, u.user_id as query_id, row_number() over (partition by u.user_id order by k desc, e.value desc, e.event_id) as rank
    from e join (select user_id, min(event_type) as tool from events group by 1) u on e.event_type = u.tool and e.user_id = u.user_id)
"""


@query(
    "f18_two_layer_retrieval",
    f"""with {EXPERIENCE_SQL} select query_id, event_id, round(value / 200 * 0.55 + 0.5 * 0.20 + least(1.0, value / 100) * 0.15 + least(greatest(k, 1), 10) / 10.0 * 0.10
      + 0.05 + 0.05 + case when k >= 90 then 0.10 else 0.03 end, 9) as score, rank from c where rank <= 30""",
)
def f18(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    tools = t.events.groupBy("user_id").agg(F.min("event_type").alias("tool"))
    # The signature carries the user, so a query meets its own rows only.
    stored = t.events.select("event_id", "value", k.alias("k"), F.concat_ws("@", "event_type", "user_id").alias("chain_signature"))
    queries = tools.select(F.col("user_id").alias("query_id"), F.concat_ws("@", "tool", "user_id").alias("tool"))
    best = retrieval.coarse_candidates(stored, queries, [F.desc("k"), F.desc("value"), F.col("event_id")])
    role = F.when(F.col("k") >= 90, "fallback").otherwise("primary")
    score = retrieval.experience_score(
        F.col("value") / 200, F.lit(0.5), F.col("value") / 100, F.col("k"), F.lit(True), F.lit(True), role, F.lit(True)
    )
    return ranked(best.withColumn("score", F.round(score, 9))).select("query_id", "event_id", "score", "rank")


@query(
    "f19_experience_role",
    """select event_id, case when event_type = 'error' then 'anti_pattern' when event_type = 'signup' then 'fallback' else 'primary' end as role,
      coalesce(value > 50, false) or contains(event_type, 'error') as risky from events""",
)
def f19(t: Tables) -> DataFrame:
    anti = F.when(F.col("event_type") == "error", "do not").otherwise(" ")
    said = F.when(F.col("event_type") == "signup", "use the Fallback path").otherwise(F.col("event_type"))
    return t.events.select(
        "event_id", retrieval.experience_role(anti, said).alias("role"),
        retrieval.risky(F.col("value") > 50, F.lit(0), F.col("event_type")).alias("risky"),
    )


OVERLAP_SQL = f"""{TOKENS_SQL},
  qs as (select query_id, count(*) as qn from qt group by 1), ds as (select doc_id, len(list_distinct(w)) as dn from toks),
  ov as (select query_id, doc_id, count(*) as n from qt join tf using (term) group by 1, 2)
"""


@query(
    "f20_keyword_overlap",
    f"""with {OVERLAP_SQL}, s as (select query_id, doc_id as id, round(n / greatest(qn, least(dn, 8), 1), 6) as score from ov join qs using (query_id) join ds using (doc_id)),
    r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from s)
    select query_id, id, score, rank from r where rank <= 10""",
)
def f20(t: Tables) -> DataFrame:
    return ranked(retrieval.overlap_ratio(t.documents, "doc_id", "text", requests(t), 10))


@query("f21_diverse_pick")
def f21(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    scored = t.events.select(
        F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), (F.col("value") / 100).alias("score"),
        F.when(k >= 80, "anti_pattern").when(k >= 60, "fallback").otherwise("primary").alias("role"),
        F.col("event_type").alias("signature"), F.array(F.col("event_type"), (k / 10).cast("int").cast("string")).alias("terms"),
        F.lit(True).alias("risk"),
    )
    return retrieval.diverse_pick(scored)


@query(
    "f22_overlap_search",
    f"""with {OVERLAP_SQL}, r as (select query_id, doc_id as id, cast(n as double) as score, row_number() over (partition by query_id order by n desc, doc_id) as rank from ov)
    select query_id, id, score, rank from r where rank <= 5""",
)
def f22(t: Tables) -> DataFrame:
    return ranked(retrieval.overlap_search(t.documents, "doc_id", "text", requests(t), 5))


@query(
    "f23_nearest_prototype",
    f"""with {CENTROID_SQL}, n as (select label, sqrt(sum(c * c)) as nc from cent group by 1),
    s as (select vec_id, c.label, round(sum(x * c) / (sqrt(sum(x * x)) * max(nc)), 6) as sim from parts p join cent c on p.i = c.i join n on n.label = c.label group by 1, 2),
    r as (select *, row_number() over (partition by vec_id order by sim desc, 'label ' || label) as rn from s)
    select vec_id, case when sim > 0.35 then 'label ' || label else 'general' end as name, case when sim > 0.35 then sim else 0 end as similarity from r where rn = 1""",
)
def f23(t: Tables) -> DataFrame:
    prototypes = centroids(t).select(F.concat(F.lit("label "), F.col("label")).alias("name"), "vector")
    matched = topk.nearest_prototype(t.embeddings.select("vec_id", "embedding"), "embedding", prototypes, 0.35)
    return matched.select("vec_id", F.col("matches")[0]["name"].alias("name"), F.col("matches")[0]["similarity"].alias("similarity"))


@query(
    "f24_keyword_class",
    """with s as (select doc_id, (contains(lower(text), 'the')::int + contains(lower(text), 'tion')::int) as en, (contains(lower(text), 'eau')::int + contains(lower(text), 'ment')::int) as fr,
      (contains(lower(text), 'sch')::int + contains(lower(text), 'lich')::int + contains(lower(text), 'ung')::int) as de from documents)
    select doc_id, case when greatest(en, fr, de) = 0 then 'general' when en >= fr and en >= de then 'en' when fr >= de then 'fr' else 'de' end as class from s""",
)
def f24(t: Tables) -> DataFrame:
    lexicon = [("en", ["the", "tion"]), ("fr", ["eau", "ment"]), ("de", ["sch", "lich", "ung"])]
    return t.documents.select("doc_id", retrieval.keyword_class(F.col("text"), lexicon, "general").alias("class"))


@query(
    "f26_template_search",
    """select event_id, tier from (select *, case when json_extract_string(props, '$.k') = '17' then 0 else 2 end as tier from events where json_extract_string(props, '$.k') = '17')
    order by case when event_type = 'view' then strftime(ts, '%Y-%m-%d') else '2024-01-01' end desc, event_id limit 10""",
)
def f26(t: Tables) -> DataFrame:
    rows = t.events.select(
        F.col("event_id").alias("template_id"), F.col("props").alias("style"),
        F.when(F.col("event_type") == "view", F.date_format("ts", "yyyy-MM-dd")).otherwise("").alias("last_used"), F.lit("2024-01-01").alias("updated"),
    )
    found = retrieval.template_search(rows, "k", "17", None, 10)
    return found.select(F.col("template_id").alias("event_id"), F.col("tier").cast("bigint").alias("tier"))


@query(
    "f27_fallback_ladder",
    """with t as (select *, case when o_orderstatus = 'F' and o_orderpriority = '1-URGENT' then 0 when o_orderstatus = 'F' then 1 else 2 end as tier from orders),
    m as (select *, min(tier) over (partition by o_custkey) as best from t),
    r as (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as rn from m where tier = best)
    select o_custkey, o_orderkey, cast(tier as bigint) as tier from r where rn <= 2""",
)
def f27(t: Tables) -> DataFrame:
    done, urgent = F.col("o_orderstatus") == "F", F.col("o_orderpriority") == "1-URGENT"
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    got = retrieval.ladder(rows, ["o_custkey"], [done & urgent, done, F.lit(True)], [F.desc("o_orderdate"), F.col("o_orderkey")], 2)
    return got.select("o_custkey", "o_orderkey", F.col("tier").cast("bigint").alias("tier"))


@query("f28_distinct_embedding", "select doc_id, 64 as width from documents")
def f28(t: Tables) -> DataFrame:
    done = embed.embed_distinct(t.documents.select("doc_id", "text"), "text")
    return done.select("doc_id", F.size("vector").alias("width"))


@query(
    "f29_cluster_neighbours",
    """with tr as (select *, row_number() over (partition by event_type order by floor(value / 20) desc, value desc, ts desc, event_id) as n,
        floor(value / 10) as band, json_extract_string(props, '$.k') as k from events),
    cl as (select user_id, event_type, arg_max(json_extract_string(props, '$.k'), event_id) as k, floor(arg_max(value, event_id) / 10) as band from events group by 1, 2),
    s as (select cl.user_id, cl.event_type, tr.event_id, round(0.45 + case when cl.k = tr.k then 0.35 else 0 end + case when cl.band = tr.band then 0.2 else 0 end, 6) as score
      from cl join tr using (event_type) where n <= 25),
    r as (select *, row_number() over (partition by user_id, event_type order by score desc, event_id) as rank from s)
    select user_id || ' ' || event_type as cluster_id, event_id as id, score, rank from r where rank <= 3""",
)
def f29(t: Tables) -> DataFrame:
    k, band = F.get_json_object("props", "$.k"), F.floor(F.col("value") / 10).cast("string")
    traces = t.events.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("category"), F.array("event_type").alias("tools"), F.array(k).alias("keywords"),
        F.array(band).alias("words"), F.floor(F.col("value") / 20).alias("reuse"), F.col("value").alias("confidence"), F.col("ts").alias("created"),
    )
    last = t.events.groupBy("user_id", "event_type").agg(F.max_by(k, "event_id").alias("k"), F.max_by(band, "event_id").alias("band"))
    clusters = last.select(
        F.concat_ws(" ", "user_id", "event_type").alias("cluster_id"), F.col("event_type").alias("category"), F.array("event_type").alias("tools"),
        F.array("k").alias("keywords"), F.array("band").alias("words"),
    )
    return ranked(retrieval.cluster_neighbours(clusters, traces))


@query(
    "c31_lexical_winner",
    f"""with {OVERLAP_SQL.replace(TOKEN, '[a-z0-9]{{2,}}')}, r as (select query_id, doc_id, n, row_number() over (partition by query_id order by n desc, doc_id) as rn from ov),
    b as (select query_id, max(case when rn = 1 then doc_id end) as id, max(case when rn = 1 then n end) as top, max(case when rn = 2 then n end) as second from r where rn <= 2 group by 1)
    select query_id, id, cast(top as double) as score, cast(coalesce(second, 0) as double) as second from b where case when second is null then top >= 1 else top >= 2 and top - second >= 2 end""".replace(
        "'[a-z0-9]{{2,}}'", "'[a-z0-9]{2,}'"
    ),
)
def c31(t: Tables) -> DataFrame:
    def terms(text):
        return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{2,}"), F.lit(0)))

    own = each(t.documents, terms(F.col("text")), "term", ["doc_id", F.lit(1.0).alias("weight")])
    asked = each(requests(t), terms(F.col("text")), "term", ["query_id", F.lit(1.0).alias("weight")])
    scores = topk.sparse_topk(own, "doc_id", asked, 2)
    return facts.clear_winner(scores.drop("rank"), "query_id", "id", "score").select(
        "query_id", "id", "score", F.coalesce("second", F.lit(0.0)).alias("second")
    )


@query("k01_embedding")
def k01(t: Tables) -> DataFrame:
    rows = t.benchmark.select("item_id", embed.embedding(F.col("text")).alias("vector"))
    return rows.select("item_id", F.size("vector").alias("width"), F.round(topk.cosine(F.col("vector"), F.col("vector")), 6).alias("self"))


@query(
    "f25_dimension_ladder",
    """select doc_id, case when regexp_matches(lower(text), 'ation') then 'theme' when regexp_matches(lower(text), 'sch') then 'layout' else 'all' end as dims from documents""",
)
def f25(t: Tables) -> DataFrame:
    near = F.when(F.lower("text").contains("ation"), F.array(F.lit("theme"), F.lit("visual"))).otherwise(F.array(F.lit("visual")))
    word = F.when(F.lower("text").contains("sch"), "layout").otherwise("general")
    filled = F.array(F.lit("theme"), F.lit("layout"))
    got = retrieval.dimension_ladder(near, word, filled)
    return t.documents.select("doc_id", F.coalesce(F.array_join(got, ","), F.lit("all")).alias("dims"))


