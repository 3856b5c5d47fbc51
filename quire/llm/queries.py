"""The registered queries of this folder and the DuckDB SQL that states the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import spread, table


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"), "doc_id")


def op1_suffix_index(spark: SparkSession, folder: str) -> DataFrame:
    from quire.llm.suffix_index import without_repeats

    return without_repeats(_documents(spark, folder)).drop("kept")


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    from quire.llm.simhash import near_duplicates

    return near_duplicates(_documents(spark, folder))


def op3_language(spark: SparkSession, folder: str) -> DataFrame:
    from quire.llm.language import language_ids

    return language_ids(_documents(spark, folder))


def op4_vectors(spark: SparkSession, folder: str) -> DataFrame:
    from quire.llm.vectors import near_vectors

    return near_vectors(spread(table(spark, folder, "embeddings"), "vec_id"))


def op5_disclosure(spark: SparkSession, folder: str) -> DataFrame:
    from quire.llm.disclosure import personal_data

    return personal_data(_documents(spark, folder))


def op6_line_rules(spark: SparkSession, folder: str) -> DataFrame:
    from quire.llm.line_rules import line_rules

    return line_rules(_documents(spark, folder))


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from quire.llm.mixing import mix_rates

    rated = mix_rates(_documents(spark, folder))
    taken = (F.col("mix.size") * F.col("mix.n_copies")).alias("taken")
    return rated.select("doc_id", "mix.size", "mix.source_size", "mix.target", taken, "mix.n_copies")


def op8_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from quire.llm.byte_bpe import tokenized

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return tokenized(_documents(spark, folder), path, public_tokenizers.PATTERN, with_ids=False).drop("ids")


def op9_passages(spark: SparkSession, folder: str) -> DataFrame:
    from quire.llm.passages import quality

    return quality(_documents(spark, folder), table(spark, folder, "labels"))


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    from quire.llm.warc import read_archives, resolved, write_archives

    path = write_archives(spread(table(spark, folder, "pages"), "page_id"))
    return resolved(read_archives(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_lexical(spark: SparkSession, folder: str) -> DataFrame:
    from quire.llm.lexical import ranked

    return ranked(_documents(spark, folder), table(spark, folder, "benchmark"))


def op12_merkle(spark: SparkSession, folder: str) -> DataFrame:
    from quire.llm.merkle import manifest

    return manifest(_documents(spark, folder))


def op13_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from quire.llm.toxicity import toxicity

    return toxicity(_documents(spark, folder), table(spark, folder, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_index, op2_simhash, op3_language, op4_vectors, op5_disclosure, op6_line_rules, op7_mixing, op8_byte_bpe, op9_passages, op10_warc,
        op11_lexical, op12_merkle, op13_toxicity,
    )
}

SQL = {
    "op1_suffix_index": """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
w as (select doc_id, p, md5(array_slice(h, 2 * p + 1, 2 * p + 200)) as k from d, unnest(range(0, n - 99)) as t(p)),
dup as (select doc_id, p from w qualify row_number() over (partition by k order by doc_id, p) > 1),
cut as (select *, coalesce(p > lag(p) over (partition by doc_id order by p) + 100, true) as new from dup),
num as (select *, sum(new::int) over (partition by doc_id order by p) as run from cut),
runs as (select doc_id, run, min(p) as a, max(p) + 100 as z from num group by 1, 2),
gaps as (select *, coalesce(lag(z) over (partition by doc_id order by a), 0) as last from runs),
kept as (select doc_id, count(*) as n_spans, sum(z - a) as n_removed, max(z) as z, string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' order by a) as head
  from gaps join d using (doc_id) group by doc_id)
select doc_id, cast(n as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans,
  sha256(unhex(coalesce(head || substr(h, 2 * z + 1), h))) as kept_sha256 from d left join kept using (doc_id)""",
    "op4_vectors": """
with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings where label is not null and embedding is not null),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.98),
r as (select vec_id, vec_id as other from embeddings union select r.vec_id, l.b from r join l on r.other = l.a),
n as (select a, count(*) as n from l group by a)
select vec_id, cast(coalesce(max(n), 0) as bigint) as n_links, min(other) as component_id, vec_id = min(other) as kept
from r left join n on n.a = r.vec_id group by vec_id""",
    "op6_line_rules": r"""
with d as (select row_number() over () as rid, doc_id, coalesce(source, chr(0)) as host, coalesce(text, '') as text from documents),
w as (select rid, doc_id, host, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
  string_split(text, chr(10)) as lines from d),
l as (select rid, host, unnest(lines) as line, unnest(range(len(lines))) as pos from w),
lw as (select rid, host, line, pos, translate(array_to_string(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> ''), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm,
  len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) as n from l),
dup as (select rid, count(*) - count(distinct line) as n_dup_lines from lw where n > 0 group by rid),
common as (select host, norm from lw where n > 0 group by all having count(distinct rid) > 50),
gone as (select rid, sum(n) as removed from lw join common using (host, norm) where n > 0 group by rid),
g as (select rid, unnest(range(1, len(words) - 3)) as i, words from w where len(words) >= 5),
g5 as (select rid, i, array_to_string(words[i:i + 4], ' ') as gram from g),
rep as (select rid, i from g5 qualify count(*) over (partition by rid, gram) > 1),
hit as (select rid, count(distinct i + k) as n from rep, unnest(range(5)) as r(k) group by rid),
m as (select doc_id, len(words) as n_words,
  length(text) - length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')) as word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
  coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(hit.n, 0) as n_repeat_words, coalesce(removed, 0) as removed
  from w left join dup using (rid) left join hit using (rid) left join gone using (rid)),
f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  removed > 0 and (n_words - removed < 10 or n_words - removed < 0.3 * n_words) as depleted from m)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
  cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
  not base_failed and not depleted as kept, cast(removed as bigint) as removed_words from f""",
    "op10_warc": """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as d from pages),
f as (select d, min(page_id) as first from p where n >= 100 group by d)
select page_id, cast(n as bigint) as payload_bytes, d as payload_digest,
  case when n >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
  case when n >= 100 and page_id <> first then first end as refers_to
from p left join f using (d)""",
    "op11_lexical": r"""
with t as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
tf as (select doc_id, term, count(*) as tf from t group by all),
n as (select doc_id, cast(sum(tf) as bigint) as n from tf group by all),
c as (select count(*) as docs, cast(sum(n) as bigint) as l from n),
w as (select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) as bigint) as w from tf, c group by term, docs),
q as (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
qt as (select item_id, term, count(*) as times from q group by all),
s as (select item_id, doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // l))))) as bigint) as score
  from qt join tf using (term) join w using (term) join n using (doc_id), c group by all)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score from s where score > 0
qualify rank <= 10""",
    "op12_merkle": """
with recursive d as (select row_number() over () as rid, *, coalesce(xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, len(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i, 1))::bigint)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), list_value(0, 0, 0, 0, 0, 0, 0, 0)::bigint[]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 5 = 0, false) as bad,
    concat(coalesce(len(doc_id::varchar) || ':' || doc_id, '-'), coalesce(octet_length(encode(source)) || ':' || source, '-'),
      coalesce(octet_length(encode(lang)) || ':' || lang, '-'), coalesce(len(n_chars::varchar) || ':' || n_chars, '-')) as head,
    coalesce(octet_length(encode(text)) || ':', '-') as size from documents),
f as (select rid, doc_id, source, sha256(concat(head, size, text)) as leaf,
    case when bad then sha256(concat(head, size, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) end as changed from d),
p as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by source) as n from f),
t as (select source, 0 as k, pos, n, leaf as node from p
  union all select source, k + 1, pos // 16, (n + 15) // 16, sha256(string_agg(node, '' order by pos)) from t where n > 1 group by source, k, pos // 16, n),
s as (select source, node as subroot, row_number() over (order by source nulls first) - 1 as seat, count(*) over () as n from t where n = 1),
g as (select 0 as k, seat as pos, n, subroot as node from s
  union all select k + 1, pos // 16, (n + 15) // 16, sha256(string_agg(node, '' order by pos)) from g where n > 1 group by k, pos // 16, n),
tr as (select source, k, pos // 16 as run, list(node order by pos) as nodes from t where n > 1 group by all),
gr as (select k, pos // 16 as run, list(node order by pos) as nodes from g where n > 1 group by all),
steps as (select rid, 0 as tier, k, nodes, (pos >> (4 * k)) % 16 as own from p join tr on p.source is not distinct from tr.source and run = pos >> (4 * k + 4)
  union all select rid, 1, k, nodes, (seat >> (4 * k)) % 16 from p join s on p.source is not distinct from s.source join gr on run = seat >> (4 * k + 4)),
sides as (select rid, row_number() over (partition by rid order by tier, k) as i, array_to_string(nodes[1:own], '') as l, array_to_string(nodes[own + 2:16], '') as r from steps),
fold as (select rid, 1 as i, coalesce(changed, leaf) as node from f union all select rid, i + 1, sha256(l || node || r) from fold join sides using (rid, i)),
done as (select rid, arg_max(node, i) as folded_root from fold group by rid),
proof as (select rid, sha256(string_agg(l || r, '' order by i)) as proof from sides group by rid)
select doc_id, leaf, subroot, g.node as root, coalesce(proof, sha256('')) as proof_sha256, folded_root, folded_root = g.node as verified
from p join s on p.source is not distinct from s.source join done using (rid) left join proof using (rid), g where g.n = 1""",
}
