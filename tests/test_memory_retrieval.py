import random
import re
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import embed, graph, topk
from quire.operators import memory, retrieval


def test_similar_clusters_match_a_plain_loop(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(6, 8))
    vecs = [(base[i % 6] + rng.normal(scale=0.15, size=8)).tolist() for i in range(60)]
    df = spark.createDataFrame([("u", i, v) for i, v in enumerate(vecs)], "user string, id long, v array<double>")
    got = {r["id"]: r["cluster"] for r in memory.similar_clusters(df, ["user"], "id", "v", ["id"]).collect()}
    m = np.array(vecs)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want, used = {}, set()
    for i in range(60):
        if i in used:
            continue
        members = [i]
        for j in range(i + 1, 60):
            if j not in used and len(members) < 5 and all(m[k] @ m[j] >= 0.8 for k in members):
                members.append(j)
        used.update(members)
        want.update({j: i for j in members})
    assert got == want


def test_blocks_do_not_change_clusters(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vecs = rng.normal(size=(150, 3)).tolist()
    df = spark.createDataFrame([("u", i, v) for i, v in enumerate(vecs)], "user string, id long, v array<double>")
    sets = df.select("user", "id", F.array(F.col("id") % 5).alias("t"), F.array(F.col("id") % 3).alias("k"), F.array(F.col("id") % 7).alias("w"))

    def both():
        return (
            sorted(map(tuple, memory.similar_clusters(df, ["user"], "id", "v", ["id"]).collect())),
            sorted(map(tuple, memory.overlap_clusters(sets, ["user"], "id", ["t", "k", "w"], ["id"]).collect())),
        )

    whole = both()
    monkeypatch.setattr(memory, "links", lambda *a: graph.links(*a, block_rows=16))
    assert both() == whole
    part = [[], []]
    for i in range(150):
        home = next((c for c in part[1] if any(0.45 * (i % 5 == j % 5) + 0.35 * (i % 3 == j % 3) + 0.2 * (i % 7 == j % 7) >= 0.58 for j in c)), None)
        if home is None:
            home = []
            part[1].append(home)
        home.append(i)
    assert whole[1] == sorted((i, c[0]) for c in part[1] for i in c)


def test_small_keys_are_walked_where_they_are_compared(spark, monkeypatch):
    rng = random.Random(7)
    words = [None, *"abc"]
    data = [(rng.choice([None, *"uvwxyz"]) if i % 3 else "big", i * 7 % 400, *[rng.sample(words, rng.randrange(0, 4)) for _ in range(3)]) for i in range(400)]
    df = spark.createDataFrame(data, "user string, id long, t array<string>, k array<string>, w array<string>")
    want, parts = {}, {}
    for user, i, *own in sorted(data, key=lambda r: r[1]):
        groups = parts.setdefault(user, [])

        def score(other):
            return sum(p * (len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 0) for p, a, b in zip((0.45, 0.35, 0.2), own, other))

        home = next((g for g in groups if any(score(o) >= 0.58 for _, o in g)), None)
        if home is None:
            home = []
            groups.append(home)
        home.append((i, own))
        want[i] = home[0][0]
    assert len(set(want.values())) < len(want) - 20
    for rows, batch in ((400, 10000), (400, 7), (100, 7)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        if rows == 400:
            monkeypatch.setattr(memory, "links", None)
        else:
            monkeypatch.setattr(memory, "links", graph.links)
        found = memory.overlap_clusters(df, ["user"], "id", ["t", "k", "w"], ["id"], block_rows=rows)
        got = {r.id: r.cluster for r in found.collect()}
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


def test_overlap_clusters(spark, rows):
    df = spark.createDataFrame(
        [("u", 1, ["t"], ["k1", "k2"], ["w"]), ("u", 2, ["t"], ["k1", "k2"], ["x"]), ("u", 3, ["z"], ["k9"], ["q"]), ("u", 4, ["t"], ["k1"], ["w"])],
        "user string, id int, tools array<string>, keys array<string>, words array<string>",
    )
    assert rows(memory.overlap_clusters(df, ["user"], "id", ["tools", "keys", "words"], ["id"])) == [(1, 1), (2, 1), (3, 3), (4, 1)]


def test_blank_lessons_stay_apart(spark):
    df = spark.createDataFrame([(1, " ", 0, 1), (2, "", 0, 2), (3, "x ", 2, 1), (4, "x", 2, 3)], "id int, t string, reuse int, at int")
    got = {r["keep_id"]: (r["reuse"], r["copies"]) for r in memory.exact_duplicates(df, "id", "t", "reuse", "at").collect()}
    assert got == {1: (0, 1), 2: (0, 1), 4: (4, 2)}
    assert memory.exact_duplicates(df, "id", "t", "reuse", "at", drop_blank=True).count() == 1


def test_chain_forms(spark, rows):
    df = spark.createDataFrame([("r", 1, "a"), ("r", 2, "a"), ("r", 3, "b"), ("r", 4, "a")], "round string, i int, tool string")
    got = memory.whole_round_chain(df, ["round"], ["i"], "tool").first()
    assert got["signature"] == "a-b-a" and got["tools"] == ["a", "a", "b", "a"] and got["cycle_indices"] == [0, 1, 2, 3]


def test_lookback_fold_keeps_rejected_out_of_the_window(spark):
    values = ["a", "a", "b", "a", "c", "b", "a"]
    df = spark.createDataFrame([(values,)], "v array<string>").select(memory.lookback_fold(F.col("v"), 2).alias("k"))
    kept = []
    for v in values:
        if v not in kept[-2:]:
            kept.append(v)
    assert df.first()["k"] == kept


def test_experience_merge_and_lookup(spark, rows):
    s = "k string, chain_ids array<string>, users array<string>, jobs array<string>, support int, merges int, ts string"
    old = spark.createDataFrame([("x", ["c1"], ["u1"], ["j"], 3, 1, "t0")], s)
    new = spark.createDataFrame([("x", ["c2", "c2"], ["u1", " u2 "], ["j2"], 0, 0, "t1"), ("y", ["c3"], ["u"], [], 0, 0, "t2")], s)
    got = {r["k"]: r for r in memory.merge_experience(old, new, ["k"]).collect()}
    assert (got["x"]["users"], got["x"]["support"], got["x"]["merges"], got["x"]["ts"]) == (["u1", "u2"], 3, 2, "t0")
    assert got["y"]["support"] == 1 and got["y"]["ts"] == "t2"
    e = spark.createDataFrame([(1, ["a", "b"], 0.5), (2, ["c"], 0.9)], "id int, pipeline array<string>, confidence double")
    assert [r["id"] for r in memory.experiences_for_tool(e.where("id = 1"), e.withColumn("id", F.col("id") + 10), "a").collect()] == [1, 11]


def test_hints_params_errors(spark, rows):
    p = spark.createDataFrame([("u", "a", "red", None, "dense"), ("u", "b", "", None, None), ("u", "c", "blue", None, None)], "user_id string, intent string, color string, style string, density string")
    cur = spark.createDataFrame([("u", "c")], "user_id string, current_intent string")
    assert rows(memory.cross_intent_hints(p, cur, ["color", "style", "density"], 3), "hint") == [("[a] red; dense",)]
    v = spark.createDataFrame([("s", 1, {"a": "1", "b": "x"}), ("s", 2, {"a": "3", "c": "y"})], "slide string, version int, params map<string,string>")
    assert rows(memory.params_diff(v, "slide", "params", 1, 2), "param", "before", "after", "delta") == [("a", "1", "3", 2.0), ("b", "x", None, None), ("c", None, "y", None)]
    r = spark.createDataFrame([('{"success": false, "error": "boom"}',), ('{"ok": 1}',), ("Error: x",), ("❌ no",), ('{"error_code": "E1", "message": "m"}',)], "r string")
    got = [tuple(x) for x in r.select(memory.soft_error(F.col("r")), memory.error_summary(F.col("r"))).collect()]
    assert [g[0] for g in got] == [True, False, True, True, True] and got[0][1] == "boom" and got[4][1] == "E1: m"


def test_search_plans_start_no_job(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta")], "id int, text string").repartition(2)
    asked = spark.createDataFrame([(1, "beta gamma")], "query_id int, text string")
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    plans = [retrieval.bm25(docs, "id", "text", asked, 3), retrieval.overlap_search(docs, "id", "text", asked, 3)]
    assert len(tracker.getJobIdsForGroup(None)) == before
    assert [[r["id"] for r in p.orderBy("rank").collect()] for p in plans] == [[2, 1], [1, 2]]


def test_sparse_topk_matches_numpy(spark):
    rng = np.random.default_rng(4)
    docs = [(d, f"t{t}", float(rng.integers(1, 5))) for d in range(80) for t in rng.choice(12, 4, replace=False)]
    asked = [(q, f"t{t}", float(rng.integers(1, 4))) for q in range(4) for t in rng.choice(14, 3, replace=False)]
    got = topk.sparse_topk(spark.createDataFrame(docs, "id int, term string, weight double").repartition(6), "id", spark.createDataFrame(asked, "query_id int, term string, weight double"), 5)
    got = sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in got.collect())
    want = []
    for q in range(4):
        w = {t: x for qq, t, x in asked if qq == q}
        score = {}
        for d, t, x in docs:
            if t in w:
                score[d] = score.get(d, 0.0) + x * w[t]
        best = sorted(score.items(), key=lambda i: (-i[1], i[0]))[:5]
        want += [(q, n, d, s) for n, (d, s) in enumerate(best, 1)]
    assert got == sorted(want)


def test_vector_batches_agree(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(50)], "id int, v array<double>").repartition(4)
    q = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(7)], "query_id int, vector array<double>")
    one = sorted(tuple(r) for r in retrieval.vector_search(v, "id", "v", q, 3).collect())
    monkeypatch.setattr(topk, "MAX_QUERIES", 2)
    assert sorted(tuple(r) for r in retrieval.vector_search(v, "id", "v", q, 3).collect()) == one and len(one) == 21


def test_cosine_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(topk.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]


def test_hybrid_keeps_a_single_branch(spark, rows):
    s = "query_id string, id int, score double, rank int"
    a = spark.createDataFrame([("x", 1, 9.0, 1), ("x", 2, 8.0, 2), ("y", 3, 7.0, 1)], s)
    b = spark.createDataFrame([("x", 2, 1.0, 1)], s)
    got = rows(retrieval.hybrid(a, b, 5).select("query_id", "id", F.round("score", 4)))
    assert got == [("x", 1, 0.0164), ("x", 2, 0.0325), ("y", 3, 7.0)]


def test_short_trigrams_never_match(spark, rows):
    d = spark.createDataFrame([(1, "Growth of sales"), (2, "SALES"), (3, "sa")], "id int, t string")
    q = spark.createDataFrame([("a", "sales"), ("b", "sa")], "query_id string, text string")
    assert rows(retrieval.trigram_search(d, "id", "t", q, 5, [F.col("id")]), "query_id", "id") == [("a", 1), ("a", 2)]


def test_diverse_pick(spark, rows):
    s = "query_id string, id int, score double, role string, signature string, terms array<string>, risk boolean"
    data = [("q", 1, 0.9, "primary", "a", ["x", "y"], True), ("q", 2, 0.8, "primary", "b", ["x", "y"], True), ("q", 3, 0.7, "fallback", "c", ["z"], True), ("q", 4, 0.6, "anti_pattern", "d", ["w"], True), ("r", 5, 0.1, "primary", "a", [], False)]
    assert rows(retrieval.diverse_pick(spark.createDataFrame(data, s)), "id", "pick") == [(1, 1), (3, 3), (4, 2)]


def test_dimension_pick_and_layout(spark, rows):
    p = spark.createDataFrame([(1, "general"), (2, "theme.color"), (3, "layout.x"), (4, "theme.font"), (5, None)], "id int, dimension string").na.fill("")
    assert rows(retrieval.dimension_pick(p, ["theme"], 3, [F.col("id")]), "id") == [(1,), (2,), (5,)]
    pages = spark.createDataFrame([(1, "opening", "opening", "none", "none", 0), (2, "content", "figure_focus", "required", "figure", 0)], "page int, page_purpose string, content_shape string, visual_requirement string, bound_asset_kind string, formula_count int")
    layouts = [{"name": "opening", "supports": {"title"}}, {"name": "pic", "supports": {"figure", "ending"}}]
    assert rows(retrieval.recommend_layout(pages, layouts), "page", "layout", "fit_score") == [(1, "opening", 0.6), (2, "pic", 1.26)]


def test_copies_are_embedded_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(texts):
        seen.add(len(texts))
        return np.ones((len(texts), 2), dtype="float32")

    df = spark.createDataFrame([(i, "same" if i < 9 else "other") for i in range(10)], "id int, t string")
    assert embed.embed_distinct(df, "t", count).count() == 10
    embed.embed_distinct(df, "t", count).collect()
    assert seen.value <= 4


def test_quota_beyond_place_100(spark, rows):
    data = [(i, "click", 1000.0 - i) for i in range(300)] + [(300 + i, "error", 10.0 - i) for i in range(5)] + [(400, None, 1.0)]
    df = spark.createDataFrame(data, "id long, kind string, value double").repartition(4)
    got = retrieval.quota_pick(df, "kind", {"error": 2, "click": 4}, {"click": 6}, 9, [F.desc("value"), F.col("id")])
    want = [(0, 1), (1, 1), (2, 1), (3, 1), (300, 1), (301, 1), (4, 2), (5, 2), (302, 2)]
    assert rows(got, "pick", "id", "phase") == sorted(((n + 1, i, p) for n, (i, p) in enumerate(want)), key=repr)


def test_many_prototypes(spark):
    v = np.random.default_rng(6).normal(size=(4500, 16)).tolist()
    names = spark.createDataFrame([(f"p{i:05d}", x) for i, x in enumerate(v)] + [("q", v[7])], "name string, vector array<double>")
    asked = spark.createDataFrame([(i, v[i]) for i in (7, 2100, 4400)], "id int, vector array<double>")
    got = {r.id: [m.name for m in r.matches] for r in topk.nearest_prototype(asked, "vector", names, 0.5, 2).collect()}
    assert got[7] == ["p00007", "q"] and got[2100][0] == "p02100" and got[4400][0] == "p04400"


def test_trigrams_are_never_broadcast(spark):
    d = spark.createDataFrame([(1, "Growth of sales"), (2, "SALES"), (3, "sa")], "id int, t string")
    q = spark.createDataFrame([("a", "sales")], "query_id string, text string")
    found = retrieval.trigram_search(d, "id", "t", q, 5, [F.col("id")])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 2


def exchanges(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x]


def test_scores_of_a_document_are_final_where_it_lies(spark, rows):
    from quire.operators import retrieval

    docs = spark.createDataFrame([(1, "red fish blue fish"), (2, "blue"), (3, None), (4, "one red one")], "id long, text string")
    asked = spark.createDataFrame([(7, "red fish red"), (8, "blue blue"), (9, "nothing")], "query_id long, text string")
    assert retrieval.few_terms(asked)
    for few in (False, True):
        scores = retrieval.lexical_scores(docs, "id", "text", asked, few=few)
        assert rows(scores, "query_id", "id", "shared") == [(7, 1, 2.0), (7, 4, 1.0), (8, 1, 1.0), (8, 2, 1.0)]
    dealt = exchanges(retrieval.bm25(docs, "id", "text", asked, 3, few=True))
    assert dealt and not any(re.search(r"\(query_id#\d+L?, id#", x) for x in dealt)


def test_index_shuffles_terms_not_postings(spark, rows):
    from quire.plans import load_all

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    docs = spark.createDataFrame([(1, "en", "ab ab cd"), (2, "en", "cd"), (3, "fr", "ab"), (4, None, "ab")], "doc_id long, lang string, text string")
    docs.repartition(40).write.option("maxRecordsPerFile", 1).parquet(f"{folder}/documents.parquet")
    got = load_all()["f02_bm25_index"].run(spark, folder)
    assert rows(got, "lang", "term", "df", "docs") == [("en", "ab", 1, 2), ("en", "cd", 2, 2), ("fr", "ab", 1, 1)]
    assert not any("doc_id" in x and "term" in x for x in exchanges(got))


def test_only_ids_go_along_the_timeline_of_neighbours(spark, rows, monkeypatch):
    from quire.operators import memory
    from quire.plans import load_all

    seen = []
    step = memory.with_previous
    monkeypatch.setattr(memory, "with_previous", lambda df, *rest: seen.append(df.columns) or step(df, *rest))
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    docs = [(1, "a", "en", "use the station"), (2, "a", "en", "never use the station"), (3, "a", "fr", None), (4, "b", "en", "alone")]
    spark.createDataFrame(docs, "doc_id long, source string, lang string, text string").write.parquet(f"{folder}/documents.parquet")
    assert rows(load_all()["g04_weighted_overlap"].run(spark, folder), "doc_id", "prev_doc_id", "score") == [(2, 1, 0.95), (3, 2, 0.0)]
    assert rows(load_all()["g05_relation"].run(spark, folder), "doc_id", "relation") == [(2, "merge"), (3, "unrelated")]
    assert all(set(c) <= {"doc_id", "source"} for c in seen)
