import random
import tempfile

import pytest
from pyspark.sql import functions as F

from quire.functions.scan import Timeline, id_slice
from quire.operators import citations, outline


def test_budget_matches_a_fold(spark):
    import random

    rng = random.Random(1)
    data = [(k, i, rng.choice([1, 1, 2])) for k in range(40) for i in range(rng.randrange(1, 6))]
    df = spark.createDataFrame(data, "k int, i int, c int")
    for budget in (1, 2, 3, 5):
        got = sorted(tuple(r) for r in outline.within_budget(df, ["k"], [F.col("i")], F.col("c"), budget).select("k", "i").collect())
        want, used = [], {}
        for k, i, c in data:
            if used.get(k, 0) + c <= budget:
                used[k] = used.get(k, 0) + c
                want.append((k, i))
        assert got == sorted(want)


def test_greedy_cover(spark, rows):
    missing = spark.createDataFrame([("s", n) for n in "1234"], "slide_id string, number string")
    cand = spark.createDataFrame([("s", "block", "a", 1, n) for n in "12"] + [("s", "block", "b", 2, n) for n in "1239"] + [("s", "table", "c", 3, "4")], "slide_id string, kind string, id string, pos int, number string")
    assert rows(outline.greedy_cover(missing, cand), "id", "added") == [("b", 1), ("c", 2)]


def test_small_slides_are_covered_without_rounds(spark):
    rng = random.Random(5)
    missing = spark.createDataFrame([(s, n) for s in range(20) for n in range(s)], "slide_id int, number int")
    given = spark.createDataFrame([(s, "ab"[k % 2], k, k % 3, rng.randrange(25)) for s in range(22) for k in range(8) for _ in range(s)], "slide_id int, kind string, id int, pos int, number int")
    got = [sorted(map(tuple, outline.greedy_cover(missing, given, **how).collect())) for how in ({"rounds": 0}, {"slide_rows": 0}, {"slide_rows": 40})]
    assert len(got[0]) == 53 and got[0] == got[1] == got[2]


def test_greedy_cover_against_a_plain_loop(spark):
    rng = random.Random(4)
    need = {s: set(rng.sample(range(30), rng.randrange(0, 20))) for s in range(12)}
    cand = {s: [(k % 5, f"c{k}", set(rng.sample(range(30), rng.randrange(0, 8)))) for k in range(15)] for s in range(12)}
    missing = spark.createDataFrame([(str(s), str(n)) for s, ns in need.items() for n in ns] * 2, "slide_id string, number string")
    rows = [(str(s), "block", i, p, str(n)) for s, cs in cand.items() for p, i, ns in cs for n in ns]
    given = spark.createDataFrame(rows, "slide_id string, kind string, id string, pos int, number string")
    want = set()
    for s, left in need.items():
        left, n = set(left), 0
        while True:
            best = min(cand[s], key=lambda c: (-len(c[2] & left), c[0], c[1]))
            if not best[2] & left:
                break
            n += 1
            want.add((str(s), best[1], n))
            left -= best[2]
    assert {(r.slide_id, r.id, r.added) for r in outline.greedy_cover(missing, given).collect()} == want


def test_assignment_against_a_plain_loop(spark):
    rng = random.Random(6)
    figures = [("d", f"s{k % 3}", f"f{k}", rng.randrange(20)) for k in range(45)]
    hosts = [("d", f"s{k % 4}", f"p{k}", k, rng.randrange(0, 4)) for k in range(16)]
    scores = [("d", f[2], h[2], rng.randrange(2), rng.randrange(3)) for f in figures for h in hosts if f[1] == h[1] and rng.random() < 0.6]
    points = {(f, h): (d, o) for _, f, h, d, o in scores}
    room, want = {h[2]: h[4] for h in hosts}, {}
    for _, section, f, _ in sorted(figures, key=lambda f: (f[3], f[2])):
        free = [h for h in hosts if h[1] == section and room[h[2]] > 0]
        best = max(free, key=lambda h: (*points.get((f, h[2]), (0, 0)), -h[3]), default=None)
        want[f] = best and best[2]
        if best:
            room[best[2]] -= 1
    got = outline.assign_figures(
        spark.createDataFrame(figures, "doc_id string, section_id string, figure_id string, order int"),
        spark.createDataFrame(hosts, "doc_id string, section_id string, slide_id string, host_no int, room int"),
        spark.createDataFrame(scores, "doc_id string, figure_id string, slide_id string, direct int, overlap int"),
    )
    assert {r.figure_id: r.slide_id for r in got.collect()} == want


def test_number_grounding(spark, rows):
    c = spark.createDataFrame([("s", "grew 1,200 to 12.50% in 2021-2023, x99")], "k string, t string")
    e = spark.createDataFrame([("s", "1200 and 12.5, 2021 2022")], "k string, t string")
    got = [float(n) for _, n in rows(outline.ungrounded(c, e, ["k"], "t", "t"))]
    assert got == [2023.0]


def test_takeaway_and_titles(spark, rows):
    long = "短句，" + "这是一个比较长的分句内容" * 2 + "，" + "还有一个也比较长的分句内容" * 2
    df = spark.createDataFrame([("A sentence. More。next",), (long,), ("",)], "m string").select(outline.takeaway(F.col("m")).alias("t"))
    got = [r["t"] for r in df.collect()]
    assert got[0] == "A sentence. More" and got[1] == "这是一个比较长的分句内容" * 2 and got[2] == ""
    s = spark.createDataFrame([("x", 1, "T", "one。"), ("x", 2, "T", "two。"), ("x", 3, "T", "two。"), ("y", 4, "T", "z")], "sec string, pos int, title string, msg string")
    out = outline.first_of_title(s, ["sec"], F.col("title"), ["pos"], id_slice("pos", 2), F.col("msg"))
    assert rows(out, "pos", "new_title") == [(1, "T"), (2, "two"), (3, "T"), (4, "T")]


def test_source_order(spark, rows):
    slides = spark.createDataFrame([("d", "a", 0, "content", "s2"), ("d", "b", 1, "closing", None), ("d", "c", 2, "content", "s1"), ("d", "e", 3, "title", None)], "doc_id string, slide_id string, pos int, page_role string, section_ref string")
    sections = spark.createDataFrame([("d", "s1", 0), ("d", "s2", 1)], "doc_id string, section_id string, pos int")
    got = outline.source_order(slides, sections).orderBy("pos").collect()
    assert [(r["slide_id"], r["page_role"], r["section_ref"]) for r in got] == [
        ("slide_001", "title", None), ("slide_002", "content", "s1"), ("slide_003", "content", "s2"), ("slide_004", "closing", None),
    ]


def test_figure_assignment_respects_room(spark, rows):
    figures = spark.createDataFrame([("d", "s", f"f{i}", i) for i in (1, 2, 3)], "doc_id string, section_id string, figure_id string, order int")
    hosts = spark.createDataFrame([("d", "s", "p1", 0, 1), ("d", "s", "p2", 1, 1)], "doc_id string, section_id string, slide_id string, host_no int, room int")
    scores = spark.createDataFrame([("d", "f1", "p2", 1, 0), ("d", "f2", "p2", 0, 9)], "doc_id string, figure_id string, slide_id string, direct int, overlap int")
    assert rows(outline.assign_figures(figures, hosts, scores), "figure_id", "slide_id") == [("f1", "p2"), ("f2", "p1"), ("f3", None)]
    left = spark.createDataFrame([("d", "s", "f3", 3, 2, "cap"), ("d", "s", "f4", 4, 1, "cap"), ("d", "t", "f5", 5, 0, "c")], "doc_id string, section_id string, figure_id string, order int, nearby int, caption string")
    content = spark.createDataFrame([("d", 5)], "doc_id string, content int")
    assert rows(outline.standalone_pages(left, content), "figure_id") == [("f3",), ("f5",)]


@pytest.fixture(scope="module")
def deck(spark):
    slides = spark.createDataFrame(
        [
            ("d", "s0", 0, "title", None, None, None, "T", None, [], []),
            ("d", "s1", 1, "content", "text", "x", "Wrong", "A", "Growth was 30 in the year.", ["up 77"], ["src"]),
            ("d", "s2", 2, "content", "text", "nope", None, "B", None, [], []),
        ],
        "doc_id string, slide_id string, pos int, page_role string, slide_type string, section_ref string, section string, title string, key_message string, bullet_points array<string>, source_refs array<string>",
    )
    refs = spark.createDataFrame([("d", "s1", 0, "block", "b1"), ("d", "s1", 1, "block", "far"), ("d", "s1", 2, "figure", "f1"), ("d", "s1", 3, "block", "gone")], "doc_id string, slide_id string, ref_no int, kind string, id string")
    visuals = spark.createDataFrame([("d", "s1", 0, "v1", "image", "paired"), ("d", "s1", 1, "v2", "chart", None)], "doc_id string, slide_id string, visual_no int, candidate_id string, type string, display_mode string")
    visual_refs = spark.createDataFrame([("d", "s1", 0, 0, "figure", "f2"), ("d", "s1", 1, 0, "block", "b1")], "doc_id string, slide_id string, visual_no int, ref_no int, kind string, id string")
    evidence = spark.createDataFrame([("d", "block", "b1", "x", "Growth was 30 in the year."), ("d", "block", "far", "y", "t"), ("d", "figure", "f1", "x", ""), ("d", "figure", "f2", "x", "")], "doc_id string, kind string, id string, section_id string, text string")
    sections = spark.createDataFrame([("d", "x", 0, "Growth"), ("d", "y", 1, "Else")], "doc_id string, section_id string, pos int, title string")
    closure = spark.createDataFrame([("d", "x", "x"), ("d", "y", "y")], "doc_id string, section_id string, ancestor string")
    inventory = spark.createDataFrame([("d", "f1", True, "c", 1), ("d", "f2", False, "c", 2)], "doc_id string, figure_id string, selectable boolean, caption string, order int")
    blocks = spark.createDataFrame([("d", "b1", "paragraph", "Growth was 30 in the year.")], "doc_id string, id string, type string, text_raw string")
    return slides, refs, visuals, visual_refs, evidence, sections, closure, inventory, blocks


def test_outline_issues(deck, rows):
    got = rows(outline.outline_issues(*deck).select("code", "path"))
    assert got == [
        ("BUNDLE.CONTENT_WITHOUT_EVIDENCE", "d/s2"), ("BUNDLE.CONTENT_WITHOUT_SOURCE", "d/s2"), ("BUNDLE.CROSS_SECTION_EVIDENCE", "d/s1/block/far"),
        ("BUNDLE.SECTION_TITLE_MISMATCH", "d/s1"), ("BUNDLE.UNGROUNDED_NUMBER", got[4][1]), ("BUNDLE.UNKNOWN_EVIDENCE", "d/s1/block/gone"),
        ("BUNDLE.UNKNOWN_SECTION", "d/s2"), ("FIGURE.CONTENT_IMAGE_COVERAGE", "d/s1"), ("FIGURE.IMAGE_EVIDENCE_NOT_ON_SLIDE", "d/s1/f2"),
        ("FIGURE.INVALID_IMAGE_CANDIDATE", "d/s1/0"), ("LAYOUT.VISUAL_BUDGET_EXCEEDED", "d/s1"),
    ]
    assert got[4][1].startswith("d/s1/77")


def test_used_figures_and_labels(spark, deck, rows):
    slides, refs, visuals, visual_refs, evidence, sections, closure, inventory, blocks = deck
    kept = outline.within_budget(visuals, ["doc_id", "slide_id"], [F.col("visual_no")], outline.visual_cost())
    assert rows(kept, "candidate_id") == [("v1",)]
    assert rows(outline.used_figure_refs(refs, slides, visual_refs, kept), "id") == [("b1",), ("far",), ("gone",)]
    figs = spark.createDataFrame([("d", "f1", "cap", "x")], "doc_id string, figure_id string, caption string, section_id string")
    got = {r["slide_id"]: (r["section"], r["changed"]) for r in outline.owned_labels(slides, sections, figs, refs).collect()}
    assert got["s1"] == ("Growth", 1)
    lead = {r["slide_id"]: r["changed"] for r in outline.topic_messages(slides.withColumn("key_message", F.lit("other")), refs, blocks).collect()}
    assert lead["s1"] and not lead["s2"]


def test_front_summary(spark, deck, rows):
    slides, refs, *_ = deck
    highlights = spark.createDataFrame([("d", "x", "b1"), ("d", "x", "b7")], "doc_id string, section_id string, block_id string")
    assert rows(outline.front_summary_issues(highlights, slides, refs), "code") == [("BUNDLE.FRONT_SUMMARY_MISSING",)]
    made = slides.withColumn("slide_type", F.when(F.col("slide_id") == "s1", "summary").otherwise(F.col("slide_type")))
    assert rows(outline.front_summary_issues(highlights, made, refs), "code", "path") == [("BUNDLE.FRONT_SUMMARY_EVIDENCE_MISSING", "d/b7")]


def test_plan_speaker_source_rules(spark, rows):
    claims = spark.createDataFrame([("d", "c1", "block", "b1"), ("d", "c1", "block", "zz")], "doc_id string, claim_id string, kind string, id string")
    ev = spark.createDataFrame([("d", "block", "b1")], "doc_id string, kind string, id string")
    secs = spark.createDataFrame([("d", "x")], "doc_id string, section_id string")
    srefs = spark.createDataFrame([("d", "x"), ("d", "q")], "doc_id string, section_ref string")
    assert rows(outline.plan_issues(claims, srefs, ev, secs), "code", "path") == [("unavailable_evidence", "d/c1/block/zz"), ("unknown_section", "d/q")]
    slides = spark.createDataFrame([("d", 0, "s0", "A"), ("d", 1, "s1", "B")], "doc_id string, pos int, slide_id string, title string")
    scripts = spark.createDataFrame([("d", 0, "s0", "A", "next"), ("d", 1, "s1", "C", "more")], "doc_id string, pos int, slide_id string, slide_title string, transition_to_next string")
    none = spark.createDataFrame([], "doc_id string, slide_id string, kind string, id string")
    assert rows(outline.speaker_issues(slides, scripts, none, none, ev), "code") == [("final_transition",), ("speaker_alignment",)]
    sources = spark.createDataFrame([("d", "a"), ("d", "a")], "doc_id string, source_id string")
    used = spark.createDataFrame([("d", "s0", "b")], "doc_id string, slide_id string, source_id string")
    visuals = spark.createDataFrame([("d", "v")], "doc_id string, candidate_id string")
    assert rows(outline.source_issues(sources, slides, used, visuals), "code") == [("SOURCE.DUPLICATE_ID",), ("SOURCE.UNKNOWN_REFERENCE",)]


def test_fill_and_compliance(spark, rows):
    s = spark.createDataFrame([("a", " ", [" ", "b1"], "T"), ("b", None, [], "T"), ("c", "k", [], "T")], "slide_id string, key_message string, bullet_points array<string>, title string")
    assert rows(outline.filled_messages(s), "slide_id", "key_message") == [("a", "b1"), ("b", "T"), ("c", "k")]
    got = outline.compliance([("slides", s, F.count(F.lit(1)) == 3), ("titles", s, F.bool_and(F.col("title") != "T"))]).first()
    assert got["failures"] == ["titles"] and got["status"] == "failed"


def test_citation_units(spark, rows):
    raw = "**Sales rose[^cite_id:a][^cite_id:b]。Costs fell! Margin (was 3[^cite_id:c])，more[^cite_id:a]."
    df = spark.createDataFrame([("d", "b1", raw), ("d", "b2", "none")], "doc_id string, block_id string, raw_text string")
    got = rows(citations.citation_units(df), "unit_id", "text", "cite_ids")
    assert got == [("b1_cu_001", "Sales rose。", ["a", "b"]), ("b1_cu_002", "was 3)，", ["c"]), ("b1_cu_003", "more.", ["a"])]


def test_html_claims(spark, rows):
    html = (
        "<div style='display: none'><p>hidden</p></div><ul><li>one<sup class='reference-mark'>[1]</sup></li><li><p>inner <b>bold</b></p></li></ul>"
        "<p aria-hidden='true'>no</p><p>  </p><td>cell</td>"
    )
    got = rows(citations.html_claims(spark.createDataFrame([("p1", html)], "id string, html string"), "id", "html"), "claim_id", "text")
    assert got == [("p1_claim_001", "one"), ("p1_claim_002", "inner bold"), ("p1_claim_003", "cell")]


def test_appendix_and_labels(spark, rows):
    md = "\n".join([
        "前言", "## 第一部分 引用材料清单", "- 文件名：web_1.md", "- 类型：网页", "- 描述：网页发布时间：2024-03-05 公告标题", "  续行", "- 来源：博查搜索结果（来源：sse.com.cn）",
        "文件名: `600_2023-01-02_年报.pdf`", "描述: dir/600000_2023-01-02_年报.pdf", "文件名：web_1.md", "描述：网页发布时间：2024-03-06 新标题", "第二部分 数据溯源附录", "文件名：late.md",
    ])
    cat = citations.appendix_catalogue(spark.createDataFrame([("d", md)], "doc_id string, text string"))
    got = {r["cite_id"]: r for r in cat.collect()}
    assert set(got) == {"web_1", "600_2023-01-02_年报"} and got["web_1"]["description"] == "网页发布时间：2024-03-06 新标题"
    refs = spark.createDataFrame([("web_1", "新标题", "交易所", "")], "cite_id string, title string, publisher string, document_number string")
    full = citations.reference_fields(cat, refs)
    assert rows(full.where("issue is not null"), "cite_id", "issue") == [("web_1", "publisher not in source")]
    labels = rows(full.select("cite_id", citations.source_label(full).alias("l")))
    assert labels == [("600_2023-01-02_年报", "《年报》，2023年1月2日。"), ("web_1", "交易所，《新标题》，2024年3月6日。")]
    assert full.where("cite_id like '600%'").first()["reference_title"] == "dir/600000_2023-01-02_年报.pdf"


def test_mappings_and_cache(spark, rows):
    raw = spark.createDataFrame([('{"mappings":[{"html_claim_id":"c1","status":"supported","citation_unit_ids":["u1"]},{"html_claim_id":"c2","status":"supported","citation_unit_ids":[]}]}',), ("bad",)], "content string")
    m = citations.parse_mappings(raw)
    claims = spark.createDataFrame([("c1",), ("c3",)], "claim_id string")
    units = spark.createDataFrame([("u1",)], "unit_id string")
    assert rows(citations.mapping_issues(m, claims, units), "code", "path") == [("inconsistent_status", "c2"), ("unknown_claim", "c2")]
    assert rows(citations.with_default(claims, m, "claim_id", "status")) == [("c1", "supported"), ("c3", "unsupported")]
    keys = spark.createDataFrame([(1, "k1"), (2, "k2")], "batch int, cache_key string")
    cache = spark.createDataFrame([("k1", "done")], "cache_key string, result string")
    assert rows(citations.pending(keys, cache), "batch") == [(2,)] and rows(citations.cached(keys, cache), "result") == [("done",)]


def test_numbering_is_exact_over_slices(spark):
    df = spark.range(0, 1000).repartition(7)
    got = {r["id"]: r["number"] for r in citations.number_sources(df, Timeline((), ("id",), id_slice("id", 64))).collect()}
    assert got == {i: i + 1 for i in range(1000)}


def test_lead_of_prose_keeps_a_number_at_its_start(spark):
    from quire.plans import load_all

    folder = documents(spark, ["56.187.231.175 is a host. More", "1. Some words here", ". Nothing before", "Two\x0bwords  and one. End"])
    got = {r["doc_id"]: r["lead"] for r in load_all()["d08_lead_sentence"].run(spark, folder).collect()}
    assert got == {0: "56.187.231.175 is a host.", 3: "Two\x0bwords and one."}


def documents(spark, texts):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return folder


def test_only_numbers_go_along_the_timeline(spark, monkeypatch):
    from quire.operators import memory
    from quire.plans import load_all

    seen = []
    step = memory.with_previous
    monkeypatch.setattr(memory, "with_previous", lambda df, *rest: seen.append(df.columns) or step(df, *rest))
    rows = spark.createDataFrame([(1, "a", "7 and 8"), (2, "a", "8 and 9"), (3, "b", "9"), (4, "a", None), (5, "a", "9")], "doc_id long, source string, text string")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows.write.parquet(f"{folder}/documents.parquet")
    got = load_all()["d04_ungrounded_numbers"].run(spark, folder)
    whole = {(r[0], float(r[1])) for r in got.collect()}
    assert whole == {(1, 7.0), (1, 8.0), (2, 9.0), (3, 9.0), (5, 9.0)} and "text" not in seen[0]


def test_spread_parts_grow_with_the_table(spark):
    from quire.plans.registry import Tables

    rows = spark.range(20000).selectExpr("id as doc_id", "sha2(string(id), 512) as text")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        assert Tables(spark, folder).documents.rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
