import random
import pytest
from pyspark.sql import functions as F

from quire.functions import rules
from quire.operators import structure
from quire.sources import readers

MARKDOWN = """# Report  ##

Intro line one
line **two** [^cite_id:a1]

Heading Two
-----------
- first
  more
- second
1. third

> quote one
> quote two
```python
# not a heading
| a | b |
```
Table 1. Values

| Name | 2023 | 2024 |
|:-----|-----:|:---:|
| x \\| y | 1 | 2 |
| z | 3 |
![alt text](chart:c-1)
***
tail
"""


@pytest.fixture(scope="module")
def blocks(spark):
    return structure.parse_blocks(spark.createDataFrame([("d", MARKDOWN)], "doc_id string, text string")).cache()


def test_blocks(blocks):
    got = [(r["type"], r["line_start"], r["line_end"], r["text"]) for r in blocks.orderBy("no").collect()]
    assert got == [
        ("heading", 1, 1, "Report"),
        ("paragraph", 3, 4, "Intro line one line two"),
        ("heading", 6, 7, "Heading Two"),
        ("list", 8, 10, None),
        ("list", 11, 11, None),
        ("blockquote", 13, 14, "quote one\nquote two"),
        ("code", 15, 18, "# not a heading\n| a | b |"),
        ("paragraph", 19, 19, "Table 1. Values"),
        ("table", 21, 24, None),
        ("image", 25, 25, None),
        ("horizontal_rule", 26, 26, None),
        ("paragraph", 27, 27, "tail"),
    ]


def test_table_and_image_fields(blocks):
    t = blocks.where("type = 'table'").first()
    assert t["columns"] == ["Name", "2023", "2024"] and t["alignments"] == ["left", "right", "center"]
    assert t["rows"] == [["x | y", "1", "2"], ["z", "3", ""]] and t["ragged"] == [2]
    assert blocks.where("type = 'image'").first()["url"] == "chart:c-1"
    assert blocks.where("no = 2").first()["citations"] == ["a1"]


def test_captions_sections_and_statistics(blocks):
    cap = structure.table_captions(blocks).where("caption is not null").select("block_id", "caption").collect()
    assert [tuple(r) for r in cap] == [("block_0009", "Table 1. Values")]
    paths = {r["no"]: (r["path"], r["parent_heading_id"]) for r in structure.section_paths(blocks).collect()}
    assert paths[1] == (["block_0001"], None)
    assert paths[3] == (["block_0001", "block_0003"], "block_0001")
    assert paths[12] == (["block_0001", "block_0003"], "block_0003")
    s = structure.block_statistics(blocks).first()
    assert (s["title"], s["block_count"], s["list_count"], s["table_count"]) == ("Report", 12, 2, 1)


def test_invariants(spark, blocks, rows):
    parsed = structure.section_paths(blocks)
    counts = spark.createDataFrame([("d", 28)], "doc_id string, line_count int")
    assert structure.document_invariants(parsed, counts).count() == 0
    short = spark.createDataFrame([("d", 20)], "doc_id string, line_count int")
    assert structure.document_invariants(parsed, short).where("code = 'invalid_line_range'").count() == 4


def test_plain_text_headings(spark):
    text = "第一章 总则\n\n一、概况\n正文在此。\n\n1.2 Market size\ntext\n2.1 not after blank"
    got = structure.parse_blocks(spark.createDataFrame([("d", text)], "doc_id string, text string"), plain=F.lit(True))
    heads = [(r["level"], r["text"]) for r in got.where("type = 'heading'").orderBy("no").collect()]
    assert heads == [(1, "第一章 总则"), (2, "概况"), (3, "Market size")]


def test_unclosed_fence_runs_to_the_end(spark):
    got = structure.parse_blocks(spark.createDataFrame([("d", "a\n~~~\nb\n```\n# c")], "doc_id string, text string"))
    assert [(r["type"], r["line_start"], r["line_end"]) for r in got.orderBy("no").collect()] == [("paragraph", 1, 1), ("code", 2, 5)]


def test_section_ids(spark, rows):
    heads = spark.createDataFrame(
        [("d", 1, "1 Start"), ("d", 2, "Plain"), ("d", 3, "1.2 Part"), ("d", 4, "1 Again"), ("d", 5, "1.2 Part")],
        "doc_id string, no long, text string",
    )
    assert rows(structure.section_ids(heads), "no", "section_id") == [
        (1, "sec-1"), (2, "sec-002"), (3, "sec-1-2"), (4, "sec-1-3"), (5, "sec-1-2-2"),
    ]


def test_ancestry_finds_cycles_and_unknown_parents(spark, rows):
    nodes = spark.createDataFrame(
        [("d", "a", None), ("d", "b", "a"), ("d", "c", "b"), ("d", "x", "y"), ("d", "y", "x"), ("d", "z", "gone")],
        "doc_id string, id string, parent_id string",
    )
    got = {r["id"]: (r["path"], r["issue"]) for r in structure.ancestry(nodes, ["doc_id"], "id", "parent_id").collect()}
    assert got["c"] == (["a", "b", "c"], None)
    assert got["x"][1] == "cycle" and got["y"][1] == "cycle" and got["z"][1] == "unknown parent"


@pytest.fixture(scope="module")
def items(spark):
    data = [
        ("d", 0, 0, "text", "Figure 1 growth", None, [100.0, 100.0, 900.0, 120.0], None, None, None, None, None),
        ("d", 1, 0, "text", "Source: company", None, [100.0, 400.0, 900.0, 420.0], None, None, None, None, None),
        ("d", 2, 0, "text", "label in the figure", None, [100.0, 150.0, 200.0, 180.0], None, None, None, None, None),
        ("d", 3, 0, "text", "Chapter", 1, [100.0, 500.0, 900.0, 520.0], None, None, None, None, None),
        ("d", 4, 0, "table", None, None, [100.0, 600.0, 900.0, 900.0], "<table/>", ["Table cap"], ["note"], None, None),
        ("d", 5, 1, "text", "cell a", None, [100.0, 20.0, 300.0, 40.0], None, None, None, None, None),
        ("d", 6, 1, "text", "cell b", None, [320.0, 20.0, 600.0, 40.0], None, None, None, None, None),
        ("d", 7, 1, "text", "Source: agency", None, [100.0, 60.0, 300.0, 80.0], None, None, None, None, None),
        ("d", 8, 1, "text", "bad box", None, [900.0, 60.0, 300.0, 80.0], None, None, None, None, None),
    ]
    schema = (
        "doc_id string, item_index int, page_idx int, type string, text string, text_level int, bbox array<double>, table_body string, "
        "table_caption array<string>, table_footnote array<string>, image_caption array<string>, image_footnote array<string>"
    )
    df = spark.createDataFrame(data, schema)
    return df.withColumns({"chart_caption": F.col("image_caption"), "chart_footnote": F.col("image_footnote")})


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([("d", 1, 500.0, 800.0), ("d", 2, 500.0, 800.0)], "doc_id string, page int, width double, height double")


def test_item_blocks(items, pages):
    got = {r["id"]: r for r in structure.item_blocks(items, pages).collect()}
    assert [got[f"p001-b00{i}"]["type"] for i in range(1, 8)] == [
        "image_caption", "image_footnote", "figure_text", "heading", "table", "table_caption", "table_footnote",
    ]
    assert got["p001-b001"]["bbox"] == [50.0, 80.0, 450.0, 96.0]
    assert got["p002-b004"]["issue"] == "bbox_out_of_range" and got["p001-b006"]["text_raw"] == "Table cap"


def test_reading_order_moves_the_note(items, pages, rows):
    order = structure.reading_order(structure.item_blocks(items, pages))
    ids = [r["id"] for r in order.orderBy("reading_order").collect()]
    assert ids[:3] == ["p001-b001", "p001-b003", "p001-b002"]
    assert ids.index("p001-b006") < ids.index("p001-b005") < ids.index("p001-b007")


def test_table_continuation(items, rows):
    got = structure.table_continuations(items).collect()
    assert [(r["table_index"], r["note_index"], r["items"]) for r in got] == [(4, 7, [5, 6])]


@pytest.fixture(scope="module")
def bundle(spark):
    none = "cast(null as string)"
    block = spark.createDataFrame(
        [
            ("d", 0, "b1", 1, "heading", "1 Growth", [0.0, 0.0, 10.0, 10.0], "s1", 0, None, None),
            ("d", 1, "b2", 1, "paragraph", "Sales grew by a third in the year.", [0.0, 10.0, 10.0, 20.0], "s1", 1, None, None),
            ("d", 2, "b3", 1, "image_caption", "Figure of growth", [0.0, 20.0, 10.0, 30.0], "s1", 2, None, None),
            ("d", 3, "b4", 1, "image_footnote", "资料来源：公司公告", [0.0, 30.0, 10.0, 40.0], "s1", 2, None, None),
            ("d", 4, "b5", 2, "paragraph", "A table follows with the numbers.", [0.0, 0.0, 10.0, 10.0], "s1", 3, "t1", None),
            ("d", 5, "b6", 9, "paragraph", "far away text that is long enough", None, "s2", 4, None, None),
        ],
        "doc_id string, pos int, id string, page int, type string, text_raw string, bbox array<double>, section_id string, "
        "source_content_index int, table_id string, figure_id string",
    )
    section = spark.createDataFrame(
        [("d", 0, "s1", 1, "b1", None, ["b2", "gone"])],
        "doc_id string, pos int, id string, level int, title_block_id string, parent_id string, content_block_ids array<string>",
    )
    table = spark.createDataFrame(
        [("d", 0, "t1", "s1", None, [], [], [], 3, "complete", [(2, [0.0, 0.0, 5.0, 5.0], "t1.png")])],
        "doc_id string, pos int, id string, section_id string, title_block_id string, caption_block_ids array<string>, footnote_block_ids array<string>, "
        "continuation_block_ids array<string>, source_content_index int, status string, fragments array<struct<page:int,bbox:array<double>,crop_path:string>>",
    )
    figure = spark.createDataFrame(
        [("d", 0, "f1", 1, "s1", [0.0, 20.0, 10.0, 30.0], None, ["b3"], ["b4"], "img/f1.png", 2), ("d", 1, "f2", 1, "s1", None, None, [], [], "../f2.png", None)],
        "doc_id string, pos int, id string, page int, section_id string, bbox array<double>, caption_block_id string, caption_block_ids array<string>, "
        "footnote_block_ids array<string>, asset_path string, source_content_index int",
    )
    return block, section, table, figure


def test_evidence_and_relations(bundle, rows):
    block, _, table, figure = bundle
    ev = {(r["kind"], r["id"]): (r["section_id"], r["page"]) for r in structure.evidence_index(block, table, figure).collect()}
    assert len(ev) == 9 and ev[("table", "t1")] == ("s1", 2) and ev[("figure", "f1")] == ("s1", 1)
    rel = rows(structure.block_relations(block, table, figure), "block_id", "kind", "target_id")
    assert rel == [("b3", "figure", "f1"), ("b4", "figure", "f1"), ("b5", "table", "t1")]


def test_figures(spark, bundle, rows):
    block, section, table, figure = bundle
    assets = spark.createDataFrame([("d", "img/f1.png"), ("d", "../f2.png")], "doc_id string, asset_path string")
    inv = {r["figure_id"]: r for r in structure.figure_inventory(figure, block, section, assets).collect()}
    assert inv["f1"]["caption"] == "Figure of growth" and inv["f1"]["section_title"] == "1 Growth"
    assert inv["f1"]["selectable"] and not inv["f2"]["available"] and inv["f1"]["order"] == 1
    rel = structure.block_relations(block, table, figure)
    near = rows(structure.figure_neighbours(figure.where("id = 'f1'"), block, rel), "figure_id", "id")
    assert near == [("f1", "b2"), ("f1", "b5")]
    assert rows(structure.figure_sources(figure, block), "figure_id", "source_text") == [("f1", "资料来源：公司公告")]


def test_chunks_cover_blocks_in_order(bundle, rows):
    block, _, table, figure = bundle
    sized = block.select("doc_id", "id", "pos", "section_id", F.length("text_raw").alias("chars"))
    chunked = structure.chunk_blocks(sized, 60)
    got = [(r["chunk_id"], r["id"]) for r in chunked.orderBy("pos").collect()]
    assert got == [("chunk-0001", "b1"), ("chunk-0001", "b2"), ("chunk-0001", "b3"), ("chunk-0002", "b4"), ("chunk-0002", "b5"), ("chunk-0003", "b6")]
    pay = {r["chunk_id"]: r for r in structure.chunk_payloads(chunked, block, structure.block_relations(block, table, figure)).collect()}
    assert pay["chunk-0002"]["table_ids"] == ["t1"] and pay["chunk-0002"]["figure_ids"] == ["f1"]
    assert [a["id"] for a in pay["chunk-0002"]["allowed"]] == ["b4", "b5", "t1", "f1"]


def test_bundle_issues(spark, bundle, rows):
    block, section, table, figure = bundle
    doc = spark.createDataFrame([("d", 2)], "doc_id string, page_count int")
    pages = spark.createDataFrame(
        [("d", 1, 10.0, 40.0, ["b1", "b2", "b3", "b4"]), ("d", 2, 10.0, 40.0, ["b5", "b9"])], "doc_id string, page int, width double, height double, block_ids array<string>"
    )
    order = spark.createDataFrame([("d", f"b{i}") for i in (1, 2, 3, 4, 5, 5)], "doc_id string, block_id string")
    got = rows(structure.bundle_issues(doc, pages, block, order, section, table, figure), "code", "path")
    assert got == [
        ("invalid_block_page", "d/b6"), ("invalid_block_section", "d/b6"), ("invalid_page_reference", "d/b6"), ("invalid_page_reference", "d/b9"),
        ("invalid_reading_order", "d/b5"), ("invalid_reading_order", "d/b6"), ("invalid_section_reference", "d/s1"),
    ]
    from quire.functions.rules import status

    assert status(structure.bundle_issues(doc, pages, block, order, section, table, figure)).first()["status"] == "failed"


def test_region_captions(spark, rows):
    regions = spark.createDataFrame(
        [("r1", 1, "figure", 0.0, 0.0, 100.0, 100.0), ("r2", 1, "table", 0.0, 300.0, 100.0, 400.0), ("r3", 2, "figure", 0.0, 0.0, 9.0, 9.0)],
        "region_id string, page int, category string, x0 double, y0 double, x1 double, y1 double",
    )
    caps = spark.createDataFrame(
        [(1, "figure", "below", 0.0, 110.0, 90.0, 120.0), (1, "figure", "above far", 0.0, -70.0, 90.0, -60.0), (1, "table", "above", 0.0, 280.0, 90.0, 290.0), (1, "table", "thin", 95.0, 405.0, 300.0, 410.0)],
        "page int, category string, caption_text string, x0 double, y0 double, x1 double, y1 double",
    )
    assert rows(structure.region_captions(regions, caps), "region_id", "caption") == [("r1", "below"), ("r2", "above"), ("r3", "")]


@pytest.mark.parametrize("cell", [7, 200])
def test_region_captions_against_all_pairs(spark, cell):
    rng = random.Random(11)
    box = lambda: (x := rng.randrange(-50, 500), y := rng.randrange(-50, 600), x + rng.randrange(0, 260), y + rng.randrange(0, 90))
    regions = [(f"r{i}", rng.randrange(2), rng.choice("ft"), *map(float, box())) for i in range(80)]
    caps = [(rng.randrange(2), rng.choice("ft"), f"c{i}", *map(float, box())) for i in range(150)]
    want = {}
    for r, page, kind, x0, y0, x1, y1 in regions:
        best = []
        for p, k, text, a0, b0, a1, b1 in caps:
            overlap = (min(x1, a1) - max(x0, a0)) / max(1.0, min(x1 - x0, a1 - a0))
            side = 0 if -12 <= b0 - y1 <= 120 else 1 if -12 <= y0 - b1 <= 80 else None
            if (p, k) == (page, kind) and overlap >= 0.2 and side is not None:
                best.append((side, abs(b0 - y1 if side == 0 else y0 - b1), -overlap, text))
        want[r] = min(best)[3] if best else ""
    b = "x0 double, y0 double, x1 double, y1 double"
    got = structure.region_captions(
        spark.createDataFrame(regions, f"region_id string, page int, category string, {b}"),
        spark.createDataFrame(caps, f"page int, category string, caption_text string, {b}"), cell,
    )
    assert {r.region_id: r.caption for r in got.collect()} == want


def test_pages_by_postings_as_by_pairs(spark, rows):
    rng = random.Random(12)
    bits = ["see ![x](img/t2.png)", "a/b (c/f1.png)", "figure 12", "Table  3", "results", "attention", "chart", "x/y.png)", "plain", "trend bleu", "formula 1"]
    purposes = ["content", "content", "opening", None]
    pages = [(f"d{i % 4}", i, " ".join(rng.choice(bits) for _ in range(rng.randrange(4))), rng.choice(purposes[:3]), rng.randrange(2), rng.randrange(2)) for i in range(120)]
    assets = [(f"d{rng.randrange(4)}", f"img/{rng.choice(['t2', 'f1', 'y', 'q'])}{k if k > 40 else ''}.png", rng.choice(["figure", "table", "chart", "formula"]),
               rng.choice([f"Table {k % 5}: scores", f"Figure {k % 13} results", "no number", None]), rng.randrange(4), rng.randrange(9)) for k in range(60)]
    p = spark.createDataFrame(pages, "doc_id string, page int, text string, purpose string, image_count int, table_count int")
    a = spark.createDataFrame(assets, "doc_id string, path string, kind string, caption string, base int, area int")
    cues = [("table", None, ("results",), 2), (None, "scores", ("trend", "plain"), 3), ("figure", "figure", ("attention",), 1)]
    want = rows(structure.bind_assets(p, structure.score_assets(p, a, cues)), "doc_id", "page", "path", "kind", "step", "requirement")
    assert rows(structure.bind_pages(p, a, cues), "doc_id", "page", "path", "kind", "step", "requirement") == want
    assert {w[4] for w in want} == {None, 1, 2, 3, 4, 5}
    assert rows(structure.bind_pages(p, a, []), "page", "step") == rows(structure.bind_assets(p, structure.score_assets(p, a, [])), "page", "step")


def test_assets_of_one_name_are_not_paired_with_pages(spark, rows):
    pages = spark.range(200).selectExpr("'d' as doc_id", "id as page", "'see (img/x.png) and table 7' as text", "'content' as purpose", "1 as image_count", "0 as table_count")
    assets = spark.range(1000).selectExpr("'d' as doc_id", "concat('a', id, '/x.png') as path", "'table' as kind", "'Table 7' as caption", "id % 9 as base", "id % 7 as area")
    got = structure.bind_pages(pages, assets, [])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        whole = {(r.path, r.step) for r in got.collect()}
        plan = got._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert whole == {(min((-(i % 9), -(i % 7), f"a{i}/x.png") for i in range(1000))[2], 1)}

    def most(node):
        own = node.metrics().get("numOutputRows")
        below = [most(node.children().apply(i)) for i in range(node.children().size())]
        return max([own.get().value() if own.isDefined() and "Join" in node.nodeName() else 0, *below])

    assert most(plan) <= 200


def test_application_plan(spark, rows):
    assets = spark.createDataFrame(
        [("a.png", "s1", "f1"), ("b.png", "s1", "f9"), ("c.png", "s9", "f1"), ("d.png", "s1", "f1")], "filename string, slide_id string, figure_id string"
    )
    slides = spark.createDataFrame([("s1", 1)], "slide_id string, page_number int")
    sources = spark.createDataFrame([("f1", "src")], "figure_id string, source_text string")
    images = spark.createDataFrame([(1, "a.png", 0)], "page_number int, filename string, image_index int")
    assert rows(structure.application_plan(assets, slides, sources, images), "filename", "state", "reason") == [
        ("a.png", "planned", None), ("b.png", "skipped", "explicit_source_note_not_found"), ("c.png", "skipped", "slide_html_not_found"),
        ("d.png", "skipped", "image_not_used_in_final_html"),
    ]


def test_note_box_and_conflicts(spark, rows):
    df = spark.createDataFrame([("p", 1, 0.0, 200.0, 50.0, 200.0), ("p", 2, 0.0, 60.0, 50.0, 60.0)], "page string, id int, left double, right double, bottom double, width double")
    made = df.select("page", "id", structure.note_box(F.col("left"), F.col("right"), F.col("bottom"), F.col("width"), F.lit("short"), F.lit(300.0), F.lit(300.0)).alias("n"))
    got = {r["id"]: r["n"] for r in made.collect()}
    assert got[1]["box"]["bottom"] == 65.0 and got[2]["issue"] == "image_too_narrow"
    boxes = made.where("n.box is not null").select("page", "id", "n.box.*")
    blockers = spark.createDataFrame([("p", 10.0, 60.0, 20.0, 70.0)], "page string, left double, top double, right double, bottom double")
    assert rows(structure.box_conflicts(boxes, blockers, ["page"], "id")) == [("p", 1)]


def test_asset_binding(spark, rows):
    pages = spark.createDataFrame(
        [("d", 1, "opening page", "opening", 0, 0), ("d", 2, "see ![x](img/t2.png)", "content", 1, 0), ("d", 3, "the results in table 3", "content", 0, 0), ("d", 4, "plain words", "content", 0, 0)],
        "doc_id string, page int, text string, purpose string, image_count int, table_count int",
    )
    assets = spark.createDataFrame(
        [("d", "img/t2.png", "table", "Table 2: scores", 3, 10), ("d", "img/t3.png", "table", "Table 3: more", 3, 10)],
        "doc_id string, path string, kind string, caption string, base int, area int",
    )
    scored = structure.score_assets(pages, assets, [("table", None, ("results",), 2)])
    got = rows(structure.bind_assets(pages, scored), "page", "path", "requirement")
    assert got == [(1, None, "none"), (2, "img/t2.png", "required"), (3, "img/t3.png", "required"), (4, None, "none")]


def test_chart_ids(spark, rows):
    refs = spark.createDataFrame([("d", "chart:a-1"), ("d", "chart:a-1"), ("d", "chart:b c")], "doc_id string, url string")
    assert rows(structure.chart_id_issues(refs), "code", "path") == [("duplicate_chart_id", "d/a-1"), ("invalid_chart_id", "d/b c")]


def test_lookups_and_catalogue(bundle, rows):
    block, section, *_ = bundle
    b = block.withColumn("reading_order", F.col("pos"))
    assert rows(structure.on_page(b, 2), "id") == [("b5",)] and structure.in_section(b, "s2").count() == 1
    assert structure.paragraphs(b).count() == 3 and structure.location(b, "b1").first()["section_id"] == "s1"
    assert rows(structure.section_catalogue(section, block), "ordinal", "section_id", "title") == [(0, "s1", "1 Growth")]


def test_grids(spark):
    df = spark.createDataFrame([("| a | b |\n|---|:---:|\n| 1 \\| 2 | `x|y` |\n| 3 |",), ("no table",), ("| a |\n| b |\n| c |",)], "t string")
    got = readers.markdown_grid(df, "t").collect()
    assert got[0]["columns"] == ["a", "b"] and got[0]["rows"] == [["1 | 2", "`x|y`"], ["3", ""]] and got[0]["ragged"] == [2]
    assert got[1]["issue"] == "needs a header and a separator" and got[2]["issue"] == "separator row is not valid"
    html = "<table><tr><th>A</th><th>B &amp; C</th></tr><tr><td>1</td><td> <b>2</b> </td></tr></table>"
    g = spark.createDataFrame([(html,)], "h string").select(readers.html_grid(F.col("h")).alias("g")).first()["g"]
    assert g["columns"] == ["A", "B & C"] and g["rows"] == [["1", "2"]]


def test_rules_in_parts_hold_no_more_on_a_larger_table(spark, rows, monkeypatch):
    monkeypatch.setattr(rules, "PART_ROWS", 100)
    kept = spark.range(0, 900).select((F.col("id") % 300).alias("k"))
    given = spark.range(0, 1000).select("id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 400).alias("ref"))
    parts = rules.parts_of(given, kept)
    assert parts == 10
    plain = rows(rules.missing(given, kept, [("ref", "k")], "gone", "id"))
    assert len(plain) > 100 and rows(rules.missing(given, kept, [("ref", "k")], "gone", "id", parts=parts)) == plain
    assert rules.missing(given, kept, [("ref", "k")], "gone", "id", parts=parts).rdd.getNumPartitions() == parts
    assert rows(rules.missing(given.where("ref < 300"), kept, [("ref", "k")], "gone", "id", parts=parts)) == []
    twice = rules.repeated(given, ["ref"], "twice", parts=parts)
    assert twice.rdd.getNumPartitions() == parts and rows(twice) == rows(rules.repeated(given, ["ref"], "twice"))
