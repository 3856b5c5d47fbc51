from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quire.functions.spans import spans
from quire.operators import facts
from quire.session import cut


def blocks(spark, *texts):
    return spark.createDataFrame([("d", f"b{i}", "paragraph", t) for i, t in enumerate(texts, 1)], "doc_id string, id string, type string, text_raw string")


def test_spans_match_python(spark):
    import re

    texts = ["a12b345", "7", "", "x", "12 34 5", "ab1"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", spans(F.col("t"), r"\d+").alias("s"))
    for r in df.collect():
        assert [(s["start"], s["end"], s["value"]) for s in r["s"]] == [(m.start(), m.end(), m.group()) for m in re.finditer(r"\d+", r["t"])]


def test_period_labels(spark):
    df = spark.createDataFrame([("2021-2023年营收，2024E，Q1",), ("2020年末与2020年",), ("2000至2030",)], "t string")
    got = [r["p"] for r in df.select(facts.period_labels(F.col("t")).alias("p")).collect()]
    assert got == [["2021", "2022", "2023", "2024E", "Q1"], ["2020"], ["2000", "2030"]]


def test_block_facts(spark):
    text = "2023年营业收入达到1,200.5亿元，净利润为80亿元，毛利率25%"
    got = facts.block_facts(blocks(spark, text, "no numbers here", "版本 12 号")).orderBy("start").collect()
    assert [(r["raw_value"], r["unit"], r["metric_key"], r["measure_kind"]) for r in got] == [
        ("1,200.5", "亿元", "revenue", "amount"), ("80", "亿元", "net_profit", "amount"), ("25", "%", "gross_margin", "ratio"),
    ]
    assert got[0]["normalized_value"] == Decimal("1200.5") and got[0]["period"] == "2023" and got[0]["label"] == "营业收入"
    assert text[got[1]["start"] : got[1]["end"]] == "80" and got[0]["unit_scale"] == "100000000"
    assert all(r["fact_id"].startswith("fact_") and len(r["fact_id"]) == 25 for r in got)


def test_shared_unit_and_scenario(spark):
    got = facts.block_facts(blocks(spark, "预计2024E收入为10亿元、2025E收入为12")).orderBy("start").collect()
    assert [(r["raw_value"], r["unit"], r["period"], r["scenario"]) for r in got] == [("10", "亿元", "2024E", "estimate"), ("12", "亿元", "2025E", "estimate")]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(
        [("d", "t1", "complete", ["指标（亿元）", "2022年", "2023年", "2024年E", "2025年E"], [["营业收入", "1", "2", "3", "4"], ["净利润", "0.5", "0.6", "0.7", "0.8"], ["备注", "--", "n/a", "x", ""]])],
        "doc_id string, id string, status string, columns array<string>, rows array<array<string>>",
    )


def test_table_facts_and_candidates(spark, table, rows):
    got = rows(facts.table_facts(table), "row_index", "column_index", "raw_value", "unit", "period", "metric_key")
    assert got[0] == (0, 1, "1", "亿元", "2022", "revenue") and len(got) == 8
    c = facts.table_candidates(table).first()
    assert (c["visual_type"], c["chart_intent"], c["score"]) == ("chart", "trend", 1.0)


def test_composition_table(spark):
    t = spark.createDataFrame([("d", "t", "complete", ["产品", "占比"], [["A", "50%"], ["B", "30%"], ["C", "20%"], ["合计", "100%"]])], "doc_id string, id string, status string, columns array<string>, rows array<array<string>>")
    assert facts.table_candidates(t).first()["chart_intent"] == "composition"
    plans = spark.createDataFrame([("d", "p1", "t", "composition")], "doc_id string, plan_id string, id string, chart_intent string")
    pts = facts.table_proposals(plans, t, cut(facts.table_facts(t))).orderBy("point").collect()
    assert [(p["category"], p["series"]) for p in pts] == [("A", "占比"), ("B", "占比"), ("C", "占比")]


def test_proposals_groups_and_rules(spark, table, rows):
    prose = cut(facts.block_facts(blocks(spark, "2021年收入10亿元，2022年收入12亿元，2023年收入15亿元，2024年收入19亿元")))
    led = cut(facts.ledger(prose, cut(facts.table_facts(table))))
    assert facts.ledger_issues(led).count() == 0
    plans = spark.createDataFrame([("d", "p1", "b1", None), ("d", "p2", "t1", None)], "doc_id string, plan_id string, id string, chart_intent string")
    one = facts.block_proposals(plans, led).first()
    assert (one["intent"], one["chart_type"], one["unit"]) == ("trend", "line", "亿元") and one["categories"] == ["2021", "2022", "2023", "2024"]
    assert facts.chart_bindings(facts.block_proposals(plans, led)).count() == 4
    pts = cut(facts.table_proposals(plans, table, led))
    assert rows(pts.select("plan_id", "series", "category").where("series_no = 1")) == [("p2", "营业收入", p) for p in ("2022", "2023", "2024", "2025")]
    group = facts.metric_groups(pts, led).first()
    assert group["reject"] is None and group["metric_key"] == "revenue" and len(group["fact_ids"]) == 4
    charts = spark.createDataFrame([("d", "p2", "line", "亿元")], "doc_id string, plan_id string, chart_type string, unit string")
    allowed = spark.createDataFrame([("d", "p2", "table", "t1")], "doc_id string, plan_id string, kind string, id string")
    assert facts.chart_issues(pts, led, allowed, charts).count() == 0
    other = allowed.withColumn("id", F.lit("t9"))
    bad = rows(facts.chart_issues(pts, led, other, charts.withColumn("unit", F.lit("%"))).select("code").distinct())
    assert bad == [("fact_outside_evidence",), ("unit_differs",)]
    doc = facts.chart_documents(pts, led).first()
    assert doc["categories"] == ["2022", "2023", "2024", "2025"] and [float(x) for x in doc["series"][0]["values"]] == [1, 2, 3, 4]


def test_forecast_boundary(spark, rows):
    df = spark.createDataFrame(
        [("a", 1, 1, "actual"), ("a", 1, 2, "estimate"), ("b", 1, 1, "estimate"), ("b", 1, 2, "actual"), ("c", 1, 1, "actual"), ("c", 2, 1, "estimate")],
        "k string, s int, pos int, scenario string",
    )
    assert rows(facts.forecast_boundary(df, ["k"], "s", "pos", F.col("scenario"))) == [("a", 2, True), ("b", 1, False), ("c", 1, False)]


def test_mixed_groups_get_the_first_code(spark, rows):
    df = spark.createDataFrame([("a", "revenue", "amount"), ("a", "eps", "amount"), ("b", "unknown", "amount"), ("c", "revenue", "amount"), ("c", "revenue", "ratio")], "k string, metric_key string, measure_kind string")
    assert rows(facts.compatibility(df, ["k"]), "k", "reject") == [("a", "reject.mixed_metric"), ("b", "reject.incomplete_metric_typing"), ("c", "reject.mixed_measure_kind")]


def test_checked_cells_and_audit(spark, table, rows):
    led = cut(facts.table_facts(table))
    cells = facts.checked_cells(table, led)
    assert cells.where("issue is not null").count() == 0 and facts.table_bindings(cells).count() == 8
    fewer = led.where("column_index > 1")
    assert rows(facts.checked_cells(table, fewer).where("issue is not null"), "row_index", "column_index") == [(0, 1), (1, 1)]
    out = spark.createDataFrame([("f1", "1.50"), ("f2", "2"), ("f3", "3")], "fact_id string, out string")
    src = spark.createDataFrame([("f1", "1.5"), ("f2", "2.1"), ("f4", "4")], "fact_id string, v string")
    audit = facts.numeric_audit(out, src, ["fact_id"], "out", "v")
    assert rows(audit, "fact_id", "status") == [("f1", "matched"), ("f2", "mismatch"), ("f3", "unknown"), ("f4", "missing")]
    assert facts.audit_rollup(audit).first()["audit"] == "failed"


def test_audit_gate(spark, rows):
    schema = "slide_id string, visualization_id string, status string"
    audit = spark.createDataFrame([("s", "v1", "passed"), ("s", "v2", "failed"), ("s", "v1", "passed")], schema)
    entries = spark.createDataFrame([("s", "v2", "mismatch")], schema)
    needed = spark.createDataFrame([("s", "v1"), ("s", "v3")], "slide_id string, visualization_id string")
    assert rows(facts.audit_gate(audit, entries, needed), "code", "path") == [
        ("audit_not_passed", "s/v2"), ("duplicate_audit", "s/v1"), ("missing_audit", "s/v3"), ("unmatched_value", "s/v2"),
    ]


def test_scoped_candidates_prefer_direct_hits(spark, rows):
    slides = spark.createDataFrame([("d", "s1", "content", None, "x"), ("d", "s2", "content", None, "x"), ("d", "s3", "title", None, "x")], "doc_id string, slide_id string, page_role string, slide_type string, section_ref string")
    refs = spark.createDataFrame([("d", "s1", "block", "b1"), ("d", "s2", "block", "b2")], "doc_id string, slide_id string, kind string, id string")
    evidence = spark.createDataFrame([("d", "block", f"b{i}", "x", i) for i in range(1, 30)], "doc_id string, kind string, id string, section_id string, pos int")
    relations = spark.createDataFrame([], "doc_id string, block_id string, kind string, target_id string")
    cand = spark.createDataFrame([("d", "block", b, "chart", "trend", 0.8) for b in ("b1", "b3", "b25")], "doc_id string, kind string, id string, visual_type string, chart_intent string, score double")
    assert rows(facts.scoped_candidates(slides, refs, evidence, relations, cand), "slide_id", "id") == [("s1", "b1"), ("s2", "b1"), ("s2", "b3")]


def test_candidate_hash_is_canonical(spark):
    import hashlib
    import json

    df = spark.createDataFrame([(None, "chart", "trend", [("block", "b1")])], "s string, v string, i string, r array<struct<kind:string,id:string>>")
    got = df.select(facts.candidate_id(F.col("s"), F.col("v"), F.col("i"), F.col("r")).alias("c")).first()["c"]
    body = json.dumps({"slide_id": None, "visual_type": "chart", "chart_intent": "trend", "evidence_refs": [["block", "b1"]]}, sort_keys=True, separators=(",", ":"))
    assert got == "cand_" + hashlib.sha256(body.encode()).hexdigest()[:16]


def test_split_issues_and_modes(spark, rows):
    issues = spark.createDataFrame([("v1", "x"), ("v1", "safe"), ("v2", "x")], "visualization_id string, code string")
    explicit = spark.createDataFrame([("v1",)], "visualization_id string")
    assert rows(facts.split_issues(issues, explicit, ("safe",)), "visualization_id", "code", "effect") == [("v1", "safe", "warning"), ("v1", "x", "blocking"), ("v2", "x", "warning")]
    a = spark.createDataFrame([("s", "e1", 1.0)], "k string, e string, score double")
    b = spark.createDataFrame([("s", "e1", 0.9), ("s", "e2", 0.8), ("s", "e3", 0.7)], "k string, e string, score double")
    assert rows(facts.merge_plans(a, b, ["k"], ["e"], "score"), "e", "origin") == [("e1", "explicit"), ("e2", "located")]
    assert facts.merge_plans(a, b, ["k"], ["e"], "score", mode="shadow").count() == 1
    with pytest.raises(ValueError):
        facts.merge_plans(a, b, ["k"], ["e"], "score", mode="other")
    assert rows(facts.candidate_report(a, b, ["k"], ["e"]), "e", "decision") == [("e1", "planned"), ("e2", "not planned"), ("e3", "not planned")]


def test_clear_winner(spark, rows):
    s = spark.createDataFrame([("a", "x", 5.0), ("a", "y", 4.0), ("b", "x", 5.0), ("b", "y", 2.0), ("c", "x", 1.0)], "q string, id string, score double")
    assert rows(facts.clear_winner(s, "q", "id", "score"), "q", "id") == [("b", "x"), ("c", "x")]


def test_tables_of_one_small_file_are_dealt(spark, tmp_path):
    from quire.plans import load_all
    from quire.plans.registry import Tables

    parts = spark.range(50).selectExpr("id as p_partkey", "'Bolt' as p_name", "cast(7 as int) as p_size", "1234.5D as p_retailprice")
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = load_all()["c05_table_facts"].run(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted((r.source_id, r.value) for r in got.collect()) == sorted((i, v) for i in range(50) for v in (7.0, 1234.5))
    assert Tables(spark, str(tmp_path)).spread("part", "p_partkey", 2).rdd.getNumPartitions() == 25
