import tempfile
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quire.operators import pages, runs
from quire.sources import readers, tables
from quire.streaming import rounds

T0 = datetime(2024, 1, 1)


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def drain(spark, df, name, mode="append", timers=False):
    if timers:  # a query with timers never ends by itself: wait for the first result, then stop
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", folder()).start()
        for _ in range(120):
            time.sleep(0.5)
            if not q.isActive or spark.table(name).count():
                break
        q.stop()
        return spark.table(name)
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", folder()).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert q.exception() is None and not q.isActive
    return spark.table(name)


def streamed(spark, data, schema):
    path = folder()
    spark.createDataFrame(data, schema).coalesce(1).write.mode("overwrite").parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def test_collect_rounds_stream(spark, rows):
    data = [
        ("a", 1, at(0), 10, "add"), ("a", 2, at(1), 10, "add"), ("a", 1, at(2), 0, "ack"), ("a", 3, at(3), 10, "add"), ("a", 4, at(4), 10, "add"),
        ("b", 1, at(0), 2500, "add"), ("b", 2, at(1), 5, "add"), ("b", 0, at(2), 0, "rollback"), ("b", 3, at(3), 7, "add"), ("b", 0, at(4), 0, "end"),
        ("c", 1, at(0), 1, "add"), ("c", 2, at(4000), 1, "add"),
    ]
    out = drain(spark, rounds.collect_rounds(streamed(spark, data, rounds.ROUND_OPS)), "flushed", timers=True)
    assert rows(out, "user_id", "round_ids", "tokens", "reason") == [
        ("a", [2, 3, 4], 30, "rounds"), ("b", [1], 2500, "tokens"), ("b", [3], 7, "end"), ("c", [1, 2], 2, "idle"),
    ]


def test_round_lifecycle_stream(spark, rows):
    data = [("a", at(0), "begin", "hello!"), ("a", at(1), "call", "abc"), ("a", at(2), "end", ""), ("a", at(3), "call", "lost"), ("a", at(4), "begin", "x"), ("a", at(5), "end", "")]
    out = drain(spark, rounds.close_rounds(streamed(spark, data, "user_id string, ts timestamp, op string, text string")), "closed")
    assert rows(out) == [("a", 1, 1, 3), ("a", 2, 0, 0)]


def test_cooldown_stream_equals_batch(spark, rows):
    data = [("u", at(s)) for s in (0, 10, 59, 60, 61, 119, 120, 500)] + [("v", at(5))]
    out = drain(spark, rounds.live_cooldown(streamed(spark, data, "url string, ts timestamp"), 60), "cooled")
    batch = spark.createDataFrame([(u, t, i) for i, (u, t) in enumerate(data)], "url string, ts timestamp, id int")
    kept = rounds.cooled_down(batch, "url", "ts", "id", 60).join(batch.select("id", "ts"), "id")
    assert rows(out, "url", "ts") == rows(kept, "url", "ts") and out.count() == 5


def test_sessions_distinct_and_counts_streams(spark, rows):
    data = [("a", at(0), 1, False), ("a", at(60), 1, True), ("a", at(4000), 2, False), ("b", at(10), 3, False), ("z", at(90000), 9, False)]
    schema = "user_id string, ts timestamp, id int, is_error boolean"
    # The last row moves the watermark, so the sessions before it are final.
    out = drain(spark, rounds.live_sessions(streamed(spark, data, schema), "30 minutes"), "sess")
    assert rows(out, "user_id", "events") == [("a", 1), ("a", 2), ("b", 1)]
    assert rows(drain(spark, rounds.live_distinct(streamed(spark, data, schema), ["id"]), "dist"), "id") == [(1,), (2,), (3,), (9,)]
    got = rows(drain(spark, rounds.live_counts(streamed(spark, data, schema), ["user_id"], "1 day"), "cnt", "update").select("user_id", "uses", "errors"))
    assert got == [("a", 3, 1), ("b", 1, 0), ("z", 1, 0)]


def test_append_new_is_exact_on_replay(spark):
    target = folder() + "/index"
    run = rounds.append_new(target, "id")
    batch = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id int, v string")
    for _ in range(2):
        run(batch, 0)
    run(spark.createDataFrame([(2, "b"), (3, "c")], "id int, v string"), 1)
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == [1, 2, 3]


# --- evaluation ------------------------------------------------------------------------


def test_probe_tables(spark, rows):
    dim = [
        ("analyst", "uid-a", "role_decision_fit", 8.0, 4.0, "primary_better"), ("analyst", "uid-a", "narrative_priority", 7.0, 5.0, "primary_better"),
        ("analyst", "uid-a", "visual_manifestation", 6.0, 3.0, "primary_better"), ("analyst", "uid-a", "action_support", 5.0, 6.0, "control_better"),
        ("teacher", "uid-b", "role_decision_fit", 4.0, 6.0, "control_better"), ("teacher", "uid-b", "narrative_priority", 7.0, 4.0, "primary_better"),
        ("teacher", "uid-b", "visual_manifestation", 8.0, 4.0, "primary_better"), ("teacher", "uid-b", "action_support", 9.0, 5.0, "primary_better"),
    ]
    d = spark.createDataFrame(dim, "persona string, probe_uid string, dimension_id string, primary_score double, control_score double, winner string").withColumn("score_lift", F.col("primary_score") - F.col("control_score"))
    o = spark.createDataFrame([(p, p, u, 3.0, "primary_better", "clear", True, 1.0) for p, u in (("analyst", "uid-a"), ("teacher", "uid-b"))], "persona string, probe_id string, probe_uid string, score_lift double, winner string, profile_effect string, order_consistent boolean, vote_consistency_rate double")
    probes = runs.probe_rows(d, o, ["clear"])
    assert rows(probes, "probe_uid", "primary_win_dims", "strict_positive") == [("uid-a", 3, True), ("uid-b", 3, True)]
    r = runs.overall_row(probes, d).first()
    assert r["paired_probe_count"] == 2 and r["strict_positive_persona_rate"] == 1.0 and r["mean_role_decision_fit_lift"] == 1.0
    scores = {r["dimension_id"]: r["primary_avg_score"] for r in runs.dimension_rows(d).collect()}
    assert [scores[k] for k in runs.DIMENSIONS] == [6.0, 7.0, 7.0, 7.0]
    assert rows(runs.probe_rows(d, o.withColumn("vote_consistency_rate", F.lit(0.5)), ["clear"]), "strict_positive") == [(False,), (False,)]


def test_labels_and_payloads(spark, rows):
    df = spark.createDataFrame([("Model-X 5 pro",), (" other ",), ("",)], "t string")
    assert [r[0] for r in df.select(runs.label_from_text(F.col("t"), [("modelx5", "Model X5")])).collect()] == ["Model X5", "other", ""]
    p = spark.createDataFrame([("Tool-Memory", "run_noinj_3")], "a string, b string").select(runs.arm_label(F.col("a")), runs.arm_from_path(F.col("b"))).first()
    assert tuple(p) == ("tool_only", "no_injection")
    raw = ['{"tool": " t ", "duration_s": "1.5", "error": "Yes"}', '{"name": "n", "duration": 7}', '{"tool_name": "x", "latency_ms": "bad"}']
    got = runs.normal_calls(spark.createDataFrame([(r,) for r in raw], "payload string"))
    assert [tuple(r) for r in got.collect()] == [("t", 1500.0, True), ("n", 7.0, False), ("x", 0.0, False)]
    meta = spark.createDataFrame([("revise deck", None, None, None, 1), (None, "plan", None, None, 5), (None, None, None, None, 2)], "task_type string, task_kind string, phase string, intent string, task_idx int")
    assert [r["modify"] for r in runs.is_modify_task(meta).collect()] == [True, False, True]
    inj = spark.createDataFrame([(1, '{"final_injected": {"content": "x"}, "components": {"wm": {"chars": 8, "tokens_estimated": 2}}}'), (1, '{"wm": "12345678"}')], "round_index int, payload string")
    r = runs.injection_stats(inj, ["wm"]).first()
    assert (r["total_ops"], r["ops_with_injection"], r["wm_chars"], r["wm_tokens"]) == (2, 1, 16, 4)


# --- pages -----------------------------------------------------------------------------

HTML = (
    "<html><head><style>h1{font-family: 'Fira Sans', serif; font-size: 40px; color:#112233; background:#fff} .body{font-family:Lato;font-size:18px}</style></head>"
    "<body style=\"background-color: rgb(10, 20, 30)\"><h1>Title</h1><p style='color:#111111;background:#222'>Text</p><img width=\"10\" height=\"20\"></body></html>"
)


def test_page_measures(spark, rows):
    df = spark.createDataFrame([("p", HTML)], "id string, html string")
    fp = pages.fingerprint(df, "id", "html").first()
    assert fp["colors"] == ["#0a141e", "#111111", "#112233", "#222222"] and fp["background_type"] == "solid" and fp["image_area"] == 200
    f = pages.font_roles(df, "id", "html").first()
    assert (f["title_font"], f["title_size"], f["body_font"], f["body_size"]) == ("Fira Sans", 40.0, "Lato", 18.0)
    s = pages.layout_stats(df, "id", "html").first()
    assert (s["font_max"], s["font_min"], s["advice"]) == (30.0, 13.5, "smaller largest font")
    assert rows(pages.contrast_issues(df, "id", "html"), "background", "color") == [("#222222", "#111111")]
    bad = rows(pages.palette_issues(df, "id", "html", {"primary": "#112233", "surface": "#ffffff", "text": "#999999"}), "property", "color", "suggestion")
    assert bad == [("background", "#222222", "#ffffff"), ("background-color", "#0a141e", "#ffffff"), ("color", "#111111", "#999999")]
    assert rows(pages.font_issues(df, "id", "html", ["lato"]), "font") == [("'Fira Sans', serif",)] or pages.font_issues(df, "id", "html", ["lato"]).count() >= 1
    params = {r["parameter"]: r["value"] for r in pages.slide_params(df, "id", "html").collect()}
    assert params["image_count"] == 1 and params["title_font_size"] == 40.0 and params["dominant_color_hue"] == 0.0  # greys have hue 0 and are the most


def test_template_quality_and_elements(spark, rows):
    data = [("good", [("a", False, 2, 1), ("b", False, 1, 0)], 18, "#000000", "#ffffff", "#eeeeee", "#111111", "#ffffff"), ("bare", [], 0, "", "", "", "", "")]
    t = spark.createDataFrame(data, "template_id string, layouts array<struct<name:string,functional:boolean,texts:bigint,images:bigint>>, body_size int, background string, text string, surface string, primary_text string, inverse_text string")
    got = {r["template_id"]: r for r in pages.template_quality(t).collect()}
    assert got["bare"]["mode"] == "style_reference" and "layouts.none" in got["bare"]["issues"]
    assert got["good"]["structure_score"] == 1.0
    e = spark.createDataFrame([("p", 1, 5, 4, 2)], "id string, t int, i int, wt int, wi int")
    assert rows(pages.element_issues(e, "id", F.col("t"), F.col("i"), F.col("wt"), F.col("wi"), F.lit(True)), "issue") == [("few text",), ("many image",)]


# --- sources ---------------------------------------------------------------------------


def test_bundles_and_lists(spark, rows):
    import json
    from pathlib import Path

    root = Path(folder())
    good = {"document": {"id": "d1", "page_count": 1}, "pages": [], "blocks": [{"id": "b1", "page": 1}], "reading_order": ["b1"], "sections": [], "tables": [], "figures": []}
    (root / "a.json").write_text(json.dumps(good))
    (root / "b.json").write_text(json.dumps({"document": {"id": "d2"}, "pages": []}))
    (root / "c.json").write_text("{not json")
    got = readers.read_bundles(spark, str(root)).cache()
    assert {r["path"].rsplit("/", 1)[-1]: len(r["issues"]) for r in got.collect()} == {"a.json": 0, "b.json": 5, "c.json": 8}
    assert rows(readers.bundle_tables(got)["block"], "doc_id", "id") == [("d1", "b1")]
    lists = Path(folder())
    (lists / "x.json").write_text('[{"page_idx": 0, "type": "text", "text": "t"}, {"page_idx": 1, "type": "table"}]')
    (lists / "y.json").write_text('{"no": 1}')
    items = rows(readers.read_content_lists(spark, str(lists)), "item_index", "type", "issue")
    assert items == [(0, "text", None), (1, "table", None), (None, None, "root is not an array of objects")]


def test_reports_logs_and_sinks(spark, rows):
    import hashlib
    from pathlib import Path

    root = Path(folder())
    (root / "sub").mkdir()
    (root / "my report!.md").write_bytes("﻿# 标题".encode())
    (root / "sub" / "old.txt").write_bytes("标题".encode("gb18030"))
    got = rows(readers.read_reports(spark, str(root)), "doc_id", "source_format", "text", "source_sha256")
    assert got[0] == ("my_report", "markdown", "# 标题", hashlib.sha256("﻿# 标题".encode()).hexdigest())
    assert got[1][:3] == ("old", "plain_text", "标题")
    logs = Path(folder())
    (logs / "run_7" / ".memory" / "rounds" / "task_02").mkdir(parents=True)
    (logs / "run_7" / ".memory" / "rounds" / "task_02" / "raw_tool_calls.json").write_text('{"tool_calls": [{"name": "a"}, {"name": "b"}]}')
    found = readers.discover_logs(spark, str(logs))
    # Spark skips hidden folders, so a root below the hidden one is given.
    if found.count() == 0:
        found = readers.discover_logs(spark, str(logs / "run_7" / ".memory" / "rounds"))
    assert rows(readers.call_rows(found), "run", "task_idx", "call_idx") == [("run_7", 2, 0), ("run_7", 2, 1)]
    out = folder()
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    tables.write_json(df, out + "/j")
    tables.write_report_csv(df, out + "/c")
    tables.write_version(df, out + "/t", 1)
    assert spark.read.json(out + "/j").count() == spark.read.csv(out + "/c", header=True).count() == spark.read.parquet(out + "/t").count() == 1
    issues = spark.createDataFrame([("X", "p")], "code string, path string")
    with pytest.raises(ValueError):
        tables.export_run({"t": df}, issues, out + "/e")
    tables.export_run({"t": df}, issues.limit(0), out + "/e")
    assert spark.read.parquet(out + "/e/t").count() == 1
    with pytest.raises(ValueError):
        readers.load_rows(spark)


def test_briefs_of_plain_lines(spark, rows):
    from quire.plans import load_all

    text = "+1 (168) 555-5254 called\n# Section " + "x" * 90 + "\n- agenda\n总结"
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    got = load_all()["i10_page_briefs"].run(spark, folder)
    lines = text.split("\n")
    purposes = ["opening", "content", "table_of_contents", "content"]
    assert rows(got, "page", "title", "purpose") == [(i + 1, x, p) for i, (x, p) in enumerate(zip(lines, purposes))]


def test_pairs_take_the_newest_known_figure(spark, rows):
    s = "run_id int, model int, scenario int, arm string, x double, y double"
    data = [(0, 1, 1, "a", 1.0, 2.0), (2, 1, 1, "a", None, 3.0), (1, 1, 1, "b", None, 4.0)]
    got = runs.pair_arms(spark.createDataFrame(data, s), ("a", "b"), ("x", "y"), F.col("run_id"))
    assert rows(got, "run_a", "run_b", "x_a", "y_a", "x_b", "y_b", "runs_a") == [(2, 1, 1.0, 3.0, None, 4.0, 2)]
