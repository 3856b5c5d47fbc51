"""The bucketed index against a plain set, and exports that appear at once or not at all."""

import random
import tempfile

import pytest

from quire.sources import tables
from quire.sources.index import BucketedIndex


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


@pytest.mark.parametrize("words", [1, 1 << 14])
def test_index_against_a_plain_set(spark, words):
    """With one word a filter is soon full, so every id is looked up; results do not change."""
    rng = random.Random(words)
    index, held = BucketedIndex(folder() + "/i", "id", buckets=4, words=words), {}
    for batch in range(3):
        ids = [rng.randrange(300) for _ in range(120)] + [None, None]
        rows = spark.createDataFrame([(i, batch) for i in ids], "id long, batch int")
        new = {i for i in ids if i is not None} - held.keys()
        held |= dict.fromkeys(new, batch)
        assert {r.id for r in index.append(rows).collect()} == new
        assert index.append(rows).count() == 0  # a replay adds nothing
    assert {r.id: r.batch for r in index.rows(spark).collect()} == held and index.rows(spark).count() == len(held)


def test_index_reads_touched_buckets_only(spark):
    index = BucketedIndex(folder() + "/i", "id", buckets=16)
    index.append(spark.range(200))
    assert index.maybe_known(spark.range(1000, 1200)).count() <= 10
    assert index.maybe_known(spark.range(200)).count() == 200
    plan = index.fresh(spark.createDataFrame([(7,)], "id long"))._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan and "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket#")


def test_filter_ahead_of_data_loses_nothing(spark):
    """After a crash between the two writes the filter holds ids that the data does not."""
    index = BucketedIndex(folder() + "/i", "id", buckets=2)
    index.append(spark.range(10))
    index.probes(spark.range(10, 20)).select("bucket", "word", "bits").write.mode("append").parquet(index.path + "/filter")
    assert {r.id for r in index.append(spark.range(5, 20)).collect()} == set(range(10, 20))


def test_string_ids_and_empty_batches(spark):
    index = BucketedIndex(folder() + "/i", "k")
    empty = spark.createDataFrame([], "k string")
    assert index.append(empty).count() == 0
    assert index.append(spark.createDataFrame([("a",), ("a",), ("",)], "k string")).count() == 2
    assert index.append(empty).count() == 0 and index.rows(spark).count() == 2


def run_tables(spark, **change):
    given = {
        "slides": [("d", "s1"), ("d", "s2")],
        "artifacts": [("d", "c", "s1", "chart", "bar", 2, 0, 0, 1), ("d", "t", "s2", "table", None, 0, 2, 3, 1), ("d", "i", "s2", "image", None, 0, 0, 0, 1)],
        "series": [("d", "c", 1, "x", 2), ("d", "c", 2, "y", 2)],
        "audit": [("d", "passed", 0)],
        "bindings": [("d", "c", "p1", "f1"), ("d", "t", "p1", "f2")],
    } | change
    kinds = {
        "slides": "doc_id string, slide_id string", "series": "doc_id string, artifact_id string, series_no int, name string, values int",
        "artifacts": "doc_id string, artifact_id string, slide_id string, kind string, chart_type string, categories int, columns int, rows int, sources int",
        "audit": "doc_id string, status string, mismatches int", "bindings": "doc_id string, artifact_id string, output_path string, fact_id string",
    }
    return {k: spark.createDataFrame(v, kinds[k]) for k, v in given.items()}


CHART = ("d", "c", "s1", "chart", "bar", 2, 0, 0, 1)


@pytest.mark.parametrize("code, change", [
    (None, {}),
    ("DUPLICATE_SLIDE", {"slides": [("d", "s1"), ("d", "s2"), ("d", "s1")]}),
    ("UNKNOWN_SLIDE", {"slides": [("d", "s1")]}),
    ("SERIES_NAMES", {"series": [("d", "c", 1, " x", 2), ("d", "c", 2, "x", 2)]}),
    ("SERIES_LENGTH", {"series": [("d", "c", 1, "x", 3)]}),
    ("EMPTY_CHART", {"series": []}),
    ("AUDIT", {"audit": [("d", "passed", 1)]}),
    ("AUDIT_MISSING", {"audit": []}),
    ("NOT_AUDITED", {"bindings": [("d", "c", "p1", "f1")]}),
    ("UNKNOWN_BINDING", {"bindings": [("d", "c", "p1", "f1"), ("d", "t", "p1", "f2"), ("d", "z", "p1", "f2")]}),
    ("BINDING", {"bindings": [("d", "c", "p1", "f1"), ("d", "c", "p1", "f2"), ("d", "t", "p1", "f2")]}),
])
def test_export_rules(spark, code, change):
    got = {r.code.removeprefix("EXPORT.") for r in tables.export_issues(**run_tables(spark, **change)).collect()}
    assert got == ({code} if code else set())


def test_export_rules_on_copies_nulls_and_parts(spark, rows):
    """Copies of charts meet every series; a null key meets nothing; each rule names what it should."""
    odd = run_tables(
        spark,
        artifacts=[CHART, CHART, ("d", "c", "s1", "chart", "pie", None, 0, 0, 1), (None, "t", "s1", "table", None, 0, 1, 1, 1), ("d", "i", "s9", None, None, 0, 0, 0, None), ("d", "e", "s1", "chart", "combo", 2, 0, 0, 1)],
        series=[("d", "c", 1, "x", 2), ("d", "c", None, "y", None), ("d", "e", 1, "x", 2), ("d", "e", 2, "x", 2), ("d", "z", 1, "", 1)],
        bindings=[("d", "c", "p1", "f1"), ("d", "c", "p2", None), ("d", "z", "p1", "f1"), ("d", "z", "p1", "f1"), (None, "t", None, "f1"), ("d", "e", None, "f1")],
    )
    want = sorted([
        ("BINDING", "d/c/p2"), ("BINDING", "d/z/p1"), ("DUPLICATE_ARTIFACT", "d/c"), ("EMPTY_CHART", "d/c"), ("NOT_AUDITED", "t"), ("NO_SOURCE", "d/i"),
        ("PIE_SERIES", "d/c"), ("SERIES_NAMES", "d/e"), ("UNKNOWN_BINDING", "d/z"), ("UNKNOWN_BINDING", "d/z"), ("UNKNOWN_SLIDE", "d/i"), ("UNSUPPORTED_CHART", "d/e"),
    ])
    odd["series"] = odd["series"].where("artifact_id <> 'c' or series_no is not null")
    # Two copies of the bar chart meet one series: two numbered series, one name.
    want = sorted([*want, ("SERIES_NAMES", "d/c")])
    want.remove(("PIE_SERIES", "d/c"))
    for parts in (None, 3):
        got = [(r.code.removeprefix("EXPORT."), r.path) for r in tables.export_issues(**odd, parts=parts).collect()]
        assert sorted(got) == want


def test_artifacts_are_dealt_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    plan = tables.export_issues(**run_tables(spark), parts=3)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # By artifact; artifacts and slides by slide, artifacts and audit by document, slides once more.
    assert plan.count("Exchange hashpartitioning") <= 6 and "SortMergeJoin" not in plan


def test_publish_at_once_or_not_at_all(spark):
    root = folder() + "/out"
    given = run_tables(spark)
    none = tables.export_issues(**given)
    tables.publish(given, none, root)
    assert tables.read_published(spark, root, "series").count() == 2
    bad = tables.export_issues(**run_tables(spark, audit=[]))
    with pytest.raises(ValueError, match="AUDIT_MISSING"):
        tables.publish({"series": given["series"].limit(1)}, bad, root)
    assert tables.read_published(spark, root, "series").count() == 2

    def fails(x):
        raise ValueError("lost")

    broken = given["series"].rdd.map(fails).toDF("a int")
    with pytest.raises(Exception):  # noqa: B017
        tables.publish({"series": given["series"].limit(1), "slides": broken}, none, root)
    assert tables.read_published(spark, root, "series").count() == 2
    tables.publish({"series": given["series"].limit(1)}, none, root)
    assert tables.read_published(spark, root, "series").count() == 1
    assert {r.number for r in tables.published(spark, root).collect()} == {1, 2}
