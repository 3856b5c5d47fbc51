"""Table changes as pure transforms, and the sinks that write results."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.rules import ERROR, all_issues, missing, repeated, rule
from quire.functions.scan import each


def append_rows(df: DataFrame, delta: DataFrame) -> DataFrame:
    return df.unionByName(delta)


def update_rows(df: DataFrame, where: Column, values: Mapping[str, Column]) -> DataFrame:
    """Set columns where the predicate holds; a null predicate changes nothing."""
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_rows(df: DataFrame, where: Column) -> DataFrame:
    return df.where(~F.coalesce(where, F.lit(False)))


def upsert(df: DataFrame, delta: DataFrame, keys: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Merge on a unique key. Existing rows take the new values, but keep the ``keep`` columns
    (id, owner, first time); unknown keys are added."""
    old, new = df.alias("o"), delta.withColumn("_new", F.lit(True)).alias("n")

    def pick(c: str) -> Column:
        if c in keep:
            return F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c)
        return F.when(F.col("_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)

    rest = [c for c in df.columns if c not in keys]
    return old.join(new, list(keys), "full_outer").select(*keys, *[pick(c) for c in rest])


def add_to_index(index: DataFrame, new: DataFrame, id: str) -> DataFrame:
    """Append rows whose id the index does not hold."""
    return index.unionByName(new.join(index.select(id), id, "left_anti"))


def index_candidates(df: DataFrame, indexed: DataFrame, id: str, active: Column, created: Sequence[str], cap: int | None = 1000) -> DataFrame:
    """The newest ``cap`` active rows that still need an index entry, or all of them for None."""
    newest = df.where(active)
    if cap is not None:
        newest = newest.orderBy(*[F.desc(c) for c in created], F.desc(id)).limit(cap)
    return newest.join(indexed.select(id), id, "left_anti")


def write_json(df: DataFrame, path: str) -> None:
    """Replace the artifact; the commit protocol makes the change atomic."""
    df.write.mode("overwrite").json(path)


def write_report_csv(df: DataFrame, path: str) -> None:
    """A summary table as headed files, one per partition of ``df``; a small result of an
    aggregation is one partition already."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_version(df: DataFrame, root: str, version: int, partition: Sequence[str] = ()) -> str:
    """Write a new version folder of a table and return its path."""
    path = f"{root}/version={version}"
    df.write.mode("errorifexists").partitionBy(*partition).parquet(path)
    return path


def export_run(tables: Mapping[str, DataFrame], issues: DataFrame, root: str) -> None:
    """Write all tables of a run, or raise before the first write if a rule failed."""
    failed = issues.limit(20).collect()
    if failed:
        raise ValueError("export refused: " + "; ".join(f"{r['code']} {r['path']}" for r in failed))
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")


def export_issues(slides: DataFrame, artifacts: DataFrame, series: DataFrame, audit: DataFrame, bindings: DataFrame, parts: int | None = None) -> DataFrame:
    """What keeps a run from being exported: outline, artifacts and numeric audit checked against
    each other. ``slides``: doc_id, slide_id; ``artifacts``: doc_id, artifact_id, slide_id, kind
    (chart, table or image), chart_type, categories, columns, rows, sources (counts); ``series``:
    doc_id, artifact_id, series_no, name, values (count); ``audit``: doc_id, status, mismatches;
    ``bindings``: doc_id, artifact_id, output_path, fact_id of every audited number.

    Artifacts, their series and their bindings are dealt once, by artifact, in ``parts`` parts if
    given, and every rule about an artifact is decided on that one order."""
    key = ["doc_id", "artifact_id"]
    at = F.concat_ws("/", *key)
    return all_issues(
        repeated(slides, ["doc_id", "slide_id"], "EXPORT.DUPLICATE_SLIDE", parts=parts),
        missing(artifacts, slides, [("doc_id", "doc_id"), ("slide_id", "slide_id")], "EXPORT.UNKNOWN_SLIDE", at, parts=parts),
        rule(audit, "EXPORT.AUDIT", "doc_id", (F.coalesce("status", F.lit("")) != "passed") | (F.coalesce("mismatches", F.lit(0)) > 0)),
        missing(artifacts, audit, [("doc_id", "doc_id")], "EXPORT.AUDIT_MISSING", at, parts=parts),
        _artifact_issues(artifacts, series, bindings, parts),
    )


def _artifact_issues(artifacts: DataFrame, series: DataFrame, bindings: DataFrame, parts: int | None) -> DataFrame:
    """One row of (tag, label, number, mark) per chart (its type, categories), other artifact, series
    (name, values, numbered) and binding (path, -, has a fact); ``mark`` of an artifact has a bit
    for each rule on its own row. Rows of equal tag, label and, for charts, number are one group."""
    c, key = F.col, ["doc_id", "artifact_id"]
    chart, table = c("kind") == "chart", c("kind") == "table"
    zero = lambda name: F.coalesce(name, F.lit(0)) == 0
    bits = enumerate((zero("sources"), chart & (c("chart_type") == "combo"), table & (zero("columns") | zero("rows")), chart | table))
    mark = sum((F.when(flag, 1 << k).otherwise(0) for k, flag in bits), F.lit(0))
    rows = (
        artifacts.select(*key, F.when(chart, 0).otherwise(1).alias("tag"), F.when(chart, c("chart_type")).alias("label"), F.when(chart, c("categories")).alias("number"), mark.alias("mark"))
        .unionByName(series.select(*key, F.lit(2).alias("tag"), F.trim(F.coalesce("name", F.lit(""))).alias("label"), c("values").alias("number"), c("series_no").isNotNull().cast("int").alias("mark")))
        .unionByName(bindings.select(*key, F.lit(3).alias("tag"), c("output_path").cast("string").alias("label"), F.lit(None).alias("number"), c("fact_id").isNotNull().cast("int").alias("mark")))
    )
    # Series and bindings come to the artifacts, so there are more parts.
    dealt = rows.repartition(*key) if parts is None else rows.repartition(3 * parts, *key)
    group = ["tag", "label", "own"]
    made, of_key, of_group = c("tag") <= 1, Window.partitionBy(*key), Window.partitionBy(*key, *group)
    numbered = (c("tag") == 2) & (c("mark") == 1)
    values = F.when(c("tag") == 2, c("number"))
    seen = (
        dealt.withColumn("own", F.when(c("tag") == 0, c("number")))
        # The first window has the longest order; the others find their rows in it.
        .withColumn("nth_of_key", F.row_number().over(of_key.orderBy(*group)))
        .withColumns({"nth": F.row_number().over(of_group.orderBy("own")), "copies": F.count(F.lit(1)).over(of_group)})
        .withColumns({
            "artifacts": F.count_if(made).over(of_key), "bound": F.count_if(c("tag") == 3).over(of_key), "n": F.count_if(numbered).over(of_key),
            "blank": F.count_if(numbered & (c("label") == "")).over(of_key), "names": F.count_if((c("tag") == 2) & (c("label") != "") & (c("nth") == 1)).over(of_key),
            "low": F.min(values).over(of_key), "high": F.max(values).over(of_key),
        })
    )
    # A null in the key meets nothing. Copies of a chart meet each of its series.
    meets = c("doc_id").isNotNull() & c("artifact_id").isNotNull()
    n = F.when(meets, c("n") * c("copies")).otherwise(0)
    shape, bit = (c("tag") == 0) & (c("nth") == 1), lambda k: made & (c("mark").bitwiseAND(1 << k) > 0)
    found = {
        "DUPLICATE_ARTIFACT": (c("nth_of_key") == 1) & (c("artifacts") > 1),
        "NO_SOURCE": bit(0), "UNSUPPORTED_CHART": bit(1), "EMPTY_TABLE": bit(2),
        "EMPTY_CHART": shape & ((n == 0) | zero("own")),
        "SERIES_NAMES": shape & meets & ((c("blank") > 0) | (c("names") < c("copies") * (c("n") - c("blank")))),
        "SERIES_LENGTH": shape & meets & ((c("low") != c("own")) | (c("high") != c("own"))),
        "PIE_SERIES": shape & (c("label") == "pie") & (n != 1),
        "NOT_AUDITED": bit(3) & ~(meets & (c("bound") > 0)),
        "UNKNOWN_BINDING": (c("tag") == 3) & meets & (c("artifacts") == 0),
        "BINDING": (c("tag") == 3) & (c("nth") == 1) & ((c("copies") > 1) | (c("mark") == 0)),
    }
    codes = F.array_compact(F.array(*[F.when(flag, f"EXPORT.{code}") for code, flag in found.items()]))
    issues = each(seen, codes, "code", [*key, "label"])
    path = F.when(c("code") == "EXPORT.BINDING", F.concat_ws("/", *key, "label")).otherwise(F.concat_ws("/", *key))
    return issues.select("code", path.alias("path"), F.lit(ERROR).alias("severity"))


def publish(tables: Mapping[str, DataFrame], issues: DataFrame, root: str) -> str:
    """Write all tables of a run under a fresh folder, then a manifest that names it: readers of
    the manifest see all of them or none. Nothing is written if a rule failed; a write that fails
    leaves the earlier manifest, and so the earlier export, as it was. Returns the folder."""
    failed = issues.where("severity = 'error'").orderBy("code", "path").limit(20).collect()
    if failed:
        raise ValueError("export refused: " + "; ".join(f"{r['code']} {r['path']}" for r in failed))
    folder = f"run-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/{folder}/{name}")
    spark = issues.sparkSession
    counts = [(folder, name, spark.read.parquet(f"{root}/{folder}/{name}").count()) for name in tables]
    # The number of a manifest orders them; one that another run took makes this one fail.
    number = max([int(r["n"]) for r in published(spark, root).select(F.max("number").alias("n")).collect() if r["n"] is not None], default=0) + 1
    lines = spark.createDataFrame([(number, *c) for c in counts], MANIFEST).coalesce(1)
    lines.write.mode("errorifexists").parquet(f"{root}/manifest/number={number}")
    return f"{root}/{folder}"


MANIFEST = "number long, folder string, name string, rows long"


def published(spark: SparkSession, root: str) -> DataFrame:
    """(number, folder, name, rows) of every published export; the newest has the largest number."""
    try:
        found = spark.read.option("basePath", f"{root}/manifest").option("recursiveFileLookup", "true").schema(MANIFEST).parquet(f"{root}/manifest")
        found.limit(1).count()
        return found
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], MANIFEST)


def read_published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the newest export."""
    newest = published(spark, root).where(F.col("name") == name).orderBy(F.desc("number")).select("folder").first()
    if newest is None:
        raise ValueError(f"no export under {root} has a table {name}")
    return spark.read.parquet(f"{root}/{newest['folder']}/{name}")
