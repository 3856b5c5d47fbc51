"""Scans: document bundles, reports, parser lists, delimited rows and table text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire.schemas import BUNDLE, CONTENT_ITEM
from quire.functions.text import unless

BUNDLE_PARTS = ("pages", "blocks", "reading_order", "sections", "tables", "figures")


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """One row per bundle file with its path, typed content, and the list of schema issues
    (at most 20). A file that is not JSON keeps its text in ``_corrupt_record``."""
    raw = (
        spark.read.schema(BUNDLE)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
    )
    issues = F.array_compact(
        F.array(
            F.when(F.col("_corrupt_record").isNotNull(), "not valid JSON for the schema"),
            F.when(F.col("document").isNull(), "document is required"),
            *[F.when(F.col(p).isNull(), f"{p} is required") for p in BUNDLE_PARTS],
        )
    )
    return raw.select("*", F.col("_metadata.file_path").alias("path")).withColumn("issues", F.slice(issues, 1, 20))


def bundle_tables(bundles: DataFrame) -> dict[str, DataFrame]:
    """The accepted bundles as tables keyed by ``doc_id``."""
    good = bundles.where(F.size("issues") == 0)
    doc = F.col("document.id").alias("doc_id")
    out = {"doc": good.select(doc, "document.*").drop("id")}
    for part, name in (("pages", "page"), ("blocks", "block"), ("sections", "section"), ("tables", "doc_table"), ("figures", "figure")):
        out[name] = good.select(doc, F.posexplode(part).alias("pos", "x")).select("doc_id", "pos", "x.*")
    out["reading_order"] = good.select(doc, F.posexplode("reading_order").alias("pos", "block_id"))
    return out


@F.pandas_udf(StringType())
def _decode_other(content: pd.Series) -> pd.Series:
    """Bytes that are not UTF-8: the national encoding, else replacement characters."""
    def one(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        for name in ("utf-8-sig", "gb18030"):
            try:
                return bytes(raw).decode(name)
            except UnicodeDecodeError:
                continue
        return bytes(raw).decode("utf-8", "replace")

    return content.map(one)


def read_reports(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Report files: id from the name, format from the suffix, SHA-256 of the bytes, text."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", recursive)
        .option("pathGlobFilter", "*.{md,markdown,mdown,mkd,txt,text}")
        .load(path)
    )
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    stem = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"\.[^.]+$", ""), "[^A-Za-z0-9_.-]+", "_"), "^[_.-]+|[_.-]+$", "")
    plain = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.regexp_replace(F.col("content").cast("string"), "^﻿", "")
    return files.select(
        F.when(stem == "", "document").otherwise(stem).alias("doc_id"),
        name.alias("source_file"),
        F.when(suffix.isin("txt", "text"), "plain_text").otherwise("markdown").alias("source_format"),
        F.sha2("content", 256).alias("source_sha256"),
        # The decoder runs only on the bytes that are not UTF-8.
        F.when(plain, text).otherwise(_decode_other(F.when(~plain, F.col("content")))).alias("text"),
    )


def fingerprints(df: DataFrame, id: str, text: str) -> DataFrame:
    """Hash, characters and lines of a text column."""
    return df.select(
        id,
        F.sha2(text, 256).alias("sha256"),
        F.length(text).cast("bigint").alias("chars"),
        F.size(F.split(text, "\n")).cast("bigint").alias("lines"),
    )


def read_content_lists(spark: SparkSession, path: str) -> DataFrame:
    """Parser output: a JSON array of objects per file, one row per item with its position.
    A file whose root is not an array gives one row with ``issue``."""
    files = spark.read.text(path, wholetext=True).select(F.col("value"), F.col("_metadata.file_path").alias("path"))
    items = files.withColumn("items", F.from_json("value", CONTENT_ITEM))
    rooted = F.col("value").rlike(r"^\s*\[")
    bad = ~rooted | F.col("items").isNull()
    rows = items.select(
        "path",
        F.when(bad, "root is not an array of objects").alias("issue"),
        F.posexplode_outer(F.when(~bad, F.col("items"))).alias("item_index", "item"),
    )
    return rows.select("path", "issue", "item_index", "item.*")


def coerce_scalar(text: Column) -> Column:
    """A cell to (kind, number, text): thousands separators and a percent sign are allowed,
    blank stays blank, anything else is text."""
    trimmed = F.trim(F.coalesce(text, F.lit("")))
    numeric = F.regexp_replace(trimmed, ",", "")
    whole = numeric.rlike(r"^-?\d+$")
    decimal = numeric.rlike(r"^-?\d+(\.\d+)?%?$")
    return F.struct(
        F.when(trimmed == "", "blank").when(whole, "int").when(decimal, "float").otherwise("text").alias("kind"),
        F.when(whole | decimal, F.regexp_replace(numeric, "%$", "").try_cast("double")).alias("number"),
        trimmed.alias("text"),
    )


def load_rows(
    spark: SparkSession, *, rows: DataFrame | None = None, csv_path: str | None = None, json_path: str | None = None
) -> DataFrame:
    """Chart rows from exactly one input, all as text; rows with no value are dropped."""
    if sum(x is not None for x in (rows, csv_path, json_path)) != 1:
        raise ValueError("give exactly one of rows, csv_path, json_path")
    if csv_path is not None:
        df = spark.read.csv(csv_path, header=True)
    elif json_path is not None:
        df = spark.read.option("primitivesAsString", True).json(json_path)
    else:
        df = rows.select(*[F.col(c).cast("string").alias(c) for c in rows.columns])
    filled = F.lit(False)
    for c in df.columns:
        filled = filled | (F.trim(F.coalesce(F.col(c), F.lit(""))) != "")
    return df.where(filled)


# --- tables in text --------------------------------------------------------------------

# A pipe that is neither escaped nor inside a code span ends a cell.
_CELL = r"(?:\\.|`[^`]*`|[^|\\`]|`)*"


def split_row(line: Column) -> Column:
    """Cells of one Markdown table row; escaped pipes and code spans stay in their cell."""
    body = F.regexp_replace(F.trim(line), r"^\|", "")
    body = F.regexp_replace(body, r"(?<!\\)\|$", "")
    cells = F.regexp_extract_all(F.concat(body, F.lit("|")), F.lit(rf"({_CELL})\|"), F.lit(1))
    return F.transform(cells, lambda c: F.trim(F.regexp_replace(c, r"\\(.)", "$1")))


def is_separator(line: Column) -> Column:
    """The row under a header: every cell is dashes with optional colons."""
    return line.contains("|") & line.rlike(r"^\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)*\|?\s*$")


def alignment(cell: Column) -> Column:
    left, right = cell.startswith(":"), cell.endswith(":")
    return F.when(left & right, "center").when(left, "left").when(right, "right").otherwise("none")


def pad_row(row: Column, width: Column) -> Column:
    """Cut or fill a row to the header width."""
    return F.slice(F.concat(row, F.array_repeat(F.lit(""), width)), F.lit(1), width)


def markdown_grid(df: DataFrame, text: str) -> DataFrame:
    """Pipe table text to ``columns``, ``alignments``, ``rows`` and ``ragged`` (row numbers
    that had to be padded or cut). ``issue`` says why a text is not a table."""
    lines = F.filter(F.split(text, "\r?\n"), lambda x: F.trim(x) != "")
    raw = F.transform(F.slice(F.col("_lines"), 3, 1_000_000_000), split_row)
    width = F.size("columns")
    return (
        df.withColumn("_lines", lines)
        .withColumn(
            "issue",
            F.when(F.size("_lines") < 2, "needs a header and a separator")
            .when(~is_separator(F.try_element_at("_lines", F.lit(2))), "separator row is not valid")
            .when(F.size("_lines") < 3, "no data rows"),
        )
        .withColumn("columns", F.when(F.col("issue").isNull(), split_row(F.try_element_at("_lines", F.lit(1)))))
        .withColumn(
            "alignments",
            F.when(F.col("issue").isNull(), F.transform(split_row(F.try_element_at("_lines", F.lit(2))), alignment)),
        )
        .withColumn("_raw", F.when(F.col("issue").isNull(), raw))
        .withColumn("rows", F.transform("_raw", lambda r: pad_row(r, width)))
        .withColumn(
            "ragged",
            F.filter(F.transform("_raw", lambda r, i: F.when(F.size(r) != width, i + 1)), lambda x: x.isNotNull()),
        )
        .drop("_lines", "_raw")
    )


def html_grid(html: Column) -> Column:
    """HTML table to (columns, rows): first row is the header, cells are stripped of tags."""
    trs = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), F.lit(1))

    def clean(cell: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(cell, r"(?s)<[^>]+>", ""), r"\s+", " ")
        for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
            plain = F.replace(plain, F.lit(entity), F.lit(char))
        return F.trim(plain)

    grid = F.transform(
        trs, lambda tr: F.transform(F.regexp_extract_all(tr, F.lit(r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]\s*>"), F.lit(1)), clean)
    )
    grid = F.filter(grid, lambda r: F.size(r) > 0)
    return F.struct(
        F.coalesce(F.get(grid, F.lit(0)), F.array().cast("array<string>")).alias("columns"),
        F.slice(grid, 2, 1_000_000_000).alias("rows"),
    )


# --- memory tables and logs ------------------------------------------------------------


def scan(spark: SparkSession, path: str, where: str | None = None, **args) -> DataFrame:
    """A stored table, filtered by a predicate with named parameters; the filter reaches the
    Parquet scan."""
    df = spark.read.parquet(path)
    return spark.sql(f"SELECT * FROM {{t}} WHERE {where}", args=args, t=df) if where else df


def discover_logs(spark: SparkSession, root: str, glob: str = "*.json") -> DataFrame:
    """Every log file under the root with run, task and file name taken from its path."""
    files = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .text(root, wholetext=True)
        .select("value", F.col("_metadata.file_path").alias("path"))
    )
    return files.select(
        "path",
        unless(F.regexp_extract("path", r"([^/]+)/\.memory/", 1), F.lit("")).alias("run"),
        F.regexp_extract("path", r"/task_(\d+)/", 1).try_cast("int").alias("task_idx"),
        F.element_at(F.split("path", "/"), -1).alias("file"),
        F.col("value").alias("payload"),
    )


def call_rows(logs: DataFrame) -> DataFrame:
    """One row per call of a raw log, whose payload is a list, or an object holding one."""
    listed = F.coalesce(
        F.when(F.col("payload").rlike(r"^\s*\["), F.col("payload")),
        F.get_json_object("payload", "$.tool_calls"),
        F.get_json_object("payload", "$.calls"),
    )
    calls = F.from_json(F.regexp_replace(listed, r"^\s+", ""), "array<string>")
    return logs.select(*[c for c in logs.columns if c != "payload"], F.posexplode(calls).alias("call_idx", "payload"))
