"""Document structure: text to typed blocks, sections, chunks, figures and assets.

Windows by ``doc_id`` over lines are safe here: the lines of a document come out of one
row, so a group is never larger than one text. Tables that may hold any number of rows
per key go through ``Timeline``."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.rules import all_issues, missing, repeated, rule
from quire.functions.scan import GHOST, SLICE, Timeline, top_rows
from quire.functions.text import squeeze, unless
from quire.session import cut
from quire.sources.readers import alignment, is_separator, pad_row, split_row

# Line patterns of the Markdown subset.
ATX = r"^\s{0,3}(#{1,6})[ \t]+(.+?)\s*$"
SETEXT = r"^\s{0,3}(=+|-+)\s*$"
LIST = r"^([ \t]*)([-+*]|\d+[.)])[ \t]+(.+?)\s*$"
IMAGE = r"^\s*!\[([^\]]*)\]\((.+?)\)\s*$"
FENCE = r"^\s*(`{3,}|~{3,})(.*)$"
QUOTE = r"^\s*>[ \t]?(.*)$"
RULE = r"^\s{0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})\s*$"
CITE = r"\[\^cite_id:([^\]]+)\]"
CHAPTER = r"^(第[一二三四五六七八九十百零〇]+[章节篇部分])(?:[：:、.\s]+)?(.+)$"
CJK_NUMBER = r"^([一二三四五六七八九十百]+)[、.]\s*(.+)$"
DECIMAL = r"^(\d+(?:\.\d+){0,5})[、.\s]+(.+)$"
SENTENCE_END = r"[。！？；;]$"
TABLE_CAPTION = r"(?i)^(表|图表|Table\b)"
TYPES = ("heading", "paragraph", "list", "table", "image", "blockquote", "code", "horizontal_rule")


def clean_inline(text: Column) -> Column:
    """Remove inline Markdown wrappers and tags; the words stay."""
    out = F.regexp_replace(text, CITE, "")
    for pattern, to in (
        (r"!\[([^\]]*)\]\([^)]+\)", "$1"),
        (r"(?<!!)\[([^\]]+)\]\([^)]+\)", "$1"),
        (r"<[^>]+>", ""),
        (r"(?<!\\)(\*\*|__)(.+?)\1", "$2"),
        (r"(?<!\\)(\*|_)(.+?)\1", "$2"),
        (r"`([^`]+)`", "$1"),
        (r"\\\|", "|"),
        (r"[ \t]+", " "),
    ):
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def _code_spans(lines: Column) -> Column:
    """Fenced code as line ranges. Only the fence lines are folded, so the fold is short."""
    fences = F.filter(
        F.transform(
            lines,
            lambda x, i: F.struct(
                i.alias("pos"),
                F.regexp_extract(x, FENCE, 1).alias("mark"),
                (F.trim(F.regexp_extract(x, FENCE, 2)) == "").alias("bare"),
            ),
        ),
        lambda f: f["mark"] != "",
    )
    span = "array<struct<first:int,last:int>>"
    start = F.struct(
        F.lit(None).cast("int").alias("open"), F.lit("").alias("mark"), F.array().cast(span).alias("spans")
    )

    def step(acc: Column, f: Column) -> Column:
        closes = f["bare"] & f["mark"].startswith(acc["mark"])
        closed = F.struct(
            F.lit(None).cast("int").alias("open"),
            F.lit("").alias("mark"),
            F.array_append(acc["spans"], F.struct(acc["open"].alias("first"), f["pos"].alias("last"))).alias("spans"),
        )
        opened = F.struct(f["pos"].alias("open"), f["mark"].alias("mark"), acc["spans"].alias("spans"))
        return F.when(acc["open"].isNull(), opened).when(closes, closed).otherwise(acc)

    def finish(acc: Column) -> Column:
        rest = F.struct(acc["open"].alias("first"), (F.size(lines) - 1).alias("last"))
        return F.when(acc["open"].isNull(), acc["spans"]).otherwise(F.array_append(acc["spans"], rest))

    return F.aggregate(fences, start, step, finish)


def _blank(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"\s+", " ")) == ""


def _plain_level(line: Column, previous: Column) -> Column:
    """Heading level of a plain-text line after a blank one: chapter, CJK number, decimal."""
    text = F.trim(line)
    depth = F.size(F.split(F.regexp_extract(text, DECIMAL, 1), r"\.")) + 1
    fits = (
        (text != "")
        & (F.length(text) <= 160)
        & ~text.rlike(CITE)
        & ~text.rlike(SENTENCE_END)
        & (previous.isNull() | _blank(previous))
    )
    level = (
        F.when(text.rlike(CHAPTER), 1).when(text.rlike(CJK_NUMBER), 2).when(text.rlike(DECIMAL), F.least(depth, F.lit(6)))
    )
    return F.when(fits, level)


def typed_lines(docs: DataFrame, text: str = "text", plain: Column | None = None) -> DataFrame:
    """Every line of every document with its block type and whether it starts a block."""
    plain = F.lit(False) if plain is None else plain
    w = Window.partitionBy("doc_id").orderBy("pos")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    line, pos = F.col("line"), F.col("pos")
    rows = (
        docs.select("doc_id", plain.alias("plain"), F.split(text, "\r?\n").alias("_lines"))
        .withColumn("_code", _code_spans(F.col("_lines")))
        .select("doc_id", "plain", "_code", F.posexplode("_lines").alias("pos", "line"))
        .withColumn("code", F.get(F.filter("_code", lambda c: (c["first"] <= pos) & (pos <= c["last"])), F.lit(0)))
        .drop("_code")
        .withColumns({"next": F.lead("line").over(w), "prev": F.lag("line").over(w)})
    )
    free = F.col("code").isNull()
    atx = line.rlike(ATX) & (F.trim(F.regexp_replace(F.regexp_extract(line, ATX, 2), r"\s+#+\s*$", "")) != "")
    rows = rows.withColumns(
        {
            "blank": _blank(line),
            "atx": free & atx,
            "is_list": free & line.rlike(LIST),
            "is_quote": free & line.rlike(QUOTE),
            "is_image": free & line.rlike(IMAGE),
            "is_rule": free & line.rlike(RULE),
            "sep": is_separator(line),
            "table_start": free & line.contains("|") & F.coalesce(is_separator(F.col("next")), F.lit(False)),
            "plain_level": F.when(free & F.col("plain"), _plain_level(line, F.col("prev"))),
        }
    )
    taken = F.col("atx") | F.col("is_list") | F.col("is_quote") | F.col("is_image") | F.col("table_start")
    rows = rows.withColumn(
        "setext", free & ~F.col("plain") & ~F.col("blank") & ~taken & F.coalesce(F.col("next").rlike(SETEXT), F.lit(False))
    )
    heading = F.col("atx") | F.col("setext") | F.col("plain_level").isNotNull()
    edge = ~free | F.col("blank") | heading | taken | F.col("is_rule")
    rows = rows.withColumns(
        {
            "heading": heading,
            "table_start": F.col("table_start") & ~heading,
            "under": F.coalesce(F.lag("setext").over(w), F.lit(False)),
            "edge": edge,
        }
    )
    # A table runs from its header until a line that breaks it; a list until a line that is
    # neither an item nor an indented continuation.
    indent = F.length(F.regexp_replace(F.regexp_extract(line, LIST, 1), "\t", "    "))
    lead = F.length(F.regexp_extract(line, r"^[ \t]*", 0))
    breaks = F.col("blank") | ~line.contains("|") | (F.col("edge") & ~F.col("sep")) | F.col("under")
    rows = rows.withColumns(
        {
            "last_table": F.last(F.when(F.col("table_start"), pos), ignorenulls=True).over(upto),
            "last_break": F.last(F.when(breaks, pos), ignorenulls=True).over(upto),
            "last_item": F.last(F.when(F.col("is_list"), pos), ignorenulls=True).over(upto),
            "last_indent": F.last(F.when(F.col("is_list"), indent), ignorenulls=True).over(upto),
        }
    )
    off_list = ~F.col("is_list") & (F.col("edge") | F.col("under") | (lead <= F.coalesce("last_indent", F.lit(10_000))))
    rows = rows.withColumn("last_off", F.last(F.when(off_list, pos), ignorenulls=True).over(upto))
    in_table = F.col("last_table").isNotNull() & (
        (F.coalesce("last_break", F.lit(-1)) <= F.col("last_table")) | (pos == F.col("last_table") + 1)
    )
    in_list = F.col("last_item").isNotNull() & (F.coalesce("last_off", F.lit(-1)) < F.col("last_item"))
    kind = (
        F.when(~free, "code")
        .when(F.col("blank"), "blank")
        .when(F.col("under") | F.col("heading"), "heading")
        .when(in_table, "table")
        .when(F.col("is_rule"), "horizontal_rule")
        .when(in_list, "list")
        .when(F.col("is_quote"), "blockquote")
        .when(F.col("is_image"), "image")
        .otherwise("paragraph")
    )
    rows = rows.withColumn("type", kind).withColumn("prev_type", F.lag("type").over(w))
    ordered = F.regexp_extract(line, LIST, 2).rlike(r"^\d")
    first_item = F.col("is_list") & ~F.col("prev_type").eqNullSafe("list")
    rows = rows.withColumn(
        "last_flag",
        F.last(F.when((F.col("type") == "list") & (first_item | (F.col("is_list") & (indent < 2))), ordered), ignorenulls=True).over(before),
    )
    flips = F.col("is_list") & (indent < 2) & (ordered != F.col("last_flag"))
    starts = (
        F.when(F.col("type") == "code", pos == F.col("code.first"))
        .when(F.col("type") == "blank", False)
        .when(F.col("type") == "heading", ~F.col("under"))
        .when(F.col("type") == "table", F.col("table_start"))
        .when(F.col("type").isin("horizontal_rule", "image"), True)
        .when(F.col("type") == "list", first_item | F.coalesce(flips, F.lit(False)))
        .otherwise(~F.col("prev_type").eqNullSafe(F.col("type")))
    )
    level = (
        F.when(F.col("atx"), F.length(F.regexp_extract(line, ATX, 1)))
        .when(F.col("setext"), F.when(F.trim("next").startswith("="), 1).otherwise(2))
        .otherwise(F.col("plain_level"))
    )
    title = (
        F.when(F.col("atx"), F.regexp_replace(F.regexp_extract(line, ATX, 2), r"\s+#+\s*$", ""))
        .when(F.col("plain_level") == 2, F.when(F.trim(line).rlike(CJK_NUMBER), F.regexp_extract(F.trim(line), CJK_NUMBER, 2)).otherwise(F.regexp_extract(F.trim(line), DECIMAL, 2)))
        .when(F.col("plain_level") > 2, F.regexp_extract(F.trim(line), DECIMAL, 2))
        .otherwise(line)
    )
    return rows.select(
        "doc_id", "pos", "line", "type", starts.alias("starts"),
        F.when(F.col("type") == "heading", level).alias("level"),
        F.when(F.col("type") == "heading", clean_inline(title)).alias("title"),
    )


def parse_blocks(docs: DataFrame, text: str = "text", plain: Column | None = None) -> DataFrame:
    """Typed blocks of every document: id, type, line range, raw and clean text, heading level,
    citations, and for tables the columns, alignments, rows and ragged rows."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = typed_lines(docs, text, plain).withColumn("no", F.sum(F.col("starts").cast("int")).over(w))
    body = F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"])
    blocks = (
        lines.where(F.col("type") != "blank")
        .groupBy("doc_id", "no")
        .agg(
            F.min_by("type", "pos").alias("type"),
            F.min("pos").alias("_first"),
            F.max("pos").alias("_last"),
            F.first("level", ignorenulls=True).alias("level"),
            F.min_by("title", "pos").alias("title"),
            body.alias("lines"),
        )
    )
    raw = F.array_join("lines", "\n")
    inner = F.filter("lines", lambda x, i: (i > 0) & ((i < F.size("lines") - 1) | ~x.rlike(FENCE)))
    joined = F.array_join(F.transform("lines", clean_inline), " ")
    said = (
        F.when(F.col("type") == "heading", F.col("title"))
        .when(F.col("type") == "code", F.array_join(inner, "\n"))
        .when(F.col("type") == "blockquote", F.trim(F.array_join(F.transform("lines", lambda x: clean_inline(F.regexp_extract(x, QUOTE, 1))), "\n")))
        .when(F.col("type") == "paragraph", F.coalesce(unless(F.trim(joined), F.lit("")), squeeze(raw)))
    )
    table = F.col("type") == "table"
    grid = F.transform(F.filter(F.slice("lines", 3, 1_000_000_000), lambda x: ~_blank(x)), split_row)
    return (
        blocks.withColumn("columns", F.when(table, F.transform(split_row(F.get("lines", F.lit(0))), clean_inline)))
        .withColumn("_grid", F.when(table, grid))
        .select(
            "doc_id",
            F.col("no").cast("bigint").alias("no"),
            F.format_string("block_%04d", "no").alias("block_id"),
            "type",
            (F.col("_first") + 1).alias("line_start"),
            (F.col("_last") + 1).alias("line_end"),
            "level",
            raw.alias("raw_text"),
            said.alias("text"),
            citations(raw).alias("citations"),
            "columns",
            F.when(table, F.transform(split_row(F.get("lines", F.lit(1))), alignment)).alias("alignments"),
            F.transform("_grid", lambda r: pad_row(r, F.size("columns"))).alias("rows"),
            F.filter(F.transform("_grid", lambda r, i: F.when(F.size(r) != F.size("columns"), i + 1)), lambda x: x.isNotNull()).alias("ragged"),
            F.when(F.col("type") == "image", F.regexp_extract(raw, IMAGE, 2)).alias("url"),
        )
    )


def citations(text: Column) -> Column:
    """Distinct citation ids in order."""
    ids = F.transform(F.regexp_extract_all(text, F.lit(CITE), F.lit(1)), lambda x: F.trim(x))
    return F.array_distinct(F.filter(ids, lambda x: x != ""))


def table_captions(blocks: DataFrame) -> DataFrame:
    """Caption of a table: the paragraph that ends at most two lines above and starts with a
    table marker."""
    w = Window.partitionBy("doc_id").orderBy("no")
    above = F.lag(F.struct("type", "text", "line_end")).over(w)
    near = (above["type"] == "paragraph") & (F.col("line_start") - above["line_end"] <= 2) & above["text"].rlike(TABLE_CAPTION)
    return blocks.withColumn("caption", F.when((F.col("type") == "table") & near, above["text"]))


def open_levels(df: DataFrame, line: Timeline, level: str, id: str, depth: int = 6) -> DataFrame:
    """``path``: ids of the headings open at each row, outermost first. A heading closes when
    one of its level or shallower follows."""
    at = F.struct(*line.order, F.col(id).alias("id"))
    specs = {f"_l{k}": ("last", F.when(F.col(level) == k, at)) for k in range(1, depth + 1)}
    rows = line.running(df, **specs)

    def still_open(k: int) -> Column:
        here = F.col(f"_l{k}")
        shallower = [F.col(f"_l{j}") for j in range(1, k)]
        ok = here.isNotNull()
        for other in shallower:
            ok = ok & (other.isNull() | (here > other))
        return F.when(ok, here["id"])

    return rows.withColumn("path", F.array_compact(F.array(*[still_open(k) for k in range(1, depth + 1)]))).drop(*specs)


def section_paths(blocks: DataFrame) -> DataFrame:
    """Blocks with the path of open headings, the parent heading and level jumps."""
    line = Timeline(("doc_id",), ("no",))
    rows = open_levels(blocks, line, "level", "block_id")
    own = F.col("type") == "heading"
    return rows.withColumn(
        "parent_heading_id", F.when(own, F.try_element_at("path", F.lit(-2))).otherwise(F.try_element_at("path", F.lit(-1)))
    ).withColumn("parent_heading_id", F.when(own & (F.size("path") < 2), None).otherwise(F.col("parent_heading_id")))


def section_ids(headings: DataFrame) -> DataFrame:
    """Stable section id from the heading number (else its ordinal); a repeat gets -2, -3."""
    line = Timeline(("doc_id",), ("no",))
    number = F.regexp_extract("text", r"^\s*(\d+(?:\.\d+)*)", 1)
    rows = line.numbered(headings, "ordinal").withColumn(
        "base_id",
        F.when(number != "", F.concat(F.lit("sec-"), F.replace(number, F.lit("."), F.lit("-")))).otherwise(
            F.format_string("sec-%03d", "ordinal")
        ),
    )
    again = Timeline(("doc_id", "base_id"), ("no",)).numbered(rows, "_nth")
    named = again.withColumn(
        "section_id", F.when(F.col("_nth") == 1, F.col("base_id")).otherwise(F.concat_ws("-", "base_id", "_nth"))
    )
    # A suffixed id may equal a natural one (1 and 1 against 1.2): the later takes the next number.
    clash = Timeline(("doc_id", "section_id"), ("no",)).numbered(named, "_same")
    return clash.withColumn(
        "section_id",
        F.when(F.col("_same") == 1, F.col("section_id")).otherwise(
            F.concat_ws("-", "base_id", (F.col("_nth") + F.col("_same") - 1).cast("string"))
        ),
    ).drop("_nth", "_same")


def ancestry(nodes: DataFrame, keys: Sequence[str], id: str, parent: str, depth: int | None = None) -> DataFrame:
    """Path from the root to every node, with ``issue`` for a cycle or an unknown parent.
    One equi join per level, as many as the deepest node needs; ``depth`` bounds them where it
    is known."""
    base = nodes.select(*keys, F.col(id).alias("_id"), F.col(parent).alias("_up"))
    rows = nodes.withColumns(
        {"path": F.array(F.col(id)), "_next": F.col(parent), "issue": F.lit(None).cast("string")}
    )
    level = 0
    while level < depth if depth is not None else rows.where(F.col("_next").isNotNull()).limit(1).count():
        level += 1
        step = base.select(*keys, F.col("_id").alias("_next"), F.col("_up").alias("_after"), F.lit(True).alias("_hit"))
        rows = rows.join(step, [*keys, "_next"], "left")
        cycle = F.array_contains("path", F.col("_next"))
        go = F.col("_next").isNotNull() & F.col("_hit").isNotNull() & ~cycle
        rows = rows.withColumns(
            {
                "issue": F.coalesce(
                    "issue",
                    F.when(F.col("_next").isNotNull() & cycle, "cycle").when(
                        F.col("_next").isNotNull() & F.col("_hit").isNull(), "unknown parent"
                    ),
                ),
                "path": F.when(go, F.array_insert("path", 1, F.col("_next"))).otherwise(F.col("path")),
                "_next": F.when(go, F.col("_after")),
            }
        ).drop("_after", "_hit")
        rows = rows if depth is not None else cut(rows)
    return rows.withColumn("issue", F.coalesce("issue", F.when(F.col("_next").isNotNull(), "too deep"))).drop("_next")


# --- chunks ----------------------------------------------------------------------------


def chunk_cuts(items: Column, limit: int) -> Column:
    """Greedy chunks over an ordered array of struct(section, chars): a chunk closes when the
    section changes or the running size would pass ``limit``. Array of
    struct(chunk, first, items, chars)."""
    cut = "array<struct<first:int,items:int,chars:bigint,section:string>>"
    start = F.struct(
        F.array().cast(cut).alias("done"), F.lit(0).alias("first"), F.lit(0).alias("items"),
        F.lit(0).cast("bigint").alias("chars"), F.lit(None).cast("string").alias("section"),
    )

    def closed(acc: Column) -> Column:
        return F.array_append(
            acc["done"],
            F.struct(acc["first"].alias("first"), acc["items"].alias("items"), acc["chars"].alias("chars"), acc["section"].alias("section")),
        )

    def step(acc: Column, x: Column) -> Column:
        flush = (acc["items"] > 0) & (
            ~acc["section"].eqNullSafe(x["section"]) | (acc["chars"] + x["chars"] > limit)
        )
        fresh = flush | (acc["items"] == 0)
        return F.struct(
            F.when(flush, closed(acc)).otherwise(acc["done"]).alias("done"),
            F.when(flush, acc["first"] + acc["items"]).otherwise(acc["first"]).alias("first"),
            F.when(flush, F.lit(1)).otherwise(acc["items"] + 1).alias("items"),
            F.when(flush, x["chars"].cast("bigint")).otherwise(acc["chars"] + x["chars"]).alias("chars"),
            F.when(fresh, x["section"]).otherwise(acc["section"]).alias("section"),
        )

    return F.aggregate(items, start, step, lambda acc: F.when(acc["items"] > 0, closed(acc)).otherwise(acc["done"]))


def chunk_lines(docs: DataFrame, limit: int, text: str = "text") -> DataFrame:
    """Order-preserving chunks of the lines of a text, folded inside the row: no shuffle."""
    sizes = F.transform(
        F.split(text, "\n"), lambda x: F.struct(F.lit("").alias("section"), F.length(x).cast("bigint").alias("chars"))
    )
    return docs.select("doc_id", F.posexplode(chunk_cuts(sizes, limit)).alias("i", "c")).select(
        "doc_id", (F.col("i") + 1).alias("chunk"), (F.col("c.first") + 1).alias("first_line"),
        F.col("c.items").alias("lines"), F.col("c.chars").alias("chars"),
    )


def chunk_blocks(blocks: DataFrame, limit: int) -> DataFrame:
    """Chunk number of every block: (doc_id, id, pos, section_id, chars). A document's blocks
    come from one bundle, so the array is bounded by it."""
    items = F.sort_array(
        F.collect_list(F.struct("pos", F.col("section_id").alias("section"), F.col("chars").cast("bigint").alias("chars"), "id"))
    )
    cuts = blocks.groupBy("doc_id").agg(items.alias("_i")).withColumn("_c", chunk_cuts(F.col("_i"), limit))
    return (
        cuts.select("doc_id", "_i", F.posexplode("_c").alias("n", "c"))
        .select(
            "doc_id",
            F.format_string("chunk-%04d", F.col("n") + 1).alias("chunk_id"),
            F.explode(F.slice("_i", F.col("c.first") + 1, F.col("c.items"))).alias("x"),
        )
        .select("doc_id", "chunk_id", F.col("x.id").alias("id"), F.col("x.pos").alias("pos"), F.col("x.section").alias("section_id"))
    )


def chunk_payloads(chunked: DataFrame, blocks: DataFrame, relations: DataFrame) -> DataFrame:
    """JSON payload of every chunk: blocks in order, related tables and figures, and the refs
    that may be cited."""
    rows = chunked.join(blocks.select("doc_id", "id", "text_raw", "type"), ["doc_id", "id"])
    body = rows.groupBy("doc_id", "chunk_id", "section_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "id", "type", "text_raw"))).alias("blocks")
    )
    linked = chunked.join(relations, (chunked.doc_id == relations.doc_id) & (chunked.id == relations.block_id)).select(
        chunked.doc_id, "chunk_id", "kind", "target_id"
    )
    refs = linked.groupBy("doc_id", "chunk_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("kind") == "table", F.col("target_id")))).alias("table_ids"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "figure", F.col("target_id")))).alias("figure_ids"),
    )
    none = F.array().cast("array<string>")
    out = body.join(refs, ["doc_id", "chunk_id"], "left").withColumns(
        {"table_ids": F.coalesce("table_ids", none), "figure_ids": F.coalesce("figure_ids", none)}
    )

    def ref(kind: str, ids: Column) -> Column:
        return F.transform(ids, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("id")))

    allowed = F.concat(
        ref("block", F.transform("blocks", lambda b: b["id"])), ref("table", F.col("table_ids")), ref("figure", F.col("figure_ids"))
    )
    return out.withColumn("allowed", allowed).withColumn(
        "payload", F.to_json(F.struct("chunk_id", "section_id", "blocks", "table_ids", "figure_ids", "allowed"))
    )


# --- parser items to blocks ------------------------------------------------------------

FIGURE_CAPTION = r"^\s*(?:图|Figure)\s*\d+"
SOURCE_NOTE = r"^\s*(?:资料来源|数据来源|来源|Source)\s*[:：]?"


def actual_box(box: Column, width: Column, height: Column) -> Column:
    """Box in thousandths of a page to page points, with an issue code."""
    x = [F.get(box, F.lit(i)) for i in range(4)]
    valid = F.coalesce((F.size(box) == 4) & ~F.exists(box, lambda v: v.isNull()), F.lit(False))
    scaled = F.array(*[F.round(v * (width if i % 2 == 0 else height) / 1000, 4) for i, v in enumerate(x)])
    outside = (x[0] < 0) | (x[1] < 0) | (x[2] > 1000) | (x[3] > 1000) | (x[0] >= x[2]) | (x[1] >= x[3])
    return F.struct(
        F.when(valid, scaled).alias("bbox"),
        F.when(~valid, "missing_or_invalid_bbox").when(outside, "bbox_out_of_range").alias("issue"),
    )


def caption_notes(items: DataFrame) -> DataFrame:
    """Each figure caption with the nearest source note below it on the page: an as-of match
    on y. Captions on a page are few, so the join on page stays small."""
    text = F.coalesce(F.col("text"), F.lit(""))
    caption = items.where((F.col("type") == "text") & text.rlike(FIGURE_CAPTION) & (F.size("bbox") == 4)).select(
        "doc_id", "page_idx", F.col("item_index").alias("caption_index"), F.get("bbox", F.lit(3)).alias("y0")
    )
    note = items.where((F.col("type") == "text") & text.rlike(SOURCE_NOTE) & (F.size("bbox") == 4)).select(
        "doc_id", "page_idx", F.col("item_index").alias("note_index"), F.get("bbox", F.lit(1)).alias("y1")
    )
    return (
        caption.join(note, ["doc_id", "page_idx"])
        .where(F.col("y1") > F.col("y0"))
        .groupBy("doc_id", "page_idx", "caption_index", "y0")
        .agg(F.min(F.struct("y1", "note_index")).alias("n"))
        .select("doc_id", "page_idx", "caption_index", "n.note_index", "y0", "n.y1")
    )


def normal_types(items: DataFrame) -> DataFrame:
    """Block type of every item; text between a caption and its note is ``figure_text``."""
    bands = caption_notes(items)
    roles = (
        bands.select("doc_id", F.col("caption_index").alias("item_index"), F.lit("image_caption").alias("role"), F.col("caption_index").alias("by"))
        .unionByName(bands.select("doc_id", F.col("note_index").alias("item_index"), F.lit("image_footnote").alias("role"), F.col("caption_index").alias("by")))
        .unionByName(
            items.select("doc_id", "page_idx", "item_index", "bbox")
            .join(bands.select("doc_id", "page_idx", "y0", "y1", F.col("caption_index").alias("by")), ["doc_id", "page_idx"])
            .where((F.size("bbox") == 4) & (F.get("bbox", F.lit(1)) >= F.col("y0")) & (F.get("bbox", F.lit(3)) <= F.col("y1")))
            .select("doc_id", "item_index", F.lit("figure_text").alias("role"), "by")
        )
        .groupBy("doc_id", "item_index")
        .agg(F.min_by("role", F.struct("by", F.when(F.col("role") == "figure_text", 1).otherwise(0))).alias("role"))
    )
    source = F.coalesce("type", F.lit("unknown"))
    plain = (
        F.when(source == "text", F.when(F.col("text_level") > 0, "heading").otherwise("paragraph"))
        .when(source == "title", "heading")
        .when(source.isin("image", "chart"), "figure")
        .when(source.isin("equation", "interline_equation", "inline_equation"), "formula")
        .otherwise(source)
    )
    return items.join(roles, ["doc_id", "item_index"], "left").withColumn("block_type", F.coalesce("role", plain)).drop("role")


def item_blocks(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Primary, caption and footnote blocks of every item, with a running id per page."""
    none = F.array().cast("array<string>")
    typed = normal_types(items).join(
        pages.select("doc_id", (F.col("page") - 1).alias("page_idx"), "width", "height"), ["doc_id", "page_idx"], "left"
    )
    kind = F.coalesce("type", F.lit("unknown"))
    primary = F.when(kind == "table", F.col("table_body")).otherwise(F.col("text"))

    def extra(role: str, rank: int) -> Column:
        texts = F.lit(None).cast("array<string>")
        for t in ("table", "image", "chart"):
            texts = F.when(kind == t, F.col(f"{t}_{role}")).otherwise(texts)
        return F.transform(
            F.coalesce(texts, none),
            lambda x, i: F.struct(
                F.lit(rank).alias("rank"), i.alias("i"), F.concat_ws("_", kind, F.lit(role)).alias("type"),
                F.concat_ws("_", kind, F.lit(role)).alias("source_field"), x.alias("text_raw"),
            ),
        )

    own = F.array(
        F.struct(
            F.lit(0).alias("rank"), F.lit(0).alias("i"), F.col("block_type").alias("type"),
            F.when(kind == "table", "table_body").otherwise("text").alias("source_field"),
            F.coalesce(primary, F.lit("")).alias("text_raw"),
        )
    )
    box = actual_box(F.col("bbox"), F.col("width"), F.col("height"))
    rows = typed.withColumn("_box", box).select(
        "doc_id", (F.col("page_idx") + 1).alias("page"), F.col("item_index").alias("source_content_index"),
        kind.alias("source_type"), "text_level", F.col("_box.bbox").alias("bbox"),
        F.when(F.col("width").isNull(), "invalid_page").otherwise(F.col("_box.issue")).alias("issue"),
        F.inline(F.concat(own, extra("caption", 1), extra("footnote", 2))),
    )
    w = Window.partitionBy("doc_id", "page").orderBy("source_content_index", "rank", "i")
    return rows.withColumn("id", F.format_string("p%03d-b%03d", "page", F.row_number().over(w))).drop("i")


def reading_order(blocks: DataFrame) -> DataFrame:
    """Position of every block: by source index, captions before body before footnotes; a
    vector figure's note moves behind the last body block of its band."""
    by_page = ["doc_id", "page"]
    role = F.when(F.col("source_field").contains("caption"), 0).when(F.col("source_field").contains("footnote"), 2).otherwise(1)
    w = Window.partitionBy("doc_id").orderBy("source_content_index", "_role", "id")
    rows = blocks.withColumn("_role", role).withColumn("_at", F.row_number().over(w).cast("double"))
    text = F.col("source_type") == "text"
    y0, y1 = F.get("bbox", F.lit(1)), F.get("bbox", F.lit(3))
    captions = rows.where((F.col("type") == "image_caption") & text).select(*by_page, F.col("id").alias("cap"), y1.alias("top"))
    notes = rows.where((F.col("type") == "image_footnote") & text).select(*by_page, F.col("id").alias("note"), y0.alias("low"))
    bands = (
        captions.join(notes, by_page).where(F.col("low") > F.col("top"))
        .groupBy(*by_page, "cap", "top").agg(F.min(F.struct("low", "note")).alias("n"))
        .select(*by_page, "top", "n.low", "n.note")
    )
    moved = (
        rows.where(F.col("type") == "figure_text").select(*by_page, y0.alias("_y0"), y1.alias("_y1"), "_at")
        .join(bands, by_page).where((F.col("_y0") >= F.col("top")) & (F.col("_y1") <= F.col("low")))
        .groupBy("doc_id", F.col("note").alias("id")).agg((F.max("_at") + 0.5).alias("_moved"))
    )
    placed = rows.join(moved, ["doc_id", "id"], "left").withColumn("_at", F.coalesce("_moved", "_at"))
    final = Window.partitionBy("doc_id").orderBy("_at", "id")
    return placed.withColumn("reading_order", F.row_number().over(final) - 1).drop("_role", "_at", "_moved")


CELL = 200  # edge of a grid cell in box units; it decides the work, not the result


def table_continuations(items: DataFrame) -> DataFrame:
    """Tables cut by a page end: bottom edge from 850, a source note within the top 250 of the
    next page, and at least two text items aligned with the table above that note."""
    def at(i: int) -> Column:
        return F.get("bbox", F.lit(i))

    boxed = items.where(F.size("bbox") == 4)
    tables = boxed.where((F.col("type") == "table") & (at(3) >= 850) & (F.size("table_caption") > 0)).select(
        "doc_id", (F.col("page_idx") + 1).alias("page_idx"), F.col("item_index").alias("table_index"), at(0).alias("left"), at(2).alias("right")
    )
    texts = boxed.where((F.col("type") == "text") & (F.coalesce("text", F.lit("")) != ""))
    notes = (
        texts.where(F.col("text").rlike(SOURCE_NOTE) & (at(1) <= 250))
        .groupBy("doc_id", "page_idx").agg(F.min(F.struct(at(1).alias("y"), F.col("item_index").alias("note_index"))).alias("n"))
        .select("doc_id", "page_idx", "n.y", "n.note_index")
    )
    # Texts above the note meet tables by the cell of their left edge; a table looks into the
    # cells where that edge may lie, so a pair meets in one cell.
    cell = lambda c: F.floor(c / CELL)
    near = (
        texts.join(notes.select("doc_id", "page_idx", "y"), ["doc_id", "page_idx"]).where((at(1) < F.col("y")) & (at(3) <= 250))
        .select("doc_id", "page_idx", "item_index", at(0).alias("b0"), at(2).alias("b2"), cell(at(0)).alias("cell"))
    )
    wide = tables.withColumn("cell", F.explode(F.sequence(cell(F.col("left") - 100), cell(F.col("right") + 100))))
    return (
        wide.join(near, ["doc_id", "page_idx", "cell"])
        .where((F.col("b0") >= F.col("left") - 100) & (F.col("b2") <= F.col("right") + 100))
        .select("doc_id", "page_idx", "table_index", "item_index")
        .join(notes.select("doc_id", "page_idx", "note_index"), ["doc_id", "page_idx"])
        .groupBy("doc_id", "table_index", "note_index")
        .agg(F.array_sort(F.collect_list("item_index")).alias("items"))
        .where(F.size("items") >= 2)
    )


# --- evidence and figures --------------------------------------------------------------


def evidence_index(blocks: DataFrame, tables: DataFrame, figures: DataFrame) -> DataFrame:
    """Everything that can be cited: (doc_id, kind, id) with section, page and box. A table
    sits where its first fragment is."""
    first = F.get("fragments", F.lit(0))

    def rows(df: DataFrame, kind: str, page: Column, box: Column) -> DataFrame:
        ok = F.when(F.size(box) == 4, box)
        return df.select("doc_id", F.lit(kind).alias("kind"), "id", "section_id", page.alias("page"), ok.alias("bbox"))

    return (
        rows(blocks, "block", F.col("page"), F.col("bbox"))
        .unionByName(rows(tables, "table", first["page"], first["bbox"]))
        .unionByName(rows(figures, "figure", F.col("page"), F.col("bbox")))
    )


def block_relations(blocks: DataFrame, tables: DataFrame, figures: DataFrame) -> DataFrame:
    """(doc_id, block_id, kind, target_id): through caption, footnote, continuation and title
    ids, a shared source index, or the block's own table or figure id."""
    none = F.array().cast("array<string>")

    def listed(df: DataFrame, kind: str) -> DataFrame:
        many = [c for c in ("caption_block_ids", "footnote_block_ids", "continuation_block_ids") if c in df.columns]
        one = [c for c in ("title_block_id", "caption_block_id", "source_block_id") if c in df.columns]
        ids = F.concat(*[F.coalesce(F.col(c), none) for c in many], F.array_compact(F.array(*[F.col(c) for c in one], F.lit(None).cast("string"))))
        named = df.select("doc_id", F.explode(F.array_distinct(ids)).alias("block_id"), F.col("id").alias("target_id"))
        known = named.join(blocks.select("doc_id", F.col("id").alias("block_id")), ["doc_id", "block_id"], "left_semi")
        shared = (
            df.where(F.col("source_content_index").isNotNull())
            .select("doc_id", "source_content_index", F.col("id").alias("target_id"))
            .join(blocks.select("doc_id", "source_content_index", F.col("id").alias("block_id")), ["doc_id", "source_content_index"])
            .select("doc_id", "block_id", "target_id")
        )
        owned = blocks.where(F.col(f"{kind}_id").isNotNull()).select(
            "doc_id", F.col("id").alias("block_id"), F.col(f"{kind}_id").alias("target_id")
        ).join(df.select("doc_id", F.col("id").alias("target_id")), ["doc_id", "target_id"], "left_semi")
        return known.unionByName(shared).unionByName(owned).withColumn("kind", F.lit(kind))

    return listed(tables, "table").unionByName(listed(figures, "figure")).distinct()


# Phrases of page furniture.
BOILERPLATE = (
    "本公司具备证券投资咨询业务资格", "证券研究报告", "MINSHENG SECURITIES", "执业证书", "分析师",
    "邮箱：", "资料来源：", "当前价格：", "民生证券",
)


def useful_text(text: Column, markers: Sequence[str] = BOILERPLATE) -> Column:
    """Text worth showing: long enough, not only digits, no markup, no page furniture."""
    low = F.lower(text)
    furniture = reduce(lambda a, b: a | b, [low.contains(m.lower()) for m in markers], F.lit(False))
    return (F.length(text) >= 12) & ~text.rlike(r"^[\d\s./-]+$") & ~text.startswith("<table") & ~furniture


def figure_inventory(figures: DataFrame, blocks: DataFrame, sections: DataFrame, assets: DataFrame) -> DataFrame:
    """Figures in source order with caption, section title and whether they can be used."""
    ids = F.when(F.size("caption_block_ids") > 0, F.col("caption_block_ids")).otherwise(F.array_compact(F.array("caption_block_id")))
    texts = blocks.select("doc_id", F.col("id").alias("_b"), F.trim("text_raw").alias("_t"))
    captions = (
        figures.select("doc_id", "id", F.posexplode(ids).alias("_i", "_b")).join(texts, ["doc_id", "_b"])
        .where(F.col("_t") != "").groupBy("doc_id", "id")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_t"))), lambda s: s["_t"]), " ").alias("caption"))
    )
    titles = sections.select("doc_id", F.col("id").alias("section_id"), F.col("title_block_id").alias("_b")).join(
        texts, ["doc_id", "_b"]
    ).select("doc_id", "section_id", F.col("_t").alias("section_title"))
    held = assets.select("doc_id", "asset_path").distinct().withColumn("_held", F.lit(True))
    safe = F.coalesce((F.col("asset_path") != "") & ~F.col("asset_path").startswith("/") & ~F.array_contains(F.split("asset_path", "/"), ".."), F.lit(False))
    indexed = F.col("source_content_index").isNotNull()
    key = F.struct(
        F.when(indexed, 0).otherwise(1), F.when(indexed, F.col("source_content_index")).otherwise(F.coalesce("page", F.lit(2147483647))),
        F.when(indexed, 0.0).otherwise(F.coalesce(F.get("bbox", F.lit(1)), F.lit(0.0))),
        F.when(indexed, 0.0).otherwise(F.coalesce(F.get("bbox", F.lit(0)), F.lit(0.0))), "pos",
    )
    rows = (
        figures.join(captions, ["doc_id", "id"], "left").join(titles, ["doc_id", "section_id"], "left")
        .join(held, ["doc_id", "asset_path"], "left")
    )
    w = Window.partitionBy("doc_id").orderBy(key)
    available = safe & F.coalesce("_held", F.lit(False))
    return rows.select(
        "doc_id", F.col("id").alias("figure_id"), "page", "section_id", F.coalesce("caption", F.lit("")).alias("caption"),
        F.coalesce("section_title", F.lit("")).alias("section_title"), available.alias("available"),
        (available & (F.coalesce("caption", F.lit("")) != "")).alias("selectable"), F.row_number().over(w).alias("order"),
    )


def nearest_rows(df: DataFrame, line: Timeline, at: Column, id: str, k: int = 3) -> DataFrame:
    """For every row the ``k`` nearest neighbours on its timeline by distance of ``at``, ties
    to the earlier. Only ``k`` rows on each side can qualify, so a halo of ``k`` is exact."""
    rows = line.halo(df.withColumn("_at", at), before=k, after=k)
    w = line.window()
    around = F.concat(
        F.collect_list(F.struct("_at", id)).over(w.rowsBetween(-k, -1)),
        F.collect_list(F.struct("_at", id)).over(w.rowsBetween(1, k)),
    )
    out = rows.withColumn("_near", around).where(~F.col(GHOST)).drop(SLICE, GHOST)
    ranked = F.transform("_near", lambda s: F.struct(F.abs(s["_at"] - F.col("_at")).alias("d"), s["_at"].alias("at"), s[id].alias("id")))
    return out.withColumn("near", F.slice(F.array_sort(ranked), 1, k)).drop("_near", "_at")


def figure_neighbours(figures: DataFrame, blocks: DataFrame, relations: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` useful blocks nearest to each figure in its section, at most a page away."""
    linked = relations.where(F.col("kind") == "figure").join(
        blocks.select("doc_id", F.col("id").alias("block_id"), "pos"), ["doc_id", "block_id"]
    )
    anchors = linked.groupBy("doc_id", F.col("target_id").alias("figure_id")).agg(F.min("pos").alias("anchor"))
    captions = figures.select(
        "doc_id", F.explode(F.concat(F.coalesce("caption_block_ids", F.array().cast("array<string>")), F.coalesce("footnote_block_ids", F.array().cast("array<string>")))).alias("id")
    )
    usable = (
        blocks.where(~F.col("type").isin("figure", "figure_text", "table") & useful_text(F.trim("text_raw")))
        .join(captions, ["doc_id", "id"], "left_anti")
        .select("doc_id", "section_id", "id", "pos", F.col("page").alias("_page"))
    )
    named = figures.select("doc_id", F.col("id").alias("figure_id"), "section_id", "page").join(anchors, ["doc_id", "figure_id"], "left")
    rows = named.join(usable, ["doc_id", "section_id"]).where(F.abs(F.coalesce(F.col("page") - F.col("_page"), F.lit(0))) <= 1)
    gap = F.abs(F.col("pos") - F.coalesce("anchor", F.lit(2147483647)))
    return top_rows(rows, ["doc_id", "figure_id"], [gap, F.col("pos")], k).select("doc_id", "figure_id", "id", "pos")


def figure_sources(figures: DataFrame, blocks: DataFrame) -> DataFrame:
    """Source text of each figure: explicit source notes among its footnotes, distinct, in order."""
    plain = squeeze(F.regexp_replace("text_raw", r"<[^>]+>", ""))
    notes = blocks.select("doc_id", F.col("id").alias("_b"), F.trim(F.regexp_extract(plain, r"^\s*(?:资料来源|数据来源|来源)\s*[:：]\s*(.+)$", 1)).alias("_s"))
    return (
        figures.select("doc_id", F.col("id").alias("figure_id"), F.posexplode("footnote_block_ids").alias("_i", "_b"))
        .join(notes, ["doc_id", "_b"]).where(F.col("_s") != "")
        .groupBy("doc_id", "figure_id")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_s"))), lambda s: F.concat(F.lit("资料来源："), s["_s"])).alias("_all"))
        .select("doc_id", "figure_id", F.array_join(F.array_distinct("_all"), "；").alias("source_text"))
    )


def application_plan(assets: DataFrame, slides: DataFrame, sources: DataFrame, images: DataFrame) -> DataFrame:
    """Each verified source copy ends as planned, or skipped with the first reason that holds.
    ``assets``: filename, slide_id, figure_id; ``slides``: slide_id, page_number; ``images``:
    page_number, filename, image_index."""
    rows = (
        assets.join(sources.select("figure_id", "source_text"), "figure_id", "left")
        .join(slides, "slide_id", "left")
        .join(images.select("page_number").distinct().withColumn("_html", F.lit(True)), "page_number", "left")
        .join(images.groupBy("page_number", "filename").agg(F.min("image_index").alias("image_index")), ["page_number", "filename"], "left")
    )
    return rows.withColumn(
        "reason",
        F.when(F.col("source_text").isNull(), "explicit_source_note_not_found")
        .when(F.col("_html").isNull(), "slide_html_not_found")
        .when(F.col("image_index").isNull(), "image_not_used_in_final_html")
        .when(F.col("source_text") == "", "invalid_source_record"),
    ).withColumn("state", F.when(F.col("reason").isNull(), "planned").otherwise("skipped")).drop("_html")


def note_box(left: Column, right: Column, bottom: Column, width: Column, text: Column, page_width: Column, page_height: Column) -> Column:
    """Place of a note under an image: struct(box, issue)."""
    lines = F.greatest(F.lit(1), F.ceil(F.length(text) * 8.2 / width))
    box = F.struct(left.alias("left"), (bottom + 3).alias("top"), right.alias("right"), (bottom + 3 + lines * 12).alias("bottom"))
    issue = (
        F.when(width < 80, "image_too_narrow").when(lines > 3, "source_too_long_for_image_width")
        .when((left < 0) | (right > page_width), "source_box_outside_slide")
        .when(bottom + 3 + lines * 12 > page_height - 4, "no_space_below_image")
    )
    return F.struct(F.when(issue.isNull(), box).alias("box"), issue.alias("issue"))


def box_conflicts(boxes: DataFrame, blockers: DataFrame, key: Sequence[str], id: str) -> DataFrame:
    """Boxes that overlap a blocker on the same page (a page holds few of them)."""
    b = blockers.select(*key, *[F.col(c).alias(f"_{c}") for c in ("left", "top", "right", "bottom")])
    apart = (
        (F.col("right") <= F.col("_left")) | (F.col("left") >= F.col("_right"))
        | (F.col("bottom") <= F.col("_top")) | (F.col("top") >= F.col("_bottom"))
    )
    return boxes.join(b, list(key)).where(~apart).select(*key, id).distinct()


def interval_conflicts(df: DataFrame, line: Timeline, start: str, end: str) -> DataFrame:
    """Mark intervals that overlap another one of their key, without forming pairs: an earlier
    interval must end after the start, or a later one start before the end. ``line`` is
    ordered by the start."""
    rows = line.running(line.placed(df), strict=True, _reach=("max", F.col(end)))
    w = line.window()
    ahead = line.halo(rows, after=1).withColumn("_next", F.lead(start).over(w)).where(~F.col(GHOST)).drop(SLICE, GHOST)
    hit = F.coalesce(F.col("_reach") > F.col(start), F.lit(False)) | F.coalesce(F.col("_next") < F.col(end), F.lit(False))
    return ahead.withColumn("overlaps", hit).drop("_reach", "_next")


def next_match(df: DataFrame, line: Timeline, target: Column, value: Column, name: str) -> DataFrame:
    """As-of look-ahead: for every row the nearest later row of its key where ``target`` holds."""
    return line.running(df, reverse=True, strict=True, **{name: ("last", F.when(target, value))})


def in_band(df: DataFrame, bands: DataFrame, key: Sequence[str], value: str, low: str, high: str) -> DataFrame:
    """Whether a value lies in the band of its key (one band per key)."""
    return df.join(bands, list(key), "left").withColumn(
        "in_band", F.coalesce((F.col(value) >= F.col(low)) & (F.col(value) <= F.col(high)), F.lit(False))
    )


def zip_lists(left: DataFrame, right: DataFrame, left_line: Timeline, right_line: Timeline, keys: Sequence[str]) -> DataFrame:
    """Pair the n-th left row with the n-th right row of a key; the shorter list wins."""
    a, b = left_line.numbered(left, "n"), right_line.numbered(right, "n")
    return a.join(b, [*keys, "n"])


def zip_warnings(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose lists differ in length."""
    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))

    both = count(left, "n_left").join(count(right, "n_right"), list(keys), "full_outer").na.fill(0)
    return both.where(F.col("n_left") != F.col("n_right"))


def chart_id_issues(refs: DataFrame) -> DataFrame:
    """Chart ids that are empty, hold other characters, or repeat in a document."""
    chart = refs.withColumn("chart_id", F.trim(F.regexp_replace("url", "^chart:", "")))
    return all_issues(
        rule(chart, "invalid_chart_id", F.concat_ws("/", "doc_id", "chart_id"), ~F.col("chart_id").rlike("^[A-Za-z0-9_-]+$")),
        repeated(chart, ["doc_id", "chart_id"], "duplicate_chart_id"),
    )


def first_run(df: DataFrame, line: Timeline, mark: Column, group: Column, minimum: int = 2) -> DataFrame:
    """Per key the earliest run of at least ``minimum`` consecutive marked rows of one group."""
    value = F.when(mark, group)
    runs = (
        line.islands(df, value, "island")
        .withColumn("_g", value)
        .where(F.col("_g").isNotNull())
        .groupBy(*line.keys, "island", "_g")
        .agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct(*line.order)).alias("_at"))
        .where(F.col("rows") >= minimum)
    )
    return runs.groupBy(*line.keys).agg(F.min_by(F.struct("_g", "rows", "_at"), "_at").alias("r")).select(
        *line.keys, F.col("r._g").alias("group"), "r.rows", "r._at.*"
    )


def compact_excerpt(text: Column, limit: Column | int, marks: str = "；，、：") -> Column:
    """Text cut at the last clause mark before the limit, if that is far enough in."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    said = squeeze(text)
    head = F.left(said, limit - 1)
    kept = F.regexp_extract(head, f"^(?s)(.*)[{marks}]", 1)
    far = F.length(kept) >= F.greatest(F.lit(20), F.floor((limit - 1) / 2))
    cut = F.regexp_replace(F.when(far & head.rlike(f"[{marks}]"), kept).otherwise(head), f"[{marks} ]+$", "")
    return F.when(F.length(said) <= limit, said).otherwise(F.concat(cut, F.lit("…")))


def excerpt_budget(items: Column, total: int = 480, least: int = 60) -> Column:
    """Characters for each of n items."""
    return F.greatest(F.lit(least), F.floor(F.lit(total) / items))


def block_statistics(blocks: DataFrame, types: Sequence[str] = TYPES) -> DataFrame:
    """Blocks by type per document, and its title: first level-1 heading, else first text."""
    return blocks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("block_count"),
        *[F.count_if(F.col("type") == t).alias(f"{t}_count") for t in types],
        F.coalesce(
            F.min_by("text", F.when((F.col("type") == "heading") & (F.col("level") == 1), F.col("no"))),
            F.left(F.min_by("text", F.when(F.coalesce("text", F.lit("")) != "", F.col("no"))), F.lit(300)),
        ).alias("title"),
    )


def document_invariants(blocks: DataFrame, line_counts: DataFrame) -> DataFrame:
    """Rules on parsed blocks: unique ids, line ranges, heading parents, row widths."""
    at = F.concat_ws("/", "doc_id", "block_id")
    ranged = blocks.join(line_counts, "doc_id", "left")
    bad = ~((F.col("line_start") >= 1) & (F.col("line_start") <= F.col("line_end")) & (F.col("line_end") <= F.col("line_count")))
    headings = blocks.where(F.col("type") == "heading").select("doc_id", "block_id")
    width = F.size("columns")
    uneven = (F.col("type") == "table") & ((width != F.size("alignments")) | F.exists("rows", lambda r: F.size(r) != width))
    return all_issues(
        repeated(blocks, ["doc_id", "block_id"], "duplicate_block_id"),
        rule(ranged, "invalid_line_range", at, F.coalesce(bad, F.lit(True))),
        missing(blocks, headings, [("doc_id", "doc_id"), ("parent_heading_id", "block_id")], "unknown_parent_heading", at),
        rule(blocks, "table_width", at, uneven),
    )


def bundle_issues(doc: DataFrame, pages: DataFrame, blocks: DataFrame, order: DataFrame, sections: DataFrame, tables: DataFrame, figures: DataFrame) -> DataFrame:
    """Validation of document bundles: ids, order, boxes and references."""
    def at(id: str) -> Column:
        return F.concat_ws("/", "doc_id", id)

    on_page = blocks.join(pages.select("doc_id", "page", "width", "height"), ["doc_id", "page"])
    b = [F.get("bbox", F.lit(i)) for i in range(4)]
    boxed = F.coalesce(
        (F.size("bbox") == 4) & (b[0] >= 0) & (b[0] < b[2]) & (b[2] <= F.col("width")) & (b[1] >= 0) & (b[1] < b[3]) & (b[3] <= F.col("height")),
        F.lit(False),
    )
    key = [("doc_id", "doc_id"), ("block_id", "id")]

    def refs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
        single = [F.col(c) for c in columns if not c.endswith("ids")]
        many = [F.coalesce(F.col(c), F.array().cast("array<string>")) for c in columns if c.endswith("ids")]
        return df.select("doc_id", "id", F.explode(F.array_compact(F.concat(F.array(*single), *many))).alias("block_id"))

    listed = pages.select("doc_id", "page", F.explode("block_ids").alias("id"))
    counts = doc.join(pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")), "doc_id", "left")
    return all_issues(
        rule(counts, "page_count_mismatch", "doc_id", ~F.col("page_count").eqNullSafe(F.coalesce("_n", F.lit(0)).cast("int"))),
        repeated(blocks, ["doc_id", "id"], "duplicate_block_ids"),
        missing(blocks, order, [("doc_id", "doc_id"), ("id", "block_id")], "invalid_reading_order", at("id")),
        missing(order, blocks, [("doc_id", "doc_id"), ("block_id", "id")], "invalid_reading_order", at("block_id")),
        repeated(order, ["doc_id", "block_id"], "invalid_reading_order"),
        missing(blocks, pages, [("doc_id", "doc_id"), ("page", "page")], "invalid_block_page", at("id")),
        rule(on_page, "invalid_bbox", at("id"), ~boxed),
        missing(blocks, listed, [("doc_id", "doc_id"), ("page", "page"), ("id", "id")], "invalid_page_reference", at("id")),
        missing(listed, blocks, [("doc_id", "doc_id"), ("page", "page"), ("id", "id")], "invalid_page_reference", at("id")),
        missing(refs(sections, ["title_block_id", "content_block_ids"]), blocks, key, "invalid_section_reference", at("id")),
        missing(sections, sections.select("doc_id", F.col("id").alias("_p")), [("doc_id", "doc_id"), ("parent_id", "_p")], "invalid_section_parent", at("id")),
        missing(blocks, sections.select("doc_id", F.col("id").alias("_s")), [("doc_id", "doc_id"), ("section_id", "_s")], "invalid_block_section", at("id")),
        missing(refs(tables, ["title_block_id", "caption_block_ids", "footnote_block_ids", "continuation_block_ids"]), blocks, key, "invalid_table_reference", at("id")),
        rule(tables, "image_only_without_crop", at("id"), (F.col("status") == "image_only") & (F.coalesce(F.size("fragments"), F.lit(0)) <= 0)),
        missing(refs(figures, ["caption_block_id", "caption_block_ids", "footnote_block_ids"]), blocks, key, "invalid_figure_reference", at("id")),
        rule(figures, "missing_figure_asset", at("id"), F.coalesce("asset_path", F.lit("")) == ""),
    )


# --- look-ups --------------------------------------------------------------------------


def in_order(blocks: DataFrame) -> DataFrame:
    return blocks.orderBy("doc_id", "reading_order")


def on_page(blocks: DataFrame, page: int) -> DataFrame:
    return in_order(blocks.where(F.col("page") == page))


def in_section(blocks: DataFrame, section_id: str) -> DataFrame:
    return in_order(blocks.where(F.col("section_id") == section_id))


def paragraphs(blocks: DataFrame) -> DataFrame:
    return in_order(blocks.where(F.col("type") == "paragraph"))


def location(blocks: DataFrame, id: str) -> DataFrame:
    return blocks.where(F.col("id") == id).select("doc_id", "id", "page", "bbox", "section_id")


def unresolved(issues: DataFrame) -> DataFrame:
    return issues.where(F.col("severity") == "error")


def section_catalogue(sections: DataFrame, blocks: DataFrame) -> DataFrame:
    """Sections in order with ordinal from 0, parent, level and title."""
    titles = blocks.select("doc_id", F.col("id").alias("title_block_id"), F.trim("text_raw").alias("title"))
    line = Timeline(("doc_id",), ("pos",))
    rows = line.numbered(sections.join(titles, ["doc_id", "title_block_id"], "left"), "_n")
    return rows.select("doc_id", (F.col("_n") - 1).alias("ordinal"), F.col("id").alias("section_id"), "parent_id", "level", F.coalesce("title", F.lit("")).alias("title"))


# --- features, budgets, captions, assets -----------------------------------------------


def feature_flags(df: DataFrame, keys: Sequence[str], flags: dict[str, Column]) -> DataFrame:
    """Names of the features that hold for any row of a key, sorted; ``always`` is one."""
    names = sorted(flags)
    bits = df.groupBy(*keys).agg(*[F.bool_or(flags[n]).alias(n) for n in names])
    found = F.array_compact(F.array(F.lit("always"), *[F.when(F.col(n), n) for n in names]))
    return bits.select(*keys, F.array_sort(found).alias("features"))


def case_matches(features: DataFrame, cases: Sequence[dict], keep: int = 3) -> DataFrame:
    """Judge every rule case against the features of a row: all required, none excluded, any
    alternative. ``cases`` is a small library held in the plan; the best ``keep`` by priority
    then id are selected. One row per (row, case) with the reasons for a refusal."""
    text = "array<string>"

    def lits(values: Sequence[str]) -> Column:
        return F.array(*[F.lit(v) for v in values]).cast(text)

    listed = F.array(
        *[
            F.struct(
                F.lit(c["id"]).alias("case_id"), F.lit(c.get("priority", 0)).alias("priority"), lits(c.get("all", ())).alias("need"),
                lits(c.get("any", ())).alias("some"), lits(c.get("none", ())).alias("ban"),
            )
            for c in cases
        ]
    )

    def judged(c: Column) -> Column:
        lacking = F.array_except(c["need"], F.col("features"))
        banned = F.array_intersect(c["ban"], F.col("features"))
        none_of = (F.size(c["some"]) > 0) & ~F.arrays_overlap(c["some"], F.col("features"))
        reasons = F.array_compact(
            F.array(
                F.when(F.size(lacking) > 0, F.concat(F.lit("missing:"), F.array_join(lacking, ","))),
                F.when(F.size(banned) > 0, F.concat(F.lit("excluded_by:"), F.array_join(banned, ","))),
                F.when(none_of, "no_any_feature_matched"),
            )
        )
        return F.struct(
            (F.size(reasons) > 0).alias("refused"), (-c["priority"]).alias("low"), c["case_id"].alias("case_id"), F.array_join(reasons, ";").alias("reasons")
        )

    ranked = F.array_sort(F.transform(listed, judged))
    rows = features.select(*features.columns, F.posexplode(ranked).alias("_i", "_c"))
    return rows.select(
        *features.columns, F.col("_c.case_id").alias("case_id"), (~F.col("_c.refused")).alias("matched"),
        (~F.col("_c.refused") & (F.col("_i") < keep)).alias("selected"), F.col("_c.reasons").alias("reasons"),
    )


def length_class(text: Column, lines: int = 300, chars: int = 30_000) -> Column:
    """long when a text has more than ``lines`` lines or ``chars`` characters."""
    return F.when((F.size(F.split(text, "\n")) > lines) | (F.length(text) > chars), "long").otherwise("normal")


def region_captions(regions: DataFrame, captions: DataFrame, cell: int = CELL) -> DataFrame:
    """Nearest caption of each region: same page and category, widths overlap by a fifth, below
    (gap −12 to 120) before above (−12 to 80), then by gap and overlap.

    A grid join: a caption lies in the band of its near edge and in the columns it covers, a
    region looks into the bands its gap allows; a pair counts in the first column both cover. The
    best caption is an aggregate, so a page with many boxes is not paired in full."""
    at = lambda c: F.floor((F.col(c) if isinstance(c, str) else c) / cell)
    columns = lambda a, z: F.explode(F.sequence(at(F.least(a, z)), at(F.greatest(a, z))))
    c = captions.select("page", "category", "caption_text", *[F.col(x).alias(f"c_{x}") for x in ("x0", "y0", "x1", "y1")])
    sides = F.array(
        F.struct(F.lit(0).alias("side"), at("c_y0").alias("band"), F.col("c_y0").alias("edge")),
        F.struct(F.lit(1).alias("side"), at("c_y1").alias("band"), F.col("c_y1").alias("edge")),
    )
    c = c.withColumn("s", F.explode(sides)).select("*", "s.*").drop("s").withColumn("column", columns(F.col("c_x0"), F.col("c_x1")))
    looks = F.array(
        F.struct(F.lit(0).alias("side"), (F.col("y1") - 12).alias("lo"), (F.col("y1") + 120).alias("hi")),
        F.struct(F.lit(1).alias("side"), (F.col("y0") - 80).alias("lo"), (F.col("y0") + 12).alias("hi")),
    )
    r = regions.select("region_id", "page", "category", "x0", "x1", "y0", "y1").withColumn("s", F.explode(looks)).select("*", "s.*").drop("s")
    r = r.withColumn("band", F.explode(F.sequence(at("lo"), at("hi")))).withColumn("column", columns(F.col("x0"), F.col("x1")))
    overlap = (F.least("x1", "c_x1") - F.greatest("x0", "c_x0")) / F.greatest(
        F.lit(1.0), F.least(F.col("x1") - F.col("x0"), F.col("c_x1") - F.col("c_x0"))
    )
    gap = F.when(F.col("side") == 0, F.col("edge") - F.col("y1")).otherwise(F.col("y0") - F.col("edge"))
    rows = r.join(c, ["page", "category", "side", "band", "column"]).where(
        (F.col("column") == at(F.greatest(F.least("x0", "x1"), F.least("c_x0", "c_x1")))) & F.col("edge").between(F.col("lo"), F.col("hi")) & (overlap >= 0.2)
    )
    # A caption that fits below is not one above.
    best = rows.groupBy("region_id").agg(F.min_by("caption_text", F.struct("side", F.abs(gap), -overlap, "caption_text")).alias("caption"))
    return regions.join(best, "region_id", "left").withColumn("caption", F.trim(F.coalesce("caption", F.lit(""))))


def asset_kind(kind: Column, text: Column) -> Column:
    """Declared kind if known, else from the words of caption, label and path."""
    low, said = F.lower(F.trim(F.coalesce(kind, F.lit("")))), F.lower(text)
    return (
        F.when(low.isin("figure", "table", "chart", "formula"), low)
        .when(said.contains("table"), "table").when(said.contains("chart"), "chart").otherwise("figure")
    )


def union_first(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Union of lists where the first list that names a key wins; rows without a key all stay."""
    ranked = reduce(DataFrame.unionByName, [p.withColumn("list", F.lit(i)) for i, p in enumerate(parts)])
    rest = [c for c in ranked.columns if c != key]
    named = ranked.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    kept = named.groupBy(key).agg(F.min(F.struct("list", *[c for c in rest if c != "list"])).alias("_r")).select(key, "_r.*")
    bare = ranked.where(F.coalesce(F.col(key).cast("string"), F.lit("")) == "")
    return kept.unionByName(bare.select(*kept.columns))


def names_to_files(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """Exact name match only; a parsed image without a file keeps null."""
    return parsed.join(files.groupBy("name").agg(F.min("path").alias("file_path")), "name", "left")


Cue = tuple[str | None, str | None, tuple[str, ...], int]


def score_assets(pages: DataFrame, assets: DataFrame, cues: Sequence[Cue]) -> DataFrame:
    """Additive score of (page, asset) inside one document: asset base score plus the weight of
    every cue (kind or None, caption term or None, page terms, weight) that holds. Pages and
    assets of a document are few; cues are constants of the plan."""
    pairs = pages.select("doc_id", "page", "text").join(assets.select("doc_id", "path", "kind", "caption", "base", "area"), "doc_id")
    low, cap = F.lower("text"), F.lower(F.coalesce("caption", F.lit("")))
    ruled = pairs.withColumn("_c", F.lit(0))
    for kind, caption_term, page_terms, weight in cues:
        holds = reduce(lambda a, b: a | b, [low.contains(t) for t in page_terms])
        if kind is not None:
            holds = holds & (F.col("kind") == kind)
        if caption_term is not None:
            holds = holds & cap.contains(caption_term)
        ruled = ruled.withColumn("_c", F.col("_c") + F.when(holds, weight).otherwise(0))
    return ruled.withColumn("score", F.col("base") + F.col("_c")).drop("_c")


def bind_assets(pages: DataFrame, scored: DataFrame) -> DataFrame:
    """One binding per page by a ladder: structural pages take none; an asset named in the text;
    a numbered reference; a topic cue; else the best asset if the page hints at visuals."""
    low = F.lower("text")
    named = (F.col("filename") != "") & F.contains(F.col("text"), F.concat(F.lit("/"), F.col("filename"), F.lit(")")))
    number = F.regexp_extract(F.lower("caption"), r"(?:table|figure|fig\.?)\s*(\d+)", 1)
    numbered = (number != "") & F.contains(F.regexp_replace(low, r"\s+", " "), F.concat(F.col("kind"), F.lit(" "), number))
    mechanism = low.rlike("架构|architecture|mechanism|attention") & (F.col("kind") == "figure")
    result = low.rlike("结果|bleu|result|table|chart|trend|accuracy|指标|消融|训练成本") & F.col("kind").isin("table", "chart")
    hinted = F.col("image_count") + F.col("table_count") > 0
    step = (
        F.when(named, 1).when(numbered, 2).when(mechanism, 3).when(result, 4).when(hinted, 5)
    )
    rows = scored.join(pages.select("doc_id", "page", "purpose", "image_count", "table_count"), ["doc_id", "page"])
    rows = rows.withColumn("filename", F.element_at(F.split("path", "/"), -1)).withColumn("step", step)
    structural = F.col("purpose").isin("opening", "ending", "table_of_contents", "section_divider")
    best = (
        rows.where(F.col("step").isNotNull() & ~structural)
        .groupBy("doc_id", "page")
        .agg(F.min_by(F.struct("path", "kind", "step"), F.struct(F.col("step"), -F.col("score"), -F.col("area"), F.col("path"), F.col("kind"))).alias("b"))
        .select("doc_id", "page", "b.*")
    )
    return pages.select("doc_id", "page").join(best, ["doc_id", "page"], "left").withColumn(
        "requirement", F.when(F.col("step").isNull(), "none").when(F.col("step") == 5, "optional").otherwise("required")
    )


def bind_pages(pages: DataFrame, assets: DataFrame, cues: Sequence[Cue]) -> DataFrame:
    """``bind_assets`` over ``score_assets`` without pairing the pages and assets of a document.

    What a page names comes from its text: file names and numbered references are postings that
    meet assets by equality. Assets are put into classes of equal kind and equal cues, under a
    name, under a number and in a document; inside a class the order of assets is the same for
    every page, so its first asset stands for it. The classes under a key are one row, so a page
    stays one row a name, number or document, however many assets there are."""
    low, cap = F.lower("text"), F.lower(F.coalesce("caption", F.lit("")))

    def bits(holds: list[Column]) -> Column:
        return F.array(*[F.coalesce(h, F.lit(False)) for h in holds])

    on_page = [reduce(lambda a, b: a | b, [low.contains(t) for t in terms]) for _, _, terms, _ in cues]
    on_asset = [(F.lit(True) if kind is None else F.col("kind") == kind) & (F.lit(True) if term is None else cap.contains(term)) for kind, term, _, _ in cues]
    structural = F.col("purpose").isin("opening", "ending", "table_of_contents", "section_divider")
    own = pages.where(~F.coalesce(structural, F.lit(False))).select(
        "doc_id", "page", bits(on_page).alias("p_cues") if cues else F.array().cast("array<boolean>").alias("p_cues"),
        low.rlike("架构|architecture|mechanism|attention").alias("mechanism"),
        low.rlike("结果|bleu|result|table|chart|trend|accuracy|指标|消融|训练成本").alias("result"),
        (F.col("image_count") + F.col("table_count") > 0).alias("hinted"), "text",
    )
    held = assets.select(
        "doc_id", "path", "kind", "base", "area", F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.regexp_extract(F.lower("caption"), r"(?:table|figure|fig\.?)\s*(\d+)", 1).alias("number"),
        bits(on_asset).alias("a_cues") if cues else F.array().cast("array<boolean>").alias("a_cues"),
    )
    def classes(*keys: str) -> DataFrame:
        """The classes under a key as one small list: a class keeps its first asset."""
        first = F.min(F.struct((-F.col("base")).alias("_b"), (-F.col("area")).alias("_a"), "path")).alias("f")
        firsts = held.groupBy("doc_id", *{*keys, "kind"}, "a_cues").agg(first)
        row = F.struct("kind", "a_cues", (-F.col("f._b")).alias("base"), (-F.col("f._a")).alias("area"), F.col("f.path").alias("path"))
        return firsts.select("doc_id", *keys, row.alias("c")).groupBy("doc_id", *keys).agg(F.collect_list("c").alias("classes"))

    def place(c: Column, step: Column) -> Column:
        points = F.lit(0)
        for i, (_, _, _, weight) in enumerate(cues):
            points = points + F.when(F.col("p_cues")[i] & c["a_cues"][i], weight).otherwise(0)
        return F.struct(step.cast("int").alias("step"), (-(c["base"] + points)).alias("score"), (-c["area"]).alias("area"), c["path"].alias("path"), c["kind"].alias("kind"))

    def best_of(step: Callable[[Column], Column]) -> Column:
        """The best place of a page among the listed classes, found in its row."""
        return F.array_min(F.filter(F.transform("classes", lambda c: place(c, step(c))), lambda p: p["step"].isNotNull())).alias("at")

    # A name follows a slash and ends at its bracket.
    named = own.select("doc_id", "page", "p_cues", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?=/([^/]*?\)))"), F.lit(1)))).alias("n"))
    named = named.select("doc_id", "page", "p_cues", F.regexp_replace("n", r"\)$", "").alias("filename")).where("filename <> ''")
    found = F.regexp_extract_all(F.regexp_replace(F.lower("text"), r"\s+", " "), F.lit(r"(?=((?:table|chart|figure|formula) \d+))"), F.lit(1))
    numbered = own.select("doc_id", "page", "p_cues", F.explode(F.array_distinct(found)).alias("n")).select("doc_id", "page", "p_cues", F.split("n", " ").alias("n"))
    # "figure 12" also names figure 1, as a text contains it.
    starts = F.transform(F.sequence(F.lit(1), F.length(F.col("n")[1])), lambda k: F.substring(F.col("n")[1], F.lit(1), k))
    numbered = numbered.select("doc_id", "page", "p_cues", F.col("n")[0].alias("kind"), F.explode(starts).alias("number"))
    # A name that holds a bracket itself is rare, and is looked for as it is.
    names = classes("filename")
    odd = names.where(F.contains("filename", F.lit(")"))).join(own.select("doc_id", "page", "p_cues", "text"), "doc_id")
    odd = odd.where(F.contains("text", F.concat(F.lit("/"), F.col("filename"), F.lit(")"))))
    by_name = named.join(names, ["doc_id", "filename"]).select("doc_id", "page", "p_cues", "classes").unionByName(odd.select("doc_id", "page", "p_cues", "classes"))
    by_number = numbered.join(classes("kind", "number"), ["doc_id", "kind", "number"])
    topic = lambda c: F.when(F.col("mechanism") & (c["kind"] == "figure"), 3).when(F.col("result") & c["kind"].isin("table", "chart"), 4).when(F.col("hinted"), 5)
    by_class = own.drop("text").where("mechanism or result or hinted").join(classes(), "doc_id")
    rows = reduce(DataFrame.unionByName, [
        by_name.select("doc_id", "page", best_of(lambda c: F.lit(1))), by_number.select("doc_id", "page", best_of(lambda c: F.lit(2))), by_class.select("doc_id", "page", best_of(topic)),
    ])
    best = rows.groupBy("doc_id", "page").agg(F.min("at").alias("b")).select("doc_id", "page", "b.path", "b.kind", "b.step")
    return pages.select("doc_id", "page").join(best, ["doc_id", "page"], "left").withColumn(
        "requirement", F.when(F.col("step").isNull(), "none").when(F.col("step") == 5, "optional").otherwise("required")
    )


def extractive_summary(text: Column, cues: Sequence[str], limit: int | None = 8000, caps: Sequence[int | None] = (12, 24, 10, 8), longer: int | None = 30) -> Column:
    """Headings, cue lines (else the first ``longer`` longer lines), image and table lines of a
    text, each distinct and capped, as one clipped string; None takes all. Folded inside the row."""
    def first(items: Column, most: int | None) -> Column:
        return items if most is None else F.slice(items, 1, most)

    lines = F.filter(F.transform(F.split(text, "\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    heads = F.filter(lines, lambda x: x.startswith("#"))
    body = F.filter(lines, lambda x: ~x.startswith("#"))
    images = F.filter(body, lambda x: x.contains("![") & x.contains("]("))
    rest = F.filter(body, lambda x: ~(x.contains("![") & x.contains("](")))
    tables = F.filter(rest, lambda x: F.lower(x).contains("table"))
    cued = F.filter(rest, lambda x: reduce(lambda a, b: a | b, [F.lower(x).contains(c) for c in cues]))
    points = F.when(F.size(cued) > 0, cued).otherwise(first(F.filter(lines, lambda x: F.length(x) >= 40), longer))

    def part(title: str, items: Column, most: int | None) -> Column:
        kept = first(F.array_distinct(F.filter(F.transform(items, squeeze), lambda x: x != "")), most)
        return F.when(F.size(kept) > 0, F.concat(F.lit(f"## {title}\n- "), F.array_join(kept, "\n- ")))

    heads = F.transform(heads, lambda x: F.trim(F.regexp_replace(x, "^[# ]+", "")))
    parts = zip(("Sections", "Points", "Visuals", "Tables"), (heads, points, images, tables), caps, strict=True)
    said = F.concat_ws("\n", *[part(*p) for p in parts])
    return said if limit is None else F.left(said, F.lit(limit))
