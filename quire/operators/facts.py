"""Numbers in text and tables: typed, located, compared exactly.

Units, metrics and cue words are parameters; the defaults are the fixed values of the
financial domain. Values are decimals from parse to audit."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.rules import all_issues, missing, repeated, rule
from quire.functions.scan import top_rows
from quire.functions.spans import let, outside, spans
from quire.functions.text import squeeze, unless

DECIMAL = "decimal(38,10)"

# Unit spellings, longest first.
UNITS = (
    "万亿元", "千万元", "百万元", "亿美元", "万颗", "个百分点", "亿元", "万元", "美元", "GW", "MW", "元", "%", "倍", "颗",
)
# Unit to (family, scale, currency).
UNIT_TABLE = {
    "元": ("currency", "1", "CNY"),
    "万元": ("currency", "10000", "CNY"),
    "百万元": ("currency", "1000000", "CNY"),
    "千万": ("currency", "10000000", "CNY"),
    "亿元": ("currency", "100000000", "CNY"),
    "美元": ("currency", "1", "USD"),
    "万美元": ("currency", "10000", "USD"),
    "亿美元": ("currency", "100000000", "USD"),
    "%": ("percentage", "1", ""),
    "个百分点": ("percentage", "1", ""),
    "倍": ("multiple", "1", ""),
    "个": ("count", "1", ""),
    "项": ("count", "1", ""),
    "颗": ("count", "1", ""),
    "GW": ("capacity", "1000", ""),
    "MW": ("capacity", "1", ""),
}
# Metric patterns in priority order.
METRICS = (
    ("parent_net_profit", "归母净利润|归属于母公司.*净利润"),
    ("net_profit", "净利润|净利"),
    ("revenue", "营业收入|营业总收入|营收|销售收入|收入"),
    ("operating_cash_flow", "经营.*现金流|经营活动.*现金"),
    ("gross_margin", "毛利率"),
    ("net_margin", "净利率"),
    ("market_share", "市占率|市场份额"),
    ("eps", "(?i)EPS|每股收益"),
    ("pe", "(?i)PE|市盈率"),
    ("pb", "(?i)PB|市净率"),
    ("price", "价格|单价"),
    ("sales_volume", "销量|出货量"),
    ("capacity", "产能|装机"),
    ("composition", "构成|占比|份额"),
)
# A metric that is only a part of another one's wording is not a second metric.
NARROWER = {"parent_net_profit": "net_profit"}
# Patterns for numbers, periods, cues and missing cells.
NUMBER = r"[+\-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"
PERIOD = r"(?i)(?:(?:19|20)\d{2}(?:年末|年|[AE])?|(?:Q[1-4]|[一二三四]季度))"
YEAR_RANGE = r"((?:19|20)\d{2})\s*[-–—至]\s*((?:19|20)\d{2})年?"
METRIC_CUE = r"(?i)同比|环比|增长率|增速|CAGR|毛利率|净利率|市占率|占比|份额|营收|收入|利润|现金流|市场规模|销量|产量"
ADMIN_CUE = r"(?i)页码|第\s*\d+\s*页|股票代码|证券代码|报告编号|发布日期|报告日期"
LABEL_TAIL = r"(?i)(?:同比|环比|增长率|增速|CAGR|毛利率|净利率|市占率|占比|份额|构成)$"
# What stands between a metric's name and its number.
LABEL_STOP = "[^，,。；;：:]*$"
LABEL_LEAD = "^(?:预计|其中|分别|约|达到|为|是|达)+"
LABEL_LINK = r"(?:分别为|约为|达到|为|是|达)\s*$"
LABEL_EDGE = "^[ ：:、，,/]+|[ ：:、，,/]+$"
LABEL_WORD = r"[一-鿿A-Za-z][一-鿿A-Za-z0-9+\-]{0,24}"
TOTAL_ROW = r"(?i)合计|总计|total"
MISSING = ("", "-", "--", "—", "N/A", "n/a", "NA", "null")


@dataclass(frozen=True)
class Lexicon:
    """Unit spellings and metric patterns of a domain."""

    units: Sequence[str] = UNITS
    metrics: Sequence[tuple[str, str]] = METRICS
    cue: str = METRIC_CUE

    @property
    def unit_pattern(self) -> str:
        return "|".join(f"\\Q{u}\\E" for u in self.units)

    @property
    def mention(self) -> str:
        return rf"(?i)(?<![\d.]){NUMBER}(?:\s*(?:{self.unit_pattern}))?"

    @property
    def cell(self) -> str:
        return rf"(?i)^\s*({NUMBER})\s*({self.unit_pattern})?\s*$"


def clean(text: Column) -> Column:
    """Cell or block text without citations and emphasis marks, blanks squeezed."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)\[\^cite_?id:[^\]]+\]", "")
    return squeeze(F.regexp_replace(F.regexp_replace(bare, r"[*_`~]+", ""), "　", " "))


def to_decimal(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").try_cast(DECIMAL)


def canonical_unit(text: Column, units: Sequence[str] = UNITS) -> Column:
    out = F.lit("")
    for u in reversed(units):
        out = F.when(F.lower(text) == u.lower(), u).otherwise(out)
    return F.when(text.isNull(), "").otherwise(out)


def header_unit(text: Column, units: Sequence[str] = UNITS) -> Column:
    """First known unit that occurs in a header."""
    low = F.lower(text)
    found = F.lit("")
    for u in reversed(units):
        found = F.when(low.contains(u.lower()), u).otherwise(found)
    return found


def period_label(text: Column) -> Column:
    plain = F.regexp_replace(F.trim(text), "(年末|年)$", "")
    return F.when(F.upper(plain).rlike("^Q[1-4]$"), F.upper(plain)).otherwise(plain)


def period_labels(text: Column) -> Column:
    """Periods in order, distinct; a year range of up to ten years is spelled out."""
    years = F.transform(
        spans(text, YEAR_RANGE),
        lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"),
            F.regexp_extract(s["value"], YEAR_RANGE, 1).cast("int").alias("a"),
            F.regexp_extract(s["value"], YEAR_RANGE, 2).cast("int").alias("b"),
        ),
    )
    ranges = F.filter(years, lambda s: (s["a"] <= s["b"]) & (s["b"] - s["a"] <= 10))

    def labels(known: Column) -> Column:
        spelled = F.transform(
            known,
            lambda s: F.struct(s["start"].alias("start"), F.transform(F.sequence(s["a"], s["b"]), lambda y: y.cast("string")).alias("labels")),
        )
        single = F.transform(
            outside(spans(text, PERIOD), known),
            lambda s: F.struct(s["start"].alias("start"), F.array(period_label(s["value"])).alias("labels")),
        )
        return F.array_distinct(F.flatten(F.transform(F.array_sort(F.concat(spelled, single)), lambda s: s["labels"])))

    return let(ranges, labels)


def label_before(text: Column, start: Column) -> Column:
    """Word in front of a number: text since the last boundary, without periods and linking
    words; the last word counts."""
    cleared = reduce(lambda t, drop: F.regexp_replace(t, drop, ""), (YEAR_RANGE, PERIOD, LABEL_LEAD, LABEL_LINK, LABEL_EDGE), F.regexp_extract(F.left(text, start), LABEL_STOP, 0))
    last = F.try_element_at(F.regexp_extract_all(cleared, F.lit(LABEL_WORD), F.lit(0)), F.lit(-1))
    bare = F.trim(F.regexp_replace(last, LABEL_TAIL, ""))
    return F.when(bare == "", last).otherwise(bare)


def fact_id(kind: Column, source: Column, locator: Column) -> Column:
    """Stable id of a number from its source and place."""
    return F.concat(F.lit("fact_"), F.left(F.sha2(F.concat_ws(":", kind, source, locator), 256), F.lit(20)))


def metric_keys(text: Column, metrics: Sequence[tuple[str, str]] = METRICS) -> Column:
    """Metrics named by a text, in priority order, without parts of other metrics."""
    text = F.coalesce(text, F.lit(""))
    wide = {narrow: p for w, narrow in NARROWER.items() for k, p in metrics if k == w}
    named = [F.when(text.rlike(p) & (~text.rlike(wide[k]) if k in wide else F.lit(True)), k) for k, p in metrics]
    return F.array_compact(F.array(*named))


def unit_semantics(unit: Column) -> Column:
    """struct(family, scale, currency) of a unit; unknown units are volumes."""
    table = F.create_map(
        *[x for name, v in UNIT_TABLE.items() for x in (F.lit(name), F.struct(*[F.lit(p) for p in v]))]
    )
    found = F.try_element_at(table, F.coalesce(unit, F.lit("")))
    other = F.when(F.coalesce(unit, F.lit("")) == "", "dimensionless").otherwise("volume")
    return F.struct(
        F.coalesce(found["col1"], other).alias("family"), F.coalesce(found["col2"], F.lit("1")).alias("scale"),
        F.coalesce(found["col3"], F.lit("")).alias("currency"),
    )


def scenario(period: Column, text: Column) -> Column:
    """guidance, target, estimate or actual."""
    return (
        F.when(text.rlike("(?i)指引|guidance"), "guidance")
        .when(text.rlike("(?i)目标|target"), "target")
        .when(F.coalesce(F.upper(F.trim(period)).endswith("E"), F.lit(False)) | text.rlike("(?i)预计|预测|预期|estimate|forecast"), "estimate")
        .otherwise("actual")
    )


def classify(
    df: DataFrame, name: str, label: Column, context: Column, unit: Column, period: Column,
    metrics: Sequence[tuple[str, str]] = METRICS,
) -> DataFrame:
    """Add the struct ``name``: metric, measure, unit family, scale, currency and scenario of a
    number. The label beats the context; the context counts only when it names exactly one
    metric. Built in steps so that no pattern is matched twice."""
    text = F.concat_ws(" ", unless(F.col("_l"), F.lit("")), unless(F.col("_c"), F.lit("")))
    named = F.when(F.size("_own") > 0, F.get("_own", F.lit(0))).when(F.size("_around") == 1, F.get("_around", F.lit(0))).otherwise("unknown")
    family = F.col("_unit.family")
    measure = (
        F.when(F.col("_growth"), "growth_rate")
        .when(F.col("_share"), "share")
        .when((F.col("_named") == "eps") | F.col("_text").contains("每股"), "per_share")
        .when(F.col("_named").isin("pe", "pb") | (family == "multiple"), "multiple")
        .when(F.col("_named").isin("gross_margin", "net_margin", "market_share") | (family == "percentage"), "ratio")
        .when(family == "count", "count")
        .when((F.col("_named") != "unknown") | family.isin("currency", "capacity", "volume"), "amount")
        .otherwise("unknown")
    )
    key = F.when(~F.col("_growth") & F.col("_share") & (F.col("_named") == "unknown"), "composition").otherwise(F.col("_named"))
    return (
        df.withColumns({"_l": F.coalesce(label, F.lit("")), "_c": F.coalesce(context, F.lit("")), "_unit": unit_semantics(unit), "_p": period})
        .withColumns({"_own": metric_keys(F.col("_l"), metrics), "_around": metric_keys(F.col("_c"), metrics), "_text": text})
        .withColumns(
            {"_named": named, "_growth": F.col("_text").rlike("(?i)同比|环比|增速|增长率|CAGR"), "_share": F.col("_text").rlike("占比|份额|构成")}
        )
        .withColumn(
            name,
            F.struct(
                key.alias("metric_key"), F.trim("_l").alias("metric_label"), measure.alias("measure_kind"), family.alias("unit_family"),
                F.col("_unit.scale").alias("unit_scale"), F.col("_unit.currency").alias("currency"), scenario(F.col("_p"), F.col("_text")).alias("scenario"),
            ),
        )
        .drop("_l", "_c", "_unit", "_p", "_own", "_around", "_text", "_named", "_growth", "_share")
    )


def with_mentions(df: DataFrame, text: str, lexicon: Lexicon = Lexicon()) -> DataFrame:
    """Add ``found``: the numbers of a text as struct(start, end, raw, unit). Digits of periods do
    not count, and a number without unit counts only where the text names a metric. Texts
    without a digit leave at once; each step is a column, so nothing is computed twice."""
    typed = F.transform(
        "_all",
        lambda s: F.struct(
            s["start"].alias("start"),
            (s["start"] + F.length(F.regexp_extract(s["value"], NUMBER, 0))).alias("end"),
            F.regexp_extract(s["value"], NUMBER, 0).alias("raw"),
            canonical_unit(F.trim(F.regexp_replace(s["value"], rf"^{NUMBER}", "")), lexicon.units).alias("unit"),
        ),
    )
    units = F.array_distinct(F.filter(F.transform("_typed", lambda s: s["unit"]), lambda u: u != ""))
    filled = F.transform(
        "_typed",
        lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["raw"].alias("raw"),
            F.when(s["unit"] == "", F.col("_shared")).otherwise(s["unit"]).alias("unit"),
        ),
    )
    return (
        df.where(F.col(text).rlike("[0-9]"))
        .withColumns({"_hits": spans(F.col(text), lexicon.mention), "near": spans(F.col(text), PERIOD), "_cued": F.col(text).rlike(lexicon.cue)})
        .withColumn("_all", outside(F.col("_hits"), F.col("near")))
        .withColumn("_typed", typed)
        .withColumn("_units", units)
        .withColumn("_shared", F.when(F.size("_units") == 1, F.get("_units", F.lit(0))).otherwise(""))
        .withColumn("_filled", filled)
        .withColumn("found", F.filter("_filled", lambda s: (s["unit"] != "") | F.col("_cued")))
        .drop("_hits", "_cued", "_all", "_typed", "_units", "_shared", "_filled")
    )


def block_facts(blocks: DataFrame, context: str | None = None, lexicon: Lexicon = Lexicon()) -> DataFrame:
    """One row per number in paragraph-like blocks (doc_id, id, type, text_raw): place, value,
    unit, label, period and metric typing. All inside the row; no shuffle."""
    text = F.coalesce("text_raw", F.lit(""))
    rows = (
        blocks.where(F.col("type").isin("paragraph", "blockquote", "list_item"))
        .select("doc_id", F.col("id").alias("source_id"), text.alias("text"), (F.col(context) if context else F.lit("")).alias("context"))
    )
    rows = (
        with_mentions(rows, "text", lexicon)
        .withColumn("periods", period_labels(F.col("text")))
        .withColumn("labels", F.transform("found", lambda s: label_before(F.col("text"), s["start"])))
    )
    one = rows.select(
        "doc_id", "source_id", "text", "context", "periods", "near", "labels", F.size("found").alias("n"),
        F.posexplode("found").alias("i", "m"),
    )
    known = F.filter(F.slice("labels", F.lit(1), F.col("i") + 1), lambda x: x.isNotNull())
    label = F.try_element_at(known, F.lit(-1))
    before = F.filter(
        "near", lambda p: (p["end"] <= F.col("m.start")) & (F.col("m.start") - p["end"] <= 40)
    )
    period = F.when(F.size("periods") == F.col("n"), F.get("periods", F.col("i"))).otherwise(
        period_label(F.try_element_at(before, F.lit(-1))["value"])
    )
    typed = one.withColumns({"label": label, "period": period, "unit": F.col("m.unit")})
    meant = classify(typed, "_t", F.col("label"), F.concat_ws(" ", "context", "text"), F.col("unit"), F.col("period"), lexicon.metrics)
    return meant.select(
        "doc_id",
        fact_id(F.lit("block"), F.col("source_id"), F.concat_ws(":", F.lit("span"), "m.start", "m.end")).alias("fact_id"),
        F.lit("block").alias("source_kind"), "source_id", F.col("m.raw").alias("raw_value"),
        to_decimal(F.col("m.raw")).alias("normalized_value"), "unit", "label", "period",
        F.col("m.start").alias("start"), F.col("m.end").alias("end"),
        F.lit(None).cast("int").alias("row_index"), F.lit(None).cast("int").alias("column_index"),
        F.lit("document").alias("entity_id"), F.lit("").alias("entity_name"), F.lit("company").alias("entity_type"),
        F.lit("consolidated").alias("scope"), F.lit("").alias("scope_label"), "_t.*",
    )


def cell_number(text: Column, lexicon: Lexicon = Lexicon()) -> Column:
    """A cell that is exactly one number: struct(raw, value, unit); null otherwise."""
    t = clean(text)
    raw = F.regexp_extract(t, lexicon.cell, 1)
    value = to_decimal(raw)
    ok = ~t.isin(*MISSING) & (raw != "") & value.isNotNull()
    return F.when(
        ok,
        F.struct(
            raw.alias("raw"), value.alias("value"),
            canonical_unit(F.regexp_extract(t, lexicon.cell, 2), lexicon.units).alias("unit"),
        ),
    )


def table_cells(tables: DataFrame) -> DataFrame:
    """Tables with ``columns`` and ``rows`` in long form, first column kept as the row label."""
    rows = tables.select("doc_id", F.col("id").alias("source_id"), "columns", F.posexplode("rows").alias("row_index", "_row"))
    return rows.select(
        "doc_id", "source_id", "columns", "row_index", F.get("_row", F.lit(0)).alias("label"),
        F.posexplode("_row").alias("column_index", "cell"),
    ).withColumn("header", F.coalesce(F.get("columns", F.col("column_index")), F.lit("")))


def table_facts(tables: DataFrame, context: str | None = None, lexicon: Lexicon = Lexicon()) -> DataFrame:
    """One row per numeric cell: unit from the cell, else its header, else the table; period
    from the header; entity and scope from the row label."""
    cells = table_cells(tables.withColumn("columns", F.transform("columns", clean)))
    if context:
        cells = cells.join(tables.select("doc_id", F.col("id").alias("source_id"), F.col(context).alias("context")), ["doc_id", "source_id"])
    else:
        cells = cells.withColumn("context", F.lit(""))
    first = F.coalesce(F.get("columns", F.lit(0)), F.lit(""))
    rows = (
        cells.where(F.col("column_index") > 0)
        .withColumn("v", cell_number(F.col("cell"), lexicon))
        .where(F.col("v").isNotNull())
        .withColumn("label", unless(clean(F.col("label")), F.lit("")))
        .withColumn("periods", period_labels(F.col("header")))
    )
    period = F.when(F.size("periods") == 1, F.get("periods", F.lit(0))).when(
        F.size("periods") > 1, F.trim(F.regexp_replace("header", "[（(][^）)]*[）)]", ""))
    )
    unit = F.coalesce(
        unless("v.unit", F.lit("")), unless(header_unit(F.col("header"), lexicon.units), F.lit("")),
        unless(header_unit(first, lexicon.units), F.lit("")), F.lit(""),
    )
    rows = rows.withColumns({"period": period, "unit": unit, "peer": first.rlike("公司|企业|可比|证券") & F.col("label").isNotNull()})
    said = F.when(F.coalesce("period", F.lit("")) != "", F.col("label")).otherwise(F.col("header"))
    rows = classify(rows, "_a", said, F.col("header"), F.col("unit"), F.col("period"), lexicon.metrics)
    rows = classify(rows, "_b", F.lit(""), F.col("context"), F.col("unit"), F.col("period"), lexicon.metrics)
    lost = (F.col("_a.metric_key") == "unknown") & (F.col("context") != "")
    key = F.when(lost, F.col("_b.metric_key")).otherwise(F.col("_a.metric_key"))
    measure = F.when(lost & (F.col("_a.measure_kind") == "unknown"), F.col("_b.measure_kind")).otherwise(F.col("_a.measure_kind"))
    timed = F.coalesce("period", F.lit("")) != ""
    scope = (
        F.when(F.col("peer"), "consolidated")
        .when(timed & F.col("label").isNotNull() & (key == "unknown"), "segment")
        .when(~timed & F.col("label").isNotNull(), "category")
        .otherwise("consolidated")
    )
    return rows.select(
        "doc_id",
        fact_id(F.lit("table"), F.col("source_id"), F.concat_ws(":", F.lit("cell"), "row_index", "column_index")).alias("fact_id"),
        F.lit("table").alias("source_kind"), "source_id", F.col("v.raw").alias("raw_value"), F.col("v.value").alias("normalized_value"),
        "unit", "label", "period", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"),
        "row_index", "column_index",
        F.when(F.col("peer"), F.concat_ws(":", F.lit("table"), "source_id", F.lit("entity"), "row_index")).otherwise("document").alias("entity_id"),
        F.when(F.col("peer"), F.col("label")).otherwise("").alias("entity_name"),
        F.when(F.col("peer"), "peer").otherwise("company").alias("entity_type"),
        scope.alias("scope"), F.when(scope != "consolidated", F.col("label")).otherwise("").alias("scope_label"),
        key.alias("metric_key"),
        F.when(lost, F.col("_b.metric_label")).otherwise(F.col("_a.metric_label")).alias("metric_label"),
        measure.alias("measure_kind"), F.col("_a.unit_family").alias("unit_family"), F.col("_a.unit_scale").alias("unit_scale"),
        F.col("_a.currency").alias("currency"), F.col("_a.scenario").alias("scenario"),
    )


def ledger(prose: DataFrame, cells: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """All facts, or those of selected evidence (doc_id, kind, id)."""
    facts = prose.unionByName(cells)
    if refs is None:
        return facts
    chosen = refs.select("doc_id", F.col("kind").alias("source_kind"), F.col("id").alias("source_id")).distinct()
    return facts.join(chosen, ["doc_id", "source_kind", "source_id"], "left_semi")


def fact_by_id(facts: DataFrame, id: str) -> DataFrame:
    return facts.where(F.col("fact_id") == id)


def facts_of(facts: DataFrame, kind: str, id: str) -> DataFrame:
    return facts.where((F.col("source_kind") == kind) & (F.col("source_id") == id))


def fact_in_cell(facts: DataFrame, table: str, row: int, column: int) -> DataFrame:
    return facts_of(facts, "table", table).where((F.col("row_index") == row) & (F.col("column_index") == column))


def ledger_issues(facts: DataFrame) -> DataFrame:
    """Contract of a fact: unique id, a finite value, exactly one kind of place, a positive
    scale, and known enumeration values."""
    spanned = F.col("start").isNotNull() & F.col("end").isNotNull() & (F.col("start") >= 0) & (F.col("start") < F.col("end"))
    placed = F.col("row_index").isNotNull() & F.col("column_index").isNotNull()
    one = (spanned & F.col("row_index").isNull() & F.col("column_index").isNull()) | (
        placed & F.col("start").isNull() & F.col("end").isNull()
    )
    families = ("currency", "percentage", "multiple", "count", "capacity", "volume", "dimensionless", "unknown")
    kinds = ("amount", "growth_rate", "ratio", "share", "per_share", "multiple", "count", "unknown")
    return all_issues(
        repeated(facts, ["doc_id", "fact_id"], "duplicate_fact_id"),
        rule(facts, "value_not_finite", "fact_id", F.col("normalized_value").isNull()),
        rule(facts, "locator", "fact_id", ~F.coalesce(one, F.lit(False))),
        rule(facts, "unit_scale", "fact_id", ~F.coalesce(F.col("unit_scale").try_cast("double") > 0, F.lit(False))),
        rule(facts, "unit_family", "fact_id", ~F.col("unit_family").isin(*families)),
        rule(facts, "measure_kind", "fact_id", ~F.col("measure_kind").isin(*kinds)),
        rule(facts, "scenario", "fact_id", ~F.col("scenario").isin("actual", "estimate", "guidance", "target", "unknown")),
    )


def good_facts(facts: DataFrame, issues: DataFrame) -> DataFrame:
    """Facts without an issue; the others stay in the issue table."""
    return facts.join(issues.select(F.col("path").alias("fact_id")).distinct(), "fact_id", "left_anti")


def serialized(facts: DataFrame) -> DataFrame:
    """One JSON text per fact, and the fact count of its document."""
    place = F.struct("start", "end", "row_index", "column_index")
    body = F.to_json(
        F.struct(
            "fact_id", F.struct(F.col("source_kind").alias("kind"), F.col("source_id").alias("id")).alias("source"), "raw_value",
            F.col("normalized_value").cast("string").alias("normalized_value"), "unit", "label", "period", "metric_key", "measure_kind",
            "unit_family", "unit_scale", "currency", "scope", "scenario", place.alias("source_locator"),
        )
    )
    return facts.select("doc_id", "fact_id", body.alias("fact"))


def serialized_counts(facts: DataFrame) -> DataFrame:
    return facts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("fact_count"))


def canonical_hash(columns: Sequence[Column], length: int = 64) -> Column:
    """Hash of a canonical JSON list of values; null and text are kept apart."""
    parts = [F.coalesce(F.to_json(F.array(c.cast("string"))), F.lit("[null]")) for c in columns]
    return F.left(F.sha2(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")), 256), F.lit(length))


# --- candidates ------------------------------------------------------------------------

MIN_SCORE = 0.55


def composition(values: Column, low: float = 95.0, high: float = 105.0) -> Column:
    """Three to six shares, none negative, that sum to about a hundred."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return F.size(values).between(3, 6) & ~F.exists(values, lambda x: x < 0) & total.between(low, high)


def compositions(df: DataFrame, keys: Sequence[str], value: str, low: float = 95.0, high: float = 105.0) -> DataFrame:
    """The same test over rows: groups whose values form a composition."""
    return df.groupBy(*keys).agg(
        F.count(value).alias("parts"), F.min(value).alias("least"), F.sum(value).alias("total")
    ).where(F.col("parts").between(3, 6) & (F.col("least") >= 0) & F.round("total", 6).between(low, high))


def candidate_id(slide: Column, visual: Column, intent: Column, refs: Column) -> Column:
    """Content hash of a candidate: canonical JSON with sorted keys."""
    def quoted(c: Column) -> Column:
        return F.coalesce(F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", ""), F.lit("null"))

    payload = F.concat(
        F.lit('{"chart_intent":'), F.when(intent.isNull(), "null").otherwise(quoted(intent)), F.lit(',"evidence_refs":['),
        F.array_join(F.transform(refs, lambda r: F.to_json(F.array(r["kind"], r["id"]))), ","),
        F.lit('],"slide_id":'), F.when(slide.isNull(), "null").otherwise(quoted(slide)), F.lit(',"visual_type":'), quoted(visual), F.lit("}"),
    )
    return F.concat(F.lit("cand_"), F.left(F.sha2(payload, 256), F.lit(16)))


def score_group(numbers: Column, units: Column, periods: Column, composed: Column, labelled: Column, cued: Column) -> Column:
    """struct(intent, score) of comparable numbers; null when they do not make a chart."""
    fits = (numbers >= 2) & labelled & ((units <= 1) | composed)
    intent = F.when(composed, "composition").when(periods >= 4, "trend").otherwise("comparison")
    score = 0.40 + F.when(composed | (periods >= 4), 0.30).otherwise(0.25) + F.when(cued, 0.10).otherwise(0.0)
    bounded = F.least(F.lit(1.0), F.round(score, 4))
    return F.when(fits & (bounded >= MIN_SCORE), F.struct(intent.alias("intent"), bounded.alias("score")))


def block_candidates(blocks: DataFrame, lexicon: Lexicon = Lexicon()) -> DataFrame:
    """Chart candidates among paragraph-like blocks, scored inside the row."""
    rows = (
        blocks.where(F.col("type").isin("paragraph", "blockquote", "list_item") & F.col("text_raw").rlike("[0-9]"))
        .select("doc_id", "id", clean(F.col("text_raw")).alias("text"))
        .withColumns({"hits": spans(F.col("text"), lexicon.mention), "near": spans(F.col("text"), PERIOD), "cued": F.col("text").rlike(lexicon.cue)})
        .withColumn("found", outside(F.col("hits"), F.col("near")))
    )
    cued = F.col("cued")
    observed = F.transform(
        "found",
        lambda s: F.struct(
            to_decimal(F.regexp_extract(s["value"], NUMBER, 0)).alias("value"),
            canonical_unit(F.trim(F.regexp_replace(s["value"], rf"^{NUMBER}", "")), lexicon.units).alias("unit"),
        ),
    )
    rows = rows.withColumn("typed", observed).withColumn("obs", F.filter("typed", lambda o: (o["unit"] != "") | cued))
    rows = rows.where(F.size("obs") >= 2)
    units = F.size(F.array_distinct(F.filter(F.transform("obs", lambda o: o["unit"]), lambda u: u != "")))
    percents = F.transform(F.filter("obs", lambda o: o["unit"] == "%"), lambda o: o["value"])
    composed = composition(percents) & (F.size(percents) == F.size("obs"))
    periods = F.size(F.array_distinct(F.transform("near", lambda p: p["value"])))
    labelled = F.col("text").rlike(r"[一-鿿A-Za-z]{2,}")
    office = F.col("text").rlike(ADMIN_CUE) & ~cued & (units == 0)
    judged = rows.withColumn("s", F.when(~office, score_group(F.size("obs"), units, periods, composed, labelled, cued)))
    return judged.where(F.col("s").isNotNull()).select(
        "doc_id", F.lit("block").alias("kind"), "id", F.lit("chart").alias("visual_type"), F.col("s.intent").alias("chart_intent"),
        F.col("s.score").alias("score"), F.left("text", F.lit(400)).alias("excerpt"),
    )


def table_candidates(tables: DataFrame, lexicon: Lexicon = Lexicon()) -> DataFrame:
    """Chart and table candidates among complete tables."""
    cells = table_cells(tables.where(F.col("status") == "complete").withColumn("columns", F.transform("columns", clean)))
    cells = cells.withColumn("v", cell_number(F.col("cell"), lexicon)).withColumn("_label", cell_number(F.col("label"), lexicon))
    key = ["doc_id", "source_id"]
    total = F.coalesce("label", F.lit("")).rlike(TOTAL_ROW)
    by_column = (
        cells.where((F.col("column_index") > 0) & F.col("v").isNotNull())
        .groupBy(*key, "column_index", "header")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.collect_set(unless("v.unit", F.lit(""))).alias("units"),
            F.count_if(~total).alias("m"),
            F.count_if(~total & (F.col("v.unit") == "%")).alias("pct"),
            F.count_if(~total & (F.col("v.unit") == "")).alias("bare"),
            F.min(F.when(~total, F.col("v.value"))).alias("low"),
            F.sum(F.when(~total, F.col("v.value"))).alias("sum"),
        )
    )
    share = F.col("header").rlike("%|占比|份额|构成")
    composed = (
        F.col("m").between(3, 6) & ((F.col("pct") == F.col("m")) | ((F.col("bare") == F.col("m")) & share))
        & (F.col("low") >= 0) & F.col("sum").between(95, 105)
    )
    numeric = by_column.groupBy(*key).agg(
        F.count(F.lit(1)).alias("numeric_columns"), F.sum("n").alias("values"),
        F.max(F.size("units")).alias("most_units"), F.size(F.array_distinct(F.flatten(F.collect_list("units")))).alias("all_units"),
        F.count_if(F.col("header").rlike(PERIOD)).alias("period_columns"), F.bool_or(composed).alias("composed"),
    )
    shape = cells.where(F.col("column_index") == 0).groupBy(*key).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if((F.coalesce("label", F.lit("")) != "") & F.col("_label").isNull()).alias("labels"),
    )
    words = tables.select(
        "doc_id", F.col("id").alias("source_id"),
        F.array_join(F.concat("columns", F.flatten(F.slice("rows", 1, 8))), " | ").alias("excerpt"), F.size("columns").alias("width"),
    )
    rows = numeric.join(shape, key).join(words, key).where((F.col("width") >= 2) & (F.col("labels") > 0) & (F.col("values") >= 2))
    mixed = (F.col("most_units") > 1) | (F.col("all_units") > 1)
    intent = (
        F.when(F.col("composed"), "composition")
        .when((F.col("period_columns") >= 4) & ~mixed, "trend")
        .when((F.col("labels") >= 2) & (F.col("numeric_columns") <= 3) & (F.col("rows") <= 8) & ~mixed, "comparison")
    )
    extra = F.when(intent.isin("composition", "trend"), 0.25).when(intent == "comparison", 0.20).otherwise(0.0)
    score = 0.65 + extra + F.when(F.col("excerpt").rlike(lexicon.cue), 0.10).otherwise(0.0)
    return rows.select(
        "doc_id", F.lit("table").alias("kind"), F.col("source_id").alias("id"),
        F.when(intent.isNull(), "table").otherwise("chart").alias("visual_type"), intent.alias("chart_intent"),
        F.least(F.lit(1.0), F.round(score, 4)).alias("score"), F.left("excerpt", F.lit(400)).alias("excerpt"),
    )


def corpus_candidates(blocks: DataFrame, tables: DataFrame, lexicon: Lexicon = Lexicon()) -> DataFrame:
    """Every candidate of every document."""
    return best_candidates(block_candidates(blocks, lexicon).unionByName(table_candidates(tables, lexicon)), ["doc_id"])


def best_candidates(candidates: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """One candidate per (evidence, type, intent): the best score."""
    keys = [*scope, "kind", "id", "visual_type", "chart_intent"]
    rest = [c for c in candidates.columns if c not in keys]
    # A null intent is a group of its own in groupBy.
    return candidates.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct("score", *[c for c in rest if c != "score"])).alias("_r")
    ).select(*keys, "_r.*")


def anchor_window(df: DataFrame, anchors: DataFrame, keys: Sequence[str], pos: str, before: int = 6, size: int = 12) -> DataFrame:
    """Rows around the anchor of a key: from ``before`` rows ahead of it, ``size`` rows. One
    anchor per key; a key without anchor gives its first ``size`` rows."""
    start = F.greatest(F.lit(0), F.coalesce("_anchor", F.lit(0)) - before)
    rows = df.join(anchors.select(*keys, F.col(pos).alias("_anchor")), list(keys), "left")
    return rows.where((F.col(pos) >= start) & (F.col(pos) < start + size)).drop("_anchor")


def scoped_candidates(slides: DataFrame, refs: DataFrame, evidence: DataFrame, relations: DataFrame, candidates: DataFrame, blocks_in_section: int | None = 12, tables_in_section: int | None = 4) -> DataFrame:
    """Candidates of every content slide: from its own evidence if that gives any, else from a
    window of its section (all of it for None). ``refs``: slide evidence (doc_id, slide_id, kind, id);
    ``evidence`` has section_id and pos; ``relations`` link blocks to tables."""
    pages = slides.where((F.coalesce("slide_type", F.lit("")) != "figure_page") & (F.coalesce("page_role", F.lit("content")) == "content"))
    own = pages.select("doc_id", "slide_id").join(refs, ["doc_id", "slide_id"]).join(evidence.select("doc_id", "kind", "id"), ["doc_id", "kind", "id"], "left_semi")
    linked = own.where(F.col("kind") == "block").join(
        relations.where(F.col("kind") == "table").select("doc_id", F.col("block_id").alias("id"), "target_id"), ["doc_id", "id"]
    )
    direct = own.select("doc_id", "slide_id", "kind", "id").unionByName(
        linked.select("doc_id", "slide_id", F.lit("table").alias("kind"), F.col("target_id").alias("id"))
    ).distinct()
    hits = direct.join(candidates, ["doc_id", "kind", "id"])
    open_pages = pages.join(hits.select("doc_id", "slide_id").distinct(), ["doc_id", "slide_id"], "left_anti")
    placed = direct.join(evidence.select("doc_id", "kind", "id", "section_id", "pos"), ["doc_id", "kind", "id"])
    sections = (
        open_pages.where(F.col("section_ref").isNotNull()).select("doc_id", "slide_id", F.col("section_ref").alias("section_id"))
        .unionByName(placed.join(open_pages.select("doc_id", "slide_id"), ["doc_id", "slide_id"]).select("doc_id", "slide_id", "section_id"))
        .where(F.col("section_id").isNotNull()).distinct()
    )
    anchors = placed.where(F.col("kind") == "block").groupBy("doc_id", "slide_id", "section_id").agg(F.min("pos").alias("_anchor"))
    around = (
        sections.join(evidence.where(F.col("kind") == "block"), ["doc_id", "section_id"])
        .join(anchors, ["doc_id", "slide_id", "section_id"], "left")
        .where(F.lit(True) if blocks_in_section is None else F.col("pos") >= F.coalesce(F.col("_anchor") - blocks_in_section // 2, F.lit(0)))
    )
    blocks = top_rows(around, ["doc_id", "slide_id"], [F.col("pos"), F.col("id")], blocks_in_section, "_n").select("doc_id", "slide_id", "kind", "id")
    near = sections.join(evidence.where(F.col("kind") == "table"), ["doc_id", "section_id"])
    tables = top_rows(near, ["doc_id", "slide_id"], [F.col("pos"), F.col("id")], tables_in_section, "_n").select("doc_id", "slide_id", "kind", "id")
    expanded = blocks.unionByName(tables).join(direct, ["doc_id", "slide_id", "kind", "id"], "left_anti").join(candidates, ["doc_id", "kind", "id"])
    return best_candidates(hits.unionByName(expanded.select(*hits.columns)), ["doc_id", "slide_id"])


def merge_plans(explicit: DataFrame, located: DataFrame, keys: Sequence[str], evidence: Sequence[str], score: str, mode: str = "active", most: int = 2) -> DataFrame:
    """Explicit suggestions all stay; located ones fill up to ``most`` per key, best first, and
    only on evidence no suggestion uses. Mode ``shadow`` and ``disabled`` add none."""
    if mode not in ("active", "shadow", "disabled"):
        raise ValueError("mode must be active, shadow or disabled")
    planned = explicit.withColumn("origin", F.lit("explicit"))
    if mode != "active":
        return planned
    taken = explicit.groupBy(*keys).agg(F.count(F.lit(1)).alias("_taken"))
    free = located.join(explicit.select(*keys, *evidence).distinct(), [*keys, *evidence], "left_anti")
    ranked = top_rows(free, keys, [F.desc(score), *[F.col(e) for e in evidence]], most, "_n")
    added = ranked.join(taken, list(keys), "left").where(F.col("_n") + F.coalesce("_taken", F.lit(0)) <= most)
    return planned.unionByName(added.select(*explicit.columns).withColumn("origin", F.lit("located")))


def candidate_report(plans: DataFrame, candidates: DataFrame, keys: Sequence[str], evidence: Sequence[str]) -> DataFrame:
    """Every candidate with whether it was planned; the plan itself does not change."""
    used = plans.select(*keys, *evidence).distinct().withColumn("_used", F.lit(True))
    return candidates.join(used, [*keys, *evidence], "left").withColumn(
        "decision", F.when(F.col("_used"), "planned").otherwise("not planned")
    ).drop("_used")


# --- proposals and groups --------------------------------------------------------------


def block_proposals(plans: DataFrame, facts: DataFrame) -> DataFrame:
    """Single-series proposal from the facts of a block: distinct periods make a trend, distinct
    labels a comparison; one unit only. A block holds few facts. ``plans``: doc_id, plan_id,
    id, chart_intent."""
    rows = facts.where(F.col("source_kind") == "block").withColumnRenamed("source_id", "id")
    ordered = F.sort_array(F.collect_list(F.struct("start", "fact_id", "label", "period", "unit")))
    per = rows.groupBy("doc_id", "id").agg(ordered.alias("f"))
    units = F.array_distinct(F.filter(F.transform("f", lambda x: x["unit"]), lambda u: u != ""))
    timed = F.filter("f", lambda x: F.coalesce(x["period"], F.lit("")) != "")
    named = F.filter("f", lambda x: F.coalesce(x["label"], F.lit("")) != "")

    def distinct(c: Column, name: str) -> Column:
        return F.size(F.array_distinct(F.transform(c, lambda x: x[name]))) == F.size(c)

    choice = (
        F.when((F.col("chart_intent") == "composition") & distinct(named, "label") & (F.size(named) >= 2), "composition")
        .when(F.col("chart_intent").eqNullSafe("composition"), None)
        .when((F.size(timed) >= 2) & distinct(timed, "period"), "trend")
        .when((F.size(named) >= 2) & distinct(named, "label"), F.coalesce("chart_intent", F.lit("comparison")))
    )
    out = plans.join(per, ["doc_id", "id"]).withColumn("intent", choice).where(F.col("intent").isNotNull() & (F.size("f") >= 2) & (F.size(units) <= 1))
    picked = F.when(F.col("intent") == "trend", timed).otherwise(named)
    out = out.withColumn("categories", F.transform(picked, lambda x: F.when(F.col("intent") == "trend", x["period"]).otherwise(x["label"])))
    chart = (
        F.when(F.col("intent") == "composition", "pie").when((F.col("intent") == "trend") & (F.size("categories") >= 4), "line")
        .when(F.col("chart_intent") == "comparison", "bar").otherwise("column")
    )
    return out.select(
        "doc_id", "plan_id", "id", "intent", chart.alias("chart_type"), F.coalesce(F.get(units, F.lit(0)), F.lit("")).alias("unit"), "categories",
        F.array(F.struct(F.lit("Value").alias("name"), F.transform(picked, lambda x: x["fact_id"]).alias("fact_ids"))).alias("series"),
    )


SIGNATURE = ("metric_key", "measure_kind", "unit_family", "unit_scale", "currency", "scope")


def table_series(facts: DataFrame, signature: Sequence[str] = SIGNATURE, keep: int | None = 3) -> DataFrame:
    """Trend series of each table: the largest group of period columns that share a unit, rows
    complete over those columns with one metric signature, the largest signature group, and
    of it the first ``keep`` rows (all for None). One row per (table, row) with its signature."""
    key = ["doc_id", "source_id"]
    timed = facts.where((F.col("source_kind") == "table") & (F.coalesce("period", F.lit("")) != ""))
    columns = timed.groupBy(*key, "column_index").agg(
        F.min(unless("unit", F.lit(""))).alias("_u"), F.max(unless("unit", F.lit(""))).alias("_v")
    ).where(F.col("_u").eqNullSafe(F.col("_v")))
    groups = columns.groupBy(*key, F.coalesce("_u", F.lit("")).alias("group_unit")).agg(
        F.count(F.lit(1)).alias("width"), F.min("column_index").alias("_first")
    ).where(F.col("width") >= 2)
    best = groups.groupBy(*key).agg(F.max_by(F.struct("group_unit", "width"), F.struct("width", -F.col("_first"))).alias("b")).select(*key, "b.*")
    chosen = columns.withColumn("group_unit", F.coalesce("_u", F.lit(""))).join(best, [*key, "group_unit"]).select(*key, "column_index", "width")
    text = F.concat_ws("|", *signature)
    rows = timed.withColumn("_s", text).join(chosen, [*key, "column_index"]).groupBy(*key, "row_index", "width").agg(
        F.count(F.lit(1)).alias("n"), F.min("_s").alias("signature"), F.max("_s").alias("_s2"), F.min("measure_kind").alias("measure"),
    ).where((F.col("n") == F.col("width")) & (F.col("signature") == F.col("_s2")) & (F.col("measure") != "unknown"))
    sizes = rows.groupBy(*key, "signature").agg(F.count(F.lit(1)).alias("members"), F.min("row_index").alias("_first"))
    winner = sizes.groupBy(*key).agg(F.max_by("signature", F.struct("members", -F.col("_first"))).alias("signature"))
    return top_rows(rows.join(winner, [*key, "signature"]), key, [F.col("row_index")], keep, "series").select(*key, "row_index", "signature", "width", "series")


def table_proposals(plans: DataFrame, tables: DataFrame, facts: DataFrame) -> DataFrame:
    """Chart proposal of each table plan in long form: one row per point (plan_id, intent,
    series, category, fact_id, unit). Composition takes the first composed column, then a
    trend if periods allow, else the first comparable column of the first eight rows."""
    key = ["doc_id", "source_id"]
    named = tables.select("doc_id", F.col("id").alias("source_id"), "columns", "rows")
    rows = plans.withColumnRenamed("id", "source_id").join(facts.where(F.col("source_kind") == "table"), key).join(named, key)
    header = F.get("columns", F.col("column_index"))
    label = F.get(F.get("rows", F.col("row_index")), F.lit(0))
    rows = rows.withColumns({"header": header, "row_label": label})
    part = ~F.coalesce("row_label", F.lit("")).rlike(TOTAL_ROW)
    composed = (
        rows.where((F.col("chart_intent") == "composition") & part)
        .groupBy("doc_id", "plan_id", "source_id", "column_index")
        .agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("unit") == "%").alias("p"),
            F.min("normalized_value").alias("low"), F.sum("normalized_value").alias("sum"),
        )
        .where(F.col("n").between(3, 6) & (F.col("p") == F.col("n")) & (F.col("low") >= 0) & F.col("sum").between(95, 105))
        .groupBy("doc_id", "plan_id", "source_id").agg(F.min("column_index").alias("column_index"))
    )
    shares = rows.join(composed, ["doc_id", "plan_id", "source_id", "column_index"]).where(part).select(
        "doc_id", "plan_id", F.lit("composition").alias("intent"), F.col("header").alias("series"), F.lit(1).alias("series_no"),
        F.col("row_index").alias("point"), F.col("row_label").alias("category"), "fact_id", "unit",
    )
    other = rows.where(~F.col("chart_intent").eqNullSafe("composition"))
    lines = table_series(facts)
    unit_columns = other.groupBy(*key, "column_index").agg(F.count(F.lit(1)).alias("_n"))
    trend = other.where(F.coalesce("period", F.lit("")) != "").join(lines, [*key, "row_index"]).join(unit_columns, [*key, "column_index"]).where(
        F.concat_ws("|", *SIGNATURE) == F.col("signature")
    ).select(
        "doc_id", "plan_id", F.lit("trend").alias("intent"), F.col("row_label").alias("series"), F.col("series").alias("series_no"),
        F.col("column_index").alias("point"), F.col("period").alias("category"), "fact_id", "unit",
    )
    rest = other.join(lines.select(*key).distinct(), key, "left_anti")
    usable = rest.where((F.coalesce("row_label", F.lit("")) != "") & (F.col("row_index") < 8))
    expect = named.select(*key, F.size(F.filter(F.slice("rows", 1, 8), lambda r: F.coalesce(F.get(r, F.lit(0)), F.lit("")) != "")).alias("labels"))
    sign = F.concat_ws("|", *SIGNATURE[:5])
    column = (
        usable.groupBy("doc_id", "plan_id", "source_id", "column_index")
        .agg(F.count(F.lit(1)).alias("n"), F.min(sign).alias("a"), F.max(sign).alias("b"), F.min("measure_kind").alias("m"))
        .join(expect, key)
        .where((F.col("n") >= 2) & (F.col("n") == F.col("labels")) & (F.col("a") == F.col("b")) & (F.col("m") != "unknown"))
        .groupBy("doc_id", "plan_id", "source_id").agg(F.min("column_index").alias("column_index"))
    )
    compared = usable.join(column, ["doc_id", "plan_id", "source_id", "column_index"]).select(
        "doc_id", "plan_id", F.coalesce("chart_intent", F.lit("comparison")).alias("intent"), F.col("header").alias("series"),
        F.lit(1).alias("series_no"), F.col("row_index").alias("point"), F.col("row_label").alias("category"), "fact_id", "unit",
    )
    points = shares.unionByName(trend).unionByName(compared)
    mixed = points.groupBy("doc_id", "plan_id").agg(F.min(unless("unit", F.lit(""))).alias("a"), F.max(unless("unit", F.lit(""))).alias("b")).where(
        ~F.col("a").eqNullSafe(F.col("b"))
    )
    return points.join(mixed, ["doc_id", "plan_id"], "left_anti")


def route_proposals(ranked: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first proposal in evidence order wins."""
    rest = [c for c in ranked.columns if c not in keys]
    return ranked.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


# Attributes in checking order with the code of a refusal.
SAME = (
    ("metric_key", "reject.mixed_metric"),
    ("measure_kind", "reject.mixed_measure_kind"),
    ("unit_family", "reject.mixed_unit_family"),
    ("unit_scale", "reject.mixed_unit_scale"),
    ("currency", "reject.mixed_currency"),
    ("unit", "reject.mixed_unit"),
    ("scope", "reject.mixed_scope"),
)


def compatibility(df: DataFrame, keys: Sequence[str], same: Sequence[tuple[str, str]] = SAME, typed: Sequence[str] = ("metric_key", "measure_kind", "unit_family")) -> DataFrame:
    """Whether all facts of a group agree on every attribute: the code of the first that does
    not, or of a missing type. Minimum and maximum decide, so groups of any size are partial
    aggregates."""
    present = [(a, c) for a, c in same if a in df.columns]
    sums = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("facts"),
        *[F.min(F.coalesce(F.col(a).cast("string"), F.lit(""))).alias(f"_a_{a}") for a, _ in present],
        *[F.max(F.coalesce(F.col(a).cast("string"), F.lit(""))).alias(f"_z_{a}") for a, _ in present],
    )
    code = F.lit(None).cast("string")
    for a, c in reversed(present):
        if a in typed:
            code = F.when(F.col(f"_a_{a}") == "unknown", "reject.incomplete_metric_typing").otherwise(code)
        code = F.when(F.col(f"_a_{a}") != F.col(f"_z_{a}"), c).otherwise(code)
    return sums.select(*keys, "facts", code.alias("reject"))


def metric_groups(points: DataFrame, facts: DataFrame) -> DataFrame:
    """Typed group of every proposal, or the code of the first rule it breaks."""
    key = ["doc_id", "plan_id"]
    joined = points.drop("unit").join(facts.drop("source_kind", "start", "end"), ["doc_id", "fact_id"], "left")
    unknown = joined.where(F.col("normalized_value").isNull()).select(*key).distinct().withColumn("_unknown", F.lit(True))
    same = compatibility(joined, key)
    line = joined.where(F.col("intent") == "trend").groupBy(*key, "series_no").agg(
        F.min("entity_id").alias("e1"), F.max("entity_id").alias("e2"),
        F.min(F.concat_ws("|", "scope", "scope_label")).alias("s1"), F.max(F.concat_ws("|", "scope", "scope_label")).alias("s2"),
    ).groupBy(*key).agg(F.bool_or(F.col("e1") != F.col("e2")).alias("_entity"), F.bool_or(F.col("s1") != F.col("s2")).alias("_scope"))
    edge = forecast_boundary(joined.where(F.col("intent") == "trend"), key, "series_no", "point", F.col("scenario"))
    flat = joined.groupBy(*key, "intent").agg(
        F.min("scenario").alias("c1"), F.max("scenario").alias("c2"), F.min("measure_kind").alias("measure_kind"),
        F.count_distinct(unless("period", F.lit(""))).alias("periods"),
        F.sort_array(F.collect_list(F.struct("series_no", "point", "fact_id"))).alias("_f"), F.min("metric_key").alias("metric_key"),
        F.min("unit").alias("unit"), F.min("unit_family").alias("unit_family"), F.min("unit_scale").alias("unit_scale"),
        F.min("currency").alias("currency"), F.min("scope").alias("scope"),
    )
    rows = flat.join(same, key).join(unknown, key, "left").join(line, key, "left").join(edge, key, "left")
    trend = F.col("intent") == "trend"
    code = (
        F.when(F.col("_unknown"), "reject.unknown_fact")
        .when(F.col("reject").isNotNull() & (F.col("reject") != "reject.mixed_scope"), F.col("reject"))
        .when(trend & F.col("_entity"), "reject.mixed_entity")
        .when(trend & F.col("_scope"), "reject.mixed_scope")
        .when(trend & ~F.col("ordered"), "reject.invalid_forecast_boundary")
        .when(~trend & (F.col("c1") != F.col("c2")), "reject.mixed_scenario")
        .when((F.col("intent") == "comparison") & (F.col("periods") > 1), "reject.mixed_period")
        .when((F.col("intent") == "composition") & (F.col("measure_kind") != "share"), "reject.mixed_measure_kind")
        .when(F.col("reject").isNotNull(), F.col("reject"))
    )
    ids = F.transform("_f", lambda x: x["fact_id"])
    digest = canonical_hash([F.col(c) for c in ("plan_id", "intent", "metric_key", "measure_kind", "unit_family", "unit_scale", "currency")] + [F.array_join(ids, ",")], 20)
    return rows.select(
        *key, F.concat(F.lit("metric_group_"), digest).alias("group_id"), "intent", "metric_key", "measure_kind", "unit_family", "unit",
        "unit_scale", "currency", "scope", ids.alias("fact_ids"), F.col("boundary").alias("forecast_start_index"), code.alias("reject"),
    )


def forecast_boundary(df: DataFrame, keys: Sequence[str], series: str, pos: str, scenario: Column) -> DataFrame:
    """First forecast position of each key; ``ordered`` when in every series all actuals come
    before all forecasts and every series starts its forecast at the same position."""
    forecast = scenario.isin("estimate", "guidance", "target")
    per = df.groupBy(*keys, series).agg(
        F.min(F.when(forecast, F.col(pos))).alias("_first"), F.max(F.when(~forecast, F.col(pos))).alias("_last")
    )
    fine = F.col("_first").isNull() | F.col("_last").isNull() | (F.col("_last") < F.col("_first"))
    return per.groupBy(*keys).agg(
        F.min("_first").alias("boundary"),
        (F.bool_and(fine) & F.min(F.coalesce("_first", F.lit(-1))).eqNullSafe(F.max(F.coalesce("_first", F.lit(-1))))).alias("ordered"),
    )


def chart_issues(points: DataFrame, facts: DataFrame, allowed: DataFrame, charts: DataFrame) -> DataFrame:
    """Rules of a verified chart. ``charts``: doc_id, plan_id, chart_type, unit; ``allowed``:
    doc_id, plan_id, kind, id."""
    key = ["doc_id", "plan_id"]
    at = F.concat_ws("/", *key)
    known = points.drop("unit").join(facts.select("doc_id", "fact_id", "source_kind", "source_id", "unit", "normalized_value"), ["doc_id", "fact_id"], "left")
    scoped = known.where(F.col("source_id").isNotNull()).join(
        allowed.select(*key, F.col("kind").alias("source_kind"), F.col("id").alias("source_id")).distinct(), [*key, "source_kind", "source_id"], "left_anti"
    )
    names = points.select(*key, "series_no", "series").distinct()
    sizes = points.groupBy(*key, "series_no").agg(F.count(F.lit(1)).alias("n"))
    shape = sizes.groupBy(*key).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count(F.lit(1)).alias("lines"))
    sums = known.groupBy(*key).agg(
        F.count_distinct(unless("unit", F.lit(""))).alias("units"), F.max(unless("unit", F.lit(""))).alias("fact_unit"),
        F.min("normalized_value").alias("low"), F.sum("normalized_value").alias("total"),
    )
    full = charts.join(shape, key, "left").join(sums, key, "left")
    pie = F.col("chart_type") == "pie"
    return all_issues(
        rule(names, "series_name_empty", at, F.trim(F.coalesce("series", F.lit(""))) == ""),
        repeated(names, [*key, "series"], "series_name_repeated"),
        rule(known, "unknown_fact", F.concat_ws("/", *key, "fact_id"), F.col("source_id").isNull()),
        repeated(points, [*key, "fact_id"], "fact_used_twice"),
        rule(scoped, "fact_outside_evidence", F.concat_ws("/", *key, "fact_id")),
        rule(full, "no_facts", at, F.col("lines").isNull()),
        rule(full, "series_length", at, F.col("least") != F.col("most")),
        rule(full, "conflicting_units", at, F.col("units") > 1),
        rule(full, "unit_differs", at, F.col("unit") != F.coalesce("fact_unit", F.lit(""))),
        rule(full, "line_categories", at, (F.col("chart_type") == "line") & (F.col("most") < 4)),
        rule(full, "bar_categories", at, F.col("chart_type").isin("bar", "column") & ~F.col("most").between(3, 8)),
        rule(full, "pie_series", at, pie & (F.col("lines") != 1)),
        rule(full, "pie_values", at, pie & (~F.col("most").between(3, 6) | (F.col("low") < 0))),
        rule(full, "pie_total", at, pie & ((F.col("unit") != "%") | ~F.col("total").between(95, 105))),
    )


def chart_documents(points: DataFrame, facts: DataFrame) -> DataFrame:
    """Charts as nested rows: categories and series with their values in order."""
    rows = points.drop("unit").join(facts.select("doc_id", "fact_id", "normalized_value"), ["doc_id", "fact_id"])
    lines = rows.groupBy("doc_id", "plan_id", "intent", "series_no", "series").agg(
        F.sort_array(F.collect_list(F.struct("point", "category", "normalized_value"))).alias("p")
    )
    return lines.groupBy("doc_id", "plan_id", "intent").agg(
        F.sort_array(F.collect_list(F.struct("series_no", F.col("series").alias("name"), F.transform("p", lambda x: x["normalized_value"]).alias("values")))).alias("series"),
        F.min_by(F.transform("p", lambda x: x["category"]), "series_no").alias("categories"),
    )


def checked_cells(tables: DataFrame, facts: DataFrame, rows: int | None = None, columns: int | None = None) -> DataFrame:
    """The cells of a table (with ``rows`` and ``columns`` only the first so many), each numeric
    cell with its fact; ``issue`` names a number without a fact or a fact that differs."""
    cells = table_cells(tables)
    for place, most in (("row_index", rows), ("column_index", columns)):
        cells = cells if most is None else cells.where(F.col(place) < most)
    known = facts.where(F.col("source_kind") == "table").select(
        "doc_id", "source_id", "row_index", "column_index", "fact_id", "raw_value", "normalized_value"
    )
    numbers = cells.withColumn("v", F.when(F.col("column_index") > 0, cell_number(F.col("cell"))))
    both = numbers.join(known, ["doc_id", "source_id", "row_index", "column_index"], "left")
    issue = F.when(F.col("v").isNotNull() & F.col("fact_id").isNull(), "numeric cell without fact").when(
        (F.col("v.value") != F.col("normalized_value")) | (F.col("v.raw") != F.col("raw_value")), "fact differs from cell"
    )
    return both.select("doc_id", "source_id", "row_index", "column_index", "cell", "fact_id", F.when(F.col("v").isNotNull(), issue).alias("issue"))


def chart_bindings(proposals: DataFrame) -> DataFrame:
    """Output path of every fact of a chart with nested series."""
    lines = proposals.select("doc_id", "plan_id", F.posexplode("series").alias("i", "s"))
    return lines.select("doc_id", "plan_id", "i", F.posexplode("s.fact_ids").alias("j", "fact_id")).select(
        "doc_id", "plan_id", "fact_id", F.array(F.lit("series"), F.col("i").cast("string"), F.lit("values"), F.col("j").cast("string")).alias("output_path")
    )


def table_bindings(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("fact_id").isNotNull()).select(
        "doc_id", "source_id", "fact_id", F.array(F.lit("rows"), F.col("row_index").cast("string"), F.col("column_index").cast("string")).alias("output_path")
    )


def numeric_audit(outputs: DataFrame, facts: DataFrame, keys: Sequence[str], output: str, value: str) -> DataFrame:
    """Every output value beside its source: matched, mismatch, unknown (no source) or missing
    (no output). Decimals are compared exactly."""
    left = outputs.select(*keys, F.col(output).alias("output_value"), F.lit(True).alias("_o"))
    right = facts.select(*keys, F.col(value).alias("source_value"), F.lit(True).alias("_s"))
    return left.join(right, list(keys), "full_outer").withColumn(
        "status",
        F.when(F.col("_s").isNull(), "unknown").when(F.col("_o").isNull(), "missing")
        .when(F.col("output_value").cast(DECIMAL) == F.col("source_value").cast(DECIMAL), "matched").otherwise("mismatch"),
    ).drop("_o", "_s")


def audit_rollup(audit: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    sums = audit.groupBy(*keys).agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("matched", "mismatch", "unknown", "missing")]
    )
    bad = F.col("mismatch") + F.col("unknown") + F.col("missing")
    return sums.withColumn("audit", F.when(bad == 0, "passed").otherwise("failed"))


def audit_gate(audit: DataFrame, entries: DataFrame, needed: DataFrame) -> DataFrame:
    """Every needed visual has exactly one passed audit and only matched entries. Columns
    slide_id, visualization_id and status."""
    key = ["slide_id", "visualization_id"]
    at = F.concat_ws("/", *key)
    return all_issues(
        repeated(audit, key, "duplicate_audit"),
        missing(needed, audit, [(k, k) for k in key], "missing_audit", at),
        rule(audit, "audit_not_passed", at, F.lower(F.coalesce("status", F.lit(""))) != "passed"),
        rule(entries, "unmatched_value", at, F.lower(F.coalesce("status", F.lit(""))) != "matched"),
    )


def clear_winner(scores: DataFrame, key: str, candidate: str, score: str, least: int = 2, margin: int = 2) -> DataFrame:
    """The single best candidate of each query, if it is strong and ahead of the second; a sole
    candidate needs a score of one. ``scores`` hold at least the two best of each query."""
    two = top_rows(scores, [key], [F.desc(score), F.col(candidate)], 2, "_n")
    best = two.groupBy(key).agg(
        F.max_by(candidate, -F.col("_n")).alias(candidate), F.max(score).alias(score),
        F.max(F.when(F.col("_n") == 2, F.col(score))).alias("second"),
    )
    sole = F.col("second").isNull()
    return best.where(F.when(sole, F.col(score) >= 1).otherwise((F.col(score) >= least) & (F.col(score) - F.col("second") >= margin)))


def chart_long(df: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Several measures to (series, value) rows."""
    return df.select(*ids, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(list(ids), list(values), "series", "value")


def column_types(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """quantitative, temporal or nominal for each text column, ignoring blanks."""
    date = r"^\d{4}-\d{2}-\d{2}(?:[ t]\d{2}:\d{2}(?::\d{2})?)?$"
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column", "cell")
    cell = F.trim("cell")
    given = F.coalesce(cell, F.lit("")) != ""
    numeric = F.regexp_replace(cell, ",", "").rlike(r"^-?\d+(\.\d+)?%?$")
    return long.groupBy("column").agg(
        F.count_if(given).alias("values"), F.count_if(given & numeric).alias("_n"), F.count_if(given & cell.rlike(date)).alias("_d")
    ).select(
        "column", "values",
        F.when(F.col("values") == 0, "nominal").when(F.col("_n") == F.col("values"), "quantitative")
        .when(F.col("_d") == F.col("values"), "temporal").otherwise("nominal").alias("type"),
    )


def split_issues(issues: DataFrame, explicit: DataFrame, safe_codes: Sequence[str]) -> DataFrame:
    """blocking for issues on explicit visuals with a code that is not safe, else warning."""
    marked = issues.join(explicit.select("visualization_id").distinct().withColumn("_e", F.lit(True)), "visualization_id", "left")
    return marked.withColumn(
        "effect", F.when(F.coalesce("_e", F.lit(False)) & ~F.col("code").isin(*safe_codes), "blocking").otherwise("warning")
    ).drop("_e")
