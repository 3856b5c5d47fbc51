"""Page and HTML analytics. One page is one row, and every measure is an expression over it,
so nothing here shuffles except limits that come from other rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.spans import let
from quire.functions.text import unless

# Weights and thresholds of template quality.
TEMPLATE_WEIGHTS = {
    "text_share": 0.45, "slot_share": 0.35, "base": 0.2, "no_body": 0.25, "bare": 0.2,
    "background_pair": 0.4, "surface_pair": 0.4, "derived_pair": 0.22, "text_surface": 0.15, "visual": 0.2,
    "sound": 0.58, "safe": 0.72,
}
# Colours and fonts that never count as a finding, slide size, contrast floor.
SAFE_COLORS = ("#ffffff", "#fff", "white", "transparent", "inherit", "initial", "currentcolor", "#000000", "#000", "black")
SAFE_FONTS = (
    "arial", "sans-serif", "serif", "monospace", "noto sans cjk sc", "microsoft yahei", "微软雅黑", "simhei", "simsun",
    "kaiti", "fangsong", "helvetica", "times new roman", "courier new",
)
SLIDE_AREA = 1280 * 720
NEAR_COLOR, LEAST_CONTRAST = 30, 3.8
COLOR = r"#[0-9a-fA-F]{3,6}|rgba?\([^)]+\)"


def count_of(text: Column, piece: str) -> Column:
    """Occurrences of a literal in lower-cased text."""
    low = F.lower(text)
    return ((F.length(low) - F.length(F.replace(low, F.lit(piece), F.lit("")))) / len(piece)).cast("bigint")


def styles(html: Column) -> Column:
    """Inline style values and the content of style elements, joined."""
    inline = F.regexp_extract_all(html, F.lit(r"(?i)style\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    sheets = F.regexp_extract_all(html, F.lit(r"(?is)<style[^>]*>(.*?)</style>"), F.lit(1))
    return F.array_join(F.concat(inline, sheets), "\n")


def normal_color(raw: Column) -> Column:
    """Lower-case six-digit hex for short hex and rgb forms; other text as it is."""
    low = F.lower(F.trim(raw))
    short = F.concat(F.lit("#"), *[F.repeat(F.substring(low, i, 1), 2) for i in (2, 3, 4)])
    parts = F.regexp_extract_all(low, F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    hexed = F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex(F.get(parts, F.lit(i)).cast("double").cast("bigint"))), 2, "0") for i in range(3)])
    return F.when(low.rlike("^#[0-9a-f]{3}$"), short).when(low.startswith("rgb"), hexed).otherwise(low)


def channel(color: Column, i: int) -> Column:
    """Channel 0 to 2 of a six-digit hex colour, null otherwise."""
    return F.when(color.rlike("^#[0-9a-f]{6}$"), F.conv(F.substring(color, 2 + 2 * i, 2), 16, 10).cast("int"))


def color_uses(html: Column) -> Column:
    """Colours set by properties, as array of struct(property, color)."""
    pattern = rf"(?i)(background(?:-color)?|(?<!-)color|border(?:-color)?)\s*:\s*({COLOR})"

    def parse(all_: Column) -> Column:
        return F.transform(
            F.regexp_extract_all(all_, F.lit(pattern), F.lit(0)),
            lambda m: F.struct(F.lower(F.regexp_extract(m, pattern, 1)).alias("property"), normal_color(F.regexp_extract(m, pattern, 2)).alias("color")),
        )

    return F.array_distinct(let(styles(html), parse))


def background_kind(html: Column) -> Column:
    """gradient, image, solid or none."""
    def kind(s: Column) -> Column:
        return (
            F.when(s.rlike(r"(?i)linear-gradient|radial-gradient"), "gradient")
            .when(html.rlike(r"(?i)background(?:-image)?\s*:\s*url\("), "image")
            .when(s.rlike(rf"(?i)background(?:-color)?\s*:\s*({COLOR})"), "solid").otherwise("none")
        )

    return let(styles(html), kind)


PURPOSE_WORDS = {
    "ending": "thanks|thank you|q&a|questions|结束|总结|致谢",
    "table_of_contents": "contents|目录|agenda|outline",
    "section_divider": "section|part|研究背景|方法概述",
}
TEXT_TAGS = ("<p", "<h1", "<h2", "<h3", "<h4", "<h5", "<h6", "<span", "<li")


def visible(html: Column) -> Column:
    """Markup without style and script elements."""
    return F.regexp_replace(html, r"(?is)<(style|script)[^>]*>.*?</\1>", "")


def plain(html: Column) -> Column:
    """Text without tags, blanks squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"\s+", " "))


def tag_chars(html: Column, tags: str) -> Column:
    """Characters inside elements of the given names."""
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<({tags})[^>]*>(.*?)</\1>"), F.lit(2))
    sizes = F.transform(found, lambda x: F.length(F.trim(F.regexp_replace(x, r"<[^>]+>", ""))).cast("bigint"))
    return F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, x: a + x)


def fingerprint(pages: DataFrame, id: str, html: str) -> DataFrame:
    """Visual fingerprint of every page."""
    h = F.col(html)
    rows = pages.withColumn("_shown", visible(h)).withColumn("_uses", color_uses(h))
    colors = F.filter(F.transform("_uses", lambda u: u["color"]), lambda c: ~c.isin(*SAFE_COLORS))
    title, body = tag_chars(F.col("_shown"), "h[1-6]"), tag_chars(F.col("_shown"), "p|li|span")
    area = image_area(h)
    return rows.select(
        id,
        F.array_sort(F.array_distinct(colors)).alias("colors"),
        F.coalesce(F.get(F.filter("_uses", lambda u: u["property"].startswith("background")), F.lit(0))["color"], F.lit("")).alias("background_color"),
        background_kind(h).alias("background_type"),
        reduce(lambda a, b: a + b, [count_of(h, t) for t in TEXT_TAGS]).alias("text_elements"),
        count_of(h, "<img").alias("image_elements"),
        count_of(h, "<table").alias("table_elements"),
        (count_of(h, "<svg") + count_of(h, "<canvas")).alias("chart_elements"),
        count_of(h, "<li").alias("bullets"),
        title.alias("title_chars"),
        body.alias("body_chars"),
        area.alias("image_area"),
    ).withColumn("density", F.round((F.col("title_chars") + F.col("body_chars")) / (SLIDE_AREA / 10_000), 6))


def image_area(html: Column) -> Column:
    """Summed area of images that state both sizes."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<img[^>]+>"), F.lit(0))
    sizes = F.transform(
        tags,
        lambda t: F.coalesce(
            F.regexp_extract(t, r"width[:\s=\"]*(\d+)", 1).try_cast("bigint") * F.regexp_extract(t, r"height[:\s=\"]*(\d+)", 1).try_cast("bigint"),
            F.lit(0).cast("bigint"),
        ),
    )
    return F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, x: a + x)


def css_rules(html: Column) -> Column:
    """Rules of all style elements as array of struct(selector, body)."""
    def parse(sheet: Column) -> Column:
        return F.transform(
            F.regexp_extract_all(sheet, F.lit(r"[^{}]+\{[^{}]+\}"), F.lit(0)),
            lambda r: F.struct(
                F.lower(F.trim(F.regexp_extract(r, r"^([^{}]+)\{", 1))).alias("selector"), F.regexp_extract(r, r"\{([^{}]+)\}", 1).alias("body")
            ),
        )

    sheets = F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)<style[^>]*>(.*?)</style>"), F.lit(1)), "\n")
    return let(sheets, parse)


def _font(body: Column) -> Column:
    return F.regexp_replace(F.trim(F.split_part(F.regexp_extract(body, r"(?i)font-family\s*:\s*([^;]+)", 1), F.lit(","), F.lit(1))), "^[\"' ]+|[\"' ]+$", "")


def _size(body: Column) -> Column:
    return F.coalesce(F.regexp_extract(body, r"(?i)font-size\s*:\s*([\d.]+)", 1).try_cast("double"), F.lit(0.0))


def font_roles(pages: DataFrame, id: str, html: str) -> DataFrame:
    """Title and body font by selector, the last rule wins; without a title rule the largest
    font is the title."""
    def fonts(bodies: Column) -> Column:
        return F.filter(F.transform(bodies, lambda b: F.struct(_size(b).alias("size"), _font(b).alias("font"))), lambda f: f["font"] != "")

    inline = F.regexp_extract_all(html, F.lit(r"(?i)style\s*=\s*\"([^\"]*)\""), F.lit(1))
    rows = pages.withColumn("_rules", css_rules(F.col(html))).withColumn("_inline", inline)
    set_ = F.filter("_rules", lambda r: _font(r["body"]) != "")
    title_sel = r"\.title|h1|h2|\.heading"
    titles = F.filter("_set", lambda r: r["selector"].rlike(title_sel))
    bodies = F.filter("_set", lambda r: ~r["selector"].rlike(title_sel) & r["selector"].rlike(r"\.content|\.body|p|\.text"))
    rows = rows.withColumn("_set", set_).withColumns({"_t": F.try_element_at(titles, F.lit(-1)), "_b": F.try_element_at(bodies, F.lit(-1))})
    known = F.filter(fonts(F.concat("_inline", F.transform("_set", lambda r: r["body"]))), lambda f: ~F.lower(f["font"]).isin(*SAFE_FONTS))
    largest = F.filter(F.array(F.array_max(known)), lambda f: f.isNotNull() & (f["size"] > 0))
    best = F.get(largest, F.lit(0))
    return rows.select(
        id,
        F.coalesce(_font(F.col("_t.body")), best["font"], F.lit("")).alias("title_font"),
        F.coalesce(F.when(F.col("_t").isNotNull(), _size(F.col("_t.body"))), best["size"], F.lit(0.0)).alias("title_size"),
        F.coalesce(_font(F.col("_b.body")), F.lit("")).alias("body_font"),
        F.coalesce(F.when(F.col("_b").isNotNull(), _size(F.col("_b.body"))), F.lit(0.0)).alias("body_size"),
    )


def layout_stats(pages: DataFrame, id: str, html: str) -> DataFrame:
    """Characters, images, font sizes in points, elements and flags, with an advice text."""
    pattern = r"font-size\s*:\s*([\d.]+)(pt|px)"
    sizes = F.transform(
        F.regexp_extract_all(html, F.lit(pattern), F.lit(0)),
        lambda m: F.regexp_extract(m, pattern, 1).cast("double") * F.when(F.regexp_extract(m, pattern, 2) == "px", 0.75).otherwise(1.0),
    )
    low = F.lower(html)
    rows = pages.select(
        id, F.length(plain(F.col(html))).cast("bigint").alias("chars"),
        F.size(F.regexp_extract_all(html, F.lit(r"(?i)<img[^>]+>"), F.lit(0))).cast("bigint").alias("images"),
        image_area(F.col(html)).alias("image_area"), sizes.alias("_s"),
        F.regexp_count(html, F.lit(r"<\w+")).cast("bigint").alias("elements"),
        low.contains("<table").alias("has_table"), (low.contains("<pre") | low.contains("<code")).alias("has_code"),
    )
    total = F.aggregate("_s", F.lit(0.0), lambda a, x: a + x)
    some = F.size("_s") > 0
    rows = rows.select(
        id, "chars", "images", "image_area", "elements", "has_table", "has_code",
        F.when(some, F.round(F.array_max("_s"), 1)).otherwise(0.0).alias("font_max"),
        F.when(some, F.round(F.array_min("_s"), 1)).otherwise(0.0).alias("font_min"),
        F.when(some, F.round(total / F.size("_s"), 1)).otherwise(0.0).alias("font_avg"),
    )
    advice = F.concat_ws(
        "; ",
        F.when(F.col("chars") > 600, "less text"), F.when(F.col("images") > 2, "fewer or smaller images"),
        F.when(F.col("font_max") > 24, "smaller largest font"), F.when(F.col("has_table"), "simpler table"), F.when(F.col("has_code"), "smaller code"),
    )
    return rows.withColumn("advice", F.coalesce(unless(advice, F.lit("")), F.lit("check absolute positions")))


def luminance(color: Column) -> Column:
    """Relative luminance of a six-digit hex colour."""
    def linear(c: Column) -> Column:
        v = c / 255.0
        return F.when(v <= 0.03928, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))

    r, g, b = (linear(channel(color, i)) for i in range(3))
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def ratio(x: Column, y: Column) -> Column:
    """Contrast of two luminances; 21 where one is missing."""
    return F.when(x.isNull() | y.isNull(), 21.0).otherwise((F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05))


def contrast(a: Column, b: Column) -> Column:
    """Contrast of two colours; 21 where one is not a colour."""
    return ratio(luminance(a), luminance(b))


def contrast_issues(pages: DataFrame, id: str, html: str, least: float = LEAST_CONTRAST) -> DataFrame:
    """Style values and rules that set a text colour too close to their background."""
    inline = F.transform(
        F.regexp_extract_all(html, F.lit(r"(?i)style\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1)),
        lambda s: F.struct(F.left(s, F.lit(80)).alias("selector"), s.alias("body")),
    )
    rows = pages.select(id, F.explode(F.array_distinct(F.concat(inline, css_rules(F.col(html))))).alias("r"))
    bg = normal_color(F.regexp_extract("r.body", rf"(?i)background(?:-color)?\s*:\s*({COLOR})", 1))
    fg = normal_color(F.regexp_extract("r.body", rf"(?i)(?<!-)color\s*:\s*({COLOR})", 1))
    # One-element arrays are steps: each value is computed once, and the code stays small.
    pairs = rows.select(id, F.col("r.selector").alias("location"), F.inline(F.array(F.struct(bg.alias("background"), fg.alias("color"))))).where(
        (F.col("background") != "") & (F.col("color") != "")
    )
    light = pairs.select("*", F.inline(F.array(F.struct(luminance(F.col("background")).alias("_b"), luminance(F.col("color")).alias("_c")))))
    return light.select(*pairs.columns, F.round(ratio(F.col("_b"), F.col("_c")), 2).alias("contrast")).where(F.col("contrast") < least)


def palette_issues(pages: DataFrame, id: str, html: str, palette: Mapping[str, str]) -> DataFrame:
    """Colours that are neither in the palette nor near one of its colours, with the palette
    colour suggested for the property."""
    allowed = {role: c.lower() for role, c in palette.items() if c}
    rows = pages.select(id, F.explode(color_uses(F.col(html))).alias("u")).select(id, "u.property", "u.color")
    near = F.lit(False)
    for c in allowed.values():
        parts = [F.abs(channel(F.col("color"), i) - int(c[1 + 2 * i : 3 + 2 * i], 16)) for i in range(3)]
        near = near | F.coalesce(parts[0] + parts[1] + parts[2] < NEAR_COLOR, F.lit(False))

    def pick(*roles: str) -> str:
        return next((allowed[r] for r in roles if r in allowed), "")

    suggestion = (
        F.when(F.col("property").startswith("background"), pick("surface", "background", "primary"))
        .when(F.col("property").startswith("border"), pick("border", "accent", "secondary", "primary"))
        .otherwise(pick("primary_text", "text", "inverse_text", "primary"))
    )
    bad = ~F.col("color").isin(*SAFE_COLORS) & ~F.col("color").isin(*allowed.values()) & ~near
    return rows.where(bad).withColumn("suggestion", suggestion)


def font_issues(pages: DataFrame, id: str, html: str, allowed: Sequence[str]) -> DataFrame:
    """Inline fonts that name none of the allowed ones."""
    found = F.regexp_extract_all(html, F.lit(r"(?i)font-family\s*:\s*([^;\"']+)"), F.lit(1))
    rows = pages.select(id, F.explode(F.array_distinct(F.transform(found, lambda x: F.trim(x)))).alias("font"))
    ok = reduce(lambda a, b: a | b, [F.lower("font").contains(a.lower()) for a in allowed], F.lit(False))
    return rows.where(~ok)


def element_issues(pages: DataFrame, id: str, text: Column, image: Column, want_text: Column, want_image: Column, marked: Column) -> DataFrame:
    """Too few elements (under half), or too many (over twice, on marked pages)."""
    def judge(n: Column, want: Column, name: str) -> Column:
        few = (want > 0) & (n < F.greatest(F.lit(1), F.floor(want * 0.5)))
        many = marked & (want > 0) & (n > want * 2)
        return F.when(few, f"few {name}").when(many, f"many {name}")

    issues = F.array_compact(F.array(judge(text, want_text, "text"), judge(image, want_image, "image")))
    return pages.select(id, F.explode(issues).alias("issue"))


def upper_quartile(df: DataFrame, keys: Sequence[str], value: str, name: str = "p75") -> DataFrame:
    """Element at floor(0.75 n) of the sorted values, exact and not interpolated. Equal values
    are counted first, so the window runs over distinct values only."""
    from pyspark.sql import Window

    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(value)
    ranked = counts.withColumns({"_upto": F.sum("_n").over(w), "_all": F.sum("_n").over(Window.partitionBy(*keys))})
    return ranked.where(F.col("_upto") > F.floor(F.col("_all") * 0.75)).groupBy(*keys).agg(F.min(value).alias(name))


def over_limit(df: DataFrame, limits: DataFrame, keys: Sequence[str], value: str, floor: int, factor: float, language: Column | float = 1.0) -> DataFrame:
    """Rows longer than max(p75, floor) × factor × language factor of their group."""
    coefficient = F.lit(language) if isinstance(language, (int, float)) else language
    limit = F.floor(F.greatest(F.col("p75"), F.lit(floor)) * factor * coefficient)
    return df.join(limits, list(keys)).withColumn("limit", limit).where(F.col(value) > F.col("limit"))


def to_text(html: Column) -> Column:
    """Body text of a page: no script, style, head or tags, entities resolved."""
    body = F.regexp_replace(html, r"(?is)<(script|style|head|nav|footer)\b[^>]*>.*?</\1>", " ")
    said = F.regexp_replace(F.regexp_replace(body, r"(?s)<!--.*?-->", " "), r"<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        said = F.replace(said, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(said, r"\s+", " "))


def normal_url(url: Column) -> Column:
    """Canonical form: scheme and host in lower case, query sorted, no fragment."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    path = F.coalesce(unless(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), F.lit("")), F.lit("/"))
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    pairs = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: x != "")), "&")
    return F.concat(scheme, F.lit("://"), host, path, F.when(pairs != "", F.concat(F.lit("?"), pairs)).otherwise(""))


def url_host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(F.trim(url), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^.*@|:\d+$", "")


def host_allowed(host: Column, allowed: Sequence[str]) -> Column:
    """The host is an allowed one or below it."""
    return reduce(lambda a, b: a | b, [(host == a) | host.endswith("." + a) for a in allowed], F.lit(False))


def page_briefs(
    docs: DataFrame, text: str, separator: str = r"\n\s*---+\s*\n", words: Mapping[str, str] = PURPOSE_WORDS, markdown: bool = True
) -> DataFrame:
    """Pages of a manuscript with title, counts, purpose and content shape. Without ``markdown``
    marks at the start of a line are text: the first line is the title, the whole page the body."""
    parts = F.filter(F.transform(F.split(text, separator), lambda x: F.trim(x)), lambda x: x != "")
    rows = docs.select("doc_id", parts.alias("_p")).select("doc_id", F.size("_p").alias("pages"), F.posexplode("_p").alias("i", "segment"))
    lines = F.transform(F.split("segment", "\r?\n"), lambda x: F.trim(x))
    if markdown:
        heading = F.filter(lines, lambda x: x.startswith("#") | ((x != "") & ~x.rlike(r"^[-*+]|^\d+[.)]\s")))
        title = F.coalesce(F.regexp_replace(F.get(heading, F.lit(0)), r"^#+\s*", ""), F.concat(F.lit("Slide "), (F.col("i") + 1).cast("string")))
        body = F.trim(F.array_join(F.filter(F.split("segment", "\r?\n"), lambda x: ~F.trim(x).startswith("#")), "\n"))
    else:
        title, body = F.get(F.filter(lines, lambda x: x != ""), F.lit(0)), F.col("segment")
    rows = rows.select("doc_id", "pages", (F.col("i") + 1).alias("page"), title.alias("title"), body.alias("body"), "segment")
    rows = rows.withColumns(
        {
            "images": F.regexp_count("segment", F.lit(r"(?i)!\[[^\]]*\]\([^)]+\)|<img\b")),
            "tables": F.regexp_count("segment", F.lit(r"(?m)^\|.*\|\s*$")),
            "formulae": F.regexp_count("segment", F.lit(r"(?i)\$[^\$]{2,160}\$|\\\(|\\\)|softmax|QK\^?T|√d")),
            "bullets": F.size(F.filter(F.split("body", "\r?\n"), lambda x: F.trim(x).rlike(r"^[-*+]|^\d+[.)]\s"))),
        }
    )
    low, said = F.lower("title"), F.lower(F.concat_ws("\n", "title", "body"))
    purpose = (
        F.when(F.col("page") == 1, "opening")
        .when((F.col("page") == F.col("pages")) & said.rlike(words["ending"]), "ending")
        .when(low.rlike(words["table_of_contents"]), "table_of_contents")
        .when(low.rlike(words["section_divider"]) & (F.length(F.trim("body")) < 80), "section_divider")
        .otherwise("content")
    )
    shape = (
        F.when(F.col("purpose") != "content", F.col("purpose")).when(F.col("tables") > 0, "table_focus")
        .when((F.col("images") > 0) & (F.col("bullets") >= 2), "title_body_figure").when(F.col("images") > 0, "figure_focus")
        .when(F.col("formulae") > 0, "title_body_formula").when(F.col("bullets") >= 5, "two_column").otherwise("title_body")
    )
    return rows.withColumn("purpose", purpose).withColumn("shape", shape).drop("segment", "pages")


def slide_params(pages: DataFrame, id: str, html: str) -> DataFrame:
    """Numeric parameters of a page in long form (parameter, value, confidence)."""
    h = F.col(html)
    uses = F.filter(color_uses(h), lambda u: u["color"].rlike("^#[0-9a-f]{6}$"))
    rows = layout_stats(pages.select(id, html), id, html).join(
        pages.select(id, uses.alias("_u"), F.length(to_text(h)).alias("text_count"), F.size(F.regexp_extract_all(h, F.lit(r"(?i)font-size"), F.lit(0))).alias("_f")), id
    )
    bg = F.get(F.filter("_u", lambda u: u["property"].startswith("background")), F.lit(0))["color"]
    brightness = (0.2126 * channel(bg, 0) + 0.7152 * channel(bg, 1) + 0.0722 * channel(bg, 2)) / 255.0
    hues = F.filter(F.transform(F.filter("_u", lambda u: ~u["property"].startswith("border")), lambda u: F.floor(hue(u["color"]) / 30) * 30), lambda x: x.isNotNull())
    counted = F.transform(F.array_distinct(hues), lambda x, i: F.struct(F.size(F.filter(hues, lambda y: y == x)).alias("n"), (-i).alias("i"), x.alias("x")))
    values = {
        "background_brightness": (F.round(brightness, 4), "high"),
        "avg_font_size": (F.when(F.col("_f") > 0, F.round(F.col("font_avg") / 0.75, 1)), "high"),
        "title_font_size": (F.when(F.col("_f") > 0, F.round(F.col("font_max") / 0.75, 1)), "high"),
        "text_count": (F.col("text_count"), "high"),
        "image_count": (F.col("images"), "high"),
        "content_density": (F.round(F.col("text_count") / SLIDE_AREA, 6), "medium"),
        "dominant_color_hue": (F.array_max(counted)["x"], "medium"),
        "text_image_ratio": (F.round(F.col("text_count") / F.greatest(F.col("images"), F.lit(1)), 1), "medium"),
    }
    items = F.array(*[F.struct(F.lit(n).alias("parameter"), v.cast("double").alias("value"), F.lit(c).alias("confidence")) for n, (v, c) in values.items()])
    return rows.select(id, F.inline(items)).where(F.col("value").isNotNull())


def hue(color: Column) -> Column:
    """Hue of a six-digit hex colour in degrees."""
    r, g, b = (channel(color, i) / 255.0 for i in range(3))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    h = F.when(top == r, (g - b) / span).when(top == g, 2.0 + (b - r) / span).otherwise(4.0 + (r - g) / span)
    return F.when(top.isNull(), None).when(span == 0, 0.0).otherwise(F.pmod(F.round(h * 60), F.lit(360.0)))


def template_quality(profiles: DataFrame) -> DataFrame:
    """Structure and visual scores of a template with mode and issues. Columns: template_id,
    layouts (array of struct(name, functional, texts, images)), body_size, and the colours
    background, text, surface, primary_text, inverse_text."""
    content = F.filter("layouts", lambda l: ~l["functional"])

    def count(items: Column) -> Column:
        return F.size(items)

    def total(name: str) -> Column:
        return F.aggregate("layouts", F.lit(0).cast("bigint"), lambda a, l: a + l[name])

    rows = profiles.withColumns(
        {
            "_n": F.size("layouts"), "_content": count(content), "_content_text": count(F.filter(content, lambda l: l["texts"] > 0)),
            "_texts": total("texts"), "_images": total("images"), "_bare": count(F.filter("layouts", lambda l: l["texts"] == 0)),
            "_visual": count(F.filter("layouts", lambda l: l["images"] > 0)), "_bg": luminance(normal_color(F.col("background"))), "_sf": luminance(normal_color(F.col("surface"))),
            **{f"_{c}": F.coalesce(c, F.lit("")) != "" for c in ("background", "text", "surface", "primary_text", "inverse_text")},
        }
    )
    mostly_bare = F.col("_bare") >= F.greatest(F.lit(1), F.col("_n") - 1)
    no_body = F.coalesce("body_size", F.lit(0)) <= 0
    no_text = (F.col("_content") > 0) & (F.col("_content_text") == 0)
    ratio = F.col("_content_text") / F.greatest(F.col("_content"), F.lit(1))
    slots = F.col("_texts") / F.greatest(F.col("_texts") + F.col("_images"), F.lit(1))
    w = TEMPLATE_WEIGHTS
    raw = w["text_share"] * ratio + w["slot_share"] * F.least(F.lit(1.0), slots * 2) + w["base"]
    raw = raw - F.when(no_body, w["no_body"]).otherwise(0.0) - F.when(mostly_bare, w["bare"]).otherwise(0.0)
    structure = F.when(F.col("_n") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
    same_hue = F.abs(hue(normal_color(F.col("background"))) - hue(normal_color(F.col("surface")))) <= 30
    derived = F.coalesce(F.col("_background") & F.col("_surface") & (F.col("_sf") - F.col("_bg") >= 0.35) & same_hue, F.lit(False))
    visual = F.least(
        F.lit(1.0),
        F.when(F.col("_background") & F.col("_inverse_text"), w["background_pair"]).otherwise(0.0)
        + F.when(F.col("_surface") & F.col("_primary_text"), F.when(derived, w["derived_pair"]).otherwise(w["surface_pair"]))
        .when(F.col("_text") & F.col("_surface"), w["text_surface"]).otherwise(0.0)
        + F.when(F.col("_visual") > 0, w["visual"]).otherwise(0.0),
    )
    found = {
        "layouts.none": F.col("_n") == 0,
        "content.textless": no_text,
        "body.unsized": no_body,
        "layouts.bare": mostly_bare,
        "background.alone": F.col("_background") & ~F.col("_text"),
        "background.no_inverse": F.col("_background") & ~F.col("_inverse_text"),
        "surface.no_primary": F.col("_surface") & ~F.col("_primary_text"),
        "visual.none": (F.col("_visual") == 0) & (F.col("_images") == 0),
        "surface.derived": derived,
    }
    issues = F.array_compact(F.array(*[F.when(holds, code) for code, holds in found.items()]))
    rows = rows.withColumns({"_structure": structure, "_score": visual, "_derived": derived, "issues": issues})
    sound = (F.col("_structure") >= w["sound"]) & ~no_text & ~no_body & ~mostly_bare
    safe = (F.col("_score") >= w["safe"]) & ~F.col("_derived")
    mode = F.when(sound & safe, "strict_structural").when(sound, "adaptive_structural").otherwise("style_reference")
    return rows.select(
        "template_id", F.round("_structure", 3).alias("structure_score"), F.round("_score", 3).alias("visual_score"), mode.alias("mode"), "issues"
    )
