"""Outline and evidence rules as joins and rule tables.

Long form: ``slides`` (doc_id, slide_id, pos, page_role, slide_type, section_ref, title,
key_message, ...), ``refs`` (doc_id, slide_id, ref_no, kind, id), ``visuals`` (doc_id,
slide_id, visual_no, candidate_id, type, display_mode) and ``visual_refs`` (the refs of a
visual). ``closure`` holds (doc_id, section_id, ancestor) pairs, each section included."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.graph import by_size
from quire.functions.rules import all_issues, missing, repeated, rule
from quire.functions.scan import Timeline, each, top_rows
from quire.functions.spans import let
from quire.functions.text import unless
from quire.session import cut, stored

# Patterns of citations, list markers, numbers and lead sentences.
CITE = r"\[\^cite_id:[^\]]+\]"
LIST_MARK = r"^(?:(?:[➢►▶◆◇■□●○•·▪▫\-–—])|(?:\d+|[一二三四五六七八九十]+)[）).、])\s*"
CLAIM_NUMBER = r"(?<![A-Za-z0-9])\d{1,4}(?:[.,]\d+)*(?:%|倍|X|x|亿元|万元|百万元|TOPS|POPS)?"
YEARS = r"((?:19|20)\d{2})[-—至]((?:19|20)\d{2})"
LEAD = r"^(?s)(.+?[。！？：])"
BUDGET, PAIRED, SINGLE = 2, 2, 1
# Rows of a slide up to which its cover is found in one row.
SLIDE_ROWS = 256


def bare(text: Column) -> Column:
    """Text without citations and without any blank, for comparison."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), CITE, ""), r"\s+", "")


def spoken(text: Column) -> Column:
    """Text without citations and a leading list mark, blanks squeezed."""
    said = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), CITE, ""), r"\s+", " "))
    return F.trim(F.regexp_replace(said, LIST_MARK, ""))


def lead_sentence(text: Column, pattern: str = LEAD, least: int = 6, most: int = 120) -> Column:
    """First sentence if it is short enough to be shown; else null."""
    return short_lead(spoken(text), pattern, least, most)


def short_lead(said: Column, pattern: str, least: int = 6, most: int = 120, blank: str = r"\s+") -> Column:
    """First sentence of a text that is taken as it is, all of it if the pattern finds none; null
    if it has too few or too many characters besides blanks."""
    first = F.regexp_extract(said, pattern, 1)
    sentence = F.trim(F.when(first == "", said).otherwise(first))
    size = F.length(F.regexp_replace(sentence, blank, ""))
    return F.when(size.between(least, most), sentence)


def number_keys(text: Column, pattern: str = CLAIM_NUMBER) -> Column:
    """Distinct numbers of a text in a normal form; short year ranges are spelled out."""
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))

    def key(token: Column) -> Column:
        digits = F.regexp_replace(F.regexp_extract(token, r"\d{1,4}(?:[.,]\d+)*", 0), ",", "")
        return F.coalesce(digits.try_cast("decimal(38,10)").cast("string"), digits)

    ranges = F.regexp_extract_all(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", ""), F.lit(YEARS), F.lit(0))

    def years(r: Column) -> Column:
        a, b = F.regexp_extract(r, YEARS, 1).cast("int"), F.regexp_extract(r, YEARS, 2).cast("int")
        listed = F.transform(F.sequence(a, b), lambda y: y.cast("decimal(38,10)").cast("string"))
        return F.when((a <= b) & (b <= a + 20), listed).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(F.transform(raw, key), F.flatten(F.transform(ranges, years))))


def ungrounded(claims: DataFrame, evidence: DataFrame, keys: Sequence[str], claim: str, text: str, pattern: str = CLAIM_NUMBER) -> DataFrame:
    """(keys, number) of every number claimed but absent from the evidence of the same key."""
    said = each(claims, number_keys(F.col(claim), pattern), "number", list(keys)).distinct()
    known = each(evidence, number_keys(F.col(text), pattern), "number", list(keys)).distinct()
    return said.join(known, [*keys, "number"], "left_anti")


def new_numbers(rows: DataFrame, keys: Sequence[str], claimed: str, known: str) -> DataFrame:
    """``ungrounded`` where both sides are ``number_keys`` of one row: (keys, number)."""
    none = F.array().cast("array<string>")
    return each(rows, F.array_except(claimed, F.coalesce(F.col(known), none)), "number", list(keys))


def inside_section(refs: DataFrame, slides: DataFrame, evidence: DataFrame, closure: DataFrame) -> DataFrame:
    """Refs with ``kept``: false when the evidence lies outside the slide's section and its
    descendants. A slide of unknown section, or unknown evidence, keeps its refs."""
    known = closure.select("doc_id", F.col("section_id").alias("section_ref")).distinct().withColumn("_known", F.lit(True))
    placed = evidence.select("doc_id", "kind", "id", F.col("section_id").alias("_at"), F.lit(True).alias("_found"))
    below = closure.select("doc_id", F.col("section_id").alias("_at"), F.col("ancestor").alias("section_ref"), F.lit(True).alias("_below"))
    rows = (
        refs.join(slides.select("doc_id", "slide_id", "section_ref"), ["doc_id", "slide_id"])
        .join(known, ["doc_id", "section_ref"], "left")
        .join(placed, ["doc_id", "kind", "id"], "left")
        .join(below, ["doc_id", "_at", "section_ref"], "left")
    )
    outside = F.col("_known") & F.col("_found") & F.col("_below").isNull()
    return rows.withColumn("kept", ~F.coalesce(outside, F.lit(False))).select(*refs.columns, "kept")


def contained(df: DataFrame, closure: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose (member, ancestor) pair is in the closure."""
    return df.join(closure.select(*on).distinct(), list(on), "left_semi")


def within_budget(df: DataFrame, keys: Sequence[str], order: Sequence[Column], cost: Column, budget: int = BUDGET) -> DataFrame:
    """Items kept in order while costs of one or two fit the budget, skipping those that do not
    fit. With these costs the result has a closed form: the first items as long as they fit, and,
    where one unit is left, the next item of one. Both lie within the first ``budget`` rows of
    their kind, so two group limits decide it, and no key is folded in one task."""
    rows = df.withColumn("_cost", cost)
    so_far = Window.partitionBy(*keys).orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    first = top_rows(rows, keys, order, budget, "_n").withColumn("_used", F.sum("_cost").over(so_far)).where(F.col("_used") <= budget)
    ends = first.groupBy(*keys).agg(F.max("_used").alias("_used"), F.count_if(F.col("_cost") == 1).alias("_ones"))
    ones = top_rows(rows.where(F.col("_cost") == 1), keys, order, budget, "_n").join(ends.where(F.col("_used") == budget - 1), list(keys))
    more = ones.where(F.col("_n") == F.col("_ones") + 1)
    if budget == 1:  # no prefix fits where the first item costs two
        none = top_rows(rows.where(F.col("_cost") == 1), keys, order, 1, "_n").join(ends.select(*keys), list(keys), "left_anti")
        return first.select(*df.columns).unionByName(none.select(*df.columns))
    return first.select(*df.columns).unionByName(more.select(*df.columns))


def visual_cost() -> Column:
    return F.when((F.col("type") == "image") & (F.col("display_mode") == "paired"), PAIRED).otherwise(SINGLE)


def used_figure_refs(refs: DataFrame, slides: DataFrame, visual_refs: DataFrame, kept: DataFrame) -> DataFrame:
    """Refs without figures that no kept image visual uses; figure pages keep theirs."""
    images = kept.where(F.col("type") == "image").select("doc_id", "slide_id", "visual_no")
    used = visual_refs.where(F.col("kind") == "figure").join(images, ["doc_id", "slide_id", "visual_no"], "left_semi")
    pages = slides.where(F.col("slide_type") == "figure_page").select("doc_id", "slide_id")
    figures = refs.where(F.col("kind") == "figure")
    return (
        refs.where(F.col("kind") != "figure")
        .unionByName(figures.join(used.select("doc_id", "slide_id", "id").distinct(), ["doc_id", "slide_id", "id"], "left_semi").select(*refs.columns))
        .unionByName(figures.join(pages, ["doc_id", "slide_id"], "left_semi").select(*refs.columns))
        .distinct()
    )


def greedy_cover(missing_numbers: DataFrame, candidates: DataFrame, rounds: int = 1000, slide_rows: int = SLIDE_ROWS) -> DataFrame:
    """Evidence to add so that missing numbers are covered: the candidate that covers most of what
    is left goes first (ties to the earlier), until none helps. ``missing_numbers``: (slide_id,
    number); ``candidates``: (slide_id, kind, id, pos, number).

    A slide of at most ``slide_rows`` rows (candidate, number) is covered where its rows are
    gathered. Larger slides run in rounds, so none is held in a task."""
    useful = candidates.join(missing_numbers, ["slide_id", "number"], "left_semi").select("slide_id", "kind", "id", "pos", "number").distinct()
    # Most slides are small, so what is large is looked for first, in what is written once.
    useful = stored(useful)
    small, large = by_size(useful, ["slide_id"], slide_rows)
    picked = _cover_gathered(small)
    return picked if large is None else picked.unionByName(_cover_rounds(large, rounds))


def _cover_gathered(useful: DataFrame) -> DataFrame:
    """Slides as rows: their candidates with the numbers each covers, folded until none is left."""
    one = useful.repartition("slide_id").groupBy("slide_id", "pos", "kind", "id").agg(F.collect_list("number").alias("nums"))
    decks = one.groupBy("slide_id").agg(F.collect_list(F.struct("pos", "kind", "id", "nums")).alias("cands"))
    decks = decks.withColumn("wanted", F.array_distinct(F.flatten(F.transform("cands", lambda c: c["nums"]))))

    def best(left: Column) -> Column:
        gain = lambda c: F.size(F.array_intersect(c["nums"], left))
        return F.array_min(F.transform("cands", lambda c: F.struct((-gain(c)).alias("n"), c["pos"].alias("pos"), c["kind"].alias("kind"), c["id"].alias("id"), c["nums"].alias("nums"))))

    def step(acc: Column, _: Column) -> Column:
        # What nothing is left for stays as it is; the numbers left are all in some candidate.
        def take(b: Column) -> Column:
            chosen = F.struct(b["kind"].alias("kind"), b["id"].alias("id"))
            return F.struct(F.array_except(acc["left"], b["nums"]).alias("left"), F.concat(acc["picked"], F.array(chosen)).alias("picked"))

        return F.when(F.size(acc["left"]) == 0, acc).otherwise(let(best(acc["left"]), take))

    kind = F.col("cands")[0]
    none = F.slice(F.array(F.struct(kind["kind"].alias("kind"), kind["id"].alias("id"))), 1, 0)
    turns = F.sequence(F.lit(1), F.least(F.size("wanted"), F.size("cands")))
    picked = F.aggregate(turns, F.struct(F.col("wanted").alias("left"), none.alias("picked")), step, lambda acc: acc["picked"])
    rows = decks.select("slide_id", F.posexplode_outer(picked).alias("n", "c")).where(F.col("c").isNotNull())
    return rows.select("slide_id", "c.kind", "c.id", (F.col("n") + 1).alias("added"))


def _cover_rounds(left: DataFrame, rounds: int) -> DataFrame:
    """Each round is two aggregates over (slide, candidate, number) rows that still count: what every
    candidate covers, and the best candidate of every slide, for all slides at once; the numbers it
    covers then leave."""
    left = cut(left)
    picked = []
    for added in range(1, rounds + 1):
        gain = left.groupBy("slide_id", "pos", "kind", "id").agg(F.count(F.lit(1)).alias("n"))
        best = gain.groupBy("slide_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "pos", "kind", "id")).alias("b")).select("slide_id", "b.pos", "b.kind", "b.id")
        best = cut(best)
        if best.limit(1).count() == 0:
            break
        picked.append(best.select("slide_id", "kind", "id", F.lit(added).alias("added")))
        covered = left.join(best, ["slide_id", "pos", "kind", "id"], "left_semi").select("slide_id", "number")
        left = cut(left.join(covered, ["slide_id", "number"], "left_anti"))
    else:
        raise RuntimeError(f"the cover did not end in {rounds} rounds")
    none = left.limit(0).select("slide_id", "kind", "id", F.lit(0).alias("added"))
    return reduce(DataFrame.unionByName, picked, none)


def owned_labels(slides: DataFrame, sections: DataFrame, figures: DataFrame, refs: DataFrame) -> DataFrame:
    """Section label and figure-page title from the source; ``changed`` counts the repairs."""
    titles = sections.select("doc_id", F.col("section_id").alias("section_ref"), unless(F.trim("title"), F.lit("")).alias("_section"))
    one = refs.where(F.col("kind") == "figure").groupBy("doc_id", "slide_id").agg(F.min("id").alias("figure_id"))
    cap = figures.select("doc_id", "figure_id", unless(F.trim("caption"), F.lit("")).alias("_caption"), F.col("section_id").alias("_figure_section"))
    rows = slides.join(one, ["doc_id", "slide_id"], "left").join(cap, ["doc_id", "figure_id"], "left")
    page = F.col("slide_type") == "figure_page"
    rows = rows.withColumn("section_ref", F.when(page, F.coalesce("_figure_section", "section_ref")).otherwise(F.col("section_ref")))
    rows = rows.join(titles, ["doc_id", "section_ref"], "left")
    section = F.coalesce("_section", F.col("section"), F.lit(""))
    title = F.when(page, F.coalesce("_caption", F.col("title"))).otherwise(F.coalesce("title", F.lit("")))
    changed = (~section.eqNullSafe(F.col("section"))).cast("int") + (~title.eqNullSafe(F.col("title"))).cast("int")
    return rows.withColumns({"changed": changed, "section": section, "title": title}).select(*slides.columns, "changed")


def takeaway(text: Column, most: int = 42) -> Column:
    """Short title from a message: its first sentence, else as many lead clauses as fit, else a
    cut. A very short opening clause is left out when others follow."""
    sentence = F.regexp_replace(F.split_part(F.regexp_replace(spoken(text), "[。！？；;]", "\u0001"), F.lit("\u0001"), F.lit(1)), "^[ ，,]+|[ ，,]+$", "")

    def size(c: Column) -> Column:
        return F.length(F.regexp_replace(c, r"\s+", ""))

    def build(s: Column) -> Column:
        parts = F.filter(F.transform(F.split(s, "[，,]"), lambda x: F.trim(x)), lambda x: x != "")
        kept = F.when((F.size(parts) > 1) & (size(F.get(parts, F.lit(0))) <= 8), F.slice(parts, 2, 1000)).otherwise(parts)
        start = F.struct(F.lit("").alias("out"), F.lit(False).alias("full"))

        def step(acc: Column, x: Column) -> Column:
            joined = F.when(acc["out"] == "", x).otherwise(F.concat_ws("，", acc["out"], x))
            over = (acc["out"] != "") & (size(joined) > most)
            return (
                F.when(acc["full"], acc)
                .when(over, F.struct(acc["out"].alias("out"), F.lit(True).alias("full")))
                .otherwise(F.struct(joined.alias("out"), (size(joined) >= most).alias("full")))
            )

        picked = F.aggregate(kept, start, step, lambda acc: acc["out"])
        cut = F.concat(F.regexp_replace(F.left(s, F.lit(most - 1)), "[ ，,]+$", ""), F.lit("…"))
        return F.when(size(s) <= most, s).when((picked != "") & (size(picked) <= most), picked).otherwise(cut)

    return let(sentence, build)


def first_of_title(df: DataFrame, group: Sequence[str], title: Column, order: Sequence[str], slice: str | None, message: Column) -> DataFrame:
    """First row of a title in its group keeps it; later ones take the lead clause of their
    message, unless that is empty or already a title of the group."""
    rows = df.withColumn("_key", bare(title))
    numbered = Timeline((*group, "_key"), tuple(order), slice).numbered(rows, "_nth")
    proposed = numbered.withColumn("_new", F.when((F.col("_nth") > 1) | (F.col("_key") == ""), takeaway(message)))
    taken = numbered.where(F.col("_nth") == 1).select(*group, F.col("_key").alias("_other")).withColumn("_taken", F.lit(True))
    checked = proposed.withColumn("_other", bare(F.col("_new"))).join(taken, [*group, "_other"], "left")
    # Two replacements may also meet; the first keeps the name.
    again = Timeline((*group, "_other"), tuple(order), slice).numbered(checked, "_same")
    use = F.col("_new").isNotNull() & (F.col("_other") != "") & F.col("_taken").isNull() & (F.col("_same") == 1)
    return again.withColumn("new_title", F.when(use, F.col("_new")).otherwise(title)).withColumn("replaced", use).drop(
        "_key", "_nth", "_new", "_other", "_taken", "_same"
    )


def topic_messages(slides: DataFrame, refs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Key message of content slides from the lead sentence of the first suitable cited block."""
    leads = blocks.where(F.col("type").isin("paragraph", "blockquote")).select("doc_id", "id", lead_sentence(F.col("text_raw")).alias("_lead"))
    first = (
        refs.where(F.col("kind") == "block").join(leads.where(F.col("_lead").isNotNull()), ["doc_id", "id"])
        .groupBy("doc_id", "slide_id").agg(F.min_by("_lead", "ref_no").alias("_lead"))
    )
    content = (F.col("page_role") == "content") & (F.coalesce("slide_type", F.lit("")) != "figure_page")
    rows = slides.join(first, ["doc_id", "slide_id"], "left")
    change = content & F.col("_lead").isNotNull() & (bare(F.col("key_message")) != bare(F.col("_lead")))
    return rows.withColumns({"changed": change, "key_message": F.when(change, F.col("_lead")).otherwise(F.col("key_message"))}).drop("_lead")


def source_order(slides: DataFrame, sections: DataFrame) -> DataFrame:
    """Slides in section order, title first and closing last, with ids renumbered."""
    place = sections.select("doc_id", F.col("section_id").alias("section_ref"), F.col("pos").alias("_at"))
    last = sections.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    rows = slides.join(place, ["doc_id", "section_ref"], "left").join(last, "doc_id", "left")
    n = F.coalesce("_n", F.lit(0))
    rank = F.when(F.col("page_role") == "title", -1).when(F.col("page_role") == "closing", n + 2).otherwise(F.coalesce("_at", n))
    ranked = rows.withColumn("_rank", rank)
    line = Timeline(("doc_id",), ("_rank", "pos"))
    out = line.numbered(ranked, "_new")
    return out.withColumns(
        {"moved": F.col("_new") != F.col("pos") + 1, "pos": F.col("_new") - 1, "slide_id": F.format_string("slide_%03d", "_new")}
    ).drop("_at", "_n", "_rank", "_new")


def out_of_order(df: DataFrame, line: Timeline, value: Column, increasing: bool = False) -> DataFrame:
    """Rows whose value is below the running maximum of the rows before (or not above it, where
    values must increase)."""
    rows = line.running(df, strict=True, _top=("max", value))
    return rows.where((value <= F.col("_top")) if increasing else (value < F.col("_top"))).withColumnRenamed("_top", "running_max")


def assign_figures(figures: DataFrame, hosts: DataFrame, scores: DataFrame, rounds: int = 1000) -> DataFrame:
    """Figures in source order take the best host of their section with room: direct evidence
    first, then shared terms, then the earlier host. ``figures``: doc_id, section_id, figure_id,
    order; ``hosts``: doc_id, section_id, slide_id, host_no, room; ``scores``: doc_id, figure_id,
    slide_id, direct, overlap.

    By deferred acceptance: every figure proposes to its best host that has not refused it, a host
    keeps the earliest figures it has room for and refuses the others, until no one is refused. As
    all hosts rank figures by source order, that is the choice figure by figure. A round is one
    top-k by group limit, for all sections at once."""
    pairs = (
        figures.join(hosts.where("room > 0"), ["doc_id", "section_id"])
        .join(scores, ["doc_id", "figure_id", "slide_id"], "left")
        .na.fill({"direct": 0, "overlap": 0})
    )
    key = ["doc_id", "section_id", "figure_id"]
    liking = Window.partitionBy(*key).orderBy(F.desc("direct"), F.desc("overlap"), "host_no", "slide_id")
    wishes = cut(pairs.select(*key, "order", "slide_id", "room", F.row_number().over(liking).alias("wish")))
    at = wishes.select(*key).distinct().withColumn("wish", F.lit(1))
    seat = Window.partitionBy("doc_id", "section_id", "slide_id").orderBy("order", "figure_id")
    for _ in range(rounds):
        offers = wishes.join(at, [*key, "wish"])
        kept = cut(offers.withColumn("_seat", F.row_number().over(seat)).where(F.col("_seat") <= F.col("room")).select(*key, "order", "slide_id", "room", "wish"))
        # Hosts only ever change to earlier figures, so wishes for full hosts are passed over.
        host = ["doc_id", "section_id", "slide_id"]
        full = kept.groupBy(*host, "room").agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct("order", "figure_id")).alias("_last")).where("_n >= room")
        refused = at.join(kept.select(*key), key, "left_anti").withColumnRenamed("wish", "_past")
        open_ = wishes.join(refused, key).where("wish > _past").join(full.select(*host, "_last"), host, "left")
        open_ = open_.where(F.col("_last").isNull() | (F.struct("order", "figure_id") < F.col("_last")))
        more = cut(open_.groupBy(*key).agg(F.min("wish").alias("wish")))
        if more.limit(1).count() == 0:
            break
        at = kept.select(*key, "wish").unionByName(more)
    else:
        raise RuntimeError(f"the assignment did not settle in {rounds} rounds")
    return figures.select(*key).join(kept.select(*key, "slide_id"), key, "left")


def standalone_pages(unassigned: DataFrame, content_counts: DataFrame, ratio: float = 0.4, per_section: int | None = 3) -> DataFrame:
    """Figure pages that stay: a share of the content pages, one per section first, then up to
    three per section, richest context first."""
    order = [F.desc("nearby"), F.desc(F.length("caption")), F.col("order")]
    ranked = top_rows(unassigned, ["doc_id", "section_id"], order, per_section, "nth")
    phased = ranked.join(content_counts, "doc_id", "left").withColumn(
        "budget", F.when(F.coalesce("content", F.lit(0)) == 0, 1).otherwise(F.floor(F.col("content") * ratio))
    )
    line = Timeline(("doc_id",), ("_phase", "_a", "_b", "order"))
    rows = phased.withColumns({"_phase": F.when(F.col("nth") == 1, 0).otherwise(1), "_a": -F.col("nearby"), "_b": -F.length("caption")})
    return line.numbered(rows, "_n").where(F.col("_n") <= F.col("budget")).select(*unassigned.columns)


def outline_issues(
    slides: DataFrame, refs: DataFrame, visuals: DataFrame, visual_refs: DataFrame, evidence: DataFrame, sections: DataFrame,
    closure: DataFrame, inventory: DataFrame, blocks: DataFrame, allowed: DataFrame | None = None,
) -> DataFrame:
    """Every evidence rule of an outline as one issue table. ``slides`` also has source_refs and
    section; ``inventory`` is the figure inventory; ``evidence`` has section_id and text."""
    key = ["doc_id", "slide_id"]
    at = F.concat_ws("/", *key)
    ref_at = F.concat_ws("/", *key, "kind", "id")
    content = F.col("page_role") == "content"
    page = F.coalesce("slide_type", F.lit("")) == "figure_page"
    titled = slides.join(
        sections.select("doc_id", F.col("section_id").alias("section_ref"), F.col("pos").alias("_sec"), F.trim("title").alias("_title")),
        ["doc_id", "section_ref"], "left",
    )
    line = Timeline(("doc_id",), ("pos",))
    counts = refs.groupBy(*key).agg(F.count(F.lit(1)).alias("refs"), F.count_if(F.col("kind") == "figure").alias("figures"))
    units = visuals.withColumn("_u", visual_cost()).groupBy(*key).agg(F.sum("_u").alias("units"))
    full = titled.join(counts, key, "left").join(units, key, "left").na.fill({"refs": 0, "figures": 0, "units": 0})
    figure = refs.where(F.col("kind") == "figure").join(
        inventory.select("doc_id", F.col("figure_id").alias("id"), "selectable", "caption", F.col("order").alias("_order")), ["doc_id", "id"], "left"
    )
    figure_pages = full.where(page & (F.col("refs") == 1) & (F.col("figures") == 1)).join(
        figure.where("selectable").select(*key, "_order", "caption"), key
    )
    placed = inside_section(refs, slides, evidence, closure)
    vis_placed = inside_section(visual_refs, slides, evidence, closure)
    per_visual = visuals.join(
        visual_refs.join(inventory.select("doc_id", F.col("figure_id").alias("id"), F.col("order").alias("_order")), ["doc_id", "id"], "left")
        .groupBy(*key, "visual_no").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "figure").alias("f"),
            F.transform(F.sort_array(F.collect_list(F.struct("ref_no", F.when(F.col("kind") == "figure", F.coalesce("_order", F.lit(0))).alias("o")))), lambda s: s["o"]).alias("_orders"),
        ),
        [*key, "visual_no"], "left",
    ).na.fill({"n": 0, "f": 0})
    visual_at = F.concat_ws("/", *key, "visual_no")
    expected = F.when(F.col("display_mode") == "paired", 2).otherwise(1)
    image = F.col("type") == "image"
    orders = F.filter("_orders", lambda x: x.isNotNull())
    image_figures = visual_refs.where(F.col("kind") == "figure").join(visuals.where(image).select(*key, "visual_no"), [*key, "visual_no"], "left_semi").select(*key, "id").distinct()
    slide_figures = refs.where(F.col("kind") == "figure").select(*key, "id").distinct()
    plain = slides.where(~page).select(*key)
    first_block = (
        refs.where(F.col("kind") == "block").join(blocks.where(F.col("type").isin("paragraph", "blockquote")).select("doc_id", "id", "text_raw"), ["doc_id", "id"])
        .groupBy(*key).agg(F.min_by(lead_sentence(F.col("text_raw")), "ref_no").alias("_lead"))
    )
    topical = slides.where(content & ~page).join(first_block, key)
    shown = slides.where(content & ~page).withColumn("_said", F.concat_ws(" ", "title", "key_message", F.array_join("bullet_points", " ")))
    cited = refs.join(evidence.select("doc_id", "kind", "id", F.col("text").alias("_text")), ["doc_id", "kind", "id"]).select(*key, "_text")
    heads = titled.where(F.col("_title").isNotNull()).select(*key, F.col("_title").alias("_text"))
    rules = [
        rule(titled, "BUNDLE.UNKNOWN_SECTION", at, F.col("section_ref").isNotNull() & F.col("_sec").isNull()),
        rule(out_of_order(titled.where(F.col("_sec").isNotNull()), line, F.col("_sec")), "BUNDLE.SECTION_ORDER", at),
        rule(titled, "BUNDLE.SECTION_TITLE_MISMATCH", at, (F.trim(F.coalesce("section", F.lit(""))) != "") & (F.col("_title") != "") & (F.trim("section") != F.col("_title"))),
        rule(full, "LAYOUT.VISUAL_BUDGET_EXCEEDED", at, F.col("units") > F.when(content & ~page, BUDGET).otherwise(0)),
        rule(full, "FIGURE.PAGE_REQUIRES_ONE_FIGURE", at, page & ((F.col("refs") != 1) | (F.col("figures") != 1))),
        rule(figure, "FIGURE.ASSET_UNAVAILABLE", ref_at, ~F.coalesce("selectable", F.lit(False))),
        rule(figure_pages, "FIGURE.TITLE_MISMATCH", at, (F.coalesce("caption", F.lit("")) != "") & ~F.trim("title").eqNullSafe(F.trim("caption"))),
        rule(out_of_order(figure_pages, line, F.col("_order"), increasing=True), "FIGURE.ORDER", at),
        rule(full, "FIGURE.CONTENT_BUDGET_EXCEEDED", at, ~page & (F.col("figures") > 2)),
        rule(full, "BUNDLE.CONTENT_WITHOUT_EVIDENCE", at, content & (F.col("refs") == 0)),
        rule(full, "BUNDLE.SLIDE_WITHOUT_SECTION", at, content & F.col("section_ref").isNull()),
        rule(full, "BUNDLE.CONTENT_WITHOUT_SOURCE", at, content & (F.coalesce(F.size("source_refs"), F.lit(0)) <= 0)),
        missing(refs, evidence, [("doc_id", "doc_id"), ("kind", "kind"), ("id", "id")], "BUNDLE.UNKNOWN_EVIDENCE", ref_at),
        rule(placed, "BUNDLE.CROSS_SECTION_EVIDENCE", ref_at, ~F.col("kept")),
        rule(per_visual, "BUNDLE.VISUAL_WITHOUT_NATIVE_EVIDENCE", visual_at, F.col("n") == 0),
        rule(per_visual, "FIGURE.INVALID_IMAGE_CANDIDATE", visual_at, image & (F.col("n") > 0) & ((F.col("n") != expected) | (F.col("f") != expected))),
        rule(per_visual, "FIGURE.IMAGE_ORDER", visual_at, image & (F.array_sort(orders) != orders)),
        rule(per_visual, "FIGURE.WRONG_VISUAL_TYPE", visual_at, ~image & (F.col("f") > 0)),
        rule(image_figures.join(slide_figures, [*key, "id"], "left_anti"), "FIGURE.IMAGE_EVIDENCE_NOT_ON_SLIDE", F.concat_ws("/", *key, "id")),
        rule(slide_figures.join(plain, key, "left_semi").join(image_figures, [*key, "id"], "left_anti").select(*key).distinct(), "FIGURE.CONTENT_IMAGE_COVERAGE", at),
        missing(visual_refs, evidence, [("doc_id", "doc_id"), ("kind", "kind"), ("id", "id")], "BUNDLE.UNKNOWN_VISUAL_EVIDENCE", ref_at),
        rule(vis_placed, "BUNDLE.CROSS_SECTION_VISUAL_EVIDENCE", ref_at, ~F.col("kept")),
        rule(topical, "BUNDLE.TOPIC_SENTENCE_MISMATCH", at, F.col("_lead").isNotNull() & F.col("key_message").isNotNull() & (bare(F.col("key_message")) != bare(F.col("_lead")))),
        rule(ungrounded(shown, cited.unionByName(heads), key, "_said", "_text"), "BUNDLE.UNGROUNDED_NUMBER", F.concat_ws("/", *key, "number")),
    ]
    if allowed is not None:
        known = refs.join(evidence.select("doc_id", "kind", "id"), ["doc_id", "kind", "id"], "left_semi")
        rules.append(missing(known, allowed, [("doc_id", "doc_id"), ("kind", "kind"), ("id", "id")], "BUNDLE.EVIDENCE_NOT_IN_MEMORY", ref_at))
    return all_issues(*rules)


def front_summary_issues(summaries: DataFrame, slides: DataFrame, refs: DataFrame) -> DataFrame:
    """Pre-contents highlights need a summary slide, first after the title, citing each of them.
    ``summaries``: doc_id, section_id, block_id per highlight."""
    wanted = summaries.select("doc_id", "section_id").distinct()
    pages = slides.where((F.col("page_role") == "content") & (F.col("slide_type") == "summary")).join(
        wanted.withColumnRenamed("section_id", "section_ref"), ["doc_id", "section_ref"], "left_semi"
    )
    opening = slides.where(F.col("page_role") != "title").groupBy("doc_id").agg(F.min("pos").alias("_open"))
    first = pages.groupBy("doc_id").agg(F.min("pos").alias("_first")).join(opening, "doc_id")
    used = refs.where(F.col("kind") == "block").join(pages.select("doc_id", "slide_id"), ["doc_id", "slide_id"], "left_semi")
    covered = summaries.join(pages.select("doc_id").distinct(), "doc_id", "left_semi")
    return all_issues(
        rule(wanted.join(pages.select("doc_id").distinct(), "doc_id", "left_anti"), "BUNDLE.FRONT_SUMMARY_MISSING", "doc_id"),
        rule(first, "BUNDLE.FRONT_SUMMARY_ORDER", "doc_id", F.col("_first") != F.col("_open")),
        rule(
            covered.join(used.select("doc_id", F.col("id").alias("block_id")).distinct(), ["doc_id", "block_id"], "left_anti"),
            "BUNDLE.FRONT_SUMMARY_EVIDENCE_MISSING", F.concat_ws("/", "doc_id", "block_id"),
        ),
    )


def duplicates(df: DataFrame, value: Column, id: str) -> DataFrame:
    """Later rows of a repeated value with the first id that has it."""
    keyed = df.select(id, F.sha2(value, 256).alias("_k"))
    first = keyed.groupBy("_k").agg(F.min(id).alias("first_id"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    # One row per repeated value on the right; a large group of copies is split by the
    # adaptive skew join, as the left side needs no grouping afterwards.
    return keyed.join(first, "_k").where(F.col(id) != F.col("first_id")).select(id, "first_id")


def source_issues(sources: DataFrame, slides: DataFrame, source_refs: DataFrame, visuals: DataFrame) -> DataFrame:
    """Repeated ids and references to undeclared sources."""
    return all_issues(
        repeated(sources, ["doc_id", "source_id"], "SOURCE.DUPLICATE_ID"),
        repeated(slides, ["doc_id", "slide_id"], "SLIDE.DUPLICATE_ID"),
        repeated(visuals, ["doc_id", "candidate_id"], "VISUAL_CANDIDATE.DUPLICATE_ID"),
        missing(source_refs, sources, [("doc_id", "doc_id"), ("source_id", "source_id")], "SOURCE.UNKNOWN_REFERENCE", F.concat_ws("/", "doc_id", "slide_id", "source_id")),
    )


def plan_issues(claims: DataFrame, section_refs: DataFrame, evidence: DataFrame, sections: DataFrame) -> DataFrame:
    """A claim plan may only use known sections and evidence."""
    return all_issues(
        missing(section_refs, sections, [("doc_id", "doc_id"), ("section_ref", "section_id")], "unknown_section", F.concat_ws("/", "doc_id", "section_ref")),
        missing(claims, evidence, [("doc_id", "doc_id"), ("kind", "kind"), ("id", "id")], "unavailable_evidence", F.concat_ws("/", "doc_id", "claim_id", "kind", "id")),
    )


def aligned(left: DataFrame, right: DataFrame, keys: Sequence[str], pos: str, columns: Sequence[str]) -> DataFrame:
    """Two lists compared position by position: rows that lack a partner or differ in a column."""
    a = left.select(*keys, pos, *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(True).alias("_a"))
    b = right.select(*keys, pos, *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(True).alias("_b"))
    both = a.join(b, [*keys, pos], "full_outer")
    issue = F.when(F.col("_a").isNull(), "extra").when(F.col("_b").isNull(), "missing")
    for c in columns:
        issue = issue.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), f"{c} differs")
    return both.withColumn("issue", issue).where(F.col("issue").isNotNull()).drop("_a", "_b")


def speaker_issues(slides: DataFrame, scripts: DataFrame, refs: DataFrame, script_refs: DataFrame, allowed: DataFrame) -> DataFrame:
    """A script must follow its outline in id, order and title, cite within it, and end without a
    transition."""
    shape = aligned(
        slides.select("doc_id", "pos", "slide_id", "title"), scripts.select("doc_id", "pos", "slide_id", F.col("slide_title").alias("title")),
        ["doc_id"], "pos", ["slide_id", "title"],
    )
    last = scripts.groupBy("doc_id").agg(F.max_by("transition_to_next", "pos").alias("_t"))
    key = [("doc_id", "doc_id"), ("slide_id", "slide_id"), ("kind", "kind"), ("id", "id")]
    at = F.concat_ws("/", "doc_id", "slide_id", "kind", "id")
    return all_issues(
        rule(shape, "speaker_alignment", F.concat_ws("/", "doc_id", "pos", "issue")),
        missing(script_refs, refs, key, "evidence_outside_slide", at),
        missing(script_refs, allowed, [k for k in key if k[0] != "slide_id"], "evidence_unavailable", at),
        rule(last, "final_transition", "doc_id", F.coalesce("_t", F.lit("")) != ""),
    )


def filled_messages(slides: DataFrame) -> DataFrame:
    """Blank messages take the first bullet that says something, else the title."""
    said = F.filter(F.transform("bullet_points", lambda x: F.trim(x)), lambda x: x != "")
    own = unless(F.trim("key_message"), F.lit(""))
    return slides.withColumn("key_message", F.coalesce(own, F.get(said, F.lit(0)), unless(F.trim("title"), F.lit("")), F.col("key_message")))


def one_terminal(df: DataFrame, keys: Sequence[str], order: Sequence[str], terminal: Column, closing: DataFrame) -> DataFrame:
    """Exactly one terminal row per key, at the end. Earlier terminal rows go, the last one moves
    to the end, and keys without one get the row of ``closing`` (same columns without order)."""
    at = F.struct(*order)
    ends = df.groupBy(*keys).agg(
        F.max_by(F.struct(*df.columns), F.when(terminal, at)).alias("_t"), F.max(order[-1]).alias("_last"), F.count_if(terminal).alias("_n")
    )
    body = df.where(~F.coalesce(terminal, F.lit(False)))
    kept = ends.where(F.col("_n") > 0).select("_t.*", "_last").withColumn(order[-1], F.col("_last")).drop("_last")
    fresh = ends.where(F.col("_n") == 0).select(*keys, (F.col("_last") + 1).alias(order[-1])).join(closing, list(keys))
    return body.unionByName(kept.select(*df.columns)).unionByName(fresh.select(*df.columns))


def repeated_fragments(df: DataFrame, id: str, html: str, least: int = 12) -> DataFrame:
    """Visible text that occurs more than once on a page: (id, fragment, copies). Counted inside
    the row."""
    body = F.regexp_extract(html, r"(?is)<body\b[^>]*>(.*?)</body>", 1)
    shown = F.regexp_replace(body, r"(?is)<(?:script|style)\b[^>]*>.*?</(?:script|style)>", "")
    found = F.transform(F.regexp_extract_all("_shown", F.lit(">([^<>]+)<"), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    # A fragment repeats iff it equals its neighbour in the sorted list.
    sorted_ = F.array_sort(F.filter(found, lambda x: (F.length(x) >= least) & x.rlike(r"[A-Za-z一-鿿]")))
    rows = df.select(id, shown.alias("_shown")).withColumn("_all", sorted_)
    twice = F.array_distinct(F.filter("_all", lambda x, i: (i > 0) & (x == F.get("_all", i - 1))))
    out = each(rows.withColumn("_twice", twice), F.col("_twice"), "fragment", [id, "_all"])
    return out.select(id, "fragment", F.size(F.filter("_all", lambda x: x == F.col("fragment"))).alias("copies"))


def without_repeats(text: Column, sep: str = "\n", least: int = 12) -> Column:
    """Text with later copies of a long enough part removed, order kept."""
    def run(parts: Column) -> Column:
        return F.array_join(
            F.filter(parts, lambda x, i: (F.length(x) < least) | (F.array_position(parts, x) == i + 1)), sep
        )

    return let(F.split(text, sep), run)


def compliance(checks: Sequence[tuple[str, DataFrame, Column]]) -> DataFrame:
    """One row: passed or failed, with every failed check named. Each check is a table and an
    aggregate that must be true."""
    one = None
    for name, df, ok in checks:
        row = df.agg(F.coalesce(ok, F.lit(False)).alias(name)).withColumn("_one", F.lit(1))
        one = row if one is None else one.join(row, "_one")
    failed = F.array_compact(F.array(*[F.when(~F.col(n), n) for n, _, _ in checks]))
    return one.select(failed.alias("failures"), F.when(F.size(failed) == 0, "passed").otherwise("failed").alias("status"))


def merged_lists(a: Column, b: Column) -> Column:
    """Ordered distinct union of two lists without blanks."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.concat(F.coalesce(a, none), F.coalesce(b, none)), lambda x: F.trim(x) != ""))


def distinct_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values of each key in order, joined; duplicates are removed before grouping."""
    rows = df.select(*keys, value).where(F.col(value).isNotNull()).distinct()
    return rows.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(value)), ", ").alias("merged"))
