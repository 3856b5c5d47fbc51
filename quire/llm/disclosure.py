"""Personal data: emails, addresses, cards and phones by form, and the terms that disclose them by
their co-occurrence over whole documents of the whole corpus. DataFrame functions only.

An entity is a value or what values of its kind share: a mail domain, a network, the issuer of a
card, the area of a phone. A term discloses an entity in a document if the other documents say so:
of the n(t) - 1 others with the term, n(t,e) - 1 hold the entity, and the lower bound of that share
(one standard error, by Wilson's formula) stands against the entity's share p of all documents. The
bound gives a part of the entity's information content: log2(bound / p) / log2(1 / p). Terms at
``GENERAL`` of it are generalised to their class, terms at ``REMOVE`` removed. So a term met with an
entity in one document only, which cannot be told from chance, discloses nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import cut, release, small

KINDS = ("email", "ip", "card", "phone", "general", "remove")
BASE = 4
# The stated forms without backtracking: a form that begins with a run of characters can only
# start where the run does (or where the last match ended), and runs are taken whole. The card
# form holds its 16 to 19 digits, as a match is always a whole chain of digits.
LOCAL = r"A-Za-z0-9._%+-"
FORMS = (
    rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
# What a text must hold for a form to be tried.
SIGNS = ("@", ".", "", "+")
TERM = r"[^\p{L}\p{N}]"
LEAST_TERM = 3  # characters of a term
GENERAL, REMOVE = 0.75, 0.85
ERRORS = 1.0  # standard errors of the lower bound
POOL = 4  # added to the kind of an entity that values share


def matches(docs: DataFrame) -> DataFrame:
    """(doc_id, key, found, t) per row; ``key`` names the document: its id and the hash of its
    text. ``found`` holds the matches of a form with the length of the gap before each, ``t`` the
    text where a form matches, else null."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.select("doc_id", document_key(), text.alias("t"))
    for kind, (form, sign) in enumerate(zip(FORMS, SIGNS)):
        has = F.contains("t", F.lit(sign)) if sign else F.rlike("t", F.lit(r"[0-9][\x20-]?[0-9]"))
        out = out.withColumn(f"m{kind}", F.when(has, F.regexp_extract_all("t", F.lit(form), F.lit(0))))
        out = out.withColumn(f"p{kind}", F.when(F.size(f"m{kind}") > 0, F.split("t", form, -1)))
    placed = [F.expr(f"transform(m{k}, (m, i) -> struct({k} as kind, i as nth, length(p{k}[i]) as gap, m as hit))") for k in range(BASE)]
    arrays = [F.when(F.size(f"m{k}") > 0, placed[k]) for k in range(BASE)]
    found = F.flatten(F.array_compact(F.array(*arrays)))
    return out.select("doc_id", "key", found.alias("found"), "t").withColumn("t", F.when(F.size("found") > 0, F.col("t")))


def may_match() -> Column:
    """Texts with a match of some form. The others have no span of any kind, as terms are only
    hidden in documents that hold the entity they disclose."""
    tries = []
    for form, sign in zip(FORMS, SIGNS):
        hit = F.rlike("text", F.lit(form))
        tries.append(F.contains("text", F.lit(sign)) & hit if sign else hit)
    return F.coalesce(reduce(lambda a, b: a | b, tries), F.lit(False))


def document_key() -> Column:
    return F.concat_ws(":", F.col("doc_id").cast("string"), F.hex(F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))).alias("key")


def _luhn(digits: Column) -> Column:
    """Double every second digit from the right; the digit sum is a multiple of ten."""
    steps = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + (d.cast("int") * 2 / 10).cast("int")),
    )
    return F.aggregate(steps, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def base_spans(found: DataFrame) -> DataFrame:
    """(key, kind, start, stop, value): the matches that hold, one document each.
    Places follow from the lengths before them, over the matches of one text."""
    rows = found.select("key", F.explode("found").alias("f")).select("key", "f.*")
    so_far = Window.partitionBy("key", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.length("hit")).over(so_far)
    placed = rows.select("*", stop.cast("long").alias("stop"), (stop - F.length("hit")).cast("long").alias("start"))
    digits = F.regexp_replace("hit", "[^0-9]", "")
    parts = F.transform(F.split("hit", r"\."), lambda x: F.regexp_replace(x, "^0+(?=[0-9])", ""))
    byte = F.forall(parts, lambda x: (F.length(x) < 3) | ((F.length(x) == 3) & (x <= "255")))
    holds = (
        F.when(F.col("kind") == 0, F.lit(True))
        .when(F.col("kind") == 1, byte)
        .when(F.col("kind") == 2, F.length(digits).between(16, 19) & _luhn(digits))
        .otherwise(F.length(digits).between(8, 15))
    )
    value = F.when(F.col("kind") <= 1, F.lower("hit")).otherwise(digits)
    return placed.where(holds).select("key", "kind", "start", "stop", value.alias("value"))


def entities_of(base: DataFrame) -> DataFrame:
    """(key, kind, entity): each value, and under ``kind + POOL`` what it shares with others: the
    domain of an email, the first two parts of an address, the first six digits of a card and the
    first four of a phone. Entities are 64-bit hashes of their text."""
    shared = (
        F.when(F.col("kind") == 0, F.substring_index("value", "@", -1)).when(F.col("kind") == 1, F.substring_index("value", ".", 2))
        .when(F.col("kind") == 2, F.left("value", F.lit(6))).otherwise(F.left("value", F.lit(4)))
    )
    each = F.explode(F.array(F.struct("kind", F.col("value").alias("v")), F.struct((F.col("kind") + POOL).alias("kind"), shared.alias("v"))))
    return base.select("key", each.alias("e")).select("key", "e.kind", F.xxhash64("e.kind", "e.v").alias("entity")).distinct()


def _disclosed(share: float, n_t: Column, n_te: Column) -> Column:
    """Whether the lower bound of P(entity | term) over the other documents gives the share of the
    entity's information. The bound falls with n_t and rises with n_te."""
    m, x, z = n_t - 1, n_te - 1, ERRORS
    rate = x / m
    bound = (rate + z * z / (2 * m) - z * F.sqrt(rate * (1 - rate) / m + z * z / (4 * m * m))) / (1 + z * z / m)
    p = (F.col("n_e") - 1) / (F.col("n") - 1)
    return F.coalesce((x > 0) & (p > 0) & (p < 1) & (F.log2(bound) >= (1 - share) * F.log2(p) - 1e-9), F.lit(False))


def _words(text: str) -> Column:
    """The distinct terms of a whole text."""
    return F.filter(F.array_distinct(F.split(F.lower(text), TERM + "+")), lambda w: F.length(w) >= LEAST_TERM)


def disclosing(docs: DataFrame, entities: DataFrame, held: DataFrame, general: float, remove: float) -> DataFrame:
    """(entity, term, verdict): the pairs over the threshold. Counts are of documents, over the
    whole corpus. ``entities`` (key, entity, n_e) are those of two documents or more, ``held``
    (key, t) the documents that hold them. Terms are 64-bit hashes here, so that a broadcast of
    ``small`` has a bound in bytes."""
    total = F.broadcast(docs.agg(F.count("*").alias("n")))  # one row
    # The documents that hold a term and some entity are at most all with the term, and those
    # with one entity at most n_e: a pair under the threshold with these numbers is under it for
    # good, before it is counted. Frequent words end here.
    held_terms = held.select("key", F.explode(F.transform(_words("t"), lambda w: F.xxhash64(w))).alias("term"))
    n_held = small(cut(held_terms.groupBy("term").agg(F.count("*").alias("n_held")).where("n_held > 1"), "held_terms"))
    both = held_terms.join(n_held, "term").join(entities, "key").crossJoin(total)
    both = both.where(_disclosed(general, F.col("n_held"), F.least("n_held", "n_e")))
    pair = both.groupBy("entity", "term", "n_e", "n_held", "n").agg(F.count("*").alias("n_te"))
    pair = cut(pair.where(_disclosed(general, F.col("n_held"), F.col("n_te"))), "pairs")
    wanted = small(cut(pair.select("term").distinct(), "terms"))
    words = F.array_distinct(F.split(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), TERM + "+"))
    n_t = docs.select(F.explode(F.transform(words, lambda w: F.xxhash64(w))).alias("term")).join(wanted, "term").groupBy("term").agg(F.count("*").alias("n_t"))
    reached = lambda share: _disclosed(share, F.col("n_t"), F.col("n_te"))
    verdict = F.when(reached(remove), F.lit(5)).when(reached(general), F.lit(4))
    return pair.join(n_t, "term").select("entity", "term", verdict.alias("verdict")).where("verdict is not null")


def term_spans(base: DataFrame, entities: DataFrame, held: DataFrame, told: DataFrame) -> DataFrame:
    """(key, kind, start, stop): every place of a disclosing term in every document that holds
    its entity, but for those inside a base span. A window is over the words of one text."""
    told = cut(told, "told")
    pairs = held.select("key", F.explode(F.transform(_words("t"), lambda w: F.xxhash64(w))).alias("term")).join(told.select("term").distinct(), "term", "left_semi")
    marks = cut(pairs.join(entities, "key").join(told, ["entity", "term"]).groupBy("key", "term").agg(F.max("verdict").alias("kind")), "marks")
    texts = held.join(marks.select("key").distinct(), "key", "left_semi")
    so_far = Window.partitionBy("key").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    words = texts.select("key", F.posexplode(F.split("t", TERM, -1)).alias("i", "w"))
    # A separator is one character, so places follow from the lengths.
    stop = (F.sum(F.length("w") + 1).over(so_far) - 1).cast("long")
    placed = words.withColumn("stop", stop).where(F.length("w") >= LEAST_TERM)
    placed = placed.select("key", F.xxhash64(F.lower("w")).alias("term"), (F.col("stop") - F.length("w")).alias("start"), "stop")
    spans = placed.join(marks, ["key", "term"]).select("key", "kind", "start", "stop")
    own = base.select(F.col("key").alias("k"), F.col("start").alias("a"), F.col("stop").alias("z"))
    inside = (F.col("key") == F.col("k")) & (F.col("a") <= F.col("start")) & (F.col("z") >= F.col("stop"))
    return spans.join(own, inside, "left_anti")


def all_spans(docs: DataFrame, general: float = GENERAL, remove: float = REMOVE) -> tuple[DataFrame, DataFrame]:
    """``found`` (doc_id, key), one row per row of ``docs``, and ``spans`` (key, kind, start, stop)."""
    found = cut(matches(docs).withColumn("rid", F.monotonically_increasing_id()), "matches")
    # One row stands for a document; its number is the key of all pairs, as it is short.
    named = cut(found.where(F.size("found") > 0).dropDuplicates(["key"]), "named")
    numbered = named.select(F.col("rid").alias("key"), "found", "t")
    base = cut(base_spans(numbered), "base")
    once = entities_of(base).select("key", "entity")
    n_e = once.groupBy("entity").agg(F.count("*").alias("n_e")).where("n_e > 1")
    entities = cut(once.join(n_e, "entity"), "entities")
    holders = small(cut(entities.select("key").distinct(), "holders"))
    held = numbered.join(holders, "key", "left_semi").select("key", "t")
    more = term_spans(base, entities, held, disclosing(docs, entities, held, general, remove))
    spans = base.select("key", "kind", "start", "stop").union(more).withColumnRenamed("key", "rid")
    return found.select("doc_id", "key"), spans.join(named.select("rid", "key"), "rid").select("key", "kind", "start", "stop")


def personal_data(docs: DataFrame, **options) -> DataFrame:
    """Counts and spans of personal data, one row per row of ``docs``. Places count code points,
    the end is exclusive.

    Null text is empty, an empty table gives no row, very long texts are taken whole. Rows with
    equal doc_id and text are one document and get equal spans; other columns, whatever their
    names, are not read. A term at both thresholds counts as removed."""
    found, spans = all_spans(docs, **options)
    names = F.array(*[F.lit(k) for k in KINDS])
    listed = F.sort_array(F.collect_list(F.struct("kind", "start", "stop")))
    per = spans.groupBy("key").agg(listed.alias("s"))
    rows = found.join(per, "key", "left").withColumn("s", F.coalesce("s", F.expr("array()").cast("array<struct<kind:int,start:bigint,stop:bigint>>")))
    show = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["stop"])), ",")
    count = lambda k: F.size(F.filter("s", lambda x: x["kind"] == k)).cast("long")
    return rows.select(
        "doc_id",
        *[count(k).alias(f"n_{KINDS[k]}") for k in range(BASE)],
        F.sha2(show(F.filter("s", lambda x: x["kind"] < BASE)), 256).alias("base_sha256"),
        show(F.col("s")).alias("spans"),
    )


def sanitised(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with its text rewritten: base spans become the name of their kind in brackets,
    generalised terms their class (a number, a code of letters and figures, a name, a word),
    removed terms go. Overlapping spans become one, named by the kind
    that comes first in ``KINDS``. n_chars, where present, follows the new text."""
    _, spans = all_spans(docs, **options)
    order = Window.partitionBy("key").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)
    regions = spans.withColumn("new", new).withColumn("region", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    regions = regions.groupBy("key", "region").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("kind").alias("kind"))
    per = cut(regions.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "kind"))).alias("regions")), "regions")
    release(docs.sparkSession)
    marks = "array(" + ", ".join("''" if k == "remove" else f"'[{k.upper()}]'" for k in KINDS) + ")"
    term = "substring(text, cast(r.start + 1 as int), cast(r.stop - r.start as int))"
    class_of = (
        f"case when rlike({term}, '^[0-9]+$') then '[NUMBER]' when rlike({term}, '[0-9]') then '[CODE]' "
        f"when left({term}, 1) <> lower(left({term}, 1)) then '[NAME]' else '[WORD]' end"
    )
    rebuilt = F.expr(
        "concat(array_join(transform(__regions, (r, i) -> concat(substring(text, cast(if(i = 0, 0, __regions[i - 1].stop) + 1 as int), "
        f"cast(r.start - if(i = 0, 0, __regions[i - 1].stop) as int)), if(r.kind = 4, {class_of}, {marks}[r.kind]))), ''), "
        "substring(text, cast(element_at(__regions, -1).stop + 1 as int)))"
    )
    # Only texts with a match meet the spans; the others never move.
    found = docs.where(may_match()).withColumn("__key", document_key())
    joined = found.join(per.select(F.col("key").alias("__key"), F.col("regions").alias("__regions")), "__key", "left")
    text = F.when(F.col("__regions").isNull(), F.col("text")).otherwise(rebuilt)
    done = joined.withColumn("text", text).select(*docs.columns).union(docs.where(~may_match()).select(*docs.columns))
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done
