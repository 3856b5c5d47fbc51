"""Memory tables: duplicates, clusters, merging, retention, history and versions."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.graph import BLOCK_ROWS, by_size, components, each_key, least_below, links
from quire.functions.scan import GHOST, SLICE, Timeline, best_row, top_rows
from quire.functions.text import any_of, blank_to_null, clip, jaccard, squeeze, unless
from quire.session import cut

DAY = 86_400_000_000

# Terms that mark advice against or for something.
NEGATIVE_TERMS = ("不要", "不能", "避免", "失败", "不支持", "unsupported", "avoid", "never", "failed")
POSITIVE_TERMS = ("可以", "推荐", "应该", "优先", "使用", "should", "use", "prefer", "must")
# Cue words for keyword tags, in order.
TAG_CUES = (
    "overflow", "layout", "spacing", "font", "color", "image", "text", "title", "card", "grid", "flex",
    "margin", "padding", "error", "failed", "limit", "constraint", "avoid", "must",
    "溢出", "布局", "间距", "字体", "颜色", "图片", "文本", "标题",
)
# Thresholds.
SIMILAR, CLUSTER_SIZE = 0.8, 5
CLUSTER_SIM, MERGE_SIM, RELATED_SIM = 0.58, 0.72, 0.38
PART_WEIGHTS = (0.45, 0.35, 0.20)


# --- duplicates ------------------------------------------------------------------------


def exact_duplicates(
    df: DataFrame, id: str, text: str, reuse: str, created: str, drop_blank: bool = False
) -> DataFrame:
    """One row per distinct trimmed text: the kept id (most reused, then newest), the summed
    reuse and the number of copies. Blank texts stay apart unless ``drop_blank``."""
    trimmed = F.trim(F.coalesce(text, F.lit("")))
    apart = F.when(trimmed == "", F.concat(F.lit("id:"), F.col(id).cast("string")))
    rows = df.where(trimmed != "") if drop_blank else df
    key = F.coalesce(apart, F.sha2(trimmed, 256))
    return (
        rows.groupBy(key.alias("key"))
        .agg(
            F.max_by(id, F.struct(F.col(reuse), F.col(created), F.col(id))).alias("keep_id"),
            F.sum(reuse).cast("bigint").alias("reuse"),
            F.count(F.lit(1)).alias("copies"),
        )
        .drop("key")
    )


def removed_duplicates(df: DataFrame, kept: DataFrame, id: str) -> DataFrame:
    """Rows that lost. The anti join is on the unique id, so a large group of copies spreads."""
    return df.join(kept.select(F.col("keep_id").alias(id)), id, "left_anti")


def keep_best(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str]) -> DataFrame:
    """Best row per key by a total order, as a partial aggregate."""
    named = df
    names = []
    for i, k in enumerate(keys):
        name = f"_key{i}"
        named = named.withColumn(name, F.col(k) if isinstance(k, str) else k)
        names.append(name)
    return best_row(named, names, F.struct(*order)).drop(*names)


def new_rows(delta: DataFrame, existing: DataFrame, id: str) -> DataFrame:
    """Rows whose id is not stored yet."""
    return delta.join(existing.select(id), id, "left_anti")


# --- clusters --------------------------------------------------------------------------


def _clusters(df: DataFrame, id: str, order: Sequence[str], edges: DataFrame, size: int) -> DataFrame:
    """``(id, cluster)``: rows in order join the first cluster that takes them, else open one. A
    cluster takes a row linked to all its members while there is room. What a row can join
    depends only on rows linked to it, so the rule runs inside connected components; a component
    is as large as its links make it."""
    edges = cut(edges)
    at = df.select(F.col(id).alias("node"), F.struct(*[F.col(c) for c in order]).alias("at"))
    roots = components(edges).join(at, "node")
    spots = roots.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("at", "node"))).alias("line"))
    near = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.collect_set("b").alias("near"))
    rows = spots.select("root", F.posexplode("line").alias("rn", "l")).select("root", "rn", F.col("l.node").alias("node"))
    rows = rows.join(near, rows["node"] == near["a"]).select("root", "rn", "node", "near")
    kind = df.schema[id].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rn")
        opened: list[list] = []
        home: dict = {}
        for node, near in zip(frame["node"], frame["near"]):
            linked = set(near)
            takes = sorted({home[x] for x in linked if x in home})
            takes = [c for c in takes if len(opened[c]) < size and linked.issuperset(opened[c])]
            if not takes:
                opened.append([])
                takes = [len(opened) - 1]
            home[node] = takes[0]
            opened[takes[0]].append(node)
        return pd.DataFrame({"id": list(home), "cluster": [opened[c][0] for c in home.values()]})

    joined = rows.groupBy("root").applyInPandas(run, f"id {kind}, cluster {kind}")
    return df.select(F.col(id).alias("id")).join(joined, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def _first_linked(df: DataFrame, id: str, order: Sequence[str], edges: DataFrame) -> DataFrame:
    """``(id, cluster)``: rows in order join the first cluster with a member linked to them, else
    open one. That cluster is the one opened by the earliest row that links from later to earlier
    rows lead to, so it is found by labels that fall along the links, not row by row."""
    edges = cut(edges)
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    at = F.struct(*[F.col(c) for c in order], F.col(id).alias("_id"))
    placed = df.select(F.col(id).alias("node"), at.alias("at")).join(nodes, "node")
    ends = edges.join(placed.select(F.col("node").alias("a"), F.col("at").alias("at_a")), "a").join(
        placed.select(F.col("node").alias("b"), F.col("at").alias("at_b")), "b"
    )
    low = least_below(ends.select(F.greatest("at_a", "at_b").alias("hi"), F.least("at_a", "at_b").alias("lo")))
    named = low.select(F.col("node._id").alias("_node"), F.col("low._id").alias("cluster"))
    return df.select(F.col(id).alias("id")).join(named, F.col("id") == F.col("_node"), "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def similar_clusters(
    df: DataFrame, keys: Sequence[str], id: str, vector: str, order: Sequence[str], similar: float = SIMILAR, size: int = CLUSTER_SIZE
) -> DataFrame:
    """Greedy clusters inside each key: a row joins the first earlier cluster to whose members
    it is all similar, while there is room. ``(id, cluster)``, cluster = leader id."""

    def unit(frame: pd.DataFrame) -> np.ndarray:
        m = np.vstack(frame[vector].to_numpy()).astype("float64") if len(frame) else np.zeros((0, 1))
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
        return unit(left) @ unit(right).T >= similar

    return _clusters(df, id, order, links(df, keys, id, [vector], compare), size)


def overlap_clusters(
    df: DataFrame,
    keys: Sequence[str],
    id: str,
    sets: Sequence[str],
    order: Sequence[str],
    weights: Sequence[float] = PART_WEIGHTS,
    threshold: float = CLUSTER_SIM,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Clusters by weighted set overlap: a row joins the first cluster whose closest member
    reaches the threshold, else opens one. ``(id, cluster)``, cluster = first member id.

    A key of one block is walked in order where its rows are compared, many keys a call; only
    keys of more rows write links and are settled by rounds."""

    def coded(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # Row and number of every distinct token, by row, and the sizes of the sets.
        code = lists.flatten().dictionary_encode(null_encoding="encode").indices.to_numpy()
        size = lists.value_lengths().fill_null(0).to_numpy()
        pairs = np.unique(np.repeat(np.arange(len(lists)), size) * (len(code) + 1) + code)
        at = pairs // (len(code) + 1)
        return at, np.bincount(at, minlength=len(lists)), pairs % (len(code) + 1)

    def near(rows: pa.Table, starts: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        columns = [coded(rows.column(name).combine_chunks()) for name in sets]
        for lo, hi in zip(starts, [*starts[1:], len(rows)]):
            score = np.zeros((hi - lo, hi - lo))
            for (at, size, code), weight in zip(columns, weights, strict=True):
                own = slice(*np.searchsorted(at, (lo, hi)))
                _, own_code, copies = np.unique(code[own], return_inverse=True, return_counts=True)
                shared = copies[own_code] > 1
                row, token = at[own][shared] - lo, np.unique(own_code[shared], return_inverse=True)[1]
                both = np.zeros_like(score)
                for first in range(0, int(token.max(initial=-1)) + 1, 1024):
                    part = (token >= first) & (token < first + 1024)
                    hot = np.zeros((hi - lo, 1024 if first else min(1024, int(token.max()) + 1)))
                    hot[row[part], token[part] - first] = 1
                    both += hot @ hot.T
                union = size[lo:hi, None] + size[None, lo:hi] - both
                score += weight * np.divide(both, union, out=np.zeros_like(both), where=union > 0)
            yield lo, hi, score >= threshold

    def walk(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        home = np.arange(len(rows))
        for lo, hi, linked in near(rows, starts):
            earlier, first = np.tril(linked, -1), home[lo:hi]
            for i in np.flatnonzero(earlier.any(axis=1)):
                first[i] = first[:i][earlier[i, :i]].min()
        return pa.table({"id": rows.column(id), "cluster": rows.column(id).take(pa.array(home))})

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
        score = np.zeros((len(left), len(right)))
        for name, weight in zip(sets, weights, strict=True):
            a, b = [set(x) for x in left[name]], [set(x) for x in right[name]]
            where = {t: k for k, t in enumerate(set().union(*a))}
            # Rows by token; only tokens of the left part can be shared.
            m, n = np.zeros((len(a), len(where))), np.zeros((len(b), len(where)))
            for hot, rows in ((m, a), (n, b)):
                for i, row in enumerate(rows):
                    hot[i, [where[t] for t in row if t in where]] = 1
            both = m @ n.T
            union = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :] - both
            score += weight * np.divide(both, union, out=np.zeros_like(both), where=union > 0)
        return score >= threshold

    kind = df.schema[id].dataType.simpleString()
    small, large = by_size(df, keys, block_rows)
    need = list(dict.fromkeys([*keys, *order, id, *sets]))
    walked = each_key(small.select(*need), keys, list(dict.fromkeys([*order, id])), walk, f"id {kind}, cluster {kind}")
    if large is None:
        return walked
    return walked.union(_first_linked(large, id, order, links(large, keys, id, list(sets), compare)))


def weighted_overlap(pairs: Sequence[tuple[Column, Column]], weights: Sequence[float] = PART_WEIGHTS) -> Column:
    """Weighted sum of set similarities, at most 1."""
    total = F.lit(0.0)
    for (a, b), w in zip(pairs, weights, strict=True):
        total = total + F.lit(w) * jaccard(a, b)
    return F.least(F.lit(1.0), total)


def polarity(text: Column) -> Column:
    """What ``relation`` needs of a text: does it hold terms against, and terms for."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.struct(any_of(low, NEGATIVE_TERMS).alias("against"), any_of(low, POSITIVE_TERMS).alias("for"))


def relation_of(score: Column, new: Column, old: Column) -> Column:
    """``relation`` of two texts known by their ``polarity``."""
    opposed = (new["against"] & old["for"]) | (new["for"] & old["against"])
    return (
        F.when(score >= MERGE_SIM, "merge")
        .when((score >= RELATED_SIM) & opposed, "supersede")
        .otherwise("unrelated")
    )


def relation(score: Column, new_text: Column, old_text: Column) -> Column:
    """merge, supersede (related but of opposite polarity) or unrelated."""
    return relation_of(score, polarity(new_text), polarity(old_text))


def with_previous(df: DataFrame, line: Timeline, columns: Sequence[str]) -> DataFrame:
    """Add ``prev_<column>`` from the row before on the timeline (null at the start)."""
    return line.previous(df, columns)


# --- merging and superseding -----------------------------------------------------------


def supersede(df: DataFrame, line: Timeline, id: str, group: str) -> DataFrame:
    """Every row of a (keys, group) except the newest gets ``superseded_by`` = the next row;
    rows with a blank group are exempt."""
    w = line.window()
    return (
        line.halo(df, after=1)
        .withColumn("superseded_by", F.when(blank_to_null(F.col(group)).isNotNull(), F.lead(id).over(w)))
        .where(~F.col(GHOST))
        .drop(SLICE, GHOST)
        .withColumn("status", F.when(F.col("superseded_by").isNull(), "active").otherwise("superseded"))
    )


def merge_experience(existing: DataFrame, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merge stored and new experience rows of the same key: distinct union of the lists,
    support and merge counters as maxima, first timestamp kept. Columns besides the keys:
    chain_ids, users, jobs (arrays), support, merges, ts."""
    old, new = existing.alias("o"), delta.alias("n")
    none = F.array().cast("array<string>")

    def union(c: str) -> Column:
        both = F.concat(F.coalesce(F.col(f"o.{c}"), none), F.coalesce(F.col(f"n.{c}"), none))
        return F.array_distinct(F.filter(F.transform(both, lambda x: F.trim(x)), lambda x: x != ""))

    own = F.greatest(F.lit(1), F.size(F.array_distinct(F.coalesce(F.col("n.chain_ids"), none))))
    support = F.when(F.col("n.chain_ids").isNull(), F.col("o.support")).otherwise(
        F.greatest(own, F.coalesce(F.col("o.support"), F.lit(0)))
    )
    return old.join(new, list(keys), "full_outer").select(
        *keys,
        F.array_distinct(F.coalesce(F.col("n.chain_ids"), F.col("o.chain_ids"))).alias("chain_ids"),
        union("users").alias("users"),
        union("jobs").alias("jobs"),
        support.alias("support"),
        F.greatest(F.coalesce(F.col("o.merges"), F.lit(0)), support - 1).alias("merges"),
        F.coalesce(F.col("o.ts"), F.col("n.ts")).alias("ts"),
    )


def confidence_steps(
    df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], verify: Column, contradict: Column,
    start: int = 50, up: int = 5, down: int = 10,
) -> DataFrame:
    """Confidence (hundredths) after every feedback in order: verify adds, capped at 100;
    contradict subtracts, floored at 0. A step is ``x -> min(hi, max(lo, x + a))`` and such
    steps compose to one of the same form, so seconds fold to hours and hours to the key; no
    task sees a whole key."""
    # A bound far outside the range stands for "no bound".
    free = 1_000_000_000
    step = df.where(verify | contradict).select(
        *keys,
        F.unix_micros(ts).alias("_us"),
        F.struct(*order).alias("at"),
        F.when(verify, up).otherwise(-down).cast("bigint").alias("a"),
        F.when(verify, -free).otherwise(0).cast("bigint").alias("lo"),
        F.when(verify, 100).otherwise(free).cast("bigint").alias("hi"),
        F.when(verify, 1).otherwise(0).cast("bigint").alias("ups"),
        F.when(verify, 0).otherwise(1).cast("bigint").alias("downs"),
    )
    zero = F.struct(
        F.lit(0).cast("bigint").alias("a"), F.lit(-free).cast("bigint").alias("lo"), F.lit(free).cast("bigint").alias("hi")
    )

    def clamp(x: Column, s: Column) -> Column:
        return F.least(s["hi"], F.greatest(s["lo"], x))

    def compose(acc: Column, s: Column) -> Column:
        return F.struct(
            (acc["a"] + s["a"]).alias("a"),
            clamp(acc["lo"] + s["a"], s).alias("lo"),
            clamp(acc["hi"] + s["a"], s).alias("hi"),
        )

    def level(rows: DataFrame, micros: int | None) -> DataFrame:
        part = [F.floor(F.col("_us") / micros).alias("_part")] if micros else []
        steps = F.sort_array(F.collect_list(F.struct("at", "a", "lo", "hi")))
        out = rows.groupBy(*keys, *part).agg(
            F.aggregate(steps, zero, compose).alias("f"),
            F.min("_us").alias("_us"),
            F.min("at").alias("at"),
            F.sum("ups").alias("ups"),
            F.sum("downs").alias("downs"),
        )
        return out.select(*keys, "_us", "at", "f.a", "f.lo", "f.hi", "ups", "downs")

    whole = level(level(level(step, 1_000_000), 3_600_000_000), None)
    at_end = F.least(F.col("hi"), F.greatest(F.col("lo"), F.lit(start) + F.col("a")))
    return whole.select(*keys, at_end.alias("confidence"), "ups", "downs")


# --- retention -------------------------------------------------------------------------


def age_days(ts: Column, as_of: Column) -> Column:
    return F.greatest((F.unix_micros(as_of) - F.unix_micros(ts)) / DAY, F.lit(0.0))


def decayed(confidence: Column, reuse: Column, ts: Column, as_of: Column) -> Column:
    """Value of a memory: confidence halved after 30 days, plus 0.05 for each reuse."""
    return confidence / (1.0 + age_days(ts, as_of) / 30.0) + reuse * 0.05


def expired(ts: Column, reuse: Column, confidence: Column, as_of: Column, max_age_days: int = 90) -> Column:
    """Old, never reused and not of high confidence."""
    return (age_days(ts, as_of) > max_age_days) & (reuse == 0) & (confidence < 0.9)


def over_capacity(df: DataFrame, id: str, value: str, cap: int) -> DataFrame:
    """The rows to remove when there are more than ``cap``: the max(excess, 20 %) of lowest
    value, ties by id. Ranks are exact and computed range by range."""
    total = df.agg(F.count(F.lit(1))).scalar()
    drop = F.when(total > cap, F.greatest(total - cap, F.floor(total * 0.2))).otherwise(0)
    return Timeline((), (value, id)).numbered(df, "rank").where(F.col("rank") <= drop)


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: int = 20) -> DataFrame:
    return top_rows(df, keys, [F.col(c).desc() for c in order], keep)


# --- chains ----------------------------------------------------------------------------


def chain_signature(steps: Column) -> Column:
    """Tool names with consecutive repeats dropped, joined by '-'. For one round in an array."""
    kept = F.filter(
        F.transform(steps, lambda x, i: F.struct(x.alias("x"), (F.when(i > 0, F.get(steps, i - 1))).alias("p"))),
        lambda s: ~s["x"].eqNullSafe(s["p"]),
    )
    return F.array_join(F.transform(kept, lambda s: s["x"]), "-")


def chain_steps(df: DataFrame, line: Timeline, tool: str) -> DataFrame:
    """The same in long form for rounds of any length: numbered steps without repeats."""
    rows = with_previous(line.placed(df), line, [tool])
    kept = rows.where(~F.col(tool).eqNullSafe(F.col(f"prev_{tool}"))).drop(f"prev_{tool}")
    return line.numbered(kept, "step").drop(SLICE)


def sessions(df: DataFrame, line: Timeline, ts: str, gap_micros: int, name: str = "session") -> DataFrame:
    """Number the sessions of each key: a gap of at least ``gap_micros`` starts a new one."""
    rows = with_previous(line.placed(df), line, [ts])
    gap = F.unix_micros(ts) - F.unix_micros(f"prev_{ts}")
    start = F.when(gap < gap_micros, 0).otherwise(1)
    return line.running(rows, **{name: ("sum", start)}).drop(f"prev_{ts}", SLICE)


def whole_round_chain(df: DataFrame, keys: Sequence[str], line_order: Sequence[str], tool: str) -> DataFrame:
    """One chain per round: the full tool sequence with its index list. Rounds are bounded by
    the collector; use ``chain_steps`` for unbounded keys."""
    calls = F.sort_array(F.collect_list(F.struct(*line_order, tool)))
    seq = F.transform(calls, lambda s: s[tool])
    return df.groupBy(*keys).agg(seq.alias("tools")).withColumns(
        {"signature": chain_signature(F.col("tools")), "cycle_indices": F.sequence(F.lit(0), F.size("tools") - 1)}
    )


def experiences_for_tool(session: DataFrame, stored: DataFrame, tool: str) -> DataFrame:
    """Session rows first, then stored rows whose pipeline holds the tool."""
    def tier(df: DataFrame, n: int) -> DataFrame:
        return df.where(F.array_contains("pipeline", tool)).withColumn("tier", F.lit(n))

    return tier(session, 1).unionByName(tier(stored, 2)).orderBy("tier", F.desc("confidence"), "id")


# --- profiles and history --------------------------------------------------------------


def latest_value(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Newest value per key, with the number of versions seen."""
    return df.groupBy(*keys).agg(
        F.max_by(value, F.struct(*order)).alias(value), F.count(F.lit(1)).alias("versions")
    )


def profile_fields(df: DataFrame, user: str, field: str, value: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row per user with the latest value of every known field."""
    return df.groupBy(user).agg(
        *[F.max_by(value, F.when(F.col(field) == f, F.struct(*order))).alias(f) for f in fields]
    )


def profile_extras(df: DataFrame, user: str, field: str, value: str, fields: Sequence[str]) -> DataFrame:
    """Distinct values of fields that have no place in the profile, in long form."""
    return df.where(~F.col(field).isin(*fields)).select(user, value).distinct()


def usage_summary(df: DataFrame, key: str, success: Column, example: Column, intent: str, order: Sequence[str]) -> DataFrame:
    """Counts, successes, failures, the first three examples and the distinct intents."""
    counts = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("uses"),
        F.count_if(success).alias("successes"),
        F.count_if(~success).alias("failures"),
        F.array_join(F.array_sort(F.collect_set(blank_to_null(F.col(intent)))), "|").alias("intents"),
    )
    said = df.withColumn("_example", F.left(example, F.lit(200))).where(F.col("_example") != "")
    first = top_rows(said, [key], [F.col(c) for c in order], 3, "_rn")
    texts = first.groupBy(key).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_rn", "_example"))), lambda s: s["_example"]), "|").alias("examples")
    )
    return counts.join(texts, key, "left").withColumn("examples", F.coalesce("examples", F.lit("")))


def stable_preferences(df: DataFrame, user: str, item: str, ts: str, threshold: int = 2, keep: int = 3) -> DataFrame:
    """Items a user used at least ``threshold`` times, the top ``keep`` by (uses, latest, item)."""
    used = df.groupBy(user, item).agg(F.count(F.lit(1)).alias("uses"), F.max(ts).alias("latest"))
    return top_rows(
        used.where(F.col("uses") >= threshold), [user], [F.desc("uses"), F.desc("latest"), F.desc(item)], keep
    )


def cross_intent_hints(profiles: DataFrame, current: DataFrame, parts: Sequence[str], keep: int) -> DataFrame:
    """Short summaries (two parts at most) of a user's other intents, the first ``keep``."""
    others = profiles.join(current, "user_id").where(F.col("intent") != F.col("current_intent"))
    said = F.array_compact(F.array(*[blank_to_null(F.col(p)) for p in parts]))
    hint = F.concat(F.lit("["), F.col("intent"), F.lit("] "), F.array_join(F.slice(said, 1, 2), "; "))
    return top_rows(others.where(F.size(said) > 0).select("user_id", "intent", hint.alias("hint")), ["user_id"], [F.col("intent")], keep)


def rolling_history(df: DataFrame, keys: Sequence[str], order: str, text: str, keep: int = 20, full: int = 5, short: int = 50) -> DataFrame:
    """Last ``keep`` rounds; the last ``full`` whole, older ones cut to ``short`` characters."""
    last = top_rows(df, keys, [F.desc(order)], keep, "back")
    return last.withColumn("summary", F.when(F.col("back") <= full, F.col(text)).otherwise(clip(F.col(text), short)))


def lookback_repeats(df: DataFrame, line: Timeline, same: Sequence[str], rows: int = 12) -> DataFrame:
    """Mark rows whose ``same`` columns equal one of the ``rows`` rows before them, kept or not;
    ``kept_lookback`` is the form in which rejected rows take no place."""
    key = F.xxhash64(*same)
    w = line.window().rowsBetween(-rows, -1)
    return (
        line.halo(df.withColumn("_same", key), before=rows)
        .withColumn("repeat", F.array_contains(F.collect_list("_same").over(w), F.col("_same")))
        .where(~F.col(GHOST))
        .drop(SLICE, GHOST, "_same")
    )


def kept_lookback(df: DataFrame, line: Timeline, same: Sequence[str], rows: int = 12, rounds: int = 1000) -> DataFrame:
    """``df`` with ``repeat``: a row is rejected when its ``same`` columns equal one of the last
    ``rows`` kept rows of its key; a rejected row takes no place in the look-back.

    What a slice hands on is its last kept rows. Every slice is folded as if nothing came before
    it; then slices that get another start than they were folded with are folded again, until
    none does. A slice with enough kept rows hands on the same rows from any start, so a hot key
    of many values settles in few rounds; one of few values may take a round a slice. Rows are
    always placed by ranges, and only keys that a range cuts take part."""
    line = Timeline(line.keys, line.order)
    keys = list(line.keys)
    by = [*keys, SLICE]
    placed = cut(line.placed(df).withColumn("_same", F.xxhash64(*same)))
    kinds = {f.name: f.dataType.simpleString() for f in placed.schema}
    key_schema = ", ".join(f"`{c}` {kinds[c]}" for c in by)

    def fold(mark: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, kept = None, []

            def rows_of(ends: list, kind: pa.Schema) -> pa.RecordBatch:
                cols = [pa.array([k[i] for k, _ in ends], kind.field(c).type) for i, c in enumerate(by)]
                return pa.RecordBatch.from_arrays([*cols, pa.array([e for _, e in ends], pa.list_(pa.int64()))], [*by, "_end"])

            for batch in batches:
                out, ends, starts = [], [], batch.column("_start")
                groups = zip(*[batch.column(c).to_pylist() for c in by])
                for i, (key, value) in enumerate(zip(groups, batch.column("_same").to_pylist())):
                    if key != held:
                        if held is not None:
                            ends.append((held, kept))
                        held, kept = key, starts[i].as_py() or []
                    seen = value in kept
                    out.append(seen)
                    if not seen:
                        kept = [*kept, value][-rows:]
                if mark:
                    names = [c for c in batch.schema.names if c != "_start"]
                    yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(out, pa.bool_())], [*names, "repeat"])
                elif ends:
                    yield rows_of(ends, batch.schema)
            if held is not None and not mark:
                yield rows_of([(held, kept)], batch.schema)

        return run

    def started(frame: DataFrame, starts: DataFrame | None) -> DataFrame:
        if starts is None:
            frame = frame.withColumn("_start", F.lit(None).cast("array<long>"))
        else:
            match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by])
            renamed = starts.select(*[F.col(c).alias(f"_k_{c}") for c in by], "_start")
            frame = frame.join(renamed, match, "left").select(*frame.columns, "_start")
        return frame.repartition(*by).sortWithinPartitions(*by, *line.order)

    between = line.between(placed)
    starts = None
    if between is not None:
        lean = between.select(*by, *[c for c in line.order if c not in by], "_same")
        before = Window.partitionBy(*keys).orderBy(SLICE)

        def folded(frame: DataFrame, starts: DataFrame | None) -> DataFrame:
            given = started(frame, starts)
            return given.mapInArrow(fold(False), f"{key_schema}, _end array<long>")

        ends = cut(folded(lean, None))
        starts = ends.select(*by, F.lit(None).cast("array<long>").alias("_start"))
        for _ in range(rounds):
            now = ends.withColumn("_start", F.lag("_end").over(before)).select(*by, "_start")
            old = starts.select(*[F.col(c).alias(f"_o_{c}") for c in by], F.col("_start").alias("_old"))
            match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in by])
            both = now.join(old, match)
            change = cut(both.where(~F.coalesce("_start", F.array().cast("array<long>")).eqNullSafe(F.coalesce("_old", F.array().cast("array<long>")))).select(*by, "_start"))
            starts = cut(now)
            if change.limit(1).count() == 0:
                break
            # Only these slices are read again.
            renamed = change.select(*[F.col(c).alias(f"_k_{c}") for c in by])
            again = lean.join(renamed, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by]), "left_semi")
            new = folded(again, change).withColumnRenamed("_end", "_new").select(*[F.col(c).alias(f"_n_{c}") for c in by], "_new")
            match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_n_{c}")) for c in by])
            ends = cut(ends.join(new, match, "left").select(*by, F.coalesce("_new", "_end").alias("_end")))
        else:
            raise RuntimeError(f"the look-back did not settle in {rounds} rounds")
    columns = ", ".join(f"`{c}` {kinds[c]}" for c in placed.columns)
    marked = started(placed, starts).mapInArrow(fold(True), f"{columns}, repeat boolean")
    return marked.select(*df.columns, "repeat")


def lookback_fold(values: Column, rows: int = 12) -> Column:
    """Values of one bounded job kept when none of the last ``rows`` kept values equals them;
    a rejected value does not take a place in the look-back."""
    start = F.array().cast("array<string>")
    return F.aggregate(
        values,
        start,
        lambda kept, v: F.when(
            F.array_contains(F.slice(kept, F.greatest(F.size(kept) - rows + 1, F.lit(1)), rows), v), kept
        ).otherwise(F.array_append(kept, v)),
    )


def eligible(source: Column, content: Column, category: Column, confidence: Column, tool: Column, keywords: Column, minimum: float) -> Column:
    """Whether a working-memory row may be stored for good."""
    text = F.trim(F.coalesce(content, F.lit("")))
    auto = (
        (F.coalesce(confidence, F.lit(0.0)) >= minimum)
        | ((category != "generic") & ((tool != "") | (keywords > 0)))
        | ((tool != "") & (F.length(content) >= 20))
    )
    return (
        F.when(source == "preload", False)
        .when(F.length(text) < 8, False)
        .when(source.isin("agent_lesson", "tool_error") | (category == "tool_error"), True)
        .when(source != "auto_extract", False)
        .otherwise(auto)
    )


def experience_type(explicit: Column, tags: Column, outcome: Column, aliases: Mapping[str, str], priority: Sequence[str]) -> Column:
    """Explicit type unless generic, else the tag of best priority, else by outcome. ``aliases``
    maps normalised names to canonical types; it is a small table of constants."""
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    order = F.array(*[F.lit(p) for p in priority])

    def norm(c: Column) -> Column:
        return F.regexp_replace(F.lower(F.trim(c)), "[- ]", "_")

    def canon(c: Column) -> Column:
        n = norm(c)
        own = F.coalesce(F.try_element_at(table, n), F.when(F.array_contains(order, n), n))
        return F.coalesce(
            own,
            F.when(n.startswith("agent_") | (n == "initial_generation"), "agent_run"),
            F.when(n.startswith("chain"), "chain"),
        )

    def rank(c: Column) -> Column:
        at = F.array_position(order, c)
        return F.when(at == 0, 99).otherwise(at)

    stated = F.coalesce(
        F.try_element_at(table, norm(explicit)), F.when(F.array_contains(order, norm(explicit)), norm(explicit))
    )
    tagged = F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), canon), lambda x: x.isNotNull())
    ranked = F.transform(tagged, lambda x, i: F.struct(rank(x).alias("r"), i.alias("i"), x.alias("x")))
    return F.coalesce(
        F.when(stated != "generic", stated),
        F.array_min(ranked)["x"],
        F.when(F.lower(F.trim(outcome)).isin("failed", "error"), "tool_error"),
        stated,
        F.lit("generic"),
    )


def default_outcome(kind: Column) -> Column:
    return (
        F.when(kind == "tool_error", "failed").when(kind.isin("tool_misuse", "tool_limitation"), "partial").otherwise("success")
    )


def cue_tags(content: Column, tool: Column, cues: Sequence[str] = TAG_CUES, keep: int = 10) -> Column:
    """Tool name and the cue words found, in cue order, at most ``keep``."""
    low = F.lower(content)
    own = F.filter(F.array(tool), lambda x: x.isNotNull() & (x != ""))
    found = F.filter(F.array(*[F.lit(c) for c in cues]), lambda c: F.contains(low, c))
    return F.slice(F.concat(own, found), 1, keep)


def add_uses(df: DataFrame, used: DataFrame, id: str, counter: str) -> DataFrame:
    """Add the number of occurrences in ``used`` to each row's counter."""
    counts = used.groupBy(id).agg(F.count(F.lit(1)).alias("_n"))
    return df.join(counts, id, "left").withColumn(counter, F.col(counter) + F.coalesce("_n", F.lit(0))).drop("_n")


def count_change(df: DataFrame, key: str, before: Column) -> DataFrame:
    """Rows before and after a cut by key, and the difference."""
    return df.groupBy(key).agg(F.count_if(before).alias("before"), F.count(F.lit(1)).alias("after")).withColumn(
        "added", F.col("after") - F.col("before")
    )


def versions(df: DataFrame, line: Timeline, value: str) -> DataFrame:
    """Number the snapshots of each key and give the change from the one before."""
    rows = line.running(df, strict=True, _before=("last", F.struct(value)), _n=("count", F.lit(1)))
    before = F.col(f"_before.{value}")
    added = {f"prev_{value}": before, "version": F.col("_n") + 1, "delta": F.col(value) - before}
    return rows.withColumns(added).drop("_before", "_n")


def params_diff(df: DataFrame, key: str, params: str, first: int, second: int) -> DataFrame:
    """Parameters (a map) that differ between two versions of each key, with numeric change."""
    def side(v: int, name: str) -> DataFrame:
        return df.where(F.col("version") == v).select(key, F.explode(params).alias("param", name))

    both = side(first, "before").join(side(second, "after"), [key, "param"], "full_outer")
    return both.where(~F.col("before").eqNullSafe(F.col("after"))).withColumn(
        "delta", F.col("after").try_cast("double") - F.col("before").try_cast("double")
    )


def soft_error(result: Column) -> Column:
    """A result that failed without saying so: a JSON payload or an error prefix."""
    success = F.get_json_object(result, "$.success")
    code = F.coalesce(F.get_json_object(result, "$.error_code"), F.lit(""))
    error = F.coalesce(F.get_json_object(result, "$.error"), F.lit(""))
    text = F.trim(F.coalesce(result, F.lit("")))
    told = (
        F.coalesce(success == "false", F.lit(False))
        | ~code.isin("", "null", "false", "0")
        | (~error.isin("", "null", "false", "0") & ~F.coalesce(success == "true", F.lit(False)))
    )
    return told | F.lower(text).startswith("error:") | text.startswith("❌")


def error_summary(result: Column, limit: int = 100) -> Column:
    code = blank_to_null(F.get_json_object(result, "$.error_code"))
    message = F.coalesce(
        blank_to_null(F.get_json_object(result, "$.error")), blank_to_null(F.get_json_object(result, "$.message"))
    )
    said = blank_to_null(F.concat_ws(": ", code, message))
    return F.left(F.coalesce(said, F.trim(F.coalesce(result, F.lit("")))), F.lit(limit))


def compact_call(calls: DataFrame, actions: Mapping[str, Column]) -> DataFrame:
    """One row per raw tool call (tool_name, args, result, is_error): target file, action text
    by tool, observation and error message. ``raw`` wrapped arguments are unwrapped."""
    args = F.coalesce(F.get_json_object("args", "$.raw"), F.col("args"))
    rows = calls.withColumn("args", args)
    target = F.coalesce(
        *[blank_to_null(F.get_json_object("args", f"$.{n}")) for n in ("target_file", "file_path", "html_file", "path")],
        F.lit(""),
    )
    action = F.left(F.coalesce("args", F.lit("")), F.lit(80))
    for tool, text in actions.items():
        action = F.when(F.col("tool_name") == tool, text).otherwise(action)
    failed = F.col("is_error") | soft_error(F.col("result"))
    return rows.select(
        *[c for c in calls.columns if c not in ("args", "result", "is_error")],
        target.alias("target_file"),
        action.alias("action"),
        F.left(squeeze(F.coalesce("result", F.lit(""))), F.lit(200)).alias("observation"),
        failed.alias("is_error"),
        F.when(failed, error_summary(F.col("result"))).otherwise("").alias("error"),
    )


def round_tokens(df: DataFrame, keys: Sequence[str], line_chars: Column, raw_chars: Column) -> DataFrame:
    """Length of the assembled round text (lines joined by a newline), its token estimate, and
    how much shorter it is than the raw text. Lengths add up, so no text is gathered."""
    out = df.groupBy(*keys).agg(
        (F.sum(line_chars) + F.count(F.lit(1)) - 1).cast("bigint").alias("chars"),
        F.sum(raw_chars).cast("bigint").alias("raw"),
        F.sum(line_chars).alias("_lines"),
    )
    return out.select(
        *keys,
        "chars",
        F.floor(F.col("chars") / 3).alias("tokens"),
        F.round(F.col("_lines") / unless(F.col("raw"), F.lit(0)), 4).alias("ratio"),
    )
