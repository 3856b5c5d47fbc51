"""Round collection and keyed stream state, with batch twins that split hot keys.

A batch twin states the same result over a stored table. The streams keep a small state
per key and see each micro-batch once."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.functions.scan import SLICE, Timeline

# A batch closes at three rounds, 2000 tokens or an hour since the last one.
ROUNDS, TOKENS, IDLE_S = 3, 2000, 3600


# --- batch twins -----------------------------------------------------------------------


def _jumps(df: DataFrame, line: Timeline, tokens: Column, tokens_cap: int, idle_us: int) -> DataFrame:
    """For every row the length (1 to 3) of the batch that would start there. It depends on the
    row before (time of the last flush) and two rows ahead only."""
    ts = line.order[0]
    rows = line.halo(df.withColumn("_tok", tokens.cast("bigint")), before=1, after=2)
    w = line.window()
    since = F.coalesce(F.lag(F.unix_micros(ts)).over(w), F.unix_micros(ts))
    at = [F.unix_micros(ts), F.lead(F.unix_micros(ts)).over(w)]
    t1 = F.col("_tok")
    t2 = t1 + F.lead("_tok").over(w)
    one = (t1 >= tokens_cap) | (at[0] - since > idle_us)
    two = (t2 >= tokens_cap) | (at[1] - since > idle_us)
    return (
        rows.withColumn("_jump", F.when(one, 1).when(F.coalesce(two, F.lit(False)), 2).otherwise(ROUNDS))
        .where(~F.col("_ghost"))
        .drop("_ghost", "_tok")
    )


def collected_batches(df: DataFrame, line: Timeline, tokens: Column, tokens_cap: int = TOKENS, idle_us: int = IDLE_S * 1_000_000) -> DataFrame:
    """Number the collector batches of every key: a batch closes when it holds three rounds,
    reaches the token cap, or the idle time has passed since the last flush.

    The next start is one, two or three rows on, so a slice maps the place of the first start
    in it (0, 1 or 2) to that place in the next slice. Slices are walked in parallel, their maps
    are chained per key over one small row per slice, and a second walk marks the starts."""
    keys = list(line.keys)
    rows = _jumps(df, line, tokens, tokens_cap, idle_us)
    by = [*keys, SLICE]
    spread = rows.repartition(*by).sortWithinPartitions(*by, *line.order)
    key_schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    slice_type = rows.schema[SLICE].dataType.simpleString()

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Three walkers per slice, one for each place of entry; a row moves those standing on it.
        held, at, nxt = None, 0, [0, 1, 2]
        for frame in frames:
            out = []
            for *key, jump in frame[[*by, "_jump"]].itertuples(index=False):
                if key != held:
                    if held is not None:
                        out.append((*held, *(n - at for n in nxt)))
                    held, at, nxt = key, 0, [0, 1, 2]
                nxt = [n + jump if n == at else n for n in nxt]
                at += 1
            if out:
                yield pd.DataFrame(out, columns=[*by, "f0", "f1", "f2"])
        if held is not None:
            yield pd.DataFrame([(*held, *(n - at for n in nxt))], columns=[*by, "f0", "f1", "f2"])

    maps = spread.select(*by, "_jump").mapInPandas(walk, f"{key_schema}, {SLICE} {slice_type}, f0 int, f1 int, f2 int")

    def chain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, entry = None, 0
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                *key, s, f0, f1, f2 = row
                if key != held:
                    held, entry = key, 0
                out.append((*key, s, entry))
                entry = (f0, f1, f2)[entry]
            yield pd.DataFrame(out, columns=[*by, "_entry"])

    entries = (
        maps.repartition(*keys).sortWithinPartitions(*keys, SLICE)
        .mapInPandas(chain, f"{key_schema}, {SLICE} {slice_type}, _entry int")
        .select(*[F.col(k).alias(f"_e_{k}") for k in keys], F.col(SLICE).alias("_e_slice"), "_entry")
    )
    match = F.col(SLICE) == F.col("_e_slice")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_e_{k}"))
    joined = rows.join(entries, match).drop("_e_slice", *[f"_e_{k}" for k in keys])
    placed = joined.repartition(*by).sortWithinPartitions(*by, *line.order)
    names = [c for c in placed.columns if c not in ("_jump", "_entry")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema if f.name in names)

    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, at, nxt = None, 0, 0
        for frame in frames:
            starts = []
            for *key, jump, entry in frame[[*by, "_jump", "_entry"]].itertuples(index=False):
                if key != held:
                    held, at, nxt = key, 0, entry
                starts.append(1 if at == nxt else 0)
                nxt = nxt + jump if at == nxt else nxt
                at += 1
            yield frame[names].assign(_start=starts)

    marked = placed.mapInPandas(mark, f"{fields}, _start int")
    return line.running(marked, batch=("sum", F.col("_start"))).drop("_start", SLICE)


def batch_summary(batches: DataFrame, keys: Sequence[str], order: str, tokens: Column, tokens_cap: int = TOKENS) -> DataFrame:
    """One row per batch: rounds, tokens, first and last round and the reason it closed; the
    last batch of a key may still be open."""
    sums = batches.groupBy(*keys, "batch").agg(
        F.count(F.lit(1)).alias("rounds"), F.sum(tokens).cast("bigint").alias("tokens"), F.min(order).alias("first_id"), F.max(order).alias("last_id")
    )
    reason = F.when(F.col("rounds") >= ROUNDS, "rounds").when(F.col("tokens") >= tokens_cap, "tokens").otherwise("idle or open")
    return sums.withColumn("reason", reason)


def acknowledged(pending: DataFrame, acks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pending rounds without those acknowledged."""
    return pending.join(acks.select(*keys).distinct(), list(keys), "left_anti")


def retracted(rounds: DataFrame, tombstones: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rounds without those a rollback names."""
    return rounds.join(tombstones.select(*keys).distinct(), list(keys), "left_anti")


def rounds_of_turns(turns: DataFrame, line: Timeline, opens: Column, chars: Column) -> DataFrame:
    """Close each round at the next opening turn: calls, characters, first and last turn. Turns
    before the first opening belong to no round."""
    numbered = line.running(turns, round=("sum", F.when(opens, 1).otherwise(0)))
    return (
        numbered.where(F.col("round") > 0)
        .groupBy(*line.keys, "round")
        .agg(
            F.count(F.lit(1)).alias("turns"), F.sum(chars).cast("bigint").alias("chars"),
            F.min(line.order[0]).alias("first_turn"), F.max(line.order[0]).alias("last_turn"),
        )
    )


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of every key: what a duplicate-free append keeps."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def cooled_down(df: DataFrame, key: str, ts: str, id: str, seconds: int = 3600) -> DataFrame:
    """Rows that pass a cool-down in whole seconds: the first of a key, then the first one at
    least ``seconds`` after the last that passed. Rows of one second are alike, so only the
    first of each second travels; a hot key then sends at most one row per second, and its
    fold is a short scan that holds one value."""
    each_second = df.groupBy(key, F.unix_seconds(ts).alias("_s")).agg(F.min_by(id, F.struct(ts, id)).alias(id), F.min(ts).alias(ts))
    rows = each_second.repartition(key).sortWithinPartitions(key, "_s")
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, until = None, None
        for frame in frames:
            keep = []
            for k, s in zip(frame[key], frame["_s"], strict=True):
                passed = k != held or s >= until
                keep.append(passed)
                if passed:
                    held, until = k, s + seconds
            if any(keep):
                yield frame[keep][[key, id]]

    return rows.mapInPandas(run, f"`{key}` {types[key]}, `{id}` {types[id]}")


def window_counts(df: DataFrame, ts: str, keys: Sequence[str], width: str, slide: str | None = None) -> DataFrame:
    """Uses, errors and value by tumbling or sliding window; the same call serves a stream."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return df.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("uses"), F.count_if("is_error").alias("errors"))


# --- streams ---------------------------------------------------------------------------

ROUND_OPS = "user_id string, round_id int, ts timestamp, tokens int, op string"
FLUSHED = "user_id string, round_ids array<int>, tokens int, reason string"


def collect_rounds(stream: DataFrame, rounds: int = ROUNDS, tokens: int = TOKENS, idle_s: int = IDLE_S) -> DataFrame:
    """Pending rounds per user as stream state. ``op`` is add, ack (drop the round), rollback (drop
    the round, or the newest for 0) or end (flush). A flush comes at the round count, the token
    budget, the idle time since the last flush, or the end; a quiet user is flushed by a
    processing-time timer."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState):
        held = json.loads(state.get[0]) if state.exists else {"p": [], "since": None}
        out = []

        def flush(reason: str, at) -> None:
            if held["p"]:
                out.append((key[0], [r for r, _ in held["p"]], sum(t for _, t in held["p"]), reason))
            held["p"], held["since"] = [], at

        if state.hasTimedOut:
            flush("idle", held["since"])
            state.remove()
        else:
            ops = pd.concat(list(frames)).sort_values(["ts", "round_id"])
            for r, ts, t, op in ops[["round_id", "ts", "tokens", "op"]].itertuples(index=False):
                now = ts.timestamp()
                held["since"] = now if held["since"] is None else held["since"]
                if op == "add":
                    held["p"].append([int(r), int(t)])
                    total = sum(x for _, x in held["p"])
                    if len(held["p"]) >= rounds:
                        flush("rounds", now)
                    elif total >= tokens:
                        flush("tokens", now)
                    elif now - held["since"] > idle_s:
                        flush("idle", now)
                elif op in ("ack", "rollback"):
                    named = [p for p in held["p"] if p[0] != r]
                    held["p"] = held["p"][:-1] if op == "rollback" and not r else named
                elif op == "end":
                    flush("end", now)
            state.update((json.dumps(held),))
            if held["p"]:
                state.setTimeoutDuration(idle_s * 1000)
        if out:
            yield pd.DataFrame(out, columns=["user_id", "round_ids", "tokens", "reason"])

    return stream.groupBy("user_id").applyInPandasWithState(
        step, FLUSHED, "held string", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def close_rounds(stream: DataFrame) -> DataFrame:
    """Round lifecycle on a stream of (user_id, ts, op, text): begin opens a round, call adds to
    it, end closes it to one row. A begin while one is open drops the open one."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState):
        held = json.loads(state.get[0]) if state.exists else {"open": False, "n": 0, "calls": 0, "chars": 0}
        out = []
        for op, text in pd.concat(list(frames)).sort_values("ts", kind="stable")[["op", "text"]].itertuples(index=False):
            if op == "begin":
                held.update(open=True, n=held["n"] + 1, calls=0, chars=len(text or ""))
            elif held["open"] and op == "call":
                held.update(calls=held["calls"] + 1, chars=held["chars"] + len(text or ""))
            elif held["open"] and op == "end":
                out.append((key[0], held["n"], held["calls"], held["chars"] // 3))
                held["open"] = False
        state.update((json.dumps(held),))
        if out:
            yield pd.DataFrame(out, columns=["user_id", "round_id", "calls", "tokens"])

    return stream.groupBy("user_id").applyInPandasWithState(
        step, "user_id string, round_id int, calls int, tokens int", "held string", "append", GroupStateTimeout.NoTimeout
    )


def live_cooldown(stream: DataFrame, seconds: int = 3600) -> DataFrame:
    """Failures per URL on a stream of (url, ts): rows inside the period since the last one that
    passed are suppressed."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState):
        until = state.get[0] if state.exists else None
        out = []
        for ts in pd.concat(list(frames)).sort_values("ts")["ts"]:
            s = int(ts.timestamp())
            if until is None or s >= until:
                out.append((key[0], ts))
                until = s + seconds
        state.update((until,))
        if out:
            yield pd.DataFrame(out, columns=["url", "ts"])

    return stream.groupBy("url").applyInPandasWithState(
        step, "url string, ts timestamp", "until long", "append", GroupStateTimeout.NoTimeout
    )


def live_sessions(stream: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions per user that end after a gap of inactivity."""
    return (
        stream.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap).alias("s"), "user_id")
        .agg(F.count(F.lit(1)).alias("events"))
        .select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events")
    )


def live_distinct(stream: DataFrame, keys: Sequence[str], late: str = "10 minutes") -> DataFrame:
    """Rows not seen before within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def live_counts(stream: DataFrame, keys: Sequence[str], width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counters by window for update mode."""
    return window_counts(stream.withWatermark("ts", late), "ts", keys, width, slide)


def append_new(target: str, id: str):
    """A ``foreachBatch`` function that appends only ids the target does not hold. A replayed
    batch adds nothing, so the append is exact."""

    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([id])
        try:
            known = spark.read.parquet(target).select(id)
            fresh = fresh.join(known, id, "left_anti")
        except Exception as e:  # the first batch finds no target yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        fresh.write.mode("append").parquet(target)

    return run


