"""The sliced scans against plain Python on data where one key holds most rows."""

import random

import pytest
from pyspark.sql import functions as F

from quire.functions.scan import GHOST, Timeline, top_rows
from quire.operators import memory, structure
from quire.streaming import rounds


@pytest.fixture(scope="module")
def data():
    rng = random.Random(7)
    out = []
    for i in range(600):
        key = "hot" if rng.random() < 0.6 else rng.choice(["a", "b", None])
        out.append((key, rng.randrange(0, 200), i, rng.choice([None, rng.randrange(50)]), rng.choice("xyz")))
    return out


@pytest.fixture(scope="module", params=["floor(t / 1)", "floor(t / 13)", "floor(t / 1000)", None])
def line(request, spark):
    # Small ranges must stay apart for the work between them to show.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield Timeline(("k",), ("t", "id"), request.param)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame(data, "k string, t int, id int, v int, c string").repartition(5)


def by_key(data):
    keys = {}
    for r in sorted(data, key=lambda r: (r[1], r[2])):
        keys.setdefault(r[0], []).append(r)
    return keys


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_running(frame, line, data, reverse, strict):
    v = F.col("v")
    got = line.running(
        frame, reverse=reverse, strict=strict, s=("sum", v), n=("count", v), hi=("max", v), lo=("min", v), last=("last", v)
    )
    got = {r["id"]: (r["s"], r["n"], r["hi"], r["lo"], r["last"]) for r in got.collect()}
    want = {}
    for items in by_key(data).values():
        items = items[::-1] if reverse else items
        for i, r in enumerate(items):
            seen = [x[3] for x in items[: i if strict else i + 1] if x[3] is not None]
            want[r[2]] = (sum(seen), len(seen), max(seen), min(seen), seen[-1]) if seen else (None, 0, None, None, None)
    assert got == want


def test_halo_lag_and_lead(frame, line, data):
    w = line.window()
    got = line.halo(frame, before=3, after=2).select(
        "id", GHOST, F.collect_list("id").over(w.rowsBetween(-3, -1)).alias("b"), F.collect_list("id").over(w.rowsBetween(1, 2)).alias("a")
    )
    got = {r["id"]: (r["b"], r["a"]) for r in got.where(~F.col(GHOST)).collect()}
    want = {}
    for items in by_key(data).values():
        ids = [r[2] for r in items]
        for i, x in enumerate(ids):
            want[x] = (ids[max(0, i - 3) : i], ids[i + 1 : i + 3])
    assert got == want


def test_islands(frame, line, data):
    got = {r["id"]: r["island"] for r in line.islands(frame, F.col("c")).collect()}
    want = {}
    for items in by_key(data).values():
        n, last = 0, object()
        for r in items:
            n += r[4] != last
            last = r[4]
            want[r[2]] = n
    assert got == want


def test_numbered_without_key(frame, data):
    got = {r["id"]: r["rn"] for r in Timeline((), ("t", "id"), "floor(t / 9)").numbered(frame).collect()}
    order = sorted(data, key=lambda r: (r[1], r[2]))
    assert got == {r[2]: i + 1 for i, r in enumerate(order)}
    assert got == {r["id"]: r["rn"] for r in Timeline((), ("t", "id")).numbered(frame).collect()}


def test_ranges_spread_a_hot_key_and_are_placed_once(frame, spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    line = Timeline(("k",), ("t", "id"))
    placed = line.placed(frame)
    rows = placed.where("k = 'hot'").groupBy("_slice").count().collect()
    assert len(rows) >= 2 and max(r["count"] for r in rows) < 0.75 * sum(r["count"] for r in rows)
    kinds = {(r.k, r._slice % 2) for r in placed.select("k", "_slice").distinct().collect()}
    assert len(kinds) == len({k for k, _ in kinds}) and ("hot", 1) in kinds
    steps = line.numbered(line.previous(placed, ["v"]), "n")
    assert "_slice" in steps.columns and steps.count() == frame.count()
    plan = steps._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_steps_in_a_row_by_ranges(frame, data, spark, coalesce):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    line = Timeline(("k",), ("t", "id"))
    timed = frame.withColumn("ts", F.timestamp_seconds("t"))
    by_ts = Timeline(("k",), ("ts", "id"))
    got = {r.id: r.session for r in memory.sessions(timed, by_ts, "ts", 2_000_000).collect()}
    chain = sorted((repr(r.k), r.step, r.id) for r in memory.chain_steps(frame, line, "c").collect())
    want, steps = {}, []
    for k, items in by_key(data).items():
        n, last, tool, step = 0, None, None, 0
        for r in items:
            n += last is None or r[1] - last >= 2
            want[r[2]], last = n, r[1]
            if r[4] != tool:
                step, tool = step + 1, r[4]
                steps.append((repr(k), step, r[2]))
    assert got == want and chain == sorted(steps)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("rows", [1, 3, 12])
@pytest.mark.parametrize("values", [2, 40])
def test_kept_lookback_matches_a_plain_loop(frame, data, rows, values, spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    line = Timeline(("k",), ("t", "id"))
    given = frame.withColumn("m", F.col("id") * 7 % values)
    got = {r.id: r.repeat for r in memory.kept_lookback(given, line, ["m"], rows).collect()}
    want = {}
    for items in by_key(data).values():
        kept = []
        for r in items:
            want[r[2]] = (value := r[2] * 7 % values) in kept
            if not want[r[2]]:
                kept = [*kept, value][-rows:]
    assert got == want
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_group_limit_is_planned(frame):
    plan = top_rows(frame, ["k"], [F.col("t"), F.col("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("width", [1, 40, 100000, None])
def test_collector_matches_a_plain_loop(spark, width):
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.7 else f"u{rng.randrange(6)}", rng.randrange(0, 4000), i, rng.randrange(0, 60)) for i in range(900)]
    df = spark.createDataFrame(data, "k string, s int, id int, tok int").withColumn("ts", F.timestamp_seconds("s"))
    line = Timeline(("k",), ("ts", "id"), width and f"floor(unix_seconds(ts) / {width})")
    got = {r["id"]: r["batch"] for r in rounds.collected_batches(df, line, F.col("tok"), 100, 90 * 1_000_000).collect()}
    want, keys = {}, {}
    for r in sorted(data, key=lambda r: (r[1], r[2])):
        keys.setdefault(r[0], []).append(r)
    for items in keys.values():
        batch, n, used, since = 1, 0, 0, items[0][1]
        for _, s, i, tok in items:
            n, used = n + 1, used + tok
            want[i] = batch
            if n >= 3 or used >= 100 or s - since > 90:
                batch, n, used, since = batch + 1, 0, 0, s
    assert got == want


def test_confidence_matches_a_plain_loop(spark):
    rng = random.Random(5)
    data = [(rng.choice("ab"), rng.randrange(0, 20000), i, rng.random() < 0.6) for i in range(500)]
    df = spark.createDataFrame(data, "k string, s int, id int, up boolean").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["k"]: (r["confidence"], r["ups"], r["downs"]) for r in memory.confidence_steps(df, ["k"], "ts", ["ts", "id"], F.col("up"), ~F.col("up")).collect()}
    want = {}
    for k in "ab":
        c, ups, downs = 50, 0, 0
        for r in sorted((r for r in data if r[0] == k), key=lambda r: (r[1], r[2])):
            c = min(100, c + 5) if r[3] else max(0, c - 10)
            ups, downs = ups + r[3], downs + (not r[3])
        want[k] = (c, ups, downs)
    assert got == want


def test_interval_conflicts_match_all_pairs(spark):
    rng = random.Random(9)
    data = [(rng.choice("ab"), (a := rng.randrange(0, 3000)), i, a + rng.randrange(1, 12)) for i in range(300)]
    df = spark.createDataFrame(data, "k string, a long, id int, z long")
    line = Timeline(("k",), ("a", "id"), "floor(a / 50)")
    got = {r["id"]: r["overlaps"] for r in structure.interval_conflicts(df, line, "a", "z").collect()}
    want = {
        r[2]: any(o[2] != r[2] and o[0] == r[0] and o[1] < r[3] and r[1] < o[3] for o in data) for r in data
    }
    assert got == want
