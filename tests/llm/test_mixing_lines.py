from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quire.llm.line_rules import line_rules, measure, repeated_words, without_common_lines
from quire.llm.mixing import mix_rates, mix_sources, source_targets
from tests.llm.helpers import words


def shares(sizes, share=1.5, cap=2.0, weights=(5, 2, 1)):
    names = sorted((k for k in sizes if k is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        level = left / sum(w[n] for n in free)
        over = [n for n in free if w[n] * level > cap * sizes[n]]
        if not over:
            return target | {n: w[n] * level for n in free}
        for n in over:
            target[n] = cap * sizes[n]
            left -= target[n]
            free.discard(n)
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 10, "c": 10}, {"a": 1000, "b": 1, "c": 5, "d": 7, None: 3}, {"x": 0}, {"a": 0, "b": 4}, {"a": 5},
    {f"s{i}": (i * 37) % 11 for i in range(30)}, {"\U0001F600": 5, "�": 9, "z": 1},
])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    assert got == pytest.approx(shares(sizes))


def test_mix(spark):
    rows = [(i, "w " * (i % 9), "en", f"s{i % 3}" if i % 7 else None, 1) for i in range(600)] + [(5, None, None, "s1", None), (None, "a b", "en", "s0", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumnRenamed("n_chars", "size")
    rated = mix_rates(docs).select("doc_id", "source", "mix.*").collect()
    assert len(rated) == len(rows)
    for r in rated:
        rate = r.target / r.source_size
        assert r.n_copies in (int(rate), int(rate) + 1) and r.n_copies <= 2
    total = defaultdict(int)
    for r in rated:
        total[r.source] += r.size * r.n_copies
    for r in rated:
        assert total[r.source] == pytest.approx(r.target, rel=0.15)
    clash = docs.withColumns({c: F.lit("own") for c in ("target", "source_size", "mix", "n_copies", "weight")})
    mixed = mix_sources(clash)
    assert mixed.columns == clash.columns
    want = Counter({r.doc_id: 0 for r in rated})
    for r in rated:
        want[r.doc_id] += r.n_copies
    assert Counter(r.doc_id for r in mixed.repartition(7).collect()) == +want


def test_mix_empty(spark):
    assert mix_rates(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def plain_repeat(ws):
    at = defaultdict(list)
    for i in range(len(ws) - 4):
        at[tuple(ws[i : i + 5])].append(i)
    return len({i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)})


TEXTS = ["", "a", "a b c d e a b c d e x", "x " * 40, "one\ntwo\none\n \n \none ", "pé # $ | q\n\n", "\x1c a b\x0bc",
         " ".join(str((i * i) % 61) for i in range(5000)), "a b c d e f " * 3 + "g h"]


@pytest.mark.parametrize("text", TEXTS)
def test_measure(text):
    got = measure(text.encode())
    ws = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    assert got[:5] == (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), plain_repeat(ws))


def test_wide_vocabulary():
    ws = [str(i % 9000).encode() for i in range(20000)]
    assert repeated_words(ws) == plain_repeat(ws)


def test_line_rules(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, f"{good} {i}\nCookie  NOTICE here", "h") for i in range(8)]
    rows += [(100 + i, "cookie notice here\nfew words are left now in this one small text ok", "h") for i in range(4)]
    rows += [(200, "cookie notice here\n" * 2 + good, "other"), (201, None, "h"), (None, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("host", F.lit(1))
    got = {r.doc_id: r for r in line_rules(docs, doc_limit=5, min_words=12).collect()}
    assert len(got) == len(rows)
    assert all(got[i].kept and got[i].removed_words == 3 for i in range(8))
    assert all(not got[100 + i].kept and not got[100 + i].base_failed for i in range(4))
    assert got[200].removed_words == 0 and got[200].kept and got[200].n_dup_lines == 1
    assert got[201].base_failed and got[None].base_failed
    texts = {r.doc_id: r.text for r in without_common_lines(docs, 5).collect()}
    assert texts[0] == f"{good} 0" and texts[200] == rows[12][1] and texts[201] is None
    assert line_rules(docs.limit(0)).count() == 0
