import random

import pytest

from quire.llm import suffix_index
from quire.llm.suffix_index import without_repeats
from tests.llm.helpers import sha


def plain(texts):
    """texts: bytes in order. Per text: (removed bytes, runs, digest of the rest)."""
    seen, out = set(), []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - 99):
            w = t[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(w)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(t), sum(gone), runs, sha(bytes(c for c, g in zip(t, gone) if not g))))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    syll = ["the", "an", "é", "tion", " ", " ", "ou", "ß", "in", ".\n"]
    make = lambda k: "".join(rng.choice(syll) for _ in range(k))
    passages = [make(k) for k in (30, 38, 45, 60, 90, 300)]
    texts = []
    for _ in range(n):
        t = make(rng.randrange(0, 300))
        for _ in range(rng.randrange(3)):
            t += rng.choice(passages) + make(rng.randrange(0, 30))
        if texts and rng.random() < 0.4:
            old = rng.choice(texts)
            cut = rng.randrange(len(old) + 1)
            t = old[:cut] + rng.choice(["", "X"]) + old[cut:]
        texts.append(t)
    return texts + ["", "a" * 99, "a" * 100, "a" * 101, "ab" * 400, "Heat " * 200, make(400) * 3, "b" * 1000]


def check(spark, texts, batches=4):
    rows = [(i * 3, t, "k") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, uid string").repartition(5)
    got = {r.doc_id: r for r in without_repeats(docs, batches).collect()}
    want = plain([(t or "").encode() for t in texts])
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        r = got[i * 3]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == w, i
        assert sha(r.kept) == w[3]


def test_random(spark):
    check(spark, corpus(1))


def test_small_chunks_and_groups(spark, monkeypatch):
    """Long texts cut into pieces, and groups too large for a task."""
    monkeypatch.setattr(suffix_index, "CHUNK", 300)
    monkeypatch.setattr(suffix_index, "GROUP_ROWS", 3)
    monkeypatch.setattr(suffix_index, "TABLES", [])
    check(spark, corpus(2), 3)
    check(spark, corpus(3), 1)


def test_common_line(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    line = " ".join(word() for _ in range(25))
    texts = [" ".join([word() for _ in range(20)] + [line[: rng.randrange(60, len(line))]] + [word() for _ in range(20)]) for _ in range(120)]
    check(spark, texts)


@pytest.mark.parametrize("rows", [
    [], [(None, None)], [(1, None), (1, "x" * 150), (1, "x" * 150), (None, "x" * 120), (0, "y")],
])
def test_odd_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed) for r in without_repeats(docs).collect())
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = plain([(t or "").encode() for _, t in order])
    assert got == sorted((i is None, i or 0, w[0], w[1]) for (i, _), w in zip(order, want))
