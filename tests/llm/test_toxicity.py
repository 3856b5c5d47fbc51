import random
import zlib

import numpy as np
import pytest

from quire.llm import toxicity as tx
from quire.llm.toxicity import AIMED, BONUS, FACTOR, NEGATED, PAIR, REPORTED, THREAT, G, I, Lexicon, N, Q, R, Reader, Scale, T, toxicity


def plain_clause(symbols, weights):
    """The rules one after the other, each over the whole clause."""
    out = list(symbols)
    for i, a in enumerate(symbols):  # negation reaches three words
        if a in (I, T) and any(symbols[j] == N for j in range(max(0, i - 3), i)):
            out[i] = NEGATED
    inside, left = False, 0
    for i, a in enumerate(symbols):  # reported speech: eight words, or quote marks
        if a == Q:
            inside, left = not inside, 0
        elif inside:
            out[i] = REPORTED if out[i] in (I, T) else out[i]
        else:
            if left and out[i] in (I, T):
                out[i] = REPORTED
            left = 8 if a == R else max(0, left - 1)
    state = ("none", 0)
    for i, a in enumerate(out):  # targets
        kind, n = state
        if a == G:
            out[i] = PAIR if kind == "insult" else G
            state = ("target", 4)
        elif a == I:
            out[i] = AIMED if kind == "target" else I
            state = ("insult", 3)
        else:
            state = (kind, n - 1) if n > 1 else ("none", 0)
    left = 0
    for i, a in enumerate(out):  # threats
        if a == T:
            left = 3
        elif a == G:
            out[i], left = (THREAT if left else G), 0
        else:
            left = max(0, left - 1)
    return sum(FACTOR.get(a, 0) * w + BONUS.get(a, 0) for a, w in zip(out, weights))


def test_composed_machine_is_the_rules_in_turn():
    reader, rng = Reader(Lexicon({}, {})), random.Random(2)
    for _ in range(3000):
        symbols = [rng.choice([0, 0, N, R, Q, G, G, I, I, T]) for _ in range(rng.randrange(1, 25))]
        weights = [rng.random() if s in (I, T) else 0.0 for s in symbols]
        assert reader.clause(list(zip(symbols, weights)))[0] == pytest.approx(plain_clause(symbols, weights))


def test_clauses():
    reader = Reader(Lexicon({}, dict.fromkeys(tx.INSULTS, 3.0)))
    total = lambda text: np.expm1(reader.features(text)[0])
    assert total("nothing here at all") == 0 and total("") == 0
    assert total("a stupid thing") == pytest.approx(3.0)
    assert total("You are an IDIOT") > total("an idiot") > total('he wrote "idiot" there') > total("not an idiot") > 0
    assert total("I will kill you.") > total("They kill time")
    assert total("you are. An idiot") == pytest.approx(3.0)  # a clause ends at its mark
    assert total("1d10t") == total("idiooooot") == total("idiot")
    long = "word, " * 400_000 + "you idiot"  # longer than a piece
    assert total(long) == pytest.approx(total("you idiot"))


def test_newton_steps_reach_the_gradient_of_zero():
    r = np.random.default_rng(3)
    x = r.normal(size=(400, tx.FEATURES))
    y = (x[:, 0] + r.normal(size=400) > 0.5).astype(float)
    w = r.uniform(0.5, 2, 400)
    s = Scale().fit(x, y, w)
    z = np.column_stack([np.ones(400), (x - s.mean) / s.spread])
    pull = np.append(1e-6, np.ones(tx.FEATURES)) * s.beta
    assert np.abs(z.T @ (w * (y - s.score(x))) - pull).max() < 1e-6


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_labels(spark):
    rng = random.Random(7)
    clean = [a + b for a in ("ba", "lo", "mi", "tu", "re") for b in ("na", "ko", "", "si", "da")]
    bad = ["zugmi", "zugna", "zugsida", "zugkoko", "vrax"]
    rows = []
    for i in range(1500):
        words = [rng.choice(clean) for _ in range(rng.randrange(10, 60))]
        toxic = i % 6 == 0
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), toxic))
    extra = [(5000, None), (5001, ""), (None, "zugmi vrax"), (5002, rows[0][1]), (0, rows[0][1]), (5003, "Ba na. " * 300_000)]
    docs = spark.createDataFrame([(i, t, 0.5, "x") for i, t, _ in rows] + [(i, t, 0.1, "y") for i, t in extra], "doc_id long, text string, score double, toxic string")
    labels = spark.createDataFrame([(i, int(y), 1) for i, _, y in rows] + [(3, 0, 1), (None, 1, 1), (7, None, 1), (9999, 1, 0)], "doc_id long, toxic int, held_out int")
    got = toxicity(docs, labels).collect()
    assert len(got) == len(rows) + len(extra)
    by = {r.doc_id: r for r in got}
    unseen = [i for i, _, _ in rows if held(i)]
    assert all(by[i].held_out == held(i) for i, _, _ in rows) and by[None].held_out
    assert sum(by[i].predicted == rows[i][2] for i in unseen) / len(unseen) > 0.98
    assert by[5000].score == by[5001].score and by[5000].predicted == 0 and by[5003].predicted == 0
    assert by[5002].score == by[0].score and all(0 <= r.score <= 1 for r in got)
    again = {r.doc_id: r.score for r in toxicity(docs.repartition(3), labels).collect()}
    assert all(again[r.doc_id] == r.score for r in got)
    few = toxicity(docs, labels, sample={1: 60, 0: 200}).where("not held_out").count()
    assert few == sum(not held(i) for i, _, _ in rows) + sum(not held(i) for i, _ in extra if i is not None)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (2, "a tree")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    by = {r.doc_id: r for r in toxicity(docs, labels).collect()}
    assert by[1].predicted == 1 and by[2].score == 0
    assert toxicity(docs.where("false"), labels).count() == 0
