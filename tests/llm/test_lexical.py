import math
import random
import re
from collections import Counter

import numpy as np

from quire.llm.lexical import Chunk, best_rows, masks, ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    """Every item against every document."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    N = sum(1 for _, c in counts if c)
    L = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            if not c:
                continue
            m = 25 + (75 * sum(c.values()) * N) // L
            s = sum(n * math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, n in Counter(terms(text)).items() if c[t])
            if s > 0:
                scored.append((-s, i if i is not None else -1))
        out += [(item, r, i if i != -1 else None, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def table(spark, docs):
    return spark.createDataFrame([(i, t, 7, "x") for i, t in docs], "doc_id long, text string, item int, score string")


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_against_every_pair(spark):
    rng = random.Random(5)
    vocabulary = ["The", "a", "été", "x9", "ΩΑ", "no", "zeta", "b-c", "q_r"] + [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choice(vocabulary[: rng.randrange(3, 69)]) for _ in range(rng.randrange(1, 40)))) for i in range(400)]
    docs += [(1000 + i, docs[3][1]) for i in range(30)]  # ties by doc_id
    docs += [(2000, None), (2001, ""), (2002, " ,;- "), (3, docs[3][1]), (None, "zeta zeta été")]
    docs += [(2003, "zeta " * 300_000 + "été")]  # longer than a piece
    items = [(i, docs[i * 7][1]) for i in range(20)] + [(50, "zeta zeta the"), (51, None), (52, "--"), (53, "unknownword"), (50, "été")]
    items.append((60, " ".join(f"w{i} x{i}" for i in range(90)) + " the a"))  # more terms than a mask word has bits
    given = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    want = plain(docs, items)
    assert found(ranked(table(spark, docs).repartition(5), given)) == want
    assert found(ranked(table(spark, docs), given, block_terms=40)) == want
    assert found(ranked(table(spark, docs), given, k=3)) == plain(docs, items, 3)


def test_empty_tables(spark):
    docs, items = table(spark, [(1, "a b")]), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked(docs.where("false"), items).count() == 0
    assert ranked(docs, items.where("false")).count() == 0
    assert found(ranked(docs, items)) == plain([(1, "a b")], [(1, "a")])


def test_masks_and_early_end():
    on, bits, group = masks(6, [np.array([0, 2, 4]), np.array([2, 3, 4])])
    assert on.tolist() == [0, 2, 3, 4] and bits[group].tolist() == [[True, False], [True, True], [False, True], [True, True]]
    rng = np.random.default_rng(1)
    n, size = rng.integers(1, 50, 3000), 80
    held = [np.sort(rng.choice(size, rng.integers(0, 12), replace=False)) for _ in n]
    tfs = [rng.integers(1, 5, len(h)) for h in held]
    chunk = Chunk(n, [len(h) for h in held], np.concatenate(held), np.concatenate(tfs), 3000, int(n.sum()))
    query = [(t, int(w)) for t, w in zip(range(0, 80, 3), rng.integers(0, 9000, 27))]
    m = 25 + 75 * n * 3000 // n.sum()
    whole = [sum(w * (10**9 * int(f) // (1000 * int(f) + 8 * int(m[i]))) for t, w in query for f in tfs[i][held[i] == t]) for i in range(3000)]
    rows, scores = best_rows(chunk, query, 10, np.arange(3000))
    want = sorted(((-s, i) for i, s in enumerate(whole)))[:10]
    assert sorted(zip((-scores).tolist(), rows.tolist())) == want
