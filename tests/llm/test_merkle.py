import random
import zlib
from itertools import groupby

import pytest

from quire.llm import merkle
from tests.llm.helpers import sha

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string, pos string, node long"


def h(*parts):
    return sha("".join(parts).encode())


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def up(nodes):
    """Levels of one tree."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def path(tree, at):
    out = []
    for nodes in tree[:-1]:
        lo = at // 16 * 16
        out.append((nodes[lo:at], nodes[at + 1 : lo + 16]))
        at //= 16
    return out


def plain(rows):
    """The whole manifest on plain lists."""
    key = lambda r: (r[1] is not None, (r[1] or "").encode())
    trees = []
    for _, own in groupby(sorted(rows, key=key), key=key):
        own = [(h(*map(field, r[:5])), r) for r in own]
        own.sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        trees.append((own, up([x[0] for x in own])))
    top = up([t[-1][0] for _, t in trees])
    out = []
    for k, (own, tree) in enumerate(trees):
        for i, (leaf, r) in enumerate(own):
            steps = path(tree, i) + path(top, k)
            now = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = None if r[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
                now = h(*map(field, (*r[:4], text)))
            for a, b in steps:
                now = h(*a, now, *b)
            root = top[-1][0]
            out.append((r[0], leaf, tree[-1][0], root, h(*[x for a, b in steps for x in a + b]), now, now == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("span", [1, 3])
def test_against_plain_trees(spark, span, monkeypatch):
    monkeypatch.setattr(merkle, "SPAN", span)
    rng = random.Random(span)
    names = [None, "", "hot", "Z", "a", "\U0001F600", "�"] + [f"s{i}" for i in range(16 if span == 3 else 300)]
    rows = [(i, "hot" if rng.random() < 0.4 else rng.choice(names), rng.choice([None, "en"]), rng.choice([None, 5, -3]), rng.choice(["Ab é", "", None, "low", "X" * 100_000]), "p", 1) for i in range(1500)]
    rows += [rows[7], rows[7], (rows[8][0], *rows[9][1:]), (None, "hot", "en", 3, "NULL id", "p", 2), (None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(7)
    got = merkle.manifest(docs).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows)
    assert {r.verified for r in got} == {True, False}


def test_single_document_and_empty_table(spark):
    docs = spark.createDataFrame([(5, "a", "en", 1, "T", None, None)], COLUMNS)
    (r,) = merkle.manifest(docs).collect()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == sha(b"")
    assert merkle.manifest(docs.where("false")).count() == 0
    assert sorted(tuple(r) for r in merkle.manifest(docs).collect()) == plain([(5, "a", "en", 1, "T")])
