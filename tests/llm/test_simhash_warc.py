import gzip
import random

import numpy as np
import pytest

from quire.llm.common import components, written
from quire.llm.simhash import fingerprint, links, near_duplicates, without_near_duplicates
from quire.llm.warc import parse_at, reachable, read_archives, resolved, write_archives
from tests.llm.helpers import roots, sha, simhash


def test_fingerprint():
    rng = random.Random(1)
    texts = ["", " \n", "One", "one TWO", "É b c", "a b c\x0bd e"] + [" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (3, 4, 50, 70000)]
    for t in texts:
        assert fingerprint(t.encode()) == simhash(t)


def test_links(spark):
    rng = random.Random(2)
    points = [rng.getrandbits(64) for _ in range(40)]
    for p in points[:30]:
        for k in (1, 2, 3, 4):
            x = p
            for b in rng.sample(range(64), k):
                x ^= 1 << b
            points.append(x)
    points = sorted({p - (1 << 64) if p >> 63 else p for p in points + [0, 1, (1 << 64) - 1]})
    want = {(a, b) for a in points for b in points if a < b and bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 3}
    got = [tuple(r) for r in links(spark.createDataFrame([(p,) for p in points], "fp long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_near_duplicates(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghijk") * 2 + str(rng.randrange(50)) for _ in range(300)) for _ in range(6)]
    texts = base + base[:2] * 20 + [b.replace("1", "2", 3) for b in base] + [None, "", "  "]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(0, texts[0], "x", "y"), (None, "", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id string")
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fps = {i: simhash(t) for i, t in enumerate(texts)}
    pairs = [(a, b) for a in fps for b in fps if a < b and bin(fps[a] ^ fps[b]).count("1") <= 3]
    want = roots(fps, pairs)
    for r in got:
        if r.doc_id is not None:
            assert (r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", want[r.doc_id])
    kept = without_near_duplicates(docs)
    assert kept.columns == docs.columns
    # The repeated row (same id, same text) stays once.
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want.values()))
    assert near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    ids = list(range(400))
    pairs = [(i, i + 1) for i in range(150)] + [(200, i) for i in range(201, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = roots(ids, pairs)
    linked = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {i: want[i] for i in linked}


def test_reachable():
    at = np.array([0, 10, 13, 20, 30])
    assert reachable(at, np.array([10, 20, 20, 30, 40])).tolist() == [True, True, False, True, True]
    long = np.arange(0, 5000, 5)
    assert reachable(long, long + 5).all()
    assert reachable(np.array([3]), np.array([9])).tolist() == [False]
    assert reachable(np.array([], int), np.array([], int)).tolist() == []


def test_parse():
    rec = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert parse_at(rec, 0)[0] == len(rec)
    assert parse_at(rec.replace(b": 3", b": 4"), 0) is None
    assert parse_at(rec.replace(b": 3", b": x"), 0) is None


def test_round_trip(spark):
    inner = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    big = "<p>" + "x" * 120
    rows = [(1, "u\r\nX-Page-Id: 9", big), (2, None, big), (0, "v%0A", "short"), (3, "w", "short"), (4, "t", None), (5, "t", ""),
            (6, "m", inner * 3), (7, "m", "a" + inner), (8, "é", "é" * 60), (None, "n", big), (9, "l", "z" * 300000), (2, None, big), (11, "m", inner * 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = write_archives(pages)
    records = read_archives(spark, path)
    assert records.count() == len(rows)
    got = resolved(records).collect()
    assert all(r.verified for r in got)
    for i, u, h in rows:
        data = (h or "").encode()
        same = [p for p, _, t in rows if (t or "").encode() == data and p is not None]
        again = len(data) >= 100 and i != min(same)
        hits = [r for r in got if r.page_id == i and r.payload_digest == sha(data)]
        assert hits and all((r.payload_bytes, r.record_type, r.refers_to, r.url) == (len(data), "revisit" if again else "response", min(same) if again else None, u) for r in hits)
    assert resolved(read_archives(spark, write_archives(pages.limit(0)))).count() == 0


def test_long_url(spark):
    urls = ["u", "data:," + "%" * 25_000, "data:," + "x" * 65_536 + "\n", "v" * 300_000, "w"]
    same = "<p>" + "y" * 200
    rows = [(i, u, same if i % 3 == 0 else f"page {i}") for i, u in enumerate(urls * 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: r for r in resolved(read_archives(spark, write_archives(pages))).collect()}
    assert len(got) == len(rows) and all(r.verified for r in got.values())
    for i, u, h in rows:
        assert (got[i].url, got[i].payload_digest, got[i].payload_bytes) == (u, sha(h.encode()), len(h))


def test_broken_chain(spark, tmp_path):
    rec = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    for i, data in enumerate((rec + b"lost", rec + rec.replace(b": 3", b": 4") + rec, b"lost" + rec)):
        path = tmp_path / str(i)
        path.mkdir()
        (path / "a.gz").write_bytes(gzip.compress(data))
        with pytest.raises(Exception, match="records end at byte|no record at the start"):
            read_archives(spark, str(path)).collect()
