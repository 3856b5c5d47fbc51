import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import passages
from quire.llm.passages import Network, encode, good_documents, groups, quality, scorer

FOLDER = "/root/testdata/sf0.001"


def test_gradients():
    """The written gradients against finite differences."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(9, passages.WIDTH)).astype(np.float32)
    bags, y = np.array([0, 0, 0, 1, 1, 2, 2, 2, 2]), np.array([1, 0, 1], np.float32)
    net = Network()
    grads = net.step(x, bags, y)

    def loss():
        _, total, z = net.parts(x, bags, 3)
        p = net.score(z / total[:, None])
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for k, a in net.p.items():
        net.p[k] = a.astype(np.float64)
    for k in net.p:
        at = tuple(rng.integers(s) for s in net.p[k].shape)
        net.p[k][at] += 1e-5
        up = loss()
        net.p[k][at] -= 2e-5
        down = loss()
        net.p[k][at] += 1e-5
        assert (up - down) / 2e-5 == pytest.approx(float(grads[k][at]), rel=0.02, abs=2e-4)


def test_encoding(monkeypatch):
    rng = random.Random(3)
    bodies = [" ".join(rng.choice(["aa", "Bb", "c!!", "é"]) for _ in range(n)).encode() for n in (0, 1, 95, 96, 97, 500)] + [b" \n", b"x" * 3000]
    x, bags = encode(bodies)
    assert np.bincount(bags).tolist() == [1, 1, 1, 1, 2, 6, 1, 1]
    for i, b in enumerate(bodies):
        alone, _ = encode([b])
        assert np.allclose(alone, x[bags == i], atol=1e-6)
    whole = scorer(Network())(bodies)
    monkeypatch.setattr(passages, "CHUNK", 96 * 5)
    parts = list(groups(bodies))
    assert b"".join(b for g in parts for _, b in g) == b"".join(bodies) and len(parts) > 5
    assert np.isfinite(scorer(Network())(bodies)).all() and len(whole) == len(bodies)


def test_quality(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    odd = spark.createDataFrame([(10**9, None, "x", None, 1), (None, "", None, "y", 2), (10**9, None, "x", None, 1)], docs.schema)
    got = quality(docs.unionByName(odd), labels).collect()
    assert len(got) == docs.count() + 3
    truth = {r.doc_id: r.quality for r in labels.collect()}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    for out in (True, False):
        own = [r for r in got if r.held_out == out and r.doc_id in truth]
        assert np.mean([truth[r.doc_id] == r.predicted for r in own]) >= 0.95
    again = {(r.doc_id, r.score) for r in quality(docs.repartition(5), labels).collect()}
    assert all((r.doc_id, pytest.approx(r.score, abs=1e-9)) for r in got) and len(again) == docs.count()
    assert quality(docs, labels.limit(0)).first().score == 0.5
    clash = docs.withColumns({c: F.lit(1) for c in ("score", "predicted", "row", "body", "quality_score", "held_out")})
    assert good_documents(clash, labels).columns == clash.columns
    assert good_documents(docs.limit(0), labels).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    now, counts = docs, [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, FOLDER).cache()
        if i < 4:
            assert out.columns == docs.columns, name
        counts.append(out.count())
        if name == "simhash_near_dedup":
            assert out.select("doc_id").distinct().count() == out.count()
        if name == "personal_data":
            assert out.count() == now.count()
        if name == "byte_bpe":
            enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=corpus_pipeline.tokenized.__globals__["read_ranks"](public_tokenizers.path(corpus_pipeline.VOCABULARY)), special_tokens={})
            texts = {r.doc_id: r.text for r in now.collect()}
            for r in out.collect():
                assert r.exact and r.ids == enc.encode_ordinary(texts[r.doc_id] or "")
        now = out
    assert counts[0] > counts[1] > counts[2] == counts[3]
    final = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(str, final.select("doc_id", "ids_sha256").collect())) == sorted(map(str, now.select("doc_id", "ids_sha256").collect()))
