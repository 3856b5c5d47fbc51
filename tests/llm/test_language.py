import random
import zlib

import numpy as np

from quire.llm import language
from quire.llm.language import ORDERS, calibrate, counts, fit_ftrl, gram_buckets, language_ids

FOLDER = "/root/testdata/sf0.001"


def test_counts(monkeypatch):
    text = "Ein Satz mit Ümlauten. " * 30 + "\U0001F600x"
    want = np.zeros(language.BUCKETS, np.int64)
    chars = np.array([ord(c) for c in text.lower()], np.uint32)
    for n in ORDERS:
        want += np.bincount(gram_buckets(chars, n), minlength=language.BUCKETS)
    assert (counts(text) == want).all()
    monkeypatch.setattr(language, "CHUNK", 7)
    assert (counts(text) == want).all() and counts("").sum() == 0 and counts("a").sum() == 1


def test_ftrl_is_sparse_and_calibrated():
    rng = np.random.default_rng(1)
    x = np.abs(rng.normal(size=(400, 60)))
    y = (x[:, 0] > x[:, 1]).astype(int)
    w = fit_ftrl(x, y, 2, l1=1.0)
    assert (np.argmax(x @ w, 1) == y).mean() > 0.9
    assert (fit_ftrl(x, y, 2, l1=0.0) == 0).mean() < (w == 0).mean() < (fit_ftrl(x, y, 2, l1=8.0) == 0).mean()
    t = calibrate(np.column_stack([x[:, 1], x[:, 0]]) * 9, np.where(rng.random(400) < 0.2, 1 - y, y))
    assert t > 2


def test_languages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame([(10**9, None, "en", "x", 1), (None, "123 !!", None, "y", 2), (10**9 + 1, "", "xx", None, 1), (10**9 + 3, "ß", "de", "z", 1)], docs.schema)
    got = language_ids(docs.unionByName(odd)).collect()
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert len(got) == len(truth) + 4
    by = {r.doc_id: r for r in got}
    for i in (10**9, None, 10**9 + 1):
        assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
    assert by[10**9 + 3].lang_pred in set(truth.values())
    for r in got:
        assert 0 <= r.score <= 1
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    own = [truth[r.doc_id] == r.lang_pred for r in got if r.doc_id in truth and r.held_out]
    assert np.mean(own) >= 0.95
    assert language_ids(docs.limit(0)).count() == 0


def test_sparse_rows_fit_like_dense_ones():
    rng = np.random.default_rng(2)
    x = np.where(rng.random((80, 30)) < 0.2, rng.random((80, 30)), 0.0)
    y = (x[:, 0] > x[:, 1]).astype(int)
    rows = [(np.flatnonzero(r), r[np.flatnonzero(r)]) for r in x]
    assert (language.fit_sparse(rows, y, 2, 30) == fit_ftrl(x, y, 2)).all()
    tallies = np.zeros(language.BUCKETS)
    tallies[[3, 9]] = 2, 5
    model = language.Model(["a"], np.linspace(1, 2, language.BUCKETS), np.zeros((language.BUCKETS, 1)), np.zeros(1))
    on, v = language.sparse(model, np.array([3, 9], "<u2").tobytes(), np.array([2, 5], "<i4").tobytes())
    assert on.tolist() == [3, 9, language.BUCKETS] and (v[:2] == model.features(tallies)[[3, 9]]).all() and v[2] == 1
