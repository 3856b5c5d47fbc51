import random

import public_tokenizers
import pytest
import tiktoken

from quire.llm import byte_bpe
from quire.llm.byte_bpe import Codec, merge_table, read_ranks, tokenized
from tests.llm.helpers import sha

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(PATH)


@pytest.fixture(scope="module")
def real(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(9)
    out = ["", " ", "a", "\n\n  \t x", "I'll we've 12345 é ü 日本語 \U0001F600!!", "<|endoftext|>", "a" * 700, "ab" * 600, "xyz" * 100 + " " * 900, "\0\x7fÿ", "é" * 300]
    for _ in range(60):
        out.append("".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 600), 32, 97, 101])) for _ in range(rng.randrange(300))))
    out.append("".join(rng.choice("abcdefghijklmnop") for _ in range(3000)))
    return out


def test_like_the_library(ranks, real, monkeypatch):
    monkeypatch.setattr(byte_bpe, "QUERY_BYTES", 200)
    monkeypatch.setattr(byte_bpe, "DECODE_TOKENS", 50)
    monkeypatch.setattr(byte_bpe, "KNOWN_WORDS", 30)
    codec = Codec(ranks, merge_table(ranks), public_tokenizers.PATTERN)
    given = texts()
    ids = codec.encode(given)
    assert [x.tolist() for x in ids] == [real.encode_ordinary(t) for t in given]
    assert codec.decode(ids) == [t.encode() for t in given]


def test_table(spark, real):
    given = texts() + [None]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(given)] + [(0, "a", "x"), (None, "b", "x")], "doc_id long, text string, ids string")
    got = tokenized(docs.repartition(3), PATH, public_tokenizers.PATTERN).collect()
    assert len(got) == len(given) + 2
    for r in got:
        t = given[r.doc_id] if r.doc_id is not None else "b"
        if r.doc_id == 0 and r.n_tokens:
            t = "a"
        ids = real.encode_ordinary(t or "")
        assert r.ids == ids and r.n_tokens == len(ids) and r.exact
        assert r.ids_sha256 == sha(",".join(map(str, ids)).encode()) and r.decoded_sha256 == sha((t or "").encode())
    assert tokenized(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
