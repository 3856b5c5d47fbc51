"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams,
trained by follow-the-regularised-leader with elastic-net penalties, then temperature scaled."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import cut, held_out, release

BUCKETS = 1 << 13
ORDERS = (1, 2, 3)
SAMPLE_PER_LANG = 600  # learning texts of one language; document frequencies use all of them
CHUNK = 1 << 17  # characters counted at a time
LETTER = regex.compile(r"\p{L}")
U = np.uint64


def gram_buckets(chars: np.ndarray, order: int) -> np.ndarray:
    code = chars[: len(chars) - order + 1].astype(np.uint64)
    for k in range(1, order):
        code = code * U(0x100000001B3) + chars[k : len(chars) - order + 1 + k]
    code = (code + U(order)) * U(0x9E3779B97F4A7C15)
    return (code >> U(64 - 13)).astype(np.int64)


def counts(text: str) -> np.ndarray:
    """Hashed counts of the character n-grams of a whole text, lower case."""
    out = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(text), CHUNK):
        # Chunks overlap so that every n-gram is counted once.
        part = text[at : at + CHUNK + max(ORDERS) - 1].lower()
        chars = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")
        for n in ORDERS:
            stop = min(len(chars), CHUNK + n - 1) if at + CHUNK < len(text) else len(chars)
            if stop >= n:
                out += np.bincount(gram_buckets(chars[:stop], n), minlength=BUCKETS)
    return out


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (buckets, languages)
    bias: np.ndarray
    temperature: float = 1.0

    def features(self, tallies: np.ndarray) -> np.ndarray:
        x = np.log1p(tallies) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)

    def chances(self, tallies: np.ndarray) -> np.ndarray:
        z = (self.features(tallies) @ self.weights + self.bias) / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def document_frequencies(learn: DataFrame) -> tuple[np.ndarray, int]:
    """In how many learning texts each bucket occurs, over all of them; one row per task and
    bucket is shuffled. The last bucket number counts the texts."""

    def run(batches):
        seen = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for x in batch.column("text"):
                seen[:BUCKETS] += counts(x.as_py()) > 0
                seen[BUCKETS] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen)), pa.array(seen[seen > 0])], ["bucket", "n"])

    rows = learn.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS + 1, np.int64)
    for r in rows:  # one row per bucket
        out[r.bucket] = r.n
    return out[:BUCKETS], int(out[BUCKETS])


def sparse(model: Model, bucket: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The features of one text that are not zero, with the bias as the last: places, values."""
    on = np.frombuffer(bucket, "<u2").astype(np.int64)
    tallies = np.zeros(BUCKETS)
    tallies[on] = np.frombuffer(n, "<i4")
    return np.append(on, BUCKETS), np.append(model.features(tallies)[on], 1.0)


def fit_ftrl(x: np.ndarray, y: np.ndarray, n_classes: int, **rates) -> np.ndarray:
    """``fit_sparse`` for a dense matrix."""
    return fit_sparse([(on := np.flatnonzero(r), r[on]) for r in x], y, n_classes, x.shape[1], **rates)


def fit_sparse(
    x: Sequence[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_classes: int, width: int, alpha=2.0, beta=1.0, l1=0.02, l2=0.1, epochs=4, seed=3
) -> np.ndarray:
    """Per-coordinate FTRL-proximal for the softmax loss over rows of (places, values); the last
    feature is the bias."""
    rng = np.random.default_rng(seed)
    z, n = np.zeros((width, n_classes)), np.zeros((width, n_classes))

    def solve(zi, ni):
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            on, v = x[i]
            w = solve(z[on], n[on])
            s = v @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = v[:, None] * p[None, :]
            grown = n[on] + g * g
            z[on] += g - (np.sqrt(grown) - np.sqrt(n[on])) / alpha * w
            n[on] = grown
    return solve(z, n)


def calibrate(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search on its logarithm."""

    def loss(t):
        s = scores / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    a, b, g = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> Model | None:
    """Learn from rows with text and lang that are not held out. The classifier sees at most
    ``per_lang`` texts per language, the first by hash of the id; none: no model."""
    learn = docs.where(~held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    df, total = document_frequencies(learn)
    if not total:
        return None
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = learn.select("doc_id", "lang").withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_lang).drop("n")
    ids = F.broadcast(cut(ids, "sample"))  # at most per_lang rows a language

    def run(batches):
        for batch in batches:
            tallies = [counts(x.as_py()) for x in batch.column("text")]
            on = [np.flatnonzero(t) for t in tallies]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("lang"),
                    pa.array([k.astype("<u2").tobytes() for k in on], pa.binary()),
                    pa.array([t[k].astype("<i4").tobytes() for t, k in zip(tallies, on)], pa.binary()),
                ],
                ["doc_id", "lang", "bucket", "n"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = learn.join(ids, ["doc_id", "lang"], "left_semi").mapInArrow(run, f"doc_id {kind}, lang string, bucket binary, n binary").toPandas()
    rows = rows.sort_values(["lang", "doc_id"]).reset_index(drop=True)
    langs = sorted(set(rows["lang"]))
    model = Model(langs, np.log((1 + total) / (1 + df)) + 1, np.zeros((BUCKETS, len(langs))), np.zeros(len(langs)))
    # The texts stay sparse: a dense matrix of the sample would be most of the driver's memory.
    x = [sparse(model, b, n) for b, n in zip(rows["bucket"], rows["n"])]
    y = rows["lang"].map({k: i for i, k in enumerate(langs)}).to_numpy()
    part = np.random.default_rng(5).permutation(len(x)) % 5 == 0  # for the temperature only
    if len(langs) == 1 or part.all() or not part.any():
        part = np.zeros(len(x), bool)
    w = fit_sparse([r for r, out in zip(x, part) if not out], y[~part], len(langs), BUCKETS + 1)
    model.weights, model.bias = w[:BUCKETS], w[BUCKETS]
    if part.any() and len(langs) > 1:
        scores = np.array([v @ w[on] for (on, v), out in zip(x, part) if out])
        model.temperature = calibrate(scores, y[part])
    return model


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row, from the whole text alone. Null text, text
    without a letter, or no model: ``und`` with score 0."""

    def run(batches):
        for batch in batches:
            langs, scores = [], []
            for x in batch.column("text"):
                text = x.as_py()
                if model is None or text is None or not LETTER.search(text):
                    langs.append("und")
                    scores.append(0.0)
                    continue
                p = model.chances(counts(text)[None])[0]
                langs.append(model.langs[int(p.argmax())])
                scores.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    given = docs.select("doc_id", held_out().alias("held_out"), "text")
    return given.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def language_ids(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> DataFrame:
    model = train(docs, per_lang)
    release(docs.sparkSession)
    return identify(docs, model)
