"""Quality classifier: attention-based multiple-instance learning. Every passage of a text is
encoded, gated attention weighs the passages, and the weighted encoding is scored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut, held_out, release

PASSAGE_WORDS = 96
SAMPLE = 3000  # labelled texts learnt from, the first by hash of the id
STEPS = 300
THRESHOLD = 0.3
CHUNK = 1 << 18  # bytes encoded at a time
GRAMS = 256
HIDDEN, GATE = 24, 12
SINGLE = b"#*$%&|<>!?.,;:'\"()[]{}=+-_/\\@~^`"
U = np.uint64

# Byte classes: white space, lower, upper, digit, beyond ASCII, other, then single signs.
CLASS = np.full(256, 5, np.int64)
CLASS[[9, 10, 11, 12, 13, 32]] = 0
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[128:] = 1, 2, 3, 4
for _i, _c in enumerate(SINGLE):
    CLASS[_c] = 6 + _i
CLASSES = 6 + len(SINGLE)
POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
WIDTH = CLASSES + 6 + GRAMS


def encode(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts, and the text that each passage is of. A text
    without words has one passage of zeros."""
    data = np.frombuffer(b" ".join(bodies) + b" ", np.uint8)
    bounds = np.cumsum([len(b) + 1 for b in bodies])
    kind = CLASS[data]
    word = kind > 0
    start = np.flatnonzero(word & ~np.append(False, word[:-1]))
    if not len(start):
        return np.zeros((len(bodies), WIDTH), np.float32), np.arange(len(bodies))
    stop = np.flatnonzero(word[:-1] & ~word[1:]) + 1
    of = np.searchsorted(bounds, start, side="right")
    first = np.append(True, of[1:] != of[:-1])
    nth = np.arange(len(start)) - np.maximum.accumulate(np.where(first, np.arange(len(start)), 0))
    head = nth % PASSAGE_WORDS == 0
    passage = np.cumsum(head) - 1
    n = passage[-1] + 1
    on = np.flatnonzero(word)
    word_of = np.repeat(np.arange(len(start)), stop - start)
    p = passage[word_of]
    chars = np.bincount(p, minlength=n).astype(float)
    words = np.bincount(passage, minlength=n).astype(float)
    classes = np.bincount(p * CLASSES + kind[on], minlength=n * CLASSES).reshape(n, CLASSES) / chars[:, None]
    inner = np.flatnonzero(word_of[1:] == word_of[:-1])
    code = ((data[on[inner]].astype(np.int64) * 257 + data[on[inner + 1]]) * 40503 >> 7) % GRAMS
    grams = np.bincount(p[inner] * GRAMS + code, minlength=n * GRAMS).reshape(n, GRAMS) / chars[:, None]
    place = np.minimum(on - start[word_of], 63)
    digest = np.add.reduceat((data[on].astype(np.uint64) + U(1)) * POWERS[place], np.cumsum(stop - start) - (stop - start))
    order = np.lexsort((digest, passage))
    same = (digest[order][1:] == digest[order][:-1]) & (passage[order][1:] == passage[order][:-1])
    repeats = np.bincount(passage[order][1:][same], minlength=n) / words
    twice = np.bincount(passage[1:][(digest[1:] == digest[:-1]) & ~head[1:]], minlength=n) / words
    capital = np.bincount(passage[kind[start] == 2], minlength=n) / words
    marked = np.bincount(passage[kind[stop - 1] > 4], minlength=n) / words
    shape = np.column_stack([repeats, twice, capital, marked, np.log1p(chars / words), np.log1p(words) / 5])
    x = np.concatenate([np.sqrt(classes), shape, np.sqrt(grams)], axis=1).astype(np.float32)
    bags = of[head]
    empty = np.setdiff1d(np.arange(len(bodies)), bags)
    if len(empty):
        x, bags = np.concatenate([x, np.zeros((len(empty), WIDTH), np.float32)]), np.concatenate([bags, empty])
        order = np.argsort(bags, kind="stable")
        x, bags = x[order], bags[order]
    return x, bags


def groups(bodies):
    """Texts in groups of about a chunk; a very long text in parts of whole words, each with the
    number of its text, so memory stays bounded and no passage is left out."""
    held, size = [], 0
    for i, b in enumerate(bodies):
        at = 0
        while True:
            end = min(len(b), at + CHUNK)
            while end < len(b) and CLASS[b[end]]:
                end += 1
            if size + end - at > CHUNK and held:
                yield held
                held, size = [], 0
            held.append((i, b[at:end]))
            size += end - at
            at = end
            if at >= len(b):
                break
    if held:
        yield held


class Network:
    """h = tanh(x W + b); attention of a passage = w . (tanh(h V) * sigmoid(h U)); the softmax
    over a text's passages weighs h; a logistic unit scores the sum."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        f = lambda *s: (r.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        self.mean, self.scale = np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32)
        self.p = {"W": f(WIDTH, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": f(HIDDEN, GATE), "U": f(HIDDEN, GATE), "w": f(GATE, 1), "c": f(HIDDEN, 1), "d": np.zeros(1, np.float32)}

    def hidden(self, x):
        p = self.p
        h = np.tanh((x - self.mean) * self.scale @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        return h, v, u, ((v * u) @ p["w"])[:, 0]

    def parts(self, x, bags, n):
        """Sums that scores need: the largest attention, the weights and the weighted encodings
        of each text. Parts of one text combine, so a text never has to be held whole."""
        h, _, _, a = self.hidden(x)
        top = np.full(n, -np.inf)
        np.maximum.at(top, bags, a)
        e = np.exp(a - top[bags])
        total, z = np.zeros(n), np.zeros((n, HIDDEN))
        np.add.at(total, bags, e)
        np.add.at(z, bags, h * e[:, None])
        return top, total, z

    def score(self, z):
        return 1 / (1 + np.exp(-np.clip((z @ self.p["c"])[:, 0] + self.p["d"][0], -30, 30)))

    def step(self, x, bags, y):
        """Gradients of the mean log loss over the texts of a batch."""
        p, n = self.p, len(y)
        h, v, u, a = self.hidden(x)
        top = np.full(n, -np.inf)
        np.maximum.at(top, bags, a)
        e = np.exp(a - top[bags])
        total = np.bincount(bags, e, n)
        att = (e / total[bags]).astype(np.float32)
        z = np.zeros((n, HIDDEN), np.float32)
        np.add.at(z, bags, h * att[:, None])
        g = ((self.score(z) - y) / n).astype(np.float32)
        dz = g[:, None] * p["c"][:, 0][None, :]
        along = (h * dz[bags]).sum(axis=1)
        mean = np.bincount(bags, att * along, n)
        da = (att * (along - mean[bags])).astype(np.float32)
        gate = da[:, None] * p["w"][:, 0][None, :]
        dv, du = gate * u * (1 - v * v), gate * v * u * (1 - u)
        dh = (att[:, None] * dz[bags] + dv @ p["V"].T + du @ p["U"].T) * (1 - h * h)
        xs = (x - self.mean) * self.scale
        return {"W": xs.T @ dh, "b": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (v * u).T @ da[:, None], "c": z.T @ g[:, None], "d": g.sum(keepdims=True)}

    def fit(self, x, bags, y, epochs=12, size=64, rate=0.01, decay=1e-3, seed=12):
        """Adam over batches of texts; ``bags`` is sorted and numbers the texts of ``y``. Few
        texts are gone over more often, for at least ``STEPS`` steps."""
        epochs = max(epochs, -(-STEPS * size // len(y)))
        self.mean = x.mean(0)
        self.scale = (1 / np.maximum(x.std(0), 0.02)).astype(np.float32)
        first = np.searchsorted(bags, np.arange(len(y) + 1))
        m, v2, t = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}, 0
        r = np.random.default_rng(seed)
        for epoch in range(epochs):
            order = r.permutation(len(y))
            for lo in range(0, len(y), size):
                pick = order[lo : lo + size]
                rows = np.concatenate([np.arange(first[k], first[k + 1]) for k in pick])
                own = np.repeat(np.arange(len(pick)), first[pick + 1] - first[pick])
                grads = self.step(x[rows], own, y[pick])
                t += 1
                pace = rate * (1 - epoch / epochs)
                for k, g in grads.items():
                    g = g + decay * self.p[k] * (k in "WVUwc")
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v2[k] = 0.99 * v2[k] + 0.01 * g * g
                    self.p[k] = (self.p[k] - pace * (m[k] / (1 - 0.9**t)) / (np.sqrt(v2[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return self


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | None:
    """Learn from labelled rows that are not held out, at most ``sample`` texts; a text with both
    labels counts as the higher. None without any."""
    known = labels.where(~held_out() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    there = known.join(docs.where("text is not null").select("doc_id").distinct(), "doc_id", "left_semi")
    picked = F.broadcast(cut(there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "sample"))

    def run(batches):
        for batch in batches:
            for ident, y, body in zip(batch.column("doc_id"), batch.column("quality"), batch.column("body")):
                x = np.concatenate([encode([b for _, b in g])[0] for g in groups([body.as_py()])])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ident.as_py()], batch.column("doc_id").type), pa.array([y.as_py()], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["doc_id", "quality", "x"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    given = docs.where("text is not null").select("doc_id", F.col("text").cast("binary").alias("body")).join(picked.select("doc_id", F.col("quality").cast("int").alias("quality")), "doc_id")
    rows = given.mapInArrow(run, f"doc_id {kind}, quality int, x binary").toPandas().sort_values("doc_id")
    if not len(rows):
        return None
    bags = [np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in rows["x"]]
    return Network().fit(np.concatenate(bags), np.repeat(np.arange(len(bags)), [len(b) for b in bags]), rows["quality"].to_numpy().astype(np.float32))


def scorer(model: Network | None):
    """bodies -> scores; without a model every score is 0.5."""

    def run(bodies: list[bytes]) -> np.ndarray:
        n = len(bodies)
        if model is None or not n:
            return np.full(n, 0.5)
        top, total, z = np.full(n, -np.inf), np.zeros(n), np.zeros((n, HIDDEN))
        for g in groups(bodies):
            x, bags = encode([b for _, b in g])
            t, s, part = model.parts(x, bags, len(g))
            for k, (i, _) in enumerate(g):  # a text's parts combine by their largest attention
                new = max(top[i], t[k])
                a, b = np.exp(top[i] - new), np.exp(t[k] - new)
                total[i], z[i], top[i] = total[i] * a + s[k] * b, z[i] * a + part[k] * b, new
        return model.score(z / total[:, None])

    return run


def scored(docs: DataFrame, model: Network | None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` in the struct ``__quality``, from the whole
    text alone; null and empty texts get the score of a text without words."""
    run = scorer(model)

    def add(batches):
        for batch in batches:
            score = run([x.as_py() or b"" for x in batch.column("body")])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(score, pa.float64())], ["row", "score"])

    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("binary").alias("body"))
    out = packed.mapInArrow(add, f"row {packed.schema['row'].dataType.simpleString()}, score double")
    return out.select("row.*", F.struct("score", (F.col("score") >= threshold).cast("int").alias("predicted")).alias("__quality"))


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row."""
    model = train(docs, labels, sample)
    release(docs.sparkSession)
    out = scored(docs.select("doc_id", "text"), model, threshold)
    return out.select("doc_id", held_out().alias("held_out"), "__quality.score", "__quality.predicted")


def good_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, same columns."""
    model = train(docs, labels, sample)
    release(docs.sparkSession)
    return scored(docs, model, threshold).where("__quality.predicted = 1").select(*docs.columns)
