"""Toxicity: a weighted finite-state grammar over the words of a clause. Transducers for negation,
reported speech, targets and threats are composed into one machine, which weighs the insults and
threats of each clause by what stands around them; the clause scores of a text give its score."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut, held_out

SAMPLE = {1: 4000, 0: 6000}  # labelled texts learnt from by label, the first by hash of the id
THRESHOLD = 0.5
PIECE = 1 << 20  # characters read at a time, up to the next clause mark
CACHE = 1 << 19  # distinct words whose class a task remembers
PREFIX = (3, 9)  # lengths of word starts that may be learnt
SUPPORT, SURE, LEAST = 4, 3.0, 1.0  # sightings in toxic texts, standard errors and log odds a pattern needs
SEED, CAP = 3.0, 8.0  # evidence that a listed word starts with; largest weight

# Listed words, by role. Insults and threats are only a start: labels add words and weigh them.
INSULTS = frozenset("idiot moron loser scum trash clown stupid pathetic worthless disgusting idiotisch dumm abschaum versager crétin imbécile abruti minable imbécil estúpido basura escoria".split())
THREATS = frozenset("kill hurt destroy beat töten vernichten verprügeln tuer détruire frapper matar destruir golpear".split())
TARGETS = frozenset("you your yours he him she her they them people du dich dir ihr euch sie tu toi te vous ils elles tú ti usted ustedes ellos".split())
NEGATIONS = frozenset("not never no isn aren don nicht kein keine nie pas jamais aucun nunca jamás ningún".split())
REPORTS = frozenset("said says wrote writes called quoted claimed sagte schrieb nannte dit écrit appelé dijo escribió llamó".split())

TOKEN = re.compile(r"[^\W_]+|[.!?;:,\n\"“”«»]")
MARK = re.compile(r"[.!?;:,\n]")
QUOTES = frozenset("\"“”«»")
TRIPLE = re.compile(r"(.)\1{2,}")
FIGURES = str.maketrans("013457", "oieast")

# Symbols of the machines: other word, negation, report, quote mark, target, insult, threat;
# then what the machines make of the last two: negated, reported, aimed, and a completed pair.
O, N, R, Q, G, I, T, NEGATED, REPORTED, AIMED, PAIR, THREAT = range(12)
WORDS = (O, N, R, Q, G, I, T)
FACTOR = {I: 1.0, T: 0.5, NEGATED: 0.2, REPORTED: 0.4, AIMED: 1.5}
BONUS = {PAIR: 0.5, THREAT: 3.0}


@dataclass(frozen=True)
class Machine:
    """A deterministic transducer: (state, symbol) -> (symbol written, next state); start 0."""

    arcs: dict

    @classmethod
    def over(cls, states, symbols, rule):
        return cls({(s, a): rule(s, a) for s in states for a in symbols})


def compose(first: Machine, then: Machine) -> Machine:
    """What ``first`` writes is read by ``then``; only pairs of states that can be reached."""
    symbols = {a for _, a in first.arcs}
    number, todo, arcs = {(0, 0): 0}, [(0, 0)], {}
    for s, t in todo:
        for a in symbols:
            mid, s2 = first.arcs[s, a]
            out, t2 = then.arcs[t, mid]
            if (s2, t2) not in number:
                number[s2, t2] = len(number)
                todo.append((s2, t2))
            arcs[number[s, t], a] = out, number[s2, t2]
    return Machine(arcs)


def negation(scope: int = 3) -> Machine:
    """Insults and threats within ``scope`` words after a negation are negated."""

    def rule(s, a):
        if a == N:
            return N, scope
        return (NEGATED if s and a in (I, T) else a), max(s - 1, 0)

    return Machine.over(range(scope + 1), WORDS, rule)


def reported(scope: int = 8) -> Machine:
    """Words after a verb of reporting, or between quote marks, are another's words."""
    inside = scope + 1

    def rule(s, a):
        if a == Q:
            return O, 0 if s == inside else inside
        out = REPORTED if s and a in (I, T) else O if a == R else a
        return out, s if s == inside else scope if a == R else max(s - 1, 0)

    return Machine.over(range(scope + 2), (*WORDS, NEGATED), rule)


def targeted(before: int = 4, after: int = 3) -> Machine:
    """An insult is aimed if a target stands up to ``before`` words before it; a target up to
    ``after`` words behind an insult makes a pair. States above ``before`` count the words left."""

    def rule(s, a):
        if a == G:
            return (PAIR if s > before else G), before
        if a == I:
            return (AIMED if 0 < s <= before else I), before + after
        return a, 0 if s in (0, before + 1) else s - 1

    return Machine.over(range(before + after + 1), (*WORDS, NEGATED, REPORTED), rule)


def threatening(scope: int = 3) -> Machine:
    """A threat is complete with a target among the next ``scope`` words."""

    def rule(s, a):
        if a == T:
            return T, scope
        return (THREAT if s and a == G else a), 0 if a == G else max(s - 1, 0)

    return Machine.over(range(scope + 1), (*WORDS, NEGATED, REPORTED, AIMED, PAIR), rule)


def grammar() -> Machine:
    out = negation()
    for machine in (reported(), targeted(), threatening()):
        out = compose(out, machine)
    return out


class Lexicon:
    """The first transducer: a word -> its symbol and weight. Listed words by role; learnt
    patterns are whole words (``word``) and proper starts of words (``start*``), and the one with
    the largest weight counts."""

    def __init__(self, learnt: dict[str, float], listed: dict[str, float]):
        self.learnt, self.listed, self.seen = learnt, listed, {}
        self.role = {w: s for s, ws in ((N, NEGATIONS), (R, REPORTS), (G, TARGETS), (T, THREATS)) for w in ws}
        self.role |= {q: Q for q in QUOTES}

    def __getstate__(self):
        return {"learnt": self.learnt, "listed": self.listed, "seen": {}, "role": self.role}

    def weight(self, word: str) -> float:
        starts = [self.learnt.get(word[:k] + "*", 0.0) for k in range(PREFIX[0], min(len(word) - 1, PREFIX[1]) + 1)]
        return max([self.learnt.get(word, 0.0), self.listed.get(word, 0.0), *starts])

    def of(self, word: str) -> tuple[int, float]:
        hit = self.seen.get(word)
        if hit is None:
            if len(self.seen) >= CACHE:
                self.seen.clear()
            plain = word
            if not word.isalpha() and len(word) > 1 and any(c.isalpha() for c in word):
                plain = word.translate(FIGURES)
            plain = TRIPLE.sub(r"\1", plain)
            w = max(self.weight(word), self.weight(plain) if plain != word else 0.0)
            role = self.role.get(plain, O)
            hit = self.seen[word] = (I, w) if w and role in (O, T) else (role, SEED if role == T else 0.0)
        return hit


FEATURES = 9


class Reader:
    """Clause scores of whole texts, summed up in ``FEATURES`` numbers a text."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.machine = lexicon, grammar()

    def clause(self, words: list[tuple[int, float]]) -> tuple[float, float, float]:
        """(score, part aimed or threatening, part negated or reported) of one clause."""
        state, score, aimed, damped = 0, 0.0, 0.0, 0.0
        for symbol, weight in words:
            out, state = self.machine.arcs[state, symbol]
            worth = FACTOR.get(out, 0.0) * weight + BONUS.get(out, 0.0)
            score += worth
            if out in (AIMED, PAIR, THREAT):
                aimed += worth
            elif out in (NEGATED, REPORTED):
                damped += worth
        return score, aimed, damped

    def features(self, text: str) -> list[float]:
        of, at = self.lexicon.of, 0
        words = clauses = matched = 0
        total = top = aim = damp = 0.0
        held: set[str] = set()
        while at < len(text):
            end = MARK.search(text, at + PIECE)
            end = end.end() if end else len(text)
            tokens = TOKEN.findall(text[at:end].lower())
            at = end
            found = [of(t) for t in tokens]
            hits = [i for i, (s, _) in enumerate(found) if s in (I, T)]
            ends = [i for i, t in enumerate(tokens) if MARK.match(t)]
            words += len(tokens) - len(ends)
            clauses += len(ends) + 1
            edges = np.searchsorted(ends, hits)
            for k in np.unique(edges):  # only clauses with an insult or a threat
                lo, hi = ends[k - 1] + 1 if k else 0, ends[k] if k < len(ends) else len(tokens)
                score, aimed, damped = self.clause(found[lo:hi])
                matched += 1
                total, top, aim, damp = total + score, max(top, score), aim + aimed, damp + damped
            held.update(tokens[i] for i in hits)
        log = np.log1p
        return [log(total), log(100 * total / max(words, 1)), top, log(matched), matched / max(clauses, 1), log(words), log(len(held)), log(aim), log(damp)]


class Scale:
    """Logistic regression on the features of a text, by Newton steps with a small ridge. Without
    labels of both kinds the sum of the clause scores over itself plus ``SEED`` is the score."""

    def __init__(self):
        self.mean, self.spread, self.beta = np.zeros(FEATURES), np.ones(FEATURES), None

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0):
        self.mean, self.spread = x.mean(0), np.maximum(x.std(0), 1e-3)
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.spread])
        beta, pull = np.zeros(z.shape[1]), ridge * np.eye(z.shape[1])
        pull[0, 0] = 1e-6
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + pull, z.T @ (weight * (y - p)) - pull @ beta)
            beta = beta + step
            if np.abs(step).max() < 1e-8:
                break
        self.beta = beta
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.beta is None:
            total = np.expm1(x[:, 0])
            return total / (total + SEED)
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.spread])
        return 1 / (1 + np.exp(-np.clip(z @ self.beta, -30, 30)))


def patterns(word: str) -> list[str]:
    return [word] + [word[:k] + "*" for k in range(PREFIX[0], min(len(word) - 1, PREFIX[1]) + 1)]


def sightings(sample: DataFrame) -> DataFrame:
    """(word, toxic, fold, times) over the sample. A word counts once for each pair of
    neighbours, so copies of a text add nothing and a word repeated in place counts once."""

    def run(batches):
        for batch in batches:
            for toxic, fold, text in zip(batch.column("toxic").to_pylist(), batch.column("fold").to_pylist(), batch.column("text")):
                words = ["", *[t for t in TOKEN.findall((text.as_py() or "").lower()) if len(t) > 1], ""]
                held = {(w, xxhash.xxh3_64_intdigest("\n".join(words[i - 1 : i + 2])) >> 1) for i, w in enumerate(words) if 0 < i < len(words) - 1}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w for w, _ in held], pa.string()), pa.array([c for _, c in held], pa.int64()), pa.array([toxic] * len(held), pa.int32()), pa.array([fold] * len(held), pa.int32())],
                    ["word", "context", "toxic", "fold"],
                )

    met = sample.mapInArrow(run, "word string, context long, toxic int, fold int").groupBy("word", "context", "toxic").agg(F.min("fold").alias("fold"))
    return met.groupBy("word", "toxic", "fold").agg(F.count("*").alias("times"))


def learn(sample: DataFrame, folds: int = 2) -> tuple[list[Lexicon], Lexicon]:
    """One lexicon without each fold, and one of the whole sample. The weight of a pattern is the
    lower bound of its log odds between toxic and other texts, ``SURE`` standard errors below."""
    words = cut(sightings(sample), "words")
    sums = {(r["toxic"], r["fold"]): r["n"] for r in words.groupBy("toxic", "fold").agg(F.sum("times").alias("n")).collect()}

    def starts(batches):
        for batch in batches:
            named = [patterns(w) for w in batch.column("word").to_pylist()]
            at = pa.array([i for i, ps in enumerate(named) for _ in ps], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([p for ps in named for p in ps], pa.string()), *[batch.column(c).take(at) for c in ("toxic", "fold", "times")]], ["pattern", "toxic", "fold", "times"])

    spelt = words.mapInArrow(starts, "pattern string, toxic int, fold int, times long")
    lexicons, columns = [], []
    for k in range(folds + 1):  # the last leaves nothing out
        used = F.lit(True) if k == folds else F.col("fold") != k
        for toxic in (1, 0):
            columns.append(F.sum(F.when(used & (F.col("toxic") == toxic), F.col("times")).otherwise(0)).alias(f"t{toxic}_{k}"))
    table = spelt.groupBy("pattern").agg(*columns)
    bounds, totals = [], []
    for k in range(folds + 1):
        whole = [max(1, sum(n for (t, f), n in sums.items() if t == toxic and f != k)) for toxic in (1, 0)]
        totals.append(whole)
        a, b = F.col(f"t1_{k}"), F.col(f"t0_{k}")
        odds = F.log((a + 0.5) / whole[0] / ((b + 0.5) / whole[1])) - SURE * F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        bounds.append(F.when(a >= SUPPORT, odds).alias(f"w_{k}"))
    weighed = table.select("*", *bounds)
    kept = weighed.where(F.greatest(*[F.col(f"w_{k}") for k in range(folds + 1)]) > LEAST).collect()
    listed = {r["pattern"]: r for r in weighed.where(F.col("pattern").isin(*INSULTS)).collect()}
    for k in range(folds + 1):
        learnt = {r["pattern"]: min(CAP, r[f"w_{k}"]) for r in kept if (r[f"w_{k}"] or 0.0) > LEAST}
        start = {}
        for w in INSULTS:  # a listed word starts with some evidence, which clean texts can outweigh
            a, b = (listed[w][f"t1_{k}"], listed[w][f"t0_{k}"]) if w in listed else (0, 0)
            start[w] = float(np.clip(np.log((a + SEED) / (b + 0.5) * totals[k][1] / totals[k][0]), 0, SEED))
        lexicons.append(Lexicon(learnt, start))
    return lexicons[:folds], lexicons[folds]


def measured(df: DataFrame, readers: list[Reader], keep: list[str]) -> DataFrame:
    """``keep`` and the features ``x`` of each text; column ``fold`` picks the reader."""

    def run(batches):
        for batch in batches:
            x = [readers[f].features(t.as_py() or "") for f, t in zip(batch.column("fold").to_pylist(), batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(x, pa.list_(pa.float64()))], [*keep, "x"])

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.mapInArrow(run, f"{kinds}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None) -> tuple[Reader, Scale]:
    """Learn from labelled rows that are not held out, at most ``sample`` texts a label; a text
    with both labels counts as toxic. The scale is fitted on texts that the lexicon they are read
    with has not seen, each label weighed as often as it stands in the table."""
    sample = sample or SAMPLE
    known = labels.where(~held_out() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    there = cut(known.join(docs.where("text is not null").select("doc_id").distinct(), "doc_id", "left_semi"), "known")
    counts = {r["toxic"]: r["count"] for r in there.groupBy("toxic").count().collect()}
    listed = Reader(Lexicon({}, dict.fromkeys(INSULTS, SEED)))
    if not (counts.get(0) and counts.get(1)):
        return listed, Scale()
    of = lambda y: there.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample[y])
    picked = cut(of(1).union(of(0)).withColumn("fold", (F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(2))).cast("int")), "sample")
    texts = cut(docs.where("text is not null").select("doc_id", "text").join(F.broadcast(picked), "doc_id"), "texts")
    folds, whole = learn(texts)
    rows = measured(texts, [Reader(x) for x in folds], ["doc_id", "toxic"]).toPandas().sort_values("doc_id")
    y = rows["toxic"].to_numpy().astype(float)
    used = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    weight = np.where(y == 1, counts[1] / used[1], counts[0] / used[0])
    return Reader(whole), Scale().fit(np.array(rows["x"].tolist()), y, weight / weight.mean())


def toxicity(docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``, from the whole text alone.

    Null and empty texts get the score of a text without words. Repeated rows and equal texts
    score alike, a null id is held out, a score equal to ``threshold`` is predicted toxic. Very
    long texts are read in pieces that end at clause marks, whole. An empty table gives no row;
    without labels of both kinds the listed words alone decide. Other columns are not read."""
    reader, scale = train(docs, labels, sample)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            x = np.array([reader.features(t.as_py() or "") for t in batch.column("text")]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scale.score(x), pa.float64())], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
