"""Toxicity by a weighted finite-state grammar over clauses.

The insult lexicon (words and word beginnings with their log-odds) is learned from labelled training rows. Four
small transducers rewrite the class of every word in a clause: a target near an insult makes it aimed, a
negation before it negated, a verb of speech before it reported, and an intent before a verb of harm a threat.
They are composed into one transducer. What it emits for the matched clauses, weighted, goes into a logistic
model whose factors are learned from the same rows, so the labels decide what a negated or reported insult counts.

The fit uses at most ``TRAIN_ROWS`` labelled rows, the first by a hash of their id; scoring covers all rows and
whole texts. Labels, language, source and id never enter a score.

Defined results: null and empty texts match nothing and get the score of a text without matches. A null id
counts as the empty string for the held-out test. Labels that are null are ignored, repeated ones count by
their maximum. Without labels of both kinds there is no lexicon and every score is 0. Repeated rows get equal
scores; extra columns are not read.
"""

import math
import re
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from alertloom.session import cut_lineage, release

TRAIN_ROWS = 8000
MIN_DOCS, MIN_SHARE, MIN_LOG_ODDS, MIN_CONTEXT_SHARE = 5, 0.006, 3.0, 0.25
THRESHOLD = 0.7
MIN_PRECISION = 0.98  # on the training rows
PREFIXES = (4, 5, 6, 7)
# word classes of the grammar, plain values for English, German, French and Spanish
TARGET = "you your yours he she they him her them du dich dir ihr euch er sie ihn tu toi vous il elle ils tú usted ustedes él ella ellos".split()
NEGATION = "not no never none isn't aren't nicht kein keine nie ne pas jamais nunca jamás tampoco".split()
SPEECH = "said says say called calls wrote claimed quoted sagte sagt nannte schrieb dit disait appelé écrit dijo dice llamó escribió".split()
INTENT = "will shall gonna must werde werden wirst vais allons voy vamos".split()
HARM = "kill hurt destroy beat burn shoot stab töten schlagen vernichten tuer frapper brûler matar golpear quemar".split()
OTHER, INSULT, T, N, S, W, H = range(7)
AIMED, NEGATED, REPORTED, THREAT = range(7, 11)
EMITS = (INSULT, AIMED, NEGATED, REPORTED, THREAT)
_STRIP = ".,;:!?…\"'()[]{}«»“”„-–—*#$%&|<>"
_END = re.compile(r"[.!?;:…]")


class Transducer:
    """Deterministic: ``step[state, symbol] -> (state, symbol out)``; state 0 starts a clause."""

    def __init__(self, states, step):
        self.states, self.step = states, step

    def then(self, other):
        """This transducer composed with one that reads its output."""
        step = {}
        for (a, b), symbol in product(product(range(self.states), range(other.states)), range(THREAT + 1)):
            a2, middle = self.step(a, symbol)
            b2, out = other.step(b, middle)
            step[a * other.states + b, symbol] = (a2 * other.states + b2, out)
        return Transducer(self.states * other.states, lambda s, x: step[s, x])

    def table(self):
        return [[self.step(s, x) for x in range(THREAT + 1)] for s in range(self.states)]


def within(opener, reach, reads, writes):
    """Rewrites ``reads`` as ``writes`` up to ``reach`` words after ``opener``."""

    def step(state, x):
        if x == opener:
            return reach, x
        return max(state - 1, 0), writes if state and x == reads else x

    return Transducer(reach + 1, step)


def grammar():
    threat = within(W, 3, H, THREAT)
    reported = within(S, 6, INSULT, REPORTED)
    negated = within(N, 2, INSULT, NEGATED)
    aimed = within(T, 3, INSULT, AIMED)
    return threat.then(reported).then(negated).then(aimed)


class Scorer:
    """Features of texts; ``lexicon`` maps words, and beginnings followed by ``*``, to log-odds."""

    def __init__(self, lexicon):
        self.lexicon = lexicon
        self.table = grammar().table()
        self.closed = {w: c for words, c in ((TARGET, T), (NEGATION, N), (SPEECH, S), (INTENT, W), (HARM, H)) for w in words}
        self.known = {}

    def classify(self, raw):
        word = raw.strip(_STRIP)
        best = max([self.lexicon.get(word, 0.0), *[self.lexicon.get(word[:n] + "*", 0.0) for n in PREFIXES if len(word) >= n]])
        kind = INSULT if best > 0 else self.closed.get(word, OTHER)
        found = (kind, best, bool(_END.search(raw[-1:])))
        if len(self.known) > 500_000:
            self.known.clear()
        self.known[raw] = found
        return found

    def features(self, text):
        """Per emitted class log(1 + weight), then presence and density of any match."""
        known, classify = self.known, self.classify
        tokens = [known.get(w) or classify(w) for w in text.lower().split()]
        if not any(k in (INSULT, H) for k, _, _ in tokens):
            return [0.0] * (len(EMITS) + 2)
        total, state, hits = dict.fromkeys(EMITS, 0.0), 0, 0
        for kind, weight, end in tokens:
            state, out = self.table[state][kind]
            if out in total:
                total[out] += weight if out != THREAT else 3.0
                hits += 1
            if end:
                state = 0
        return [*[math.log1p(total[x]) for x in EMITS], float(hits > 0), math.log1p(100 * hits / len(tokens))]


def terms(text):
    out = set()
    for raw in text.lower().split():
        word = raw.strip(_STRIP)
        if word:
            out.add(word)
            out.update(word[:n] + "*" for n in PREFIXES if len(word) >= n)
    return out


def _count_terms(stream):
    """Documents per term and label, added up per task: the sample bounds them."""
    positive, negative = Counter(), Counter()
    for batch in stream:
        for text, toxic in zip(batch.column("text"), batch.column("toxic")):
            (positive if toxic.as_py() else negative).update(terms(text.as_py() or ""))
    names = list(positive | negative)  # another task may hold the toxic documents of a term
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([positive[x] for x in names], pa.int64()), pa.array([negative[x] for x in names], pa.int64())], ["term", "pos", "neg"])


def _contexts(stream):
    """Distinct neighbour pairs of every term, batch by batch."""
    for batch in stream:
        out = set()
        for text in batch.column("text").to_pylist():
            words = (text or "").lower().split()
            for i, raw in enumerate(words):
                word = raw.strip(_STRIP)
                if word:
                    around = f"{words[i - 1] if i else ''} {words[i + 1] if i + 1 < len(words) else ''}"
                    out.update((x, around) for x in (word, *[word[:n] + "*" for n in PREFIXES if len(word) >= n]))
        rows = list(out)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.string()), pa.array([y for _, y in rows], pa.string())], ["term", "around"])


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """At most ``rows`` labelled documents ``text, toxic`` outside the held-out third, written once."""
    known = labels.where("toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # an id may stand on many rows: equal rows once, then the first again, so that the bound holds for rows too
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id", "text"])
    found = found.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "text").limit(rows)
    return cut_lineage(found.select("text", (F.col("toxic") > 0).alias("toxic")))


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Terms that toxic texts hold far more often than others, in contexts of their own.

    Copies of one text count once. Near copies of one toxic text would still make all of its words look toxic;
    their neighbours are always the same, so a term must stand between many different neighbours for its number of
    documents. Every term that passes is kept: the sample alone bounds the lexicon.
    """
    sample = cut_lineage(sample.distinct())
    size = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(size) < 2:
        release(sample)
        return {}
    odds = F.log((F.col("pos") + 0.5) / (size[True] + 1)) - F.log((F.col("neg") + 0.5) / (size[False] + 1))
    counted = sample.mapInArrow(_count_terms, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    least = max(MIN_DOCS, MIN_SHARE * size[True])
    strong = cut_lineage(counted.withColumn("odds", odds).where((F.col("pos") >= least) & (F.col("odds") >= MIN_LOG_ODDS)))
    seen = sample.where("toxic").mapInArrow(_contexts, "term string, around string").join(strong.select("term"), "term", "left_semi")
    around = seen.distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    kept = strong.join(around, "term").where(F.col("n") >= F.greatest(F.lit(float(least)), MIN_CONTEXT_SHARE * F.col("pos")))
    lexicon = {r["term"]: r["odds"] for r in kept.select("term", "odds").collect()}
    release(sample)
    release(strong)
    return lexicon


def _feature_frame(lexicon, carry):
    def run(stream):
        scorer = Scorer(lexicon.value)
        for batch in stream:
            rows = [scorer.features(x.as_py() or "") for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], pa.array(rows, pa.list_(pa.float64()))], [*carry, "features"])

    return run


def learn_factors(features: np.ndarray, toxic: np.ndarray, ridge: float = 1e-3):
    """Logistic regression by Newton steps on a bounded sample: (bias, factors)."""
    x = np.c_[np.ones(len(features)), features]
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * len(x))
    penalty[0] = 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hessian, x.T @ (p - toxic) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def calibrated(weights: np.ndarray, features: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """``weights`` with the bias moved so that ``THRESHOLD`` is the lowest score whose precision on the sample is ``MIN_PRECISION``.

    Texts labelled toxic that show nothing the grammar knows pull all scores down; this takes it back. The order of
    scores stays.
    """
    x = weights[0] + features @ weights[1:]
    order = np.argsort(-x, kind="stable")
    precise = np.cumsum(toxic[order]) >= MIN_PRECISION * np.arange(1, len(order) + 1)
    ends = np.append(np.diff(x[order]) != 0, True)  # equal scores fall together
    good = np.flatnonzero(precise & ends & (toxic[order].cumsum() > 0))
    if len(good) == 0 or good[-1] + 1 == len(order):
        return weights
    cut = (x[order][good[-1]] + x[order][good[-1] + 1]) / 2
    out = weights.copy()
    out[0] += np.log(THRESHOLD / (1 - THRESHOLD)) - cut
    return out


def _scores(shared):
    def run(stream):
        lexicon, weights = shared.value
        scorer = Scorer(lexicon)
        for batch in stream:
            x = np.array([scorer.features(t.as_py() or "") for t in batch.column("text")]).reshape(batch.num_rows, -1)
            score = 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30))) if lexicon else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score)], ["doc_id", "held_out", "score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs (doc_id, text)``."""
    spark = docs.sparkSession
    sample = training_rows(docs, labels)
    lexicon = learn_lexicon(sample)
    weights = np.zeros(len(EMITS) + 3)
    if lexicon:
        fit = sample.mapInArrow(_feature_frame(spark.sparkContext.broadcast(lexicon), ["toxic"]), "toxic boolean, features array<double>").collect()
        features, toxic = np.array([r["features"] for r in fit]), np.array([r["toxic"] for r in fit], float)
        weights = calibrated(learn_factors(features, toxic), features, toxic)
    release(sample)
    shared = spark.sparkContext.broadcast((lexicon, weights))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    scored = rows.mapInArrow(_scores(shared), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
