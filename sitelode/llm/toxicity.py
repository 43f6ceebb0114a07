"""Toxicity by weak supervision.

Voters are stems of a fixed lexicon and stems that a bounded labelled sample brings up, each once and repeated, and patterns over
all of them. A generative model of their votes estimates, without labels, how often each fires on toxic and on other texts, and
from the correlations within each class how much of its evidence is its own. Its posterior labels train a linear classifier, which
scores every document.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ascii_lower, held_out
from .labels import SAMPLE, training_sample

STEM = 6  # letters of a stem; shorter words are stems as a whole
STEMS = 400
LEXICON = ("bastard clown coward crap creep cretin damn disgusting dumb dumbass fool freak garbage idiot imbecile jerk kill loser lunatic "
           "moron pathetic pig psycho retard scum shut slut stupid trash ugly vermin whore worthless").split()
WORD = re.compile(r"[^\W\d_]+")
SPLIT = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
# Hits per word of a text that patterns ask for.
RATES = (0.003, 0.006, 0.01, 0.02, 0.04)


def stem_of(word: str) -> str:
    return word[:STEM]


def mined_stems(sample: DataFrame, limit: int = STEMS) -> list[tuple[str, int]]:
    """``(stem, times)``: stems that occur at least so often mostly in texts labelled toxic, strongest first.

    Counted in Spark over the sample; a stem must be frequent enough not to be chance: its toxic count must exceed by four
    deviations what the share of toxic texts gives.
    """
    words = F.filter(F.split(ascii_lower("text"), SPLIT), lambda w: F.length(w) > 2)
    stems = sample.select("y", F.monotonically_increasing_id().alias("row"), F.explode(F.transform(words, lambda w: F.substring(w, 1, STEM))).alias("stem"))
    counts = stems.groupBy("row", "y", "stem").count()
    per = counts.select("y", "stem", F.explode(F.when(F.col("count") > 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("times"))
    share = sample.agg(F.coalesce(F.avg("y"), F.lit(0.0))).first()[0]
    table = per.groupBy("stem", "times").agg(F.sum("y").alias("toxic"), F.count("*").alias("n"))
    expected = F.col("n") * F.lit(float(share))
    strength = (F.col("toxic") - expected) / F.sqrt(expected + 1)
    strong = table.filter((F.col("toxic") >= 4) & (F.col("toxic") > 0.65 * F.col("n")) & (strength > 4)).orderBy(
        strength.desc(), "stem", "times").limit(limit)
    return [(r["stem"], r["times"]) for r in strong.collect()]


class Voters:
    """Votes of a text: one for each (stem, times), then patterns over all of them."""

    def __init__(self, mined: list[tuple[str, int]]):
        fixed = sorted({stem_of(w) for w in LEXICON})
        self.rules = [(s, 1) for s in fixed] + [r for r in mined if r not in {(s, 1) for s in fixed}]
        self.stems = {s: i for i, s in enumerate(sorted({s for s, _ in self.rules}))}
        self.stem_of_rule = np.array([self.stems[s] for s, _ in self.rules], int)
        self.times = np.array([t for _, t in self.rules], int)
        self.size = len(self.rules) + 1 + len(RATES)
        self.middle = len(self.rules) + 1 + len(RATES) // 2  # the pattern from which the label model starts

    def votes(self, text: str) -> np.ndarray:
        counts = np.zeros(len(self.stems), int)
        get, n = self.stems.get, 0
        for word in WORD.findall(text.lower()):
            n += 1
            i = get(word[:STEM])
            if i is not None:
                counts[i] += 1
        out = np.zeros(self.size, np.float32)
        fired = counts[self.stem_of_rule] >= self.times
        out[:len(fired)] = fired
        # A single chance hit tells little in a long text, so patterns weigh hits by its words.
        hits = int(counts[np.unique(self.stem_of_rule[fired])].sum()) if fired.any() else 0
        n = max(n, 30)
        out[len(fired):] = [hits >= 2 and hits > RATES[0] * n] + [hits > r * n for r in RATES]
        return out


class LabelModel:
    """Two-class model of binary votes, fitted by expectation maximisation without labels."""

    def __init__(self, votes: np.ndarray, first: np.ndarray, rounds: int = 60):
        n, m = votes.shape
        self.prior = 0.1
        self.on, self.off, self.own = np.full(m, 0.5), np.full(m, 0.05), np.ones(m)
        # Every voter speaks for toxic; ``first`` marks the texts that begin as such.
        p = np.where(first, 0.95, 0.02)
        for step in range(rounds if n else 0):
            a, b = p.sum(), (1 - p).sum()
            self.prior = float(np.clip((a + 1) / (n + 2), 0.01, 0.5))
            self.on = (votes.T @ p + 1) / (a + 2)
            self.off = (votes.T @ (1 - p) + 0.1) / (b + 2)
            if step in (5, 20):  # what a voter says beyond those that it moves with in both classes
                self.own = 1 / (1 + (self._correlation(votes, p) + self._correlation(votes, 1 - p)) / 2)
            p = self.posterior(votes)

    def _correlation(self, votes, p) -> np.ndarray:
        """Sum for each voter of its positive correlations with the others among texts of weight ``p``."""
        w = p / max(p.sum(), 1e-9)
        x = votes - w @ votes
        cov = (x * w[:, None]).T @ x
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-6))
        r = np.clip(cov / sd[:, None] / sd[None, :], 0, 1)
        np.fill_diagonal(r, 0)
        return np.where(r > 0.1, r, 0).sum(1)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of toxic given the votes; a voter that keeps silent is evidence too."""
        fire = self.own * np.log(self.on / self.off)
        rest = self.own * np.log((1 - self.on) / (1 - self.off))
        logit = np.log(self.prior / (1 - self.prior)) + votes @ (fire - rest) + rest.sum()
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def linear(x: np.ndarray, p: np.ndarray, ridge: float = 0.05, rounds: int = 100) -> np.ndarray:
    """Weights, the intercept last, of the logistic regression on probabilities ``p``.

    Newton steps, halved until they lower the penalised loss: on separable votes full steps overshoot without end. The
    intercept has a small penalty too, so the least loss is attained.
    """
    x = np.concatenate((x, np.ones((len(x), 1))), 1).astype(np.float64)
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = ridge / 100
    w = np.zeros(x.shape[1])
    w[-1] = np.log((p.mean() + 1e-3) / (1 - p.mean() + 1e-3)) if len(p) else -3.0

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - p * z).sum() + (penalty * w * w).sum() / 2)

    now = loss(w)
    for _ in range(rounds if len(p) else 0):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        gradient = x.T @ (q - p) + penalty * w
        curve = (x * (q * (1 - q))[:, None]).T @ x + np.diag(penalty)
        step, size = np.linalg.solve(curve, gradient), 1.0
        while size > 1e-8 and loss(w - size * step) > now:
            size /= 2
        after = loss(w - size * step)
        if not after < now - 1e-9 * (1 + now):
            break
        w, now = w - size * step, after
    return w


class Model:
    """Voters and the weights of the linear classifier over their votes."""

    def __init__(self, voters: Voters, votes: np.ndarray):
        self.voters = voters
        self.labels = LabelModel(votes, votes[:, voters.middle] > 0 if len(votes) else np.zeros(0, bool))
        self.weights = linear(votes, self.labels.posterior(votes))

    def score(self, text: str) -> float:
        votes = self.voters.votes(text)
        return float(1 / (1 + np.exp(-np.clip(votes @ self.weights[:-1] + self.weights[-1], -30, 30))))


def fit(sample: DataFrame) -> Model:
    """Model of a bounded sample (``text, y``). Labels choose stems; the label model and the classifier see votes only."""
    voters = Voters(mined_stems(sample))
    size = voters.size

    def votes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(voters.votes(t.as_py() or "").astype(bool)).tobytes() for t in batch.column(0)],
                                                       pa.binary())], ["x"])

    rows = sorted(bytes(r["x"]) for r in sample.select("text").mapInArrow(votes, "x binary").collect())
    packed = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, -(-size // 8))
    return Model(voters, np.unpackbits(packed, axis=1)[:, :size].astype(np.float64))


def score_toxicity(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, label: str = "toxic") -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs`` (``doc_id, text``); ``predicted`` is 1 from 0.7 on.

    Texts alone decide the score. Null texts score as empty ones; repeated rows are returned each; without labels the fixed lexicon
    votes alone. Empty tables give no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(training_sample(docs, labels, label, limit)))

    def score(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(
                [model.value.score(t.as_py() or "") for t in batch.column(2)], pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    scored = rows.mapInArrow(score, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def keep_civil(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """``docs`` without the rows predicted toxic, all columns as they are. Rows are judged one by one where they are read, so null or
    repeated ids and columns of any name do no harm and nothing is shuffled."""
    model = docs.sparkSession.sparkContext.broadcast(fit(training_sample(docs, labels, "toxic", limit)))
    place = docs.columns.index("text")

    def civil(batches):
        for batch in batches:
            yield batch.filter(pa.array([model.value.score(t.as_py() or "") < 0.7 for t in batch.column(place)], pa.bool_()))

    return docs.mapInArrow(civil, docs.schema)
