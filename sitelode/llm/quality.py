"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

Terms are trigrams of character classes (letters alike, capitals, digits, each punctuation mark) and signs of repetition. A singular value
decomposition of a bounded labelled sample gives the space; the sample's vectors are broadcast, and every document meets all of them
in blocked exact cosine products. The nearest vote with their labels, weighted by similarity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import held_out, utf8_rows
from .labels import SAMPLE, training_sample

TERMS = 2048  # hashed trigrams, after the signs of repetition
SIGNS = 40
DIMS = 48
NEIGHBOURS = 15
SHARPNESS = 8.0
# Documents scored at once.
ROWS = 512
TEXT_BYTES = 4 << 20


def _classes() -> np.ndarray:
    """Class of each byte: letters of any script 0, capitals 1, digits 2, blanks 3, line ends 4, other ASCII one each."""
    kind = np.zeros(256, np.int64)
    for b in range(128):
        c = chr(b)
        kind[b] = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 4 if c == "\n" else 3 if c.isspace() else b + 5
    return kind


CLASS = _classes()


def repetition(text: bytes) -> list[float]:
    """Shares between 0 and 1 that tell repeated from running text: of words equal to the one before, of words seen before beyond what
    a text of this length has anyway, of lines seen before, and of words in the longest run."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0, 0.0, 0.0, 0.0]
    equal = [a == b for a, b in zip(words, words[1:])]
    lines = [x for x in text.split(b"\n") if x.strip()]
    fresh = len(set(words)) / n
    return [sum(equal) / n, max(0.0, 1 - fresh * max(1.0, (n / 60) ** 0.35)), 1 - len(set(lines)) / max(1, len(lines)),
            min(1.0, 6 / n)]


def term_rows(column) -> np.ndarray:
    """Weighted term vectors, one row of unit length per text; the empty text is all zeros but its signs."""
    raw, offsets = utf8_rows(column)
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    out = np.zeros((n, SIGNS + TERMS), np.float32)
    if len(raw) > 2:
        kind = CLASS[raw]
        gram = (kind[:-2] * 140 + kind[1:-1]) * 140 + kind[2:]
        gram = ((gram * 0x9E3779B1) >> 7) % TERMS
        doc = np.repeat(np.arange(n), sizes)
        inside = doc[:-2] == doc[2:]
        counts = np.bincount(doc[:-2][inside] * TERMS + gram[inside], minlength=n * TERMS).reshape(n, TERMS)
        out[:, SIGNS:] = np.log1p(200.0 * counts / np.maximum(sizes, 50)[:, None])
    data = raw.tobytes()
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        for j, share in enumerate(repetition(data[a:b])):
            out[i, 10 * j + min(9, int(share * 10))] = 1.0
    return out


class Space:
    """Latent-semantic space of a sample: term weights, axes, and the labelled vectors in it."""

    def __init__(self, terms: np.ndarray, y: np.ndarray, dims: int = DIMS):
        df = (terms > 0).sum(0) / max(1, len(terms))
        self.weight = np.where(df > 0, np.log((1 + len(terms)) / (1 + df * len(terms))) + 0.1, 0).astype(np.float32)
        self.weight[:SIGNS] *= 4
        self.center = np.zeros(terms.shape[1], np.float32)
        self.axes = np.zeros((terms.shape[1], 1), np.float32)
        if len(terms):
            x = self._terms(terms)
            self.center = x.mean(0)
            x = x - self.center
            # Axes of the sample from the smaller of its two Gram matrices.
            gram = x.T.astype(np.float64) @ x
            values, vectors = np.linalg.eigh(gram)
            self.axes = vectors[:, ::-1][:, :dims].astype(np.float32)
        self.vectors = self.place(terms)
        self.y = y.astype(np.float32)

    def _terms(self, terms: np.ndarray) -> np.ndarray:
        x = terms * self.weight
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)

    def place(self, terms: np.ndarray) -> np.ndarray:
        z = (self._terms(terms) - self.center) @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-6)

    def vote(self, terms: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, weighted by similarity; 0.5 without any."""
        if not len(self.y):
            return np.full(len(terms), 0.5)
        near = self.place(terms) @ self.vectors.T
        k = min(k, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        cosine = np.take_along_axis(near, top, 1).astype(np.float64)
        weight = np.exp(SHARPNESS * (cosine - 1)) + 1e-9
        return (weight * self.y[top]).sum(1) / weight.sum(1)


def fit(sample: DataFrame, dims: int = DIMS) -> Space:
    """Space of a bounded sample (``text, y``); its term vectors are made by the executors."""
    def vectors(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = term_rows(part.column(0)).astype(np.float16)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary()), part.column(1)], ["x", "y"])

    rows = sample.mapInArrow(vectors, "x binary, y int").collect()
    # In an order of their own, whatever order they came in.
    rows.sort(key=lambda r: (bytes(r["x"]), r["y"]))
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.float16).reshape(-1, SIGNS + TERMS).astype(np.float32)
    return Space(x, np.array([r["y"] for r in rows]), dims)


def score_quality(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE // 2, label: str = "quality") -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs`` (``doc_id, text``).

    The score, 0 to 1, is the weighted share of label 1 among the nearest labelled documents; texts alone decide it. Null texts score as
    empty ones; repeated rows are returned each; without labels all scores are 0.5. Empty tables give no rows.
    """
    space = docs.sparkSession.sparkContext.broadcast(fit(training_sample(docs, labels, label, limit)))

    def score(batches):
        for batch in batches:
            _, offsets = utf8_rows(batch.column(2))
            at = 0
            while at < batch.num_rows:
                to = int(np.searchsorted(offsets, offsets[at] + TEXT_BYTES, side="right")) - 1
                to = min(max(to, at + 1), at + ROWS, batch.num_rows)
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(space.value.vote(term_rows(part.column(2))))],
                                                 ["doc_id", "held_out", "score"])
                at = to

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    scored = rows.mapInArrow(score, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
