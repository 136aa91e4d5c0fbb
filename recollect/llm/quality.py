"""Quality classifier: supervised subword embeddings.

Each hashed word and character n-gram has a learned vector; a document is the average of its vectors; a softmax layer gives
the probability of label 1. Trained by stochastic gradient descent in numpy in a task, from a bounded sample.

For scoring, the average of vectors times the output layer equals the average of each vector times the output layer, so the
broadcast model is one number a bucket.

Null and empty texts have no features and get the model's bias alone. Without both labels in the sample every score is 1.0
if only good ones (or none at all) are known, else 0.0. Repeated rows and equal texts are scored alike, ties need no order. Texts
of any length are scored whole. Columns pass through whatever their names; one of the score's name gives way. An empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .features import held_out, sampled_rows, scored, subword_features


@dataclass(frozen=True)
class Params:
    bits: int = 17  # hash buckets: 2**bits
    sizes: tuple[int, ...] = (2, 3)  # of character n-grams
    width: int = 8  # of the vectors
    epochs: int = 4
    rate: float = 0.4
    seed: int = 7
    #: Labelled rows learned from, at most, of each label.
    sample_per_label: int = 2000
    #: Characters of their texts, at most, of each label (features.labelled_sample).
    sample_characters: int = 1 << 25
    threshold: float = 0.7


def bag(text: str, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their shares of the text's features."""
    parts = [b for b, _ in subword_features([text], p.bits, p.sizes)]
    found, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64), np.zeros(0))
    return found.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)


def train(texts: list[str], labels: list[int], stands: tuple[float, float] = (1.0, 1.0), p: Params = Params()) -> tuple[np.ndarray, float]:
    """The weight of each bucket and the bias: the log-odds of label 1 are bias + mean of weights.

    stands: for how many labelled rows a row of each label stands. The bias takes the log of their ratio, so that the scores
    follow the shares of the labels in the whole table, however many of each the sample holds.
    """
    if len(set(labels)) < 2:
        return np.zeros(1 << p.bits, np.float32), 30.0 if not labels or labels[0] == 1 else -30.0
    rng = np.random.default_rng(p.seed)
    bags = [bag(x, p) for x in texts]
    E = rng.uniform(-1 / p.width, 1 / p.width, (1 << p.bits, p.width))
    W, b = np.zeros((p.width, 2)), np.zeros(2)
    steps, done = p.epochs * len(bags), 0
    for _ in range(p.epochs):
        for k in rng.permutation(len(bags)):
            rate = p.rate * (1 - done / steps) + 1e-3
            done += 1
            at, share = bags[k]
            h = share @ E[at]
            z = h @ W + b
            q = np.exp(z - z.max())
            q /= q.sum()
            q[labels[k]] -= 1
            down = W @ q
            W -= rate * np.outer(h, q)
            b -= rate * 0.1 * q
            # shares are small in long texts; the step of a vector grows with the text's distinct features
            E[at] -= rate * np.minimum(1.0, share * len(at))[:, None] * down
    return (E @ (W[:, 1] - W[:, 0])).astype(np.float32), float(b[1] - b[0] + np.log(stands[1] / stands[0]))


def mean_scores(texts: list[str], weights: np.ndarray, bias: float, p: Params) -> np.ndarray:
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for buckets, doc in subword_features(texts, p.bits, p.sizes):
        total += np.bincount(doc, weights[buckets], len(texts))
        count += np.bincount(doc, minlength=len(texts))
    return (1 / (1 + np.exp(-np.clip(bias + total / np.maximum(1, count), -35, 35))))[:, None]


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> tuple[np.ndarray, float]:
    """Learns from at most p.sample_per_label labelled rows of each label, none of them held out.

    The sample, which is bounded, is learned from in a task; the driver gets the model alone, and none of the texts.
    """
    rows, stands = sampled_rows(docs, labels, "quality", p.sample_per_label, ~held_out(), p.sample_characters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sorted(x for b in batches for x in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
        weights, bias = train([x for _, x, _ in known], [y for _, _, y in known], stands, p)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()]), pa.array([bias])], names=["weights", "bias"])

    model = rows.coalesce(1).mapInArrow(run, "weights binary, bias double").first()
    return (np.frombuffer(model.weights, np.float32), model.bias) if model else train([], [], stands, p)


def classify(docs: DataFrame, model: tuple[np.ndarray, float], p: Params = Params(), text: str = "text", score: str = "score") -> DataFrame:
    """docs with the probability of label 1, from the text alone."""
    weights, bias = model
    return scored(docs, text, [score], lambda texts: mean_scores(texts, weights, bias, p))
