"""Toxicity: cumulative-link ordinal regression on sparse text features.

Severity grades are 0 (not toxic) and 1 to GRADES. Labels only say toxic or not, so the toxic rows of the sample are graded
before the fit by evidence from rows other than themselves: the sample falls into two halves, each half tells the log-odds of
toxicity of each word, and a toxic row's evidence is the sum of the other half's log-odds over those of its words that speak for
toxicity (LEXICON_ODDS or more). Its grade is the third of the toxic rows in which that sum lies. The model
P(grade <= k) = sigmoid(cut_k - w.x) shares its weights w over the ordered cuts; x says which lower-cased letter runs the text
holds. The expected severity is the sum of P(grade > k). Labels of held-out rows (crc32 of the id leaves 2 when divided by 4)
are not learned from.

Null and empty texts have no features and take the severity of the cuts alone. Without toxic rows in the sample every severity
is 0. Repeated rows and equal texts are graded alike, ties need no order. Texts of any length are graded whole. Columns pass
through whatever their names; those of the results' names give way. An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_chunks, mix64
from .features import held_out, labelled_sample, scored, word_features

GRADES = 3


@dataclass(frozen=True)
class Params:
    bits: int = 20  # hash buckets: 2**bits
    #: Labelled rows learned from, at most, of each label.
    sample_per_label: int = 3000
    #: Characters of their texts, at most, of each label (features.labelled_sample).
    sample_characters: int = 1 << 25
    #: A word must stand in so many rows of the sample to be a feature.
    least_rows: int = 5
    epochs: int = 300
    rate: float = 0.3
    ridge: float = 5e-5
    lasso: float = 3e-4
    #: Words of these log-odds or more speak for toxicity.
    lexicon_odds: float = 1.0
    #: A toxic document that is missed counts as so many clean ones that are flagged.
    miss: float = 4.0
    #: The cut: where the model's probabilities are right, 1 / (1 + miss) costs least. cross_validated() chooses it and `evidence`.
    threshold: float = 0.2
    #: Below a half, a document's odds must also be so many times those of an empty text.
    evidence: float = 4.0
    #: What cross-validation chooses from, and the parts of the sample.
    thresholds: tuple[float, ...] = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5)
    #: More than 1, so that an empty text, and one that speaks for nothing, is never told toxic below a half.
    evidences: tuple[float, ...] = (2.0, 4.0, 8.0, 16.0)
    folds: int = 3


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def presence(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs, by text; a part of the texts at a time, to bound memory."""
    parts = [np.zeros(0, np.int64)]
    for lo, hi in in_chunks(texts, 1 << 18):
        bucket, doc = word_features(texts[lo:hi], bits)
        parts.append(np.unique(((doc + lo) << bits) | bucket))
    both = np.concatenate(parts)
    return both >> bits, both & ((1 << bits) - 1)


def grades(doc: np.ndarray, column: np.ndarray, labels: np.ndarray, columns: int, p: Params) -> np.ndarray:
    half = np.arange(len(labels)) % 2
    evidence = np.zeros(len(labels))
    for own in (0, 1):
        other = half[doc] != own
        a, b = (np.bincount(column[other & (labels[doc] == k)], minlength=columns) for k in (1, 0))
        na, nb = (int(((half != own) & (labels == k)).sum()) for k in (1, 0))
        odds = np.log((a + 0.5) / (na + 1)) - np.log((b + 0.5) / (nb + 1))
        evidence += np.bincount(doc[~other], np.where(odds >= p.lexicon_odds, odds, 0)[column[~other]], len(labels))
    out = np.zeros(len(labels), np.int64)
    cuts = np.quantile(evidence[labels == 1], [k / GRADES for k in range(1, GRADES)])
    out[labels == 1] = 1 + (evidence[labels == 1][:, None] > cuts).sum(1)
    return out


def train(texts: list[str], labels: list[int], stands: tuple[float, float] = (1.0, 1.0), p: Params = Params()) -> tuple[np.ndarray, np.ndarray]:
    """Weights by bucket and the ordered cuts.

    stands: for how many labelled rows a row of each label stands, which is its weight in the fit.
    """
    weights = np.zeros(1 << p.bits, np.float32)
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        return weights, np.full(GRADES, 35.0 if not len(y) or y[0] == 0 else -35.0)
    doc, bucket = presence(texts, p.bits)
    used, column, rows = np.unique(bucket, return_inverse=True, return_counts=True)
    keep = rows >= p.least_rows
    place = np.cumsum(keep) - 1
    doc, column, used = doc[keep[column]], place[column[keep[column]]], used[keep]
    g = grades(doc, column, y, len(used), p)
    w = np.zeros(len(used))
    share = np.array(stands)[y]
    share /= share.sum()
    below = [share[g <= k].sum() for k in range(GRADES)]
    cut = np.array([np.log((b + 1e-3) / (1 - b + 1e-3)) for b in below])
    above = g[:, None] > np.arange(GRADES)
    here = (g[:, None] - 1 <= np.arange(GRADES)) & (np.arange(GRADES) <= g[:, None])  # the cuts on both sides of the grade
    sw, sc = np.full(len(w), 1e-8), np.full(GRADES, 1e-8)
    for _ in range(p.epochs):
        z = np.bincount(doc, w[column], len(y))
        up = sigmoid(z[:, None] - cut)  # P(grade > k)
        lo = np.concatenate([np.ones((len(y), 1)), up], 1)[np.arange(len(y)), g]
        hi = np.concatenate([up, np.zeros((len(y), 1))], 1)[np.arange(len(y)), g]
        # d log P(grade) / d z for the two neighbouring cuts
        slope = up * (1 - up) / np.maximum(lo - hi, 1e-9)[:, None] * np.where(above, 1, -1) * here
        grad_z = -slope.sum(1) * share
        grad_w = np.bincount(column, grad_z[doc], len(w)) + p.ridge * w
        grad_c = share @ slope
        sw, sc = sw + grad_w**2, sc + grad_c**2
        step = p.rate / np.sqrt(sw)
        w = w - step * grad_w
        w = np.sign(w) * np.maximum(0, np.abs(w) - step * p.lasso)
        cut = np.maximum.accumulate(cut - p.rate / np.sqrt(sc) * grad_c)
    weights[used] = w
    return weights, cut


def severities(texts: list[str], weights: np.ndarray, cuts: np.ndarray, p: Params) -> np.ndarray:
    """(expected severity, P(grade > 0)) of each text."""
    bucket, doc = word_features(texts, p.bits)
    on = weights[bucket] != 0
    both = np.unique((doc[on] << p.bits) | bucket[on])
    z = np.bincount(both >> p.bits, weights[both & ((1 << p.bits) - 1)], len(texts))
    up = sigmoid(z[:, None] - cuts)
    return np.stack([up.sum(1), up[:, 0]], 1)


def told(probability: np.ndarray, odds: np.ndarray, threshold: float, evidence: float) -> np.ndarray:
    """grade()'s rule: odds are those of P(grade > 0) over those of an empty text."""
    return (probability >= 0.5) | ((probability >= threshold) & (odds >= evidence))


def cross_validated(texts: list[str], labels: list[int], stands: tuple[float, float] = (1.0, 1.0), p: Params = Params()) -> Params:
    """p with the threshold and the evidence that cost least on rows of the sample that their model had not seen.

    A row counts as many times as it stands for; of choices that cost the same, those nearest to p's are taken. Without both labels p stays.
    """
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        return p
    fold = (mix64(np.arange(1, len(y) + 1, dtype=np.uint64)) % np.uint64(p.folds)).astype(np.int64)
    chance, odds = np.zeros(len(y)), np.zeros(len(y))
    for k in range(p.folds):
        learned, seen = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        model = train([texts[i] for i in learned], y[learned].tolist(), stands, p)
        none = severities([""], *model, p)[0, 1]
        for lo, hi in in_chunks([texts[i] for i in seen], 1 << 18):
            chance[seen[lo:hi]] = severities([texts[i] for i in seen[lo:hi]], *model, p)[:, 1]
        odds[seen] = chance[seen] * (1 - none) / np.maximum(none * (1 - chance[seen]), 1e-300)
    weight = np.array(stands)[y] * np.where(y == 1, p.miss, 1.0)

    def cost(choice: tuple[float, float]) -> tuple[float, float]:
        wrong = told(chance, odds, *choice) != (y == 1)
        return round(float(weight[wrong].sum()), 6), abs(np.log(choice[0] / p.threshold)) + abs(np.log(choice[1] / p.evidence))

    threshold, evidence = min(((t, e) for t in p.thresholds for e in p.evidences), key=cost)
    return replace(p, threshold=threshold, evidence=evidence)


def tuned(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> tuple[tuple[np.ndarray, np.ndarray], Params]:
    """fit()'s model, and p with the cut chosen by cross-validation over the same sample. Held-out rows take no part in either."""
    texts, y, stands = labelled_sample(docs, labels, "toxic", p.sample_per_label, ~held_out(), p.sample_characters)
    return train(texts, y, stands, p), cross_validated(texts, y, stands, p)


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> tuple[np.ndarray, np.ndarray]:
    """Learns from at most p.sample_per_label labelled rows of each label, none of them held out."""
    return train(*labelled_sample(docs, labels, "toxic", p.sample_per_label, ~held_out(), p.sample_characters), p)


def grade(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], p: Params = Params(), text: str = "text", severity: str = "severity", toxic: str = "toxic", probability: str = "p_toxic") -> DataFrame:
    """docs with the expected severity (0 to GRADES), P(grade > 0), and whether that is p.threshold or more.

    A text that speaks hardly more for toxicity than an empty one does is told toxic only from a half on, however common toxic rows are.
    """
    weights, cuts = model
    out = scored(docs.drop(toxic), text, [severity, probability], lambda texts: severities(texts, weights, cuts, p))
    none = float(severities([""], weights, cuts, p)[0, 1])
    return out.withColumn(toxic, (F.col(probability) >= 0.5) | ((F.col(probability) >= p.threshold) & (F.col(probability) * (1 - none) >= p.evidence * none * (1 - F.col(probability)))))
