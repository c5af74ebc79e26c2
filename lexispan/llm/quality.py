"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. A line's score comes from features of itself and of the lines before and after
it, and neighbouring labels have a score of their own. The marginals of forward-backward, weighted by the
lines' lengths, give a document's share of good text; a logistic curve turns it into a probability of
label 1. Labels are given for documents alone, so training alternates: lines get labels from their
document (a bad one's lines that the field holds for good may stay good), and the field is fitted to them
by gradient ascent on the chains' likelihood.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_rows
from .langid import eligible, labelled_sample

UPPER, LETTER, DIGIT, SYMBOL, STOP = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", b"0123456789", b"#$%&*|!@^~_=+<>{}[]\\", b".,;:"
OWN = 12


def features(line: str) -> tuple[float, ...]:
    """A line's own features, each of the order of one."""
    raw = line.encode()
    n = len(raw) or 1
    count = lambda drop: len(raw) - len(raw.translate(None, drop))
    words = raw.split()
    k = len(words) or 1
    letters = count(LETTER)
    same = sum(map(bytes.__eq__, words, words[1:]))
    odd = sum(w[-1] in SYMBOL for w in words)
    different = len(set(words))
    return (
        count(UPPER) / (letters or 1),
        count(DIGIT) / n * 5,
        count(SYMBOL) / n * 5,
        count(STOP) / n * 10,
        same / k,
        different / k,
        odd / k,
        np.log1p(k) / 4,
        min(n / k / 10, 3.0),
        float(k < 4),
        raw.count(b"|") / k,
        different / k * np.log1p(k) / 4,
    )


def alike(docs: list[np.ndarray], batch: int, cells: int = 1 << 17) -> list[list[int]]:
    """The documents' numbers in groups of like length, of at most so many documents and, unless one alone has more, so many lines when padded."""
    groups: list[list[int]] = [[]]
    for i in sorted(range(len(docs)), key=lambda i: len(docs[i])):
        if groups[-1] and (len(groups[-1]) == batch or (len(groups[-1]) + 1) * len(docs[i]) > cells):
            groups.append([])
        groups[-1].append(i)
    return groups if docs else []


def padded(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Documents' lines (own features) in one array with those of the lines before and after and a constant, and which places are lines."""
    most = max(len(d) for d in docs)
    own = np.zeros((len(docs), most + 2, OWN), np.float32)
    real = np.zeros((len(docs), most), bool)
    for x, r, d in zip(own, real, docs, strict=True):
        x[1 : len(d) + 1] = d
        r[: len(d)] = True
    return np.concatenate([own[:, 1:-1], own[:, :-2], own[:, 2:], np.ones((len(docs), most, 1), np.float32)], axis=2), real


def logsum(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Field:
    """weights: (2, features); moves: (2, 2), of one line's label and the next one's. curve: of the logistic function."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros((2, 3 * OWN + 1)))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    curve: tuple[float, float] = (1.0, 0.0)

    def marginals(self, x: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each line's label probabilities, and the sums over lines of neighbours' joint ones."""
        s = x @ self.weights.T
        n, most, _ = s.shape
        ahead, back = np.zeros_like(s), np.zeros_like(s)
        ahead[:, 0] = s[:, 0]
        for i in range(1, most):
            ahead[:, i] = np.where(real[:, i, None], logsum(ahead[:, i - 1, :, None] + self.moves, 1) + s[:, i], ahead[:, i - 1])
        for i in range(most - 2, -1, -1):
            back[:, i] = np.where(real[:, i + 1, None], logsum(self.moves + (s[:, i + 1] + back[:, i + 1])[:, None, :], 2), back[:, i + 1])
        total = logsum(ahead[:, -1], 1)
        one = np.where(real[..., None], np.exp(ahead + back - total[:, None, None]), 0)
        pair = ahead[:, :-1, :, None] + self.moves + (s[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, None, None, None]
        return one, np.where(real[:, 1:, None, None], np.exp(np.minimum(pair, 0)), 0).sum(axis=1)

    def good(self, docs: list[np.ndarray], batch: int = 256) -> list[np.ndarray]:
        """Each document's lines' probabilities of being good."""
        out: list = [None] * len(docs)
        for some in alike(docs, batch):
            one, _ = self.marginals(*padded([docs[j] for j in some]))
            for k, j in enumerate(some):
                out[j] = one[k, : len(docs[j]), 1]
        return out

    def probability(self, shares: np.ndarray) -> np.ndarray:
        a, b = self.curve
        s = np.clip(shares, 1e-4, 1 - 1e-4)
        return 1 / (1 + np.exp(-np.clip(a * np.log(s / (1 - s)) + b, -30, 30)))


def read(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's lines' features and lengths; an empty text is one line of length one."""
    lines = text.split("\n")
    found = [np.array([features(x) for x in lines[i : i + 4096]], np.float32) for i in range(0, len(lines), 4096)]
    return np.concatenate(found), np.array([max(len(x), 1) for x in lines], np.float64)


def shares(found: list[np.ndarray], lengths: list[np.ndarray]) -> np.ndarray:
    return np.array([(p * n).sum() / n.sum() for p, n in zip(found, lengths, strict=True)])


def train(texts: list[str], quality: list[int], rounds: int = 3, epochs: int = 8, batch: int = 64, rate: float = 0.5, decay: float = 1e-4, seed: int = 0) -> Field:
    """A field from documents and their labels."""
    crf = Field()
    if not texts:
        return crf
    rng = np.random.default_rng(seed)
    pairs = [read(t) for t in texts]
    docs, lengths = [a for a, _ in pairs], [b for _, b in pairs]
    y = np.array(quality)
    labels = [np.full(len(d), q) for d, q in zip(docs, y, strict=True)]
    for r in range(rounds):
        if r:
            for i, p in enumerate(crf.good(docs)):
                if y[i] == 0:  # its lines that look good may be; the worst one can't
                    labels[i] = (p > 0.5).astype(int)
                    labels[i][int(np.argmin(p))] = 0
        groups = alike(docs, batch)
        for e in range(epochs):
            for g in rng.permutation(len(groups)):
                some = groups[g]
                x, real = padded([docs[i] for i in some])
                one, two = crf.marginals(x, real)
                gold = np.zeros_like(one)
                for k, i in enumerate(some):
                    gold[k, np.arange(len(docs[i])), labels[i]] = 1
                moved = np.einsum("nia,nib->nab", gold[:, :-1], gold[:, 1:])
                n = real.sum()
                now = rate / (1 + 0.3 * (r * epochs + e))
                crf.weights += now * (np.einsum("nia,nif->af", gold - one, x) / n * 10 - decay * crf.weights)
                crf.moves += now * ((moved - two).sum(axis=0) / n * 10 - decay * crf.moves)
    fit_curve(crf, shares(crf.good(docs), lengths), y)
    return crf


def fit_curve(crf: Field, s: np.ndarray, y: np.ndarray, steps: int = 400) -> None:
    """The logistic curve of the labels on the shares' log odds; Newton steps with a little ridge."""
    s = np.clip(s, 1e-4, 1 - 1e-4)
    x = np.stack([np.log(s / (1 - s)), np.ones(len(s))], axis=1)
    w = np.array([0.5, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(2), x.T @ (y - p) - 0.5 * w)
        w += np.clip(step, -0.5, 0.5)
        if np.abs(step).max() < 1e-8:
            break
    crf.curve = (max(float(w[0]), 1e-3), float(w[1]))


def fitted(docs: DataFrame, labels: DataFrame, most: int = 3000, held_out: int = 0, folds: int = 5) -> Field:
    """A field from text and quality of at most `most` labelled documents outside the held-out fold (a documented bound of the training sample)."""
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & eligible(held_out, folds)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    some = labelled_sample(marks, most, "quality")
    chosen = docs.sparkSession.createDataFrame([(r["doc_id"], int(r["quality"])) for r in some], "doc_id long, _quality int")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "_quality").agg(F.min("text").alias("text")).collect()  # one text an id
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["text"] or ""))
    return train([r["text"] or "" for r in rows], [int(r["_quality"] > 0) for r in rows])


def scored(docs: DataFrame, crf: Field) -> DataFrame:
    """All of docs' rows and columns in a struct named row, with score and lines.

    score: the calibrated probability of label 1; lines: each line's probability of being good, in order.
    A null text counts as empty, and an empty text as one empty line. An empty table gives no rows. A
    field that saw no labels gives every document 0.5.
    """
    held = docs.sparkSession.sparkContext.broadcast(crf)  # of a fixed size

    def fn(texts: list[str]) -> dict[str, list]:
        pairs = [read(t) for t in texts]
        found = held.value.good([a for a, _ in pairs]) if pairs else []
        return {"score": held.value.probability(shares(found, [b for _, b in pairs])).tolist() if pairs else [], "lines": [p.tolist() for p in found]}

    return by_rows(docs, fn, "score double, lines array<double>")
