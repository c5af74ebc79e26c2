"""Language identification by averaged embeddings of hashed subwords and a linear softmax.

A text is the average of the vectors of its words' character n-grams (two to four code points, word ends
counted as one), each found by a hash. Vectors and softmax are trained by stochastic gradient descent.
Rejection is calibrated on a part of the sample that training doesn't see: by a temperature and the least
probability to accept, and by how usual a text's n-grams are in the language predicted, as a softmax is sure
of languages it has never seen. The latter is the mean logarithm of their shares in the training texts, less
that of a usual text, in units that allow a short text to stray farther.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import Numbers
from .common import by_rows, give_back

UNDETERMINED = "und"
BUCKETS, SIZES = 1 << 14, (2, 3, 4)
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every n-gram of all texts, and which text it is of."""
    points = [np.frombuffer(t.lower().encode("utf-32-le"), np.uint32) for t in texts]
    gap = np.zeros(max(SIZES) - 1, np.uint32)
    flat = np.concatenate([gap, *(x for p in points for x in (p, gap))])
    of = np.repeat(np.arange(len(texts)), [len(p) + len(gap) for p in points])
    of = np.concatenate([np.zeros(len(gap), np.int64), of])
    code = np.where(letters()[flat], flat, 0).astype(np.uint32)
    word = code != 0
    hashes, texts_of = [], []
    for n in SIZES:
        m = len(code) - n + 1
        ok = word[0:m] | word[n - 1 : n - 1 + m]
        for k in range(1, n - 1):
            ok = ok & word[k : k + m]
        at = np.flatnonzero(ok)
        h = np.full(len(at), n * 2654435761 % 2**32, np.uint32)
        for k in range(n):
            h = (h ^ code[at + k]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        hashes.append(((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - 14)).astype(np.int64))
        texts_of.append(of[at + n // 2])
    return np.concatenate(hashes), np.concatenate(texts_of)


def bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its n-grams' buckets and each one's share; a text without letters has none."""
    out = []
    for t in texts:
        bucket, n = np.unique(grams([t])[0], return_counts=True)
        out.append((bucket.astype(np.int32), (n / max(n.sum(), 1)).astype(np.float32)))
    return out


def dense(some: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    x = np.zeros((len(some), BUCKETS), np.float32)
    for row, (bucket, share) in zip(x, some, strict=True):
        row[bucket] = share
    return x


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


#: A text's n-grams beyond so many don't make it less free to stray from the usual.
STEADY = 200


@dataclass
class Model:
    """weights: what each bucket adds to each language's score (its vector times the softmax layer). shares: the logarithm of each bucket's share in a language's texts; middle: their mean in a usual text."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    shares: np.ndarray
    middle: np.ndarray
    temperature: float = 1.0
    accept: float = 0.0
    usual: float = -np.inf

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "seen"}

    def forget(self) -> None:
        """Lets go of the words remembered."""
        self.__dict__.pop("seen", None)

    def sums(self, texts: list[str], most: int = 250_000) -> np.ndarray:
        """For each text the sums of its n-grams' weights, of the logarithms of their shares, and their number. No n-gram crosses white space, so each distinct word is looked up once."""
        each = np.concatenate([self.weights, self.shares], axis=1)
        if "seen" not in self.__dict__ or len(self.seen[0]) > most:
            self.seen = [Numbers(), np.zeros((1 << 12, each.shape[1] + 1), np.float32)]
        number, table = self.seen
        words = [t.lower().split() for t in texts]
        which = np.fromiter((number[w] for own in words for w in own), np.int64, sum(map(len, words)))
        if number.new:
            while len(number) > len(table):
                table = self.seen[1] = np.concatenate([table, np.zeros_like(table)])
            bucket, of = grams(number.new)
            size, first = len(number), len(number) - len(number.new)
            for k in range(each.shape[1]):
                table[first:size, k] = np.bincount(of, each[bucket, k], size - first)
            table[first:size, -1] = np.bincount(of, minlength=size - first)
            number.new = []
        ends = np.concatenate([[0], np.cumsum([len(own) for own in words])])
        total = np.zeros((len(texts), table.shape[1]), np.float64)
        some = np.flatnonzero(np.diff(ends))
        if len(some):
            total[some] = np.add.reduceat(table[which].astype(np.float64), ends[some], axis=0)
        return total

    def scores(self, texts: list[str], at_once: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text the languages' scores, how usual it is in each, and its number of n-grams. at_once: so many texts' words are held at a time."""
        total, n = np.concatenate([self.sums(texts[i : i + at_once]) for i in range(0, max(len(texts), 1), at_once)]), len(self.languages)
        number = total[:, -1:]
        mean = total[:, :-1] / np.maximum(number, 1)
        return mean[:, :n] + self.bias, (mean[:, n:] - self.middle) * np.sqrt(np.minimum(number, STEADY) / STEADY), total[:, -1]

    def judged(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text its best language's number, its calibrated probability, and whether it is rejected. Without n-grams: 0, 0 and rejected."""
        z, usual, n = self.scores(texts)
        p = softmax(z / self.temperature)
        best = p.argmax(axis=1)
        at = np.arange(len(best))
        score = np.where(n > 0, p[at, best], 0.0)
        return np.where(n > 0, best, 0), np.clip(score, 0, 1), (n == 0) | (score < self.accept) | (usual[at, best] < self.usual)


def train(texts: list[str], langs: list[str], size: int = 16, epochs: int = 4, batch: int = 32, rate: float = 40.0, rejected: float = 0.0005, seed: int = 0) -> Model:
    """A model of the languages seen. Each text counts twice, as a whole and by one of its lines, so that short texts are known too.

    rejected: the share of rightly labelled calibration texts (whole ones, and up to eight lines of each) that may
    fall below the accepted probability.
    """
    names = sorted(set(langs))
    if not names:
        return Model([], *(np.zeros(x, np.float32) for x in ((BUCKETS, 0), 0, (BUCKETS, 0), 0)))
    rng = np.random.default_rng(seed)
    y = np.array([names.index(x) for x in langs])
    order = rng.permutation(len(texts))
    held, fit = order[: len(texts) // 5], order[len(texts) // 5 :]  # held: for calibration
    lines = [rng.choice(t.split("\n")) for t in texts]
    pool = [(x, y[i]) for some in (texts, lines) for x, i in zip(bags([some[i] for i in fit]), fit, strict=True) if len(x[0])]
    vectors = rng.normal(0, 0.1, (BUCKETS, size)).astype(np.float32)
    layer, bias = np.zeros((size, len(names)), np.float32), np.zeros(len(names), np.float32)
    steps, step = max(1, epochs * -(-len(pool) // batch)), 0
    for _ in range(epochs):
        mixed = rng.permutation(len(pool))
        for i in range(0, len(pool), batch):
            some = [pool[j] for j in mixed[i : i + batch]]
            x, t = dense([a for a, _ in some]), np.array([b for _, b in some])
            h = x @ vectors
            d = softmax(h @ layer + bias)
            d[np.arange(len(t)), t] -= 1
            d /= len(t)
            now = np.float32(rate * (1 - step / steps))
            down = d @ layer.T
            layer -= now / 8 * (h.T @ d)
            bias -= now / 40 * d.sum(axis=0)
            vectors -= now * (x.T @ down)
            step += 1
    counts = np.full((BUCKETS, len(names)), 0.5)
    for i in fit:
        np.add.at(counts[:, y[i]], grams([texts[i]])[0], 1.0)
    model = Model(names, vectors @ layer, bias, np.log(counts / counts.sum(axis=0)).astype(np.float32), np.zeros(len(names), np.float32))
    if len(held):
        some = [(x, y[i]) for i in held for x in [texts[i], *list(rng.permutation(texts[i].split("\n")))[:8]]]
        calibrate(model, [x for x, _ in some], np.array([k for _, k in some]), rejected)
    return model


def calibrate(model: Model, texts: list[str], y: np.ndarray, rejected: float) -> None:
    """Sets the temperature of the least log loss, then the least probability and the least usualness to accept."""
    z, usual, n = model.scores(texts)
    loss = lambda t: -np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean()
    model.temperature = float(min(np.geomspace(0.05, 8, 60), key=loss))
    best = softmax(z / model.temperature)
    ok = (best.argmax(axis=1) == y) & (n > 0)
    for k in range(len(model.languages)):
        own = usual[ok & (y == k) & (n >= STEADY), k]
        model.middle[k] = np.median(own) if len(own) else -1e9  # too few long texts: nothing is unusual
    usual = model.scores(texts)[1]
    least = lambda v: float(np.sort(v)[int(len(v) * rejected)]) if len(v) else 0.0
    model.accept = least(best.max(axis=1)[ok])
    model.usual = least(usual[np.arange(len(y)), y][ok])


def eligible(held_out: int, folds: int) -> Column:
    """Rows that may be learnt from, in the JVM; see id_remainder."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds != held_out


def labelled_sample(rows: DataFrame, most: int, *columns: str) -> list:
    """At most `most` rows of a table (doc_id and columns), those of least hash of the id: the same at every run, and chosen alike at every size."""
    n, order = rows.count(), F.xxhash64("doc_id")
    if n > 4 * most:  # few rows of other hashes can be among the least, so that each task sends few
        rows = rows.where(order < -(1 << 63) + (1 << 64) * 2 * most // n)
    return sorted(rows.select("doc_id", *columns).orderBy(order, "doc_id", *columns).limit(most).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, str(r[-1])))


def fitted(docs: DataFrame, most: int = 3000, held_out: int = 2, folds: int = 4) -> Model:
    """A model from text and lang of at most `most` documents outside the held-out fold (a documented bound of the training sample)."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & eligible(held_out, folds))
    some = labelled_sample(rows.select("doc_id", "text", "lang"), most, "text", "lang")
    model = train([r["text"] for r in some], [r["lang"] for r in some])
    model.forget()
    del some
    give_back()  # this is the driver, whose memory the JVM shares
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All of docs' rows and columns in a struct named row, with lang_pred, score and rejected.

    score: the predicted language's calibrated probability. A text that is null or has no letter, or any
    if no language was learnt, is "und" with score 0 and rejected; a text of less probability than the
    model accepts, or whose n-grams are too unusual in its language, is rejected but keeps its prediction. An empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size for each language

    def fn(texts: list[str]) -> dict[str, list]:
        m = held.value
        if not m.languages:
            return {"lang_pred": [UNDETERMINED] * len(texts), "score": [0.0] * len(texts), "rejected": [True] * len(texts)}
        best, score, rejected = m.judged(texts)
        return {"lang_pred": [m.languages[b] if s > 0 else UNDETERMINED for b, s in zip(best, score, strict=True)], "score": score.tolist(), "rejected": rejected.tolist()}

    return by_rows(docs, fn, "lang_pred string, score double, rejected boolean")

