"""Cumulative-link (proportional odds) regression on hashed text features.

P(grade <= k | x) = sigmoid(theta_k - w.x): one weight vector is shared by all
grades and the thresholds are ordered. The features of a text are the presence of
hashed words plus, for quality, hashed shapes and bucketed statistics of the whole
text. Weights are fitted by accelerated proximal gradient with an L1 penalty,
so words that carry no signal get the weight 0 and long texts gather no noise;
features without a marked difference in grade are screened out before.

Training takes a bounded sample of the labelled rows: ``max_rows``, by hash of the
document id. Everything else (scoring) covers every text in full, in one pass
without a shuffle.

Nulls: null and empty texts have no word features; rows with a null grade or id
don't train; without labelled rows every document gets the lowest known grade
(0) with tail probability 0. Repeated rows are each graded alike; of several labels of one id the highest counts. An empty
table gives no rows, long texts are graded whole, clashing output names get underscores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blobs, fresh, map_text
from .textcore import ALNUM_WORDS, BLANK_WORDS, Words, mix

U64 = np.uint64
BITS = 20
#: Bytes of word beginnings that are features too: inflected and compounded forms share them.
STEMS = (3, 4, 5)
MAX_ROWS = 8_000


def word_features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, distinct and sorted: hashed lower-case words and beginnings of words."""
    w = Words(raw, off, ALNUM_WORDS, lower=True)
    doc, f = [w.doc], [w.hashes()]
    head = w.starts8()
    for n in STEMS:
        long = w.end - w.start > n
        doc.append(w.doc[long])
        f.append(mix((head[long] & U64((1 << 8 * n) - 1)) + U64(n << 56)))
    return _distinct(np.concatenate(doc), (np.concatenate(f) >> U64(64 - BITS)).astype(np.int64))


def _distinct(doc: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = (doc.astype(np.int64) << BITS) | f
    x.sort()
    if len(x):
        x = x[np.concatenate([[True], x[1:] != x[:-1]])]
    return x >> BITS, x & ((1 << BITS) - 1)


_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_SIGN = np.zeros(256, bool)
_SIGN[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in ".,;:'\"-"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True


def quality_features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words, hashed word endings that are no letters, and buckets of whole-text shares."""
    n = len(off) - 1
    w = Words(raw, off, BLANK_WORDS)
    h = w.hashes()
    doc, f = [w.doc], [(h >> U64(64 - BITS)).astype(np.int64)]
    if len(w):
        tail = raw[w.end - 1].astype(np.int64) * 256 + np.where(w.end - w.start > 1, raw[np.maximum(w.end - 2, 0)], 0)
        odd = _SIGN[raw[w.end - 1]]
        doc.append(w.doc[odd])
        f.append((mix(tail[odd].astype(U64) + U64(1 << 32)) >> U64(64 - BITS)).astype(np.int64))
    words = np.diff(w.first)
    size = np.maximum(np.diff(off), 1)
    _, first = np.unique((h & ~U64(0xFFFFF)) | (w.doc.astype(U64) & U64(0xFFFFF)), return_index=True)
    kinds = np.bincount(w.doc[first], minlength=n)
    same = np.zeros(n)
    if len(w) > 1:
        eq = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
        same = np.bincount(w.doc[1:][eq], minlength=n)
    total = lambda t: np.diff(np.concatenate([[0], np.cumsum(t[raw])])[off])
    shares = [kinds / np.maximum(words, 1), same / np.maximum(words, 1), total(_UPPER) / size, total(_SIGN) / size, total(_DIGIT) / size, np.minimum(size / np.maximum(words, 1) / 20, 1), np.minimum(np.log2(words + 1) / 16, 1)]
    for k, s in enumerate(shares):
        doc.append(np.arange(n))
        f.append((mix(((np.ceil(np.clip(s, 0, 1) * 20)).astype(np.int64) + 1000 * (k + 1)).astype(U64) + U64(1 << 40)) >> U64(64 - BITS)).astype(np.int64))
    return _distinct(np.concatenate(doc), np.concatenate(f))


FEATURES = {"words": word_features, "quality": quality_features}


@dataclass
class Ordinal:
    """Fitted model: grades in order, thresholds (one fewer) and weights over hashed features."""

    grades: np.ndarray
    theta: np.ndarray
    weights: np.ndarray

    def score(self, doc: np.ndarray, f: np.ndarray, n: int, tail: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and P(grade >= tail) of each of n texts; the highest grade, if None."""
        if len(self.grades) < 2:
            sure = len(self.grades) > 0 and tail is not None and self.grades[0] >= tail
            return np.full(n, float(self.grades[0]) if len(self.grades) else 0.0), np.full(n, float(sure))
        z = np.bincount(doc, self.weights[f], n)
        at_most = _sigmoid(self.theta[None, :] - z[:, None])
        p = np.diff(np.concatenate([np.zeros((n, 1)), at_most, np.ones((n, 1))], 1), axis=1)
        high = self.grades >= (self.grades[-1] if tail is None else tail)
        return p @ self.grades.astype(float), p[:, high].sum(1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_rows(doc: np.ndarray, f: np.ndarray, y: np.ndarray, l1: float = 2e-4, steps: int = 300, least_docs: int = 2, least_far: float = 3.0) -> Ordinal:
    """Fits on (text, feature) pairs and grades y; features in fewer than ``least_docs`` texts, or
    whose texts' grades differ from the mean by under ``least_far`` standard errors, are left out."""
    grades = np.unique(y)
    n, k = len(y), len(grades)
    w = np.zeros(1 << BITS)
    if k < 2:
        return Ordinal(grades, np.zeros(0), w)
    df = np.bincount(f, minlength=1 << BITS)
    # screening: how far the mean grade of a feature's texts lies from that of all, in standard errors
    off = y - y.mean()
    far = np.abs(np.bincount(f, off[doc], 1 << BITS)) / np.sqrt(np.maximum(df, 1)) / max(off.std(), 1e-9)
    used = (df >= least_docs) & (far >= least_far)
    ok = used[f]
    at = (np.cumsum(used, dtype=np.int32) - np.int32(1))[f[ok]]
    doc, used = doc[ok].astype(np.int32), np.flatnonzero(used)
    g = np.searchsorted(grades, y)
    # equal weight of the grades, so that a rare grade counts
    wt = (n / k / np.bincount(g, minlength=k))[g] / n
    share = np.cumsum(np.full(k, 1 / k))[:-1]
    theta = np.log(share / (1 - share))
    v, theta_v = np.zeros(len(used)), theta.copy()
    x, theta_x, t = v.copy(), theta.copy(), 1.0
    rows = np.arange(n)
    step = 4.0 / max(1.0, float(np.sqrt(np.bincount(doc, minlength=n).mean()) * 4)) * 4
    scale = 1 / np.sqrt(1 + np.bincount(at, wt[doc], len(used)) * 50)
    for _ in range(steps):
        z = np.bincount(doc, v[at], n)
        a = np.concatenate([np.zeros((n, 1)), _sigmoid(theta_v[None, :] - z[:, None]), np.ones((n, 1))], 1)
        hi, lo = a[rows, g + 1], a[rows, g]
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi), lo * (1 - lo)
        gz = wt * (dhi - dlo) / p
        gt = np.bincount(np.minimum(g, k - 2), np.where(g < k - 1, -wt * dhi / p, 0), k - 1) + np.bincount(np.maximum(g - 1, 0), np.where(g > 0, wt * dlo / p, 0), k - 1)
        gw = np.bincount(at, gz[doc], len(used))
        new = v - step * scale * gw
        new = np.sign(new) * np.maximum(np.abs(new) - step * scale * l1, 0)
        new_t = np.sort(theta_v - 2.0 * gt)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if float(((v - new) * (new - x)).sum()) > 0:  # overshoot: restart the momentum
            s = 1.0
        v, theta_v = new + (t - 1) / s * (new - x), np.sort(new_t + (t - 1) / s * (new_t - theta_x))
        x, theta_x, t = new, new_t, s
    w[used] = x
    return Ordinal(grades, theta_x, w)


def fit(docs: DataFrame, labels: DataFrame, grade: str, features: str = "words", doc_id: str = "doc_id", text: str = "text", max_rows: int = MAX_ROWS, **options) -> Ordinal:
    """Fits on labelled documents. The sample: rows whose hashed id falls under max_rows / all labelled rows."""
    lab = labels.select(F.col(doc_id).alias("i"), F.col(grade).cast("double").alias("y")).where("i is not null and y is not null").groupBy("i").agg(F.max("y").alias("y"))
    rows = lab.count()
    if not rows:
        return Ordinal(np.zeros(0), np.zeros(0), np.zeros(1 << BITS))
    if rows > max_rows:
        lab = lab.where(F.pmod(F.xxhash64("i"), F.lit(1 << 30)) < int((1 << 30) * max_rows / rows))
    # at most a little over max_rows small rows: bounded, so it may be broadcast
    d = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).join(F.broadcast(lab), "i")
    make = FEATURES[features]

    def task():
        def f(raw, off, _):
            doc, x = make(raw, off)
            return [blobs(x.astype(np.int32), np.searchsorted(doc, np.arange(len(off))))]

        return f

    got = map_text(d, "t", task, [T.StructField("x", T.BinaryType())], ["i", "y"]).drop("i").toLocalIterator()
    xs, ys = [], []
    for r in got:
        xs.append(np.frombuffer(r.x, np.int32))
        ys.append(r.y)
    doc = np.repeat(np.arange(len(xs), dtype=np.int32), [len(x) for x in xs])
    return fit_rows(doc, np.concatenate(xs) if xs else np.zeros(0, np.int32), np.array(ys), **options)


def grade(docs: DataFrame, model: Ordinal, features: str = "words", text: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("expected_grade", "p_top"), tail: float | None = None) -> DataFrame:
    """Adds the expected grade and the probability of at least the grade ``tail`` (the highest, if None)."""
    make = FEATURES[features]
    used = np.flatnonzero(model.weights)
    sent = docs.sparkSession.sparkContext.broadcast((model.grades, model.theta, used, model.weights[used]))

    def task():
        grades, theta, at, val = sent.value
        w = np.zeros(1 << BITS)
        w[at] = val
        m = Ordinal(grades, theta, w)

        def f(raw, off, _):
            e, p = m.score(*make(raw, off), len(off) - 1, tail)
            return [pa.array(e), pa.array(p)]

        return f

    return map_text(docs, text, task, [T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.DoubleType())], keep)


#: A document is rejected as toxic from this probability of the highest grade on.
TOXIC_FROM = 0.4


def reject(docs: DataFrame, model: Ordinal, threshold: float = TOXIC_FROM) -> DataFrame:
    """The documents whose probability of the highest grade is under the threshold, with their own columns."""
    names = fresh(docs, "sg_grade"), fresh(docs, "sg_top")
    return grade(docs, model, names=names).where(F.col(names[1]) < threshold).select(*docs.columns)
