"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives and unlabelled text are described by ``FEATURES`` (shares of character classes, repetition, word
shape, none of them bound to a language), and a small network g is trained in numpy to minimise
    prior * R_p(+)  +  max(0, R_u(-) - prior * R_p(-)),
with the sigmoid loss; where the second term falls below zero the step goes the other way, which keeps the network
from driving it down by overfitting. The class prior is estimated from a part of the sample held out of the first fit:
the least ratio, over thresholds of the score, of the unlabelled share above it to the positive share above it, plus a
confidence term (best-bin estimate). Scoring reads whole texts.

The fit takes a hashed sample of at most about ``max_docs`` positives and as many unlabelled rows. Known negatives are
never used. Defined results: a null text counts as empty; empty texts get a score like any other; rows with a null key
are scored but never learned from; repeated rows score alike; with no positives or an
empty table every score is 0.5; a very long text is read whole, at some 100 bytes of memory for each character. Other columns of the input are
not read, so names that clash don't matter; keys may have any type.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import char_table, code_points, hash_share, word_spans

FEATURES = (
    "log_chars", "letters", "digits", "spaces", "marks", "upper", "sentence_marks", "odd_marks", "pipes", "word_length",
    "word_spread", "distinct_words", "top_word", "distinct_pairs", "line_length", "distinct_lines", "lines_ended", "lines_opened",
    "marked_words", "upper_words", "digit_words", "long_words", "commas", "trigram_kinds",
)


def features(text: str | None) -> np.ndarray:
    text = text or ""
    out = np.zeros(len(FEATURES), np.float32)
    n = len(text)
    if not n:
        return out
    points = code_points(text)
    low = np.bincount(np.minimum(points, 127), minlength=128) / n
    letters = char_table("letter")[points]
    alnum = char_table("alnum")[points]
    space = char_table("space")[points]
    of = lambda chars: sum(low[ord(c)] for c in chars)
    starts, ends = word_spans(points)
    lengths = ends - starts
    words = text.lower().split()
    counts = Counter(words)
    m = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    grams = (points[:-2].astype(np.uint64) * np.uint64(31) + points[1:-1]) * np.uint64(31) + points[2:] if n > 2 else points.astype(np.uint64)
    cut = text.split()
    out[:] = (
        np.log1p(n), letters.mean(), low[48:58].sum(), space.mean(), (~(alnum | space)).mean(), low[65:91].sum(), of(".!?"), of("#$%&*@~^<>{}[]\\"), of("|"),
        lengths.mean() if len(lengths) else 0, lengths.std() if len(lengths) else 0, len(counts) / m ** 0.8, max(counts.values(), default=0) / m, len(set(zip(words, words[1:]))) / m,
        np.log1p(n / max(1, len(lines))), len(set(lines)) / max(1, len(lines)), sum(x.rstrip()[-1] in ".!?:;\"'" for x in lines) / max(1, len(lines)), sum(x[0].isupper() for x in lines) / max(1, len(lines)),
        sum(not w[-1].isalnum() for w in cut) / m, sum(w.isupper() and len(w) > 1 for w in cut) / m, sum(any(map(str.isdigit, w)) for w in cut) / m, sum(len(w) > 18 for w in cut) / m, of(","), len(np.unique(grams)) / n**0.7,
    )
    return out


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def pu_train(pos: np.ndarray, unl: np.ndarray, prior: float, hidden: int, epochs: int, seed: int) -> QualityModel:
    """Adam on mini-batches of the non-negative risk."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([pos, unl])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-6
    p, u = (np.clip((x - mean) / scale, -6, 6) for x in (pos, unl))
    theta = [rng.normal(0, 1 / np.sqrt(p.shape[1]), (p.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    first, second, step = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta], 0
    for _ in range(epochs):
        for _ in range(max(1, len(u) // 256)):
            xp, xu = p[rng.integers(0, len(p), 128)], u[rng.integers(0, len(u), 256)]
            x = np.concatenate([xp, xu])
            h = np.tanh(x @ theta[0] + theta[1])
            g = h @ theta[2] + theta[3][0]
            s, k = sigmoid(g), len(xp)
            slope = s * (1 - s)  # of the loss of calling x negative; the loss of calling it positive falls as steeply
            negative = s[k:].mean() - prior * s[:k].mean()
            dg = np.zeros_like(g)
            if negative >= 0:
                dg[:k] = -2 * prior * slope[:k] / k
                dg[k:] = slope[k:] / len(xu)
            else:
                dg[:k] = prior * slope[:k] / k
                dg[k:] = -slope[k:] / len(xu)
            dh = dg[:, None] * theta[2] * (1 - h * h)
            grads = [x.T @ dh + 1e-4 * theta[0], dh.sum(axis=0), h.T @ dg + 1e-4 * theta[2], np.array([dg.sum()])]
            step += 1
            for t, a, b, d in zip(theta, first, second, grads):
                a += 0.1 * (d - a)
                b += 0.001 * (d * d - b)
                t -= 3e-3 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return QualityModel(mean, scale, *theta[:3], float(theta[3][0]), prior)


def class_prior(pos: np.ndarray, unl: np.ndarray, seed: int) -> float:
    """Best-bin estimate from the scores of a positive-against-unlabelled fit on the other half."""
    if len(pos) < 4 or len(unl) < 4:
        return 0.5
    model = pu_train(pos[::2], unl[::2], 0.5, 8, 12, seed)
    sp, su = np.sort(model.margin(pos[1::2])), np.sort(model.margin(unl[1::2]))
    cuts = sp[np.arange(0, max(1, int(0.95 * len(sp))))]
    above_p = 1 - np.searchsorted(sp, cuts) / len(sp)
    above_u = 1 - np.searchsorted(su, cuts) / len(su)
    slack = np.sqrt(np.log(20) / (2 * len(su))) + np.sqrt(np.log(20) / (2 * len(sp)))
    best = np.argmin((above_u + slack) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 1e-3, 1 - 1e-3))  # 0 and 1 leave no risk to weigh


def _features_of(rows: DataFrame) -> DataFrame:
    """key, kind, text -> key, kind, features as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "kind": b["kind"], "x": [features(t).tobytes() for t in b["text"]]})

    return rows.mapInPandas(run, "key long, kind int, x binary")


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", quality: str = "quality", learn: Column | None = None, max_docs: int = 12000, hidden: int = 24, epochs: int = 40, seed: int = 11) -> QualityModel | None:
    """Fit on at most about ``max_docs`` trusted positives (quality 1) and as many unlabelled rows where ``learn`` holds."""
    allowed = (F.lit(True) if learn is None else learn) & F.col(key).isNotNull()
    keys = docs.where(allowed).select(F.xxhash64(F.col(key).cast("string")).alias("key"))
    good = labels.where((F.col(quality) == 1) & allowed).select(F.xxhash64(F.col(key).cast("string")).alias("key")).distinct()
    share = lambda n: min(1.0, max_docs / max(1, n))
    positives = good.where(hash_share("key", F.lit(seed)) < share(good.count())).select("key", F.lit(1).alias("kind"))
    unlabelled = keys.where(hash_share("key", F.lit(seed + 1)) < share(keys.count())).select("key", F.lit(0).alias("kind"))
    drawn = positives.union(unlabelled)  # at most about 2 * max_docs keys, so the broadcast has a fixed bound
    rows = docs.where(allowed).select(F.xxhash64(F.col(key).cast("string")).alias("key"), F.col(text).cast("string").alias("text")).join(F.broadcast(drawn), "key").select("key", "kind", "text")
    got = sorted({(r.key, r.kind, bytes(r.x)) for r in _features_of(rows).collect()})
    x = {kind: np.array([np.frombuffer(f, np.float32) for _, k, f in got if k == kind], np.float64).reshape(-1, len(FEATURES)) for kind in (0, 1)}
    if not len(x[1]) or not len(x[0]):
        return None
    rng = np.random.default_rng(seed)
    pos, unl = rng.permutation(x[1]), rng.permutation(x[0])
    return pu_train(pos, unl, class_prior(pos, unl, seed), hidden, epochs, seed)


def score(docs: DataFrame, model: QualityModel | None, *, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: the key, ``carry``, and the score of its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            x = np.array([features(t) for t in b["_text"]], np.float64).reshape(-1, len(FEATURES))
            b["score"] = m.score(x) if m else 0.5
            yield b.drop(columns="_text")

    source = docs.select(F.col(key), *carry, F.col(text).cast("string").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1])
    return source.mapInPandas(run, f"{fields}, score double")
