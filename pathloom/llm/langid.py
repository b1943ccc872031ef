"""Language identification: averaged hashed subword embeddings with a linear softmax and calibrated rejection.

A text is lower-cased and cut into words of letters; every run of 2 to 4 characters inside a word (with a mark at
its ends) is hashed to a bucket, each bucket has an embedding, and the softmax of a linear map of the embeddings'
mean gives the classes. Embeddings and map are trained by stochastic gradient descent in numpy on a bounded sample
of labelled rows (``max_docs``), of whose whole texts the driver gets each bucket with its count. A second part of that sample sets the softmax's temperature and the
two rejection limits: the calibrated probability, and the share of n-grams whose bucket occurred in training (a text
in an unknown script or language has few of those). Prediction reads whole texts.

Defined results: a text that is null or without letters gets ``und``, score 0 and ``rejected``. Rows with a null key or
null label are never learned from. Repeated rows are predicted alike. Without labelled rows, as in an empty table, every text is ``und``. Very long texts are read whole, at some 50 bytes of memory
for each character. Other columns of the input are not read, so names that clash don't matter; keys may have any type.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, char_table, code_points, hash_share, mix

SCHEMA = "key long, lang_pred string, score double, known double, rejected boolean"


def gram_buckets(text: str | None, bits: int) -> np.ndarray:
    """Buckets of all subwords of the text."""
    points = code_points((text or "").lower())
    letters = char_table("letter")[points]
    marked = np.where(letters, points, 32)
    keep = letters.copy()
    keep[1:] |= letters[:-1]  # one mark after each word
    body = np.concatenate([[32], marked[keep], [32]]).astype(U64)
    if not letters.any():
        return np.zeros(0, np.int64)
    shift, inner, found = U64(64 - bits), body != 32, []
    h = body
    for n in (2, 3, 4):
        h = h[:-1] * U64(0x100000001B3) + body[n - 1 :]
        ok = inner[1 : len(inner) - n + 2] if n == 3 else (inner[1:-2] & inner[2:-1] if n == 4 else inner[:-1] | inner[1:])
        found.append(mix(h[ok] + U64(n)) >> shift)
    return np.concatenate(found).astype(np.int64)


@dataclass
class LanguageModel:
    labels: list[str]
    bits: int
    logits: np.ndarray  # bucket x label: embeddings times the linear map
    bias: np.ndarray
    seen: np.ndarray
    temperature: float = 1.0
    least_score: float = 0.0
    least_known: float = 0.0

    def raw(self, buckets: np.ndarray) -> tuple[np.ndarray, float]:
        return self.logits[buckets].mean(axis=0) + self.bias, float(self.seen[buckets].mean())

    def calibrated(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        buckets = gram_buckets(text, self.bits) if self.labels else ()
        if not len(buckets):
            return "und", 0.0, 0.0, True
        logits, known = self.raw(buckets)
        p = self.calibrated(logits)
        best = int(p.argmax())
        return self.labels[best], float(p[best]), known, bool(p[best] < self.least_score or known < self.least_known)


def counted(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets and the share of each."""
    found, n = np.unique(buckets, return_counts=True)
    return found, n / n.sum()


def sgd(grams: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, labels: list[str], bits: int, dim: int, epochs: int, rate: float, seed: int) -> LanguageModel:
    """Minimise cross entropy over mini-batches of 32 documents; classes count alike."""
    rng, n, c = np.random.default_rng(seed), len(grams), len(labels)
    emb, lin, bias = rng.normal(0, 0.1, (1 << bits, dim)), rng.normal(0, 0.1, (dim, c)), np.zeros(c)
    seen = np.zeros(1 << bits, bool)
    for g, _ in grams:
        seen[g] = True
    weight = n / (c * np.bincount(y, minlength=c).clip(1))[y]
    steps, total = 0, epochs * -(-n // 32)
    for _ in range(epochs):
        order = rng.permutation(n)
        for i in range(0, n, 32):
            batch = order[i : i + 32]
            sizes = np.array([len(grams[k][0]) for k in batch])
            flat, share = (np.concatenate([grams[k][i] for k in batch]) for i in (0, 1))
            row = np.repeat(np.arange(len(batch)), sizes)
            mean = np.add.reduceat(emb[flat] * share[:, None], np.r_[0, np.cumsum(sizes)[:-1]], axis=0)
            z = mean @ lin + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), y[batch]] -= 1
            p *= weight[batch, None] / len(batch)
            to_mean = p @ lin.T
            eta = rate * (1 - steps / total)
            lin -= eta * mean.T @ p
            bias -= eta * p.sum(axis=0)
            # the mean gives each bucket its share of the gradient only; the embeddings' own rate makes up for that
            np.subtract.at(emb, flat, eta * 100 * share[:, None] * to_mean[row])
            steps += 1
    emb[~seen] = 0
    return LanguageModel(labels, bits, (emb @ lin).astype(np.float32), bias, seen)


def calibrate(model: LanguageModel, grams: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, lose: float) -> None:
    """Choose the temperature of least log loss, then limits that reject at most a share ``lose`` of these texts each."""
    if not len(grams):
        return
    raw = [(share @ model.logits[g] + model.bias, float(share @ model.seen[g])) for g, share in grams]
    z, known = np.array([r[0] for r in raw]), np.array([r[1] for r in raw])
    best = (np.inf, 1.0)
    for t in np.geomspace(0.02, 50, 60):
        model.temperature = t
        loss = -np.log(model.calibrated(z)[np.arange(len(y)), y].clip(1e-12)).mean()
        best = min(best, (loss, t))
    model.temperature = best[1]
    top = model.calibrated(z).max(axis=1)
    model.least_score = float(min(0.5, np.quantile(top, lose)))
    model.least_known = float(min(0.8, np.quantile(known, lose)) * 0.75)


def fit(docs: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "lang", learn: Column | None = None, max_docs: int = 4000, bits: int = 16, dim: int = 8, epochs: int = 6, rate: float = 0.3, lose: float = 0.001, seed: int = 7, max_labels: int = 5000) -> LanguageModel:
    """Fit on a hashed sample of at most about ``max_docs`` rows where ``learn`` holds, shared out over the labels.

    The driver gets the buckets of each whole text, 2**bits at most and some thousands mostly, so its memory has a fixed bound.
    Each label's share of the sample is equal, so with nearly as many labels as ``max_docs`` some get no row and are not learned, and every fifth row of the sample
    goes to calibration alone; more than ``max_labels`` labels are an error.
    """
    rows = docs.where((F.lit(True) if learn is None else learn) & F.col(label).isNotNull() & F.col(key).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(F.col(label).cast("string")).count().limit(max_labels + 1).collect()}
    if len(counts) > max_labels:
        raise ValueError(f"more than {max_labels} labels")
    labels = sorted(counts)
    if not labels:
        return LanguageModel([], bits, np.zeros((1, 1), np.float32), np.zeros(1), np.zeros(1, bool))
    share = F.create_map(*[F.lit(x) for k in labels for x in (k, min(1.0, max_docs / len(labels) / counts[k]))])
    drawn = rows.select(F.xxhash64(F.col(key).cast("string")).alias("key"), F.col(text).cast("string").alias("text"), F.col(label).cast("string").alias("label"))
    drawn = drawn.where(F.col("label").isin(labels) & (hash_share(F.col("key"), F.lit(seed)) < share[F.col("label")]))

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t, lang in b.itertuples(index=False):
                g = gram_buckets(t, bits)
                if len(g):
                    found, share = counted(g)
                    out.append((k, lang, found.astype(np.int32).tobytes(), share.astype(np.float32).tobytes()))
            yield pd.DataFrame(out, columns=["key", "label", "grams", "share"])

    got = sorted(map(tuple, drawn.mapInPandas(sample, "key long, label string, grams binary, share binary").collect()))
    grams = [(np.frombuffer(g, np.int32).astype(np.int64), np.frombuffer(w, np.float32).astype(float)) for *_, g, w in got]
    y = np.array([labels.index(lang) for _, lang, *_ in got], int)
    held = np.arange(len(got)) % 5 == 4
    if not len(got):
        return LanguageModel([], bits, np.zeros((1, 1), np.float32), np.zeros(1), np.zeros(1, bool))
    model = sgd([g for g, h in zip(grams, held) if not h], y[~held], labels, bits, dim, epochs, rate, seed)
    calibrate(model, [g for g, h in zip(grams, held) if h], y[held], lose)
    return model


def predict(docs: DataFrame, model: LanguageModel, *, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: the key, ``carry``, lang_pred, score, known and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            said = [m.predict(t) for t in b["_text"]]
            for i, name in enumerate(("lang_pred", "score", "known", "rejected")):
                b[name] = [s[i] for s in said]
            yield b.drop(columns="_text")

    source = docs.select(F.col(key), *carry, F.col(text).cast("string").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1])
    return source.mapInPandas(run, f"{fields}, lang_pred string, score double, known double, rejected boolean")


def keep_known(docs: DataFrame, model: LanguageModel, *, text: str = "text") -> DataFrame:
    """The rows of docs whose language is not rejected, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        return pd.Series([not shared.value.predict(t)[3] for t in texts], dtype=bool)

    return docs.where(known(F.col(text).cast("string")))
