"""Quality classifier learned from trusted positives and unlabelled text.

A linear model over hashed character shapes and a few measures of the text is
fitted by minimising the non-negative unbiased risk: with class prior p,
p * R+(positives) + max(0, R-(unlabelled) - p * R-(positives)), logistic loss;
where the bracket turns negative, a step is made against it.  The prior is
estimated from held-out scores of a positive-against-unlabelled fit, as the
least ratio of the unlabelled to the positive share above a threshold.

Labels are used as trusted positives (label 1) only; where label 0 exists among
the rows that may be learned from, both labels set the scale and offset of the
final score.  All fits run on bounded samples (``SAMPLE`` rows each), chosen by a
hash of doc_id; scoring covers whole texts of all rows.

Defined cases: a null or empty text has no features and gets the score of the
offset; several labels of a document count as label 1 only if all are 1; without any
positive every score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outcomelens.llm.common import bucket

SAMPLE = 2500
SHAPES = 1 << 11
FEATURES = SHAPES + 5
THRESHOLD = 0.7
EPOCHS = 60
RATE = 0.05
BATCH = 500
DECAY = 1e-4
_PIECE = 1 << 20


class Model(NamedTuple):
    weights: np.ndarray
    offset: float
    prior: float
    scale: float
    shift: float


def _classes() -> np.ndarray:
    """Shape of each byte: lower letter, upper letter, digit, longer character; other bytes are themselves."""
    out = np.arange(256, dtype=np.uint32)
    out[ord("a"):ord("z") + 1] = ord("a")
    out[ord("A"):ord("Z") + 1] = ord("A")
    out[ord("0"):ord("9") + 1] = ord("0")
    out[128:] = ord("a")
    out[[9, 11, 12, 13]] = 32
    return out


def features(text: str) -> np.ndarray:
    """Hashed frequencies of 1 to 4 neighbouring shapes, and five measures, of a whole text."""
    out = np.zeros(FEATURES, np.float32)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    if not len(raw):
        return out
    classes, counts = _classes(), np.zeros(SHAPES, np.int64)
    for at in range(0, len(raw), _PIECE):
        b = classes[raw[at:at + _PIECE + 3]]
        code = np.zeros(len(b), np.uint32)
        for n in (1, 2, 3, 4):
            if len(b) < n:
                break
            code = (code if n == 1 else code[:-1]) * np.uint32(0x01000193) + b[n - 1:]
            h = (code[:_PIECE] ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            counts += np.bincount((h >> np.uint32(21)).astype(np.int64), minlength=SHAPES)
    root = np.sqrt(counts)
    out[:SHAPES] = root / np.linalg.norm(root)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n = max(len(words), 1)
    out[SHAPES:] = (len(set(words)) / n, 1 - len(set(lines)) / max(len(lines), 1), min(len(words) / 10, 1),
                    min(len(text) / n / 20, 2), sum(map(str.isupper, words)) / n)
    return out


def _pack(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([features(t or "").tobytes() for t in batch], dtype=object)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _descend(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, seed: int) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk; without a prior, plain logistic loss of positives against unlabelled."""
    rng = np.random.default_rng(seed)
    d = positive.shape[1]
    w, m, v, step = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1), 0
    rounds = max(1, -(-max(len(positive), len(unlabelled)) // BATCH))
    for _ in range(EPOCHS):
        ps, us = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
        for k in range(rounds):
            p, u = positive[ps[k::rounds]], unlabelled[us[k::rounds]]
            if not len(p) or not len(u):
                continue
            sp, su = _sigmoid(p @ w[:-1] + w[-1]), _sigmoid(u @ w[:-1] + w[-1])
            # gradients of the margin: of -log s for R+, of -log(1 - s) for R-
            up_p, down_p, down_u = (sp - 1) / len(p), sp / len(p), su / len(u)
            if prior is None:
                gp, gu = up_p, down_u
            else:
                rest = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
                gp, gu = (prior * (up_p - down_p), down_u) if rest >= 0 else (prior * down_p, -down_u)
            g = np.append(gp @ p + gu @ u, gp.sum() + gu.sum())
            g[:-1] += DECAY * w[:-1]
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return w[:-1], float(w[-1])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 3) -> float:
    """Share of positives in the unlabelled rows, from scores on the half that wasn't fitted."""
    w, b = _descend(positive[::2], unlabelled[::2], None, seed)
    p, u = np.sort(positive[1::2] @ w + b), np.sort(unlabelled[1::2] @ w + b)
    if len(p) < 20 or len(u) < 20:
        return 0.5
    cut = np.quantile(p, np.linspace(0, 0.9, 46))
    above_p = 1 - np.searchsorted(p, cut) / len(p)
    above_u = 1 - np.searchsorted(u, cut) / len(u)
    slack = np.sqrt(np.log(20) / 2 / len(u)) + np.sqrt(np.log(20) / 2 / len(p))
    best = np.argmin((above_u + slack) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.95))


def fit(positive: np.ndarray, unlabelled: np.ndarray, negative: np.ndarray, seed: int = 5) -> Model | None:
    """Fit on features; ``negative`` only sets scale and offset of the score."""
    if not len(positive) or not len(unlabelled):
        return None
    prior = estimate_prior(positive, unlabelled)
    w, b = _descend(positive, unlabelled, prior, seed)
    scale, shift = 1.0, 0.0
    if len(negative) >= 10:
        z = np.concatenate((positive @ w + b, negative @ w + b))
        y = np.concatenate((np.ones(len(positive)), np.zeros(len(negative))))
        weight = np.where(y == 1, prior / len(positive), (1 - prior) / len(negative))
        for _ in range(2000):
            g = weight * (_sigmoid(scale * z + shift) - y)
            scale, shift = max(scale - 0.3 * float(g @ z), 0.05), shift - 0.3 * float(g.sum())
    return Model(w, b, prior, scale, shift)


def _sample(rows: DataFrame, most: int, salt: str, *by: str) -> DataFrame:
    """``most`` rows, the first in the order of a hash of the columns ``by``.

    The last hash among them is found first, from the hashes alone, so that no other row's text is moved.
    """
    h = F.xxhash64(*by, F.lit(salt))
    last = rows.select(h.alias("h")).orderBy("h").limit(most).agg(F.max("h")).first()[0]
    return rows.filter(h <= F.lit(last).cast("long")).orderBy(h, *by).limit(most)


def train(docs: DataFrame, labels: DataFrame, learn: Column) -> Model | None:
    """Fit from the rows of ``docs`` (doc_id, text) and ``labels`` (doc_id, quality) where ``learn`` holds.

    Of an id with several texts the first by hash stands for its label; of several labels the smaller counts.
    """
    one = (labels.filter(learn & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
           .agg(F.min("quality").alias("quality")))
    chosen = (_sample(one.filter("quality = 1"), SAMPLE, "positive", "doc_id").select("doc_id", F.lit("p").alias("part"))
              .unionAll(_sample(one.filter("quality = 0"), SAMPLE, "negative", "doc_id").select("doc_id", F.lit("n").alias("part"))))
    text = F.coalesce("text", F.lit(""))
    # at most 2 * SAMPLE ids: small enough to go to every task
    told = (docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "part").agg(F.min_by(text, F.struct(F.md5(text))).alias("text")))
    rest = _sample(docs.filter(learn & F.col("doc_id").isNotNull()).select("doc_id", text.alias("text")), SAMPLE, "unlabelled", "doc_id", "text")
    rows = told.select("doc_id", "part", "text").unionAll(rest.select("doc_id", F.lit("u").alias("part"), "text"))
    got = (rows.select("doc_id", "part", F.md5("text").alias("t"), F.pandas_udf(_pack, "binary")("text").alias("x"))
           .toPandas().sort_values(["part", "doc_id", "t"]))

    def of(part: str) -> np.ndarray:
        rows = [np.frombuffer(x, np.float32) for x in got.x[got.part == part]]
        return np.array(rows, np.float32).reshape(len(rows), FEATURES)

    return fit(of("p"), of("u"), of("n"))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``__s``, the probability of label 1."""
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            if model is None:
                yield pd.Series(np.full(len(batch), 0.5))
                continue
            x = np.array([features(t or "") @ model.weights for t in batch], float) + model.offset
            yield pd.Series(_sigmoid(model.scale * x + model.shift))
    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn("__s", F.pandas_udf(run, "double")("text"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract columns of the classifier query: rows with remainder 2 are never learned from."""
    held_out = bucket(F.col("doc_id"), 4) == 2
    docs = docs.select("doc_id", "text")
    model = train(docs, labels.select("doc_id", "quality"), ~held_out)
    return score(docs, model).select("doc_id", held_out.alias("held_out"), F.col("__s").alias("score"),
                                     (F.col("__s") >= THRESHOLD).cast("int").alias("predicted"))
