"""Language identification: averaged hashed subword embeddings, linear softmax.

Subwords are the 2-, 3- and 4-byte pieces of a text's lower-cased words, each
word between two marks; they hash into buckets with an embedding each.  A text
is the mean of its embeddings; a linear softmax over it gives the languages.
Training is stochastic gradient descent in numpy on a bounded sample of
labelled rows (``SAMPLE``); a part of the sample, unseen by it, sets the
temperature of the softmax and the score below which an answer is rejected.

Since the mean is linear, a trained bucket is its row of class scores, and a
whole text is scored by one product of bucket counts and that table.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
rows with a null lang are never learned from; without any labelled row every
answer is ``und``; an empty table gives an empty result.  Repeated rows are learned
from, and answered, each.  Of languages with equal scores the first by name is the
answer.  Texts are counted whole, ``_PIECE`` bytes at a time.  Other columns are
ignored; ``predict`` keeps them and adds ``__p``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from outcomelens.llm.common import bucket

SAMPLE = 3000  # labelled rows that a model is fitted on, shared out by the languages' rows
FLOOR = 100  # and at least so many of each language, as far as it has them
LANGS = 500  # languages learned at most
BUCKETS = 1 << 15
DIM = 16
EPOCHS = 8
STEPS = 8000  # and more epochs on a small sample, for so many steps at least
RATE = 0.5
PRECISION = 0.99  # among accepted answers, on the calibration part
_PIECE = 1 << 20  # bytes counted at a time


class Model(NamedTuple):
    langs: list[str]
    table: np.ndarray  # (BUCKETS, languages)
    bias: np.ndarray
    temperature: float
    accept: float


def _letters() -> np.ndarray:
    """Byte translation: letters and all bytes of longer characters stay, the rest becomes a space."""
    out = np.full(256, 0x20, np.uint8)
    out[128:] = np.arange(128, 256)
    for c in range(ord("a"), ord("z") + 1):
        out[c] = c
    return out


def subword_counts(text: str) -> np.ndarray:
    """How often each bucket occurs in a whole text."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    table = _letters()
    for at in range(0, len(raw), _PIECE):
        b = table[raw[at:at + _PIECE + 3]].astype(np.uint32)
        inner = b != 0x20
        code = b
        for n in (2, 3, 4):
            if len(b) < n:
                break
            code = code[:-1] * np.uint32(0x01000193) + b[n - 1:]
            # a piece lies within one word and its marks
            whole = (inner[:-1] | inner[1:], inner[1:-1], inner[1:-2] & inner[2:-1])[n - 2][:_PIECE]
            h = (code[:len(whole)][whole] * np.uint32(0x9E3779B1)) ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            counts += np.bincount((h >> np.uint32(17)).astype(np.int64), minlength=BUCKETS)
    return counts


def _sparse(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        rows = []
        for text in batch:
            c = subword_counts(text or "")
            at = np.flatnonzero(c)
            rows.append((at.astype(np.int32).tobytes(), c[at].astype(np.float32).tobytes()))
        yield pd.DataFrame(rows, columns=["at", "n"])


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]], seed: int = 7) -> Model | None:
    """Train on sparse counts (buckets, counts, lang)."""
    langs = sorted({r[2] for r in rows})
    if not langs:
        return None
    number = {x: i for i, x in enumerate(langs)}
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held = order[:len(rows) // 5]
    learn = order[len(rows) // 5:]
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    out, bias = np.zeros((DIM, len(langs))), np.zeros(len(langs))
    epochs = max(EPOCHS, -(-STEPS // max(len(learn), 1)))
    steps, done = epochs * len(learn), 0
    for _ in range(epochs):
        for i in rng.permutation(learn):
            at, n, lang = rows[i]
            rate = RATE * (1 - done / steps)
            done += 1
            if not len(at):
                continue
            share = n / n.sum()
            mean = share @ emb[at]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[number[lang]] -= 1
            back = out @ p
            out -= rate * np.outer(mean, p)
            bias -= rate * p * 0.1
            emb[at] -= rate * 10 * np.outer(share, back)
    table = emb @ out
    scores = np.array([(n / max(n.sum(), 1)) @ table[at] + bias for at, n, _ in (rows[i] for i in held)]).reshape(len(held), len(langs))
    truth = np.array([number[rows[i][2]] for i in held], int)
    temperature = min((0.1, 0.2, 0.35, 0.5, 0.7, 1.0, 1.5, 2.0, 3.0, 5.0),
                      key=lambda t: _loss(scores / t, truth)) if len(held) else 1.0
    return Model(langs, table.astype(np.float32), bias, temperature, _accept(_softmax(scores / temperature), truth))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _loss(z: np.ndarray, truth: np.ndarray) -> float:
    return float(-np.log(_softmax(z)[np.arange(len(truth)), truth] + 1e-12).mean())


def _accept(p: np.ndarray, truth: np.ndarray) -> float:
    """Lowest score from which accepted answers reach the precision."""
    if not len(truth):
        return 0.0
    best, right = p.max(1), p.argmax(1) == truth
    order = np.argsort(-best, kind="stable")
    good = np.flatnonzero(np.cumsum(right[order]) >= PRECISION * np.arange(1, len(order) + 1))
    return float(best[order][good[-1]]) if len(good) else 1.0


def train(docs: DataFrame, learn: Column) -> Model | None:
    """Fit on ``SAMPLE`` of the rows where ``learn`` holds, the first of each language in the order of a hash of id and text.

    A language gets its share of the sample, but at least ``FLOOR`` rows as far as it has them;
    with more than ``LANGS`` languages those with the most rows are learned.
    """
    rows = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGS).collect()
    n = sum(r["count"] for r in sizes)
    quotas = rows.sparkSession.createDataFrame([(r.lang, max(FLOOR, -(-SAMPLE * r["count"] // n))) for r in sizes], "lang string, quota long")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))  # limited before the shuffle, too
    first = (rows.select("doc_id", "lang", "text", F.xxhash64("doc_id", "text", F.lit("langid")).alias("h"))
             .withColumn("place", place).filter(F.col("place") <= SAMPLE + FLOOR)
             .join(F.broadcast(quotas), "lang").filter("place <= quota"))  # LANGS rows at most
    got = (first.select("doc_id", "lang", "h", F.pandas_udf(_sparse, "at binary, n binary")("text").alias("s"))
           .select("doc_id", "lang", "h", "s.*").toPandas().sort_values(["doc_id", "lang", "h"]))
    return fit([(np.frombuffer(a, np.int32), np.frombuffer(c, np.float32).astype(np.float64), x) for a, c, x in zip(got["at"], got["n"], got["lang"])])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score and whether the calibrated threshold would reject the answer."""
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        letter = regex.compile(r"\p{L}")
        for batch in texts:
            rows = []
            for text in batch:
                if model is None or not text or not letter.search(text):
                    rows.append(("und", 0.0, True))
                    continue
                c = subword_counts(text)
                z = (c.astype(np.float32) @ model.table).astype(np.float64) / max(c.sum(), 1) + model.bias
                p = _softmax(z / model.temperature)
                k = int(p.argmax())
                rows.append((model.langs[k], float(p[k]), bool(p[k] < model.accept)))
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "rejected"])
    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return docs.select("*", F.pandas_udf(run, "lang_pred string, score double, rejected boolean")("text").alias("__p"))


def digest(docs: DataFrame) -> DataFrame:
    """Contract columns of the language query: rows with remainder 2 are never learned from."""
    docs = docs.select("doc_id", "text", "lang")
    held_out = bucket(F.col("doc_id"), 4) == 2
    model = train(docs, ~held_out)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "__p.*")
