"""Scores computed a second time, slowly and from the definitions, with the same weights."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from outcomelens.llm import langid, lm, pu_quality

M64 = (1 << 64) - 1
M32 = (1 << 32) - 1


def softmax_log(z):
    top = max(z)
    total = math.log(sum(math.exp(x - top) for x in z)) + top
    return [x - total for x in z]


# ---------------------------------------------------------------- language model
def feature_codes(names, i, rare):
    def at(k):
        return names[k] if k is not None and k >= 0 else rare + 1
    frequent = [k for k in range(i) if names[k] < rare]
    k1, k2 = (frequent[-1] if frequent else None), (frequent[-2] if len(frequent) > 1 else None)
    p1, p2, k1, k2 = at(i - 1), at(i - 2), at(k1), at(k2)
    wide = 0x9FB21C651E98DF25
    out = []
    for c in (p1 * 4 + 1, (p1 * wide + p2) * 4 + 2, k1 * 4 + 3, (k1 * wide + k2) * 4):
        c = c * 0x9E3779B97F4A7C15 & M64
        c = (c ^ c >> 29) * 0xBF58476D1CE4E5B9 & M64
        out.append(c ^ c >> 32)
    return out


def row_of(code, rows):
    return (code * 0x94D049BB133111EB & M64) >> (64 - rows.bit_length() + 1)


def slow_score(text, f, weights, counts):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [lm.END]
    number = {w: i for i, w in enumerate(f.words)}
    rare = len(f.words)
    names = [number.get(w, lm.NAMES + zlib.crc32(w.encode()) if counts.get(w) else lm.NAMES - 1) for w in words]
    z = math.log10(f.total + 0.5 * (f.distinct + 1))
    base = total = 0.0
    for i, (word, name) in enumerate(zip(words, names)):
        token = min(name, rare)
        kind = int(f.classes[token])
        leaf = int(f.leaf[token]) if token < rare else ((name - lm.NAMES) % lm.FAN ** lm.OTHER_LEVELS if name >= lm.NAMES else 0)
        codes = feature_codes(names, i, rare)
        logits = [float(sum(weights[0][row_of(c, f.rows)][k] for c in codes) + weights[0][-1][k]) for k in range(lm.CLASSES)]
        gain = softmax_log(logits)[kind] / math.log(10) - f.share[kind]
        for level, shares in enumerate(f.shares):
            place = kind * lm.FAN ** level + leaf % lm.FAN ** level
            mine = shares[place]
            if sum(x > -60 for x in mine) < 2:
                continue
            mark = (place * lm.LEVELS + level + 1) * 0xD6E8FEB86659FD93 & M64
            logits = [float(sum(weights[1][row_of(c ^ mark, f.rows)][k] for c in codes) + mine[k]) for k in range(lm.FAN)]
            branch = leaf // lm.FAN ** level % lm.FAN
            gain += (softmax_log(logits)[branch] - float(mine[branch])) / math.log(10)
        one = math.log10(counts.get(word, 0) + 0.5) - z
        base += one
        total += one + gain
    return base, total


def test_language_model_scores_equal_a_slow_computation(make, monkeypatch):
    monkeypatch.setattr(lm, "TOP", 60)
    rng = random.Random(4)
    vocabulary = ["the", "of", "A", "to"] + [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choices(vocabulary, [200, 90, 60, 30] + [1] * 400, k=rng.randrange(0, 60)))) for i in range(120)]
    rows += [(200, None), (201, "Unseen words Only"), (202, "the the\tthe\nOF é")]
    docs = lm.with_block(make(rows).select("doc_id", "text"))
    table = lm.count_table(docs)
    f = lm.frame(table, docs)
    weights = lm.train(docs, f)
    counts = {r.word: r.c for r in table.filter("place = 1").select("word", "c").collect()}
    assert np.abs(weights[0][:-1]).max() > 0.01 and np.abs(weights[1]).max() > 0.01
    got = {r.doc_id: r for r in lm.score(docs, table, f, weights).collect()}
    for i, text in rows:
        base, total = slow_score(text, f, weights, counts)
        assert got[i].base_score == pytest.approx(base, abs=1e-9)
        assert got[i].score == pytest.approx(total, abs=1e-3)


# ---------------------------------------------------------------- languages
def slow_subwords(text):
    raw = [b if b >= 128 or 97 <= b <= 122 else 32 for b in f" {text.lower()} ".encode()]
    counts = {}
    for n in (2, 3, 4):
        for i in range(len(raw) - n + 1):
            piece = raw[i:i + n]
            inside = [b != 32 for b in piece]
            if not (any(inside) if n == 2 else all(inside[1:-1])):
                continue
            code = piece[0]
            for b in piece[1:]:
                code = (code * 0x01000193 + b) & M32
            h = (code * 0x9E3779B1 & M32) ^ (n * 0x85EBCA6B & M32)
            h = (h ^ h >> 15) * 0x2C1B3C6D & M32
            counts[h >> 17] = counts.get(h >> 17, 0) + 1
    return counts


def test_language_scores_equal_a_slow_computation(make):
    rng = random.Random(6)
    words = {"a": ["der", "und", "über", "Haus"], "b": ["the", "and", "house", "over"], "c": ["le", "et", "maison", "où"]}
    rows = [(i, " ".join(rng.choices(words[x], k=9)), x) for i, x in enumerate(rng.choices("abc", k=90))]
    docs = make(rows + [(900, "123 !"), (901, None), (902, "Ünd 東京 the-le")])
    model = langid.train(docs, F.col("doc_id") < 80)
    got = {r.doc_id: r.__getitem__("__p") for r in langid.predict(docs, model).collect()}
    for i, text in [(i, t) for i, t, _ in rows] + [(902, "Ünd 東京 the-le")]:
        counts = slow_subwords(text)
        n = sum(counts.values())
        z = [sum(c * float(model.table[b][k]) for b, c in counts.items()) / n + float(model.bias[k]) for k in range(len(model.langs))]
        p = [math.exp(x) for x in softmax_log([x / model.temperature for x in z])]
        best = max(range(len(p)), key=lambda k: p[k])
        assert got[i].score == pytest.approx(p[best], abs=1e-4) and (got[i].lang_pred == model.langs[best] or p[best] < 0.5001)
    assert (got[900].lang_pred, got[900].score) == (got[901].lang_pred, got[901].score) == ("und", 0.0)


def test_a_rare_language_keeps_its_floor(make, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 60)
    monkeypatch.setattr(langid, "FLOOR", 8)
    rows = [(i, f"word number {i} of many", "x") for i in range(900)] + [(2000 + i, f"rara parola {i}", "y") for i in range(8)]
    rows += [(3000, "same row", "x")] * 50
    seen = []
    monkeypatch.setattr(langid, "fit", lambda got, seed=7: seen.extend(x for _, _, x in got))
    langid.train(make(rows), F.lit(True))
    assert seen.count("y") == 8 and seen.count("x") <= 61


def test_equal_language_scores_go_to_the_first_name(make):
    model = langid.Model(["aa", "bb"], np.zeros((langid.BUCKETS, 2), np.float32), np.zeros(2), 1.0, 0.0)
    row = langid.predict(make([(1, "words")]), model).first()["__p"]
    assert (row.lang_pred, row.score) == ("aa", 0.5)


# ---------------------------------------------------------------- quality
def slow_features(text):
    def shape(b):
        if b >= 128 or 97 <= b <= 122:
            return 97
        return 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 32 if b in (9, 11, 12, 13) else b
    raw, counts = [shape(b) for b in text.encode()], [0] * pu_quality.SHAPES
    for n in (1, 2, 3, 4):
        for i in range(len(raw) - n + 1):
            code = 0
            for b in raw[i:i + n]:
                code = (code * 0x01000193 + b) & M32
            h = (code ^ (n * 0x85EBCA6B & M32)) * 0x9E3779B1 & M32
            h = (h ^ h >> 15) * 0x2C1B3C6D & M32
            counts[h >> 21] += 1
    size = math.sqrt(sum(counts))
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n = max(len(words), 1)
    return [math.sqrt(c) / size for c in counts] + [len(set(words)) / n, 1 - len(set(lines)) / max(len(lines), 1), min(len(words) / 10, 1),
                                                    min(len(text) / n / 20, 2), sum(w.isupper() for w in words) / n]


def test_quality_scores_equal_a_slow_computation(spark, make):
    rng = random.Random(9)
    good = [" ".join(rng.choices(["plain", "words", "of", "a", "text"], k=30)) + "." for _ in range(60)]
    bad = [" ".join(rng.choices(["BUY", "$$$", "now!!", "1234"], k=12)) for _ in range(60)]
    rows = list(enumerate(good + bad)) + [(500, "Ünïcode\nline\nline\t Tab"), (501, "x")]
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)], "doc_id long, quality int, toxic int")
    model = pu_quality.train(make(rows), labels, F.lit(True))
    got = {r.doc_id: r["__s"] for r in pu_quality.score(make(rows), model).collect()}
    for i, text in rows:
        z = sum(a * float(b) for a, b in zip(slow_features(text), model.weights)) + float(model.offset)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(model.scale * z + model.shift))), abs=1e-4)


def test_a_sample_moves_no_other_texts(spark):
    from pyspark.sql import functions as F
    from outcomelens.llm import pu_quality as Q
    rows = spark.range(500).select((F.col("id") % 300).alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 300).cast("string")).alias("text"))
    got = Q._sample(rows, 40, "unlabelled", "doc_id", "text")
    want = rows.orderBy(F.xxhash64("doc_id", "text", F.lit("unlabelled")), "doc_id", "text").limit(40)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "<=" in got._jdf.queryExecution().optimizedPlan().toString()  # cut off before the sort
    assert Q._sample(rows.filter("false"), 40, "unlabelled", "doc_id", "text").count() == 0
