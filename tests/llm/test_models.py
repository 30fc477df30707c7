import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from outcomelens.llm import langid, lm, pu_quality
from outcomelens.llm.common import read

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_langid_held_out_accuracy(spark):
    docs = read(spark, SF, "documents")
    got = langid.digest(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.9
    assert all(0 <= r.score <= 1 for r in got)


def test_langid_defined_cases(make):
    en, de = "the and of is that with this from words", "der die und das nicht ein mit worte über"
    rows = [(i, (en if i % 2 else de) + " %d" % i, "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "123 !!", "de"), (103, en, None), (None, de, "de"), (104, en * 500, None)]
    got = {r.doc_id: r for r in langid.digest(make(rows, extra=["lang_pred", "score"])).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (100, 101, 102))
    assert got[103].lang_pred == "en" and got[104].lang_pred == "en"
    assert {r.lang_pred for r in langid.digest(make([(1, "x", None)])).collect()} == {"und"}
    assert langid.digest(make([])).count() == 0


def test_subword_counts_cover_whole_text():
    text = "abc de"
    assert langid.subword_counts(text).sum() == 7 + 5 + 3  # pairs, triples around a letter, quadruples around two
    long = "wörter " * 400_000
    one = langid.subword_counts("wörter " * 4)
    many = langid.subword_counts(long)
    assert set(np.flatnonzero(one)) == set(np.flatnonzero(many))


def test_pu_learns_from_positives_and_unlabelled():
    rng = np.random.default_rng(1)
    pos, neg = rng.normal(1, 1, (4000, 4)), rng.normal(-1, 1, (4000, 4))
    positive, unlabelled = pos[:1500], np.vstack((pos[1500:3600], neg[:900]))
    prior = pu_quality.estimate_prior(positive, unlabelled)
    assert abs(prior - 0.7) < 0.08
    m = pu_quality.fit(positive, unlabelled, np.zeros((0, 4)))
    test, truth = np.vstack((pos[3600:], neg[3600:])), np.repeat([1, 0], 400)
    assert (((test @ m.weights + m.offset) > 0) == truth).mean() > 0.93
    assert pu_quality.fit(positive[:0], unlabelled, neg) is None


def test_pu_digest(spark, make):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    got = pu_quality.digest(docs, labels).join(labels.groupBy("doc_id").agg(F.min("quality").alias("quality")), "doc_id", "left").collect()
    assert len(got) == docs.count()
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.quality is not None]
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.85
    none = spark.createDataFrame([], "doc_id long, quality int, score double")
    odd = make([(1, None), (1, ""), (None, "x" * 100_000), (2, "text")], extra=["score", "quality"])
    assert [r.score for r in pu_quality.digest(odd, none).collect()] == [0.5] * 4
    assert pu_quality.digest(make([]), labels).count() == 0


def lm_rows():
    rng = random.Random(3)
    words = {k: [k + "w%d" % i for i in range(30)] for k in "ab"}
    rows = []
    for i in range(300):
        k = rng.choice("ab")
        rows.append((i, " ".join(rng.choice(words[k]) for _ in range(rng.randint(5, 40))).title() + " É"))
    return rows + [(400, None), (401, ""), (402, "only new things"), (402, "only new things"), (None, "aw1 aw2"), (403, "aw1 bw2 " * 20_000)]


def test_lm_base_and_gain(make):
    rows = lm_rows()
    got = lm.digest(make(rows, extra=["block", "train", "word"])).collect()
    assert len(got) == len(rows)
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    toks = [(i, WORD.findall((t or "").translate(lower)) + ["\n"]) for i, t in rows]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = Counter(w for i, t in toks if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((i is None, i or 0, held(i), len(t), sum(w in c for w in t), n,
                   round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for i, t in toks)
    have = sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    assert [w[:6] for w in want] == [h[:6] for h in have]
    assert all(abs(w[6] - h[6]) < 1e-5 * max(1, abs(w[6])) for w, h in zip(want, have))
    tested = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 300]  # texts like those learned from
    assert sum(r.score for r in tested) > sum(r.base_score for r in tested)
    assert lm.digest(make([])).count() == 0


def test_lm_is_a_distribution():
    """Over all tokens that can follow a context the probabilities sum to one."""
    rng = np.random.default_rng(2)
    rows = rng.integers(0, lm.ROWS, (5, 4))
    w = rng.normal(0, 1, (lm.ROWS + 1, lm.CLASSES)).astype(np.float32)
    assert np.allclose(np.exp(lm.class_log(w, rows)).sum(1), 1, atol=1e-5)
    ids, starts = np.array([0, 3, 9, 3, 1, 9, 0]), np.array([0, 4])
    a = lm.context(ids, starts, 9)
    alone = lm.context(ids[4:], np.array([0]), 9)
    assert (a[4:] == alone).all()  # a text's contexts don't reach into the text before


def test_lm_rare_tokens_depend_on_their_context(make):
    """Beyond the frequent tokens too a token's context tells which it is, and all tokens' shares sum to one."""
    frequent, lm.TOP = lm.TOP, 2
    try:
        rows = [(i, " ".join(("left%d right%d" % (k, k)) for k in (i % 7, (i + 3) % 7, (i + 5) % 7))) for i in range(400)]
        docs = lm.with_block(make(rows).select("doc_id", "text"))
        table = lm.count_table(docs)
        f = lm.frame(table, docs)
        weights = lm.train(docs, f)
        c = {r.word: r.c for r in table.filter("place = 1").collect()}
    finally:
        lm.TOP = frequent
    words = [*c, None]
    number = {w: i for i, w in enumerate(f.words)}
    names = np.array([lm.NAMES - 1 if w is None else lm.Names(number)[w] for w in words])
    at = {w: n for w, n in zip(words, names)}
    _, classes, leaf = lm._targets(names, f)
    share = np.array([c.get(w, 0) + 0.5 for w in words]) / (f.total + 0.5 * (f.distinct + 1))
    assert abs(share.sum() - 1) < 1e-9
    for k in range(7):
        text = np.array([at["left%d" % k], 0])
        code = lm.context(lm._targets(text, f)[0], np.array([0]), len(f.words), text)[1:]
        gain = lm.token_gain(classes, leaf, np.repeat(code, len(words), 0), f, weights)
        p = share * 10 ** gain
        assert abs(p.sum() - 1) < 1e-4
        if "right%d" % k not in number:
            assert p[words.index("right%d" % k)] > 2 * share[words.index("right%d" % k)]
