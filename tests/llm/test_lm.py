"""The language model's training step, softmax and stored names."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from outcomelens.llm import lm


def plain_step(w, used, square, rows, truth, bias):
    """A gradient step by its definition, in double precision."""
    z = np.stack([sum(w[k].astype(float) for k in r) for r in rows]) + (w[-1] if bias is None else bias)
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    sums, times = np.zeros(w.shape), np.zeros(len(w))
    for r, t, q in zip(rows, truth, p):
        if q[t] < 1 - lm.SURE:
            q[t] -= 1
            for k in [*r, *([len(w) - 1] if bias is None else [])]:
                sums[k] += q
                times[k] += 1
    square += (sums ** 2).sum(1)
    w -= (lm.RATE / np.sqrt(square))[:, None] * sums
    used += times


@pytest.mark.parametrize("width, with_bias", [(lm.CLASSES, False), (lm.FAN, True)])
def test_a_step_equals_its_definition(width, with_bias):
    rng = np.random.default_rng(5)
    w = rng.normal(0, 1, (301, width)).astype(np.float32)
    rows = np.minimum(rng.zipf(1.3, (900, 4)) - 1, 299)  # some rows once, some hundreds of times
    truth = rng.integers(0, width, 900)
    w[rows[:200, 0], truth[:200]] += 9  # some choices are sure
    bias = rng.normal(0, 1, (900, width)).astype(np.float32) if with_bias else None
    used, square = np.zeros(301, np.float32), np.full(301, 1e-6, np.float32)
    want = [w.astype(float), used.astype(float), square.astype(float)]
    plain_step(*want, rows, truth, bias)
    lm._step(w, used, square, rows, truth, bias)
    assert np.allclose(w, want[0], atol=1e-4) and (used == want[1]).all() and np.allclose(square, want[2], rtol=1e-4)


def test_runs_are_summed_from_long_to_short():
    rng = np.random.default_rng(6)
    times = np.array([1, 33, 2, 32, 500, 31, 1, 34, 3])
    at = np.cumsum(times) - times
    g, take = rng.normal(0, 1, (90, 5)).astype(np.float32), rng.integers(0, 90, times.sum())
    by, sums = lm.run_sums(g, take, at, times)
    assert sorted(by) == list(range(len(at))) and (np.diff(np.minimum(times[by], 33)) <= 0).all()
    assert np.allclose(sums, [g[take[at[i]:at[i] + times[i]]].sum(0) for i in by], atol=1e-3)


@pytest.mark.parametrize("level", [0, 50, 500, -50, -500])
def test_softmax_of_far_logits(level):
    rng = np.random.default_rng(7)
    w = (rng.normal(0, 3, (40, 6)) + level / 4).astype(np.float32)
    w[-1] = 0
    rows, truth = rng.integers(0, 39, (20, 4)), rng.integers(0, 6, 20)
    e, total, log = lm.softmax(w, rows, truth)
    assert np.allclose(log, lm.class_log(w, rows)[np.arange(20), truth], atol=1e-3)
    assert np.allclose(e / total[:, None], np.exp(lm.class_log(w, rows)), atol=1e-4)


def test_words_are_those_of_the_pattern():
    text = "A\x1cb\x85c\xa0D É İ\x00\tx\x0bY\x0cz\r\n" + "".join(map(chr, range(1, 0x500)))
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    texts = [None, text, "", " \t", " b  C "]
    words, sizes = lm.split(pa.array(texts))
    want = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) for t in texts]
    assert words.to_pylist() == sum(want, []) and list(sizes) == [len(w) for w in want]


def test_training_and_scores_read_stored_names(make, monkeypatch):
    """Texts are split for the counts and for the names; rounds and scores start from the names."""
    monkeypatch.setattr(lm, "TOP", 20)
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["a", "B", "c"] + [f"w{k}" for k in range(200)], [90, 60, 30] + [1] * 200, k=rng.randrange(40)))) for i in range(90)]
    rows += [(100, None), (101, ""), (102, "never seen"), (102, "never seen"), (None, "a b")]
    docs = lm.with_block(make(rows).select("doc_id", "text"))
    table = lm.count_table(docs)
    top = lm.frequent(table)
    stored = lm.numbered(docs, table, top.words, top.total, top.distinct)
    number = {w: i for i, w in enumerate(top.words)}
    seen = {r.word for r in table.filter("c > 0").select("word").collect()}
    name = lm.Names(number)
    texts = {i: (t or "").lower().split() + [lm.END] for i, t in rows}
    got = list(lm._stored([stored.toPandas()], most=300))
    assert len(got) > 3 and sum(len(r) for r, _, _ in got) == len(rows)
    for part, names, starts in got:
        ends = np.append(starts[1:], len(names))
        for i, a, b in zip(part["doc_id"], starts, ends):
            words = texts[None if i != i or i is None else int(i)]
            assert list(names[a:b]) == [name[w] if w in seen else lm.NAMES - 1 for w in words]

    def split(texts):
        raise AssertionError("split again")
    monkeypatch.setattr(lm, "split", split)
    f = lm.frame(table, stored, top)
    found = lm.score(stored, table, f, lm.train(stored, f))
    assert found.count() == len(rows)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
