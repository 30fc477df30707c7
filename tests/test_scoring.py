"""Scoring paths: network explanation ranking (sort path) and logistic closed form vs numpy."""

import numpy as np
from pyspark.sql import functions as F

from outcomelens.functions.encode import Scaler, expand_features, fit_contract
from outcomelens.functions.scalars import round_fast
from outcomelens.operators.scoring import LogisticModel, MlpModel, Scorer, explain_gradient, gradients, score_batch
from outcomelens.sources.fixtures import fact_records
from outcomelens.spec import FIXTURE_SPEC

from conftest import SF_SMALL

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "own_amt"]


def _scorer(spark, model_fn):
    f = fact_records(spark, SF_SMALL)
    c = fit_contract(f, FIXTURE_SPEC, "B")
    sc = Scaler.fit(expand_features(f, c, FIXTURE_SPEC), c.names)
    return f.orderBy(*KEY).limit(40), Scorer(FIXTURE_SPEC, c, sc, model_fn(c.width))


def _check_ranks(ex, grads, names):
    for key, g in grads.items():
        g = np.asarray(g)
        order = sorted(range(len(g)), key=lambda i: (-abs(g[i]), i)) if np.any(g) else list(range(len(g)))
        got = sorted(ex[key], key=lambda r: r[1])
        assert [names.index(r[0]) for r in got] == order
        tot = np.abs(g).sum()
        for feat, rank, mag in got:
            exp = abs(g[names.index(feat)]) / tot * 100 if tot > 0 else 0.0
            assert abs(mag - exp) < 1e-9


def _collect(ex_df, g_df):
    ex, grads = {}, {}
    for r in ex_df.collect():
        ex.setdefault(tuple(r[k] for k in KEY), []).append((r.feature, r["rank"], r.magnitude))
    for r in g_df.collect():
        grads[tuple(r[k] for k in KEY)] = r.grad
    return ex, grads


def test_network_explanation_ranks(spark):
    rng = np.random.default_rng(5)
    f, sc = _scorer(spark, lambda d: MlpModel(((rng.normal(size=(6, d)), rng.normal(size=6)),
                                               (rng.normal(size=(2, 6)), rng.normal(size=2)))))
    ex, grads = _collect(explain_gradient(f, sc, KEY), gradients(f, sc, KEY))
    _check_ranks(ex, grads, list(sc.contract.names))


def test_logistic_closed_form_ranks(spark):
    f, sc = _scorer(spark, lambda d: LogisticModel(tuple(((3 * i) % 7 - 3) / 4.0 for i in range(d)), 0.1))
    ex, grads = _collect(explain_gradient(f, sc, KEY), gradients(f, sc, KEY))
    _check_ranks(ex, grads, list(sc.contract.names))


def test_network_scores_match_forward(spark):
    rng = np.random.default_rng(2)
    f, sc = _scorer(spark, lambda d: MlpModel(((rng.normal(size=(4, d)), rng.normal(size=4)),
                                               (rng.normal(size=(2, 4)), rng.normal(size=2)))))
    s = {tuple(r[k] for k in KEY): r.probability for r in score_batch(f, sc, KEY, check_cost=False).collect()}
    g = {tuple(r[k] for k in KEY): r.probability for r in gradients(f, sc, KEY).collect()}
    assert s.keys() == g.keys() and all(abs(s[k] - g[k]) < 1e-12 for k in s)


def test_a_network_ranks_in_batches(spark):
    """Ties keep the features' order, gradients of zero too; no row sorts structs."""
    f, sc = _scorer(spark, lambda d: MlpModel(((np.tile([0.5, -0.5, 0.0], (2, d))[:, :d], np.zeros(2)), (np.array([[0.0, 0.0], [1.0, 0.0]]), np.zeros(2))), "relu"))
    ex = explain_gradient(f, sc, KEY)
    plan = ex._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "sort_array" not in plan
    ex, grads = _collect(ex, gradients(f, sc, KEY))
    _check_ranks(ex, grads, list(sc.contract.names))
    assert any(not np.any(g) for g in grads.values()) and any(np.any(g) for g in grads.values())


def test_fast_rounding_is_rounding(spark):
    values = [0.0, -0.0, 1e-12, -1e-12, 0.000005, -0.000015, 2.5e-8, 1.000005, 99.999995, -12.345675, 1e300, float("nan"), float("inf"), None]
    values += [x / 7e4 for x in range(-500, 500)] + [(x + 0.5) / 1e5 for x in range(-300, 300)]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    for digits in (5, 8):
        rows = df.select(F.round("x", digits).alias("slow"), round_fast("x", digits).alias("fast")).collect()
        assert [repr(r.slow) for r in rows] == [repr(r.fast) for r in rows]
