"""Request documents (H7, B11): damaged bodies, routing, defaults, importance."""

import json

import pytest

from outcomelens.functions.encode import FeatureContract, Scaler, feature_terms
from outcomelens.operators.scoring import Scorer, fixed_logistic, score_requests
from outcomelens.spec import FIXTURE_SPEC as S


def scorer(variant):
    vocab = {"site_type": ["F", "O"]}
    names = tuple(n for n, _ in feature_terms(S, variant, vocab))
    flat = Scaler((0.0,) * len(names), (1.0,) * len(names))
    weights = fixed_logistic(names)
    return Scorer(S, FeatureContract(variant, names, vocab), Scaler(flat.means, tuple(100000.0 if n.endswith("amt") else 10000.0 if n == "area" else 50.0 for n in names)), weights)


@pytest.fixture(scope="module")
def run(spark):
    def go(*bodies):
        texts = [b if b is None or isinstance(b, str) else json.dumps(b) for b in bodies]
        df = spark.createDataFrame(list(enumerate(texts)), "i int, body string")
        return {r.i: r for r in score_requests(df, scorer("A"), scorer("B"), keep=["i"]).collect()}
    return go


WHOLE = {"config_id": "c", "item": "SMALL", "opt": "None", "extra": 0, "level": 10.0, "area": 5.0, "site_type": "F"}


def test_unreadable_bodies_get_an_error_and_no_probability(run):
    got = run("not json", None, "", "[1, 2]", {**WHOLE, "level": "high"}, "12", WHOLE)
    for i in range(6):
        assert got[i].error == "unreadable request" and got[i].probability is None and got[i].positive is None
    assert got[6].error is None and got[6].probability is not None


def test_missing_fields_take_their_defaults(run):
    bare = {"config_id": "c"}
    full = {"config_id": "c", "item": "None", "opt": "None", "extra": 0, "level": 0.0, "area": 9728.0, "site_type": "O"}
    got = run(bare, full, {**full, "site_type": "F"})
    assert got[0].probability == got[1].probability != got[2].probability


def test_model_type_routes(run):
    a = {**WHOLE, "own_amt": 90000.0, "other_amt": 90000.0}
    got = run(a, {**a, "model_type": "with_bp"}, {**a, "model_type": "no_bp"}, {**a, "model_type": "no_bp", "own_amt": 1.0}, {**a, "own_amt": 1.0})
    assert got[0].probability == got[1].probability and got[0].model_type == "with_bp"
    assert got[2].model_type == "no_bp" and got[2].probability == got[3].probability
    assert got[0].probability != got[4].probability


def test_importance_where_asked(run):
    got = run({**WHOLE, "include_importance": True}, {**WHOLE, "include_importance": True, "model_type": "no_bp"}, WHOLE,
              {**WHOLE, "include_importance": True, "extra": 3, "opt": "1-URGENT", "flag_a": "Yes"})
    assert len(got[0].importance) == scorer("A").contract.width and len(got[1].importance) == scorer("B").contract.width
    shares = [x.magnitude for x in got[0].importance]
    assert shares == sorted(shares, reverse=True) and abs(sum(shares) - 100) < 1e-6
    assert got[2].importance is None
    assert got[3].importance is None and got[3].error.startswith("invalid configuration")
