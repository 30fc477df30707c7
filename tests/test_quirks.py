"""Edge cases listed among the original's quirks, with the engine's chosen behaviour."""

from outcomelens.functions.encode import feature_terms
from outcomelens.operators import prepare as P
from outcomelens.operators import reports as R
from outcomelens.spec import FIXTURE_SPEC, GAME_SPEC


def test_blank_policy_is_one_argument(spark):
    df = spark.createDataFrame([("", 1), (None, 0), ("Key", 1)], "item string, label int")
    as_none = {(r.value, r.n) for r in R.value_counts(df, ["item"], blank_policy="None").collect()}
    as_blank = {(r.value, r.n) for r in R.value_counts(df, ["item"], blank_policy="blank").collect()}
    assert as_none == {("None", 2), ("Key", 1)}
    assert as_blank == {("", 2), ("Key", 1)}


def test_unseen_category_encodes_as_zeros(spark):
    df = spark.createDataFrame([("Fog Vial",), ("Key",)], "item string")
    terms = [(n, e) for n, e in feature_terms(GAME_SPEC, "B", {}) if n.startswith("item__")]
    rows = df.select(*[e.alias(n) for n, e in terms]).collect()
    assert sum(rows[0]) == 0.0          # not in the training vocabulary
    assert sum(rows[1]) == 1.0


def test_unmapped_label_is_quarantined(spark):
    raw = spark.createDataFrame([("Escape", "10"), ("Draw", "5"), ("Dead", "x")], "label string, level string")
    spec = GAME_SPEC.present(["label", "level"])
    typed = P.typed_projection(raw, spec)
    q = {r.reason for r in P.quarantine(typed, spec).collect()}
    assert q == {"missing label", "missing level"}
    assert P.drop_incomplete(typed, spec).count() == 1


def test_feature_order_is_spec_order(spark):
    names = [n for n, _ in feature_terms(FIXTURE_SPEC, "A", {"site_type": ["O", "F"]})]
    assert names[:2] == ["level", "area"] and names[-2:] == ["own_amt", "other_amt"]
    assert names.index("site_type__f") < names.index("site_type__o")   # discovered vocabulary sorted
