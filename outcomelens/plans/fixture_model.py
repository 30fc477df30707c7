"""The fixed-weight scorer over the record view and its SQL twin.

The scaler is fitted on the whole record view (Spark aggregate); weights follow
a fixed rule (``scoring.fixed_logistic``), so DuckDB can recompute every score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.encode import Scaler, expand_features, fit_contract
from ..operators.ordering import written
from ..operators.scoring import Scorer, fixed_logistic
from ..session import DROP_SHUFFLES, settings
from ..sources.fixtures import fact_records
from ..spec import CODE, COUNT, FIXED_CAT, FLAG, FOUND_CAT, LEVEL, MEDIAN, FIXTURE_SPEC, TableSpec
from ..functions.encode import safe_name
from .oracle import lenient_num

SITE_TYPES = ["F", "O"]   # vocabulary the view yields at every scale (l_linestatus)


def stored_facts(spark, sf: str) -> DataFrame:
    """The record view, joined once and stored, for queries that read it several times; the joins' files go at once."""
    with settings(spark, DROP_SHUFFLES):
        return written(fact_records(spark, sf), "facts")


def fixture_scorer(spark, sf: str, variant: str = "A", fact: DataFrame | None = None) -> Scorer:
    fact = fact_records(spark, sf) if fact is None else fact
    contract = fit_contract(fact, FIXTURE_SPEC, variant)
    wide = expand_features(fact, contract, FIXTURE_SPEC)
    scaler = Scaler.fit(wide, contract.names)
    return Scorer(FIXTURE_SPEC, contract, scaler, fixed_logistic(contract.names))


def sql_terms(variant: str, spec: TableSpec = FIXTURE_SPEC) -> list[tuple[str, str]]:
    out = []
    one = "1.0::DOUBLE"
    zero = "0.0::DOUBLE"
    for f in spec.features(variant):
        c = f.name
        if f.role == FLAG:
            out.append((c, f"CASE WHEN CAST({c} AS VARCHAR) IN ('Yes', '1') THEN {one} ELSE {zero} END"))
        elif f.role == CODE:
            out.append((c, f"CASE WHEN CAST({c} AS VARCHAR) IN ('{f.positive}', '1') THEN {one} ELSE {zero} END"))
        elif f.role in (LEVEL, MEDIAN, COUNT):
            out.append((c, f"coalesce({lenient_num(c)}, {float(f.default or 0.0)}::DOUBLE)"))
        elif f.role == FIXED_CAT:
            v = f"coalesce(nullif(CAST({c} AS VARCHAR), ''), 'None')"
            out += [(f"{c}__{safe_name(x)}", f"CASE WHEN {v} = '{x}' THEN {one} ELSE {zero} END") for x in f.vocab]
        elif f.role == FOUND_CAT:
            out += [(f"{c}__{safe_name(x)}", f"CASE WHEN CAST({c} AS VARCHAR) = '{x}' THEN {one} ELSE {zero} END")
                    for x in SITE_TYPES]
    return out


def sql_weights(variant: str) -> tuple[list[float], float]:
    m = fixed_logistic([n for n, _ in sql_terms(variant)])
    return list(m.weights), m.bias


def sql_scaler_cte(variant: str, source: str = "fact") -> str:
    """CTE ``st``: mean / population std of every term over ``source``."""
    terms = sql_terms(variant)
    aggs = ", ".join(f"avg({e}) AS m{i}, stddev_pop({e}) AS s{i}" for i, (_, e) in enumerate(terms))
    return f"st AS (SELECT {aggs} FROM {source})"


def sql_logit(variant: str) -> str:
    """Logit expression over a relation joined with ``st``."""
    terms = sql_terms(variant)
    w, b = sql_weights(variant)
    acc = f"{b!r}::DOUBLE"
    for i, (_, e) in enumerate(terms):
        z = f"(({e}) - st.m{i}) / (CASE WHEN st.s{i} = 0 THEN 1.0::DOUBLE ELSE st.s{i} END)"
        acc = f"({acc} + {w[i]!r}::DOUBLE * {z})"
    return acc


def sql_cost(opt: str = "opt", extra: str = "extra", flags=("flag_a", "flag_b", "flag_c", "flag_d")) -> str:
    s = FIXTURE_SPEC.search
    oc = (f"(CASE WHEN {opt} IS NULL OR {opt} = 'None' OR {opt} = '' THEN 0 "
          f"WHEN {opt} = '{s.double_cost_option}' THEN 2 ELSE 1 END)")
    fl = " + ".join(f"(CASE WHEN {f} = 'Yes' THEN 1 ELSE 0 END)" for f in flags)
    return f"({oc} + coalesce(CAST({extra} AS INTEGER), 0) + {fl})"


def round6(c):
    return F.round(c, 6)
