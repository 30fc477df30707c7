"""Registered queries against their DuckDB oracles at sf0.001.

A representative set runs by default; OUTCOMELENS_FULL=1 runs every key.
"""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()
DEFAULT = ["rate_by_value", "histogram", "numeric_summary", "common_configs", "batch_composition",
           "outcome_by_range", "stratified_split", "score_batch", "drop_incomplete", "top_configs",
           "first_over_threshold", "fingerprint", "publish_report", "rate_stream"]
KEYS = sorted(E.oracle_sql()) if os.environ.get("OUTCOMELENS_FULL") else DEFAULT


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (1, "nan") if math.isnan(v) else (2, repr(v))
    if isinstance(v, bool):
        return (3, str(v))
    if isinstance(v, int):
        return (2, repr(float(v)))
    return (4, str(v))


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in recs)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and set(df.columns) == {"feature", "value", "n", "positives", "rate"}


def test_every_query_has_a_callable():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF_SMALL)
    res = con.execute(E.oracle_sql()[key])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(dcols, res.fetchall())
