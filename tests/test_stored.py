"""Rows that a query reads several times are joined once, and a record's joins move little."""

import pytest

from conftest import SF_SMALL
from outcomelens.plans import q_io, q_learn, q_model, q_prepare, q_search, q_sinks
from outcomelens.sources.fixtures import fact_records


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_customers_are_joined_to_orders_not_to_records(spark):
    first = next(line for line in _plan(fact_records(spark, SF_SMALL)).splitlines() if "Join Inner" in line)
    assert "l_orderkey" in first and "c_custkey" not in first


class Seen(Exception):
    pass


def _stop(df, *_, **__):
    raise Seen(_plan(df))


@pytest.mark.parametrize("module,query,owner,step", [
    (q_model, "q_standardize", q_model.E, "fit_contract"), (q_model, "q_score_batch", q_model.SC, "score_batch"),
    (q_model, "q_explain_network", q_model.SC, "explain_gradient"), (q_model, "q_split_records", q_model.L, "stratified_parts"),
    (q_prepare, "q_fill_median", q_prepare.P, "medians"), (q_search, "q_optimize_own_fields", q_search.Q, "optimize_configs"),
    (q_sinks, "q_publish_document", q_sinks.R, "value_counts"), (q_learn, "_parts", q_learn.L, "stratified_parts"),
    (q_io, "q_fingerprint", q_io, "fingerprint")])
def test_rows_read_several_times_are_joined_once(spark, monkeypatch, module, query, owner, step):
    monkeypatch.setattr(owner, step, _stop)
    with pytest.raises(Seen) as seen:
        getattr(module, query)(spark, SF_SMALL)
    assert "Join" not in str(seen.value)


def test_a_request_stream_fits_its_scorers_on_stored_rows(spark, monkeypatch):
    monkeypatch.setattr(q_sinks, "fixture_scorer", lambda spark, sf, variant, fact: _stop(fact))
    with pytest.raises(Seen) as seen:
        q_sinks.q_request_stream(spark, SF_SMALL)
    assert "Join" not in str(seen.value)


def test_an_edited_copy_of_files_is_not_joined_again(spark, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter
    plans, parquet = [], DataFrameWriter.parquet

    def seen(self, path, *a, **k):
        plans.append(_plan(self._df))
        return parquet(self, path, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "parquet", seen)
    monkeypatch.setattr(q_sinks, "file_manifest", lambda *_, **__: (_ for _ in ()).throw(Seen()))
    with pytest.raises(Seen):
        q_sinks.q_file_manifest(spark, SF_SMALL)
    assert len(plans) == 2 and "Join" in plans[0] and "Join" not in plans[1]


def test_a_fingerprint_deals_rows_by_their_keys(spark, monkeypatch):
    dealt, taken = [], q_io.fingerprint
    monkeypatch.setattr(q_io, "fingerprint", lambda df, cols: dealt.append(_plan(df)) or taken(df, cols))
    q_io.q_fingerprint(spark, SF_SMALL)
    moved = [line for p in dealt for line in p.splitlines() if "RepartitionByExpression" in line]
    assert moved and all("l_orderkey" in line.split("[")[1] for line in moved)


def test_requests_have_no_copy_beside_those_sent(spark, monkeypatch):
    def start(source, *_):
        raise Seen(source)

    monkeypatch.setattr(q_sinks, "written", lambda df, name: _stop(df))
    monkeypatch.setattr(q_sinks, "start_request_stream", start)
    with pytest.raises(Seen) as seen:
        q_sinks.q_request_stream(spark, SF_SMALL)
    assert seen.value.args[0].isStreaming


def test_an_epoch_is_scored_once_and_not_persisted(spark, monkeypatch):
    import os
    import uuid

    from pyspark.sql import functions as F
    from outcomelens.session import ensure_checkpoint_dir
    from outcomelens.streaming.score_stream import epoch_sink
    base = f"{ensure_checkpoint_dir(spark)}/epochs-{uuid.uuid4().hex}"
    seen = spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame([(1, None), (2, "x"), (3, None)], "i int, error string")

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    batch = rows.mapInPandas(count, rows.schema)
    monkeypatch.setattr(type(batch), "persist", lambda self, *_: _stop(self))
    epoch_sink(f"{base}/out", f"{base}/bad")(batch, 0)
    assert sorted(r.i for r in spark.read.parquet(f"{base}/out").collect()) == [1, 3]
    assert [r.i for r in spark.read.parquet(f"{base}/bad").where(F.col("error") == "x").collect()] == [2]
    assert seen.value == 3 and os.listdir(f"{base}/out".removeprefix("file:")) == ["epoch=0"]


def test_settings_come_back(spark):
    from outcomelens.session import DROP_SHUFFLES, settings
    from outcomelens.streaming.score_stream import STATE
    before = {k: spark.conf.get(k, None) for k in DROP_SHUFFLES | STATE}
    with pytest.raises(Seen):
        with settings(spark, DROP_SHUFFLES | STATE):
            assert all(spark.conf.get(k) == v for k, v in (DROP_SHUFFLES | STATE).items())
            raise Seen()
    assert {k: spark.conf.get(k, None) for k in before} == before
