"""Streaming queries (I1, I2): run to completion with availableNow, read the file sink back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources.fixtures import events_as_records, fact_from_lineitem, table
from ..streaming.rate_stream import start_rate_stream, window_date, windowed_rates
from ..streaming.score_stream import start_score_stream
from .catalog import register
from .fixture_model import fixture_scorer, sql_cost, sql_logit, sql_scaler_cte
from .oracle import BATCH, FACT, norm_flag

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "own_key"]


def _scratch(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"


@register("score_stream", f"""WITH {FACT}, {sql_scaler_cte('A')}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, own_amt AS own_key,
  CASE WHEN {sql_cost()} <= 4 THEN round(1.0::DOUBLE / (1.0::DOUBLE + exp(-({sql_logit('A')}))), 6) END AS probability,
  CASE WHEN {sql_cost()} > 4 THEN 'invalid configuration: ' || CAST({sql_cost()} AS VARCHAR) || ' slots used, limit 4' END AS error
FROM fact, st""")
def q_score_stream(spark, sf):
    """Line items arrive as a stream, join static dimensions, are scored; valid rows
    land in the output sink and over-limit rows in the quarantine sink."""
    sc = fixture_scorer(spark, sf, "A")
    schema = table(spark, sf, "lineitem").schema
    src = (spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet")
                .option("maxFilesPerTrigger", 1).parquet(sf))
    base = _scratch(spark, "score")
    q = start_score_stream(
        spark, src, lambda li: fact_from_lineitem(spark, sf, li).withColumn("own_key", F.col("own_amt")),
        sc, KEY, f"{base}/out", f"{base}/quarantine", f"{base}/_checkpoint")
    q.awaitTermination()
    both = spark.read.parquet(f"{base}/out").unionByName(spark.read.parquet(f"{base}/quarantine"))
    return both.select(*KEY, F.round("probability", 6).alias("probability"), "error")


@register("rate_stream", f"""WITH {BATCH},
g AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS window_start, {norm_flag('flag_d')} AS value, count(*) AS n,
        count(*) FILTER (WHERE label = 1) AS positives FROM brec GROUP BY 1, 2)
SELECT window_start, value, n, positives, 100.0::DOUBLE * positives / n AS rate FROM g""")
def q_rate_stream(spark, sf):
    """Purchase rate per (day window, flag value), in complete mode: the last, open day too."""
    schema = table(spark, sf, "events").schema
    src = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    rates = windowed_rates(events_as_records(src), "ts", "flag_d", delay="1 day")
    base = _scratch(spark, "rates")
    q = start_rate_stream(rates, f"{base}/out", f"{base}/_checkpoint", complete=True)
    q.awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    return out.select(window_date("window_start").alias("window_start"), "value", "n", "positives", "rate")
