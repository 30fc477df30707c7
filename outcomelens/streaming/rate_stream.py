"""I2 rate_stream: outcome rate per (tumbling window, value) on a stream.

Event time needs a TIMESTAMP column for ``withWatermark`` (TIMESTAMP_NTZ is
refused).  A wall-clock (NTZ) time is turned into an instant by reading its
fields as UTC, so day windows are wall-clock days whatever the session time
zone.  ``delay`` says how late a row may come; the caller must choose it, since
Spark drops rows that come later.  In append mode a window is emitted once the
watermark passes its end, so the last, still open window is withheld; complete
mode gives all windows so far with every micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import normalize_flag


def as_utc_instant(c: str):
    """TIMESTAMP_NTZ wall clock -> TIMESTAMP instant, reading the fields as UTC."""
    x = F.col(c)
    return F.make_timestamp(F.year(x), F.month(x), F.dayofmonth(x), F.hour(x), F.minute(x),
                            F.date_part(F.lit("SECOND"), x), F.lit("UTC"))


def window_date(c: str):
    """UTC calendar date of an instant (independent of the session time zone)."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(F.col(c)) / 86400).cast("int"))


def windowed_rates(records: DataFrame, ts: str, value: str, label: str = "label", *,
                   delay: str, window: str = "1 day") -> DataFrame:
    """Streaming-safe aggregate: window start/end, value, n, positives, rate."""
    ts_type = dict(records.dtypes).get(ts, "timestamp")
    instant = as_utc_instant(ts) if ts_type == "timestamp_ntz" else F.col(ts).cast("timestamp")
    r = records.withColumn("_ts", instant).withWatermark("_ts", delay)
    g = r.groupBy(F.window("_ts", window).alias("w"), normalize_flag(value).alias("value")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("positives"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "value",
                    "n", "positives", (F.lit(100.0) * F.col("positives") / F.col("n")).alias("rate"))


def start_rate_stream(rates: DataFrame, out_path: str, checkpoint: str, available_now: bool = True,
                      complete: bool = False):
    """Start writing rates: closed windows appended to files, or (``complete``) all windows so far,
    each micro-batch replacing the files under ``out_path``."""
    if complete:
        w = rates.writeStream.outputMode("complete").foreachBatch(
            lambda batch, epoch: batch.write.mode("overwrite").parquet(out_path))
    else:
        w = rates.writeStream.outputMode("append").format("parquet").option("path", out_path)
    w = w.option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
