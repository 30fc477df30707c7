"""A4 publish_report: tidy report frames -> nested JSON documents (the sink side).

``nest`` makes one JSON object per group of a small report.  ``fragments`` takes any
number of reports of any size: every entry is a line of text with the brackets and
commas that stand before and after it, so the lines in order are one JSON document,
and no report or feature is ever one row.  ``publish`` writes them from sorted ranges.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import written


def nest(df: DataFrame, group: Sequence[str], key: str, value: str, name: str = "payload") -> DataFrame:
    """One row per group: JSON object key -> value, keys in ascending order.

    ``df`` is an aggregated report (one row per key), so a group holds one entry
    per category value, not raw records.
    """
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), F.col(value).alias("v"))))
    return df.groupBy(*group).agg(F.to_json(F.map_from_entries(entries)).alias(name))


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def entries(report: str, df: DataFrame, key: str, values: Sequence[str], feature=None) -> DataFrame:
    """(report, feature, key, value): a tidy report's rows as entries, the values as a JSON object."""
    name = F.lit("") if feature is None else F.col(feature).cast("string") if isinstance(feature, str) else feature
    return df.select(F.lit(report).alias("report"), name.alias("feature"), F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("key"),
                     F.to_json(F.struct(*values)).alias("value"))


def _text(column):
    """A JSON string: that of a one-element array, without its brackets."""
    return F.regexp_extract(F.to_json(F.array(column)), r"(?s)^\[(.*)\]$", 1)


def fragments(rows: DataFrame) -> DataFrame:
    """(report, feature, key, line): the lines, ordered by the first three, are {report: {feature: {key: value}}}.

    Where an object opens or closes follows from the first and last key of each feature
    and the first and last feature of each report, a few small rows.
    """
    rows = written(rows, "report-entries")
    ends = rows.groupBy("report", "feature").agg(F.min("key").alias("_k1"), F.max("key").alias("_k2"))
    around = ends.groupBy("report").agg(F.min("feature").alias("_f1"), F.max("feature").alias("_f2"))
    whole = around.agg(F.struct(F.min("report").alias("first"), F.max("report").alias("last")).alias("r")).scalar()
    ends = ends.join(F.broadcast(around), "report")  # a row per report
    d = rows.join(ends, ["report", "feature"])
    opens_feature, closes_feature = F.col("key") == F.col("_k1"), F.col("key") == F.col("_k2")
    opens_report = opens_feature & (F.col("feature") == F.col("_f1"))
    closes_report = closes_feature & (F.col("feature") == F.col("_f2"))
    head = F.concat(F.when(opens_report, F.concat(F.when(F.col("report") == whole.getField("first"), "{").otherwise(","), _text(F.col("report")), F.lit(":{")))
                    .when(opens_feature, F.lit(",")).otherwise(F.lit("")),
                    F.when(opens_feature, F.concat(_text(F.col("feature")), F.lit(":{"))).otherwise(F.lit(",")))
    tail = F.concat(F.when(closes_feature, "}").otherwise(""), F.when(closes_report, "}").otherwise(""),
                    F.when(closes_report & (F.col("report") == whole.getField("last")), "}").otherwise(""))
    return d.select("report", "feature", "key", F.concat(head, _text(F.col("key")), F.lit(":"), "value", tail).alias("line"))


def publish(rows: DataFrame, path: str) -> None:
    """The document in text files whose names' order is the lines' order."""
    fragments(rows).orderBy("report", "feature", "key").select("line").write.mode("overwrite").text(path)
