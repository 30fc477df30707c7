"""Fixed-size batches of consecutive records and per-batch crosstabs.

Consecutive rows (in an explicit order) form batches of ``size``.  Position in
the order comes from the distributed ``global_index``; one grouped aggregate
then yields every per-batch statistic, and the crosstabs aggregate that small
batch-level frame against literal label spines so empty cells show as 0.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cap_value, is_truthy, lenient_int, outcome_label, range_bucket
from .ordering import global_index


def assign_batches(df: DataFrame, order: Sequence[Column | str], size: int = 4,
                   name: str = "batch") -> DataFrame:
    """batch = floor(position / size) over the total order ``order`` (unique keys)."""
    idx = global_index(df, order, "_pos")
    return idx.withColumn(name, F.floor(F.col("_pos") / F.lit(size)).cast("long"))


def batch_composition(batched: DataFrame, item_a: str, item_b: str, flags: Sequence[str],
                      allowed_types: Sequence[str], default_type: str, size: int = 4,
                      label: str = "label", item: str = "item", count_col: str = "extra",
                      site_type: str = "site_type") -> DataFrame:
    """C13 + E2 + E3 in one aggregate per batch; incomplete batches dropped.

    Columns: batch, n, positives, negatives, item_a_n, item_b_n, any_flag_n,
    extra_sum, site_type.  ``site_type`` is the first non-null value in the batch
    order, replaced by ``default_type`` when outside ``allowed_types``.
    """
    any_flag = None
    for f in flags:
        t = is_truthy(f)
        any_flag = t if any_flag is None else (any_flag | t)
    first_type = F.min_by(F.col(site_type), F.when(F.col(site_type).isNotNull(), F.col("_pos")))
    g = batched.groupBy("batch").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(label) == 1).alias("positives"),
        F.count_if(F.col(item) == F.lit(item_a)).alias("item_a_n"),
        F.count_if(F.col(item) == F.lit(item_b)).alias("item_b_n"),
        F.count_if(any_flag).alias("any_flag_n"),
        F.sum(lenient_int(count_col)).cast("long").alias("extra_sum"),
        first_type.alias("_first_type"))
    g = g.where(F.col("n") == size)  # E2: complete batches only
    st = F.when(F.col("_first_type").isin(*allowed_types), F.col("_first_type")).otherwise(F.lit(default_type))
    return g.select("batch", "n", "positives", (F.col("n") - F.col("positives")).alias("negatives"),
                    "item_a_n", "item_b_n", "any_flag_n", "extra_sum", st.alias("site_type"))


OUTCOMES = ("0k", "1k", "2k", "3k", "4k")
CHASE_RANGES = ("0-3", "4-6", "7-9", "10-12")


def _spine(spark, outcomes: Sequence[str], buckets: Sequence[str]) -> DataFrame:
    """Literal (outcome, bucket) label grid built from a fixed label list."""
    cells = [F.struct(F.lit(o).alias("outcome"), F.lit(b).alias("bucket"))
             for o in outcomes for b in buckets]
    return spark.range(1).select(F.inline(F.array(*cells)))


def outcome_by_site_type(comp: DataFrame, type_a: str, type_b: str, size: int = 4) -> DataFrame:
    """C14: outcome x {type_a, type_b} counts, total and % of all complete batches."""
    spark = comp.sparkSession
    lab = comp.select(outcome_label("positives", size).alias("outcome"), "site_type")
    g = lab.groupBy("outcome").agg(F.count_if(F.col("site_type") == type_a).alias("type_a_n"),
                                   F.count_if(F.col("site_type") == type_b).alias("type_b_n"))
    spine = _spine(spark, OUTCOMES, ["-"]).select("outcome")
    out = spine.join(g, "outcome", "left").select(
        "outcome", F.coalesce("type_a_n", F.lit(0)).cast("long").alias("type_a_n"),
        F.coalesce("type_b_n", F.lit(0)).cast("long").alias("type_b_n"))
    out = out.withColumn("total", F.col("type_a_n") + F.col("type_b_n"))
    all_n = out.agg(F.sum("total")).scalar()
    return out.withColumn("pct", F.coalesce(F.try_divide(F.col("total") * F.lit(100.0), all_n), F.lit(0.0)))


def outcome_crosstab(comp: DataFrame, bucket: Column, buckets: Sequence[str], size: int = 4) -> DataFrame:
    """Outcome x bucket counts over complete batches, full spine, zero-filled."""
    spark = comp.sparkSession
    lab = comp.select(outcome_label("positives", size).alias("outcome"), bucket.alias("bucket"))
    g = lab.groupBy("outcome", "bucket").agg(F.count(F.lit(1)).alias("n"))
    return (_spine(spark, OUTCOMES, buckets).join(g, ["outcome", "bucket"], "left")
            .select("outcome", "bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def count_buckets(cap: int = 4) -> list[str]:
    return [str(i) for i in range(cap + 1)]


def outcome_by_item_a(comp: DataFrame, size: int = 4) -> DataFrame:
    """Outcome x number of members with item A (capped at 4)."""
    return outcome_crosstab(comp, cap_value("item_a_n", 4).cast("string"), count_buckets(), size)


def outcome_by_item_b(comp: DataFrame, size: int = 4) -> DataFrame:
    """Outcome x number of members with item B (capped at 4)."""
    return outcome_crosstab(comp, cap_value("item_b_n", 4).cast("string"), count_buckets(), size)


def outcome_by_any_flag(comp: DataFrame, size: int = 4) -> DataFrame:
    """Outcome x number of members with any flag set (capped at 4)."""
    return outcome_crosstab(comp, cap_value("any_flag_n", 4).cast("string"), count_buckets(), size)


def outcome_by_range(comp: DataFrame, size: int = 4) -> DataFrame:
    """C15d: outcome x range of the batch's count sum (0-3, 4-6, 7-9, 10-12)."""
    return outcome_crosstab(comp, range_bucket("extra_sum"), CHASE_RANGES, size)
