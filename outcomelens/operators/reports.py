"""Aggregate reports over records.

Every report is one lazy DataFrame built from hash aggregates with map-side
partial aggregation, so a hot category costs one row per task before the
shuffle.  Several per-column reports share a single pass by unpivoting to
(feature, value) first instead of scanning once per column.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import as_number, blank_to_sentinel, lenient_int, lenient_numeric, normalize_flag
from ..spec import NONE_VALUE
from .ordering import exact_quantile_frame, written


def _rate(pos: str = "positives", n: str = "n"):
    return F.coalesce(F.try_divide(F.lit(100.0) * F.col(pos), F.col(n)), F.lit(0.0))


def _positive(label: str):
    return F.when(F.col(label) == 1, 1).otherwise(0)


def _long_categoricals(df: DataFrame, columns: Sequence[str], label: str,
                       blank_policy: str) -> DataFrame:
    cols = [c for c in columns if c in df.columns]
    casted = df.select(F.col(label).alias("_label"),
                       *[F.col(c).cast("string").alias(c) for c in cols])
    long = casted.unpivot(["_label"], cols, "feature", "value")
    if blank_policy == "None":
        long = long.withColumn("value", blank_to_sentinel("value", NONE_VALUE))
    else:
        long = long.withColumn("value", F.coalesce(F.col("value"), F.lit("")))
    return long


def value_counts(df: DataFrame, columns: Sequence[str], label: str = "label",
                 blank_policy: str = "None") -> DataFrame:
    """Rows per (feature, value) for each categorical column, plus the row total."""
    long = _long_categoricals(df, columns, label, blank_policy)
    g = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    return _with_total(g)


def _with_total(g: DataFrame) -> DataFrame:
    """Row total beside counts per (feature, value): every row gives exactly one (sentinel-filled)
    value per feature, so a feature's counts sum to it.  Two steps over the counted frame, the
    first by (feature, hash of the value), so a feature of very many values is dealt over tasks."""
    g = g.withColumn("_s", F.pmod(F.xxhash64("value"), F.lit(64)))
    part = Window.partitionBy("feature", "_s")
    g = g.withColumn("_p", F.sum("n").over(part)).withColumn("_f", F.row_number().over(part.orderBy("value")) == 1)
    firsts = g.where("_f").groupBy("feature").agg(F.sum("_p").alias("total"))
    return g.join(F.broadcast(firsts), "feature").select("feature", "value", "n", F.col("total").cast("long").alias("total"))


def rate_by_value(df: DataFrame, columns: Sequence[str], label: str = "label",
                  blank_policy: str = "None") -> DataFrame:
    """(feature, value, n, positives, rate) in one grouped pass over all columns."""
    long = _long_categoricals(df, columns, label, blank_policy)
    g = long.groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(_positive("_label")).cast("long").alias("positives"))
    return g.select("feature", "value", "n", "positives", _rate().alias("rate"))


def numeric_distribution(df: DataFrame, column: str, label: str = "label") -> DataFrame:
    """Per exact numeric value: n, positives, rate; bad text ignored."""
    v = df.select(as_number(df, column).alias("value"), F.col(label).alias("_label"))
    g = (v.where(F.col("value").isNotNull()).groupBy("value")
          .agg(F.count(F.lit(1)).alias("n"),
               F.sum(_positive("_label")).cast("long").alias("positives")))
    return g.select("value", "n", "positives", _rate().alias("rate"))


def overall_rate(df: DataFrame, label: str = "label") -> DataFrame:
    """C4: rows, positives, rate (0 when empty)."""
    g = df.agg(F.count(F.lit(1)).alias("n"),
               F.coalesce(F.sum(_positive(label)), F.lit(0)).cast("long").alias("positives"))
    return g.select("n", "positives", _rate().alias("rate"))


def _long_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cols = [c for c in columns if c in df.columns]
    casted = df.select(*[as_number(df, c).alias(c) for c in cols])
    return (casted.unpivot([], cols, "column", "x").where(F.col("x").isNotNull()))


def _bin_counts(long: DataFrame, width: float) -> DataFrame:
    """(column, bin, n, largest value) per floor(x / width): one pass over the values."""
    w = F.lit(float(width))
    return long.groupBy("column", F.floor(F.col("x") / w).cast("long").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.max("x").alias("mx"))


_SPINE = 1 << 16           # bins of a spine made by one row
_MOST_BINS = 1 << 40        # of a column: more can't be listed, so it's an error


def _close_bins(bins: DataFrame, width: float) -> DataFrame:
    """Counted bins -> (column, bin_start, n): the last bin is closed, empty bins between stay.

    Bounds come from one small row per column.  Empty bins are made in chunks: rows that
    each stand for ``_SPINE`` bins are dealt over tasks; chunks without a counted bin are
    listed where they are, only the others meet the counts.  So an outlier costs rows,
    never an array or a window over all bins of a column.  A column spanning more than
    2^40 bins raises an error that says so.
    """
    w = int(width)
    top = F.max_by(F.struct("bin", "mx"), "bin")
    tops = bins.groupBy("column").agg(top.alias("t"), F.min("bin").alias("lo"))
    # where the top bin holds its lower edge only, its values belong to the closed bin before it
    folds = (F.col("t.mx") == F.col("t.bin") * F.lit(float(width))) & (F.col("t.bin") > F.col("lo"))
    tops = tops.select("column", "lo", F.when(folds, F.col("t.bin") - 1).otherwise(F.col("t.bin")).alias("last"))
    wide = F.col("last").cast("double") - F.col("lo") >= F.lit(float(_MOST_BINS))
    tops = tops.withColumn("last", F.when(wide, F.raise_error(F.concat(
        F.lit(f"histogram: more than {_MOST_BINS} bins of width {w} in "), "column"))).otherwise(F.col("last")))
    tops = F.broadcast(tops)  # a row per column
    chunk = F.floor((F.col("bin") - F.col("lo")) / _SPINE).cast("long")
    counts = (bins.join(tops, "column").withColumn("bin", F.least("bin", "last"))
              .select("column", chunk.alias("chunk"), "bin", "n", "lo", "last"))
    chunks = tops.select("column", "lo", "last", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("last") - F.col("lo")) / _SPINE).cast("long"))).alias("chunk")).repartition("column", "chunk")
    filled = counts.select("column", "chunk").distinct()

    def listed(rows: DataFrame) -> DataFrame:
        first = F.col("lo") + F.col("chunk") * _SPINE
        return rows.select("column", F.explode(F.sequence(first, F.least(first + (_SPINE - 1), "last"))).alias("bin"), F.lit(0).cast("long").alias("n"))

    empty = listed(chunks.join(filled, ["column", "chunk"], "left_anti"))
    met = (listed(chunks.join(filled, ["column", "chunk"], "left_semi")).unionByName(counts.select("column", "bin", "n"))
           .groupBy("column", "bin").agg(F.sum("n").alias("n")))
    return empty.unionByName(met).select("column", (F.col("bin") * w).alias("bin_start"), F.col("n").cast("long").alias("n"))


def histogram(df: DataFrame, columns: Sequence[str], width: float = 5000.0) -> DataFrame:
    """Fixed-width bins from floor(min) to ceil(max); empty bins kept, last bin closed.

    Rows are counted per bin in one pass; bounds, the closed last bin and the empty
    bins follow from the counted frame.
    """
    return _close_bins(written(_bin_counts(_long_numeric(df, columns), width), "bins"), width)


def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Min, max, mean, exact median, count per numeric column.

    The first pass over the values gives all but the median, which is found by radix selection.
    """
    long = _long_numeric(df, columns)
    s = exact_quantile_frame(long, "x", "column", with_stats=True)
    return s.select("column", "min", "max", "mean", F.col("q_value").alias("median"), "n")


def rate_curve(df: DataFrame, column: str, label: str = "label") -> DataFrame:
    """(x, rate, n, positives) per numeric x, ordered by x."""
    d = numeric_distribution(df, column, label)
    return d.select(F.col("value").alias("x"), "rate", "n", "positives").orderBy("x")


def allow_list(df: DataFrame, column: str, allowed: DataFrame, allowed_col: str) -> DataFrame:
    """Keep rows whose value is in the allowed set (left semi join).

    The allowed set is a dimension; Spark broadcasts it when its size estimate is
    under ``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise.
    """
    a = allowed.select(F.col(allowed_col).cast("double").alias("_allowed")).distinct()
    return df.join(a, lenient_numeric(column) == F.col("_allowed"), "left_semi")


def rate_curve_allowed(df: DataFrame, column: str, allowed: DataFrame, allowed_col: str,
                       label: str = "label") -> DataFrame:
    """C7 restricted to allow-listed x values."""
    return rate_curve(allow_list(df, column, allowed, allowed_col), column, label)


def common_configs(df: DataFrame, columns: Sequence[str], flag_columns: Sequence[str],
                   count_column: str | None, label: str = "label", min_n: int = 2,
                   top: int = 20) -> DataFrame:
    """Most common configurations (n >= min_n) with outcome rate, top ``top`` by n.

    Values are normalised before grouping (blank -> None, flag spellings -> Yes/No,
    count -> int), so 'Yes' and '1' fall in one group.  Ties on n are broken by the
    configuration columns, ascending; ``limit`` is the feature (a top-k report).
    """
    proj = []
    for c in columns:
        if c not in df.columns:
            continue
        if c in flag_columns:
            proj.append(normalize_flag(c).alias(c))
        elif c == count_column:
            proj.append(lenient_int(c).alias(c))
        else:
            proj.append(blank_to_sentinel(F.col(c).cast("string")).alias(c))
    keys = [p for p in columns if p in df.columns]
    norm = df.select(*proj, F.col(label).alias("_label"))
    g = norm.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                                F.sum(_positive("_label")).cast("long").alias("positives"))
    g = g.where(F.col("n") >= min_n).select(*keys, "n", "positives", _rate().alias("rate"))
    g = g.withColumn("likely", F.col("rate") >= 50.0)
    return g.orderBy(F.col("n").desc(), *[F.col(k).asc_nulls_first() for k in keys]).limit(top)


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per label."""
    return df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def vocabulary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct non-null values per column, as (column, value) rows."""
    cols = [c for c in columns if c in df.columns]
    casted = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    return (casted.unpivot([], cols, "column", "value")
                  .where(F.col("value").isNotNull()).distinct())


def vocabulary_list(df: DataFrame, column: str, max_values: int | None = None) -> list[str]:
    """Sorted vocabulary of a categorical column, brought to the driver.

    It becomes one feature per value, so it is as wide as the model.  ``max_values``
    (off by default; ``TableSpec.max_vocabulary`` in a fit) refuses a wider column.
    """
    values = df.select(F.col(column).cast("string").alias("v")).where("v IS NOT NULL").distinct().orderBy("v")
    rows = (values if max_values is None else values.limit(max_values + 1)).collect()
    if max_values is not None and len(rows) > max_values:
        raise ValueError(f"{column}: more than {max_values} distinct values; not a category column")
    return [r.v for r in rows]


def stats_union(df: DataFrame, categoricals: Sequence[str], numeric: str,
                histogram_columns: Sequence[str], label: str = "label",
                width: float = 5000.0) -> DataFrame:
    """G1: C1, C3 and C5 as one tidy frame (kind, feature, value, n), from one pass over the rows.

    Each row gives its cells as (kind, feature, value or bin); one aggregate counts
    them, and the bins are closed on the counted frame, which is written once so that
    the two readers of it don't repeat the pass.
    """
    cats = [c for c in categoricals if c in df.columns]
    hist = [c for c in histogram_columns if c in df.columns]
    w = F.lit(float(width))

    def cell(kind, feature, value, x):
        return F.struct(F.lit(kind).alias("kind"), F.lit(feature).alias("feature"), value.cast("string").alias("value"),
                        x.cast("double").alias("x"))

    none = F.lit(None).cast("double")
    cells = [cell("distribution", c, blank_to_sentinel(F.col(c).cast("string"), NONE_VALUE), none) for c in cats]
    cells.append(cell("numeric", numeric, as_number(df, numeric), as_number(df, numeric)))
    cells += [cell("histogram", c, F.floor(as_number(df, c) / w).cast("long"), as_number(df, c)) for c in hist]
    long = df.select(F.inline(F.array(*cells))).where("kind = 'distribution' OR x IS NOT NULL")
    counted = written(long.groupBy("kind", "feature", "value").agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("mx")), "stats")
    bins = counted.where("kind = 'histogram'").select(F.col("feature").alias("column"), F.col("value").cast("long").alias("bin"), "n", "mx")
    closed = _close_bins(bins, width).select(
        F.lit("histogram").alias("kind"), F.col("column").alias("feature"), F.col("bin_start").cast("string").alias("value"), "n")
    return counted.where("kind <> 'histogram'").select("kind", "feature", "value", "n").unionByName(closed)
