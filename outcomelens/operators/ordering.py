"""Order-dependent building blocks that stay distributed.

``global_index`` gives every row its 0-based position in a total order without
an unpartitioned window (which runs in one task); ``exact_quantile_frame`` finds exact
quantiles without sorting at all.  Recipe of the index:

1. range-partition on the order keys and sort inside partitions;
2. stamp partition id and position inside the partition, then ``checkpoint()``
   into the session's reliable checkpoint folder, which freezes the layout and
   cuts lineage (a lost executor re-reads the checkpoint, not the sort);
3. per-partition totals (at most one row per partition) -> exclusive prefix ->
   broadcast join back (size bounded by the partition count);
4. row position = partition offset + position inside the partition.

Order keys should be unique, otherwise positions among ties are arbitrary.
Range partitioning of unique keys is balanced, so no task gets a hot key.
"""

from __future__ import annotations

import math
import uuid
from typing import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import ensure_checkpoint_dir, shuffle_partitions

ROWS_PER_TASK = 2_000_000  # of a range, about, however large the input is
_PID = "_ol_pid"
_POS = "_ol_pos"


def _frozen_sorted(df: DataFrame, order: Sequence[Column | str], partitions: int | None,
                   keep_input: bool = False) -> DataFrame:
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or max(shuffle_partitions(spark), -(-df.count() // ROWS_PER_TASK))
    # The range bounds are sampled in one job and the data moved in the next.  For a
    # pre-aggregated input (``keep_input``) it is cheaper to keep it between the two
    # (memory, spilling to disk; lost blocks recompute from lineage) than to rebuild it;
    # raw row-level input is recomputed instead of being cached whole.
    def stamp(src: DataFrame) -> DataFrame:
        ranged = src.repartitionByRange(n, *order).sortWithinPartitions(*order)
        return (ranged.withColumn(_PID, F.spark_partition_id())
                      .withColumn(_POS, F.monotonically_increasing_id())).checkpoint(eager=True)

    if not keep_input:
        return stamp(df)
    src = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return stamp(src)
    finally:
        src.unpersist()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: it is computed once."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_stored(df: DataFrame) -> bool:
    """Whether the frame is files as they stand, which need no second copy to be read again."""
    return df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"


def _offsets(frozen: DataFrame, weight: Column) -> DataFrame:
    per_part = frozen.groupBy(_PID).agg(F.sum(weight).alias("_ol_part_total"),
                                        F.min(_POS).alias("_ol_first_pos"))
    # at most one row per partition: an unpartitioned window over it is bounded
    w = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select(_PID, "_ol_first_pos",
                           F.coalesce(F.sum("_ol_part_total").over(w), F.lit(0)).alias("_ol_offset"))


def global_index(df: DataFrame, order: Sequence[Column | str], name: str = "idx",
                 partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 0-based position of the row in the total order ``order``."""
    frozen = _frozen_sorted(df, order, partitions)
    offs = _offsets(frozen, F.lit(1).cast("long"))
    out = frozen.join(F.broadcast(offs), _PID)
    return (out.withColumn(name, F.col("_ol_offset") + F.col(_POS) - F.col("_ol_first_pos"))
               .drop(_PID, _POS, "_ol_offset", "_ol_first_pos"))


_BUCKETS = 4096


def _bucket(x: Column, lo: float, hi: float) -> Column:
    """Number from 0 to 4096 that never falls as x rises from lo to hi; infinities stand apart.

    The first passes divide the logarithm's range, so a few very large values don't
    fill all but one bucket; near the end, and where that tells no two values apart, the
    values' own range is divided, which always tells the ends apart.
    """
    near = (lo > 0 and hi / lo < 16) or (hi < 0 and lo / hi < 16) or max(abs(lo), abs(hi)) < 1
    ends = [math.copysign(math.log1p(abs(v)), v) for v in (lo, hi)]
    if near or ends[0] == ends[1]:
        part = (x - F.lit(lo)) / F.lit(hi - lo)
    else:
        part = (F.signum(x) * F.log1p(F.abs(x)) - F.lit(ends[0])) / F.lit(ends[1] - ends[0])
    inside = F.floor(F.least(F.greatest(part, F.lit(0.0)), F.lit(1.0)) * _BUCKETS).cast("int")
    return F.when(x == float("inf"), _BUCKETS + 1).when(x == float("-inf"), -1).otherwise(inside)


def exact_quantile_frame(df: DataFrame, value: str, group_col: str | None = None,
                         q: float = 0.5, with_stats: bool = False) -> DataFrame:
    """Exact interpolated quantile (pandas/DuckDB ``median`` semantics) of ``value``, by radix selection.

    Returns one row per group: (group?, q_value); ``with_stats`` (grouped form) adds n,
    min, max and mean.  Groups are few, as the columns of a report.

    A pass counts the values per bucket of their range (at most 4,098 rows a group reach
    the driver); the bucket that holds the wanted rank is the next range, until it holds
    one value.  After the first pass only the rows of the wanted buckets are kept.
    Nothing is sorted, and a hot value is one count per task.
    """
    spark = df.sparkSession
    x = F.col(value).cast("double")
    rows = df.select(*([F.col(group_col).alias("g")] if group_col else [F.lit(0).alias("g")]), x.alias("x")).where("x IS NOT NULL AND NOT isnan(x)")
    finite = F.when(F.abs("x") < float("inf"), F.col("x"))
    stats = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"),
                                  F.min(finite).alias("lo"), F.max(finite).alias("hi")).collect()
    # a target is a rank of a group: rows before its range, and the range
    targets: dict[tuple, list] = {}
    for r in stats:
        at = (r["n"] - 1) * q
        for rank in {math.floor(at), math.ceil(at)}:
            lo, hi = (r["min"], r["max"]) if r["lo"] is None else (r["lo"], r["hi"])
            targets[r["g"], rank] = [0, lo, hi, r["min"] == r["max"]]
    names = {t: i for i, t in enumerate(targets)}
    first = True
    while any(not t[3] for t in targets.values()):
        cells = []
        for (g, rank), (_, lo, hi, done) in targets.items():
            if not done:
                here = F.col("g").eqNullSafe(F.lit(g)) & (F.lit(True) if first else F.col("x").between(lo, hi))
                cells.append(F.when(here, F.struct(F.lit(names[g, rank]).alias("t"), _bucket(F.col("x"), lo, hi).alias("b"))))
        counted = rows.select("g", "x", F.explode(F.array_compact(F.array(*cells))).alias("c"))
        found = counted.groupBy("c.t", "c.b").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        by_target: dict[int, list] = {}
        for r in found:
            by_target.setdefault(r["t"], []).append(r)
        for key, state in targets.items():
            for r in sorted(by_target.get(names[key], ()), key=lambda r: r["b"]):
                if state[0] + r["n"] > key[1]:
                    state[1:] = [r["lo"], r["hi"], r["lo"] == r["hi"]]
                    break
                state[0] += r["n"]
        if first and any(not t[3] for t in targets.values()):
            keep = F.lit(False)
            for (g, _), (_, lo, hi, done) in targets.items():
                if not done:
                    keep = keep | (F.col("g").eqNullSafe(F.lit(g)) & F.col("x").between(lo, hi))
            rows = written(rows.where(keep), "quantile-rows")
        first = False
    out = []
    for r in stats:
        at = (r["n"] - 1) * q
        low, high = targets[r["g"], math.floor(at)][1], targets[r["g"], math.ceil(at)][1]
        value_ = low if low == high else low + (high - low) * (at - math.floor(at))
        out.append(([r["g"]] if group_col else []) + [value_] + ([r["n"], r["min"], r["max"], r["mean"]] if with_stats and group_col else []))
    kind = df.schema[group_col].dataType.simpleString() if group_col else None
    schema = ([f"`{group_col}` {kind}"] if group_col else []) + ["q_value double"]
    schema += ["n long", "min double", "max double", "mean double"] if with_stats and group_col else []
    if not group_col and not out:
        out = [[None]]
    return spark.createDataFrame(out, ", ".join(schema))
