"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training time 0..1, piecewise linear.
Its integral, scaled to the source's target, is the cumulative demand; a
document's place in its source's order is a stretch of that demand, and the
inverse gives the training position.  Sorting by position is the mix.

Order within a source is a hash order, laid out by two-level prefix sums: hash
blocks whose number follows the row count, then a window inside each block, so
no source is gathered in one task.

Defined cases: a null text has size 0; rows of size 0 are never taken; null is
a source of its own, after all others; repeated rows count as often as they
occur (and stand next to each other in the order, in one block); an empty table
gives an empty mix.  Sizes are those of whole texts, whatever their length.  Equal
hashes are ordered by doc_id and size.  ``mix`` keeps other columns, whatever their
names, ``digest`` ignores them.  Sources are taken to be as many as fit one task's
window (their number is that of the sources, not of the rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outcomelens.llm.common import WORD, written

#: Shapes of the schedules, by the source's place in the weights' cycle: weight at time 0, 1/2 and 1.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
WEIGHTS = (1.0, 2.0, 3.0)
MAX_EPOCHS = 3
ROWS_PER_BLOCK = 8192


def targets(sources: DataFrame) -> DataFrame:
    """Targets of sources (one row each: source, source_size): shares by weight, stopped at
    ``MAX_EPOCHS`` times the size, the excess reshared until none is above.

    The stopped sources are a prefix in the order of size per weight, so the common
    factor follows from prefix sums over the sources; no repeated resharing is needed.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in WEIGHTS])
    s = (sources.withColumn("place", (F.row_number().over(order) - 1) % len(WEIGHTS))
         .withColumn("weight", F.get(cycle, F.col("place")))
         .withColumn("cap", F.lit(float(MAX_EPOCHS)) * F.col("source_size")))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = (s.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
         .withColumn("rest", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
         .withColumn("factor", (F.sum(F.col("source_size").cast("double")).over(every) - F.col("capped")) / F.col("rest"))
         .withColumn("open", F.col("factor") * F.col("weight") <= F.col("cap")))
    factor = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("factor")))).over(every)["factor"]
    return s.select("source", "source_size", "place",
                    F.least(F.col("cap"), F.coalesce(factor * F.col("weight"), F.col("cap"))).alias("target"))


def position(share: Column, place: Column) -> Column:
    """Training time at which a source has met ``share`` (0..1) of its demand.

    The schedule's integral is quadratic on either half; its inverse is a root.
    """
    out = None
    for i, (a, b, c) in enumerate(SCHEDULES):
        first, total = (a + b) / 4, (a + b) / 4 + (b + c) / 4
        y = share * total
        early, late = _root(y, a, 2 * (b - a)), F.lit(0.5) + _root(y - first, b, 2 * (c - b))
        t = F.when(y <= first, early).otherwise(late)
        out = F.when(place == i, t) if out is None else out.when(place == i, t)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def _root(y: Column, weight: float, slope: float) -> Column:
    """Smallest t >= 0 with weight * t + slope / 2 * t^2 = y."""
    if slope == 0:
        return y / weight
    under = F.greatest(F.lit(weight * weight) + 2 * slope * y, F.lit(0.0))
    return (F.sqrt(under) - weight) / slope


def plan(docs: DataFrame, keep_row: bool = False) -> DataFrame:
    """Per document row: doc_id, size, its source's size and target, ``copies`` taken,
    and ``start``/``place``: where its stretch begins in the source's order.

    ``keep_row`` carries the whole input row along as the struct ``row``.
    The order is that of a hash of the row; blocks are ranges of that hash, so
    their number changes no result.
    """
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    order = F.concat_ws("|", F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    rows = docs.select("doc_id", "source", size.alias("size"), F.conv(F.substring(F.md5(order), 1, 15), 16, 10).cast("long").alias("h"),
                       F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    # sizes are stored; whole rows, which are much longer, are read again
    sized = written(rows.drop("row"), "mix-sizes")
    blocks = max(1, -(-sized.count() // ROWS_PER_BLOCK))
    block = F.floor(F.col("h") / F.lit(float(1 << 60)) * blocks)
    sums = sized.withColumn("b", block).groupBy("source", "b").agg(F.sum("size").alias("s"))
    sized = (rows if keep_row else sized).withColumn("b", block)
    goal = targets(sums.groupBy("source").agg(F.sum("s").alias("source_size")))
    ahead = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "b", F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("ahead")).alias("o")
    offsets = (offsets.join(goal.alias("g"), F.expr("o.source <=> g.source"))
               .select("o.*", "source_size", "place", "target").alias("o"))
    inside = Window.partitionBy("source", "b").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    run = sized.withColumn("before", F.sum("size").over(inside) - F.col("size")).alias("d")
    both = run.join(offsets, F.expr("d.source <=> o.source AND d.b = o.b"))
    start = F.col("ahead") + F.col("before")
    full = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    rest = F.col("target") - full * F.col("source_size")
    # the last, partial pass takes a document if its middle lies before the target
    extra = F.when(start + F.col("size") / 2 <= rest, 1).otherwise(0)
    copies = F.when(F.col("size") > 0, F.least(full + extra, F.lit(MAX_EPOCHS))).otherwise(0).cast("int")
    return both.select("doc_id", F.col("d.source").alias("source"), "size", "source_size", "target", "place", "h",
                       start.cast("long").alias("start"), copies.alias("copies"), *(["row"] if keep_row else []))


def first_position(epoch: Column) -> Column:
    """Training position of a planned row's copy in the given pass over its source."""
    demand = epoch * F.col("source_size") + F.col("start") + F.col("size") / 2
    return position(demand / F.greatest(F.col("target"), F.lit(1.0)), F.col("place"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed stream: every column of ``docs``, a row per copy taken, range-sorted by position."""
    copies = F.transform(F.sequence(F.lit(0), F.col("copies") - 1), first_position)
    return (plan(docs, keep_row=True).filter("copies > 0")
            .select("row", "h", F.explode(copies).alias("at"))
            .orderBy("at", "h").select("row.*"))


def digest(docs: DataFrame) -> DataFrame:
    """Contract columns of the mixing query, sorted by each document's first position."""
    return (plan(docs).select("doc_id", "size", "source_size", "target",
                              (F.col("copies") * F.col("size")).cast("long").alias("taken"),
                              F.when(F.col("copies") > 0, first_position(F.lit(0))).alias("first_position"))
            .orderBy("first_position", "doc_id"))
