"""Searching scored candidates.

All selections are aggregates (``max_by`` / ``min_by`` with partial
aggregation) rather than per-group windows over the candidate set, so a group
holding most candidates never lands in a single task.  Ties resolve by the
candidate ``ordinal`` (earliest wins).
"""

from __future__ import annotations

import math
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.encode import to_form
from .configs import candidate_grid, config_fields, spec_code_values
from .ordering import written
from .scoring import Scorer, partial_logit, score_batch


def _rank_key(score: str = "probability", ordinal: str = "ordinal"):
    """Larger is better: higher score, then earlier ordinal."""
    return F.struct(F.col(score), (-F.col(ordinal)).alias("_neg_ord"))


def best_per_group(scored: DataFrame, group: Sequence[str], fields: Sequence[str],
                   score: str = "probability") -> DataFrame:
    """Best scored row per group value (aggregate, skew-safe)."""
    best = F.max_by(F.struct(*fields, F.col(score).alias(score), "ordinal"), _rank_key(score))
    return scored.groupBy(*group).agg(best.alias("_b")).select(
        *[F.col(f"_b.{f}").alias(f) for f in fields if f not in group], *group,
        F.col(f"_b.{score}").alias(score), F.col("_b.ordinal").alias("ordinal"))


def dedupe_configs(scored: DataFrame, key: Sequence[str], fields: Sequence[str],
                   score: str = "probability") -> DataFrame:
    """One row per equal configuration on ``key`` (null-safe), keeping the best."""
    return best_per_group(scored, key, fields, score)


def first_over_threshold(scored: DataFrame, fields: Sequence[str], threshold: float = 0.95,
                         score: str = "probability") -> DataFrame:
    """The earliest candidate reaching ``threshold``, else the arg-max (earliest on ties).

    One global aggregate; result is one row (``found_early`` tells which rule chose).
    """
    cfg = F.struct(*fields, F.col(score).alias(score), "ordinal")
    early = F.min_by(cfg, F.when(F.col(score) >= threshold, F.col("ordinal")))
    best = F.max_by(cfg, _rank_key(score))
    r = scored.agg(early.alias("_e"), best.alias("_m"))
    r = r.select(F.coalesce("_e", "_m").alias("_w"), F.col("_e").isNotNull().alias("found_early"))
    return r.select(*[F.col(f"_w.{f}").alias(f) for f in fields], F.col(f"_w.{score}").alias(score),
                    F.col("_w.ordinal").alias("ordinal"), "found_early")


def overlay(baselines: DataFrame, winner: DataFrame, fields: Sequence[str], spec=None) -> DataFrame:
    """The (one-row) winner's fields override each baseline's; others stay.

    The winner enters as one scalar subquery returning a struct, not as a join.
    With ``spec``, typed baselines are first brought to form spelling.
    """
    if spec is not None:
        baselines = to_form(baselines, spec)
    present = [f for f in fields if f in winner.columns]
    w = winner.select(F.struct(*present).alias("w")).scalar()
    return baselines.withColumns({f: F.coalesce(w.getField(f), F.col(f)) if f in baselines.columns
                                  else w.getField(f) for f in present})


def improvement(df: DataFrame, current: str = "current_chance", best: str = "best_chance") -> DataFrame:
    """Best vs current chance per row; a negative delta keeps the current one, delta 0;
    without one of the chances there is no improvement to state (null)."""
    delta = F.col(best) - F.col(current)
    return df.withColumns({
        best: F.when(delta < 0, F.col(current)).otherwise(F.col(best)),
        "improvement": F.when(delta.isNotNull(), F.greatest(delta, F.lit(0.0))),
    })


def compare_columns(df: DataFrame, left: str, right: str) -> DataFrame:
    """D6 where both chances stand in one row: left_chance, right_chance, delta."""
    return df.withColumns({"left_chance": F.col(left), "right_chance": F.col(right)}).withColumn(
        "delta", F.col("right_chance") - F.col("left_chance"))


def compare_configs(scored: DataFrame, pairs: DataFrame, key: str = "config_id") -> DataFrame:
    """Chance of two configurations side by side (pairs: left_id, right_id)."""
    s = scored.select(key, "chance")
    a = s.select(F.col(key).alias("left_id"), F.col("chance").alias("left_chance"))
    b = s.select(F.col(key).alias("right_id"), F.col("chance").alias("right_chance"))
    return compare_columns(pairs.join(a, "left_id").join(b, "right_id"), "left_chance", "right_chance")


def optimize_configs(baselines: DataFrame, sites: DataFrame, scorer: Scorer,
                     key: str | Sequence[str] = "config_id", threshold: float = 0.95) -> DataFrame:
    """H9: for every baseline configuration, the best grid candidate (or itself).

    Where the grid sets every feature, candidate scores do not depend on the
    baseline: the grid is scored once and reduced by one aggregate (E6), then
    each baseline is compared with that winner (baseline counts as ordinal -1,
    so it wins ties and its own >= threshold stops the search).  ``valid`` tells
    whether the baseline itself keeps the slot limit.  Where the grid leaves fields to
    the baseline, see ``optimize_own_fields``.
    """
    keys = [key] if isinstance(key, str) else list(key)
    space = scorer.spec.search
    fields = config_fields(space, scorer.variant)
    if any(f.name not in fields for f in scorer.spec.features(scorer.variant)):
        return optimize_own_fields(baselines, sites, scorer, keys, threshold, fields)
    grid = candidate_grid(sites, space, scorer.variant, code_values=spec_code_values(scorer.spec))
    scored = score_batch(grid, scorer, [*fields, "site_group", "ordinal"], check_cost=False)
    win = first_over_threshold(scored, [*fields, "site_group"], threshold)
    baselines = to_form(baselines, scorer.spec)   # one spelling for baseline and winner fields
    cur = score_batch(baselines, scorer, [*keys, *[f for f in fields if f in baselines.columns]])
    w = win.select(F.struct("*").alias("w")).scalar()   # one row, evaluated once
    wrow = {f"best_{f}": w.getField(f) for f in [*fields, "site_group"]}
    cur = cur.withColumn("_cand_p", w.getField("probability")).withColumn("_early", w.getField("found_early"))
    take = (F.col("probability").isNull() |
            ((F.col("probability") < threshold) &
             (F.col("_early") | (F.col("_cand_p") > F.col("probability")))))
    out = cur.select(*keys, "probability", "_cand_p", take.alias("_take"), *[v.alias(k) for k, v in wrow.items()],
                     *[F.col(f).alias(f"cur_{f}") for f in fields if f in baselines.columns])
    chosen = []
    for f in fields:
        cur_f = F.col(f"cur_{f}") if f"cur_{f}" in out.columns else F.lit(None)
        chosen.append(F.when(F.col("_take"), F.col(f"best_{f}")).otherwise(cur_f).alias(f))
    best_p = F.when(F.col("_take"), F.col("_cand_p")).otherwise(F.col("probability"))
    res = out.select(*keys, *chosen,
                     F.when(F.col("_take"), F.col("best_site_group")).alias("site_group"),
                     (best_p * 100.0).alias("best_chance"),
                     (F.col("probability") * 100.0).alias("current_chance"),
                     F.col("probability").isNotNull().alias("valid"))
    return improvement(res).withColumn("improvement", F.coalesce("improvement", F.lit(0.0)))


def running_records(scored: DataFrame, score: str = "score", chunk: int = 1 << 16) -> DataFrame:
    """Candidates that beat all earlier ones, by ordinal.

    The first candidate to reach any given score is one of them, and so is the best.
    Chunks of ordinals run in tasks of their own; only the chunks' maxima (a row per
    65,536 candidates) meet in one window.
    """
    c = scored.withColumn("_chunk", F.floor(F.col("ordinal") / chunk))
    earlier = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    tops = c.groupBy("_chunk").agg(F.max(score).alias("_top")).select("_chunk", F.max("_top").over(earlier).alias("_before"))
    inside = Window.partitionBy("_chunk").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("_own", F.max(score).over(inside))
    best = F.greatest("_own", "_before")  # null only for the very first
    return c.join(tops, "_chunk").where(best.isNull() | (F.col(score) > best)).drop("_chunk", "_own", "_before")


def optimize_own_fields(baselines: DataFrame, sites: DataFrame, scorer: Scorer, keys: Sequence[str],
                        threshold: float, fields: Sequence[str]) -> DataFrame:
    """H9 where candidates keep the baseline's value in fields that the grid leaves open.

    A logistic score falls into the grid's part and the baseline's, so the order of
    candidates is the same for every baseline: the grid is scored once and cut down to
    its running records.  A baseline's winner is the first record that reaches the
    threshold less the baseline's part (found by binary search among the records),
    else the last one.  Scores that differ by less than 1e-9 are ties.  The records are
    bounded by the search space, whatever the number of baselines.
    """
    spec, space = scorer.spec, scorer.spec.search
    spark = baselines.sparkSession
    grid = candidate_grid(sites, space, scorer.variant, code_values=spec_code_values(spec))
    missing = [f.name for f in spec.features(scorer.variant) if f.name not in grid.columns]
    typed = grid.select("*", *[F.lit(None).cast("double").alias(f) for f in missing])
    inside, _ = partial_logit(scorer, dict(typed.dtypes), fields)
    scored = typed.select(*fields, "site_group", "ordinal", inside.alias("score"))
    records = written(running_records(scored), "records")
    best = Window.orderBy("ordinal")  # over the records only
    records = records.withColumn("_place", F.row_number().over(best) - 1)
    reached = [r["score"] for r in records.select("score", "_place").orderBy("_place").collect()]

    @F.pandas_udf("int")
    def first_at(wanted: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(reached, wanted.to_numpy(float), "left"), dtype="int32")

    limit = math.log(threshold / (1.0 - threshold))
    base = to_form(baselines, spec)
    _, outside = partial_logit(scorer, dict(base.dtypes), fields)
    present = [f for f in fields if f in base.columns]
    kept = [f for f in missing if f in base.columns and f not in keys]
    cur = score_batch(base.withColumn("_outside", outside), scorer, [*keys, *present, *kept, "_outside"])
    cur = cur.withColumn("_at", first_at(F.lit(limit) - F.col("_outside")))
    cur = cur.withColumn("_early", F.col("_at") < len(reached)).withColumn("_place", F.least(F.col("_at"), F.lit(len(reached) - 1)))
    win = records.select("_place", F.col("score").alias("_score"), *[F.col(f).alias(f"best_{f}") for f in [*fields, "site_group"]])
    cur = cur.join(win, "_place", "left").withColumn("_cand_p", 1.0 / (1.0 + F.exp(-(F.col("_score") + F.col("_outside")))))
    take = F.col("_cand_p").isNotNull() & (F.col("probability").isNull() | (
        (F.col("probability") < threshold) & (F.col("_early") | (F.col("_cand_p") > F.col("probability")))))
    cur = cur.withColumn("_take", take)
    chosen = [F.when(F.col("_take"), F.col(f"best_{f}")).otherwise(F.col(f) if f in present else F.lit(None)).alias(f) for f in fields]
    res = cur.select(*keys, *chosen, *kept, F.when(F.col("_take"), F.col("best_site_group")).alias("site_group"),
                     (F.when(F.col("_take"), F.col("_cand_p")).otherwise(F.col("probability")) * 100.0).alias("best_chance"),
                     (F.col("probability") * 100.0).alias("current_chance"), F.col("probability").isNotNull().alias("valid"))
    return improvement(res).withColumn("improvement", F.coalesce("improvement", F.lit(0.0)))


def diverse_top_k(scored: DataFrame, fields: Sequence[str], dedupe_key: Sequence[str],
                  group: str, k: int = 5, floor_chance: float = 35.0) -> DataFrame:
    """E5: diverse top-k equal to the three-pass greedy pick.

    1. D7 de-duplicate on ``dedupe_key`` (best kept) - bounded by the number of
       distinct keys (items x loadouts), whatever the grid size;
    2. tier 1 = best of each group; tier 2 = rank <= max(2, k // 3) in its group
       with chance >= floor; tier 3 = the rest;
    3. order by (tier, chance desc, ordinal), take k, re-sort by chance.
    """
    d = dedupe_configs(scored.withColumn("chance", F.col("probability") * 100.0),
                       dedupe_key, [*fields, "chance"], "probability")
    cap = max(2, k // 3)
    w = Window.partitionBy(group).orderBy(F.col("probability").desc(), F.col("ordinal").asc())
    d = d.withColumn("_r", F.row_number().over(w))
    tier = (F.when(F.col("_r") == 1, F.lit(1))
             .when((F.col("_r") <= cap) & (F.col("chance") >= floor_chance), F.lit(2))
             .otherwise(F.lit(3)))
    top = d.withColumn("tier", tier).orderBy("tier", F.col("probability").desc(), "ordinal").limit(k)
    pick = Window.orderBy(F.col("probability").desc(), F.col("ordinal").asc())
    # at most k rows here: the unpartitioned window is bounded by k
    return top.withColumn("pick_rank", F.row_number().over(pick)).drop("_r", "tier")


def top_configs(grid: DataFrame, scorer: Scorer, k: int = 5) -> DataFrame:
    """Score the top-configuration grid and pick a diverse top-k."""
    space = scorer.spec.search
    fields = config_fields(space, scorer.variant)
    scored = score_batch(grid, scorer, [*fields, "ordinal"], check_cost=False)
    key = [space.item_field, space.option_field, space.count_field, *space.slot_flags]
    out = diverse_top_k(scored, fields, key, space.option_field, k)
    return out.withColumn("positive", F.col("probability") >= 0.5)


MOST_PICKS = 1000  # of one request


def picks_by_count(scored: DataFrame, fields: Sequence[str], dedupe_key: Sequence[str], group: str,
                   counts: Sequence[int], floor_chance: float = 35.0) -> DataFrame:
    """E5 for several k at once: (k, pick_rank, fields, probability, chance, ordinal).

    The share of a group, max(2, k // 3), depends on k, so each k has tiers of its own;
    but all picks come from a small pool: the first of each group up to the largest
    share, and the best overall as far as the largest k and the pool's groups reach.
    """
    most = max(counts)
    d = dedupe_configs(scored.withColumn("chance", F.col("probability") * 100.0), dedupe_key, [*fields, "chance"], "probability")
    d = written(d, "distinct-configs")
    order = [F.col("probability").desc(), F.col("ordinal").asc()]
    cap = max(2, most // 3)
    ranked = d.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    heads = written(ranked.where(F.col("_r") <= cap), "group-heads")  # a group's share at most
    rest = ranked.where(F.col("_r") > cap).orderBy(*order).limit(most)
    pool = heads.unionByName(rest).withColumn("k", F.explode(F.lit(sorted(set(counts)))))
    share = F.greatest(F.lit(2), F.floor(F.col("k") / 3))
    tier = (F.when(F.col("_r") == 1, F.lit(1)).when((F.col("_r") <= share) & (F.col("chance") >= floor_chance), F.lit(2)).otherwise(F.lit(3)))
    first = F.row_number().over(Window.partitionBy("k").orderBy(tier, *order))
    top = pool.withColumn("_n", first).where(F.col("_n") <= F.col("k"))
    pick = F.row_number().over(Window.partitionBy("k").orderBy(*order))
    return top.withColumn("pick_rank", pick).drop("_r", "_n")


def top_configs_for(requests: DataFrame, grid: DataFrame, scorer: Scorer, count: str = "count", default: int = 5) -> DataFrame:
    """H10 for many requests, each with its own ``count``: every column of the request with each of its picks.

    The grid is scored once, picks are made once per distinct count and joined to the
    requests.  A missing count is ``default``, one under 1 gives no rows, one over
    ``MOST_PICKS`` an error.
    """
    space = scorer.spec.search
    fields = config_fields(space, scorer.variant)
    asked = requests.withColumn("_k", F.coalesce(F.col(count).cast("int"), F.lit(default)))
    counts = [r["_k"] for r in asked.where("_k >= 1").select("_k").distinct().limit(MOST_PICKS + 1).collect()]
    if any(k > MOST_PICKS for k in counts) or len(counts) > MOST_PICKS:
        raise ValueError(f"a request may ask for {MOST_PICKS} configurations at most")
    scored = score_batch(grid, scorer, [*fields, "ordinal"], check_cost=False)
    key = [space.item_field, space.option_field, space.count_field, *space.slot_flags]
    picks = picks_by_count(scored, fields, key, space.option_field, counts or [default])
    picks = picks.withColumn("positive", F.col("probability") >= 0.5).withColumnRenamed("k", "_k")
    clash = [c for c in picks.columns if c != "_k" and c in requests.columns]
    if clash:
        raise ValueError(f"requests have columns of the picks: {clash}")
    return asked.join(picks, "_k").drop("_k")
