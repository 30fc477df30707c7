"""Configuration dimensions and candidate grids.

The grid is generated, not joined: each site row explodes into items, levels
and loadouts through generator expressions, after a repartition of the small
(site, item, level) base so the expansion and the scoring spread over tasks.
Every candidate carries ``ordinal``, a mixed-radix number that increases in
enumeration order, so ties always resolve to the earliest candidate.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import option_cost, slot_cost
from ..session import shuffle_partitions
from ..spec import SearchSpace


def valid_configs(configs: DataFrame, space: SearchSpace, exact: bool = False) -> DataFrame:
    """Keep configurations within the slot limit (exactly at it when ``exact``)."""
    cost = slot_cost(space, dict(configs.dtypes))
    return configs.where(cost == space.slot_limit if exact else cost <= space.slot_limit)


def quarantine_configs(configs: DataFrame, space: SearchSpace) -> DataFrame:
    """B17 reject branch: over-limit configurations with a reason."""
    cost = slot_cost(space, dict(configs.dtypes))
    return (configs.where(cost > space.slot_limit)
                   .withColumn("reason", F.concat(F.lit("slots used: "), cost.cast("string"))))


def site_lookup(records: DataFrame, sites: DataFrame, site_col: str = "site") -> DataFrame:
    """Attach site type / area / group by site name (left join to the site dimension).

    The dimension is small per site catalogue; Spark broadcasts it only while its
    size estimate is under the broadcast threshold.
    """
    return records.join(sites, site_col, "left")


def top_sites_per_group(sites: DataFrame, n: int = 5) -> DataFrame:
    """at most ``n`` largest sites per group, with a site ordinal (group, area desc, name)."""
    w = Window.partitionBy("site_group").orderBy(F.col("area").desc(), F.col("site").asc())
    ranked = sites.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    # the catalogue is a dimension: ordering it in one window is bounded by its size
    order = Window.orderBy("site_group", "_r")
    return ranked.withColumn("site_ord", (F.row_number().over(order) - 1).cast("long")).drop("_r")


def reduced_sites(sites: DataFrame) -> DataFrame:
    """Only (type, area) enter the score: keep the earliest site of each pair."""
    firsts = sites.groupBy("site_type", "area").agg(
        F.min_by(F.struct("site", "site_group"), F.col("site_ord")).alias("_s"),
        F.min("site_ord").alias("site_ord"))
    return firsts.select("site_type", "area", "site_ord",
                         F.col("_s.site").alias("site"), F.col("_s.site_group").alias("site_group"))


def _option_structs(space: SearchSpace) -> Column:
    return F.array(*[F.struct(F.lit(o).alias("opt"), F.lit(i).alias("opt_idx"),
                              F.lit(o in space.popular_options).alias("popular"))
                     for i, o in enumerate(space.options)])


def _mask_msb(mask: Column, k: int) -> Column:
    """Mask with flag 0 as the most significant bit (lexicographic combination order)."""
    out = F.lit(0)
    for j in range(k):
        out = out + F.when(F.shiftright(mask, j) % 2 == 1, F.lit(1 << (k - 1 - j))).otherwise(F.lit(0))
    return out


def loadout_columns(df: DataFrame, space: SearchSpace) -> DataFrame:
    """Explode options x count 0..3 x flag masks on every row; keep cost == limit (D3)."""
    k = len(space.slot_flags)
    x = df.select("*", F.inline(_option_structs(space)))
    x = x.select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias(space.count_field))
    x = x.select("*", F.explode(F.sequence(F.lit(0), F.lit((1 << k) - 1))).alias("_mask"))
    cost = option_cost("opt", space) + F.col(space.count_field) + F.bit_count("_mask")
    x = x.where(cost == space.slot_limit)
    flags = {f: F.when(F.shiftright("_mask", j) % 2 == 1, F.lit("Yes")).otherwise(F.lit("No"))
             for j, f in enumerate(space.slot_flags)}
    # F5 order: popular options first, larger count first, then enumeration order
    key = ((((1 - F.col("popular").cast("int")) * 4 + (3 - F.col(space.count_field))) * len(space.options)
            + F.col("opt_idx")) * (1 << k) + ((1 << k) - 1 - _mask_msb(F.col("_mask"), k)))
    x = x.withColumns(flags).withColumn("loadout_key", key.cast("long"))
    if space.option_field != "opt":
        x = x.withColumnRenamed("opt", space.option_field)
    return x.drop("_mask", "popular", "opt_idx")


def loadout_radix(space: SearchSpace) -> int:
    return 2 * 4 * len(space.options) * (1 << len(space.slot_flags))


def loadouts(spark: SparkSession, space: SearchSpace) -> DataFrame:
    """D3 + F5: all loadouts with cost exactly at the limit, in priority order."""
    lo = loadout_columns(spark.range(1).drop("id"), space)
    # bounded: options x 4 x 2^flags rows
    return lo.withColumn("loadout_ord", (F.row_number().over(Window.orderBy("loadout_key")) - 1).cast("long"))


def _explode_values(df: DataFrame, name: str, values: Sequence, idx_name: str) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(v).alias(name), F.lit(i).alias(idx_name)) for i, v in enumerate(values)])
    return df.select("*", F.inline(arr))


def candidate_grid(sites: DataFrame, space: SearchSpace, variant: str = "A",
                   partitions: int | None = None, code_values: dict | None = None) -> DataFrame:
    """Item x site (type, area) x level x free flags/codes x loadout (x post-hoc values).

    ``sites`` must carry site_type, area, site_ord, site_group (see ``reduced_sites``).
    ``code_values`` maps each free code to its (positive, negative) texts; the
    positive text is enumerated first.
    """
    spark = sites.sparkSession
    n_sites = sites.agg(F.max("site_ord") + 1).scalar()  # radix of the site place
    base = sites.select("site_type", "area", "site_ord", "site_group", "site")
    base = _explode_values(base, space.item_field, space.items, "_item_idx")
    base = _explode_values(base, space.level_field, [float(v) for v in space.levels], "_level_idx")
    ordinal = (F.col("_item_idx") * n_sites + F.col("site_ord")) * len(space.levels) + F.col("_level_idx")
    for f in space.free_flags:
        base = _explode_values(base, f, ["Yes", "No"], f"_{f}_idx")
        ordinal = ordinal * 2 + F.col(f"_{f}_idx")
    for c in space.free_codes:
        pos, neg = (code_values or {}).get(c, ("1", "0"))
        base = _explode_values(base, c, [pos, neg], f"_{c}_idx")
        ordinal = ordinal * 2 + F.col(f"_{c}_idx")
    base = base.withColumn("ordinal", ordinal.cast("long"))
    base = base.repartition(partitions or shuffle_partitions(spark))
    grid = loadout_columns(base, space)
    grid = grid.withColumn("ordinal", F.col("ordinal") * loadout_radix(space) + F.col("loadout_key"))
    if variant == "A" and space.posthoc_own:
        grid = _explode_values(grid, "own_amt", [float(v) for v in space.posthoc_own], "_own_idx")
        grid = _explode_values(grid, "other_amt", [float(v) for v in space.posthoc_other], "_other_idx")
        grid = grid.withColumn("ordinal", (F.col("ordinal") * len(space.posthoc_own) + F.col("_own_idx"))
                               * len(space.posthoc_other) + F.col("_other_idx"))
    return grid.drop(*[c for c in grid.columns if c.startswith("_")], "loadout_key")


def candidate_budget(sites: DataFrame, space: SearchSpace, variant: str = "A",
                     per_option: int | None = None, areas_per_type: dict | None = None,
                     code_values: dict | None = None) -> DataFrame:
    """the top-configuration grid: level and post-hoc values fixed; optionally only
    the ``areas_per_type`` largest areas of each site type and the first ``per_option``
    loadouts of each option (priority order).  Both caps are off by default
    (``None``): scoring the whole grid is cheap on Spark.
    """
    s = sites
    if areas_per_type:
        w = Window.partitionBy("site_type").orderBy(F.col("area").desc())
        s = s.withColumn("_ar", F.dense_rank().over(w))
        cond = None
        for t, k in areas_per_type.items():
            c = (F.col("site_type") == t) & (F.col("_ar") <= k)
            cond = c if cond is None else cond | c
        s = s.where(cond).drop("_ar")
    one_level = SearchSpace(**{**space.__dict__, "levels": (space.top_level,),
                               "posthoc_own": (space.top_posthoc[0],),
                               "posthoc_other": (space.top_posthoc[1],)})
    grid = candidate_grid(s, one_level, variant, code_values=code_values)
    if per_option is not None:
        w = Window.partitionBy(space.option_field).orderBy("loadout_ord")
        lo = loadouts(sites.sparkSession, space).withColumn("_lr", F.row_number().over(w))
        lo = lo.where(F.col("_lr") <= per_option)
        keys = [space.option_field, space.count_field, *space.slot_flags]
        grid = grid.join(F.broadcast(lo.select(*keys)), keys, "left_semi")  # <= 71-row dimension
    return grid


def config_fields(space: SearchSpace, variant: str = "A") -> list[str]:
    f = [space.item_field, "site_type", "area", space.level_field, *space.free_flags, *space.free_codes,
         space.option_field, space.count_field, *space.slot_flags]
    if variant == "A" and space.posthoc_own:
        f += ["own_amt", "other_amt"]
    return f



def spec_code_values(spec) -> dict:
    """(positive, negative) texts of the spec's two-valued code fields."""
    return {f.name: (f.positive, f.negative) for f in spec.fields if f.positive is not None}
