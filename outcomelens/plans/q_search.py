"""Configuration dimensions, grid search and selection queries (B16, B17, D1-D7, E4-E6,
F4-F6, H9, H10) with the fixed-weight scorer."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import slot_cost
from ..operators import configs as C
from ..operators import search as Q
from ..operators.scoring import score_batch
from ..sources.fixtures import fact_records, site_dim, table
from ..spec import FIXTURE_SPEC as S
from .catalog import register
from .fixture_model import fixture_scorer, stored_facts, sql_cost, sql_logit, sql_scaler_cte, sql_terms, sql_weights
from .oracle import FACT, SITES

SP = S.search
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "own_key"]
KEY_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey, own_amt AS own_key"
KEY_COLS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, own_key"
FLAGS = list(SP.slot_flags)
FIELDS_B = C.config_fields(SP, "B")          # item, site_type, area, level, opt, extra, flags
FIELDS_B_SQL = ", ".join(FIELDS_B)


def _fact(spark, sf):
    return fact_records(spark, sf).withColumn("own_key", F.col("own_amt"))


def _sites(spark, sf):
    return C.reduced_sites(C.top_sites_per_group(site_dim(spark, sf), 5))


# ------------------------------------------------------------------ SQL building blocks
def _values(rows, names):
    def lit(v):
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        if isinstance(v, float):
            return f"{v!r}::DOUBLE"
        return str(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) t({', '.join(names)}))"


def _msb(mask="mask", k=4):
    return " + ".join(f"((({mask} >> {j}) & 1) * {1 << (k - 1 - j)})" for j in range(k))


def _grid_ctes(levels=None, areas_per_type=None, per_option=None) -> str:
    levels = levels if levels is not None else [float(v) for v in SP.levels]
    nopt = len(SP.options)
    opt_cost = (f"(CASE WHEN opt = 'None' THEN 0 WHEN opt = '{SP.double_cost_option}' THEN 2 ELSE 1 END)")
    flags = ", ".join(f"CASE WHEN (mask >> {j}) & 1 = 1 THEN 'Yes' ELSE 'No' END AS {f}"
                      for j, f in enumerate(FLAGS))
    red_filter = ""
    if areas_per_type:
        conds = " OR ".join(f"(site_type = '{t}' AND ar <= {k})" for t, k in areas_per_type.items())
        red_filter = f", redf AS (SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY site_type ORDER BY area DESC) AS ar FROM red0) WHERE {conds})"
    lo_filter = ""
    if per_option:
        lo_filter = f" QUALIFY row_number() OVER (PARTITION BY opt ORDER BY loadout_key) <= {per_option}"
    return f"""{SITES},
sr AS (SELECT *, row_number() OVER (PARTITION BY site_group ORDER BY area DESC, site) AS rr FROM sites),
top5 AS (SELECT site, site_group, site_type, area, row_number() OVER (ORDER BY site_group, rr) - 1 AS site_ord
         FROM sr WHERE rr <= 5),
red0 AS (SELECT site_type, area, min(site_ord) AS site_ord, arg_min(site, site_ord) AS site,
           arg_min(site_group, site_ord) AS site_group FROM top5 GROUP BY 1, 2){red_filter},
red AS (SELECT site_type, area, site_ord, site, site_group FROM {'redf' if areas_per_type else 'red0'}),
items AS {_values([(v, i) for i, v in enumerate(SP.items)], ['item', 'item_idx'])},
levels AS {_values([(float(v), i) for i, v in enumerate(levels)], ['level', 'level_idx'])},
opts AS {_values([(o, i, o in SP.popular_options) for i, o in enumerate(SP.options)], ['opt', 'opt_idx', 'popular'])},
ex AS (SELECT CAST(unnest(range(0, 4)) AS INTEGER) AS extra),
mk AS (SELECT CAST(unnest(range(0, {1 << len(FLAGS)})) AS INTEGER) AS mask),
lo AS (SELECT opt, extra, {flags},
         CAST((((1 - CAST(popular AS INTEGER)) * 4 + (3 - extra)) * {nopt} + opt_idx) * {1 << len(FLAGS)}
              + ({(1 << len(FLAGS)) - 1} - ({_msb()})) AS BIGINT) AS loadout_key
       FROM opts, ex, mk WHERE {opt_cost} + extra + bit_count(mask) = {SP.slot_limit}{lo_filter}),
grid AS (SELECT item, red.site_type, red.area, level, opt, extra, {', '.join(FLAGS)}, site_group, site,
           ((CAST(item_idx AS BIGINT) * (SELECT max(site_ord) + 1 FROM red) + site_ord) * {len(levels)} + level_idx) * {C.loadout_radix(SP)}
             + loadout_key AS ordinal
         FROM red, items, levels, lo)"""


def _scored_grid_sql(grid_ctes: str) -> str:
    return f"""WITH {FACT}, {sql_scaler_cte('B')}, {grid_ctes},
sg AS (SELECT grid.*, 1.0::DOUBLE / (1.0::DOUBLE + exp(-({sql_logit('B')}))) AS p FROM grid, st)"""


def _scored_grid(spark, sf, grid=None):
    sc = fixture_scorer(spark, sf, "B")
    grid = grid if grid is not None else C.candidate_grid(_sites(spark, sf), SP, "B")
    return sc, score_batch(grid, sc, [*FIELDS_B, "site_group", "site", "ordinal"], check_cost=False)


# ------------------------------------------------------------------ dimensions
@register("site_lookup", f"""WITH {SITES}
SELECT c_custkey, n_name AS site, sites.site_group, sites.site_type, sites.area
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN sites ON n_name = sites.site""")
def q_site_lookup(spark, sf):
    c = table(spark, sf, "customer")
    n = table(spark, sf, "nation")
    rec = c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", F.col("n_name").alias("site"))
    return C.site_lookup(rec, site_dim(spark, sf)).select("c_custkey", "site", "site_group", "site_type", "area")


@register("top_sites_per_group", f"""WITH {_grid_ctes()}
SELECT site, site_group, site_type, area, site_ord FROM top5""")
def q_top_sites_per_group(spark, sf):
    return C.top_sites_per_group(site_dim(spark, sf), 5).select("site", "site_group", "site_type", "area", "site_ord")


@register("slot_cost", f"""WITH {FACT}
SELECT {KEY_SQL}, CAST({sql_cost()} AS INTEGER) AS cost FROM fact""")
def q_slot_cost(spark, sf):
    return _fact(spark, sf).select(*KEY, slot_cost(SP).alias("cost"))


@register("valid_configs", f"""WITH {FACT}
SELECT {KEY_SQL}, opt, extra, {', '.join(FLAGS)} FROM fact WHERE {sql_cost()} <= 4""")
def q_valid_configs(spark, sf):
    return C.valid_configs(_fact(spark, sf), SP).select(*KEY, "opt", "extra", *FLAGS)


@register("loadouts", f"""WITH {FACT}, {_grid_ctes()},
lod AS (SELECT *, row_number() OVER (ORDER BY loadout_key) - 1 AS loadout_ord FROM lo),
used AS (SELECT opt, extra, {', '.join(FLAGS)}, count(*) AS n FROM fact GROUP BY ALL)
SELECT lod.opt, lod.extra, {', '.join('lod.' + f for f in FLAGS)}, loadout_ord, coalesce(used.n, 0) AS n
FROM lod LEFT JOIN used ON lod.opt = used.opt AND lod.extra = used.extra AND
  {' AND '.join(f'lod.{f} = used.{f}' for f in FLAGS)}""")
def q_loadouts(spark, sf):
    """D3 + F5: loadout dimension with how many records use each loadout."""
    lo = C.loadouts(spark, SP)
    keys = ["opt", "extra", *FLAGS]
    used = _fact(spark, sf).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return (lo.join(used, keys, "left")
              .select(*keys, "loadout_ord", F.coalesce("n", F.lit(0)).alias("n")))


@register("candidate_grid", f"""WITH {_grid_ctes()}
SELECT {FIELDS_B_SQL}, site_group, site, ordinal FROM grid""")
def q_candidate_grid(spark, sf):
    return C.candidate_grid(_sites(spark, sf), SP, "B").select(*FIELDS_B, "site_group", "site", "ordinal")


_BUDGET = dict(levels=[SP.top_level], areas_per_type={"F": 3, "O": 5}, per_option=10)


def _budget_grid(spark, sf):
    return C.candidate_budget(_sites(spark, sf), SP, "B", per_option=10, areas_per_type={"F": 3, "O": 5})


@register("candidate_budget", f"""WITH {_grid_ctes(**_BUDGET)}
SELECT {FIELDS_B_SQL}, site_group, site, ordinal FROM grid""")
def q_candidate_budget(spark, sf):
    return _budget_grid(spark, sf).select(*FIELDS_B, "site_group", "site", "ordinal")


# ------------------------------------------------------------------ selection over scored grid
_SG = _scored_grid_sql(_grid_ctes())


@register("best_per_group", _SG + f""",
r AS (SELECT *, row_number() OVER (PARTITION BY opt ORDER BY p DESC, ordinal) AS rn FROM sg)
SELECT {FIELDS_B_SQL}, round(p, 6) AS probability, ordinal FROM r WHERE rn = 1""")
def q_best_per_group(spark, sf):
    _, s = _scored_grid(spark, sf)
    b = Q.best_per_group(s, ["opt"], FIELDS_B)
    return b.select(*FIELDS_B, F.round("probability", 6).alias("probability"), "ordinal")


FIELDS_A = C.config_fields(SP, "A")
_SG_A = f"""WITH {FACT}, {sql_scaler_cte('A')}, {_grid_ctes()},
own AS {_values([(float(v), i) for i, v in enumerate(SP.posthoc_own)], ['own_amt', 'own_idx'])},
other AS {_values([(float(v), i) for i, v in enumerate(SP.posthoc_other)], ['other_amt', 'other_idx'])},
grid_a AS (SELECT * REPLACE ((ordinal * {len(SP.posthoc_own)} + own_idx) * {len(SP.posthoc_other)} + other_idx AS ordinal)
           FROM grid, own, other),
sg AS (SELECT grid_a.*, 1.0::DOUBLE / (1.0::DOUBLE + exp(-({sql_logit('A')}))) AS p FROM grid_a, st)"""


@register("best_with_posthoc", _SG_A + f""",
r AS (SELECT *, row_number() OVER (PARTITION BY item, opt ORDER BY p DESC, ordinal) AS rn FROM sg)
SELECT {', '.join(FIELDS_A)}, round(p, 6) AS probability, ordinal FROM r WHERE rn = 1""")
def q_best_with_posthoc(spark, sf):
    """D2 + E4 for variant A: the whole grid with every pair of post-hoc values, best per item and option."""
    sc = fixture_scorer(spark, sf, "A")
    s = score_batch(C.candidate_grid(_sites(spark, sf), SP, "A"), sc, [*FIELDS_A, "ordinal"], check_cost=False)
    b = Q.best_per_group(s, ["item", "opt"], FIELDS_A)
    return b.select(*FIELDS_A, F.round("probability", 6).alias("probability"), "ordinal")


_DKEY = ["item", "opt", "extra", *FLAGS]


@register("dedupe_configs", _SG + f""",
r AS (SELECT *, row_number() OVER (PARTITION BY {', '.join(_DKEY)} ORDER BY p DESC, ordinal) AS rn FROM sg)
SELECT {FIELDS_B_SQL}, round(p, 6) AS probability, ordinal FROM r WHERE rn = 1""")
def q_dedupe_configs(spark, sf):
    _, s = _scored_grid(spark, sf)
    d = Q.dedupe_configs(s, _DKEY, FIELDS_B)
    return d.select(*FIELDS_B, F.round("probability", 6).alias("probability"), "ordinal")


_WIN = """,
early AS (SELECT * FROM sg WHERE p >= 0.95 ORDER BY ordinal LIMIT 1),
best AS (SELECT * FROM sg ORDER BY p DESC, ordinal LIMIT 1),
win AS (SELECT *, true AS found_early FROM early
        UNION ALL SELECT *, false FROM best WHERE NOT EXISTS (SELECT 1 FROM early))"""


@register("first_over_threshold", _SG + _WIN + f"""
SELECT {FIELDS_B_SQL}, site_group, round(p, 6) AS probability, ordinal, found_early FROM win""")
def q_first_over_threshold(spark, sf):
    _, s = _scored_grid(spark, sf)
    w = Q.first_over_threshold(s, [*FIELDS_B, "site_group"], 0.95)
    return w.select(*FIELDS_B, "site_group", F.round("probability", 6).alias("probability"), "ordinal", "found_early")


@register("overlay", _SG + _WIN + f"""
SELECT {KEY_COLS}, {', '.join(f'win.{f} AS {f}' for f in FIELDS_B)}, fact_k.level AS base_level
FROM (SELECT {KEY_SQL}, level FROM fact) fact_k, win""")
def q_overlay(spark, sf):
    _, s = _scored_grid(spark, sf)
    w = Q.first_over_threshold(s, [*FIELDS_B, "site_group"], 0.95)
    base = _fact(spark, sf).select(*KEY, *FIELDS_B, F.col("level").alias("base_level"))
    return Q.overlay(base, w, FIELDS_B).select(*KEY, *FIELDS_B, "base_level")


def _cur_sql():
    cost = sql_cost()
    return f"""cur AS (SELECT {KEY_SQL}, {FIELDS_B_SQL},
  CASE WHEN {cost} > 4 THEN NULL ELSE 1.0::DOUBLE / (1.0::DOUBLE + exp(-({sql_logit('B')}))) END AS p
  FROM fact, st)"""


_OPT = _SG + _WIN + f""",
{_cur_sql()},
j AS (SELECT cur.*, win.p AS cand_p, win.found_early,
        cur.p IS NULL OR (cur.p < 0.95 AND (win.found_early OR win.p > cur.p)) AS take,
        {', '.join(f'win.{f} AS best_{f}' for f in [*FIELDS_B, 'site_group'])} FROM cur, win),
res AS (SELECT {KEY_COLS}, {', '.join(f'CASE WHEN take THEN best_{f} ELSE {f} END AS {f}' for f in FIELDS_B)},
          CASE WHEN take THEN best_site_group END AS site_group,
          (CASE WHEN take THEN cand_p ELSE p END) * 100.0::DOUBLE AS best_chance, p * 100.0::DOUBLE AS current_chance,
          p IS NOT NULL AS valid
        FROM j)"""


@register("optimize_configs", _OPT + f"""
SELECT {KEY_COLS}, {FIELDS_B_SQL}, site_group, round(best_chance, 4) AS best_chance,
  round(current_chance, 4) AS current_chance,
  round(greatest(coalesce(best_chance - current_chance, 0.0), 0.0), 4) AS improvement, valid FROM res""")
def q_optimize_configs(spark, sf):
    sc = fixture_scorer(spark, sf, "B")
    base = _fact(spark, sf).select(*KEY, *FIELDS_B)
    o = Q.optimize_configs(base, _sites(spark, sf), sc, KEY)
    return o.select(*KEY, *FIELDS_B, "site_group", *[F.round(c, 4).alias(c) for c in
                                                     ("best_chance", "current_chance", "improvement")], "valid")


_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "own_key"]
_PAIRED = f"""WITH {FACT}, {sql_scaler_cte('B')}, {_cur_sql()},
l AS (SELECT {KEY_COLS}, p * 100.0::DOUBLE AS chance, lag(p * 100.0::DOUBLE) OVER (PARTITION BY l_orderkey
        ORDER BY {", ".join(_LINE_ORDER)}) AS before FROM cur)"""


def _paired(spark, sf):
    """Every record's chance beside that of the record before it in its order (an order is a few lines)."""
    s = score_batch(_fact(spark, sf), fixture_scorer(spark, sf, "B"), KEY)
    return s.withColumn("before", F.lag("chance").over(Window.partitionBy("l_orderkey").orderBy(*_LINE_ORDER)))


@register("improvement", _PAIRED + f"""
SELECT {KEY_COLS}, round(before, 4) AS current_chance,
  round(CASE WHEN chance - before < 0 THEN before ELSE chance END, 4) AS best_chance,
  round(CASE WHEN before IS NULL OR chance IS NULL THEN NULL ELSE greatest(chance - before, 0.0) END, 4) AS improvement FROM l""")
def q_improvement(spark, sf):
    """Each record as a proposal against the record before it: gains, losses and missing chances."""
    d = Q.improvement(_paired(spark, sf).select(*KEY, F.col("before").alias("current_chance"), F.col("chance").alias("best_chance")))
    return d.select(*KEY, *[F.round(c, 4).alias(c) for c in ("current_chance", "best_chance", "improvement")])


@register("compare_configs", _PAIRED + f"""
SELECT {KEY_COLS}, round(before, 4) AS left_chance, round(chance, 4) AS right_chance, round(chance - before, 4) AS delta FROM l""")
def q_compare_configs(spark, sf):
    """Every record against the one before it in its order."""
    c = Q.compare_columns(_paired(spark, sf), "before", "chance")
    return c.select(*KEY, *[F.round(x, 4).alias(x) for x in ("left_chance", "right_chance", "delta")])


_TOPK = _scored_grid_sql(_grid_ctes(levels=[SP.top_level])) + f""",
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(_DKEY)} ORDER BY p DESC, ordinal) AS dn
      FROM sg) WHERE dn = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY opt ORDER BY p DESC, ordinal) AS gr FROM d),
t AS (SELECT *, CASE WHEN gr = 1 THEN 1 WHEN gr <= 2 AND p * 100.0::DOUBLE >= 35.0 THEN 2 ELSE 3 END AS tier FROM r),
top AS (SELECT * FROM t ORDER BY tier, p DESC, ordinal LIMIT 5)
SELECT {FIELDS_B_SQL}, round(p * 100.0::DOUBLE, 4) AS chance, p >= 0.5 AS positive,
  row_number() OVER (ORDER BY p DESC, ordinal) AS pick_rank FROM top"""


@register("diverse_top_k", _TOPK)
def q_diverse_top_k(spark, sf):
    _, s = _scored_grid(spark, sf, C.candidate_budget(_sites(spark, sf), SP, "B"))
    t = Q.diverse_top_k(s, FIELDS_B, _DKEY, "opt", 5)
    return t.select(*FIELDS_B, F.round("chance", 4).alias("chance"), (F.col("probability") >= 0.5).alias("positive"),
                    "pick_rank")


@register("top_configs", _TOPK)
def q_top_configs(spark, sf):
    sc = fixture_scorer(spark, sf, "B")
    t = Q.top_configs(C.candidate_budget(_sites(spark, sf), SP, "B"), sc, 5)
    return t.select(*FIELDS_B, F.round("chance", 4).alias("chance"), "positive", "pick_rank")


# ------------------------------------------------------------------ baselines with fields of their own
_OPEN = replace(SP, posthoc_own=(), posthoc_other=())
OPEN_FIELDS = [f for f in FIELDS_A if f not in ("own_amt", "other_amt")]


def _parts_sql():
    """The variant A logit in the grid's part and the baseline's, rounded like the library's."""
    w, b = sql_weights("A")
    inside, outside = "0.0::DOUBLE", f"{b!r}::DOUBLE"
    for i, (name, e) in enumerate(sql_terms("A")):
        z = f"(({e}) - st.m{i}) / (CASE WHEN st.s{i} = 0 THEN 1.0::DOUBLE ELSE st.s{i} END)"
        if name.split("__")[0] in OPEN_FIELDS:
            inside = f"({inside} + {w[i]!r}::DOUBLE * {z})"
        else:
            outside = f"({outside} + {w[i]!r}::DOUBLE * {z})"
    return f"round({inside}, 9)", f"round({outside}, 9)"


_INSIDE, _OUTSIDE = _parts_sql()
_LIMIT = f"{math.log(0.95 / (1.0 - 0.95))!r}::DOUBLE"


@register("optimize_own_fields", f"""WITH {FACT}, {sql_scaler_cte('A')}, {_grid_ctes()},
g AS (SELECT grid.*, {_INSIDE} AS score FROM grid, st),
b AS (SELECT {KEY_SQL}, {', '.join(OPEN_FIELDS)}, own_amt, other_amt, {_OUTSIDE} AS part, row_number() OVER () AS n,
  CASE WHEN {sql_cost()} > 4 THEN NULL ELSE 1.0::DOUBLE / (1.0::DOUBLE + exp(-({sql_logit('A')}))) END AS p FROM fact, st),
-- every baseline with every candidate
full_product AS (SELECT b.n, min(g.ordinal) FILTER (g.score + b.part >= {_LIMIT}) AS early, max(g.score + b.part) AS most FROM b, g GROUP BY b.n),
tops AS (SELECT max(score) AS top FROM g),
last AS (SELECT min(ordinal) AS late FROM g, tops WHERE score = top),
j AS (SELECT b.*, f.early IS NOT NULL AS found, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(g.score + b.part))) AS cand_p, f.most,
  {', '.join(f'g.{f} AS best_{f}' for f in [*OPEN_FIELDS, 'site_group'])}
  FROM b JOIN full_product f ON b.n = f.n CROSS JOIN last JOIN g ON g.ordinal = coalesce(f.early, last.late)),
t AS (SELECT *, p IS NULL OR (p < 0.95 AND (found OR cand_p > p)) AS take FROM j),
res AS (SELECT {KEY_COLS}, {', '.join(f'CASE WHEN take THEN best_{f} ELSE {f} END AS {f}' for f in OPEN_FIELDS)}, own_amt, other_amt,
  CASE WHEN take THEN best_site_group END AS site_group, (CASE WHEN take THEN cand_p ELSE p END) * 100.0::DOUBLE AS best_chance,
  p * 100.0::DOUBLE AS current_chance, p IS NOT NULL AS valid, found OR abs(most - (SELECT top FROM tops) - part) < 1e-6 AS agrees FROM t)
SELECT {KEY_COLS}, {', '.join(OPEN_FIELDS)}, own_amt, other_amt, site_group, round(best_chance, 4) AS best_chance, round(current_chance, 4) AS current_chance,
  round(greatest(coalesce(best_chance - current_chance, 0.0), 0.0), 4) AS improvement, valid FROM res WHERE agrees""")
def q_optimize_own_fields(spark, sf):
    """H9 for baselines that keep their own post-hoc values: the grid leaves two fields to each."""
    f = stored_facts(spark, sf).withColumn("own_key", F.col("own_amt"))
    sc = fixture_scorer(spark, sf, "A", f)
    sc = replace(sc, spec=replace(sc.spec, search=_OPEN))
    base = f.select(*KEY, *OPEN_FIELDS, "own_amt", "other_amt")
    o = Q.optimize_configs(base, _sites(spark, sf), sc, KEY)
    return o.select(*KEY, *OPEN_FIELDS, "own_amt", "other_amt", "site_group",
                    *[F.round(c, 4).alias(c) for c in ("best_chance", "current_chance", "improvement")], "valid")


_COUNTS = (1, 5, 12)


@register("top_configs_by_request", _scored_grid_sql(_grid_ctes(levels=[SP.top_level])) + f""",
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(_DKEY)} ORDER BY p DESC, ordinal) AS dn FROM sg) WHERE dn = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY opt ORDER BY p DESC, ordinal) AS gr FROM d),
ks AS (SELECT CAST(unnest({list(_COUNTS)}) AS INTEGER) AS k),
t AS (SELECT *, CASE WHEN gr = 1 THEN 1 WHEN gr <= greatest(2, k // 3) AND p * 100.0::DOUBLE >= 35.0 THEN 2 ELSE 3 END AS tier FROM r, ks),
n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY tier, p DESC, ordinal) AS rn FROM t),
picks AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p DESC, ordinal) AS pick_rank FROM n WHERE rn <= k)
SELECT c_custkey, k AS asked, {FIELDS_B_SQL}, round(p * 100.0::DOUBLE, 4) AS chance, p >= 0.5 AS positive, pick_rank
FROM customer JOIN picks ON k = {list(_COUNTS)}[c_custkey % 3 + 1]""")
def q_top_configs_by_request(spark, sf):
    """A request per customer for 1, 5 or 12 configurations, all answered from one scored grid."""
    sc = fixture_scorer(spark, sf, "B")
    asked = table(spark, sf, "customer").select("c_custkey", F.get(F.lit(list(_COUNTS)), (F.col("c_custkey") % 3).cast("int")).alias("asked"))
    t = Q.top_configs_for(asked, C.candidate_budget(_sites(spark, sf), SP, "B"), sc, "asked")
    return t.select("c_custkey", "asked", *FIELDS_B, F.round("chance", 4).alias("chance"), "positive", "pick_rank")
