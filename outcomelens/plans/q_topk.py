"""Sort / limit queries (F1, F2, F5) and the integer text key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import int_key
from ..operators import configs as C
from ..operators import reports as R
from ..operators.scoring import score_batch
from ..sources.fixtures import fact_records
from ..spec import FIXTURE_SPEC as S
from .catalog import register
from .fixture_model import fixture_scorer, sql_cost, sql_logit, sql_scaler_cte
from .oracle import FACT, union_long
from .q_search import _grid_ctes

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "own_key"]


@register("top_by_count", f"""WITH {FACT}, long AS ({union_long('fact', S.report_categoricals)})
SELECT feature, value, count(*) AS n FROM long GROUP BY 1, 2 ORDER BY n DESC, feature, value LIMIT 20""")
def q_top_by_count(spark, sf):
    """the 20 most frequent (feature, value) pairs; ties by feature, value."""
    c = R.value_counts(fact_records(spark, sf), S.report_categoricals).select("feature", "value", "n")
    return c.orderBy(F.col("n").desc(), "feature", "value").limit(20)


@register("top_by_score", f"""WITH {FACT}, {sql_scaler_cte('A')},
s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, own_amt AS own_key,
        1.0::DOUBLE / (1.0::DOUBLE + exp(-({sql_logit('A')}))) AS p FROM fact, st WHERE {sql_cost()} <= 4)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, own_key, round(p, 6) AS probability FROM s
ORDER BY p DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, own_key LIMIT 25""")
def q_top_by_score(spark, sf):
    """the 25 best-scoring valid records (distributed top-k, TakeOrderedAndProject)."""
    sc = fixture_scorer(spark, sf, "A")
    f = fact_records(spark, sf).withColumn("own_key", F.col("own_amt"))
    s = score_batch(f, sc, KEY).where("error IS NULL")
    top = s.orderBy(F.col("probability").desc(), *KEY).limit(25)
    return top.select(*KEY, F.round("probability", 6).alias("probability"))


@register("priority_order", f"""WITH {FACT}, {_grid_ctes()},
used AS (SELECT DISTINCT opt, extra, flag_a, flag_b, flag_c, flag_d FROM fact)
SELECT lo.opt, lo.extra, lo.flag_a, lo.flag_b, lo.flag_c, lo.flag_d,
  row_number() OVER (ORDER BY loadout_key) - 1 AS loadout_ord
FROM lo JOIN used ON lo.opt = used.opt AND lo.extra = used.extra AND lo.flag_a = used.flag_a
  AND lo.flag_b = used.flag_b AND lo.flag_c = used.flag_c AND lo.flag_d = used.flag_d""")
def q_priority_order(spark, sf):
    """loadouts seen in the records, in search priority order (popular option, count desc)."""
    keys = ["opt", "extra", "flag_a", "flag_b", "flag_c", "flag_d"]
    used = fact_records(spark, sf).select(*keys).distinct()
    lo = C.loadout_columns(spark.range(1).drop("id"), S.search).join(used, keys)
    # at most options x 4 x 2^flags rows: the ordering window is bounded
    from pyspark.sql.window import Window
    return lo.select(*keys, (F.row_number().over(Window.orderBy("loadout_key")) - 1).alias("loadout_ord"))


@register("int_key", f"""WITH {FACT}
SELECT CAST(CAST(trunc(other_amt / 1000) AS BIGINT) AS VARCHAR) AS key, count(*) AS n FROM fact GROUP BY 1""")
def q_int_key(spark, sf):
    """Numeric value -> truncated integer text key, as report keys are built."""
    f = fact_records(spark, sf)
    return f.groupBy(int_key(F.col("other_amt") / 1000).alias("key")).agg(F.count(F.lit(1)).alias("n"))
