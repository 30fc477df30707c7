"""Report queries (C1-C12, G1, B19) over the record view."""

from __future__ import annotations

from ..operators import reports as R
from ..sources.fixtures import fact_records, site_dim
from ..spec import FIXTURE_SPEC as S
from .catalog import register
from .oracle import FACT, SITES, lenient_num, norm_flag, union_long

CATS = S.report_categoricals
CAT_LIST = ", ".join(CATS)


@register("rate_by_value", f"""WITH {FACT}, long AS ({union_long('fact', CATS)})
SELECT feature, value, count(*) AS n,
  CAST(sum(CASE WHEN _label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS positives,
  100.0::DOUBLE * CAST(sum(CASE WHEN _label = 1 THEN 1 ELSE 0 END) AS BIGINT) / count(*) AS rate
FROM long GROUP BY feature, value""")
def q_rate_by_value(spark, sf):
    return R.rate_by_value(fact_records(spark, sf), CATS)


@register("value_counts", f"""WITH {FACT}, long AS ({union_long('fact', CATS)})
SELECT feature, value, count(*) AS n, (SELECT count(*) FROM fact) AS total
FROM long GROUP BY feature, value""")
def q_value_counts(spark, sf):
    return R.value_counts(fact_records(spark, sf), CATS)


@register("numeric_distribution", f"""WITH {FACT}
SELECT {lenient_num('level')} AS value, count(*) AS n,
  CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS positives,
  100.0::DOUBLE * CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) / count(*) AS rate
FROM fact WHERE {lenient_num('level')} IS NOT NULL GROUP BY 1""")
def q_numeric_distribution(spark, sf):
    return R.numeric_distribution(fact_records(spark, sf), "level")


@register("overall_rate", f"""WITH {FACT}
SELECT count(*) AS n, CAST(coalesce(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS positives,
  coalesce(100.0::DOUBLE * CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) / nullif(count(*), 0), 0.0) AS rate
FROM fact""")
def q_overall_rate(spark, sf):
    return R.overall_rate(fact_records(spark, sf))


_HIST_LONG = """long AS (
  SELECT 'own_amt' AS "column", own_amt AS x FROM fact WHERE own_amt IS NOT NULL
  UNION ALL SELECT 'other_amt', other_amt FROM fact WHERE other_amt IS NOT NULL)"""

_HIST = f"""WITH {FACT}, {_HIST_LONG},
stats AS (SELECT "column", CAST(floor(min(x) / 5000.0) * 5000 AS BIGINT) AS bin_min,
                 CAST(ceil(max(x) / 5000.0) * 5000 AS BIGINT) AS bin_max FROM long GROUP BY 1),
st AS (SELECT *, greatest(bin_max - 5000, bin_min) AS last_start FROM stats),
spine AS (SELECT "column", unnest(range(bin_min, last_start + 1, 5000)) AS bin_start FROM st),
binned AS (SELECT l."column", least(CAST(floor(x / 5000.0) * 5000 AS BIGINT), last_start) AS bin_start
           FROM long l JOIN st ON l."column" = st."column"),
counts AS (SELECT "column", bin_start, count(*) AS n FROM binned GROUP BY 1, 2)"""


@register("histogram", _HIST + """
SELECT s."column", CAST(s.bin_start AS BIGINT) AS bin_start, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM spine s LEFT JOIN counts c ON s."column" = c."column" AND s.bin_start = c.bin_start""")
def q_histogram(spark, sf):
    return R.histogram(fact_records(spark, sf), S.histogram_columns, 5000.0)


@register("numeric_summary", f"""WITH {FACT}, {_HIST_LONG}
SELECT "column", min(x) AS min, max(x) AS max, round(avg(x), 6) AS mean,
  round(median(x), 6) AS median, count(*) AS n FROM long GROUP BY 1""")
def q_numeric_summary(spark, sf):
    from pyspark.sql import functions as F
    d = R.numeric_summary(fact_records(spark, sf), S.histogram_columns)
    return d.withColumn("mean", F.round("mean", 6)).withColumn("median", F.round("median", 6))


@register("rate_curve", f"""WITH {FACT}
SELECT CAST(level AS DOUBLE) AS x,
  100.0::DOUBLE * CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) / count(*) AS rate,
  count(*) AS n, CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS positives
FROM fact WHERE level IS NOT NULL GROUP BY 1""")
def q_rate_curve(spark, sf):
    return R.rate_curve(fact_records(spark, sf), "level")


@register("allow_list", f"""WITH {FACT}, {SITES}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, own_amt, area FROM fact
WHERE CAST(area AS DOUBLE) IN (SELECT CAST(area AS DOUBLE) FROM sites)""")
def q_allow_list(spark, sf):
    f = fact_records(spark, sf)
    return R.allow_list(f, "area", site_dim(spark, sf), "area").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "own_amt", "area")


@register("rate_curve_allowed", f"""WITH {FACT}, {SITES}
SELECT CAST(area AS DOUBLE) AS x,
  100.0::DOUBLE * CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) / count(*) AS rate,
  count(*) AS n, CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS positives
FROM fact WHERE CAST(area AS DOUBLE) IN (SELECT CAST(area AS DOUBLE) FROM sites) GROUP BY 1""")
def q_rate_curve_allowed(spark, sf):
    return R.rate_curve_allowed(fact_records(spark, sf), "area", site_dim(spark, sf), "area")


_CFG = ["item", "opt", "extra", "flag_a", "flag_b", "flag_c", "flag_d"]
_FLAGS = ["flag_a", "flag_b", "flag_c", "flag_d"]


@register("common_configs", f"""WITH {FACT}, norm AS (
  SELECT coalesce(nullif(CAST(item AS VARCHAR), ''), 'None') AS item,
         coalesce(nullif(CAST(opt AS VARCHAR), ''), 'None') AS opt,
         coalesce(TRY_CAST({lenient_num('extra')} AS INTEGER), 0) AS extra,
         {norm_flag('flag_a')} AS flag_a, {norm_flag('flag_b')} AS flag_b,
         {norm_flag('flag_c')} AS flag_c, {norm_flag('flag_d')} AS flag_d, label FROM fact),
g AS (SELECT item, opt, extra, flag_a, flag_b, flag_c, flag_d, count(*) AS n,
        CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS positives
      FROM norm GROUP BY ALL HAVING count(*) >= 2)
SELECT *, 100.0::DOUBLE * positives / n AS rate, 100.0::DOUBLE * positives / n >= 50.0 AS likely
FROM g ORDER BY n DESC, item, opt, extra, flag_a, flag_b, flag_c, flag_d LIMIT 20""")
def q_common_configs(spark, sf):
    return R.common_configs(fact_records(spark, sf), _CFG, _FLAGS, "extra")


@register("class_balance", f"""WITH {FACT}
SELECT label, count(*) AS n FROM fact GROUP BY 1""")
def q_class_balance(spark, sf):
    return R.class_balance(fact_records(spark, sf))


@register("vocabulary", f"""WITH {FACT}
SELECT DISTINCT 'item' AS "column", item AS value FROM fact WHERE item IS NOT NULL
UNION SELECT DISTINCT 'opt', opt FROM fact WHERE opt IS NOT NULL
UNION SELECT DISTINCT 'site_type', site_type FROM fact WHERE site_type IS NOT NULL""")
def q_vocabulary(spark, sf):
    return R.vocabulary(fact_records(spark, sf), ["item", "opt", "site_type"])


@register("stats_union", _HIST + f""",
clong AS ({union_long('fact', CATS)})
SELECT 'distribution' AS kind, feature, value, count(*) AS n FROM clong GROUP BY 2, 3
UNION ALL
SELECT 'numeric', 'level', CAST(CAST(level AS DOUBLE) AS VARCHAR), count(*) FROM fact GROUP BY 3
UNION ALL
SELECT 'histogram', s."column", CAST(s.bin_start AS VARCHAR), CAST(coalesce(c.n, 0) AS BIGINT)
FROM spine s LEFT JOIN counts c ON s."column" = c."column" AND s.bin_start = c.bin_start""")
def q_stats_union(spark, sf):
    return R.stats_union(fact_records(spark, sf), CATS, "level", S.histogram_columns)
